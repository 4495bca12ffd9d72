"""Pay analytics on Spark: curve-adjusted salaries, rankings, histories and registry joins."""
