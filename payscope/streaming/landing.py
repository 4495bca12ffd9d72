"""Daily lists as they land: a state for each day, bad answers set aside and asked again.

An answer is a list, an empty day, or neither: a rate limit is answered like a list but isn't one, and taking it for one
would lose a day's filings without a word.  A day that has its list, or is known to be empty, is settled, and later answers about it
change nothing.  After a bad answer the day is to be asked again after a pause that doubles, and after five it has failed.
The clock is that of the answers themselves, so a replay comes to the same states, whatever the size of its batches.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from payscope.operators.resolution import filing_status
from payscope.sources.files import FILING_LIST

#: Bad answers after which a day has failed; the pause after the i-th is 2^i seconds.
MOST_ANSWERS = 5
#: The state store that keeps timers and typed states.
STATE_STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
ANSWER = "day DATE, at TIMESTAMP, file STRING, body STRING"
EVENT = "day DATE, event STRING, at TIMESTAMP, answers INT, file STRING"
#: Times within the state are microseconds since 1970.
_KNOWN = "status STRING, answers INT, at LONG, file STRING, due LONG"
_EVENT = "day DATE, event STRING, at LONG, answers INT, file STRING"
_SECOND = 1_000_000


def landed_answers(spark: SparkSession, landing: str, most_files: int = 1000) -> DataFrame:
    """A stream of answers that land as one file each, named by its day (ANSWER); the time of an answer is that of its file."""
    raw = spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", most_files).load(landing)
    name = F.col("_metadata.file_name")
    return raw.select(
        F.regexp_extract(name, r"(\d{4}-\d{2}-\d{2})", 1).try_cast("date").alias("day"), F.col("_metadata.file_modification_time").alias("at"), name.alias("file"), F.col("value").alias("body")
    ).where("day IS NOT NULL")


def classified(answers: DataFrame) -> DataFrame:
    """``answers`` (ANSWER) with ``status``: ok, empty or bad.  What is no JSON object is bad."""
    parsed = answers.withColumn("_list", F.from_json("body", FILING_LIST))
    return parsed.withColumns({"metadata": F.col("_list.metadata"), "results": F.col("_list.results")}).withColumn("status", F.coalesce(filing_status(), F.lit("bad"))).drop("_list", "metadata", "results")


class DayState(StatefulProcessor):
    """One day's state, its answers taken in the order of their time."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.known = handle.getValueState("known", _KNOWN)

    def handleInputRows(self, key: Any, rows: Iterator[Row], timerValues: Any) -> Iterator[Row]:  # noqa: N802, N803
        day = key[0]
        status, answers, last, file, due = self.known.get() if self.known.exists() else ("open", 0, None, None, None)
        for row in sorted(rows, key=lambda r: (r["at"], r["file"])):
            if status in ("ok", "empty", "failed"):
                break  # settled: what comes later changes nothing
            if last is not None and (row["at"], row["file"]) <= (last, file):
                continue  # seen already, by a replay of the landing
            last, file, answers = row["at"], row["file"], answers + 1
            if due is not None:
                self.handle.deleteTimer(_millis(due))
                due = None
            if row["status"] != "bad":
                status = row["status"]
                yield Row(day=day, event=status, at=last, answers=answers, file=file)
                continue
            yield Row(day=day, event="quarantined", at=last, answers=answers, file=file)
            if answers >= MOST_ANSWERS:
                status = "failed"
                yield Row(day=day, event="failed", at=last, answers=answers, file=file)
                continue
            due = last + 2**answers * _SECOND
            # A pause that is over by the clock of the answers is reported at once; the others by their timers.
            if _millis(due) <= timerValues.getCurrentWatermarkInMs():
                yield Row(day=day, event="ask", at=due, answers=answers, file=file)
                due = None
            else:
                self.handle.registerTimer(_millis(due))
        self.known.update((status, answers, last, file, due))

    def handleExpiredTimer(self, key: Any, timerValues: Any, expiredTimerInfo: Any) -> Iterator[Row]:  # noqa: N802, N803
        status, answers, last, file, due = self.known.get()
        if status == "open" and due is not None and _millis(due) == expiredTimerInfo.getExpiryTimeInMs():
            self.known.update((status, answers, last, file, None))
            yield Row(day=key[0], event="ask", at=due, answers=answers, file=file)

    def close(self) -> None:
        pass


def _millis(micros: int) -> int:
    return -(-micros // 1000)


def day_events(answers: DataFrame, late: str = "0 seconds") -> DataFrame:
    """The stream of what happens to days (EVENT) from a stream of answers (ANSWER): ok, empty, quarantined, ask, failed.

    Needs STATE_STORE as ``spark.sql.streaming.stateStore.providerClass``.  A day is a key, so its state
    is a row, however many days there are.
    """
    rows = classified(answers).select("day", F.col("at").alias("clock"), F.unix_micros("at").alias("at"), "file", "status").withWatermark("clock", late)
    events = rows.groupBy("day").transformWithState(DayState(), _EVENT, "append", "eventTime")
    return events.withColumn("at", F.timestamp_micros("at"))


def keep_events(answers: DataFrame, table: str, checkpoint: str, late: str = "0 seconds") -> StreamingQuery:
    """Writes the events of all that has landed since the last run behind those of ``table`` (Parquet)."""
    answers.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", STATE_STORE)
    out = day_events(answers, late).writeStream.format("parquet").outputMode("append")
    return out.option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def day_states(events: DataFrame) -> DataFrame:
    """(day, state, answers, ask_at) from events: the last state of each day; ``ask_at`` for those that are to be asked again."""
    order = F.struct("at", F.when(F.col("event") == "quarantined", 0).when(F.col("event") == "ask", 1).otherwise(2).alias("k"))
    last = events.groupBy("day").agg(F.max_by(F.struct("event", "answers", "at"), order).alias("e"))
    settled = F.col("e.event").isin("ok", "empty", "failed")
    pause = F.timestamp_seconds(F.unix_seconds("e.at") + F.pow(F.lit(2), F.col("e.answers")).cast("long"))
    return last.select(
        "day", F.when(settled, F.col("e.event")).otherwise("open").alias("state"), F.col("e.answers").alias("answers"),
        F.when(~settled, F.when(F.col("e.event") == "ask", F.col("e.at")).otherwise(pause)).alias("ask_at"),
    )


def settled_lists(answers: DataFrame, events: DataFrame) -> DataFrame:
    """The answers that settled a day with its list: what ``filing_lists`` may read of a landing without any other check."""
    return answers.join(events.where("event = 'ok'").select("day", "file"), ["day", "file"], "left_semi")
