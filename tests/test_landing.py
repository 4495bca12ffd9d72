"""Days and their answers: states, pauses, quarantine, replay."""

import datetime as dt
import json
import random

import pytest
from pyspark.sql import functions as F

from payscope.streaming import landing

T0 = dt.datetime(2024, 6, 20, 12, 0, 0)
BODIES = {
    "ok": json.dumps({"metadata": {"status": "200"}, "results": [{"docID": "S1"}]}),
    "empty": json.dumps({"metadata": {"status": "404"}}),
    "limit": json.dumps({"statusCode": "429", "message": "Too Many Requests"}),
    "none": json.dumps({"metadata": {"status": "200"}}),
    "text": "<html>busy</html>",
}


@pytest.fixture
def rocks(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield spark
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def run(spark, root, batches, checkpoint="c", table="t"):
    """The events of answers (day, seconds, file, kind) that land in batches."""
    for n, batch in enumerate(batches):
        folder = root / "in"
        folder.mkdir(exist_ok=True)
        rows = [json.dumps({"day": d, "at": (T0 + dt.timedelta(seconds=s)).isoformat() + "Z", "file": f, "body": BODIES[k]}) for d, s, f, k in batch]
        (folder / f"{n:03}.json").write_text("\n".join(rows))
        answers = spark.readStream.schema(landing.ANSWER).json(str(folder))
        landing.keep_events(answers, str(root / table), str(root / checkpoint)).awaitTermination()
    return sorted(((str(r.day)[-2:], int((r.at - T0).total_seconds()), r.event, r.answers, r.file) for r in spark.read.parquet(str(root / table)).collect()))


def plain(answers):
    """The same by the rules: one day after the other, its answers in order; a pause counts when the next answer or the end is past it."""
    out = []
    for day in {a[0] for a in answers}:
        own, status, n = sorted((s, f, k) for d, s, f, k in answers if d == day), "open", 0
        for s, f, k in own:
            if status != "open":
                break
            n += 1
            if k in ("ok", "empty"):
                status = k
                out.append((day[-2:], s, k, n, f))
            else:
                out.append((day[-2:], s, "quarantined", n, f))
                if n == 5:
                    status = "failed"
                    out.append((day[-2:], s, "failed", n, f))
    return sorted(out)


def test_states_and_pauses(rocks, tmp_path):
    first = [("2024-06-01", 0, "a", "limit"), ("2024-06-02", 0, "a", "ok"), ("2024-06-03", 1, "a", "empty"), ("2024-06-04", 1, "a", "text"), ("2024-06-05", 1, "a", "none")]
    second = [("2024-06-01", 10, "b", "ok"), ("2024-06-02", 11, "b", "limit"), ("2024-06-04", 12, "b", "limit")]
    third = [("2024-06-04", 20 + k, "cdefg"[k], "limit") for k in range(5)] + [("2024-06-06", 100, "a", "ok")]
    events = run(rocks, tmp_path, [first, second, third, [("2024-06-07", 200, "a", "ok")]])
    assert [e for e in events if e[2] != "ask"] == plain([*first, *second, *third, ("2024-06-07", 200, "a", "ok")])
    asked = {(d, s, n) for d, s, e, n, _ in events if e == "ask"}
    assert ("05", 3, 1) in asked  # 2 seconds after its only answer
    assert all((d, s - 2**n, "quarantined", n) in {e[:4] for e in events} for d, s, n in asked)
    states = {str(r.day)[-2:]: (r.state, r.answers, r.ask_at and int((r.ask_at - T0).total_seconds())) for r in landing.day_states(rocks.read.parquet(str(tmp_path / "t"))).collect()}
    assert states == {"01": ("ok", 2, None), "02": ("ok", 1, None), "03": ("empty", 1, None), "04": ("failed", 5, None), "05": ("open", 1, 3), "06": ("ok", 1, None), "07": ("ok", 1, None)}


def test_replay_and_other_batches_give_the_same_states(rocks, tmp_path):
    rng = random.Random(4)
    answers = [(f"2024-06-{d:02}", 40 * k + d, f"{k}", rng.choice(["limit", "text", "ok", "empty", "limit", "limit", "none"])) for d in range(1, 9) for k in range(7)]
    answers.sort(key=lambda a: a[1])
    (tmp_path / "one").mkdir()
    (tmp_path / "many").mkdir()
    one = run(rocks, tmp_path / "one", [answers])
    many = run(rocks, tmp_path / "many", [answers[k : k + 19] for k in range(0, len(answers), 19)] + [answers[:20]])  # the last lands again
    settled = lambda events: [e for e in events if e[2] != "ask"]
    assert settled(one) == settled(many) == plain(answers)
    state = lambda name: sorted(map(tuple, landing.day_states(rocks.read.parquet(str(tmp_path / name / "t"))).select("day", "state", "answers").collect()))
    assert state("one") == state("many")


def test_files_of_a_landing(rocks, tmp_path):
    """Answers as files; those that settled a day with a list are the ones to read."""
    (tmp_path / "lists").mkdir()
    for name, kind in {"list_2024-06-03.json": "ok", "list_2024-06-04.json": "limit", "list_2024-06-05.json": "empty", "readme.txt": "text"}.items():
        (tmp_path / "lists" / name).write_text(BODIES[kind])
    landing.keep_events(landing.landed_answers(rocks, str(tmp_path / "lists")), str(tmp_path / "t"), str(tmp_path / "c")).awaitTermination()
    events = rocks.read.parquet(str(tmp_path / "t"))
    assert sorted((r.file, r.event) for r in events.collect()) == [("list_2024-06-03.json", "ok"), ("list_2024-06-04.json", "quarantined"), ("list_2024-06-05.json", "empty")]
    again = rocks.read.text(str(tmp_path / "lists"), wholetext=True).select(F.lit("2024-06-03").cast("date").alias("day"), F.col("_metadata.file_name").alias("file"))
    assert [r.file for r in landing.settled_lists(again, events).collect()] == ["list_2024-06-03.json"]
