"""Streams split over many micro-batches must equal the batch operators."""

import random

from pyspark.sql import functions as F

from auditloom.operators.admission import rate_limit_label
from auditloom.operators.state import deadline_absence
from auditloom.session import run_folder
from auditloom.streaming.deadline import deadline_stream
from auditloom.streaming.rate_limit import rate_limit_stream
from auditloom.streaming.run import read_stream, run_available

SECOND = 1_000_000


def batches(spark, rows, schema, parts):
    """One file per part, in time order."""
    folder = run_folder(spark, "test-input")
    size = -(-len(rows) // parts)
    for n in range(parts):
        part = rows[n * size : (n + 1) * size]
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(folder)
    return folder


def test_rate_limit_stream_equals_batch(spark):
    rng = random.Random(1)
    rows, at = [], 1_700_000_000 * SECOND
    for i in range(300):
        # Some gaps are long enough for a full bucket, so states are dropped on the way.
        at += rng.randrange(0, 3 * SECOND) if rng.random() < 0.97 else 200 * SECOND
        rows.append((rng.choice([1, 1, 1, 2, 3]), at, i))
    folder = batches(spark, rows, "k long, at long, i long", 4)
    want = rate_limit_label(spark.read.parquet(folder), "k", "at", "i", 10, 60 * SECOND, 3)
    stream = rate_limit_stream(read_stream(spark, folder, max_files=1), "k", "at", "i", 10, 60 * SECOND, 3)
    got = run_available(stream, "test-rate")
    assert {tuple(r) for r in got.collect()} == {tuple(r) for r in want.collect()}
    assert got.where("NOT allowed").count() > 20


def test_deadline_stream_equals_batch(spark):
    rng = random.Random(2)
    rows, at = [], 1_700_000_000 * SECOND
    for i in range(200):
        at += rng.randrange(0, 4 * SECOND)
        rows.append((rng.choice([1, 2, 3]), at, i, rng.random() < 0.6))
    edge = at + 500 * SECOND
    rows += [(7, edge, 900, True), (7, edge + 10 * SECOND, 901, False), (8, edge + 11 * SECOND, 902, True)]
    # A late row moves the watermark past every deadline.
    rows += [(9, edge + 900 * SECOND, 903, False)]
    folder = batches(spark, rows, "k long, at long, i long, arm boolean", 4)
    arm, confirm = F.col("arm"), ~F.col("arm")
    want = deadline_absence(spark.read.parquet(folder), "k", "at", arm, confirm, 10 * SECOND)
    stream = deadline_stream(read_stream(spark, folder, max_files=1), "k", "i", "at", arm, confirm, 10 * SECOND)
    got = run_available(stream, "test-deadline")
    names = ("i", "k", "due_us", "confirm_us", "outcome")
    result = {tuple(r[n] for n in names) for r in got.collect()}
    assert result == {tuple(r[n] for n in names) for r in want.collect()}
    outcomes = {r[0]: r[4] for r in result}
    assert outcomes[900] == "confirmed" and outcomes[902] == "rollback"


def test_a_stopped_stream_goes_on_from_its_folder(spark):
    rng = random.Random(3)
    rows, at = [], 1_700_000_000 * SECOND
    for i in range(200):
        at += rng.randrange(0, 3 * SECOND)
        rows.append((rng.choice([1, 2]), at, i))
    source, target = run_folder(spark, "test-input") + "/rows", run_folder(spark, "test-resume")
    schema = "k long, at long, i long"
    for part in (rows[:90], rows[90:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(source)
        stream = rate_limit_stream(read_stream(spark, source), "k", "at", "i", 10, 60 * SECOND, 3)
        got = run_available(stream, "test-resume", folder=target)
    want = rate_limit_label(spark.read.parquet(source), "k", "at", "i", 10, 60 * SECOND, 3)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_event_files_are_made_from_their_own_rows(spark, tmp_path, monkeypatch):
    """Each batch's file is read from a folder of its own, holds all its rows and follows the one before."""
    from auditloom.plans import stream_queries

    monkeypatch.setattr(stream_queries, "ROWS_PER_FILE", 40)
    monkeypatch.setattr(stream_queries, "run_folder", lambda spark, name: str(tmp_path / name))
    rows = spark.range(200).selectExpr("id AS event_id", "timestamp_ntz '2024-01-01 00:00:00' + make_dt_interval(0, 0, 0, id * id % 1009) AS ts")
    rows.unionByName(spark.sql("SELECT 900L AS event_id, CAST(NULL AS timestamp_ntz) AS ts")).repartition(3).write.parquet(str(tmp_path / "events.parquet"))
    stream_queries._events(spark, str(tmp_path))
    home = tmp_path / "event-files"
    assert len(list((home / "dealt").glob("_part=*"))) == 9
    files = sorted((home / "rows").glob("part-*.parquet"), key=lambda f: f.stat().st_mtime_ns)
    spans = [spark.read.parquet(str(f)).selectExpr("min(ts)", "max(ts)", "count(*)").first() for f in files]
    assert len(files) == 9 and sum(s[2] for s in spans) == 200 and all(a[1] < b[0] for a, b in zip(spans, spans[1:]))


def test_streams_of_many_keys_work_by_group(spark, monkeypatch):
    """Keys that share a group, a null key, large numbers next to null ones: as the batch operators, with a state per group."""
    from auditloom.streaming import groups

    monkeypatch.setattr(groups, "GROUPS", 3)
    rng = random.Random(5)
    rows, at = [], 1_700_000_000 * SECOND
    for i in range(600):
        at += rng.randrange(0, SECOND) if rng.random() < 0.97 else 60 * SECOND
        rows.append((rng.choice([None, 0, *range(1, 40)]), at, None if i % 50 == 0 else 2**60 + i, rng.random() < 0.6))
    rows.append((99, at + 900 * SECOND, 1, False))
    folder = batches(spark, rows, "k long, at long, i long, arm boolean", 4)
    table, arm, confirm = spark.read.parquet(folder), F.col("arm"), ~F.col("arm")
    want = rate_limit_label(table, "k", "at", "i", 10, 60 * SECOND, 2)
    got = run_available(rate_limit_stream(read_stream(spark, folder, max_files=1), "k", "at", "i", 10, 60 * SECOND, 2), "test-rate", folder=(target := run_folder(spark, "test-groups")))
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    assert got.where("NOT allowed").count() > 5
    state = spark.read.format("statestore").option("stateVarName", "buckets").load(f"{target}/checkpoint")
    assert state.count() <= 4
    want = deadline_absence(table, "k", "at", arm, confirm, 10 * SECOND)
    judged = run_available(deadline_stream(read_stream(spark, folder, max_files=1), "k", "i", "at", arm, confirm, 10 * SECOND), "test-deadline")
    names = ("i", "k", "due_us", "confirm_us", "outcome")
    assert sorted(repr(tuple(r[n] for n in names)) for r in judged.collect()) == sorted(repr(tuple(r[n] for n in names)) for r in want.collect())


def test_a_group_is_read_and_written_once_a_batch():
    """One state call each way however many keys a group has, and a timer that moves with what is held."""
    import pandas as pd

    from auditloom.streaming.deadline import _Deadlines
    from auditloom.streaming.rate_limit import _Buckets

    class Handle:
        def __init__(self):
            self.value, self.calls, self.timers = None, [], set()

        def getValueState(self, name, schema):
            return self

        def get(self):
            self.calls.append("get")
            return self.value

        def update(self, value):
            self.calls.append("update")
            self.value = value

        def clear(self):
            self.value = None

        def registerTimer(self, at):
            self.timers.add(at)

        def deleteTimer(self, at):
            self.timers.remove(at)

    class Now:
        def getCurrentWatermarkInMs(self):
            return 0

    handle, buckets = Handle(), _Buckets("k", "at", ["at", "i"], 60 * SECOND, 120 * SECOND, 10)
    buckets.init(handle)
    for n in range(2):
        part = pd.DataFrame({"k": range(500), "at": [n * SECOND + i for i in range(500)], "i": range(500)})
        assert len(next(buckets.handleInputRows((1,), iter([part[:200], part[200:]]), Now()))) == 500
    assert handle.calls == ["get", "update"] * 2 and len(handle.timers) == 1
    handle, deadlines = Handle(), _Deadlines("k", "i", "at", 10 * SECOND)
    deadlines.init(handle)
    part = pd.DataFrame({"k": range(500), "at": [i * SECOND for i in range(500)], "i": range(500), "no_id": False, "is_arm": True, "is_confirm": False})
    assert list(deadlines.handleInputRows((1,), iter([part]), Now())) == []
    assert handle.calls == ["get", "update"] and handle.timers == {10_001}
    part = part.assign(is_arm=False, is_confirm=True, at=part["at"] + SECOND)[:300]
    (done,) = deadlines.handleInputRows((1,), iter([part]), Now())
    assert len(done) == 300 and handle.calls == ["get", "update"] * 2 and handle.timers == {310_001}
