"""Windows over time: sliced hot keys must equal the plain window and a brute-force loop."""

import random

from pyspark.sql import functions as F

from auditloom.functions import sizing, skew
from auditloom.operators import policy, state
from auditloom.operators.policy import toggle_asof


def rows_of(seed, n=400):
    rng = random.Random(seed)
    at, rows = 0, []
    for i in range(n):
        at += rng.randrange(0, 12)
        key = 1 if rng.random() < 0.7 else rng.choice([2, 3, None])
        rows.append((key, at, at + rng.randrange(0, 300), i, rng.random() < 0.5, rng.randrange(1, 4)))
    return rows


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, a long, b long, i long, flag boolean, wait int")


def test_concurrency_profile(spark):
    rows = rows_of(1)
    want = {}
    for k in {r[0] for r in rows}:
        mine = [r for r in rows if r[0] == k]
        for t in {r[1] for r in mine} | {r[2] for r in mine}:
            want[(k, t)] = sum(1 for r in mine if r[1] <= t < r[2])
    for hot_rows in (50, 10_000):
        profile = state.concurrency_profile(frame(spark, rows), "k", "a", "b", hot_rows=hot_rows)
        assert {(r.k, r.t_us): r.active for r in profile.collect()} == want
        peaks = {r.k: (r.peak, r.peak_us) for r in state.concurrency_peak(profile, "k").collect()}
        for k, (peak, at) in peaks.items():
            best = max(v for (kk, _), v in want.items() if kk == k)
            assert peak == best and at == min(t for (kk, t), v in want.items() if kk == k and v == best)


def test_deadline(spark):
    rows = rows_of(2)
    grace = 10
    want = {}
    for k, at, _, i, arm, _ in rows:
        if arm:
            later = [r[1] for r in rows if r[0] == k and not r[4] and at <= r[1] <= at + grace]
            want[i] = ("confirmed", min(later)) if later else ("rollback", None)
    for hot_rows in (50, 10_000):
        judged = state.deadline_absence(
            frame(spark, rows), "k", "a", F.col("flag"), ~F.col("flag"), grace, hot_rows=hot_rows
        )
        assert {r.i: (r.outcome, r.confirm_us) for r in judged.collect()} == want


def test_deadline_edges(spark):
    rows = [(1, 0, 0, 1, True, 1), (1, 180, 0, 2, False, 1), (2, 0, 0, 3, True, 1), (2, 181, 0, 4, False, 1)]
    judged = state.deadline_absence(frame(spark, rows), "k", "a", F.col("flag"), ~F.col("flag"), 180)
    assert {r.i: r.outcome for r in judged.collect()} == {1: "confirmed", 3: "rollback"}


def test_early_retry(spark):
    rows = [(k, a * 700_000, b, i, flag, wait) for k, a, b, i, flag, wait in rows_of(3)]
    want, last = {}, {}
    for k, at, _, i, ok, wait in sorted(rows, key=lambda r: (r[1], r[3])):
        denied = last.get(k)
        left = max(0, denied[0] + denied[1] * 1_000_000 - at) if denied else 0
        want[i] = (denied[0] if denied else None, left, left > 0)
        if not ok:
            last[k] = (at, wait)
    for hot_rows in (50, 10_000):
        got = state.early_retry(frame(spark, rows), "k", "a", "i", "flag", "wait", hot_rows=hot_rows)
        assert {r.i: (r.denied_us, r.wait_left_us, r.early) for r in got.collect()} == want


def test_toggle_asof(spark, monkeypatch):
    rng = random.Random(4)
    changes = [(s, rng.randrange(0, 5000), c, rng.choice(["up", "down", "disable"])) for c in range(60) for s in (1, 2)]
    flows = [(rng.choice([1, 2, 3]), rng.randrange(-50, 6000), i) for i in range(500)]
    want = {}
    for s, at, i in flows:
        seen = [c for c in changes if c[0] == s and c[1] <= at and c[3] != "down"]
        want[i] = max(seen, key=lambda c: (c[1], c[2]))[3] == "up" if seen else False
    flow_df = spark.createDataFrame(flows, "site long, ts long, i long")
    change_df = spark.createDataFrame(changes, "site long, ts long, c long, action string")
    assert {r.i: r.kill_switch for r in toggle_asof(flow_df, change_df, "ts", "site", "c").collect()} == want
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=1: sizing.policy_rows(t, 1))
    for hot_rows in (60, 10_000):
        got = toggle_asof(flow_df, change_df, "ts", "site", "c", hot_rows=hot_rows)
        assert {r.i: r.kill_switch for r in got.collect()} == want


def test_orphans(spark):
    names = spark.createDataFrame([("run-1",), ("run-2",), ("other",)], "name string")
    ended = spark.createDataFrame([("run-1",), ("run-1",), ("run-9",)], "name string")
    assert [r.name for r in state.orphan_sweep(names, ended, "name", "run-").collect()] == ["run-2"]
    pairs = state.orphan_pairs(names, ended, "name", ("a", "b")).collect()
    assert {(r.name, r.missing_from) for r in pairs} == {("run-2", "b"), ("other", "b"), ("run-9", "a")}


def test_slices_hold_equal_shares_of_bursts(spark):
    """98 of 100 rows inside ten time units, and a key with a single time."""
    rng = random.Random(7)
    rows = [(1, rng.randrange(10) if i % 50 else i * 100, i) for i in range(10_000)] + [(2, 5, i) for i in range(3_000)] + [(3, i, i) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, a long, i long")
    limit = 1_000
    hot = skew.hot_keys(df, "k", limit)
    assert sorted(hot.keys) == [1, 2]
    sliced, any_hot = skew.with_slices(df, "k", ["a", "i"], hot)
    sizes = sliced.groupBy("k", "_slice", "_hot").agg(F.count("*").alias("n"), F.min(F.struct("a", "i")).alias("lo"), F.max(F.struct("a", "i")).alias("hi")).collect()
    assert any_hot and max(r.n for r in sizes if r._hot) <= limit and sum(r.n for r in sizes) == len(rows)
    for key in (1, 2):
        pieces = sorted((r for r in sizes if r.k == key), key=lambda r: r._slice)
        assert all(tuple(a.hi) < tuple(b.lo) for a, b in zip(pieces, pieces[1:])) and len(pieces) > 3
    assert [r.n for r in sizes if r.k == 3] == [90]


def test_open_intervals_stay_active(spark):
    rows = [(1, 0, None, 1), (1, 5, 8, 2), (2, 3, None, 3)]
    df = spark.createDataFrame(rows, "k long, a long, b long, i long")
    got = {(r.k, r.t_us): r.active for r in state.concurrency_profile(df, "k", "a", "b").collect()}
    assert got == {(1, 0): 1, (1, 5): 2, (1, 8): 1, (2, 3): 1}


def test_toggle_rows_grow_with_the_input_alone(spark, monkeypatch):
    """Changes years apart: no row but one per flow and change."""
    year = 365 * 86_400 * 1_000_000
    changes = spark.createDataFrame([(n, n % 20, n * 3 * year, "up") for n in range(200)], "c long, site long, ts long, action string")
    flows = spark.createDataFrame([(i % 20, i * year) for i in range(100)], "site long, ts long")
    monkeypatch.setattr(policy, "policy_rows", lambda t, n=1: sizing.policy_rows(t, 1))
    looked = toggle_asof(flows, changes, "ts", "site", "c")
    looked.collect()
    assert "sequence" not in looked._jdf.queryExecution().executedPlan().toString().lower()


def test_a_low_limit_over_many_rows_asks_for_few_pieces(spark):
    """One key of 20,000 rows, a limit of 10: a piece per limit would be 16,000 tasks."""
    df = spark.range(20_000).selectExpr("0L AS k", "id AS a")
    assert skew.hot_keys(df, "k", 10).pieces == skew.MOST_PIECES
    assert skew.hot_keys(df, "k", 2_000).pieces == 80
