"""Token bucket and concurrency cap against a plain loop."""

import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from auditloom.functions import skew
from auditloom.operators import admission
from auditloom.operators.admission import (
    _LeadMap,
    bucket_step,
    bucket_units,
    concurrency_admit,
    image_of,
    rate_limit_label,
    throttle_label,
)


@pytest.fixture(autouse=True)
def few_rounds(monkeypatch):
    """Answers do not depend on the rounds of trials; their jobs take the time of these tests."""
    monkeypatch.setattr(admission, "TRIALS", 2)


def naive_bucket(rows, per, period, burst):
    token, cap, refill = bucket_units(per, period, burst)
    state, out = {}, {}
    for k, at, i in sorted(rows, key=lambda r: (r[1], r[2])):
        units, last = state.get(k, (cap, at))
        level = min(cap, units + (at - last) * refill)
        if level >= token:
            out[i] = (True, 0)
            state[k] = (level - token, at)
        else:
            wait = 60 if refill <= 0 else max(1, -(-(token - level) // (refill * 1_000_000)))
            out[i] = (False, wait)
            state[k] = (level, at)
    return out


def naive_slots(rows, limit):
    state, out = {}, {}
    for k, a, b, i in sorted(rows, key=lambda r: (r[1], r[3])):
        ends = [e for e in state.get(k, []) if e > a]
        out[i] = len(ends) < limit
        state[k] = ends + [b] if out[i] else ends
    return out


@settings(max_examples=400, deadline=None)
@given(
    gaps=st.lists(st.integers(0, 40), min_size=1, max_size=60),
    token=st.integers(1, 30),
    burst=st.integers(1, 4),
    refill=st.integers(0, 4),
    cut=st.integers(0, 59),
)
def test_lead_map_carries_any_start(gaps, token, burst, refill, cut):
    cap = burst * token
    times, at = [], 0
    for g in gaps:
        at += g
        times.append(at)
    cut = min(cut, len(times) - 1)
    fractional, real, last = cap, cap, times[0]
    for at in times[:cut]:
        gain = (at - last) * refill
        fractional = max(0, min(cap, fractional + gain) - token)
        real = bucket_step(real, at - last, token, cap, refill)[2]
        last = at
    assert 0 <= real - fractional < token
    for lead in range(token):
        if fractional + lead > cap:
            break
        lead_map = _LeadMap(token, cap, refill, fractional, last)
        c, t, before = fractional, fractional + lead, last
        for at in times[cut:]:
            lead_map.add(at)
            gain = (at - before) * refill
            c = max(0, min(cap, c + gain) - token)
            t = bucket_step(t, at - before, token, cap, refill)[2]
            before = at
        pieces = lead_map.pieces()
        held = [p for p in pieces if p[0] <= lead]
        assert image_of(lead, held[-1] if held else pieces[-1], token) == t - c


def bucket_frame(spark, rows):
    return spark.createDataFrame(rows, "k long, at long, i long")


def check_bucket(spark, rows, per, period, burst, hot_rows):
    labelled = rate_limit_label(
        bucket_frame(spark, rows), "k", "at", "i", per, period, burst, hot_rows=hot_rows
    )
    got = {r.i: (r.allowed, r.retry_after) for r in labelled.collect()}
    assert got == naive_bucket(rows, per, period, burst)


def test_bucket_edges(spark):
    day = 86_400_000_000
    rows = [(1, 0, 1), (1, 0, 2), (1, 0, 3), (1, day // 2, 4), (1, day, 5), (2, 5, 6), (None, 9, 7)]
    check_bucket(spark, rows, 2, day, 0, 1000)
    check_bucket(spark, rows, 0, day, 1, 1000)
    check_bucket(spark, rows, 2, day, 2, 1000)


def test_bucket_hot_key_in_slices(spark):
    for seed, (per, period, burst, gap) in enumerate(
        [(3, 1000, 4, 200), (3, 1000, 1, 200), (5, 977, 3, 190)]
    ):
        rng = random.Random(seed)
        rows, at = [], 0
        for i in range(1500):
            at += rng.randrange(0, gap * 2) if rng.random() > 0.01 else 20 * period
            rows.append((7 if rng.random() < 0.8 else rng.choice([1, 2, None]), at, i))
        check_bucket(spark, rows, per, period, burst, 200)


def check_slots(spark, rows, limit, hot_rows):
    df = spark.createDataFrame(rows, "k long, a long, b long, i long")
    labelled = concurrency_admit(df, "k", "a", "b", "i", limit, hot_rows=hot_rows)
    collected = labelled.collect()
    assert {r.i: r.admitted for r in collected} == naive_slots(rows, limit)
    assert all(r.retry_after == (0 if r.admitted else 5) for r in collected)


def test_slots_edges(spark):
    check_slots(spark, [(1, 0, 10, 1), (1, 10, 20, 2), (1, 10, 20, 3), (1, 19, 21, 4), (2, 5, 5, 5), (2, 5, 9, 6)], 1, 1000)


def test_slots_hot_key_in_slices(spark):
    for seed, longest in enumerate([300, 2000]):
        rng = random.Random(seed)
        rows, at = [], 0
        for i in range(900):
            at += rng.randrange(0, 100)
            rows.append((7 if rng.random() < 0.8 else rng.choice([1, None]), at, at + rng.randrange(0, longest), i))
        check_slots(spark, rows, 3, 200)


def test_slots_with_open_ends_and_renewals(spark):
    for seed, (longest, idle) in enumerate([(50, 0.05), (5000, 0.0), (300, 0.01)]):
        rng = random.Random(seed + 20)
        rows, at = [], 0
        for i in range(1200):
            at += 10_000 if rng.random() < idle else rng.randrange(0, 60)
            end = None if rng.random() < 0.002 else at + rng.randrange(0, longest)
            rows.append((7 if rng.random() < 0.8 else rng.choice([1, None]), at, end, i))
        df = spark.createDataFrame(rows, "k long, a long, b long, i long")
        want = naive_slots([(k, a, 10**15 if b is None else b, i) for k, a, b, i in rows], 3)
        for hot_rows in (150, 10_000) if longest < 5000 else (150,):
            got = concurrency_admit(df, "k", "a", "b", "i", 3, hot_rows=hot_rows).collect()
            assert {r.i: r.admitted for r in got} == want


def test_both_limits_in_one_fold(spark):
    rng = random.Random(31)
    rows, at = [], 0
    for i in range(900):
        at += rng.randrange(0, 400)
        rows.append((7 if rng.random() < 0.7 else rng.choice([1, None]), at, at + rng.randrange(0, 3000), i, rng.random() < 0.9))
    df = spark.createDataFrame(rows, "k long, a long, b long, i long, ok boolean")
    bucket = naive_bucket([(k, a, i) for k, a, _, i, ok in rows if ok], 3, 1000, 2)
    slots = naive_slots([(k, a, b, i) for k, a, b, i, ok in rows if ok and bucket[i][0]], 2)
    want = {i: (*bucket.get(i, (None, None)), slots.get(i)) for *_, i, _ in rows}
    for hot_rows in (100, 10_000):
        got = throttle_label(df, "k", "a", "b", "i", 3, 1000, 2, 2, when="ok", hot_rows=hot_rows).collect()
        assert {r.i: (r.rate_allowed, r.rate_retry_after, r.slot_admitted) for r in got} == want
        assert all(r.slot_retry_after == {None: None, True: 0, False: 5}[r.slot_admitted] for r in got)


def never_idle(seed, n, shape):
    """Rows of one key with a row running at any time: mixed lengths, or two phases that never meet."""
    rng = random.Random(seed)
    if shape == "phases":
        return [(7, 10 * i, 10 * i + 15, i) for i in range(n)]
    if shape == "drift":
        return [(7, 10 * i, 10 * i + 10 * rng.choice([1, 2, 3]) + 5, i) for i in range(n)]
    rows, at = [], 0
    for i in range(n):
        at += rng.randrange(0, 40)
        rows.append((7, at, at + (10**7 if rng.random() < 0.001 else rng.randrange(200, 800)), i))
    return rows


@pytest.mark.parametrize("shape, limit", [("mixed", 4), ("phases", 1), ("drift", 2)])
def test_slots_of_a_key_that_never_idles(spark, shape, limit, monkeypatch):
    monkeypatch.setattr(admission, "PIECES_PER_LIMIT", 1)
    monkeypatch.setattr(admission, "TRIALS", 3)
    rows = never_idle(5, 1500, shape)
    df = spark.createDataFrame(rows, "k long, a long, b long, i long")
    want = naive_slots(rows, limit)
    states = admission._with_states(*sliced(df), "k", "a", "b", "i", limit).select("_slice").distinct().count()
    assert {r.i: r.admitted for r in concurrency_admit(df, "k", "a", "b", "i", limit, hot_rows=150).collect()} == want
    if shape != "mixed":  # many tasks: the slices of the key stay apart
        assert states > 10
        return
    monkeypatch.setattr(admission, "TRIALS", 1)  # states that have not settled: one piece from there on
    assert {r.i: r.admitted for r in concurrency_admit(df, "k", "a", "b", "i", limit, hot_rows=150).collect()} == want


def sliced(df):
    rows, _ = skew.with_slices(df.withColumn("_counts", F.lit(True)), "k", ["a", "i"], skew.hot_keys(df, "k", 150))
    return [rows]
