import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import hard_negatives
from auditloom.llm.hard_negatives import component_limit, encode, integers, intervals, mine_hard_negatives
from tests.llm.vectors_odd import odd_vectors, usable_rows, vectors_frame


def brute_force(rows, every=50, positives=5, negatives=3):
    usable = usable_rows([r for r in rows if r[2] is not None], zero=True)
    numbers = {}
    for i, vector, _ in usable:
        most = component_limit(len(vector))
        numbers[i] = [max(-most, min(most, math.floor(256 * x))) for x in vector]
    out = set()
    for a, vector, label in usable:
        if a % every:
            continue
        scored = sorted(
            (-sum(x * y for x, y in zip(numbers[a], numbers[i])), i, other) for i, v, other in usable if i != a and len(v) == len(vector)
        )
        for score, p, _ in [s for s in scored if s[2] == label][:positives]:
            goal = -score
            fits = [(-s, i) for s, i, other in scored if other != label and 50 * goal <= -100 * s <= 95 * goal]
            out |= {(a, p, rank, i, goal, s) for rank, (s, i) in enumerate(fits[:negatives], 1)}
    return out


def mined(df, **options):
    rows = mine_hard_negatives(df, F.col("vec_id") % 50 == 0, **options).collect()
    assert len(set(rows)) == len(rows)
    return {tuple(r) for r in rows}


def test_odd_vectors_equal_brute_force(spark):
    rows = odd_vectors()
    want = brute_force(rows)
    assert len(want) > 20 and mined(vectors_frame(spark, rows, clash=True)) == want


def test_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(hard_negatives, "block_rows", lambda count: 40)
    monkeypatch.setattr(hard_negatives, "ROWS_AT_ONCE", 16)
    rows = odd_vectors(seed=2)
    assert mined(vectors_frame(spark, rows), anchor_block=3) == brute_force(rows)


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(50, None, 1)], [(50, [1.0], None)], [(50, [1.0], 1)], [(None, [1.0], 1)] * 2, [(50, [1.0], 1), (51, [1.0], 2)]):
        assert mined(vectors_frame(spark, rows)) == set()


@pytest.mark.parametrize("dim", [1, 3, 64, 100])
def test_intervals_hold_every_score_and_pay(dim):
    rng = np.random.default_rng(dim)
    numbers = integers(rng.standard_normal((500, dim)) / np.sqrt(dim) * rng.uniform(0, 50, (500, 1)), 256)
    numbers[:5] = 0
    numbers[5:20] = numbers[5]
    words, alignments, rest = encode(numbers)
    lengths = np.sqrt((numbers.astype(float) ** 2).sum(axis=1))
    lower, upper = intervals(words, alignments, rest, lengths, numbers[::7].astype(np.int64))
    scores = numbers.astype(np.int64) @ numbers[::7].astype(np.int64).T
    assert (lower <= scores).all() and (scores <= upper).all()
    # The codes tell something: half widths stay far below the product of lengths, which is all that Cauchy-Schwarz alone gives.
    assert (upper - lower).mean() / 2 < 0.15 * np.outer(lengths, lengths[::7]).mean() + 1
