import itertools
import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from auditloom.llm.packing import optimal_boundaries, pack_by_length
from tests.llm.odd import frame, odd_rows, words_of


def padding(histogram, boundaries):
    return sum(n * (min(b for b in boundaries if b >= length) - length) for length, n in histogram)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=9), st.integers(1, 5))
def test_boundaries_are_optimal(counts, buckets):
    histogram = list(counts.items())
    got = optimal_boundaries(histogram, buckets)
    lengths = sorted(counts)
    assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) == min(buckets, len(lengths))
    best = min(
        padding(histogram, (*some, lengths[-1]))
        for some in itertools.combinations(lengths[:-1], min(buckets, len(lengths)) - 1)
    )
    assert padding(histogram, got) == best


def test_boundaries_of_a_large_histogram():
    rng = random.Random(3)
    histogram = [(n, rng.randrange(1, 1000)) for n in range(1, 8193)]
    got = optimal_boundaries(histogram, 12)
    for i in range(len(got) - 1):  # no boundary can be moved alone
        for step in (-1, 1):
            moved = sorted({*got[:i], got[i] + step, *got[i + 1 :]})
            assert padding(histogram, moved) >= padding(histogram, got)


def test_packing_covers_every_token_once(spark):
    rows = odd_rows()
    packed = pack_by_length(frame(spark, rows, clash=True), buckets=3, max_length=64, token_budget=256).collect()
    want = defaultdict(int)
    for row in rows:
        want[row[0]] += len(words_of(row[1])) + 1
    got, batches = defaultdict(int), defaultdict(list)
    for r in packed:
        assert 0 < r.length <= r.bucket <= 64 and r.padding == r.bucket - r.length and r.start == r.piece * 64
        got[r.doc_id] += r.length
        batches[r.bucket, r.batch].append(r.slot)
    assert got == want
    for (bucket, batch), slots in batches.items():
        assert sorted(slots) == list(range(len(slots))) and len(slots) <= 256 // bucket
        if (bucket, batch + 1) in batches:
            assert len(slots) == 256 // bucket
    histogram = defaultdict(int)
    for r in packed:
        histogram[r.length] += 1
    assert {r.bucket for r in packed} <= set(optimal_boundaries(list(histogram.items()), 3))


def test_packing_is_repeatable_and_takes_an_empty_table(spark):
    docs = frame(spark, [r for r in odd_rows() if r[0] is not None][:40])
    one = pack_by_length(docs, max_length=64, token_budget=256)
    two = pack_by_length(docs.repartition(5), max_length=64, token_budget=256)
    assert sorted(one.collect()) == sorted(two.collect())
    assert pack_by_length(frame(spark, [])).count() == 0
    with pytest.raises(ValueError):
        pack_by_length(docs, max_length=64, token_budget=32)
