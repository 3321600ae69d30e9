import random
from collections import Counter, defaultdict

import pytest

from auditloom.llm.mixing import mix_documents, mix_draws, mix_totals, source_targets
from tests.llm.odd import SCHEMA, frame, odd_rows, prose, words_of


def targets_by_resharing(sizes, share=1.5):
    """Cut off what is above twice the size, share it again by weight, until nothing is above."""
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, full = share * sum(sizes.values()), {}
    while True:
        rest = [s for s in names if s not in full]
        left = budget - sum(full.values())
        total = sum(weights[s] for s in rest)
        target = {s: left * weights[s] / total for s in rest} if rest else {}
        above = [s for s in rest if target[s] > 2 * sizes[s]]
        if not above:
            return full | target
        full |= {s: 2.0 * sizes[s] for s in above}


def test_targets_equal_resharing(spark):
    rng = random.Random(5)
    for _ in range(5):
        sizes = {rng.choice(["a", "b", "é", "z", "Z", None, "q"]): rng.randrange(1, 1000) for _ in range(6)}
        units = spark.createDataFrame(list(sizes.items()), "source string, unit_words long")
        got = {r.source: r.target for r in source_targets(units, "source").collect()}
        assert got == pytest.approx(targets_by_resharing(sizes))


def test_totals_come_near_the_targets(spark):
    rows = odd_rows()
    docs = frame(spark, rows, clash=True)
    got = mix_totals(docs, block_words=200).collect()
    assert Counter((r.doc_id, r.size) for r in got) == Counter((r[0], len(words_of(r[1]))) for r in rows)
    again = mix_totals(docs.repartition(5), block_words=200).collect()
    assert Counter(got) == Counter(again)
    by_target = defaultdict(lambda: [0, 0])
    for r in got:
        assert r.taken <= 2 * r.size and r.taken % max(r.size, 1) == 0
        at = by_target[r.source_size, r.target]
        at[0] += r.taken
        at[1] = max(at[1], r.size)
    repeated = max(Counter(rows).values())
    for (_, target), (taken, largest) in by_target.items():
        assert abs(taken - target) <= largest * repeated / 2 + 1


def test_blocks_are_drawn_once_and_quotas_add_up(spark):
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(5, 60)), "en", "aaab"[i % 4], 1) for i in range(600)]
    units, draws = mix_draws(spark.createDataFrame(rows, SCHEMA), block_words=100, shards=8)
    drawn = draws.collect()
    shard_of = defaultdict(set)
    for r in drawn:
        shard_of[r.source, r.epoch, r.block].add(r.shard)
    assert all(len(s) == 1 for s in shard_of.values())
    per_shard = Counter(next(iter(s)) for s in shard_of.values())
    assert len(per_shard) == 8 and max(per_shard.values()) - min(per_shard.values()) <= 1
    assert len({(r.doc_id, r.epoch) for r in drawn}) == len(drawn)
    # The quota of a source follows the hypergeometric mean: no shard holds one source alone.
    for shard in per_shard:
        assert {key[0] for key, s in shard_of.items() if shard in s} == {"a", "b"}


def test_documents_come_as_often_as_drawn(spark):
    rows = [r for r in odd_rows() if r[0] is not None]
    docs = frame(spark, rows, clash=True)
    mixed = mix_documents(docs, block_words=300)
    assert mixed.columns == docs.columns
    words = Counter()
    for r in mixed.collect():
        words[r.doc_id] += len(words_of(r.text))
    want = Counter()
    for r in mix_totals(docs, block_words=300).collect():
        want[r.doc_id] += r.taken
    assert +words == +want


def test_empty_and_wordless_tables(spark):
    assert mix_totals(frame(spark, [])).count() == 0
    got = mix_totals(frame(spark, [(1, None, "en", "a", 1), (2, " ", "en", None, 1)])).collect()
    assert {(r.doc_id, r.size, r.target, r.taken) for r in got} == {(1, 0, 0.0, 0), (2, 0, 0.0, 0)}
    assert mix_documents(frame(spark, [])).count() == 0


def test_main_path_is_native(spark):
    plan = mix_totals(frame(spark, odd_rows()))._jdf.queryExecution().executedPlan().toString()
    assert not any(name in plan for name in ("Python", "Arrow", "Pandas"))
