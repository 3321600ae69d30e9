import random

import numpy as np
from pyspark.sql import functions as F

from auditloom.llm import hnsw
from auditloom.llm.hnsw import build, levels_of, lifted, nearest_neighbours, search
from tests.llm.vectors_odd import odd_vectors, usable_rows, vectors_frame


def dot(left, right):
    """In order; `sum` makes up for rounding."""
    total = 0.0
    for a, b in zip(left, right):
        total += a * b
    return total


def brute_force(rows, k, every=20):
    usable = usable_rows(rows, zero=False)
    out = {}
    for q, vector, _ in usable:
        if q % every == 0:
            scored = [(-dot(vector, v), i) for i, v, _ in usable if i != q and len(v) == len(vector)]
            out[q] = [(i, -s) for s, i in sorted(scored)[:k]]
    return out


def answers(df, **options):
    got = {}
    for r in nearest_neighbours(df, F.col("vec_id") % 20 == 0, **options).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r["rank"], r.vec_id, r.score))
    for found in got.values():
        assert [f[0] for f in found] == list(range(1, len(found) + 1))
    return {q: [f[1:] for f in found] for q, found in got.items()}


def recall(got, want):
    return np.mean([len({i for i, _ in got.get(q, [])} & {i for i, _ in found}) / len(found) for q, found in want.items() if found])


def test_odd_vectors_equal_brute_force(spark):
    rows = odd_vectors()
    want = {q: found for q, found in brute_force(rows, 20).items() if found}
    assert answers(vectors_frame(spark, rows, clash=True)) == want
    assert len({len(found) for found in want.values()}) > 0 and 1200 in want


def test_shards_and_query_blocks_are_merged(spark, monkeypatch):
    monkeypatch.setattr(hnsw, "block_rows", lambda count: 40)
    rows = odd_vectors(seed=2)
    want = {q: found for q, found in brute_force(rows, 20).items() if found}
    assert answers(vectors_frame(spark, rows), query_block=5) == want


def test_empty_and_unusable_tables(spark):
    for rows in ([], [(20, None, 1)], [(20, [0.0, 0.0], 1)], [(20, [1.0], 1)], [(None, [1.0], 1)] * 2):
        assert answers(vectors_frame(spark, rows)) == {}
    assert answers(vectors_frame(spark, [(20, [1.0], 1), (21, [2.0], None)])) == {20: [(21, 2.0)]}


def test_integer_components(spark):
    df = spark.createDataFrame([(20, [1, 2], 0), (21, [3, 4], 0), (22, [-1, 0], 0)], "vec_id long, embedding array<int>, label int")
    assert answers(df) == {20: [(21, 11.0), (22, -1.0)]}


def test_recall_on_the_whole_table(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute_force([tuple(r) for r in df.select("vec_id", "embedding", "label").collect()], 20)
    assert recall(answers(df), want) >= 0.99


def test_graph_of_crowded_and_uneven_vectors():
    """Clusters, copies that differ in the last digits and lengths from 25 to 100: nine of ten neighbours at least, links within bounds."""
    rng = np.random.default_rng(5)
    centres = rng.standard_normal((20, 16))
    vectors = centres[rng.integers(0, 20, 3000)] + 1e-3 * rng.standard_normal((3000, 16))
    vectors *= rng.uniform(25, 100, (3000, 1))
    levels = np.sort(levels_of(rng.integers(-(2**63), 2**63 - 1, 3000)))[::-1]
    graph = lifted(vectors)
    layers = build(graph, levels)
    for layer, links in enumerate(layers):
        assert len(links) == (levels >= layer).sum() and links.max() < len(links)
        assert all(len(set(row[row >= 0])) == (row >= 0).sum() for row in links)
        assert not (links == np.arange(len(links))[:, None]).any()
    asked = rng.standard_normal((100, 16))
    found = search(graph, layers, np.hstack([asked, np.zeros((100, 1))]).astype(np.float32), 192)
    scores = asked @ vectors.T
    hits = sum(len(set(f[:20]) & set(np.argsort(-s)[:20])) for f, s in zip(found, scores))
    assert hits >= 0.9 * 20 * 100


def test_reruns_agree(spark):
    rows = odd_vectors(seed=3)
    random.Random(0).shuffle(rows)
    assert answers(vectors_frame(spark, rows)) == answers(vectors_frame(spark, rows[::-1]))
