import hashlib
from collections import Counter, defaultdict

from pyspark.sql import functions as F

from auditloom.llm.sharding import interleave_shards
from tests.llm.odd import frame, odd_rows


def brute_force(rows, shards, seed="shard"):
    by_source = defaultdict(list)
    for row in rows:
        key = hashlib.md5(f"{seed}:{'' if row[0] is None else row[0]}".encode()).hexdigest()
        by_source[row[3]].append((key, row[0]))
    order = []
    for source, members in by_source.items():
        n = len(members)
        for rank, (key, doc) in enumerate(sorted(members, key=lambda m: (m[0], m[1] is not None, m[1] or 0))):
            order.append(((rank * 2 + 1) / (n * 2), source is None, source or "", key, doc))
    order.sort(key=lambda o: o[:4])
    n, out, seen = len(order), [], Counter()
    for place, (*_, doc) in enumerate(order):
        shard = place * shards // n
        out.append((doc, shard, seen[shard]))
        seen[shard] += 1
    return out


def test_shards_equal_brute_force(spark):
    rows = odd_rows()
    got = interleave_shards(frame(spark, rows, clash=True)).collect()
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, r.shard, r.slot) for r in got), key=key) == sorted(brute_force(rows, 8), key=key)


def test_every_shard_matches_the_mixture(spark):
    rows = [(i, "x", "en", "abbbcc"[i % 6] if i % 3 else None, 1) for i in range(3001)]
    got = interleave_shards(frame(spark, rows)).collect()
    sizes, mixture = Counter(r.shard for r in got), Counter((r.shard, r.source) for r in got)
    whole = Counter(r[3] for r in rows)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for (shard, source), n in mixture.items():
        assert abs(n - whole[source] * sizes[shard] / 3001) <= 1 + len(whole) / 2
    for shard in sizes:
        assert sorted(r.slot for r in got if r.shard == shard) == list(range(sizes[shard]))


def test_fewer_rows_than_shards_and_none(spark):
    few = interleave_shards(frame(spark, odd_rows()[:3])).collect()
    assert len({r.shard for r in few}) == 3 and {r.slot for r in few} == {0}
    assert interleave_shards(frame(spark, [])).count() == 0
    carried = interleave_shards(frame(spark, odd_rows()).withColumn("size", F.lit(1)), carry=("size",))
    assert carried.columns == ["doc_id", "source", "size", "shard", "slot"]
