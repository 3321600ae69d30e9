import random
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import minhash
from auditloom.llm.components import connected_components
from auditloom.llm.minhash import drop_near_duplicates, exact_links, near_duplicate_labels, stars
from auditloom.llm.shingles import WordHashes, rolling, shingle_set
from tests.llm.odd import SCHEMA, frame, odd_rows, prose


def shingles(text, size):
    words = (text or "").encode().lower().split()
    if len(words) < size:
        return frozenset([tuple(words)]) if words else frozenset()
    return frozenset(zip(*(words[i:] for i in range(size))))


def brute_force(rows, size, percent):
    """{(id, text): (set size, smallest id reachable)}; rows with one id are one document."""
    sets = [shingles(r[1], size) for r in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common = len(sets[i] & sets[j])
            same_id = rows[i][0] is not None and rows[i][0] == rows[j][0] and sets[i] and sets[j]
            if sets[i] and sets[j] and (same_id or 100 * common >= percent * (len(sets[i]) + len(sets[j]) - common)):
                parent[find(i)] = find(j)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    out = {}
    for i, row in enumerate(rows):
        ids = [x for x in groups[find(i)] if x is not None]
        out[row[0], row[1]] = (len(sets[i]), min(ids) if ids else None) if sets[i] else (0, row[0])
    return out


def star_family(rng, copies, start, words=140, changes=(2, 9)):
    """A text and copies of it, most of them nearer to the text than to each other."""
    base = prose(rng, words).split()
    rows = [(start, " ".join(base), "en", "a", 1)]
    for i in range(copies):
        own = list(base)
        for _ in range(rng.randrange(*changes)):
            own[rng.randrange(len(own))] = f"w{rng.randrange(10**6)}"
        rows.append((start + 1 + i, " ".join(own), "en", "a", 1))
    return rows


def check(spark, rows, size, percent, clash=False):
    want = brute_force(rows, size, percent)
    texts = defaultdict(set)
    for (doc_id, _), answer in want.items():
        texts[doc_id].add(answer)
    got = near_duplicate_labels(frame(spark, rows, clash), shingle_words=size, percent=percent).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) in texts[r.doc_id]
        assert r.kept == (r.doc_id == r.component_id)


@pytest.mark.parametrize("size, percent", [(3, 85), (5, 80)])
def test_odd_documents_equal_brute_force(spark, size, percent):
    check(spark, odd_rows(), size, percent, clash=True)


def test_star_families_equal_brute_force(spark):
    rng = random.Random(11)
    rows = star_family(rng, 150, 1000) + star_family(rng, 30, 5000) + star_family(rng, 3, 0)
    rows += [(9000 + i, prose(rng, 50), "en", "b", 1) for i in range(60)]
    check(spark, rows, 3, 85)


def test_dense_regions_and_blocks_equal_brute_force(spark, monkeypatch):
    """Regions beyond REGION and HOT_REGION, families of many blocks."""
    monkeypatch.setattr(minhash, "REGION", 16)
    monkeypatch.setattr(minhash, "HOT_REGION", 40)
    monkeypatch.setattr(minhash, "BLOCK_SHINGLES", 3000)
    check(spark, star_family(random.Random(12), 160, 100), 3, 85)


def test_exact_links_across_and_inside():
    rng = random.Random(4)
    hashes = WordHashes()
    texts = [r[1] for r in star_family(rng, 30, 0)]
    sets = [shingle_set(hashes.of(t.encode().split()), 3) for t in texts]
    plain = [shingles(t, 3) for t in texts]
    assert [len(s) for s in sets] == [len(s) for s in plain]
    ids = np.arange(100, 131)
    side = np.array([i % 2 for i in range(31)])

    def reach(edges):
        up = {int(i): int(i) for i in ids}
        for _ in ids:
            for a, b in edges:
                up[int(a)] = up[int(b)] = min(up[int(a)], up[int(b)])
        return up

    for across in (False, True):
        own = side if across else np.zeros(31, int)
        want = [
            (ids[i], ids[j]) for i in range(31) for j in range(i)
            if (not across or own[i] != own[j])
            and 100 * len(plain[i] & plain[j]) >= 85 * len(plain[i] | plain[j])
        ]
        got = exact_links(sets, ids, own, 85, across)
        assert reach(got) == reach(want) and len(got) < 31


def test_stars_span_the_components():
    links = np.zeros((6, 6), bool)
    for a, b in ((0, 3), (3, 5), (1, 2)):
        links[a, b] = links[b, a] = True
    found = stars(np.arange(10, 16), lambda rows, rest: links[np.ix_(rows, rest)])
    assert {tuple(sorted(e)) for e in found.tolist()} == {(10, 13), (10, 15), (11, 12)}


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 20, 21])
def test_rolling_hash_depends_on_the_window_alone(size):
    values = np.random.default_rng(size).integers(0, 2**63, 60, dtype=np.uint64)
    got = rolling(values, size)
    base = 0x9E3779B97F4A7C15
    want = [sum(int(v) * base ** (size - 1 - k) for k, v in enumerate(values[i : i + size])) % 2**64 for i in range(61 - size)]
    assert got.tolist() == want


def test_components_of_a_path_and_a_star(spark):
    rng = random.Random(1)
    path = [(i, i + 1) for i in range(0, 64)]
    star = [(500, 500 + i) for i in range(1, 40)]
    edges = [(b, a) if rng.random() < 0.5 else (a, b) for a, b in path + star + [(900, 900)]]
    rng.shuffle(edges)
    found = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert found == {**{i: 0 for i in range(65)}, **{i: 500 for i in range(500, 540)}}
    assert connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_one_document_of_each_group_stays(spark):
    rng = random.Random(6)
    rows = star_family(rng, 20, 10, changes=(1, 3)) + [(1, None, None, None, None), (2, "", "en", "a", 1), (3, "clean text", "en", "a", 1)]
    docs = frame(spark, rows, clash=True)
    kept = drop_near_duplicates(docs)
    assert kept.columns == docs.columns
    want = {i for (i, _), (_, root) in brute_force(rows, 5, 80).items() if i == root}
    assert {r.doc_id for r in kept.collect()} == want and {1, 2, 3, 10} <= want


def test_empty_table(spark):
    assert near_duplicate_labels(spark.createDataFrame([], SCHEMA)).count() == 0
    assert drop_near_duplicates(frame(spark, [])).count() == 0


def half_similar_nodes(spark, rng, n, pairs):
    """Nodes of one region of one tree, half alike; `pairs` of them agree in 120 places but not in the first after the key."""
    base = rng.integers(0, 256, minhash.SLOTS, dtype=np.uint8)
    sigs = np.where(rng.random((n, minhash.SLOTS)) < 0.5, base, rng.integers(0, 256, (n, minhash.SLOTS), dtype=np.uint8))
    sigs[:, : minhash.DEPTH] = base[: minhash.DEPTH]
    planted = [(k, n - 1 - k) for k in range(pairs)]
    for x, y in planted:
        sigs[y] = sigs[x]
        for slot in (minhash.DEPTH, *rng.choice(np.arange(minhash.DEPTH + 1, minhash.SLOTS), 7, replace=False)):
            sigs[y, slot] ^= 128
    order = rng.permutation(n).tolist()
    rows = [(order[i], [7] + [i * 100 + t for t in range(1, minhash.TREES)], bytearray(sigs[i].tobytes())) for i in range(n)]
    nodes = spark.createDataFrame(rows, "node long, keys array<long>, sig binary")
    return nodes, [(order[x], order[y]) for x, y in planted]


@pytest.mark.parametrize("hot", [50_000, 100])
def test_windows_and_cuts_hide_no_pair(spark, monkeypatch, hot):
    monkeypatch.setattr(minhash, "REGION", 16)
    monkeypatch.setattr(minhash, "HOT_REGION", hot)
    monkeypatch.setattr(minhash, "BLOCK_NODES", 100)
    nodes, planted = half_similar_nodes(spark, np.random.default_rng(8), 400, 60)
    root = {r.node: r.root for r in minhash.related(nodes, 85).collect()}
    assert [p for p in planted if root.get(p[0], p[0]) != root.get(p[1], p[1])] == []


@pytest.mark.parametrize("across", [False, True])
def test_crossing_joins_what_agrees(across):
    rng = np.random.default_rng(3)
    sigs = rng.integers(0, 2, (150, minhash.SLOTS), dtype=np.uint8)
    sigs[100:] = sigs[:50] ^ (rng.random((50, minhash.SLOTS)) < 0.05)
    roots = np.arange(150) // 3 * 3
    first = np.arange(150) < 80 if across else np.ones(150, bool)
    got = connected(minhash.crossing(roots, first, sigs, 90, across))
    near = (sigs[:, None] == sigs[None]).sum(2) >= 90
    want = [(roots[i], roots[j]) for i, j in zip(*np.nonzero(near)) if not across or first[i] != first[j]]
    assert got == connected(want) and len(got) > 50 / 3


def connected(edges):
    up = {}
    find = lambda r: r if up.setdefault(r, r) == r else find(up[r])
    for u, v in edges:
        if u != v:
            x, y = find(int(u)), find(int(v))
            up[max(x, y)] = min(x, y)
    return {r: find(r) for r in up}


def test_trees_miss_less_than_the_bound():
    assert minhash.forest_shape(85) == (16, 4) and minhash.forest_shape(80) == (22, 4)
    for percent in range(12, 100):
        trees, depth = minhash.forest_shape(percent)
        assert (1 - (percent / 100) ** depth) ** trees <= minhash.MISS and trees * depth <= minhash.SLOTS
    assert minhash.forest_shape(100) == (16, 4) and minhash.forest_shape(1) == (128, 1)
    assert len(set(minhash.tree_keys(np.arange(128, dtype=np.uint64), 22, 4).tolist())) == 22


def test_every_text_of_a_repeated_id_is_linked(spark):
    """Ids with two or three texts, each with near copies or copies under other ids."""
    rng = random.Random(15)
    rows = []
    for k in range(12):
        one, two, three = (prose(rng, 120) for _ in range(3))
        near = [" ".join(t.split()[:-1] + ["changed"]) for t in (one, two, three)]
        at = 1000 + 100 * k
        rows += [(at, one, "en", "a", 1), (at, two, "en", "a", 1), (at, near[0], "en", "a", 1), (at + 1, near[0], "en", "a", 1)]
        rows += [(at + 2, near[1], "en", "a", 1), (at - 50, three, "en", "a", 1), (at + 2, three, "en", "a", 1), (at, one, "en", "a", 1)]
    got = near_duplicate_labels(frame(spark, rows), shingle_words=3, percent=85).collect()
    want = brute_force(rows, 3, 85)
    assert len(got) == len(rows) and len(set(want.values())) > 1
    texts = defaultdict(set)
    for (doc_id, _), answer in want.items():
        texts[doc_id].add(answer)
    assert all((r.n_shingles, r.component_id) in texts[r.doc_id] for r in got)
