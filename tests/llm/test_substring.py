import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest

from auditloom.llm import substring
from auditloom.llm.substring import entry_columns, entry_row, remove_repeats, removal_labels, repeated_spans
from tests.llm.odd import frame, odd_rows, prose, words_of


def brute_force(rows, window):
    """{(id, text): (words, removed, digest)}; rows without an id come last."""
    order = lambda doc_id: 2**63 - 1 if doc_id is None else doc_id
    first = {}
    for doc_id, text, *_ in rows:
        words = words_of(text)
        for i in range(len(words) - window + 1):
            key = tuple(words[i : i + window])
            first[key] = min(first.get(key, (2**64, 0)), (order(doc_id), i))
    out = {}
    for doc_id, text, *_ in rows:
        words = words_of(text)
        gone = [False] * len(words)
        for i in range(len(words) - window + 1):
            if first[tuple(words[i : i + window])] < (order(doc_id), i):
                gone[i : i + window] = [True] * window
        kept = [w for w, g in zip(words, gone) if not g]
        out[doc_id, text] = (len(words), len(words) - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest())
    return out


def check(spark, rows, window=20, clash=False):
    want, by_id = brute_force(rows, window), defaultdict(set)
    for (doc_id, _), answer in want.items():
        by_id[doc_id].add(answer)
    got = removal_labels(frame(spark, rows, clash), window=window).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_words, r.n_removed, r.kept_sha256) in by_id[r.doc_id]
    assert sum(r.n_removed for r in got) == sum(want[row[0], row[1]][1] for row in rows)


def shared_passages(rng, n):
    passages = [prose(rng, rng.randrange(15, 80)) for _ in range(6)]
    rows = []
    for i in range(n):
        parts = [prose(rng, rng.randrange(0, 50)) for _ in range(3)]
        for _ in range(rng.randrange(0, 3)):
            parts.insert(rng.randrange(len(parts) + 1), rng.choice(passages))
        rows.append((rng.randrange(10 * n) * 2 + 1, "  ".join(parts), "en", "a", 1))
    return list({r[0]: r for r in rows}.values())


def test_odd_documents_equal_brute_force(spark):
    check(spark, odd_rows(), clash=True)


@pytest.mark.parametrize("window", [1, 5, 20])
def test_shared_passages_equal_brute_force(spark, window):
    check(spark, shared_passages(random.Random(window), 120), window)


def test_many_chunks_and_buckets_equal_brute_force(spark, monkeypatch):
    monkeypatch.setattr(substring, "CHUNK_BYTES", 2_000)
    monkeypatch.setattr(substring, "BUCKET_WINDOWS", 300)
    check(spark, shared_passages(random.Random(9), 150) + odd_rows())


def test_spans_are_maximal(spark):
    rng = random.Random(3)
    shared, twice = prose(rng, 30), prose(rng, 25)
    rows = [(1, shared, "", "", 0), (2, f"{prose(rng, 5)} {shared} {prose(rng, 7)} {twice} x {twice}", "", "", 0)]
    found = repeated_spans(frame(spark, rows)).collect()
    assert [(r.doc_id, [(s.start, s.end) for s in r.spans]) for r in found] == [(2, [(5, 35), (68, 93)])]
    docs = frame(spark, rows, clash=True)
    cleaned = remove_repeats(docs)
    assert cleaned.columns == docs.columns
    texts = {r.doc_id: r.text for r in cleaned.collect()}
    words = rows[1][1].split()
    assert texts == {1: shared, 2: " ".join(words[:5] + words[35:68] + words[93:])}


def test_entries_survive_their_encoding():
    rng = np.random.default_rng(1)
    ids = np.sort(rng.integers(-(2**40), 2**62, 50))
    hashes = rng.integers(-(2**63), 2**63, 50)
    doc_of = np.sort(rng.integers(0, 50, 400))
    places = np.concatenate([np.sort(rng.choice(10**6, n, replace=False)) for n in np.unique(doc_of, return_counts=True)[1]])
    row = entry_row(3, rng.integers(0, 2**56, 400, dtype=np.uint64), ids, hashes, doc_of, places)
    got = entry_columns(row)
    assert (got[0] == ids[doc_of]).all() and (got[1] == hashes[doc_of]).all() and (got[2] == places).all()


def test_empty_table(spark):
    assert removal_labels(frame(spark, [])).count() == 0
    assert remove_repeats(frame(spark, [])).count() == 0
    blank = removal_labels(frame(spark, [(1, None, None, None, None)])).collect()
    assert [(r.n_words, r.n_removed, r.kept_sha256) for r in blank] == [(0, 0, hashlib.sha256(b"").hexdigest())]


def test_the_largest_id_loses_like_any_other(spark):
    text = " ".join(f"w{i}" for i in range(40))
    for last in (2**63 - 1, 2**63 - 2, None):
        rows = frame(spark, [(5, text, "en", "a", 1), (last, text, "en", "a", 1)])
        got = {r.doc_id: r.n_removed for r in removal_labels(rows).collect()}
        assert got == {5: 0, last: 40}
    shared = frame(spark, [(2**63 - 1, text, "en", "a", 1), (None, text, "en", "a", 1)])
    assert {r.n_removed for r in removal_labels(shared).collect()} == {0}
