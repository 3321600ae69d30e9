import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from auditloom.llm import merkle
from auditloom.llm.merkle import merkle_manifest
from tests.llm.odd import frame, odd_rows


def sha(*texts):
    return hashlib.sha256("".join(texts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def leaf(doc_id, text, lang, source, n_chars):
    return sha(*map(field, (doc_id, source, lang, n_chars, text)))


def levels_of(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha(*levels[-1][i : i + 3]) for i in range(0, len(levels[-1]), 3)])
    return levels


def siblings(levels, i):
    for nodes in levels[:-1]:
        first = i - i % 3
        yield "".join(nodes[first:i]), "".join(nodes[i + 1 : first + 3])
        i //= 3


def is_tampered(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 2 == 0


def brute_force(rows):
    by_source = defaultdict(list)
    for doc_id, text, lang, source, n_chars in rows:
        changed = text.replace("\n", "") if text is not None and is_tampered(doc_id) else text
        by_source[source].append((doc_id, leaf(doc_id, text, lang, source, n_chars), leaf(doc_id, changed, lang, source, n_chars)))
    order = sorted(by_source, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        by_source[source].sort(key=lambda x: (x[0] is not None, x[0] or 0, x[1]))
        trees[source] = levels_of([x[1] for x in by_source[source]])
    crown = levels_of([trees[s][-1][0] for s in order])
    out = []
    for j, source in enumerate(order):
        for i, (doc_id, digest, found) in enumerate(by_source[source]):
            path = [*siblings(trees[source], i), *siblings(crown, j)]
            for left, right in path:
                found = sha(left, found, right)
            proof = sha(*[left + right for left, right in path])
            out.append((doc_id, digest, trees[source][-1][0], crown[-1][0], proof, found, found == crown[-1][0]))
    return out


def manifest(docs):
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    changed = F.when(tampered, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    return [tuple(r) for r in merkle_manifest(docs, changed).collect()]


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1:]))


@pytest.mark.parametrize("levels", [2, 7])
def test_odd_documents_equal_brute_force(spark, monkeypatch, levels):
    """Chunks of 3, 9 and 2,187 leaves: the chunks never show."""
    monkeypatch.setattr(merkle, "LEVELS", levels)
    got = manifest(frame(spark, odd_rows(), clash=True))
    want = brute_force(odd_rows())
    assert in_order(got) == in_order(want)
    assert {r[-1] for r in got} == {True, False}


def test_tree_sizes(spark, monkeypatch):
    """Sources of 1 to 28 rows, some an exact power of the fanout, next to each other."""
    monkeypatch.setattr(merkle, "LEVELS", 1)
    sizes = {None: 1, "a": 2, "b": 3, "c": 4, "d": 9, "": 10, "é": 27, "z": 28}
    rows = [(i * 31 + n, f"line\n{i}", "en", source, i) for source, n in sizes.items() for i in range(n)]
    assert in_order(manifest(frame(spark, rows))) == in_order(brute_force(rows))


def test_one_row(spark):
    assert manifest(frame(spark, odd_rows()[5:6])) == brute_force(odd_rows()[5:6])


def test_many_sources(spark):
    rows = [(i, "same", None, chr(0x30 + i * 37 % 700) if i % 50 else None, 1) for i in range(300)]
    assert in_order(manifest(frame(spark, rows))) == in_order(brute_force(rows))


def test_no_rows(spark):
    assert manifest(frame(spark, [])) == []


def test_without_a_change_all_rows_verify(spark):
    got = merkle_manifest(frame(spark, odd_rows())).collect()
    assert all(r.verified for r in got) and len({r.root for r in got}) == 1 and len(got) == len(odd_rows())
