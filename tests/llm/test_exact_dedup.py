import hashlib
import re
from collections import defaultdict

from auditloom.llm.exact_dedup import DigestIndex, drop_exact_duplicates, exact_dedup_labels, text_digest
from auditloom.session import run_folder
from tests.llm.odd import SCHEMA, frame, odd_rows


def norm(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_labels_equal_brute_force(spark):
    rows = odd_rows()
    groups = defaultdict(list)
    for row in rows:
        groups[norm(row[1])].append(row[0])
    got = exact_dedup_labels(frame(spark, rows, clash=True), buckets=4).collect()
    assert len(got) == len(rows)
    want = []
    for row in rows:
        ids = [i for i in groups[norm(row[1])] if i is not None]
        keep = min(ids) if ids else None
        digest = hashlib.sha256(norm(row[1]).encode()).digest()
        want.append((row[0], digest, keep, len(groups[norm(row[1])]), row[0] == keep))
    key = lambda r: tuple((v is None, v) for v in r)
    assert sorted(((r.doc_id, bytes(r.digest), r.keep_id, r.group_size, r.kept) for r in got), key=key) == sorted(want, key=key)


def test_one_row_of_each_group_stays(spark):
    docs = frame(spark, odd_rows(), clash=True)
    kept = drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    texts = [norm(r.text) for r in kept.collect()]
    assert len(texts) == len(set(texts)) == len({norm(r[1]) for r in odd_rows()})


def test_empty_table(spark):
    empty = frame(spark, [])
    assert exact_dedup_labels(empty, buckets=2).count() == 0
    assert drop_exact_duplicates(empty).columns == empty.columns


def test_index_lasts_and_takes_only_unseen_digests(spark):
    folder = run_folder(spark, "test-index")
    index = DigestIndex(spark, "test_lasting_index", f"{folder}/rows", buckets=4)

    def batch(rows):
        return spark.createDataFrame(rows, SCHEMA).select("doc_id", text_digest("text").alias("digest"))

    index.add(batch([(5, "x y", None, None, None), (9, "x\ty", None, None, None), (7, "z", None, None, None)]), 0)
    again = DigestIndex(spark, "test_lasting_index", f"{folder}/rows", buckets=4)
    again.add(batch([(1, "x y", None, None, None), (2, "new", None, None, None)]), 1)
    assert sorted((r.keep_id, r.batch) for r in again.rows().collect()) == [(2, 1), (5, 0), (7, 0)]
    plan = again.rows()._jdf.queryExecution().executedPlan().toString()
    assert "Bucketed: true" in plan or again.rows().count() == 3
    unseen = batch([(3, "q", None, None, None)]).hint("merge").join(again.rows().hint("merge"), "digest", "left_anti")
    text = unseen._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in text
    spark.sql("DROP TABLE test_lasting_index")


def test_new_documents_meet_a_lasting_index(spark):
    index = DigestIndex(spark, "test_growing_index", run_folder(spark, "test-index") + "/rows", buckets=4)
    first = spark.createDataFrame([(1, "a", None, None, None), (2, "b", None, None, None), (3, "a ", None, None, None)], SCHEMA)
    second = spark.createDataFrame([(0, "b", None, None, None), (9, "c", None, None, None), (8, "c", None, None, None)], SCHEMA)
    kept = [{r.doc_id for r in drop_exact_duplicates(docs, index=index).collect()} for docs in (first, second)]
    assert kept == [{1, 2, 3}, {8}]
    labels = {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in exact_dedup_labels(second, index=index).collect()}
    assert labels == {0: (2, 1, False), 9: (8, 2, False), 8: (8, 2, True)}
    assert index.rows().count() == 4
    before = {t.name for t in spark.catalog.listTables()}
    exact_dedup_labels(first).count()
    assert {t.name for t in spark.catalog.listTables()} == before
    index.drop()


def test_null_ids_next_to_few_ids(spark):
    """Rows without an id fall into a batch that exists, also where the ids make fewer batches than asked for."""
    for ids, batches in (([5], 2), ([0, 8], 4), ([0, 1], 2)):
        rows = [(i, f"text {i}", None, None, None) for i in ids] + [(None, text, None, None, None) for text in ("alone", "alone", "text 0")]
        got = exact_dedup_labels(frame(spark, rows), batches=batches, buckets=2).collect()
        assert len(got) == len(rows)
        assert sum(r.keep_id is None and r.kept and r.group_size == 2 for r in got) == 2
    docs = frame(spark, [(5, "one", "en", "a", 1), (None, "two", "en", "a", 1)])
    assert {r.text for r in drop_exact_duplicates(docs).collect()} == {"one", "two"}
