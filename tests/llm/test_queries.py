"""Queries with a SQL answer against DuckDB, the others against what their tests import."""

import hashlib
import zlib

import pytest

import __spark_entry__ as entry
import corpus_pipeline
from auditloom.llm.queries import QUERIES
from auditloom.session import run_folder, settle
from tests.llm.odd import frame, odd_rows
from tests.llm.test_minhash import brute_force as near_groups
from tests.llm.test_sharding import brute_force as shard_places
from tests.llm.vectors_odd import vectors_frame
from tests.oracle_check import compare, connect


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


def test_all_are_registered():
    assert {f"op{n}" for n in range(1, 14)} == {name.split("_")[0] for name in QUERIES}
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(name for name, (_, sql) in QUERIES.items() if sql))
def test_query_equals_sql(spark, con, sf_dir, name):
    assert compare(spark, con, sf_dir, *QUERIES[name]) is None


def test_near_duplicates_equal_brute_force(spark, con, sf_dir):
    rows = con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    want = {i: answer for (i, _), answer in near_groups(rows, 3, 85).items()}
    got = QUERIES["op7_near_duplicates"][0](spark, sf_dir).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == want and len(got) == len(rows)


def test_shards_equal_brute_force(spark, con, sf_dir):
    rows = con.sql("SELECT doc_id, text, lang, source, n_chars FROM documents").fetchall()
    got = QUERIES["op9_interleave_shards"][0](spark, sf_dir).collect()
    assert {(r.doc_id, r.shard, r.slot) for r in got} == set(shard_places(rows, 8))
    texts = {r[0]: (r[1] or "").encode() for r in rows}
    for r in got:
        assert (r["size"], r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
        assert (r.law, r.grown_shard) == ("rows", None)


def test_pipeline_stages(spark, con, sf_dir):
    """Each stage against brute force on its own input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns = docs.columns
    stages = dict(corpus_pipeline.STAGES)
    told = stages["language_id"](spark, docs, sf_dir).cache()
    assert told.columns == columns and told.count() >= 0.98 * docs.count()
    unique = stages["exact_dedup"](spark, told, sf_dir).cache()
    norms = [hashlib.md5(b" ".join(r.text.encode().split())).digest() for r in unique.collect()]
    assert unique.columns == columns and len(set(norms)) == len(norms)
    apart = stages["near_dedup"](spark, unique, sf_dir).cache()
    groups = near_groups([tuple(r) for r in unique.collect()], 5, 80)
    assert {r.doc_id for r in apart.collect()} == {i for (i, _), (_, root) in groups.items() if i == root}
    mixed = stages["mix"](spark, apart, sf_dir).cache()
    assert mixed.columns == columns and apart.count() < mixed.count() <= 2 * apart.count()
    packed = stages["pack"](spark, mixed, sf_dir)
    tokens = sum(len(r.text.encode().split()) + 1 for r in mixed.collect())
    assert packed.groupBy().sum("length").first()[0] == tokens
    assert corpus_pipeline.run(spark, sf_dir).count() == packed.count()


def test_pipeline_stages_take_odd_and_empty_documents(spark, sf_dir):
    for rows in (odd_rows(), [], [(None, None, None, None, None)] * 3):
        docs = frame(spark, rows, clash=True)
        kept = docs
        for name, stage in corpus_pipeline.STAGES:
            kept = settle(stage(spark, kept, sf_dir))
            if name != "pack":
                assert kept.columns == docs.columns, name
        if rows == odd_rows():
            assert kept.where("length > 0").count() == kept.count() > 50


def test_queries_take_an_empty_table(spark):
    folder = run_folder(spark, "test-empty")
    frame(spark, []).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([], "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    vectors_frame(spark, []).write.parquet(f"{folder}/embeddings.parquet")
    for name, (query, _) in QUERIES.items():
        assert query(spark, folder).collect() == [], name


def test_queries_take_odd_documents(spark, sf_dir):
    """Nulls, blanks, repeated rows and ids through every query on documents."""
    folder = run_folder(spark, "test-odd")
    frame(spark, odd_rows(), clash=True).write.parquet(f"{folder}/documents.parquet")
    for name, (query, _) in QUERIES.items():
        if name not in ("op4_warc_segments", "op11_nearest_neighbours", "op12_hard_negatives"):  # on other tables
            n = query(spark, folder).count()
            assert n == len(odd_rows()) if name != "op2_length_buckets" else n > len(odd_rows()), name
