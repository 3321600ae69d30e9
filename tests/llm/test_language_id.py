import random
from collections import Counter
from zlib import crc32

import numpy as np
import pytest
from pyspark.sql import functions as F

from auditloom.llm import language_id
from auditloom.llm.language_id import (
    UNDETERMINED,
    LanguageModel,
    accepted_documents,
    document_frequencies,
    fit_language_model,
    fit_temperature,
    gram_counts,
    held_out,
    identify_languages,
    softmax,
)
from auditloom.llm.queries import QUERIES
from tests.llm.odd import SCHEMA, frame, odd_rows

SYLLABLES = {"en": "the ing ow sh ea".split(), "de": "sch ung ei ü ß".split(), "ja": "の は を た ん".split()}


def language_rows(n=300, seed=3):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = ("en", "de", "ja")[i % 3]
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randrange(1, 4))) for _ in range(rng.randrange(3, 60))]
        rows.append((i, " ".join(words), lang if i % 11 else None, "a", 1))
    return rows


def test_features_do_not_depend_on_pieces(monkeypatch):
    text = "Ünïcode: the quick (brown) fox, 漢字 12 jumps " * 40
    whole = gram_counts(text)
    monkeypatch.setattr(language_id, "PIECE", 17)
    assert all((a == b).all() for a, b in zip(whole, gram_counts(text)))
    monkeypatch.setattr(language_id, "PIECE", 10**6)
    long_text = text * 30
    used, counts = gram_counts(long_text)
    assert len(used) >= len(whole[0]) and counts.sum() > 30 * (whole[1].sum() - 1)
    assert len(gram_counts("12 34 !!")[0]) == 0 == len(gram_counts(None)[0])
    assert (gram_counts("ABC def")[0] == gram_counts("abc!DEF")[0]).all()


def test_held_out_languages_are_found(spark):
    rows = language_rows()
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    model = fit_language_model(docs, learn=~held_out(), max_train_docs=150)
    assert model.languages == ["de", "en", "ja"]
    assert 0 < (model.weights != 0).mean() < 0.5  # sparse
    langs = {i: ("en", "de", "ja")[i % 3] for i in range(300)}
    found = identify_languages(docs, model).select("doc_id", "lang_pred", "score", held_out().alias("h")).collect()
    assert {r.doc_id for r in found if r.h} == {i for i in langs if crc32(str(i).encode()) % 5 == 0}
    assert all(r.lang_pred == langs[r.doc_id] and 0 <= r.score <= 1 for r in found)


def test_prediction_uses_the_text_alone(spark):
    docs = frame(spark, language_rows(120) + odd_rows(), clash=True)
    model = fit_language_model(docs, max_train_docs=60)
    other = docs.withColumns({"lang": F.lit("xx"), "source": F.lit("zz")}).withColumn("doc_id", F.col("doc_id") + 1)
    one = Counter((r.text, r.lang_pred, r.score) for r in identify_languages(docs, model).collect())
    two = Counter((r.text, r.lang_pred, r.score) for r in identify_languages(other, model).collect())
    assert one == two
    for text, lang, score in one:
        lettered = any(c.isalpha() for c in text or "")
        assert (lang != UNDETERMINED) == lettered and (lettered or score == 0)


def test_frequencies_cover_all_rows(spark):
    rows = odd_rows()
    got, n = document_frequencies(spark.createDataFrame(rows, SCHEMA).repartition(4), "text")
    want = np.zeros(language_id.FEATURES, np.int64)
    for row in rows:
        want[gram_counts(row[1])[0]] += 1
    assert n == len(rows) and (got == want).all()


def test_rerun_gives_the_same_model(spark):
    docs = spark.createDataFrame(language_rows(150), SCHEMA)
    one, two = (fit_language_model(d, max_train_docs=90) for d in (docs.repartition(2), docs.repartition(5)))
    assert (one.weights == two.weights).all() and one.temperature == two.temperature


def test_temperature_calibrates():
    rng = np.random.default_rng(0)
    logits = rng.normal(size=(4000, 3))
    labels = np.array([rng.choice(3, p=p) for p in softmax(logits)])
    assert fit_temperature(logits * 5, labels) == pytest.approx(5, rel=0.15)
    assert fit_temperature(logits[:0], labels[:0]) == 1.0


def test_without_labels_and_without_rows(spark):
    rows = [(1, "some text", None, "a", 1), (2, "12", None, "a", 1), (3, None, None, None, None)]
    docs = spark.createDataFrame(rows, SCHEMA)
    model = fit_language_model(docs)
    assert model.languages == [] and {r.lang_pred for r in identify_languages(docs, model).collect()} == {UNDETERMINED}
    assert [r.doc_id for r in accepted_documents(docs).collect()] == [1]
    empty = frame(spark, [], clash=True)
    assert accepted_documents(empty).columns == empty.columns and accepted_documents(empty).count() == 0


def test_only_undetermined_documents_are_rejected(spark):
    docs = frame(spark, language_rows(200) + odd_rows(), clash=True)
    kept = accepted_documents(docs)
    assert kept.columns == docs.columns
    found = Counter(r.doc_id for r in kept.collect())
    assert all(found[i] for i in range(100, 200) if i != 97)


def test_held_out_accuracy_on_documents(spark, sf_dir):
    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").collect()}
    rows = QUERIES["op3_language_id"][0](spark, sf_dir).where("held_out").collect()
    right = [r.lang_pred == truth[r.doc_id] for r in rows]
    assert len(right) > 20 and sum(right) / len(right) > 0.95
    assert isinstance(LanguageModel([], np.ones(1), np.ones((1, 0)), np.ones(0)).predict("a"), tuple)
