"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Weights come from follow-the-regularised-leader with elastic-net penalties on a bounded
sample of labelled documents; a temperature, fitted on labelled documents that the training has not
seen, calibrates the scores. Document frequencies cover all labelled documents, and every text is
judged whole.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import fresh, lean

ORDERS = (1, 2, 3)
FEATURES = 2**16
PIECE = 1_000_000
UNDETERMINED = "und"
#: Odd multipliers of the n-gram hash, one per position.
MULTIPLIERS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)

#: Code points below are looked up in a table; the letters among the others are few in any text.
TABLED = 0x3000


def letter_table() -> np.ndarray:
    """For the first TABLED code points, whether they are letters."""
    return np.fromiter((chr(c).isalpha() for c in range(TABLED)), bool, TABLED)


_letters = letter_table()


def are_letters(codes: np.ndarray) -> np.ndarray:
    """Whether each code point is a letter."""
    found = _letters[np.minimum(codes, TABLED - 1)]
    high = np.flatnonzero(codes >= TABLED)
    if len(high):
        distinct, which = np.unique(codes[high], return_inverse=True)
        found[high] = np.fromiter((chr(c).isalpha() for c in distinct.tolist()), bool, len(distinct))[which]
    return found


def gram_features(text: str) -> Iterator[np.ndarray]:
    """Feature numbers of all character n-grams of a text, in pieces of bounded size.

    The text is lowered; everything but letters counts as a space, and n-grams of
    spaces alone are left out.
    """
    lowered = text.lower()
    for at in range(0, len(lowered), PIECE):
        piece = lowered[at : at + PIECE + ORDERS[-1] - 1]
        codes = np.frombuffer(piece.encode("utf-32-le", "surrogatepass"), np.uint32)
        letters = are_letters(codes)
        codes = np.where(letters, codes, 32).astype(np.uint64)
        starts = min(len(codes), PIECE)
        for order in ORDERS:
            n = min(starts, len(codes) - order + 1)
            if n <= 0:
                continue
            mixed = np.full(n, order, np.uint64)
            some = letters[:n].copy()
            for shift in range(order):
                mixed += codes[shift : shift + n] * np.uint64(MULTIPLIERS[shift])
                some |= letters[shift : shift + n]
            mixed ^= mixed >> np.uint64(29)
            mixed *= np.uint64(MULTIPLIERS[0])
            yield (mixed[some] >> np.uint64(48)).astype(np.int64)


def gram_counts(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(distinct feature numbers, their counts) of a whole text; empty without letters."""
    found = list(gram_features(text)) if text else []
    if sum(map(len, found)) < 4096:
        return np.unique(np.concatenate(found or [np.empty(0, np.int64)]), return_counts=True)
    counts = np.zeros(FEATURES, np.int64)
    for features in found:
        counts += np.bincount(features, minlength=FEATURES)
    used = np.flatnonzero(counts)
    return used, counts[used]


@dataclass
class LanguageModel:
    """`idf` by feature, `weights` by feature and language, `bias` by language and the temperature."""

    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    bias: np.ndarray
    temperature: float = 1.0

    def vector(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """TF-IDF of a document, of length 1, with damped counts."""
        values = (1.0 + np.log(counts)) * self.idf[used]
        return values / max(np.sqrt(values @ values), 1e-12)

    def logits(self, used: np.ndarray, counts: np.ndarray) -> np.ndarray:
        return self.vector(used, counts) @ self.weights[used] + self.bias

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, calibrated score); `und` and 0 without a letter or without a language learned."""
        used, counts = gram_counts(text)
        if len(used) == 0 or not self.languages:
            return UNDETERMINED, 0.0
        scores = softmax(self.logits(used, counts) / self.temperature)
        best = int(scores.argmax())
        return self.languages[best], float(scores[best])


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


def train_ftrl(
    model: LanguageModel,
    rows: list[tuple[np.ndarray, np.ndarray, int]],
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.1,
    epochs: int = 2,
) -> None:
    """Fit weights and bias by FTRL-proximal, one document at a time.

    z gathers gradients, n their squares; a weight is 0 while |z| <= l1 and else
    -(z - sign(z) l1) / ((beta + sqrt n) / alpha + l2).
    """
    k = len(model.languages)
    z, n = np.zeros((FEATURES + 1, k)), np.zeros((FEATURES + 1, k))

    def weights(at):
        shrunk = np.sign(z[at]) * np.maximum(np.abs(z[at]) - l1, 0)
        return -shrunk / ((beta + np.sqrt(n[at])) / alpha + l2)

    for _ in range(epochs):
        for used, counts, label in rows:
            at = np.append(used, FEATURES)
            x = np.append(model.vector(used, counts), 1.0)
            w = weights(at)
            error = softmax(x @ w)
            error[label] -= 1
            gradient = x[:, None] * error[None, :]
            step = (np.sqrt(n[at] + gradient**2) - np.sqrt(n[at])) / alpha
            z[at] += gradient - step * w
            n[at] += gradient**2
    fitted = weights(slice(None))
    model.weights, model.bias = fitted[:FEATURES].astype(np.float32), fitted[FEATURES]


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood, by golden-section search on its logarithm."""
    if len(labels) == 0:
        return 1.0

    def loss(log_t):
        return -np.log(softmax(logits / np.exp(log_t))[np.arange(len(labels)), labels] + 1e-300).mean()

    lo, hi, ratio = -4.0, 4.0, (np.sqrt(5) - 1) / 2
    for _ in range(60):
        a, b = hi - ratio * (hi - lo), lo + ratio * (hi - lo)
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def document_frequencies(labelled: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """(documents with each feature, documents) over all labelled rows; at most FEATURES rows reach the driver."""

    def count(batches):
        frequencies, n = np.zeros(FEATURES, np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                used, _ = gram_counts(text.as_py())
                frequencies[used] += 1
                n += 1
        used = np.flatnonzero(frequencies)
        yield pa.RecordBatch.from_pydict(
            {"feature": np.append(used, FEATURES), "n": np.append(frequencies[used], n)}
        )

    found = (
        labelled.select(text_col).mapInArrow(lean(count), "feature bigint, n bigint")
        .groupBy("feature").agg(F.sum("n").alias("n")).toArrow()
    )
    totals = np.zeros(FEATURES + 1, np.int64)
    totals[found.column("feature").to_numpy()] = found.column("n").to_numpy()
    return totals[:FEATURES], int(totals[FEATURES])


def fit_language_model(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    learn: Column | None = None,
    max_train_docs: int = 4_000,
    calibration_share: float = 0.25,
    **ftrl,
) -> LanguageModel:
    """Learn from rows with a language for which `learn` holds (by default all).

    The sample for weights and temperature has about `max_train_docs` documents, an
    equal number for each language where there are enough, chosen by a hash of id and text;
    `calibration_share` of it is for the temperature. Only their feature counts, at most
    FEATURES a document, reach the driver. Document frequencies are counted over all learnable rows.
    Without a learnable row the model has no language.
    """
    learnable = docs.where(F.col(lang_col).isNotNull() & (F.lit(True) if learn is None else learn)).select(
        F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")
    )
    by_language = {r["lang"]: r["count"] for r in learnable.groupBy("lang").count().collect()}
    languages = sorted(by_language)
    empty = np.zeros((FEATURES, len(languages)), np.float32)
    model = LanguageModel(languages, np.ones(FEATURES), empty, np.zeros(len(languages)))
    if not languages:
        return model
    frequencies, n_docs = document_frequencies(learnable, "text")
    model.idf = np.log((1 + n_docs) / (1 + frequencies)) + 1

    per_language = max(1, max_train_docs // len(languages))
    share = F.element_at(
        F.create_map(*[F.lit(v) for lang in languages for v in (lang, min(1.0, per_language / by_language[lang]))]),
        F.col("lang"),
    )
    place = F.pmod(F.xxhash64("doc_id", "text", F.lit("sample")), F.lit(1_000_000)) / 1_000_000
    sample = learnable.where(place < share).withColumn(
        "calibrates", F.pmod(F.xxhash64("doc_id", "text", F.lit("calibrate")), F.lit(1000)) < int(calibration_share * 1000)
    )

    def features(batches):
        for batch in batches:
            for row in zip(batch.column("lang"), batch.column("text"), batch.column("calibrates")):
                lang, text, calibrates = (v.as_py() for v in row)
                used, counts = gram_counts(text)
                if len(used):
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([lang]), pa.array([calibrates]), pa.array([used.astype("<u2").tobytes()]),
                            pa.array([np.minimum(counts, 2**31 - 1).astype("<i4").tobytes()]),
                        ],
                        names=["lang", "calibrates", "used", "counts"],
                    )

    schema = "lang string, calibrates boolean, used binary, counts binary"
    rows = sample.select("lang", "text", "calibrates").mapInArrow(lean(features), schema).toArrow().to_pylist()
    number = {lang: i for i, lang in enumerate(languages)}
    decoded = [
        (np.frombuffer(r["used"], "<u2").astype(np.int64), np.frombuffer(r["counts"], "<i4"), number[r["lang"]], r["calibrates"])
        for r in sorted(rows, key=lambda r: hash_order(r["used"], r["counts"]))
    ]
    training = [d[:3] for d in decoded if not d[3]] or [d[:3] for d in decoded]
    train_ftrl(model, training, **ftrl)
    held = [d for d in decoded if d[3]]
    if held:
        logits = np.array([model.logits(used, counts) for used, counts, _, _ in held])
        model.temperature = fit_temperature(logits, np.array([d[2] for d in held]))
    return model


def hash_order(*parts: bytes) -> bytes:
    """A fixed shuffled order, so that a rerun trains on the same sequence."""
    import hashlib

    return hashlib.md5(b"|".join(parts), usedforsecurity=False).digest()


def identify_languages(
    docs: DataFrame, model: LanguageModel, text_col: str = "text", pred_col: str = "lang_pred", score_col: str = "score"
) -> DataFrame:
    """`docs` with the predicted language and its score, from the text alone; a text of any length is read whole.

    A text that is null, empty or without a letter gets `und` and score 0. Repeated
    rows get equal answers. If `docs` has columns of the new names, they are replaced. An
    empty table stays empty.
    """
    kept = [c for c in docs.columns if c not in (pred_col, score_col)]
    schema = T.StructType(
        [docs.schema[c] for c in kept]
        + [T.StructField(pred_col, T.StringType()), T.StructField(score_col, T.DoubleType())]
    )
    shared = docs.sparkSession.sparkContext.broadcast(model)  # FEATURES floats per language

    def predict(batches):
        for batch in batches:
            found = [shared.value.predict(text.as_py()) for text in batch.column(text_col)]
            languages, scores = [f[0] for f in found], [f[1] for f in found]
            yield pa.RecordBatch.from_arrays(
                [batch.column(c) for c in kept] + [pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=schema.fieldNames(),
            )

    return docs.mapInArrow(lean(predict), schema)


def held_out(id_col: str = "doc_id") -> Column:
    """Every fifth document by the CRC-32 of its id; a null id is not held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def accepted_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_score: float = 0.3
) -> DataFrame:
    """`docs`, all columns, without those whose language cannot be told.

    Rejected are texts without a letter and those with a score below `min_score`. The model learns from the rows
    that `held_out` leaves; without labelled rows only texts without a letter go.
    """
    model = fit_language_model(docs, id_col, text_col, lang_col, learn=~held_out(id_col))
    pred, score = fresh(docs, "lang_found"), fresh(docs, "lang_score")
    judged = identify_languages(docs, model, text_col, pred, score)
    if model.languages:
        keep = (F.col(pred) != UNDETERMINED) & (F.col(score) >= min_score)
    else:
        keep = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return judged.where(keep).select(*docs.columns)
