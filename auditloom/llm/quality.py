"""Quality rules: in-text counts and the frequency of lines across the documents of a host."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import fresh, lean
from auditloom.session import settle

# The symbols that are counted, and the shares and sizes of the base rule.
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_WINDOW = 3
REPEAT_PERCENT = 50

MAX_DOCS_PER_HOST = 50
MIN_LEFT_PERCENT = 30

SPACES = b" \t\n\x0b\x0c\r"
FOLD_DIGITS = bytes.maketrans(b"123456789", b"000000000")
LINES = "array<struct<line_hash: binary, line_words: bigint>>"


def line_key(words: list[bytes]) -> bytes:
    """128-bit hash of a normalised line: A-Z lowered, digits as 0, words joined by one space."""
    return hashlib.md5(b" ".join(words).lower().translate(FOLD_DIGITS), usedforsecurity=False).digest()


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur twice or more in the text, the first included."""
    n = len(words) - REPEAT_WINDOW + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    base = len(numbers)
    pairs = ids[:-1] * base + ids[1:]
    if base > 2**20:  # keep the products inside 64 bits
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:n] * base + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order[1:]] == windows[order[:-1]]
    starts = np.zeros(n, bool)
    starts[order[1:][same]] = True
    starts[order[:-1][same]] = True
    covered = np.zeros(len(words), bool)
    for shift in range(REPEAT_WINDOW):
        covered[shift : shift + n] |= starts
    return int(covered.sum())


def text_counts(text: str | None) -> tuple:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lines) of a whole text.

    `lines` has each distinct normalised line once, with all words it has in the text.
    """
    if not text:
        return 0, 0, 0, 0, 0, []
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    if not words:
        return 0, 0, len(data) - len(data.translate(None, SYMBOLS)), 0, 0, []
    word_chars = len(text) - (len(data) - len(data.translate(None, SPACES)))
    n_symbols = len(data) - len(data.translate(None, SYMBOLS))
    seen, n_dup, lines = set(), 0, {}
    for line in data.split(b"\n"):
        own = line.split()
        if own:
            n_dup += line in seen
            seen.add(line)
            key = line_key(own)
            lines[key] = lines.get(key, 0) + len(own)
    return len(words), word_chars, n_symbols, n_dup, repeated_words(words), list(lines.items())


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def document_counts(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """Narrow settled table: `row_no`, id, `text_hash`, `host`, COUNTS, `lines`; the texts are read once."""
    fields = [
        T.StructField("doc_id", docs.schema[id_col].dataType),
        T.StructField("text_hash", T.LongType()),
        T.StructField("host", docs.schema[host_col].dataType),
        *[T.StructField(n, T.LongType()) for n in COUNTS],
        *T.StructType.fromDDL(f"lines {LINES}").fields,
    ]
    line_type = pa.list_(pa.struct([("line_hash", pa.binary()), ("line_words", pa.int64())]))

    def count(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                rows = [text_counts(text.as_py()) for text in part.column("text")]
                columns = list(zip(*rows))
                lines = pa.array(
                    [[{"line_hash": h, "line_words": w} for h, w in row] for row in columns[-1]], line_type
                )
                yield pa.RecordBatch.from_arrays(
                    [part.column(c) for c in ("doc_id", "text_hash", "host")]
                    + [pa.array(c, pa.int64()) for c in columns[:-1]]
                    + [lines],
                    names=[f.name for f in fields],
                )

    narrow = docs.select(
        F.col(id_col).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(host_col).alias("host"),
        F.col(text_col).alias("text"),
    )
    counted = narrow.mapInArrow(lean(count), T.StructType(fields))
    return settle(counted.withColumn("row_no", F.monotonically_increasing_id()))


def line_verdicts(
    counts: DataFrame, max_docs: int = MAX_DOCS_PER_HOST, min_left_percent: int = MIN_LEFT_PERCENT
) -> tuple[DataFrame, DataFrame]:
    """(one row per document with all columns but `lines`, the lines to remove by `row_no`).

    A line is frequent when more than `max_docs` documents of one host have it; it is counted per host and hash before
    the shuffle, so one that every document has is a row per task. Frequent lines then meet
    the lines of the documents; a hot one is split by the adaptive skew join. Their
    words are removed, and a document with less than `min_left_percent` of its words left is depleted.
    """
    lines = counts.select("row_no", "host", F.explode("lines").alias("line")).select("row_no", "host", "line.*")
    frequent = settle(
        lines.groupBy("host", "line_hash").agg(F.count(F.lit(1)).alias("n_docs")).where(F.col("n_docs") > max_docs)
    ).select(F.col("host").alias("f_host"), F.col("line_hash").alias("f_hash"), "n_docs")
    removed = settle(
        lines.join(
            frequent, (F.col("line_hash") == F.col("f_hash")) & F.col("host").eqNullSafe(F.col("f_host"))
        ).select("row_no", "line_hash", "line_words")
    )
    lost = removed.groupBy(F.col("row_no").alias("l_row")).agg(
        F.sum("line_words").alias("lost"), F.count(F.lit(1)).alias("lost_lines")
    )
    n_removed = F.coalesce("lost", F.lit(0))
    base_failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * REPEAT_PERCENT)
    depleted = (F.col("n_words") - n_removed) * 100 < F.col("n_words") * min_left_percent
    verdicts = (
        counts.drop("lines")
        .join(lost, F.col("row_no") == F.col("l_row"), "left")
        .withColumns({"n_line_words_removed": n_removed, "base_failed": base_failed})
        .withColumn("kept", ~base_failed & ~depleted)
        .drop("l_row", "lost", "lost_lines")
    )
    return verdicts, removed


def quality_labels(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits
) -> DataFrame:
    """One row per document: `doc_id`, COUNTS, `n_line_words_removed`, `base_failed`, `kept`.

    Words are runs without ASCII white space. A null or empty text has no words, fails the base
    rule and is not kept. A null host is a host of its own. Every row counts as a document, rows that repeat an
    id or a text too. Texts are read whole. An empty table gives no rows; other columns are not read.
    """
    verdicts, _ = line_verdicts(document_counts(docs, id_col, text_col, host_col), **limits)
    return verdicts.select("doc_id", *COUNTS, "n_line_words_removed", "base_failed", "kept")


def clean_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", **limits
) -> DataFrame:
    """The kept documents, all columns, without their frequent lines; the other lines stay as they are."""
    verdicts, removed = line_verdicts(document_counts(docs, id_col, text_col, host_col), **limits)
    hashes = removed.groupBy(F.col("row_no").alias("r_row")).agg(F.collect_set("line_hash").alias("c_lines"))
    keys = [F.col("doc_id").alias("c_id"), F.col("text_hash").alias("c_hash"), F.col("host").alias("c_host")]
    kept = (
        verdicts.where("kept")
        .join(hashes, F.col("row_no") == F.col("r_row"), "left")
        .groupBy(*keys)
        .agg(F.first("c_lines").alias("c_lines"))
    )
    text_hash, gone = fresh(docs, "text_hash"), fresh(docs, "gone_lines")
    joined = docs.withColumn(text_hash, F.xxhash64(F.col(text_col))).join(
        kept,
        F.col(id_col).eqNullSafe(F.col("c_id"))
        & (F.col(text_hash) == F.col("c_hash"))
        & F.col(host_col).eqNullSafe(F.col("c_host")),
    )
    names = docs.columns
    rows = joined.select(*names, F.col("c_lines").alias(gone))

    def strip(batches):
        for batch in batches:
            texts = []
            for text, hashes in zip(batch.column(text_col), batch.column(gone)):
                value, frequent = text.as_py(), set(hashes.as_py() or ())
                if frequent:
                    data = value.encode("utf-8", "surrogatepass").split(b"\n")
                    value = b"\n".join(
                        line for line in data if not (own := line.split()) or line_key(own) not in frequent
                    ).decode("utf-8", "surrogatepass")
                texts.append(value)
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return rows.mapInArrow(lean(strip), docs.schema)
