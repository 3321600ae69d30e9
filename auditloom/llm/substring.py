"""Repeated passages: every window of a fixed number of words that also starts earlier is removed.

A pass over the texts hashes all windows with rolling (Rabin-Karp) polynomials. Chunks of documents drop
their own repeats first, so a passage that millions of documents share sends one entry per chunk. The entries,
56 hash bits and a place, go to buckets by further hash bits; a bucket finds the first place of every hash and
returns all others, packed by shards of documents. Per document the repeated windows merge into maximal removal
intervals. The number of buckets follows the size of the corpus; with 56 bits and the bucket, two of n
windows get mixed up with probability below n / 2^35 in the whole corpus for buckets of BUCKET_WINDOWS.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import fresh, lean
from auditloom.llm.shingles import ROLL, ROLL_TOO, WordHashes, mixed, rolling
from auditloom.session import settle

WINDOW = 20
CHUNK_BYTES = 6_000_000
BUCKET_WINDOWS = 1_500_000
BYTES_PER_WORD = 6
#: Id of rows without one, the largest there is; a row may have it of its own.
NO_ID = 2**63 - 1

SPANS = "array<struct<start: bigint, end: bigint>>"


def planes(values: np.ndarray) -> bytes:
    """Bytes of equal weight together, compressed."""
    raw = np.ascontiguousarray(values).view(np.uint8).reshape(len(values), values.dtype.itemsize)
    return zstandard.compress(raw.T.tobytes(), 1)


def unplaned(data: bytes, dtype, n: int) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    raw = np.frombuffer(zstandard.decompress(data), np.uint8).reshape(size, n)
    return np.ascontiguousarray(raw.T).reshape(-1).view(dtype)


def differences(values: np.ndarray) -> np.ndarray:
    out = values.copy()
    out[1:] -= values[:-1]
    return out


def grouped(batches, key: str):
    """The rows of each value of `key`, in the order of sorted batches."""
    at, held = None, []
    for batch in batches:
        for n in range(batch.num_rows):
            row = batch.slice(n, 1).to_pylist()[0]
            if held and row[key] != at:
                yield held
                held = []
            at = row[key]
            held.append(row)
    if held:
        yield held


ENTRY_SCHEMA = "bucket int, n_entries int, n_docs int, repeats boolean, hashes binary, docs binary, counts binary, places binary"


def entry_row(bucket: int, hashes: np.ndarray | None, ids, text_hashes, doc_of: np.ndarray, places: np.ndarray) -> dict:
    """One row for the entries of a chunk in a bucket, in order of (document, place)."""
    used, counts = np.unique(doc_of, return_counts=True)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    steps = differences(places)
    steps[firsts] = places[firsts]
    low = None if hashes is None else np.ascontiguousarray(hashes).view(np.uint8).reshape(-1, 8)[:, :7].tobytes()
    return {
        "bucket": bucket, "n_entries": len(places), "n_docs": len(used), "repeats": hashes is None, "hashes": low,
        "docs": planes(differences(ids[used])) + text_hashes[used].tobytes(),
        "counts": planes(counts.astype(np.uint32)), "places": planes(steps.astype(np.uint32)),
    }


def entry_columns(row: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids, text hashes, places) of the entries of a row."""
    n, n_docs = row["n_entries"], row["n_docs"]
    data, tail = row["docs"], 8 * n_docs
    ids = np.cumsum(unplaned(data[: len(data) - tail], np.int64, n_docs))
    text_hashes = np.frombuffer(data, np.int64, n_docs, len(data) - tail)
    counts = unplaned(row["counts"], np.uint32, n_docs).astype(np.int64)
    steps = unplaned(row["places"], np.uint32, n).astype(np.int64)
    total = np.cumsum(steps)
    firsts = np.concatenate([[0], np.cumsum(counts)[:-1]])
    places = total - np.repeat(total[firsts] - steps[firsts], counts)
    return np.repeat(ids, counts), np.repeat(text_hashes, counts), places


def chunk_rows(docs: list[tuple], hashes: WordHashes, window: int, buckets: int):
    """Rows of ENTRY_SCHEMA for (id, text hash, words) of a chunk."""
    docs = sorted({d[:2]: d for d in docs}.values(), key=lambda d: d[:2])  # a repeated row is the same document
    docs = [d for d in docs if len(d[2]) >= window]
    if not docs:
        return
    sizes = np.array([len(d[2]) for d in docs])
    words = np.concatenate([d[2] for d in docs])
    ids = np.array([d[0] for d in docs], np.int64)
    text_hashes = np.array([d[1] for d in docs], np.int64)
    ends = np.cumsum(sizes)
    doc_of = np.repeat(np.arange(len(docs)), sizes)
    places = np.arange(len(words)) - (ends - sizes)[doc_of]
    whole = places <= sizes[doc_of] - window  # the window does not run over into the next document
    whole = whole[: len(words) - window + 1]
    doc_of, places = doc_of[: len(whole)][whole], places[: len(whole)][whole]
    high = mixed(rolling(words, window, ROLL)[whole])
    low = mixed(rolling(words, window, ROLL_TOO)[whole]) >> np.uint64(8)
    bucket = ((high >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)

    order = np.argsort(low, kind="stable")
    same = (low[order[1:]] == low[order[:-1]]) & (bucket[order[1:]] == bucket[order[:-1]])
    run = np.concatenate([[0], np.where(same, 0, np.arange(1, len(order)))])
    first = np.empty(len(order), np.int64)
    first[order] = order[np.maximum.accumulate(run)]
    # An equal window at the same place of a document with the same id is no earlier one.
    repeat = (ids[doc_of] != ids[doc_of[first]]) | (places != places[first])
    again = np.flatnonzero(repeat)
    if len(again):
        yield entry_row(int(bucket[again[0]]), None, ids, text_hashes, doc_of[again], places[again])
    sent = np.flatnonzero(~repeat)
    sent = sent[np.argsort(bucket[sent], kind="stable")]
    borders = np.flatnonzero(np.diff(bucket[sent])) + 1
    for part in np.split(sent, borders):
        if len(part):
            yield entry_row(int(bucket[part[0]]), low[part], ids, text_hashes, doc_of[part], places[part])


def bucket_repeats(rows: list[dict]):
    """(id, text hash, places) of all entries of a bucket but the first of each hash."""
    ids, text_hashes, places, lows = [], [], [], []
    for row in rows:
        own = entry_columns(row)
        if row["repeats"]:
            yield own
            continue
        wide = np.zeros((row["n_entries"], 8), np.uint8)
        wide[:, :7] = np.frombuffer(row["hashes"], np.uint8).reshape(-1, 7)
        lows.append(wide.reshape(-1).view(np.uint64))
        for store, values in zip((ids, text_hashes, places), own):
            store.append(values)
    if not lows:
        return
    low = np.concatenate(lows)
    order = np.argsort(low, kind="stable")
    same = low[order[1:]] == low[order[:-1]]
    shared = np.zeros(len(low), bool)
    shared[order[1:][same]] = True
    shared[order[:-1][same]] = True
    at = np.flatnonzero(shared)
    if len(at) == 0:
        return
    low = low[at]
    ids, text_hashes, places = (np.concatenate(s)[at] for s in (ids, text_hashes, places))
    order = np.lexsort((places, ids, low))
    low, ids, text_hashes, places = low[order], ids[order], text_hashes[order], places[order]
    run = np.concatenate([[0], np.where(low[1:] == low[:-1], 0, np.arange(1, len(low)))])
    first = np.maximum.accumulate(run)
    later = (ids != ids[first]) | (places != places[first])
    yield ids[later], text_hashes[later], places[later]


REPEAT_SCHEMA = "shard int, n_docs int, docs binary, counts binary, places binary"


def repeat_rows(found: list[tuple], shards: int) -> list[dict]:
    """One row per shard of documents for the repeats of a bucket, its documents and places packed."""
    if not found:
        return []
    ids, text_hashes, places = (np.concatenate(parts) for parts in zip(*found))
    mark = mixed(ids.view(np.uint64) * ROLL ^ text_hashes.view(np.uint64))
    shard = ((mark >> np.uint64(32)) * np.uint64(shards) >> np.uint64(32)).astype(np.int64)
    order = np.lexsort((places, text_hashes, ids, shard))
    ids, text_hashes, places, shard = (v[order] for v in (ids, text_hashes, places, shard))
    new_doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (text_hashes[1:] != text_hashes[:-1])])
    starts = np.flatnonzero(new_doc)
    counts = np.diff(np.append(starts, len(ids)))
    own = shard[starts]
    rows = []
    for lo, hi in runs(own):
        entries = slice(starts[lo], starts[hi - 1] + counts[hi - 1])
        at = starts[lo:hi]
        rows.append(
            {
                "shard": int(own[lo]), "n_docs": hi - lo, "docs": ids[at].tobytes() + text_hashes[at].tobytes(),
                "counts": counts[lo:hi].astype("<u4").tobytes(),
                "places": zstandard.compress(places[entries].astype("<u4").tobytes(), 1),
            }
        )
    return rows


def runs(values: np.ndarray) -> list[tuple[int, int]]:
    """(start, end) of the stretches of equal values."""
    if len(values) == 0:
        return []
    borders = [0, *(np.flatnonzero(values[1:] != values[:-1]) + 1).tolist(), len(values)]
    return list(zip(borders, borders[1:]))


def shard_spans(rows: list[dict], window: int) -> pa.RecordBatch:
    """(id, text hash, spans) of the documents of a shard: their repeated windows merged into maximal intervals."""
    ids, text_hashes, places = [], [], []
    for row in rows:
        n, counts = row["n_docs"], np.frombuffer(row["counts"], "<u4")
        ids.append(np.repeat(np.frombuffer(row["docs"], np.int64, n), counts))
        text_hashes.append(np.repeat(np.frombuffer(row["docs"], np.int64, n, 8 * n), counts))
        places.append(np.frombuffer(zstandard.decompress(row["places"]), "<u4").astype(np.int64))
    ids, text_hashes, places = (np.concatenate(v) for v in (ids, text_hashes, places))
    order = np.lexsort((places, text_hashes, ids))
    ids, text_hashes, places = ids[order], text_hashes[order], places[order]
    new_doc = np.concatenate([[True], (ids[1:] != ids[:-1]) | (text_hashes[1:] != text_hashes[:-1])])
    new_span = new_doc | np.concatenate([[True], places[1:] > places[:-1] + window])
    first = np.flatnonzero(new_span)
    ends = places[np.append(first[1:], len(places)) - 1] + window
    offsets = np.append(np.flatnonzero(new_doc[first]), len(first)).astype(np.int32)
    docs = np.flatnonzero(new_doc)
    spans = pa.ListArray.from_arrays(
        pa.array(offsets), pa.StructArray.from_arrays([pa.array(places[first]), pa.array(ends)], names=["start", "end"])
    )
    return pa.RecordBatch.from_arrays([pa.array(ids[docs]), pa.array(text_hashes[docs]), spans], names=["doc_id", "text_hash", "spans"])


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """(`doc_id`, `text_hash`, `spans`) of the documents that lose words; spans are disjoint word ranges in order, the end not included.

    A word goes if a window that covers it also starts earlier: in a document with a
    smaller id or earlier in its own. Windows are judged on the whole input. Rows without an id have the largest id, NO_ID, and are
    told so by `doc_id`. Rows that share an id count as one document among themselves: only an earlier start counts between them.
    Null and empty texts and texts shorter than the window lose nothing. Texts are read whole; ids are integers.
    """
    spark = docs.sparkSession
    n_bytes = docs.agg(F.sum(F.octet_length(F.col(text_col)))).first()[0] or 0
    buckets = int(n_bytes // (BYTES_PER_WORD * BUCKET_WINDOWS)) + 1
    rows = docs.select(
        F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)).alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"),
        F.col(text_col).alias("text"),
    )
    entry_type = T.StructType.fromDDL(ENTRY_SCHEMA)
    arrow_type = pa.schema(
        [("bucket", pa.int32()), ("n_entries", pa.int32()), ("n_docs", pa.int32()), ("repeats", pa.bool_())]
        + [(n, pa.binary()) for n in ("hashes", "docs", "counts", "places")]
    )

    def hash_windows(batches):
        hashes, held, size = WordHashes(), [], 0

        def close():
            if found := list(chunk_rows(held, hashes, window, buckets)):
                yield pa.RecordBatch.from_pylist(found, schema=arrow_type)

        for batch in batches:
            for doc_id, text_hash, text in zip(*(batch.column(c) for c in ("doc_id", "text_hash", "text"))):
                text = text.as_py()
                if not text:
                    continue
                words = text.encode("utf-8", "surrogatepass").split()
                held.append((doc_id.as_py(), text_hash.as_py(), hashes.of(words)))
                size += len(text)
                if size >= CHUNK_BYTES:
                    yield from close()
                    held, size = [], 0
        yield from close()

    repeat_type = pa.schema([("shard", pa.int32()), ("n_docs", pa.int32())] + [(n, pa.binary()) for n in ("docs", "counts", "places")])

    def find_repeats(batches):
        for held in grouped(batches, "bucket"):
            found = [f for f in bucket_repeats(held) if len(f[0])]
            if rows := repeat_rows(found, buckets):
                yield pa.RecordBatch.from_pylist(rows, schema=repeat_type)

    def merge(batches):
        for held in grouped(batches, "shard"):
            yield shard_spans(held, window)

    entries = rows.mapInArrow(lean(hash_windows), entry_type)
    repeats = entries.repartition(buckets, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(find_repeats), REPEAT_SCHEMA)
    merged = (
        repeats.repartition(buckets, "shard")
        .sortWithinPartitions("shard")
        .mapInArrow(lean(merge), f"doc_id bigint, text_hash bigint, spans {SPANS}")
    )
    return settle(merged)


def with_spans(docs: DataFrame, spans: DataFrame, id_col: str, text_col: str, spans_col: str) -> DataFrame:
    """`docs` with their spans, null where nothing goes; one shuffle of the texts."""
    text_hash = fresh(docs, "text_hash")
    side = spans.select(F.col("doc_id").alias("s_id"), F.col("text_hash").alias("s_hash"), F.col("spans").alias(spans_col))
    same = (F.coalesce(F.col(id_col).cast("long"), F.lit(NO_ID)) == F.col("s_id")) & (F.col(text_hash) == F.col("s_hash"))
    joined = docs.withColumn(text_hash, F.xxhash64(F.col(text_col))).join(side, same, "left")
    return joined.select(*docs.columns, spans_col)


def kept_words(text: str | None, spans: list[dict] | None) -> tuple[int, list[bytes]]:
    """(number of words, words outside the spans)."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    if not spans:
        return len(words), words
    kept, at = [], 0
    for span in spans:
        kept += words[at : span["start"]]
        at = span["end"]
    return len(words), kept + words[at:]


def removal_labels(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """One row per row of `docs`: id, `n_words`, `n_removed`, `kept_sha256` of the kept words joined by one space.

    See `repeated_spans`. Null and empty texts have no words and the digest of the empty text. An
    empty table gives no rows; other columns are not read.
    """
    narrow = docs.select(F.col(id_col), F.col(text_col))
    joined = with_spans(narrow, repeated_spans(narrow, id_col, text_col, window), id_col, text_col, "spans_")
    schema = T.StructType(
        [docs.schema[id_col], *T.StructType.fromDDL("n_words bigint, n_removed bigint, kept_sha256 string").fields]
    )

    def label(batches):
        for batch in batches:
            found = []
            for text, spans in zip(batch.column(text_col), batch.column("spans_")):
                n, kept = kept_words(text.as_py(), spans.as_py())
                found.append((n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
            columns = list(zip(*found)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(id_col), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.string())],
                names=schema.fieldNames(),
            )

    return joined.mapInArrow(lean(label), schema)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW) -> DataFrame:
    """`docs`, all columns, with the kept words, joined by one space, as the text of those that lose words."""
    spans_col = fresh(docs, "spans")
    joined = with_spans(docs, repeated_spans(docs, id_col, text_col, window), id_col, text_col, spans_col)
    names = docs.columns

    def rewrite(batches):
        for batch in batches:
            texts = []
            for text, spans in zip(batch.column(text_col), batch.column(spans_col)):
                value, own = text.as_py(), spans.as_py()
                texts.append(b" ".join(kept_words(value, own)[1]).decode("utf-8", "surrogatepass") if own else value)
            columns = [pa.array(texts, pa.string()) if c == text_col else batch.column(c) for c in names]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(lean(rewrite), docs.schema)
