"""Token ids as Arrow stream files of equal-length sequences with masks.

A file holds record batches of `ids` and `mask`, both fixed-size lists of the
sequence length. Documents follow each other in the stream, each with its end id,
and run over sequence borders; only the last sequence of a file is padded, where the mask is
false. A sequence is reached without copying or decoding. Next to the files stands an index
with the place of every document.
"""

from __future__ import annotations

import os
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import kept_in_worker, lean
from auditloom.llm.files import open_mapped, open_output, task_file
from auditloom.llm.shingles import mixed

SEQUENCE = 2048
BATCH_SEQUENCES = 512
MEMO_PIECES, TABLE_BITS = 400_000, 20
#: Bytes that are hashed in one step; a longer piece is hashed by itself.
STEP_BYTES = 1 << 17
MODEL_CACHE = 20_000
#: Bytes of text that are encoded together; a longer text is a group of its own.
GROUP_BYTES = 1 << 19
# The characters of the Unicode property White_Space beyond ASCII.
WIDE_SPACE = re.compile("[\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SPACE_BYTES = np.zeros(256, bool)
SPACE_BYTES[[9, 10, 11, 12, 13, 32]] = True
# The words of the byte-level pre-tokenizer, as far as they are Latin, and its signs for bytes.
LATIN_LETTER = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBER = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
LATIN_PIECE = re.compile("[ \\n]?(?:(?!<\\|)[!-~\u00a1-\u00ac\u00ae-\u024f])+")
LATIN_WORD = re.compile(
    f"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN_LETTER}]+| ?[{NUMBER}]+| ?[^\\s{LATIN_LETTER}{NUMBER}]+|\\s+"
)
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
SPACE_SIGN = "\u0120"
BYTE_SIGNS = {b: chr(b) for b in SHOWN} | {
    b: chr(256 + n) for n, b in enumerate(b for b in range(256) if b not in SHOWN)
}


def piece_starts(data: np.ndarray, text_starts: np.ndarray) -> np.ndarray:
    """Where the pieces of texts begin: a run of white space and the visible run after it are one piece.

    Tokens of a byte-level BPE never reach over white space that follows a visible character, so a text is
    the sum of its pieces.
    """
    space = SPACE_BYTES[data]
    begins = np.zeros(len(data), bool)
    begins[1:] = space[1:] & ~space[:-1]
    begins[text_starts] = True
    return np.flatnonzero(begins)


def latin_words(piece: str) -> list[str]:
    """The pre-tokenizer's words of a piece in Latin letters, bytes as their signs; the usual shapes without a search."""
    if piece[0] == " " and piece.isascii():
        if piece[1:].isalpha():
            return [SPACE_SIGN + piece[1:]]
        if piece[-1] in ".," and piece[1:-1].isalpha():
            return [SPACE_SIGN + piece[1:-1], piece[-1]]
    return [w.encode().decode("latin-1").translate(BYTE_SIGNS) for w in LATIN_WORD.findall(piece)]


class HashTable:
    """64-bit hash to a number, by open addressing in two arrays; looks up and adds whole arrays."""

    def __init__(self, bits: int):
        self.mask = np.uint64(2**bits - 1)
        self.hashes, self.numbers = np.zeros(2**bits, np.uint64), np.full(2**bits, -1, np.int32)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each hash, -1 where there is none."""
        at = (hashes & self.mask).astype(np.int64)
        found = self.numbers[at]
        other = np.flatnonzero((found >= 0) & (self.hashes[at] != hashes))
        while len(other):
            at[other] = (at[other] + 1) & int(self.mask)
            found[other] = self.numbers[at[other]]
            other = other[(found[other] >= 0) & (self.hashes[at[other]] != hashes[other])]
        return found

    def add(self, hashes: np.ndarray, numbers: np.ndarray) -> None:
        """Distinct new hashes with their numbers."""
        at, todo = (hashes & self.mask).astype(np.int64), np.arange(len(hashes))
        while len(todo):
            free = todo[self.numbers[at[todo]] < 0]
            _, first = np.unique(at[free], return_index=True)
            placed = free[first]
            self.hashes[at[placed]], self.numbers[at[placed]] = hashes[placed], numbers[placed]
            rest = np.ones(len(hashes), bool)
            rest[placed] = False
            todo = todo[rest[todo]]
            at[todo] = (at[todo] + 1) & int(self.mask)


class PieceHasher:
    """64-bit hashes of pieces of a byte array, all at once, by running sums of a polynomial with random byte values."""

    def __init__(self):
        base = 0x9E3779B97F4A7C15
        self.values = np.random.default_rng(7).integers(0, 2**64, 256, dtype=np.uint64)
        self.powers, self.inverses = self._powers(base), self._powers(pow(base, -1, 2**64))

    @staticmethod
    def _powers(base: int) -> np.ndarray:
        factors = np.full(STEP_BYTES, base, np.uint64)
        factors[0] = 1
        return np.multiply.accumulate(factors)

    def hashes(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        out, lo = np.empty(len(starts), np.uint64), 0
        while lo < len(starts):
            hi = int(np.searchsorted(ends, starts[lo] + STEP_BYTES, "right"))
            if hi == lo:  # one long piece
                out[lo] = xxhash.xxh64_intdigest(data[starts[lo] : ends[lo]])
                lo += 1
                continue
            first, last = starts[lo], ends[hi - 1]
            sums = np.zeros(last - first + 1, np.uint64)
            np.cumsum(self.values[data[first:last]] * self.powers[: last - first], out=sums[1:])
            own = sums[ends[lo:hi] - first] - sums[starts[lo:hi] - first]
            sizes = (ends[lo:hi] - starts[lo:hi]).astype(np.uint64)
            out[lo:hi] = mixed(own * self.inverses[starts[lo:hi] - first] + sizes)
            lo = hi
        return out


class PieceEncoder:
    """Ids of whole texts by a byte-level BPE tokenizer file, each distinct piece encoded once.

    The ids are those of `Tokenizer.encode(text, add_special_tokens=False)`. Pieces are known by
    a 64-bit hash; with MEMO_PIECES known at a time, a new piece is taken for another with probability below 1e-13.
    Texts with white space beyond ASCII go through the tokenizer whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.dtype = np.uint16 if self.tokenizer.get_vocab_size() <= 2**16 else np.uint32
        words, added = self.tokenizer.pre_tokenizer, self.tokenizer.get_added_tokens_decoder().values()
        #: Whether the file asks for nothing but the usual byte-level words and the model.
        self.plain = (
            self.tokenizer.normalizer is None
            and isinstance(words, pre_tokenizers.ByteLevel)
            and not words.add_prefix_space
            and words.use_regex
            and all(len(t.content) > 3 and t.content.startswith("<|") for t in added)
        )
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(MODEL_CACHE)
        self.hasher, self.table = PieceHasher(), HashTable(TABLE_BITS)
        self.ids, self.n_ids, self.n_pieces = np.empty(1 << 16, self.dtype), 0, 0
        self.starts, self.sizes, self.uses = (np.zeros(1 << 12, np.int64) for _ in range(3))
        self.hashes = np.zeros(1 << 12, np.uint64)

    def forget(self) -> None:
        """Keep the pieces that were used most, half of MEMO_PIECES at most; uses are halved."""
        uses, least = self.uses[: self.n_pieces], 2
        while (uses >= least).sum() > MEMO_PIECES // 2:
            least *= 2
        kept = np.flatnonzero(uses >= least)
        self.ids, sizes = self._gather(kept)
        self.n_ids, self.n_pieces = len(self.ids), len(kept)
        self.hashes, self.table = self.hashes[kept], HashTable(TABLE_BITS)
        self.table.add(self.hashes, np.arange(len(kept)))
        self.starts, self.sizes, self.uses = np.cumsum(sizes) - sizes, sizes, uses[kept] // 2

    def _gather(self, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of the pieces one after the other, number of ids of each)."""
        sizes = self.sizes[places]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        return self.ids[np.repeat(self.starts[places] - ends + sizes, sizes) + np.arange(total)], sizes

    def _by_model(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        """(all ids, number of ids of each piece) of pieces in Latin letters, by the tokenizer's own BPE model.

        The model gets the words of the pre-tokenizer, bytes as their stand-in characters.
        """
        tokenize, flat, sizes = self.tokenizer.model.tokenize, [], []
        for piece in pieces:
            before = len(flat)
            for word in latin_words(piece):
                flat += [t.id for t in tokenize(word)]
            sizes.append(len(flat) - before)
        return flat, sizes

    def _alone(self, pieces: list[str]) -> tuple[list[int], list[int]]:
        found = [e.ids for e in self.tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]
        return [i for ids in found for i in ids], [len(ids) for ids in found]

    def _learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode new pieces; they get the next places in the order given."""
        first, n = self.n_pieces, len(pieces)
        while first + n > len(self.starts):
            self.starts, self.sizes, self.uses, self.hashes = (
                np.concatenate([v, np.zeros(len(v) + 1, v.dtype)]) for v in (self.starts, self.sizes, self.uses, self.hashes)
            )
        fits = [self.plain and (p[1:].isalpha() and p.isascii() or bool(LATIN_PIECE.fullmatch(p))) for p in pieces]
        for way, encode in ((True, self._by_model), (False, self._alone)):
            own = [k for k, fit in enumerate(fits) if fit == way]
            if not own:
                continue
            ids, sizes = encode([pieces[k] for k in own])
            sizes, numbers = np.array(sizes, np.int64), np.array(own) + first
            while self.n_ids + len(ids) > len(self.ids):
                self.ids = np.concatenate([self.ids, np.empty(len(self.ids) + 1, self.dtype)])
            self.ids[self.n_ids : self.n_ids + len(ids)] = ids
            self.starts[numbers] = self.n_ids + np.cumsum(sizes) - sizes
            self.sizes[numbers] = sizes
            self.n_ids += len(ids)
        self.hashes[first : first + n] = hashes
        self.uses[first : first + n] = 0
        self.table.add(hashes, np.arange(first, first + n))
        self.n_pieces += n

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts one after the other, number of ids of each); null and empty texts have none."""
        wide = [k for k, t in enumerate(texts) if t and not t.isascii() and WIDE_SPACE.search(t)]
        if wide:
            whole = {k: np.array(self.tokenizer.encode(texts[k], add_special_tokens=False).ids, self.dtype) for k in wide}
            ids, sizes = self.encode_all([None if k in whole else t for k, t in enumerate(texts)])
            ends = np.cumsum(sizes)
            parts = [whole.get(k, ids[end - size : end]) for k, (end, size) in enumerate(zip(ends, sizes))]
            return np.concatenate(parts), np.array([len(part) for part in parts])
        if self.n_pieces > MEMO_PIECES:
            self.forget()
        coded = [t.encode() if t else b"" for t in texts]
        lengths = np.array([len(c) for c in coded], np.int64)
        raw = b"".join(coded)
        if not raw:
            return np.empty(0, self.dtype), lengths
        data, text_ends = np.frombuffer(raw, np.uint8), np.cumsum(lengths)
        starts = piece_starts(data, (text_ends - lengths)[lengths > 0])
        ends = np.append(starts[1:], len(data))
        hashes = self.hasher.hashes(data, starts, ends)
        places = self.table.find(hashes)
        unknown = np.flatnonzero(places < 0)
        if len(unknown):
            new, first, which = np.unique(hashes[unknown], return_index=True, return_inverse=True)
            at = unknown[first]
            pieces = [raw[a:b].decode() for a, b in zip(starts[at].tolist(), ends[at].tolist())]
            places[unknown] = self.n_pieces + which
            self._learn(new, pieces)
        np.add.at(self.uses, places, 1)
        ids, sizes = self._gather(places)
        before = np.concatenate([[0], np.cumsum(sizes)])[np.searchsorted(starts, np.concatenate([[0], text_ends]))]
        return ids, np.diff(before)


class SequenceWriter:
    """One stream file; `add` takes the ids of a document, in any number of calls."""

    def __init__(self, uri: str, dtype, sequence: int):
        self.sequence, self.dtype = sequence, dtype
        self.schema = pa.schema(
            [
                ("ids", pa.list_(pa.from_numpy_dtype(dtype), sequence)),
                ("mask", pa.list_(pa.bool_(), sequence)),
            ]
        )
        self.out = open_output(uri)
        self.stream = pa.ipc.new_stream(self.out, self.schema)
        self.waiting, self.n_waiting, self.n_ids = [], 0, 0

    def add(self, ids: np.ndarray) -> None:
        self.waiting.append(ids)
        self.n_waiting += len(ids)
        self.n_ids += len(ids)
        if self.n_waiting >= BATCH_SEQUENCES * self.sequence:
            self._write(BATCH_SEQUENCES * self.sequence)

    def _write(self, step: int) -> None:
        flat = np.concatenate(self.waiting)
        done = 0
        while len(flat) - done >= step > 0:
            self._batch(flat[done : done + step], step)
            done += step
        self.waiting, self.n_waiting = [flat[done:].copy()], len(flat) - done

    def _batch(self, flat: np.ndarray, real: int) -> None:
        mask = np.arange(len(flat)) < real
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(values), self.sequence) for values in (flat, mask)
        ]
        self.stream.write_batch(pa.record_batch(columns, schema=self.schema))

    def close(self) -> None:
        if self.n_waiting:
            flat = np.concatenate(self.waiting)
            padded = np.zeros(-(-len(flat) // self.sequence) * self.sequence, self.dtype)
            padded[: len(flat)] = flat
            self._batch(padded, len(flat))
        self.stream.close()
        self.out.close()


class SequenceFile:
    """Sequences of a stream file by number, as views of the mapped file."""

    def __init__(self, uri: str):
        self.source = open_mapped(uri)
        self.batches = list(pa.ipc.open_stream(self.source))
        self.sequence = self.batches[0].schema.field("ids").type.list_size if self.batches else 0

    def __len__(self) -> int:
        return sum(len(b) for b in self.batches)

    def __getitem__(self, number: int) -> tuple[np.ndarray, pa.Array]:
        """(ids, mask) of a sequence. All batches but the last have BATCH_SEQUENCES rows."""
        batch = self.batches[number // BATCH_SEQUENCES]
        row = number % BATCH_SEQUENCES
        at = slice(row * self.sequence, (row + 1) * self.sequence)
        return (
            batch.column("ids").values.to_numpy()[at],
            batch.column("mask").values.slice(at.start, self.sequence),
        )

    def runs(self, start: int, size: int):
        """The ids from `start`, as views that break at batch borders."""
        per_batch = BATCH_SEQUENCES * self.sequence
        while size > 0:
            values = self.batches[start // per_batch].column("ids").values.to_numpy()
            run = values[start % per_batch :][:size]
            yield run
            start, size = start + len(run), size - len(run)

    def masked(self) -> int:
        """Number of real ids by the masks."""
        return sum(b.column("mask").values.true_count for b in self.batches)


def groups(batch: pa.RecordBatch):
    """Consecutive slices of about GROUP_BYTES of text."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        before = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + GROUP_BYTES, "right")))
        yield batch.slice(at, to - at)
        at = to


def write_token_stream(
    docs: DataFrame,
    folder: str,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    end_id: int = 2,
    sequence: int = SEQUENCE,
) -> DataFrame:
    """Write the stream files of `docs` below `folder`, in ascending id order; return their index.

    Index, also kept as Parquet in `folder`: id, `part` (order of the files), `file`,
    `start` (place in the file) and `n_tokens` with the end id. Null and empty
    texts have the end id alone; long texts are encoded whole. Null ids come first, repeated ids
    side by side, ordered by a hash of their text, which also spreads them over several
    files. An empty table writes no file. Other columns are not read. One task
    writes one file, holding one batch at a time.
    """
    spark = docs.sparkSession
    id_type = docs.schema[id_col].dataType
    tie = F.xxhash64(F.col(text_col))
    ordered = (
        docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), tie.alias("tie"))
        .repartitionByRange("doc_id", "tie")
        .sortWithinPartitions("doc_id", "tie")
        .select("doc_id", "text")
    )
    schema = T.StructType(
        [
            T.StructField("doc_id", id_type),
            T.StructField("part", T.IntegerType()),
            T.StructField("file", T.StringType()),
            T.StructField("start", T.LongType()),
            T.StructField("n_tokens", T.LongType()),
        ]
    )

    def write(batches):
        part_no, writer = TaskContext.get().partitionId(), None
        encoder = kept_in_worker(f"encoder:{tokenizer_path}", lambda: PieceEncoder(tokenizer_path))
        for batch in batches:
            for part in groups(batch):
                if writer is None:
                    name = task_file(folder, ".arrows")
                    writer = SequenceWriter(name, encoder.dtype, sequence)
                ids, sizes = encoder.encode_all(part.column("text").to_pylist())
                starts = writer.n_ids + np.cumsum(sizes + 1) - sizes - 1
                writer.add(np.insert(ids, np.cumsum(sizes), end_id))
                n = part.num_rows
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([part_no] * n, pa.int32()),
                        pa.array([name] * n),
                        pa.array(starts, pa.int64()),
                        pa.array(sizes + 1, pa.int64()),
                    ],
                    names=schema.fieldNames(),
                )
        if writer is not None:
            writer.close()

    ordered.mapInArrow(lean(write), schema).write.parquet(f"{folder}/index")
    return read_index(spark, folder)


def read_index(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/index")


def read_token_stream(spark: SparkSession, folder: str) -> DataFrame:
    """One row per document, from the files: `doc_id`, `start` in the whole stream, `n_tokens`, `ids_crc32`.

    Each file is mapped by one task, which also holds its masks against the
    index. The starts add up the files before, one row per file.
    """
    index = read_index(spark, folder)
    files = index.groupBy("part", "file").agg(F.sum("n_tokens").alias("file_tokens"))
    before = Window.partitionBy(F.lit(0)).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = files.select("file", "file_tokens", F.coalesce(F.sum("file_tokens").over(before), F.lit(0)).alias("before"))
    n_files = max(1, files.count())  # a file's rows are few, but reading it is a task of its own
    placed = index.join(offsets, "file").repartition(n_files, "file").sortWithinPartitions("file", "start")
    schema = T.StructType(
        [index.schema["doc_id"], *[T.StructField(n, T.LongType()) for n in ("start", "n_tokens", "ids_crc32")]]
    )

    def read(batches):
        opened, name = None, None
        for batch in batches:
            crcs = []
            rows = zip(*(batch.column(c).to_pylist() for c in ("file", "start", "n_tokens", "file_tokens")))
            for file, start, size, file_tokens in rows:
                if file != name:
                    opened, name = SequenceFile(file), file
                    if opened.masked() != file_tokens:
                        raise ValueError(f"{file}: masks and index differ")
                crc = 0
                for run in opened.runs(start, size):
                    crc = zlib.crc32(run.astype("<u4"), crc)
                crcs.append(crc)
            starts = np.add(batch.column("start").to_numpy(), batch.column("before").to_numpy())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(starts, pa.int64()), batch.column("n_tokens"), pa.array(crcs, pa.int64())],
                names=schema.fieldNames(),
            )

    return placed.mapInArrow(lean(read), schema)
