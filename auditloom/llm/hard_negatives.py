"""Hard negatives by rotated one-bit codes, exact: intervals from popcounts decide which rows are scored at all.

A vector becomes integers, `floor(SCALE * x)`. Its code has STAGES parts. Each rotates what is left of the vector,
keeps one sign bit a component, stores the alignment of the vector with that code vector, and hands the residual on.
The inner product with an anchor is then a sum over the parts of alignment times code times rotated anchor, and
one term more, with the last residual, which Cauchy-Schwarz bounds by the lengths of both. Code times anchor comes from popcounts
of the bits with PLANES bit planes of the anchor, up to a rounding that is known exactly. So every row has an
interval that holds its true score, without chance, and only rows whose interval can still reach an answer are scored in integers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import kept_in_worker, lean
from auditloom.llm.vectors import block_rows, blocks_of, in_block_pairs, matrix, one_row_per_id, usable_vectors
from auditloom.session import settle

STAGES, PLANES = 6, 6
ANCHOR_BLOCK = 65_536
#: Rows and anchors whose intervals are worked out at once, and pairs scored at once.
ROWS_AT_ONCE, ANCHORS_AT_ONCE, PAIRS_AT_ONCE = 4096, 64, 65_536
#: Share of both lengths that covers the rounding of doubles.
ROUNDING = 1e-9


def rotation(dim: int, stage: int) -> np.ndarray:
    """The orthogonal matrix of one stage, the same in every task."""

    def make():
        q, r = np.linalg.qr(np.random.default_rng([dim, stage]).standard_normal((dim, dim)))
        return q * np.sign(np.diag(r))

    return kept_in_worker(f"rotation_{dim}_{stage}", make)


def padded(vectors: np.ndarray) -> np.ndarray:
    """Vectors as doubles, with zeros up to whole words of 64 bits."""
    return np.pad(vectors.astype(np.float64), ((0, 0), (0, -vectors.shape[1] % 64)))


def component_limit(dim: int) -> int:
    """The largest component whose scores fit 64 bits."""
    return min(2**31 - 1, int((2**62 / dim) ** 0.5))


def integers(vectors: np.ndarray, scale: float) -> np.ndarray:
    most = component_limit(vectors.shape[1])
    with np.errstate(over="ignore"):
        return np.clip(np.floor(vectors * scale), -most, most).astype(np.int32)


def encode(numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code words [row, stage, word], alignments [row, stage] and the length of the last residual."""
    left = padded(numbers)
    dim = left.shape[1]
    words, alignments = [], []
    for stage in range(STAGES):
        left = left @ rotation(dim, stage).T
        signs = left > 0
        alignment = np.abs(left).sum(axis=1) / np.sqrt(dim)
        left = left - np.where(signs, 1.0, -1.0) * (alignment / np.sqrt(dim))[:, None]
        words.append(np.packbits(signs, axis=1).view(np.uint64))
        alignments.append(alignment)
    return np.stack(words, axis=1), np.stack(alignments, axis=1), np.sqrt((left**2).sum(axis=1))


def intervals(words, alignments, rest, lengths, anchors: np.ndarray):
    """Lower and upper bounds [row, anchor] of the inner products with the anchors."""
    turned = padded(anchors)
    dim = turned.shape[1]
    square = (turned**2).sum(axis=1)
    estimate = np.zeros((len(words), len(anchors)))
    slack = np.zeros_like(estimate)
    for stage in range(STAGES):
        turned = turned @ rotation(dim, stage).T
        low = turned.min(axis=1, initial=0)
        step = (turned.max(axis=1, initial=0) - low) / (2**PLANES - 1)
        step = np.where(step > 0, step, 1.0)
        levels = np.rint((turned - low[:, None]) / step[:, None]).astype(np.uint8)
        rounded = levels * step[:, None] + low[:, None]
        error = np.abs(turned - rounded).sum(axis=1) / np.sqrt(dim)
        code = words[:, stage]
        ones = np.bitwise_count(code).sum(axis=1, dtype=np.int64)
        weighed = np.zeros(estimate.shape, np.int64)
        for plane in range(PLANES):
            bits = np.packbits((levels >> plane) & 1, axis=1).view(np.uint64)
            for word in range(code.shape[1]):
                weighed += np.bitwise_count(code[:, None, word] & bits[None, :, word]).astype(np.int64) << plane
        with_code = (2 * (weighed * step + ones[:, None] * low) - rounded.sum(axis=1)) / np.sqrt(dim)
        estimate += alignments[:, stage, None] * with_code
        slack += alignments[:, stage, None] * error
    beside = np.sqrt(np.maximum(square - np.maximum(np.abs(with_code) - error, 0) ** 2, 0))
    slack += rest[:, None] * beside + ROUNDING * (lengths[:, None] * np.sqrt(square) + 1)
    return estimate - slack, estimate + slack


def scored(numbers: np.ndarray, anchors: np.ndarray, r: np.ndarray, a: np.ndarray) -> np.ndarray:
    """Integer inner products of row r[i] and anchor a[i]."""
    out = np.empty(len(r), np.int64)
    for at in range(0, len(r), PAIRS_AT_ONCE):
        here = slice(at, at + PAIRS_AT_ONCE)
        out[here] = np.einsum("ij,ij->i", numbers[r[here]], anchors[a[here]])
    return out


def at_least(lower: np.ndarray, sure: np.ndarray, n: int) -> np.ndarray:
    """Per anchor, a bound that `n` sure rows reach; -inf where there are fewer."""
    bounds = np.where(sure, lower, -np.inf)
    if len(bounds) < n:
        return np.full(bounds.shape[1], -np.inf)
    return -np.partition(-bounds, n - 1, axis=0)[n - 1]


def first_of_each(group: np.ndarray, score: np.ndarray, ids: np.ndarray, n: int) -> np.ndarray:
    """Places of the first `n` of each group: higher scores first, ties by smaller id."""
    order = np.lexsort((ids, -score, group))
    sorted_group = group[order]
    starts = np.r_[True, sorted_group[1:] != sorted_group[:-1]] if len(order) else np.zeros(0, bool)
    begin = np.maximum.accumulate(np.where(starts, np.arange(len(order)), 0)) if len(order) else order
    return order[np.arange(len(order)) - begin < n]


class Block:
    """Rows of a block as arrays, a slice at a time."""

    def __init__(self, rows: pa.Table, dim: int):
        self.ids, self.labels = rows["id"].to_numpy(), rows["label"].to_numpy()
        self.numbers = matrix(rows["numbers"], dim).astype(np.int64)
        self.words = np.frombuffer(b"".join(rows["words"].to_pylist()), np.uint64).reshape(len(self.ids), STAGES, -1)
        self.alignments = matrix(rows["alignments"], STAGES)
        self.rest = rows["rest"].to_numpy()
        self.lengths = np.sqrt((self.numbers.astype(np.float64) ** 2).sum(axis=1))

    def slices(self):
        return (slice(at, at + ROWS_AT_ONCE) for at in range(0, len(self.ids), ROWS_AT_ONCE))

    def intervals(self, part: slice, anchors: np.ndarray):
        return intervals(self.words[part], self.alignments[part], self.rest[part], self.lengths[part], anchors)


def find_positives(n: int):
    """Function of a block of rows and one of anchors: per anchor its `n` best other rows of the same label in the block."""

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [np.zeros((3, 0), np.int64)]
        if rows.num_rows and anchors.num_rows:
            dim = rows["dim"][0].as_py()
            block = Block(rows, dim)
            asked, ids, labels = matrix(anchors["numbers"], dim).astype(np.int64), anchors["id"].to_numpy(), anchors["label"].to_numpy()
            for at in range(0, len(ids), ANCHORS_AT_ONCE):
                some = slice(at, at + ANCHORS_AT_ONCE)
                pairs = []
                for part in block.slices():
                    like = (block.labels[part, None] == labels[some]) & (block.ids[part, None] != ids[some])
                    lower, upper = block.intervals(part, asked[some])
                    r, a = np.nonzero(like & (upper >= at_least(lower, like, n)))
                    r, a = r + part.start, a + at
                    pairs.append(np.stack([a, r, scored(block.numbers, asked, r, a)]))
                a, r, score = np.concatenate(pairs, axis=1)
                best = first_of_each(a, score, block.ids[r], n)
                found.append(np.stack([ids[a[best]], block.ids[r[best]], score[best]]))
        return pa.table([pa.array(c) for c in np.concatenate(found, axis=1)], names=["anchor_id", "id", "score"])

    return run


def find_negatives(n: int, low: int, high: int):
    """Function of a block of rows and one of anchors with their positives: per pair its `n` best rows of other labels in the block."""
    names = ["anchor_id", "positive_id", "positive_score", "id", "score"]

    def run(rows: pa.Table, anchors: pa.Table) -> pa.Table:
        found = [np.zeros((5, 0), np.int64)]
        if rows.num_rows and anchors.num_rows:
            dim = rows["dim"][0].as_py()
            block = Block(rows, dim)
            asked, ids, labels = matrix(anchors["numbers"], dim).astype(np.int64), anchors["id"].to_numpy(), anchors["label"].to_numpy()
            positives = anchors["positives"].to_pylist()
            for at in range(0, len(ids), ANCHORS_AT_ONCE):
                some = slice(at, at + ANCHORS_AT_ONCE)
                pairs = [np.zeros((4, 0), np.int64)]
                for part in block.slices():
                    unlike = block.labels[part, None] != labels[some]
                    lower, upper = block.intervals(part, asked[some])
                    for rank in range(max(len(p) for p in positives[some])):
                        has = np.array([len(p) > rank for p in positives[some]])
                        goal = np.array([p[rank]["score"] if len(p) > rank else 0 for p in positives[some]], object)
                        # Bounds of the score as exact integers: low * goal <= 100 * score <= high * goal.
                        least = np.array([-(-low * int(g) // 100) for g in goal], np.int64)
                        most = np.array([high * int(g) // 100 for g in goal], np.int64)
                        open_ = unlike & has & (upper >= least) & (lower <= most)
                        sure = open_ & (lower >= least) & (upper <= most)
                        r, a = np.nonzero(open_ & (upper >= at_least(lower, sure, n)))
                        r, a = r + part.start, a + at
                        score = scored(block.numbers, asked, r, a)
                        inside = (score >= least[a - at]) & (score <= most[a - at])
                        pairs.append(np.stack([a, np.full(len(a), rank), r, score])[:, inside])
                a, rank, r, score = np.concatenate(pairs, axis=1)
                best = first_of_each(a * (max(len(p) for p in positives[some]) + 1) + rank, score, block.ids[r], n)
                chosen = [positives[i][k] for i, k in zip(a[best], rank[best])]
                found.append(
                    np.stack(
                        [
                            ids[a[best]], np.array([p["id"] for p in chosen], np.int64),
                            np.array([p["score"] for p in chosen], np.int64), block.ids[r[best]], score[best],
                        ]
                    )
                )
        return pa.table([pa.array(c) for c in np.concatenate(found, axis=1)], names=names)

    return run


def coded_rows(rows: DataFrame, scale: float) -> DataFrame:
    """Settled rows with their integers (`numbers`), code words, alignments and length of the residual (`rest`)."""
    added = "numbers array<int>, words binary, alignments array<double>, rest double"
    schema = T.StructType(
        [f for f in rows.schema.fields if f.name != "vector"] + T.StructType.fromDDL(added).fields
    )

    def make(batches):
        for batch in batches:
            table = pa.Table.from_batches([batch])
            for dim in sorted(set(table["dim"].to_pylist())):
                part = table.filter(pa.compute.equal(table["dim"], dim))
                numbers = integers(matrix(part["vector"], dim), scale)
                words, alignments, rest = encode(numbers)
                columns = [part[f.name].combine_chunks() for f in schema.fields[:-4]] + [
                    pa.FixedSizeListArray.from_arrays(numbers.reshape(-1), dim).cast(pa.list_(pa.int32())),
                    pa.array([w.tobytes() for w in words], pa.binary()),
                    pa.FixedSizeListArray.from_arrays(alignments.reshape(-1), STAGES).cast(pa.list_(pa.float64())),
                    pa.array(rest),
                ]
                yield from pa.table(columns, names=schema.fieldNames()).to_batches()

    return settle(rows.mapInArrow(lean(make), schema))


def mine_hard_negatives(
    df: DataFrame,
    is_anchor,
    id_col: str = "vec_id",
    label_col: str = "label",
    vector_col: str = "embedding",
    positives: int = 5,
    negatives: int = 3,
    low: int = 50,
    high: int = 95,
    scale: float = 256.0,
    anchor_block: int = ANCHOR_BLOCK,
) -> DataFrame:
    """Per anchor and positive, the first `negatives` rows of other labels that score from `low` to `high` percent of the positive.

    Anchors are the rows where `is_anchor` (a column of `df`) holds; an anchor's positives are its first `positives` other rows of the same label.
    Higher scores come first, ties by smaller id. Returns `anchor_id`, `positive_id`, `rank` (from 1), `negative_id`, `positive_score`,
    `negative_score`; an anchor without positives, or a positive without such rows, has none. Exact, whatever the codes tell.

    Rows without an id or a label, and vectors that are null, empty or hold a null, NaN or infinite component, take no part. Of rows
    that share an id the one with the smallest label, then vector, counts. Vectors of one length only meet each other. Components
    beyond `component_limit` (270 million at 64 components) are held to it, so that every score fits 64 bits.
    """
    rows = usable_vectors(
        df, id_col, vector_col, label=F.col(label_col).cast("long"), asks=F.coalesce(is_anchor, F.lit(False))
    ).where("label IS NOT NULL")
    coded = coded_rows(one_row_per_id(rows.select("id", "label", "vector", "dim", "asks")), scale)
    count = coded.count()
    blocks = max(1, -(-count // block_rows(count)))
    asking = coded.where("asks").select("id", "label", "dim", "numbers")
    parts = max(1, -(-asking.count() // anchor_block))
    dealt = blocks_of(coded.drop("asks"), blocks, "block")
    near = in_block_pairs(
        dealt, blocks_of(asking, parts, "part"), blocks, parts, find_positives(positives), "anchor_id bigint, id bigint, score bigint"
    )
    best = Window.partitionBy("anchor_id").orderBy(F.desc("score"), "id")
    first = near.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= positives)
    goals = first.groupBy(F.col("anchor_id").alias("_anchor")).agg(
        F.array_sort(F.collect_list(F.struct("_n", "id", "score"))).alias("positives")
    )
    with_goals = settle(asking.join(goals, F.col("id") == F.col("_anchor")).drop("_anchor"))
    far = in_block_pairs(
        dealt, blocks_of(with_goals, parts, "part"), blocks, parts, find_negatives(negatives, low, high),
        "anchor_id bigint, positive_id bigint, positive_score bigint, id bigint, score bigint",
    )
    best = Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("score"), "id")
    ranked = far.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= negatives)
    return ranked.select(
        "anchor_id", "positive_id", "rank", F.col("id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score")
    )
