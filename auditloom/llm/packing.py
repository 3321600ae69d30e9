"""Token-budget batches from optimal length buckets.

Documents longer than `max_length` are cut into pieces. The histogram of piece
lengths, at most `max_length` rows, goes to the driver, where dynamic programming finds
the bucket boundaries with the least padding. Batches form inside each bucket.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.sizing import small_table
from auditloom.llm.common import key_slice, running_before, seeded_key, slice_count, word_count
from auditloom.session import settle


def optimal_boundaries(histogram: list[tuple[int, int]], buckets: int) -> list[int]:
    """Upper bucket boundaries that minimise the padding of `(length, count)` rows.

    Every length falls in the bucket of the smallest boundary not below it and is
    padded to that boundary. Exact, in integers: for bucket number k,
    best[j] = min over i < j of best_before[i] + length_j * (N_j - N_i) - (S_j - S_i)
    with counts N and token sums S up to a length. For growing length_j the terms of i
    are lines of falling slope, so the lower envelope is kept in a queue and a round takes
    linear time. Of equal solutions the one with the smaller earlier boundaries wins.
    """
    rows = sorted((length, count) for length, count in histogram if count > 0)
    if not rows:
        return []
    lengths = [0] + [length for length, _ in rows]
    counts, sums = [0], [0]
    for length, count in rows:
        counts.append(counts[-1] + count)
        sums.append(sums[-1] + length * count)
    n = len(rows)
    best: list[int | None] = [0] + [None] * n
    choices = []
    for _ in range(min(buckets, n)):
        now: list[int | None] = [None] * (n + 1)
        choice = [0] * (n + 1)
        hull: list[tuple[int, int, int]] = []  # slope, value at 0, i
        head = 0
        for j in range(1, n + 1):
            i = j - 1
            if best[i] is not None:
                line = (-counts[i], best[i] + sums[i], i)
                while len(hull) - head >= 2 and _hidden(hull[-2], hull[-1], line):
                    hull.pop()
                hull.append(line)
            if head >= len(hull):
                continue
            x = lengths[j]
            while len(hull) - head >= 2 and hull[head + 1][0] * x + hull[head + 1][1] < hull[head][0] * x + hull[head][1]:
                head += 1
            slope, value, i = hull[head]
            now[j] = slope * x + value + x * counts[j] - sums[j]
            choice[j] = i
        best = now
        choices.append(choice)
    boundaries, j = [], n
    for choice in reversed(choices):
        boundaries.append(lengths[j])
        j = choice[j]
    return boundaries[::-1]


def _hidden(a: tuple, b: tuple, c: tuple) -> bool:
    """Line b is nowhere strictly below both a and c (slopes fall from a to c)."""
    return (c[1] - a[1]) * (a[0] - b[0]) < (b[1] - a[1]) * (a[0] - c[0])


def pieces(docs: DataFrame, id_col: str, length: Column, max_length: int) -> DataFrame:
    """Rows (id, piece, start, length): whole documents, or pieces of `max_length` and a rest."""
    sized = docs.select(F.col(id_col), F.coalesce(length, F.lit(0)).cast("long").alias("n_tokens"))
    last = F.greatest(F.ceil(F.col("n_tokens") / max_length) - 1, F.lit(0)).cast("long")
    cut = sized.select("*", F.explode(F.sequence(F.lit(0).cast("long"), last)).alias("piece"))
    start = F.col("piece") * max_length
    return cut.select(
        id_col, "piece", start.alias("start"), F.least(F.col("n_tokens") - start, F.lit(max_length)).alias("length")
    )


def pack_by_length(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    length: Column | None = None,
    buckets: int = 8,
    max_length: int = 2048,
    token_budget: int = 32_768,
    seed: str = "pack",
) -> DataFrame:
    """One row per piece: id, `piece`, `start`, `length`, `bucket`, `batch`, `slot`, `padding`.

    `length` is the number of tokens of a document, by default its words and an
    end token, so a null or empty text has length 1. A document longer than
    `max_length` (at most `token_budget`) becomes pieces, none is cut off. `bucket` is
    the boundary a piece is padded to; a batch of a bucket holds
    `token_budget div bucket` pieces, taken in seeded order, and the last batch of each
    bucket may be short. Rows that repeat an id, null ids too, are packed one by
    one; among them the order is open. An explicit length of 0 or null gives
    a row with null bucket, batch and slot. An empty table gives no rows. Other
    columns are not read.
    """
    spark = docs.sparkSession
    if not 0 < max_length <= token_budget:
        raise ValueError("max_length must be between 1 and token_budget")
    if length is None:
        length = word_count(F.col(text_col)) + 1
    key = seeded_key(seed, F.col(id_col), F.col("piece"))
    items = settle(pieces(docs, id_col, length, max_length).withColumn("pack_key", key))
    histogram = items.where("length > 0").groupBy("length").count().collect()  # at most max_length rows
    boundaries = optimal_boundaries([(r["length"], r["count"]) for r in histogram], buckets)
    bounds = small_table(
        spark, list(zip([0, *boundaries], boundaries)), "above bigint, bucket bigint"
    )
    placed = items.join(
        F.broadcast(bounds), (F.col("length") > F.col("above")) & (F.col("length") <= F.col("bucket")), "left"
    ).drop("above")
    ranked = running_before(
        placed,
        ["bucket"],
        key_slice(F.col("pack_key"), slice_count(spark)),
        [F.col("pack_key"), F.col(id_col), F.col("piece"), F.col("length")],
        {"pack_rank": F.lit(1)},
    )
    per_batch = F.floor(F.lit(token_budget) / F.col("bucket"))
    held = F.col("bucket").isNotNull()
    return ranked.select(
        id_col,
        "piece",
        "start",
        "length",
        "bucket",
        F.when(held, F.floor(F.col("pack_rank") / per_batch)).cast("long").alias("batch"),
        F.when(held, F.col("pack_rank") % per_batch).cast("long").alias("slot"),
        (F.col("bucket") - F.col("length")).alias("padding"),
    )
