"""Shards that all match the mixture: proportional stratified interleaving."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from auditloom.llm.common import key_slice, running_before, seeded_key, slice_count
from auditloom.session import settle


def interleave_shards(
    rows: DataFrame,
    id_col: str = "doc_id",
    source_col: str = "source",
    shards: int = 8,
    seed: str = "shard",
    carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row: id, source, the `carry` columns, `shard`, `slot`.

    Rows of a source are put in seeded order; rank r of n gets the fraction
    (2r + 1) / 2n. Sorted by fraction, any stretch holds each source in its share of the
    whole, give or take a row, so the cut into `shards` stretches with row counts at most
    one apart makes every shard match the mixture. `slot` counts a shard's rows from 0
    without gaps and is the order they should be written in.

    A null source is a source of its own. Equal fractions go by source (null
    last), then by the seeded key. Repeated ids, null ids too, are placed row
    by row; which of them comes first is open unless a `carry` column tells them apart.
    An empty table gives no rows, and shards beyond the number of rows stay empty.
    Neither a large source nor the whole is ranked in one task: both orders are cut into
    slices (`running_before`).
    """
    spark = rows.sparkSession
    slices = slice_count(spark)
    key = seeded_key(seed, F.col(id_col))
    narrow = settle(rows.select(id_col, source_col, *carry, key.alias("shard_key")))
    ties = [F.col(id_col), *[F.col(c) for c in carry]]
    sizes = narrow.groupBy(F.col(source_col).alias("size_source")).agg(F.count(F.lit(1)).alias("source_rows"))
    ranked = running_before(
        narrow, [source_col], key_slice(F.col("shard_key"), slices), [F.col("shard_key"), *ties], {"source_rank": F.lit(1)}
    )
    fraction = (F.col("source_rank") * 2 + 1) / (F.col("source_rows") * 2)
    spread = settle(
        ranked.join(sizes, F.col(source_col).eqNullSafe(F.col("size_source"))).select(
            *narrow.columns, fraction.alias("fraction")
        )
    )
    total = spread.count()
    order = [F.col("fraction"), F.col(source_col).asc_nulls_last(), F.col("shard_key"), *ties]
    placed = running_before(spread, [], F.floor(F.col("fraction") * slices).cast("int"), order, {"place": F.lit(1)})
    shard = F.expr(f"(place * {shards}) div {max(total, 1)}")
    first = F.expr(f"(shard * {total} + {shards - 1}) div {shards}")
    return (
        placed.withColumn("shard", shard.cast("int"))
        .withColumn("slot", (F.col("place") - first).cast("long"))
        .select(id_col, source_col, *carry, "shard", "slot")
    )
