"""Slices of equal size for keys that hold too many rows for one task.

Operators that walk a key in order would give a hot key to one task. Here the rows of such
keys are cut by rank: a range partitioning over (key, order) deals them into
pieces of about equal size, however they crowd in time, and the piece is written down as the slice.
Each slice is worked on its own and a small carry (one row per slice) passes from
slice to slice, so results stay exact. Keys below the limit keep the single slice 0.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.functions.sizing import small_side, small_table
from auditloom.session import settle

HOT_ROWS = 8_000_000
PIECES_PER_LIMIT = 8
#: Pieces that a low limit may ask for; more only where they would hold over HOT_ROWS / PIECES_PER_LIMIT rows each.
MOST_PIECES = 256


@dataclass(frozen=True)
class Hot:
    """Keys above the limit, null among them, and the number of pieces for their rows."""

    keys: list = field(default_factory=list)
    pieces: int = 0

    def __bool__(self) -> bool:
        return bool(self.keys)


NONE_HOT = Hot()


def hot_keys(df: DataFrame, key: str, hot_rows: int = HOT_ROWS) -> Hot:
    """The keys with more than `hot_rows` rows.

    Reads `key` alone, combined before the shuffle. At most rows / `hot_rows` keys reach
    the driver. A job of several operators over the same rows asks once, on its input, and hands the answer
    on; a job that knows its keys can state them, or NONE_HOT, and nothing runs. Every piece is a task of several jobs, so a low limit over
    many rows asks for MOST_PIECES of them and not for one per `hot_rows` / PIECES_PER_LIMIT rows.
    """
    found = df.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_rows).collect()
    pieces, least = (sum(-(-r["n"] * PIECES_PER_LIMIT // rows) for r in found) for rows in (hot_rows, HOT_ROWS))
    return Hot([r["_key"] for r in found], max(min(pieces, MOST_PIECES), least))


def with_slices(df: DataFrame, key: str, order: list[str], hot: Hot) -> tuple[DataFrame, bool]:
    """Add `_slice` BIGINT and `_hot` BOOLEAN; also tell whether any key is hot.

    Slices of a key follow each other in rising `order`; rows that tie in it may fall on either
    side of a cut. With hot keys the rows are written down once before they are parted, so that
    what made `df` does not run twice, and the hot ones once more with their slice, which a repeated task then finds unchanged.
    """
    if not hot:
        return df.withColumns({"_slice": F.lit(0).cast("long"), "_hot": F.lit(False)}), False
    rows = settle(df)
    schema = T.StructType([T.StructField("_hot_key", df.schema[key].dataType)])
    listed = F.broadcast(small_table(df.sparkSession, [(k,) for k in hot.keys], schema))
    same = F.col(key).eqNullSafe(F.col("_hot_key"))
    cold = rows.join(listed, same, "left_anti").withColumns({"_slice": F.lit(0).cast("long"), "_hot": F.lit(False)})
    cut = rows.join(listed, same, "left_semi").repartitionByRange(hot.pieces, key, *order)
    sliced = settle(cut.withColumn("_slice", F.spark_partition_id().cast("long")))
    return cold.unionByName(sliced.withColumn("_hot", F.lit(True))), True


def join_slices(rows: DataFrame, per_slice: DataFrame, key: str) -> DataFrame:
    """Left join a per-slice table on (key, `_slice`), null keys included."""
    side = per_slice.withColumnsRenamed({key: "_side_key", "_slice": "_side_slice"})
    return rows.join(
        side,
        F.col(key).eqNullSafe(F.col("_side_key"))
        & (F.col("_slice") == F.col("_side_slice")),
        "left",
    ).drop("_side_key", "_side_slice")


def running_sliced(
    rows: DataFrame,
    any_hot: bool,
    key: str,
    order: list[Column],
    local: Column,
    frame: tuple[int, int],
    total: Column,
    carried: Column,
    combine,
    out: str,
    reverse: bool = False,
) -> DataFrame:
    """Running window value per key over rows that have `_slice` and `_hot`.

    `local` is the window value inside a slice over `order` and the ROWS `frame`,
    `total` the aggregate of one slice,
    `carried` the window aggregate over the `_total` of the slices before it
    (after it if `reverse`), and `combine(local, carry)` the final value.
    """
    window = Window.partitionBy(key, "_slice").orderBy(*order).rowsBetween(*frame)
    labelled = rows.withColumn(out, local.over(window))
    if any_hot:
        slice_order = F.col("_slice").desc() if reverse else F.col("_slice")
        before = (
            Window.partitionBy(key)
            .orderBy(slice_order)
            .rowsBetween(Window.unboundedPreceding, -1)
        )
        carry = (
            rows.where("_hot")
            .groupBy(key, "_slice")
            .agg(total.alias("_total"))
            .select(key, "_slice", carried.over(before).alias("_carry"))
        )
        labelled = join_slices(labelled, carry, key).withColumn(
            out, combine(F.col(out), F.col("_carry"))
        )
    return labelled.drop("_carry")


def running(
    df: DataFrame,
    key: str,
    cut_by: list[str],
    hot_rows: int = HOT_ROWS,
    hot: Hot | None = None,
    **window,
) -> DataFrame:
    """`running_sliced` over the rows of `df`, hot keys cut along the rising columns `cut_by`."""
    hot = hot_keys(df, key, hot_rows) if hot is None else hot
    rows, any_hot = with_slices(df, key, cut_by, hot)
    return running_sliced(rows, any_hot, key, **window).drop("_slice", "_hot")


def spread_join(rows: DataFrame, side: DataFrame, key: str, hot_rows: int = HOT_ROWS // 16) -> DataFrame:
    """Left join of `rows` with `side`, which has one row per value of `key`, without a hot task.

    Rows of a value with more than `hot_rows` of them, null among the values, are numbered and written down, and dealt by number to
    as many tasks as it takes for `hot_rows` each; their row of `side` is copied as often. Equal rows are
    told apart like all others. The hot values stay in a table of their own, so there may be any number of them.
    """
    counts = rows.groupBy(F.col(key).alias("_value")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows)
    hot = settle(counts.select("_value", F.ceil(F.col("_n") / hot_rows).cast("int").alias("_salts")))
    if not hot.limit(1).count():
        return rows.join(side, key, "left")
    rows, listed = settle(rows), small_side(hot)
    same = F.col(key).eqNullSafe(F.col("_value"))
    cold = rows.join(listed, same, "left_anti").join(side, key, "left")
    salt = F.pmod(F.monotonically_increasing_id(), F.col("_salts")).cast("int")
    dealt = settle(rows.join(listed, same).withColumn("_salt", salt).drop("_value", "_salts"))
    copies = side.join(listed, F.col(key) == F.col("_value")).withColumn("_salt", F.explode(F.sequence(F.lit(0), F.col("_salts") - 1)))
    spread = dealt.join(copies.drop("_value", "_salts"), [key, "_salt"], "left").drop("_salt")
    return cold.unionByName(spread)
