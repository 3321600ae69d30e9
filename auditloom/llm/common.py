"""Columns and steps that several corpus operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
import sys
import types

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# The six ASCII white-space characters, as a regular expression class and as text.
SPACE_CLASS = r"[\x20\x09-\x0D]"
WORD_CLASS = r"[^\x20\x09-\x0D]"
SPACE_CHARS = " \t\n\x0b\x0c\r"

SLICES_PER_PARTITION = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have yet, so that extra columns never clash."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def word_count(text: Column) -> Column:
    """Number of `[^\\x20\\x09-\\x0D]+` in a text as BIGINT; null has none.

    Every word with the space after it becomes one sign, so no array of words is made.
    """
    trimmed = F.btrim(F.coalesce(text, F.lit("")), F.lit(SPACE_CHARS))
    return F.char_length(F.regexp_replace(trimmed, f"{WORD_CLASS}+{SPACE_CLASS}*", "x")).cast("long")


def seeded_key(seed: str, *parts: Column) -> Column:
    """32 hex digits that depend on the seed and the parts alone (null counts as empty)."""
    texts = [F.coalesce(p.cast("string"), F.lit("")) for p in parts]
    return F.md5(F.concat_ws(":", F.lit(seed), *texts))


def slice_count(spark: SparkSession) -> int:
    return SLICES_PER_PARTITION * int(spark.conf.get("spark.sql.shuffle.partitions"))


def key_slice(key: Column, slices: int) -> Column:
    """Slice of a hex key; equal shares of the key range, in key order."""
    return F.floor(F.conv(F.substring(key, 1, 8), 16, 10).cast("long") * slices / F.lit(2**32)).cast("int")


def running_before(
    df: DataFrame, group: list[str], slice_by: Column, order: list[Column], values: dict[str, Column]
) -> DataFrame:
    """Sums over the rows before each row of its group: `values` maps new columns to what is summed.

    With `F.lit(1)` the sum is a rank without gaps from 0. A group may hold any
    share of the rows: `slice_by`, a number that never falls along `order`, cuts
    it into slices. Each slice is summed by itself, one row per slice passes
    the sums on, and the result does not depend on the number of slices. `df`
    is read twice, so hand in a narrow, settled table.
    """
    cut = fresh(df, "slice")
    sliced = df.withColumn(cut, slice_by)
    totals = sliced.groupBy(*group, cut).agg(*[F.sum(v).alias(f"{n}_total") for n, v in values.items()])
    earlier = Window.partitionBy(*(group or [F.lit(0)])).orderBy(cut).rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        *[F.col(g).alias(f"{g}_side") for g in group],
        F.col(cut).alias(f"{cut}_side"),
        *[F.coalesce(F.sum(f"{n}_total").over(earlier), F.lit(0)).alias(f"{n}_offset") for n in values],
    )
    inside = (
        Window.partitionBy(*group, cut).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    )
    local = sliced.withColumns({n: F.coalesce(F.sum(v).over(inside), F.lit(0)) for n, v in values.items()})
    same = F.col(cut) == F.col(f"{cut}_side")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"{g}_side"))
    joined = local.join(offsets, same)
    return joined.withColumns({n: F.col(n) + F.col(f"{n}_offset") for n in values}).select(*df.columns, *values)


def hand_back() -> None:
    """Free what is unreachable and give unused memory of the allocators back to the system."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def lean(run):
    """`run`, a function over Arrow batches, that starts and ends with `hand_back`.

    Python workers go from task to task. What the function of an earlier task left in cycles, and
    what the allocators keep, would be missing elsewhere on the executor.
    """

    @functools.wraps(run)
    def wrapped(batches):
        hand_back()
        yield from run(batches)
        hand_back()

    return wrapped


def kept_in_worker(name: str, make):
    """An object that a Python worker makes once and its later tasks find again.

    The functions of this package travel with each task by value, and the globals of their modules with
    them, so what is to outlive a task is kept with the interpreter.
    """
    holder = sys.modules.setdefault("_auditloom_worker", types.ModuleType("_auditloom_worker"))
    if not hasattr(holder, name):
        setattr(holder, name, make())
    return getattr(holder, name)
