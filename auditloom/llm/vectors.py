"""Steps that the operators on vectors share: which rows take part, blocks of them, pairs of blocks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import hand_back

#: Rows of a block: ROWS_OF_ROOT times the root of their number, so that blocks grow in number and size alike.
LEAST_BLOCK, MOST_BLOCK, ROWS_OF_ROOT = 4096, 262_144, 16


def block_rows(count: int) -> int:
    return max(LEAST_BLOCK, min(MOST_BLOCK, int(ROWS_OF_ROOT * count**0.5)))


def usable(vector: Column) -> Column:
    """Whether a vector has components, all of them finite numbers."""

    def finite(x: Column) -> Column:
        return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))

    return F.coalesce((F.size(vector) > 0) & F.forall(vector, finite), F.lit(False))


def usable_vectors(df: DataFrame, id_col: str, vector_col: str, **carry: Column) -> DataFrame:
    """`id`, `vector` (FLOAT or DOUBLE components as they are, others as DOUBLE), `dim` and what is carried, of rows with an id and a usable vector."""
    kind = df.schema[vector_col].dataType
    known = isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))
    vector = F.col(vector_col) if known else F.col(vector_col).cast("array<double>")
    rows = df.select(F.col(id_col).cast("long").alias("id"), vector.alias("vector"), *[c.alias(n) for n, c in carry.items()])
    return rows.where(F.col("id").isNotNull() & usable(F.col("vector"))).withColumn("dim", F.size("vector"))


def one_row_per_id(rows: DataFrame) -> DataFrame:
    """Of rows that share an `id`, the first by all other columns in order.

    Ids alone are counted first; where none repeats, which is the rule, the vectors are not shuffled.
    """
    if not rows.groupBy("id").count().where("count > 1").limit(1).count():
        return rows
    others = [c for c in rows.columns if c != "id"]
    first = Window.partitionBy("id").orderBy(*others)
    return rows.withColumn("_n", F.row_number().over(first)).where("_n = 1").drop("_n")


def blocks_of(rows: DataFrame, count: int, of: str) -> DataFrame:
    """Add the block `of`, 0 to `count` - 1, as equal in size as the partitions of `rows` allow, whatever the rows hold.

    The numbers of rows differ from one reading to the next only if the files do, so hand in a settled table.
    """
    return rows.withColumn(of, F.pmod(F.monotonically_increasing_id(), F.lit(count)).cast("int"))


def in_block_pairs(rows: DataFrame, queries: DataFrame, row_blocks: int, query_blocks: int, run, schema) -> DataFrame:
    """`run(rows, queries)` on Arrow tables, for every block of rows (`block`) and block of queries (`part`) of one `dim`.

    Rows and queries are copied once per block of the other side; a task holds one block of each.
    """
    parts = F.explode(F.sequence(F.lit(0), F.lit(query_blocks - 1)))
    blocks = F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1)))
    key = ["dim", "block", "part"]

    def tidy(left: pa.Table, right: pa.Table) -> pa.Table:
        hand_back()
        return run(left, right)

    left = rows.withColumn("part", parts).groupBy(*key)
    return left.cogroup(queries.withColumn("block", blocks).groupBy(*key)).applyInArrow(tidy, schema)


def matrix(vectors: pa.ChunkedArray, dim: int) -> np.ndarray:
    """A column of vectors of one length as a table of doubles."""
    flat = [c.flatten().to_numpy(zero_copy_only=False) for c in vectors.chunks]
    return np.concatenate([*flat, np.zeros(0)]).astype(np.float64).reshape(-1, dim)


def ordered_dots(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Inner products of two tables row by row, in doubles, the components added from first to last."""
    total = np.zeros(len(left))
    for k in range(left.shape[1]):
        total += left[:, k] * right[:, k]
    return total
