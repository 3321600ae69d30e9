"""Size checks for the small side of a join."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

BROADCAST_ROWS = 1_000_000
BROADCAST_BYTES = 64_000_000
POLICY_ROWS = 256


def small_table(spark: SparkSession, rows, schema: str | T.StructType) -> DataFrame:
    """A short literal table, held in the plan and not in an RDD."""
    fields = T.StructType.fromDDL(schema) if isinstance(schema, str) else schema
    columns = zip(*rows) if rows else [()] * len(fields)
    arrow_schema = to_arrow_schema(fields)
    arrays = [pa.array(list(c), f.type) for c, f in zip(columns, arrow_schema)]
    return spark.createDataFrame(pa.Table.from_arrays(arrays, schema=arrow_schema), fields)


def policy_rows(policy: DataFrame, max_rows: int = POLICY_ROWS) -> list[Row] | None:
    """Rows of a short policy table, or None when it has more than `max_rows`."""
    rows = policy.limit(max_rows + 1).collect()
    return rows if len(rows) <= max_rows else None


def row_bytes(df: DataFrame) -> Column:
    """Rough size of a row in bytes: lengths of texts and arrays count, other values as 16."""

    def of(name: str, kind: T.DataType) -> Column:
        if isinstance(kind, (T.StringType, T.BinaryType)):
            return F.coalesce(F.octet_length(F.col(name)), F.lit(0)) + 24
        if isinstance(kind, (T.ArrayType, T.MapType, T.StructType)):
            return F.coalesce(F.octet_length(F.to_json(F.struct(F.col(name)))), F.lit(0)) * 2 + 24
        return F.lit(16)

    return sum((of(f"`{f.name}`", f.dataType).cast("long") for f in df.schema.fields), F.lit(0).cast("long"))


def is_small(side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether `side` has at most `max_rows` rows and `max_bytes` bytes; reads one row more than that."""
    size = side.limit(max_rows + 1).select(row_bytes(side).alias("b")).agg(F.count(F.lit(1)), F.sum("b")).first()
    return size[0] <= max_rows and (size[1] or 0) <= max_bytes


def small_side(side: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Hint a broadcast only if `is_small` holds; else return the side without a hint, and the join shuffles both sides."""
    return F.broadcast(side) if is_small(side, max_rows, max_bytes) else side
