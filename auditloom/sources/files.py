"""Files in and out: JSON bodies, log lines, corpora, template trees, settings."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_bodies(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """JSON lines, each kept whole in `body`, with the `file` it came from.

    The text is typed by `request_parse` or `json_project`, so a damaged line is
    a row and not a failed job.
    """
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(
        F.col("value").alias("body"), F.col("_metadata.file_path").alias("file")
    )


def read_log(spark: SparkSession, path: str, stream: bool = False) -> DataFrame:
    """Log lines in `line`, with the `file` they came from."""
    reader = spark.readStream if stream else spark.read
    return reader.format("text").load(path).select(
        F.col("value").alias("line"), F.col("_metadata.file_path").alias("file")
    )


def read_corpus(spark: SparkSession, path: str, glob: str = "*", recursive: bool = True) -> DataFrame:
    """Files as rows: path, length, body BINARY. Names are filtered before any body is read.

    Spark's file readers pass over files of zero bytes; those come from the reader's own list of files, less the ones
    that it has read.
    """
    files = (
        spark.read.format("binaryFile")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", str(recursive).lower())
        .load(path)
        .select("path", "length", F.col("content").alias("body"))
    )
    listed = spark.createDataFrame(pa.table({"path": pa.array(files.inputFiles(), pa.string())}))
    # The list has URIs, the rows have paths.
    decoded = F.url_decode(F.replace("path", F.lit("+"), F.lit("%2B")))
    names = listed.select(F.regexp_replace(decoded, "^([^:/]+):///", "$1:/").alias("path"))
    empty = names.join(files.select("path"), "path", "left_anti")
    return files.unionByName(empty.select("path", F.lit(0).cast("long").alias("length"), F.lit(b"").alias("body")))


def read_templates(spark: SparkSession, path: str, glob: str = "*.yaml") -> DataFrame:
    """Template tree as rows: path, severity, tags."""
    text = F.col("value")
    tag_line = F.regexp_extract(text, r"(?m)^\s*tags:[ \t]*(.*)$", 1)
    return (
        spark.read.format("text")
        .option("wholetext", "true")
        .option("pathGlobFilter", glob)
        .option("recursiveFileLookup", "true")
        .load(path)
        .select(
            F.col("_metadata.file_path").alias("path"),
            F.nullif(
                F.lower(F.regexp_extract(text, r"(?m)^\s*severity:[ \t]*([A-Za-z]+)", 1)), F.lit("")
            ).alias("severity"),
            F.filter(
                F.transform(F.split(tag_line, ","), lambda t: F.trim(t)), lambda t: t != ""
            ).alias("tags"),
        )
    )


def read_settings(spark: SparkSession, path: str) -> DataFrame:
    """KEY=value lines of settings files as rows: file, key, value."""
    pattern = r"^\s*([A-Za-z_][A-Za-z0-9_]*)=(.*)$"
    lines = spark.read.text(path).where(F.col("value").rlike(pattern))
    return lines.select(
        F.col("_metadata.file_path").alias("file"),
        F.regexp_extract("value", pattern, 1).alias("key"),
        F.regexp_extract("value", pattern, 2).alias("value"),
    )


def write_responses(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """Rows as JSON lines, null fields kept, one file per task."""
    df.write.mode(mode).option("ignoreNullFields", "false").json(path)


def write_table(df: DataFrame, path: str, by: list[str] | None = None, mode: str = "errorifexists") -> None:
    """Parquet, optionally in one folder per value of `by`."""
    writer = df.write.mode(mode)
    (writer.partitionBy(*by) if by else writer).parquet(path)


def write_log(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """The `line` of each row as text; see `exec_log_write`."""
    df.select("line").write.mode(mode).text(path)
