"""Run a streaming job over what is there now and read its result."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from auditloom.session import run_folder

PROVIDER = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
CHANGELOG = "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled"


def use_rocksdb(spark: SparkSession) -> None:
    """State on local disk with changes uploaded to the checkpoint per batch."""
    spark.conf.set(PROVIDER, ROCKSDB)
    spark.conf.set(CHANGELOG, "true")


def read_stream(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """Parquet files of `path` as a stream, with the schema of the files there."""
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    if max_files is not None:
        reader = reader.option("maxFilesPerTrigger", max_files)
    return reader.parquet(path)


def run_available(stream: DataFrame, name: str, folder: str | None = None) -> DataFrame:
    """Process all available input, then return the written result as a table.

    Result and checkpoint go to `folder`. A later call with the same folder goes
    on from the last batch of the one before; without a folder the run gets one of
    its own below the shared one and starts from nothing.
    """
    spark = stream.sparkSession
    use_rocksdb(spark)
    folder = folder or run_folder(spark, name)
    # A batch costs every partition of the state a worker and a commit, so there are no more of them than run at once. A checkpoint keeps its own number.
    width = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", min(int(width), max(2, spark.sparkContext.defaultParallelism)))
    writer = (
        stream.writeStream.format("parquet")
        .outputMode("append")
        .option("path", f"{folder}/out")
        .option("checkpointLocation", f"{folder}/checkpoint")
        .trigger(availableNow=True)
    )
    try:
        query = writer.start()  # takes its settings along
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", width)
    return spark.read.schema(stream.schema).parquet(f"{folder}/out")
