"""Exact duplicates by a persistent digest index, bucketed and sorted by digest.

The index is a table with one row per distinct normalised text: `digest` (SHA-256
as 32 bytes), `keep_id` and the `batch` that brought it. A new batch is reduced to
one row per digest, checked against the index by a sort-merge anti-join that
leaves the index where it is, and its unseen digests are appended.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from auditloom.llm.common import SPACE_CLASS, fresh
from auditloom.session import run_folder, settle

INDEX_SCHEMA = "digest BINARY, keep_id {id_type}, batch INT"


def normalised(text: Column) -> Column:
    """Each run of ASCII white space as one space; null counts as empty."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), f"{SPACE_CLASS}+", " ")


def text_digest(text: Column) -> Column:
    """SHA-256 of the normalised text in UTF-8, 32 bytes."""
    return F.unhex(F.sha2(F.encode(normalised(text), "UTF-8"), 256))


class DigestIndex:
    """A digest index on disk.

    `path` is a folder all executors share; `buckets` should give each bucket some
    hundred MB at the size the index will reach. An index lives on with its
    folder: open it again with the same name, path and number of buckets.
    """

    def __init__(
        self, spark: SparkSession, name: str, path: str, buckets: int = 64, id_type: str = "BIGINT"
    ):
        self.spark, self.name, self.buckets = spark, name, buckets
        if not spark.catalog.tableExists(name):
            spark.sql(
                f"CREATE TABLE {name} ({INDEX_SCHEMA.format(id_type=id_type)}) USING parquet "
                f"CLUSTERED BY (digest) SORTED BY (digest) INTO {buckets} BUCKETS LOCATION '{path}'"
            )

    def rows(self) -> DataFrame:
        return self.spark.table(self.name)

    def next_batch(self) -> int:
        last = self.rows().agg(F.max("batch")).first()[0]
        return 0 if last is None else last + 1

    def drop(self) -> None:
        """Forget the table; its files stay with their folder."""
        self.spark.sql(f"DROP TABLE {self.name}")

    def add(self, digests: DataFrame, batch: int, id_col: str = "doc_id") -> None:
        """Append the digests of a batch that the index lacks, each with its smallest id."""
        firsts = digests.groupBy("digest").agg(F.min(id_col).alias("keep_id"))
        unseen = firsts.hint("merge").join(self.rows().hint("merge"), "digest", "left_anti")
        (
            unseen.select("digest", "keep_id", F.lit(batch).alias("batch"))
            # Dealt by the bucket number, so that each bucket is one file of one task.
            .repartition(self.buckets, F.pmod(F.hash("digest"), F.lit(self.buckets)))
            .write.mode("append")
            .format("parquet")
            .bucketBy(self.buckets, "digest")
            .sortBy("digest")
            .saveAsTable(self.name)
        )

    def resolve(self, digests: DataFrame) -> DataFrame:
        """`digests` with `keep_id` of their text and `group_size`, the number of rows here that share it.

        Rows are counted per digest before the index is met, so the index join
        sees every digest once; a text that holds a large share of all rows is split by
        the adaptive skew join of the last step.
        """
        counted = digests.groupBy("digest").agg(F.count(F.lit(1)).alias("group_size"))
        groups = settle(self.rows().select("digest", "keep_id").join(counted, "digest"))
        return digests.join(groups.hint("merge"), "digest")


def id_batches(digests: DataFrame, id_col: str, batches: int) -> list[DataFrame]:
    """Cut rows into batches of rising ids; rows without an id come last."""
    ends = digests.agg(F.min(id_col).cast("long").alias("lo"), F.max(id_col).cast("long").alias("hi")).first()
    if ends.lo is None:
        return [digests]
    width = max(1, -(-(ends.hi - ends.lo + 1) // batches))
    count = -(-(ends.hi - ends.lo + 1) // width)
    number = F.coalesce(F.expr(f"(`{id_col}` - {ends.lo}) div {width}"), F.lit(count - 1))
    return [digests.where(number == n) for n in range(count)]


def exact_dedup_labels(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    batches: int = 2,
    buckets: int = 64,
    index: DigestIndex | None = None,
) -> DataFrame:
    """One row per document: id, `digest`, `keep_id`, `group_size`, `kept`.

    The texts are read once, for their digests; batches of rising ids then go
    through one `DigestIndex`, so the smallest id of equal texts stays. With an `index` of
    earlier documents a text it knows keeps its id from there, and the new texts stay in it; without
    one the index is made for this call. A null text
    counts as empty, empty texts equal each other, and texts of any length are
    digested whole. A null id loses to any id; a text with null ids only has a
    null `keep_id`, and its rows are all kept, since no id tells them apart. Rows
    that repeat both id and text get the same labels and count one each in
    `group_size`. An empty table gives no rows; other columns are not read.
    """
    spark = docs.sparkSession
    digests = settle(docs.select(F.col(id_col), text_digest(F.col(text_col)).alias("digest")))
    own = index is None
    if own:
        folder = f"{run_folder(spark, 'digest-index')}/rows"
        id_type = digests.schema[id_col].dataType.simpleString()
        index = DigestIndex(spark, f"digest_index_{uuid.uuid4().hex}", folder, buckets, id_type)
    first = index.next_batch()
    for number, batch in enumerate(id_batches(digests, id_col, batches), first):
        index.add(batch, number, id_col)
    labels = index.resolve(digests)
    if own:
        index.drop()
    return labels.withColumn("kept", F.col(id_col).eqNullSafe(F.col("keep_id")))


def drop_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", index: DigestIndex | None = None
) -> DataFrame:
    """`docs`, all columns, with one row of each group of equal texts.

    Follows `exact_dedup_labels`; of rows that tie in both id and text one stays,
    chosen by the hash of the whole row. One shuffle of the texts, of kept rows with a
    duplicate only on the narrow side.
    """
    labels = exact_dedup_labels(docs, id_col, text_col, index=index)
    keep = labels.where("kept").select(F.col("digest").alias("k_digest"), F.col(id_col).alias("k_id")).distinct()
    digest, rank = fresh(docs, "digest"), fresh(docs, "digest_rank")
    same_row = Window.partitionBy(digest, id_col).orderBy(F.xxhash64(*docs.columns))
    return (
        docs.withColumn(digest, text_digest(F.col(text_col)))
        .join(
            keep.hint("merge"),
            (F.col(digest) == F.col("k_digest")) & F.col(id_col).eqNullSafe(F.col("k_id")),
            "left_semi",
        )
        .withColumn(rank, F.row_number().over(same_row))
        .where(F.col(rank) == 1)
        .select(*docs.columns)
    )
