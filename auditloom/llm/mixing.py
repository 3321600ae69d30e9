"""Mix sources to target weights by a splitting tree over block quotas.

All steps are DataFrame operations. Each source's documents, in seeded order and
repeated for further epochs, are cut into blocks of about `block_words` words. The blocks a
source owes to the mix are its quota. A tree splits all quotas among the
output shards: each node shuffles its urn of blocks and halves it, a draw
from the multivariate hypergeometric distribution, so the quotas of the shards add up exactly
and no block is drawn twice. Each shard then takes its quota from the source's permuted
blocks and shuffles what it got by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import fresh, key_slice, running_before, seeded_key, slice_count, word_count
from auditloom.session import settle

# Weights of the sources in their order, repeating.
WEIGHTS = (5, 2, 1)
SHARE = 1.5
MAX_EPOCHS = 2
#: Rounds that fill the gap to a target.
FILLS = 3


def source_targets(units: DataFrame, source_col: str, share: float = SHARE, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """One row per source: source, `source_size`, `weight`, `target`.

    Sources by code point, null last, weigh WEIGHTS in turn. Targets are in
    proportion to the weights and stop at `max_epochs` times the source's size;
    what is cut off is shared again by weight until no target is above. That is
    least(max_epochs * size, level * weight) with one level for all: with the sources
    sorted by the level at which they fill up, the level is the largest of
    (budget - capacity of the first k) / weight of the others.
    """
    sums = units.groupBy(source_col).agg(F.sum("unit_words").alias("source_size"))
    by_name = Window.partitionBy(F.lit(0)).orderBy(F.col(source_col).asc_nulls_last())
    turn = (F.row_number().over(by_name) - 1) % len(WEIGHTS)
    weight = F.element_at(F.array(*[F.lit(w).cast("long") for w in WEIGHTS]), turn + 1)
    weighed = sums.withColumn("weight", weight).withColumn("room", F.col("source_size") * max_epochs)
    by_fill = (
        Window.partitionBy(F.lit(0))
        .orderBy(F.col("room") / F.col("weight"), F.col(source_col).asc_nulls_last())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    whole = Window.partitionBy(F.lit(0))
    left = weighed.withColumns(
        {
            "budget": F.lit(share) * F.sum("source_size").over(whole),
            "filled": F.coalesce(F.sum("room").over(by_fill), F.lit(0)),
            "weight_left": F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(by_fill), F.lit(0)),
        }
    )
    level = F.max((F.col("budget") - F.col("filled")) / F.col("weight_left")).over(whole)
    target = F.least(F.col("room").cast("double"), level * F.col("weight"))
    return left.select(source_col, "source_size", "weight", target.alias("target"))


def tree_shard(drawn: Column, n_blocks: Column, shards: int) -> Column:
    """The leaf of a block drawn at place `drawn` of `n_blocks`.

    All levels of the tree follow from one shuffle of the urn: a node holds a stretch of
    the shuffled blocks and hands one half to each child. Given which blocks are in a stretch,
    their order is still uniform, so each halving is a multivariate hypergeometric draw.
    Node k of the level with m nodes holds the places with place * m div n_blocks = k.
    """
    return F.floor(drawn * shards / n_blocks).cast("int")


def split_quotas(blocks: DataFrame, source_col: str, shards: int) -> DataFrame:
    """(source, shard, quota): exact block quotas of the leaves of the splitting tree over all blocks."""
    drawn = running_before(
        blocks,
        [],
        key_slice(F.col("urn_key"), slice_count(blocks.sparkSession)),
        [F.col("urn_key"), F.col(source_col), F.col("epoch"), F.col("block")],
        {"drawn": F.lit(1)},
    )
    n_blocks = F.lit(max(blocks.count(), 1))
    leaves = drawn.withColumn("shard", tree_shard(F.col("drawn"), n_blocks, shards))
    return leaves.groupBy(source_col, "shard").agg(F.count(F.lit(1)).alias("quota"))


def draw_blocks(blocks: DataFrame, quotas: DataFrame, source_col: str) -> DataFrame:
    """(source, epoch, block, shard): shards take consecutive runs of the permuted blocks, quota by quota."""
    permuted = running_before(
        blocks,
        [source_col],
        key_slice(F.col("permute_key"), slice_count(blocks.sparkSession)),
        [F.col("permute_key"), F.col("epoch"), F.col("block")],
        {"place": F.lit(1)},
    )
    before = Window.partitionBy(source_col).orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum("quota").over(before), F.lit(0))
    places = quotas.withColumn("start", start).select(
        F.col(source_col).alias("q_source"),
        "shard",
        F.explode(F.sequence(F.col("start"), F.col("start") + F.col("quota") - 1)).alias("q_place"),
    )
    same = F.col(source_col).eqNullSafe(F.col("q_source")) & (F.col("place") == F.col("q_place"))
    return permuted.join(places, same).select(source_col, "epoch", "block", "shard")


def document_units(docs: DataFrame, id_col: str, text_col: str, source_col: str, size: Column, seed: str) -> DataFrame:
    """One row per (id, text, source): `text_hash`, `size`, `n_rows`, `unit_words`, `mix_key`; settled, read from the texts once."""
    narrow = docs.select(
        F.col(id_col), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(source_col), size.alias("size")
    )
    units = narrow.groupBy(id_col, "text_hash", source_col, "size").agg(F.count(F.lit(1)).alias("n_rows"))
    return settle(
        units.withColumns(
            {
                "unit_words": F.col("size") * F.col("n_rows"),
                "mix_key": seeded_key(seed, F.col(source_col), F.col(id_col)),
            }
        )
    )


def taken_epochs(units: DataFrame, id_col: str, source_col: str, max_epochs: int) -> DataFrame:
    """Units with the `epoch` they are taken in: documents in seeded order up to the target, then smaller ones for what is missing.

    A document is taken where it ends at or before the target. What is then missing, less than the next document, is
    filled FILLS times over from the rest of that epoch: documents no longer than the gap, in seeded order, as far as they fit.
    """
    epochs = units.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(max_epochs - 1)))).withColumn(
        "ends", F.col("epoch") * F.col("source_size") + F.col("words_before") + F.col("unit_words")
    )
    fits = F.col("ends") <= F.col("target")
    got = F.coalesce(F.sum(F.when(fits, F.col("unit_words"))), F.lit(0))
    gaps = epochs.groupBy(F.col(source_col).alias("g_source")).agg((F.max("target") - got).alias("gap"))
    last = F.col("epoch") == F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0)))
    taken = epochs.where(fits)
    rest = epochs.where(~fits & last & (F.col("unit_words") > 0))
    for _ in range(FILLS):
        spare = rest.join(gaps, F.col(source_col).eqNullSafe(F.col("g_source"))).where(F.col("unit_words") <= F.col("gap"))
        order = [F.col("mix_key"), F.col(id_col), F.col("text_hash"), F.col("size")]
        slices = key_slice(F.col("mix_key"), slice_count(units.sparkSession))
        summed = running_before(
            settle(spare.drop("g_source")), [source_col], slices, order, {"spare_before": F.col("unit_words")}
        )
        filling = settle(summed.withColumn("filling", F.col("spare_before") + F.col("unit_words") <= F.col("gap")))
        taken = taken.unionByName(filling.where("filling").select(*epochs.columns))
        rest = filling.where("NOT filling").select(*epochs.columns)
        got = F.coalesce(F.sum(F.when(F.col("filling"), F.col("unit_words"))), F.lit(0))
        gaps = filling.groupBy(F.col(source_col).alias("g_source")).agg((F.max("gap") - got).alias("gap"))
    return taken


def mix_draws(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    size: Column | None = None,
    share: float = SHARE,
    max_epochs: int = MAX_EPOCHS,
    block_words: int = 20_000,
    shards: int = 8,
    seed: str = "mix",
) -> tuple[DataFrame, DataFrame]:
    """The mix as (units, draws).

    units: one row per document with `source_size`, `target`, `n_rows`.
    draws: one row per document and epoch it is taken in, with `block`, `shard` and
    `local_key`, the seeded order inside the shard.

    An epoch of a source is its documents in seeded order. The mix takes whole epochs
    while the target covers them and of the next epoch what `taken_epochs` says: never more than the target, and
    less by a small part of a document where the source has small ones. The size
    is the number of words (null text: 0); a document without words is taken in every epoch
    that reaches its place. A null source is a source of its own, with the last weight. Rows that repeat id, text and source
    are one unit: they are drawn together and each counts its words. Ids that
    repeat with different texts, and null ids, are told apart by the text. An empty
    table, or one without words, gives targets of 0. Other columns are not read.
    """
    if size is None:
        size = word_count(F.col(text_col))
    spark = docs.sparkSession
    units = document_units(docs, id_col, text_col, source_col, size, seed)
    targets = source_targets(units, source_col, share, max_epochs).withColumnRenamed(source_col, "t_source")
    ordered = running_before(
        units,
        [source_col],
        key_slice(F.col("mix_key"), slice_count(spark)),
        [F.col("mix_key"), F.col(id_col), F.col("text_hash"), F.col("size")],
        {"words_before": F.col("unit_words")},
    )
    units = settle(ordered.join(targets, F.col(source_col).eqNullSafe(F.col("t_source"))).drop("t_source"))
    taken = taken_epochs(units, id_col, source_col, max_epochs).withColumn(
        "block", F.floor(F.col("words_before") / F.lit(block_words))
    )
    taken = settle(taken.select(id_col, "text_hash", source_col, "epoch", "block"))
    block = [F.col(source_col), F.col("epoch"), F.col("block")]
    blocks = settle(
        taken.select(*block)
        .distinct()
        .withColumns(
            {"urn_key": seeded_key(f"{seed}:urn", *block), "permute_key": seeded_key(f"{seed}:permute", *block)}
        )
    )
    drawn = draw_blocks(blocks, split_quotas(blocks, source_col, shards), source_col).select(
        F.col(source_col).alias("d_source"), F.col("epoch").alias("d_epoch"), F.col("block").alias("d_block"), "shard"
    )
    draws = taken.join(
        drawn,
        F.col(source_col).eqNullSafe(F.col("d_source"))
        & (F.col("epoch") == F.col("d_epoch"))
        & (F.col("block") == F.col("d_block")),
    ).drop("d_source", "d_epoch", "d_block")
    local = seeded_key(f"{seed}:local", F.col("shard"), F.col(id_col), F.col("text_hash"), F.col("epoch"))
    return units, draws.withColumn("local_key", local)


def mix_totals(docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", **options) -> DataFrame:
    """One row per row of `docs`: id, `size`, `source_size`, `target`, `taken` words, from `mix_draws`."""
    units, draws = mix_draws(docs, id_col, source_col=source_col, **options)
    times = draws.groupBy(
        F.col(id_col).alias("d_id"), F.col("text_hash").alias("d_hash"), F.col(source_col).alias("d_source")
    ).agg(F.count(F.lit(1)).alias("times"))
    same = (
        F.col(id_col).eqNullSafe(F.col("d_id"))
        & (F.col("text_hash") == F.col("d_hash"))
        & F.col(source_col).eqNullSafe(F.col("d_source"))
    )
    return (
        units.join(times, same, "left")
        .withColumn("taken", F.col("size") * F.coalesce(F.col("times"), F.lit(0)))
        .withColumn("repeat", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n_rows"))))
        .select(id_col, "size", "source_size", "target", "taken")
    )


def mix_documents(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options
) -> DataFrame:
    """The mix itself: `docs`, all columns, each document as often as it was drawn, ordered inside its shard's part.

    The rows of a shard are dealt by the leading digits of their local key, then sorted,
    so a large shard is not one task. The texts are shuffled twice.
    """
    _, draws = mix_draws(docs, id_col, text_col, source_col, **options)
    text_hash = fresh(docs, "text_hash")
    drawn = draws.select(
        F.col(id_col).alias("mix_id"),
        F.col("text_hash").alias("mix_hash"),
        F.col(source_col).alias("mix_source"),
        F.col("shard").alias("mix_shard"),
        F.col("local_key").alias("mix_local"),
    )
    return (
        docs.withColumn(text_hash, F.xxhash64(F.col(text_col)))
        .join(
            drawn,
            F.col(id_col).eqNullSafe(F.col("mix_id"))
            & (F.col(text_hash) == F.col("mix_hash"))
            & F.col(source_col).eqNullSafe(F.col("mix_source")),
        )
        .repartition("mix_shard", F.substring("mix_local", 1, 2))
        .sortWithinPartitions("mix_shard", "mix_local")
        .select(*docs.columns)
    )
