"""Merkle manifest of a table: a tree of digests per source, one over the sources, and a proof for every row.

1. One pass over the rows makes the leaves; texts go no further. A leaf's place is its rank in its source, counted over slices of
   a range partitioning, so a source may hold any share of the rows.
2. Places are cut into aligned chunks of up to FANOUT ** LEVELS leaves; no run of siblings crosses a border. In a chunk, level after level,
   window columns at the fixed offsets FANOUT ** level (lag and lead, once and twice) hold the siblings of a node, masked by its slot and
   the length of its run; the first child's row hashes the parent. All levels share one sort.
3. What remains of the chunks is a smaller table of nodes, treated alike until one node of each source remains.
   Sources are then the leaves of one more tree.
4. Downwards, lag columns at the same offsets hand a parent's siblings to its children, chunk by chunk; a proof is these texts in a row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.common import running_before
from auditloom.session import settle

FANOUT = 3
#: Levels of a chunk at most: 3 ** 7 = 2,187 rows, which a window holds in memory.
LEVELS = 7


def field(value: Column) -> Column:
    """A value as the manifest writes it: `-` if null, else bytes, colon, text."""
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def digest(*parts: Column) -> Column:
    """Lower-case hex SHA-256 of texts put together."""
    return F.sha2(F.concat(*parts).cast("binary"), 256)


def _nodes_at(level: int) -> Column:
    """Number of nodes of the row's tree at a level above its table."""
    return F.ceil(F.col("_n") / F.lit(FANOUT**level)).cast("long")


def _first_row(level: int) -> Column:
    """Whether a row is the first leaf below a node of the level."""
    return F.col("_pos") % FANOUT**level == 0


def _height(most: int) -> int:
    """Levels above `most` nodes, LEVELS at most and one at least."""
    return next((k for k in range(1, LEVELS) if FANOUT**k >= most), LEVELS)


def _in_chunk(nodes: DataFrame, group: str, levels: int) -> DataFrame:
    """Adds `_left<k>` and `_right<k>`, the siblings of the node at level k that starts at the row, and `_d<k>`, its digest."""
    here = Window.partitionBy(group, "_chunk").orderBy("_pos")
    rows = nodes.withColumn("_chunk", F.expr(f"_pos div {FANOUT**levels}")).withColumn("_d0", F.col("_d"))
    for level in range(levels):
        step, name = FANOUT**level, f"_d{level}"
        rows = rows.withColumns(
            {f"_by{k}": (F.lag if k < 0 else F.lead)(name, abs(k) * step).over(here) for k in (-2, -1, 1, 2)}
        )
        index = F.expr(f"_pos div {step}")
        slot = index % FANOUT
        run = F.least(F.lit(FANOUT), _nodes_at(level) - (index - slot))
        grows = _first_row(level) & (_nodes_at(level) > 1)

        def beside(k: int, inside: Column) -> Column:
            return F.when(inside, F.col(f"_by{k}")).otherwise("")

        rows = rows.withColumns(
            {
                f"_left{level}": F.when(grows, F.concat(beside(-2, slot >= 2), beside(-1, slot >= 1))),
                f"_right{level}": F.when(grows, F.concat(beside(1, slot + 1 < run), beside(2, slot + 2 < run))),
            }
        ).drop(*[f"_by{k}" for k in (-2, -1, 1, 2)])
        parent = F.when(~_first_row(level + 1), F.lit(None).cast("string")).when(
            _nodes_at(level) > 1, digest(F.col(name), F.col(f"_right{level}"))
        )
        rows = rows.withColumn(f"_d{level + 1}", parent.otherwise(F.col(name)))
    return rows


def _down_chunk(rows: DataFrame, group: str, levels: int) -> DataFrame:
    """Adds `_path`: `left.right/` for every level from the row's node up to the top of its chunk."""
    here = Window.partitionBy(group, "_chunk").orderBy("_pos")
    path = F.lit("")
    for level in range(levels - 1, -1, -1):
        step = FANOUT**level
        rows = rows.withColumn("_path", path)
        rows = rows.withColumns({f"_up{k}": F.lag("_path", k * step).over(here) for k in (1, 2)})
        slot = F.expr(f"_pos div {step}") % FANOUT
        above = F.when(slot == 0, F.col("_path")).when(slot == 1, F.col("_up1")).otherwise(F.col("_up2"))
        own = F.when(F.col(f"_left{level}").isNull(), F.lit("")).otherwise(
            F.concat(f"_left{level}", F.lit("."), f"_right{level}", F.lit("/"))
        )
        path = F.when(_first_row(level), F.concat(own, above))
        rows = rows.withColumn("_path", path).drop("_up1", "_up2", f"_left{level}", f"_right{level}")
        path = F.col("_path")
    return rows


def tree_paths(nodes: DataFrame, group: str, above_tops) -> DataFrame:
    """`nodes` with `path`, the siblings of each from its own level up, and the columns of its tree.

    `nodes` has `group` (not null), `_pos` from 0, `_n` (nodes of the group) and `_d`, and is read more than once, so hand in a settled table.
    `above_tops` takes the tops (`group`, `_d`) and returns `group`, the `path` above a top and any other columns, one row per group.
    """
    tables, heights = [nodes], []
    while not heights or most > 1:
        most = tables[-1].agg(F.max("_n")).first()[0] or 0
        levels = _height(most)
        heads = _in_chunk(tables[-1], group, levels).where(F.col("_pos") % FANOUT**levels == 0).select(
            group, F.col("_chunk").alias("_pos"), _nodes_at(levels).alias("_n"), F.col(f"_d{levels}").alias("_d")
        )
        tables.append(settle(heads))
        heights.append(levels)
        most = -(-most // FANOUT**levels)
    # Written down, so that the chunk is a column like any other and rows are dealt by it.
    upper = settle(above_tops(tables[-1].select(group, "_d")).withColumn("_chunk", F.lit(0).cast("long")))
    for table, levels in zip(tables[-2::-1], heights[::-1]):
        above = upper.withColumnRenamed("path", "_above").hint("merge")
        joined = _down_chunk(_in_chunk(table, group, levels), group, levels).join(above, [group, "_chunk"])
        extra = [c for c in above.columns if c not in (group, "_chunk", "_above")]
        paths = joined.select(*table.columns, F.concat("_path", "_above").alias("path"), *extra)
        upper = paths.drop("_n", "_d").withColumnRenamed("_pos", "_chunk")
    return paths


def _ranked(rows: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Settled rows with `_pos`, the rank from 0 in the group, and `_n`, its rows."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cut = settle(rows.repartitionByRange(parts, group, *order).withColumn("_slice", F.spark_partition_id()))
    placed = running_before(cut, [group], F.col("_slice"), [F.col(c) for c in order], {"_pos": F.lit(1)}).drop("_slice")
    sizes = cut.groupBy(group).agg(F.count(F.lit(1)).alias("_n"))
    return settle(placed.join(sizes, group))


def folded(path: Column, leaf: Column) -> Column:
    """The root that a leaf and the siblings of a path give."""
    steps = F.filter(F.split(path, "/"), lambda s: s != "")
    return F.aggregate(
        steps, leaf, lambda acc, s: digest(F.substring_index(s, ".", 1), acc, F.substring_index(s, ".", -1))
    )


def merkle_manifest(
    docs: DataFrame,
    changed: Column | None = None,
    id_col: str = "doc_id",
    source_col: str = "source",
    columns: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    text_col: str = "text",
) -> DataFrame:
    """Leaf, subroot, root and proof of every row, and the root that its proof gives.

    A leaf is the digest of `columns` (`field`). `changed` is the text, as it is found later, that a row is checked with;
    without it, the text itself. Returns `id_col`, `leaf`, `subroot`, `root`, `proof_sha256`, `folded_root` and `verified`.

    Leaves of a source (null is a source, before all others) ascend by id, rows without one first, and rows that share an id by leaf;
    rows that agree in all columns follow each other, and each has its own place and proof. A blank text and a null one differ.
    A source of one row has its leaf for a subroot, and one source its subroot for the root. Without rows there is no root and no row.
    """

    def leaf_of(text: Column) -> Column:
        return digest(*[field(text if c == text_col else F.col(c)) for c in columns])

    rows = docs.select(
        F.coalesce(F.concat(F.lit("="), F.col(source_col).cast("string")), F.lit("")).alias("_group"),
        F.col(id_col).alias("_id"),
        leaf_of(F.col(text_col)).alias("_d"),
        leaf_of(F.col(text_col) if changed is None else changed).alias("_found"),
        F.monotonically_increasing_id().alias("_row"),
    )
    # Written first: the range partitioning reads what it deals out twice, and that must not be the texts.
    leaves = _ranked(settle(rows), "_group", ["_id", "_d", "_row"]).drop("_row")

    def over_sources(tops: DataFrame) -> DataFrame:
        sources = _ranked(tops.select(F.lit(0).alias("_all"), F.col("_group").alias("_source"), "_d"), "_all", ["_source"])
        paths = tree_paths(sources, "_all", lambda top: top.select("_all", F.lit("").alias("path"), F.col("_d").alias("root")))
        return paths.select(F.col("_source").alias("_group"), "path", F.col("_d").alias("subroot"), "root")

    joined = tree_paths(leaves, "_group", over_sources)
    path = F.col("path")
    proof = F.sha2(F.translate(path, "./", "").cast("binary"), 256)
    checked = joined.select(
        F.col("_id").alias(id_col), F.col("_d").alias("leaf"), "subroot", "root", proof.alias("proof_sha256"),
        folded(path, F.col("_found")).alias("folded_root"),
    )
    return checked.withColumn("verified", F.col("folded_root") == F.col("root"))
