"""Near duplicates by an LSH forest over minhash signatures, confirmed on the full shingle sets.

1. One pass over the texts: shingle set, its fingerprint, a minhash signature and one key per tree,
   the hash of the first values of the tree's order (`forest_shape`: 4 values and 16 trees at 0.85, 22 at 0.80). Equal sets become one node.
2. Forest: the nodes of a tree that share a key are a region, sorted by the tree's
   signature order, so those with the longest common prefix are neighbours. Where a region is
   larger than REGION, neighbours within REGION are compared first; a hot region is also cut by deeper
   keys before it is dealt out. If that leaves a region in more than one family, all its nodes of
   different families are compared, in pairs of blocks of BLOCK_NODES.
   Signature estimates well below the threshold already make two nodes relatives.
3. Families are the connected components of relatives. Their full sets are brought together
   once and all links inside a family are decided exactly, large families in pairs of
   blocks. Only spanning edges leave a task, never the pairs.
4. Connected components of the confirmed links are the groups.

A link is missed only if no tree puts both ends in one region, at the threshold with
probability (1 - 0.85^4)^16 or (1 - 0.80^4)^22, less than MISS, or if its estimate is SLACK deviations too low, less than 4e-6.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from auditloom.llm.common import fresh, key_slice, lean, running_before, seeded_key, slice_count
from auditloom.llm.components import connected_components
from auditloom.llm.shingles import WordHashes, fingerprint, mixed, shingle_set
from auditloom.session import settle

TREES, DEPTH, SLOTS = 16, 4, 128
#: Probability with which the trees may miss a pair at the threshold; `forest_shape` adds trees for it.
MISS = 1e-5
REGION = 1024
HOT_REGION = 50_000
BLOCK_NODES = 8192
BLOCK_SHINGLES = 200_000
SHORT_SHINGLES = 150
COLUMNS_AT_ONCE = 2048
#: Standard deviations that an estimate may fall below the threshold and still count as a relative.
SLACK = 4.5
NO_ID = 2**62

_multipliers = np.random.default_rng(20_240).integers(1, 2**63, SLOTS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def words_of(text: str | None) -> list[bytes]:
    """Words of a text, A-Z lowered."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def signature(shingles: np.ndarray) -> np.ndarray:
    """SLOTS minima of 32-bit hashes of the shingles."""
    lows = np.full(SLOTS, 2**32 - 1, np.uint64)
    for at in range(0, len(shingles), 1 << 16):
        part = shingles[at : at + (1 << 16)]
        for slot in range(SLOTS):
            low = (part * _multipliers[slot]).min() >> np.uint64(32)
            if low < lows[slot]:
                lows[slot] = low
    return lows


def forest_shape(percent: int) -> tuple[int, int]:
    """(trees, depth): TREES trees of DEPTH values, or what more trees or less depth a miss below MISS takes at `percent`."""
    for depth in range(DEPTH, 0, -1):
        apart = 1 - (percent / 100) ** depth
        trees = max(TREES, int(np.ceil(np.log(MISS) / np.log(apart)))) if 0 < apart < 1 else TREES
        if trees * depth <= SLOTS:
            return trees, depth
    return SLOTS, 1


def tree_keys(lows: np.ndarray, trees: int, depth: int) -> np.ndarray:
    """Per tree, a hash of the first `depth` values of its order and its number."""
    step = SLOTS // trees
    keys = np.arange(1, trees + 1, dtype=np.uint64)
    for j in range(depth):
        keys = mixed(keys * np.uint64(0x9E3779B97F4A7C15) + lows[np.arange(trees) * step + j])
    return keys.view(np.int64)


def sketch(docs: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int) -> DataFrame:
    """Settled: `doc_id`, `text_hash`, `n_shingles`, `set_id`, `sig` (low bytes of the signature), `keys`."""
    fields = T.StructType(
        [
            T.StructField("doc_id", T.LongType()),
            T.StructField("text_hash", T.LongType()),
            *T.StructType.fromDDL("n_shingles bigint, set_id binary, sig binary, keys array<bigint>").fields,
        ]
    )

    trees, depth = forest_shape(percent)

    def make(batches):
        hashes = WordHashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                sizes, ids, sigs, keys = [], [], [], []
                for text in part.column("text"):
                    found = shingle_set(hashes.of(words_of(text.as_py())), shingle_words)
                    sizes.append(len(found))
                    if len(found) == 0:
                        ids.append(None), sigs.append(None), keys.append(None)
                        continue
                    lows = signature(found)
                    ids.append(fingerprint(found))
                    sigs.append((lows & np.uint64(255)).astype(np.uint8).tobytes())
                    keys.append(tree_keys(lows, trees, depth))
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"), part.column("text_hash"), pa.array(sizes, pa.int64()),
                        pa.array(ids, pa.binary()), pa.array(sigs, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=fields.fieldNames(),
                )

    rows = docs.select(
        F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(F.col(text_col)).alias("text_hash"), F.col(text_col).alias("text")
    )
    return settle(rows.mapInArrow(lean(make), fields))


def least_agreeing(threshold: float) -> int:
    """Number of equal signature values from which two nodes are relatives."""
    spread = np.sqrt(threshold * (1 - threshold) / SLOTS)
    return int(np.floor(SLOTS * (threshold - SLACK * spread)))


def region_members(nodes: DataFrame) -> DataFrame:
    """Settled: one row per node and tree of the nodes that share a key, with its region's size `n` and lowest node `low`."""
    entries = nodes.select("node", F.posexplode("keys").alias("tree", "key"))
    sizes = entries.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("low")).where("n > 1")
    shared = settle(sizes.select(F.col("key").alias("s_key"), "n", "low"))
    return settle(entries.join(shared, F.col("key") == F.col("s_key")).select("node", "tree", "key", "n", "low"))


def relatives(nodes: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """Spanning edges (u, v) of nodes whose signatures agree well enough, of neighbours in the regions of the forest."""
    signed = members.join(nodes.select(F.col("node").alias("s_node"), "sig"), F.col("node") == F.col("s_node"))
    trees, depth = forest_shape(percent)
    step = SLOTS // trees
    start = F.col("tree") * step
    order = F.concat(F.substring("sig", start + 1, F.lit(SLOTS)), F.substring("sig", F.lit(1), start))
    # Regions beyond HOT_REGION are cut by the next `depth` and 2 * `depth` values of the tree's order.
    deeper = F.when(F.col("n") <= HOT_REGION, F.lit(0)).otherwise(
        F.xxhash64(
            F.substring("in_order", F.lit(1), F.when(F.col("n") <= HOT_REGION * 16, 2 * depth).otherwise(4 * depth))
        )
    )
    dealt = (
        signed.withColumn("in_order", order)
        .withColumn("cut", deeper)
        .repartition("key", "cut")
        .sortWithinPartitions("key", "cut", "in_order", "node")
        .select("key", "cut", "node", "in_order", "low")
    )
    least = least_agreeing(percent / 100)

    def link(batches):
        held: list[tuple] = []  # of the region at hand: (nodes, signatures)
        at, n_held, last = None, 0, None

        def close(final):
            """Edges of what is held; a part of a longer region keeps a foot in the next part."""
            nonlocal held, n_held
            ids = np.concatenate([h[0] for h in held])
            sigs = np.concatenate([h[1] for h in held])
            held, n_held = ([], 0) if final else ([(ids[-1:], sigs[-1:])], 1)
            return spanning(ids, sigs, least)

        for batch in batches:
            keys = batch.column("key").to_numpy()
            cuts = batch.column("cut").to_numpy()
            ids, lows = batch.column("node").to_numpy(), batch.column("low").to_numpy()
            sigs = np.frombuffer(b"".join(batch.column("in_order").to_pylist()), np.uint8).reshape(-1, SLOTS)
            borders = np.flatnonzero((keys[1:] != keys[:-1]) | (cuts[1:] != cuts[:-1])) + 1
            edges = []
            for lo, hi in zip([0, *borders], [*borders, len(keys)]):
                if (keys[lo], cuts[lo]) != at:
                    if n_held > 1:
                        edges.append(close(True))
                    held, n_held, at = [], 0, (keys[lo], cuts[lo])
                    if cuts[lo]:  # a foot of each part of a hot region
                        edges.append(np.array([[ids[lo], lows[lo]]]))
                while lo < hi:
                    take = min(hi - lo, REGION - n_held)
                    held.append((ids[lo : lo + take], sigs[lo : lo + take]))
                    n_held, lo = n_held + take, lo + take
                    if n_held == REGION:
                        # Joins most dense regions to one family, whose exact check decides; `across_windows` sees to the others.
                        part = np.concatenate([h[0] for h in held])
                        edges.append(np.stack([part[:1], part[-1:]], 1))
                        edges.append(close(False))
            if edges:
                found = np.concatenate(edges)
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])
        if n_held > 1:
            found = close(True)
            if len(found):
                yield pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"])

    return dealt.mapInArrow(lean(link), "u bigint, v bigint")


def across_windows(nodes: DataFrame, members: DataFrame, families: DataFrame, percent: int) -> DataFrame | None:
    """Edges (u, v) between families with relatives in one region larger than REGION; None if each is one family.

    All nodes of different families are compared, so this is exact on the signatures: a region is dealt
    into blocks of about BLOCK_NODES, and a task holds one block or two. The work is quadratic
    in the size of a region that is not one family, and nothing for the others.
    """
    wide = members.where(F.col("n") > REGION)
    rooted = wide.join(families.select(F.col("node").alias("f_node"), "root"), F.col("node") == F.col("f_node"), "left")
    rooted = settle(rooted.select("key", "node", "n", F.coalesce("root", "node").alias("root")))
    split = rooted.groupBy(F.col("key").alias("o_key")).agg(F.min("root").alias("one"), F.max("root").alias("other"))
    split = settle(split.where("one <> other").select("o_key"))
    if split.isEmpty():
        return None
    parts = F.ceil(F.col("n") / BLOCK_NODES)
    blocked = (
        rooted.join(split, F.col("key") == F.col("o_key"))
        .join(nodes.select(F.col("node").alias("s_node"), "sig"), F.col("node") == F.col("s_node"))
        .select("key", "root", "sig", (parts - 1).alias("last"), F.pmod(F.xxhash64("node"), parts).alias("block"))
    )
    pairs = F.expr("transform(sequence(0L, last), b -> struct(least(b, block) AS one, greatest(b, block) AS two))")
    dealt = (
        blocked.withColumn("pair", F.explode(pairs))
        .select("key", "pair.one", "pair.two", "block", "root", "sig")
        .repartition("key", "one", "two")
        .sortWithinPartitions("key", "one", "two")
    )
    least = least_agreeing(percent / 100)

    def link(batches):
        at, held = None, []  # of the pair of blocks at hand: (roots, which block, signatures)

        def close():
            roots, blocks, sigs = (np.concatenate(part) for part in zip(*held))
            edges = crossing(roots, blocks == at[1], sigs, least, at[1] != at[2])
            return pa.RecordBatch.from_arrays([pa.array(edges[:, 0]), pa.array(edges[:, 1])], names=["u", "v"])

        for batch in batches:
            key, one, two, block, root = (batch.column(c).to_numpy() for c in ("key", "one", "two", "block", "root"))
            sigs = np.frombuffer(b"".join(batch.column("sig").to_pylist()), np.uint8).reshape(-1, SLOTS)
            borders = np.flatnonzero((key[1:] != key[:-1]) | (one[1:] != one[:-1]) | (two[1:] != two[:-1])) + 1
            for lo, hi in zip([0, *borders], [*borders, len(key)]):
                if (key[lo], one[lo], two[lo]) != at:
                    if held:
                        yield close()
                    at, held = (key[lo], one[lo], two[lo]), []
                held.append((root[lo:hi], block[lo:hi], sigs[lo:hi]))
        if held:
            yield close()

    return dealt.mapInArrow(lean(link), "u bigint, v bigint")


def agreeing(some: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Number of equal values of each of `some` and each of `others`; both hold a signature per column."""
    found = np.zeros((some.shape[1], others.shape[1]), np.uint8)
    for slot in range(SLOTS):
        found += some[slot][:, None] == others[slot]
    return found


def crossing(roots: np.ndarray, first: np.ndarray, sigs: np.ndarray, least: int, across: bool) -> np.ndarray:
    """Edges (u, v) that join the roots of rows of different families that agree in at least `least` places.

    `across`: only rows of the first block and rows of the other one are compared.
    """
    by_root = np.argsort(roots, kind="stable")
    roots, first, sigs = roots[by_root], first[by_root], np.ascontiguousarray(sigs[by_root].T)
    left = np.flatnonzero(first)
    joined = {int(r): int(r) for r in np.unique(roots)}

    def find(r):
        while joined[r] != r:
            joined[r] = r = joined[joined[r]]
        return r

    edges = []
    for lo in range(0, len(left), 64):
        rows = left[lo : lo + 64]
        # Rows of one family lie side by side; those behind `rows` are compared when it is their turn.
        rest = np.flatnonzero(~first) if across else np.arange(rows[0], len(roots))
        if rows[0] != rows[-1] and roots[rows[0]] == roots[rows[-1]] or len(rows) == 1:
            rest = rest[roots[rest] != roots[rows[0]]]
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            near = agreeing(sigs[:, rows], sigs[:, part]) >= least
            near &= roots[rows][:, None] != roots[part]
            a, b = np.nonzero(near)
            if len(a):
                for u, v in np.unique(np.stack([roots[rows[a]], roots[part[b]]], 1), axis=0).tolist():
                    if (x := find(u)) != (y := find(v)):
                        joined[max(x, y)] = min(x, y)
                        edges.append((u, v))
    return np.array(edges, np.int64).reshape(-1, 2)


def spanning(ids: np.ndarray, sigs: np.ndarray, least: int) -> np.ndarray:
    """Star edges (node, hub) of the components of rows that agree in at least `least` places."""
    n = len(ids)
    if n == 2:
        near = int((sigs[0] == sigs[1]).sum()) >= least
        return np.array([[ids[1], ids[0]]] if near else [], np.int64).reshape(-1, 2)
    return stars(ids, lambda rows, rest: (sigs[rows][:, None, :] == sigs[rest][None, :, :]).sum(2) >= least)


def stars(ids: np.ndarray, linked) -> np.ndarray:
    """Star edges of the components; `linked(rows, rest)` is the link matrix between two lists of places."""
    rest, edges = np.arange(len(ids)), []
    while len(rest) > 1:
        hub, frontier, rest = rest[0], rest[:1], rest[1:]
        while len(frontier) and len(rest):
            found = np.zeros(len(rest), bool)
            for lo in range(0, len(frontier), 64):
                found |= linked(frontier[lo : lo + 64], rest).any(0)
            frontier, rest = rest[found], rest[~found]
            edges.append(np.stack([ids[frontier], np.full(len(frontier), ids[hub])], 1))
    return np.concatenate(edges) if edges else np.empty((0, 2), np.int64)


def related(nodes: DataFrame, percent: int) -> DataFrame:
    """Families (node, root): the connected components of relatives."""
    members = region_members(nodes)
    families = connected_components(relatives(nodes, members, percent))
    more = across_windows(nodes, members, families, percent)
    if more is None:
        return families
    return connected_components(families.select(F.col("node").alias("u"), F.col("root").alias("v")).unionByName(more))


def exact_links(
    sets: list[np.ndarray], ids: np.ndarray, side: np.ndarray, percent: int, across: bool
) -> np.ndarray:
    """Spanning edges of the links 100 * |A & B| >= percent * |A | B|; `across`: only between the two sides count."""
    sizes = np.array([len(s) for s in sets])
    _, columns, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = counts > 1
    number = np.cumsum(shared) - 1
    rows = np.repeat(np.arange(len(sets)), sizes)
    keep = shared[columns]
    rows, columns = rows[keep], number[columns[keep]]
    by_column = np.argsort(columns, kind="stable")
    rows, columns = rows[by_column], columns[by_column]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if across else left
    common = np.zeros((len(left), len(right)), np.float32)
    place = np.empty(len(sets), np.int64)
    place[right] = np.arange(len(right))
    if across:
        place[left] = np.arange(len(left))
    for lo in range(0, int(shared.sum()), COLUMNS_AT_ONCE):
        a, b = np.searchsorted(columns, [lo, lo + COLUMNS_AT_ONCE])
        block = [np.zeros((len(own), COLUMNS_AT_ONCE), np.float32) for own in ((left, right) if across else (left,))]
        which = side[rows[a:b]] if across else np.zeros(b - a, int)
        for number_, matrix in enumerate(block):
            mine = which == number_
            matrix[place[rows[a:b][mine]], columns[a:b][mine] - lo] = 1
        common += block[0] @ block[-1].T
    union = sizes[left][:, None] + sizes[right][None, :] - common
    links = 100 * common.astype(np.int64) >= percent * union.astype(np.int64)
    if not across:
        return stars(ids, lambda some, rest: links[np.ix_(some, rest)])
    both = np.zeros((len(sets), len(sets)), bool)
    both[np.ix_(left, right)] = links
    both[np.ix_(right, left)] = links.T
    return stars(ids, lambda some, rest: both[np.ix_(some, rest)])


def confirmed(
    docs: DataFrame, nodes: DataFrame, families: DataFrame, id_col: str, text_col: str, shingle_words: int, percent: int
) -> DataFrame:
    """Spanning edges (u, v) of the links inside families, decided on the full sets.

    A family is cut into blocks of about BLOCK_SHINGLES (a short text weighs as
    SHORT_SHINGLES); a task holds one block or two.
    """
    member = nodes.join(families, "node").select(
        "node", "root", "doc_id", "text_hash", F.greatest("n_shingles", F.lit(SHORT_SHINGLES)).alias("weight"),
        seeded_key("family", F.col("node")).alias("family_key"),
    )
    placed = running_before(
        settle(member),
        ["root"],
        key_slice(F.col("family_key"), slice_count(docs.sparkSession)),
        [F.col("family_key"), F.col("node"), F.col("text_hash")],
        {"shingles_before": F.col("weight")},
    )
    blocked = settle(placed.withColumn("block", F.floor(F.col("shingles_before") / BLOCK_SHINGLES)))
    last = blocked.groupBy(F.col("root").alias("l_root")).agg(F.max("block").alias("last"))
    pairs = F.expr("transform(sequence(0L, last), b -> struct(least(b, block) AS one, greatest(b, block) AS two))")
    texts = docs.select(
        F.col(id_col).cast("long").alias("t_id"), F.xxhash64(F.col(text_col)).alias("t_hash"), F.col(text_col).alias("text")
    )
    own = (
        blocked.hint("merge")
        .join(texts, F.col("doc_id").eqNullSafe(F.col("t_id")) & (F.col("text_hash") == F.col("t_hash")))
        .join(last, F.col("root") == F.col("l_root"))
    )
    dealt = (
        own.withColumn("pair", F.explode(pairs))
        .select("root", "pair.one", "pair.two", "block", "node", "text_hash", "text")
        .repartition("root", "one", "two")
        .sortWithinPartitions("root", "one", "two", "block", "node", "text_hash")
    )

    def check(batches):
        hashes = WordHashes()
        at, last_row, sets, ids, blocks = None, None, [], [], []

        def close():
            if len(sets) < 2:
                return None
            side = (np.array(blocks) != at[1]).astype(int)
            across = at[1] != at[2]
            if across and (side.all() or not side.any()):
                return None
            found = exact_links(sets, np.array(ids), side, percent, across)
            return pa.RecordBatch.from_arrays([pa.array(found[:, 0]), pa.array(found[:, 1])], names=["u", "v"]) if len(found) else None

        for batch in batches:
            columns = [batch.column(c) for c in ("root", "one", "two", "block", "node", "text_hash", "text")]
            for root, one, two, block, node, text_hash, text in zip(*columns):
                key = (root.as_py(), one.as_py(), two.as_py())
                if key != at:
                    if (found := close()) is not None:
                        yield found
                    at, last_row, sets, ids, blocks = key, None, [], [], []
                # Texts of one document are sets of their own.
                if (row := (node.as_py(), text_hash.as_py())) == last_row:  # a repeated row
                    continue
                last_row = row
                sets.append(shingle_set(hashes.of(words_of(text.as_py())), shingle_words))
                ids.append(node.as_py())
                blocks.append(block.as_py())
        if (found := close()) is not None:
            yield found

    return dealt.mapInArrow(lean(check), "u bigint, v bigint")


def shared_ids(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Edges (u, v) from the node of each set to the ids of its documents that have other sets as well."""
    held = settle(rows.where("set_id IS NOT NULL AND doc_id IS NOT NULL").select("doc_id", "set_id").distinct())
    several = held.groupBy(F.col("doc_id").alias("m_id")).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select("m_id")
    found = held.join(several, F.col("doc_id") == F.col("m_id")).join(sets, "set_id")
    return found.select(F.col("node").alias("u"), F.col("doc_id").alias("v")).where("u <> v").distinct()


def near_duplicate_labels(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle_words: int = 5, percent: int = 80
) -> DataFrame:
    """One row per row of `docs`: `doc_id`, `text_hash`, `n_shingles`, `component_id`, `kept`.

    Words are runs without ASCII white space, A-Z lowered. Documents are linked when
    their sets of `shingle_words`-word shingles have a Jaccard similarity of at least `percent` / 100; a text with fewer
    words is one shingle. `component_id` is the smallest id that links reach. Null, empty and blank texts have no
    shingle, are linked with nothing and are their own component. Texts are read whole. Rows
    that share an id count as one document with all its links. A row without an id is
    linked, gets the smallest id of its component (null if none has one) and is not kept unless that is null. An
    empty table gives no rows; other columns are not read. Ids are integers below 2^62.
    """
    rows = sketch(docs, id_col, text_col, shingle_words, percent)
    grouped = rows.where("n_shingles > 0").groupBy("set_id").agg(
        F.min("doc_id").alias("rep_id"), F.min(F.when(F.col("doc_id").isNull(), F.col("text_hash"))).alias("null_hash")
    )
    # Sets that only rows without an id have get a node above all ids.
    own = F.lit(NO_ID) + F.pmod("null_hash", F.lit(NO_ID))
    sets = settle(grouped.select("set_id", "rep_id", F.coalesce("rep_id", own).alias("node")))
    first = rows.join(sets, "set_id").where(F.col("doc_id").eqNullSafe(F.col("rep_id")))
    nodes = settle(
        first.select("node", "set_id", "doc_id", "text_hash", "n_shingles", "sig", "keys").dropDuplicates(["set_id"])
    )
    families = related(nodes, percent)
    links = confirmed(docs, nodes, families, id_col, text_col, shingle_words, percent)
    components = connected_components(links.unionByName(shared_ids(rows, sets)))
    by_set = settle(
        sets.join(components, "node", "left").select(
            F.col("set_id").alias("c_set"), F.coalesce("root", "node").alias("component")
        )
    )
    real = F.when(F.col("component") < NO_ID, F.col("component"))
    labelled = rows.join(by_set.hint("merge"), F.col("set_id") == F.col("c_set"), "left")
    component = F.when(F.col("set_id").isNull(), F.col("doc_id")).otherwise(real)
    return labelled.select("doc_id", "text_hash", "n_shingles", component.alias("component_id")).withColumn(
        "kept", F.col("doc_id").eqNullSafe(F.col("component_id"))
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """`docs`, all columns, with one document of each group of near duplicates, the one with the smallest id.

    Follows `near_duplicate_labels`. Rows that repeat the id and the text of the kept one stay with it, as do rows without an
    id in a group without one.
    """
    labels = near_duplicate_labels(docs, id_col, text_col, **options)
    keep = labels.where("kept").select(F.col("doc_id").alias("k_id"), F.col("text_hash").alias("k_hash")).distinct()
    text_hash = fresh(docs, "text_hash")
    same = F.col(id_col).eqNullSafe(F.col("k_id")) & (F.col(text_hash) == F.col("k_hash"))
    return (
        docs.withColumn(text_hash, F.xxhash64(F.col(text_col)))
        .join(keep.hint("merge"), same, "left_semi")
        .select(*docs.columns)
    )
