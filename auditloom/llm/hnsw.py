"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

1. Equal vectors become one node, with the ids it may have to name. Nodes are dealt to shards by number, so
   that all are of one size (`block_rows`).
2. A task builds the graph of a shard. Largest inner product becomes a nearest-neighbour search by one more
   component that gives all vectors the same length; vectors BAND times shorter than the longest make a graph of their own, and so on. Nodes are sorted by falling level, so the nodes of
   a layer are a prefix and its links one flat array of node numbers. The graph is written as such arrays.
3. Every distinct query vector walks the graph of every shard, a block of queries at a time. What is found is scored on the
   original vectors, the components added in order in double precision.
4. The best of all shards are merged per query vector, and each query leaves itself out.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from auditloom.llm.vectors import block_rows, blocks_of, in_block_pairs, matrix, one_row_per_id, ordered_dots, usable_vectors
from auditloom.session import settle

LINKS, BASE_LINKS = 24, 48
BUILD_WIDTH, SEARCH_WIDTH = 96, 192
#: Nodes of an upper layer from which the walk of the layer below starts.
START_WIDTH = 32
BATCH = 256
EXPAND = 4
#: Vectors of one graph differ in length by this factor at most.
BAND = 4
QUERY_BLOCK = 65_536
SEGMENT = 4096
#: Cells of the table of visited nodes of one block of walks.
SEEN_CELLS = 1 << 25


def lifted(vectors: np.ndarray) -> np.ndarray:
    """Vectors of one length with a component more: of these, the nearest is the one with the largest inner product."""
    scale = np.abs(vectors).max(initial=0) or 1.0
    rows = vectors / scale
    squares = np.einsum("ij,ij->i", rows, rows)
    return np.hstack([rows, np.sqrt(np.maximum(squares.max(initial=0) - squares, 0))[:, None]]).astype(np.float32)


def bands_of(vectors: np.ndarray) -> np.ndarray:
    """Band of each vector by its length, 0 for those near the longest."""
    largest = np.abs(vectors).max(axis=1, initial=0)
    lengths = np.log(largest) + np.log(np.sqrt(((vectors / largest[:, None]) ** 2).sum(axis=1)))
    return ((lengths.max(initial=-np.inf) - lengths) / np.log(BAND)).astype(np.int64)


def levels_of(hashes: np.ndarray) -> np.ndarray:
    """Level of each node, from its hash: one in LINKS rises by one."""
    share = ((hashes.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 1) / 2**53
    return (-np.log(share) / np.log(LINKS)).astype(np.int64)


def walk(vectors, links, queries, starts, width):
    """The `width` best nodes of one layer that each query reaches, best first: (nodes, scores), -1 where there are none.

    All queries of a block go side by side: in each step every query expands its EXPAND best open nodes.
    """
    count, size = len(queries), len(links)
    seen = np.zeros((count, size + 1), bool)
    seen[:, size] = True
    rows = np.arange(count)
    nodes = np.full((count, width), -1, np.int32)
    scores = np.full((count, width), -np.inf, np.float32)
    opened = np.zeros((count, width), bool)
    starts = starts[:, :width]
    some = starts >= 0
    nodes[:, : starts.shape[1]] = starts
    r, c = np.nonzero(some)
    scores[r, c] = np.einsum("ij,ij->i", queries[r], vectors[starts[r, c]])
    seen[r, starts[r, c]] = True
    opened[r, c] = True
    order = np.argsort(-scores, axis=1, kind="stable")
    nodes, scores, opened = (np.take_along_axis(x, order, 1) for x in (nodes, scores, opened))
    live = rows
    while len(live):
        here_open = opened[live]
        live = live[here_open.any(axis=1)]
        if not len(live):
            break
        here_open = opened[live]
        picks = np.argsort(~here_open, axis=1, kind="stable")[:, :EXPAND]
        valid = np.take_along_axis(here_open, picks, 1)
        opened[live[:, None], picks] = False
        near = links[np.take_along_axis(nodes[live], picks, 1)]
        near[~valid] = -1
        near = np.sort(near.reshape(len(live), -1), axis=1)
        new = ~seen[live[:, None], near]
        new[:, 1:] &= near[:, 1:] != near[:, :-1]
        r, c = np.nonzero(new)
        found = near[r, c]
        seen[live[r], found] = True
        dots = np.einsum("ij,ij->i", queries[live[r]], vectors[found])
        better = dots > scores[live[r], -1]
        r, found, dots = r[better], found[better], dots[better]
        if not len(r):
            continue
        counts = np.bincount(r, minlength=len(live))
        place = np.arange(len(r)) - np.repeat(np.cumsum(counts) - counts, counts)
        most = counts.max()
        more_nodes = np.full((len(live), most), -1, np.int32)
        more_scores = np.full((len(live), most), -np.inf, np.float32)
        more_nodes[r, place], more_scores[r, place] = found, dots
        touched = counts > 0
        at = live[touched]
        all_scores = np.hstack([scores[at], more_scores[touched]])
        order = np.argsort(-all_scores, axis=1, kind="stable")[:, :width]
        scores[at] = np.take_along_axis(all_scores, order, 1)
        nodes[at] = np.take_along_axis(np.hstack([nodes[at], more_nodes[touched]]), order, 1)
        opened[at] = np.take_along_axis(np.hstack([opened[at], more_nodes[touched] >= 0]), order, 1)
    return nodes, scores


def spread_out(vectors, nodes, scores, limit):
    """Of candidates, best first, at most `limit` that are nearer to their node than to those chosen before: a table of node numbers."""
    held = vectors[np.maximum(nodes, 0)]
    between = held @ held.transpose(0, 2, 1)
    nearest = np.full(nodes.shape, -np.inf, np.float32)
    chosen = np.zeros(nodes.shape, bool)
    taken = np.zeros(len(nodes), np.int64)
    for i in range(nodes.shape[1]):
        fine = (nodes[:, i] >= 0) & (scores[:, i] > nearest[:, i]) & (taken < limit)
        if fine.any():
            chosen[:, i] = fine
            taken += fine
            nearest = np.where(fine[:, None], np.maximum(nearest, between[:, i, :]), nearest)
    # Free places go to the best of the rest, which keeps the graph of a crowded shard in one piece.
    rank = np.argsort(np.where(chosen, 0, np.where(nodes >= 0, 1, 2)), axis=1, kind="stable")[:, :limit]
    return np.take_along_axis(nodes, rank, 1)


def best_first(nodes, scores, width):
    order = np.argsort(-scores, axis=1, kind="stable")[:, :width]
    return np.take_along_axis(nodes, order, 1), np.take_along_axis(scores, order, 1)


def link_back(vectors, links, sources, targets):
    """Add `sources[i]` to the links of `targets[i]`; lists that overflow keep what `spread_out` chooses."""
    order = np.lexsort((sources, targets))
    sources, targets = sources[order], targets[order]
    owners, first, counts = np.unique(targets, return_index=True, return_counts=True)
    limit = links.shape[1]
    held = (links[owners] >= 0).sum(axis=1)
    place = np.arange(len(sources)) - np.repeat(first, counts)
    owner = np.repeat(np.arange(len(owners)), counts)
    fits = (held + counts <= limit)[owner]
    links[targets[fits], (held[owner] + place)[fits]] = sources[fits]
    over = np.nonzero(held + counts > limit)[0]
    for at in range(0, len(over), BATCH):
        part = over[at : at + BATCH]
        width = limit + counts[part].max()
        nodes = np.full((len(part), width), -1, np.int32)
        nodes[:, :limit] = links[owners[part]]
        for i, k in enumerate(part):
            nodes[i, limit : limit + counts[k]] = sources[first[k] : first[k] + counts[k]]
        scores = np.einsum("ikj,ij->ik", vectors[np.maximum(nodes, 0)], vectors[owners[part]])
        scores[nodes < 0] = -np.inf
        links[owners[part]] = spread_out(vectors, *best_first(nodes, scores, 2 * limit), limit)


def build(vectors: np.ndarray, levels: np.ndarray) -> list[np.ndarray]:
    """Links of every layer, the base first; `levels` must not rise.

    Nodes go in by batches: a batch walks the graph of those before it, and sees its own members exactly.
    """
    sizes = [int((levels >= layer).sum()) for layer in range(int(levels.max(initial=0)) + 1)]
    layers = [np.full((n, LINKS if layer else BASE_LINKS), -1, np.int32) for layer, n in enumerate(sizes)]
    begin = 1
    while begin < len(vectors):
        end = min(len(vectors), begin + min(BATCH, begin))
        batch = vectors[begin:end]
        among = batch @ batch.T
        np.fill_diagonal(among, -np.inf)
        starts = np.zeros((end - begin, 1), np.int32)
        for layer in range(len(layers) - 1, -1, -1):
            links, inside = layers[layer], max(0, min(sizes[layer], end) - begin)
            standing = links[: min(begin, len(links))]
            nodes, scores = walk(vectors, standing, batch, starts, BUILD_WIDTH if inside else START_WIDTH)
            starts = nodes
            if not inside:
                continue
            own = np.arange(begin, begin + inside, dtype=np.int32)
            nodes = np.hstack([nodes[:inside], np.broadcast_to(own, (inside, inside))])
            scores = np.hstack([scores[:inside], among[:inside, :inside]])
            nodes = np.where(scores > -np.inf, nodes, -1)
            chosen = spread_out(vectors, *best_first(nodes, scores, BUILD_WIDTH), LINKS)
            links[begin : begin + inside, : chosen.shape[1]] = chosen
            r, c = np.nonzero(chosen >= 0)
            sources, targets = own[r], chosen[r, c]
            known = (links[targets] == sources[:, None]).any(axis=1)
            link_back(vectors, links, sources[~known], targets[~known])
        begin = end
    return layers


def search(vectors, layers, queries, width):
    """The `width` nodes that each query finds, best first, -1 where there are fewer."""
    starts = np.zeros((len(queries), 1), np.int32)
    for links in layers[:0:-1]:
        starts = walk(vectors, links, queries, starts, START_WIDTH)[0]
    return walk(vectors, layers[0], queries, starts, width)[0]


def index_shards(nodes: DataFrame, count: int) -> DataFrame:
    """Settled graphs of the shards: rows of flat arrays, `SEGMENT` nodes each.

    `nodes` has `vector`, `dim` and `ids`. Layer 0 carries the vectors and ids of its nodes, the layers above are prefixes of it; the links
    of a layer are int32 numbers of nodes, LINKS or BASE_LINKS a node, -1 where there are fewer.
    """
    schema = (
        "dim int, block int, band int, layer int, segment int, nodes int, vectors binary, ids array<bigint>, id_counts array<int>, links binary"
    )
    out = ["dim", "block", "band", "layer", "segment", "nodes", "vectors", "ids", "id_counts", "links"]

    def make(table: pa.Table) -> pa.Table:
        dim, block = table["dim"][0].as_py(), table["block"][0].as_py()
        hashes, bands = table["hash"].to_numpy(), bands_of(matrix(table["vector"], dim))
        rows = []
        for band in np.unique(bands).tolist():
            levels = levels_of(hashes)
            order = np.lexsort((hashes, -levels))
            order = order[bands[order] == band]
            part = table.take(pa.array(order))
            exact = matrix(part["vector"], dim)
            for layer, links in enumerate(build(lifted(exact), levels[order])):
                for at in range(0, len(links), SEGMENT):
                    some = links[at : at + SEGMENT]
                    ids = part["ids"].slice(at, SEGMENT).to_pylist() if layer == 0 else []
                    rows.append(
                        (
                            dim, block, band, layer, at // SEGMENT, len(some), None if layer else exact[at : at + SEGMENT].tobytes(),
                            [i for group in ids for i in group], [len(group) for group in ids], some.tobytes(),
                        )
                    )
        return pa.table([pa.array(c, t) for c, t in zip(zip(*rows), arrow_types)], names=out)

    arrow_types = [pa.int32()] * 6 + [pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary()]
    dealt = blocks_of(nodes, count, "block").withColumn("hash", F.xxhash64("vector"))
    return settle(dealt.groupBy("dim", "block").applyInArrow(make, schema))


class Graph:
    """The arrays of one graph, from its rows in the index."""

    def __init__(self, index: pa.Table):
        index = index.sort_by([("layer", "ascending"), ("segment", "ascending")])
        of_layer, blobs = index["layer"].to_pylist(), index["links"].to_pylist()
        self.layers = []
        for layer in range(max(of_layer) + 1):
            flat = b"".join(b for b, at in zip(blobs, of_layer) if at == layer)
            self.layers.append(np.frombuffer(flat, np.int32).reshape(-1, LINKS if layer else BASE_LINKS))
        base = index.filter(pa.compute.equal(index["layer"], 0))
        self.exact = np.frombuffer(b"".join(base["vectors"].to_pylist()), np.float64).reshape(-1, index["dim"][0].as_py())
        self.counts = np.concatenate([c.flatten().to_numpy() for c in base["id_counts"].chunks])
        self.ids = np.concatenate([c.flatten().to_numpy() for c in base["ids"].chunks])
        self.first = np.cumsum(self.counts) - self.counts
        self.vectors = lifted(self.exact)

    def found(self, asked: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in `asked`, id, exact score) of what a walk finds, every id of a node."""
        size = np.abs(asked).max(axis=1, initial=0)[:, None]
        flat = np.hstack([asked / np.where(size > 0, size, 1), np.zeros((len(asked), 1))]).astype(np.float32)
        r, c = np.nonzero((nodes := search(self.vectors, self.layers, flat, width)) >= 0)
        node = nodes[r, c]
        copies = self.counts[node]
        rows = np.repeat(np.arange(len(r)), copies)
        spot = np.arange(len(rows)) - np.repeat(np.cumsum(copies) - copies, copies)
        return r[rows], self.ids[self.first[node][rows] + spot], ordered_dots(asked[r], self.exact[node])[rows]


def find_in_shard(width: int, keep: int):
    """Function of one shard and one block of queries: up to `keep` rows (`query`, `id`, `score`) a query, best first."""
    names = ["query", "id", "score"]

    def run(index: pa.Table, queries: pa.Table) -> pa.Table:
        found = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
        if index.num_rows and queries.num_rows:
            dim = index["dim"][0].as_py()
            bands = sorted(set(index["band"].to_pylist()))
            graphs = [Graph(index.filter(pa.compute.equal(index["band"], band))) for band in bands]
            numbers = queries["query"].to_numpy()
            step = max(16, min(BATCH, SEEN_CELLS // max(len(g.exact) for g in graphs)))
            for at in range(0, len(numbers), step):
                asked = matrix(queries["vector"].slice(at, step), dim)
                row, named, points = (np.concatenate(x) for x in zip(*[g.found(asked, max(width, keep)) for g in graphs]))
                order = np.lexsort((named, -points, row))
                row, named, points = row[order], named[order], points[order]
                starts = np.r_[True, row[1:] != row[:-1]]
                begin = np.maximum.accumulate(np.where(starts, np.arange(len(row)), 0))
                kept = np.arange(len(row)) - begin < keep
                found.append((numbers[at + row[kept]], named[kept], points[kept]))
        return pa.table([pa.array(np.concatenate(c)) for c in zip(*found)], names=names)

    return run


def nearest_neighbours(
    df: DataFrame,
    is_query,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    k: int = 20,
    width: int = SEARCH_WIDTH,
    query_block: int = QUERY_BLOCK,
) -> DataFrame:
    """The `k` rows found with the largest inner product, for each row where `is_query` (a column of `df`) holds.

    Returns `query_id`, `rank` from 1, `vec_id`, `score`; nearest first, ties to the smaller id, never the query's own id. A query with fewer
    candidates has all that were found. Approximate: a walk of `width` finds of every shard. Every row is indexed.

    Rows without an id, and vectors that are null, empty, zero or hold a null, NaN or infinite component, take no part. Of rows that
    share an id the one with the smallest vector counts. Vectors of one length only meet each other. Equal vectors are one node
    with the `k` + 1 smallest of their ids, which is all that any answer can name of them.
    """
    rows = usable_vectors(df, id_col, vector_col, asks=F.coalesce(is_query, F.lit(False)))
    rows = one_row_per_id(settle(rows.where(F.exists("vector", lambda x: x != 0))))
    same = Window.partitionBy("dim", "vector").orderBy("id")
    copies = rows.withColumn("_n", F.row_number().over(same)).where(F.col("_n") <= k + 1)
    nodes = settle(copies.groupBy("dim", "vector").agg(F.array_sort(F.collect_list("id")).alias("ids")))
    asking = rows.where("asks").select(F.col("id").alias("query_id"), "dim", "vector")
    queries = settle(asking.groupBy("dim", "vector").agg(F.min("query_id").alias("query")))
    count, asked = nodes.count(), queries.count()
    shards, parts = max(1, -(-count // block_rows(count))), max(1, -(-asked // query_block))
    found = in_block_pairs(
        index_shards(nodes, shards), blocks_of(queries, parts, "part"), shards, parts,
        find_in_shard(width, k + 1), "query bigint, id bigint, score double",
    )
    best = Window.partitionBy("query").orderBy(F.desc("score"), "id")
    merged = found.withColumn("_n", F.row_number().over(best)).where(F.col("_n") <= k + 1)
    lists = merged.groupBy("query").agg(F.array_sort(F.collect_list(F.struct("_n", "id", "score"))).alias("found"))
    # Queries with equal vectors share an answer; the join deals a hot vector out again where it must.
    answers = queries.join(lists, "query").select("dim", "vector", "found")
    others = F.slice(F.filter("found", lambda f: f["id"] != F.col("query_id")), 1, k)
    return (
        asking.join(answers.hint("merge"), ["dim", "vector"])
        .select("query_id", F.posexplode(others).alias("_at", "_hit"))
        .select("query_id", (F.col("_at") + 1).alias("rank"), F.col("_hit.id").alias("vec_id"), F.col("_hit.score").alias("score"))
    )
