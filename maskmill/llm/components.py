"""Groups of linked records: connected components on a two-dimensional grid.

Vertices are hashed into ``B`` blocks; an edge belongs to the cell of its two blocks.
One round

1. runs a union-find inside every cell, which turns the cell's edges into a star per
   local component (vertex -> smallest vertex reached inside the cell);
2. exchanges the representatives of a vertex over the cells of its row and column and
   keeps the smallest as its parent;
3. follows the parents to their roots and rewrites the disagreements between cells as
   edges between roots: the edges of the next, much smaller round.

Rounds end when no cells disagree, that is, when parents are stable. Every vertex that
gets a parent leaves the graph in that round, so the parent maps compose into the final
labels from the last round to the first.

Sizes: a cell is one task and holds about ``cell_edges`` edges; the grid grows with the
edges. A hot vertex is spread over the cells of its row and column, and the only table
that its rows meet in a join is broadcast after it was measured, or salted. Nothing is
collected. All rounds are cut by tables in the shared folder, and deleted once over.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmill.runtime import cut, fits_broadcast, lookup, release, rows_of, seen

#: Edges of a cell; the grid of a round has as many blocks as its edges ask for.
CELL_EDGES = 250_000
#: Blocks of the first round at least, so that every run exchanges representatives.
LEAST_BLOCKS = 4


def union_find(u: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
    """Smallest reachable vertex of each of ``n`` vertices.

    Union by hooking the larger root under the smaller, find by path halving, over
    whole arrays at once; edges whose ends meet are dropped as the rounds go on.
    """
    parent = np.arange(n, dtype=np.int64)
    while len(u):
        ru, rv = parent[u], parent[v]
        open_ = ru != rv
        u, v, ru, rv = u[open_], v[open_], ru[open_], rv[open_]
        np.minimum.at(parent, np.maximum(ru, rv), np.minimum(ru, rv))
        while True:
            up = parent[parent]
            if np.array_equal(up, parent):
                break
            parent = up
    return parent


def _stars(u: pa.Array, v: pa.Array) -> tuple[pa.Array, pa.Array]:
    """Star edges (vertex, smallest vertex) of the components of some edges."""
    both = pa.concat_arrays([u, v]).dictionary_encode()
    names = both.dictionary
    order = pc.sort_indices(names).to_numpy()
    rank = np.empty(len(names), np.int64)
    rank[order] = np.arange(len(names))
    codes = rank[both.indices.to_numpy(zero_copy_only=False)]
    parent = union_find(codes[: len(u)], codes[len(u) :], len(names))
    x = np.flatnonzero(parent != np.arange(len(names)))
    ordered = names.take(pa.array(order))
    return ordered.take(pa.array(x)), ordered.take(pa.array(parent[x]))


def _cell_forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a cell; holds the forest of what was read, never all edges."""
    x = m = pa.array([], pa.string())
    held: list[pa.RecordBatch] = []
    size = 0

    def fold():
        nonlocal x, m, held, size
        u = pa.concat_arrays([x, *[b.column(0).cast(pa.string()) for b in held]])
        v = pa.concat_arrays([m, *[b.column(1).cast(pa.string()) for b in held]])
        x, m = _stars(u, v)
        held, size = [], 0

    for b in batches:
        held.append(b)
        size += b.num_rows
        if size >= CELL_EDGES:
            fold()
    if held:
        fold()
    for at in range(0, len(x), 50_000):
        yield pa.RecordBatch.from_arrays([x.slice(at, 50_000), m.slice(at, 50_000)], names=["x", "m"])


def roots_of(parents: DataFrame, referenced: DataFrame) -> DataFrame:
    """(name, root) of the referenced vertices that have a parent, by pointer jumping."""
    active = cut(parents.join(referenced, parents.x == referenced.m, "left_semi").select(F.col("x").alias("name"), F.col("p").alias("root")))
    if rows_of(active) == 0:
        return active
    fits = fits_broadcast(active)  # roots change, names and the number of rows do not
    while True:
        jumped = active
        for i in range(3 if fits else 1):  # a broadcast hop costs little, so take several at once
            hop = active.select(F.col("name").alias(f"__n{i}"), F.col("root").alias(f"__r{i}"))
            jumped = lookup(jumped, hop, "root", f"__n{i}", fits=fits).select("name", F.coalesce(f"__r{i}", "root").alias("root"), F.col(f"__r{i}").isNotNull().alias("moved"))
        jumped = cut(jumped, moved=F.count_if("moved"))
        release(active)
        active = jumped
        if not seen(active, "moved"):
            return active


def connected_components(edges: DataFrame, src: str = "src", dst: str = "dst", cell_edges: int = CELL_EDGES) -> DataFrame:
    """(vertex, component) of every vertex of ``edges``; a component is named by its
    smallest vertex in binary order.

    Edges are undirected; repeated edges and ties are harmless; self-loops and edges
    with a null end link nothing, so their vertices are absent unless another edge has
    them. Other columns are ignored. No edges give an empty result.
    """
    a, b = F.col(f"`{src}`").cast("string"), F.col(f"`{dst}`").cast("string")
    current = cut(edges.select(a.alias("u"), b.alias("v")).filter("u is not null and v is not null and u <> v"))
    rounds: list[DataFrame] = []
    while True:
        n = rows_of(current)
        if n == 0:
            break
        blocks = max(1 if rounds else LEAST_BLOCKS, math.ceil(math.sqrt(2 * n / cell_edges)))
        bu, bv = (F.pmod(F.xxhash64(c), F.lit(blocks)) for c in ("u", "v"))
        placed = current.select("u", "v", F.least(bu, bv).alias("row"), F.greatest(bu, bv).alias("col"))
        cells = blocks * (blocks + 1) // 2
        grid = placed.repartition(cells, "row", "col").select("u", "v")
        stars = grid.mapInArrow(_cell_forest, "x string, m string")
        # a vertex stands in at most `blocks` cells: its row and its column
        exchanged = cut(stars.groupBy("x").agg(F.min("m").alias("p"), F.collect_set("m").alias("ms")))
        release(current)
        apart = exchanged.filter(F.size("ms") > 1)
        if blocks == 1:
            rounds.append(exchanged.select("x", F.col("p").alias("root")))
            break
        referenced = exchanged.select(F.explode("ms").alias("m")).distinct()
        found = roots_of(exchanged.select("x", "p"), referenced)
        top = found.select("name", "root")
        fits = fits_broadcast(found)
        second = top.select(F.col("name").alias("__n2"), F.col("root").alias("__r2"))
        mapped = lookup(exchanged.select("x", "p"), top, "p", "name", fits=fits)
        rounds.append(cut(mapped.select("x", F.coalesce("root", "p").alias("root"))))
        pairs = apart.select("p", F.explode("ms").alias("m")).filter("p <> m")
        pairs = lookup(lookup(pairs, top, "p", "name", fits=fits), second, "m", "__n2", fits=fits, counts=pairs)
        current = cut(pairs.select(F.coalesce("root", "p").alias("u"), F.coalesce("__r2", "m").alias("v")).filter("u <> v").distinct())
        release(exchanged, found)
    if not rounds:
        return current.select(F.col("u").alias("vertex"), F.col("v").alias("component"))
    return compose(rounds)


def compose(rounds: list[DataFrame]) -> DataFrame:
    """(vertex, component) from the (x, root) maps of successive contractions."""
    labels = rounds[-1].select(F.col("x").alias("vertex"), F.col("root").alias("component"))
    for parents in reversed(rounds[:-1]):
        later = labels.select(F.col("vertex").alias("__v"), F.col("component").alias("__c"))
        mine = lookup(parents, later, "root", "__v").select(F.col("x").alias("vertex"), F.coalesce("__c", "root").alias("component"))
        old, labels = labels, cut(mine.unionByName(labels))
        release(old, parents)
    roots = labels.select(F.col("component").alias("vertex")).distinct()
    return labels.unionByName(roots.select("vertex", F.col("vertex").alias("component")))
