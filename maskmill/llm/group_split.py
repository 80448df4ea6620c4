"""Train, validation and test splits that never separate linked records.

Groups are found by Borůvka contraction: in each round every component picks its
lightest outgoing edge, all picked edges join the persisted spanning forest, and the
components they connect are contracted to their roots. Of two components that pick the
same edge the smaller becomes the root, so the picks form a forest; pointer jumping
finds its roots, and edges between roots, the lightest of each parallel set, go on.

Groups are then stratified by size band (powers of two) and dealt systematically, band
by band from the largest: each split gets its exact number of groups of a band, in
proportion to what it still lacks, spread evenly over the order of size. Lone records
come last and are dealt against the exact sums, so they even out what whole groups could
not.

Per round the only tables that meet a hot component in a join are broadcast after they
were measured, or salted (``runtime.lookup``). The driver sees one row per size band and
split.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.llm.components import compose, roots_of
from maskmill.runtime import cut, fits_broadcast, lookup, ranked, release, rows_of


#: Once a round leaves so few edges, one task contracts the rest.
TAIL_EDGES = 20_000


def _finish(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lightest forest of the edges (w, tie, ou, ov, u, v) of one task, as rows
    (u, v, weight) of the forest and (x, root) of the map."""
    edges = sorted(zip(*[[x for b in held for x in b.column(i).to_pylist()] for i in range(6)], strict=True)) if (held := list(batches)) else []
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent.setdefault(x, x) != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    chosen = []
    for w, _, ou, ov, u, v in edges:
        low, high = sorted((find(u), find(v)))
        if low != high:
            parent[high] = low
            chosen.append((ou, ov, w, None, None))
    rows = [*chosen, *[(None, None, None, x, root) for x in parent if (root := find(x)) != x]]
    types = (pa.string(), pa.string(), pa.float64(), pa.string(), pa.string())
    yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=["u", "v", "weight", "x", "root"])


def contract(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None, tail_edges: int = TAIL_EDGES) -> tuple[DataFrame, list[DataFrame]]:
    """(forest, rounds) of an undirected graph: the chosen edges (u, v, weight, round) and
    the (x, root) map of each round, which ``labels_of`` composes.

    Without ``weight`` edges weigh the same; ties fall to the hash of the edge. Null ends,
    self-loops and repeated edges link nothing more. Edges are totally ordered, so the
    forest is the same one whether or not its end is found by one task.
    """
    a, b = F.col(f"`{src}`").cast("string"), F.col(f"`{dst}`").cast("string")
    w = F.col(f"`{weight}`").cast("double") if weight else F.lit(0.0)
    ends = edges.select(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"), F.coalesce(w, F.lit(float("inf"))).alias("w"), a.isNotNull() & b.isNotNull())
    ends = ends.toDF("u", "v", "w", "ok").filter("ok and u <> v")
    # a vertex keeps its own name (ou, ov) in the forest while its component's name moves
    current = cut(ends.groupBy("u", "v").agg(F.min("w").alias("w")).select("u", "v", "w", F.col("u").alias("ou"), F.col("v").alias("ov")))
    forest = current.select("u", "v", F.col("w").alias("weight"), F.lit(0).alias("round")).limit(0)
    rounds: list[DataFrame] = []
    while rows_of(current):
        if rounds and rows_of(current) <= tail_edges:
            tied = current.select("w", F.xxhash64("ou", "ov").alias("tie"), "ou", "ov", "u", "v")
            last = cut(tied.repartition(1).mapInArrow(_finish, "u string, v string, weight double, x string, root string"))
            forest = forest.unionByName(last.filter("x is null").select("u", "v", "weight", F.lit(len(rounds) + 1).alias("round")))
            rounds.append(last.filter("x is not null").select("x", "root"))
            break
        key = F.struct("w", F.xxhash64("ou", "ov").alias("tie"), "ou", "ov")
        half = current.select(F.explode(F.array(F.struct(F.col("u").alias("x"), F.col("v").alias("y")), F.struct(F.col("v").alias("x"), F.col("u").alias("y")))).alias("e"), key.alias("k"))
        picks = half.groupBy("e.x").agg(F.min(F.struct("k", F.col("e.y").alias("y"))).alias("best")).select("x", "best.k", "best.y")
        # an edge is picked by one or by both of its ends: at most two rows a group
        hooks = picks.groupBy("k").agg(F.min("x").alias("lo"), F.max("x").alias("hi"), F.max("y").alias("top"), F.count("*").alias("n"))
        both = F.col("n") == 2
        hooks = cut(hooks.select("k", F.when(both, F.col("hi")).otherwise(F.col("lo")).alias("x"), F.when(both, F.col("lo")).otherwise(F.col("top")).alias("p")))
        chosen = hooks.select(F.col("k.ou").alias("u"), F.col("k.ov").alias("v"), F.col("k.w").alias("weight"), F.lit(len(rounds) + 1).alias("round"))
        forest = chosen if not rounds else forest.unionByName(chosen)
        parents = hooks.select("x", "p")
        top = roots_of(parents, parents.select(F.col("p").alias("m")).distinct())
        mapped = cut(lookup(parents, top.select("name", "root"), "p", "name", fits=fits_broadcast(top)).select("x", F.coalesce("root", "p").alias("root")))
        rounds.append(mapped)
        fits = fits_broadcast(mapped)
        left = mapped.select(F.col("x").alias("__x1"), F.col("root").alias("__r1"))
        right = mapped.select(F.col("x").alias("__x2"), F.col("root").alias("__r2"))
        moved = lookup(lookup(current, left, "u", "__x1", fits=fits), right, "v", "__x2", fits=fits, counts=current)
        moved = moved.select(F.coalesce("__r1", "u").alias("a"), F.coalesce("__r2", "v").alias("b"), "w", "ou", "ov").filter("a <> b")
        lightest = moved.groupBy(F.least("a", "b").alias("u"), F.greatest("a", "b").alias("v")).agg(
            F.min(F.struct("w", F.xxhash64("ou", "ov").alias("tie"), "ou", "ov")).alias("k")
        )
        old, current = current, cut(lightest.select("u", "v", "k.w", "k.ou", "k.ov"))
        release(old, top)
    return forest, rounds


def labels_of(forest: DataFrame, rounds: list[DataFrame]) -> DataFrame:
    """(vertex, component) of every vertex with an edge."""
    return compose(rounds) if rounds else forest.select(F.col("u").alias("vertex"), F.col("v").alias("component"))


def spanning_forest(edges: DataFrame, src: str = "src", dst: str = "dst", weight: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(forest, labels) of an undirected graph; see ``contract``."""
    forest, rounds = contract(edges, src, dst, weight)
    return forest, labels_of(forest, rounds)


def shares(counts: list[float], seats: int) -> list[int]:
    """``seats`` divided in proportion to ``counts`` by largest remainders."""
    total = sum(counts)
    if total <= 0 or seats <= 0:
        out = [0] * len(counts)
        if seats > 0:
            out[0] = seats
        return out
    exact = [seats * c / total for c in counts]
    out = [int(x) for x in exact]
    for i in sorted(range(len(counts)), key=lambda i: (out[i] - exact[i], i))[: seats - sum(out)]:
        out[i] += 1
    return out


def dealt_to(rank: Column, places: Column) -> Column:
    """The split of the record with this rank (from 1), for the seats of each split.

    ``places`` is an array of (split, seats) whose seats sum up to the number of ranks.
    The first split takes every rank at which its running share of the seats grows by
    one, so its records lie evenly and are exactly its seats; what it leaves is ranked
    anew for the next split, and so on.
    """
    whole = lambda c: c.cast("decimal(19,0)")

    def step(state: Column, place: Column) -> Column:
        upto = lambda r: F.coalesce(F.call_function("div", whole(r) * whole(place["seats"]), F.nullif(whole(state["n"]), F.lit(0).cast("decimal(19,0)"))), F.lit(0)).cast("long")
        held, before = upto(state["r"]), upto(state["r"] - 1)
        mine = state["split"].isNull() & (held > before)
        return F.struct((state["r"] - held).cast("long").alias("r"), (state["n"] - place["seats"]).cast("long").alias("n"), F.when(mine, place["split"]).otherwise(state["split"]).alias("split"))

    total = F.aggregate(places, F.lit(0).cast("long"), lambda a, p: a + p["seats"])
    start = F.struct(rank.cast("long").alias("r"), total.alias("n"), F.lit(None).cast("string").alias("split"))
    return F.aggregate(places, start, step)["split"]


def deal(groups: DataFrame, targets: dict[str, float], total: int, group: str, size: str) -> DataFrame:
    """``groups`` with the column ``split``, dealt so that the sizes meet the targets.

    ``targets`` are shares (any positive scale) by split name; zero and negative shares
    get nothing. No target at all is an error; an empty table stays empty.
    """
    names = sorted(targets, key=lambda s: (-targets[s], s))
    weights = [max(0.0, float(targets[s])) for s in names]
    if sum(weights) <= 0:
        raise ValueError("no split has a positive share")
    spark = groups.sparkSession
    banded = cut(groups.withColumn("__band", F.floor(F.log2(F.col(size))).cast("int")))
    bands = sorted((r["__band"], r["n"], r["s"]) for r in banded.groupBy("__band").agg(F.count("*").alias("n"), F.sum(size).alias("s")).collect())
    lacking = [total * w / sum(weights) for w in weights]

    def dealt(part: DataFrame, seats: dict[int, list[int]], rows: int) -> DataFrame:
        """Groups in the order of size, larger first, then of their hash."""
        places = spark.createDataFrame([(b, list(zip(names, x, strict=True))) for b, x in seats.items()], "__b int, __places array<struct<split: string, seats: long>>")
        sizes = part.groupBy("__band", size).agg(F.count("*").alias("__n"))  # few: sizes add up to the records
        larger = Window.partitionBy("__band").orderBy(F.desc(size)).rowsBetween(Window.unboundedPreceding, -1)
        offsets = cut(sizes.select(F.col(size).alias("__size"), F.coalesce(F.sum("__n").over(larger), F.lit(0)).alias("__offset")))
        order = lookup(ranked(part, ["__band", size], [group], "__rank", 29, rows), offsets, size, "__size")
        placed = order.join(F.broadcast(places), F.col("__band") == F.col("__b"))  # at most 64 bands
        return placed.select(*groups.columns, dealt_to(F.col("__rank") + F.col("__offset"), F.col("__places")).alias("split"))

    seats: dict[int, list[int]] = {}
    for band, n, s in reversed(bands):
        if band > 0:
            seats[band] = shares([max(0.0, x) for x in lacking] if sum(max(0.0, x) for x in lacking) > 0 else weights, n)
            lacking = [x - s * k / n for x, k in zip(lacking, seats[band], strict=True)]
    parts = []
    if seats:
        together = cut(dealt(banded.filter("__band > 0"), seats, sum(n for b, n, _ in bands if b > 0)))
        parts.append(together)
        used = {r["split"]: r["s"] for r in together.groupBy("split").agg(F.sum(size).alias("s")).collect()}
        lacking = [total * w / sum(weights) - used.get(x, 0) for w, x in zip(weights, names, strict=True)]
    single = sum(n for b, n, _ in bands if b == 0)
    if single:
        open_ = [max(0.0, x) for x in lacking]
        parts.append(dealt(banded.filter("__band = 0"), {0: shares(open_ if sum(open_) > 0 else weights, single)}, single))
    if not parts:
        return groups.withColumn("split", F.lit(None).cast("string"))
    return parts[0].unionByName(parts[1]) if len(parts) > 1 else parts[0]


def split_records(records: DataFrame, edges: DataFrame, targets: dict[str, float], key: str = "sample_id", prefix: str = "s:", weight: str | None = None) -> DataFrame:
    """(key, group_first, group_size, split) of every distinct record.

    ``edges`` link vertices ``prefix + key`` with each other or with shared names.
    Records without a link are groups of one. Null keys are dropped: nothing can name
    them.
    """
    ids = records.select(F.col(f"`{key}`").cast("string").alias(key)).filter(F.col(key).isNotNull()).distinct()
    _, labels = spanning_forest(edges, weight=weight)
    known = labels.select(F.col("vertex").alias("__v"), F.col("component").alias("__c")).filter(F.startswith("__v", F.lit(prefix)))
    members = ids.join(known, F.concat(F.lit(prefix), key) == F.col("__v"), "left").select(key, F.coalesce("__c", F.concat(F.lit(prefix), key)).alias("__root"))
    members = cut(members)
    groups = members.groupBy("__root").agg(F.min(key).alias("group_first"), F.count("*").alias("group_size"))
    total = rows_of(members)
    placed = deal(groups, targets, total, "__root", "group_size").withColumnRenamed("__root", "__r")
    return lookup(members, placed, "__root", "__r").select(key, "group_first", "group_size", "split")


def torn_groups(members: DataFrame, group: str, same: list, apart) -> DataFrame:
    """Groups whose members differ in one of the ``same`` values or hold one ``apart``.

    Nulls are a value of their own. Minimum and maximum are compared, so nothing is
    collected per group.
    """
    packed = [F.struct(c.isNull(), c) for c in same]
    sums = [f(c).alias(f"__{n}{i}") for i, c in enumerate(packed) for n, f in (("lo", F.min), ("hi", F.max))]
    checked = members.groupBy(group).agg(*sums, F.max(apart).alias("__apart"))
    differs = F.col("__apart")
    for i in range(len(packed)):
        differs |= F.col(f"__lo{i}") != F.col(f"__hi{i}")
    return checked.filter(differs).select(group)
