"""Filling containers of fixed capacity with items of varying length.

Only the histogram of lengths decides the packing, and it has at most one bin per
length up to the capacity, whatever the number of items:

1. enumerate patterns of few lengths (several of one, topped up by one or two others)
   that fill a container to the last token;
2. fit how often each pattern is used to the histogram by non-negative least squares;
3. round down, never using more items than there are;
4. pack the residual items, longest first, each into the tightest open container, many
   equal containers at a time.

The result is a list of recipes (contents, number of containers). Items then find their
container by their rank among the items of their length: ranks come from hash buckets
with summed offsets (``runtime.ranked``), so a length that a third of all items share is
no single task, and no item is moved except for that rank.

An item longer than the capacity is cut into full containers and one remainder; no other
item is ever split. Items of length zero need no container and get none (null).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmill.runtime import cut, ranked

#: For each main length and number of it, so many pairs that fill up the rest are tried.
#: Every length up to the capacity is a main length, so at 2,048 the fit is over 94,000
#: patterns at most.
PAIRS_PER_MAIN = 4
ITERATIONS = 300


def enumerate_patterns(lengths: np.ndarray, capacity: int, pairs: int = PAIRS_PER_MAIN) -> tuple[list[dict[int, int]], int]:
    """(patterns, left out): contents (length -> number) that fill the capacity exactly.

    A pattern is a main length, one or several times, topped up by nothing, one or two
    others. Of the pairs that top up one main, ``pairs`` are taken, spread evenly over
    their lengths; how many were left out is counted.
    """
    have = np.zeros(capacity + 1, bool)
    have[lengths] = True
    seen: dict[tuple, dict[int, int]] = {}
    left_out = 0

    def add(*parts: tuple[int, int]) -> None:
        out: dict[int, int] = {}
        for length, n in parts:
            out[length] = out.get(length, 0) + n
        seen.setdefault(tuple(sorted(out.items())), out)

    for a, i in [(a, i) for a in lengths.tolist() for i in range(1, capacity // a + 1)]:
        rest = capacity - a * i
        if rest == 0:
            add((a, i))
            continue
        if have[rest]:
            add((a, i), (rest, 1))
        b = np.flatnonzero(have[1 : rest // 2 + 1] & have[rest - 1 : rest - rest // 2 - 1 : -1]) + 1
        left_out += max(0, len(b) - pairs)
        for x in b[np.linspace(0, len(b) - 1, min(len(b), pairs)).astype(int)].tolist() if len(b) else ():
            add((a, i), (x, 1), (rest - x, 1))
    return list(seen.values()), left_out


def nnls(rows: np.ndarray, cols: np.ndarray, values: np.ndarray, target: np.ndarray, n: int, iterations: int = ITERATIONS) -> np.ndarray:
    """argmin |Ax - target| over x >= 0 for a sparse non-negative A, by multiplicative
    updates (each keeps x non-negative and never raises the residual)."""
    weight = np.bincount(cols, values * target[rows], n)
    x = weight / np.maximum(np.bincount(cols, values * values, n), 1e-12)
    x /= max(1.0, float(np.bincount(rows, values * x[cols], len(target)).sum() / max(1.0, target.sum())))
    for _ in range(iterations):
        fitted = np.bincount(rows, values * x[cols], len(target))
        x *= weight / np.maximum(np.bincount(cols, values * fitted[rows], n), 1e-12)
    return x


def plan(histogram: dict[int, int], capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Recipes (number of containers, contents) that pack the whole histogram."""
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        if not 0 < length <= capacity:
            raise ValueError(f"length {length} is outside 1..{capacity}")
        left[length] += n
    recipes: list[tuple[int, dict[int, int]]] = []
    lengths = np.flatnonzero(left)
    patterns = enumerate_patterns(lengths, capacity)[0] if len(lengths) else []
    if patterns:
        cols = np.repeat(np.arange(len(patterns)), [len(p) for p in patterns])
        rows = np.array([k for p in patterns for k in p], np.int64)
        values = np.array([v for p in patterns for v in p.values()], float)
        fit = nnls(rows, cols, values, left.astype(float), len(patterns))
        for i in np.argsort(-fit, kind="stable").tolist():
            times = int(fit[i])
            if times == 0:
                break
            times = min(times, *(int(left[k]) // v for k, v in patterns[i].items())) if len(patterns[i]) else 0
            if times > 0:
                recipes.append((times, patterns[i]))
                for k, v in patterns[i].items():
                    left[k] -= times * v
    return recipes + best_fit(left, capacity)


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[int, dict[int, int]]]:
    """Best fit decreasing over a histogram, equal containers filled together."""
    open_: list[list[tuple[int, dict[int, int]]]] = [[] for _ in range(capacity + 1)]
    for length in range(capacity, 0, -1):
        n = int(left[length])
        free = length
        while n:
            while free <= capacity and not open_[free]:
                free += 1
            if free > capacity:
                each = capacity // length
                full, rest = divmod(n, each)
                if full:
                    open_[capacity - each * length].append((full, {length: each}))
                if rest:
                    open_[capacity - rest * length].append((1, {length: rest}))
                break
            count, contents = open_[free].pop()
            each = free // length
            used, put = (min(count, n // each), each) if n >= each else (1, n)
            if used < count:
                open_[free].append((count - used, contents))
            filled = dict(contents)
            filled[length] = filled.get(length, 0) + put
            open_[free - put * length].append((used, filled))
            n -= used * put
    return [r for group in open_ for r in group]


def pack(items: DataFrame, key: str, size: str, capacity: int, names: tuple[str, str, str] = ("chunk", "chunk_size", "container")) -> DataFrame:
    """(key, chunk number, its size, container) of every item, oversized ones in chunks.

    ``key`` should identify items: repeated keys are packed as separate items, null
    keys too. Null and negative sizes count as zero. Other columns are left out, so
    they cannot clash.
    """
    if capacity < 1:
        raise ValueError("the capacity must be positive")
    chunk, chunk_size, container = names
    length = F.greatest(F.coalesce(F.col(f"`{size}`").cast("long"), F.lit(0)), F.lit(0))
    slim = items.select(F.col(f"`{key}`").alias("__k"), length.alias("__s"))
    pieces = F.when(F.col("__s") > capacity, F.ceil(F.col("__s") / F.lit(capacity))).otherwise(1).cast("long")
    cutup = slim.select("__k", "__s", F.explode(F.sequence(F.lit(1).cast("long"), pieces)).alias("__c"))
    parts = cut(cutup.select("__k", F.col("__c").cast("int").alias("__c"), F.least(F.lit(capacity), F.col("__s") - (F.col("__c") - 1) * capacity).alias("__n")))
    counts = parts.filter("__n > 0").groupBy("__n").agg(F.count("*").alias("n")).collect()  # at most one row a length
    histogram = {int(r["__n"]): int(r["n"]) for r in counts}
    starts, bases, eaches = _slots(plan(histogram, capacity))

    @F.pandas_udf("long")
    def container_of(parts: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for lengths, ranks in parts:
            n, r = lengths.to_numpy(np.int64), ranks.to_numpy(np.int64) - 1
            at = np.searchsorted(starts, (n << 44) | r, side="right") - 1
            yield pd.Series(bases[at] + (r - (starts[at] & ((1 << 44) - 1))) // eaches[at])

    filled = ranked(parts.filter("__n > 0"), ["__n"], ["__k", "__c"], "__r", rows=sum(histogram.values()))
    placed = filled.select("__k", "__c", "__n", container_of("__n", "__r").alias("__b"))
    empty = parts.filter("__n = 0").withColumn("__b", F.lit(None).cast("long"))
    return placed.unionByName(empty).select(F.col("__k").alias(key), F.col("__c").alias(chunk), F.col("__n").alias(chunk_size), F.col("__b").alias(container))


def _slots(recipes: list[tuple[int, dict[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each length, which of its ranks (from 0) go to which containers."""
    next_rank: dict[int, int] = {}
    rows, base = [], 0
    for times, contents in recipes:
        for length, each in contents.items():
            at = next_rank.get(length, 0)
            rows.append(((length << 44) | at, base, each))
            next_rank[length] = at + times * each
        base += times
    rows.sort()
    table = np.array(rows, np.int64).reshape(-1, 3)
    return table[:, 0].copy(), table[:, 1].copy(), table[:, 2].copy()
