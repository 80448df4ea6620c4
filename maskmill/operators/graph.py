"""Content groups: components of duplicate links, by alternating stars.

A *large star* hangs every larger neighbour of a vertex on the smallest vertex around
it, a *small star* every smaller-or-equal one; both keep the components, and in
alternation they turn any graph into stars in a logarithmic number of rounds. Each is
one aggregation and one join on the vertex; hub vertices meet the join as the side that
is looked up, one row each, and the lookup is broadcast behind a count or salted.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmill.functions.scalars import join_sorted
from maskmill.operators.dedup import number_in_order
from maskmill.runtime import cut, lookup, release, rows_of, seen


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """Edges (u, v) with u > v, after one star step."""
    if large:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    else:
        both = edges
    least = cut(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("__u"), F.least("u", "m").alias("__m")))
    joined = lookup(both, least, "u", "__u")
    if large:
        moved = joined.filter("v > u").select(F.col("v").alias("u"), F.col("__m").alias("v"))
    else:
        hung = joined.select(F.col("v").alias("u"), F.col("__m").alias("v"))
        moved = hung.unionByName(least.select(F.col("__u").alias("u"), F.col("__m").alias("v")))
    out = cut(moved.filter("u > v").distinct(), sign=F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")))
    release(least)
    return out


#: So many edges are joined up by one task.
ONE_TASK = 20_000


def _join_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Union-find over a bounded table: each vertex with the smallest of its component."""
    parent: dict[str, str] = {}

    def find(x: str) -> str:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for b in batches:
        for u, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            parent.setdefault(u, u)
            parent.setdefault(v, v)
            a, c = sorted((find(u), find(v)))
            parent[c] = a
    pairs = [(x, find(x)) for x in parent]
    pairs = [p for p in pairs if p[0] != p[1]]
    yield pa.RecordBatch.from_arrays([pa.array([p[i] for p in pairs], pa.string()) for i in (0, 1)], names=["u", "v"])


def components(edges: DataFrame, src: str, dst: str, one_task: int = ONE_TASK) -> DataFrame:
    """(vertex, component) of all vertices (texts) with an edge; named by the smallest.

    Up to ``one_task`` edges are joined up by one task, more by stars."""
    a, b = F.col(src), F.col(dst)
    current = cut(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u is not null and v is not null and u > v").distinct())
    before = None
    n = rows_of(current)
    if n <= one_task:
        current = cut(current.coalesce(1).select(F.col("u").cast("string"), F.col("v").cast("string")).mapInArrow(_join_up, "u string, v string"))
    while n > one_task:
        old, middle = current, _star(current, True)
        current = _star(middle, False)
        release(old, middle)
        sign = (rows_of(current), seen(current, "sign"))
        if sign == before:
            break
        before = sign
    roots = current.select(F.col("v").alias("vertex")).distinct()
    return current.select(F.col("u").alias("vertex"), F.col("v").alias("component")).unionByName(roots.select("vertex", F.col("vertex").alias("component")))


def content_groups(members: DataFrame, key: str, edges: DataFrame, src: str, dst: str, one_task: int = ONE_TASK) -> DataFrame:
    """(key, content_group) of every member: linked ones share a group, numbered in the
    order of the smallest member; edges with an end outside ``members`` are dropped."""
    ids = members.select(F.col(key).alias("__id")).distinct()
    inner = edges.join(ids, F.col(src) == F.col("__id"), "left_semi").join(ids, F.col(dst) == F.col("__id"), "left_semi")
    found = components(inner, src, dst, one_task).withColumnsRenamed({"vertex": "__v", "component": "__c"})
    placed = ids.join(found, F.col("__id") == F.col("__v"), "left").select(F.col("__id").alias(key), F.coalesce("__c", "__id").alias("first_member"))
    placed = cut(placed)
    numbered = number_in_order(placed.select("first_member").distinct(), "first_member", "content_group", "content")
    return lookup(placed, numbered.withColumnRenamed("first_member", "__f"), "first_member", "__f").select(key, "first_member", "content_group")


def group_report(members: DataFrame, group: str, key: str, label: str, partition: str, fold: str) -> DataFrame:
    """Members, labels and place of each group."""
    return members.groupBy(group).agg(join_sorted(F.collect_set(key)).alias("sample_ids"), join_sorted(F.collect_set(label)).alias("diagnoses"), F.min(partition).alias("partition"), F.min(fold).alias("fold"), F.countDistinct(key).alias("member_count"))
