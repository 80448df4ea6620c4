"""Mixing sources to target shares by the cube method.

A source that is to give ``target`` tokens and holds ``tokens`` is used
``k = min(max_repeats, target / tokens)`` times: every record is taken ``floor(k)``
times, and a balanced sample with inclusion probability ``k - floor(k)`` once more. The
sample comes from the cube method: the vector of inclusion probabilities moves along
the null space of the balancing equations (number of records, number of tokens), each
step with both directions weighted so that the expectation stays, until a record is
settled at 0 or 1. What the equations cannot settle, at most two records a source, is
the landing problem; of its few outcomes that nearest to the token total is taken.

A source is cut into hash blocks of bounded size, which fly independently; what each
leaves open (two records at most) flies on in fewer blocks, until one block a source
remains. So a source that holds a third of all records is many tasks, and only open
records ever move on.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmill.runtime import cut, lookup

#: Records that fly together in one task.
BLOCK_ROWS = 20_000
#: The target table is read by the driver; more rows than this are refused.
MAX_SOURCES = 100_000
_EPS = 1e-9


def flight(prob: list[float], sizes: list[float], seed: int) -> list[float]:
    """Move probabilities until at most two lie strictly between 0 and 1.

    The sums of ``prob`` and of ``prob * sizes`` stay as they are.
    """
    rng = random.Random(seed)
    p = list(prob)
    open_: list[int] = []
    for i in range(len(p)):
        if not _EPS < p[i] < 1 - _EPS:
            p[i] = float(round(p[i]))
            continue
        open_.append(i)
        if len(open_) < 3:
            continue
        a, b, c = open_
        u = (sizes[c] - sizes[b], sizes[a] - sizes[c], sizes[b] - sizes[a])  # null space of the two equations
        if u == (0, 0, 0):
            u = (1.0, -1.0, 0.0)
        up = min((1 - p[j]) / w if w > 0 else p[j] / -w for j, w in zip(open_, u, strict=True) if w)
        down = min(p[j] / w if w > 0 else (1 - p[j]) / -w for j, w in zip(open_, u, strict=True) if w)
        step = up if rng.random() * (up + down) < down else -down
        still = []
        for j, w in zip(open_, u, strict=True):
            p[j] += step * w
            if _EPS < p[j] < 1 - _EPS:
                still.append(j)
            else:
                p[j] = float(round(p[j]))
        if len(still) == 3:  # rounding noise: settle the one nearest to a bound
            j = min(still, key=lambda j: min(p[j], 1 - p[j]))
            p[j] = float(round(p[j]))
            still.remove(j)
        open_ = still
    return p


def landing(prob: list[float], sizes: list[float]) -> list[float]:
    """Settle what a last flight left open: nearest to the token total, then to the count."""
    p = list(prob)
    open_ = [i for i, x in enumerate(p) if _EPS < x < 1 - _EPS]
    if not open_:
        return [float(round(x)) for x in p]
    tokens, count = sum(p[i] * sizes[i] for i in open_), sum(p[i] for i in open_)
    options = [[float(m >> j & 1) for j in range(len(open_))] for m in range(1 << len(open_))]
    best = min(options, key=lambda o: (abs(sum(s * sizes[i] for s, i in zip(o, open_, strict=True)) - tokens), abs(sum(o) - count)))
    for i, s in zip(open_, best, strict=True):
        p[i] = s
    return [float(round(x)) for x in p]


_FLOWN = "source string, id binary, tokens long, p double, block int, last boolean"


def _fly(key: tuple, table: pa.Table) -> pa.Table:
    table = table.sort_by([("tokens", "descending"), ("id", "ascending")])  # what stays open is small
    sizes = [float(x or 0) for x in table["tokens"].to_pylist()]
    p = flight(table["p"].to_pylist(), sizes, table.num_rows)
    if table["last"][0].as_py():
        p = landing(p, sizes)
    return table.set_column(table.schema.get_field_index("p"), "p", pa.array(p, pa.float64()))


def balanced_sample(units: DataFrame, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(source, id, taken) of units (source, id, tokens, p): a balanced sample per source.

    ``p`` may differ by unit. Long records fly first, so that the landing problem is one
    of short records; ties follow the id (binary), so the result does not depend on how
    the rows are distributed.
    """
    settled, rest = [], units.select("source", "id", "tokens", "p")
    sizes = {r["source"]: r["n"] for r in rest.groupBy("source").agg(F.count("*").alias("n")).collect()}
    spark = units.sparkSession
    while True:
        blocks = {s: max(1, -(-n // block_rows)) for s, n in sizes.items()}
        last = all(b == 1 for b in blocks.values())
        table = spark.createDataFrame(list(blocks.items()), "__s string, __b int")
        placed = lookup(rest, table, "source", "__s", "inner").withColumn("block", F.pmod(F.xxhash64(F.lit(41), "id"), F.col("__b")).cast("int"))
        placed = placed.withColumn("last", F.col("__b") == 1)
        flown = placed.select("source", "id", "tokens", "p", "block", "last").groupBy("source", "block").applyInArrow(_fly, _FLOWN)
        if last:
            settled.append(flown.select("source", "id", F.col("p").cast("int").alias("taken")))
            break
        flown = cut(flown)
        open_ = (F.col("p") > _EPS) & (F.col("p") < 1 - _EPS)
        settled.append(flown.filter(~open_).select("source", "id", F.col("p").cast("int").alias("taken")))
        rest = flown.filter(open_).select("source", "id", "tokens", "p")
        left = {r["source"]: r["n"] for r in rest.groupBy("source").agg(F.count("*").alias("n")).collect()}
        sizes = left
        if not sizes:
            break
    out = settled[0]
    for s in settled[1:]:
        out = out.unionByName(s)
    return out


def mix_report(records: DataFrame, targets: DataFrame, source: str, tokens: str, total: int | None = None) -> list[dict]:
    """Per target source what it holds, what it should give and how often it is used.

    ``targets`` has source, target_permille and max_repeats; of repeated sources the
    first in order holds; negative figures count as zero. ``total`` defaults to the
    tokens of all records, those without a target included. A source without records
    gives nothing.
    """
    have = records.groupBy(F.col(f"`{source}`").alias("source")).agg(F.sum(F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long")).alias("tokens"), F.count("*").alias("documents"))
    have = cut(have)
    total = int(have.agg(F.sum("tokens")).first()[0] or 0) if total is None else total
    wanted = targets.select(F.col(source).alias("s"), "target_permille", "max_repeats").filter("s is not null").dropDuplicates(["s"])
    rows = wanted.join(have, F.col("s") == have["source"], "left").orderBy("s").limit(MAX_SOURCES + 1).collect()
    if len(rows) > MAX_SOURCES:
        raise ValueError(f"more than {MAX_SOURCES} target sources")
    out = []
    for r in rows:
        held, permille, repeats = int(r["tokens"] or 0), max(0, int(r["target_permille"] or 0)), max(0, int(r["max_repeats"] or 0))
        goal = total * permille / 1000
        times = min(float(repeats), goal / held) if held else 0.0
        whole = int(times + _EPS)
        out.append(
            {"source": r["s"], "target_permille": permille, "max_repeats": repeats, "documents": int(r["documents"] or 0), "tokens": held, "total": total,
             "whole": whole, "part": max(0.0, times - whole), "short": held * repeats * 1000 < total * permille}
        )
    return out


def mix(records: DataFrame, key: str, source: str, tokens: str, report: list[dict], block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(key, source, tokens, copies) of every record that is used, copies >= 1.

    Records with a null source or one without a target are not used. Equal keys are
    separate records only if they differ in source or tokens; null keys are one more key.
    """
    spark = records.sparkSession
    shares = spark.createDataFrame([(r["source"], r["whole"], r["part"]) for r in report], "__s string, __whole int, __part double")
    slim = records.select(F.col(f"`{key}`").alias("__k"), F.col(f"`{source}`").alias("__src"), F.coalesce(F.col(f"`{tokens}`"), F.lit(0)).cast("long").alias("__t"))
    used = cut(lookup(slim, shares, "__src", "__s", "inner").withColumn("__id", F.unhex(F.sha2(F.concat_ws("|", F.coalesce(F.col("__k").cast("string"), F.lit("")), "__t"), 256))))
    part = used.filter(F.col("__part") > _EPS)
    taken = balanced_sample(part.select(F.col("__src").alias("source"), F.col("__id").alias("id"), F.col("__t").alias("tokens"), F.col("__part").alias("p")), block_rows)
    taken = taken.groupBy("source", "id").agg(F.max("taken").alias("taken"))
    joined = used.join(taken, (used["__src"] == taken["source"]) & (used["__id"] == taken["id"]), "left")
    copies = (F.col("__whole") + F.coalesce("taken", F.lit(0))).cast("int")
    return joined.select(F.col("__k").alias(key), F.col("__src").alias(source), F.col("__t").alias(tokens), copies.alias("copies")).filter("copies > 0")
