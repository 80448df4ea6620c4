"""A sample that meets target shares per category, by divisor-method priorities.

Every record gets the rank ``r`` of a random order within its category and the priority
``(r - 0.5) / target``. Records within the category's minimum stand first; of the
others those with the smallest priorities are kept. Since a category that runs out
simply has no more records, its seats go to the next priorities of all others.

The priorities of a category depend only on its number of records, so where the cut
falls follows from one count per category; only then are records ranked, and only in
categories that have a seat. Ranks come from hash buckets with summed offsets
(``runtime.ranked``), so a category that holds a third of all records is no single task.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmill.operators.selection import seeded_hash
from maskmill.runtime import cut, lookup, ranked

#: Categories are listed by the caller; more than this many are refused.
MAX_CATEGORIES = 100_000


def priority_seats(available: list[int], targets: list[float], floors: list[int], seats: int) -> list[int]:
    """Seats per category: the floors, then the smallest priorities of all.

    The priority at which the seats are full is found by bisection; equal priorities at
    the cut fall to the category that stands first. If the floors alone need more than
    ``seats`` they are kept nevertheless. Categories without a target get their floor.
    """
    k = range(len(available))
    base = [min(a, max(0, f)) for a, f in zip(available, floors, strict=True)]

    def upto(cut_at: float) -> list[int]:
        return [max(base[i], min(available[i], int(cut_at * targets[i] + 0.5))) if targets[i] > 0 else base[i] for i in k]

    if sum(base) >= seats:
        return base
    high = max(((available[i] + 1) / targets[i] for i in k if targets[i] > 0), default=0.0)
    full = upto(high)
    if sum(full) <= seats:
        return full
    low = 0.0
    for _ in range(200):
        middle = (low + high) / 2
        if middle in (low, high):
            break
        if sum(upto(middle)) <= seats:
            low = middle
        else:
            high = middle
    out = upto(low)
    while sum(out) < seats:
        i = min((i for i in k if targets[i] > 0 and out[i] < available[i]), key=lambda i: ((out[i] + 0.5) / targets[i], i))
        out[i] += 1
    return out


def sample_report(records: DataFrame, category: list[str], targets: DataFrame, target: str, floor: str, size, per: int = 1000) -> tuple[DataFrame, int]:
    """One row per target category: available records, wanted, seats and whether it is missed.

    ``size`` is a number or a function of the number of records. Wanted is the larger of
    the floor and ``size * target div per``. Targets of equal category count once (the
    largest holds); null category values match null.
    """
    counts = records.groupBy(*category).agg(F.count("*").alias("available"))
    merged = targets.groupBy(*category).agg(F.max(F.coalesce(target, F.lit(0))).alias(target), F.max(F.coalesce(floor, F.lit(0))).alias(floor))
    on = [F.col(f"t.{c}").eqNullSafe(F.col(f"n.{c}")) for c in category]
    joined = merged.alias("t").join(counts.alias("n"), on, "left").select(*[f"t.{c}" for c in category], target, floor, F.coalesce("n.available", F.lit(0)).alias("available"))
    rows = joined.orderBy(*category).limit(MAX_CATEGORIES + 1).collect()
    if len(rows) > MAX_CATEGORIES:
        raise ValueError(f"more than {MAX_CATEGORIES} target categories")
    total = records.count()
    n = int(size(total) if callable(size) else size)
    seats = priority_seats([r["available"] for r in rows], [float(r[target]) for r in rows], [int(r[floor]) for r in rows], n)
    out = [
        (*[r[c] for c in category], int(r[target]), int(r[floor]), r["available"], max(int(r[floor]), n * int(r[target]) // per), s)
        for r, s in zip(rows, seats, strict=True)
    ]
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in targets.select(*category).schema.fields)
    report = records.sparkSession.createDataFrame(out, f"{fields}, target int, floor int, available long, wanted long, seats long")
    return report.withColumn("missed", F.col("available") < F.col("wanted")), n


def _as_key(category: list[str]):
    return F.to_json(F.struct(*[F.col(f"`{c}`").cast("string").alias(c) for c in category]), {"ignoreNullFields": "false"})


def quota_sample(records: DataFrame, key: str, category: list[str], report: DataFrame, seed: int = 7) -> DataFrame:
    """The records with a seat: key, category, rank, priority and why they were taken.

    The random order is that of ``sha256(seed:key)``, the same at every size of the table;
    equal keys are one record, so ``records`` must be distinct in it. Null keys have no
    order and are dropped.
    """
    slim = records.select(key, *category, _as_key(category).alias("__a")).filter(F.col(key).isNotNull())
    seats = report.filter("seats > 0").select(_as_key(category).alias("__b"), F.col("target").alias("__target"), F.col("floor").alias("__floor"), F.col("seats").alias("__seats"))
    held = cut(lookup(slim, seats, "__a", "__b", "inner").drop("__a", "__b"))
    order = ranked(held, category, [key], "__rank", hashed=seeded_hash(F.col(key), seed))
    taken = order.filter(F.col("__rank") <= F.col("__seats"))
    return taken.select(
        key, *category, F.col("__rank").alias("rank"), F.try_divide(F.col("__rank") - 0.5, F.col("__target").cast("double")).alias("priority"),
        F.when(F.col("__rank") <= F.col("__floor"), "minimum").otherwise("share").alias("taken_for"),
    )


def met_report(report: DataFrame, sample: DataFrame, category: list[str]) -> DataFrame:
    """The report with the records drawn; a target is missed if fewer were drawn than
    wanted and no further record exists that could have been."""
    counts = sample.groupBy(*category).agg(F.count("*").alias("__drawn")).select(_as_key(category).alias("__b"), "__drawn")
    drawn = F.coalesce("__drawn", F.lit(0))
    joined = lookup(report.withColumn("__a", _as_key(category)), counts, "__a", "__b")
    return joined.select(*[c for c in report.columns if c != "missed"], drawn.alias("drawn"), ((drawn < F.col("wanted")) & (F.col("available") < F.col("wanted"))).alias("missed"))
