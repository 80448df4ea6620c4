"""Selections in order: first rows, positions, saved against present order, weighted draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.operators.dedup import number_in_order
from maskmill.runtime import lookup, ranked


def seeded_hash(key: Column, seed: int) -> Column:
    """Fifteen digits of ``sha256(seed:key)``, spread over all of ``bigint`` in their order."""
    digits = F.substring(F.sha2(F.concat_ws(":", F.lit(str(seed)), key.cast("string")), 256), 1, 15)
    return ((F.conv(digits, 16, 10).cast("long") - (1 << 59)) * 16).cast("long")


def in_order(df: DataFrame, *order: str, limit: int | None = None) -> DataFrame:
    """Rows sorted by ``order``; with ``limit`` the first of them, which Spark takes from
    the first of every partition."""
    out = df.orderBy(*order)
    return out if limit is None else out.limit(limit)


def first_of_each(df: DataFrame, n: int, group: str, *order: str) -> DataFrame:
    """The first ``n`` rows of each group with their place; of a hot group every task keeps
    only its own first ``n`` before the shuffle."""
    place = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    return df.withColumn("place", place).filter(F.col("place") <= n)


def positions(df: DataFrame, key: str) -> DataFrame:
    """(key, position): the place of each row of a unique column in its order, from 0."""
    numbered = number_in_order(df.select(key), key, "__n", "n")
    return numbered.select(key, F.substring("__n", 3, 30).cast("long").alias("position"))


def order_mismatches(saved: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """Positions at which a saved list (position, key) and the present keys in order differ;
    a place that only one of them has is a difference."""
    now = positions(present, key).select(F.col(key).alias("present"), F.col("position").alias("__p"))
    then = saved.select(F.col(key).alias("saved"), F.col("position").alias("__q"))
    both = then.join(now, F.col("__p") == F.col("__q"), "full")
    return both.filter(~F.col("saved").eqNullSafe(F.col("present"))).select(F.coalesce("__q", "__p").alias("position"), "saved", "present")


def missing_columns(df: DataFrame, required: tuple[str, ...]) -> list[str]:
    """Required columns that a table lacks, sorted."""
    return sorted(set(required) - set(df.columns))


def weighted_draws(df: DataFrame, key: str, label: str, targets: dict[int, float], draws: int, seed: int = 11) -> DataFrame:
    """(draw, key, label): ``draws`` draws with replacement, in which each class comes up with
    its target share and its rows alike.

    A draw's hash picks the class by the cumulative targets and a second one the row by its
    rank in the hash order of the class, so draws are independent of how rows are stored.
    Targets must be positive and every class present. Null labels are never drawn.
    """
    if not targets or min(targets.values()) <= 0:
        raise ValueError("targets must be positive")
    counts = {r[label]: r["n"] for r in df.filter(F.col(label).isin(*targets)).groupBy(label).agg(F.count("*").alias("n")).collect()}  # one row a class
    lacking = sorted(set(targets) - set(counts))
    if lacking:
        raise ValueError(f"classes without rows: {lacking}")
    ranks = ranked(df.filter(F.col(label).isin(*targets)).select(key, label), [label], [key], "__rank", hashed=seeded_hash(F.col(key), seed))
    part = lambda salt: (F.conv(F.substring(F.sha2(F.concat_ws(":", F.lit(f"{salt}{seed}"), F.col("draw").cast("string")), 256), 1, 12), 16, 10).cast("double") / float(1 << 48))
    total, upto, chosen, size = sum(targets.values()), 0.0, None, None
    for k in sorted(targets):
        upto += targets[k] / total
        here = part("c") < F.lit(upto)
        chosen = F.when(here, k) if chosen is None else chosen.when(here, k)
        size = F.when(here, counts[k]) if size is None else size.when(here, counts[k])
    last = max(targets)
    drawn = df.sparkSession.range(draws).select(F.col("id").alias("draw")).select("draw", chosen.otherwise(last).alias("__class"), size.otherwise(counts[last]).alias("__size"))
    drawn = drawn.select("draw", F.concat_ws(":", "__class", (F.floor(part("r") * F.col("__size")) + 1).cast("long")).alias("__pick"))
    rows = ranks.select(F.concat_ws(":", label, "__rank").alias("__at"), key, label)
    return lookup(drawn, rows, "__pick", "__at", "inner", skewed=False).select("draw", key, label)
