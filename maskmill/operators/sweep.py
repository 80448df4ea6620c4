"""Threshold sweeps by difference encoding, and selection with tie rules.

As the threshold rises a sample's score changes only where one of its pixels drops out.
So a sample is a step function over the grid; it is sent as one pair of differences per
step, and the sum over all samples at each threshold is a running sum over the grid.
The rows that move are as many as pixels with different places on the grid, never
pixels times thresholds.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.functions.ratios import balanced_mean, dice, safe

#: Thresholds 0.05, 0.06, .. 0.99.
FIRST, LAST = 5, 99


def grid() -> list[float]:
    return [i / 100 for i in range(FIRST, LAST + 1)]


def place_on_grid(p: Column) -> Column:
    """How many thresholds are at most ``p``, by comparison with the thresholds
    themselves: a guess by rounding is corrected by one step either way."""
    guess = F.least(F.greatest(F.floor(p * 100).cast("int"), F.lit(FIRST - 1)), F.lit(LAST))
    up = F.when((guess < LAST) & ((guess + 1) / F.lit(100.0) <= p), guess + 1).otherwise(guess)
    down = F.when((up >= FIRST) & (up / F.lit(100.0) > p), up - 1).otherwise(up)
    return down - (FIRST - 1)


def place_in_list(p: Column, thresholds: list[float]) -> Column:
    """How many of a caller's thresholds are at most ``p``."""
    return F.size(F.filter(F.array(*[F.lit(float(x)) for x in thresholds]), lambda x: x <= p))


def sweep(df: DataFrame, *keys: str, thresholds: list[float] | None = None) -> DataFrame:
    """Headline scores at every threshold, per ``keys``; at those of the grid, or of a list,
    of which repeated ones count once."""
    if thresholds is not None:
        thresholds = sorted({float(x) for x in thresholds})
        if not thresholds or thresholds[0] <= 0 or thresholds[-1] > 1:
            raise ValueError("thresholds must lie above 0 and up to 1")
    t, winner = F.col("target"), F.when(F.col("p1") >= F.col("p2"), 1).otherwise(2)
    own = F.col("class_id") > 0
    marked = df.select(*keys, "sample_id", "class_id", (place_on_grid(F.col("p1") + F.col("p2")) if thresholds is None else place_in_list(F.col("p1") + F.col("p2"), thresholds)).alias("k"), (t > 0).alias("t"), (t == F.col("class_id")).alias("o"), (winner == F.col("class_id")).alias("w"))
    by = [*keys, "sample_id", "class_id"]
    steps = marked.groupBy(*by, "k").agg(
        F.count_if("t").alias("tp"), F.count_if(~F.col("t")).alias("fp"), F.count("*").alias("n"),
        F.count_if(F.col("o") & F.col("w") & own).alias("otp"), F.count_if(~F.col("o") & F.col("w") & own).alias("ofp"), F.count_if(F.col("o") & own).alias("os"),
    )
    mine = Window.partitionBy(*by)  # the pixels of one image
    high = mine.orderBy(F.desc("k")).rowsBetween(Window.unboundedPreceding, 0)
    run = steps.select(
        *by, "k", *[F.sum(c).over(high).alias(c) for c in ("tp", "fp", "otp", "ofp")], F.sum("n").over(high).alias("fg"), F.sum("n").over(mine).alias("n"), F.sum("tp").over(mine).alias("pos"),
        F.sum("os").over(mine).alias("opos"), F.coalesce(F.lead("k").over(mine.orderBy(F.desc("k"))), F.lit(0)).alias("below"), F.max("k").over(mine).alias("top"),
    )
    last = LAST - FIRST + 1 if thresholds is None else len(thresholds)
    label = (F.col("j") + FIRST - 1) / F.lit(100.0) if thresholds is None else F.element_at(F.array(*[F.lit(x) for x in thresholds]), F.col("j").cast("int"))
    values = {
        "e": F.when(F.col("class_id") == 0, (F.col("fg") == 0).cast("double")), "s": F.when(F.col("class_id") == 0, 1 - safe("fg", "n")),
        "b": F.when(own, dice("tp", "fp", F.col("pos") - F.col("tp"))), "c": F.when(own, dice("otp", "ofp", F.col("opos") - F.col("otp"))),
    }
    filled = run.filter("k > below").select(*keys, "class_id", (F.col("below") + 1).alias("lo"), F.col("k").alias("hi"), *[v.alias(n) for n, v in values.items()])
    none = run.filter((F.col("k") == F.col("top")) & (F.col("top") < last)).withColumns({c: F.lit(0) for c in ("tp", "fp", "otp", "ofp", "fg")})
    filled = filled.unionByName(none.select(*keys, "class_id", (F.col("top") + 1).alias("lo"), F.lit(last).alias("hi"), *[v.alias(n) for n, v in values.items()]))
    ends = F.explode(F.array(F.struct(F.col("lo").alias("j"), F.lit(1.0).alias("sign")), F.struct((F.col("hi") + 1).alias("j"), F.lit(-1.0).alias("sign"))))
    changes = filled.select(*keys, "class_id", *values, ends.alias("d"))
    sums = changes.groupBy(*keys, "class_id", "d.j").agg(*[F.sum(F.col(n) * F.col("d.sign")).alias(n) for n in values], *[F.sum(F.when(F.col(n).isNotNull(), F.col("d.sign"))).alias(f"{n}n") for n in values])
    # a few hundred rows from here on: classes times thresholds
    every = sums.select(*keys, "class_id").distinct().withColumn("j", F.explode(F.sequence(F.lit(1), F.lit(last))))
    full = every.join(sums, [*keys, "class_id", "j"], "left")
    along = Window.partitionBy(*keys, "class_id").orderBy("j").rowsBetween(Window.unboundedPreceding, 0)
    means = full.select(*keys, "class_id", "j", *[safe(F.sum(n).over(along), F.round(F.sum(f"{n}n").over(along))).alias(n) for n in values])
    pick = lambda c, k: F.max(F.when(F.col("class_id") == k, F.col(c)))
    wide = means.groupBy(*keys, label.alias("threshold")).agg(
        pick("e", 0).alias("d_n"), pick("s", 0).alias("d_n_soft"), pick("b", 1).alias("d_b_bin"), pick("b", 2).alias("d_m_bin"), pick("c", 1).alias("d_b_cls"), pick("c", 2).alias("d_m_cls")
    )
    cls = balanced_mean("d_b_cls", "d_m_cls")
    return wide.select(
        "*", balanced_mean("d_n", "d_b_bin", "d_m_bin").alias("d_bin_bal"), cls.alias("d_cls_bal"),
        balanced_mean(balanced_mean("d_n", "d_b_bin", "d_m_bin"), cls).alias("s_bal"), balanced_mean(balanced_mean("d_n_soft", "d_b_bin", "d_m_bin"), cls).alias("s_bal_soft"),
    )


def best_threshold(swept: DataFrame, metric: str = "s_bal", tolerance: float = 1e-9, *keys: str) -> DataFrame:
    """Of the thresholds within ``tolerance`` of the best score the one with the best
    score on normal samples, then the highest."""
    top = Window.partitionBy(*[F.col(k) for k in keys]) if keys else Window.partitionBy(F.lit(0))
    near = swept.withColumn("__best", F.max(metric).over(top)).filter(F.col("__best") - F.col(metric) <= tolerance)
    order = top.orderBy(F.desc("d_n"), F.desc("threshold"))
    return near.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__best")


def best_checkpoint(best: DataFrame, name: str, tolerance: float = 1e-4) -> DataFrame:
    """Of the checkpoints (one row each, at its own threshold) within ``tolerance`` of the
    best score the one best on normal samples, then of the highest threshold, then the last
    by name. Checkpoints are few, so one task picks."""
    every = Window.partitionBy(F.lit(0))
    near = best.withColumn("__best", F.max("s_bal").over(every)).filter(F.col("__best") - F.col("s_bal") <= tolerance)
    order = every.orderBy(F.desc("d_n"), F.desc("threshold"), F.col(name).cast("string").desc())
    return near.withColumn("__r", F.row_number().over(order)).filter("__r = 1").drop("__r", "__best")
