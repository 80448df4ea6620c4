"""Ordered analytics over run logs: one row per (run, epoch).

What a frame can express is a window per run. Rules with memory (early stop, plateau,
top three, exponential means) read the epochs of a run in order and keep a few values:
runs are put in order on their partitions, and the rows stream through, so a run of any
length needs no more memory than one row. A rule that depends on all epochs before is
sequential, so one run is one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema


def latest_lines(df: DataFrame, received: str, *keys: str) -> DataFrame:
    """Of lines sent again the one received last; lines without a key are no epoch."""
    held = df.filter(" and ".join(f"{k} is not null" for k in keys))
    rest = [c for c in df.columns if c not in (*keys, received)]
    last = held.groupBy(*keys).agg(F.max_by(F.struct(received, *rest), F.struct(received, *[c for c in ("log_id",) if c in rest])).alias("r"))
    return last.select(*keys, f"r.{received}", *[f"r.{c}" for c in rest])


#: Epochs of a run that one task orders where a window can be split.
BLOCK = 10_000


def _carried(df: DataFrame, keys: tuple, figure: Column, carry: Callable[[str], Column], block: int) -> tuple[DataFrame, Window]:
    """Rows with ``__block`` and ``__carried``, a figure carried over all earlier blocks of
    epochs of the run, and the window of the rows before within a block. So the epochs of a
    hot run are ordered by many tasks."""
    blocked = df.withColumn("__block", F.coalesce(F.floor(F.col("epoch") / block), F.lit(-(1 << 40))).cast("long"))
    per = blocked.groupBy(*keys, "__block").agg(figure.alias("__figure"))
    earlier = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    carried = per.withColumn("__carried", carry("__figure").over(earlier)).drop("__figure")
    on = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in (*keys, "__block")]
    joined = blocked.alias("a").join(carried.alias("b"), on).select("a.*", "b.__carried")
    return joined, Window.partitionBy(*keys, "__block").orderBy("epoch").rowsBetween(Window.unboundedPreceding, -1)


def running_best(df: DataFrame, score: str, *keys: str, block: int = BLOCK) -> DataFrame:
    """Whether an epoch is strictly better than all before it, and the best so far."""
    rows, before = _carried(df, keys, F.max(score), F.max, block)
    top = F.greatest(F.max(score).over(before), F.col("__carried"))
    better = F.coalesce(F.col(score) > top, F.col(score).isNotNull())
    return rows.withColumns({"is_best": better, "best_so_far": F.greatest(F.col(score), top)}).drop("__block", "__carried")


def top_three(df: DataFrame, score: str, *keys: str) -> DataFrame:
    """Best three epochs of a run, ties to the earlier one."""
    order = Window.partitionBy(*keys).orderBy(F.desc_nulls_last(score), "epoch")
    return df.withColumn("place", F.row_number().over(order)).filter((F.col("place") <= 3) & F.col(score).isNotNull())


def _streamed(df: DataFrame, score: str, keys: tuple, rule: Callable[[], Callable], results: str, extra: tuple = ()) -> DataFrame:
    """``rule()`` starts a run and gives a function of (epoch, score, extra..) that returns
    the results of an epoch; rows of a run arrive in the order of epochs."""
    slim = df.select(*keys, F.col("epoch").cast("int").alias("epoch"), F.col(score).cast("double").alias("__score"), *extra)
    ordered = slim.repartition(*keys).sortWithinPartitions(*keys, "epoch")
    n, fields = len(keys), T._parse_datatype_string(results)
    types = to_arrow_schema(fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, step = None, None
        for b in batches:
            columns = [c.to_pylist() for c in b.columns]
            out = []
            for row in zip(*columns, strict=True):
                if step is None or row[:n] != current:
                    current, step = row[:n], rule()
                out.append(step(*row[n:]))
            arrays = [pa.array([r[i] for r in out], f.type) for i, f in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*b.columns[: n + 1], *arrays], names=[*keys, "epoch", *types.names])

    kinds = ", ".join(f"`{k}` {slim.schema[k].dataType.simpleString()}" for k in keys)
    return ordered.mapInArrow(run, f"{kinds}, epoch int, {results}")


def early_stop(df: DataFrame, score: str, *keys: str, min_improvement: float = 0.002, patience: int = 12) -> DataFrame:
    """Bad-epoch counter: an epoch at least ``min_improvement`` above the best resets it
    and becomes the best; any other counts. Null scores count as bad."""

    def rule():
        best, bad = None, 0

        def step(_, x):
            nonlocal best, bad
            if x is not None and (best is None or x >= best + min_improvement):
                best, bad = x, 0
            else:
                bad += 1
            return bad, best, bad >= patience

        return step

    return _streamed(df, score, keys, rule, "bad_epochs int, best double, stop boolean")


def enters_top_three(df: DataFrame, score: str, *keys: str) -> DataFrame:
    """Whether a score enters the three best so far: fewer than three, or above the least."""

    def rule():
        top: list[float] = []

        def step(_, x):
            enters = x is not None and (len(top) < 3 or x > top[0])
            if enters:
                top.append(x)
                top.sort()
                del top[:-3]
            return (enters,)

        return step

    return _streamed(df, score, keys, rule, "enters boolean")


def plateau_rate(df: DataFrame, score: str, *keys: str, rate: float = 1e-3, factor: float = 0.5, patience: int = 3, floor: float = 1e-6, phase: str | None = None) -> DataFrame:
    """Learning rate that is multiplied by ``factor`` after more than ``patience`` epochs
    without a strictly better score, never below ``floor``; our own rule, stated here.
    With ``phase``, a change of that column starts it anew."""

    def rule():
        best, bad, now, last = None, 0, rate, None

        def step(_, x, part=None):
            nonlocal best, bad, now, last
            if part != last:
                best, bad, now, last = None, 0, rate, part
            if x is not None and (best is None or x > best):
                best, bad = x, 0
            else:
                bad += 1
            if bad > patience:
                now, bad = max(now * factor, floor), 0
            return (now,)

        return step

    return _streamed(df, score, keys, rule, "learning_rate double", (phase,) if phase else ())


def moving_mean(df: DataFrame, score: str, *keys: str, decay: float = 0.9) -> DataFrame:
    """Exponential mean s = d*s + (1-d)*x from the first value on; nulls keep the state."""

    def rule():
        mean = None

        def step(_, x):
            nonlocal mean
            if x is not None:
                mean = x if mean is None else decay * mean + (1 - decay) * x
            return (mean,)

        return step

    return _streamed(df, score, keys, rule, "mean double")


def phase_of_epoch(epoch: Column, ends: tuple[int, ...]) -> Column:
    """Phase from the last epochs of all but the last phase."""
    out = F.lit(len(ends) + 1)
    for i, end in reversed(list(enumerate(ends, 1))):
        out = F.when(epoch <= end, i).otherwise(out)
    return F.when(epoch.isNotNull(), out)


def cosine_rate(epoch: Column, total: int, base: float, least: float = 0.0, warmup: int = 0) -> Column:
    """Linear warm-up, then half a cosine down to ``least``."""
    progress = (epoch - warmup) / float(max(1, total - warmup))
    clipped = F.least(F.greatest(progress, F.lit(0.0)), F.lit(1.0))
    down = least + (base - least) * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * clipped))
    return F.when(epoch <= warmup, base * epoch / float(max(1, warmup))).otherwise(down) if warmup else down


def epoch_gaps(df: DataFrame, *keys: str, block: int = BLOCK) -> DataFrame:
    """Epochs whose number is not their place: the log is not 1..n."""
    rows, before = _carried(df, keys, F.count(F.lit(1)), F.sum, block)
    place = (F.count(F.lit(1)).over(before) + F.coalesce("__carried", F.lit(0)) + 1).cast("int")
    return rows.withColumn("place", place).filter(F.col("place") != F.col("epoch")).drop("__block", "__carried")


def reconcile(log: DataFrame, checkpoint: DataFrame, *keys: str) -> DataFrame:
    """What to do with a log against its checkpoint: equal, one behind (repair from the
    checkpoint), one ahead (roll the last line back); anything else is refused."""
    last = log.groupBy(*keys).agg(F.max("epoch").alias("log_epoch"))
    both = last.join(checkpoint.select(*keys, F.col("epoch").alias("checkpoint_epoch")), list(keys), "full")
    ahead = F.coalesce("log_epoch", F.lit(0)) - F.coalesce("checkpoint_epoch", F.lit(0))
    return both.withColumn("action", F.when(ahead == 0, "equal").when(ahead == -1, "repair").when(ahead == 1, "roll_back").otherwise("refuse"))


def repaired(log: DataFrame, checkpoint: DataFrame, *keys: str) -> tuple[DataFrame, DataFrame]:
    """(log, orphans) after ``reconcile``: a log one behind gets the line its checkpoint
    holds, one ahead loses its last line, which goes to the orphans. Runs that are refused
    keep their log, for the caller to see in ``reconcile``.

    ``checkpoint`` has one row a run: the keys, epoch and the columns of a log line.
    """
    plan = reconcile(log, checkpoint, *keys).select(*[F.col(k).alias(f"__{k}") for k in keys], "log_epoch", "action")
    marked = log.join(plan, [F.col(k) == F.col(f"__{k}") for k in keys])  # one row a run: broadcast by size, else AQE splits hot runs
    ahead = (F.col("action") == "roll_back") & (F.col("epoch") == F.col("log_epoch"))
    kept = marked.filter(~ahead).select(*log.columns)
    missing = checkpoint.join(plan.filter("action = 'repair'"), [F.col(k) == F.col(f"__{k}") for k in keys]).select(*log.columns)
    return kept.unionByName(missing), marked.filter(ahead).select(*log.columns)


def fit_regime(gap: Column, high: float = 0.30, low: float = 0.08) -> Column:
    """Reading of the gap between training and validation score."""
    return F.when(gap.isNull(), F.lit(None).cast("string")).when(gap >= high, "overfitting").when(gap <= low, "underfitting").otherwise("balanced")
