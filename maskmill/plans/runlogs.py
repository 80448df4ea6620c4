"""Queries over the training log, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.functions.scalars import minutes_seconds
from maskmill.operators import runlog as r
from maskmill.plans.evaluation import rounded
from maskmill.runtime import table


def epochs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and epoch: of lines sent again the one received last (then the
    largest log_id). The score is one minus the training loss."""
    t = table(spark, sf_dir, "training").filter("run_id is not null and epoch is not null")
    keep = ["phase", "global_step", "elapsed_seconds", "train", "fit_regime"]
    last = t.groupBy("run_id", "epoch").agg(F.max_by(F.struct("log_id", "received_at", *keep), F.struct("received_at", "log_id")).alias("r"))
    return last.select("run_id", "epoch", "r.*").withColumn("score", 1 - F.col("train.loss"))


_EPOCHS = """epochs AS (SELECT run_id, epoch, phase, global_step, elapsed_seconds, train, fit_regime, 1 - train.loss AS score FROM training WHERE run_id IS NOT NULL AND epoch IS NOT NULL
  QUALIFY row_number() OVER (PARTITION BY run_id, epoch ORDER BY received_at DESC, log_id DESC) = 1)"""


def running_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.running_best(epochs(spark, sf_dir).select("run_id", "epoch", "score"), "score", "run_id"))


def top3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.top_three(epochs(spark, sf_dir).select("run_id", "epoch", "score"), "score", "run_id"))


def phase_of_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Epochs per phase by the boundaries 5 and 15 against the recorded phase."""
    got = epochs(spark, sf_dir).select(r.phase_of_epoch(F.col("epoch"), (5, 15)).alias("computed_phase"), "phase")
    return got.groupBy("computed_phase", "phase").agg(F.count("*").alias("epochs"))


def early_stop(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.early_stop(epochs(spark, sf_dir), "score", "run_id", patience=3))


def enters_top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.enters_top_three(epochs(spark, sf_dir), "score", "run_id")


def plateau_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.plateau_rate(epochs(spark, sf_dir), "score", "run_id"), 9)


def ema(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(r.moving_mean(epochs(spark, sf_dir), "score", "run_id"))


def cosine_lr(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = epochs(spark, sf_dir).select("epoch").distinct()
    return rounded(e.select("epoch", r.cosine_rate(F.col("epoch"), 40, 1e-3, 1e-6, 3).alias("learning_rate")), 9)


def epoch_gap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return r.epoch_gaps(epochs(spark, sf_dir).select("run_id", "epoch"), "run_id").select("run_id", "epoch", "place")


def fit_regime(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reading of the train/validation gap of each logged line that carries one."""
    t = table(spark, sf_dir, "training")
    whole = F.when(F.try_parse_json("fit_regime").isNotNull(), F.col("fit_regime"))
    train, valid = (F.get_json_object(whole, f"$.{k}_S_bal").try_cast("double") for k in ("train", "validation"))
    out = t.select("log_id", F.round(train - valid, 5).alias("gap")).filter("gap is not null")
    return out.select("log_id", "gap", r.fit_regime(F.col("gap")).alias("regime"))


def log_reconcile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Logs against a checkpoint table: the last epoch whose line carries a training loss."""
    e = epochs(spark, sf_dir)
    saved = e.filter("phase >= 1 and train.loss < 0.9").groupBy("run_id").agg(F.max("epoch").alias("epoch"))
    return r.reconcile(e, saved, "run_id")


def epoch_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean loss, gradient norm and share of clipped epochs per run, time as minutes and seconds."""
    e = epochs(spark, sf_dir)
    out = e.groupBy("run_id").agg(
        F.count("*").alias("epochs"), F.avg("train.loss").alias("loss"), F.avg("train.preclip_grad_norm").alias("grad_norm"), F.avg((F.col("train.preclip_grad_norm") > 5.0).cast("double")).alias("clipped"), F.max(F.floor("elapsed_seconds")).alias("t")
    )
    minutes, seconds = minutes_seconds(F.col("t"))
    return rounded(out.select("run_id", "epochs", (F.col("loss") + 1e-9).alias("loss"), (F.col("grad_norm") + 1e-9).alias("grad_norm"), (F.col("clipped") + 1e-9).alias("clipped"), minutes.alias("minutes"), seconds.alias("seconds")))


def learning_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Entries of the learning-rate map by parameter group."""
    t = table(spark, sf_dir, "training").select(F.explode("learning_rates").alias("part", "rate"))
    return rounded(t.groupBy("part").agg(F.count("*").alias("lines"), F.min("rate").alias("least"), F.max("rate").alias("most")), 9)


def late_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that arrived more than an hour after they were logged, and lines sent again."""
    t = table(spark, sf_dir, "training")
    late = F.col("received_at") > F.col("logged_at") + F.expr("INTERVAL 1 HOUR")
    return t.groupBy("phase").agg(F.count("*").alias("lines"), F.count_if(late).alias("late"), (F.count("*") - F.countDistinct("run_id", "epoch", "global_step")).alias("repeated"))


_ORDERED = "o AS (SELECT run_id, epoch, score, row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS n FROM epochs)"
_STEP_EARLY = """f AS (SELECT run_id, n, epoch, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS bad, score AS best FROM o WHERE n = 1
  UNION ALL SELECT o.run_id, o.n, o.epoch, CASE WHEN coalesce(o.score >= f.best + 0.002, f.best IS NULL AND o.score IS NOT NULL) THEN 0 ELSE f.bad + 1 END,
  CASE WHEN coalesce(o.score >= f.best + 0.002, f.best IS NULL AND o.score IS NOT NULL) THEN o.score ELSE f.best END FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)"""
_STEP_EMA = """f AS (SELECT run_id, n, epoch, score AS mean FROM o WHERE n = 1
  UNION ALL SELECT o.run_id, o.n, o.epoch, CASE WHEN o.score IS NULL THEN f.mean WHEN f.mean IS NULL THEN o.score ELSE 0.9::DOUBLE * f.mean + (1 - 0.9::DOUBLE) * o.score END FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)"""
_STEP_RATE = """f AS (SELECT run_id, n, epoch, score AS best, CASE WHEN score IS NULL THEN 1 ELSE 0 END AS bad, 0.001::DOUBLE AS rate FROM o WHERE n = 1
  UNION ALL SELECT o.run_id, o.n, o.epoch, CASE WHEN coalesce(o.score > f.best, f.best IS NULL AND o.score IS NOT NULL) THEN o.score ELSE f.best END,
  CASE WHEN coalesce(o.score > f.best, f.best IS NULL AND o.score IS NOT NULL) THEN 0 WHEN f.bad + 1 > 3 THEN 0 ELSE f.bad + 1 END,
  CASE WHEN NOT coalesce(o.score > f.best, f.best IS NULL AND o.score IS NOT NULL) AND f.bad + 1 > 3 THEN greatest(f.rate * 0.5, 1e-6) ELSE f.rate END FROM f JOIN o ON o.run_id = f.run_id AND o.n = f.n + 1)"""
SQL = {
    "running_best": f"""WITH {_EPOCHS}, b AS (SELECT *, max(score) OVER (PARTITION BY run_id ORDER BY epoch ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM epochs)
SELECT run_id, epoch, round(score, 6) AS score, coalesce(score > top, score IS NOT NULL) AS is_best, round(greatest(score, top), 6) AS best_so_far FROM b""",
    "top3": f"WITH {_EPOCHS}, p AS (SELECT run_id, epoch, score, CAST(row_number() OVER (PARTITION BY run_id ORDER BY score DESC NULLS LAST, epoch) AS INTEGER) AS place FROM epochs) SELECT run_id, epoch, round(score, 6) AS score, place FROM p WHERE place <= 3 AND score IS NOT NULL",
    "phase_of_epoch": f"WITH {_EPOCHS} SELECT CASE WHEN epoch <= 5 THEN 1 WHEN epoch <= 15 THEN 2 ELSE 3 END AS computed_phase, phase, count(*) AS epochs FROM epochs GROUP BY 1, 2",
    "early_stop": f"WITH RECURSIVE {_EPOCHS}, {_ORDERED}, {_STEP_EARLY} SELECT run_id, epoch, bad AS bad_epochs, round(best, 6) AS best, bad >= 3 AS stop FROM f",
    "enters_top_three": f"""WITH {_EPOCHS}, p AS (SELECT a.run_id, a.epoch, a.score, (SELECT list_sort(list(b.score))[-3:] FROM epochs b WHERE b.run_id = a.run_id AND b.epoch < a.epoch AND b.score IS NOT NULL) AS top FROM epochs a)
SELECT run_id, epoch, score IS NOT NULL AND (coalesce(len(top), 0) < 3 OR score > top[1]) AS enters FROM p""",
    "plateau_lr": f"WITH RECURSIVE {_EPOCHS}, {_ORDERED}, {_STEP_RATE} SELECT run_id, epoch, round(rate, 9) AS learning_rate FROM f",
    "ema": f"WITH RECURSIVE {_EPOCHS}, {_ORDERED}, {_STEP_EMA} SELECT run_id, epoch, round(mean, 6) AS mean FROM f",
    "cosine_lr": f"WITH {_EPOCHS} SELECT DISTINCT epoch, round(CASE WHEN epoch <= 3 THEN 0.001 * epoch / 3.0 ELSE 1e-6 + (0.001 - 1e-6) * 0.5 * (1 + cos(3.141592653589793 * least(greatest((epoch - 3) / 37.0, 0), 1))) END, 9) AS learning_rate FROM epochs",
    "epoch_gap": f"WITH {_EPOCHS}, p AS (SELECT run_id, epoch, CAST(row_number() OVER (PARTITION BY run_id ORDER BY epoch) AS INTEGER) AS place FROM epochs) SELECT * FROM p WHERE place <> epoch",
    "fit_regime": """WITH g AS (SELECT log_id, CASE WHEN json_valid(fit_regime) THEN fit_regime::JSON END AS j FROM training), d AS (SELECT log_id, round(TRY_CAST(j->>'$.train_S_bal' AS DOUBLE) - TRY_CAST(j->>'$.validation_S_bal' AS DOUBLE), 5) AS gap FROM g)
SELECT log_id, gap, CASE WHEN gap >= 0.30 THEN 'overfitting' WHEN gap <= 0.08 THEN 'underfitting' ELSE 'balanced' END AS regime FROM d WHERE gap IS NOT NULL""",
    "log_reconcile": f"""WITH {_EPOCHS}, l AS (SELECT run_id, max(epoch) AS log_epoch FROM epochs GROUP BY 1), c AS (SELECT run_id, max(epoch) AS checkpoint_epoch FROM epochs WHERE phase >= 1 AND train.loss < 0.9 GROUP BY 1)
SELECT run_id, log_epoch, checkpoint_epoch, CASE coalesce(log_epoch, 0) - coalesce(checkpoint_epoch, 0) WHEN 0 THEN 'equal' WHEN -1 THEN 'repair' WHEN 1 THEN 'roll_back' ELSE 'refuse' END AS action FROM l FULL JOIN c USING (run_id)""",
    "epoch_means": f"""WITH {_EPOCHS} SELECT run_id, count(*) AS epochs, round(avg(train.loss) + 1e-9, 6) AS loss, round(avg(train.preclip_grad_norm) + 1e-9, 6) AS grad_norm, round(avg(CAST(train.preclip_grad_norm > 5 AS INTEGER)) + 1e-9, 6) AS clipped,
  CAST(CAST(max(floor(elapsed_seconds)) AS BIGINT) // 60 AS INTEGER) AS minutes, CAST(CAST(max(floor(elapsed_seconds)) AS BIGINT) % 60 AS INTEGER) AS seconds FROM epochs GROUP BY 1""",
    "learning_rates": "WITH e AS (SELECT unnest(map_entries(learning_rates)) AS x FROM training) SELECT x.key AS part, count(*) AS lines, round(min(x.value), 9) AS least, round(max(x.value), 9) AS most FROM e GROUP BY 1",
    "late_lines": "SELECT phase, count(*) AS lines, count(*) FILTER (received_at > logged_at + INTERVAL 1 HOUR) AS late, count(*) - count(DISTINCT CASE WHEN run_id IS NOT NULL AND epoch IS NOT NULL AND global_step IS NOT NULL THEN (run_id, epoch, global_step) END) AS repeated FROM training GROUP BY 1",
}
_NAMES = (running_best, top3, phase_of_epoch, early_stop, enters_top_three, plateau_lr, ema, cosine_lr, epoch_gap, fit_regime, log_reconcile, epoch_means, learning_rates, late_lines)
QUERIES = {f.__name__: f for f in _NAMES}
