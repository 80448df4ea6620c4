"""Evaluation queries over the pixels view, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.operators import metrics as m
from maskmill.operators import sweep as sw
from maskmill.plans.views import ALL_PIXELS_SQL, PIXELS_SQL, pixels
from maskmill.runtime import table


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    """Doubles rounded, so that the order of summation does not show."""
    return df.select(*[F.round(c, digits).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def label_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows with a class label outside 0..2 (quantity taken as a label): the label check."""
    bad = m.validate_labels(table(spark, sf_dir, "lineitem").withColumn("label", F.col("l_quantity") / 10), "label")
    return bad.groupBy("l_returnflag").agg(F.count("*").alias("bad_rows"))


def prob_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Probability check on weights not yet normalized, and what is left after it."""
    good = pixels(spark, sf_dir)
    skewed = good.withColumns({"p0": F.when(F.col("sample_id") % 7 == 0, F.col("p0") * 1.01).otherwise(F.col("p0")), "p1": F.when(F.col("sample_id") % 11 == 0, -F.col("p1")).otherwise(F.col("p1"))})
    bad = m.validate_probabilities(skewed)
    return bad.groupBy("class_id").agg(F.count("*").alias("bad_pixels"), F.countDistinct("sample_id").alias("bad_samples"))


def normalized_probabilities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean probabilities per class after those that do not sum to one were brought to it."""
    skewed = pixels(spark, sf_dir).withColumns({f"p{k}": F.when(F.col("sample_id") % 7 == 0, F.col(f"p{k}") * (1 + 0.0005 * k)).otherwise(F.col(f"p{k}")) for k in range(3)})
    return rounded(m.normalized(skewed).groupBy("class_id").agg(*[F.avg(f"p{k}").alias(f"p{k}") for k in range(3)], F.max(F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1)).alias("off")))


def target_diagnosis_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples whose target disagrees with their class."""
    return m.inferred_classes(pixels(spark, sf_dir, every_sample=True)).filter("NOT agrees").select("sample_id", "class_id", "inferred_class")


def pixel_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.confusion(pixels(spark, sf_dir))


def sample_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.confusion(pixels(spark, sf_dir), "sample_id")


def per_sample_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.per_image(m.per_sample(pixels(spark, sf_dir))))


def predicted_diagnosis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.diagnosis_confusion(m.per_sample(pixels(spark, sf_dir)))


def diagnosis_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.accuracy(m.per_sample(pixels(spark, sf_dir))))


def headline_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.headline(m.per_image(m.per_sample(pixels(spark, sf_dir)))))


def micro_macro_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.micro_macro(m.per_sample(pixels(spark, sf_dir))))


def fg_fraction_p95(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact 95th percentile of the predicted lesion fraction of normal samples."""
    per = m.per_sample(pixels(spark, sf_dir)).filter("class_id = 0")
    return rounded(per.agg(F.expr("percentile(predicted_fraction, 0.95)").alias("p95"), F.avg("predicted_fraction").alias("mean"), F.max("predicted_fraction").alias("largest")))


def brier_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.brier(pixels(spark, sf_dir)))


def calibration_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.calibration_bins(pixels(spark, sf_dir)))


def ece_binary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.expected_calibration_error(m.calibration_bins(pixels(spark, sf_dir), "binary")))


def ece_multiclass(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.expected_calibration_error(m.calibration_bins(pixels(spark, sf_dir))))


def quartile_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline scores per size quartile of the sample (its number of lesion pixels)."""
    per = m.per_sample(pixels(spark, sf_dir))
    size = (F.col("tp") + F.col("fn")).cast("int")
    quartile = F.when(F.col("class_id") == 0, 0).otherwise(F.least(size, F.lit(4)))
    images = m.per_image(per).join(per.select("sample_id", quartile.alias("lesion_size_quartile")), "sample_id")
    return rounded(m.headline(images, "lesion_size_quartile"))


def class_pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return m.class_pixel_counts(pixels(spark, sf_dir))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.class_weights(m.class_pixel_counts(pixels(spark, sf_dir))))


def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(sw.sweep(pixels(spark, sf_dir)))


def _best(swept: DataFrame, tolerance: float, *keys: str) -> DataFrame:
    """The chosen threshold by hard and by soft score, from one pass over the sweep."""
    scores = F.explode(F.array(*[F.struct(F.lit(x).alias("metric"), F.col(x).alias("score")) for x in ("s_bal", "s_bal_soft")]))
    long = swept.select("*", scores.alias("m")).select(*swept.columns, "m.metric", "m.score")
    return sw.best_threshold(long, "score", tolerance, *keys, "metric")


def best_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The threshold chosen by hard and by soft score."""
    swept = rounded(sw.sweep(pixels(spark, sf_dir)), 9)
    return rounded(_best(swept, 1e-7).select("metric", "threshold", "d_n", "s_bal", "s_bal_soft"))


def listed_thresholds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores at thresholds that the caller lists, one of them twice."""
    return rounded(sw.sweep(pixels(spark, sf_dir), thresholds=[0.5, 0.25, 0.375, 0.5, 0.9, 1.0]))


def winner_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of an evaluation at the threshold that the hard score chose."""
    base = pixels(spark, sf_dir)
    chosen = _best(rounded(sw.sweep(base), 9), 1e-7).filter("metric = 's_bal'").first()["threshold"]  # one row
    return rounded(m.evaluate(base, threshold=chosen))


def evaluation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of an evaluation at 0.5, with samples given twice refused."""
    return rounded(m.evaluate(pixels(spark, sf_dir, numbered=True), ("pixel",)))


def _checkpoints(base: DataFrame) -> DataFrame:
    """Three checkpoints, each with other probabilities."""
    flat = {1: 0.0, 2: 0.1, 3: 0.25}
    mixes = F.explode(F.array(*[F.struct(F.lit(n).alias("checkpoint"), F.lit(a).alias("a")) for n, a in flat.items()]))
    return base.select("*", mixes.alias("c")).select(*base.columns, "c.*").withColumns({f"p{k}": (1 - F.col("a")) * F.col(f"p{k}") + F.col("a") / 3 for k in range(3)}).drop("a")


def checkpoint_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrate three checkpoints and take the one within 1e-4 of the best score that is
    best on normal samples, then of the highest threshold, then of the last name."""
    swept = rounded(sw.sweep(_checkpoints(pixels(spark, sf_dir)), "checkpoint"), 9)
    best = sw.best_threshold(swept, "s_bal", 1e-7, "checkpoint").select("checkpoint", "threshold", "s_bal", "d_n")
    return rounded(sw.best_checkpoint(best, "checkpoint", 1e-4))


def outer_test(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Calibrate three checkpoints on four folds of the samples and test the one chosen on
    the fifth, at its own threshold."""
    base = pixels(spark, sf_dir)
    outer = F.pmod(F.floor(F.col("sample_id") / 3), F.lit(5)) == 0
    mixed = _checkpoints(base)
    swept = rounded(sw.sweep(mixed.filter(~outer), "checkpoint"), 9)
    best = sw.best_threshold(swept, "s_bal", 1e-7, "checkpoint").select("checkpoint", "threshold", "s_bal", "d_n")
    chosen = sw.best_checkpoint(best, "checkpoint", 1e-4).first()  # one row
    tested = mixed.filter(outer & (F.col("checkpoint") == chosen["checkpoint"])).drop("checkpoint")
    scores = m.headline(m.per_image(m.per_sample(tested, chosen["threshold"])))
    return rounded(scores.select(F.lit(chosen["checkpoint"]).alias("checkpoint"), F.lit(chosen["threshold"]).alias("threshold"), *scores.columns))


def deep_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Losses of two stages, the first with flatter probabilities, and their mean at 0.3 to 0.7."""
    base = pixels(spark, sf_dir)
    first = base.withColumns({f"p{k}": 0.8 * F.col(f"p{k}") + 0.2 / 3 for k in range(3)})
    weights = m.class_weights(m.class_pixel_counts(base))
    return rounded(m.deep_supervision([m.losses(first, weights), m.losses(base, weights)], [0.3, 0.7]))


def macro_rule_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over samples of the two macro rules (classes in truth; lesion classes in either)."""
    classes = m.class_table(pixels(spark, sf_dir), "sample_id")
    names = ("dice", "iou", "recall", "precision")
    present = m.macro_present(classes, "sample_id").agg(F.count("*").alias("samples"), *[F.avg(n).alias(n) for n in names]).withColumn("rule", F.lit("present"))
    fore = m.macro_foreground(classes, "sample_id").agg(F.count("*").alias("samples"), *[F.avg(n).alias(n) for n in names]).withColumn("rule", F.lit("foreground"))
    return rounded(present.unionByName(fore))


def smoothed_per_class(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(m.per_class_smoothed(m.class_table(pixels(spark, sf_dir))))


def batch_mean_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Macro lesion scores computed per batch of 16 sample numbers, then averaged."""
    batched = pixels(spark, sf_dir).withColumn("batch", F.floor(F.col("sample_id") / 16))
    per = m.macro_foreground(m.class_table(batched, "batch"), "batch")
    return rounded(per.agg(F.count("*").alias("batches"), *[F.avg(n).alias(n) for n in ("dice", "iou", "recall", "precision")]))


def losses(spark: SparkSession, sf_dir: str) -> DataFrame:
    base = pixels(spark, sf_dir)
    return rounded(m.losses(base, m.class_weights(m.class_pixel_counts(base))))


def tta_average(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Softmax of logits of a view and of its mirror, averaged; still a distribution."""
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", *[F.col(c).cast("double") for c in ("l_quantity", "l_discount", "l_tax")])
    views = []
    for order in (("l_quantity", "l_discount", "l_tax"), ("l_tax", "l_discount", "l_quantity")):
        top = F.greatest(*order)
        ex = [F.exp(F.col(c) - top) for c in order]
        views.append([e / (ex[0] + ex[1] + ex[2]) for e in ex])
    mean = [((a + b) / 2).alias(f"q{i}") for i, (a, b) in enumerate(zip(views[0], reversed(views[1]), strict=True))]
    return rounded(lines.select("l_orderkey", *mean).groupBy("l_orderkey").agg(*[F.sum(f"q{i}").alias(f"q{i}") for i in range(3)], F.count("*").alias("pixels")))


def argmax_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pixels(spark, sf_dir).groupBy(m.arg_max().alias("prediction")).agg(F.count("*").alias("pixels"))


def dual_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline scores of two heads side by side; the second reads flattened probabilities."""
    one = pixels(spark, sf_dir).withColumn("head", F.lit("p1"))
    two = one.withColumns({f"p{k}": 0.8 * F.col(f"p{k}") + 0.2 / 3 for k in range(3)}).withColumn("head", F.lit("p2"))
    per = m.per_sample(one.unionByName(two), 0.5, "head")
    heads = m.per_image(per.withColumn("sample_id", F.struct("head", "sample_id"))).withColumn("head", F.col("sample_id.head"))
    return rounded(m.headline(heads, "head"))


def recorded_headline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headline scores of the recorded per-image table, per run; of repeated rows the
    one received last counts."""
    t = table(spark, sf_dir, "test_per_image")
    last = t.groupBy("run_id", "sample_id").agg(F.max(F.struct("received_at", "class_id", "normal_empty", "predicted_foreground_fraction", "binary_dice", "diagnosis_class_dice")).alias("r"))
    images = last.select("run_id", "r.class_id", "r.normal_empty", F.col("r.predicted_foreground_fraction").alias("predicted_fraction"), "r.binary_dice", F.col("r.diagnosis_class_dice").alias("class_dice"))
    scores = m.headline(images, "run_id")  # recorded values have five digits: the nudge settles exact ties
    return rounded(scores.select(*[(F.col(c) + 1e-9).alias(c) if t == "double" else F.col(c) for c, t in scores.dtypes]))


_PRED = "CASE WHEN p1 + p2 >= 0.5 THEN CASE WHEN p1 >= p2 THEN 1 ELSE 2 END ELSE 0 END"
_DICE = lambda tp, fp, fn: f"(CASE WHEN 2*{tp}+{fp}+{fn} <> 0 THEN 2.0*{tp}/(2*{tp}+{fp}+{fn}) END)"
_IOU = lambda tp, fp, fn: f"(CASE WHEN {tp}+{fp}+{fn} <> 0 THEN 1.0*{tp}/({tp}+{fp}+{fn}) END)"
_REC = lambda tp, fn: f"(CASE WHEN {tp}+{fn} <> 0 THEN 1.0*{tp}/({tp}+{fn}) END)"
_PRE = lambda tp, fp, fn: f"(CASE WHEN {tp}+{fp} = 0 THEN CASE WHEN {fn} > 0 THEN 0.0 END ELSE 1.0*{tp}/({tp}+{fp}) END)"


def _per_sample(source: str = "pixels", pred: str = _PRED, keys: str = "") -> str:
    k = keys and keys + ", "
    counts = ", ".join(f"count(*) FILTER (target = {c} AND p = {c}) AS tp{c}, count(*) FILTER (target <> {c} AND p = {c}) AS fp{c}, count(*) FILTER (target = {c} AND p <> {c}) AS fn{c}" for c in (1, 2))
    return f"""
pred AS (SELECT *, {pred} AS p FROM {source}),
counted AS (SELECT {k}sample_id, class_id, count(*) AS pixels, count(*) FILTER (target > 0 AND p > 0) AS tp, count(*) FILTER (target = 0 AND p > 0) AS fp,
  count(*) FILTER (target > 0 AND p = 0) AS fn, count(*) FILTER (target = 0 AND p = 0) AS tn, {counts} FROM pred GROUP BY {k}sample_id, class_id),
per AS (SELECT *, CASE class_id WHEN 1 THEN tp1 WHEN 2 THEN tp2 END AS otp, CASE class_id WHEN 1 THEN fp1 WHEN 2 THEN fp2 END AS ofp, CASE class_id WHEN 1 THEN fn1 WHEN 2 THEN fn2 END AS ofn,
  CASE WHEN tp1+fp1+tp2+fp2 = 0 THEN 0 WHEN tp1+fp1 >= tp2+fp2 THEN 1 ELSE 2 END AS predicted_diagnosis, 1.0*(tp+fp)/pixels AS predicted_fraction, 1.0*(tp+fn)/pixels AS true_fraction FROM counted),
images AS (SELECT {k}sample_id, class_id, predicted_diagnosis, CASE WHEN class_id = 0 THEN tp+fp = 0 END AS normal_empty, predicted_fraction, true_fraction,
  CASE WHEN class_id > 0 THEN {_DICE("tp", "fp", "fn")} END AS binary_dice, CASE WHEN class_id > 0 THEN {_IOU("tp", "fp", "fn")} END AS binary_iou,
  CASE WHEN class_id > 0 THEN {_PRE("tp", "fp", "fn")} END AS binary_precision, CASE WHEN class_id > 0 THEN {_REC("tp", "fn")} END AS binary_recall,
  {_DICE("otp", "ofp", "ofn")} AS class_dice, tp, fn FROM per)"""


def _headline(source: str, keys: str = "") -> str:
    k = keys and keys + ", "
    return f"""SELECT {k}samples, round(d_n, 6) AS d_n, round(d_n_soft, 6) AS d_n_soft, round(d_b_bin, 6) AS d_b_bin, round(d_m_bin, 6) AS d_m_bin, round(d_b_cls, 6) AS d_b_cls, round(d_m_cls, 6) AS d_m_cls,
  round((d_n+d_b_bin+d_m_bin)/3, 6) AS d_bin_bal, round((d_b_cls+d_m_cls)/2, 6) AS d_cls_bal, round(((d_n+d_b_bin+d_m_bin)/3+(d_b_cls+d_m_cls)/2)/2, 6) AS s_bal,
  round(((d_n_soft+d_b_bin+d_m_bin)/3+(d_b_cls+d_m_cls)/2)/2, 6) AS s_bal_soft
FROM (SELECT {k}count(*) AS samples, avg(CAST(normal_empty AS INT)) FILTER (class_id = 0) AS d_n, avg(1 - predicted_fraction) FILTER (class_id = 0) AS d_n_soft,
  avg(binary_dice) FILTER (class_id = 1) AS d_b_bin, avg(binary_dice) FILTER (class_id = 2) AS d_m_bin, avg(class_dice) FILTER (class_id = 1) AS d_b_cls, avg(class_dice) FILTER (class_id = 2) AS d_m_cls
  FROM {source} {"GROUP BY " + keys if keys else ""})"""


_PER = f"WITH {PIXELS_SQL},{_per_sample()}"
_ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"


def _classes(keys: str = "") -> str:
    k = keys and keys + ", "
    return f"""SELECT {k}c AS class, count(*) FILTER (target = c AND p = c) AS tp, count(*) FILTER (target <> c AND p = c) AS fp, count(*) FILTER (target = c AND p <> c) AS fn
FROM (SELECT *, {_ARGMAX} AS p FROM pixels) CROSS JOIN (VALUES (0), (1), (2)) v(c) GROUP BY {k}c"""


def _macro(source: str, keys: str, eps: str, where: str) -> str:
    return f"""SELECT {keys}, avg(2.0*tp/(2*tp+fp+fn+{eps})) AS dice, avg(tp/(tp+fp+fn+{eps})) AS iou, avg(tp/(tp+fn+{eps})) AS recall, avg(tp/(tp+fp+{eps})) AS precision FROM {source} WHERE {where} GROUP BY {keys}"""


_MEANS = ", ".join(f"round(avg({n}), 6) AS {n}" for n in ("dice", "iou", "recall", "precision"))
_SWEEP = f"""
grid AS (SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 100) r(i)),
swept AS (SELECT threshold, sample_id, class_id, count(*) AS pixels, count(*) FILTER (target > 0 AND p1+p2 >= threshold) AS tp, count(*) FILTER (target = 0 AND p1+p2 >= threshold) AS fp,
  count(*) FILTER (target > 0 AND p1+p2 < threshold) AS fn,
  count(*) FILTER (target = class_id AND p1+p2 >= threshold AND class_id = CASE WHEN p1 >= p2 THEN 1 ELSE 2 END) AS otp,
  count(*) FILTER (target <> class_id AND p1+p2 >= threshold AND class_id = CASE WHEN p1 >= p2 THEN 1 ELSE 2 END) AS ofp, count(*) FILTER (target = class_id) AS opos
  FROM pixels CROSS JOIN grid GROUP BY ALL),
scored AS (SELECT threshold, class_id, CASE WHEN class_id = 0 THEN tp+fp = 0 END AS normal_empty, 1.0*(tp+fp)/pixels AS predicted_fraction,
  CASE WHEN class_id > 0 THEN {_DICE("tp", "fp", "fn")} END AS binary_dice, CASE WHEN class_id > 0 THEN {_DICE("otp", "ofp", "(opos-otp)")} END AS class_dice FROM swept)"""
_BINS = """
conf AS (SELECT {conf} AS conf, CAST({ok} AS INT) AS ok FROM pixels),
bins AS (SELECT CAST(least(floor(conf * 15), 14) AS INT) AS bin, count(*) AS pixels, avg(conf) AS confidence, avg(ok) AS accuracy FROM conf GROUP BY 1)"""
_MULTI = _BINS.format(conf="greatest(p0, p1, p2)", ok=f"({_ARGMAX}) = target")
_BINARY = _BINS.format(conf="greatest(p1 + p2, 1 - (p1 + p2))", ok="(p1 + p2 >= 0.5) = (target <> 0)")
_ECE = "SELECT round(sum(pixels * abs(accuracy - confidence)) / sum(pixels), 6) AS ece FROM bins"
_SWEPT_COLUMNS = _headline("scored", "threshold").replace("samples, ", "", 1)
_CHECKPOINTS = f"""
mixes AS (SELECT * FROM (VALUES (1, 0.0::DOUBLE), (2, 0.1::DOUBLE), (3, 0.25::DOUBLE)) v(checkpoint, a)),
mixed AS (SELECT checkpoint, sample_id, class_id, target, (1-a)*p0 + a/3 AS p0, (1-a)*p1 + a/3 AS p1, (1-a)*p2 + a/3 AS p2 FROM pixels JOIN mixes ON true),{
    _SWEEP.replace("FROM pixels CROSS JOIN grid", "FROM mixed CROSS JOIN grid").replace("SELECT threshold, ", "SELECT checkpoint, threshold, ")
},
per_checkpoint AS ({_headline("scored", "checkpoint, threshold").replace(", 6)", ", 9)")}),
near AS (SELECT *, max(s_bal) OVER (PARTITION BY checkpoint) AS top FROM per_checkpoint QUALIFY top - s_bal <= 1e-7),
one_each AS (SELECT * FROM near QUALIFY row_number() OVER (PARTITION BY checkpoint ORDER BY d_n DESC, threshold DESC) = 1),
chosen AS (SELECT * FROM one_each WHERE (SELECT max(s_bal) FROM one_each) - s_bal <= 1e-4 ORDER BY d_n DESC, threshold DESC, CAST(checkpoint AS VARCHAR) DESC LIMIT 1)"""


def _report(source: str, pred: str, whole: bool = True) -> str:
    """All figures of an evaluation of ``source`` as (metric, value)."""
    names = {
        "h": "samples d_n d_n_soft d_b_bin d_m_bin d_b_cls d_m_cls d_bin_bal d_cls_bal s_bal s_bal_soft",
        "mm": "micro_dice micro_iou micro_precision micro_recall benign_dice malignant_dice macro_dice macro_iou macro_precision macro_recall area_ratio",
        "acc": "accuracy", "br": "brier_binary brier_multiclass", "eb": "ece_binary", "em": "ece_multiclass",
    }
    bins = lambda b, n: b.replace("conf AS", f"conf_{n} AS").replace("bins AS", f"bins_{n} AS").replace("FROM conf ", f"FROM conf_{n} ").replace("FROM pixels", f"FROM {source}")
    tables = f"""{_per_sample(source, pred)}, h AS ({_headline("images")}),
mm AS (SELECT * FROM (SELECT {_DICE("sum(tp)", "sum(fp)", "sum(fn)")} AS micro_dice, {_IOU("sum(tp)", "sum(fp)", "sum(fn)")} AS micro_iou, {_PRE("sum(tp)", "sum(fp)", "sum(fn)")} AS micro_precision, {_REC("sum(tp)", "sum(fn)")} AS micro_recall,
  {_DICE("sum(tp1)", "sum(fp1)", "sum(fn1)")} AS benign_dice, {_DICE("sum(tp2)", "sum(fp2)", "sum(fn2)")} AS malignant_dice, 1.0 * sum(tp + fp) / sum(tp + fn) AS area_ratio FROM per),
  (SELECT avg(binary_dice) AS macro_dice, avg(binary_iou) AS macro_iou, avg(binary_precision) AS macro_precision, avg(binary_recall) AS macro_recall FROM images)),
acc AS (SELECT avg(CAST(class_id = predicted_diagnosis AS INT)) AS accuracy FROM images),
br AS (SELECT avg(pow(p1 + p2 - CAST(target > 0 AS INT), 2)) AS brier_binary, avg(pow(p0 - CAST(target = 0 AS INT), 2) + pow(p1 - CAST(target = 1 AS INT), 2) + pow(p2 - CAST(target = 2 AS INT), 2)) AS brier_multiclass FROM {source}),{bins(_BINARY, "b")},{bins(_MULTI, "m")},
eb AS (SELECT sum(pixels * abs(accuracy - confidence)) / sum(pixels) AS ece_binary FROM bins_b), em AS (SELECT sum(pixels * abs(accuracy - confidence)) / sum(pixels) AS ece_multiclass FROM bins_m)
"""
    rows = " UNION ALL ".join(f"SELECT '{c}' AS metric, round(CAST({c} AS DOUBLE), 6) AS value FROM {t}" for t, cs in names.items() for c in cs.split())
    return (f"WITH {PIXELS_SQL}," if whole else "") + tables + rows


def _stages_sql() -> str:
    """The losses of both stages beside each other, and their weighted mean."""
    names = ("cross_entropy", "control_dice", "localization_dice", "localization_tversky", "class_dice", "control_loss", "composite_loss")
    stage = lambda n, source: f"""per_{n} AS (SELECT sample_id, sum(weight * -ln(CASE target WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS ce, sum(weight) AS w,
  sum((p1+p2) * CAST(target > 0 AS INT)) AS tp, sum((p1+p2) * CAST(target = 0 AS INT)) AS fp, sum((1-(p1+p2)) * CAST(target > 0 AS INT)) AS fn, max(CAST(target > 0 AS INT)) AS has,
  coalesce(sum(p1) FILTER (target = 1), 0) AS py1, sum(p1) AS p1s, count(*) FILTER (target = 1) AS y1s, coalesce(sum(p2) FILTER (target = 2), 0) AS py2, sum(p2) AS p2s, count(*) FILTER (target = 2) AS y2s FROM {source} JOIN wt USING (target) GROUP BY 1),
t_{n} AS (SELECT sum(ce)/sum(w) AS cross_entropy, 1 - avg(((2*py1+1e-5)/(p1s+y1s+1e-5) + (2*py2+1e-5)/(p2s+y2s+1e-5))/2) AS control_dice, 1 - avg((2*tp+1e-5)/(2*tp+fp+fn+1e-5)) FILTER (has > 0) AS localization_dice,
  1 - avg((tp+1e-5)/(tp+0.6*fp+0.4*fn+1e-5)) FILTER (has > 0) AS localization_tversky, ((1 - (2*sum(py1)+1e-5)/(sum(p1s)+sum(y1s)+1e-5)) + (1 - (2*sum(py2)+1e-5)/(sum(p2s)+sum(y2s)+1e-5)))/2 AS class_dice FROM per_{n}),
l_{n} AS (SELECT *, cross_entropy + control_dice AS control_loss, cross_entropy + 0.7*localization_dice + 0.3*class_dice AS composite_loss FROM t_{n})"""  # noqa: E731
    rounded_ = lambda f: ", ".join(f"round({f.format(c=c)}, 6) AS {c}" for c in names)
    return f"""WITH {PIXELS_SQL}, n AS (SELECT target, count(*) AS pixels FROM pixels GROUP BY 1), wt AS (SELECT target, pow((SELECT pixels FROM n WHERE target = 0) / pixels::DOUBLE, 0.5) AS weight FROM n),
flat AS (SELECT sample_id, target, 0.8*p0 + 0.2/3 AS p0, 0.8*p1 + 0.2/3 AS p1, 0.8*p2 + 0.2/3 AS p2 FROM pixels), {stage("a", "flat")}, {stage("b", "pixels")}
SELECT 'p1' AS stage, 0.3::DOUBLE AS weight, {rounded_("{c}")} FROM l_a UNION ALL SELECT 'p2', 0.7::DOUBLE, {rounded_("{c}")} FROM l_b
UNION ALL SELECT 'total', 1.0::DOUBLE, {rounded_("0.3 * l_a.{c} + 0.7 * l_b.{c}")} FROM l_a, l_b"""


SQL = {
    "label_violations": "SELECT l_returnflag, count(*) AS bad_rows FROM lineitem WHERE l_quantity / 10 <> floor(l_quantity / 10) OR l_quantity / 10 < 0 OR l_quantity / 10 >= 3 GROUP BY 1",
    "prob_validation": f"""WITH {PIXELS_SQL}, skewed AS (SELECT sample_id, class_id, CASE WHEN sample_id % 7 = 0 THEN p0 * 1.01 ELSE p0 END AS p0, CASE WHEN sample_id % 11 = 0 THEN -p1 ELSE p1 END AS p1, p2 FROM pixels)
SELECT class_id, count(*) AS bad_pixels, count(DISTINCT sample_id) AS bad_samples FROM skewed
WHERE p0 < -1e-6 OR p1 < -1e-6 OR p2 < -1e-6 OR p0 > 1+1e-6 OR p1 > 1+1e-6 OR p2 > 1+1e-6 OR abs(p0 + p1 + p2 - 1) > 1e-3 GROUP BY 1""",
    "normalized_probabilities": f"""WITH {PIXELS_SQL}, skewed AS (SELECT class_id, p0, CASE WHEN sample_id % 7 = 0 THEN p1 * 1.0005 ELSE p1 END AS p1, CASE WHEN sample_id % 7 = 0 THEN p2 * 1.001 ELSE p2 END AS p2 FROM pixels)
SELECT class_id, round(avg(p0 / (p0 + p1 + p2)), 6) AS p0, round(avg(p1 / (p0 + p1 + p2)), 6) AS p1, round(avg(p2 / (p0 + p1 + p2)), 6) AS p2, 0.0::DOUBLE AS off FROM skewed GROUP BY 1""",
    "target_diagnosis_check": f"""WITH {ALL_PIXELS_SQL} SELECT sample_id, min(class_id) AS class_id, CAST(max(target) AS INTEGER) AS inferred_class FROM pixels GROUP BY 1 HAVING max(target) <> min(class_id)""",
    "pixel_confusion": f"WITH {PIXELS_SQL} SELECT target, {_PRED} AS prediction, count(*) AS pixels FROM pixels GROUP BY 1, 2",
    "sample_confusion": f"WITH {PIXELS_SQL} SELECT sample_id, target, {_PRED} AS prediction, count(*) AS pixels FROM pixels GROUP BY 1, 2, 3",
    "per_sample_overlap": _PER + "SELECT sample_id, class_id, predicted_diagnosis, normal_empty, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("predicted_fraction", "true_fraction", "binary_dice", "binary_iou", "binary_precision", "binary_recall", "class_dice")) + " FROM images",
    "predicted_diagnosis": _PER + "SELECT class_id, predicted_diagnosis, count(*) AS samples FROM images GROUP BY 1, 2",
    "diagnosis_accuracy": _PER + "SELECT round(avg(CAST(class_id = predicted_diagnosis AS INT)), 6) AS accuracy, count(*) AS samples FROM images",
    "headline_scores": _PER + _headline("images"),
    "micro_macro_metrics": _PER + f"""SELECT round(micro_dice, 6) AS micro_dice, round(micro_iou, 6) AS micro_iou, round(micro_precision, 6) AS micro_precision, round(micro_recall, 6) AS micro_recall,
  round(benign_dice, 6) AS benign_dice, round(malignant_dice, 6) AS malignant_dice, round(macro_dice, 6) AS macro_dice, round(macro_iou, 6) AS macro_iou, round(macro_precision, 6) AS macro_precision,
  round(macro_recall, 6) AS macro_recall, round(area_ratio, 6) AS area_ratio FROM (
  SELECT {_DICE("sum(tp)", "sum(fp)", "sum(fn)")} AS micro_dice, {_IOU("sum(tp)", "sum(fp)", "sum(fn)")} AS micro_iou, {_PRE("sum(tp)", "sum(fp)", "sum(fn)")} AS micro_precision, {_REC("sum(tp)", "sum(fn)")} AS micro_recall,
  {_DICE("sum(tp1)", "sum(fp1)", "sum(fn1)")} AS benign_dice, {_DICE("sum(tp2)", "sum(fp2)", "sum(fn2)")} AS malignant_dice, 1.0 * sum(tp + fp) / sum(tp + fn) AS area_ratio FROM per),
  (SELECT avg(binary_dice) AS macro_dice, avg(binary_iou) AS macro_iou, avg(binary_precision) AS macro_precision, avg(binary_recall) AS macro_recall FROM images)""",
    "fg_fraction_p95": _PER + "SELECT round(quantile_cont(predicted_fraction, 0.95), 6) AS p95, round(avg(predicted_fraction), 6) AS mean, round(max(predicted_fraction), 6) AS largest FROM images WHERE class_id = 0",
    "brier_scores": f"""WITH {PIXELS_SQL} SELECT round(avg(pow(p1 + p2 - CAST(target > 0 AS INT), 2)), 6) AS brier_binary,
  round(avg(pow(p0 - CAST(target = 0 AS INT), 2) + pow(p1 - CAST(target = 1 AS INT), 2) + pow(p2 - CAST(target = 2 AS INT), 2)), 6) AS brier_multiclass FROM pixels""",
    "calibration_bins": f"WITH {PIXELS_SQL},{_MULTI} SELECT bin, pixels, round(confidence, 6) AS confidence, round(accuracy, 6) AS accuracy FROM bins",
    "ece_binary": f"WITH {PIXELS_SQL},{_BINARY} {_ECE}",
    "ece_multiclass": f"WITH {PIXELS_SQL},{_MULTI} {_ECE}",
    "quartile_metrics": _PER + _headline("(SELECT *, CAST(CASE WHEN class_id = 0 THEN 0 ELSE least(tp + fn, 4) END AS INTEGER) AS lesion_size_quartile FROM images)", "lesion_size_quartile"),
    "class_pixel_counts": f"WITH {PIXELS_SQL} SELECT target, count(*) AS pixels FROM pixels GROUP BY 1",
    "class_weights": f"WITH {PIXELS_SQL}, n AS (SELECT target, count(*) AS pixels FROM pixels GROUP BY 1) SELECT target, pixels, round(pow((SELECT pixels FROM n WHERE target = 0) / pixels::DOUBLE, 0.5), 6) AS weight FROM n",
    "threshold_sweep": f"WITH {PIXELS_SQL},{_SWEEP} {_SWEPT_COLUMNS}",
    "best_threshold": f"""WITH {PIXELS_SQL},{_SWEEP}, s AS ({_SWEPT_COLUMNS.replace(", 6)", ", 9)")}),
longer AS (SELECT 'hard' AS kind, 's_bal' AS metric, s_bal AS score, * FROM s UNION ALL SELECT 'soft', 's_bal_soft', s_bal_soft, * FROM s),
near AS (SELECT *, max(score) OVER (PARTITION BY metric) AS best FROM longer)
SELECT metric, threshold, round(d_n, 6) AS d_n, round(s_bal, 6) AS s_bal, round(s_bal_soft, 6) AS s_bal_soft FROM near WHERE best - score <= 1e-7
QUALIFY row_number() OVER (PARTITION BY metric ORDER BY d_n DESC, threshold DESC) = 1""",
    "listed_thresholds": f"WITH {PIXELS_SQL},{_SWEEP.replace('SELECT i / 100.0::DOUBLE AS threshold FROM range(5, 100) r(i)', 'SELECT unnest([0.25, 0.375, 0.5, 0.9, 1.0]::DOUBLE[]) AS threshold')} {_SWEPT_COLUMNS}",
    "checkpoint_selection": f"""WITH {PIXELS_SQL},{_CHECKPOINTS}
SELECT checkpoint, threshold, round(s_bal, 6) AS s_bal, round(d_n, 6) AS d_n FROM chosen""",
    "outer_test": f"""WITH {PIXELS_SQL.replace("pixels AS (", "every AS (")}, pixels AS (SELECT * FROM every WHERE (sample_id // 3) % 5 <> 0),{_CHECKPOINTS},
tested AS (SELECT checkpoint, threshold, sample_id, class_id, target, (1-a)*p0 + a/3 AS p0, (1-a)*p1 + a/3 AS p1, (1-a)*p2 + a/3 AS p2 FROM every JOIN chosen ON true JOIN mixes USING (checkpoint) WHERE (sample_id // 3) % 5 = 0),{_per_sample("tested", _PRED.replace("0.5", "threshold"), "checkpoint, threshold")} {_headline("images", "checkpoint, threshold")}""",
    "evaluation_report": _report("pixels", _PRED),
    "winner_metrics": f"""WITH {PIXELS_SQL},{_SWEEP}, s AS ({_SWEPT_COLUMNS.replace(", 6)", ", 9)")}),
best AS (SELECT threshold FROM s WHERE (SELECT max(s_bal) FROM s) - s_bal <= 1e-7 ORDER BY d_n DESC, threshold DESC LIMIT 1),
at_best AS (SELECT pixels.*, best.threshold AS cut_at FROM pixels JOIN best ON true),"""
    + _report("at_best", _PRED.replace("0.5", "cut_at"), whole=False),
    "deep_supervision": _stages_sql(),
    "macro_rule_metrics": f"""WITH {PIXELS_SQL}, classes AS ({_classes("sample_id")})
SELECT 'present' AS rule, count(*) AS samples, {_MEANS} FROM ({_macro("classes", "sample_id", "1e-15", "tp + fn > 0")})
UNION ALL SELECT 'foreground', count(*), {_MEANS} FROM ({_macro("classes", "sample_id", "1e-7", "class > 0 AND tp + fn + fp > 0")})""",
    "smoothed_per_class": f"WITH {PIXELS_SQL}, classes AS ({_classes()}) SELECT class, round((2.0*tp+1e-7)/(2*tp+fp+fn+1e-7), 6) AS dice, round((tp+1e-7)/(tp+fp+fn+1e-7), 6) AS iou FROM classes",
    "batch_mean_metrics": f"""WITH {PIXELS_SQL.replace("pixels AS (SELECT sample_id", "pixels AS (SELECT sample_id, CAST(floor(sample_id / 16) AS BIGINT) AS batch")}, classes AS ({_classes("batch")})
SELECT count(*) AS batches, {_MEANS} FROM ({_macro("classes", "batch", "1e-7", "class > 0 AND tp + fn + fp > 0")})""",
    "losses": f"""WITH {PIXELS_SQL}, n AS (SELECT target, count(*) AS pixels FROM pixels GROUP BY 1), wt AS (SELECT target, pow((SELECT pixels FROM n WHERE target = 0) / pixels::DOUBLE, 0.5) AS weight FROM n),
per AS (SELECT sample_id, sum(weight * -ln(CASE target WHEN 0 THEN p0 WHEN 1 THEN p1 ELSE p2 END)) AS ce, sum(weight) AS w,
  sum((p1+p2) * CAST(target > 0 AS INT)) AS tp, sum((p1+p2) * CAST(target = 0 AS INT)) AS fp, sum((1-(p1+p2)) * CAST(target > 0 AS INT)) AS fn, max(CAST(target > 0 AS INT)) AS has,
  sum(p1) FILTER (target = 1) AS a, coalesce(sum(p1) FILTER (target = 1), 0) AS py1, sum(p1) AS p1s, count(*) FILTER (target = 1) AS y1s,
  coalesce(sum(p2) FILTER (target = 2), 0) AS py2, sum(p2) AS p2s, count(*) FILTER (target = 2) AS y2s FROM pixels JOIN wt USING (target) GROUP BY 1),
t AS (SELECT sum(ce)/sum(w) AS ce, 1 - avg(((2*py1+1e-5)/(p1s+y1s+1e-5) + (2*py2+1e-5)/(p2s+y2s+1e-5))/2) AS control,
  1 - avg((2*tp+1e-5)/(2*tp+fp+fn+1e-5)) FILTER (has > 0) AS loc, 1 - avg((tp+1e-5)/(tp+0.6*fp+0.4*fn+1e-5)) FILTER (has > 0) AS tversky,
  ((1 - (2*sum(py1)+1e-5)/(sum(p1s)+sum(y1s)+1e-5)) + (1 - (2*sum(py2)+1e-5)/(sum(p2s)+sum(y2s)+1e-5)))/2 AS cls FROM per)
SELECT round(ce, 6) AS cross_entropy, round(control, 6) AS control_dice, round(loc, 6) AS localization_dice, round(tversky, 6) AS localization_tversky, round(cls, 6) AS class_dice,
  round(ce + control, 6) AS control_loss, round(ce + 0.7*loc + 0.3*cls, 6) AS composite_loss FROM t""",
    "tta_average": """WITH v AS (SELECT l_orderkey, exp(l_quantity - greatest(l_quantity, l_discount, l_tax)) AS a, exp(l_discount - greatest(l_quantity, l_discount, l_tax)) AS b, exp(l_tax - greatest(l_quantity, l_discount, l_tax)) AS c FROM lineitem)
SELECT l_orderkey, round(sum(a/(a+b+c)), 6) AS q0, round(sum(b/(a+b+c)), 6) AS q1, round(sum(c/(a+b+c)), 6) AS q2, count(*) AS pixels FROM v GROUP BY 1""",
    "argmax_counts": f"WITH {PIXELS_SQL} SELECT {_ARGMAX} AS prediction, count(*) AS pixels FROM pixels GROUP BY 1",
    "dual_head": f"WITH {PIXELS_SQL}, heads AS (SELECT 'p1' AS head, sample_id, class_id, target, p0, p1, p2 FROM pixels UNION ALL SELECT 'p2', sample_id, class_id, target, 0.8*p0 + 0.2/3, 0.8*p1 + 0.2/3, 0.8*p2 + 0.2/3 FROM pixels),{_per_sample('heads', keys='head')}"
    + _headline("images", "head"),
    "recorded_headline": "WITH r AS (SELECT *, predicted_foreground_fraction AS predicted_fraction, diagnosis_class_dice AS class_dice FROM test_per_image QUALIFY row_number() OVER (PARTITION BY run_id, sample_id ORDER BY received_at DESC) = 1) "
    + _headline("r", "run_id").replace(", 6)", " + 1e-9, 6)"),
}

_NAMES = (
    label_violations, prob_validation, normalized_probabilities, target_diagnosis_check, pixel_confusion, sample_confusion, per_sample_overlap, predicted_diagnosis, diagnosis_accuracy, headline_scores, micro_macro_metrics, fg_fraction_p95,
    brier_scores, calibration_bins, ece_binary, ece_multiclass, quartile_metrics, class_pixel_counts, class_weights, threshold_sweep, best_threshold, listed_thresholds, winner_metrics, evaluation_report, checkpoint_selection, outer_test, deep_supervision, macro_rule_metrics, smoothed_per_class,
    batch_mean_metrics, losses, tta_average, argmax_counts, dual_head, recorded_headline,
)
QUERIES = {f.__name__: f for f in _NAMES}
