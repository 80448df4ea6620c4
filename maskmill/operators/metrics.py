"""Sample-aware evaluation of class probabilities per pixel.

Input is a long table (sample_id, class_id, target, p0, p1, p2): the class of the
sample (0 has no lesion), the true class of the pixel and its probabilities. All
aggregates are one shuffle by sample, with partial aggregation before it, and one tiny
one over samples; nothing is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from maskmill.functions.ratios import balanced_mean, dice, iou, precision, recall, safe


def decide(threshold: float = 0.5) -> Column:
    """Class of a pixel: the likelier lesion class (the first on a tie) where lesion is
    probable enough, else background. The lesion probability is p1 + p2, never 1 - p0."""
    return F.when(F.col("p1") + F.col("p2") >= threshold, F.when(F.col("p1") >= F.col("p2"), 1).otherwise(2)).otherwise(0)


def arg_max() -> Column:
    """Plain most probable class, the first on a tie."""
    probs = F.array("p0", "p1", "p2")
    return (F.array_position(probs, F.array_max(probs)) - 1).cast("int")


def validate_labels(df: DataFrame, label: str = "target", classes: int = 3) -> DataFrame:
    """Rows whose label is no integer in 0..classes-1."""
    c = F.col(label).cast("double")
    return df.filter(c.isNull() | (c != F.floor(c)) | (c < 0) | (c >= classes))


def validate_probabilities(df: DataFrame, tolerance: float = 1e-6, sum_tolerance: float = 1e-3) -> DataFrame:
    """Rows whose probabilities are not finite, leave [0, 1] or do not sum to one."""
    bad = F.lit(False)
    for c in ("p0", "p1", "p2"):
        x = F.col(c)
        bad |= x.isNull() | F.isnan(x) | (x < -tolerance) | (x > 1 + tolerance)
    return df.filter(bad | (F.abs(F.col("p0") + F.col("p1") + F.col("p2") - 1) > sum_tolerance))


def normalized(df: DataFrame) -> DataFrame:
    total = F.col("p0") + F.col("p1") + F.col("p2")
    return df.withColumns({c: F.col(c) / total for c in ("p0", "p1", "p2")})


def repeated_ids(df: DataFrame, *pixel: str) -> DataFrame:
    """Samples that are given twice: a pixel (``pixel`` columns) that stands more than once."""
    return df.groupBy("sample_id", *pixel).agg(F.count("*").alias("copies")).filter("copies > 1").groupBy("sample_id").agg(F.max("copies").alias("copies"))


def evaluate(df: DataFrame, pixel: tuple[str, ...] = (), threshold: float = 0.5, bins: int = 15) -> DataFrame:
    """Everything of one evaluation as (metric, value): headline, pooled and mean ratios,
    accuracy, Brier and calibration scores of probabilities per pixel.

    With ``pixel`` a sample that is given twice is an error, raised when the result is read.
    """
    if pixel:
        own = Window.partitionBy("sample_id", *pixel)
        df = df.withColumn("__copies", F.count("*").over(own))
        wrong = F.raise_error(F.concat(F.lit("repeated sample "), F.col("sample_id").cast("string"))).cast("double")
        df = df.withColumn("p0", F.when(F.col("__copies") > 1, wrong).otherwise(F.col("p0"))).drop("__copies")
    per = per_sample(df, threshold)
    ece = [expected_calibration_error(calibration_bins(df, kind, bins)).select(F.col("ece").alias(f"ece_{kind}")) for kind in ("binary", "multiclass")]
    tables = [headline(per_image(per)), micro_macro(per), accuracy(per).drop("samples"), brier(df), *ece]
    out = None
    for t in tables:  # one row each
        long = t.select(F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in t.columns])).alias("m")).select("m.*")
        out = long if out is None else out.unionByName(long)
    return out


def deep_supervision(stages: list[DataFrame], weights: list[float]) -> DataFrame:
    """Losses of several stages (one row each, from ``losses``) and their weighted mean; the
    weights are brought to a sum of one."""
    if not weights or min(weights) < 0 or sum(weights) <= 0:
        raise ValueError("weights must be non-negative with a positive sum")
    rows = None
    for i, (stage, w) in enumerate(zip(stages, weights, strict=True), 1):
        one = stage.select(F.lit(f"p{i}").alias("stage"), F.lit(w / sum(weights)).alias("weight"), *stage.columns)
        rows = one if rows is None else rows.unionByName(one)
    names = stages[0].columns
    total = rows.agg(*[F.sum(F.col("weight") * F.col(c)).alias(c) for c in names]).select(F.lit("total").alias("stage"), F.lit(1.0).alias("weight"), *names)
    return rows.unionByName(total)


def inferred_classes(df: DataFrame) -> DataFrame:
    """Class of each sample from its target, and whether it agrees with the stated one.

    No lesion pixel means class 0; two lesion classes in one sample are an error (NULL).
    """
    lo, hi = F.min(F.when(F.col("target") > 0, F.col("target"))), F.max(F.when(F.col("target") > 0, F.col("target")))
    found = df.groupBy("sample_id").agg(F.min("class_id").alias("class_id"), lo.alias("lo"), hi.alias("hi"))
    inferred = F.when(F.col("lo").isNull(), 0).when(F.col("lo") == F.col("hi"), F.col("lo")).cast("int")
    return found.select("sample_id", "class_id", inferred.alias("inferred_class"), F.coalesce(inferred == F.col("class_id"), F.lit(False)).alias("agrees"))


def confusion(df: DataFrame, *keys: str, threshold: float = 0.5) -> DataFrame:
    """Pixels by (keys, target, prediction)."""
    return df.select(*keys, "target", decide(threshold).alias("prediction")).groupBy(*keys, "target", "prediction").agg(F.count("*").alias("pixels"))


def per_sample(df: DataFrame, threshold: float = 0.5, *keys: str) -> DataFrame:
    """One row per sample: lesion and per-class counts, fractions, predicted diagnosis."""
    t, p = F.col("target"), F.col("prediction")
    counts = {"tp": (t > 0) & (p > 0), "fp": (t == 0) & (p > 0), "fn": (t > 0) & (p == 0), "tn": (t == 0) & (p == 0)}
    for k in (1, 2):
        counts |= {f"tp{k}": (t == k) & (p == k), f"fp{k}": (t != k) & (p == k), f"fn{k}": (t == k) & (p != k)}
    pixels = df.withColumn("prediction", decide(threshold))
    out = pixels.groupBy(*keys, "sample_id", "class_id").agg(F.count("*").alias("pixels"), *[F.count_if(c).alias(n) for n, c in counts.items()])
    one, two = F.col("tp1") + F.col("fp1"), F.col("tp2") + F.col("fp2")
    own = [F.when(F.col("class_id") == 1, F.col(f"{x}1")).when(F.col("class_id") == 2, F.col(f"{x}2")).alias(f"own_{x}") for x in ("tp", "fp", "fn")]
    diagnosis = F.when((one == 0) & (two == 0), 0).when(one >= two, 1).otherwise(2)
    return out.select("*", *own, diagnosis.alias("predicted_diagnosis"), safe(F.col("tp") + F.col("fp"), "pixels").alias("predicted_fraction"), safe(F.col("tp") + F.col("fn"), "pixels").alias("true_fraction"))


def per_image(samples: DataFrame) -> DataFrame:
    """The per-image result table; overlap only where the sample has a lesion class."""
    lesion = F.col("class_id") > 0
    return samples.select(
        "sample_id", "class_id", "predicted_diagnosis", F.when(~lesion, F.col("tp") + F.col("fp") == 0).alias("normal_empty"),
        F.col("predicted_fraction"), F.col("true_fraction"),
        F.when(lesion, dice("tp", "fp", "fn")).alias("binary_dice"), F.when(lesion, iou("tp", "fp", "fn")).alias("binary_iou"),
        F.when(lesion, precision("tp", "fp", "fn")).alias("binary_precision"), F.when(lesion, recall("tp", "fn")).alias("binary_recall"),
        dice("own_tp", "own_fp", "own_fn").alias("class_dice"),
    )


def headline(images: DataFrame, *keys: str) -> DataFrame:
    """Scores balanced over the three kinds of sample; NULL if one kind is missing."""
    mean = lambda c, k: F.avg(F.when(F.col("class_id") == k, c))
    parts = images.groupBy(*keys).agg(
        F.count("*").alias("samples"),
        mean(F.col("normal_empty").cast("double"), 0).alias("d_n"), mean(1 - F.col("predicted_fraction"), 0).alias("d_n_soft"),
        mean(F.col("binary_dice"), 1).alias("d_b_bin"), mean(F.col("binary_dice"), 2).alias("d_m_bin"),
        mean(F.col("class_dice"), 1).alias("d_b_cls"), mean(F.col("class_dice"), 2).alias("d_m_cls"),
    )
    cls = balanced_mean("d_b_cls", "d_m_cls")
    return parts.select(
        "*", balanced_mean("d_n", "d_b_bin", "d_m_bin").alias("d_bin_bal"), cls.alias("d_cls_bal"),
        balanced_mean(balanced_mean("d_n", "d_b_bin", "d_m_bin"), cls).alias("s_bal"), balanced_mean(balanced_mean("d_n_soft", "d_b_bin", "d_m_bin"), cls).alias("s_bal_soft"),
    )


def micro_macro(samples: DataFrame) -> DataFrame:
    """Pooled ratios of all pixels beside means over lesion samples, and the area ratio."""
    lesion = F.col("class_id") > 0
    per = samples.withColumns({"d": F.when(lesion, dice("tp", "fp", "fn")), "i": F.when(lesion, iou("tp", "fp", "fn")), "pr": F.when(lesion, precision("tp", "fp", "fn")), "re": F.when(lesion, recall("tp", "fn"))})
    sums = per.agg(*[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn", "tp1", "fp1", "fn1", "tp2", "fp2", "fn2")], *[F.avg(c).alias(f"macro_{n}") for c, n in (("d", "dice"), ("i", "iou"), ("pr", "precision"), ("re", "recall"))])
    return sums.select(
        dice("tp", "fp", "fn").alias("micro_dice"), iou("tp", "fp", "fn").alias("micro_iou"), precision("tp", "fp", "fn").alias("micro_precision"), recall("tp", "fn").alias("micro_recall"),
        dice("tp1", "fp1", "fn1").alias("benign_dice"), dice("tp2", "fp2", "fn2").alias("malignant_dice"),
        "macro_dice", "macro_iou", "macro_precision", "macro_recall", safe(F.col("tp") + F.col("fp"), F.col("tp") + F.col("fn")).alias("area_ratio"),
    )


def diagnosis_confusion(samples: DataFrame) -> DataFrame:
    return samples.groupBy("class_id", "predicted_diagnosis").agg(F.count("*").alias("samples"))


def accuracy(samples: DataFrame) -> DataFrame:
    return samples.agg(safe(F.count_if(F.col("class_id") == F.col("predicted_diagnosis")), F.count("*")).alias("accuracy"), F.count("*").alias("samples"))


def brier(df: DataFrame) -> DataFrame:
    """Mean squared errors of the probabilities: lesion against none, and all classes."""
    lesion = F.col("p1") + F.col("p2") - (F.col("target") > 0).cast("double")
    multi = sum(((F.col(f"p{k}") - (F.col("target") == k).cast("double")) ** 2 for k in range(1, 3)), (F.col("p0") - (F.col("target") == 0).cast("double")) ** 2)
    return df.agg(F.avg(lesion * lesion).alias("brier_binary"), F.avg(multi).alias("brier_multiclass"))


def calibration_bins(df: DataFrame, kind: str = "multiclass", bins: int = 15) -> DataFrame:
    """Count, mean confidence and accuracy per confidence bin; the top edge is in the last."""
    lesion = F.col("p1") + F.col("p2")
    if kind == "binary":
        conf, correct = F.greatest(lesion, 1 - lesion), (lesion >= 0.5) == (F.col("target") != 0)
    else:
        conf, correct = F.greatest("p0", "p1", "p2"), arg_max() == F.col("target")
    placed = df.select(conf.alias("conf"), correct.cast("double").alias("ok"))
    b = F.least(F.floor(F.col("conf") * bins), F.lit(bins - 1)).cast("int")
    return placed.groupBy(b.alias("bin")).agg(F.count("*").alias("pixels"), F.avg("conf").alias("confidence"), F.avg("ok").alias("accuracy"))


def expected_calibration_error(bins: DataFrame) -> DataFrame:
    return bins.agg(safe(F.sum(F.col("pixels") * F.abs(F.col("accuracy") - F.col("confidence"))), F.sum("pixels")).alias("ece"))


def class_pixel_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("target").agg(F.count("*").alias("pixels"))


def class_weights(counts: DataFrame, power: float = 0.5, reference: int = 0) -> DataFrame:
    """(n_reference / n_class) ** power; the table has one row a class."""
    ref = F.max(F.when(F.col("target") == reference, F.col("pixels"))).over(Window.partitionBy(F.lit(0)))
    return counts.withColumn("n_ref", ref).select("target", "pixels", F.pow(safe("n_ref", "pixels"), F.lit(power)).alias("weight"))


def class_table(df: DataFrame, *keys: str) -> DataFrame:
    """tp, fp and fn per (keys, class) for the plain most probable class."""
    pixels = df.select(*keys, "target", arg_max().alias("prediction"))
    one = F.explode(F.array(*[F.struct(F.lit(k).alias("class"), (F.col("target") == k).alias("t"), (F.col("prediction") == k).alias("p")) for k in range(3)]))
    return pixels.select(*keys, one.alias("c")).groupBy(*keys, "c.class").agg(
        F.count_if(F.col("c.t") & F.col("c.p")).alias("tp"), F.count_if(~F.col("c.t") & F.col("c.p")).alias("fp"), F.count_if(F.col("c.t") & ~F.col("c.p")).alias("fn")
    )


def macro_present(classes: DataFrame, *keys: str, eps: float = 1e-15) -> DataFrame:
    """Means over the classes that the truth holds."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    held = classes.filter(F.col("tp") + F.col("fn") > 0)
    return held.groupBy(*keys).agg(F.avg(2 * tp / (2 * tp + fp + fn + eps)).alias("dice"), F.avg(tp / (tp + fp + fn + eps)).alias("iou"), F.avg(tp / (tp + fn + eps)).alias("recall"), F.avg(tp / (tp + fp + eps)).alias("precision"))


def macro_foreground(classes: DataFrame, *keys: str, eps: float = 1e-7) -> DataFrame:
    """Means over the lesion classes that truth or prediction hold."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    held = classes.filter((F.col("class") > 0) & (F.col("tp") + F.col("fn") + F.col("fp") > 0))
    return held.groupBy(*keys).agg(F.avg(2 * tp / (2 * tp + fp + fn + eps)).alias("dice"), F.avg(tp / (tp + fp + fn + eps)).alias("iou"), F.avg(tp / (tp + fn + eps)).alias("recall"), F.avg(tp / (tp + fp + eps)).alias("precision"))


def per_class_smoothed(classes: DataFrame, eps: float = 1e-7) -> DataFrame:
    """Dice and IoU with eps above and below; NULL where a class is nowhere."""
    tp, fp, fn = (F.col(c).cast("double") for c in ("tp", "fp", "fn"))
    there = F.col("tp") + F.col("fp") + F.col("fn") > 0
    return classes.select("class", F.when(there, (2 * tp + eps) / (2 * tp + fp + fn + eps)).alias("dice"), F.when(there, (tp + eps) / (tp + fp + fn + eps)).alias("iou"))


def losses(df: DataFrame, weights: DataFrame, smooth: float = 1e-5, localization_weight: float = 0.7, class_weight: float = 0.3) -> DataFrame:
    """Training losses as aggregates over the whole table as one batch.

    Weighted cross entropy is sum(w * -ln p) / sum(w). Control Dice is per sample and
    lesion class; localization Dice and Tversky are over samples with a lesion; class
    Dice pools the batch per class and averages over classes that the truth holds.
    """
    p_true = F.element_at(F.array("p0", "p1", "p2"), F.col("target") + 1)
    pixels = df.join(F.broadcast(weights.select(F.col("target").alias("__t"), "weight")), F.col("target") == F.col("__t"))
    y = {k: (F.col("target") == k).cast("double") for k in (1, 2)}
    lesion, truth = F.col("p1") + F.col("p2"), (F.col("target") > 0).cast("double")
    sums = [F.sum(F.col("weight") * -F.log(p_true)).alias("ce"), F.sum("weight").alias("w"), F.sum(lesion * truth).alias("tp"), F.sum(lesion * (1 - truth)).alias("fp"), F.sum((1 - lesion) * truth).alias("fn"), F.max(truth).alias("has")]
    for k in (1, 2):
        sums += [F.sum(F.col(f"p{k}") * y[k]).alias(f"py{k}"), F.sum(f"p{k}").alias(f"p{k}s"), F.sum(y[k]).alias(f"y{k}s")]
    per = pixels.groupBy("sample_id").agg(*sums)
    control = [(2 * F.col(f"py{k}") + smooth) / (F.col(f"p{k}s") + F.col(f"y{k}s") + smooth) for k in (1, 2)]
    loc = F.when(F.col("has") > 0, (2 * F.col("tp") + smooth) / (2 * F.col("tp") + F.col("fp") + F.col("fn") + smooth))
    tversky = F.when(F.col("has") > 0, (F.col("tp") + smooth) / (F.col("tp") + 0.6 * F.col("fp") + 0.4 * F.col("fn") + smooth))
    total = per.agg(
        (F.sum("ce") / F.sum("w")).alias("cross_entropy"), (1 - F.avg((control[0] + control[1]) / 2)).alias("control_dice"),
        F.coalesce(1 - F.avg(loc), F.lit(0.0)).alias("localization_dice"), F.coalesce(1 - F.avg(tversky), F.lit(0.0)).alias("localization_tversky"),
        *[F.when(F.sum(f"y{k}s") > 0, 1 - (2 * F.sum(f"py{k}") + smooth) / (F.sum(f"p{k}s") + F.sum(f"y{k}s") + smooth)).alias(f"c{k}") for k in (1, 2)],
    )
    present = F.array_compact(F.array("c1", "c2"))
    class_dice = F.when(F.size(present) > 0, F.aggregate(present, F.lit(0.0), lambda a, x: a + x) / F.size(present)).otherwise(0.0)
    return total.select(
        "cross_entropy", "control_dice", "localization_dice", "localization_tversky", class_dice.alias("class_dice"),
        (F.col("cross_entropy") + F.col("control_dice")).alias("control_loss"), (F.col("cross_entropy") + localization_weight * F.col("localization_dice") + class_weight * class_dice).alias("composite_loss"),
    )
