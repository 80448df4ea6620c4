import math
import random

import pytest
from pyspark.sql import functions as F

from maskmill.operators import metrics as m
from maskmill.operators import sweep as sw

SCHEMA = "sample_id int, class_id int, target int, p0 double, p1 double, p2 double"


def make(spark, n=120, many=60, seed=2):
    """Samples with many pixels, probabilities on grid thresholds included."""
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        cls = i % 3
        for j in range(rng.randint(1, many)):
            target = cls if cls and (j == 0 or rng.random() < 0.5) else 0
            lesion = rng.choice([rng.randint(0, 100) / 100, rng.random(), 0.5, 0.99, 0.05])
            p1 = lesion * rng.choice([0.5, rng.random()])
            rows.append((i, cls, target, 1 - lesion, p1, lesion - p1))
    return spark.createDataFrame(rows, SCHEMA).repartition(4), rows


def plain(rows, t):
    """Headline scores by a plain loop over samples."""
    by = {}
    for s, c, y, _, p1, p2 in rows:
        pred = (1 if p1 >= p2 else 2) if p1 + p2 >= t else 0
        by.setdefault((s, c), []).append((y, pred))
    empty, soft, binary, own = [], [], {1: [], 2: []}, {1: [], 2: []}

    def dice(pairs):
        tp, fp, fn = sum(a and b for a, b in pairs), sum(b and not a for a, b in pairs), sum(a and not b for a, b in pairs)
        return 2 * tp / (2 * tp + fp + fn) if 2 * tp + fp + fn else None

    for (_, c), px in by.items():
        fg = sum(p > 0 for _, p in px)
        if c == 0:
            empty.append(float(fg == 0))
            soft.append(1 - fg / len(px))
        else:
            binary[c].append(dice([(y > 0, p > 0) for y, p in px]))
            own[c].append(dice([(y == c, p == c) for y, p in px]))
    mean = lambda v: math.fsum(sorted(v)) / len(v)
    d = {"d_n": mean(empty), "d_n_soft": mean(soft), "d_b_bin": mean(binary[1]), "d_m_bin": mean(binary[2]), "d_b_cls": mean(own[1]), "d_m_cls": mean(own[2])}
    d["s_bal"] = ((d["d_n"] + d["d_b_bin"] + d["d_m_bin"]) / 3 + (d["d_b_cls"] + d["d_m_cls"]) / 2) / 2
    return d


def test_headline_and_sweep_against_a_plain_loop(spark):
    df, rows = make(spark)
    got = m.headline(m.per_image(m.per_sample(df, 0.37))).first().asDict()
    for k, v in plain(rows, 0.37).items():
        assert got[k] == pytest.approx(v), k
    swept = {round(r.threshold, 2): r for r in sw.sweep(df).collect()}
    assert len(swept) == 95
    for t in (0.05, 0.06, 0.29, 0.5, 0.57, 0.58, 0.98, 0.99):
        for k, v in plain(rows, t).items():
            assert swept[t][k] == pytest.approx(v), (t, k)


def test_grid_places_are_those_of_comparisons(spark):
    values = [i / 100 for i in range(0, 101)] + [i / 100 + e for i in range(1, 100) for e in (1e-16, -1e-16, 1e-12, -1e-12)]
    df = spark.createDataFrame([(v,) for v in values], "p double")
    for v, k in df.select("p", sw.place_on_grid(F.col("p"))).collect():
        assert k == sum(t <= v for t in sw.grid()), v


def test_ties_and_missing_kinds(spark):
    swept = spark.createDataFrame([(0.4, 0.9, 1.0), (0.5, 0.9, 1.0), (0.6, 0.9, 0.5), (0.7, 0.89999, 1.0)], "threshold double, s_bal double, d_n double")
    assert sw.best_threshold(swept).first().threshold == 0.5 and sw.best_threshold(swept, "s_bal", 1e-3).first().threshold == 0.7
    one = spark.createDataFrame([(1, 1, 1, 0.2, 0.8, 0.0)], SCHEMA)
    got = m.headline(m.per_image(m.per_sample(one))).first()
    assert got.d_b_bin == 1.0 and got.d_n is None and got.s_bal is None
    assert sw.sweep(one).filter("s_bal is not null").count() == 0
    assert m.per_sample(one.limit(0)).count() == 0 and sw.sweep(one.limit(0)).count() == 0
    tie = spark.createDataFrame([(1, 1, 1, 0.0, 0.5, 0.5)], SCHEMA)
    assert m.per_sample(tie).first().predicted_diagnosis == 1


def test_validation(spark):
    rows = [(1, 0, 0, 0.5, 0.5, 0.0), (2, 0, 3, 0.5, 0.6, 0.0), (3, 0, None, float("nan"), 0.5, 0.5), (4, 1, 2, -0.1, 0.6, 0.5), (5, 1, 1, 0.3, 0.3, 0.4)]
    df = spark.createDataFrame(rows, SCHEMA)
    assert sorted(r.sample_id for r in m.validate_labels(df).collect()) == [2, 3]
    assert sorted(r.sample_id for r in m.validate_probabilities(df).collect()) == [2, 3, 4]
    assert {r.sample_id: r.agrees for r in m.inferred_classes(df).collect()}[4] is False
    r = m.normalized(df.filter("sample_id = 2")).first()
    assert r.p0 + r.p1 + r.p2 == pytest.approx(1)


def test_calibration_edges(spark):
    df = spark.createDataFrame([(1, 0, 0, 1.0, 0.0, 0.0), (2, 0, 0, 0.6, 0.4, 0.0), (3, 1, 1, 0.5, 0.5, 0.0)], SCHEMA)
    bins = {r.bin: r for r in m.calibration_bins(df).collect()}
    assert set(bins) == {14, 9, 7} and bins[14].accuracy == 1.0
    binary = m.calibration_bins(df, "binary").collect()
    assert sum(r.pixels for r in binary) == 3
    assert m.brier(df).first().brier_binary == pytest.approx((0 + 0.16 + 0.25) / 3)
    weights = {r.target: r.weight for r in m.class_weights(m.class_pixel_counts(df)).collect()}
    assert weights[0] == 1.0 and weights[1] == pytest.approx(2**0.5)


def test_macro_rules(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.1, 0.8, 0.1), (1, 0, 0, 0.8, 0.1, 0.1)], SCHEMA)
    classes = m.class_table(df, "sample_id")
    assert m.macro_present(classes, "sample_id").first().dice == pytest.approx(2 / 3) and m.macro_foreground(classes, "sample_id").first().dice == pytest.approx(0, abs=1e-6)
    assert {r["class"]: r.dice for r in m.per_class_smoothed(m.class_table(df)).collect()}[2] is None


def test_losses(spark):
    df = spark.createDataFrame([(1, 0, 0, 0.9, 0.05, 0.05)], SCHEMA)
    w = spark.createDataFrame([(0, 1.0), (1, 2.0), (2, 2.0)], "target int, weight double")
    got = m.losses(df, w).first()
    assert got.cross_entropy == pytest.approx(-math.log(0.9)) and got.localization_dice == 0.0 and got.class_dice == 0.0
    both = spark.createDataFrame([(1, 1, 1, 0.0001, 0.9999, 0.0), (2, 0, 0, 0.9999, 0.0001, 0.0)], SCHEMA)
    got = m.losses(both, w).first()
    assert got.localization_dice < 0.01 and got.class_dice < 0.01 and got.composite_loss < 0.02
