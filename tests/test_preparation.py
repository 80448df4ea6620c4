import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmill.functions import scalars as s
from maskmill.operators import dedup, provenance, quality, runlog, selection
from maskmill.operators import metrics as m
from maskmill.operators import sweep as sw


def test_atrous_rates_fit_the_map(spark):
    sizes = [0, -3, 1, 3, 8, 16, 17, 24, 32, 40, 41, 64]
    df = spark.createDataFrame([(i, n) for i, n in enumerate(sizes)], "i int, n int")
    got = {r.n: r.a for r in df.select("n", s.atrous_rates(F.col("n")).alias("a")).collect()}
    assert got[16] == [2, 3, 5] and got[24] == [2, 4, 6] and got[32] == [3, 6, 9] and got[64] == [6, 12, 18]
    assert got[0] is None and got[-3] is None and got[1] == got[3] == [1, 1, 1] and got[8] == [2, 3, 3]


def test_rows_that_look_alike_have_other_digests(spark):
    rows = [('a","b', "c"), ("a", 'b","c'), ("a", None), ("a", "null"), ("", None), (None, ""), ("a\\", "b"), ("a", "\\b"), ("x\ty", "z"), ("x", "\ty z")]
    df = spark.createDataFrame(rows, "a string, b string")
    assert df.select(provenance.row_digest("a", "b").alias("d")).distinct().count() == len(rows)


def test_table_digest_is_a_multiset(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2), ("y", 2), ("z", 1)], "k string, v int")
    one = provenance.table_digest(a, "k", "v").first()
    assert provenance.table_digest(a.repartition(5).orderBy("v"), "k", "v").first() == one and one.row_count == 4
    assert provenance.table_digest(a.distinct(), "k", "v").first().digest != one.digest
    assert provenance.table_digest(a.limit(0), "k").collect() == []
    with pytest.raises(ValueError):
        provenance.table_digest(a.limit(0), "k", required=True)
    assert {r.v for r in provenance.table_digest(a, "k", keys=("v",)).collect()} == {1, 2}


def test_contract_digest(tmp_path):
    paths = [str(tmp_path / n) for n in ("manifest.csv", "print.json", "none.json")]
    for p in paths[:2]:
        with open(p, "w") as f:
            f.write(os.path.basename(p))
    alone, both = provenance.contract_digest(paths[0]), provenance.contract_digest(*paths)
    assert alone != both == provenance.contract_digest(paths[0], paths[1]) and len(both) == 64


def test_picture_profiles():
    from maskmill.functions.config import picture_profile

    assert picture_profile("padded_320")["name"] == "padded_320_imagenet" and picture_profile(" Legacy ")["resize"] == "square_warp"
    assert picture_profile("xception", 128)["size"] == 128 and picture_profile("xception_256")["size"] == 256
    for bad in (("none", None), ("legacy", 100), ("legacy", 0)):
        with pytest.raises((KeyError, ValueError)):
            picture_profile(*bad)


def test_selection_by_reason(spark):
    from maskmill.operators import splits

    df = spark.createDataFrame([("a", 1, "", "development", 0, "0"), ("b", 0, None, "development", 1, "0;2"), ("c", 1, "broken", "development", 2, "")], "id string, eligible int, exclusion_reason string, partition string, fold int, calibration_for_folds string")
    of = lambda *x, **k: [r.id for r in df.filter(splits.in_split(*x, **k)).orderBy("id").collect()]
    assert of("development") == ["a", "c"] and of("development", by_reason=True) == ["a", "b"]
    assert of("calibration", 0) == [] and of("calibration", 0, strict=False, by_reason=True) == ["a", "b"] and of("calibration", 0, by_reason=True) == ["b"]


def test_cells_and_paths(spark):
    df = spark.createDataFrame([(0, " TRUE "), (1, "12"), (2, "-1.5e2"), (3, "none"), (4, "x "), (5, None), (6, "99999999999999999999")], "i int, t string")
    got = {r.i: tuple(r.c) for r in df.select("i", s.cast_cell(F.col("t")).alias("c")).collect()}
    assert got[0] == ("bool", True, None, None, None) and got[1] == ("int", None, 12, None, None) and got[2] == ("float", None, None, -150.0, None)
    assert got[3] == got[5] == ("null", None, None, None, None) and got[4] == ("string", None, None, None, "x ") and got[6][0] == "float"
    files = F.array(F.lit("/data/set/a.png"), F.lit("/data/b.png"))
    paths = spark.createDataFrame([("a.png",), ("b.png",), ("c.png",), ("/abs",)], "p string").coalesce(1)
    assert [r[0] for r in paths.select(s.resolve_path(F.col("p"), "/data/set/", files)).collect()] == ["/data/set/a.png", "/data/b.png", "/data/set/c.png", "/abs"]
    with pytest.raises(Exception, match="no patient id"):
        paths.select(s.patient_id(F.col("p"), strict=True)).collect()
    assert spark.range(1).select(s.round_half_even(F.lit(2.5), 0)).first()[0] == 2.0


def test_order_and_draws(spark):
    df = spark.createDataFrame([(f"k{i:03d}", i % 3) for i in range(300)], "k string, c int").repartition(5)
    places = {r.k: r.position for r in selection.positions(df, "k").collect()}
    assert [k for k, _ in sorted(places.items(), key=lambda x: x[1])] == sorted(places) and set(places.values()) == set(range(300))
    saved = selection.positions(df.filter("k <> 'k010'"), "k")
    off = selection.order_mismatches(saved, df, "k").collect()
    assert len(off) == 290 and {r.position for r in off} == set(range(10, 300)) and sum(r.saved is None for r in off) == 1
    assert selection.order_mismatches(selection.positions(df, "k"), df, "k").collect() == []
    first = selection.first_of_each(df, 2, "c", "k").collect()
    assert sorted((r.c, r.place, r.k) for r in first) == [(c, p + 1, f"k{c + 3 * p:03d}") for c in range(3) for p in range(2)]
    assert [r.k for r in selection.in_order(df, "k", limit=3).collect()] == ["k000", "k001", "k002"]
    drawn = selection.weighted_draws(df, "k", "c", {0: 1.0, 1: 2.0, 2: 1.0}, 4000).collect()
    again = selection.weighted_draws(df.repartition(2), "k", "c", {0: 1.0, 1: 2.0, 2: 1.0}, 4000).collect()
    assert len(drawn) == 4000 and sorted(drawn) == sorted(again) and len({r.k for r in drawn}) == 300
    assert abs(sum(r.c == 1 for r in drawn) - 2000) < 150
    for bad in ({0: 0.0}, {}, {7: 1.0}):
        with pytest.raises(ValueError):
            selection.weighted_draws(df, "k", "c", bad, 10)
    assert selection.missing_columns(df, ("k", "z", "a")) == ["a", "z"]


def test_plateau_starts_anew_with_a_phase(spark):
    rows = [("r", e, 0.5, 1 if e <= 6 else 2) for e in range(1, 13)]
    df = spark.createDataFrame(rows, "run string, epoch int, score double, phase int").repartition(4)
    rates = {r.epoch: r.learning_rate for r in runlog.plateau_rate(df, "score", "run", rate=1.0, patience=2, phase="phase").collect()}
    assert [rates[e] for e in range(1, 13)] == [1, 1, 1, 0.5, 0.5, 0.5, 1, 1, 1, 0.5, 0.5, 0.5]
    assert runlog.plateau_rate(df.limit(0), "score", "run").collect() == []


def test_rules_stream_through_a_long_run(spark):
    """One run of many epochs beside short ones, in any order of rows."""
    n = 30_000
    long = spark.range(1, n + 1).select(F.lit("hot").alias("run"), F.col("id").cast("int").alias("epoch"), F.when(F.col("id") % 7 == 0, None).otherwise(F.col("id") % 101 / 101.0).alias("score"))
    df = long.unionByName(spark.createDataFrame([("b", 1, 0.1), ("b", 2, None), ("a", 1, None)], "run string, epoch int, score double")).repartition(8)
    mean, want = None, {}
    for e in range(1, n + 1):
        if e % 7:
            x = e % 101 / 101.0
            mean = x if mean is None else 0.9 * mean + (1 - 0.9) * x
        want[e] = mean
    got = {(r.run, r.epoch): r.mean for r in runlog.moving_mean(df, "score", "run").collect()}
    assert len(got) == n + 3 and all(got["hot", e] == pytest.approx(want[e]) for e in (1, 2, 7, 8, 999, n)) and got["a", 1] is None and got["b", 2] == 0.1
    bad = {(r.run, r.epoch): (r.bad_epochs, r.best) for r in runlog.early_stop(df, "score", "run").collect()}
    assert bad["a", 1] == (1, None) and bad["b", 2] == (1, 0.1) and bad["hot", 1] == (0, 1 / 101)


def test_logs_are_repaired(spark):
    log = spark.createDataFrame([(r, e, r + str(e)) for r, n in (("same", 2), ("behind", 2), ("ahead", 3), ("far", 5)) for e in range(1, n + 1)], "run string, epoch int, line string")
    saved = spark.createDataFrame([("same", 2, "same2"), ("behind", 3, "behind3"), ("ahead", 2, "ahead2"), ("far", 2, "far2")], "run string, epoch int, line string")
    kept, orphans = runlog.repaired(log, saved, "run")
    lines = sorted(r.line for r in kept.collect())
    assert lines == sorted(["same1", "same2", "behind1", "behind2", "behind3", "ahead1", "ahead2", "far1", "far2", "far3", "far4", "far5"])
    assert [r.line for r in orphans.collect()] == ["ahead3"]


def test_written_paths_and_exact_members(spark):
    df = spark.createDataFrame([("a", True), ("b", False)], "id string, ok boolean")
    assert sorted(tuple(r) for r in df.select(*quality.written_paths(F.col("id"), F.col("ok"))).collect()) == [("images/a.png", "masks/a.png"), ("quarantine/images/b.png", "quarantine/masks/b.png")]
    rows = spark.createDataFrame([("h", f"k{i}") for i in range(50)] + [("g", "x"), ("g", "y"), ("lone", "z"), ("", "e"), ("", "f"), (None, "n")], "d string, k string")
    got = dedup.exact_members(rows, "d", "k").collect()
    assert {(r.exact_group, r.d, r.members) for r in got} == {("exact_0000", "g", 2), ("exact_0001", "h", 50)} and len(got) == 52


def test_bands_recall(spark):
    """Against all pairs: at least nine of ten at 0.9, none twice, none false; copies of one
    vector count once, and a bucket larger than a block is compared whole."""
    rng = np.random.default_rng(3)
    base = rng.normal(size=(150, 32))
    near = base + 0.25 * rng.normal(size=base.shape)
    v = np.concatenate([base, near, np.repeat(base[:1], 60, axis=0)])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    cosine = unit @ unit.T
    want = {(i, j) for i in range(300) for j in range(i + 1, 300) if cosine[i, j] >= 0.9}
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(999, None)], "id long, e array<double>")
    got = [(r.id_a, r.id_b) for r in dedup.banded_pairs(df, "id", "e", 0.9, rows_per_block=8).collect()]
    assert len(got) == len(set(got)) and set(got) <= want and len(got) >= 0.9 * len(want) > 100
    assert dedup.banded_pairs(df.limit(0), "id", "e", 0.9).collect() == []


def test_near_search_against_brute_force(spark):
    rng = np.random.default_rng(8)
    pictures = [rng.normal(size=(8, 8)) for _ in range(24)]
    pictures += [np.roll(pictures[i], 1, axis=1) for i in range(4)] + [pictures[5] + 0.01 * rng.normal(size=(8, 8)), pictures[6].copy(), pictures[6] * 2]
    rows = [(i, p.ravel().tolist(), (p > 0.5).astype(int).ravel().tolist()) for i, p in enumerate(pictures)]
    df = spark.createDataFrame([*rows, (99, None, None)], "id long, e array<double>, m array<int>")

    def bits(p):
        flat = p.ravel()
        return sum(1 << (63 - i) for i, x in enumerate(flat) if x > np.median(flat[1:]))

    want = {}
    for i, a in enumerate(pictures):
        for j in range(i + 1, len(pictures)):
            b = pictures[j]
            if 29 in (i, j):  # the copy of picture 6
                continue
            best, dy, dx = (x[0] for x in dedup.aligned(a.reshape(1, -1), b.reshape(1, -1)))
            distance = (bits(a) ^ bits(b)).bit_count()
            if not np.array_equal(a, b) and (distance <= 6 or best >= 0.9):
                dice = dedup.shifted_dice(a > 0.5, b > 0.5, int(dy), int(dx))
                why = [n for n, ok in (("phash_le_6", distance <= 6), ("aligned_corr_ge_0.95", best >= 0.95), ("corr_ge_0.90_and_mask_dice_ge_0.70", best >= 0.9 and dice >= 0.7)) if ok]
                if why:
                    want[i, j] = (distance, round(float(dice), 8), int(dy), int(dx), ";".join(why))
    got = {(r.sample_a, r.sample_b): (r.phash_distance, r.registered_mask_dice, r.alignment_dy, r.alignment_dx, r.evidence) for r in dedup.near_search(df, "id", "e", "m").collect()}
    assert got == want and len(want) >= 5
    assert dedup.shifted_dice(np.zeros((3, 3)), np.zeros((3, 3)), 1, 0) == 1.0


SCHEMA = "sample_id int, class_id int, target int, p0 double, p1 double, p2 double, px int"


def test_one_shot_evaluation_refuses_repeated_samples(spark):
    rows = [(i, i % 3, (i % 3) if px < 2 else 0, 0.5, 0.3, 0.2, px) for i in range(9) for px in range(4)]
    df = spark.createDataFrame(rows, SCHEMA)
    out = {r.metric: r.value for r in m.evaluate(df, ("px",)).collect()}
    assert out["samples"] == 9 and 0 <= out["ece_multiclass"] <= 1 and len(out) == 27
    twice = df.unionByName(df.filter("sample_id = 4"))
    assert [tuple(r) for r in m.repeated_ids(twice, "px").collect()] == [(4, 2)] and m.repeated_ids(df, "px").collect() == []
    with pytest.raises(Exception, match="repeated sample 4"):
        m.evaluate(twice, ("px",)).collect()


def test_listed_thresholds_and_checkpoints(spark):
    df = spark.createDataFrame([(1, 1, 1, 0.4, 0.6, 0.0), (1, 1, 0, 0.9, 0.1, 0.0), (2, 2, 2, 0.2, 0.0, 0.8), (3, 0, 0, 0.7, 0.3, 0.0)], "sample_id int, class_id int, target int, p0 double, p1 double, p2 double")
    grid = {r.threshold: r.s_bal for r in sw.sweep(df).collect()}
    listed = {r.threshold: r.s_bal for r in sw.sweep(df, thresholds=[0.9, 0.5, 0.5, 0.25]).collect()}
    assert set(listed) == {0.25, 0.5, 0.9} and all(listed[t] == pytest.approx(grid[t]) for t in listed)
    with pytest.raises(ValueError):
        sw.sweep(df, thresholds=[])
    best = spark.createDataFrame([("a", 0.5, 0.8, 0.9), ("b", 0.6, 0.80005, 0.9), ("c", 0.6, 0.80001, 0.9), ("d", 0.9, 0.7, 1.0)], "name string, threshold double, s_bal double, d_n double")
    assert sw.best_checkpoint(best, "name").first().name == "c"


def test_deep_supervision(spark):
    one, two = (spark.createDataFrame([(x, 2 * x)], "a double, b double") for x in (1.0, 3.0))
    rows = {r.stage: r for r in m.deep_supervision([one, two], [1, 3]).collect()}
    assert rows["total"].a == pytest.approx(2.5) and rows["total"].b == pytest.approx(5.0) and rows["p2"].weight == 0.75
    with pytest.raises(ValueError):
        m.deep_supervision([one, two], [0, 0])
