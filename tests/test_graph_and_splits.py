import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from maskmill.operators import dedup, graph, splits
from maskmill.operators.provenance import array_digest, table_digest


def test_components_against_brute_force(spark):
    rng = random.Random(7)
    chain = [f"c{i}" for i in range(40)]
    rng.shuffle(chain)
    pairs = list(zip(chain, chain[1:])) + [("hub", f"h{i}") for i in range(30)] + [("x", "y"), ("y", "x"), ("z", "z"), (None, "q")]
    parent = {}

    def find(a):
        while parent.setdefault(a, a) != a:
            a = parent[a]
        return a

    for a, b in pairs:
        if a and b and a != b and find(a) != find(b):
            ra, rb = sorted((find(a), find(b)))
            parent[rb] = ra
    for one_task in (0, 1000):
        got = {r.vertex: r.component for r in graph.components(spark.createDataFrame(pairs, "a string, b string"), "a", "b", one_task).collect()}
        assert got == {v: find(v) for v in parent}
    assert graph.components(spark.createDataFrame([], "a string, b string"), "a", "b").collect() == []


def test_ineligible_node_cuts_a_chain(spark):
    members = spark.createDataFrame([("a",), ("c",), ("d",)], "id string")
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "x string, y string")
    got = {r.id: r.content_group for r in graph.content_groups(members, "id", edges, "x", "y").collect()}
    assert got == {"a": "content_0000", "c": "content_0001", "d": "content_0001"}


def test_exact_groups_and_numbers(spark):
    df = spark.createDataFrame([("h2", "a", "n"), ("h2", "b", "m"), ("h1", "c", "n"), ("h1", "d", "n"), ("h3", "e", "n"), ("", "f", "n"), ("", "g", "n"), (None, "h", "n")], "digest string, id string, label string")
    got = {r.exact_group: r for r in dedup.exact_groups(df, "digest", "id", "label").collect()}
    assert set(got) == {"exact_0000", "exact_0001"} and got["exact_0000"].sample_ids == "c;d" and got["exact_0001"].action == "quarantine"
    many = spark.range(5000).select(F.sha2(F.col("id").cast("string"), 256).alias("k")).repartition(7)
    out = dedup.number_in_order(many, "k", "n", "x").orderBy("k").collect()
    assert [int(r.n[2:]) for r in out] == list(range(5000))


@pytest.mark.parametrize("most", [0, 6, 12])
def test_hamming_banding_is_exact(spark, most):
    rng = random.Random(most)
    base = [rng.getrandbits(64) for _ in range(30)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(64), rng.randint(0, 14))) for b in base]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    first = {}
    for i, v in enumerate(values):
        first.setdefault(v, i)
    want = {(i, j, bin(a ^ b).count("1")) for a, i in first.items() for b, j in first.items() if i < j and bin(a ^ b).count("1") <= most}
    df = spark.createDataFrame(list(enumerate(signed)), "id long, h long")
    assert {tuple(r) for r in dedup.hamming_pairs(df, "id", "h", most).collect()} == want


def test_hot_band_is_compared_in_blocks(spark):
    """Hashes that nearly all share most bands: each pair once, whatever the blocks."""
    rng = random.Random(1)
    values = list({sum(1 << b for b in rng.sample(range(64), rng.randint(0, 5))) for _ in range(250)})
    want = {(i, j) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= 6}
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([*enumerate(signed), (999, None), (None, 5)], "id long, h long")
    for rows in (16, 4096):
        got = [(r.id_a, r.id_b) for r in dedup.hamming_pairs(df, "id", "h", 6, rows).collect()]
        assert len(got) == len(set(got)) and set(got) - {p for p in got if 999 in p or None in p} == want


def test_block_pairs(spark):
    rng = np.random.default_rng(4)
    v = rng.normal(size=(60, 64))
    v[7] = v[3] + 0.01 * rng.normal(size=64)
    shifted = np.roll(v[5].reshape(8, 8), 1, axis=1)
    v[9] = shifted.ravel()
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)] + [(99, None)], "id long, e array<double>")
    n = v / np.linalg.norm(v, axis=1, keepdims=True)
    want = {(i, j) for i in range(60) for j in range(i + 1, 60) if n[i] @ n[j] >= 0.3}
    got = dedup.block_pairs(df, "id", "e", 0.3, rows_per_block=16).collect()
    assert {(r.id_a, r.id_b) for r in got} == want and len(got) == len(want)
    hit = [r for r in dedup.block_pairs(df, "id", "e", 0.95, 16, "aligned").collect() if (r.id_a, r.id_b) == (5, 9)]
    assert len(hit) == 1 and abs(hit[0].dx) == 1 and hit[0].dy == 0 and hit[0].score > 0.99


def test_evidence_rules(spark):
    rows = [(6, 0.0, 0.0), (7, 0.8999, 1.0), (7, 0.90, 0.70), (7, 0.90, 0.6999), (7, 0.95, 0.0), (6, 0.95, 0.7)]
    df = spark.createDataFrame(rows, "d int, c double, m double").coalesce(1)
    assert [r[0] for r in df.select(dedup.evidence(F.col("d"), F.col("c"), F.col("m"))).collect()] == [
        "phash_le_6", "", "corr_ge_0.90_and_mask_dice_ge_0.70", "", "aligned_corr_ge_0.95", "phash_le_6;aligned_corr_ge_0.95;corr_ge_0.90_and_mask_dice_ge_0.70"
    ]
    masks = spark.createDataFrame([([0, 0], [0, 0]), ([1, 1], [1, 0])], "a array<int>, b array<int>").coalesce(1)
    assert [r[0] for r in masks.select(dedup.mask_dice(F.col("a"), F.col("b"))).collect()] == [1.0, pytest.approx(2 / 3)]


def test_selections_cover_development(spark):
    rng = random.Random(1)
    rows = [(i, rng.choice([0, 1]), rng.choice(["development", "sealed"]), rng.randint(0, 4), ";".join(map(str, rng.sample(range(5), 2)))) for i in range(300)]
    df = spark.createDataFrame(rows, "id int, eligible int, partition string, fold int, calibration_for_folds string")
    for k in range(5):
        parts = [{r.id for r in df.filter(splits.in_split(x, k)).collect()} for x in ("fit", "calibration", "outer")]
        assert not parts[0] & parts[1] and not parts[0] & parts[2] and not parts[1] & parts[2]
        assert set.union(*parts) == {r.id for r in df.filter(splits.in_split("development")).collect()}
    with pytest.raises(ValueError):
        splits.in_split("fit")


def test_group_split_and_leakage(spark):
    df = spark.createDataFrame([(i % 500, i) for i in range(2000)] + [(None, 1)], "g int, i int")
    out = splits.split_by_group(df, "g").collect()
    assert Counter(r.split for r in out) == {"train": 400, "val": 50, "test": 50}
    torn = spark.createDataFrame([(1, "a"), (1, "b"), (2, "a"), (2, "c"), (2, "b"), (3, "a")], "g int, s string")
    assert {tuple(r) for r in splits.leakage(torn, "g", "s").collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}


def test_greedy_rules():
    strata = np.array([[3, 0], [0, 3], [2, 2], [1, 0], [0, 1]], float)
    taken = splits.greedy_select(strata.sum(1), strata, 0.5, list("abcde"), 1)
    assert strata[taken].sum() >= 6
    assert splits.greedy_select(np.array([5.0]), np.array([[5.0]]), 0.3, ["a"], 1).all()
    folds = splits.assign_folds(np.ones(20), np.ones((20, 1)), 5, [str(i) for i in range(20)], 3)
    assert Counter(folds.tolist()) == {i: 4 for i in range(5)}


def test_greedy_kinds_against_single_groups():
    """Kinds of groups give the choice that scoring every single group gives."""
    import hashlib

    rng = np.random.default_rng(6)
    for n in (1, 7, 60, 200):
        strata = rng.integers(0, 3, (n, 4)).astype(float)
        strata[:, 0] += 1
        sizes, keys = strata.sum(1), [f"g{i}" for i in range(n)]
        tie = np.argsort(np.argsort([hashlib.sha256(f"3:{k}".encode()).hexdigest() for k in keys], kind="stable"))
        want, size, have = np.zeros(n, bool), 0.0, np.zeros(4)
        target, per = float(np.round(sizes.sum() * 0.3)), strata.sum(0) * 0.3
        while size < target and not want.all():
            score = np.round(((size + sizes - target) / max(target, 1)) ** 2 + (((have + strata - per) / np.maximum(per, 1)) ** 2).sum(1), 12)
            score[want] = np.inf
            best = np.flatnonzero(score == score.min())
            i = best[np.argmin(tie[best])]
            want[i] = True
            size, have = size + sizes[i], have + strata[i]
        assert np.array_equal(splits.greedy_select(sizes, strata, 0.3, keys, 3), want)
    assert not len(splits.greedy_select(np.zeros(0), np.zeros((0, 2)), 0.3, [], 3))


def test_nested_splits(spark):
    rng = random.Random(3)
    rows = []
    for g in range(80):
        for i in range(rng.randint(1, 5)):
            rows.append((f"g{g:03d}", f"g{g}_{i}", rng.choice(["a", "b"]), g < 8 and i == 0))
    df = spark.createDataFrame(rows, "grp string, id string, stratum string, prior boolean")
    out = splits.nested_splits(df, "grp", "stratum", F.col("prior")).collect()
    assert len(out) == 80 and all(r.partition == "development" for r in out if int(r.grp[1:]) < 8)
    for r in out:
        held = [int(x) for x in r.calibration_for_folds.split(";") if x]
        assert (r.fold == -1) == (r.partition == "sealed") and r.fold not in held and (r.partition == "development" or not held)
    size = defaultdict(int)
    for g, *_ in rows:
        size[g] += 1
    total = sum(size[r.grp] for r in out if r.fold >= 0)
    assert all(abs(sum(size[r.grp] for r in out if r.fold == k) - total / 5) <= 5 for k in range(5))
    assert splits.nested_splits(df.limit(0), "grp", "stratum", F.col("prior")).collect() == []
    with pytest.raises(ValueError):
        splits.nested_splits(df, "grp", "stratum", F.col("prior"), limit=10)


def test_digests(spark):
    a = spark.createDataFrame([("x", 1), ("y", None), ("x", 1)], "k string, v int")
    one, two = table_digest(a, "k", "v").first(), table_digest(a.repartition(3).orderBy("k"), "k", "v").first()
    assert one.digest == two.digest and one.row_count == 3
    assert table_digest(a.distinct(), "k", "v").first().digest != one.digest
    d = spark.createDataFrame([(bytearray(b"ab"),)], "b binary").select(array_digest("|u1", (1, 2), F.col("b"))).first()[0]
    import hashlib
    import struct

    assert d == hashlib.sha256(b"|u1" + struct.pack("<qq", 1, 2) + b"ab").hexdigest()


def test_selections_read_every_way_of_writing_folds(spark):
    folds = ["0|4", '["0","2"]', "['3','0']", '"0";"4"', "0；1", "0 + 1", "1;2"]
    df = spark.createDataFrame([(i, 1, "development", 3 if i == 0 else 4, f) for i, f in enumerate(folds)], "id int, eligible int, partition string, fold int, calibration_for_folds string")
    assert {r.id for r in df.filter(splits.in_split("calibration", 0)).collect()} == {0, 1, 2, 3, 4, 5}
    assert {r.id for r in df.filter(splits.in_split("fit", 0)).collect()} == {6}


@pytest.mark.parametrize("most", [0, 6, 16])
def test_hamming_pairs_of_equal_hashes(spark, most):
    """A third of all ids share one hash: every pair of ids is given, by bands and in blocks."""
    rng = random.Random(most)
    base = [rng.getrandbits(63) for _ in range(24)]
    values = base + [b ^ sum(1 << x for x in rng.sample(range(63), rng.randint(1, 8))) for b in base] + [base[3]] * 24 + base[5:8]
    want = {(i, j, (a ^ b).bit_count()) for i, a in enumerate(values) for j, b in enumerate(values) if i < j and (a ^ b).bit_count() <= most}
    df = spark.createDataFrame([*enumerate(values), (999, None), (None, base[3])], "id long, h long")
    for part in (2048, 7):
        got = [tuple(r) for r in dedup.all_hamming_pairs(df, "id", "h", most, part).collect()]
        assert len(got) == len(want) and set(got) == want


def test_hamming_query_keeps_copies(spark, tmp_path):
    from maskmill.plans.dataset import hamming_pairs

    rng = random.Random(2)
    vectors = [[rng.gauss(0, 1) for _ in range(64)] for _ in range(4)]
    spark.createDataFrame([(i, vectors[max(0, i - 2)]) for i in range(6)], "vec_id long, embedding array<double>").write.parquet(f"{tmp_path}/embeddings.parquet")
    assert {(0, 1, 0), (0, 2, 0), (1, 2, 0)} <= {tuple(r) for r in hamming_pairs(spark, str(tmp_path)).collect()}


def _folds_in_full(sizes, strata, folds, keys, seed):
    """Every group scored in full for each fold."""
    import hashlib

    rarity = (strata / np.maximum(strata.sum(0), 1)).sum(1)
    order = sorted(range(len(sizes)), key=lambda i: (-sizes[i], -round(float(rarity[i]), 12), hashlib.sha256(f"{seed}:{keys[i]}".encode()).hexdigest()))
    out, size, have = np.zeros(len(sizes), int), np.zeros(folds), np.zeros((folds, strata.shape[1]))
    size_target, target = max(sizes.sum() / folds, 1), np.maximum(strata.sum(0) / folds, 1)
    for i in order:
        scores = []
        for f in range(folds):
            s, h = size.copy(), have.copy()
            s[f] += sizes[i]
            h[f] += strata[i]
            scores.append((round(2 * float(np.var(s / size_target)) + float(np.mean(np.var(h / target, axis=0))), 12), size[f], f))
        out[i] = f = min(scores)[2]
        size[f] += sizes[i]
        have[f] += strata[i]
    return out


def test_fold_kinds_against_single_groups():
    """Folds told apart by kinds of groups are those that scoring every single group gives."""
    rng = np.random.default_rng(8)
    for n, width, most, folds in ((1, 1, 2, 5), (40, 3, 4, 5), (400, 9, 2, 5), (400, 2, 2, 3), (150, 30, 2, 4)):
        strata = rng.integers(0, most, (n, width)).astype(float)
        strata[:, 0] += 1
        keys = [f"g{i}" for i in range(n)]
        assert np.array_equal(splits.assign_folds(strata.sum(1), strata, folds, keys, 5), _folds_in_full(strata.sum(1), strata, folds, keys, 5))
    assert not len(splits.assign_folds(np.zeros(0), np.zeros((0, 2)), 5, [], 5))


def test_splits_do_not_depend_on_pieces(spark, monkeypatch):
    """Nested splits put together from single choices, whatever is hashed and sent at once;
    no stratum is a stratum, and a group without a name is one too."""
    rng = random.Random(5)
    rows = [(None if g == 7 else f"g{g:02d}", rng.choice(["a", 'b"|', "", None]), g % 9 == 0) for g in range(60) for _ in range(rng.randint(1, 4))]
    df = spark.createDataFrame(rows, "grp string, stratum string, prior boolean").repartition(5)
    names = sorted({g for g, *_ in rows}, key=str)
    strata = np.array([[sum(r[0] == g and (r[1] or "") == s for r in rows) for s in ("", "a", 'b"|')] for g in names], float)
    sizes = strata.sum(1)
    free = np.array([i for i, g in enumerate(names) if not any(r[2] for r in rows if r[0] == g)])
    pick = lambda at, share, seed: set(at[splits.greedy_select(sizes[at], strata[at], share, [str(names[i]) for i in at], seed)].tolist())
    shut = pick(free, 0.15, 20260717)
    dev = np.array([i for i in range(len(names)) if i not in shut])
    fold = dict(zip(dev.tolist(), _folds_in_full(sizes[dev], strata[dev], 5, [str(names[i]) for i in dev], 20260718).tolist(), strict=True))
    held = [pick(np.array([i for i in dev.tolist() if fold[i] != k]), 0.125, 20261717 + k) for k in range(5)]
    want = {(g, "sealed" if i in shut else "development", fold.get(i, -1), ";".join(str(k) for k in range(5) if i in held[k])) for i, g in enumerate(names)}
    for piece in (7, 200_000):
        monkeypatch.setattr(splits, "PIECE", piece)
        got = [tuple(r) for r in splits.nested_splits(df, "grp", "stratum", F.col("prior")).collect()]
        assert len(got) == len(want) and set(got) == want


def test_half_a_million_groups_are_dealt(spark):
    n = 500_010
    df = spark.range(n).select(F.concat(F.lit("g"), "id").alias("grp"), F.floor(F.log2(F.col("id") % 7 + 1)).cast("string").alias("stratum"), (F.col("id") % 10 == 0).alias("prior"))
    out = splits.nested_splits(df, "grp", "stratum", F.col("prior"), sealed=0.01, calibration=0.004).cache()
    assert out.count() == out.select("grp").distinct().count() == n
    assert out.filter("partition = 'sealed'").count() == 4_500  # of 450,009, and none of the others
    assert out.filter("partition = 'sealed' and substring(grp, -1) = '0'").isEmpty()
    fold = {r.fold: r["count"] for r in out.groupBy("fold").count().collect()}
    assert set(fold) == {-1, 0, 1, 2, 3, 4} and max(fold[k] for k in range(5)) - min(fold[k] for k in range(5)) <= 1
    held = out.select(F.explode(F.split("calibration_for_folds", ";")).alias("k"), "fold").filter("k <> ''").groupBy("k").agg(F.count("*").alias("n"), F.count_if(F.col("fold").isin(-1) | (F.col("fold") == F.col("k"))).alias("wrong"))
    assert {(r.k, r.n, r.wrong) for r in held.collect()} == {(str(k), round((n - 4_500 - fold[k]) * 0.004), 0) for k in range(5)}
    out.unpersist()
