import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from maskmill.llm.group_split import contract, dealt_to, labels_of, shares, spanning_forest, split_records, torn_groups
from graph_brute import brute, random_pairs


def test_shares():
    assert shares([70, 15, 15], 20) == [14, 3, 3] and shares([1, 1], 3) == [2, 1] and shares([0, 0], 2) == [2, 0]


@pytest.mark.parametrize("seats", [[700, 150, 150], [1, 0, 2], [0, 5], [3], [123, 45, 6, 7, 0, 891]])
def test_dealing_is_exact_and_even(spark, seats):
    """Every split gets its seats, and never strays from its running share by more than
    the splits before it can shift it."""
    n = sum(seats)
    places = F.array(*[F.struct(F.lit(f"s{i}").alias("split"), F.lit(k).cast("long").alias("seats")) for i, k in enumerate(seats)])
    got = [r.s for r in spark.range(1, n + 1).select("id", dealt_to(F.col("id"), places).alias("s")).orderBy("id").collect()]
    assert Counter(got) == {f"s{i}": k for i, k in enumerate(seats) if k}
    for i, k in enumerate(seats):
        run = 0
        for r, s in enumerate(got, 1):
            run += s == f"s{i}"
            assert abs(run - r * k / n) <= len(seats) + 1
    huge = 3 * 10**9
    far = F.array(F.struct(F.lit("a").alias("split"), F.lit(huge).cast("long").alias("seats")), F.struct(F.lit("b").alias("split"), F.lit(huge).cast("long").alias("seats")))
    assert [r.s for r in spark.range(2 * huge - 1, 2 * huge + 1).select(dealt_to(F.col("id"), far).alias("s")).collect()] == ["b", "a"]


def test_forest_spans_and_is_lightest(spark):
    """Against Kruskal: same components, as many edges as a tree has, the same total weight."""
    rng = random.Random(8)
    pairs = [(a, b, float(rng.randint(1, 50))) for a, b in random_pairs(rng)]
    df = spark.createDataFrame([*pairs, (None, "x", 1.0), ("y", "y", 1.0)], "src string, dst string, w double")
    forest, labels = spanning_forest(df, weight="w")
    forest = forest.collect()
    want = brute([(a, b) for a, b, _ in pairs if a != b])
    groups = defaultdict(set)
    for r in labels.collect():
        groups[r.component].add(r.vertex)
    expected = defaultdict(set)
    for v, root in want.items():
        expected[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert len(forest) == len(want) - len(expected)
    parent, total = {v: v for v in want}, 0.0

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b, w in sorted(pairs, key=lambda p: p[2]):
        if a != b and find(a) != find(b):
            parent[find(a)] = find(b)
            total += w
    assert sum(r.weight for r in forest) == pytest.approx(total)
    assert len(brute([(r.u, r.v) for r in forest])) == len(want)
    for tail_edges in (0, 10):  # rounds to the end, and a task that takes over late
        other, rounds = contract(df, weight="w", tail_edges=tail_edges)
        assert {(r.u, r.v, r.weight) for r in other.collect()} == {(r.u, r.v, r.weight) for r in forest}
        sets = defaultdict(set)
        for r in labels_of(other, rounds).collect():
            sets[r.component].add(r.vertex)
        assert sorted(map(sorted, sets.values())) == sorted(map(sorted, groups.values()))


TARGETS = {"train": 700, "validation": 150, "test": 150}


def test_split_keeps_groups_whole(spark):
    """A giant group, many small ones and lone records: no group is torn, shares hold."""
    ids = [f"r{i:05d}" for i in range(6000)]
    rng = random.Random(2)
    pairs = [("s:" + i, "t:giant") for i in ids[:2000]]
    at = 2000
    while at < 4000:
        n = rng.randint(2, 12)
        pairs += [("s:" + i, f"t:g{at}") for i in ids[at : at + n]]
        at += n
    records = spark.createDataFrame([(i, "x", 1) for i in ids + ids[:50]] + [(None, "x", 1)], "sample_id string, split string, group_size int")
    out = split_records(records, spark.createDataFrame(pairs, "src string, dst string"), TARGETS).collect()
    assert sorted(r.sample_id for r in out) == ids
    by_group = defaultdict(set)
    for r in out:
        by_group[r.group_first].add(r.split)
    assert all(len(v) == 1 for v in by_group.values()) and len(by_group) > 1000
    assert next(r.group_size for r in out if r.sample_id == ids[0]) == 2000
    got = Counter(r.split for r in out)
    assert all(abs(got[k] - 6000 * v / 1000) <= 12 for k, v in TARGETS.items()), got


def test_split_does_not_depend_on_partitions_or_ranges(spark, monkeypatch):
    from maskmill import runtime

    rng = random.Random(5)
    pairs = [(f"s:r{rng.randint(0, 900)}", f"t:g{rng.randint(0, 300)}") for _ in range(700)]
    records = spark.createDataFrame([(f"r{i}",) for i in range(1500)], "sample_id string")
    edges = spark.createDataFrame(pairs, "src string, dst string")
    one = {r.sample_id: r.split for r in split_records(records, edges, TARGETS).collect()}
    monkeypatch.setattr(runtime, "RANK_ROWS", 50)
    assert {r.sample_id: r.split for r in split_records(records.repartition(7), edges.repartition(5), TARGETS).collect()} == one


def test_split_edge_cases(spark):
    none = spark.createDataFrame([], "src string, dst string")
    records = spark.createDataFrame([("a",), ("b",)], "sample_id string")
    assert {r.group_size for r in split_records(records, none, TARGETS).collect()} == {1}
    assert split_records(records.limit(0), none, TARGETS).collect() == []
    assert {r.split for r in split_records(records, none, {"only": 1, "none": 0}).collect()} == {"only"}
    with pytest.raises(ValueError):
        split_records(records, none, {"none": 0}).collect()


def test_torn_groups(spark):
    df = spark.createDataFrame(
        [("a", "x", 1, False), ("a", "x", 1, False), ("b", "x", 1, False), ("b", None, 1, False), ("c", "x", 1, True), ("d", None, None, False), ("d", None, None, False), ("e", "x", 1, False), ("e", "x", 2, False)],
        "g string, p string, fold int, own boolean",
    )
    assert sorted(r.g for r in torn_groups(df, "g", [F.col("p"), F.col("fold")], F.col("own")).collect()) == ["b", "c", "e"]
