import random
from collections import Counter

import pytest

from maskmill.llm.quota_sample import met_report, priority_seats, quota_sample, sample_report, seeded_hash


def brute_seats(available, targets, floors, seats):
    """Sort every record by (within its floor first, priority, category)."""
    rows = []
    for c, n in enumerate(available):
        for r in range(1, n + 1):
            if r <= floors[c]:
                rows.append((0, 0.0, c))
            elif targets[c] > 0:
                rows.append((1, (r - 0.5) / targets[c], c))
    rows.sort()
    floor_rows = sum(1 for x in rows if x[0] == 0)
    out = Counter(c for _, _, c in rows[: max(seats, floor_rows)])
    return [out[c] for c in range(len(available))]


def test_seats_against_a_full_sort():
    rng = random.Random(6)
    for _ in range(400):
        k = rng.randint(1, 6)
        available = [rng.randint(0, 40) for _ in range(k)]
        targets = [float(rng.choice([0, 1, 5, 10, 37])) for _ in range(k)]
        floors = [rng.randint(0, 6) for _ in range(k)]
        seats = rng.randint(0, 120)
        assert priority_seats(available, targets, floors, seats) == brute_seats(available, targets, floors, seats)


RECORDS = "id string, cat string, bin int, rank int"
TARGETS = "cat string, bin int, permille int, floor int"


def test_sample(spark):
    rows = [(f"a{i}", "a", 1, 0) for i in range(600)] + [(f"b{i}", "b", 1, 0) for i in range(20)] + [(f"c{i}", "c", None, 0) for i in range(50)] + [(f"d{i}", "d", 4, 0) for i in range(330)]
    records = spark.createDataFrame(rows, RECORDS).repartition(3)
    targets = spark.createDataFrame([("a", 1, 500, 0), ("b", 1, 300, 5), ("c", None, 200, 10), ("gone", 7, 1, 3), ("c", None, 150, 10)], TARGETS)
    report, n = sample_report(records, ["cat", "bin"], targets, "permille", "floor", lambda t: t // 5)
    got = {r.cat: r for r in report.collect()}
    assert n == 200 and len(got) == 4
    assert (got["b"].seats, got["b"].missed, got["b"].wanted) == (20, True, 60) and (got["gone"].seats, got["gone"].missed) == (0, True)
    assert got["a"].seats + got["c"].seats == 180 and got["c"].seats == 50 and not got["c"].missed
    taken = quota_sample(records, "id", ["cat", "bin"], report).collect()
    assert len(taken) == len({r.id for r in taken}) == 200 and Counter(r.cat for r in taken) == {"a": 130, "b": 20, "c": 50}
    assert sum(1 for r in taken if r.taken_for == "minimum") == 15
    met = {r.cat: r for r in met_report(report, quota_sample(records, "id", ["cat", "bin"], report), ["cat", "bin"]).collect()}
    assert {k: (r.drawn, r.missed) for k, r in met.items()} == {"a": (130, False), "b": (20, True), "c": (50, False), "gone": (0, True)}
    again = quota_sample(records.repartition(7), "id", ["cat", "bin"], report).collect()
    assert {r.id for r in again} == {r.id for r in taken}


def test_empty(spark):
    records = spark.createDataFrame([], RECORDS)
    targets = spark.createDataFrame([("a", 1, 500, 2)], TARGETS)
    report, n = sample_report(records, ["cat", "bin"], targets, "permille", "floor", 10)
    assert n == 10 and report.first().missed and quota_sample(records, "id", ["cat", "bin"], report).collect() == []
    none, _ = sample_report(spark.createDataFrame([("x", "a", 1, 0)], RECORDS), ["cat", "bin"], targets.limit(0), "permille", "floor", 10)
    assert none.collect() == []


def test_ranks_are_exact_in_buckets(spark, monkeypatch):
    from pyspark.sql import functions as F

    import maskmill.runtime as runtime

    monkeypatch.setattr(runtime, "RANK_ROWS", 100)
    df = spark.range(3000).select("id", (F.col("id") % 3 == 0).cast("int").alias("g"))
    out = runtime.ranked(df, ["g"], ["id"], hashed=seeded_hash(F.col("id"), 1)).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.max("rank").alias("m")).collect()
    assert all(r.n == r.d == r.m for r in out)


@pytest.mark.parametrize("seats", [0, 5])
def test_floors_alone_can_exceed_the_size(seats):
    assert priority_seats([10, 10], [1.0, 1.0], [4, 4], seats) == [4, 4]
