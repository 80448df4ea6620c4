import random

import pytest

from maskmill.llm.mixing import balanced_sample, flight, landing, mix, mix_report


def test_flight_keeps_both_totals():
    rng = random.Random(1)
    for n in (0, 1, 2, 3, 50, 2000):
        sizes = [float(rng.choice([5, 5, rng.randint(1, 3000)])) for _ in range(n)]
        p = [rng.choice([0.0, 1.0, 0.25, rng.random()]) for _ in range(n)]
        q = flight(p, sizes, 3)
        assert sum(q) == pytest.approx(sum(p)) and sum(a * b for a, b in zip(q, sizes)) == pytest.approx(sum(a * b for a, b in zip(p, sizes)))
        assert sum(1 for x in q if 1e-9 < x < 1 - 1e-9) <= 2
        assert set(landing(q, sizes)) <= {0.0, 1.0}


def test_flight_keeps_the_expectation():
    """Over many seeds every record is taken about as often as its probability says."""
    sizes, p = [10.0, 20.0, 30.0, 40.0, 50.0, 60.0], [0.5, 0.25, 0.75, 0.5, 0.5, 0.5]
    mean = [0.0] * 6
    for seed in range(4000):
        for i, x in enumerate(flight(p, sizes, seed)):
            mean[i] += x / 4000
    assert all(abs(a - b) < 0.03 for a, b in zip(mean, p))


UNITS = "source string, id binary, tokens long, p double"


def test_blocks_give_the_totals(spark):
    rng = random.Random(4)
    rows = [("hot", f"h{i}".encode(), rng.randint(1, 500), 0.3) for i in range(3000)] + [("small", f"s{i}".encode(), 7, 0.5) for i in range(9)]
    df = spark.createDataFrame(rows, UNITS).repartition(3)
    out = {bytes(r.id): r.taken for r in balanced_sample(df, 200).collect()}
    assert len(out) == len(rows)
    want = 0.3 * sum(r[2] for r in rows[:3000])
    assert abs(sum(r[2] * out[r[1]] for r in rows[:3000]) - want) <= 500 and abs(sum(out[r[1]] for r in rows[:3000]) - 900) <= 2
    assert sum(out[r[1]] for r in rows[3000:]) in (4, 5)


RECORDS = "doc_id long, source string, tokens long, copies int"
TARGETS = "source string, target_permille int, max_repeats int"


def test_mix(spark):
    rng = random.Random(5)
    rows = [(i, "big", rng.randint(50, 150), 0) for i in range(800)] + [(1000 + i, "tiny", 20, 0) for i in range(10)] + [(2000 + i, "mid", 100, 0) for i in range(100)]
    rows += [(3000, None, 5000, 0), (3001, "other", 900, 0), (3002, "mid", 0, 0), (3003, "mid", None, 0), (None, "mid", 100, 0)]
    records = spark.createDataFrame(rows, RECORDS).repartition(3)
    targets = spark.createDataFrame([("big", 300, 1), ("tiny", 500, 4), ("mid", 200, 5), ("none", 10, 2), (None, 5, 5), ("big", 300, 1), ("never", 0, 3)], TARGETS)
    report = mix_report(records, targets, "source", "tokens")
    by = {r["source"]: r for r in report}
    total = sum(r[2] or 0 for r in rows)
    assert set(by) == {"big", "tiny", "mid", "none", "never"} and by["tiny"]["short"] and by["none"]["short"] and not by["big"]["short"] and not by["never"]["short"]
    used = mix(records, "doc_id", "source", "tokens", report, 100).collect()
    got = {s: sum(r.tokens * r.copies for r in used if r.source == s) for s in by}
    assert got["tiny"] == 800 and all(r.copies == 4 for r in used if r.source == "tiny")
    assert abs(got["big"] - total * 0.3) < 150 and abs(got["mid"] - total * 0.2) <= 100
    copies = {r.copies for r in used if r.source == "mid"}
    assert copies <= {1, 2} and max(r.copies for r in used if r.source == "big") == 1
    assert {r.source for r in used} == {"big", "tiny", "mid"}


def test_empty(spark):
    records = spark.createDataFrame([], RECORDS)
    targets = spark.createDataFrame([("a", 100, 2)], TARGETS)
    report = mix_report(records, targets, "source", "tokens")
    assert not report[0]["short"] and mix(records, "doc_id", "source", "tokens", report).collect() == []
    assert mix_report(records, targets.limit(0), "source", "tokens") == []
