import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from maskmill.llm.packing import best_fit, enumerate_patterns, nnls, pack, plan
from maskmill.llm.tokens import encoder, token_count


def contents_of(recipes, capacity):
    got = Counter()
    for times, contents in recipes:
        assert times > 0 and 0 < sum(k * v for k, v in contents.items()) <= capacity
        for k, v in contents.items():
            got[k] += times * v
    return got


def test_patterns_fill_exactly():
    patterns, left_out = enumerate_patterns(np.array([1, 3, 4, 10]), 10)
    assert left_out == 0
    assert {10: 1} in patterns and {1: 10} in patterns and {3: 3, 1: 1} in patterns
    assert all(sum(k * v for k, v in p.items()) == 10 for p in patterns)


def test_every_length_is_a_main_length():
    """All lengths up to the capacity: each has its patterns, and what is left out is counted."""
    capacity = 300
    patterns, left_out = enumerate_patterns(np.arange(1, capacity + 1), capacity)
    few, more_left = enumerate_patterns(np.arange(1, capacity + 1), capacity, 1)
    assert {k for p in patterns for k in p} == set(range(1, capacity + 1)) and left_out > 0
    assert len(few) < len(patterns) and more_left > left_out
    assert all(any(p.get(a) for p in patterns if len(p) >= 2) for a in range(1, capacity))
    pairs = {(a, b, c) for a in range(1, 41) for b in range(1, 41) for c in [40 - a - b] if c >= b}
    whole, none = enumerate_patterns(np.arange(1, 41), 40, 1000)
    assert none == 0 and {tuple(sorted([a, b, c])) for a, b, c in pairs} <= {tuple(sorted(k for k, v in p.items() for _ in range(v))) for p in whole}


def test_nnls_against_a_known_solution():
    a = np.array([[2.0, 0.0, 1.0], [0.0, 3.0, 1.0]])
    rows, cols = np.nonzero(a)
    x = nnls(rows, cols, a[rows, cols], a @ np.array([5.0, 0.0, 2.0]), 3, 5000)
    assert np.all(x >= 0) and np.allclose(a @ x, [12, 2], atol=1e-3)


@pytest.mark.parametrize("n,worst", [(5, 0.0), (300, 0.9), (20_000, 0.995)])
def test_plan_packs_all_and_well(n, worst):
    rng = np.random.default_rng(n)
    lengths = np.clip(rng.lognormal(5, 1, n).astype(int), 1, 2048)
    histogram = dict(Counter(lengths.tolist()))
    recipes = plan(histogram, 2048)
    assert contents_of(recipes, 2048) == histogram
    containers = sum(t for t, _ in recipes)
    assert lengths.sum() / 2048 / containers >= worst


def test_best_fit_against_item_by_item():
    """Equal containers filled together give no more containers than one item at a time."""
    rng = random.Random(3)
    for _ in range(60):
        items = [rng.randint(1, 50) for _ in range(rng.randint(1, 80))]
        left = np.zeros(51, np.int64)
        for i in items:
            left[i] += 1
        recipes = best_fit(left, 50)
        assert contents_of(recipes, 50) == Counter(items)
        free = []
        for i in sorted(items, reverse=True):
            fit = [f for f in free if f >= i]
            if fit:
                free.remove(min(fit))
                free.append(min(fit) - i)
            else:
                free.append(50 - i)
        assert sum(t for t, _ in recipes) == len(free)


def test_equal_lengths_and_bad_lengths():
    assert sum(t for t, _ in plan({700: 10}, 2048)) == 5
    assert sum(t for t, _ in plan({2048: 7}, 2048)) == 7 and plan({}, 2048) == []
    with pytest.raises(ValueError):
        plan({3000: 1}, 2048)


def test_pack(spark, monkeypatch):
    import maskmill.runtime as runtime

    monkeypatch.setattr(runtime, "RANK_ROWS", 200)
    rng = random.Random(9)
    rows = [(i, rng.choice([100, 100, 100, rng.randint(1, 90)]), "x", 1) for i in range(1500)] + [(2000, 250, "x", 1), (2001, 201, None, 1), (2002, 0, None, 1), (2003, None, None, 1), (None, 40, "x", 1), (2000, 250, "x", 1)]
    df = spark.createDataFrame(rows, "id long, n int, container string, chunk int").repartition(3)
    out = pack(df, "id", "n", 100).collect()
    used = defaultdict(int)
    by_id = defaultdict(list)
    for r in out:
        by_id[r.id].append((r.chunk, r.chunk_size))
        if r.container is not None:
            used[r.container] += r.chunk_size
    assert max(used.values()) <= 100 and sorted(used) == list(range(len(used)))
    assert sorted(by_id[2000]) == [(1, 100), (1, 100), (2, 100), (2, 100), (3, 50), (3, 50)] and sorted(by_id[2001]) == [(1, 100), (2, 100), (3, 1)]
    assert by_id[2002] == by_id[2003] == [(1, 0)] and by_id[None] == [(1, 40)]
    assert all(len(v) == 1 for k, v in by_id.items() if k is not None and k < 2000)
    total = sum(used.values())
    assert total == sum(r[1] or 0 for r in rows) and len(used) <= total / 100 * 1.02
    assert pack(df.limit(0), "id", "n", 100).collect() == []
    with pytest.raises(ValueError):
        pack(df, "id", "n", 0)


def test_tokens(spark):
    texts = [None, "", "a", "naïve — 21 × 19 mm", "x " * 50_000, "<|endoftext|>"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = {r.i: r.n for r in df.select("i", token_count(df.t).alias("n")).collect()}
    assert [got[i] for i in range(len(texts))] == [0, 0, *[len(encoder().encode_ordinary(t)) for t in texts[2:]]]
    assert got[5] > 1
