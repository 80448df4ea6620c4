"""The grid and the forest when no table may be broadcast."""

import random
from collections import defaultdict

from graph_brute import brute, random_pairs

from maskmill import runtime
from maskmill.llm.components import connected_components
from maskmill.llm.group_split import contract, labels_of


def test_without_broadcasts(spark, monkeypatch):
    monkeypatch.setattr(runtime, "BROADCAST_ROWS", -1)
    monkeypatch.setattr(runtime, "HOT_ROWS", 3)
    pairs = random_pairs(random.Random(12))
    df = spark.createDataFrame(pairs, "src string, dst string")
    want = brute([p for p in pairs if p[0] != p[1]])
    assert {r.vertex: r.component for r in connected_components(df, cell_edges=20).collect()} == want
    forest, rounds = contract(df, tail_edges=0)
    labels = labels_of(forest, rounds)
    groups, expected = defaultdict(set), defaultdict(set)
    for r in labels.collect():
        groups[r.component].add(r.vertex)
    for v, root in want.items():
        expected[root].add(v)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))
    assert forest.count() == len(want) - len(expected)
