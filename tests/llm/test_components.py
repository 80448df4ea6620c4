import random

import numpy as np
import pytest
from graph_brute import brute, random_pairs
from pyspark.sql import types as T

from maskmill.llm.components import connected_components, union_find
from maskmill.llm.links import link_edges

PAIR = T.StructType([T.StructField("src", T.StringType()), T.StructField("dst", T.StringType()), T.StructField("vertex", T.StringType())])


def test_union_find_against_brute_force():
    rng = np.random.default_rng(1)
    for n, m in ((1, 0), (5, 3), (200, 150), (1000, 900)):
        u, v = rng.integers(0, n, m), rng.integers(0, n, m)
        got = union_find(u.copy(), v.copy(), n)
        want = brute(list(zip(u.tolist(), v.tolist())))
        assert all(got[x] == want.get(x, x) for x in range(n))


@pytest.mark.parametrize("cell_edges", [10_000, 20])
def test_grid_against_brute_force(spark, cell_edges):
    """A grid whose second round is one cell, and one that must exchange representatives
    over several rounds."""
    pairs = random_pairs(random.Random(4))
    rows = [(*p, "x") for p in pairs] + [(None, "a", None), ("a", None, None), (None, None, None), ("lone", "lone", "x")]
    df = spark.createDataFrame(rows, PAIR).repartition(3)
    got = {r.vertex: r.component for r in connected_components(df, cell_edges=cell_edges).collect()}
    assert got == brute([p for p in pairs if p[0] != p[1]])


def test_empty(spark):
    assert connected_components(spark.createDataFrame([], PAIR)).collect() == []


MANIFEST = "sample_id string, eligible int, exact_duplicate_group string, near_duplicate_group string, content_group string, grouping_evidence string, src string"
CANDIDATES = "sample_a string, sample_b string, group_conservatively int"


def test_links(spark):
    m = spark.createDataFrame(
        [
            ("a", 1, " E1", None, "", "n1:accepted_by_both_reviewers;n2:rejected_by_both_reviewers", "q"),
            ("b", 1, "e1 ", "", None, '["n2:pending_conservative_group"]', "q"),
            ("c", 0, "e1", None, None, "n1:pending_conservative_group", None),
            ("d", 1, None, "e1", " ", " N1 : pending ", None),
            (None, 1, "e1", None, None, None, None),
            ("b", 1, "E1", "", None, None, "q"),
        ],
        MANIFEST,
    )
    c = spark.createDataFrame([("b", "d", 0), ("a", "c", 1), ("d", "a", 1), ("d", "a", 1), (None, "a", 1)], CANDIDATES)
    got = {(r.src, r.dst) for r in link_edges(m, c).collect()}
    assert got == {
        ("s:a", "t:exact_duplicate_group:e1"), ("s:b", "t:exact_duplicate_group:e1"), ("s:a", "t:candidate:n1"), ("s:b", "t:candidate:n2"),
        ("s:d", "t:near_duplicate_group:e1"), ("s:d", "t:candidate:n1"), ("s:d", "s:a"),
    }
    assert link_edges(m.limit(0), c.limit(0)).collect() == []
