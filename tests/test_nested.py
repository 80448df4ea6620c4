import json
import random

import pytest
from pyspark.sql import types as T

from maskmill.operators.nested import REST, Damaged, Group, Levels, level_columns, nested_tables, parse, rebuild
from maskmill.plans.curation import CALIBRATION

DOC = {
    "p1": {"n": 1, "per_image": [{"sample_id": "a", "components": [{"component": 1}, {"component": "2", "boundary": {"points": [{"y": 1, "x": 2}, {"y": 3, "x": 4}]}}]}, {"sample_id": "b"}]},
    "p2": {"per_image": {"c": {"class_id": 1, "components": {"component": 3}}, "d": None}},
}
FORMS = [
    json.dumps(DOC),
    json.dumps(json.dumps(DOC)),
    json.dumps([{"head": k, **v} for k, v in DOC.items()]),
    json.dumps({k: json.dumps(v) for k, v in DOC.items()}),
    "﻿" + json.dumps({"p1": {"n": 1, "details": {"per_image": DOC["p1"]["per_image"]}}, "p2": DOC["p2"], "version": 3}, indent=1),
]
TABLES = {
    "per_image": {"head": "head.head", "image": "per_image.sample_id", "no": "#per_image"},
    "components": {"head": "head.head", "image": "per_image.sample_id", "no": "#components", "component": "components.component"},
    "points": {"component": "components.component", "no": "#points", "x": "points.x"},
}


@pytest.mark.parametrize("text", FORMS)
def test_every_written_form(text):
    levels = Levels(CALIBRATION)
    assert levels.add(None) and levels.add(text) and levels.add("[]")
    images, comps, points = (rebuild(levels, t) for t in ("per_image", "components", "points"))
    assert images["values"]["sample_id"] == ["a", "b", "c"] and images["ordinal"]["per_image"].tolist() == [1, 2, 1]
    assert images["record"].tolist() == [1, 1, 1] and images["row"]["head"].tolist() == [0, 0, 1]
    assert comps["values"]["component"] == ["1", "2", "3"] and comps["row"]["per_image"].tolist() == [0, 0, 2]
    assert points["values"]["x"] == ["2", "4"] and points["row"]["components"].tolist() == [1, 1]


def test_damaged_gives_nothing():
    for text in (FORMS[0][:-20], '{"p1": "{\\"per_image\\": [1,"}', "{", "nul", "[" * 100_000):
        levels = Levels(CALIBRATION)
        assert not levels.add(text)
        assert len(rebuild(levels, "head")["record"]) == 0
    with pytest.raises(Damaged):
        parse('"{"')


def _random_tree(rng, depth=0):
    kids = [] if depth == 3 else [_random_tree(rng, depth + 1) for _ in range(rng.randint(0, 3))]
    out = {"v": rng.choice([None, rng.randint(0, 9), "t"])}
    if kids or rng.random() < 0.5:
        out[f"g{depth + 1}"] = kids
    return out


def test_levels_against_a_recursive_walk():
    """Tables rebuilt from level sequences equal those of a plain recursive walk."""
    root = Group("g0", ("v",), (Group("g1", ("v",), (Group("g2", ("v",), (Group("g3", ("v",)),)),)),))
    rng = random.Random(3)
    docs = [[_random_tree(rng) for _ in range(rng.randint(0, 3))] for _ in range(200)]
    levels = Levels(root)
    for d in docs:
        levels.add(json.dumps(d))
    expected = {f"g{i}": [] for i in range(4)}

    def walk(objs, depth, record, places):
        for i, o in enumerate(objs, 1):
            v = o["v"]
            expected[f"g{depth}"].append((record, (*places, i), None if v is None else str(v)))
            walk(o.get(f"g{depth + 1}") or [], depth + 1, record, (*places, i))

    for i, d in enumerate(docs):
        walk(d, 0, i, ())
    for i in range(4):
        t = rebuild(levels, f"g{i}")
        places = zip(*[t["ordinal"][f"g{k}"].tolist() for k in range(i + 1)])
        assert list(zip(t["record"].tolist(), places, t["values"]["v"])) == expected[f"g{i}"]


SCHEMA = T.StructType([T.StructField("log_id", T.LongType()), T.StructField("doc", T.StringType()), T.StructField("head", T.StringType())])


def test_operator(spark):
    rows = [(i, f, "x") for i, f in enumerate(FORMS)] + [(50, None, None), (51, "", None), (None, FORMS[0], None), (52, "{bad", None)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = nested_tables(df, ["log_id"], "doc", CALIBRATION, TABLES).collect()
    for key in [*range(len(FORMS)), None]:
        mine = [r for r in out if r.log_id == key]
        assert sorted((r.head, r.image, r.no) for r in mine if r.table_name == "per_image") == [("p1", "a", "1"), ("p1", "b", "2"), ("p2", "c", "1")]
        assert sorted((r.image, r.no, r.component) for r in mine if r.table_name == "components") == [("a", "1", "1"), ("a", "2", "2"), ("c", "1", "3")]
        assert sorted((r.component, r.no, r.x) for r in mine if r.table_name == "points") == [("2", "1", "2"), ("2", "2", "4")]
    assert {r.log_id for r in out} == {*range(len(FORMS)), None}
    assert nested_tables(df.limit(0), ["log_id"], "doc", CALIBRATION, TABLES).collect() == []
    with pytest.raises(ValueError):
        nested_tables(df, ["head"], "doc", CALIBRATION, {"head": {"head": "head.head"}})
    levels = level_columns(df, ["log_id"], "doc", CALIBRATION)
    assert levels.filter("damaged").select("log_id").distinct().collect()[0][0] == 52
    row = levels.filter("log_id = 0 and leaf_path = 'head.per_image.components.points.x'").first()
    assert row.leaf_values == [None, "2", "4", None, None] and row.repetition == [0, 3, 4, 2, 1] and row.definition == [3, 5, 5, 2, 3]


def test_other_scalars_are_kept():
    levels = Levels(Group("g", ("a", REST)))
    levels.add('{"a": 1, "b": true, "c": [1, 2]}')
    assert rebuild(levels, "g")["values"] == {"a": ["1"], REST: ['{"b":true,"c":[1,2]}']}
