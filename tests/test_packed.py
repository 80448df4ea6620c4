import json
import random

import pytest
from pyspark.sql import types as T

from maskmill.operators.packed import DELIMITERS, split_packed, tokenize


@pytest.mark.parametrize(
    "text,values",
    [
        (None, []), ("", []), ("  ", []), ("[]", []), (";", []), ('""', []), ("'';a", ["a"]), (" ; ;a", ["a"]),
        ("a;b", ["a", "b"]), ("a,;b,;", ["a", "b"]), ("a | b;c", ["a", "b", "c"]), ("a\r\nb\tc；d", ["a", "b", "c", "d"]),
        ('"a;b"', ["a;b"]), ('"x 3"" y";\'z\'', ['x 3" y', "z"]), ("\"'17' old\";b", ["'17' old", "b"]),
        ("reader's pick;O'5", ["reader's pick", "O'5"]), ("['a', \"O'1\"]", ["a", "O'1"]), ('["a\\"b", "\\u00e9\\n"]', ['a"b', "é"]),
        ("[4170] scan.png", ["[4170] scan.png"]), ('["[1] a", "b"]', ["[1] a", "b"]), ("{1, 3}", ["1", "3"]),
        ("[[1,2],[3]]", ["1", "2", "3"]), ("[a, c [1,2]]", ["a", "c [1,2]"]), ('"open;b', ['"open', "b"]), ('"a"x;b', ['"a"x', "b"]),
        ("a\\;b;c", ["a;b", "c"]), ('"C:\\d\\";b', ["C:\\d\\", "b"]), ("a;a;a", ["a", "a", "a"]),
    ],
)
def test_tokenizer(text, values):
    assert tokenize(text) == values


def test_very_long_text():
    assert len(tokenize(";".join(["x" * 50] * 20_000))) == 20_000
    assert tokenize("y" * 300_000) == ["y" * 300_000]


def _written(values, style):
    if style == 0:
        return ";".join('"' + v.replace('"', '""') + '"' for v in values)
    if style == 1:
        return json.dumps(values)
    if style == 2:
        return json.dumps(values, ensure_ascii=False, separators=(",", ":"))
    if style == 3:
        return " | ".join("'" + v.replace("'", "''") + "'" for v in values)
    return str(values)


def test_round_trip_of_every_exporter():
    """Whatever an exporter writes comes back: random values with quotes, delimiters, brackets."""
    rng = random.Random(5)
    for _ in range(3000):
        values = []
        for _ in range(rng.randint(1, 5)):
            v = "".join(rng.choice("ab 1\"';,|[]{}é\\") for _ in range(rng.randint(1, 9))).strip()
            if v.strip() and not v.endswith("\\"):
                values.append(v)
        style = rng.randrange(5)
        if not values or style == 4 and any("\\" in v for v in values):
            continue
        if style in (0, 3) and any("\\" in v for v in values):
            continue
        assert tokenize(_written(values, style)) == values, (style, values)


SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in ("sample_id", "a", "b", "pos")])


def test_operator(spark):
    df = spark.createDataFrame(
        [("s1", "x;y", "1+2", "z"), ("s1", '["x","y"]', "{1,2}", "q"), ("s2", None, "", "z"), (None, "p|q", "7", None), ("s3", "one", None, "")], SCHEMA
    )
    out = {tuple(r) for r in split_packed(df, ["sample_id"], ["a", "b"], {"b": "+"}, min_values=2).collect()}
    assert out == {("s1", "a", 1, "x"), ("s1", "a", 2, "y"), ("s1", "b", 1, "1"), ("s1", "b", 2, "2"), (None, "a", 1, "p"), (None, "a", 2, "q")}
    full = split_packed(df, ["sample_id"], ["a", "b"], {"b": "+"})
    assert full.count() == 8 and dict(full.dtypes)["pos"] == "int"
    assert split_packed(df.limit(0), ["sample_id"], ["a", "b"]).collect() == []
    with pytest.raises(ValueError):
        split_packed(df, ["pos"], ["a"])


def test_delimiters_are_a_class():
    for d in DELIMITERS:
        assert tokenize(f"a{d}b") == ["a", "b"]


@pytest.mark.parametrize(
    "text,values",
    [
        ("scan [a; b].png; c.png", ["scan [a; b].png", "c.png"]), ("x; f{1,2}.png | y", ["x", "f{1,2}.png", "y"]), ("a [b {c; d}; e] f; g", ["a [b {c; d}; e] f", "g"]),
        ("a [b; c", ["a [b", "c"]), ("a] b; c", ["a] b", "c"]), ("a [b; c [d; e]", ["a [b", "c [d; e]"]), ("a [b; c}; d", ["a [b", "c}", "d"]),
    ],
)
def test_brackets_within_bare_values(text, values):
    assert tokenize(text) == values


def test_brackets_that_never_close_are_no_slower():
    assert len(tokenize("a[;" * 100_000)) == 100_000
