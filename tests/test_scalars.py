import pytest
from pyspark.sql import functions as F

from maskmill.functions import ratios as q
from maskmill.functions import scalars as s
from maskmill.functions.config import beside, check_split_arguments, named_profile, overlay
from maskmill.operators import quality


def values(spark, column, rows, schema="x string"):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(column).collect()]


def test_text_functions(spark):
    x = F.col("x")
    rows = [("benign (12)",), ("benign (123456)",), ("scan B-1",), ("No Number!",), ("007",), ("000",)]
    assert values(spark, s.stable_id(F.lit("b"), x), rows) == ["b_0012", "b_123456", "b_0001", "b_no_number", "b_0007", "b_0000"]
    assert values(spark, s.patient_id(x), [("a/P_00016_LEFT/x",), ("none",), (None,)]) == ["P_00016", None, None]
    assert values(spark, s.split_list(x), [(" a; ;b;",), ("",), (None,)]) == [["a", "b"], [], []]
    assert values(spark, s.fold_list(x), [("0; 2,4",), ("x;1",), (None,)]) == [[0, 2, 4], [1], []]
    assert values(spark, s.infer_cell(x), [(v,) for v in ("", " None", "TRUE", "-12", "1.5e3", ".5", "a1", "99999999999999999999", None, "1e")]) == ["null", "null", "bool", "int", "float", "float", "string", "float", "null", "string"]
    assert values(spark, s.class_of_name(x), [(" Benign",), ("2",), ("normal",), ("x",), (None,)]) == [1, 2, 0, None, None]
    assert values(spark, s.quartile_number(x), [("Q3",), ("normal",), ("4",), ("Q5",), (None,)]) == [3, 0, 4, None, None]
    assert values(spark, s.keyword_class(x), [("MALIGNANT and benign",), ("Benign",), ("",), (None,)]) == [2, 1, 1, 1]
    assert values(spark, s.resolve_path(x, "/data/"), [("/a/b",), ("c/d",)]) == ["/a/b", "/data/c/d"]
    assert values(spark, s.four_digits("content", F.lit(7)), [("x",)]) == ["content_0007"] and values(spark, s.four_digits("c", F.lit(12345)), [("x",)]) == ["c_12345"]


def test_bins_on_the_cut(spark):
    x = F.col("x")
    assert values(spark, s.aspect_bin(x), [(0.79999,), (0.8,), (1.25,), (1.2500001,), (0.0,), (None,)], "x double") == ["portrait", "square", "square", "landscape", "portrait", None]
    assert values(spark, s.quartile_of(x, F.array(F.lit(1.0), F.lit(2.0), F.lit(3.0))), [(0.5,), (1.0,), (2.5,), (3.0,)], "x double") == [1, 2, 3, 4]
    df = spark.createDataFrame([("a", float(i)) for i in range(5)], "g string, v double")
    assert s.size_cuts(df, "g", "v").first().cuts == [1.0, 2.0, 3.0]
    assert values(spark, F.struct(*s.minutes_seconds(x)), [(125.9,)], "x double")[0][:] == (2, 5)


def test_ratios(spark):
    df = spark.createDataFrame([(0, 0, 0), (0, 0, 3), (2, 1, 0), (0, 2, 0)], "tp int, fp int, fn int")
    got = [tuple(r) for r in df.select(q.dice("tp", "fp", "fn"), q.iou("tp", "fp", "fn"), q.precision("tp", "fp", "fn"), q.recall("tp", "fn")).collect()]
    assert got == [(None, None, None, None), (0.0, 0.0, 0.0, 0.0), (0.8, pytest.approx(2 / 3), pytest.approx(2 / 3), 1.0), (0.0, 0.0, 0.0, None)]
    assert df.select(q.balanced_mean(F.lit(1.0), F.lit(None))).first()[0] is None


def test_review_truth_table(spark):
    rows = [(a, b) for a in ("", "group", "accept", "same", "separate", "reject", "different", None, " SAME ", "what") for b in ("", "group", "separate", None)]
    df = spark.createDataFrame(rows, "a string, b string")
    state, grouped = quality.review_outcome(F.col("a"), F.col("b"))
    for a, b, st, g in df.select("a", "b", state, grouped).collect():
        one, two = (a or "").strip().lower(), (b or "").strip().lower()
        yes, no = {"group", "accept", "same"}, {"separate", "reject", "different"}
        want = "invalid_decision" if one == "what" else "rejected_by_both_reviewers" if one in no and two in no else "accepted_by_both_reviewers" if one in yes and two in yes else "disputed_conservative_group" if one or two else "pending_conservative_group"
        assert st == want and g == (want != "rejected_by_both_reviewers")


def test_eligibility_order(spark):
    cols = "normal boolean, readable boolean, notes boolean, masks int, px int, torn boolean, denied boolean"
    rows = [
        ((False, False, True, 0, 0, False, False), "unreadable_source_image"), ((True, True, True, 1, 5, False, False), "normal_source_mask_qc_failure"), ((True, True, False, 1, 5, False, False), "normal_source_mask_not_empty"),
        ((False, True, True, 0, 0, False, False), "missing_positive_mask"), ((False, True, True, 1, 0, False, False), "positive_source_mask_qc_failure"), ((False, True, False, 1, 0, False, False), "empty_positive_mask"),
        ((False, False, True, 0, 0, True, False), "contradictory_exact_duplicate"), ((False, False, True, 0, 0, True, True), "known_contradictory_exact_duplicate"), ((False, True, False, 1, 9, False, False), ""),
    ]
    df = spark.createDataFrame([r for r, _ in rows], cols).coalesce(1)
    reason = quality.eligibility_reason(*[F.col(c.split()[0]) for c in cols.split(", ")])
    assert [r[0] for r in df.select(reason).collect()] == [w for _, w in rows]


def test_contract_and_hashes(spark):
    df = spark.createDataFrame([(1, "a"), (2, None)], "id int, v string")
    out = {r.check_name: r.ok for r in quality.contract(df, {"good": (F.count("*"), F.lit(2)), "bad": (F.count("v"), F.lit(2)), "null": (F.max(F.lit(None).cast("int")), F.lit(1))}).collect()}
    assert out == {"good": True, "bad": False, "null": False}
    files = spark.createDataFrame([("x", bytearray(b"abc"))], "name string, content binary")
    recorded = spark.createDataFrame([("x", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("y", "00")], "name string, digest string")
    assert [r.name for r in quality.hash_mismatches(recorded, files, "name", "digest").collect()] == ["y"]


def test_config(tmp_path):
    base = {"a": 1, "b": {"c": 2}}
    assert overlay(base, {"b": {"c": 5}, "_note": "x"}) == {"a": 1, "b": {"c": 5}} and base["b"]["c"] == 2
    for bad, error in (({"z": 1}, KeyError), ({"b": {"z": 1}}, KeyError), ({"b": 1}, TypeError)):
        with pytest.raises(error):
            overlay(base, bad)
    assert named_profile({"v2": {"size": 256}}, " V2 ", size=256)["size"] == 256 and named_profile({"v2": {}}, "new", {"new": "v2"}) == {}
    with pytest.raises(ValueError):
        named_profile({"v2": {"size": 256}}, "v2", size=128)
    (tmp_path / "r.csv").write_text("x")
    assert beside(str(tmp_path / "m.csv"), "q.csv", "r.csv").endswith("r.csv")
    check_split_arguments(0.15, 0.1, 5, {"m": str(tmp_path / "r.csv")})
    for args in ((0, 0.1, 5), (0.1, 1, 5), (0.1, 0.1, 1)):
        with pytest.raises(ValueError):
            check_split_arguments(*args)
    with pytest.raises(FileExistsError):
        check_split_arguments(0.1, 0.1, 5, None, str(tmp_path))


def test_fold_list_of_every_exporter(spark):
    """Whatever delimiters, quotes or brackets an exporter writes around folds."""
    two = ["0;2", "0|2", "0 | 2", '["0","2"]', "['0', '2']", "{0,2}", '"0";"2"', "0；2", "0+2", "0 / 2", "0 2", "0\n2", "0\r\n2", "0\t2", "0;;2", " 0,;2| ", "0;2.5;-1;x3;2;99999999999"]
    assert values(spark, s.fold_list(F.col("x")), [(t,) for t in two]) == [[0, 2]] * len(two)
    assert values(spark, s.fold_list(F.col("x")), [("[]",), (";",), ("",), (None,)]) == [[]] * 4
