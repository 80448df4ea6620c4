"""Queries over the project's own tables that need no part of the ``llm`` subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.operators.nested import REST, Group, level_columns, nested_tables
from maskmill.operators.packed import split_packed
from maskmill.runtime import table

#: Packed manifest fields and the delimiters that only they may use: a digest holds no
#: blank, a fold number neither blank nor ``+`` nor ``/``; paths and names may.
PACKED_FIELDS = {"source_mask_paths": "", "source_mask_sha256s": " ", "previous_names": "", "calibration_for_folds": " +/"}


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of a packed manifest field that holds two or more."""
    return split_packed(table(spark, sf_dir, "manifest"), ["sample_id"], PACKED_FIELDS, PACKED_FIELDS, min_values=2)


def p1_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value of the packed manifest fields, those that stand alone included."""
    return split_packed(table(spark, sf_dir, "manifest"), ["sample_id"], PACKED_FIELDS, PACKED_FIELDS)


_POINT = Group("points", ("y", "x"), within=("boundary",))
_COMPONENT = Group("components", ("component", "area_px", "box", "boundary.hd95", REST), (_POINT,), "component", ("prediction",))
_IMAGE = Group("per_image", ("sample_id", "class_id", "binary_dice", "predicted_diagnosis", REST), (_COMPONENT,), "sample_id", ("details",))
#: calibration_fixed_0_50: heads, their images, the images' components and boundary points.
CALIBRATION = Group(
    "head",
    ("head", "sample_count", "D_N", "D_B_bin", "D_M_bin", "D_bin_bal", "S_bal", "multiclass_ece", "subgroup_counts", "per_class_pixel_metrics", "diagnosis_confusion_matrix", REST),
    (_IMAGE,),
    "head",
    names=("p1", "p2"),
)
#: fit_regime: the gap figures and their class rows.
FIT = Group("fit", ("train_S_bal", "validation_S_bal", "probe_sample_count", "S_bal_gap", REST), (Group("probe_by_class", ("diagnosis", "n", "train_fg_dice", REST), key="diagnosis"),))
_LINE = ["log_id", "run_id", "epoch"]


def _int(name: str):
    return F.expr(f"try_cast(try_cast({name} as double) as int)")


def _number(name: str):
    return F.expr(f"try_cast({name} as double)")


def _calibration(spark: SparkSession, sf_dir: str, keys: list[str], tables: dict) -> DataFrame:
    return nested_tables(table(spark, sf_dir, "training"), keys, "calibration_fixed_0_50", CALIBRATION, tables)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per nested image, component and probe object of a training line."""
    image = {"head": "head.head", "item_key": "per_image.sample_id"}
    below = _calibration(spark, sf_dir, ["log_id"], {"per_image": image, "components": image | {"sub": "components.component"}})
    probes = nested_tables(
        table(spark, sf_dir, "training"), ["log_id"], "fit_regime", FIT, {"probe_by_class": {"item_key": "probe_by_class.diagnosis"}}
    )
    child = F.when(F.col("table_name") == "per_image", "image").otherwise("component")
    return below.filter(F.col("head").isin("p1", "p2")).select(
        "log_id", child.alias("child"), "head", "item_key", F.when(child == "image", F.lit(0)).otherwise(_int("sub")).alias("sub_key")
    ).unionByName(probes.select("log_id", F.lit("probe").alias("child"), F.lit("fit").alias("head"), "item_key", F.lit(0).alias("sub_key")))


def p5_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of heads: one row per head of a line, with its figures."""
    names = {x: x.replace("diagnosis_", "") for x in CALIBRATION.leaves if x not in ("head", REST)}
    out = _calibration(spark, sf_dir, _LINE, {"head": {"head": "head.head", "other": f"head.{REST}"} | {n: f"head.{x}" for x, n in names.items()}})
    numbers = ("D_N", "D_B_bin", "D_M_bin", "D_bin_bal", "S_bal", "multiclass_ece")
    return out.select(
        *_LINE, "head", _int("sample_count").alias("sample_count"), *[_number(n).alias(n) for n in numbers], "subgroup_counts", "per_class_pixel_metrics", "confusion_matrix", "other"
    )


def p5_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of images: linked to the line and, by head, to the head."""
    cols = {"head": "head.head", "image_no": "#per_image", "other": f"per_image.{REST}"} | {x: f"per_image.{x}" for x in _IMAGE.leaves if x != REST}
    out = _calibration(spark, sf_dir, _LINE, {"per_image": cols})
    return out.select(*_LINE, "head", _int("image_no").alias("image_no"), "sample_id", _int("class_id").alias("class_id"), _number("binary_dice").alias("binary_dice"), "predicted_diagnosis", "other")


def p5_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of components: linked to the line, the head and the image."""
    cols = {"head": "head.head", "image_no": "#per_image", "sample_id": "per_image.sample_id", "component_no": "#components", "hd95": "components.boundary.hd95", "other": f"components.{REST}"}
    out = _calibration(spark, sf_dir, _LINE, {"components": cols | {x: f"components.{x}" for x in ("component", "area_px", "box")}})
    box = F.from_json("box", "array<int>")
    return out.select(
        *_LINE, "head", _int("image_no").alias("image_no"), "sample_id", _int("component_no").alias("component_no"), _int("component").alias("component"), _int("area_px").alias("area_px"),
        *[F.get(box, i).alias(f"box_{n}") for i, n in enumerate("xywh")], _number("hd95").alias("hd95"), "other",
    )


def p5_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of boundary points: linked to the line, head, image and component."""
    cols = {"head": "head.head", "image_no": "#per_image", "component_no": "#components", "point_no": "#points", "y": "points.y", "x": "points.x"}
    out = _calibration(spark, sf_dir, _LINE, {"points": cols})
    return out.select(*_LINE, "head", *[_int(c).alias(c) for c in ("image_no", "component_no", "point_no", "y", "x")])


def p5_probes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Table of probe classes: linked to the line."""
    cols = {"probe_no": "#probe_by_class", "train_S_bal": "fit.train_S_bal"} | {x: f"probe_by_class.{x}" for x in ("diagnosis", "n", "train_fg_dice")}
    out = nested_tables(table(spark, sf_dir, "training"), _LINE, "fit_regime", FIT, {"probe_by_class": cols})
    return out.select(*_LINE, _int("probe_no").alias("probe_no"), "diagnosis", _int("n").alias("n"), _number("train_fg_dice").alias("train_fg_dice"), _number("train_S_bal").alias("line_train_S_bal"))


def p5_levels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shredded form: repetition and definition levels per leaf path."""
    return level_columns(table(spark, sf_dir, "training"), _LINE, "calibration_fixed_0_50", CALIBRATION)


QUERIES = {f.__name__: f for f in (p1_found, p1_values, p5_found, p5_heads, p5_images, p5_components, p5_points, p5_probes, p5_levels)}
#: Elements of a group written as a list, as one object (it has its key) or as a map of objects.
_EACH = """list_filter(CASE json_type({v}) WHEN 'ARRAY' THEN list_transform(CAST({v} AS JSON[]), lambda e: {{'k': NULL::VARCHAR, 'o': e}})
  WHEN 'OBJECT' THEN CASE WHEN json_exists({v}, '$.{key}') THEN [{{'k': NULL::VARCHAR, 'o': {v}}}] ELSE list_transform(json_keys({v}), lambda n: {{'k': n, 'o': json_extract({v}, '$."' || n || '"')}}) END ELSE [] END, lambda x: json_type(x.o) = 'OBJECT')"""
_OPEN = "CASE WHEN json_type({v}) = 'VARCHAR' THEN CASE WHEN json_valid({v} ->> '$') THEN CAST({v} ->> '$' AS JSON) END ELSE {v} END"
_LINES = f"""
texts AS (SELECT log_id, run_id, epoch, CASE WHEN json_valid(calibration_fixed_0_50) THEN CAST(calibration_fixed_0_50 AS JSON) END AS t, CASE WHEN json_valid(fit_regime) THEN CAST(fit_regime AS JSON) END AS f FROM training),
docs AS (SELECT log_id, run_id, epoch, {_OPEN.format(v="t")} AS t, {_OPEN.format(v="f")} AS f FROM texts),
tops AS (SELECT log_id, run_id, epoch, unnest(CASE json_type(t) WHEN 'OBJECT' THEN [{{'h': 'p1', 'j': t -> 'p1'}}, {{'h': 'p2', 'j': t -> 'p2'}}] WHEN 'ARRAY' THEN list_transform(CAST(t AS JSON[]), lambda e: {{'h': e ->> 'head', 'j': e}}) ELSE [] END) AS x FROM docs),
opened AS (SELECT log_id, run_id, epoch, x.h AS head, {_OPEN.format(v="x.j")} AS j, x.j IS NOT NULL AS stands FROM tops),
heads AS (SELECT * FROM opened WHERE json_type(j) = 'OBJECT' AND head IN ('p1', 'p2') AND log_id NOT IN (SELECT log_id FROM opened WHERE stands AND j IS NULL)),
listed AS (SELECT log_id, run_id, epoch, head, coalesce(j -> 'per_image', j -> 'details' -> 'per_image') AS v FROM heads),
spread AS (SELECT log_id, run_id, epoch, head, {_EACH.format(v="v", key="sample_id")} AS xs FROM listed),
images AS (SELECT log_id, run_id, epoch, head, unnest(xs) AS x, generate_subscripts(xs, 1) AS image_no FROM spread),
parts AS (SELECT log_id, run_id, epoch, head, image_no, coalesce(x.o ->> 'sample_id', x.k) AS sample_id, x.o AS o, coalesce(x.o -> 'components', x.o -> 'prediction' -> 'components') AS v FROM images),
inner_parts AS (SELECT * EXCLUDE (o, v), {_EACH.format(v="v", key="component")} AS xs FROM parts),
components AS (SELECT * EXCLUDE (xs), unnest(xs).o AS o, generate_subscripts(xs, 1) AS component_no FROM inner_parts),
fits AS (SELECT log_id, run_id, epoch, f, f -> 'probe_by_class' AS v FROM docs WHERE json_type(f) = 'OBJECT'),
fit_parts AS (SELECT log_id, run_id, epoch, f, {_EACH.format(v="v", key="diagnosis")} AS xs FROM fits),
probes AS (SELECT log_id, run_id, epoch, f, unnest(xs) AS x, generate_subscripts(xs, 1) AS probe_no FROM fit_parts)"""
SQL: dict[str, str] = {
    "p5_found": f"""WITH {_LINES} SELECT log_id, 'image' AS child, head, sample_id AS item_key, 0 AS sub_key FROM parts
UNION ALL SELECT log_id, 'component', head, sample_id, TRY_CAST(TRY_CAST(o ->> 'component' AS DOUBLE) AS INTEGER) FROM components
UNION ALL SELECT log_id, 'probe', 'fit', coalesce(x.o ->> 'diagnosis', x.k), 0 FROM probes""",
}
