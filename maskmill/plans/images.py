"""Queries over masks drawn, pixel by pixel, from the manifest's boxes."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.operators import images as im
from maskmill.plans.evaluation import rounded
from maskmill.plans.views import SAMPLES_SQL, samples
from maskmill.runtime import shuffle_width
from maskmill.sources.tables import annotations, tag_text
from maskmill.functions.scalars import hash_part, keyword_class

def _boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples with their box (x, y, w, h); those without a box are left out."""
    b = F.transform(F.split("bounding_box_xywh", ","), lambda x: F.trim(x).try_cast("int"))
    kept = ("sample_id", "diagnosis", "class_id", "original_height", "original_width")
    out = samples(spark, sf_dir).select(*kept, b.alias("b")).filter("size(b) = 4 and original_height > 0 and original_width > 0")
    return out.select(*kept, hash_part(F.col("sample_id"), 20).alias("part"), *[F.col("b")[i].alias(n) for i, n in enumerate("xywh")]).dropna()


def annotation_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes written as nested annotation texts and read back object by object."""
    corners = F.struct(F.array(F.array("x", "y"), F.array(F.col("x") + F.col("w") - 1, F.col("y") + F.col("h") - 1)).cast("array<array<double>>").alias("exterior"))
    tags = F.array(F.struct(F.lit("pathology").alias("name"), F.upper("diagnosis").alias("value")))
    text = F.to_json(F.struct(tags.alias("tags"), F.array(F.struct(F.lit("rectangle").alias("geometryType"), corners.alias("points"))).alias("objects")))
    objects = annotations(_boxes(spark, sf_dir).select("sample_id", text.alias("doc")), "doc")
    p = F.col("object.points.exterior")
    return objects.select(
        "sample_id", keyword_class(tag_text(F.col("tags"))).alias("tag_class"), "object_no", F.col("object.geometryType").alias("kind"),
        (p[1][0] - p[0][0] + 1).cast("int").alias("w"), (p[1][1] - p[0][1] + 1).cast("int").alias("h"),
    )


def _rectangle(height: int, width: int, x: int, y: int, w: int, h: int) -> np.ndarray:
    mask = np.zeros((height, width), np.uint8)
    mask[max(0, y) : max(0, y + h), max(0, x) : max(0, x + w)] = 1
    return mask


def _per_mask(spark: SparkSession, sf_dir: str, work: Callable, results: str, types: tuple, *extra: str) -> DataFrame:
    """``work(mask, *extra)`` on every drawn mask: masks are drawn where they are used and
    never leave the task."""
    slim = _boxes(spark, sf_dir).select("sample_id", "original_height", "original_width", "x", "y", "w", "h", *extra)
    slim = slim.repartition(shuffle_width(spark))  # rows are small and their work is not: tasks must not be put together
    names = [f.split()[0] for f in results.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = [work(_rectangle(*r[:6]), *r[6:]) for r in zip(*[b.column(i).to_pylist() for i in range(1, b.num_columns)], strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array([r[i] for r in rows], t) for i, t in enumerate(types)]], names=["sample_id", *names])

    return slim.mapInArrow(run, f"sample_id string, {results}")


def mask_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels, parts and box of every drawn mask."""

    def work(mask: np.ndarray) -> tuple:
        found = im.geometry(mask)
        return (found["lesion_pixels"], found["connected_components"], *(found["box"] or (None,) * 4))

    return _per_mask(spark, sf_dir, work, "lesion_pixels int, parts int, x int, y int, w int, h int", (pa.int32(),) * 6)


def surface_distance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HD95 and mean surface distance, in pixels, of each drawn mask to itself moved by
    three columns and two rows."""

    def work(mask: np.ndarray) -> tuple:
        moved = np.zeros_like(mask)
        moved[2:, 3:] = mask[:-2, :-3]
        return im.surface_distances(mask, moved)

    return rounded(_per_mask(spark, sf_dir, work, "hd95 double, assd double", (pa.float64(),) * 2))


#: Side of the square that pictures are brought to.
SIDE = 256


def preprocessed_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels per class after every mask was scaled and padded to a square."""

    def work(mask: np.ndarray) -> tuple:
        return (int(np.count_nonzero(im.fit_mask(mask, SIDE))),)

    lesion = _per_mask(spark, sf_dir, work, "lesion long", (pa.int64(),))
    known = samples(spark, sf_dir).filter("eligible = 1").select(F.col("sample_id").alias("__s"), "class_id")
    per = lesion.join(known, F.col("sample_id") == F.col("__s")).select(F.explode(F.array(F.struct(F.lit(0).alias("target"), (SIDE * SIDE - F.col("lesion")).alias("n")), F.struct(F.col("class_id").alias("target"), F.col("lesion").alias("n")))).alias("p"))
    return per.groupBy("p.target").agg(F.sum("p.n").alias("pixels"))


def manifest_reader(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pictures and masks, drawn as PNG files, read back through the manifest and checked;
    some masks are missing, one column short, or of another class."""

    def work(mask: np.ndarray, class_id: int, part: int) -> tuple:
        label = {1: class_id + 1}.get(part, class_id)
        return im.encode_png(np.full(mask.shape, 7, np.uint8)), None if part == 2 else im.encode_png((mask[:, 1:] if part == 3 else mask) * label)

    rows = samples(spark, sf_dir).select(F.col("sample_id").alias("__s"), "class_id")
    drawn = _per_mask(spark, sf_dir, work, "image binary, mask binary", (pa.binary(),) * 2, "class_id", "part")
    files = drawn.select(F.explode(F.array(F.struct(F.concat(F.lit("images/"), "sample_id").alias("path"), F.col("image").alias("content")), F.struct(F.concat(F.lit("masks/"), "sample_id").alias("path"), F.col("mask").alias("content")))).alias("f")).select("f.*").filter("content is not null")
    wanted = rows.select(F.col("__s").alias("sample_id"), "class_id", F.concat(F.lit("images/"), "__s").alias("image_path"), F.concat(F.lit("masks/"), "__s").alias("mask_path"))
    out = im.checked_samples(wanted, files)
    return out.groupBy("class_id", F.coalesce("problem", F.lit("")).alias("problem")).agg(F.count("*").alias("samples"), F.sum(F.coalesce("lesion_pixels", F.lit(0))).alias("lesion_pixels"))


_BOX = f"""WITH {SAMPLES_SQL}, s AS (SELECT *, list_transform(string_split(bounding_box_xywh, ','), lambda v: TRY_CAST(trim(v) AS INTEGER)) AS b FROM samples WHERE original_height > 0 AND original_width > 0),
boxes AS (SELECT sample_id, diagnosis, original_height, original_width, b[1] AS x, b[2] AS y, b[3] AS w, b[4] AS h FROM s WHERE len(b) = 4 AND b[1] + b[2] + b[3] + b[4] IS NOT NULL)"""
_SHOWN = """shown AS (SELECT *, greatest(0, least(x + w, original_width) - greatest(x, 0)) AS sw, greatest(0, least(y + h, original_height) - greatest(y, 0)) AS sh FROM boxes)"""
SQL = {
    "annotation_boxes": f"{_BOX} SELECT sample_id, CASE WHEN diagnosis = 'malignant' THEN 2 ELSE 1 END AS tag_class, 0 AS object_no, 'rectangle' AS kind, w, h FROM boxes",
    "mask_geometry": f"{_BOX}, {_SHOWN} SELECT sample_id, sw * sh AS lesion_pixels, 1 AS parts, x, y, sw AS w, sh AS h FROM shown",
    "preprocessed_counts": f"""{_BOX}, {_SHOWN}, fit AS (SELECT *, greatest(1, least(256, CAST(round_even(original_height * (256 / greatest(original_height, original_width)::DOUBLE), 0) AS BIGINT))) AS nh,
  greatest(1, least(256, CAST(round_even(original_width * (256 / greatest(original_height, original_width)::DOUBLE), 0) AS BIGINT))) AS nw FROM shown),
n AS (SELECT sample_id, (((y + sh) * nh + original_height - 1) // original_height - (y * nh + original_height - 1) // original_height) * (((x + sw) * nw + original_width - 1) // original_width - (x * nw + original_width - 1) // original_width) AS lesion FROM fit),
p AS (SELECT class_id, lesion FROM n JOIN samples USING (sample_id) WHERE eligible = 1)
SELECT target, CAST(sum(k) AS BIGINT) AS pixels FROM (SELECT 0 AS target, 65536 - lesion AS k FROM p UNION ALL SELECT class_id, lesion FROM p) GROUP BY 1""",
    "manifest_reader": f"""{_BOX}, {_SHOWN}, parts AS (SELECT samples.sample_id, class_id, ('0x' || substr(sha256(samples.sample_id), 1, 8))::BIGINT % 20 AS part, x, sw, sh FROM samples LEFT JOIN shown USING (sample_id)),
judged AS (SELECT class_id, CASE WHEN sw IS NULL THEN 'missing_image' WHEN part = 2 THEN 'missing_mask' WHEN part = 3 THEN 'shape_mismatch' WHEN part = 1 AND sw * sh > 0 THEN 'foreign_label'
  WHEN class_id > 0 AND sw * sh = 0 THEN 'empty_lesion' ELSE '' END AS problem, CASE WHEN class_id = 0 AND part <> 1 THEN 0 ELSE sw * sh END AS n FROM parts)
SELECT class_id, problem, count(*) AS samples, CAST(sum(CASE WHEN problem IN ('', 'foreign_label') THEN n ELSE 0 END) AS BIGINT) AS lesion_pixels FROM judged GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (annotation_boxes, mask_geometry, surface_distance, preprocessed_counts, manifest_reader)}
