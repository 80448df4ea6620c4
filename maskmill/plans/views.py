"""Evaluation views over the tables at hand; every view has its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskmill.runtime import table


def pixels(spark: SparkSession, sf_dir: str, every_sample: bool = False, numbered: bool = False) -> DataFrame:
    """Line items as the pixels of an order: class, target and three probabilities, with
    the line ``numbered`` as the place of the pixel.

    Samples of a lesion class without a lesion pixel are no valid input and left out.
    """
    key = F.col("l_orderkey")
    cls = (key % 3).cast("int")
    raw = table(spark, sf_dir, "lineitem").select(
        key.alias("sample_id"), cls.alias("class_id"), F.when((cls > 0) & (F.col("l_returnflag") != "A"), cls).otherwise(0).alias("target"), "l_partkey", "l_suppkey", F.floor("l_extendedprice").alias("price"),
        *([F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate").alias("pixel")] if numbered else []),
    )
    extra = lambda k, v: F.when(F.col("target") == k, v).otherwise(0)
    w = [1 + F.col("l_partkey") % 97 + extra(0, 80), 1 + F.col("l_suppkey") % 53 + extra(1, 60), 1 + F.col("price") % 59 + extra(2, 60)]
    heavy = raw.select("sample_id", "class_id", "target", *(["pixel"] if numbered else []), *[x.cast("double").alias(f"w{k}") for k, x in enumerate(w)])
    if not every_sample:
        heavy = heavy.withColumn("__top", F.max("target").over(Window.partitionBy("sample_id"))).filter("class_id = 0 OR __top > 0").drop("__top")
    total = F.col("w0") + F.col("w1") + F.col("w2")
    return heavy.select("sample_id", "class_id", "target", *(["pixel"] if numbered else []), *[(F.col(f"w{k}") / total).alias(f"p{k}") for k in range(3)])


_WEIGHTED = """
raw AS (
  SELECT l_orderkey AS sample_id, CAST(l_orderkey % 3 AS INTEGER) AS class_id,
    CASE WHEN l_orderkey % 3 > 0 AND l_returnflag <> 'A' THEN CAST(l_orderkey % 3 AS INTEGER) ELSE 0 END AS target, l_partkey, l_suppkey, CAST(floor(l_extendedprice) AS BIGINT) AS price
  FROM lineitem
),
weighted AS (
  SELECT sample_id, class_id, target, CAST(1 + l_partkey % 97 + CASE WHEN target = 0 THEN 80 ELSE 0 END AS DOUBLE) AS w0,
    CAST(1 + l_suppkey % 53 + CASE WHEN target = 1 THEN 60 ELSE 0 END AS DOUBLE) AS w1, CAST(1 + price % 59 + CASE WHEN target = 2 THEN 60 ELSE 0 END AS DOUBLE) AS w2,
    max(target) OVER (PARTITION BY sample_id) AS top
  FROM raw
)"""
ALL_PIXELS_SQL = _WEIGHTED + ",\npixels AS (SELECT sample_id, class_id, target, w0 / (w0 + w1 + w2) AS p0, w1 / (w0 + w1 + w2) AS p1, w2 / (w0 + w1 + w2) AS p2 FROM weighted)"
PIXELS_SQL = ALL_PIXELS_SQL[:-1] + " WHERE class_id = 0 OR top > 0)"


def clean(column):
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per manifest sample: deliveries that say the same are put together."""
    text = ["diagnosis", "aspect_ratio_bin", "partition", "exclusion_reason", "content_group", "exact_duplicate_group", "near_duplicate_group"]
    number = ["class_id", "eligible", "original_height", "original_width", "aspect_ratio", "lesion_pixels", "lesion_fraction", "lesion_size_quartile", "mask_count", "multi_mask", "image_read_ok", "mask_qc_ok", "fold"]
    raw = ["decoded_pixel_sha256", "source_image_sha256", "source_image_path", "union_mask_sha256", "calibration_for_folds", "previous_split", "bounding_box_xywh", "qc_notes"]
    return table(spark, sf_dir, "manifest").groupBy("sample_id").agg(*[F.min(clean(F.col(c))).alias(c) for c in text], *[F.min(c).alias(c) for c in number], *[F.min(c).alias(c) for c in raw])


SAMPLES_SQL = """
samples AS (
  SELECT sample_id, min(lower(trim(diagnosis))) AS diagnosis, min(lower(trim(aspect_ratio_bin))) AS aspect_ratio_bin, min(lower(trim(partition))) AS partition,
    min(lower(trim(exclusion_reason))) AS exclusion_reason, min(lower(trim(content_group))) AS content_group, min(lower(trim(exact_duplicate_group))) AS exact_duplicate_group,
    min(lower(trim(near_duplicate_group))) AS near_duplicate_group, min(class_id) AS class_id, min(eligible) AS eligible, min(original_height) AS original_height,
    min(original_width) AS original_width, min(aspect_ratio) AS aspect_ratio, min(lesion_pixels) AS lesion_pixels, min(lesion_fraction) AS lesion_fraction,
    min(lesion_size_quartile) AS lesion_size_quartile, min(mask_count) AS mask_count, min(multi_mask) AS multi_mask, min(image_read_ok) AS image_read_ok,
    min(mask_qc_ok) AS mask_qc_ok, min(fold) AS fold, min(decoded_pixel_sha256) AS decoded_pixel_sha256, min(source_image_sha256) AS source_image_sha256,
    min(source_image_path) AS source_image_path, min(union_mask_sha256) AS union_mask_sha256, min(calibration_for_folds) AS calibration_for_folds, min(previous_split) AS previous_split,
    min(bounding_box_xywh) AS bounding_box_xywh, min(qc_notes) AS qc_notes
  FROM manifest GROUP BY sample_id
)"""
