"""Readers and writers of manifests, logs, reports and annotation files."""

from __future__ import annotations

import json
import math
import os
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_INTS = (
    "class_id",
    "eligible",
    "original_height",
    "original_width",
    "lesion_pixels",
    "connected_components",
    "lesion_size_quartile",
    "mask_count",
    "multi_mask",
    "image_read_ok",
    "mask_qc_ok",
    "fold",
    "split_seed",
)
_FLOATS = (
    "aspect_ratio",
    "lesion_fraction",
)
#: Columns of a written manifest, in order. The file format.
MANIFEST_COLUMNS = (
    "sample_id",
    "diagnosis",
    "class_id",
    "eligible",
    "exclusion_reason",
    "source_image_path",
    "source_mask_paths",
    "image_path",
    "mask_path",
    "original_height",
    "original_width",
    "aspect_ratio",
    "lesion_pixels",
    "lesion_fraction",
    "connected_components",
    "bounding_box_xywh",
    "lesion_size_quartile",
    "aspect_ratio_bin",
    "mask_count",
    "multi_mask",
    "image_read_ok",
    "mask_qc_ok",
    "qc_notes",
    "source_image_sha256",
    "decoded_pixel_sha256",
    "source_mask_sha256s",
    "union_mask_sha256",
    "generated_image_sha256",
    "generated_mask_sha256",
    "exact_duplicate_group",
    "near_duplicate_group",
    "content_group",
    "grouping_evidence",
    "previous_split",
    "previous_names",
    "partition",
    "fold",
    "calibration_for_folds",
    "split_seed",
    "manifest_version",
    "dataset_fingerprint",
)


def manifest_schema() -> T.StructType:
    kind = lambda c: T.IntegerType() if c in _INTS else T.DoubleType() if c in _FLOATS else T.StringType()
    return T.StructType([T.StructField(c, kind(c)) for c in MANIFEST_COLUMNS])


def _without_bom(df: DataFrame) -> DataFrame:
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_manifest_csv(spark: SparkSession, path: str, schema: T.StructType | None = None) -> DataFrame:
    """A manifest with typed columns; columns are found by name, a byte-order mark is
    dropped, missing columns and cells that do not parse are null."""
    raw = _without_bom(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    schema = schema or manifest_schema()
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_rows(spark: SparkSession, path: str) -> DataFrame:
    """Rows of a CSV, JSON-lines or JSON file, told apart by the suffix. A JSON document
    is a list of rows or an object that holds them under ``samples`` or ``rows``."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix == ".csv":
        return _without_bom(spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(path))
    if suffix in (".jsonl", ".ndjson"):
        return spark.read.json(path)
    if suffix == ".json":
        doc = spark.read.option("multiLine", True).json(path)
        for name in ("samples", "rows"):
            if name in doc.columns and isinstance(doc.schema[name].dataType, T.ArrayType):
                return doc.select(F.explode(name).alias("r")).select("r.*")
        return doc
    if suffix == ".parquet":
        return spark.read.parquet(path)
    raise ValueError(f"unknown kind of table: {path}")


def write_csv(df: DataFrame, path: str, columns: list[str] | None = None, overwrite: bool = False) -> None:
    """Rows with a fixed list of columns; others are left out, missing ones empty."""
    columns = columns or df.columns
    out = df.select(*[F.col(f"`{c}`") if c in df.columns else F.lit(None).cast("string").alias(c) for c in columns])
    out.write.mode("overwrite" if overwrite else "errorifexists").option("header", True).option("escape", '"').csv(path)


def write_json_report(report: dict, path: str) -> None:
    """A small report, written whole or not at all; keys sorted, NaN refused."""
    text = json.dumps(report, sort_keys=True, indent=2, allow_nan=False, ensure_ascii=False)
    part = f"{path}.part"
    with open(part, "w", encoding="utf-8") as f:
        f.write(text + "\n")
        f.flush()
        os.fsync(f.fileno())
    os.replace(part, path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Append rows as JSON lines; each append commits its own files."""
    df.write.mode("append").json(path)


def write_probabilities(df: DataFrame, path: str, **provenance: str) -> None:
    """A probability table with its provenance in every row; an existing one is kept."""
    df.withColumns({k: F.lit(v) for k, v in provenance.items()}).write.mode("errorifexists").parquet(path)


def read_probabilities(spark: SparkSession, path: str, **provenance: str) -> DataFrame:
    """A probability table whose rows all carry the provenance asked for; one that differs,
    or an empty table, is an error."""
    df = spark.read.parquet(path)
    lacking = sorted(set(provenance) - set(df.columns))
    if lacking:
        raise ValueError(f"{path} carries no {', '.join(lacking)}")
    if df.isEmpty():
        raise ValueError(f"{path} is empty")
    for name, value in provenance.items():
        other = df.filter(~F.col(name).eqNullSafe(F.lit(value))).select(name).first()
        if other:
            raise ValueError(f"{path} has {name} {other[0]!r}, not {value!r}")
    return df


def materialize(files: DataFrame, root: str) -> None:
    """Write (path, content) rows as files below ``root``, a folder that all executors share;
    an existing root is refused, and every file appears whole or not at all."""
    os.makedirs(root)

    def write(rows) -> None:
        for r in rows:
            to = os.path.join(root, r["path"])
            if os.path.relpath(to, root).startswith(".."):
                raise ValueError(f"{r['path']} leaves the folder")
            os.makedirs(os.path.dirname(to), exist_ok=True)
            part = f"{to}.{uuid.uuid4().hex}.part"
            with open(part, "wb") as f:
                f.write(r["content"])
            os.replace(part, to)

    files.select("path", "content").foreachPartition(write)


def free_name(path: str) -> str:
    """The path, or the first of path_2, path_3, .. that does not exist (local file systems)."""
    out, n = path, 2
    while os.path.exists(out):
        out, n = f"{path}_{n}", n + 1
    return out


def scan_images(spark: SparkSession, root: str, pattern: str = "*.png") -> DataFrame:
    """Image files below ``root``: path, class folder, file name, bytes; mask files apart."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(root)
    parts = F.split("path", "/")
    name = F.element_at(parts, -1)
    return files.select("path", F.element_at(parts, -2).alias("folder"), name.alias("file_name"), F.regexp_extract(name, r"^(.*?)(_mask(?:_\d+)?)?\.[^.]*$", 1).alias("stem"), name.contains("_mask").alias("is_mask"), "content")


def with_masks(files: DataFrame) -> DataFrame:
    """Every image with the sorted list of its masks, empty if it has none."""
    masks = files.filter("is_mask").groupBy("folder", "stem").agg(F.array_sort(F.collect_list("path")).alias("mask_paths"))
    return files.filter("NOT is_mask").join(masks, ["folder", "stem"], "left").withColumn("mask_paths", F.coalesce("mask_paths", F.array().cast("array<string>")))


def paired(images: DataFrame, masks: DataFrame, name: str = "file_name") -> tuple[DataFrame, DataFrame]:
    """(pairs on the file name, images without a partner)."""
    other = masks.select(F.col(name).alias("__n"), F.col("path").alias("mask_path")).dropDuplicates(["__n"])
    return images.join(other, F.col(name) == F.col("__n")).drop("__n"), images.join(other, F.col(name) == F.col("__n"), "left_anti")


ANNOTATION = (
    "tags array<struct<name: string, value: string>>, size struct<height: int, width: int>, "
    "objects array<struct<geometryType: string, bitmap: struct<data: string, origin: array<int>>, points: struct<exterior: array<array<double>>, interior: array<array<array<double>>>>>>"
)


def annotations(df: DataFrame, text: str) -> DataFrame:
    """Objects of annotation texts with their place; damaged texts give no rows."""
    doc = F.from_json(F.when(F.try_parse_json(text).isNotNull(), F.col(text)), ANNOTATION)
    kept = [c for c in df.columns if c != text]
    return df.select(*kept, doc.alias("__d")).select(*kept, F.col("__d.tags").alias("tags"), F.posexplode_outer("__d.objects").alias("object_no", "object"))


def tag_text(tags: Column) -> Column:
    """Tag names and values as one text, for keyword rules."""
    return F.array_join(F.transform(F.coalesce(tags, F.array().cast("array<struct<name:string,value:string>>")), lambda t: F.concat_ws(" ", t["name"], t["value"])), " ")


def finite(value: float) -> float | None:
    """NULL for NaN and infinities, which JSON lacks."""
    return value if value is not None and math.isfinite(value) else None
