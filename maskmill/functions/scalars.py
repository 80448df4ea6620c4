"""Scalar functions as Spark columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stable_id(diagnosis: Column, stem: Column) -> Column:
    """``benign_0012`` from the first number of the stem; without one, a slug of it.

    Numbers of more than four digits keep them all.
    """
    number = F.regexp_extract(stem, r"(\d+)", 1)
    slug = F.trim(F.regexp_replace(F.lower(stem), "[^a-z0-9]+", "_"), F.lit("_"))
    padded = F.when(F.length(number) >= 4, F.coalesce(F.nullif(F.ltrim(number, F.lit("0")), F.lit("")), F.lit("0"))).otherwise(number)
    return F.concat(diagnosis, F.lit("_"), F.when(number == "", slug).otherwise(F.when(F.length(padded) >= 4, padded).otherwise(F.lpad(padded, 4, "0"))))


def patient_id(path: Column, strict: bool = False) -> Column:
    """``P_00016`` anywhere in a path; where there is none NULL, or an error if strict."""
    found = F.nullif(F.regexp_extract(path, r"(P_\d+)", 1), F.lit(""))
    return F.coalesce(found, F.raise_error(F.concat(F.lit("no patient id in "), F.coalesce(path, F.lit("NULL")))).cast("string")) if strict else found


def annotation_path(folder: Column, name: Column) -> Column:
    return F.concat(folder, F.lit("/ann/"), name, F.lit(".json"))


def split_list(text: Column, delimiters: str = ";") -> Column:
    """Trimmed, non-empty parts of a simple list."""
    parts = F.transform(F.split(F.coalesce(text, F.lit("")), f"[{delimiters}]"), lambda x: F.trim(x))
    return F.filter(parts, lambda x: x != "")


def join_sorted(values: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(values)), ";")


def fold_list(text: Column) -> Column:
    """Fold numbers of ``0;2``, ``1|4``, ``["0","2"]``, ``1 + 2``, ``{0, 3}`` and the like.

    Every whole number counts, whatever stands around it; parts of words, of decimals and
    of negative numbers do not.
    """
    numbers = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"(?<![\w.\-])\d+(?![\w.\-])"), F.lit(0))
    return F.array_compact(F.transform(numbers, lambda x: x.try_cast("int")))


def four_digits(prefix: str, number: Column) -> Column:
    """``prefix_0007``; wider numbers are not cut."""
    return F.format_string(prefix + "_%04d", number)


def aspect_bin(ratio: Column) -> Column:
    """Below 0.8 portrait, above 1.25 landscape, else square; 0.0 (unreadable) is portrait."""
    return F.when(ratio < 0.8, "portrait").when(ratio > 1.25, "landscape").otherwise(F.when(ratio.isNotNull(), F.lit("square")))


def aspect_ratio(width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), width / height).otherwise(0.0)


def lesion_fraction(pixels: Column, width: Column, height: Column) -> Column:
    return F.when((width > 0) & (height > 0), pixels / (width.cast("long") * height)).otherwise(0.0)


def stratum(diagnosis: Column, quartile: Column, shape: Column) -> Column:
    return F.concat_ws("|", diagnosis, F.concat(F.lit("q"), quartile.cast("string")), shape)


def infer_cell(text: Column) -> Column:
    """Type that a cell of an untyped table would get: bool, null, int, float or string."""
    t = F.lower(F.trim(text))
    return (
        F.when(t.isNull() | t.isin("", "none", "null", "nan"), "null").when(t.isin("true", "false"), "bool").when(F.trim(text).try_cast("bigint").isNotNull() & t.rlike(r"^[+-]?\d+$"), "int")
        .when(F.trim(text).try_cast("double").isNotNull() & t.rlike(r"^[+-]?(\d+\.?\d*|\.\d+)(e[+-]?\d+)?$"), "float").otherwise("string")
    )


def cast_cell(text: Column) -> Column:
    """The cell under its inferred type: a struct of kind, flag, whole, number and text, in
    which only the member of its kind is set."""
    kind, t = infer_cell(text), F.trim(text)
    return F.struct(
        kind.alias("kind"), F.when(kind == "bool", F.lower(t) == "true").alias("flag"), F.when(kind == "int", t.try_cast("bigint")).alias("whole"),
        F.when(kind == "float", t.try_cast("double")).alias("number"), F.when(kind == "string", text).alias("text"),
    )


def class_of_name(name: Column) -> Column:
    """0, 1, 2 from a diagnosis or from the number itself; NULL for anything else."""
    t = F.lower(F.trim(name.cast("string")))
    return F.when(t.isin("normal", "0"), 0).when(t.isin("benign", "1"), 1).when(t.isin("malignant", "2"), 2)


def quartile_number(label: Column) -> Column:
    """3 from ``Q3``; 0 for ``normal``; NULL for anything else."""
    t = F.lower(F.trim(label))
    return F.when(t.isin("normal", "0"), 0).when(t.rlike("^q?[1-4]$"), F.regexp_extract(t, r"([1-4])", 1).cast("int"))


def name_contains(name: Column, word: str) -> Column:
    """Whether a name holds a word, in any case."""
    return F.coalesce(F.lower(name).contains(word.lower()), F.lit(False))


def hash_part(text: Column, parts: int) -> Column:
    """A number below ``parts`` from the sha256 of a text."""
    return F.pmod(F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("long"), F.lit(parts))


def keyword_class(text: Column) -> Column:
    """2 where the text says malignant, 1 where benign; 1 where it says neither."""
    t = F.lower(F.coalesce(text, F.lit("")))
    return F.when(t.contains("malignant"), 2).when(t.contains("benign"), 1).otherwise(1)


def resolve_path(path: Column, root: str, existing: Column | None = None) -> Column:
    """The path below ``root``; absolute ones as they are. With ``existing``, an array of
    the files there are, a path that is not below ``root`` but below its parent is that."""
    base = root.rstrip("/")
    below, beside = F.concat(F.lit(base + "/"), path), F.concat(F.lit(base.rpartition("/")[0] + "/"), path)
    found = below if existing is None else F.when(~F.array_contains(existing, below) & F.array_contains(existing, beside), beside).otherwise(below)
    return F.when(F.startswith(path, F.lit("/")), path).otherwise(found)


def round_half_even(value: Column, digits: int) -> Column:
    """Rounded by its decimal text, ties to the even digit."""
    return F.bround(value, digits)


def minutes_seconds(elapsed: Column) -> tuple[Column, Column]:
    whole = F.floor(elapsed).cast("long")
    return F.floor(whole / 60).cast("int"), (whole % 60).cast("int")


#: Largest map size, then its three rates; beyond them the last ones.
ATROUS = ((16, (2, 3, 5)), (24, (2, 4, 6)), (40, (3, 6, 9)))
ATROUS_BEYOND = (6, 12, 18)


def atrous_rates(size: Column) -> Column:
    """Dilation rates of a feature map; a kernel of three must fit the map, so no rate
    exceeds half of it. NULL for sizes below one."""
    limit = F.greatest(F.lit(1), F.floor((size - 1) / 2).cast("int"))
    chosen = F.array(*[F.lit(r) for r in ATROUS_BEYOND])
    for most, rates in reversed(ATROUS):
        chosen = F.when(size <= most, F.array(*[F.lit(r) for r in rates])).otherwise(chosen)
    return F.when(size > 0, F.transform(chosen, lambda r: F.least(r, limit)))


def size_cuts(df: DataFrame, group: str, value: str) -> DataFrame:
    """Exact quartile cuts (linear) of a value per group."""
    return df.groupBy(group).agg(F.expr(f"percentile(`{value}`, array(0.25, 0.5, 0.75))").alias("cuts"))


def quartile_of(value: Column, cuts: Column) -> Column:
    """1 + the number of cuts at most the value."""
    return (1 + F.size(F.filter(cuts, lambda c: c <= value))).cast("int")
