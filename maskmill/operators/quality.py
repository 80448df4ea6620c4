"""Curation checks: eligibility, review decisions, contracts. Each gives a table of
violations or outcomes; none collects rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GROUP = ("group", "accept", "same")
SEPARATE = ("separate", "reject", "different")


def eligibility_reason(normal: Column, readable: Column, mask_notes: Column, masks: Column, lesion_pixels: Column, contradictory: Column, denied: Column) -> Column:
    """First reason that excludes a sample, empty if none; contradictory duplicates and
    then the deny list override whatever was found before."""
    first = (
        F.when(~readable, "unreadable_source_image")
        .when(normal & mask_notes, "normal_source_mask_qc_failure").when(normal & (lesion_pixels > 0), "normal_source_mask_not_empty")
        .when(~normal & (masks == 0), "missing_positive_mask").when(~normal & mask_notes, "positive_source_mask_qc_failure").when(~normal & (lesion_pixels == 0), "empty_positive_mask")
        .otherwise("")
    )
    return F.when(denied, "known_contradictory_exact_duplicate").when(contradictory, "contradictory_exact_duplicate").otherwise(first)


def decision(text: Column) -> Column:
    """Trimmed lower-case review decision; NULL if it is none of the allowed ones."""
    t = F.lower(F.trim(F.coalesce(text, F.lit(""))))
    return F.when(t.isin("", *GROUP, *SEPARATE), t)


def review_outcome(one: Column, two: Column) -> tuple[Column, Column]:
    """(state, grouped) of two decisions; only two rejections keep a pair apart."""
    a, b = decision(one), decision(two)
    state = (
        F.when(a.isNull() | b.isNull(), "invalid_decision").when(a.isin(*SEPARATE) & b.isin(*SEPARATE), "rejected_by_both_reviewers")
        .when(a.isin(*GROUP) & b.isin(*GROUP), "accepted_by_both_reviewers").when((a != "") | (b != ""), "disputed_conservative_group").otherwise("pending_conservative_group")
    )
    return state, (state != "rejected_by_both_reviewers").cast("int")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Keys that stand more than once."""
    return df.groupBy(*keys).agg(F.count("*").alias("copies")).filter("copies > 1")


def contract(df: DataFrame, checks: dict[str, tuple[Column, Column]]) -> DataFrame:
    """One row per check (name, observed, expected, ok), all in one pass over the table.

    ``checks`` maps a name to an aggregate and what it must equal.
    """
    both = [c.cast("string").alias(f"{side}{i}") for i, pair in enumerate(checks.values()) for side, c in zip("oe", pair, strict=True)]
    rows = F.explode(F.array(*[F.struct(F.lit(n).alias("check_name"), F.col(f"o{i}").alias("observed"), F.col(f"e{i}").alias("expected"), F.col(f"o{i}").eqNullSafe(F.col(f"e{i}")).alias("ok")) for i, n in enumerate(checks)]))
    return df.agg(*both).select(rows.alias("r")).select("r.*")


def written_paths(key: Column, eligible: Column) -> tuple[Column, Column]:
    """Paths of image and mask below the output folder; those of the others are quarantined."""
    prefix = F.when(eligible, "").otherwise("quarantine/")
    return tuple(F.concat(prefix, F.lit(f"{kind}/"), key, F.lit(".png")) for kind in ("images", "masks"))


def hash_mismatches(recorded: DataFrame, files: DataFrame, key: str, digest: str) -> DataFrame:
    """Files that are missing or whose recomputed digest differs. ``files`` has (key, content)."""
    now = files.select(F.col(key).alias("__k"), F.sha2("content", 256).alias("actual"))
    return recorded.join(now, F.col(key) == F.col("__k"), "left").filter(~F.col("actual").eqNullSafe(F.col(digest))).select(key, digest, "actual")
