"""Links between eligible manifest samples, as edges to shared names.

A name that several samples carry (a recorded group, a review candidate) is a vertex of
its own: each sample that carries it gives one edge, so a hot group costs as many edges
as it has samples and no pairs are formed. Names sort after samples, so the smallest
vertex of a group is always a sample.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from maskmill.operators.packed import packed_values

GROUP_FIELDS = ("exact_duplicate_group", "near_duplicate_group", "content_group")
REJECTED = "rejected_by_both_reviewers"
SAMPLE, NAME = "s:", "t:"


def clean(column):
    """Lower case without outer white space."""
    return F.lower(F.regexp_replace(column, r"^\s+|\s+$", ""))


def eligible(manifest: DataFrame) -> DataFrame:
    return manifest.filter((F.col("eligible") == 1) & F.col("sample_id").isNotNull())


def link_edges(manifest: DataFrame, candidates: DataFrame) -> DataFrame:
    """Edges (src, dst) between eligible samples and the names they share.

    Blank and null names link nothing. An entry of grouping_evidence without a state is
    kept, one whose state is a rejection is not. Candidate rows count only if both of
    their samples are eligible.
    """
    rows = eligible(manifest)
    named = [F.when(clean(F.col(f)) != "", F.concat(F.lit(f"{NAME}{f}:"), clean(F.col(f)))) for f in GROUP_FIELDS]
    entry = F.transform(
        packed_values(F.col("grouping_evidence")),
        lambda e: F.when(
            (clean(F.substring_index(e, ":", 1)) != "") & ~(F.contains(e, F.lit(":")) & (clean(F.substring_index(e, ":", -1)) == REJECTED)),
            F.concat(F.lit(f"{NAME}candidate:"), clean(F.substring_index(e, ":", 1))),
        ),
    )
    names = F.array_compact(F.concat(F.array(*named), F.coalesce(entry, F.array().cast("array<string>"))))
    shared = rows.select(F.concat(F.lit(SAMPLE), "sample_id").alias("src"), F.explode(names).alias("dst"))
    ids = rows.select(F.col("sample_id").alias("__id")).distinct()
    pairs = candidates.filter("group_conservatively = 1 and sample_a <> sample_b").select("sample_a", "sample_b").distinct()
    pairs = pairs.join(ids, pairs.sample_a == ids["__id"], "left_semi")
    pairs = pairs.join(ids, pairs.sample_b == ids["__id"], "left_semi")
    return shared.unionByName(pairs.select(F.concat(F.lit(SAMPLE), "sample_a").alias("src"), F.concat(F.lit(SAMPLE), "sample_b").alias("dst")))
