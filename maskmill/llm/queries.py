"""Queries and oracle SQL of this subpackage."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from maskmill.llm.components import connected_components
from maskmill.llm.garbled import garbled_records, posteriors, repaired_records
from maskmill.llm.group_split import contract, spanning_forest, split_records, torn_groups
from maskmill.llm.links import SAMPLE, clean, eligible, link_edges
from maskmill.llm.mixing import mix, mix_report
from maskmill.llm.packing import pack
from maskmill.llm.quota_sample import met_report, quota_sample, sample_report
from maskmill.llm.tokens import token_count
from maskmill.operators.packed import DELIMITERS, packed_values
from maskmill.runtime import cut, lookup, table


def _linked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, group_first) of the samples that have a link; a lone one names itself."""
    edges = link_edges(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "near_duplicate_candidates"))
    labels = connected_components(edges)
    bare = [F.substring(c, len(SAMPLE) + 1, 1 << 30).alias(n) for c, n in (("vertex", "sample_id"), ("component", "group_first"))]
    return labels.filter(F.startswith("vertex", F.lit(SAMPLE))).select(*bare)


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The group of every eligible sample that is linked with another."""
    linked = _linked(spark, sf_dir)
    others = linked.filter("sample_id <> group_first")
    firsts = others.select("group_first").distinct()
    return others.unionByName(firsts.select(F.col("group_first").alias("sample_id"), "group_first"))


def p2_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One group identifier for every eligible sample, with the size of its group."""
    members = eligible(table(spark, sf_dir, "manifest")).select("sample_id").distinct()
    other = p2_found(spark, sf_dir).select(F.col("sample_id").alias("__s"), F.col("group_first").alias("__g"))
    labelled = members.join(other, members.sample_id == other["__s"], "left").select("sample_id", F.coalesce("__g", "sample_id").alias("group_first"))
    return labelled.groupBy("group_first").agg(F.count("*").alias("members"), F.max("sample_id").alias("group_last"))


def _recorded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible rows with partition, fold and the set of calibration folds made comparable."""
    folds = F.array_sort(F.array_distinct(F.array_compact(F.transform(packed_values(F.col("calibration_for_folds"), DELIMITERS + " +/"), lambda x: x.try_cast("int")))))
    return eligible(table(spark, sf_dir, "manifest")).select(
        "sample_id", clean(F.col("content_group")).alias("content_group"), clean(F.col("partition")).alias("partition"), "fold", folds.alias("folds")
    )


def _torn(members: DataFrame, group: str) -> DataFrame:
    own = F.coalesce(F.array_contains("folds", F.col("fold")), F.lit(False))
    return torn_groups(members, group, [F.col("partition"), F.col("fold"), F.array_join("folds", ",")], own)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded content groups that the recorded splits tear apart.

    Samples are put together by the roots of the spanning forest of all links, which holds
    every content group whole; the groups of torn roots are then checked by themselves,
    since a root may cover several.
    """
    members = _recorded(spark, sf_dir).filter("content_group <> ''")
    _, labels = spanning_forest(link_edges(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "near_duplicate_candidates")))
    roots = labels.filter(F.startswith("vertex", F.lit(SAMPLE))).select(F.substring("vertex", len(SAMPLE) + 1, 1 << 30).alias("__s"), F.col("component").alias("root"))
    rooted = cut(members.join(roots, members.sample_id == F.col("__s")).drop("__s"))
    torn = _torn(rooted, "root").withColumnRenamed("root", "__t")
    return _torn(lookup(rooted, torn, "root", "__t", "inner"), "content_group")


def p3_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The spanning forest of all links between eligible samples."""
    return contract(link_edges(table(spark, sf_dir, "manifest"), table(spark, sf_dir, "near_duplicate_candidates")))[0]


#: Splits that a target table may name; it is read by the driver, and more are refused.
MAX_SPLITS = 1000


def p3_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every eligible sample with its linked group and its split."""
    manifest = table(spark, sf_dir, "manifest")
    rows = table(spark, sf_dir, "split_targets").limit(MAX_SPLITS + 1).collect()
    if len(rows) > MAX_SPLITS:
        raise ValueError(f"more than {MAX_SPLITS} splits")
    targets = {r["split"]: r["target_permille"] for r in rows}
    return split_records(eligible(manifest), link_edges(manifest, table(spark, sf_dir, "near_duplicate_candidates")), targets)


def p3_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples and groups per split against the target."""
    got = p3_splits(spark, sf_dir).groupBy("split").agg(F.count("*").alias("samples"), F.count_if(F.col("sample_id") == F.col("group_first")).alias("groups"))
    joined = table(spark, sf_dir, "split_targets").join(got, "split", "left").na.fill(0, ["samples", "groups"])
    total = F.sum("samples").over(Window.partitionBy(F.lit(0)))  # one row a split
    return joined.select("split", "target_permille", "samples", "groups", F.round(F.try_divide(F.col("samples") * 1000.0, total), 3).alias("actual_permille"))


def p3_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every group with its samples and the number of splits they stand in."""
    return p3_splits(spark, sf_dir).groupBy("group_first").agg(F.count("*").alias("members"), F.count_distinct("split").alias("splits"))


def p3_recorded_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Linked groups, over all kinds of links, that the recorded splits tear apart."""
    linked = p2_found(spark, sf_dir).select(F.col("sample_id").alias("__s"), "group_first")
    recorded = _recorded(spark, sf_dir)
    return _torn(recorded.join(linked, recorded.sample_id == F.col("__s")), "group_first")


_CATEGORY = ["diagnosis", "lesion_size_quartile", "aspect_ratio_bin"]


def _categorised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per eligible sample; a delivery that lacks a value yields to one that has it."""
    label = [F.min(F.when(clean(F.col(c)) != "", clean(F.col(c)))).alias(c) for c in ("diagnosis", "aspect_ratio_bin")]
    return eligible(table(spark, sf_dir, "manifest")).groupBy("sample_id").agg(*label, F.min("lesion_size_quartile").alias("lesion_size_quartile"))


def _sample_report(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    records = _categorised(spark, sf_dir)
    targets = table(spark, sf_dir, "sample_targets").withColumn("diagnosis", clean(F.col("diagnosis"))).withColumn("aspect_ratio_bin", clean(F.col("aspect_ratio_bin")))
    return sample_report(records, _CATEGORY, targets, "target_permille", "min_rows", lambda total: total // 5)[0], records


def _sampled(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    report, records = _sample_report(spark, sf_dir)
    return report, quota_sample(records, "sample_id", _CATEGORY, report)


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that the drawn sample misses, since the eligible samples cannot meet them."""
    report, sample = _sampled(spark, sf_dir)
    return met_report(report, sample, _CATEGORY).filter("missed").select(*_CATEGORY)


def p4_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target with what there is, what was wanted and what the sample holds."""
    report, sample = _sampled(spark, sf_dir)
    return met_report(report, sample, _CATEGORY)


def p4_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The sample of a fifth of the eligible samples."""
    out = _sampled(spark, sf_dir)[1]
    return out.withColumn("priority", F.round("priority", 9))


#: Tokens a container holds.
CAPACITY = 2048


def _sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the tokens of its whole text; the texts are read once."""
    return cut(table(spark, sf_dir, "documents").select("doc_id", "source", token_count(F.col("text")).alias("tokens")))


def _packed(spark: SparkSession, sf_dir: str) -> DataFrame:
    sized = table(spark, sf_dir, "documents").select("doc_id", token_count(F.col("text")).alias("tokens"))
    return pack(sized, "doc_id", "tokens", CAPACITY)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that no container holds whole: those whose pieces lie in several."""
    placed = _packed(spark, sf_dir).filter("container is not null")
    return placed.groupBy("doc_id").agg(F.min("container").alias("lo"), F.max("container").alias("hi")).filter("lo < hi").select("doc_id")


def p6_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The container of every document, or of every chunk of one that was cut."""
    return _packed(spark, sf_dir)


def p6_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Containers, what they hold, and the least number any packing needs."""
    filled = _packed(spark, sf_dir).filter("container is not null").groupBy("container").agg(F.sum("chunk_size").alias("used"), F.count("*").alias("items"))
    sums = filled.agg(F.count("*").alias("containers"), F.sum("used").alias("tokens"), F.sum("items").alias("items"), F.max("used").alias("fullest"))
    return sums.select(
        "containers", "items", "tokens", "fullest", F.ceil(F.col("tokens") / CAPACITY).alias("least_containers"),
        F.round(F.try_divide(F.col("tokens").cast("double"), F.col("containers") * CAPACITY), 6).alias("fill"),
    )


def _mixed(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(the targets with their figures, copies of every document used)."""
    sized = _sized(spark, sf_dir)
    rows = mix_report(sized, table(spark, sf_dir, "mix_targets"), "source", "tokens")
    targets = spark.createDataFrame(
        [(r["source"], r["target_permille"], r["max_repeats"], r["documents"], r["tokens"], r["total"]) for r in rows],
        "source string, target_permille int, max_repeats int, documents long, tokens long, total long",
    )
    return targets, mix(sized, "doc_id", "source", "tokens", rows)


def _mix_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per target source what the mix holds of it, and whether it falls short: the mix has
    less than the share although every token is repeated as often as it may be."""
    targets, used = _mixed(spark, sf_dir)
    got = used.groupBy(F.col("source").alias("__s")).agg(F.sum(F.col("tokens") * F.col("copies")).alias("mixed_tokens"), F.sum("copies").alias("mixed_documents"), F.max("copies").alias("most_copies"))
    joined = lookup(targets, got, "source", "__s").drop("__s").na.fill(0, ["mixed_tokens", "mixed_documents", "most_copies"])
    wide = lambda c: F.col(c).cast("decimal(38,0)")
    less = wide("mixed_tokens") * 1000 < wide("total") * F.col("target_permille")
    return joined.withColumn("short", less & (F.col("mixed_tokens") == F.col("tokens") * F.col("max_repeats")))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources that the mix cannot give their share even at their largest number of repeats."""
    return _mix_sums(spark, sf_dir).filter("short").select("source")


def p7_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How often each document is used in the mix."""
    return _mixed(spark, sf_dir)[1]


def p7_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target and actual share of every source, and how often it was repeated."""
    whole = F.sum("mixed_tokens").over(Window.partitionBy(F.lit(0)))  # one row a source
    share = F.round(F.try_divide(F.col("mixed_tokens") * 1000.0, whole), 3)
    return _mix_sums(spark, sf_dir).select(
        "source", "target_permille", "max_repeats", "documents", "tokens", (F.col("total") * F.col("target_permille") / 1000).alias("target_tokens"), "short", "mixed_tokens", "mixed_documents", "most_copies", share.alias("actual_permille")
    )


def p8_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents whose text holds garbled characters."""
    return garbled_records(table(spark, sf_dir, "documents"), "doc_id", "text", "source")[0].select("doc_id")


def p8_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The garbled documents, their likeliest encoding chain and the restored text."""
    return repaired_records(table(spark, sf_dir, "documents"), "doc_id", "text", "source")


def p8_chains(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected documents per source and encoding chain."""
    post = posteriors(table(spark, sf_dir, "documents"), "doc_id", "text", "source")
    return post.groupBy("source", "chain").agg(F.round(F.sum("p"), 3).alias("documents")).filter("documents > 0")


_ELIGIBLE = "(SELECT * FROM manifest WHERE eligible = 1 AND sample_id IS NOT NULL)"
_EDGES = f"""
named AS (
  SELECT sample_id, 'e:' || lower(trim(exact_duplicate_group)) AS name FROM {_ELIGIBLE} WHERE trim(exact_duplicate_group) <> ''
  UNION SELECT sample_id, 'n:' || lower(trim(near_duplicate_group)) FROM {_ELIGIBLE} WHERE trim(near_duplicate_group) <> ''
  UNION SELECT sample_id, 'c:' || lower(trim(content_group)) FROM {_ELIGIBLE} WHERE trim(content_group) <> ''
  UNION SELECT sample_id, 'x:' || split_part(entry, ':', 1) FROM (
    SELECT sample_id, unnest(regexp_split_to_array(lower(grouping_evidence), '[;,|\\s]+')) AS entry FROM {_ELIGIBLE}
  ) WHERE entry <> '' AND split_part(entry, ':', 2) <> 'rejected_by_both_reviewers'
),
firsts AS (SELECT name, min(sample_id) AS first FROM named GROUP BY name),
pairs AS (
  SELECT sample_id AS a, first AS b FROM named JOIN firsts USING (name) WHERE sample_id <> first
  UNION SELECT sample_a, sample_b FROM near_duplicate_candidates
  WHERE group_conservatively = 1 AND sample_a IN (SELECT sample_id FROM {_ELIGIBLE}) AND sample_b IN (SELECT sample_id FROM {_ELIGIBLE})
),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (SELECT a AS s, a AS t FROM edges UNION SELECT reach.s, edges.b FROM reach JOIN edges ON reach.t = edges.a),
groups AS (SELECT s AS sample_id, min(t) AS group_first FROM reach GROUP BY s)
"""

_FOLDS = "list_sort(list_distinct(regexp_extract_all(coalesce(calibration_for_folds, ''), '[0-9]+')::INT[]))"
_TARGETS = f"""
samples AS (
  SELECT sample_id, min(lower(trim(diagnosis))) AS diagnosis, min(lesion_size_quartile) AS lesion_size_quartile,
    min(nullif(lower(trim(aspect_ratio_bin)), '')) AS aspect_ratio_bin
  FROM {_ELIGIBLE} GROUP BY sample_id
),
wanted AS (SELECT *, greatest(min_rows, ((SELECT count(*) FROM samples) // 5) * target_permille // 1000) AS wanted FROM sample_targets),
had AS (SELECT diagnosis, lesion_size_quartile, aspect_ratio_bin, count(*) AS available FROM samples GROUP BY ALL)
"""

# floors first, then the smallest priorities, as many as there are seats
_SEATS = """
ranks AS (SELECT s.*, target_permille, min_rows, row_number() OVER (PARTITION BY s.diagnosis, s.lesion_size_quartile, s.aspect_ratio_bin ORDER BY sha256('7:' || sample_id)) AS rank
  FROM samples s JOIN wanted USING (diagnosis, lesion_size_quartile, aspect_ratio_bin)),
ordered AS (SELECT *, row_number() OVER (ORDER BY CASE WHEN rank <= min_rows THEN 0 ELSE 1 END, CASE WHEN rank <= min_rows THEN 0 ELSE (rank - 0.5) / target_permille::DOUBLE END, diagnosis, lesion_size_quartile, aspect_ratio_bin) AS place
  FROM ranks WHERE rank <= min_rows OR target_permille > 0),
seated AS (SELECT * FROM ordered WHERE rank <= min_rows OR place <= (SELECT count(*) FROM samples) // 5)"""

QUERIES = {f.__name__: f for f in (p2_found, p2_groups, p3_found, p3_forest, p3_splits, p3_report, p3_groups, p3_recorded_leaks, p4_found, p4_report, p4_sample, p6_found, p6_containers, p6_report, p7_found, p7_mix, p7_report, p8_found, p8_repaired, p8_chains)}
SQL = {
    "p3_found": f"""SELECT content_group FROM (
  SELECT lower(trim(content_group)) AS content_group, lower(trim(partition)) AS part, fold, {_FOLDS} AS folds FROM {_ELIGIBLE}
) WHERE content_group <> '' GROUP BY content_group
HAVING count(DISTINCT part) > 1 OR count(DISTINCT fold) > 1 OR count(DISTINCT folds::VARCHAR) > 1 OR bool_or(coalesce(list_contains(folds, fold), false))""",
    "p3_recorded_leaks": f"""WITH RECURSIVE {_EDGES}
SELECT group_first FROM groups JOIN (
  SELECT sample_id, lower(trim(partition)) AS part, fold, {_FOLDS} AS folds FROM {_ELIGIBLE}
) USING (sample_id) GROUP BY group_first
HAVING count(DISTINCT part) > 1 OR count(DISTINCT fold) > 1 OR count(DISTINCT folds::VARCHAR) > 1 OR bool_or(coalesce(list_contains(folds, fold), false))""",
    "p4_found": f"""WITH {_TARGETS} SELECT w.diagnosis, w.lesion_size_quartile, w.aspect_ratio_bin FROM wanted w
LEFT JOIN had h USING (diagnosis, lesion_size_quartile, aspect_ratio_bin) WHERE coalesce(available, 0) < wanted""",
    "p4_report": f"""WITH {_TARGETS}, {_SEATS}
SELECT w.diagnosis, w.lesion_size_quartile, w.aspect_ratio_bin, target_permille AS target, min_rows AS floor, coalesce(available, 0) AS available, CAST(wanted AS BIGINT) AS wanted,
  coalesce(n, 0) AS seats, coalesce(n, 0) AS drawn, coalesce(available, 0) < wanted AND coalesce(n, 0) < wanted AS missed
FROM wanted w LEFT JOIN had h USING (diagnosis, lesion_size_quartile, aspect_ratio_bin)
LEFT JOIN (SELECT diagnosis, lesion_size_quartile, aspect_ratio_bin, count(*) AS n FROM seated GROUP BY ALL) USING (diagnosis, lesion_size_quartile, aspect_ratio_bin)""",
    "p4_sample": f"""WITH {_TARGETS}, {_SEATS}
SELECT sample_id, diagnosis, lesion_size_quartile, aspect_ratio_bin, rank, round((rank - 0.5) / target_permille::DOUBLE, 9) AS priority, CASE WHEN rank <= min_rows THEN 'minimum' ELSE 'share' END AS taken_for FROM seated""",
    "p3_groups": f"""WITH RECURSIVE {_EDGES}
SELECT coalesce(group_first, sample_id) AS group_first, count(*) AS members, CAST(1 AS BIGINT) AS splits
FROM (SELECT DISTINCT sample_id FROM {_ELIGIBLE}) LEFT JOIN groups USING (sample_id) GROUP BY 1""",
    "p2_found": f"WITH RECURSIVE {_EDGES} SELECT sample_id, group_first FROM groups",
    "p2_groups": f"""WITH RECURSIVE {_EDGES}
SELECT coalesce(group_first, sample_id) AS group_first, count(*) AS members, max(sample_id) AS group_last
FROM (SELECT DISTINCT sample_id FROM {_ELIGIBLE}) LEFT JOIN groups USING (sample_id) GROUP BY 1""",
}
