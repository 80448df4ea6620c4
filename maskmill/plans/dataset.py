"""Curation queries over the manifest and its review tables, with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.functions import scalars as s
from maskmill.operators import dedup, graph, quality, splits
from maskmill.operators.provenance import row_digest, table_digest
from maskmill.plans.evaluation import rounded
from maskmill.plans.views import SAMPLES_SQL, samples
from maskmill.runtime import table

#: Known contradictory files (class folder, file name) that are always excluded.
DENIED = (("benign", "benign (433).png"), ("malignant", "malignant (145).png"))


def exact_duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_groups(samples(spark, sf_dir), "decoded_pixel_sha256", "sample_id", "diagnosis")


def _reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir)
    torn = exact_duplicate_groups(spark, sf_dir).filter("contradictory = 1").select(F.col("decoded_pixel_sha256").alias("__d"))
    joined = rows.join(torn, F.col("decoded_pixel_sha256") == F.col("__d"), "left")
    file = F.struct(F.element_at(F.split("source_image_path", "/"), 1).alias("a"), F.element_at(F.split("source_image_path", "/"), -1).alias("b"))
    denied = file.isin([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in DENIED])
    reason = quality.eligibility_reason(
        F.col("diagnosis") == "normal", F.col("image_read_ok") == 1, F.col("mask_qc_ok") == 0, F.col("mask_count"), F.coalesce("lesion_pixels", F.lit(0)), F.col("__d").isNotNull(), denied
    )
    return joined.select("sample_id", "diagnosis", "eligible", reason.alias("reason"))


def eligibility_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _reasons(spark, sf_dir).select("sample_id", "reason")


def eligibility_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples by computed reason and recorded flag."""
    return _reasons(spark, sf_dir).groupBy("reason", "eligible").agg(F.count("*").alias("samples"))


def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stable ids from file names, and how many samples share one."""
    rows = samples(spark, sf_dir)
    stem = F.regexp_replace(F.element_at(F.split("source_image_path", "/"), -1), r"\.[^.]*$", "")
    return rows.groupBy(s.stable_id(F.col("diagnosis"), stem).alias("stable_id")).agg(F.count("*").alias("samples"))


def size_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Size quartile of every sample from exact cuts over eligible positives per diagnosis."""
    rows = samples(spark, sf_dir)
    positive = (F.col("eligible") == 1) & (F.col("class_id") > 0)
    cuts = s.size_cuts(rows.filter(positive), "diagnosis", "lesion_fraction").withColumnRenamed("diagnosis", "__g")
    joined = rows.join(F.broadcast(cuts), F.col("diagnosis") == F.col("__g"), "left")  # one row a diagnosis
    return joined.select("sample_id", F.when(positive, s.quartile_of(F.col("lesion_fraction"), F.col("cuts"))).otherwise(0).alias("quartile"))


def stratum_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = samples(spark, sf_dir).filter("eligible = 1")
    shape = s.aspect_bin(s.aspect_ratio(F.col("original_width"), F.col("original_height")))
    return rows.groupBy(s.stratum(F.col("diagnosis"), F.coalesce("lesion_size_quartile", F.lit(0)), shape).alias("stratum")).agg(F.count("*").alias("samples"))


def geometry_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recorded geometry against the formula: how many samples disagree, by class."""
    rows = samples(spark, sf_dir)
    ratio, part = s.aspect_ratio(F.col("original_width"), F.col("original_height")), s.lesion_fraction(F.col("lesion_pixels"), F.col("original_width"), F.col("original_height"))
    return rows.groupBy("diagnosis").agg(
        F.count("*").alias("samples"), F.count_if(F.abs(ratio - F.col("aspect_ratio")) > 1e-6).alias("ratio_off"), F.count_if(F.abs(part - F.col("lesion_fraction")) > 1e-6).alias("fraction_off"),
        F.count_if(s.aspect_bin(ratio) != F.col("aspect_ratio_bin")).alias("bin_off"),
    )


def manifest_pixel_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pixels per class from the geometry of eligible samples alone."""
    area = F.col("original_height").cast("long") * F.col("original_width")
    out = samples(spark, sf_dir).filter("eligible = 1").agg(
        F.sum(area - F.coalesce("lesion_pixels", F.lit(0))).alias("background"), F.sum(F.when(F.col("class_id") == 1, F.col("lesion_pixels"))).alias("benign"), F.sum(F.when(F.col("class_id") == 2, F.col("lesion_pixels"))).alias("malignant")
    )
    return out.select("background", "benign", "malignant", F.round(F.sqrt(F.col("background") / F.col("benign")), 6).alias("benign_weight"), F.round(F.sqrt(F.col("background") / F.col("malignant")), 6).alias("malignant_weight"))


def dataset_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by diagnosis, partition and fold as one report."""
    rows = samples(spark, sf_dir)
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(k).alias("field"), F.coalesce(F.col(k).cast("string"), F.lit("")).alias("value")) for k in ("diagnosis", "partition", "fold")])).alias("f"), "eligible")
    return long.groupBy("f.field", "f.value").agg(F.count("*").alias("samples"), F.count_if(F.col("eligible") == 1).alias("eligible_samples"))


def previous_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples per earlier split; a sample may have stood in several."""
    rows = samples(spark, sf_dir)
    return rows.select("sample_id", F.explode(F.array_distinct(s.split_list(F.col("previous_split")))).alias("previous")).groupBy("previous").agg(F.count("*").alias("samples"))


def prior_membership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Earlier splits of every picture content, joined back to all samples of that content."""
    rows = samples(spark, sf_dir)
    prior = rows.select("decoded_pixel_sha256", F.explode(s.split_list(F.col("previous_split"))).alias("p")).groupBy("decoded_pixel_sha256").agg(s.join_sorted(F.collect_set("p")).alias("known_splits"))
    prior = prior.withColumnRenamed("decoded_pixel_sha256", "__d")
    return rows.join(prior, F.col("decoded_pixel_sha256") == F.col("__d"), "left").select("sample_id", F.coalesce("known_splits", F.lit("")).alias("known_splits"))


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of repeated candidate rows the one received last."""
    c = table(spark, sf_dir, "near_duplicate_candidates")
    keep = ["received_at", "sample_a", "sample_b", "phash_distance", "aligned_correlation", "registered_mask_dice", "evidence", "reviewer_1_decision", "reviewer_2_decision", "review_state", "group_conservatively"]
    return c.groupBy("candidate_id").agg(F.max(F.struct(*keep)).alias("r")).select("candidate_id", "r.*")


def review_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """State of every candidate by the truth table, against the recorded one."""
    state, grouped = quality.review_outcome(F.col("reviewer_1_decision"), F.col("reviewer_2_decision"))
    out = _candidates(spark, sf_dir).select(state.alias("state"), grouped.alias("grouped"), "review_state", "group_conservatively")
    return out.groupBy("state", "grouped", "review_state").agg(F.count("*").alias("candidates"))


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates per recorded state and whether the review is complete."""
    done = (F.coalesce(F.trim("reviewer_1_decision"), F.lit("")) != "") & (F.coalesce(F.trim("reviewer_2_decision"), F.lit("")) != "")
    return _candidates(spark, sf_dir).agg(F.count("*").alias("candidates"), F.count_if(done).alias("reviewed"), F.bool_and(done).alias("complete"), *[F.count_if(F.col("review_state").startswith(x)).alias(x) for x in ("accepted", "rejected", "disputed", "pending")])


def near_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Evidence of every recorded pair recomputed from its scores."""
    got = dedup.evidence(F.col("phash_distance"), F.col("aligned_correlation"), F.col("registered_mask_dice"))
    return _candidates(spark, sf_dir).select("candidate_id", F.coalesce(got, F.lit("")).alias("recomputed"))


def candidate_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "near_duplicate_candidates")
    return c.select(dedup.candidate_id(F.col("sample_a"), F.col("sample_b")).alias("pair_id"), F.least("sample_a", "sample_b").alias("a"), F.greatest("sample_a", "sample_b").alias("b")).distinct()


def review_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs to review with what is known of both ends; null decisions read as empty."""
    rows = samples(spark, sf_dir)
    c = _candidates(spark, sf_dir)
    one = rows.select(F.col("sample_id").alias("sample_a"), F.col("diagnosis").alias("diagnosis_a"), F.col("partition").alias("partition_a"))
    two = rows.select(F.col("sample_id").alias("sample_b"), F.col("diagnosis").alias("diagnosis_b"), F.col("partition").alias("partition_b"))
    joined = c.join(one, "sample_a").join(two, "sample_b")
    return joined.select("candidate_id", "sample_a", "sample_b", "diagnosis_a", "diagnosis_b", (F.col("partition_a") == F.col("partition_b")).alias("same_partition"), *[F.coalesce(f"reviewer_{i}_decision", F.lit("")).alias(f"decision_{i}") for i in (1, 2)])


def _edges(spark: SparkSession, sf_dir: str, rows: DataFrame) -> DataFrame:
    """Conservative review pairs, and each exact duplicate with the first of its digest."""
    near = _candidates(spark, sf_dir).filter("group_conservatively = 1").select(F.col("sample_a").alias("x"), F.col("sample_b").alias("y"))
    same = dedup.representatives(rows.filter("decoded_pixel_sha256 <> ''"), "sample_id", "decoded_pixel_sha256").filter("sample_id <> representative")
    return near.unionByName(same.select(F.col("sample_id").alias("x"), F.col("representative").alias("y")))


def _grouped(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = samples(spark, sf_dir).filter("eligible = 1")
    return rows, graph.content_groups(rows, "sample_id", _edges(spark, sf_dir, rows), "x", "y")


def content_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Content group of every eligible sample: exact edges and conservative near edges."""
    return _grouped(spark, sf_dir)[1].select("sample_id", "content_group")


def content_groups_by_stars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same groups where no task may join up the edges: the way of large tables."""
    rows = samples(spark, sf_dir).filter("eligible = 1")
    return graph.content_groups(rows, "sample_id", _edges(spark, sf_dir, rows), "x", "y", one_task=0).select("sample_id", "content_group")


def content_group_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, groups = _grouped(spark, sf_dir)
    return graph.group_report(rows.drop("content_group").join(groups, "sample_id"), "content_group", "sample_id", "diagnosis", "partition", "fold").filter("member_count > 1")


def split_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples each split of each outer fold selects."""
    rows = samples(spark, sf_dir)
    sums = [F.count_if(splits.in_split(x)).alias(f"{x}") for x in ("development", "sealed")]
    sums += [F.count_if(splits.in_split(x, k)).alias(f"{x}_{k}") for k in range(5) for x in ("fit", "calibration", "outer")]
    pairs = F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.col(n).alias("samples")) for n in ["development", "sealed", *[f"{x}_{k}" for k in range(5) for x in ("fit", "calibration", "outer")]]]))
    return rows.agg(*sums).select(pairs.alias("p")).select("p.*")


def fit_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The samples that outer fold 0 is fitted on."""
    return samples(spark, sf_dir).filter(splits.in_split("fit", 0)).select("sample_id", "class_id", "fold")


def patient_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients, 80/10/10; every order follows its customer."""
    placed = splits.split_by_group(table(spark, sf_dir, "orders"), "o_custkey")
    return table(spark, sf_dir, "orders").join(placed, "o_custkey").groupBy("split").agg(F.count("*").alias("orders"), F.countDistinct("o_custkey").alias("patients"))


def patient_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.split_by_group(table(spark, sf_dir, "orders"), "o_custkey")


def leakage_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers that a split by single orders would tear apart, per pair of splits."""
    orders = table(spark, sf_dir, "orders")
    part = F.pmod(F.col("o_orderkey"), F.lit(10))
    return splits.leakage(orders.withColumn("split", F.when(part < 8, "train").when(part == 8, "val").otherwise("test")), "o_custkey", "split")


def probe_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.probe(samples(spark, sf_dir).filter("eligible = 1"), "sample_id", "class_id", 96).select("sample_id", "class_id")


def balanced_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(splits.sampling_weights(samples(spark, sf_dir).filter("eligible = 1"), "class_id", {0: 0.2, 1: 0.4, 2: 0.4}), 9)


def greedy_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sealed part, folds and calibration sets by the sequential greedy rules."""
    rows, groups = _grouped(spark, sf_dir)
    shape = F.coalesce("aspect_ratio_bin", F.lit(""))
    members = rows.drop("content_group").join(groups, "sample_id").withColumn("stratum", s.stratum(F.col("diagnosis"), F.coalesce("lesion_size_quartile", F.lit(0)), shape))
    return splits.nested_splits(members, "content_group", "stratum", F.array_contains(s.split_list(F.col("previous_split")), "test"))


def membership_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of the members of each partition."""
    rows = samples(spark, sf_dir).withColumn("grp", F.coalesce("content_group", F.lit("")))
    return table_digest(rows, "sample_id", "grp", "class_id", keys=("partition",))


def repeated_deliveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.duplicate_keys(table(spark, sf_dir, "manifest"), "sample_id")


def phash_bits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hash of every embedding as an 8 x 8 block, by its number of set bits."""
    return table(spark, sf_dir, "embeddings").select("vec_id", F.bit_count(dedup.bits_above_median(F.col("embedding").cast("array<double>"))).alias("set_bits"))


def hamming_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = table(spark, sf_dir, "embeddings").select("vec_id", dedup.bits_above_median(F.col("embedding").cast("array<double>")).alias("bits"))
    return dedup.all_hamming_pairs(v, "vec_id", "bits", 16)


def near_hash_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs within six bits, by bands, among the hashes and copies of them with the highest
    0 to 8 bits turned over."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", dedup.bits_above_median(F.col("embedding").cast("array<double>")).alias("bits"))
    turned = F.array(*[F.lit(((1 << n) - 1) << (64 - n) if n == 0 else (((1 << n) - 1) << (64 - n)) - (1 << 64)).cast("long") for n in range(9)])
    copies = v.select((-1 - F.col("vec_id")).alias("vec_id"), F.col("bits").bitwiseXOR(F.get(turned, F.pmod("vec_id", F.lit(9)).cast("int"))).alias("bits"))
    return dedup.all_hamming_pairs(v.unionByName(copies), "vec_id", "bits", 6)


def banded_cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of cosine 0.95 or more, by hyperplane bands, among the vectors and copies of
    them with one value changed."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    copies = v.select((-1 - F.col("vec_id")).alias("vec_id"), F.transform("e", lambda x, i: F.when(i == 0, x + 0.05).otherwise(x)).alias("e"))
    return rounded(dedup.banded_pairs(v.unionByName(copies), "vec_id", "e", 0.95), 5)


def near_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate candidates among the vectors as pictures of 8 x 8, and copies of every
    third moved by one column; the mask is what is above zero."""
    v = table(spark, sf_dir, "embeddings").select("vec_id", F.slice(F.col("embedding").cast("array<double>"), 1, 64).alias("e"))
    moved = F.transform("e", lambda x, i: F.get("e", (i - F.when(i % 8 > 0, 1).otherwise(0)).cast("int")))
    copies = v.filter("vec_id % 3 = 0").select((F.col("vec_id") + 1_000_000_000).alias("vec_id"), moved.alias("e"))
    both = v.unionByName(copies)
    return dedup.near_search(both.withColumn("m", F.transform("e", lambda x: (x > 0).cast("int"))), "vec_id", "e", "m")


def exact_duplicate_members(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_members(samples(spark, sf_dir), "decoded_pixel_sha256", "sample_id")


def row_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of every manifest row over columns that hold quotes, blanks and nulls."""
    return table(spark, sf_dir, "manifest").select("sample_id", "delivered_at", row_digest("sample_id", "source_image_path", "source_mask_paths", "previous_names", "class_id").alias("digest"))


def grouping_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conservative candidates of every eligible sample, as they stand in its manifest row:
    one row an entry, and in order."""
    ok = samples(spark, sf_dir).filter("eligible = 1").select("sample_id")
    ends = _candidates(spark, sf_dir).filter("group_conservatively = 1").select(F.explode(F.array("sample_a", "sample_b")).alias("__s"), F.concat_ws(":", "candidate_id", F.coalesce("review_state", F.lit(""))).alias("entry"))
    entries = ok.join(ends.distinct(), F.col("sample_id") == F.col("__s"))
    return entries.groupBy("sample_id").agg(F.array_join(F.array_sort(F.collect_list("entry")), ";").alias("grouping_evidence"))


def cosine_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dedup.block_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.42).select("vec_id_a", "vec_id_b", "score"), 5)


def aligned_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dedup.block_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 0.6, how="aligned"), 5)


def cell_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types that cells of some text columns would get if every cell were inferred."""
    rows = table(spark, sf_dir, "manifest")
    cols = ("sample_id", "calibration_for_folds", "previous_split", "exact_duplicate_group", "manifest_version")
    long = rows.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), s.infer_cell(F.col(c)).alias("kind")) for c in cols])).alias("x"))
    return long.groupBy("x.field", "x.kind").agg(F.count("*").alias("cells"))


def event_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field of JSON texts with a default where it is missing."""
    e = table(spark, sf_dir, "events")
    k = F.coalesce(F.get_json_object("props", "$.k").try_cast("bigint"), F.lit(-1))
    return e.groupBy("event_type").agg(F.count("*").alias("events"), F.sum(k).alias("sum_k"), F.count_if(k < 0).alias("without_k"))


_C = """cand AS (SELECT * FROM near_duplicate_candidates QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY received_at DESC, sample_a DESC, sample_b DESC, phash_distance DESC NULLS LAST,
  aligned_correlation DESC NULLS LAST, registered_mask_dice DESC NULLS LAST, evidence DESC NULLS LAST, reviewer_1_decision DESC NULLS LAST, reviewer_2_decision DESC NULLS LAST, review_state DESC NULLS LAST, group_conservatively DESC NULLS LAST) = 1)"""
_EXACT = """exact AS (SELECT decoded_pixel_sha256, string_agg(DISTINCT sample_id, ';' ORDER BY sample_id) AS sample_ids, string_agg(DISTINCT diagnosis, ';' ORDER BY diagnosis) AS labels,
  CAST(count(DISTINCT diagnosis) > 1 AS INTEGER) AS contradictory FROM samples WHERE decoded_pixel_sha256 <> '' GROUP BY 1 HAVING count(*) > 1)"""
_STATE = """CASE WHEN a IN ('separate','reject','different') AND b IN ('separate','reject','different') THEN 'rejected_by_both_reviewers' WHEN a IN ('group','accept','same') AND b IN ('group','accept','same') THEN 'accepted_by_both_reviewers'
  WHEN a <> '' OR b <> '' THEN 'disputed_conservative_group' ELSE 'pending_conservative_group' END"""
_DENIED = "source_image_path IN ('benign/benign (433).png', 'malignant/malignant (145).png')"
_REASON = f"""CASE WHEN {_DENIED} THEN 'known_contradictory_exact_duplicate' WHEN contradictory = 1 THEN 'contradictory_exact_duplicate' WHEN image_read_ok <> 1 THEN 'unreadable_source_image'
  WHEN diagnosis = 'normal' AND mask_qc_ok = 0 THEN 'normal_source_mask_qc_failure' WHEN diagnosis = 'normal' AND coalesce(lesion_pixels, 0) > 0 THEN 'normal_source_mask_not_empty'
  WHEN diagnosis <> 'normal' AND mask_count = 0 THEN 'missing_positive_mask' WHEN diagnosis <> 'normal' AND mask_qc_ok = 0 THEN 'positive_source_mask_qc_failure'
  WHEN diagnosis <> 'normal' AND coalesce(lesion_pixels, 0) = 0 THEN 'empty_positive_mask' ELSE '' END"""
_GROUPS = f"""WITH RECURSIVE {SAMPLES_SQL}, {_C},
ok AS (SELECT * FROM samples WHERE eligible = 1),
pairs AS (SELECT sample_a AS a, sample_b AS b FROM cand WHERE group_conservatively = 1 AND sample_a IN (SELECT sample_id FROM ok) AND sample_b IN (SELECT sample_id FROM ok)
  UNION SELECT sample_id, min(sample_id) OVER (PARTITION BY decoded_pixel_sha256) FROM ok WHERE decoded_pixel_sha256 <> ''),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (SELECT a AS s, a AS t FROM edges UNION SELECT reach.s, edges.b FROM reach JOIN edges ON reach.t = edges.a),
firsts AS (SELECT sample_id, coalesce(min(t), sample_id) AS f FROM ok LEFT JOIN reach ON s = sample_id GROUP BY sample_id),
grouped AS (SELECT sample_id, format('content_{{:04d}}', dense_rank() OVER (ORDER BY f) - 1) AS content_group FROM firsts)"""
_IN = {
    "development": "eligible = 1 AND partition = 'development'", "sealed": "eligible = 1 AND partition = 'sealed'",
    "outer": "eligible = 1 AND partition = 'development' AND fold = {k}", "calibration": "eligible = 1 AND partition = 'development' AND fold <> {k} AND list_contains(folds, {k})",
    "fit": "eligible = 1 AND partition = 'development' AND fold <> {k} AND NOT list_contains(folds, {k})",
}
_FOLDED = f"{SAMPLES_SQL}, f AS (SELECT *, list_transform(regexp_extract_all(coalesce(calibration_for_folds, ''), '[0-9]+'), lambda x: CAST(x AS INTEGER)) AS folds FROM samples)"
_BITS = "bits AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE > list_sort(list_transform(embedding[2:64], lambda y: y::DOUBLE))[32]) AS b FROM embeddings)"
_CELL = """CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'none', 'null', 'nan') THEN 'null' WHEN lower(trim(v)) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') AND TRY_CAST(trim(v) AS BIGINT) IS NOT NULL THEN 'int'
  WHEN regexp_full_match(lower(trim(v)), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') THEN 'float' ELSE 'string' END"""
_PARTS = "list_filter(list_transform(string_split(coalesce(previous_split, ''), ';'), lambda x: trim(x)), lambda x: x <> '')"
_SHAPE = "CASE WHEN r < 0.8 THEN 'portrait' WHEN r > 1.25 THEN 'landscape' ELSE 'square' END"
_SPLIT = "placed AS (SELECT o_custkey, row_number() OVER (ORDER BY sha256('42:' || o_custkey)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT o_custkey FROM orders)), named AS (SELECT o_custkey, CASE WHEN i / n::DOUBLE < 0.8 THEN 'train' WHEN i / n::DOUBLE < 0.9 THEN 'val' ELSE 'test' END AS split FROM placed)"
SQL = {
    "exact_duplicate_groups": f"WITH {SAMPLES_SQL}, {_EXACT} SELECT format('exact_{{:04d}}', row_number() OVER (ORDER BY decoded_pixel_sha256) - 1) AS exact_group, *, CASE WHEN contradictory = 1 THEN 'quarantine' ELSE 'group' END AS action FROM exact",
    "eligibility_reasons": f"WITH {SAMPLES_SQL}, {_EXACT} SELECT sample_id, {_REASON} AS reason FROM samples LEFT JOIN exact USING (decoded_pixel_sha256)",
    "eligibility_report": f"WITH {SAMPLES_SQL}, {_EXACT} SELECT {_REASON} AS reason, eligible, count(*) AS samples FROM samples LEFT JOIN exact USING (decoded_pixel_sha256) GROUP BY 1, 2",
    "stable_ids": f"WITH {SAMPLES_SQL} SELECT diagnosis || '_' || lpad(CAST(CAST(regexp_extract(source_image_path, '([0-9]+)', 1) AS BIGINT) AS VARCHAR), greatest(4, length(CAST(CAST(regexp_extract(source_image_path, '([0-9]+)', 1) AS BIGINT) AS VARCHAR)))::INTEGER, '0') AS stable_id, count(*) AS samples FROM samples GROUP BY 1",
    "size_quartiles": f"""WITH {SAMPLES_SQL}, cuts AS (SELECT diagnosis, quantile_cont(lesion_fraction, [0.25, 0.5, 0.75]) AS c FROM samples WHERE eligible = 1 AND class_id > 0 GROUP BY 1)
SELECT sample_id, CASE WHEN eligible = 1 AND class_id > 0 THEN CAST(1 + (lesion_fraction >= c[1])::INT + (lesion_fraction >= c[2])::INT + (lesion_fraction >= c[3])::INT AS INTEGER) ELSE 0 END AS quartile FROM samples LEFT JOIN cuts USING (diagnosis)""",
    "stratum_counts": f"WITH {SAMPLES_SQL}, x AS (SELECT *, CASE WHEN original_width > 0 AND original_height > 0 THEN original_width / original_height::DOUBLE ELSE 0.0 END AS r FROM samples WHERE eligible = 1) SELECT diagnosis || '|q' || coalesce(lesion_size_quartile, 0) || '|' || {_SHAPE} AS stratum, count(*) AS samples FROM x GROUP BY 1",
    "geometry_check": f"""WITH {SAMPLES_SQL}, x AS (SELECT *, CASE WHEN original_width > 0 AND original_height > 0 THEN original_width / original_height::DOUBLE ELSE 0.0 END AS r, CASE WHEN original_width > 0 AND original_height > 0 THEN lesion_pixels / (original_width::BIGINT * original_height)::DOUBLE ELSE 0.0 END AS p FROM samples)
SELECT diagnosis, count(*) AS samples, count(*) FILTER (abs(r - aspect_ratio) > 1e-6) AS ratio_off, count(*) FILTER (abs(p - lesion_fraction) > 1e-6) AS fraction_off, count(*) FILTER ({_SHAPE} <> aspect_ratio_bin) AS bin_off FROM x GROUP BY 1""",
    "manifest_pixel_counts": f"""WITH {SAMPLES_SQL}, x AS (SELECT CAST(sum(original_height::BIGINT * original_width - coalesce(lesion_pixels, 0)) AS BIGINT) AS background, CAST(sum(lesion_pixels) FILTER (class_id = 1) AS BIGINT) AS benign, CAST(sum(lesion_pixels) FILTER (class_id = 2) AS BIGINT) AS malignant FROM samples WHERE eligible = 1)
SELECT *, round(sqrt(background / benign::DOUBLE), 6) AS benign_weight, round(sqrt(background / malignant::DOUBLE), 6) AS malignant_weight FROM x""",
    "dataset_counts": f"""WITH {SAMPLES_SQL}, l AS (SELECT 'diagnosis' AS field, coalesce(diagnosis, '') AS value, eligible FROM samples UNION ALL SELECT 'partition', coalesce(partition, ''), eligible FROM samples UNION ALL SELECT 'fold', coalesce(CAST(fold AS VARCHAR), ''), eligible FROM samples)
SELECT field, value, count(*) AS samples, count(*) FILTER (eligible = 1) AS eligible_samples FROM l GROUP BY 1, 2""",
    "previous_splits": f"WITH {SAMPLES_SQL} SELECT previous, count(*) AS samples FROM (SELECT sample_id, unnest(list_distinct({_PARTS})) AS previous FROM samples) GROUP BY 1",
    "prior_membership": f"""WITH {SAMPLES_SQL}, p AS (SELECT decoded_pixel_sha256, string_agg(DISTINCT x, ';' ORDER BY x) AS k FROM (SELECT decoded_pixel_sha256, unnest({_PARTS}) AS x FROM samples) GROUP BY 1)
SELECT sample_id, coalesce(k, '') AS known_splits FROM samples LEFT JOIN p USING (decoded_pixel_sha256)""",
    "review_outcomes": f"""WITH {_C}, d AS (SELECT *, lower(trim(coalesce(reviewer_1_decision, ''))) AS a, lower(trim(coalesce(reviewer_2_decision, ''))) AS b FROM cand)
SELECT {_STATE} AS state, CAST({_STATE} <> 'rejected_by_both_reviewers' AS INTEGER) AS grouped, review_state, count(*) AS candidates FROM d GROUP BY ALL""",
    "review_progress": f"""WITH {_C}, d AS (SELECT *, coalesce(trim(reviewer_1_decision), '') <> '' AND coalesce(trim(reviewer_2_decision), '') <> '' AS done FROM cand)
SELECT count(*) AS candidates, count(*) FILTER (done) AS reviewed, bool_and(done) AS complete, {", ".join(f"count(*) FILTER (starts_with(review_state, '{x}')) AS {x}" for x in ("accepted", "rejected", "disputed", "pending"))} FROM d""",
    "near_candidates": f"""WITH {_C} SELECT candidate_id, CASE WHEN phash_distance > 6 AND aligned_correlation < 0.90 THEN '' ELSE concat_ws(';', CASE WHEN phash_distance <= 6 THEN 'phash_le_6' END,
  CASE WHEN aligned_correlation >= 0.95 THEN 'aligned_corr_ge_0.95' END, CASE WHEN aligned_correlation >= 0.90 AND registered_mask_dice >= 0.70 THEN 'corr_ge_0.90_and_mask_dice_ge_0.70' END) END AS recomputed FROM cand""",
    "candidate_ids": "SELECT DISTINCT 'near_' || substring(sha256(least(sample_a, sample_b) || '|' || greatest(sample_a, sample_b)), 1, 12) AS pair_id, least(sample_a, sample_b) AS a, greatest(sample_a, sample_b) AS b FROM near_duplicate_candidates",
    "review_pairs": f"""WITH {SAMPLES_SQL}, {_C} SELECT candidate_id, sample_a, sample_b, x.diagnosis AS diagnosis_a, y.diagnosis AS diagnosis_b, x.partition = y.partition AS same_partition,
  coalesce(reviewer_1_decision, '') AS decision_1, coalesce(reviewer_2_decision, '') AS decision_2 FROM cand JOIN samples x ON sample_a = x.sample_id JOIN samples y ON sample_b = y.sample_id""",
    "content_groups": _GROUPS + " SELECT sample_id, content_group FROM grouped",
    "content_group_report": _GROUPS
    + """ SELECT g.content_group, string_agg(sample_id, ';' ORDER BY sample_id) AS sample_ids, string_agg(DISTINCT diagnosis, ';' ORDER BY diagnosis) AS diagnoses, min(partition) AS partition, min(fold) AS fold, count(*) AS member_count
FROM grouped g JOIN ok USING (sample_id) GROUP BY 1 HAVING count(*) > 1""",
    "split_selection": f"WITH {_FOLDED} " + " UNION ALL ".join(f"SELECT '{n}' AS selection, count(*) FILTER ({c}) AS samples FROM f" for n, c in [("development", _IN["development"]), ("sealed", _IN["sealed"]), *[(f"{x}_{k}", _IN[x].format(k=k)) for k in range(5) for x in ("fit", "calibration", "outer")]]),
    "fit_rows": f"WITH {_FOLDED} SELECT sample_id, class_id, fold FROM f WHERE {_IN['fit'].format(k=0)}",
    "patient_split": f"WITH {_SPLIT} SELECT split, count(*) AS orders, count(DISTINCT o_custkey) AS patients FROM orders JOIN named USING (o_custkey) GROUP BY 1",
    "patient_of": f"WITH {_SPLIT} SELECT o_custkey, split FROM named",
    "leakage_check": """WITH o AS (SELECT DISTINCT o_custkey, CASE WHEN o_orderkey % 10 < 8 THEN 'train' WHEN o_orderkey % 10 = 8 THEN 'val' ELSE 'test' END AS split FROM orders)
SELECT a.split AS split_a, b.split AS split_b, count(*) AS shared_groups FROM o a JOIN o b ON a.o_custkey = b.o_custkey AND a.split < b.split GROUP BY 1, 2""",
    "probe_sample": f"""WITH {SAMPLES_SQL}, x AS (SELECT sample_id, class_id, count(*) OVER (PARTITION BY class_id) AS n, count(*) OVER () AS total, row_number() OVER (PARTITION BY class_id ORDER BY sha256('7:' || sample_id), sample_id) AS r FROM samples WHERE eligible = 1)
SELECT sample_id, class_id FROM x WHERE r <= least(n, greatest(1, round_even(96 * n / total::DOUBLE, 0)))""",
    "balanced_weights": f"WITH {SAMPLES_SQL} SELECT class_id, count(*) AS n, round((CASE class_id WHEN 0 THEN 0.2 ELSE 0.4 END)::DOUBLE / count(*), 9) AS weight FROM samples WHERE eligible = 1 GROUP BY 1",
    "membership_hash": f"""WITH {SAMPLES_SQL}, r AS (SELECT partition, sha256(to_json([sample_id, coalesce(content_group, ''), CAST(class_id AS VARCHAR)])) AS d FROM samples),
l AS (SELECT partition, count(*) AS n, {", ".join(f"sum(('0x' || substr(d, {1 + 15 * i}, 15))::BIGINT) AS s{i}" for i in range(4))} FROM r GROUP BY 1)
SELECT partition, n AS row_count, sha256(concat_ws(':', n, s0, s1, s2, s3)) AS digest FROM l""",
    "row_digests": "SELECT sample_id, delivered_at, sha256(to_json([sample_id, source_image_path, source_mask_paths, previous_names, CAST(class_id AS VARCHAR)])) AS digest FROM manifest",
    "content_groups_by_stars": _GROUPS + " SELECT sample_id, content_group FROM grouped",
    "exact_duplicate_members": f"""WITH {SAMPLES_SQL}, e AS (SELECT decoded_pixel_sha256, count(*) AS members, format('exact_{{:04d}}', row_number() OVER (ORDER BY decoded_pixel_sha256) - 1) AS exact_group
  FROM samples WHERE decoded_pixel_sha256 <> '' GROUP BY 1 HAVING count(*) > 1) SELECT exact_group, decoded_pixel_sha256, sample_id, members FROM samples JOIN e USING (decoded_pixel_sha256)""",
    "grouping_evidence": f"""WITH {SAMPLES_SQL}, {_C}, e AS (SELECT DISTINCT unnest([sample_a, sample_b]) AS sample_id, candidate_id || ':' || coalesce(review_state, '') AS entry FROM cand WHERE group_conservatively = 1)
SELECT sample_id, string_agg(entry, ';' ORDER BY entry) AS grouping_evidence FROM e JOIN samples USING (sample_id) WHERE eligible = 1 GROUP BY 1""",
    "near_hash_pairs": f"""WITH {_BITS}, turned AS (SELECT vec_id, b FROM bits UNION ALL SELECT -1 - vec_id, list_transform(b, lambda x, i: CASE WHEN i <= vec_id % 9 THEN NOT x ELSE x END) FROM bits),
d AS (SELECT x.vec_id AS vec_id_a, y.vec_id AS vec_id_b, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda z: (z[1] <> z[2])::INT)) AS INTEGER) AS distance FROM turned x JOIN turned y ON x.vec_id < y.vec_id)
SELECT * FROM d WHERE distance <= 6""",
    "banded_cosine_pairs": """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), t AS (SELECT * FROM v UNION ALL SELECT -1 - vec_id, list_transform(e, lambda x, i: CASE WHEN i = 1 THEN x + 0.05::DOUBLE ELSE x END) FROM v),
d AS (SELECT x.vec_id AS vec_id_a, y.vec_id AS vec_id_b, list_cosine_similarity(x.e, y.e) AS score FROM t x JOIN t y ON x.vec_id < y.vec_id) SELECT vec_id_a, vec_id_b, round(score, 5) AS score FROM d WHERE score >= 0.95""",
    "repeated_deliveries": "SELECT sample_id, count(*) AS copies FROM manifest GROUP BY 1 HAVING count(*) > 1",
    "phash_bits": f"WITH {_BITS} SELECT vec_id, CAST(list_sum(list_transform(b, lambda x: x::INT)) AS INTEGER) AS set_bits FROM bits",
    "hamming_pairs": f"WITH {_BITS} SELECT x.vec_id AS vec_id_a, y.vec_id AS vec_id_b, CAST(list_sum(list_transform(list_zip(x.b, y.b), lambda z: (z[1] <> z[2])::INT)) AS INTEGER) AS distance FROM bits x JOIN bits y ON x.vec_id < y.vec_id WHERE list_sum(list_transform(list_zip(x.b, y.b), lambda z: (z[1] <> z[2])::INT)) <= 16",
    "cosine_pairs": "SELECT x.vec_id AS vec_id_a, y.vec_id AS vec_id_b, round(list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]), 5) AS score FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE list_cosine_similarity(x.embedding::DOUBLE[], y.embedding::DOUBLE[]) >= 0.42",
    "cell_types": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM manifest" for c in ("sample_id", "calibration_for_folds", "previous_split", "exact_duplicate_group", "manifest_version")) + f") SELECT field, {_CELL} AS kind, count(*) AS cells FROM l GROUP BY 1, 2",
    "event_props": "SELECT event_type, count(*) AS events, CAST(sum(coalesce(TRY_CAST(props::JSON->>'$.k' AS BIGINT), -1)) AS BIGINT) AS sum_k, count(*) FILTER (coalesce(TRY_CAST(props::JSON->>'$.k' AS BIGINT), -1) < 0) AS without_k FROM events GROUP BY 1",
}
_NAMES = (
    exact_duplicate_groups, eligibility_reasons, eligibility_report, stable_ids, size_quartiles, stratum_counts, geometry_check, manifest_pixel_counts, dataset_counts, previous_splits, prior_membership, review_outcomes, review_progress,
    near_candidates, candidate_ids, review_pairs, content_groups, content_groups_by_stars, content_group_report, grouping_evidence, exact_duplicate_members, split_selection, fit_rows, patient_split, patient_of, leakage_check, probe_sample, balanced_weights, greedy_splits, membership_hash,
    row_digests, repeated_deliveries, phash_bits, hamming_pairs, near_hash_pairs, cosine_pairs, banded_cosine_pairs, aligned_pairs, near_search, cell_types, event_props,
)
QUERIES = {f.__name__: f for f in _NAMES}
