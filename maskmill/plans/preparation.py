"""Queries that prepare and freeze a data set: curation from end to end, its contract,
ordered selections, repaired logs and draws; with their oracle SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from maskmill.functions import scalars as s
from maskmill.operators import dedup, graph, quality, runlog, selection, splits
from maskmill.plans.dataset import DENIED, _candidates
from maskmill.plans.evaluation import rounded
from maskmill.plans.runlogs import _EPOCHS, epochs
from maskmill.plans.views import SAMPLES_SQL, samples
from maskmill.runtime import lookup, table


def curation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole curation of the raw samples: exact duplicates, eligibility, size quartiles
    and shapes, content groups of the eligible, and where each picture is to be written."""
    rows = samples(spark, sf_dir)
    exact = dedup.exact_members(rows, "decoded_pixel_sha256", "sample_id").select(F.col("sample_id").alias("__s"), "exact_group")
    sets = rows.filter("decoded_pixel_sha256 <> ''").groupBy(F.col("decoded_pixel_sha256").alias("__d")).agg((F.min("diagnosis") != F.max("diagnosis")).alias("torn"))
    rows = lookup(rows.join(exact, F.col("sample_id") == F.col("__s"), "left").drop("__s"), sets, "decoded_pixel_sha256", "__d")
    path = F.split("source_image_path", "/")
    denied = F.struct(F.element_at(path, 1).alias("a"), F.element_at(path, -1).alias("b")).isin([F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a, b in DENIED])
    reason = quality.eligibility_reason(
        F.col("diagnosis") == "normal", F.col("image_read_ok") == 1, F.col("mask_qc_ok") == 0, F.col("mask_count"), F.coalesce("lesion_pixels", F.lit(0)), F.coalesce("torn", F.lit(False)), denied
    )
    judged = rows.withColumn("reason", reason)
    positive = (F.col("reason") == "") & (F.col("class_id") > 0)
    cuts = s.size_cuts(judged.filter(positive), "diagnosis", "lesion_fraction").withColumnRenamed("diagnosis", "__g")
    judged = judged.join(F.broadcast(cuts), F.col("diagnosis") == F.col("__g"), "left")  # one row a diagnosis
    kept = judged.filter("reason = ''")
    near = _candidates(spark, sf_dir).filter("group_conservatively = 1").select(F.col("sample_a").alias("x"), F.col("sample_b").alias("y"))
    same = dedup.representatives(kept.filter("decoded_pixel_sha256 <> ''"), "sample_id", "decoded_pixel_sha256").filter("sample_id <> representative")
    groups = graph.content_groups(kept, "sample_id", near.unionByName(same.select(F.col("sample_id").alias("x"), F.col("representative").alias("y"))), "x", "y")
    groups = groups.select(F.col("sample_id").alias("__m"), F.col("content_group").alias("group"))
    image, mask = quality.written_paths(F.col("sample_id"), F.col("reason") == "")
    return judged.join(groups, F.col("sample_id") == F.col("__m"), "left").select(
        "sample_id", "reason", F.coalesce("exact_group", F.lit("")).alias("exact_group"), F.coalesce("group", F.lit("")).alias("content_group"),
        F.when(positive, s.quartile_of(F.col("lesion_fraction"), F.col("cuts"))).otherwise(0).alias("quartile"),
        s.aspect_bin(s.aspect_ratio(F.col("original_width"), F.col("original_height"))).alias("shape"), image.alias("image_path"), mask.alias("mask_path"),
    )


def contract_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fail-closed checks of a frozen manifest, one row a check, in one pass over its samples."""
    rows = samples(spark, sf_dir)
    own = s.fold_list(F.col("calibration_for_folds"))
    no = lambda c: (F.count_if(F.coalesce(c, F.lit(False))), F.lit(0))
    dev, sealed, out = (F.col("partition") == x for x in ("development", "sealed", "excluded"))
    ok = F.col("eligible") == 1
    checks = {
        "ids_are_unique": (F.count_distinct("sample_id"), F.count("*")),
        "classes_are_known": no(~F.col("class_id").isin(0, 1, 2) | F.col("class_id").isNull()),
        "class_matches_diagnosis": no(~F.coalesce(s.class_of_name(F.col("diagnosis")) == F.col("class_id"), F.lit(False))),
        "normals_are_included": (F.count_if((F.col("class_id") == 0) & ok) > 0, F.lit(True)),
        "every_class_is_eligible": (F.count_distinct(F.when(ok, F.col("class_id"))), F.lit(3)),
        "five_development_folds": (F.count_distinct(F.when(ok & dev, F.col("fold"))), F.lit(5)),
        "folds_are_in_range": no(dev & ~F.col("fold").between(0, 4)),
        "others_have_no_fold": no(~dev & (F.col("fold") != -1)),
        "excluded_are_not_eligible": no(out & ok),
        "eligible_have_a_partition": no(ok & ~(dev | sealed)),
        "excluded_have_a_reason": no(~ok & (F.coalesce("exclusion_reason", F.lit("")) == "")),
        "eligible_have_no_reason": no(ok & (F.coalesce("exclusion_reason", F.lit("")) != "")),
        "normals_have_no_lesion": no((F.col("class_id") == 0) & (F.col("lesion_pixels") > 0) & ok),
        "lesions_have_pixels": no((F.col("class_id") > 0) & (F.coalesce("lesion_pixels", F.lit(0)) <= 0) & ok),
        "masks_are_counted": no((F.col("multi_mask") == 1) != (F.col("mask_count") > 1)),
        "images_are_readable": no(ok & (F.col("image_read_ok") != 1)),
        "digests_are_present": no(ok & (F.coalesce("decoded_pixel_sha256", F.lit("")) == "")),
        "digests_are_hexadecimal": no(~F.col("decoded_pixel_sha256").rlike("^[0-9a-f]{64}$") & (F.col("decoded_pixel_sha256") != "")),
        "fractions_are_shares": no((F.col("lesion_fraction") < 0) | (F.col("lesion_fraction") > 1)),
        "quartiles_fit_the_class": no(ok & ((F.col("class_id") == 0) != (F.col("lesion_size_quartile") == 0))),
        "sealed_calibrate_nothing": no(sealed & (F.size(own) > 0)),
        "no_fold_calibrates_itself": no(dev & F.array_contains(own, F.col("fold"))),
        "calibration_folds_are_in_range": no(F.exists(own, lambda k: k > 4)),
        "prior_tests_stay_in_development": no(ok & F.array_contains(s.split_list(F.col("previous_split")), "test") & ~dev),
        "fingerprint_is_shared": (F.count_distinct("dataset_fingerprint"), F.lit(1)),
        "version_is_shared": (F.count_distinct("manifest_version"), F.lit(1)),
        "seed_is_shared": (F.count_distinct("split_seed"), F.lit(1)),
    }
    frozen = table(spark, sf_dir, "manifest").groupBy("sample_id").agg(*[F.min(c).alias(c) for c in ("dataset_fingerprint", "manifest_version", "split_seed")])
    joined = rows.join(frozen.withColumnRenamed("sample_id", "__f"), F.col("sample_id") == F.col("__f"))
    return quality.contract(joined, checks)


def prior_test_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible samples that an earlier test split held, against the number of all samples
    whose content it held: one row, ok if no such content was lost."""
    rows = samples(spark, sf_dir)
    tested = F.array_contains(s.split_list(F.col("previous_split")), "test")
    return quality.contract(rows, {"prior_tests": (F.count_if(tested & (F.col("eligible") == 1)), F.count_if(tested))})


def written_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the image and the mask of every sample go, the quarantined apart."""
    image, mask = quality.written_paths(F.col("sample_id"), F.col("eligible") == 1)
    return samples(spark, sf_dir).select("sample_id", image.alias("image_path"), mask.alias("mask_path"))


def ordered_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fit samples of outer fold 1 in the order of their ids, with their place."""
    chosen = samples(spark, sf_dir).filter(splits.in_split("fit", 1)).select("sample_id", "class_id")
    places = selection.positions(chosen, "sample_id").withColumnRenamed("sample_id", "__s")
    return selection.in_order(chosen.join(places, F.col("sample_id") == F.col("__s")).drop("__s"), "sample_id")


def selection_by_reason(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many samples the runtime's reading of the splits selects: eligible by reason, and
    calibration sets that may hold rows of the outer fold."""
    parts = ["development", "sealed", *[(x, k) for k in range(5) for x in ("fit", "calibration", "outer")]]
    named = {p if isinstance(p, str) else f"{p[0]}_{p[1]}": splits.in_split(*([p] if isinstance(p, str) else p), strict=False, by_reason=True) for p in parts}
    sums = samples(spark, sf_dir).agg(*[F.count_if(c).alias(n) for n, c in named.items()])
    return sums.select(F.explode(F.array(*[F.struct(F.lit(n).alias("selection"), F.col(n).alias("samples")) for n in named])).alias("p")).select("p.*")


def resolved_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Image and mask of every delivered row below the data folder; absolute paths stay."""
    rows = table(spark, sf_dir, "manifest").select("sample_id", "delivered_at", *[F.when(s.hash_part(F.col("sample_id"), 5) == 0, F.concat(F.lit("/mnt/"), c)).otherwise(F.col(c)).alias(c) for c in ("image_path", "mask_path")])
    return rows.select("sample_id", "delivered_at", *[s.resolve_path(F.col(c), "/data/set/").alias(c) for c in ("image_path", "mask_path")])


def first_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first fifty eligible samples in the order of their ids, as a limited prediction reads."""
    return selection.in_order(samples(spark, sf_dir).filter("eligible = 1").select("sample_id", "diagnosis"), "sample_id", limit=50)


def first_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first three runs of every phase by number of epochs, as candidates to evaluate."""
    per = epochs(spark, sf_dir).groupBy("phase", "run_id").agg(F.count("*").alias("epochs"))
    return selection.first_of_each(per.withColumn("less", -F.col("epochs")), 3, "phase", "less", "run_id").drop("less")


def candidate_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates in the order of their ids, with their place."""
    return selection.in_order(selection.positions(_candidates(spark, sf_dir).select("candidate_id"), "candidate_id"), "candidate_id")


def saved_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A saved list of eligible ids, from before those of malignant samples were corrected,
    against the present one: every place at which they differ."""
    rows = samples(spark, sf_dir).filter("eligible = 1")
    saved = selection.positions(rows.select(F.when(F.col("diagnosis") == "malignant", F.concat(F.lit("x_"), "sample_id")).otherwise(F.col("sample_id")).alias("sample_id")), "sample_id")
    return selection.order_mismatches(saved, rows.select("sample_id"), "sample_id")


def lesion_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both former parts put together, filtered by name, and split anew by patient: rows and
    patients per split, and the patients that stand in two."""
    rows = samples(spark, sf_dir)
    path = F.concat(F.lit("P_"), F.lpad(s.hash_part(F.col("sample_id"), 900).cast("string"), 5, "0"), F.lit("/"), F.col("source_image_path"))
    parts = [rows.filter(F.col("partition") == p).select("sample_id", "source_image_path", path.alias("path")) for p in ("development", "sealed")]
    both = parts[0].unionByName(parts[1])
    kept = both.filter(s.name_contains(F.element_at(F.split("source_image_path", "/"), -1), "benign")).withColumn("patient", s.patient_id(F.col("path"), strict=True))
    placed = splits.split_by_group(kept, "patient").withColumnRenamed("patient", "__p")
    split = kept.join(placed, F.col("patient") == F.col("__p"))
    torn = split.groupBy("patient").agg(F.min("split").alias("split"), (F.count_distinct("split") - 1).alias("torn"), F.count("*").alias("n"))
    return torn.groupBy("split").agg(F.sum("n").alias("samples"), F.count("*").alias("patients"), F.sum("torn").alias("torn_patients"))


def atrous_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates for maps of the sizes that the parts have."""
    sizes = table(spark, sf_dir, "part").select((F.col("p_size") * 2 - 1).alias("map_size")).distinct()
    rates = s.atrous_rates(F.col("map_size"))
    return sizes.select("map_size", *[F.get(rates, i).alias(f"rate_{i + 1}") for i in range(3)])


def typed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of some text columns cast by their inferred type: sums per field and kind."""
    cols = ("sample_id", "calibration_for_folds", "previous_split", "exact_duplicate_group", "manifest_version")
    cells = table(spark, sf_dir, "manifest").select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), s.cast_cell(F.col(c)).alias("cell")) for c in cols])).alias("x"))
    return rounded(cells.groupBy("x.field", "x.cell.kind").agg(F.count("*").alias("cells"), F.sum(F.coalesce("x.cell.whole", F.lit(0))).alias("whole_sum"), F.sum(F.coalesce("x.cell.number", F.lit(0.0))).alias("number_sum"), F.count_if("x.cell.flag").alias("true_cells"), F.coalesce(F.max(F.length("x.cell.text")), F.lit(0)).alias("longest")))


def _saved_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A checkpoint table: per run the last line of a loss below 0.9 and, of every third
    run, that line as the one after it, which the log has not got."""
    e = epochs(spark, sf_dir).filter("train.loss < 0.9").select("run_id", "epoch", "phase", "score")
    last = e.groupBy("run_id").agg(F.max(F.struct("epoch", "phase", "score")).alias("r")).select("run_id", "r.*")
    return last.withColumn("epoch", F.col("epoch") + (s.hash_part(F.col("run_id"), 3) == 0).cast("int"))


def log_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every run after its log was put in step with its checkpoint."""
    log, _ = runlog.repaired(epochs(spark, sf_dir).select("run_id", "epoch", "phase", "score"), _saved_lines(spark, sf_dir), "run_id")
    return rounded(log.groupBy("run_id").agg(F.count("*").alias("lines"), F.max("epoch").alias("last_epoch"), F.sum("score").alias("score_sum")))


def log_orphans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines that were rolled back."""
    return runlog.repaired(epochs(spark, sf_dir).select("run_id", "epoch", "phase"), _saved_lines(spark, sf_dir).drop("score"), "run_id")[1]


def weighted_draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two thousand draws with replacement from the eligible samples, classes at 25, 50 and 25 %."""
    return selection.weighted_draws(samples(spark, sf_dir).filter("eligible = 1"), "sample_id", "class_id", {0: 0.25, 1: 0.5, 2: 0.25}, 2000)


_C = """cand AS (SELECT * FROM near_duplicate_candidates QUALIFY row_number() OVER (PARTITION BY candidate_id ORDER BY received_at DESC, sample_a DESC, sample_b DESC, phash_distance DESC NULLS LAST,
  aligned_correlation DESC NULLS LAST, registered_mask_dice DESC NULLS LAST, evidence DESC NULLS LAST, reviewer_1_decision DESC NULLS LAST, reviewer_2_decision DESC NULLS LAST, review_state DESC NULLS LAST, group_conservatively DESC NULLS LAST) = 1)"""
_FOLDS = "list_transform(regexp_extract_all(coalesce(calibration_for_folds, ''), '[0-9]+'), lambda x: CAST(x AS INTEGER))"
_TESTED = "list_contains(list_transform(string_split(coalesce(previous_split, ''), ';'), lambda x: trim(x)), 'test')"
_OWN_CHECKS = {
    "ids_are_unique": ("count(DISTINCT sample_id)", "count(*)"),
    "classes_are_known": ("count(*) FILTER (class_id IS NULL OR class_id NOT IN (0, 1, 2))", "0"),
    "class_matches_diagnosis": ("count(*) FILTER (NOT coalesce(CASE diagnosis WHEN 'normal' THEN 0 WHEN 'benign' THEN 1 WHEN 'malignant' THEN 2 END = class_id, false))", "0"),
    "normals_are_included": ("count(*) FILTER (class_id = 0 AND eligible = 1) > 0", "true"),
    "every_class_is_eligible": ("count(DISTINCT class_id) FILTER (eligible = 1)", "3"),
    "five_development_folds": ("count(DISTINCT fold) FILTER (eligible = 1 AND partition = 'development')", "5"),
    "folds_are_in_range": ("count(*) FILTER (partition = 'development' AND NOT fold BETWEEN 0 AND 4)", "0"),
    "others_have_no_fold": ("count(*) FILTER (partition <> 'development' AND fold <> -1)", "0"),
    "excluded_are_not_eligible": ("count(*) FILTER (partition = 'excluded' AND eligible = 1)", "0"),
    "eligible_have_a_partition": ("count(*) FILTER (eligible = 1 AND partition NOT IN ('development', 'sealed'))", "0"),
    "excluded_have_a_reason": ("count(*) FILTER (eligible <> 1 AND coalesce(exclusion_reason, '') = '')", "0"),
    "eligible_have_no_reason": ("count(*) FILTER (eligible = 1 AND coalesce(exclusion_reason, '') <> '')", "0"),
    "normals_have_no_lesion": ("count(*) FILTER (class_id = 0 AND lesion_pixels > 0 AND eligible = 1)", "0"),
    "lesions_have_pixels": ("count(*) FILTER (class_id > 0 AND coalesce(lesion_pixels, 0) <= 0 AND eligible = 1)", "0"),
    "masks_are_counted": ("count(*) FILTER ((multi_mask = 1) <> (mask_count > 1))", "0"),
    "images_are_readable": ("count(*) FILTER (eligible = 1 AND image_read_ok <> 1)", "0"),
    "digests_are_present": ("count(*) FILTER (eligible = 1 AND coalesce(decoded_pixel_sha256, '') = '')", "0"),
    "digests_are_hexadecimal": ("count(*) FILTER (decoded_pixel_sha256 <> '' AND NOT regexp_full_match(decoded_pixel_sha256, '[0-9a-f]{64}'))", "0"),
    "fractions_are_shares": ("count(*) FILTER (lesion_fraction < 0 OR lesion_fraction > 1)", "0"),
    "quartiles_fit_the_class": ("count(*) FILTER (eligible = 1 AND (class_id = 0) <> (lesion_size_quartile = 0))", "0"),
    "sealed_calibrate_nothing": (f"count(*) FILTER (partition = 'sealed' AND len({_FOLDS}) > 0)", "0"),
    "no_fold_calibrates_itself": (f"count(*) FILTER (partition = 'development' AND list_contains({_FOLDS}, fold))", "0"),
    "calibration_folds_are_in_range": (f"count(*) FILTER (len(list_filter({_FOLDS}, lambda x: x > 4)) > 0)", "0"),
    "prior_tests_stay_in_development": (f"count(*) FILTER (eligible = 1 AND {_TESTED} AND partition <> 'development')", "0"),
    "fingerprint_is_shared": ("max((SELECT count(DISTINCT f) FROM (SELECT min(dataset_fingerprint) AS f FROM manifest GROUP BY sample_id)))", "1"),
    "version_is_shared": ("max((SELECT count(DISTINCT f) FROM (SELECT min(manifest_version) AS f FROM manifest GROUP BY sample_id)))", "1"),
    "seed_is_shared": ("max((SELECT count(DISTINCT f) FROM (SELECT min(split_seed) AS f FROM manifest GROUP BY sample_id)))", "1"),
}


def _contract_sql(checks: dict[str, tuple[str, str]]) -> str:
    one = lambda n, o, e: f"SELECT '{n}' AS check_name, CAST({o} AS VARCHAR) AS observed, CAST({e} AS VARCHAR) AS expected, CAST({o} AS VARCHAR) = CAST({e} AS VARCHAR) AS ok FROM samples"
    return f"WITH {SAMPLES_SQL} " + " UNION ALL ".join(one(n, o, e) for n, (o, e) in checks.items())


_PATHS = "CASE WHEN {ok} THEN '' ELSE 'quarantine/' END || '{kind}/' || sample_id || '.png'"
_PART = "('0x' || substr(sha256({x}), 1, 8))::BIGINT % {n}"
_LAST = f"""{_EPOCHS}, saved AS (SELECT run_id, max(epoch) + CASE WHEN {_PART.format(x='run_id', n=3)} = 0 THEN 1 ELSE 0 END AS epoch, arg_max(phase, epoch) AS phase, arg_max(score, epoch) AS score FROM epochs WHERE train.loss < 0.9 GROUP BY 1),
gaps AS (SELECT run_id, l.last, coalesce(l.last, 0) - coalesce(saved.epoch, 0) AS ahead FROM (SELECT run_id, max(epoch) AS last FROM epochs GROUP BY 1) l FULL JOIN saved USING (run_id))"""
SQL = {
    "curation": f"""WITH RECURSIVE {SAMPLES_SQL}, {_C},
sets AS (SELECT decoded_pixel_sha256, min(diagnosis) <> max(diagnosis) AS torn FROM samples WHERE decoded_pixel_sha256 <> '' GROUP BY 1),
named AS (SELECT decoded_pixel_sha256, format('exact_{{:04d}}', row_number() OVER (ORDER BY decoded_pixel_sha256) - 1) AS exact_group FROM samples WHERE decoded_pixel_sha256 <> '' GROUP BY 1 HAVING count(*) > 1),
judged AS (SELECT samples.*, exact_group, CASE WHEN source_image_path IN ('benign/benign (433).png', 'malignant/malignant (145).png') THEN 'known_contradictory_exact_duplicate'
  WHEN torn THEN 'contradictory_exact_duplicate' WHEN image_read_ok <> 1 THEN 'unreadable_source_image'
  WHEN diagnosis = 'normal' AND mask_qc_ok = 0 THEN 'normal_source_mask_qc_failure' WHEN diagnosis = 'normal' AND coalesce(lesion_pixels, 0) > 0 THEN 'normal_source_mask_not_empty'
  WHEN diagnosis <> 'normal' AND mask_count = 0 THEN 'missing_positive_mask' WHEN diagnosis <> 'normal' AND mask_qc_ok = 0 THEN 'positive_source_mask_qc_failure'
  WHEN diagnosis <> 'normal' AND coalesce(lesion_pixels, 0) = 0 THEN 'empty_positive_mask' ELSE '' END AS reason
  FROM samples LEFT JOIN sets USING (decoded_pixel_sha256) LEFT JOIN named USING (decoded_pixel_sha256)),
ok AS (SELECT * FROM judged WHERE reason = ''),
cuts AS (SELECT diagnosis, quantile_cont(lesion_fraction, [0.25, 0.5, 0.75]) AS c FROM ok WHERE class_id > 0 GROUP BY 1),
pairs AS (SELECT sample_a AS a, sample_b AS b FROM cand WHERE group_conservatively = 1 AND sample_a IN (SELECT sample_id FROM ok) AND sample_b IN (SELECT sample_id FROM ok)
  UNION SELECT sample_id, min(sample_id) OVER (PARTITION BY decoded_pixel_sha256) FROM ok WHERE decoded_pixel_sha256 <> ''),
edges AS (SELECT a, b FROM pairs WHERE a <> b UNION SELECT b, a FROM pairs WHERE a <> b),
reach AS (SELECT a AS s, a AS t FROM edges UNION SELECT reach.s, edges.b FROM reach JOIN edges ON reach.t = edges.a),
firsts AS (SELECT sample_id, coalesce(min(t), sample_id) AS f FROM ok LEFT JOIN reach ON s = sample_id GROUP BY sample_id),
grouped AS (SELECT sample_id, format('content_{{:04d}}', dense_rank() OVER (ORDER BY f) - 1) AS content_group FROM firsts)
SELECT j.sample_id, reason, coalesce(exact_group, '') AS exact_group, coalesce(g.content_group, '') AS content_group,
  CASE WHEN reason = '' AND class_id > 0 THEN CAST(1 + (lesion_fraction >= c[1])::INT + (lesion_fraction >= c[2])::INT + (lesion_fraction >= c[3])::INT AS INTEGER) ELSE 0 END AS quartile,
  CASE WHEN NOT coalesce(original_width > 0 AND original_height > 0, false) OR original_width / original_height::DOUBLE < 0.8 THEN 'portrait' WHEN original_width / original_height::DOUBLE > 1.25 THEN 'landscape' ELSE 'square' END AS shape,
  {_PATHS.format(ok="reason = ''", kind="images").replace("sample_id", "j.sample_id")} AS image_path, {_PATHS.format(ok="reason = ''", kind="masks").replace("sample_id", "j.sample_id")} AS mask_path
FROM judged j LEFT JOIN cuts USING (diagnosis) LEFT JOIN grouped g ON g.sample_id = j.sample_id""",
    "contract_checks": _contract_sql(_OWN_CHECKS),
    "prior_test_guard": _contract_sql({"prior_tests": (f"count(*) FILTER ({_TESTED} AND eligible = 1)", f"count(*) FILTER ({_TESTED})")}),
    "written_paths": f"WITH {SAMPLES_SQL} SELECT sample_id, {_PATHS.format(ok='eligible = 1', kind='images')} AS image_path, {_PATHS.format(ok='eligible = 1', kind='masks')} AS mask_path FROM samples",
    "ordered_selection": f"""WITH {SAMPLES_SQL}, f AS (SELECT *, {_FOLDS} AS folds FROM samples)
SELECT sample_id, class_id, row_number() OVER (ORDER BY sample_id) - 1 AS position FROM f WHERE eligible = 1 AND partition = 'development' AND fold <> 1 AND NOT list_contains(folds, 1)""",
    "selection_by_reason": f"WITH {SAMPLES_SQL}, f AS (SELECT *, {_FOLDS} AS folds FROM samples WHERE coalesce(exclusion_reason, '') = '') "
    + " UNION ALL ".join(
        f"SELECT '{n}' AS selection, count(*) FILTER (partition = '{part}'{more}) AS samples FROM f"
        for n, part, more in [("development", "development", ""), ("sealed", "sealed", "")]
        + [(f"{x}_{k}", "development", c.format(k=k)) for k in range(5) for x, c in (("fit", " AND fold <> {k} AND NOT list_contains(folds, {k})"), ("calibration", " AND list_contains(folds, {k})"), ("outer", " AND fold = {k}"))]
    ),
    "resolved_paths": "SELECT sample_id, delivered_at, " + ", ".join(f"CASE WHEN ('0x' || substr(sha256(sample_id), 1, 8))::BIGINT % 5 = 0 THEN '/mnt/' || {c} ELSE '/data/set/' || {c} END AS {c}" for c in ("image_path", "mask_path")) + " FROM manifest",
    "first_predictions": f"WITH {SAMPLES_SQL} SELECT sample_id, diagnosis FROM samples WHERE eligible = 1 ORDER BY sample_id LIMIT 50",
    "first_paths": f"WITH {_EPOCHS}, n AS (SELECT phase, run_id, count(*) AS epochs FROM epochs GROUP BY 1, 2) SELECT phase, run_id, epochs, CAST(row_number() OVER (PARTITION BY phase ORDER BY epochs DESC, run_id) AS INTEGER) AS place FROM n QUALIFY place <= 3",
    "candidate_order": "SELECT candidate_id, row_number() OVER (ORDER BY candidate_id) - 1 AS position FROM (SELECT DISTINCT candidate_id FROM near_duplicate_candidates)",
    "saved_order": f"""WITH {SAMPLES_SQL}, ok AS (SELECT sample_id, diagnosis FROM samples WHERE eligible = 1), now AS (SELECT sample_id AS present, row_number() OVER (ORDER BY sample_id) - 1 AS position FROM ok),
then_ AS (SELECT saved, row_number() OVER (ORDER BY saved) - 1 AS position FROM (SELECT CASE WHEN diagnosis = 'malignant' THEN 'x_' || sample_id ELSE sample_id END AS saved FROM ok))
SELECT position, saved, present FROM now FULL JOIN then_ USING (position) WHERE saved IS DISTINCT FROM present""",
    "lesion_splits": f"""WITH {SAMPLES_SQL}, kept AS (SELECT sample_id, 'P_' || lpad(CAST({_PART.format(x='sample_id', n=900)} AS VARCHAR), 5, '0') AS patient FROM samples
  WHERE partition IN ('development', 'sealed') AND contains(lower(list_last(string_split(source_image_path, '/'))), 'benign')),
placed AS (SELECT patient, row_number() OVER (ORDER BY sha256('42:' || patient)) - 1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT patient FROM kept)),
named AS (SELECT patient, CASE WHEN i / n::DOUBLE < 0.8 THEN 'train' WHEN i / n::DOUBLE < 0.9 THEN 'val' ELSE 'test' END AS split FROM placed)
SELECT split, count(*) AS samples, count(DISTINCT patient) AS patients, CAST(0 AS BIGINT) AS torn_patients FROM kept JOIN named USING (patient) GROUP BY 1""",
    "log_repaired": f"""WITH {_LAST}, lines AS (SELECT e.run_id, e.epoch, e.score FROM epochs e JOIN gaps g USING (run_id) WHERE NOT (g.ahead = 1 AND e.epoch = g.last)
  UNION ALL SELECT s.run_id, s.epoch, s.score FROM saved s JOIN gaps g USING (run_id) WHERE g.ahead = -1)
SELECT run_id, count(*) AS lines, max(epoch) AS last_epoch, round(sum(score), 6) AS score_sum FROM lines GROUP BY 1""",
    "log_orphans": f"WITH {_LAST} SELECT e.run_id, e.epoch, e.phase FROM epochs e JOIN gaps g USING (run_id) WHERE g.ahead = 1 AND e.epoch = g.last",
    "atrous_rates": """WITH m AS (SELECT DISTINCT p_size * 2 - 1 AS map_size FROM part), r AS (SELECT map_size, CASE WHEN map_size <= 16 THEN [2, 3, 5] WHEN map_size <= 24 THEN [2, 4, 6] WHEN map_size <= 40 THEN [3, 6, 9] ELSE [6, 12, 18] END AS r FROM m)
SELECT map_size, """ + ", ".join(f"CASE WHEN map_size > 0 THEN CAST(least(r[{i}], greatest(1, (map_size - 1) // 2)) AS INTEGER) END AS rate_{i}" for i in (1, 2, 3)) + " FROM r",
    "typed_cells": "WITH l AS (" + " UNION ALL ".join(f"SELECT '{c}' AS field, {c} AS v FROM manifest" for c in ("sample_id", "calibration_for_folds", "previous_split", "exact_duplicate_group", "manifest_version")) + """),
k AS (SELECT field, v, CASE WHEN v IS NULL OR lower(trim(v)) IN ('', 'none', 'null', 'nan') THEN 'null' WHEN lower(trim(v)) IN ('true', 'false') THEN 'bool' WHEN regexp_full_match(trim(v), '[+-]?[0-9]+') AND TRY_CAST(trim(v) AS BIGINT) IS NOT NULL THEN 'int'
  WHEN regexp_full_match(lower(trim(v)), '[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)(e[+-]?[0-9]+)?') THEN 'float' ELSE 'string' END AS kind FROM l)
SELECT field, kind, count(*) AS cells, CAST(sum(CASE WHEN kind = 'int' THEN TRY_CAST(trim(v) AS BIGINT) ELSE 0 END) AS BIGINT) AS whole_sum, round(sum(CASE WHEN kind = 'float' THEN TRY_CAST(trim(v) AS DOUBLE) ELSE 0 END), 6) AS number_sum,
  count(*) FILTER (kind = 'bool' AND lower(trim(v)) = 'true') AS true_cells, CAST(coalesce(max(CASE WHEN kind = 'string' THEN length(v) END), 0) AS INTEGER) AS longest FROM k GROUP BY 1, 2""",
    "weighted_draws": f"""WITH {SAMPLES_SQL}, ok AS (SELECT sample_id, class_id, row_number() OVER (PARTITION BY class_id ORDER BY sha256('11:' || sample_id)) AS rank, count(*) OVER (PARTITION BY class_id) AS n FROM samples WHERE eligible = 1 AND class_id IN (0, 1, 2)),
d AS (SELECT i AS draw, ('0x' || substr(sha256('c11:' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS c, ('0x' || substr(sha256('r11:' || i), 1, 12))::BIGINT / 281474976710656.0::DOUBLE AS r FROM range(2000) t(i)),
k AS (SELECT draw, CASE WHEN c < 0.25 THEN 0 WHEN c < 0.75 THEN 1 ELSE 2 END AS class_id, r FROM d), sizes AS (SELECT DISTINCT class_id, n FROM ok)
SELECT draw, sample_id, class_id FROM k JOIN sizes USING (class_id) JOIN ok o USING (class_id) WHERE o.rank = CAST(floor(r * sizes.n) AS BIGINT) + 1""",
}
_NAMES = (
    curation, contract_checks, prior_test_guard, written_paths, ordered_selection, selection_by_reason, resolved_paths, first_predictions, first_paths, candidate_order, saved_order, lesion_splits, atrous_rates, typed_cells, log_repaired, log_orphans, weighted_draws,
)
QUERIES = {f.__name__: f for f in _NAMES}
