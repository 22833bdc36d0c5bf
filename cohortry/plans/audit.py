"""Linkage, series selection, quality control and statuses over the driver tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import manifests, qc, selection, status
from ..operators.spread import dealt_by
from .common import r6, rounded, table


def _exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_custkey").alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("exam_date"), F.col("o_orderkey").alias("exam"), "o_orderstatus", "o_orderpriority", "o_totalprice")


EXAMS_SQL = "exams AS (SELECT o_custkey AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS exam_date, o_orderkey AS exam, o_orderstatus, o_orderpriority, o_totalprice FROM orders)"


def anchor_linkage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each customer's anchor is a stated order, which may be another's, or none."""
    clinical = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), (F.col("c_custkey") * 13).alias("series_uid"))
    series = _exams(spark, sf_dir).select(F.col("exam").alias("series_uid"), F.col("patient_id").alias("subject"), "exam_date")
    return qc.link_anchor(clinical, series).withColumn("same_subject", F.coalesce(F.col("patient_id") == F.col("subject"), F.lit(False)))


ANCHOR_SQL = f"""WITH {EXAMS_SQL} SELECT c_custkey AS patient_id, c_custkey * 13 AS series_uid, e.patient_id AS subject, e.exam_date,
  CASE WHEN e.exam IS NULL THEN 'anchor_not_found' ELSE 'linked' END AS link_status, coalesce(c_custkey = e.patient_id, false) AS same_subject
FROM customer LEFT JOIN exams e ON e.exam = c_custkey * 13"""


def exam_date_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exams(spark, sf_dir)
    return qc.exam_dates(("reconstructed", e.where("exam % 2 = 0")), ("anchor", e.where("exam % 3 = 0")), ("metadata", e.where("exam % 5 <> 0")))


DATES_SQL = f"""WITH {EXAMS_SQL}, u AS (SELECT patient_id, exam_date, 'reconstructed' AS s FROM exams WHERE exam % 2 = 0 UNION ALL SELECT patient_id, exam_date, 'anchor' FROM exams WHERE exam % 3 = 0
  UNION ALL SELECT patient_id, exam_date, 'metadata' FROM exams WHERE exam % 5 <> 0)
SELECT patient_id, exam_date, string_agg(DISTINCT s, ';' ORDER BY s) AS sources FROM u GROUP BY ALL"""


def _phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(F.col("l_orderkey").alias("exam"), (F.col("l_linenumber") - 1).alias("phase_index")).agg(F.max(F.floor("l_quantity")).cast("long").alias("size"), F.max("l_partkey").alias("part"))


PHASES_SQL = "phases AS (SELECT l_orderkey AS exam, l_linenumber - 1 AS phase_index, max(floor(l_quantity))::BIGINT AS size, max(l_partkey) AS part FROM lineitem GROUP BY ALL)"


def expected_vs_actual_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases of an exam against those with some taken, some sizes changed."""
    p = _phases(spark, sf_dir)
    actual = p.where("part % 9 <> 0").withColumn("size", F.when(F.col("part") % 10 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return qc.phase_comparison(p.where("part % 7 <> 0"), actual, ["exam"])


EXPECTED_SQL = f"""WITH {PHASES_SQL}, e AS (SELECT * FROM phases WHERE part % 7 <> 0), a AS (SELECT exam, phase_index, CASE WHEN part % 10 = 0 THEN size + 1 ELSE size END AS size FROM phases WHERE part % 9 <> 0),
b AS (SELECT coalesce(e.exam, a.exam) AS exam, coalesce(e.phase_index, a.phase_index) AS i, e.size AS want, a.size AS got, e.exam AS ee, a.exam AS aa FROM e FULL JOIN a ON e.exam = a.exam AND e.phase_index = a.phase_index)
SELECT exam, coalesce(string_agg(i::VARCHAR, ';' ORDER BY i) FILTER (aa IS NULL), '') AS missing, coalesce(string_agg(i::VARCHAR, ';' ORDER BY i) FILTER (ee IS NULL), '') AS unexpected,
  count(ee) = count(aa) AS count_matches, bool_and(want IS NOT DISTINCT FROM got) AS header_matches FROM b GROUP BY exam"""


def anchor_phase_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reconstructed against curated phases, full outer, counted by status."""
    p = _phases(spark, sf_dir)
    left = p.where("part % 7 <> 0").select("exam", "phase_index", F.col("size").alias("a"))
    right = p.where("part % 9 <> 0").select("exam", "phase_index", (F.col("size") + (F.col("part") % 4 == 0).cast("int")).alias("b"))
    both = left.join(right, ["exam", "phase_index"], "full")
    s = status.anchor_comparison(F.col("a").isNotNull(), F.col("b").isNotNull(), F.abs(F.col("a") - F.col("b")) < 1, F.col("a") % 2 == F.col("b") % 2)
    return both.groupBy(s.alias("status")).agg(F.count(F.lit(1)).alias("n"))


ANCHOR_STATUS_SQL = f"""WITH {PHASES_SQL}, l AS (SELECT exam, phase_index, size AS a FROM phases WHERE part % 7 <> 0), r AS (SELECT exam, phase_index, size + (part % 4 = 0)::INT AS b FROM phases WHERE part % 9 <> 0)
SELECT CASE WHEN a IS NULL THEN 'missing_reconstructed' WHEN b IS NULL THEN 'missing_curated' WHEN abs(a - b) >= 1 THEN 'shape_mismatch' WHEN a % 2 <> b % 2 THEN 'content_differs' ELSE 'match' END AS status, count(*) AS n
FROM l FULL JOIN r ON l.exam = r.exam AND l.phase_index = r.phase_index GROUP BY 1"""


def missing_extra_timepoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exams(spark, sf_dir)
    return qc.date_sets(e.where("exam % 4 <> 0"), e.where("exam % 5 <> 0"))


TIMEPOINTS_SQL = f"""WITH {EXAMS_SQL}, t AS (SELECT DISTINCT patient_id, exam_date FROM exams WHERE exam % 4 <> 0), g AS (SELECT DISTINCT patient_id, exam_date FROM exams WHERE exam % 5 <> 0),
b AS (SELECT coalesce(t.patient_id, g.patient_id) AS patient_id, coalesce(t.exam_date, g.exam_date) AS d, t.exam_date AS td, g.exam_date AS gd FROM t FULL JOIN g ON t.patient_id = g.patient_id AND t.exam_date = g.exam_date)
SELECT patient_id, coalesce(string_agg(d, ';' ORDER BY d) FILTER (gd IS NULL), '') AS missing, coalesce(string_agg(d, ';' ORDER BY d) FILTER (td IS NULL), '') AS extra,
  count(*) FILTER (td IS NOT NULL AND gd IS NOT NULL) AS shared FROM b GROUP BY patient_id"""


def duplicate_across_exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of the same content in earlier exams; content is a hash of the quantity."""
    joined = _phases(spark, sf_dir).join(_exams(spark, sf_dir).select("exam", "patient_id", "exam_date"), "exam")
    rows = joined.groupBy("patient_id", "exam_date", "phase_index").agg(F.sha1(F.max("size").cast("string").cast("binary")).alias("print"))
    return qc.duplicate_notes(rows, "print").select("patient_id", "exam_date", "phase_index", "earlier")


DUPLICATES_SQL = f"""WITH {PHASES_SQL}, {EXAMS_SQL}, r AS (SELECT patient_id, exam_date, phase_index, max(size) AS s FROM phases JOIN exams USING (exam) GROUP BY ALL)
SELECT patient_id, exam_date, phase_index, coalesce(string_agg(exam_date, ';') OVER (PARTITION BY patient_id, phase_index, s ORDER BY exam_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS earlier FROM r"""


def risk_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contiguity, sizes and the curated phase count; what the other rules look at is in order (see ``exam_risk_audit``)."""
    one = F.array(F.lit(1.0))
    p = _phases(spark, sf_dir).select("exam", "phase_index", F.array(F.floor(F.col("size") / 30)).alias("shape"), one.alias("spacing"), one.alias("affine"))
    curated = _exams(spark, sf_dir).where("exam % 5 = 0").select("exam", (F.col("exam") % 6 + 1).alias("curated_phases"))
    fine = {"is_anchor": True, "exists": True, "quarantined": False, "n_selected": 1, "n_expected": 0, "count_matches": True, "header_matches": True, "curated_view": "", "selection_note": "selected", "duplicate_notes": ""}
    exams = p.select("exam").distinct().join(curated, "exam", "left").withColumns({c: F.lit(v) for c, v in fine.items()} | {"planes": F.array().cast("array<string>")})
    return qc.full_exam_risk(exams, qc.phase_consistency(p, ["exam"]), ["exam"])


RISK_SQL = f"""WITH {PHASES_SQL}, x AS (SELECT exam, list_sort(list(phase_index)) AS i, count(DISTINCT floor(size / 30)) AS shapes, count(*) AS n FROM phases GROUP BY exam),
c AS (SELECT exam, CASE WHEN i = range(len(i)) THEN NULL WHEN i[1] <> 0 THEN 'does_not_start_at_zero' ELSE 'non_contiguous' END AS a,
  CASE WHEN shapes > 1 THEN 'shape_mismatch_between_reconstructed_phases' END AS b, CASE WHEN exam % 5 = 0 AND exam IN (SELECT o_orderkey FROM orders) AND exam % 6 + 1 <> n THEN 'anchor_phase_count_mismatch' END AS d FROM x)
SELECT exam, coalesce(nullif(array_to_string(list_sort(list_filter([a, b, d], lambda v: v IS NOT NULL)), '|'), ''), 'ok') AS risk_status FROM c"""


def _referenced(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exams(spark, sf_dir).withColumn("is_anchor", F.col("exam") % 11 == 0)
    return qc.reference_exam(e)


def reference_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _referenced(spark, sf_dir).select("patient_id", "exam", "reference", "reference_rule", "is_reference")


_REFERENCE_SQL = f"""{EXAMS_SQL}, ref AS (SELECT patient_id, exam AS reference, CASE WHEN exam % 11 = 0 THEN 'anchor' ELSE 'earliest' END AS reference_rule FROM (
  SELECT *, row_number() OVER (PARTITION BY patient_id ORDER BY (exam % 11 = 0) DESC, exam_date, exam) AS r FROM exams) WHERE r = 1),
refd AS (SELECT e.*, reference, reference_rule, exam = reference AS is_reference FROM exams e JOIN ref USING (patient_id))"""


def view_match_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Status and priority against the reference exam's; an unspecified priority is unknown."""
    e = _referenced(spark, sf_dir)
    ref = e.where("is_reference").select("patient_id", F.col("o_orderstatus").alias("ref_status"), F.col("o_orderpriority").alias("ref_priority"))
    j = e.join(ref, "patient_id")
    known = ~F.col("o_orderpriority").startswith("4")
    j = j.withColumn("view_matches", F.when(known, F.col("o_orderpriority") == F.col("ref_priority"))).withColumn("contrast_matches", F.col("o_orderstatus") == F.col("ref_status"))
    found = text.issues((~F.col("view_matches"), "view_mismatch"), (~F.col("contrast_matches"), "contrast_mismatch"))
    return qc.match_rollup(j.withColumn("status", found), ["view_matches", "contrast_matches"])


VIEW_SQL = f"""WITH {_REFERENCE_SQL}, j AS (
  SELECT e.patient_id, CASE WHEN e.o_orderpriority NOT LIKE '4%' THEN e.o_orderpriority = r.o_orderpriority END AS v, e.o_orderstatus = r.o_orderstatus AS c FROM refd e JOIN refd r ON e.patient_id = r.patient_id AND r.is_reference
), s AS (SELECT *, CASE WHEN v = false AND c = false THEN 'contrast_mismatch|view_mismatch' WHEN v = false THEN 'view_mismatch' WHEN c = false THEN 'contrast_mismatch' ELSE 'ok' END AS status FROM j)
SELECT patient_id, count(*) AS exams, string_agg(DISTINCT status, '|' ORDER BY status) AS statuses, bool_and(coalesce(v, true)) AS all_view_matches, bool_and(coalesce(c, true)) AS all_contrast_matches FROM s GROUP BY patient_id"""


def _visual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each exam's price against the reference's stands for field of view, spacing, score and correlations."""
    e = _referenced(spark, sf_dir)
    ref = e.where("is_reference").select("patient_id", F.col("o_totalprice").alias("ref_price"))
    j = e.join(ref, "patient_id").withColumn("fov_diff", r6(F.abs(F.col("o_totalprice") - F.col("ref_price")) / F.greatest(F.abs("ref_price"), F.lit(1e-6))))
    j = j.withColumn("score", F.when(F.col("exam") % 13 != 0, (F.col("exam") % 100) / 100.0)).withColumn("corr", F.when(F.col("exam") % 3 != 0, (F.col("exam") % 40) / 100.0))
    no = F.lit(False)
    found = status.visual_review(F.col("is_reference"), no, no, F.lit(None).cast("boolean"), F.col("fov_diff"), F.col("fov_diff") / 2, F.col("score"), F.col("corr"), F.col("corr") / 8)
    return j.withColumn("found", found).withColumn("status", F.when(F.col("found.reason") == "", F.col("found.status")).otherwise(F.col("found.reason"))).drop("found")


_VISUAL_SQL = f"""{_REFERENCE_SQL}, v0 AS (
  SELECT e.*, round(abs(e.o_totalprice - r.o_totalprice) / greatest(abs(r.o_totalprice), 1e-6), 6) AS fov_diff, CASE WHEN e.exam % 13 <> 0 THEN (e.exam % 100) / 100.0::DOUBLE END AS score,
    CASE WHEN e.exam % 3 <> 0 THEN (e.exam % 40) / 100.0::DOUBLE END AS corr FROM refd e JOIN refd r ON e.patient_id = r.patient_id AND r.is_reference
), v AS (
  SELECT *, CASE WHEN is_reference THEN 'reference_exam' ELSE coalesce(nullif(array_to_string(list_sort(list_filter([CASE WHEN fov_diff > 0.35 THEN 'fov_difference' END, CASE WHEN fov_diff / 2 > 0.75 THEN 'spacing_difference' END,
    CASE WHEN score < 0.25 AND coalesce(corr < 0.2, true) AND coalesce(corr / 8 < 0.05, true) THEN 'low_visual_similarity' END], lambda x: x IS NOT NULL)), '|'), ''), 'ok') END AS status FROM v0)"""


def review_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.review_queue(_visual(spark, sf_dir)).select("patient_id", "exam", "status", "score", "fov_diff", "place")


REVIEW_SQL = f"""WITH {_VISUAL_SQL} SELECT patient_id, exam, status, score, fov_diff, row_number() OVER (PARTITION BY patient_id ORDER BY coalesce(score, -1), exam_date, exam)::INTEGER AS place
FROM v WHERE status NOT IN ('ok', 'reference_exam')"""


def visual_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.visual_rollup(_visual(spark, sf_dir))


ROLLUP_SQL = f"""WITH {_VISUAL_SQL} SELECT patient_id, CASE WHEN count(*) FILTER (NOT is_reference) = 0 THEN 1.0 ELSE min(score) FILTER (NOT is_reference) END AS min_score,
  CASE WHEN count(*) FILTER (NOT is_reference) = 0 THEN 0.0 ELSE max(fov_diff) FILTER (NOT is_reference) END AS max_fov_diff, count(*) FILTER (NOT is_reference AND status <> 'ok') AS review_exams FROM v GROUP BY patient_id"""


def mismatch_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How many patients have any exam to review, or any mismatch."""
    review = qc.visual_rollup(_visual(spark, sf_dir)).agg(F.count_if(F.col("review_exams") > 0).alias("n")).select(F.lit("review").alias("kind"), "n")
    return review.unionByName(view_match_rollup(spark, sf_dir).agg(F.count_if(~F.col("all_view_matches")).alias("n")).select(F.lit("view").alias("kind"), "n"))


MISMATCH_SQL = f"SELECT 'review' AS kind, count(*) AS n FROM ({ROLLUP_SQL}) WHERE review_exams > 0 UNION ALL SELECT 'view', count(*) FROM ({VIEW_SQL}) WHERE NOT all_view_matches"


def staged_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _phases(spark, sf_dir).select(F.col("exam").alias("patient_id"), "phase_index", "size", "part")
    return qc.staged_pairs(p.where("part % 2 = 0").select("patient_id", "phase_index", "size"), p.where("part % 3 <> 0").select("patient_id", "phase_index", F.col("size").alias("curated")), p.where("part % 5 <> 0").select("patient_id", "phase_index", F.col("part").alias("mask")))


STAGED_SQL = f"""WITH {PHASES_SQL} SELECT s.exam AS patient_id, s.phase_index, s.size, c.size AS curated, m.part AS mask,
  CASE WHEN c.exam IS NULL THEN 'missing_curated' WHEN m.exam IS NULL THEN 'missing_mask' ELSE 'paired' END AS pair_status
FROM (SELECT * FROM phases WHERE part % 2 = 0) s LEFT JOIN (SELECT * FROM phases WHERE part % 3 <> 0) c ON s.exam = c.exam AND s.phase_index = c.phase_index
LEFT JOIN (SELECT * FROM phases WHERE part % 5 <> 0) m ON s.exam = m.exam AND s.phase_index = m.phase_index"""


def root_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exams(spark, sf_dir)
    return qc.root_status(e.where("exam % 4 <> 0"), e.where("exam % 3 = 0").withColumn("path", F.concat(F.lit("q/"), F.lpad(F.col("exam").cast("string"), 9, "0"))))


ROOT_SQL = f"""WITH {EXAMS_SQL}, a AS (SELECT DISTINCT patient_id, exam_date FROM exams WHERE exam % 4 <> 0), q AS (SELECT patient_id, exam_date, min('q/' || lpad(exam::VARCHAR, 9, '0')) AS p FROM exams WHERE exam % 3 = 0 GROUP BY ALL)
SELECT coalesce(a.patient_id, q.patient_id) AS patient_id, coalesce(a.exam_date, q.exam_date) AS exam_date,
  CASE WHEN a.patient_id IS NOT NULL AND q.patient_id IS NOT NULL THEN 'both' WHEN a.patient_id IS NOT NULL THEN 'active' ELSE 'quarantined' END AS root_status, q.p AS quarantine_path
FROM a FULL JOIN q ON a.patient_id = q.patient_id AND a.exam_date = q.exam_date"""


def work_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _exams(spark, sf_dir).select("patient_id", "exam_date", "exam")
    return qc.work_list(e.where("exam % 4 = 0").select("patient_id", "exam_date").distinct(), e.where("patient_id % 7 <> 0"), e.where("patient_id % 5 <> 0"), e.where("exam % 8 = 0"))


WORK_SQL = f"""WITH {EXAMS_SQL}, m AS (SELECT DISTINCT patient_id, exam_date FROM exams WHERE exam % 4 = 0)
SELECT patient_id, exam_date, CASE WHEN patient_id % 7 = 0 THEN 'not_in_workbook' WHEN patient_id % 5 = 0 THEN 'no_anchor'
  WHEN (patient_id, exam_date) NOT IN (SELECT (patient_id, exam_date) FROM exams WHERE exam % 8 = 0) THEN 'no_exam_group' ELSE 'process' END AS action FROM m"""


def series_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_orderkey", (F.col("l_linenumber") * 1000000 + F.col("l_partkey")).alias("o"), "l_returnflag", F.col("l_partkey").cast("string").alias("uid"), "l_linestatus")
    return qc.series_summary(rows, ["l_orderkey"], "o", ["l_returnflag", "uid"], ["l_linestatus"])


SUMMARY_SQL = """SELECT l_orderkey, count(*) AS n_series, string_agg(l_returnflag, ' | ' ORDER BY l_linenumber * 1000000 + l_partkey, l_returnflag) AS l_returnflag_list,
  string_agg(l_partkey::VARCHAR, ' | ' ORDER BY l_linenumber * 1000000 + l_partkey, l_returnflag) AS uid_list, count(DISTINCT l_linestatus) AS n_l_linestatus FROM lineitem GROUP BY l_orderkey"""


def _candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as candidate series of an exam; the part gives name, tokens and image count."""
    part = table(spark, sf_dir, "part").select("p_partkey", "p_name", "p_type", "p_size")
    each = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    size = each.count()
    lines = dealt_by(each, ["l_orderkey"], size).groupBy("l_orderkey", "l_partkey").agg(F.min("l_linenumber").alias("l_linenumber"))
    j = dealt_by(lines, ["l_partkey"], size).join(dealt_by(part, ["p_partkey"], size), lines["l_partkey"] == part["p_partkey"])
    j = dealt_by(j, ["l_orderkey"], size)
    return j.select(F.col("l_orderkey").alias("exam"), F.col("l_partkey").alias("uid"), F.col("p_name").alias("name"), F.col("p_size").alias("images"), "p_type", "l_linenumber",
                    F.array_sort(F.array_distinct(F.split("p_name", " "))).alias("tokens"))


_CANDIDATES_SQL = """cand AS (
  SELECT l_orderkey AS exam, l_partkey AS uid, p_name AS name, p_size AS images, p_type, l_linenumber, list_sort(list_distinct(string_split(p_name, ' '))) AS tokens
  FROM (SELECT l_orderkey, l_partkey, min(l_linenumber) AS l_linenumber FROM lineitem GROUP BY ALL) JOIN part ON l_partkey = p_partkey)"""


def best_series_per_exam(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir).withColumn("name", F.concat_ws("#", "name", F.col("uid").cast("string")))
    return selection.best_series(c, ["exam"]).select("exam", "uid", "images")


BEST_SQL = f"""WITH {_CANDIDATES_SQL} SELECT exam, uid, images FROM (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY images DESC, name || '#' || uid) AS r FROM cand) WHERE r = 1"""


def _groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The anchor of an exam is its candidate of the smallest uid."""
    c = _candidates(spark, sf_dir).withColumn("key", F.array_join("tokens", " "))
    anchor = c.groupBy("exam").agg(F.min_by(F.struct("key", "tokens", "uid"), "uid").alias("a"))
    moved = anchor.select((F.col("exam") + 1).alias("exam"), F.col("a.key").alias("anchor_key"), F.col("a.tokens").alias("anchor_tokens"), F.col("a.uid").alias("anchor_uid"))
    moved = dealt_by(moved, ["exam"], table(spark, sf_dir, "lineitem").count())
    return selection.family_groups(c.join(moved, "exam"), ["exam"], "anchor_key", "anchor_tokens", "anchor_uid")


def family_group_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(_groups(spark, sf_dir).select("exam", "key", "series", "score", "rank"), "score")


def family_group_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(selection.select_family(_groups(spark, sf_dir), ["exam"]), "score")


_GROUPS_SQL = f"""{_CANDIDATES_SQL}, k AS (SELECT *, array_to_string(tokens, ' ') AS key FROM cand),
anchor AS (SELECT exam + 1 AS exam, arg_min(key, uid) AS anchor_key, arg_min(tokens, uid) AS anchor_tokens, min(uid) AS anchor_uid FROM k GROUP BY exam),
g0 AS (SELECT k.exam, key, any_value(tokens) AS tokens, count(*) AS series, any_value(anchor_key) AS anchor_key, any_value(anchor_tokens) AS atok, bool_or(uid = anchor_uid) AS has FROM k JOIN anchor a ON k.exam = a.exam GROUP BY k.exam, key),
g1 AS (SELECT *, len(list_intersect(tokens, atok)) AS c FROM g0),
g2 AS (SELECT *, round(greatest(2.0::DOUBLE * c / (len(tokens) + len(atok)), c::DOUBLE / len(atok)) + (key = anchor_key)::INT + 2 * has::INT, 9) AS score FROM g1),
groups AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY score DESC, key)::INTEGER AS rank FROM g2)"""
GROUP_SCORES_SQL = f"WITH {_GROUPS_SQL} SELECT exam, key, series, round(score, 6) AS score, rank FROM groups"
SELECTION_SQL = f"""WITH {_GROUPS_SQL}, t AS (SELECT *, max(score) OVER (PARTITION BY exam) AS top, max(CASE WHEN rank = 2 THEN score END) OVER (PARTITION BY exam) AS second FROM groups),
p AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY (key = anchor_key AND top < 1)::INT DESC, rank) AS r, CASE WHEN key = anchor_key AND top < 1 THEN 1.0 ELSE top END AS s FROM t)
SELECT exam, CASE WHEN s >= 0.45 THEN key END AS key, round(s, 6) AS score, CASE WHEN s < 0.45 THEN 'no_family_match' WHEN abs(s - second) < 0.05 THEN 'near_tie' ELSE 'selected' END AS note FROM p WHERE r = 1"""


def scored_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Candidates scored by name, type and size against stated targets, with reasons and verdicts."""
    c = _candidates(spark, sf_dir)
    goal = F.col("exam") % 50 + 1
    found = selection.scored(c, [
        (F.col("name").startswith("hot"), 6.0, "name"), (F.col("p_type") == "ECONOMY", 4.0, "type"), (F.col("images") == goal, 4.0, "same_count"),
        ((F.abs(F.col("images") - goal) <= 5) & (F.col("images") != goal), 3.0, "near_count"), (F.abs(F.col("images") - goal) >= 40, -2.0, "far_count"),
    ])
    return selection.pick_scored(found, ["exam"], "uid").select("exam", "uid", "score", "reasons", "rank", "verdict", "selected")


SCORED_SQL = f"""WITH {_CANDIDATES_SQL}, s AS (SELECT *, abs(images - (exam % 50 + 1)) AS d FROM cand), t AS (
  SELECT exam, uid, (CASE WHEN name LIKE 'hot%' THEN 6.0 ELSE 0 END + CASE WHEN p_type = 'ECONOMY' THEN 4.0 ELSE 0 END + CASE WHEN d = 0 THEN 4.0 ELSE 0 END + CASE WHEN d BETWEEN 1 AND 5 THEN 3.0 ELSE 0 END + CASE WHEN d >= 40 THEN -2.0 ELSE 0 END)::DOUBLE AS score,
    array_to_string(list_filter([CASE WHEN name LIKE 'hot%' THEN 'name' END, CASE WHEN p_type = 'ECONOMY' THEN 'type' END, CASE WHEN d = 0 THEN 'same_count' END, CASE WHEN d BETWEEN 1 AND 5 THEN 'near_count' END, CASE WHEN d >= 40 THEN 'far_count' END], lambda x: x IS NOT NULL), ';') AS reasons FROM s
), r AS (SELECT *, row_number() OVER (PARTITION BY exam ORDER BY score DESC, uid)::INTEGER AS rank FROM t),
v AS (SELECT *, max(CASE WHEN rank = 1 THEN score END) OVER w AS b, max(CASE WHEN rank = 2 THEN score END) OVER w AS c FROM r WINDOW w AS (PARTITION BY exam)),
z AS (SELECT *, CASE WHEN b < 4 THEN 'low' WHEN b - c < 1 THEN 'ambiguous' ELSE 'selected' END AS verdict FROM v)
SELECT exam, uid, score, reasons, rank, verdict, rank = 1 AND verdict = 'selected' AS selected FROM z"""


def rule_and_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unique best rule score of each exam, and how many series the first matching term takes."""
    c = _candidates(spark, sf_dir).withColumn("rule_score", F.col("images") % 4)
    best = selection.unique_best(c, ["exam"])
    terms = selection.first_term(c, ["exam"], ["widget", "gear", "old"], "name").groupBy("exam").agg(F.max("term").alias("term"), F.count(F.lit(1)).alias("taken"))
    return best.join(terms, "exam", "left")


RULE_SQL = f"""WITH {_CANDIDATES_SQL}, b AS (SELECT exam, max(images % 4) AS best FROM cand GROUP BY exam), u AS (SELECT exam, best, count(*) FILTER (images % 4 = best) AS ties FROM cand JOIN b USING (exam) GROUP BY exam, best),
h AS (SELECT exam, unnest([0, 1, 2]) AS pos, unnest(['widget', 'gear', 'old']) AS term, name FROM cand), m AS (SELECT *, min(pos) OVER (PARTITION BY exam) AS least FROM h WHERE contains(lower(name), term)),
t AS (SELECT exam, max(term) AS term, count(*) AS taken FROM m WHERE pos = least GROUP BY exam)
SELECT u.exam, best, ties, CASE WHEN ties > 1 THEN 'ambiguous' ELSE 'unique' END AS status, term, taken FROM u LEFT JOIN t ON u.exam = t.exam"""


def ordered_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _candidates(spark, sf_dir)
    c = c.select("exam", "uid", F.when(F.col("uid") % 3 != 0, F.col("images")).alias("time"), F.when(F.col("uid") % 2 == 0, F.col("l_linenumber")).alias("phase"), F.concat_ws("#", "name", F.col("uid").cast("string")).alias("name"))
    return selection.ordered_series(c, ["exam"]).select("exam", "uid", "place")


ORDERED_SQL = f"""WITH {_CANDIDATES_SQL} SELECT exam, uid, row_number() OVER (PARTITION BY exam ORDER BY CASE WHEN uid % 3 <> 0 THEN images END NULLS LAST, CASE WHEN uid % 2 = 0 THEN l_linenumber END NULLS LAST, name || '#' || uid)::INTEGER AS place FROM cand"""


def manifest_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligibility, geometry, region and volume statuses of each patient, with fallback."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    rows = c.select(
        n.alias("patient_id"), F.when(n % 11 != 0, n % 2).alias("label"), F.when(n % 7 == 0, None).when(n % 5 == 0, "test").otherwise("train").alias("split"), (n % 4).alias("phases"), F.col("c_acctbal").alias("bal"),
    )
    geometry = status.geometry_status(F.col("phases") == 0, F.col("patient_id") % 13 == 0, F.col("patient_id") % 9 != 0, F.col("patient_id") % 6 != 0)
    rows = rows.withColumn("geometry", geometry)
    roi = status.roi_status(F.col("patient_id") % 17 != 0, F.col("patient_id") % 8 != 0, F.col("patient_id") % 10, F.col("patient_id") % 9 != 0, F.col("patient_id") % 6 != 0)
    gate = status.volume_gate(F.when(F.col("bal") > 0, F.col("bal") / 1000), F.when(F.col("patient_id") % 3 != 0, F.lit(2.0)))
    case = status.segmentation_case(F.col("patient_id") % 4 != 0, F.col("patient_id") % 5 != 0, F.col("patient_id") % 9 != 0)
    note = status.comparison_note(F.col("patient_id") % 19 != 0, F.col("patient_id") % 18 != 0, F.col("patient_id") % 4 != 0, F.col("patient_id") % 5 != 0, F.col("patient_id") % 9 != 0)
    fallback = status.with_fallback(roi)
    return rows.select(
        "patient_id", status.benchmark_status(F.col("label"), F.col("split"), F.col("phases"), F.col("geometry")).alias("benchmark_status"), "geometry",
        roi.alias("roi_status"), fallback["status"].alias("final_status"), fallback["reason"].alias("reason"), gate["gate"].alias("gate"), r6(gate["ratio"]).alias("ratio"), case.alias("case_status"), note.alias("note"),
    )


MANIFEST_STATUS_SQL = """WITH r AS (SELECT c_custkey AS n, CASE WHEN c_custkey % 11 <> 0 THEN c_custkey % 2 END AS label, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split, c_custkey % 4 AS phases,
  CASE WHEN c_acctbal > 0 THEN c_acctbal / 1000 END AS pred, CASE WHEN c_custkey % 3 <> 0 THEN 2.0 END AS ref FROM customer),
g AS (SELECT *, CASE WHEN phases = 0 THEN 'missing_phase' WHEN n % 13 = 0 THEN 'header_error' WHEN n % 9 = 0 THEN 'shape_mismatch' WHEN n % 6 = 0 THEN 'affine_mismatch' ELSE 'matched' END AS geometry,
  CASE WHEN n % 17 = 0 THEN 'missing_image' WHEN n % 8 = 0 THEN 'missing_mask' WHEN n % 10 = 0 THEN 'empty_mask' WHEN n % 9 = 0 THEN 'mask_image_shape_mismatch' WHEN n % 6 = 0 THEN 'mask_image_affine_mismatch' ELSE 'usable' END AS roi FROM r)
SELECT n AS patient_id, CASE WHEN label IS NULL THEN 'missing_label' WHEN split IS NULL THEN 'missing_split' WHEN phases < 1 THEN 'missing_phase0' WHEN geometry <> 'matched' THEN 'phase_geometry_mismatch' ELSE 'usable' END AS benchmark_status,
  geometry, roi AS roi_status, CASE WHEN roi IN ('usable', 'missing_image') THEN roi ELSE 'whole_image_fallback' END AS final_status, CASE WHEN roi IN ('usable', 'missing_image') THEN '' ELSE roi END AS reason,
  CASE WHEN pred IS NULL THEN 'empty_prediction' WHEN pred < 0.05 THEN 'too_small' WHEN ref IS NULL THEN 'missing_reference' WHEN pred / ref < 0.2 THEN 'ratio_low' WHEN pred / ref > 5 THEN 'ratio_high' ELSE 'pass' END AS gate,
  round(CASE WHEN pred IS NULL THEN 0.0 WHEN pred < 0.05 OR ref IS NULL THEN NULL ELSE pred / ref END, 6) AS ratio,
  CASE WHEN n % 4 = 0 THEN 'missing_prediction' WHEN n % 5 = 0 THEN 'missing_label' WHEN n % 9 = 0 THEN 'shape_mismatch' ELSE 'ok' END AS case_status,
  CASE WHEN n % 19 = 0 THEN 'unreadable' WHEN n % 18 = 0 THEN 'missing_pair' WHEN n % 4 = 0 THEN 'missing_prediction' WHEN n % 5 = 0 THEN 'missing_mask' WHEN n % 9 = 0 THEN 'grids_differ' ELSE '' END AS note FROM g"""


def eligible_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Eligible patients joined with the split, clashing columns suffixed, extra exams only."""
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("dataset"), F.when(F.col("c_custkey") % 11 != 0, F.col("c_custkey") % 2).alias("label"))
    s = table(spark, sf_dir, "customer").where("c_custkey % 7 <> 0").select(F.col("c_custkey").alias("patient_id"), F.when(F.col("c_custkey") % 5 == 0, "test").otherwise("train").alias("split"), F.lower("c_mktsegment").alias("dataset"), F.when(F.col("c_custkey") % 3 == 0, "Yes").otherwise("0").alias("usable"))
    rows = status.eligible(manifests.join_with_suffix(c, s, "patient_id", "_clinical"), flag="usable")
    return status.role_filter(rows.withColumn("is_anchor", F.col("patient_id") % 2 == 0), "extra").select("patient_id", "dataset", "dataset_clinical", "label", "split")


ELIGIBLE_SQL = """SELECT c_custkey AS patient_id, c_mktsegment AS dataset, lower(c_mktsegment) AS dataset_clinical, c_custkey % 2 AS label, CASE WHEN c_custkey % 5 = 0 THEN 'test' ELSE 'train' END AS split
FROM customer WHERE c_custkey % 11 <> 0 AND c_custkey % 7 <> 0 AND c_custkey % 3 = 0 AND c_custkey % 2 = 1"""


def train_val_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").where("quality is not null").select(F.col("doc_id").alias("patient_id"), F.col("quality").alias("label"))
    return status.stratified_split(rows, 0.2, 2026)


TRAIN_VAL_SQL = """WITH r AS (SELECT doc_id AS patient_id, quality AS label, row_number() OVER (PARTITION BY quality ORDER BY ('0x' || substr(md5('2026|' || doc_id), 1, 8))::BIGINT, doc_id) AS k, count(*) OVER (PARTITION BY quality) AS n FROM labels WHERE quality IS NOT NULL)
SELECT patient_id, label, CASE WHEN k <= round_even(n * 0.2::DOUBLE, 0) THEN 'validation' ELSE 'train' END AS fold FROM r"""


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment")
    return status.stratified_sample(rows, ["c_mktsegment"], 63, 5, 2026, "c_custkey")


SAMPLE_SQL = """WITH r AS (SELECT c_custkey, c_mktsegment, ('0x' || substr(md5('2026|' || c_custkey), 1, 8))::BIGINT AS h FROM customer),
k AS (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY h, c_custkey) AS k FROM r)
SELECT c_custkey, c_mktsegment FROM k ORDER BY (k > 13)::INT, h, c_custkey LIMIT 63"""


def first_patients(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 patients of each cohort: a report's limit."""
    return status.first_per_cohort(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment"), "c_mktsegment", "c_custkey", 20)


QUERIES = {
    "anchor_linkage": anchor_linkage, "exam_date_union": exam_date_union, "expected_vs_actual_phases": expected_vs_actual_phases, "anchor_phase_status": anchor_phase_status,
    "missing_extra_timepoints": missing_extra_timepoints, "duplicate_across_exams": duplicate_across_exams, "risk_status": risk_status, "reference_exam": reference_exam,
    "view_match_rollup": view_match_rollup, "review_queue": review_queue, "visual_rollup": visual_rollup, "mismatch_patients": mismatch_patients, "staged_pairs": staged_pairs,
    "root_status": root_status, "work_list": work_list, "series_summary": series_summary, "best_series_per_exam": best_series_per_exam, "family_group_scores": family_group_scores,
    "family_group_selection": family_group_selection, "scored_selection": scored_selection, "rule_and_terms": rule_and_terms, "ordered_series": ordered_series,
    "manifest_status": manifest_status, "eligible_rows": eligible_rows, "train_val_split": train_val_split, "stratified_sample": stratified_sample, "first_patients": first_patients,
}
ORACLE_SQL = {
    "anchor_linkage": ANCHOR_SQL, "exam_date_union": DATES_SQL, "expected_vs_actual_phases": EXPECTED_SQL, "anchor_phase_status": ANCHOR_STATUS_SQL,
    "missing_extra_timepoints": TIMEPOINTS_SQL, "duplicate_across_exams": DUPLICATES_SQL, "risk_status": RISK_SQL,
    "reference_exam": f"WITH {_REFERENCE_SQL} SELECT patient_id, exam, reference, reference_rule, is_reference FROM refd",
    "view_match_rollup": VIEW_SQL, "review_queue": REVIEW_SQL, "visual_rollup": ROLLUP_SQL, "mismatch_patients": MISMATCH_SQL, "staged_pairs": STAGED_SQL,
    "root_status": ROOT_SQL, "work_list": WORK_SQL, "series_summary": SUMMARY_SQL, "best_series_per_exam": BEST_SQL, "family_group_scores": GROUP_SCORES_SQL,
    "family_group_selection": SELECTION_SQL, "scored_selection": SCORED_SQL, "rule_and_terms": RULE_SQL, "ordered_series": ORDERED_SQL,
    "manifest_status": MANIFEST_STATUS_SQL, "eligible_rows": ELIGIBLE_SQL, "train_val_split": TRAIN_VAL_SQL, "stratified_sample": SAMPLE_SQL,
    "first_patients": "SELECT c_custkey, c_mktsegment FROM (SELECT *, row_number() OVER (PARTITION BY c_mktsegment ORDER BY c_custkey) AS r FROM customer) WHERE r <= 20",
}
