"""Longitudinal release: manifests of three grains, statuses, quarantine, counts, corrections.

Customers stand for patients (market segment: cohort), orders for exams, line items for phase files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import dq, manifests
from .common import r6, table

SOURCES = ["BUILDING", "MACHINERY"]


def phase_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row a phase file: index from 0, exam named by its date and order."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderdate")
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_extendedprice")
    joined = lines.join(orders, lines["l_orderkey"] == orders["o_orderkey"])
    return joined.select(
        F.col("o_custkey").alias("patient_id"), F.concat_ws("#", F.date_format("o_orderdate", "MM-dd-yyyy"), F.col("o_orderkey").cast("string")).alias("exam_date"),
        F.to_date("o_orderdate").alias("day"), F.col("o_orderkey").alias("exam"), (F.col("l_linenumber") - 1).alias("phase_index"), F.floor("l_extendedprice").cast("long").alias("size"),
    )


PHASES_SQL = """WITH phases AS (
  SELECT o_custkey AS patient_id, strftime(o_orderdate, '%m-%d-%Y') || '#' || o_orderkey AS exam_date, o_orderdate::DATE AS day, o_orderkey AS exam,
         l_linenumber - 1 AS phase_index, floor(l_extendedprice)::BIGINT AS size
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
), exam0 AS (
  SELECT patient_id, exam_date, count(*) AS num_phases, list_sort(list(phase_index)) AS idx, sum(size)::BIGINT AS bytes FROM phases GROUP BY ALL
), exams AS (
  SELECT *, CASE WHEN idx = range(len(idx)) THEN 'contiguous_from_zero' ELSE 'non_contiguous_or_not_zero' END AS phase_status,
         list_contains(idx, 0) AS has_phase0, idx[1]::INTEGER AS first_phase, idx[-1]::INTEGER AS last_phase,
         (row_number() OVER (PARTITION BY patient_id ORDER BY strptime(split_part(exam_date, '#', 1), '%m-%d-%Y'), exam_date) - 1)::INTEGER AS timepoint_index
  FROM exam0
)"""


def _exams(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.exam_manifest(phase_rows(spark, sf_dir), text.iso_date(F.split("exam_date", "#")[0]))


def phase_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = phase_rows(spark, sf_dir)
    path = F.concat_ws("/", F.lit("cohort"), F.col("patient_id").cast("string"), F.col("exam_date"), F.concat(F.lit("volume_phase"), F.col("phase_index").cast("string"), F.lit(".nii.gz")))
    return rows.select(path.alias("path"), text.path_parts(path).alias("p"), "size").select("path", "p.patient", "p.exam", "p.phase", "size")


PHASE_MANIFEST_SQL = f"""{PHASES_SQL} SELECT 'cohort/' || patient_id || '/' || exam_date || '/volume_phase' || phase_index || '.nii.gz' AS path,
  patient_id::VARCHAR AS patient, exam_date AS exam, phase_index AS phase, size FROM phases"""


def exam_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _exams(spark, sf_dir).withColumn("phase_indices", F.array_join(F.col("phase_indices").cast("array<string>"), ";"))


EXAM_SQL = f"""{PHASES_SQL} SELECT patient_id, exam_date, num_phases, array_to_string(idx, ';') AS phase_indices, bytes, phase_status, has_phase0,
  first_phase, last_phase, timepoint_index FROM exams"""


def patient_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifests.patient_manifest(_exams(spark, sf_dir))
    return found.withColumns({"exam_dates": F.array_join("exam_dates", ";"), "phase_counts": F.array_join(F.col("phase_counts").cast("array<string>"), ";")})


PATIENT_SQL = f"""{PHASES_SQL} SELECT patient_id, count(*) AS num_exams, greatest(count(*) - 1, 0) AS num_extra_exams, sum(num_phases)::BIGINT AS num_phase_files,
  min(num_phases) AS min_phases, max(num_phases) AS max_phases, sum(bytes)::BIGINT AS bytes,
  string_agg(exam_date, ';' ORDER BY timepoint_index) AS exam_dates, string_agg(num_phases::VARCHAR, ';' ORDER BY timepoint_index) AS phase_counts
FROM exams GROUP BY patient_id"""


def role_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.role_columns(phase_rows(spark, sf_dir).groupBy("patient_id", "exam_date", "phase_index").agg(F.max("size").alias("size")), "size")


ROLE_SQL = f"""{PHASES_SQL}, one AS (SELECT patient_id, exam_date, phase_index, max(size) AS size FROM phases GROUP BY ALL)
SELECT patient_id, exam_date, max(size) FILTER (phase_index = 0) AS phase0, max(size) FILTER (phase_index = 1) AS phase1, max(size) FILTER (phase_index = 2) AS phase2,
  arg_max(size, phase_index) AS last_phase FROM one GROUP BY patient_id, exam_date"""


def phase_status_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Both contiguity vocabularies, counted."""
    exams = phase_rows(spark, sf_dir).groupBy("exam").agg(F.collect_list("phase_index").alias("i"))
    return manifests.value_counts(exams.select(text.release_contiguity(F.col("i")).alias("release"), text.audit_contiguity(F.col("i")).alias("audit")), "release", "audit")


PHASE_STATUS_SQL = f"""{PHASES_SQL}, s AS (
  SELECT phase_status AS release, CASE WHEN idx = range(len(idx)) THEN 'contiguous_from_zero' WHEN idx[1] <> 0 THEN 'does_not_start_at_zero' ELSE 'non_contiguous' END AS audit FROM exams
) SELECT 'release' AS section, release AS key, count(*) AS n FROM s GROUP BY ALL UNION ALL SELECT 'audit', audit, count(*) FROM s GROUP BY ALL"""


def flagged_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams with a priority issue, by status as the case."""
    orders = table(spark, sf_dir, "orders").where("o_orderpriority like '1%'")
    return orders.select(
        F.col("o_custkey").alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("exam_date"),
        F.col("o_orderstatus").alias("case"), F.expr("case when o_orderkey % 2 = 0 then o_orderpriority else ' ' end").alias("issue"),
    )


FLAGGED_SQL = """flagged AS (
  SELECT o_custkey AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS exam_date, o_orderstatus AS "case", CASE WHEN o_orderkey % 2 = 0 THEN o_orderpriority ELSE ' ' END AS issue
  FROM orders WHERE o_orderpriority LIKE '1%'
), quarantine AS (
  SELECT patient_id, coalesce(string_agg(DISTINCT nullif(trim("case"), ''), ';' ORDER BY nullif(trim("case"), '')), '') AS quarantine_cases,
         string_agg(DISTINCT exam_date, ';' ORDER BY exam_date) AS flagged_dates,
         coalesce(string_agg(DISTINCT nullif(trim(issue), ''), ';' ORDER BY nullif(trim(issue), '')), '') AS issues, count(DISTINCT exam_date) AS num_flagged_dates
  FROM flagged GROUP BY patient_id
)"""


def quarantine_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.quarantine_summary(flagged_rows(spark, sf_dir))


QUARANTINE_SQL = f"WITH {FLAGGED_SQL} SELECT * FROM quarantine"


def _released(spark: SparkSession, sf_dir: str) -> DataFrame:
    clinical = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("patient_id"), F.col("c_mktsegment").alias("dataset"))
    patients = manifests.patient_manifest(_exams(spark, sf_dir).where("patient_id % 3 <> 0")).select("patient_id", "num_exams", "num_phase_files")
    held = manifests.quarantine_summary(flagged_rows(spark, sf_dir).where("patient_id % 5 = 0")).select("patient_id", "quarantine_cases", "num_flagged_dates")
    return manifests.release_status(clinical, patients, held, SOURCES)


def release_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _released(spark, sf_dir)


_RELEASED_SQL = f"""{PHASES_SQL}, {FLAGGED_SQL}, active AS (
  SELECT patient_id, count(*) AS num_exams, sum(num_phases)::BIGINT AS num_phase_files FROM exams WHERE patient_id % 3 <> 0 GROUP BY patient_id
), held AS (SELECT * FROM quarantine WHERE patient_id % 5 = 0), released AS (
  SELECT c_custkey AS patient_id, c_mktsegment AS dataset, num_exams, num_phase_files, quarantine_cases, num_flagged_dates,
    CASE WHEN a.patient_id IS NOT NULL AND h.patient_id IS NOT NULL THEN 'active_and_quarantined' WHEN a.patient_id IS NOT NULL THEN 'active'
         WHEN h.patient_id IS NOT NULL THEN 'quarantined' WHEN c_mktsegment IN ('BUILDING', 'MACHINERY') THEN 'no_active_volume' ELSE 'not_a_source_dataset' END AS release_status
  FROM customer LEFT JOIN active a ON c_custkey = a.patient_id LEFT JOIN held h ON c_custkey = h.patient_id
)"""
RELEASE_SQL = f"{_RELEASED_SQL} SELECT *, release_status = 'active' AS include_in_release FROM released"


def release_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients by status, and active patients, exams and phases by cohort with totals."""
    status = _released(spark, sf_dir)
    cohorts = status.where("include_in_release").select("patient_id", "dataset")
    phases = phase_rows(spark, sf_dir).join(cohorts, "patient_id")
    grains = manifests.cohort_counts(cohorts, phases.select("patient_id", "exam_date", "dataset").distinct(), phases)
    return grains.unionByName(status.groupBy(F.lit("status").alias("grain"), F.col("release_status").alias("cohort")).agg(F.count(F.lit(1)).alias("n")))


COUNTS_SQL = f"""{_RELEASED_SQL}, cohorts AS (SELECT patient_id, dataset FROM released WHERE release_status = 'active'),
p AS (SELECT * FROM phases JOIN cohorts USING (patient_id))
SELECT 'patients' AS grain, coalesce(dataset, 'all') AS cohort, count(*) AS n FROM cohorts GROUP BY ROLLUP (dataset)
UNION ALL SELECT 'exams', coalesce(dataset, 'all'), count(*) FROM (SELECT DISTINCT patient_id, exam_date, dataset FROM p) GROUP BY ROLLUP (dataset)
UNION ALL SELECT 'phases', coalesce(dataset, 'all'), count(*) FROM p GROUP BY ROLLUP (dataset)
UNION ALL SELECT 'status', release_status, count(*) FROM released GROUP BY release_status"""


def audit_and_qc_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exams with the first audit row of each day, and a patient summary under a prefix."""
    exams = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("exam_date"), "o_orderkey")
    audit = table(spark, sf_dir, "orders").where("o_orderkey % 3 <> 0").select(
        F.col("o_custkey").alias("patient_id"), F.to_date("o_orderdate").alias("exam_date"), F.col("o_orderkey").alias("place"), F.col("o_orderstatus").alias("risk_status"), F.col("o_orderpriority").alias("view")
    )
    merged = manifests.merge_audit(exams, audit, ["risk_status", "view", "not_there"], "place")
    summary = exams.groupBy("patient_id").agg(F.count(F.lit(1)).alias("exams"), F.max("o_orderkey").alias("last"))
    return manifests.merge_summary(merged, summary, "qc_").withColumn("exam_date", F.col("exam_date").cast("string"))


AUDIT_SQL = """
WITH exams AS (SELECT o_custkey AS patient_id, o_orderdate::DATE AS exam_date, o_orderkey FROM orders),
audit AS (SELECT o_custkey AS patient_id, o_orderdate::DATE AS exam_date, o_orderstatus AS risk_status, o_orderpriority AS view,
  row_number() OVER (PARTITION BY o_custkey, o_orderdate::DATE ORDER BY o_orderkey) AS r FROM orders WHERE o_orderkey % 3 <> 0),
summary AS (SELECT patient_id, count(*) AS qc_exams, max(o_orderkey) AS qc_last FROM exams GROUP BY patient_id)
SELECT e.patient_id, e.exam_date::VARCHAR AS exam_date, o_orderkey, risk_status, view, qc_exams, qc_last
FROM exams e LEFT JOIN (SELECT * FROM audit WHERE r = 1) a ON a.patient_id = e.patient_id AND a.exam_date = e.exam_date JOIN summary s ON s.patient_id = e.patient_id"""


def release_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Patients with exams that the clinical table lacks (here: the table without every tenth)."""
    clinical = table(spark, sf_dir, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("patient_id"))
    patients = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("patient_id")).distinct()
    return dq.not_contained(patients, clinical, ["patient_id"])


GATE_SQL = "SELECT DISTINCT o_custkey AS patient_id FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0)"


def public_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = {"identity": ["c_custkey", "c_name"], "cohort": ["c_mktsegment"]}
    return manifests.public_table(table(spark, sf_dir, "customer"), ["c_nationkey", "c_acctbal"], groups)


def exam_count_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifests.count_distribution(table(spark, sf_dir, "orders"), "o_custkey")


def split_long_form(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train and test columns of unequal length, some ids in both."""
    wide = table(spark, sf_dir, "customer").select(
        F.expr("case when c_custkey % 3 <> 0 then c_custkey end").alias("train_split"), F.expr("case when c_custkey % 4 = 0 then c_custkey end").alias("test_split")
    )
    return manifests.split_long_form(wide)


def report_replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The phases of every eleventh exam are replaced by one corrected phase."""
    rows = phase_rows(spark, sf_dir).select("patient_id", "exam_date", "phase_index", "size", F.lit("old").alias("state"))
    new = rows.where("phase_index = 0 and patient_id % 11 = 0").select("patient_id", "exam_date", "phase_index", (F.col("size") + 1).alias("size"), F.lit("new").alias("state"))
    return manifests.replace_rows(rows, new)


REPLACE_SQL = f"""{PHASES_SQL}, new AS (SELECT patient_id, exam_date, phase_index, size + 1 AS size FROM phases WHERE phase_index = 0 AND patient_id % 11 = 0)
SELECT patient_id, exam_date, phase_index, size, 'old' AS state FROM phases WHERE (patient_id, exam_date) NOT IN (SELECT (patient_id, exam_date) FROM new)
UNION ALL SELECT *, 'new' FROM new"""


def numeric_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = manifests.numeric_summary(table(spark, sf_dir, "lineitem"), ["l_quantity", "l_extendedprice", "l_tax"], ["l_returnflag"])
    return found.withColumns({c: r6(c) for c in ("low", "median", "high")})


NUMERIC_SQL = """SELECT l_returnflag, "column", round(min(v), 6) AS low, round(median(v), 6) AS median, round(max(v), 6) AS high, count(v) AS known FROM (
  SELECT l_returnflag, unnest(['l_quantity', 'l_extendedprice', 'l_tax']) AS "column", unnest([l_quantity, l_extendedprice, l_tax]) AS v FROM lineitem) GROUP BY ALL"""

QUERIES = {
    "phase_manifest": phase_manifest, "exam_manifest": exam_manifest, "patient_manifest": patient_manifest, "role_columns": role_columns,
    "phase_status_audit": phase_status_audit, "quarantine_summary": quarantine_summary, "release_status": release_status, "release_counts": release_counts,
    "audit_and_qc_merge": audit_and_qc_merge, "release_gate": release_gate, "public_table": public_table, "exam_count_distribution": exam_count_distribution,
    "split_long_form": split_long_form, "report_replace": report_replace, "numeric_summary": numeric_summary,
}
ORACLE_SQL = {
    "phase_manifest": PHASE_MANIFEST_SQL, "exam_manifest": EXAM_SQL, "patient_manifest": PATIENT_SQL, "role_columns": ROLE_SQL,
    "phase_status_audit": PHASE_STATUS_SQL, "quarantine_summary": QUARANTINE_SQL, "release_status": RELEASE_SQL, "release_counts": COUNTS_SQL,
    "audit_and_qc_merge": AUDIT_SQL, "release_gate": GATE_SQL, "public_table": "SELECT c_custkey, c_name, c_mktsegment FROM customer",
    "exam_count_distribution": "SELECT n AS rows_per_key, count(*) AS keys FROM (SELECT count(*) AS n FROM orders GROUP BY o_custkey) GROUP BY n",
    "split_long_form": "SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 3 <> 0 THEN 'train' ELSE 'test' END AS split FROM customer WHERE c_custkey % 3 <> 0 OR c_custkey % 4 = 0",
    "report_replace": REPLACE_SQL, "numeric_summary": NUMERIC_SQL,
}
