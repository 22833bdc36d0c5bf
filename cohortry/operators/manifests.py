"""Phase, exam and patient manifests, and the release built from them.

Phase rows carry ``patient_id``, ``exam_date`` (text), ``phase_index`` and ``size``. Grouping by (patient, exam) and
then by patient keeps one hash partitioning by patient useful for both; lists are collected with their order key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from . import quantiles


def exam_manifest(phases: DataFrame, date: Column | None = None) -> DataFrame:
    """One row an exam: phase count and list, contiguity, bytes, and ``timepoint_index`` by parsed date, unparsable last."""
    exams = phases.groupBy("patient_id", "exam_date").agg(
        F.count(F.lit(1)).alias("num_phases"), F.array_sort(F.collect_list("phase_index")).alias("phase_indices"), F.sum("size").alias("bytes")
    )
    parsed = date if date is not None else text.iso_date(F.col("exam_date"))
    order = Window.partitionBy("patient_id").orderBy(F.asc_nulls_last(parsed), "exam_date")
    return exams.select(
        "*",
        text.release_contiguity(F.col("phase_indices")).alias("phase_status"),
        F.array_contains("phase_indices", 0).alias("has_phase0"),
        F.array_min("phase_indices").alias("first_phase"), F.array_max("phase_indices").alias("last_phase"),
        (F.row_number().over(order) - 1).cast("int").alias("timepoint_index"),
    )


def patient_manifest(exams: DataFrame) -> DataFrame:
    """One row a patient: exam and file counts, least and most phases, dates and counts in order of time."""
    listed = F.array_sort(F.collect_list(F.struct("timepoint_index", "exam_date", "num_phases")))
    return exams.groupBy("patient_id").agg(
        F.count(F.lit(1)).alias("num_exams"), F.greatest(F.count(F.lit(1)) - 1, F.lit(0)).alias("num_extra_exams"),
        F.sum("num_phases").alias("num_phase_files"), F.min("num_phases").alias("min_phases"), F.max("num_phases").alias("max_phases"),
        F.sum("bytes").alias("bytes"), listed.alias("listed"),
    ).select("*", F.col("listed.exam_date").alias("exam_dates"), F.col("listed.num_phases").alias("phase_counts")).drop("listed")


def role_columns(phases: DataFrame, value: str, roles: tuple[int, ...] = (0, 1, 2)) -> DataFrame:
    """``phase0``, ``phase1``, ... and ``last_phase``: the value at those indices."""
    own = [F.max(F.when(F.col("phase_index") == k, F.col(value))).alias(f"phase{k}") for k in roles]
    return phases.groupBy("patient_id", "exam_date").agg(*own, F.max_by(value, "phase_index").alias("last_phase"))


def quarantine_summary(flagged: DataFrame) -> DataFrame:
    """One row a patient: distinct cases, dates and issues as sorted text, and the count of dates."""
    return flagged.groupBy("patient_id").agg(
        text.joined_set(F.col("case")).alias("quarantine_cases"), text.joined_set(F.col("exam_date")).alias("flagged_dates"),
        text.joined_set(F.col("issue")).alias("issues"), F.count_distinct("exam_date").alias("num_flagged_dates"),
    )


def release_status(clinical: DataFrame, patients: DataFrame, quarantine: DataFrame, sources: list[str]) -> DataFrame:
    """``clinical`` with ``release_status`` and ``include_in_release``, and looked-up columns of both sides."""
    active = patients.withColumn("__active", F.lit(True))
    held = quarantine.withColumn("__held", F.lit(True))
    joined = clinical.join(active, "patient_id", "left").join(held, "patient_id", "left")
    a, q = F.col("__active").isNotNull(), F.col("__held").isNotNull()
    status = (
        F.when(a & q, "active_and_quarantined").when(a, "active").when(q, "quarantined")
        .when(F.col("dataset").isin(sources), "no_active_volume").otherwise("not_a_source_dataset")
    )
    return joined.withColumn("release_status", status).withColumn("include_in_release", F.col("release_status") == "active").drop("__active", "__held")


def merge_audit(exams: DataFrame, audit: DataFrame, wanted: list[str], order: str, keys: tuple[str, ...] = ("patient_id", "exam_date")) -> DataFrame:
    """Exams with the wanted audit columns that exist; of several audit rows of a key the first by ``order`` counts."""
    first = Window.partitionBy(*keys).orderBy(order)
    columns = [c for c in wanted if c in audit.columns]
    unique = audit.withColumn("__r", F.row_number().over(first)).where("__r = 1").select(*keys, *columns)
    return exams.join(unique, list(keys), "left")


def merge_summary(patients: DataFrame, summary: DataFrame, prefix: str) -> DataFrame:
    """Patients with a summary's columns under a prefix."""
    return patients.join(summary.select("patient_id", *[F.col(c).alias(prefix + c) for c in summary.columns if c != "patient_id"]), "patient_id", "left")


def join_with_suffix(left: DataFrame, right: DataFrame, key: str, suffix: str) -> DataFrame:
    """Left join; columns of ``right`` that clash get ``suffix``."""
    clash = set(left.columns)
    return left.join(right.select(key, *[F.col(c).alias(c + suffix if c in clash else c) for c in right.columns if c != key]), key, "left")


def cohort_counts(patients: DataFrame, exams: DataFrame, phases: DataFrame, cohort: str = "dataset") -> DataFrame:
    """Rows of each grain for each cohort, and in total (cohort ``all``)."""
    out = None
    for grain, rows in (("patients", patients), ("exams", exams), ("phases", phases)):
        counts = rows.rollup(cohort).agg(F.count(F.lit(1)).alias("n"), F.grouping(cohort).alias("g"))
        counts = counts.select(F.lit(grain).alias("grain"), F.when(F.col("g") == 1, "all").otherwise(F.coalesce(cohort, F.lit("missing"))).alias("cohort"), "n")
        out = counts if out is None else out.unionByName(counts)
    return out


def value_counts(df: DataFrame, *columns: str) -> DataFrame:
    """Tidy ``section``, ``key``, ``n``; null and blank count as ``missing``."""
    pairs = F.array(*[F.struct(F.lit(c).alias("section"), F.coalesce(F.nullif(F.trim(F.col(c).cast("string")), F.lit("")), F.lit("missing")).alias("key")) for c in columns])
    return df.select(F.explode(pairs).alias("p")).groupBy("p.section", "p.key").agg(F.count(F.lit(1)).alias("n"))


def count_distribution(rows: DataFrame, key: str) -> DataFrame:
    """How many keys have k rows: ``rows_per_key``, ``keys``."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias("rows_per_key")).groupBy("rows_per_key").agg(F.count(F.lit(1)).alias("keys"))


def split_long_form(wide: DataFrame, columns: tuple[str, ...] = ("train_split", "test_split")) -> DataFrame:
    """``patient_id``, ``split``; an id in several columns belongs to the first of them."""
    long = wide.select(F.explode(F.array(*[F.struct(F.col(c).alias("patient_id"), F.lit(k).alias("k")) for k, c in enumerate(columns)])).alias("p"))
    first = long.select("p.*").where("patient_id is not null").groupBy("patient_id").agg(F.min("k").alias("k"))
    names = F.array(*[F.lit(c.removesuffix("_split")) for c in columns])
    return first.select("patient_id", names[F.col("k")].alias("split"))


def public_table(df: DataFrame, internal: list[str], groups: dict[str, list[str]]) -> DataFrame:
    """``df`` without internal columns; the column groups must name every public column exactly once."""
    public = [c for c in df.columns if c not in internal]
    named = [c for group in groups.values() for c in group]
    wrong = {"twice": sorted({c for c in named if named.count(c) > 1}), "missing": sorted(set(public) - set(named)), "extra": sorted(set(named) - set(public))}
    if any(wrong.values()):
        raise ValueError(f"column groups do not cover the public columns: {wrong}")
    return df.select(*public)


def replace_rows(report: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("patient_id", "exam_date")) -> DataFrame:
    """``report`` where all rows of a key that ``new`` has are replaced by the new ones."""
    return report.join(new.select(*keys).distinct(), list(keys), "left_anti").unionByName(new, allowMissingColumns=True)


def numeric_summary(df: DataFrame, columns: list[str], keys: list[str] | None = None, small: int = quantiles.SMALL) -> DataFrame:
    """Exact min, median and max of each column, one row a column; NaN counts as missing. A column of any length is narrowed down, not gathered."""
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in columns])
    long = df.select(*(keys or []), F.explode(values).alias("p")).select(*(keys or []), "p.*")
    found = quantiles.exact_quantiles(long, [*(keys or []), "column"], [0.5], value="v", small=small)
    return found.select(*(keys or []), "column", "low", F.col("quantiles")[0].alias("median"), "high", F.col("n").alias("known"))
