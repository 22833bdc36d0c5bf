"""Linkage and quality-control rollups over exams and phases."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import audit_contiguity, issues, joined_set


def link_anchor(clinical: DataFrame, series: DataFrame, uid: str = "series_uid") -> DataFrame:
    """Clinical rows with their anchor series; ``link_status`` tells which have none."""
    found = series.withColumn("__there", F.lit(True))
    joined = clinical.join(found, uid, "left")
    return joined.withColumn("link_status", F.when(F.col("__there").isNull(), "anchor_not_found").otherwise("linked")).drop("__there")


def exam_dates(*sources: tuple[str, DataFrame]) -> DataFrame:
    """Distinct (patient, date) of several tables and which of them have it: ``sources``, sorted."""
    out = None
    for name, df in sources:
        part = df.select("patient_id", "exam_date").distinct().withColumn("source", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("patient_id", "exam_date").agg(joined_set(F.col("source")).alias("sources"))


def phase_comparison(expected: DataFrame, actual: DataFrame, keys: list[str]) -> DataFrame:
    """For each exam: missing and unexpected phase indices, and whether counts and sizes agree."""
    e = expected.select(*keys, "phase_index", F.col("size").alias("want")).withColumn("e", F.lit(True))
    a = actual.select(*keys, "phase_index", F.col("size").alias("got")).withColumn("a", F.lit(True))
    both = e.join(a, [*keys, "phase_index"], "full")
    listed = lambda c: F.array_join(F.array_sort(F.collect_set(F.when(c, F.col("phase_index")))).cast("array<string>"), ";")
    return both.groupBy(*keys).agg(
        listed(F.col("a").isNull()).alias("missing"), listed(F.col("e").isNull()).alias("unexpected"),
        (F.count("e") == F.count("a")).alias("count_matches"),
        F.bool_and(F.col("want").eqNullSafe(F.col("got"))).alias("header_matches"),
    )


def date_sets(target: DataFrame, generated: DataFrame) -> DataFrame:
    """For each patient: dates only on one side and on both, as counts and lists."""
    both = target.select("patient_id", "exam_date").distinct().withColumn("t", F.lit(True)).join(
        generated.select("patient_id", "exam_date").distinct().withColumn("g", F.lit(True)), ["patient_id", "exam_date"], "full"
    )
    only = lambda c: joined_set(F.when(c, F.col("exam_date")))
    return both.groupBy("patient_id").agg(
        only(F.col("g").isNull()).alias("missing"), only(F.col("t").isNull()).alias("extra"), F.count_if(F.col("t") & F.col("g")).alias("shared")
    )


def duplicate_notes(phases: DataFrame, fingerprint: str) -> DataFrame:
    """Earlier exams of the patient with the same phase and content: ``earlier`` (joined by ``;``, empty if none)."""
    before = Window.partitionBy("patient_id", "phase_index", fingerprint).orderBy("exam_date").rowsBetween(Window.unboundedPreceding, -1)
    return phases.withColumn("earlier", F.array_join(F.collect_list("exam_date").over(before), ";"))


def phase_consistency(phases: DataFrame, keys: list[str], rtol: float = 1e-5, atol: float = 1e-5) -> DataFrame:
    """Per exam: ``indices``, ``n`` and whether all phases have the shape of the first, and its spacing and affine within tolerance.

    ``phases``: phase_index, shape (array), spacing and affine (arrays of doubles). Null geometry is unknown and agrees.
    """
    listed = F.array_sort(F.collect_list(F.struct("phase_index", "shape", "spacing", "affine"))).alias("p")
    near = lambda a, b: F.coalesce((F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda v: v), F.lit(True))
    first = F.col("p")[0]
    return phases.groupBy(*keys).agg(listed, F.count(F.lit(1)).alias("n")).select(
        *keys, F.transform("p", lambda x: x["phase_index"]).alias("indices"), "n",
        F.forall("p", lambda x: F.coalesce(x["shape"] == first["shape"], F.lit(True))).alias("shapes_consistent"),
        F.forall("p", lambda x: near(x["spacing"], first["spacing"])).alias("spacings_consistent"),
        F.forall("p", lambda x: near(x["affine"], first["affine"])).alias("affines_consistent"),
    )


def full_exam_risk(exams: DataFrame, consistency: DataFrame, keys: list[str]) -> DataFrame:
    """``risk_status`` by all rules. ``consistency``: of ``phase_consistency``; exams without phases have none.

    ``exams``: is_anchor, exists, quarantined (booleans), n_selected, n_expected (selected series and their phases),
    count_matches, header_matches (against the selected series; null: unknown), curated_phases, curated_view,
    planes (array), selection_note, duplicate_notes.
    """
    j = exams.join(consistency, keys, "left")
    order = F.when(F.col("indices").isNull(), "missing").otherwise(audit_contiguity(F.col("indices")))
    wrong = order != "contiguous_from_zero"
    note, copies = F.coalesce("selection_note", F.lit("")), F.coalesce("duplicate_notes", F.lit(""))
    has_plan, view = F.col("n_expected") > 0, F.coalesce("curated_view", F.lit(""))
    status = issues(
        (F.coalesce("n_selected", F.lit(0)) == 0, "no_selected_source_series"),
        (wrong, F.when(~F.col("exists") & F.col("quarantined"), "reconstruction_quarantined_not_active").otherwise(order)),
        (~F.col("shapes_consistent"), "shape_mismatch_between_reconstructed_phases"), (~F.col("spacings_consistent"), "spacing_mismatch_between_reconstructed_phases"),
        (~F.col("affines_consistent"), "affine_mismatch_between_reconstructed_phases"), (has_plan & ~F.col("count_matches"), "phase_count_mismatch_vs_selected_dicom"),
        (has_plan & ~F.col("header_matches"), "phase_header_mismatch_vs_selected_dicom"),
        (F.col("is_anchor") & F.col("exists") & (F.col("curated_phases") > 0) & (F.col("curated_phases") != F.coalesce("n", F.lit(0))), "anchor_phase_count_mismatch"),
        ((view != "") & (F.size("planes") > 0) & ~F.array_contains("planes", view), F.concat(F.lit("view_mismatch_vs_curated:"), view)),
        (note.startswith("no_family_match") | F.contains(note, F.lit("second_best_score")), "low_or_ambiguous_series_selection"),
        (F.contains(copies, F.lit("duplicates:")), "duplicate_reconstructed_volume"), (F.contains(copies, F.lit("fingerprint_error:")), "duplicate_check_error"),
    )
    return j.select(*keys, status.alias("risk_status"))


def mismatch_dates(exams: DataFrame, flags: dict[str, str], order: list[str], date: str = "exam_date", mark: str = "|") -> DataFrame:
    """For each patient and flag ``column -> name``: dates of exams known to fail it, in the order of the rows."""
    row = [F.col(c) for c in order]
    dates = lambda flag: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(~F.col(flag), F.struct(*row, F.col(date).alias("__date"))))), lambda x: x["__date"]), mark)
    return exams.groupBy("patient_id").agg(*[dates(flag).alias(name) for flag, name in flags.items()])


def patients_with(rollup: DataFrame, **kinds: Column) -> DataFrame:
    """``kind``, ``n``: how many patients of a rollup each condition holds for."""
    counts = rollup.agg(*[F.count_if(c).alias(k) for k, c in kinds.items()])
    return counts.unpivot([], list(kinds), "kind", "n")


def reference_exam(exams: DataFrame, anchor: str = "is_anchor", date: str = "exam_date", order: str = "exam") -> DataFrame:
    """Each exam with its patient's reference: the first anchor, else the earliest date (unknown ones last)."""
    best = Window.partitionBy("patient_id").orderBy(F.desc(anchor), F.asc_nulls_last(date), order)
    ref = exams.withColumn("r", F.row_number().over(best)).where("r = 1")
    ref = ref.select("patient_id", F.col(order).alias("reference"), F.when(F.col(anchor), "anchor").otherwise("earliest").alias("reference_rule"))
    joined = exams.join(ref, "patient_id")
    return joined.withColumn("is_reference", F.col(order) == F.col("reference"))


def match_rollup(exams: DataFrame, flags: list[str], status: str = "status") -> DataFrame:
    """For each patient: exams, distinct statuses, and for each flag whether no exam is known to fail."""
    every = [F.bool_and(F.coalesce(F.col(f), F.lit(True))).alias(f"all_{f}") for f in flags]
    return exams.groupBy("patient_id").agg(F.count(F.lit(1)).alias("exams"), joined_set(F.col(status), "|").alias("statuses"), *every)


def visual_rollup(exams: DataFrame) -> DataFrame:
    """Worst values of a patient's non-reference exams; 1 and 0 where there is none."""
    other = ~F.col("is_reference")
    worst = lambda f, c, default: F.when(F.count_if(other) == 0, F.lit(default)).otherwise(f(F.when(other, F.col(c))))
    return exams.groupBy("patient_id").agg(
        worst(F.min, "score", 1.0).alias("min_score"), worst(F.max, "fov_diff", 0.0).alias("max_fov_diff"), F.count_if(other & (F.col("status") != "ok")).alias("review_exams")
    )


def review_queue(exams: DataFrame) -> DataFrame:
    """Exams to look at, by score (unknown first), patient and date, with their ``place`` among the patient's."""
    rows = exams.where(~F.col("is_reference") & (F.col("status") != "ok"))
    order = Window.partitionBy("patient_id").orderBy(F.coalesce("score", F.lit(-1.0)), "exam_date", "exam")
    return rows.withColumn("place", F.row_number().over(order))


def staged_pairs(staged: DataFrame, curated: DataFrame, masks: DataFrame) -> DataFrame:
    """Each staged phase with its curated counterpart and mask, each left-joined; ``pair_status`` tells what is missing."""
    keys = ["patient_id", "phase_index"]
    joined = staged.join(curated.withColumn("c", F.lit(True)), keys, "left").join(masks.withColumn("m", F.lit(True)), keys, "left")
    status = F.when(F.col("c").isNull(), "missing_curated").when(F.col("m").isNull(), "missing_mask").otherwise("paired")
    return joined.withColumn("pair_status", status).drop("c", "m")


def root_status(active: DataFrame, quarantined: DataFrame) -> DataFrame:
    """(patient, date): in the active root, in quarantine, or both; of several quarantine paths the first counts."""
    q = quarantined.groupBy("patient_id", "exam_date").agg(F.min("path").alias("quarantine_path"))
    both = active.select("patient_id", "exam_date").distinct().withColumn("a", F.lit(True)).join(q.withColumn("q", F.lit(True)), ["patient_id", "exam_date"], "full")
    status = F.when(F.col("a") & F.col("q"), "both").when(F.col("a"), "active").otherwise("quarantined")
    return both.select("patient_id", "exam_date", status.alias("root_status"), "quarantine_path")


def work_list(missing: DataFrame, workbook: DataFrame, anchors: DataFrame, groups: DataFrame) -> DataFrame:
    """Missing dates with the first reason to skip each, or ``process``."""
    joined = (
        missing.join(workbook.select("patient_id").distinct().withColumn("w", F.lit(True)), "patient_id", "left")
        .join(anchors.select("patient_id").distinct().withColumn("n", F.lit(True)), "patient_id", "left")
        .join(groups.select("patient_id", "exam_date").distinct().withColumn("g", F.lit(True)), ["patient_id", "exam_date"], "left")
    )
    reason = F.when(F.col("w").isNull(), "not_in_workbook").when(F.col("n").isNull(), "no_anchor").when(F.col("g").isNull(), "no_exam_group").otherwise("process")
    return joined.withColumn("action", reason).drop("w", "n", "g")


def series_summary(rows: DataFrame, keys: list[str], order: str, listed: list[str], counted: list[str]) -> DataFrame:
    """Per exam: number of series, ordered joined texts, and distinct counts."""
    collected = F.array_sort(F.collect_list(F.struct(order, *listed)))
    out = rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_series"), collected.alias("l"), *[F.count_distinct(c).alias(f"n_{c}") for c in counted])
    return out.select(*keys, "n_series", *[F.array_join(F.col(f"l.{c}"), " | ").alias(f"{c}_list") for c in listed], *[f"n_{c}" for c in counted])
