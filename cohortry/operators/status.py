"""Status columns: rule cascades (the first failing rule wins) and issue lists (all failing rules, sorted)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import issues, parse_bool
from .ranking import numbered_within, seeded


def cascade(*rules: tuple[Column, str], otherwise: str) -> Column:
    """The name of the first rule that holds; null verdicts do not."""
    out = F.when(rules[0][0], rules[0][1])
    for rule, name in rules[1:]:
        out = out.when(rule, name)
    return out.otherwise(otherwise)


def eligible(df: DataFrame, label: str = "label", split: str = "split", flag: str | None = None) -> DataFrame:
    """Rows with a label, a train or test split and, if named, a true usable flag."""
    rows = df.where(F.col(label).isNotNull() & F.col(split).isin("train", "test"))
    return rows.where(parse_bool(F.col(flag))) if flag else rows


def geometry_status(missing: Column, header_error: Column, same_shape: Column, same_affine: Column) -> Column:
    return cascade((missing, "missing_phase"), (header_error, "header_error"), (~same_shape, "shape_mismatch"), (~same_affine, "affine_mismatch"), otherwise="matched")


def benchmark_status(label: Column, split: Column, phases: Column, geometry: Column) -> Column:
    return cascade(
        (label.isNull(), "missing_label"), (split.isNull() | ~split.isin("train", "test"), "missing_split"),
        (F.coalesce(phases, F.lit(0)) < 1, "missing_phase0"), (geometry != "matched", "phase_geometry_mismatch"), otherwise="usable",
    )


def manifest_verdict(label: Column, split: Column, missing_roles: Column, header_error: Column, geometry: Column, roi: Column, roi_ok: str = "expert_mask_roi") -> Column:
    """struct of the manifest's ``benchmark_status`` (the first failing rule) and what it allows: ``usable_whole_volume``,
    ``usable_multiphase``, ``usable_expert_roi`` and ``subtraction_available``. ``missing_roles`` and ``header_error`` are verdicts; null ones do not hold."""
    found = F.when(label.isNull(), "missing_pcr_label").when(split.isNull(), "missing_split").when(missing_roles, "missing_required_phase").when(header_error, "phase_header_error")
    found = found.when(geometry != "matched", F.concat(F.lit("phase_geometry_"), geometry)).otherwise("usable")
    whole = found == "usable"
    multi = whole & F.coalesce(geometry == "matched", F.lit(False))
    return F.struct(
        found.alias("benchmark_status"), whole.alias("usable_whole_volume"), multi.alias("usable_multiphase"),
        (multi & F.coalesce(roi == roi_ok, F.lit(False))).alias("usable_expert_roi"), multi.alias("subtraction_available"),
    )


def timepoint_match(is_anchor: Column) -> Column:
    """How a compared exam was matched: by the acquisition date, or as another timepoint; unknown is another one."""
    return F.when(parse_bool(is_anchor), "acquisition_date").otherwise("other_timepoint")


def volume_gate(predicted: Column, reference: Column, low: float = 0.2, high: float = 5.0, least_ml: float = 0.05) -> Column:
    """struct(gate, ratio): empty (ratio 0) and too small (null) come before a missing reference (null)."""
    ratio = predicted / F.nullif(reference, F.lit(0.0))
    of = lambda name, value: F.struct(F.lit(name).alias("gate"), value.cast("double").alias("ratio"))
    none = F.lit(None)
    return (
        F.when(predicted.isNull() | (predicted <= 0), of("empty_prediction", F.lit(0.0))).when(predicted < least_ml, of("too_small", none))
        .when(ratio.isNull(), of("missing_reference", none)).when(ratio < low, of("ratio_low", ratio)).when(ratio > high, of("ratio_high", ratio))
        .otherwise(of("pass", ratio))
    )


def roi_status(image: Column, mask: Column, voxels: Column, same_shape: Column, same_affine: Column) -> Column:
    return cascade(
        (~image, "missing_image"), (~mask, "missing_mask"), (F.coalesce(voxels, F.lit(0)) == 0, "empty_mask"),
        (~same_shape, "mask_image_shape_mismatch"), (~same_affine, "mask_image_affine_mismatch"), otherwise="usable",
    )


#: What a fallback to the whole image may replace.
FALLBACK = ["missing_mask", "empty_mask", "mask_image_shape_mismatch", "mask_image_affine_mismatch", "mask_read_or_geometry_error"]


def with_fallback(status: Column) -> Column:
    """struct(status, reason): ``whole_image_fallback`` and why, where that is allowed."""
    may = status.isin(FALLBACK)
    return F.struct(F.when(may, "whole_image_fallback").otherwise(status).alias("status"), F.when(may, status).otherwise("").alias("reason"))


def segmentation_case(prediction: Column, label: Column, same_shape: Column) -> Column:
    return cascade((~prediction, "missing_prediction"), (~label, "missing_label"), (~same_shape, "shape_mismatch"), otherwise="ok")


def comparison_note(readable: Column, pair: Column, prediction: Column, mask: Column, same_grid: Column) -> Column:
    return cascade((~readable, "unreadable"), (~pair, "missing_pair"), (~prediction, "missing_prediction"), (~mask, "missing_mask"), (~same_grid, "grids_differ"), otherwise="")


def anchor_comparison(reconstructed: Column, curated: Column, same_shape: Column, same_content: Column) -> Column:
    return cascade(
        (~reconstructed & ~curated, "missing_both"), (~reconstructed, "missing_reconstructed"), (~curated, "missing_curated"),
        (~same_shape, "shape_mismatch"), (~same_content, "content_differs"), otherwise="match",
    )


def visual_review(
    is_reference: Column, load_error: Column, reference_error: Column, header_view_matches: Column,
    fov: Column, spacing: Column, score: Column, projection: Column, volume: Column, limits: tuple = (0.35, 0.75, 0.25, 0.20, 0.05),
) -> Column:
    """struct(status, reason): ``reference_exam``, ``ok`` or ``review_recommended`` with all issues; NaN counts as unknown."""
    fov, spacing, score, projection, volume = (F.nanvl(c, F.lit(None).cast("double")) for c in (fov, spacing, score, projection, volume))
    low = (score < limits[2]) & F.coalesce(projection < limits[3], F.lit(True)) & F.coalesce(volume < limits[4], F.lit(True))
    found = issues(
        (load_error, "volume_load_error"), (reference_error, "reference_load_error"), (~header_view_matches, "nifti_header_view_mismatch"),
        (fov > limits[0], "fov_difference"), (spacing > limits[1], "spacing_difference"), (low, "low_visual_similarity"), none="",
    )
    of = lambda s, r: F.struct((F.lit(s) if isinstance(s, str) else s).alias("status"), (F.lit(r) if isinstance(r, str) else r).alias("reason"))
    return F.when(is_reference, of("reference_exam", "")).otherwise(of(F.when(found == "", "ok").otherwise("review_recommended"), found))


def view_contrast_status(series: Column, header_view: Column, view_anchor: Column, view_curated: Column, contrast: Column, contrast_anchor: Column) -> Column:
    """All issues of an exam's views and contrast: ``series`` is their number, ``contrast`` of ``text.exam_contrast``, the rest
    are verdicts (null: unknown)."""
    return issues(
        (F.coalesce(series, F.lit(0)) == 0, "no_selected_source_series"), (~header_view, "nifti_header_view_mismatch_vs_anchor"), (~view_anchor, "view_mismatch_vs_anchor"),
        (~view_curated, "view_mismatch_vs_curated"), (F.contains(contrast, F.lit("unknown")), "contrast_unknown"), (contrast.startswith("mixed:"), "mixed_contrast_selected_series"),
        (~contrast_anchor, "contrast_mismatch_vs_anchor"),
    )


def role_filter(rows: DataFrame, role: str, anchor: str = "is_anchor") -> DataFrame:
    """``all``, ``anchor`` or ``extra`` exams."""
    return rows if role == "all" else rows.where(F.col(anchor) if role == "anchor" else ~F.col(anchor))


def whole_crop(shape: Column) -> Column:
    """struct(start, end, center) of a crop that is the whole image."""
    return F.struct(
        F.transform(shape, lambda n: F.lit(0)).alias("start"), shape.alias("end"), F.transform(shape, lambda n: (n - 1) / 2).alias("center")
    )


def numeric_columns(df: DataFrame, columns: list[str], share: float = 0.9) -> list[str]:
    """Columns of which at least ``share`` of the known values are numbers, in one pass."""
    parts = df.agg(*[F.avg(F.when(F.col(c).isNotNull(), F.col(c).cast("string").try_cast("double").isNotNull().cast("double"))).alias(c) for c in columns]).first()
    return [c for c in columns if parts[c] is not None and parts[c] >= share]


def usable_columns(train: DataFrame, allowed: list[str]) -> list[str]:
    """Allowed columns that exist and are not all null in the training rows."""
    there = [c for c in allowed if c in train.columns]
    counts = train.agg(*[F.count(c).alias(c) for c in there]).first() if there else {}
    return [c for c in there if counts[c]]


def first_per_cohort(df: DataFrame, cohort: str, order: str, n: int) -> DataFrame:
    """The first ``n`` rows of each cohort: a report's limit."""
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(cohort).orderBy(order))).where(F.col("__r") <= n).drop("__r")


def stratified_split(train: DataFrame, fraction: float, seed: int, key: str = "patient_id", label: str = "label") -> DataFrame:
    """``fold``: ``validation`` for round(fraction * n) rows of each label in the order of a seeded hash, else ``train``."""
    size = train.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    ranked = numbered_within(train, [label], seeded(seed, key), key, "__place")
    joined = ranked.join(size, F.col(label).eqNullSafe(F.col("__l")))
    return joined.withColumn("fold", F.when(F.col("__place") <= F.rint(F.col("__n") * fraction), "validation").otherwise("train")).drop("__place", "__n", "__l")


def stratified_sample(df: DataFrame, strata: list[str], n: int, n_strata: int, seed: int, key: str) -> DataFrame:
    """``n`` rows: ceil(n / strata) of each stratum by a seeded hash, topped up and cut in the same order."""
    share = -(-n // n_strata)
    ranked = numbered_within(df.withColumn("__h", seeded(seed, key)), strata, F.col("__h"), key, "__r")
    return ranked.withColumn("__late", (F.col("__r") > share).cast("int")).orderBy("__late", "__h", key).limit(n).drop("__h", "__r", "__late")
