import math

import pytest
from pyspark.sql import functions as F

from cohortry.functions import text
from cohortry.operators import qc, selection, status, voxels

PHASE = "exam int, phase_index int, shape array<int>, spacing array<double>, affine array<double>"
EXAM = (
    "exam int, is_anchor boolean, exists boolean, quarantined boolean, n_selected int, n_expected int, count_matches boolean, header_matches boolean, "
    "curated_phases int, curated_view string, planes array<string>, selection_note string, duplicate_notes string"
)


def phase(exam, k, shape=(2, 2, 2), spacing=(1.0, 1.0), affine=(1.0, 0.0)):
    return exam, k, list(shape), list(spacing), list(affine)


def exam(k, **more):
    row = {"exam": k, "is_anchor": True, "exists": True, "quarantined": False, "n_selected": 1, "n_expected": 2, "count_matches": True, "header_matches": True, "curated_phases": 2}
    row |= {"curated_view": "axial", "planes": ["axial"], "selection_note": "selected", "duplicate_notes": ""} | more
    return tuple(row.values())


def test_exam_risk_by_every_rule(spark):
    fine = [phase(k, j) for k in range(20) for j in (0, 1)]
    changed = {
        1: [phase(1, 0), phase(1, 1, shape=(3, 2, 2))], 2: [phase(2, 0), phase(2, 1, spacing=(1.0, 1.1))], 3: [phase(3, 0), phase(3, 1, affine=(1.0, 1e-3))],
        4: [phase(4, 1), phase(4, 2)], 5: [], 6: [phase(6, 0), phase(6, 2)], 7: [phase(7, 0), phase(7, 1, spacing=(1.0, 1.0 + 1e-7))],
    }
    rows = [p for p in fine if p[0] not in changed] + [p for ps in changed.values() for p in ps]
    exams = {k: exam(k) for k in range(20)}
    exams[5] = exam(5, exists=False, quarantined=True)
    exams[8], exams[9] = exam(8, n_selected=0, n_expected=0, count_matches=False), exam(9, count_matches=False, header_matches=False)
    exams[10], exams[11] = exam(10, curated_phases=3), exam(11, planes=["coronal"])
    exams[12], exams[13] = exam(12, selection_note="no_family_match x"), exam(13, duplicate_notes="duplicates:3 fingerprint_error:x")
    exams[14], exams[15] = exam(14, header_matches=None, planes=[], curated_view=None), exam(15, is_anchor=False, curated_phases=9)
    consistency = qc.phase_consistency(spark.createDataFrame(rows, PHASE), ["exam"])
    got = {r["exam"]: r["risk_status"] for r in qc.full_exam_risk(spark.createDataFrame(list(exams.values()), EXAM), consistency, ["exam"]).collect()}
    between = "mismatch_between_reconstructed_phases"
    want = {
        1: f"shape_{between}", 2: f"spacing_{between}", 3: f"affine_{between}", 4: "does_not_start_at_zero", 5: "reconstruction_quarantined_not_active", 6: "non_contiguous",
        8: "no_selected_source_series", 9: "phase_count_mismatch_vs_selected_dicom|phase_header_mismatch_vs_selected_dicom", 10: "anchor_phase_count_mismatch",
        11: "view_mismatch_vs_curated:axial", 12: "low_or_ambiguous_series_selection", 13: "duplicate_check_error|duplicate_reconstructed_volume",
    }
    assert got == {k: want.get(k, "ok") for k in range(20)}


def test_view_contrast_and_visual_statuses(spark):
    df = spark.createDataFrame(
        [(1, 2, True, True, True, ["t1"], True), (2, 0, None, None, None, [], None), (3, 2, False, False, False, ["t1", "unknown"], False), (4, 1, True, None, True, ["unknown"], None)],
        "id int, n int, header boolean, anchor boolean, curated boolean, classes array<string>, contrast boolean",
    )
    found = status.view_contrast_status(F.col("n"), F.col("header"), F.col("anchor"), F.col("curated"), text.exam_contrast(F.col("classes")), F.col("contrast"))
    got = {r["id"]: r["s"] for r in df.select("id", found.alias("s")).collect()}
    every = "contrast_mismatch_vs_anchor|contrast_unknown|mixed_contrast_selected_series|nifti_header_view_mismatch_vs_anchor|view_mismatch_vs_anchor|view_mismatch_vs_curated"
    assert got == {1: "ok", 2: "no_selected_source_series", 3: every, 4: "contrast_unknown"}
    nan = math.nan
    rows = [(1, True, True, True, False, 9.0, 9.0, 0.0, 0.0, 0.0), (2, False, False, False, None, nan, None, nan, nan, nan), (3, False, True, True, False, 0.4, 0.8, 0.2, nan, None), (4, False, False, False, True, 0.1, 0.1, 0.2, 0.5, 0.0)]
    df = spark.createDataFrame(rows, "id int, ref boolean, e boolean, re boolean, v boolean, fov double, sp double, s double, m double, c double")
    got = {r["id"]: tuple(r["r"]) for r in df.select("id", status.visual_review(*[F.col(c) for c in ("ref", "e", "re", "v", "fov", "sp", "s", "m", "c")]).alias("r")).collect()}
    issues = "fov_difference|low_visual_similarity|nifti_header_view_mismatch|reference_load_error|spacing_difference|volume_load_error"
    assert got == {1: ("reference_exam", ""), 2: ("ok", ""), 3: ("review_recommended", issues), 4: ("ok", "")}


def test_texts_of_views_dimensions_and_reasons(spark):
    df = spark.createDataFrame([("Ax SAGITTAL t1", 500.0, 2.5), ("transverse", 3000.0, 90.0), ("coronal x", None, None)], "t string, tr double, te double")
    got = df.select(text.plane_by_stem(F.col("t")).alias("p"), text.contrast_class(F.col("t"), F.col("tr"), F.col("te"), values=True).alias("c")).collect()
    assert [r["p"] for r in got] == ["sagittal", "axial", "coronal"]
    assert [tuple(r["c"]) for r in got] == [("t1_like", "t1_keyword;short_tr_te:500/2.5"), ("t2_like", "long_te:90"), ("unknown", "no_t1_t2_clue")]
    nums = spark.createDataFrame([([0.78125, 0.78125, 2.0],), ([1234567.0, 1 / 3, 100.0],), ([1.0],)], "v array<double>")
    assert [r["d"] for r in nums.select(text.format_dims(F.col("v")).alias("d")).collect()] == ["0.78125x0.78125x2", "1234570x0.333333x100", None]
    pair = spark.createDataFrame([(["a"], ["a", "b"]), (["a", "c"], ["a"]), ([], ["a"])], "o array<string>, r array<string>")
    assert [r["w"] for r in pair.select(text.all_within(F.col("o"), F.col("r")).alias("w")).collect()] == [True, False, None]


def test_candidate_scores_by_factor(spark):
    schema = "id int, " + ", ".join(f"{p}{c}" for p in ("", "anchor_") for c in ("name string", "family string", "orientation string", "files int", "phases int", "rows int", "cols int", "spacing array<double>"))
    anchor = ("dyn a", "dyn", "axial", 100, 5, 256, 256, [1.0, 1.0])
    rows = [
        (1, *anchor, *anchor), (2, "dyn b", "dyn", "sagittal", 180, 6, 260, 250, [1.05, 1.0], *anchor), (3, "x", "y", None, 97, 9, 512, 512, [2.0, 2.0], *anchor),
        (4, None, None, None, None, None, None, None, None, *anchor), (5, "x", "y", "axial", 115, None, 256, None, None, *anchor),
    ]
    got = {r["id"]: (r["score"], r["reasons"]) for r in selection.candidate_score(spark.createDataFrame(rows, schema)).collect()}
    assert got[1] == (21.5, "exact_normalized_name;same_orientation;same_num_files;same_num_phases;same_matrix;same_spacing")
    assert got[2] == (4 - 4 - 2 + 0.5 + 1 + 0.5 + 0.5, "same_sequence_family;different_orientation;far_num_files;has_180_files;close_num_phases;close_matrix;close_spacing")
    assert got[3] == (3 - 1.5 - 1 - 1, "very_close_num_files;different_num_phases;different_matrix;different_spacing")
    assert got[4] == (0.0, "") and got[5] == (5.5, "same_orientation;close_num_files")


def test_audit_scores_and_rule_points(spark):
    schema = "id int, " + ", ".join(f"{p}{c}" for p in ("", "anchor_") for c in ("uid string", "key string", "tokens array<string>", "plane string", "images int", "shape array<int>", "spacing array<double>"))
    anchor = ("u", "k", ["a", "b"], "axial", 100, [2, 2], [1.0, 1.0])
    rows = [(1, *anchor, *anchor), (2, "v", "j", ["c"], "coronal", 200, [3, 3], [2.0, 1.0], *anchor), (3, "v", "k", [], "", None, None, None, *anchor)]
    got = {r["id"]: (r["audit_score"], r["audit_reasons"]) for r in selection.audit_score(spark.createDataFrame(rows, schema)).collect()}
    assert got[1][0] == pytest.approx(1 + 1 + 2 + 0.7 + 0.6 + 0.5 + 0.5) and "token_similarity:1.000" in got[1][1] and "same_plane:axial" in got[1][1]
    assert got[2] == (pytest.approx(-1.5), "different_plane:coronal;far_num_images;different_matrix;different_spacing") and got[3] == (1.0, "same_family_key")
    rules = spark.createDataFrame([("e", "voi_pair"), ("e", "analysis_mask"), ("f", "paired_segmentation"), ("f", "analysis_mask"), ("g", "none")], "exam string, rule string")
    best = {r["exam"]: (r["best"], r["status"]) for r in selection.unique_best(rules.withColumn("rule_score", selection.rule_score(F.col("rule"))), ["exam"]).collect()}
    assert best["e"] == (3, "unique") and best["f"] == (2, "ambiguous")


def test_volumes_with_constant_and_missing_voxels(spark):
    a, nan = [float(k % 7) for k in range(40)], math.nan
    rows = [(1, a, [v * 2 + 1 for v in a]), (2, a, [3.0] * 40), (3, [3.0] * 40, [3.0] * 40), (4, [nan, *a[1:]], [*a[:-1], math.inf]), (5, a[:10], a[:10]), (6, a, a[:39])]
    df = spark.createDataFrame(rows, "id int, a array<double>, b array<double>")
    got = {r["id"]: (r["c"], r["e"]) for r in df.select("id", voxels.correlation(F.col("a"), F.col("b")).alias("c"), voxels.nrmse(F.col("a"), F.col("b")).alias("e")).collect()}
    assert got[1] == (pytest.approx(1), pytest.approx(0, abs=1e-6)) and got[2] == got[3] == got[6] == (None, None)
    assert got[4] == (pytest.approx(1), pytest.approx(0, abs=1e-6)) and got[5][0] is None and got[5][1] == pytest.approx(0, abs=1e-6)
    voxel = [(k, x, y) for k, a, b in rows if len(a) == len(b) for x, y in zip(a, b, strict=True)]
    long = voxels.pair_statistics(spark.createDataFrame(voxel, "id int, a double, b double").repartition(7), ["id"])
    for r in long.collect():
        assert all(x is y is None or x == pytest.approx(y, abs=1e-6) for x, y in zip((r["corr"], r["nrmse"]), got[r["id"]], strict=True)), r
    pairs = [(1, k / 40, k / 40) for k in range(40)] + [(2, 0.1, 0.2)] * 10 + [(3, nan, 0.1)] * 40 + [(4, -1.0 + k % 2 * 5, 0.5 * (k % 2)) for k in range(40)] + [(5, 0.5, 0.5)] * 40
    nmi = {r["id"]: r["nmi"] for r in voxels.mutual_information(spark.createDataFrame(pairs, "id int, a double, b double"), "id").collect()}
    assert nmi[1] == pytest.approx(1) and nmi[2] is nmi[3] is nmi[5] is None and nmi[4] == pytest.approx(1)
    long = spark.createDataFrame([(1, float(k)) for k in range(101)] + [(1, nan), (2, nan)], "id int, v double")
    ends = {r["id"]: (r["low"], r["high"]) for r in voxels.with_percentile_bounds(long, ["id"]).select("id", "low", "high").distinct().collect()}
    assert ends == {1: (1.0, 99.0), 2: (None, None)}


def test_mismatch_dates_and_patient_counts(spark):
    df = spark.createDataFrame([(1, 2, "b", False), (1, 1, "c", False), (1, 3, "a", True), (2, 1, "a", None)], "patient_id int, row int, exam_date string, ok boolean")
    assert {r["patient_id"]: r["bad"] for r in qc.mismatch_dates(df, {"ok": "bad"}, ["row"]).collect()} == {1: "c|b", 2: ""}
    counts = qc.patients_with(qc.match_rollup(df.withColumn("status", F.lit("x")), ["ok"]), bad=~F.col("all_ok"), all=F.lit(True))
    assert {r["kind"]: r["n"] for r in counts.collect()} == {"bad": 1, "all": 2}


def test_whole_crop(spark):
    crop = status.whole_crop(F.array(F.lit(4), F.lit(5), F.lit(6)))
    assert [list(v) for v in spark.range(1).select(crop.alias("c")).first()["c"]] == [[0, 0, 0], [4, 5, 6], [1.5, 2.0, 2.5]]
