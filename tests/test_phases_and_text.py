from pyspark.sql import functions as F

from cohortry.functions import text
from cohortry.operators import manifests, phases, selection, status

SCHEMA = "series int, ord int, t int, proj double"


def split_of(df):
    return [r["phase"] for r in df.orderBy("ord").collect()]


def test_consecutive_split_at_the_gap_and_over_nulls(spark):
    df = spark.createDataFrame([(1, k, t, None) for k, t in enumerate([0, 79, 159, None, 500, 580])], SCHEMA)
    assert split_of(phases.consecutive_split(df, 80)) == [0, 0, 1, 1, 1, 2]


def test_grouped_split_needs_every_time(spark):
    df = spark.createDataFrame([(1, k, t, None) for k, t in enumerate([0, 200, 10, 210])] + [(2, 0, 1, None), (2, 1, None, None)], SCHEMA)
    got = phases.grouped_split(df, 100)
    assert split_of(got.where("series = 1")) == [0, 1, 0, 1] and got.where("series = 2").count() == 0


def test_reset_split_guards(spark):
    good = [(1, k, None, float(p)) for k, p in enumerate([0.0, 1, 2, 0, 1, 2])]
    uneven = [(2, k, None, float(p)) for k, p in enumerate([0.0, 1, 2, 3, 4, 0, 1])]
    flat = [(3, k, None, 1.0) for k in range(4)]
    falling = [(4, k, None, -float(p)) for k, p in enumerate([0.0, 1, 2, 0, 1, 2])]
    got = phases.reset_split(spark.createDataFrame(good + uneven + flat + falling, SCHEMA))
    assert split_of(got.where("series = 1")) == [0, 0, 0, 1, 1, 1] == split_of(got.where("series = 4"))
    assert got.where("series in (2, 3)").count() == 0


def test_choice_prefers_plausible_splits(spark):
    df = spark.createDataFrame([(1, k, t, None) for k, t in enumerate([0, 0, 500, 500])] + [(2, k, t, None) for k, t in enumerate([0, 500, 500])], SCHEMA)
    got = {r["series"]: (r["kind"], r["n_phases"]) for r in phases.choose_split(df, 100).collect()}
    assert got == {1: ("grouped", 2), 2: ("as_is", 1)}


def one(spark, expression, *values):
    names = [f"c{k}" for k in range(len(values))]
    df = spark.createDataFrame([values], ", ".join(f"{n} {'double' if isinstance(v, float) else 'int' if isinstance(v, int) else 'array<int>' if isinstance(v, list) else 'string'}" for n, v in zip(names, values, strict=True)))
    return df.select(expression(*[F.col(n) for n in names]).alias("x")).first()["x"]


def test_text_rules(spark):
    assert one(spark, text.normalize_series_name, "axT1Vibe ph2 20 ml pre-contrast: X") == "ax t1 vibe x"
    assert one(spark, text.family_key, "Ph1") == text.PHASE_ONLY and one(spark, text.family_key, None) is None
    assert one(spark, text.phase_number, "DYN post 3") == 3 and one(spark, text.phase_number, "dyn pre") == 0
    assert one(spark, lambda c: text.subject_id(c, "SITE"), "x_123") == "SITE-123" and one(spark, lambda c: text.subject_id(c, "SITE"), "x_5") == "SITE-05"
    assert one(spark, text.folder_description, "1-a-b-2") == "a-b" and one(spark, text.folder_description, "1-a") == "1-a"
    assert str(one(spark, text.iso_date, "02-29-2020")) == "2020-02-29" and one(spark, text.iso_date, "02-30-2019") is None
    assert one(spark, text.parse_bool, " YES ") is True and one(spark, text.parse_bool, None) is False
    assert one(spark, text.audit_contiguity, [1, 2]) == "does_not_start_at_zero" and one(spark, text.release_contiguity, [0, 2]) == "non_contiguous_or_not_zero"
    assert one(spark, text.infer_plane, "Sagittal T2") == "sagittal" and one(spark, text.infer_plane, None) == ""
    assert one(spark, lambda c: text.contrast_class(c, F.lit(5.0), F.lit(60.0))["contrast"], "T1 vibe") == "t2_like"


def test_volume_gate_order(spark):
    gate = lambda p, r: tuple(one(spark, lambda a, b: status.volume_gate(a, b), p, r))
    assert gate(0.0, 1.0) == ("empty_prediction", 0.0) and gate(0.01, 0.0) == ("too_small", None)
    assert gate(1.0, 0.0) == ("missing_reference", None) and gate(1.0, 10.0) == ("ratio_low", 0.1) and gate(1.0, 1.0) == ("pass", 1.0)


def test_split_form_and_replacement(spark):
    wide = spark.createDataFrame([("a", "a"), ("b", None), (None, "c")], "train_split string, test_split string")
    assert {tuple(r) for r in manifests.split_long_form(wide).collect()} == {("a", "train"), ("b", "train"), ("c", "test")}
    report = spark.createDataFrame([("p", "d", 0, "old"), ("p", "d", 1, "old"), ("p", "e", 0, "old")], "patient_id string, exam_date string, phase int, s string")
    new = spark.createDataFrame([("p", "d", 0, "new")], report.schema)
    assert sorted(tuple(r) for r in manifests.replace_rows(report, new).collect()) == [("p", "d", 0, "new"), ("p", "e", 0, "old")]


def test_stratified_split_shares(spark):
    rows = spark.createDataFrame([(k, int(k < 30)) for k in range(100)], "patient_id int, label int")
    got = status.stratified_split(rows, 0.2, 1)
    assert {(r["label"], r["fold"]): r["count"] for r in got.groupBy("label", "fold").count().collect()} == {(1, "train"): 24, (1, "validation"): 6, (0, "train"): 56, (0, "validation"): 14}
    assert {r[0] for r in got.where("fold = 'validation'").select("patient_id").collect()} == {r[0] for r in status.stratified_split(rows.repartition(3), 0.2, 1).where("fold = 'validation'").select("patient_id").collect()}


def test_first_term_wins(spark):
    df = spark.createDataFrame([(1, "dyn mp"), (1, "original dce"), (2, "bw83 dyn"), (3, "other")], "exam int, name string")
    got = {(r["exam"], r["name"]) for r in selection.first_term(df, ["exam"], ["original dce", "dyn"], "name").collect()}
    assert got == {(1, "original dce"), (2, "bw83 dyn")}
