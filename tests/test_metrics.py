import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortry.operators import bootstrap, dq, leaderboard, metrics


def brute_auroc(rows):
    pos, neg = [p for y, p in rows if y], [p for y, p in rows if not y]
    return sum((a > b) + 0.5 * (a == b) for a in pos for b in neg) / (len(pos) * len(neg)) if pos and neg else None


def brute_ap(rows):
    n_pos, out, before = sum(y for y, _ in rows), 0.0, 0.0
    if not n_pos or n_pos == len(rows):
        return None
    for cut in sorted({p for _, p in rows}, reverse=True):
        tp, fp = sum(y for y, p in rows if p >= cut), sum(1 - y for y, p in rows if p >= cut)
        out, before = out + (tp / n_pos - before) * tp / (tp + fp), tp / n_pos
    return out


cases = st.lists(st.tuples(st.integers(0, 1), st.integers(0, 9).map(lambda k: k / 9)), min_size=1, max_size=12)


@settings(max_examples=3, deadline=None)
@given(st.lists(cases, min_size=20, max_size=40))
def test_ranking_metrics_match_brute_force(spark, many):
    rows = [(k, y, p) for k, case in enumerate(many) for y, p in case]
    df = spark.createDataFrame(rows, "run int, label int, prob double")
    got = {r["run"]: (r["auroc"], r["average_precision"]) for r in metrics.ranking_metrics(df, ["run"]).collect()}
    for k, case in enumerate(many):
        for mine, theirs in zip(got[k], (brute_auroc(case), brute_ap(case)), strict=True):
            assert mine == pytest.approx(theirs) if theirs is not None else mine is None


def test_weights_act_like_repeated_rows(spark):
    rnd = random.Random(0)
    rows = [(rnd.randint(0, 1), rnd.randint(0, 5) / 5, rnd.randint(1, 3)) for _ in range(40)]
    weighted = spark.createDataFrame([("r", *r) for r in rows], "run string, label int, prob double, weight int")
    plain = spark.createDataFrame([("r", y, p) for y, p, w in rows for _ in range(w)], "run string, label int, prob double")
    a, b = (metrics.all_metrics(d, ["run"]).first().asDict() for d in (weighted, plain))
    assert {k: pytest.approx(v) if isinstance(v, float) else v for k, v in b.items()} == a


def test_threshold_metrics_of_published_counts(spark):
    """tn 184, fp 29, fn 54, tp 39 give the published rates."""
    rows = [(0, 0.0)] * 184 + [(0, 1.0)] * 29 + [(1, 0.0)] * 54 + [(1, 1.0)] * 39
    m = metrics.threshold_metrics(spark.createDataFrame([("r", y, p) for y, p in rows], "run string, label int, prob double"), ["run"]).first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"]) == (184, 29, 54, 39)
    for name, value in {"balanced_accuracy": 0.6416023019839467, "accuracy": 0.7287581699346405, "precision": 0.5735294117647058, "recall": 0.41935483870967744, "specificity": 0.863849765258216, "f1": 0.484472049689441}.items():
        assert m[name] == pytest.approx(value)


def test_one_class_and_zero_division(spark):
    df = spark.createDataFrame([("p", 1, 0.2), ("n", 0, 0.9)], "run string, label int, prob double")
    got = {r["run"]: r for r in metrics.all_metrics(df, ["run"]).collect()}
    assert got["p"]["auroc"] is None and got["p"]["specificity"] is None and got["p"]["precision"] == 0 and got["p"]["balanced_accuracy"] == 0
    assert got["n"]["recall"] == 0 and got["n"]["specificity"] == 0


def test_threshold_keeps_half_unless_beaten_then_takes_the_lowest(spark):
    df = spark.createDataFrame([("a", 0, 0.1), ("a", 1, 0.9), ("b", 0, 0.6), ("b", 1, 0.9)], "run string, label int, prob double")
    got = {r["run"]: r["threshold"] for r in metrics.best_threshold(df, ["run"]).collect()}
    assert got["a"] == 0.5 and got["b"] == pytest.approx(0.602)


def test_bootstrap_weights_sum_to_strata(spark):
    subjects = spark.createDataFrame([(k, "ab"[k % 2], k % 3 % 2) for k in range(50)], "patient_id int, dataset string, label int")
    w = bootstrap.draw_weights(subjects, 7, 1).join(subjects, "patient_id").groupBy("replicate", "dataset", "label").sum("weight").collect()
    sizes = {(r["dataset"], r["label"]): r["count"] for r in subjects.groupBy("dataset", "label").count().collect()}
    assert len(w) == 7 * len(sizes) and all(r["sum(weight)"] == sizes[r["dataset"], r["label"]] for r in w)


@pytest.mark.parametrize("range_rows", [1 << 20, 70, 9])
def test_replicates_equal_weighted_metrics(spark, range_rows):
    """The packed sweep against metrics of the joined weights: ties, one-class draws, a subject that lacks in a run, a null key.
    All scores are one range, or few ranges, or many of which scores fill some by themselves."""
    rnd = random.Random(3)
    people = [(k, "ab"[k % 7 == 0], int(rnd.random() < 0.3)) for k in range(60)] + [(60, "c", 1)]
    subjects = spark.createDataFrame(people, "patient_id int, dataset string, label int")
    rows = [(run, k, d, y, rnd.randint(0, 99) / 99 if rnd.random() < 0.6 else rnd.choice([0.0, 1 / 3, 0.5])) for run in ("r", "s", None) for k, d, y in people if (run, k) != ("s", 5)]
    preds = spark.createDataFrame(rows, "run_name string, patient_id int, dataset string, label int, prob double")
    for keys in (["run_name"], ["dataset", "run_name"]):
        got = bootstrap.replicate_metrics(preds, bootstrap.draw_blocks(subjects, 20, 5, size=7), keys, size=7, range_rows=range_rows)
        joined = preds.join(bootstrap.draw_weights(subjects, 20, 5), "patient_id").fillna("none", ["run_name"])
        want = metrics.all_metrics(joined, [*keys, "replicate"]).select(*keys, "replicate", *bootstrap.VALUES)
        got, want = ({tuple(r[: len(keys) + 1]): r[len(keys) + 1 :] for r in t.collect()} for t in (got.fillna("none", ["run_name"]), want))
        assert len(want) == 20 * 3 * (1 if len(keys) == 1 else 3) and got.keys() == want.keys()
        for k, values in want.items():
            assert [v if v is None else pytest.approx(v) for v in values] == list(got[k])


def test_scores_are_parted_into_ranges_that_grow_with_the_rows(spark):
    scores = spark.createDataFrame([(k / 1000,) for k in range(1000)] + [(0.25,)] * 500 + [(float("-inf"),)] * 200, "score double")
    assert bootstrap.score_cuts(scores, 2000) == []
    cuts = bootstrap.score_cuts(scores, 100)
    assert len(cuts) == 16 and cuts.count(0.25) >= 4
    counts = {r["range"]: r["n"] for r in scores.withColumn("range", bootstrap._range_of(F.col("score"), cuts)).groupBy("range").agg(F.count("*").alias("n"), F.count_distinct("score").alias("d")).where("range % 2 = 0 or d = 1").collect()}
    assert sum(counts.values()) == 1700 and {n for r, n in counts.items() if r % 2} == {501, 200} and max(n for r, n in counts.items() if r % 2 == 0) <= 201


def test_missing_scores_are_the_lowest(spark):
    people = [(k, "a", k % 2) for k in range(30)]
    subjects = spark.createDataFrame(people, "patient_id int, dataset string, label int")
    rows = [("r", k, d, y, None if k % 5 == 0 else float("nan") if k % 7 == 0 else k / 30) for k, d, y in people]
    preds = spark.createDataFrame(rows, "run_name string, patient_id int, dataset string, label int, prob double")
    low = preds.withColumn("prob", F.coalesce(F.nanvl("prob", F.lit(-1.0)), F.lit(-1.0)))
    for range_rows in (100, 7):
        a, b = ({r["replicate"]: tuple(r)[2:4] for r in bootstrap.replicate_metrics(p, bootstrap.draw_blocks(subjects, 9, 5), ["run_name"], range_rows=range_rows).collect()} for p in (preds, low))
        assert len(a) == 9 and {k: pytest.approx(v) for k, v in a.items()} == b


def test_cohorts_draw_by_their_own_seeds(spark):
    people = [(k, "ab"[k % 2], k % 3 % 2) for k in range(60)] + [(100 + k, "one", 1) for k in range(5)] + [(200, None, 0), (201, None, 1), (300, "gap", None), (301, "gap", 1), (302, "gap", 0)]
    subjects = spark.createDataFrame(people, "patient_id int, dataset string, label int")
    status = {r["dataset"]: (r["n"], r["n_pos"], r["draw_status"]) for r in bootstrap.cohort_classes(subjects).collect()}
    assert status["one"] == (5, 5, "one_class_only") and status["gap"][2] == "one_class_only" and status["a"][2] == status[None][2] == "drawn"
    drawn = bootstrap.with_both_classes(subjects)
    assert {r["dataset"] for r in drawn.select("dataset").distinct().collect()} == {"a", "b", None}
    weights = lambda df: {tuple(r) for r in bootstrap.draw_weights(df, 6, 9, cohort="dataset").collect()}
    own = weights(drawn.where("dataset = 'a'"))
    assert own == {w for w in weights(drawn.where("dataset is not null")) if w[1] < 60 and w[1] % 2 == 0} and own != {tuple(r) for r in bootstrap.draw_weights(drawn.where("dataset = 'a'"), 6, 9).collect()}


def test_replicates_of_no_rows(spark):
    subjects = spark.createDataFrame([], "patient_id int, dataset string, label int")
    preds = spark.createDataFrame([], "run_name string, patient_id int, dataset string, label int, prob double")
    assert bootstrap.replicate_metrics(preds, bootstrap.draw_blocks(subjects, 5, 1), ["run_name"]).collect() == []


def test_run_names_parse_or_are_reported(spark):
    df = spark.createDataFrame([("clinical_logreg",), ("alpha_whole_phase0_logreg",), ("alpha_phase0",), ("gamma_whole_x_logreg",)], "run_name string")
    assert {r["run_name"] for r in leaderboard.unparsed_runs(df, ["alpha"]).collect()} == {"alpha_phase0", "gamma_whole_x_logreg"}


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, [1.0]), (1, [float("nan")]), (2, None)], "k int, embedding array<double>")
    assert dq.duplicate_keys(df, ["k"]).collect()[0]["n"] == 2 and dq.bad_vectors(df).count() == 2
    with pytest.raises(dq.QualityError):
        dq.require_empty(dq.bad_vectors(df), "vectors")
    with pytest.raises(dq.QualityError):
        dq.require_columns(df, ["k", "absent"])
