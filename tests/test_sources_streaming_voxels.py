import json
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import dq, features, manifests, probe, spread, voxels
from cohortry.sources import sinks, tables
from cohortry.streaming import incremental


def test_csv_round_trips(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, "train", "yes", [1, 2]), ("b", None, "train", "1", []), ("c", 0, "dev", "true", [3])], "patient_id string, label int, split string, usable string, l array<int>")
    sinks.write_table(df, f"{tmp_path}/m", fmt="csv")
    got = tables.read_manifest(spark, f"{tmp_path}/m", "usable")
    assert [(r["patient_id"], r["label"], r["l"]) for r in got.collect()] == [("a", 1, "1;2")]
    with pytest.raises(dq.QualityError):
        tables.read_manifest(spark, f"{tmp_path}/m", "absent")
    sinks.write_table(df, f"{tmp_path}/p", partition_by="split")
    assert spark.read.parquet(f"{tmp_path}/p").count() == 3
    sinks.write_summary(df.groupBy("split").count(), f"{tmp_path}/j")
    assert spark.read.json(f"{tmp_path}/j").count() == 2


def test_series_and_phase_files(spark, tmp_path):
    (tmp_path / "s.csv").write_text(",".join(tables.SERIES_COLUMNS) + "\n1, P_1 ,d,01-01-2020,dyn,MR,x,./a\n2,P_2,d,01-01-2020,dyn,MR,12,./b\n")
    got = tables.read_series(spark, str(tmp_path / "s.csv")).orderBy("series_uid").collect()
    assert [(r["subject_id"], r["number_of_images"]) for r in got] == [("P_1", None), ("P_2", 12)]
    exam = tmp_path / "root/siteA/P-1/01-02-2020"
    exam.mkdir(parents=True)
    for name in ("volume_phase0.nii.gz", "volume_phase10.nii.gz", "other.nii.gz"):
        (exam / name).write_bytes(b"abc")
    found = tables.scan_phase_files(spark, str(tmp_path / "root")).orderBy("phase").collect()
    assert [(r["cohort"], r["patient"], r["exam"], r["phase"], r["length"]) for r in found] == [("siteA", "P-1", "01-02-2020", 0, 3), ("siteA", "P-1", "01-02-2020", 10, 3)]
    names = spark.createDataFrame([("/x/p_1_0002.nii.gz",), ("/x/p_1_0000.nii.gz",), ("/x/p_1_x.nii.gz",)], "path string")
    assert [tuple(r) for r in tables.available_phases(names).collect()] == [("p_1", [0, 2], 2)]


def test_quarantine_manual_phases_metrics_predictions(spark, tmp_path):
    for case in ("caseA", "caseB"):
        (tmp_path / "q" / case).mkdir(parents=True)
        (tmp_path / "q" / case / "flagged_patients.csv").write_text("patient_id,issues\np1,x\n")
    assert {r["case"] for r in tables.read_quarantine(spark, str(tmp_path / "q")).collect()} == {"caseA", "caseB"}
    (tmp_path / "m").mkdir()
    head = ",".join(tables.PHASE_COLUMNS) + "\n"
    (tmp_path / "m/a.csv").write_text(head + "p1,d,0,./x\np1,d,1,./y\n")
    (tmp_path / "m/b.csv").write_text(head + "p1,d,0,./x\np2,d,1,./y\n")
    assert tables.read_phase_manifests(spark, str(tmp_path / "m")).count() == 2
    for run, body in (("r1", {"best_c": 0.1, "split_counts": {"train": 3, "test": 1}, "official_test_metrics_selected_threshold": {"roc_auc": 0.5}}), ("r2", {"best_c": 1.0})):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "metrics.json").write_text(json.dumps(body))
    got = {r["run_name"]: r for r in tables.read_run_metrics(spark, str(tmp_path / "runs")).collect()}
    assert got["r1"]["test_roc_auc"] == 0.5 and got["r1"]["n_train"] == 3 and got["r2"]["test_roc_auc"] is None
    with pytest.raises(dq.QualityError):
        tables.read_run_metrics(spark, str(tmp_path / "runs"), strict_runs=["r1", "r3"])
    (tmp_path / "runs/r1/predictions.csv").write_text("patient_id,dataset,label,prob\na,s,1,0.5\nb,s,0,0.25\n")
    assert tables.read_predictions(spark, str(tmp_path / "runs")).count() == 2
    (tmp_path / "runs/r1/predictions.csv").write_text("patient_id,dataset,label,prob\na,s,1,1.5\n")
    with pytest.raises(dq.QualityError):
        tables.read_predictions(spark, str(tmp_path / "runs"))


def test_run_summaries_join_history_config_and_first_test_result(spark, tmp_path):
    files = {
        "a/metrics.csv": "epoch,train_loss,val_loss,val_roc_auc\n1,0.9,0.8,0.5\n2,0.7,0.6,0.75\n3,0.5,0.7,0.75\n",
        "a/run_config.json": json.dumps({"split_summary": {"train_rows": 10, "val_rows": 2, "freeze_encoder": True, "resize_mode": "pad"}, "args": {"image_only": False, "roi_status": ["x", "y"], "input_shape": [4, 5, 6]}}),
        "a/test_evaluation.json": "{}", "a/best_on_test.json": json.dumps({"checkpoint": "best.pt", "checkpoint_epoch": 2, "metrics": {"roc_auc": 0.5, "curve": [1, 2], "name": "t", "none": None}}), "a/test_metrics.json": json.dumps({"roc_auc": 0.1}),
        "b/metrics.csv": "step,val_loss\r\n5,\r\n6,0.25\r\n7,0.5\r\n", "c/test_metrics.json": json.dumps({"roc_auc": 0.25, "tn": 3}), "d/run_config.json": json.dumps({"args": {"architecture": "other", "roi_status": "one"}}), "e/metrics.csv": "epoch,train_loss\n4,1\n9,2\n",
    }
    for name, body in files.items():
        (tmp_path / "runs" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "runs" / name).write_text(body)
    got = {r["run_name"]: r for r in tables.summarize_runs(spark, str(tmp_path / "runs")).collect()}
    assert set(got) == set("abcde")
    a, b, c, d, e = (got[k] for k in "abcde")
    assert (a["epochs"], a["best_epoch"], a["best"]) == (3, 2, {"train_loss": 0.7, "val_loss": 0.6, "val_roc_auc": 0.75})
    assert (a["test_result_file"], a["test"], a["test_checkpoint"], a["test_checkpoint_epoch"]) == ("best_on_test.json", {"roc_auc": "0.5", "name": "t", "none": None}, "best.pt", 2)
    assert (a["train_rows"], a["freeze_encoder"], a["random_init_encoder"], a["architecture"], a["image_only"], a["roi_status"], a["input_shape"], a["resize_mode"]) == (10, "true", "false", "nnunet_encoder", "false", "x y", "4x5x6", "pad")
    assert (b["epochs"], b["best_epoch"], b["best"], b["test"]) == (3, None, {"val_loss": 0.25}, None)
    assert (c["test_result_file"], c["test"], c["test_checkpoint"], c["epochs"]) == ("test_metrics.json", {"roc_auc": "0.25", "tn": "3"}, None, None)
    assert (d["architecture"], d["roi_status"], d["resize_mode"]) == ("other", "one", "stretch") and (e["epochs"], e["best_epoch"], e["best"]) == (9, 9, {"train_loss": 2.0})
    (tmp_path / "none").mkdir()
    assert tables.summarize_runs(spark, str(tmp_path / "none")).count() == 0


def test_legend_summary_object_and_active_audit(spark, tmp_path):
    (tmp_path / "legend.csv").write_text("column,description\n age , years \nage,older\n,lost\npcr,\n")
    legend = tables.read_legend(spark, str(tmp_path / "legend.csv"))
    assert {r["column"]: r["description"] for r in legend.collect()} == {"age": "older", "pcr": None}
    (tmp_path / "clinical.csv").write_text("patient_id,age,pcr\np1,44,1\np2,x,0\n")
    clinical = tables.read_clinical(spark, str(tmp_path / "clinical.csv"), "patient_id string, age int, pcr int")
    assert sorted((r["patient_id"], r["age"]) for r in clinical.collect()) == [("p1", 44), ("p2", None)] and tables.undescribed_columns(clinical, legend) == ["patient_id"]
    counts = spark.createDataFrame([("b", "x", 1), ("b", None, 2), ("a", 'q"uote', 3), ("b", "x", 4)], "section string, key string, n long")
    sinks.write_summary_object(counts, str(tmp_path / "s"))
    written = [f for f in (tmp_path / "s").iterdir() if f.name.startswith("part-")]
    assert len(written) == 1 and written[0].read_text().strip() == '{"a":{"q\\"uote":3},"b":{"missing":2,"x":5}}'
    sinks.write_summary_object(counts.where("false"), str(tmp_path / "s0"))
    assert [f.read_text().strip() for f in (tmp_path / "s0").iterdir() if f.name.startswith("part-")] == ["{}"]
    (tmp_path / "audit.csv").write_text("patient_id,reconstructed_exam_exists\np1,True\np2,false\np3,\n")
    assert [r["patient_id"] for r in tables.read_active_audit(spark, str(tmp_path / "audit.csv")).collect()] == ["p1"]


def test_split_and_baseline_checks_and_coefficients(spark):
    runs = spark.createDataFrame([("clinical_logreg",), ("x",), ("clinical_logreg",)], "run_name string")
    assert dq.baseline_count(runs, "clinical_logreg") == 2 and dq.baseline_count(runs.where("false"), "x") == 0
    preds = spark.createDataFrame([("r", 1), ("r", 0), ("s", 1), ("t", None)], "run_name string, label int")
    assert {r["run_name"] for r in dq.one_class_keys(preds, ["run_name"]).collect()} == {"s", "t"}
    assert [tuple(r) for r in probe.coefficient_table(spark, ["a", "b", "c"], [0.5, -2.0, 0.5]).collect()] == [("b", -2.0), ("a", 0.5), ("c", 0.5)]


def test_stream_resumes_and_corrections_win(spark, tmp_path):
    schema = "patient_id string, exam_date string, v int"
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    for part in ([("a", "1", 1), ("b", "1", 1)], [("b", "1", 2), ("c", "1", 1)]):
        spark.createDataFrame(part, schema).write.mode("append").parquet(source)
        incremental.process_new(spark.readStream.schema(schema).parquet(source), lambda df: df, out, str(tmp_path / "cp"), ["patient_id"])
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [("a", "1", 1), ("b", "1", 1), ("c", "1", 1)]


def test_keys_done_before_and_batches_tried_twice(spark, tmp_path, monkeypatch):
    """Keys that the table had before the job ran stay out; a batch that failed after its write adds nothing twice."""
    schema, out, cp, source = "k int, v int", str(tmp_path / "out"), str(tmp_path / "cp"), str(tmp_path / "in")
    spark.createDataFrame([(1, 0)], schema).write.parquet(out)
    spark.createDataFrame([(1, 1), (2, 1), (2, 1)], schema).write.parquet(source)
    stream = lambda: spark.readStream.schema(schema).parquet(source)
    incremental.process_new(stream(), lambda df: df, out, cp, ["k"])
    spark.createDataFrame([(1, 2), (2, 2), (3, 2), (4, 2)], schema).write.mode("append").parquet(source)
    # as if the next batch had been written, all but its last row, and then failed
    incremental._Folder(spark, cp + "-notes").mark("tried-1")
    spark.createDataFrame([(3, 2)], schema).write.mode("append").parquet(out)
    incremental.process_new(stream(), lambda df: df, out, cp, ["k"])
    assert sorted(tuple(r) for r in spark.read.parquet(out).collect()) == [(1, 0), (2, 1), (3, 2), (4, 2)]


def test_a_batch_does_not_read_what_was_done(spark, tmp_path):
    """Once the job runs, the finished table is not read again: it may even be moved away."""
    schema, out, source = "k int", str(tmp_path / "out"), str(tmp_path / "in")
    for n in range(3):
        spark.range(n * 5, n * 5 + 10).selectExpr("cast(id as int) k").write.mode("append").parquet(source)
        incremental.process_new(spark.readStream.schema(schema).parquet(source), lambda df: df, out, str(tmp_path / "cp"), ["k"])
        got = sorted(r["k"] for r in spark.read.parquet(out).collect())
        assert got == (list(range(10)) if n == 0 else list(range(n * 5 + 5, n * 5 + 10)))
        (tmp_path / "out").rename(tmp_path / f"moved{n}")


def test_corrections_win_are_merged_and_compacted(spark, tmp_path):
    schema = "patient_id string, exam_date string, v int"
    rows = {(f"p{k}", "d"): [k, k + 100] if k % 4 == 0 else [k] for k in range(200)}
    frame = lambda d, **more: spark.createDataFrame([(*k, v) for k, vs in d.items() for v in vs], schema)
    t = incremental.CorrectedTable(spark, str(tmp_path / "t"), buckets=16)
    t.create(frame(rows))
    t.create(frame({("x", "y"): [1]}))  # a finished creation stays
    held = lambda: sorted((*map(str, tuple(r)[:2]), r["v"]) for r in t.read().collect())
    want = lambda: sorted((*k, v) for k, vs in rows.items() for v in vs)
    assert held() == want() and t.compact() == 0
    first = {("p4", "d"): [-1], ("new", "d"): [-2, -3]}
    t.append(frame(first), 1)
    t.append(frame(first), 1)  # tried twice
    second = {("p4", "d"): [-9, -10], ("p5", "d"): [-5]}
    t.append(frame(second), 2)
    rows |= first | second
    assert held() == want()
    before = set(t.folder.names("base/bucket=*/gen=*"))
    assert 1 <= t.compact() <= 3 and held() == want()
    assert len(set(t.folder.names("base/bucket=*/gen=*")) - before) <= 3
    # a compaction that wrote and died before its marker: nothing counts, the next one starts again
    t.append(frame({("p6", "d"): [-6]}), 3)
    t._bucketed(frame({("p6", "d"): [7777]})).withColumn("gen", F.lit(3)).write.mode("append").partitionBy("bucket", "gen").parquet(f"{t.root}/base")
    rows[("p6", "d")] = [-6]
    assert held() == want() and t.compact() == 1 and held() == want()
    t.vacuum()
    assert held() == want() and len(t.folder.names("commits/*")) == 1 and t.folder.names("log/batch=*") == []
    fixes = str(tmp_path / "fix")
    spark.createDataFrame([("p7", "d", -7), (None, "d", 5)], schema).write.parquet(fixes)
    t.append_stream(spark.readStream.schema(schema).parquet(fixes), str(tmp_path / "cp2"), first=4)
    rows |= {("p7", "d"): [-7], ("None", "d"): [5]}
    assert held() == want()


def test_failing_slices_carry_their_error(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "k int, slice array<double>")
    got = {r["k"]: r for r in voxels.encode_slices(df, lambda: lambda b: b @ np.ones((2, 1)), ["k"]).collect()}
    assert got[1]["embedding"] == [3.0] and got[2]["embedding"] is None and got[2]["error"]


def test_pooling_fusion_and_features(spark):
    s = spark.createDataFrame([("p", [1.0, 4.0]), ("p", [3.0, 2.0])], "patient_id string, embedding array<double>")
    assert features.pool_slices(s, ["patient_id"], mode="mean_max").first()["embedding"] == [2.0, 3.0, 3.0, 4.0]
    t = spark.createDataFrame([("p", "a", [1.0]), ("p", "b", [2.0]), ("q", "a", [3.0])], "patient_id string, model_key string, embedding array<double>")
    assert [tuple(r) for r in features.fuse_embeddings(t, ["b", "a"]).collect()] == [("p", [2.0, 1.0])]
    train = spark.createDataFrame([(1.0, "x"), (3.0, "y"), (None, "y")], "n double, c string")
    schema = features.fit_features(train, ["n"], ["c"])
    rows = spark.createDataFrame([(0, None, "z"), (1, 4.0, None)], "k int, n double, c string")
    dense = features.dense_features(features.encode_features(rows, schema, "k"), schema)
    names = {r["feature"]: r["slot"] for r in features.feature_names(spark, schema).collect()}
    f = {r["k"]: r["features"] for r in dense.collect()}
    assert f[0] == [0.0, 0.0, 0.0] and (f[1][names["c=x"]], f[1][names["c=y"]]) == (0.0, 1.0) and f[1][names["n"]] == pytest.approx(2 / (2 / 3) ** 0.5)


@pytest.mark.parametrize("variant", ["probe", "schema"])
def test_encoded_features_match_a_plain_fit(spark, monkeypatch, variant):
    """Many categories, a heavy one, missing, NaN and unknown values, a column of nulls, a constant one."""
    monkeypatch.setattr(spread, "HEAVY_ROWS", 5)
    rnd = random.Random(41)
    make = lambda k, words: (k, rnd.choice([None, float("nan"), 1.0, 2.5, 7.0]), 3.0, rnd.choice(["hot", "hot", None, *words]), None)
    kinds = "k int, n double, flat double, c string, empty string"
    train, rows = [make(k, [f"w{j}" for j in range(60)]) for k in range(300)], [make(k, [f"w{j}" for j in range(90)]) for k in range(80)]
    df = spark.createDataFrame(train, kinds)
    schema = features.fit_features(df, ["n", "flat"], ["c", "empty"], variant, small=20)
    known = sorted(r[1] for r in train if r[1] is not None and r[1] == r[1])
    fill = float(np.median(known)) if variant == "probe" else sum(known) / len(known)
    whole = [r[1] if r[1] is not None and r[1] == r[1] else fill for r in train]
    mean, std = np.mean(whole), np.std(whole, ddof=variant != "probe")
    words = Counter(r[3] for r in train if r[3] is not None)
    top = min(words, key=lambda w: (-words[w], w)) if variant == "probe" else "__missing__"
    names = {r["slot"]: r["feature"] for r in features.feature_names(spark, schema).collect()}
    missing = set() if variant == "probe" else {"c=__missing__", "empty=__missing__"}
    assert set(names.values()) == {"n", "flat", *(f"c={w}" for w in words), *missing} and sorted(names) == list(range(schema.width))
    got = features.encode_features(spark.createDataFrame(rows, kinds), schema, "k").collect()
    assert len(got) == 80
    for r in got:
        _, n, _, c, _ = rows[r["k"]]
        want = {"n": ((n if n is not None and n == n else fill) - mean) / std}
        c = top if c is None else c
        if c in words:
            want[f"c={c}"] = 1.0
        elif missing:
            want["c=__missing__"] = 1.0
        if missing:
            want["empty=__missing__"] = 1.0
        mine = {names[i]: v for i, v in zip(r["features"]["indices"], r["features"]["values"], strict=True) if abs(v) > 1e-9}
        assert r["features"]["indices"] == sorted(r["features"]["indices"])
        assert mine == pytest.approx({f: v for f, v in want.items() if abs(v) > 1e-9})


def test_medians_and_bounds_of_large_groups(spark):
    rows = [(k % 2, float(k * 7919 % 1000)) for k in range(4000)]
    df = spark.createDataFrame(rows, "volume_id int, v double").withColumn("x", F.lit(1))
    want = {g: sorted(v for h, v in rows if h == g) for g in (0, 1)}
    got = {r["volume_id"]: (r["low"], r["median"], r["high"], r["known"]) for r in manifests.numeric_summary(df, ["v"], ["volume_id"], small=100).collect()}
    assert got == {g: (v[0], (v[999] + v[1000]) / 2, v[-1], 2000) for g, v in want.items()}
    bounds = voxels.with_percentile_bounds(df, ["volume_id"], small=100).groupBy("volume_id").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.count("*").alias("n")).collect()
    for r in bounds:
        assert (r["low"], r["high"]) == pytest.approx(tuple(np.percentile(want[r["volume_id"]], [1, 99]))) and r["n"] == 2000


def test_probe_separates_and_joins_one_to_one(spark):
    rng = np.random.default_rng(1)
    rows = [(k, k % 2, "test" if k % 5 == 0 else "train", [float(k % 2) * 2 + rng.normal(), rng.normal()]) for k in range(120)]
    df = spark.createDataFrame(rows, "patient_id int, label int, split string, embedding array<double>")
    scaled = probe.scale_vectors(df.where("split = 'train'"), df)
    test, chosen = probe.run_probe(scaled, grid=[0.1, 1.0])
    auc = test.groupBy().agg(F.corr("prob", F.col("label").cast("double"))).first()[0]
    assert auc > 0.4 and chosen["c"] in (0.1, 1.0)
    with pytest.raises(dq.QualityError):
        probe.join_embeddings(df.unionByName(df).drop("embedding"), df.select("patient_id", "embedding"))
