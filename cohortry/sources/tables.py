"""Reading manifests, clinical tables, series metadata, quarantine cases, run metrics and file listings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import parse_bool, path_parts
from ..operators import dq
from ..operators.leaderboard import best_epoch
from ..operators.status import eligible

#: Column names of series metadata and phase manifests, and keys of run metrics.
SERIES_COLUMNS = ["Series UID", "Subject ID", "Study Description", "Study Date", "Series Description", "Modality", "Number of Images", "File Location"]
PHASE_COLUMNS = ["patient_id", "exam_date", "phase_index", "series_dir"]
_MEASURES = T.StructType([T.StructField(n, T.DoubleType()) for n in ("roc_auc", "average_precision", "balanced_accuracy", "accuracy", "tn", "fp", "fn", "tp")])
METRICS_SCHEMA = T.StructType([
    T.StructField("best_c", T.DoubleType()), T.StructField("selected_threshold_from_validation", T.DoubleType()),
    T.StructField("split_counts", T.MapType(T.StringType(), T.LongType())),
    T.StructField("official_test_metrics_selected_threshold", _MEASURES), T.StructField("official_test_metrics_0p5", _MEASURES),
])


def read_texts(spark: SparkSession, path: str, required: list[str] | None = None) -> DataFrame:
    """A CSV with a header, every column as text; missing required columns are an error."""
    return dq.require_columns(spark.read.csv(path, header=True, inferSchema=False), required or [])


def read_manifest(spark: SparkSession, path: str, flag: str | None = None) -> DataFrame:
    """Manifest rows that are eligible: id as text, label as int, split, and the usable flag if named."""
    rows = read_texts(spark, path, ["patient_id", "label", "split", *([flag] if flag else [])])
    return eligible(rows.withColumn("label", F.col("label").try_cast("double").cast("int")), flag=flag)


def read_clinical(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """An exported sheet with a declared schema; values that do not parse are null."""
    return spark.read.csv(path, header=True, schema=schema, mode="PERMISSIVE")


def read_series(spark: SparkSession, path: str) -> DataFrame:
    """Series metadata: trimmed texts under short names, image count as int (null if it is no number)."""
    rows = read_texts(spark, path, SERIES_COLUMNS)
    short = {c: c.lower().replace(" ", "_") for c in SERIES_COLUMNS}
    texts = rows.select(*[F.trim(F.col(f"`{c}`")).alias(n) for c, n in short.items()])
    return texts.withColumn("number_of_images", F.col("number_of_images").try_cast("int"))


def list_files(spark: SparkSession, root: str, glob: str) -> DataFrame:
    """``path`` and ``length`` of files below a folder; contents are never read."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root).select("path", "length")


def scan_phase_files(spark: SparkSession, root: str) -> DataFrame:
    """Phase files by cohort, patient, exam and phase; paths that do not fit are left out."""
    found = list_files(spark, root, "volume_phase*.nii.gz").withColumn("p", path_parts(F.col("path")))
    return found.where("p is not null").select("p.*", "path", "length")


def available_phases(files: DataFrame, name: Column | None = None) -> DataFrame:
    """Per patient: sorted numeric suffixes of ``<id>_<digits>.nii.gz``, and their count."""
    name = name if name is not None else F.element_at(F.split("path", "/"), -1)
    part = lambda k: F.regexp_extract(name, r"^(.+)_(\d+)\.nii\.gz$", k)
    rows = files.where(name.rlike(r"^.+_\d+\.nii\.gz$")).select(part(1).alias("patient_id"), part(2).cast("int").alias("phase"))
    return rows.groupBy("patient_id").agg(F.array_sort(F.collect_set("phase")).alias("phases")).withColumn("n_phases", F.size("phases"))


def read_quarantine(spark: SparkSession, root: str) -> DataFrame:
    """All cases' tables, each row with the name of its case's folder."""
    rows = spark.read.csv(f"{root}/*/flagged_patients.csv", header=True)
    return rows.withColumn("case", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))


def read_phase_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Manual phases; a file without the columns, or with several patients or dates, is ignored."""
    rows = spark.read.csv(path, header=True, schema=", ".join(f"{c} string" for c in PHASE_COLUMNS), enforceSchema=False, mode="PERMISSIVE")
    rows = rows.withColumn("file", F.col("_metadata.file_path")).where(F.col("phase_index").try_cast("int").isNotNull())
    good = rows.groupBy("file").agg(F.count_distinct("patient_id").alias("p"), F.count_distinct("exam_date").alias("d")).where("p = 1 and d = 1")
    return rows.join(good.select("file"), "file", "left_semi").withColumn("phase_index", F.col("phase_index").cast("int"))


def flatten_metrics(metrics: DataFrame) -> DataFrame:
    """Nested run metrics as columns; a missing object gives nulls."""
    chosen, half = "official_test_metrics_selected_threshold", "official_test_metrics_0p5"
    names = [f.name for f in _MEASURES]
    return metrics.select(
        *[c for c in metrics.columns if c not in METRICS_SCHEMA.names], "best_c", F.col("selected_threshold_from_validation").alias("threshold"),
        F.col("split_counts")["train"].alias("n_train"), F.col("split_counts")["test"].alias("n_test"),
        *[F.col(f"{chosen}.{n}").alias(f"test_{n}") for n in names], *[F.col(f"{half}.{n}").alias(f"test_{n}_0p5") for n in names[:3]],
    )


def read_run_metrics(spark: SparkSession, root: str, strict_runs: list[str] | None = None) -> DataFrame:
    """``<run>/metrics.json`` of all runs, flattened; with ``strict_runs`` a missing one is an error."""
    rows = spark.read.schema(METRICS_SCHEMA).json(f"{root}/*/metrics.json", multiLine=True)
    found = flatten_metrics(rows.withColumn("run_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1)))
    if strict_runs:
        wanted = spark.createDataFrame([(r,) for r in strict_runs], "run_name string")
        dq.require_empty(wanted.join(found, "run_name", "left_anti"), "runs without metrics")
    return found


def read_predictions(spark: SparkSession, root: str) -> DataFrame:
    """``<run>/predictions.csv`` of all runs; bad labels, probabilities or repeated subjects are an error."""
    rows = spark.read.csv(f"{root}/*/predictions.csv", header=True)
    dq.require_columns(rows, ["patient_id", "dataset", "label", "prob"])
    rows = rows.withColumn("run_name", F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1))
    rows = rows.withColumns({"label": F.col("label").try_cast("int"), "prob": F.col("prob").try_cast("double")})
    broken = dq.rule_counts(rows, dq.prediction_rules()).where("bad_label > 0 or bad_prob > 0")
    dq.require_empty(broken, "predictions")
    dq.require_empty(dq.duplicate_keys(rows, ["run_name", "patient_id"]), "repeated subjects")
    return rows


def read_active_audit(spark: SparkSession, path: str, flag: str = "reconstructed_exam_exists") -> DataFrame:
    rows = read_texts(spark, path, [flag])
    return rows.where(parse_bool(F.col(flag)))


def first_test_result(runs: DataFrame, *results: DataFrame) -> DataFrame:
    """``runs`` with ``test_result`` of the first of several tables (run_name, result) that has one."""
    out = runs
    for k, table in enumerate(results):
        out = out.join(table.select("run_name", F.col("result").alias(f"__r{k}")), "run_name", "left")
    own = [f"__r{k}" for k in range(len(results))]
    return out.withColumn("test_result", F.coalesce(*own)).drop(*own)


def _whole_texts(spark: SparkSession, root: str, name: str) -> DataFrame:
    """``run_name`` and ``text`` of ``<run>/<name>`` of all runs; small files, one row each. No rows if no run has it."""
    try:
        rows = spark.read.text(f"{root}/*/{name}", wholetext=True)
    except Exception as e:  # noqa: BLE001  told apart by its error class
        if "PATH_NOT_FOUND" not in str(e):
            raise
        return spark.createDataFrame([], "run_name string, text string")
    return rows.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)/[^/]+$", 1).alias("run_name"), F.col("value").alias("text"))


def read_histories(spark: SparkSession, root: str) -> DataFrame:
    """``run_name``, ``row`` (from 0), ``epoch``, ``val_auroc``, ``val_loss``, ``values`` (map of all columns) of ``<run>/metrics.csv``.

    Runs may have different columns; values that are no numbers are null. Without an ``epoch`` column it is null.
    """
    lines = F.filter(F.split("text", r"\r?\n"), lambda x: x != "")
    named = _whole_texts(spark, root, "metrics.csv").select("run_name", F.transform(F.split(lines[0], ","), lambda x: F.trim(x)).alias("head"), F.slice(lines, 2, F.greatest(F.size(lines) - 1, F.lit(0))).alias("rows"))
    rows = named.select("run_name", "head", F.posexplode("rows").alias("row", "line"))
    cells = F.transform(F.split("line", ",", -1), lambda x: F.trim(x).try_cast("double"))
    values = F.map_from_entries(F.arrays_zip(F.col("head").alias("k"), F.slice(cells, 1, F.size("head")).alias("v")))
    get = lambda c: F.try_element_at("values", F.lit(c))
    return rows.select("run_name", "row", values.alias("values")).select("run_name", "row", get("epoch").cast("int").alias("epoch"), get("val_roc_auc").alias("val_auroc"), get("val_loss").alias("val_loss"), "values")


#: Files with a run's test result, the first that is there and not empty counts.
TEST_RESULTS = ["test_evaluation.json", "best_on_test.json", "test_metrics.json"]


def summarize_runs(spark: SparkSession, root: str) -> DataFrame:
    """One row a run that has a history, a config or a test result: its size and settings (``run_config.json``), ``epochs``,
    ``best_epoch`` and ``best`` (train and validation values of the chosen epoch), ``test_result_file`` and ``test`` (its plain values as text).

    The best epoch is the one of highest validation AUROC, else of least loss, else the last; ties go to the first. What a file
    lacks is null; text that is no JSON counts as no file.
    """
    history = read_histories(spark, root)
    epochs = history.groupBy("run_name").agg(F.coalesce(F.max("epoch").cast("long"), F.count(F.lit(1))).alias("epochs"))
    best = best_epoch(history.drop("epoch"), run="run_name", epoch="row")
    kept = F.map_filter("values", lambda k, v: k.startswith("train_") | k.startswith("val_"))
    best = best.select("run_name", F.try_element_at("values", F.lit("epoch")).cast("int").alias("best_epoch"), kept.alias("best"))
    config = _whole_texts(spark, root, "run_config.json")
    at = lambda p: F.get_json_object("text", f"$.{p}")
    listed = lambda p, mark: F.coalesce(F.array_join(F.from_json(at(p), "array<string>"), mark), at(p))
    own = config.select(
        "run_name", *[at(f"split_summary.{k}").try_cast("long").alias(k) for k in ("train_rows", "val_rows", "test_rows", "tabular_dim")],
        F.lower(at("split_summary.freeze_encoder")).alias("freeze_encoder"), F.coalesce(at("split_summary.random_init_encoder"), at("args.random_init_encoder"), F.lit("false")).alias("random_init_encoder"),
        F.coalesce(at("split_summary.architecture"), at("args.architecture"), F.lit("nnunet_encoder")).alias("architecture"), at("args.image_only").alias("image_only"),
        listed("args.roi_status", " ").alias("roi_status"), listed("args.input_shape", "x").alias("input_shape"), F.coalesce(at("split_summary.resize_mode"), at("args.resize_mode"), F.lit("stretch")).alias("resize_mode"),
    )
    tables = []
    for name in TEST_RESULTS:
        found = _whole_texts(spark, root, name).withColumn("all", F.from_json("text", "map<string,string>")).where("size(all) > 0")
        tables.append(found.select("run_name", F.struct(F.lit(name).alias("file"), "text", "all").alias("result")))
    runs = history.select("run_name").unionByName(config.select("run_name"))
    for t in tables:
        runs = runs.unionByName(t.select("run_name"))
    joined = first_test_result(runs.distinct(), *tables).withColumn("text", F.col("test_result.text"))
    inner = F.from_json(at("metrics"), "map<string,string>")
    nested = F.coalesce(at("metrics").startswith("{"), F.lit(False))
    plain = F.map_filter(F.when(nested, inner).otherwise(F.col("test_result.all")), lambda k, v: v.isNull() | ~v.rlike(r"^[\[{]"))
    tested = joined.select(
        "run_name", F.col("test_result.file").alias("test_result_file"), plain.alias("test"),
        F.when(nested, at("checkpoint")).alias("test_checkpoint"), F.when(nested, at("checkpoint_epoch").try_cast("int")).alias("test_checkpoint_epoch"),
    )
    return tested.join(own, "run_name", "left").join(epochs, "run_name", "left").join(best, "run_name", "left")


def read_legend(spark: SparkSession, path: str, name: str = "column", text: str = "description") -> DataFrame:
    """The exported legend sheet of a clinical table: ``name`` and ``text``, trimmed; rows without a name are left out, of repeated names one row
    stays (the smallest text)."""
    rows = read_texts(spark, path, [name, text]).select(F.nullif(F.trim(name), F.lit("")).alias(name), F.nullif(F.trim(text), F.lit("")).alias(text))
    return rows.where(F.col(name).isNotNull()).groupBy(name).agg(F.min(text).alias(text))


def undescribed_columns(table: DataFrame, legend: DataFrame, name: str = "column") -> list[str]:
    """Columns of a clinical table that its legend does not name."""
    return sorted(set(table.columns) - {r[name] for r in legend.select(name).where(F.col(name).isin(table.columns)).collect()})
