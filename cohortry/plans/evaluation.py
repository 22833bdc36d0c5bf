"""Evaluation of model runs: metrics, leaderboard, shortlist, thresholds, paired bootstrap, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import bootstrap, dq, leaderboard, metrics
from .common import r6, rounded, table

MODELS = ["alpha", "beta"]
SEED, REPLICATES = 20260921, 5000
#: Run name -> probability of a document, in both engines.
SCORES = {
    "clinical_logreg": "(n_chars % 97) / 96.0D",
    "alpha_whole_phase1_logreg": "(n_chars % 13) / 12.0D",
    "alpha_expert_roi_phase1_image_clinical_logreg": "((n_chars * 7) % 31) / 30.0D",
    "beta_whole_all_dce_fusion_logreg": "((n_chars * 5 + doc_id) % 101) / 100.0D",
    "beta_expert_roi_phase2_image_clinical_logreg": "(doc_id % 17) / 16.0D",
}
PREDS_SQL = "WITH preds AS (" + " UNION ALL ".join(
    f"SELECT '{run}' AS run_name, doc_id AS patient_id, lang AS dataset, quality AS label, {score.replace('0D', '0::DOUBLE')} AS prob"
    " FROM labels JOIN documents USING (doc_id) WHERE quality IS NOT NULL" for run, score in SCORES.items()
) + ")"


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per run and document: five stated scores against the quality label, cohorts by language."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    rows = table(spark, sf_dir, "labels").where("quality is not null").join(docs, "doc_id")
    runs = F.array(*[F.struct(F.lit(n).alias("run_name"), F.expr(s).alias("prob")) for n, s in SCORES.items()])
    rows = rows.withColumn("r", F.explode(runs))
    return rows.select("r.run_name", F.col("doc_id").alias("patient_id"), F.col("lang").alias("dataset"), F.col("quality").alias("label"), "r.prob")


DOUBLES = ["prevalence", "log_loss", "accuracy", "balanced_accuracy", "precision", "recall", "specificity", "f1"]


def metrics_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.threshold_metrics(predictions(spark, sf_dir), ["run_name"]), *DOUBLES)


def _metrics_sql(keys: str, source: str = "preds") -> str:
    return f"""
counts AS (
  SELECT {keys},
    count(*) FILTER (label = 1 AND prob >= 0.5) AS tp, count(*) FILTER (label = 0 AND prob >= 0.5) AS fp,
    count(*) FILTER (label = 1 AND prob < 0.5) AS fn, count(*) FILTER (label = 0 AND prob < 0.5) AS tn,
    avg(-ln(CASE WHEN label = 1 THEN greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob))
                 ELSE 1 - greatest(2.220446049250313e-16, least(1 - 2.220446049250313e-16, prob)) END)) AS log_loss
  FROM {source} GROUP BY {keys}
)"""


_METRIC_COLUMNS = """
  tp + fp + fn + tn AS n, tp + fn AS n_pos, tn + fp AS n_neg, round((tp + fn) / (tp + fp + fn + tn), 6) AS prevalence,
  round(log_loss, 6) AS log_loss, round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy,
  round(CASE WHEN tp + fn = 0 THEN tn / (tn + fp) WHEN tn + fp = 0 THEN tp / (tp + fn)
        ELSE (tp / (tp + fn) + tn / (tn + fp)) / 2 END, 6) AS balanced_accuracy,
  round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp / (tp + fn) END, 6) AS recall,
  round(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) END, 6) AS specificity,
  round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  tn, fp, fn, tp, tn + fn AS pred_neg, tp + fp AS pred_pos"""


def _ranking_sql(keys: str, source: str = "preds", weight: str = "1") -> str:
    return f"""
scores AS (
  SELECT {keys}, prob, sum(CASE WHEN label = 1 THEN {weight} ELSE 0 END) AS pos, sum(CASE WHEN label = 0 THEN {weight} ELSE 0 END) AS neg
  FROM {source} GROUP BY {keys}, prob
), running AS (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp FROM scores
  WINDOW w AS (PARTITION BY {keys} ORDER BY prob DESC ROWS UNBOUNDED PRECEDING)
), ranking AS (
  SELECT {keys},
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(neg * (tp - pos / 2)) / (sum(pos) * sum(neg)))::DOUBLE END AS auroc,
    CASE WHEN sum(pos) > 0 AND sum(neg) > 0 THEN (sum(CASE WHEN pos > 0 THEN pos * tp / (tp + fp) ELSE 0 END) / sum(pos))::DOUBLE END AS average_precision
  FROM running GROUP BY {keys}
)"""


METRICS_BY_RUN_SQL = f"{PREDS_SQL}, {_metrics_sql('run_name')} SELECT run_name, {_METRIC_COLUMNS} FROM counts"


def auroc_ap_by_run(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.ranking_metrics(predictions(spark, sf_dir), ["run_name"]), "auroc", "average_precision")


AUROC_SQL = f"{PREDS_SQL}, {_ranking_sql('run_name')} SELECT run_name, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM ranking"


def metrics_by_run_and_cohort(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ["run_name", "dataset"]
    found = metrics.all_metrics(metrics.with_overall(predictions(spark, sf_dir)), keys)
    return rounded(found, *DOUBLES, "auroc", "average_precision")


COHORT_SQL = f"""{PREDS_SQL}, wide AS (SELECT * FROM preds UNION ALL SELECT run_name, patient_id, 'all', label, prob FROM preds),
{_metrics_sql('run_name, dataset', 'wide')}, {_ranking_sql('run_name, dataset', 'wide')}
SELECT run_name, dataset, {_METRIC_COLUMNS}, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision
FROM counts JOIN ranking USING (run_name, dataset)"""


def cohort_composition(spark: SparkSession, sf_dir: str) -> DataFrame:
    preds = predictions(spark, sf_dir).where(F.col("run_name") == leaderboard.BASELINE)
    return rounded(metrics.cohort_composition(metrics.with_overall(preds), ["dataset"]), "prevalence")


COMPOSITION_SQL = f"""{PREDS_SQL}, one AS (SELECT * FROM preds WHERE run_name = 'clinical_logreg'),
wide AS (SELECT dataset, label FROM one UNION ALL SELECT 'all', label FROM one)
SELECT dataset, count(*) AS n, sum(label)::BIGINT AS n_pos, (count(*) - sum(label))::BIGINT AS n_neg, round(avg(label), 6) AS prevalence FROM wide GROUP BY dataset"""


def ensemble_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    mean = metrics.mean_ensemble(predictions(spark, sf_dir)).withColumn("prob", r6("prob", 9))
    found = metrics.ranking_metrics(mean, ["run_name"])
    return rounded(found, "auroc", "average_precision", places=4)


ENSEMBLE_SQL = f"""{PREDS_SQL}, ens AS (SELECT 'average_ensemble' AS run_name, patient_id, dataset, label, round(avg(prob), 9) AS prob FROM preds GROUP BY ALL),
{_ranking_sql('run_name', 'ens')} SELECT run_name, round(auroc, 4) AS auroc, round(average_precision, 4) AS average_precision FROM ranking"""


def threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(metrics.best_threshold(predictions(spark, sf_dir), ["run_name"]), "threshold", "balanced_accuracy")


THRESHOLD_SQL = f"""{PREDS_SQL}, grid AS (SELECT i * 0.002::DOUBLE AS threshold FROM range(501) t(i)),
scored AS (
  SELECT run_name, threshold,
    (count(*) FILTER (label = 1 AND prob >= threshold) / count(*) FILTER (label = 1)
     + count(*) FILTER (label = 0 AND prob < threshold) / count(*) FILTER (label = 0)) / 2 AS balanced_accuracy
  FROM preds, grid GROUP BY run_name, threshold
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY run_name ORDER BY balanced_accuracy DESC, (threshold = 0.5)::INT DESC, threshold) AS r FROM scored
)
SELECT run_name, round(threshold, 6) AS threshold, round(balanced_accuracy, 6) AS balanced_accuracy FROM ranked WHERE r = 1"""


def _board(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = metrics.all_metrics(predictions(spark, sf_dir), ["run_name"]).select("run_name", "auroc", "average_precision", "balanced_accuracy")
    return leaderboard.comparison_table(rounded(found, "auroc", "average_precision", "balanced_accuracy"), MODELS)


def leaderboard_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.best_by_metric(_board(spark, sf_dir))


_BOARD_SQL = f"""{PREDS_SQL}, {_metrics_sql('run_name')}, {_ranking_sql('run_name')},
measured AS (
  SELECT run_name, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision, round((tp / (tp + fn) + tn / (tn + fp)) / 2, 6) AS balanced_accuracy
  FROM counts JOIN ranking USING (run_name)
), board AS (
  SELECT m.*, p.model, p.crop, p.input, p.benchmark_group, p.place FROM measured m JOIN (VALUES
    ('clinical_logreg', 'clinical', 'N/A', 'clinical', 'Clinical-only', 1),
    ('alpha_whole_phase1_logreg', 'alpha', 'Whole volume', 'phase1', 'Image-only', 2),
    ('alpha_expert_roi_phase1_image_clinical_logreg', 'alpha', 'Expert ROI', 'phase1', 'Image + clinical', 3),
    ('beta_whole_all_dce_fusion_logreg', 'beta', 'Whole volume', 'all_dce_fusion', 'Image-only', 4),
    ('beta_expert_roi_phase2_image_clinical_logreg', 'beta', 'Expert ROI', 'phase2', 'Image + clinical', 5)
  ) p(run_name, model, crop, input, benchmark_group, place) USING (run_name)
)"""
LEADERBOARD_SQL = f"""{_BOARD_SQL}, long AS (
  SELECT place, run_name, model, benchmark_group, unnest(['auroc', 'average_precision', 'balanced_accuracy']) AS metric,
         unnest([auroc, average_precision, balanced_accuracy]) AS value FROM board
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, benchmark_group, metric ORDER BY value DESC NULLS LAST, place) AS a,
            row_number() OVER (PARTITION BY benchmark_group, metric ORDER BY value DESC NULLS LAST, place) AS b FROM long
)
SELECT 'model' AS scope, benchmark_group, metric, model, run_name, value FROM ranked WHERE a = 1
UNION ALL SELECT 'overall', benchmark_group, metric, model, run_name, value FROM ranked WHERE b = 1"""


def shortlist_reasons(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaderboard.shortlist(_board(spark, sf_dir)).select("run_name", "model", "benchmark_group", "crop", "input", "selection_reason")


SHORTLIST_SQL = f"""{_BOARD_SQL}, reasons AS (
  SELECT run_name, 0 AS part, '' AS k1, '' AS k2, 'Clinical-only reference' AS reason FROM board WHERE run_name = 'clinical_logreg'
  UNION ALL SELECT run_name, 1, model, benchmark_group, 'Exploratory per-model ' || benchmark_group || ' AUROC winner' FROM (
    SELECT *, row_number() OVER (PARTITION BY model, benchmark_group ORDER BY auroc DESC, run_name) AS r FROM board WHERE benchmark_group <> 'Clinical-only') WHERE r = 1
  UNION ALL SELECT run_name, CASE WHEN benchmark_group = 'Image-only' THEN 2 ELSE 3 END, k, '', 'Exploratory overall ' || benchmark_group || ' ' || label || ' winner' FROM (
    SELECT *, row_number() OVER (PARTITION BY benchmark_group, k ORDER BY v DESC, run_name) AS r FROM (
      SELECT *, unnest(['0', '1', '2']) AS k, unnest(['AUROC', 'AP', 'balanced accuracy']) AS label, unnest([auroc, average_precision, balanced_accuracy]) AS v
      FROM board WHERE benchmark_group <> 'Clinical-only')) WHERE r = 1
)
SELECT run_name, model, benchmark_group, crop, input, string_agg(reason, '; ' ORDER BY part, k1, k2) AS selection_reason
FROM reasons JOIN board USING (run_name) GROUP BY run_name, model, benchmark_group, crop, input"""


def _subjects(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("run_name") == leaderboard.BASELINE).select("patient_id", "dataset", "label")


def bootstrap_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = bootstrap.draw_weights(_subjects(predictions(spark, sf_dir)), REPLICATES, SEED)
    return drawn.select("replicate", "patient_id", "weight")


WEIGHTS_SQL = f"""{PREDS_SQL}, subjects AS (SELECT patient_id, dataset, label FROM preds WHERE run_name = 'clinical_logreg'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY ('0x' || substr(md5('{SEED}|' || patient_id), 1, 8))::BIGINT, patient_id) - 1 AS slot, count(*) OVER (PARTITION BY dataset, label) AS size FROM subjects
), drawn AS (
  SELECT b AS replicate, dataset, label, ('0x' || substr(md5('{SEED}|' || b || '|' || dataset || '|' || label || '|' || slot), 1, 8))::BIGINT % size AS slot
  FROM ranked, range({REPLICATES}) t(b)
), weights AS (
  SELECT d.replicate, r.patient_id, count(*) AS weight FROM drawn d JOIN ranked r USING (dataset, label, slot) GROUP BY d.replicate, r.patient_id
)"""
BOOTSTRAP_WEIGHTS_SQL = f"{WEIGHTS_SQL} SELECT replicate::INTEGER AS replicate, patient_id, weight FROM weights"


def _replicates(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    preds = predictions(spark, sf_dir)
    draws = bootstrap.draw_blocks(_subjects(preds), REPLICATES, SEED)
    points = metrics.all_metrics(preds, ["run_name"]).select("run_name", *bootstrap.VALUES)
    return preds, bootstrap.replicate_metrics(preds, draws, ["run_name"]), points


def bootstrap_intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, replicates, points = _replicates(spark, sf_dir)
    return rounded(bootstrap.intervals(replicates, points, ["run_name"]), "value", "low", "high", places=5)


def bootstrap_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, replicates, points = _replicates(spark, sf_dir)
    return rounded(bootstrap.paired_deltas(replicates, points, leaderboard.BASELINE), "delta", "low", "high", "share_above", places=5)


_REPLICATE_SQL = f"""{WEIGHTS_SQL}, weighted AS (SELECT p.*, w.replicate, w.weight FROM preds p JOIN weights w USING (patient_id)
  UNION ALL SELECT p.*, -1, 1 FROM preds p),
{_ranking_sql('run_name, replicate', 'weighted', 'weight')}, balanced AS (
  SELECT run_name, replicate,
    (coalesce(sum(weight) FILTER (label = 1 AND prob >= 0.5), 0) / sum(weight) FILTER (label = 1)
     + coalesce(sum(weight) FILTER (label = 0 AND prob < 0.5), 0) / sum(weight) FILTER (label = 0)) / 2 AS ba
  FROM weighted GROUP BY run_name, replicate
), long AS (
  SELECT run_name, replicate, unnest(['auroc', 'average_precision', 'balanced_accuracy']) AS metric, unnest([auroc, average_precision, ba::DOUBLE]) AS value
  FROM ranking JOIN balanced USING (run_name, replicate)
)"""
INTERVALS_SQL = f"""{_REPLICATE_SQL} SELECT run_name, metric, round(max(value) FILTER (replicate = -1), 5) AS value,
  round(quantile_cont(value, 0.025) FILTER (replicate >= 0), 5) AS low, round(quantile_cont(value, 0.975) FILTER (replicate >= 0), 5) AS high
FROM long GROUP BY run_name, metric"""
DELTAS_SQL = f"""{_REPLICATE_SQL}, deltas AS (
  SELECT a.run_name, a.metric, a.replicate, a.value - b.value AS d FROM long a JOIN long b USING (metric, replicate)
  WHERE b.run_name = 'clinical_logreg' AND a.run_name <> 'clinical_logreg'
)
SELECT run_name, metric, round(max(d) FILTER (replicate = -1), 5) AS delta, round(quantile_cont(d, 0.025) FILTER (replicate >= 0), 5) AS low,
  round(quantile_cont(d, 0.975) FILTER (replicate >= 0), 5) AS high, round(avg((d > 0)::INT) FILTER (replicate >= 0), 5) AS share_above
FROM deltas GROUP BY run_name, metric"""


COHORT_SEED = 20260922


def _cohort_subjects(preds: DataFrame) -> DataFrame:
    return preds.where(F.col("run_name") == leaderboard.BASELINE).select("patient_id", "dataset", "label")


def _with_solo(preds: DataFrame) -> DataFrame:
    """Positives of every eleventh document are a cohort of one class."""
    return preds.withColumn("dataset", F.when((F.col("patient_id") % 11 == 0) & (F.col("label") == 1), "solo").otherwise(F.col("dataset")))


def cohort_bootstrap_deltas(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs against the baseline within each cohort: strata are classes, each cohort draws by a seed of its own; a cohort of one class is left out."""
    preds = _with_solo(predictions(spark, sf_dir))
    drawn = bootstrap.draw_blocks(bootstrap.with_both_classes(_cohort_subjects(preds)), REPLICATES, COHORT_SEED, cohort="dataset")
    keys = ["run_name", "dataset"]
    points = metrics.all_metrics(preds, keys).select(*keys, *bootstrap.VALUES)
    found = bootstrap.paired_deltas(bootstrap.replicate_metrics(preds, drawn, keys), points, leaderboard.BASELINE, ["dataset"])
    return rounded(found, "delta", "low", "high", "share_above", places=5)


_SOLO_SQL = "preds0 AS (SELECT run_name, patient_id, CASE WHEN patient_id % 11 = 0 AND label = 1 THEN 'solo' ELSE dataset END AS dataset, label, prob FROM preds)"
COHORT_DELTAS_SQL = f"""{PREDS_SQL}, {_SOLO_SQL}, fine AS (SELECT dataset FROM preds0 WHERE run_name = 'clinical_logreg' GROUP BY dataset HAVING count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0),
p AS (SELECT * FROM preds0 WHERE dataset IN (SELECT dataset FROM fine)), subjects AS (SELECT patient_id, dataset, label FROM p WHERE run_name = 'clinical_logreg'),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY dataset, label ORDER BY ('0x' || substr(md5('{COHORT_SEED}|' || patient_id), 1, 8))::BIGINT, patient_id) - 1 AS slot, count(*) OVER (PARTITION BY dataset, label) AS size,
    ('0x' || substr(md5('{COHORT_SEED}|' || dataset), 1, 8))::BIGINT AS child FROM subjects
), drawn AS (
  SELECT b AS replicate, dataset, label, ('0x' || substr(md5(child || '|' || b || '|' || dataset || '|' || label || '|' || slot), 1, 8))::BIGINT % size AS slot FROM ranked, range({REPLICATES}) t(b)
), weights AS (SELECT d.replicate, r.patient_id, count(*) AS weight FROM drawn d JOIN ranked r USING (dataset, label, slot) GROUP BY d.replicate, r.patient_id),
weighted AS (SELECT p.*, w.replicate, w.weight FROM p JOIN weights w USING (patient_id) UNION ALL SELECT p.*, -1, 1 FROM p),
{_ranking_sql('run_name, dataset, replicate', 'weighted', 'weight')}, balanced AS (
  SELECT run_name, dataset, replicate,
    (coalesce(sum(weight) FILTER (label = 1 AND prob >= 0.5), 0) / sum(weight) FILTER (label = 1) + coalesce(sum(weight) FILTER (label = 0 AND prob < 0.5), 0) / sum(weight) FILTER (label = 0)) / 2 AS ba
  FROM weighted GROUP BY run_name, dataset, replicate
), long AS (
  SELECT run_name, dataset, replicate, unnest(['auroc', 'average_precision', 'balanced_accuracy']) AS metric, unnest([auroc, average_precision, ba::DOUBLE]) AS value FROM ranking JOIN balanced USING (run_name, dataset, replicate)
), deltas AS (
  SELECT a.run_name, a.dataset, a.metric, a.replicate, a.value - b.value AS d FROM long a JOIN long b USING (dataset, metric, replicate) WHERE b.run_name = 'clinical_logreg' AND a.run_name <> 'clinical_logreg'
)
SELECT run_name, dataset, metric, round(max(d) FILTER (replicate = -1), 5) AS delta, round(quantile_cont(d, 0.025) FILTER (replicate >= 0), 5) AS low,
  round(quantile_cont(d, 0.975) FILTER (replicate >= 0), 5) AS high, round(avg((d > 0)::INT) FILTER (replicate >= 0), 5) AS share_above FROM deltas GROUP BY run_name, dataset, metric"""


def cohort_draw_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Classes of each cohort, and whether it can be resampled."""
    return bootstrap.cohort_classes(_cohort_subjects(_with_solo(predictions(spark, sf_dir))))


COHORT_STATUS_SQL = f"""{PREDS_SQL}, {_SOLO_SQL} SELECT dataset, count(*) AS n, count(*) FILTER (label = 1) AS n_pos, count(*) FILTER (label = 0) AS n_neg,
  CASE WHEN count(*) FILTER (label = 1) > 0 AND count(*) FILTER (label = 0) > 0 THEN 'drawn' ELSE 'one_class_only' END AS draw_status FROM preds0 WHERE run_name = 'clinical_logreg' GROUP BY dataset"""

_CROSS, _INPUTS = "gamma_cross", ["phase0", "last_phase_minus_phase0", "selected_fusion", "all_dce_fusion", "own_input", "phase0_phase1_last"]


def run_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run names spelled from the parts' numbers, read back: model, crop, input and its label, feature set and group; names that do not parse are null."""
    n = F.col("p_partkey")
    pick = lambda words, by: F.element_at(F.array(*map(F.lit, words)), (by % len(words) + 1).cast("int"))
    spelt = F.concat(pick(["alpha", "beta", _CROSS, "unknown"], n), F.lit("_"), pick(["whole", "expert_roi", "half"], F.floor(n / 4)), F.lit("_"), pick(_INPUTS, F.floor(n / 12)), pick(["_logreg", "_image_clinical_logreg", "_svm"], F.floor(n / 72)))
    runs = table(spark, sf_dir, "part").select("p_partkey", F.when(n % 97 == 0, leaderboard.BASELINE).otherwise(spelt).alias("run_name"))
    return runs.select("p_partkey", "run_name", leaderboard.parse_run_name(F.col("run_name"), [*MODELS, _CROSS], (_CROSS,)).alias("r")).select("p_partkey", "run_name", "r.*")


_PLAIN_LABELS = ", ".join(f"'{leaderboard.INPUT_LABELS.get(i, i)}'" for i in _INPUTS)
RUN_NAMES_SQL = f"""WITH p AS (SELECT p_partkey, p_partkey % 97 = 0 AS base, ['alpha', 'beta', '{_CROSS}', 'unknown'][p_partkey % 4 + 1] AS m, ['whole', 'expert_roi', 'half'][p_partkey // 4 % 3 + 1] AS c,
  [{", ".join(f"'{i}'" for i in _INPUTS)}][p_partkey // 12 % 6 + 1] AS i, [{_PLAIN_LABELS}][p_partkey // 12 % 6 + 1] AS label, ['_logreg', '_image_clinical_logreg', '_svm'][p_partkey // 72 % 3 + 1] AS e FROM part),
f AS (SELECT *, NOT base AND m <> 'unknown' AND c <> 'half' AND e <> '_svm' AS fits, e = '_image_clinical_logreg' AS clinical, m = '{_CROSS}' AS other FROM p)
SELECT p_partkey, CASE WHEN base THEN 'clinical_logreg' ELSE m || '_' || c || '_' || i || e END AS run_name, CASE WHEN base THEN 'clinical' WHEN fits THEN m END AS model,
  CASE WHEN base THEN 'N/A' WHEN fits AND c = 'whole' THEN 'Whole volume' WHEN fits THEN 'Expert ROI' END AS crop, CASE WHEN base THEN 'clinical' WHEN fits THEN i END AS input, CASE WHEN base THEN true WHEN fits THEN clinical END AS has_clinical,
  CASE WHEN base THEN 'Clinical-only' WHEN fits AND other THEN 'Cross-modality stress test' WHEN fits AND clinical THEN 'Image + clinical' WHEN fits THEN 'Image-only' END AS benchmark_group,
  CASE WHEN base THEN 'Clinical-only' WHEN fits AND other AND clinical THEN 'Cross-modality image + clinical' WHEN fits AND other THEN 'Cross-modality image-only' WHEN fits AND clinical THEN 'Image + clinical'
    WHEN fits AND i LIKE '%fusion%' THEN 'Image-only fused embeddings' WHEN fits THEN 'Image-only' END AS feature_set,
  CASE WHEN base THEN 'Clinical variables' WHEN fits AND c = 'whole' AND i = 'selected_fusion' THEN 'Selected phase fusion' WHEN fits THEN label END AS input_label FROM f"""


def interval_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of the report, of values rounded before."""
    found = bootstrap_intervals(spark, sf_dir)
    return found.select("run_name", "metric", metrics.interval_text(*[F.round(c, 3) for c in ("value", "low", "high")]).alias("cell"))


INTERVAL_TEXTS_SQL = f"""SELECT run_name, metric, printf('%.3f [%.3f, %.3f]', round(value, 3), round(low, 3), round(high, 3)) AS cell FROM ({INTERVALS_SQL})"""


def align_predictions_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The baseline against runs from which some rows were taken, and some labels changed."""
    preds = predictions(spark, sf_dir)
    hurt = preds.where("run_name = 'clinical_logreg' or not (run_name like 'alpha%' and patient_id % 10 = 0)")
    hurt = hurt.withColumn("label", F.when(F.expr("run_name like 'beta_whole%' and patient_id % 25 = 0"), 1 - F.col("label")).otherwise(F.col("label")))
    found = dq.misaligned_predictions(hurt, leaderboard.BASELINE, [r for r in SCORES if r != leaderboard.BASELINE])
    return found.groupBy("run_name", "problem").agg(F.count(F.lit(1)).alias("n"), F.min("patient_id").alias("first_id"))


ALIGN_SQL = f"""{PREDS_SQL}
SELECT run_name, 'missing' AS problem, count(*) AS n, min(patient_id) AS first_id FROM preds WHERE run_name LIKE 'alpha%' AND patient_id % 10 = 0 GROUP BY run_name
UNION ALL SELECT run_name, 'label', count(*), min(patient_id) FROM preds WHERE run_name LIKE 'beta_whole%' AND patient_id % 25 = 0 GROUP BY run_name"""


def prediction_rules_dq(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts, duplicate keys and one-class cohorts of each run, in one table."""
    preds = predictions(spark, sf_dir).withColumn("prob", F.col("prob") * 1.25)
    rules = dq.rule_counts(preds, dq.prediction_rules(), ["run_name"])
    twice = dq.duplicate_keys(preds.select("run_name", "dataset", "prob"), ["run_name", "dataset", "prob"]).groupBy("run_name").agg(F.count(F.lit(1)).alias("duplicate_keys"))
    single = dq.one_class_keys(preds, ["run_name", "prob"]).groupBy("run_name").agg(F.count(F.lit(1)).alias("one_class_scores"))
    return rules.join(twice, "run_name", "left").join(single, "run_name", "left").na.fill(0)


PREDICTION_RULES_SQL = f"""{PREDS_SQL}, p AS (SELECT * REPLACE (prob * 1.25 AS prob) FROM preds),
rules AS (SELECT run_name, count(*) FILTER (label NOT IN (0, 1)) AS bad_label, count(*) FILTER (prob < 0 OR prob > 1) AS bad_prob FROM p GROUP BY run_name),
twice AS (SELECT run_name, count(*) AS duplicate_keys FROM (SELECT run_name, dataset, prob FROM p GROUP BY ALL HAVING count(*) > 1) GROUP BY run_name),
single AS (SELECT run_name, count(*) AS one_class_scores FROM (SELECT run_name, prob FROM p GROUP BY ALL HAVING min(label) = max(label)) GROUP BY run_name)
SELECT run_name, bad_label, bad_prob, coalesce(duplicate_keys, 0) AS duplicate_keys, coalesce(one_class_scores, 0) AS one_class_scores
FROM rules LEFT JOIN twice USING (run_name) LEFT JOIN single USING (run_name)"""


def consistency_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Recomputed metrics against a board of which one run was altered."""
    points = metrics.all_metrics(predictions(spark, sf_dir), ["run_name"]).select("run_name", *bootstrap.VALUES)
    board = points.withColumn("auroc", F.when(F.col("run_name").startswith("beta_whole"), F.col("auroc") + 0.001).otherwise(F.col("auroc")))
    return bootstrap.consistency_gaps(points, board).select("run_name", "metric", r6(F.col("theirs") - F.col("ours")).alias("gap"))


CONSISTENCY_SQL = "SELECT 'beta_whole_all_dce_fusion_logreg' AS run_name, 'auroc' AS metric, 0.001::DOUBLE AS gap"


def semi_join_subset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metrics of the runs on the subjects that another table shares."""
    ids = table(spark, sf_dir, "labels").where("toxic = 0").select(F.col("doc_id").alias("patient_id"))
    shared = predictions(spark, sf_dir).join(ids.distinct(), "patient_id", "left_semi")
    return rounded(metrics.ranking_metrics(shared, ["run_name"]), "auroc", "average_precision")


SEMI_SQL = f"""{PREDS_SQL}, sub AS (SELECT * FROM preds WHERE patient_id IN (SELECT doc_id FROM labels WHERE toxic = 0)),
{_ranking_sql('run_name', 'sub')} SELECT run_name, round(auroc, 6) AS auroc, round(average_precision, 6) AS average_precision FROM ranking"""


def best_epoch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Supplier = run, rows in order = epochs; a third of the runs lacks AUROC, a third lacks the loss too."""
    lines = table(spark, sf_dir, "lineitem")
    history = lines.groupBy(F.col("l_suppkey").alias("run"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("epoch")).agg(
        F.max(F.expr("case when l_suppkey % 3 = 0 then l_discount end")).alias("val_auroc"), F.max(F.expr("case when l_suppkey % 3 <> 2 then l_quantity end")).alias("val_loss")
    )
    return leaderboard.best_epoch(history)


BEST_EPOCH_SQL = """
WITH h AS (
  SELECT l_suppkey AS run, l_orderkey * 10 + l_linenumber AS epoch, max(CASE WHEN l_suppkey % 3 = 0 THEN l_discount END) AS val_auroc,
         max(CASE WHEN l_suppkey % 3 <> 2 THEN l_quantity END) AS val_loss FROM lineitem GROUP BY ALL
), r AS (
  SELECT *, CASE WHEN count(val_auroc) OVER p > 0 THEN 'auroc' WHEN count(val_loss) OVER p > 0 THEN 'loss' ELSE 'last' END AS rule FROM h WINDOW p AS (PARTITION BY run)
), n AS (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY CASE rule WHEN 'auroc' THEN -val_auroc WHEN 'loss' THEN val_loss END NULLS LAST,
    CASE WHEN rule = 'last' THEN -epoch ELSE epoch END) AS k FROM r
)
SELECT run, epoch, val_auroc, val_loss, rule FROM n WHERE k = 1"""

QUERIES = {
    "metrics_by_run": metrics_by_run, "auroc_ap_by_run": auroc_ap_by_run, "metrics_by_run_and_cohort": metrics_by_run_and_cohort,
    "cohort_composition": cohort_composition, "ensemble_metrics": ensemble_metrics, "threshold_search": threshold_search,
    "leaderboard_best": leaderboard_best, "shortlist_reasons": shortlist_reasons, "bootstrap_weights": bootstrap_weights,
    "bootstrap_intervals": bootstrap_intervals, "bootstrap_deltas": bootstrap_deltas, "interval_texts": interval_texts,
    "align_predictions_dq": align_predictions_dq, "prediction_rules_dq": prediction_rules_dq, "consistency_gate": consistency_gate,
    "semi_join_subset": semi_join_subset, "best_epoch": best_epoch,
    "cohort_bootstrap_deltas": cohort_bootstrap_deltas, "cohort_draw_status": cohort_draw_status, "run_names": run_names,
}
ORACLE_SQL = {
    "metrics_by_run": METRICS_BY_RUN_SQL, "auroc_ap_by_run": AUROC_SQL, "metrics_by_run_and_cohort": COHORT_SQL,
    "cohort_composition": COMPOSITION_SQL, "ensemble_metrics": ENSEMBLE_SQL, "threshold_search": THRESHOLD_SQL,
    "leaderboard_best": LEADERBOARD_SQL, "shortlist_reasons": SHORTLIST_SQL, "bootstrap_weights": BOOTSTRAP_WEIGHTS_SQL,
    "bootstrap_intervals": INTERVALS_SQL, "bootstrap_deltas": DELTAS_SQL, "interval_texts": INTERVAL_TEXTS_SQL,
    "align_predictions_dq": ALIGN_SQL, "prediction_rules_dq": PREDICTION_RULES_SQL, "consistency_gate": CONSISTENCY_SQL,
    "semi_join_subset": SEMI_SQL, "best_epoch": BEST_EPOCH_SQL,
    "cohort_bootstrap_deltas": COHORT_DELTAS_SQL, "cohort_draw_status": COHORT_STATUS_SQL, "run_names": RUN_NAMES_SQL,
}
