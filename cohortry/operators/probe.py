"""Regularized logistic probes on Spark ML: grid over C, threshold on validation rows, refit, leave-one-cohort-out."""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import dq, features, metrics, status

#: The inverse penalties that are tried.
C_GRID = [0.001, 0.003, 0.01, 0.03, 0.1, 0.3, 1.0, 3.0, 10.0]


def join_embeddings(manifest: DataFrame, embeddings: DataFrame, key: str = "patient_id") -> DataFrame:
    """One-to-one inner join; repeated keys and null or NaN features are errors."""
    dq.require_empty(dq.duplicate_keys(manifest, [key]), "repeated manifest keys")
    dq.require_empty(dq.duplicate_keys(embeddings, [key]), "repeated embedding keys")
    dq.require_empty(dq.bad_vectors(embeddings).select(key), "null or NaN features")
    return manifest.join(embeddings, key)


def scale_vectors(train: DataFrame, rows: DataFrame, column: str = "embedding") -> DataFrame:
    """``rows`` with ``features``: population z-scores fitted on ``train``, constant positions 0."""
    each = train.select(F.posexplode(column).alias("pos", "v"))
    fitted = each.groupBy("pos").agg(F.avg("v").alias("mean"), F.stddev_pop("v").alias("std"))
    # one row a position: the width of the embedding
    known = {r["pos"]: (r["mean"], r["std"]) for r in fitted.collect()}
    mean, std = (F.array(*[F.lit(float(known[k][i])) for k in sorted(known)]) for i in (0, 1))
    z = F.transform(F.arrays_zip(F.col(column).alias("v"), mean.alias("m"), std.alias("s")), lambda x: F.when(x["s"] > 0, (x["v"] - x["m"]) / x["s"]).otherwise(0.0))
    return rows.withColumn("features", array_to_vector(z))


def fit_probe(train: DataFrame, c: float, max_iter: int = 200, tol: float = 1e-8) -> LogisticRegressionModel:
    """L2 logistic regression with balanced classes; regParam = 1 / (C * sum of weights), and the weights sum to n."""
    weighted = features.balanced_weights(train.select("features", "label"))
    n = train.count()
    solver = LogisticRegression(regParam=1.0 / (c * n), elasticNetParam=0.0, standardization=False, weightCol="weight", maxIter=max_iter, tol=tol)
    return solver.fit(weighted)


def score(model: LogisticRegressionModel, rows: DataFrame) -> DataFrame:
    return model.transform(rows).withColumn("prob", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def run_probe(rows: DataFrame, grid: list[float] | None = None, fraction: float = 0.2, seed: int = 2026, key: str = "patient_id") -> tuple[DataFrame, dict]:
    """Choose C by validation average precision (AUROC, then grid order break ties) and the threshold by balanced
    accuracy on the same rows; refit on all training rows. Returns scored test rows and the choice.

    ``rows``: ``key``, ``split`` (train, test), ``label``, ``features``. The grid is a loop of at most nine fits.
    """
    train = status.stratified_split(rows.where("split = 'train'"), fraction, seed, key).cache()
    fit, held = train.where("fold = 'train'"), train.where("fold = 'validation'")
    tried = []
    for place, c in enumerate(grid or C_GRID):
        found = score(fit_probe(fit, c), held).withColumn("c", F.lit(c))
        m = metrics.ranking_metrics(found, ["c"]).first()
        tried.append((-(m["average_precision"] or 0.0), -(m["auroc"] or 0.0), place, c))
    best = min(tried)[3]
    cut = metrics.best_threshold(score(fit_probe(fit, best), held).withColumn("c", F.lit(best)), ["c"]).first()["threshold"]
    model = fit_probe(train, best)
    test = score(model, rows.where("split = 'test'")).withColumn("pred_label", metrics.predicted_label(F.col("prob"), F.lit(cut)))
    train.unpersist()
    return test.drop("features"), {"c": best, "threshold": cut, "coefficients": model.coefficients.toArray().tolist(), "intercept": model.intercept}


def coefficient_table(spark, names: list[str], coefficients: list[float]) -> DataFrame:
    """Coefficients by absolute size; one row a feature."""
    return spark.createDataFrame(list(zip(names, coefficients, strict=True)), "feature string, coefficient double").orderBy(F.desc(F.abs("coefficient")), "feature")


def leave_one_cohort_out(rows: DataFrame, cohorts: list[str], c: float = 0.1) -> DataFrame:
    """Metrics of each cohort under a probe fitted on all the others."""
    out = None
    for cohort in cohorts:
        model = fit_probe(rows.where(F.col("dataset") != cohort), c)
        part = score(model, rows.where(F.col("dataset") == cohort)).select("dataset", "label", "prob")
        out = part if out is None else out.unionByName(part)
    return metrics.all_metrics(out, ["dataset"])
