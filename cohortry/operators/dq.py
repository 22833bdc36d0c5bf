"""Data-quality checks: each returns the rows that break a rule; ``require_empty`` turns them into an error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class QualityError(ValueError):
    """A table breaks a rule."""


def require_empty(violations: DataFrame, what: str) -> None:
    """Raise with a few examples if there is any row."""
    found = violations.take(5)
    if found:
        raise QualityError(f"{what}: {[r.asDict() for r in found]}")


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = sorted(set(columns) - set(df.columns))
    if missing:
        raise QualityError(f"missing columns: {missing}")
    return df


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys on more than one row, with ``n``."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def rule_counts(df: DataFrame, rules: dict[str, Column], keys: list[str] | None = None) -> DataFrame:
    """Rows that break each rule (a null verdict breaks it), in one pass."""
    return df.groupBy(*(keys or [])).agg(*[F.count_if(~F.coalesce(ok, F.lit(False))).alias(name) for name, ok in rules.items()])


def prediction_rules() -> dict[str, Column]:
    return {"bad_label": F.col("label").isin(0, 1), "bad_prob": F.col("prob").between(0, 1)}


def not_contained(part: DataFrame, whole: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``part`` whose key ``whole`` lacks."""
    return part.join(whole.select(*keys).distinct(), keys, "left_anti")


def misaligned_predictions(preds: DataFrame, reference: str, runs: list[str], subject: str = "patient_id") -> DataFrame:
    """Subjects of ``runs`` that differ from the reference run: missing, extra, another label or another dataset."""
    base = preds.where(F.col("run_name") == reference).select(subject, F.col("label").alias("base_label"), F.col("dataset").alias("base_dataset"))
    wanted = base.withColumn("run_name", F.explode(F.array(*[F.lit(r) for r in runs]))).withColumn("there", F.lit(True))
    own = preds.where(F.col("run_name").isin(runs)).select("run_name", subject, "label", "dataset", F.lit(True).alias("here"))
    both = own.join(wanted, ["run_name", subject], "full")
    problem = (
        F.when(F.col("here").isNull(), "missing").when(F.col("there").isNull(), "extra")
        .when(~F.col("label").eqNullSafe(F.col("base_label")), "label").when(~F.col("dataset").eqNullSafe(F.col("base_dataset")), "dataset")
    )
    return both.select("run_name", subject, problem.alias("problem")).where("problem is not null")


def bad_vectors(df: DataFrame, column: str = "embedding") -> DataFrame:
    """Rows whose vector is null, or holds null or NaN."""
    return df.where(F.col(column).isNull() | F.exists(column, lambda x: x.isNull() | F.isnan(x)))


def one_class_keys(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Keys whose rows lack one of the two classes."""
    return preds.groupBy(*keys).agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low = high or low is null")


def baseline_count(runs: DataFrame, baseline: str) -> int:
    """How many rows carry the baseline's name; 1 is expected."""
    return runs.where(F.col("run_name") == baseline).count()
