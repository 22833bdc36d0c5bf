"""Metrics of prediction tables: threshold metrics, ranking metrics, thresholds, intervals.

A prediction table has one row per key and subject: ``label`` 0/1 and ``prob``, and for resampling a ``weight``.
Nothing here is keyed by a cohort before partial aggregation, and no window spans more than one score bucket of
one key, so one run with very many predictions is spread like many small ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Clipping of probabilities in the log loss: the spacing of doubles at 1.
EPSILON = 2.220446049250313e-16
#: First-level buckets of the score range in running sums.
BUCKETS = 1024


def predicted_label(prob: Column, threshold: Column | float) -> Column:
    """1 where the probability reaches the threshold."""
    return (prob >= threshold).cast("int")


def _divide(top: Column, bottom: Column, default: Column) -> Column:
    return F.when(bottom != 0, top / bottom).otherwise(default)


def threshold_metrics(preds: DataFrame, keys: list[str], threshold: float | str = 0.5) -> DataFrame:
    """Confusion counts and what follows from them, for each key; ``threshold`` is a number or a column.

    Precision, recall and F1 are 0 on division by zero; specificity is null without negatives; balanced accuracy
    averages the recalls of the classes that occur.
    """
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    hit, y = predicted_label(F.col("prob"), cut), F.col("label")
    weight = F.col("weight") if "weight" in preds.columns else F.lit(1)
    clipped = F.greatest(F.lit(EPSILON), F.least(F.lit(1 - EPSILON), F.col("prob")))
    loss = -F.log(F.when(y == 1, clipped).otherwise(1 - clipped))
    total = lambda c: F.coalesce(F.sum(F.when(c, weight)), F.lit(0)).cast("long")
    counts = preds.groupBy(*keys).agg(
        total((y == 1) & (hit == 1)).alias("tp"), total((y == 0) & (hit == 1)).alias("fp"),
        total((y == 1) & (hit == 0)).alias("fn"), total((y == 0) & (hit == 0)).alias("tn"),
        (F.sum(loss * weight) / F.sum(weight)).alias("log_loss"),
    )
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    none, zero = F.lit(None).cast("double"), F.lit(0.0)
    recall, specificity = _divide(tp, tp + fn, none), _divide(tn, tn + fp, none)
    return counts.select(
        *keys,
        (tp + fp + fn + tn).alias("n"), (tp + fn).alias("n_pos"), (tn + fp).alias("n_neg"),
        _divide(tp + fn, tp + fp + fn + tn, none).alias("prevalence"),
        "log_loss",
        _divide(tp + tn, tp + fp + fn + tn, none).alias("accuracy"),
        (F.when(recall.isNull(), specificity).when(specificity.isNull(), recall).otherwise((recall + specificity) / 2)).alias("balanced_accuracy"),
        _divide(tp, tp + fp, zero).alias("precision"), _divide(tp, tp + fn, zero).alias("recall"),
        specificity.alias("specificity"), _divide(2 * tp, 2 * tp + fp + fn, zero).alias("f1"),
        "tn", "fp", "fn", "tp", (tn + fn).alias("pred_neg"), (tp + fp).alias("pred_pos"),
    )


def score_table(preds: DataFrame, keys: list[str], score: str = "prob") -> DataFrame:
    """Distinct scores of each key with (weighted) positives and negatives."""
    weight = F.col("weight") if "weight" in preds.columns else F.lit(1)
    return preds.groupBy(*keys, F.col(score).alias("score")).agg(
        F.coalesce(F.sum(F.when(F.col("label") == 1, weight)), F.lit(0)).cast("long").alias("pos"),
        F.coalesce(F.sum(F.when(F.col("label") == 0, weight)), F.lit(0)).cast("long").alias("neg"),
    )


def running_counts(scores: DataFrame, keys: list[str], low: float = 0.0, high: float = 1.0) -> DataFrame:
    """``scores`` with ``tp`` and ``fp``: sums over this score and all higher ones of the key.

    Two levels: totals of score buckets are summed over the buckets of a key (``BUCKETS`` rows at most), and
    scores are summed within their own bucket only.
    """
    share = (F.col("score") - low) / (high - low) * BUCKETS
    placed = scores.withColumn("bucket", F.least(F.lit(BUCKETS - 1), F.greatest(F.lit(0), F.floor(share))).cast("int"))
    totals = placed.groupBy(*keys, "bucket").agg(F.sum("pos").alias("bucket_pos"), F.sum("neg").alias("bucket_neg"))
    above = Window.partitionBy(*keys).orderBy(F.desc("bucket")).rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.select(
        *keys, "bucket",
        F.coalesce(F.sum("bucket_pos").over(above), F.lit(0)).alias("pos_above"),
        F.coalesce(F.sum("bucket_neg").over(above), F.lit(0)).alias("neg_above"),
    )
    within = Window.partitionBy(*keys, "bucket").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)
    own = placed.withColumn("tp_in", F.sum("pos").over(within)).withColumn("fp_in", F.sum("neg").over(within))
    both = own.join(totals, [*keys, "bucket"])
    return both.select(*keys, "score", "pos", "neg", (F.col("tp_in") + F.col("pos_above")).alias("tp"), (F.col("fp_in") + F.col("neg_above")).alias("fp"))


def ranking_metrics(preds: DataFrame, keys: list[str]) -> DataFrame:
    """``auroc`` (ties count half) and ``average_precision`` of each key; null if a class is missing."""
    ranked = running_counts(score_table(preds, keys), keys)
    sums = ranked.groupBy(*keys).agg(
        F.sum(F.col("neg") * (F.col("tp") - F.col("pos") / 2)).alias("area"),
        F.sum(F.when(F.col("pos") > 0, F.col("pos") * F.col("tp") / (F.col("tp") + F.col("fp"))).otherwise(0.0)).alias("steps"),
        F.sum("pos").alias("p"), F.sum("neg").alias("n"),
    )
    both = (F.col("p") > 0) & (F.col("n") > 0)
    return sums.select(
        *keys,
        F.when(both, F.col("area") / (F.col("p") * F.col("n"))).alias("auroc"),
        F.when(both, F.col("steps") / F.col("p")).alias("average_precision"),
    )


def all_metrics(preds: DataFrame, keys: list[str], threshold: float | str = 0.5) -> DataFrame:
    return threshold_metrics(preds, keys, threshold).join(ranking_metrics(preds, keys), keys)


def with_overall(preds: DataFrame, subset: str = "dataset", overall: str = "all") -> DataFrame:
    """Each row once for its subset and once for all rows together."""
    return preds.withColumn(subset, F.explode(F.array(F.lit(overall), F.col(subset))))


def cohort_composition(preds: DataFrame, keys: list[str]) -> DataFrame:
    """Size, positives, negatives and prevalence."""
    return preds.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"), F.sum("label").cast("long").alias("n_pos"),
        (F.count(F.lit(1)) - F.sum("label")).cast("long").alias("n_neg"), F.avg("label").alias("prevalence"),
    )


def mean_ensemble(preds: DataFrame, name: str = "average_ensemble", subject: str = "patient_id") -> DataFrame:
    """A run of its own: the mean probability of all runs for each subject."""
    same = [c for c in preds.columns if c not in ("run_name", "prob")]
    grouped = preds.groupBy(*same).agg(F.avg("prob").alias("prob"))
    return grouped.select(F.lit(name).alias("run_name"), *same, "prob")


def best_threshold(preds: DataFrame, keys: list[str], grid: int = 501) -> DataFrame:
    """``threshold`` with the highest balanced accuracy and that ``balanced_accuracy``.

    Candidates are 0.5 and ``i * step`` for i from 0; 0.5 stays unless a strictly better one exists, of equals the
    lowest wins. Rows are counted once by the highest candidate that they reach; the grid is all that is ranked.
    """
    step = 1.0 / (grid - 1)
    guess = F.greatest(F.lit(0), F.least(F.lit(grid - 1), F.floor(F.col("prob") / step))).cast("int")
    reach = F.when((guess + 1 < grid) & ((guess + 1) * F.lit(step) <= F.col("prob")), guess + 1)
    reach = reach.when(guess * F.lit(step) <= F.col("prob"), guess).otherwise(guess - 1)
    counts = preds.groupBy(*keys, reach.alias("i")).agg(
        F.sum("label").cast("long").alias("pos"), F.sum(1 - F.col("label")).cast("long").alias("neg")
    )
    # a handful of rows for each key: the grid, its counts, and running sums over it
    candidates = counts.select(*keys).distinct().withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
    full = candidates.withColumn("threshold", F.col("i") * F.lit(step)).join(counts, [*keys, "i"], "left")
    at_least = Window.partitionBy(*keys).orderBy(F.desc("i")).rowsBetween(Window.unboundedPreceding, 0)
    total = counts.groupBy(*keys).agg(F.sum("pos").alias("p"), F.sum("neg").alias("n"))
    ranked = full.select(
        *keys, "threshold",
        F.coalesce(F.sum("pos").over(at_least), F.lit(0)).alias("tp"), F.coalesce(F.sum("neg").over(at_least), F.lit(0)).alias("fp"),
    ).join(total, keys)
    recall, specificity = _divide(F.col("tp"), F.col("p"), F.lit(None).cast("double")), _divide(F.col("n") - F.col("fp"), F.col("n"), F.lit(None).cast("double"))
    score = F.when(recall.isNull(), specificity).when(specificity.isNull(), recall).otherwise((recall + specificity) / 2)
    order = Window.partitionBy(*keys).orderBy(F.desc("balanced_accuracy"), F.desc((F.col("threshold") == 0.5).cast("int")), "threshold")
    chosen = ranked.select(*keys, "threshold", score.alias("balanced_accuracy")).withColumn("place", F.row_number().over(order))
    return chosen.where("place = 1").drop("place")


def percentile_interval(replicates: DataFrame, keys: list[str], value: str, alpha: float = 0.05) -> DataFrame:
    """``low``, ``high``: percentiles alpha/2 and 1 - alpha/2 with linear interpolation."""
    ends = F.percentile(F.col(value), F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    return replicates.groupBy(*keys).agg(ends.alias("ends")).select(*keys, F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"))


def interval_text(value: Column, low: Column, high: Column) -> Column:
    """``0.735 [0.681, 0.786]``."""
    return F.format_string("%.3f [%.3f, %.3f]", value.cast("double"), low.cast("double"), high.cast("double"))
