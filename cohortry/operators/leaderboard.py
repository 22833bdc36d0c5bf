"""Run names, cross-model tables, winners and shortlists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Benchmark groups, the one of models trained on another modality, and feature sets.
GROUPS = ["Clinical-only", "Image-only", "Image + clinical"]
CROSS_GROUP = "Cross-modality stress test"
FEATURE_SETS = {"image": "Image-only", "clinical": "Image + clinical", "fused": "Image-only fused embeddings", "cross_image": "Cross-modality image-only", "cross_clinical": "Cross-modality image + clinical"}
#: Labels of inputs; others are shown as they are named.
INPUT_LABELS = {
    "phase0": "Phase 0",
    "phase1": "Phase 1",
    "phase2": "Phase 2",
    "last_phase": "Last phase",
    "phase1_minus_phase0": "Phase 1 - phase 0",
    "phase2_minus_phase0": "Phase 2 - phase 0",
    "last_phase_minus_phase0": "Last phase - phase 0",
    "raw_phases_fusion": "Raw phase fusion",
    "subtractions_fusion": "Subtraction fusion",
    "all_dce_fusion": "All DCE fusion",
    "selected_fusion": "Selected ROI fusion",
    "phase0_phase1_phase2": "Phase 0 + phase 1 + phase 2",
    "phase0_phase1_last": "Phase 0 + phase 1 + last phase",
    "phase0_phase2_last": "Phase 0 + phase 2 + last phase",
    "subtractions_phase1_phase2_last": "Subtraction triplet",
}
#: Label of a metric -> column.
METRICS = {"AUROC": "auroc", "AP": "average_precision", "balanced accuracy": "balanced_accuracy"}
BASELINE = "clinical_logreg"


def parse_run_name(name: Column, models: list[str], cross: tuple[str, ...] = ()) -> Column:
    """struct(model, crop, input, has_clinical, benchmark_group, feature_set, input_label) of ``model_crop_input[_image_clinical]_logreg``.

    ``clinical_logreg`` is the baseline. Models in ``cross`` were trained on another modality: a group and feature sets of their own.
    Null where the name does not parse; see ``unparsed_runs``.
    """
    pattern = rf"^({'|'.join(models)})_(whole|expert_roi)_(.+?)(_image_clinical)?_logreg$"
    part = lambda k: F.regexp_extract(name, pattern, k)
    clinical, other, whole = part(4) != "", part(1).isin(*cross) if cross else F.lit(False), part(2) == "whole"
    labels = F.create_map(*[F.lit(x) for pair in INPUT_LABELS.items() for x in pair])
    features = (
        F.when(other & clinical, FEATURE_SETS["cross_clinical"]).when(other, FEATURE_SETS["cross_image"]).when(clinical, FEATURE_SETS["clinical"])
        .when(F.contains(part(3), F.lit("fusion")), FEATURE_SETS["fused"]).otherwise(FEATURE_SETS["image"])
    )
    image = F.struct(
        part(1).alias("model"),
        F.when(whole, "Whole volume").otherwise("Expert ROI").alias("crop"),
        part(3).alias("input"),
        clinical.alias("has_clinical"),
        F.when(other, CROSS_GROUP).when(clinical, GROUPS[2]).otherwise(GROUPS[1]).alias("benchmark_group"),
        features.alias("feature_set"),
        F.when(whole & (part(3) == "selected_fusion"), "Selected phase fusion").otherwise(F.coalesce(F.try_element_at(labels, part(3)), part(3))).alias("input_label"),
    )
    base = F.struct(
        F.lit("clinical").alias("model"), F.lit("N/A").alias("crop"), F.lit("clinical").alias("input"), F.lit(True).alias("has_clinical"),
        F.lit(GROUPS[0]).alias("benchmark_group"), F.lit(GROUPS[0]).alias("feature_set"), F.lit("Clinical variables").alias("input_label"),
    )
    return F.when(name == BASELINE, base).when(name.rlike(pattern), image)


def comparison_table(runs: DataFrame, models: list[str], cross: tuple[str, ...] = ()) -> DataFrame:
    """``runs`` with the parsed columns and ``place``: a sort key of model, group, crop, input and run. Order by it."""
    parsed = runs.withColumn("__run", parse_run_name(F.col("run_name"), models, cross)).select("*", "__run.*").drop("__run")
    order = {m: k for k, m in enumerate(["clinical", *models])}
    rank = lambda column, values: F.coalesce(*[F.when(F.col(column) == v, k) for v, k in values.items()], F.lit(len(values)))
    keys = [rank("model", order), rank("benchmark_group", {g: k for k, g in enumerate([*GROUPS, CROSS_GROUP])}), rank("crop", {"N/A": 0, "Whole volume": 1, "Expert ROI": 2}), "input", "run_name"]
    named = [(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys)]
    return parsed.withColumn("place", F.struct(*named))


def unparsed_runs(runs: DataFrame, models: list[str]) -> DataFrame:
    return runs.where(parse_run_name(F.col("run_name"), models).isNull())


def best_by_metric(board: DataFrame) -> DataFrame:
    """``scope`` (model or overall), ``benchmark_group``, ``metric``, winner and value; ties to the leaderboard's order."""
    long = board.unpivot(["place", "run_name", "model", "benchmark_group"], list(METRICS.values()), "metric", "value")
    # the first of each scope is an aggregate, so a group of very many runs is combined before it is shuffled
    first = F.min(F.struct(F.col("value").isNull().alias("none"), (-F.col("value")).alias("v"), "place", "run_name", "model", "value")).alias("w")
    model = long.groupBy("benchmark_group", "metric", "model").agg(first).select(F.lit("model").alias("scope"), "benchmark_group", "metric", "w.model", "w.run_name", "w.value")
    overall = long.groupBy("benchmark_group", "metric").agg(first).select(F.lit("overall").alias("scope"), "benchmark_group", "metric", "w.model", "w.run_name", "w.value")
    return model.unionByName(overall)


def shortlist(board: DataFrame) -> DataFrame:
    """Baseline, AUROC winners of each model and group, and overall winners of each group, with their reasons in order."""
    primary = board.where(F.col("benchmark_group").isin(GROUPS[1:]))
    base = board.where(F.col("run_name") == BASELINE).select("run_name", F.lit(0).alias("part"), F.lit("").alias("k1"), F.lit("").alias("k2"), F.lit("Clinical-only reference").alias("reason"))
    best = lambda metric: F.min(F.struct(F.col(metric).isNull().alias("none"), (-F.col(metric)).alias("v"), "run_name"))["run_name"].alias("run_name")
    winners = primary.groupBy("model", "benchmark_group").agg(best("auroc"))
    winners = winners.select("run_name", F.lit(1).alias("part"), F.col("model").alias("k1"), F.col("benchmark_group").alias("k2"), F.format_string("Exploratory per-model %s AUROC winner", "benchmark_group").alias("reason"))
    reasons = base.unionByName(winners)
    tops = primary.groupBy("benchmark_group").agg(*[best(column).alias(column) for column in METRICS.values()])
    for k, (label, column) in enumerate(METRICS.items()):
        part = F.when(F.col("benchmark_group") == GROUPS[1], 2).otherwise(3)
        reasons = reasons.unionByName(
            tops.select(F.col(column).alias("run_name"), part.alias("part"), F.lit(str(k)).alias("k1"), F.lit("").alias("k2"), F.format_string(f"Exploratory overall %s {label} winner", "benchmark_group").alias("reason"))
        )
    listed = reasons.groupBy("run_name").agg(F.array_sort(F.collect_list(F.struct("part", "k1", "k2", "reason"))).alias("r"))
    listed = listed.select("run_name", F.array_join(F.array_distinct(F.col("r.reason")), "; ").alias("selection_reason"))
    rank = F.array_position(F.array(*[F.lit(g) for g in GROUPS]), F.col("benchmark_group"))
    return board.join(listed, "run_name").withColumn("group_order", rank)


def best_epoch(history: DataFrame, run: str = "run", epoch: str = "epoch", auroc: str = "val_auroc", loss: str = "val_loss") -> DataFrame:
    """The epoch of highest validation AUROC, else of least loss, else the last; ``rule`` tells which."""
    ranked = Window.partitionBy(run)
    order = Window.partitionBy(run).orderBy(
        F.when(F.col("rule") == "auroc", -F.col(auroc)).when(F.col("rule") == "loss", F.col(loss)).asc_nulls_last(),
        F.when(F.col("rule") == "last", -F.col(epoch)).otherwise(F.col(epoch)),
    )
    rule = F.when(F.count(auroc).over(ranked) > 0, "auroc").when(F.count(loss).over(ranked) > 0, "loss").otherwise("last")
    return history.withColumn("rule", rule).withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")
