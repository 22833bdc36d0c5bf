"""Masks as sparse voxel tables (volume_id, x, y, z of set voxels): statistics, overlap, summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def mask_statistics(voxels: DataFrame, ml_per_voxel: float) -> DataFrame:
    """Count, millilitres, centre and bounding box (end exclusive) of each volume's mask."""
    axes = [c for a in "xyz" for c in (F.avg(a).alias(f"c{a}"), F.min(a).alias(f"lo_{a}"), (F.max(a) + 1).alias(f"hi_{a}"))]
    return voxels.groupBy("volume_id").agg(F.count(F.lit(1)).alias("voxels"), (F.count(F.lit(1)) * ml_per_voxel).alias("ml"), *axes)


def busiest_slice(voxels: DataFrame, volumes: DataFrame, depth: str = "depth") -> DataFrame:
    """The z with most set voxels (lowest of equals), else the middle slice."""
    counts = voxels.groupBy("volume_id", "z").agg(F.count(F.lit(1)).alias("n"))
    best = counts.groupBy("volume_id").agg(F.max_by("z", F.struct("n", -F.col("z"))).alias("best"))
    return volumes.join(best, "volume_id", "left").select("volume_id", F.coalesce("best", F.floor(F.col(depth) / 2).cast("int")).alias("slice"))


def mask_overlap(predicted: DataFrame, label: DataFrame) -> DataFrame:
    """Sizes, ``dice`` (1 if both are empty), ``overlaps`` and ``ratio`` for each volume of either table.

    Volumes with an empty mask appear if they have a row with null coordinates.
    """
    at = ["volume_id", "x", "y", "z"]
    p = predicted.select(*at, F.when(F.col("x").isNotNull(), 1).alias("p"))
    q = label.select(*at, F.when(F.col("x").isNotNull(), 1).alias("q"))
    both = p.join(q, at, "full").groupBy("volume_id").agg(
        F.count("p").alias("n_pred"), F.count("q").alias("n_label"), F.count_if(F.col("p").isNotNull() & F.col("q").isNotNull()).alias("n_both")
    )
    total = F.col("n_pred") + F.col("n_label")
    return both.select(
        "*", F.when(total == 0, 1.0).otherwise(2 * F.col("n_both") / total).alias("dice"), (F.col("n_both") > 0).alias("overlaps"),
        (F.col("n_pred") / F.nullif(F.col("n_label"), F.lit(0))).alias("ratio"),
    )


def overlap_summary(cases: DataFrame, values: list[str], status: str = "status") -> DataFrame:
    """One row: cases by status and means and medians of finite values."""
    finite = lambda c: F.when(~F.isnan(c) & (F.abs(c) < float("inf")), F.col(c))
    aggs = [f(finite(c)).alias(f"{n}_{c}") for c in values for n, f in (("mean", F.avg), ("median", F.median))]
    return cases.agg(
        F.count(F.lit(1)).alias("cases"), F.count_if(F.col(status) != "ok").alias("not_ok"), F.avg(F.col("overlaps").cast("double")).alias("lesion_recall"), *aggs
    )


def dense_to_voxels(volumes: DataFrame, above: float, shape: tuple[int, int, int], column: str = "voxels") -> DataFrame:
    """Voxels over a threshold of arrays in x-major order; one row with null coordinates if there are none."""
    _, ny, nz = shape
    each = volumes.select("volume_id", F.posexplode_outer(F.filter(F.transform(column, lambda v, i: F.when(v > above, i)), lambda i: i.isNotNull())).alias("k", "i"))
    return each.select("volume_id", F.floor(F.col("i") / (ny * nz)).cast("int").alias("x"), (F.floor(F.col("i") / nz) % ny).cast("int").alias("y"), (F.col("i") % nz).cast("int").alias("z"))


