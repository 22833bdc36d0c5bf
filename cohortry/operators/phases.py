"""Splitting a series' files into acquisition phases, and choosing among the splits.

Input: one row a file with ``series``, ``ord`` (file order), ``t`` (time number or null) and ``proj`` (position
along the slice normal or null). Every split returns ``series``, ``ord``, ``phase`` (from 0); a rule that does not
apply to a series gives no rows for it. All windows are within a series.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Priority of a split where size and balance tie.
PRIORITY = {"as_is": 0, "consecutive": 1, "reset": 2, "grouped": 3}


def consecutive_split(files: DataFrame, gap: float) -> DataFrame:
    """A new phase where this file's time and the one just before differ by ``gap`` or more; null times never start one."""
    order = Window.partitionBy("series").orderBy("ord")
    jump = F.coalesce((F.abs(F.col("t") - F.lag("t").over(order)) >= gap).cast("int"), F.lit(0))
    return files.withColumn("jump", jump).select("series", "ord", F.sum("jump").over(order).cast("int").alias("phase"))


def reorder_by_time(files: DataFrame, split: DataFrame) -> DataFrame:
    """The phases of a split in the order of their least time; phases without time last, in their old order."""
    timed = split.join(files.select("series", "ord", "t"), ["series", "ord"])
    starts = timed.groupBy("series", "phase").agg(F.min("t").alias("start"))
    rank = F.row_number().over(Window.partitionBy("series").orderBy(F.asc_nulls_last("start"), "phase")) - 1
    return split.join(starts.select("series", "phase", rank.cast("int").alias("new")), ["series", "phase"]).select("series", "ord", F.col("new").alias("phase"))


def grouped_split(files: DataFrame, gap: float) -> DataFrame:
    """Distinct times, cut where neighbours differ by ``gap`` or more; nothing for a series with any missing time."""
    order = Window.partitionBy("series").orderBy("t")
    times = files.groupBy("series", "t").agg(F.count(F.lit(1)).alias("n"))
    full = files.groupBy("series").agg(F.count_if(F.col("t").isNull()).alias("missing")).where("missing = 0").select("series")
    jump = F.coalesce((F.col("t") - F.lag("t").over(order) >= gap).cast("int"), F.lit(0))
    marked = times.join(full, "series", "left_semi").withColumn("jump", jump)
    clusters = marked.select("series", "t", F.sum("jump").over(order).cast("int").alias("phase"))
    return files.select("series", "ord", "t").join(clusters, ["series", "t"]).select("series", "ord", "phase")


def reset_split(files: DataFrame, tolerance: float = 1e-3) -> DataFrame:
    """A new phase where the position runs backwards against the series' usual direction.

    Nothing for a series with a missing position, with one phase, with a phase under two files, or with phase
    sizes more than two apart.
    """
    order = Window.partitionBy("series").orderBy("ord")
    step = F.col("proj") - F.lag("proj").over(order)
    steps = files.select("series", "ord", "proj").withColumn("step", step)
    moves = F.median(F.when(F.abs("step") > tolerance, F.col("step")))
    usual = steps.groupBy("series").agg(moves.alias("usual"), F.count_if(F.col("proj").isNull()).alias("missing")).where("missing = 0 and usual is not null")
    usual = usual.select("series", F.when(F.col("usual") >= 0, 1.0).otherwise(-1.0).alias("direction"))
    back = F.coalesce((F.col("direction") * F.col("step") < -tolerance).cast("int"), F.lit(0))
    split = steps.join(usual, "series").withColumn("back", back).select("series", "ord", F.sum("back").over(order).cast("int").alias("phase"))
    sizes = split.groupBy("series", "phase").agg(F.count(F.lit(1)).alias("size"))
    fine = sizes.groupBy("series").agg(F.count(F.lit(1)).alias("phases"), F.min("size").alias("low"), F.max("size").alias("high"))
    return split.join(fine.where("phases > 1 and low >= 2 and high - low <= 2").select("series"), "series", "left_semi")


def all_splits(files: DataFrame, gap: float, tolerance: float = 1e-3) -> DataFrame:
    """The four splits, named by ``kind``."""
    as_is = files.select("series", "ord", F.lit(0).alias("phase"))
    splits = {"as_is": as_is, "grouped": grouped_split(files, gap), "reset": reset_split(files, tolerance), "consecutive": consecutive_split(files, gap)}
    out = None
    for kind, split in splits.items():
        named = split.select("series", "ord", "phase", F.lit(kind).alias("kind"))
        out = named if out is None else out.unionByName(named)
    return out


def choose_split(files: DataFrame, gap: float, tolerance: float = 1e-3) -> DataFrame:
    """``series``, ``kind``, ``n_phases``, ``balance``: plausible splits first, then most phases, best balance, priority.

    Plausible: every phase has two files or more, and one phase or a balance (least over greatest size) of 0.5.
    """
    sizes = all_splits(files, gap, tolerance).groupBy("series", "kind", "phase").agg(F.count(F.lit(1)).alias("size"))
    rated = sizes.groupBy("series", "kind").agg(
        F.count(F.lit(1)).alias("n_phases"), F.min("size").alias("least"), (F.min("size") / F.max("size")).alias("balance")
    )
    plausible = (F.col("least") >= 2) & ((F.col("n_phases") == 1) | (F.col("balance") >= 0.5))
    priority = F.coalesce(*[F.when(F.col("kind") == k, p) for k, p in PRIORITY.items()])
    best = Window.partitionBy("series").orderBy(F.desc(plausible.cast("int")), F.desc("n_phases"), F.desc("balance"), F.desc(priority))
    return rated.withColumn("r", F.row_number().over(best)).where("r = 1").select("series", "kind", "n_phases", "balance")


def exam_phase_index(candidates: DataFrame, exam: list[str], series_order: list, inner: str = "phase") -> DataFrame:
    """``phase_index`` within an exam: phases of the ordered series one after the other."""
    rank = Window.partitionBy(*exam).orderBy(*series_order, inner)
    return candidates.withColumn("phase_index", (F.dense_rank().over(rank) - 1).cast("int"))


def neighbour_spacing(files: DataFrame, fallback: list[str]) -> DataFrame:
    """``spacing`` of each series: median of the non-zero steps between sorted positions, else the first fallback known."""
    order = Window.partitionBy("series").orderBy("proj")
    steps = files.withColumn("step", F.abs(F.col("proj") - F.lag("proj").over(order)))
    known = [F.max(c).alias(c) for c in fallback]
    found = steps.groupBy("series").agg(F.median(F.when(F.col("step") > 1e-8, F.col("step"))).alias("median_step"), *known)
    return found.select("series", F.coalesce("median_step", *fallback).alias("spacing"))
