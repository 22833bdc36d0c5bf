"""Row numbers within few and large groups, without a group in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def md5_number(text: Column) -> Column:
    """The first 32 bits of the text's md5."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("bigint")


def seeded(seed: int, *columns: str) -> Column:
    """A number in [0, 2**32) from md5, the same in other engines."""
    return md5_number(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") for c in columns]))


def numbered_within(df: DataFrame, keys: list[str], number: Column, tie: str, name: str, bits: int = 10) -> DataFrame:
    """``df`` with ``name``: the row's place (from 1) in its group by ``number`` in [0, 2**32), then ``tie``.

    Groups may be few and hold most rows: rows are numbered within 2**``bits`` ranges of ``number``, and the sizes
    of the ranges before, a few rows a group, are added.
    """
    placed = df.withColumn("__n", number).withColumn("__b", F.shiftright("__n", 32 - bits).cast("int"))
    sizes = placed.groupBy(*keys, "__b").agg(F.count(F.lit(1)).alias("__size"))
    before = Window.partitionBy(*keys).orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select(*[F.col(k).alias(f"__{k}") for k in keys], F.col("__b").alias("__ob"), F.coalesce(F.sum("__size").over(before), F.lit(0)).alias("__offset"))
    within = Window.partitionBy(*keys, "__b").orderBy("__n", tie)
    own = placed.withColumn("__r", F.row_number().over(within))
    same = F.col("__b") == F.col("__ob")
    for k in keys:
        same &= own[k].eqNullSafe(offsets[f"__{k}"])
    return own.join(offsets, same).select(*[own[c] for c in df.columns], (F.col("__r") + F.col("__offset")).alias(name))
