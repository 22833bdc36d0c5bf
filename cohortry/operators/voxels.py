"""Volumes: comparisons of dense arrays by column expressions, of long voxel tables by aggregates, and encoders over slices.

A dense volume is an array of doubles in x-major order with a known shape; see ``shapes`` for measures over long voxels.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantiles, spread


def crop(volume: Column, shape: tuple[int, int, int], start: tuple[int, int, int], end: tuple[int, int, int]) -> Column:
    """The box from ``start`` to ``end`` (exclusive), in the same order."""
    _, ny, nz = shape
    return F.filter(
        volume,
        lambda v, i: (F.floor(i / (ny * nz)).between(start[0], end[0] - 1)) & ((F.floor(i / nz) % ny).between(start[1], end[1] - 1)) & ((i % nz).between(start[2], end[2] - 1)),
    )


def subtract(post: Column, base: Column) -> Column:
    """post - base, null if the lengths differ."""
    return F.when(F.size(post) == F.size(base), F.zip_with(post, base, lambda a, b: a - b))


def _sum(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, v: s + v)


def rescale(volume: Column, low: Column, high: Column) -> Column:
    """Clip to [low, high] and map to [0, 1]; constant or non-finite becomes 0."""
    return F.transform(volume, lambda v: F.when((high > low) & ~F.isnan(v), (F.least(F.greatest(v, low), high) - low) / (high - low)).otherwise(0.0))


def _finite(v: Column) -> Column:
    return v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf"))


MOMENTS = ("n", "a", "b", "aa", "bb", "ab")


def moments(a: Column, b: Column) -> Column:
    """struct(n, a, b, aa, bb, ab): count and sums of the places where both volumes are finite, in one pass; null with unequal lengths."""
    zero = F.struct(*[F.lit(0.0).alias(m) for m in MOMENTS])

    def add(s: Column, p: Column) -> Column:
        x, y = p["a"], p["b"]
        more = (F.lit(1.0), x, y, x * x, y * y, x * y)
        return F.when(_finite(x) & _finite(y), F.struct(*[(s[m] + v).alias(m) for m, v in zip(MOMENTS, more, strict=True)])).otherwise(s)

    return F.when(F.size(a) == F.size(b), F.aggregate(F.arrays_zip(a.alias("a"), b.alias("b")), zero, add))


def correlation_of(m: Column, least: int = 16) -> Column:
    """Pearson correlation from ``moments`` (bind them to a column first); null under ``least`` places, and with a constant side."""
    n = F.greatest(m["n"], F.lit(1.0))
    a, b = m["aa"] - m["a"] * m["a"] / n, m["bb"] - m["b"] * m["b"] / n
    return F.when((m["n"] >= least) & (a > 1e-12) & (b > 1e-12), (m["ab"] - m["a"] * m["b"] / n) / F.sqrt(a * b))


def nrmse_of(m: Column) -> Column:
    """Root mean squared difference of the z-scored volumes, from their ``moments``; null if one is constant."""
    r = correlation_of(m, 1)
    return F.when(r < 1, F.sqrt(2 - 2 * r)).when(r >= 1, 0.0)


def correlation(a: Column, b: Column, least: int = 16) -> Column:
    """Pearson correlation of the places where both are finite; null under ``least`` of them, with unequal lengths, or with
    a constant side."""
    return F.transform(F.array(moments(a, b)), lambda m: correlation_of(m, least))[0]


def nrmse(a: Column, b: Column) -> Column:
    """Root mean squared difference of the z-scored volumes where both are finite, from their correlation; null if one
    is constant there."""
    return F.transform(F.array(moments(a, b)), nrmse_of)[0]


def pair_statistics(pairs: DataFrame, keys: list[str], a: str = "a", b: str = "b", least: int = 16) -> DataFrame:
    """``keys``, ``n``, ``corr``, ``nrmse`` of long pairs of voxels: the same for volumes of any size, by co-moments that tasks merge."""
    both = _finite(F.col(a)) & _finite(F.col(b))
    x, y = F.when(both, F.col(a).cast("double")), F.when(both, F.col(b).cast("double"))
    found = pairs.groupBy(*keys).agg(F.count(x).alias("n"), F.covar_pop(x, y).alias("c"), F.var_pop(x).alias("va"), F.var_pop(y).alias("vb"))
    r = F.when((F.col("va") * F.col("n") > 1e-12) & (F.col("vb") * F.col("n") > 1e-12), F.col("c") / F.sqrt(F.col("va") * F.col("vb")))
    return found.select(*keys, "n", F.when(F.col("n") >= least, r).alias("corr"), F.when(r < 1, F.sqrt(2 - 2 * r)).when(r >= 1, 0.0).alias("nrmse"))


def with_percentile_bounds(voxels: DataFrame, keys: list[str], value: str = "v", low: float = 1.0, high: float = 99.0, small: int = quantiles.SMALL) -> DataFrame:
    """Long voxels with ``low`` and ``high``, the exact percentiles of each volume's finite values, for ``rescale``; null where it has none.

    A volume of any size is narrowed down by histograms, and the voxels of one that holds much of the table meet its bounds in many tasks.
    """
    finite = voxels.where(F.col(value).isNotNull() & ~F.isnan(value) & (F.abs(F.col(value)) < float("inf")))
    found = spread.saved(quantiles.exact_quantiles(finite, keys, [low / 100, high / 100], value, small))
    ends = found.select(*keys, F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))
    return spread.spread_join(voxels.drop("low", "high"), ends, keys, spread.heavy_keys(found, keys, "n"), [c for c in voxels.columns if c not in keys], "left")


def max_projections(voxels: DataFrame) -> DataFrame:
    """Largest value along each axis of a long voxel table (volume_id, x, y, z, v): ``axis``, ``i``, ``j``, ``v``."""
    planes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(i).alias("i"), F.col(j).alias("j")) for a, i, j in (("x", "y", "z"), ("y", "x", "z"), ("z", "x", "y"))])
    return voxels.select("volume_id", F.explode(planes).alias("p"), "v").groupBy("volume_id", "p.axis", "p.i", "p.j").agg(F.max("v").alias("v"))


def fingerprint(shape: Column, dtype: Column, data: Column) -> Column:
    """SHA-1 over shape, type and bytes."""
    return F.sha1(F.concat(F.array_join(shape.cast("array<string>"), "x").cast("binary"), F.lit("|").cast("binary"), dtype.cast("binary"), F.lit("|").cast("binary"), data))


def mutual_information(pairs: DataFrame, key: str, bins: int = 48, least: int = 32) -> DataFrame:
    """2 I(a, b) / (H(a) + H(b)) as ``nmi`` in [0, 1] of long pairs (key, a, b), clipped to [0, 1].

    Pairs that are not finite on both sides are left out; null under ``least`` pairs, and where both sides are constant.
    """
    fine = lambda c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    place = lambda c: F.least(F.lit(bins - 1), F.floor(F.least(F.greatest(F.col(c), F.lit(0.0)), F.lit(1.0)) * bins).cast("int"))
    both = fine("a") & fine("b")
    cells = pairs.groupBy(key, F.when(both, place("a")).alias("i"), F.when(both, place("b")).alias("j")).agg(F.count(F.lit(1)).alias("n"))
    # a cell counts in its row, in its column and by itself; that of the pairs left out counts nowhere
    kinds = F.array(*[F.struct(F.lit(name).alias("kind"), i.alias("i"), j.alias("j")) for name, i, j in (("a", F.col("i"), F.lit(-1)), ("b", F.lit(-1), F.col("j")), ("ab", F.col("i"), F.col("j")))])
    sums = cells.select(key, F.col("i").isNotNull().alias("in"), "n", F.explode(kinds).alias("c")).groupBy(key, "in", "c.kind", "c.i", "c.j").agg(F.sum("n").alias("n"))

    def entropy(kind: str) -> Column:
        n = F.when(F.col("in") & (F.col("kind") == kind), F.col("n"))
        return F.log(F.sum(n)) - F.sum(n * F.log(n)) / F.sum(n)

    found = sums.groupBy(key).agg(*[entropy(kind).alias(f"h{kind}") for kind in ("a", "b", "ab")], F.sum(F.when(F.col("in") & (F.col("kind") == "ab"), F.col("n"))).alias("n"))
    ha, hb = F.col("ha"), F.col("hb")
    return found.select(key, F.when(F.col(key).isNotNull() & (F.col("n") >= least) & (ha + hb > 1e-8), (ha + hb - F.col("hab")) * 2 / (ha + hb)).alias("nmi"))


def encode_slices(slices: DataFrame, make_encoder: Callable[[], Callable[[np.ndarray], np.ndarray]], key: list[str], column: str = "slice") -> DataFrame:
    """``key``, ``embedding``, ``error``: a frozen encoder over slices of one length, built once a task.

    A batch that fails is tried row by row, and a row that fails keeps its message: no row stops the job.
    """
    names = [*key, "embedding", "error"]
    schema = T.StructType([*(slices.schema[k] for k in key), T.StructField("embedding", T.ArrayType(T.DoubleType())), T.StructField("error", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encode = make_encoder()

        def one(v: np.ndarray) -> tuple:
            try:
                return encode(np.asarray(v, dtype=float)[None])[0].tolist(), None
            except Exception as e:  # noqa: BLE001  the row carries it
                return None, f"{type(e).__name__}: {e}"

        for batch in batches:
            try:
                found = [(v.tolist(), None) for v in encode(np.array([*batch[column]], dtype=float))]
            except Exception:  # noqa: BLE001  one bad row fails the whole batch
                found = [one(v) for v in batch[column]]
            out = batch[key].copy()
            out["embedding"], out["error"] = [f[0] for f in found], [f[1] for f in found]
            yield out[names]

    return slices.mapInPandas(run, schema)
