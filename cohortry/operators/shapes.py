"""Shape and likeness measures of volumes as jobs over long voxel tables: ``volume_id``, ``x``, ``y``, ``z`` and a value.

Nothing here needs a volume in one place. Percentiles are narrowed down, correlations are merged co-moments, windows run along image rows and
columns, components are joins of neighbours, and distances to a surface are found along one axis after the other, a grid line a row.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import quantiles, spread, voxels

AXES = ("x", "y", "z")
PLACE = ["volume_id", *AXES]
Shape = tuple[int, int, int]


def long_voxels(volumes: DataFrame, column: str, shape: Shape, value: str = "v") -> DataFrame:
    """Dense arrays in x-major order as one row a voxel."""
    _, ny, nz = shape
    each = volumes.select("volume_id", F.posexplode(column).alias("i", value))
    return each.select("volume_id", F.floor(F.col("i") / (ny * nz)).cast("int").alias("x"), (F.floor(F.col("i") / nz) % ny).cast("int").alias("y"), (F.col("i") % nz).cast("int").alias("z"), value)


def robust_features(table: DataFrame, shape: Shape, value: str = "v") -> DataFrame:
    """Per volume: percentiles 1, 50, 99 (``low``, ``median``, ``high``); of the voxels above the middle of 1 and 99 their share ``foreground``,
    centre ``cx cy cz`` and extent ``ex ey ez`` as fractions of the shape. Without such voxels the centre is null, the extent 0."""
    found = spread.saved(quantiles.exact_quantiles(table, ["volume_id"], [0.01, 0.5, 0.99], value))
    q = F.col("quantiles")
    ends = found.select("volume_id", q[0].alias("low"), q[1].alias("median"), q[2].alias("high"))
    joined = spread.spread_join(table.select(*PLACE, F.col(value).alias("v")), ends, ["volume_id"], spread.heavy_keys(found, ["volume_id"], "n"), list(AXES))
    above = (F.col("high") > F.col("low")) & (F.col("v") > (F.col("low") + F.col("high")) / 2)
    where = {a: F.when(above, F.col(a)) for a in AXES}
    centre = [(F.avg(where[a]) / n).alias(f"c{a}") for a, n in zip(AXES, shape, strict=True)]
    extent = [F.coalesce((F.max(where[a]) - F.min(where[a]) + 1) / F.lit(float(n)), F.lit(0.0)).alias(f"e{a}") for a, n in zip(AXES, shape, strict=True)]
    keys = ["volume_id", "low", "median", "high"]
    return joined.groupBy(*keys).agg((F.count_if(above) / F.count(F.lit(1))).alias("foreground"), *centre, *extent)


#: Voxels of a volume whose orbits meet in one task.
SLAB = 1 << 16
#: Names of correlations, from the highest limit down.
LIKENESS = [("equivalent", 0.999), ("very_similar", 0.98), ("similar", 0.90)]


def orientation_match(left: DataFrame, right: DataFrame, shape: Shape) -> DataFrame:
    """Per volume of ``left`` the flip (and, where x and y are as long, swap) of ``right`` that fits it best: ``transform`` (``keep`` or ``swap`` and
    the flipped axes as bits), ``corr``, ``label``. ``none`` and null where a side is constant; of equals (to 1e-12) the first transform.

    The places that transforms take to each other (16 at most) are an orbit, and no transform leads out of it: each voxel moves once, to its
    orbit, and meets its partners of all transforms there. Orbits of a volume are dealt by slabs of some ``SLAB`` voxels, so a small volume's
    sums are made in one task and a large one's in many.
    """
    nx, ny, nz = shape
    swaps = (False, True) if nx == ny else (False,)
    fold = [F.least(F.col(a), F.lit(n - 1) - F.col(a)) for a, n in zip(AXES, shape, strict=True)]
    first, second = (F.least(*fold[:2]), F.greatest(*fold[:2])) if nx == ny else fold[:2]
    orbit = ((first * ny + second) * nz + fold[2]).cast("long")
    slabs = -(-nx * ny * nz // SLAB)
    sides = [side.where(_inside(shape)).select("volume_id", orbit.alias("orbit"), F.lit(k).alias("side"), _index(shape).alias("node"), F.col("v").cast("double").alias("v")) for k, side in enumerate((left, right))]
    dealt = sides[0].unionByName(sides[1]).withColumn("slab", F.pmod(F.xxhash64("orbit"), F.lit(slabs)).cast("int")).repartition("volume_id", "slab")
    held = [F.collect_list(F.when(F.col("side") == k, F.struct("node", "v"))).alias(name) for k, name in enumerate(("here", "there"))]
    orbits = dealt.groupBy("volume_id", "slab", "orbit").agg(*held)
    sent = orbits.select("volume_id", F.col("here"), F.explode("there").alias("q"))
    placed = []
    x, y, z = F.floor(F.col("q.node") / (ny * nz)), F.floor(F.col("q.node") / nz) % ny, F.col("q.node") % nz
    for order, (swap, bits) in enumerate((s, b) for s in swaps for b in range(8)):
        turned = [F.lit(n - 1) - c if bits >> k & 1 else c for k, (c, n) in enumerate(zip([y, x, z] if swap else [x, y, z], shape, strict=True))]
        node = ((turned[0] * ny + turned[1]) * nz + turned[2]).cast("long")
        placed.append(F.struct(F.lit(order).alias("order"), F.lit(f"{'swap' if swap else 'keep'}{bits}").alias("transform"), node.alias("to")))
    met = sent.select("volume_id", "here", F.col("q.v").alias("b"), F.explode(F.array(*placed)).alias("p"))
    met = met.select("volume_id", "p.order", "p.transform", "p.to", "b", F.explode("here").alias("e")).where("e.node = to")
    pairs = met.select("volume_id", "order", "transform", F.col("e.v").alias("a"), "b")
    found = voxels.pair_statistics(pairs, ["volume_id", "order", "transform"], least=1).where(F.col("corr").isNotNull())
    top = found.groupBy("volume_id").agg(F.max("corr").alias("top"))
    best = found.join(top, "volume_id").where(F.col("corr") > F.col("top") - 1e-12).groupBy("volume_id").agg(F.min(F.struct("order", "transform", "corr")).alias("best"))
    joined = left.select("volume_id").distinct().join(best, "volume_id", "left")
    corr = F.col("best.corr")
    label = reduce(lambda c, n: c.when(corr >= n[1], n[0]), LIKENESS[1:], F.when(corr >= LIKENESS[0][1], LIKENESS[0][0])).otherwise("different")
    return joined.select("volume_id", F.coalesce("best.transform", F.lit("none")).alias("transform"), corr.alias("corr"), label.alias("label"))


def projection_ssim(left: DataFrame, right: DataFrame, shape: Shape, window: int = 7) -> DataFrame:
    """``volume_id``, ``axis``, ``ssim``: structural similarity of both sides' largest projections, uniform windows, sample covariance, the range of
    both together; 1 where that is 0. Windows slide along rows, then along columns; an image may be of any size."""
    both = left.select(*PLACE, F.col("v").alias("a")).join(right.select(*PLACE, F.col("v").alias("b")), PLACE)
    planes = F.array(*[F.struct(F.lit(a).alias("axis"), F.col(i).alias("i"), F.col(j).alias("j"), F.lit(min(window, m, n)).alias("w"), F.lit(m).alias("rows"), F.lit(n).alias("columns")) for a, i, j, m, n in (("x", "y", "z", shape[1], shape[2]), ("y", "x", "z", shape[0], shape[2]), ("z", "x", "y", shape[0], shape[1]))])
    image = both.select("volume_id", F.explode(planes).alias("p"), "a", "b").groupBy("volume_id", "p.axis", "p.i", "p.j", "p.w", "p.rows", "p.columns").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    keys = ["volume_id", "axis"]
    span = image.groupBy(*keys).agg((F.greatest(F.max("a"), F.max("b")) - F.least(F.min("a"), F.min("b"))).alias("span"))
    sums = image.withColumns({"aa": F.col("a") * F.col("a"), "bb": F.col("b") * F.col("b"), "ab": F.col("a") * F.col("b")})
    parts = []
    for w in sorted({min(window, m, n) for m, n in ((shape[1], shape[2]), (shape[0], shape[2]), (shape[0], shape[1]))}):
        own = sums.where(F.col("w") == w)
        for line, at in ((["i"], "j"), (["j"], "i")):
            over = Window.partitionBy(*keys, *line).orderBy(at).rowsBetween(0, w - 1)
            own = own.withColumns({c: F.sum(c).over(over) for c in ("a", "b", "aa", "bb", "ab")}).where(F.col(at) <= F.col("columns" if at == "j" else "rows") - w)
        parts.append(own)
    n = F.col("w") * F.col("w")
    ma, mb = F.col("a") / n, F.col("b") / n
    fix = n / F.greatest(n - 1, F.lit(1))
    va, vb, vab = fix * (F.col("aa") / n - ma * ma), fix * (F.col("bb") / n - mb * mb), fix * (F.col("ab") / n - ma * mb)
    c1, c2 = F.pow(F.col("span") * 0.01, 2), F.pow(F.col("span") * 0.03, 2)
    value = F.when(F.col("span") <= 0, 1.0).otherwise(F.try_divide((2 * ma * mb + c1) * (2 * vab + c2), (ma * ma + mb * mb + c1) * (va + vb + c2)))
    return reduce(DataFrame.unionByName, parts).join(span, keys).groupBy(*keys).agg(F.avg(value).alias("ssim"))


def _index(shape: Shape) -> Column:
    return ((F.col("x") * shape[1] + F.col("y")) * shape[2] + F.col("z")).cast("long")


def _inside(shape: Shape) -> Column:
    return reduce(lambda c, a: c & F.col(a[0]).between(0, a[1] - 1), zip(AXES, shape, strict=True), F.lit(True))


def _moved(mask: DataFrame, steps: list[tuple[int, int, int]], *more: str) -> DataFrame:
    """Every voxel at each of its neighbours' places."""
    return mask.select("volume_id", *more, F.explode(F.array(*[F.struct(*[(F.col(a) + d).alias(a) for a, d in zip(AXES, step, strict=True)]) for step in steps])).alias("p")).select("volume_id", *more, "p.*")


def components(mask: DataFrame, shape: Shape) -> DataFrame:
    """``volume_id``, ``node`` (the voxel's place in x-major order), ``part`` (the smallest node of its 26-connected part) of every mask voxel.

    Hooking and jumping: each round every part joins the least part that it touches, hooks are followed to their ends, and edges are drawn anew
    between the parts that are left, each once, so that later rounds move few rows; a round is written, so a lost executor costs a
    round. It ends when no parts touch, in a number of rounds that grows with the logarithm of a part's length. No side of a join goes through
    the driver: saved tables of few columns are small as files and large as rows, so their joins are marked as merges.
    """
    own = spread.saved(mask.select(*PLACE).distinct().withColumn("node", _index(shape)))
    forward = [s for s in np.ndindex(3, 3, 3) if s > (1, 1, 1)]
    steps = [tuple(d - 1 for d in s) for s in forward]
    near = _moved(own, steps, "node").where(_inside(shape)).withColumn("other", _index(shape)).select("volume_id", F.col("node").alias("low"), F.col("other").alias("part"))
    edges = spread.saved(near.join(own.select("volume_id", F.col("node").alias("part")).hint("merge"), ["volume_id", "part"], "left_semi"))
    now = spread.saved(own.select("volume_id", "node", F.col("node").alias("part")))
    spread.discard(own)
    while not edges.isEmpty():
        hooks = spread.saved(edges.groupBy("volume_id", "part").agg(F.min("low").alias("to")))
        # hooks go from a part to a smaller one: their chains are followed to the end, twice as far each time
        while True:
            further = hooks.join(hooks.select("volume_id", F.col("part").alias("to"), F.col("to").alias("next")).hint("merge"), ["volume_id", "to"], "left")
            longer = spread.saved(further.select("volume_id", "part", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")))
            moved = longer.where("moved").limit(1).count()
            spread.discard(hooks)
            hooks, path = longer.drop("moved"), longer.shared_path
            hooks.shared_path = path
            if not moved:
                break
        after = spread.saved(now.join(hooks.hint("merge"), ["volume_id", "part"], "left").select("volume_id", "node", F.coalesce("to", "part").alias("part")))
        # the larger end of an edge always has a hook
        ends = edges.join(hooks.hint("merge"), ["volume_id", "part"]).select("volume_id", "low", F.col("to").alias("high"))
        ends = ends.join(hooks.select("volume_id", F.col("part").alias("low"), "to").hint("merge"), ["volume_id", "low"], "left").withColumn("low", F.coalesce("to", "low"))
        ends = ends.where("low <> high").select("volume_id", F.least("low", "high").alias("low"), F.greatest("low", "high").alias("part"))
        left = spread.saved(ends.distinct())
        spread.discard(now, hooks, edges)
        now, edges = after, left
    spread.discard(edges)
    return now


def largest_components(mask: DataFrame, shape: Shape) -> DataFrame:
    """``volume_id``, ``part``, ``voxels`` of each mask's largest 26-connected part; of equals the one with the smallest first voxel."""
    sizes = components(mask, shape).groupBy("volume_id", "part").agg(F.count(F.lit(1)).alias("voxels"))
    return sizes.groupBy("volume_id").agg(F.min(F.struct((-F.col("voxels")).alias("n"), "part")).alias("m")).select("volume_id", "m.part", (-F.col("m.n")).alias("voxels"))


def surface(mask: DataFrame) -> DataFrame:
    """Mask voxels with one of six neighbours outside the mask (or the volume)."""
    own = mask.select(*PLACE).distinct()
    steps = [tuple(s if k == a else 0 for k in range(3)) for a in range(3) for s in (-1, 1)]
    inner = _moved(own, steps).groupBy(*PLACE).agg(F.count(F.lit(1)).alias("n")).where("n = 6")
    return own.join(inner, PLACE, "left_anti")


def _along(lines: DataFrame, axis: str, length: int, step: float) -> DataFrame:
    """``d`` (squared distance) of every voxel of the lines along ``axis``: the least over the line of the other voxel's ``d`` and the step to it.

    ``lines``: place and ``d`` of the voxels that have one. A line is one row; a batch of lines is one matrix.
    """
    keys = [c for c in PLACE if c != axis]
    held = lines.groupBy(*keys).agg(F.collect_list(F.struct(F.col(axis).alias("at"), "d")).alias("held"))
    steps = (np.arange(length) * step) ** 2
    schema = T.StructType([*(held.schema[k] for k in keys), T.StructField("d", T.ArrayType(T.DoubleType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 512):
                part = batch.slice(first, 512)
                values = part.column(len(keys))
                sizes = values.value_lengths().to_numpy(zero_copy_only=False)
                flat = values.flatten()
                known = np.full((part.num_rows, length), np.inf)
                known[np.repeat(np.arange(part.num_rows), sizes), flat.field("at").to_numpy(zero_copy_only=False)] = flat.field("d").to_numpy(zero_copy_only=False)
                least = known.copy()
                for k in range(1, length):
                    np.minimum(least[:, k:], known[:, :-k] + steps[k], out=least[:, k:])
                    np.minimum(least[:, :-k], known[:, k:] + steps[k], out=least[:, :-k])
                offsets = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * length)
                yield pa.RecordBatch.from_arrays([*part.columns[: len(keys)], pa.ListArray.from_arrays(offsets, pa.array(least.ravel()))], names=schema.names)

    return held.mapInArrow(run, schema).select(*keys, F.posexplode("d").alias(axis, "d")).select(*PLACE, "d")


def squared_distances(points: DataFrame, shape: Shape, spacing: tuple[float, float, float]) -> DataFrame:
    """``d``: squared distance of every voxel of a volume to its nearest point; exact, one axis after the other. Volumes without points have no rows."""
    now = points.select(*PLACE, F.lit(0.0).alias("d"))
    for axis, n, step in zip(AXES, shape, spacing, strict=True):
        now = _along(now, axis, n, step)
    return now


def surface_distances(left: DataFrame, right: DataFrame, shape: Shape, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), percentile: float = 95.0) -> DataFrame:
    """``volume_id``, ``n`` (surface voxels of both masks), ``distance``: the percentile of the distances from either surface to the other, in
    mm. Volumes of which a mask is empty have no row. Points are never paired with each other."""
    a, b = spread.saved(surface(left)), spread.saved(surface(right))
    both = [p.join(squared_distances(q, shape, spacing), PLACE) for p, q in ((a, b), (b, a))]
    each = both[0].unionByName(both[1]).select("volume_id", F.sqrt("d").alias("distance"))
    found = quantiles.exact_quantiles(spread.saved(each), ["volume_id"], [percentile / 100], "distance")
    return found.select("volume_id", "n", F.col("quantiles")[0].alias("distance"))
