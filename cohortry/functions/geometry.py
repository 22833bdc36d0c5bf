"""Vectors, affines, crops and tolerances as column expressions over arrays of doubles."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, v: s + v)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cross(a: Column, b: Column) -> Column:
    return F.array(a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0])


def slice_normal(orientation: Column) -> Column:
    """Cross product of the row and column directions (six numbers); null if there are not six."""
    return F.when(F.size(orientation) == 6, cross(F.slice(orientation, 1, 3), F.slice(orientation, 4, 3)))


def main_plane(normal: Column) -> Column:
    """Plane of a normal by its largest component: sagittal, coronal, axial."""
    sizes = F.transform(normal, F.abs)
    return F.element_at(F.array(F.lit("sagittal"), F.lit("coronal"), F.lit("axial")), F.array_position(sizes, F.array_max(sizes)).cast("int"))


def affine_column(affine: Column, k: int) -> Column:
    """Column ``k`` of the 3x3 part of a row-major 4x4 affine."""
    return F.array(affine[k], affine[4 + k], affine[8 + k])


def voxel_spacing(affine: Column) -> Column:
    return F.array(*[norm(affine_column(affine, k)) for k in range(3)])


def field_of_view(shape: Column, spacing: Column) -> Column:
    return F.zip_with(shape, spacing, lambda n, s: n * s)


def voxel_ml(affine: Column) -> Column:
    """|det| of the 3x3 part, in millilitres."""
    a, b, c = (affine_column(affine, k) for k in range(3))
    return F.abs(dot(a, cross(b, c))) / 1000


def margin_crop(low: Column, high: Column, spacing: Column, shape: Column, margin_mm: Column) -> Column:
    """struct(start, end, padded): ``low`` to ``high`` (inclusive) with ceil(mm / spacing) on both sides, clipped to the shape."""
    m = F.ceil(margin_mm / spacing)
    start, end = low - m, high + 1 + m
    return F.struct(
        F.greatest(start, F.lit(0)).cast("int").alias("start"), F.least(end, shape).cast("int").alias("end"), ((start < 0) | (end > shape)).alias("padded")
    )


def fixed_crop(center: Column, spacing: Column, size_mm: Column) -> Column:
    """struct(start, size): half-even round(mm / spacing), at least 1, around the centre."""
    size = F.greatest(F.lit(1.0), F.rint(size_mm / spacing))
    return F.struct(F.floor(center - size / 2).cast("int").alias("start"), size.cast("int").alias("size"))


def max_relative_difference(observed: Column, reference: Column) -> Column:
    """Largest |o - r| / max(|r|, 1e-6); null if either is null."""
    return F.array_max(F.zip_with(observed, reference, lambda o, r: F.abs(o - r) / F.greatest(F.abs(r), F.lit(1e-6))))


def distance(a: Column, b: Column) -> Column:
    return norm(F.zip_with(a, b, lambda x, y: x - y))


def all_close(a: Column, b: Column, atol: float = 1e-3, rtol: float = 1e-5) -> Column:
    """Same length and |a - b| <= atol + rtol * |b| everywhere."""
    return (F.size(a) == F.size(b)) & F.forall(F.zip_with(a, b, lambda x, y: F.abs(x - y) <= atol + rtol * F.abs(y)), lambda ok: F.coalesce(ok, F.lit(False)))


def max_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.zip_with(a, b, lambda x, y: F.abs(x - y)))


def sampled_slices(depth: Column, count: int) -> Column:
    """Distinct half-even rounded positions, evenly spaced from 0 to depth - 1."""
    k = F.least(F.lit(count), depth)
    spread = F.transform(F.sequence(F.lit(0), k - 1), lambda i: F.when(k == 1, 0).otherwise(F.rint(i * ((depth - 1) / (k - 1)))).cast("int"))
    return F.when(depth > 0, F.array_distinct(spread))


def consistency_score(projection: Column, volume: Column, ssim: Column, nmi: Column) -> Column:
    """Weighted mean of what is known: 0.45, 0.25, 0.20, 0.10; correlations are mapped from [-1, 1] to [0, 1]."""
    known = lambda v: v.isNotNull() & ~F.isnan(v)
    clip = lambda v: F.least(F.lit(1.0), F.greatest(F.lit(0.0), v))
    parts = [(projection, (projection + 1) / 2, 0.45), (volume, (volume + 1) / 2, 0.25), (ssim, ssim, 0.20), (nmi, nmi, 0.10)]
    total = sum((F.when(known(raw), clip(v) * w).otherwise(0.0) for raw, v, w in parts), F.lit(0.0))
    weight = sum((F.when(known(raw), w).otherwise(0.0) for raw, _, w in parts), F.lit(0.0))
    return F.when(weight > 0, total / weight)
