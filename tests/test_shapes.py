"""Volume measures over long voxel tables against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortry.operators import shapes

SHAPE = (6, 6, 5)


def volumes(seed, n=6, shape=SHAPE):
    rng = np.random.default_rng(seed)
    return {k: np.round(rng.normal(size=shape), 3) for k in range(n)}


def frame(spark, found, column="v"):
    df = spark.createDataFrame([(k, a.ravel().tolist()) for k, a in found.items()], "volume_id int, dense array<double>")
    return shapes.long_voxels(df, "dense", next(iter(found.values())).shape, column)


def test_robust_features(spark):
    found = volumes(1) | {90: np.full(SHAPE, 2.0)}
    got = {r["volume_id"]: r for r in shapes.robust_features(frame(spark, found), SHAPE).collect()}
    for k, a in found.items():
        low, mid, high = np.percentile(a, [1, 50, 99])
        at = np.argwhere(a > (low + high) / 2) if high > low else np.empty((0, 3))
        r = got[k]
        assert (r["low"], r["median"], r["high"], r["foreground"]) == pytest.approx((low, mid, high, len(at) / a.size))
        if len(at):
            assert [r[f"c{x}"] for x in "xyz"] == pytest.approx((at.mean(axis=0) / SHAPE).tolist()) and [r[f"e{x}"] for x in "xyz"] == pytest.approx(((np.ptp(at, axis=0) + 1) / SHAPE).tolist())
        else:
            assert [r[f"c{x}"] for x in "xyz"] == [None] * 3 and [r[f"e{x}"] for x in "xyz"] == [0.0] * 3


def test_orientation_match(spark):
    a = volumes(2, 18)
    b = {}
    for k in range(16):
        base = a[k].transpose(1, 0, 2) if k >= 8 else a[k]
        b[k] = np.flip(base, [axis for axis in range(3) if k >> axis & 1]) if k < 8 else np.flip(a[k], [axis for axis in range(3) if k >> axis & 1]).transpose(1, 0, 2)
    b[16], b[17] = volumes(3)[0], np.ones(SHAPE)
    got = {r["volume_id"]: r for r in shapes.orientation_match(frame(spark, a), frame(spark, b), SHAPE).collect()}
    for k in range(18):
        tried = []
        for swap in (0, 1):
            for bits in range(8):
                turned = np.flip(b[k].transpose(1, 0, 2) if swap else b[k], [axis for axis in range(3) if bits >> axis & 1])
                if turned.std() > 1e-8:
                    tried.append((round(-float(np.corrcoef(a[k].ravel(), turned.ravel())[0, 1]), 10), swap * 8 + bits, f"{'swap' if swap else 'keep'}{bits}"))
        if not tried:
            assert (got[k]["transform"], got[k]["corr"], got[k]["label"]) == ("none", None, "different")
            continue
        corr, _, name = min(tried)
        assert got[k]["transform"] == name and got[k]["corr"] == pytest.approx(-corr)
        assert got[k]["label"] == ("equivalent" if k < 16 else "different")
    flat = {0: np.arange(24.0).reshape(2, 3, 4)}
    assert shapes.orientation_match(frame(spark, flat), frame(spark, flat), (2, 3, 4)).first()["transform"] == "keep0"


def plain_ssim(a, b, window=7):
    w = min(window, *a.shape)
    span = max(a.max(), b.max()) - min(a.min(), b.min())
    if span <= 0:
        return 1.0
    out, n = [], w * w
    for i in range(a.shape[0] - w + 1):
        for j in range(a.shape[1] - w + 1):
            p, q = a[i : i + w, j : j + w].ravel(), b[i : i + w, j : j + w].ravel()
            va, vb, vab = (np.var(p, ddof=n > 1), np.var(q, ddof=n > 1), ((p - p.mean()) * (q - q.mean())).sum() / max(n - 1, 1))
            c1, c2 = (0.01 * span) ** 2, (0.03 * span) ** 2
            out.append((2 * p.mean() * q.mean() + c1) * (2 * vab + c2) / ((p.mean() ** 2 + q.mean() ** 2 + c1) * (va + vb + c2)))
    return float(np.mean(out))


@pytest.mark.parametrize("shape", [(6, 6, 5), (9, 8, 10)])
def test_projection_ssim(spark, shape):
    a, b = volumes(4, 3, shape), volumes(5, 3, shape)
    b[0] = a[0]
    a[2] = b[2] = np.ones(shape)
    got = {(r["volume_id"], r["axis"]): r["ssim"] for r in shapes.projection_ssim(frame(spark, a), frame(spark, b), shape).collect()}
    assert len(got) == 9
    for k in a:
        for axis, name in enumerate("xyz"):
            assert got[k, name] == pytest.approx(plain_ssim(a[k].max(axis=axis), b[k].max(axis=axis)), abs=1e-9)


def plain_parts(mask):
    left, out = {tuple(p) for p in np.argwhere(mask).tolist()}, []
    while left:
        todo, part = [min(left)], set()
        left.discard(todo[0])
        while todo:
            p = todo.pop()
            part.add(p)
            near = [q for q in left if max(abs(x - y) for x, y in zip(p, q, strict=True)) <= 1]
            left.difference_update(near)
            todo += near
        out.append(part)
    return out


def test_components_and_the_largest(spark):
    shape = (7, 8, 9)
    rng = np.random.default_rng(6)
    masks = {k: rng.random(shape) < share for k, share in enumerate((0.05, 0.1, 0.2, 0.5))}
    snake = np.zeros(shape, dtype=bool)
    for x in range(0, 7, 2):
        snake[x, :, 0] = True
        snake[min(x + 1, 6), 7 if x % 4 == 0 else 0, 0] = True
    masks |= {10: snake, 11: np.zeros(shape, dtype=bool)}
    long = frame(spark, {k: m.astype(float) for k, m in masks.items()}).where("v > 0")
    got = {}
    for r in shapes.components(long, shape).collect():
        got.setdefault(r["volume_id"], {}).setdefault(r["part"], set()).add(r["node"])
    largest = {r["volume_id"]: (r["part"], r["voxels"]) for r in shapes.largest_components(long, shape).collect()}
    for k, m in masks.items():
        want = [{int(np.ravel_multi_index(p, shape)) for p in part} for part in plain_parts(m)]
        assert {min(p): p for p in want} == got.get(k, {})
        if want:
            size = max(map(len, want))
            assert largest[k] == (min(min(p) for p in want if len(p) == size), size)
    assert 11 not in largest and shapes.components(long.where("false"), shape).count() == 0


def test_surface_distances(spark):
    shape, spacing = (6, 7, 8), (2.0, 0.5, 1.25)
    rng = np.random.default_rng(7)
    a = {k: rng.random(shape) < share for k, share in enumerate((0.02, 0.3, 0.9))} | {5: np.ones(shape, dtype=bool), 6: np.zeros(shape, dtype=bool)}
    b = {k: rng.random(shape) < share for k, share in enumerate((0.02, 0.6, 0.01))} | {5: np.ones(shape, dtype=bool), 6: np.ones(shape, dtype=bool)}
    la, lb = (frame(spark, {k: m.astype(float) for k, m in x.items()}).where("v > 0") for x in (a, b))

    def surface(m):
        p = np.pad(m, 1)
        inner = np.ones(m.shape, dtype=bool)
        for axis in range(3):
            for s in (-1, 1):
                inner &= np.roll(p, s, axis)[1:-1, 1:-1, 1:-1]
        return np.argwhere(m & ~inner)

    got = {r["volume_id"]: (r["n"], r["distance"]) for r in shapes.surface_distances(la, lb, shape, spacing).collect()}
    assert set(got) == {0, 1, 2, 5}
    for k in got:
        x, y = surface(a[k]) * spacing, surface(b[k]) * spacing
        d = np.sqrt(((x[:, None] - y[None]) ** 2).sum(-1))
        each = np.concatenate([d.min(axis=1), d.min(axis=0)])
        assert got[k] == (len(each), pytest.approx(np.percentile(each, 95)))


def test_nothing_comes_of_nothing(spark):
    none = frame(spark, volumes(8, 1)).where(F.lit(False))
    assert shapes.robust_features(none, SHAPE).count() == shapes.orientation_match(none, none, SHAPE).count() == shapes.projection_ssim(none, none, SHAPE).count() == shapes.surface_distances(none, none, SHAPE).count() == 0
