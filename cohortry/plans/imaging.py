"""Masks, volumes, geometry and embeddings: 64 floats of an embedding as a 4x4x4 volume or an affine."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geometry, text
from ..operators import features, masks, shapes, spread, voxels
from .common import r6, rounded, table

SHAPE, ABOVE, ML = (4, 4, 4), 0.1, 0.008


def _volumes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias("volume_id"), "label", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("voxels"))


VOLUMES_SQL = """volumes AS (SELECT vec_id AS volume_id, label, list_transform(embedding, lambda x: round(x::DOUBLE, 4)) AS v FROM embeddings),
dense AS (SELECT volume_id, label, unnest(v) AS v, unnest(range(64)) AS i FROM volumes),
vox AS (SELECT volume_id, label, (i // 16)::INT AS x, (i // 4 % 4)::INT AS y, (i % 4)::INT AS z, v FROM dense)"""


def mask_stats_crop(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics and both crops (x axis) of each mask, spacing 2 mm."""
    v = masks.dense_to_voxels(_volumes(spark, sf_dir), ABOVE, SHAPE).where("x is not null")
    s = masks.mask_statistics(v, ML)
    two = F.lit(2.0)
    margin = geometry.margin_crop(F.col("lo_x"), F.col("hi_x") - 1, two, F.lit(4), F.lit(3.0))
    fixed = geometry.fixed_crop(F.col("cx"), two, F.lit(5.0))
    found = s.select("*", margin["start"].alias("start"), margin["end"].alias("end"), margin["padded"].alias("padded"), fixed["start"].alias("fixed_start"), fixed["size"].alias("fixed_size"))
    return rounded(found, "ml", "cx", "cy", "cz")


MASK_SQL = f"""WITH {VOLUMES_SQL}, s AS (SELECT volume_id, count(*) AS voxels, round(count(*) * 0.008, 6) AS ml, avg(x) AS cx, min(x) AS lo_x, max(x) + 1 AS hi_x,
  avg(y) AS cy, min(y) AS lo_y, max(y) + 1 AS hi_y, avg(z) AS cz, min(z) AS lo_z, max(z) + 1 AS hi_z FROM vox WHERE v > 0.1 GROUP BY volume_id)
SELECT * REPLACE (round(cx, 6) AS cx, round(cy, 6) AS cy, round(cz, 6) AS cz), greatest(lo_x - 2, 0)::INT AS start, least(hi_x + 2, 4)::INT AS "end", lo_x - 2 < 0 OR hi_x + 2 > 4 AS padded,
  floor(cx - 1.0)::INT AS fixed_start, 2 AS fixed_size FROM s"""


def busiest_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    vol = _volumes(spark, sf_dir)
    v = masks.dense_to_voxels(vol, 0.35, SHAPE).where("x is not null")
    return masks.busiest_slice(v, vol.select("volume_id", F.lit(4).alias("depth")))


SLICE_SQL = f"""WITH {VOLUMES_SQL}, c AS (SELECT volume_id, z, count(*) AS n FROM vox WHERE v > 0.35 GROUP BY ALL),
b AS (SELECT volume_id, z FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY n DESC, z) AS r FROM c) WHERE r = 1)
SELECT v.volume_id, coalesce(b.z, 2)::INT AS slice FROM volumes v LEFT JOIN b ON v.volume_id = b.volume_id"""


def _pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each volume with its successor of the same label."""
    a = _volumes(spark, sf_dir)
    b = a.select((F.col("volume_id") - 10).alias("volume_id"), F.col("voxels").alias("other"))
    size = 64 * a.count()
    return spread.dealt_by(a, ["volume_id"], size).join(spread.dealt_by(b, ["volume_id"], size), "volume_id")


PAIRS_SQL = "pairs AS (SELECT a.volume_id, a.v AS a, b.v AS b FROM volumes a JOIN volumes b ON b.volume_id = a.volume_id + 10)"


def mask_dice(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir)
    pred = masks.dense_to_voxels(p.select("volume_id", "voxels"), 0.2, SHAPE)
    label = masks.dense_to_voxels(p.select("volume_id", F.col("other").alias("voxels")), 0.2, SHAPE)
    return rounded(masks.mask_overlap(pred, label), "dice", "ratio")


_DICE_SQL = f"""{VOLUMES_SQL}, {PAIRS_SQL}, d AS (SELECT volume_id, unnest(a) AS a, unnest(b) AS b FROM pairs),
o AS (SELECT volume_id, count(*) FILTER (a > 0.2) AS n_pred, count(*) FILTER (b > 0.2) AS n_label, count(*) FILTER (a > 0.2 AND b > 0.2) AS n_both FROM d GROUP BY volume_id),
dice AS (SELECT *, round(CASE WHEN n_pred + n_label = 0 THEN 1.0 ELSE 2 * n_both / (n_pred + n_label) END, 6) AS dice, n_both > 0 AS "overlaps", round(CASE WHEN n_label > 0 THEN n_pred / n_label END, 6) AS ratio FROM o)"""
DICE_SQL = f"WITH {_DICE_SQL} SELECT * FROM dice"


def overlap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    cases = mask_dice(spark, sf_dir).withColumn("status", F.when(F.col("n_pred") < 5, "small").otherwise("ok"))
    return rounded(masks.overlap_summary(cases, ["dice", "ratio"]), "lesion_recall", "mean_dice", "median_dice", "mean_ratio", "median_ratio", places=5)


SUMMARY_SQL = f"""WITH {_DICE_SQL} SELECT count(*) AS cases, count(*) FILTER (n_pred < 5) AS not_ok, round(avg("overlaps"::INT), 5) AS lesion_recall, round(avg(dice), 5) AS mean_dice, round(median(dice), 5) AS median_dice,
  round(avg(ratio), 5) AS mean_ratio, round(median(ratio), 5) AS median_ratio FROM dice"""


def volume_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Crop, subtraction, correlation, normalized error and score of each pair."""
    a, b, m = F.col("voxels"), F.col("other"), F.col("moments")
    p = _pairs(spark, sf_dir).withColumns({"moments": voxels.moments(a, b), "crop": voxels.crop(a, SHAPE, (1, 0, 2), (3, 4, 4))})
    corr, crop, diff = voxels.correlation_of(m), F.col("crop"), voxels.subtract(b, a)
    return p.select(
        "volume_id", F.size(crop).alias("crop_size"), r6(F.aggregate(crop, F.lit(0.0), lambda s, v: s + v)).alias("crop_sum"),
        r6(F.array_max(diff)).alias("max_diff"), r6(corr).alias("corr"), r6(voxels.nrmse_of(m)).alias("nrmse"),
        r6(geometry.consistency_score(corr, corr, F.lit(None).cast("double"), F.lit(0.5))).alias("score"),
        r6(geometry.max_difference(a, b)).alias("max_abs"), geometry.all_close(a, b, atol=0.5).alias("close"),
        r6(F.aggregate(voxels.rescale(a, F.lit(-0.2), F.lit(0.2)), F.lit(0.0), lambda s, v: s + v)).alias("rescaled_sum"),
    )


COMPARE_SQL = f"""WITH {VOLUMES_SQL}, {PAIRS_SQL}, d AS (SELECT volume_id, unnest(a) AS a, unnest(b) AS b, unnest(range(64)) AS i FROM pairs),
m AS (SELECT *, (a - avg(a) OVER w) / stddev_pop(a) OVER w AS za, (b - avg(b) OVER w) / stddev_pop(b) OVER w AS zb FROM d WINDOW w AS (PARTITION BY volume_id)),
g AS (SELECT volume_id, count(*) FILTER (i // 16 BETWEEN 1 AND 2 AND i % 4 BETWEEN 2 AND 3) AS crop_size, sum(a) FILTER (i // 16 BETWEEN 1 AND 2 AND i % 4 BETWEEN 2 AND 3) AS crop_sum,
  max(b - a) AS max_diff, corr(a, b) AS corr, sqrt(avg((za - zb) * (za - zb))) AS nrmse, max(abs(a - b)) AS max_abs, bool_and(abs(a - b) <= 0.5 + 1e-5 * abs(b)) AS close,
  sum((least(greatest(a, -0.2), 0.2) + 0.2) / 0.4) AS rescaled_sum FROM m GROUP BY volume_id)
SELECT volume_id, crop_size::INT AS crop_size, round(crop_sum, 6) AS crop_sum, round(max_diff, 6) AS max_diff, round(corr, 6) AS corr, round(nrmse, 6) AS nrmse,
  round((0.7 * (corr + 1) / 2 + 0.05) / 0.8, 6) AS score, round(max_abs, 6) AS max_abs, close, round(rescaled_sum, 6) AS rescaled_sum FROM g"""


def max_projections(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Largest voxels along each axis, counted and summed for each volume."""
    d = _volumes(spark, sf_dir).select("volume_id", F.posexplode("voxels").alias("i", "v"))
    long = d.select("volume_id", F.floor(F.col("i") / 16).cast("int").alias("x"), (F.floor(F.col("i") / 4) % 4).cast("int").alias("y"), (F.col("i") % 4).alias("z"), "v")
    found = voxels.max_projections(long).groupBy("volume_id", "axis").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("total"))
    return rounded(found, "total", places=5)


MIP_SQL = f"""WITH {VOLUMES_SQL}, p AS (SELECT volume_id, 'x' AS axis, y AS i, z AS j, max(v) AS v FROM vox GROUP BY ALL UNION ALL SELECT volume_id, 'y', x, z, max(v) FROM vox GROUP BY ALL UNION ALL SELECT volume_id, 'z', x, y, max(v) FROM vox GROUP BY ALL)
SELECT volume_id, axis, count(*) AS n, round(sum(v), 5) AS total FROM p GROUP BY ALL"""


def mutual_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = _pairs(spark, sf_dir).select("volume_id", F.explode(F.arrays_zip(F.col("voxels").alias("a"), F.col("other").alias("b"))).alias("p"))
    unit = lambda c: F.least(F.lit(1.0), F.greatest(F.lit(0.0), c + 0.5))
    return rounded(voxels.mutual_information(p.select("volume_id", unit(F.col("p.a")).alias("a"), unit(F.col("p.b")).alias("b")), "volume_id", 6), "nmi", places=5)


NMI_SQL = f"""WITH {VOLUMES_SQL}, {PAIRS_SQL}, d AS (SELECT volume_id, unnest(a) AS a, unnest(b) AS b FROM pairs),
c AS (SELECT volume_id, least(5, floor(least(1.0, greatest(0.0, a + 0.5)) * 6)) AS i, least(5, floor(least(1.0, greatest(0.0, b + 0.5)) * 6)) AS j, count(*) AS n FROM d GROUP BY ALL),
ha AS (SELECT volume_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT volume_id, i, sum(n) AS n FROM c GROUP BY ALL) GROUP BY volume_id),
hb AS (SELECT volume_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM (SELECT volume_id, j, sum(n) AS n FROM c GROUP BY ALL) GROUP BY volume_id),
hab AS (SELECT volume_id, ln(sum(n)) - sum(n * ln(n)) / sum(n) AS h FROM c GROUP BY volume_id)
SELECT ha.volume_id, round(CASE WHEN hab.h > 1e-12 THEN (ha.h + hb.h - hab.h) * 2 / (ha.h + hb.h) END, 5) AS nmi FROM ha JOIN hb ON ha.volume_id = hb.volume_id JOIN hab ON ha.volume_id = hab.volume_id"""


def geometry_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each 16 values as an affine: spacing, plane, millilitres, field of view; fingerprints; sampled slices."""
    p = _pairs(spark, sf_dir).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(3))))
    a, b = (F.slice(c, F.col("part") * 16 + 1, 16) for c in ("voxels", "other"))
    spacing, other = geometry.voxel_spacing(a), geometry.voxel_spacing(b)
    normal = geometry.slice_normal(F.slice(a, 1, 6))
    shape = F.array(F.lit(4), F.lit(5), F.lit(6))
    listed = lambda c: F.array_join(F.transform(c, lambda v: F.format_string("%.4f", v)), ",")
    return p.select(
        "volume_id", "part", listed(spacing).alias("spacing"), listed(geometry.field_of_view(shape, spacing)).alias("fov"), geometry.main_plane(normal).alias("plane"),
        geometry.main_plane(geometry.affine_column(a, 2)).alias("view"), r6(geometry.voxel_ml(a) * 1000, 5).alias("mm3"), r6(geometry.max_relative_difference(spacing, other), 4).alias("spacing_diff"),
        r6(geometry.distance(spacing, other)).alias("distance"), F.array_join(geometry.sampled_slices((F.col("volume_id") % 40).cast("int") + 1, 16).cast("array<string>"), ",").alias("slices"),
        voxels.fingerprint(shape, F.lit("float32"), F.col("volume_id").cast("string").cast("binary")).alias("print"),
    )


GEOMETRY_SQL = f"""WITH {VOLUMES_SQL}, {PAIRS_SQL}, affines AS (SELECT volume_id, k::INTEGER AS part, a[k * 16 + 1:k * 16 + 16] AS a, b[k * 16 + 1:k * 16 + 16] AS b FROM pairs, range(4) AS r(k)),
g AS (SELECT volume_id, part, a, b,
  [sqrt(a[1]*a[1]+a[5]*a[5]+a[9]*a[9]), sqrt(a[2]*a[2]+a[6]*a[6]+a[10]*a[10]), sqrt(a[3]*a[3]+a[7]*a[7]+a[11]*a[11])] AS s,
  [sqrt(b[1]*b[1]+b[5]*b[5]+b[9]*b[9]), sqrt(b[2]*b[2]+b[6]*b[6]+b[10]*b[10]), sqrt(b[3]*b[3]+b[7]*b[7]+b[11]*b[11])] AS t,
  [abs(a[2]*a[6]-a[3]*a[5]), abs(a[3]*a[4]-a[1]*a[6]), abs(a[1]*a[5]-a[2]*a[4])] AS n, [abs(a[3]), abs(a[7]), abs(a[11])] AS w, volume_id % 40 + 1 AS z FROM affines)
SELECT volume_id, part, printf('%.4f,%.4f,%.4f', s[1], s[2], s[3]) AS spacing, printf('%.4f,%.4f,%.4f', 4*s[1], 5*s[2], 6*s[3]) AS fov,
  ['sagittal','coronal','axial'][list_position(n, list_max(n))] AS plane, ['sagittal','coronal','axial'][list_position(w, list_max(w))] AS view,
  round(abs(a[1]*(a[6]*a[11]-a[7]*a[10]) - a[2]*(a[5]*a[11]-a[7]*a[9]) + a[3]*(a[5]*a[10]-a[6]*a[9])), 5) AS mm3,
  round(greatest(abs(s[1]-t[1])/greatest(t[1],1e-6), abs(s[2]-t[2])/greatest(t[2],1e-6), abs(s[3]-t[3])/greatest(t[3],1e-6)), 4) AS spacing_diff,
  round(sqrt((s[1]-t[1])*(s[1]-t[1])+(s[2]-t[2])*(s[2]-t[2])+(s[3]-t[3])*(s[3]-t[3])), 6) AS distance,
  array_to_string(list_transform(range(least(16, z)), lambda i: CASE WHEN z = 1 THEN 0 ELSE round_even(i * ((z - 1)::DOUBLE / (least(16, z) - 1)), 0)::INT END), ',') AS slices,
  sha1('4x5x6|float32|' || volume_id) AS print FROM g"""


def embedding_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and max of each label's vectors, long form."""
    e = table(spark, sf_dir, "embeddings").select("label", F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))
    pooled = features.pool_slices(e, ["label"], mode="mean_max")
    return rounded(pooled.select("label", F.posexplode("embedding").alias("pos", "value")), "value")


POOL_SQL = f"""WITH {VOLUMES_SQL} SELECT label, i::INT AS pos, round(avg(v), 6) AS value FROM dense GROUP BY label, i UNION ALL SELECT label, i::INT + 64, round(max(v), 6) FROM dense GROUP BY label, i"""


def embedding_fuse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three models' vectors of a patient, concatenated in the order asked for; patients without all are left out."""
    e = table(spark, sf_dir, "embeddings")
    long = e.select((F.floor(F.col("vec_id") / 4)).alias("patient_id"), F.concat(F.lit("m"), (F.col("vec_id") % 4).cast("string")).alias("model_key"), F.transform("embedding", lambda x: F.round(x.cast("double"), 4)).alias("embedding"))
    fused = features.fuse_embeddings(long.where((F.col("patient_id") % 5 != 0) | (F.col("model_key") != "m3")), ["m2", "m0", "m3"])
    return fused.select("patient_id", F.size("embedding").alias("width"), r6(F.col("embedding")[0]).alias("first"), r6(F.col("embedding")[64]).alias("second"), r6(F.col("embedding")[191]).alias("last"))


FUSE_SQL = f"""WITH {VOLUMES_SQL}, l AS (SELECT volume_id // 4 AS patient_id, volume_id % 4 AS m, v FROM volumes WHERE (volume_id // 4) % 5 <> 0 OR volume_id % 4 <> 3)
SELECT a.patient_id, 192 AS width, round(a.v[1], 6) AS first, round(b.v[1], 6) AS second, round(c.v[64], 6) AS last FROM l a JOIN l b ON a.patient_id = b.patient_id AND b.m = 0 JOIN l c ON a.patient_id = c.patient_id AND c.m = 3 WHERE a.m = 2"""


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Both volumes of each pair as long voxels."""
    p = _pairs(spark, sf_dir)
    return shapes.long_voxels(p, "voxels", SHAPE), shapes.long_voxels(p, "other", SHAPE)


_SIDES_SQL = f"""{VOLUMES_SQL}, sides AS (SELECT a.volume_id, a.x, a.y, a.z, a.v AS a, b.v AS b FROM vox a JOIN vox b ON b.volume_id = a.volume_id + 10 AND a.x = b.x AND a.y = b.y AND a.z = b.z)"""


def robust_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = shapes.robust_features(_sides(spark, sf_dir)[0], SHAPE)
    return rounded(found, *[c for c in found.columns if c != "volume_id"])


_ROBUST_SQL = """q AS (SELECT volume_id, quantile_cont(a, 0.01) AS low, quantile_cont(a, 0.5) AS median, quantile_cont(a, 0.99) AS high FROM sides GROUP BY volume_id),
robust AS (SELECT s.volume_id, round(low, 6) AS low, round(median, 6) AS median, round(high, 6) AS high, round(count(*) FILTER (a > (low + high) / 2) / count(*), 6) AS foreground,
  round(avg(x) FILTER (a > (low + high) / 2) / 4, 6) AS cx, round(avg(y) FILTER (a > (low + high) / 2) / 4, 6) AS cy, round(avg(z) FILTER (a > (low + high) / 2) / 4, 6) AS cz,
  round((max(x) FILTER (a > (low + high) / 2) - min(x) FILTER (a > (low + high) / 2) + 1) / 4, 6) AS ex, round((max(y) FILTER (a > (low + high) / 2) - min(y) FILTER (a > (low + high) / 2) + 1) / 4, 6) AS ey,
  round((max(z) FILTER (a > (low + high) / 2) - min(z) FILTER (a > (low + high) / 2) + 1) / 4, 6) AS ez FROM sides s JOIN q USING (volume_id) GROUP BY s.volume_id, low, median, high)"""
ROBUST_SQL = f"WITH {_SIDES_SQL}, {_ROBUST_SQL} SELECT * FROM robust"


def orientation_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shapes.orientation_match(*_sides(spark, sf_dir), SHAPE), "corr")


_ORIENTATION_SQL = """turned AS (SELECT volume_id, o, CASE WHEN o % 2 = 1 THEN 3 - p ELSE p END AS x, CASE WHEN o // 2 % 2 = 1 THEN 3 - q ELSE q END AS y, CASE WHEN o // 4 % 2 = 1 THEN 3 - z ELSE z END AS z, b
  FROM (SELECT volume_id, o, b, z, CASE WHEN o >= 8 THEN y ELSE x END AS p, CASE WHEN o >= 8 THEN x ELSE y END AS q FROM sides, range(16) AS r(o))),
fits AS (SELECT volume_id, o, corr(s.a, t.b) AS c FROM turned t JOIN sides s USING (volume_id, x, y, z) GROUP BY volume_id, o),
fit AS (SELECT volume_id, min(o) AS o, max(top) AS c FROM (SELECT *, max(c) OVER (PARTITION BY volume_id) AS top FROM fits) WHERE c > top - 1e-12 GROUP BY volume_id),
orientation AS (SELECT volume_id, CASE WHEN o >= 8 THEN 'swap' ELSE 'keep' END || o % 8 AS transform, round(c, 6) AS corr, CASE WHEN c >= 0.999 THEN 'equivalent' WHEN c >= 0.98 THEN 'very_similar' WHEN c >= 0.9 THEN 'similar' ELSE 'different' END AS label FROM fit)"""
ORIENTATION_SQL = f"WITH {_SIDES_SQL}, {_ORIENTATION_SQL} SELECT * FROM orientation"


def projection_ssim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shapes.projection_ssim(*_sides(spark, sf_dir), SHAPE), "ssim")


#: A 4 x 4 image is one window.
_SSIM_SQL = """images AS (SELECT volume_id, 'x' AS axis, max(a) AS a, max(b) AS b FROM sides GROUP BY volume_id, y, z UNION ALL SELECT volume_id, 'y', max(a), max(b) FROM sides GROUP BY volume_id, x, z UNION ALL SELECT volume_id, 'z', max(a), max(b) FROM sides GROUP BY volume_id, x, y),
w AS (SELECT volume_id, axis, avg(a) AS ma, avg(b) AS mb, var_samp(a) AS va, var_samp(b) AS vb, covar_samp(a, b) AS vab, greatest(max(a), max(b)) - least(min(a), min(b)) AS span FROM images GROUP BY volume_id, axis),
alike AS (SELECT volume_id, axis, (2 * ma * mb + pow(0.01 * span, 2)) * (2 * vab + pow(0.03 * span, 2)) / ((ma * ma + mb * mb + pow(0.01 * span, 2)) * (va + vb + pow(0.03 * span, 2))) AS ssim FROM w)"""
SSIM_SQL = f"WITH {_SIDES_SQL}, {_SSIM_SQL} SELECT volume_id, axis, round(ssim, 6) AS ssim FROM alike"


def _masks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return tuple(side.where(F.col("v") > ABOVE).select(*shapes.PLACE) for side in _sides(spark, sf_dir))


def surface_distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(shapes.surface_distances(*_masks(spark, sf_dir), SHAPE), "distance")


#: All surface points of one mask against all of the other.
_DISTANCE_SQL = f"""points AS (SELECT volume_id, 0 AS side, x, y, z FROM sides WHERE a > {ABOVE} UNION ALL SELECT volume_id, 1, x, y, z FROM sides WHERE b > {ABOVE}),
inner_ AS (SELECT p.volume_id, p.side, p.x, p.y, p.z FROM points p JOIN points q ON p.volume_id = q.volume_id AND p.side = q.side AND abs(p.x - q.x) + abs(p.y - q.y) + abs(p.z - q.z) = 1 GROUP BY ALL HAVING count(*) = 6),
edge AS (SELECT * FROM points EXCEPT ALL SELECT * FROM inner_),
near AS (SELECT p.volume_id, p.side, p.x, p.y, p.z, sqrt(min((p.x - q.x) * (p.x - q.x) + (p.y - q.y) * (p.y - q.y) + (p.z - q.z) * (p.z - q.z))) AS d FROM edge p JOIN edge q ON p.volume_id = q.volume_id AND p.side <> q.side GROUP BY ALL),
distances AS (SELECT volume_id, count(*) AS n, round(quantile_cont(d, 0.95), 6) AS distance FROM near GROUP BY volume_id)"""
DISTANCE_SQL = f"WITH {_SIDES_SQL}, {_DISTANCE_SQL} SELECT * FROM distances"


def largest_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shapes.largest_components(_masks(spark, sf_dir)[0], SHAPE)


#: All voxels that each voxel reaches, then the least of them.
_PARTS_SQL = f"""m AS (SELECT volume_id, x, y, z, (x * 4 + y) * 4 + z AS node FROM sides WHERE a > {ABOVE}),
e AS (SELECT p.volume_id, p.node AS u, q.node AS w FROM m p JOIN m q ON p.volume_id = q.volume_id AND abs(p.x - q.x) <= 1 AND abs(p.y - q.y) <= 1 AND abs(p.z - q.z) <= 1),
reach AS (SELECT volume_id, u, w FROM e UNION SELECT r.volume_id, r.u, e.w FROM reach r JOIN e ON r.volume_id = e.volume_id AND r.w = e.u),
parts AS (SELECT volume_id, part, count(*) AS voxels FROM (SELECT volume_id, u, min(w) AS part FROM reach GROUP BY volume_id, u) GROUP BY volume_id, part),
largest AS (SELECT volume_id, part, voxels FROM (SELECT *, row_number() OVER (PARTITION BY volume_id ORDER BY voxels DESC, part) AS r FROM parts) WHERE r = 1)"""
LARGEST_SQL = f"WITH RECURSIVE {_SIDES_SQL}, {_PARTS_SQL} SELECT volume_id, part::BIGINT AS part, voxels FROM largest"


def volume_helpers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flips, structural similarity, surface distance, largest component and robust features of each pair, side by side."""
    similar = shapes.projection_ssim(*_sides(spark, sf_dir), SHAPE).groupBy("volume_id").agg(F.avg("ssim").alias("mean_ssim"))
    hd95 = surface_distances(spark, sf_dir).select("volume_id", F.col("distance").alias("hd95"))
    largest = largest_components(spark, sf_dir).select("volume_id", F.col("voxels").alias("largest"))
    out = orientation_match(spark, sf_dir).join(robust_features(spark, sf_dir), "volume_id").join(similar, "volume_id")
    out = out.join(hd95, "volume_id", "left").join(largest, "volume_id", "left")
    return rounded(out.withColumn("largest", F.coalesce("largest", F.lit(0).cast("long"))), "mean_ssim")


HELPERS_SQL = f"""WITH RECURSIVE {_SIDES_SQL}, {_ORIENTATION_SQL}, {_ROBUST_SQL}, {_SSIM_SQL}, {_DISTANCE_SQL}, {_PARTS_SQL}
SELECT o.*, r.* EXCLUDE (volume_id), mean_ssim, distance AS hd95, coalesce(voxels, 0) AS largest FROM orientation o JOIN robust r USING (volume_id)
JOIN (SELECT volume_id, round(avg(ssim), 6) AS mean_ssim FROM alike GROUP BY volume_id) USING (volume_id) LEFT JOIN distances USING (volume_id) LEFT JOIN largest USING (volume_id)"""


def encode_slices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fixed stand-in encoder over the 16-value slices; one of fifty slices has the wrong length and fails by itself."""

    def make_encoder():
        import numpy as np

        weights = np.cos(np.arange(16 * 8).reshape(16, 8))
        return lambda batch: batch @ weights

    v = _volumes(spark, sf_dir)
    slices = v.select("volume_id", F.posexplode(F.transform(F.sequence(F.lit(0), F.lit(3)), lambda k: F.slice("voxels", k * 16 + 1, F.when(F.col("volume_id") % 50 == 0, 15).otherwise(16)))).alias("z", "slice"))
    return voxels.encode_slices(slices, make_encoder, ["volume_id", "z"])


def path_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hosts and last path parts of the pages' urls, slugged and listed."""
    p = table(spark, sf_dir, "pages")
    parts = F.split(F.regexp_replace("url", r"^[a-z]+://", ""), "/")
    return p.select("page_id", parts[0].alias("host"), text.slug(F.col("url")).alias("slug"), F.size(text.split_list(F.replace("url", F.lit("/"), F.lit("|")))).alias("parts"))


PATH_SQL = r"""SELECT page_id, string_split(regexp_replace(url, '^[a-z]+://', ''), '/')[1] AS host, regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug,
  len(list_filter(string_split(url, '/'), lambda x: trim(x) <> ''))::INT AS parts FROM pages"""

QUERIES = {
    "mask_stats_crop": mask_stats_crop, "busiest_slice": busiest_slice, "mask_dice": mask_dice, "overlap_summary": overlap_summary, "volume_compare": volume_compare,
    "max_projections": max_projections, "mutual_information": mutual_information, "geometry_rules": geometry_rules, "embedding_pool": embedding_pool, "embedding_fuse": embedding_fuse,
    "robust_features": robust_features, "orientation_match": orientation_match, "projection_ssim": projection_ssim, "surface_distances": surface_distances, "largest_components": largest_components,
    "volume_helpers": volume_helpers, "encode_slices": encode_slices, "path_rules": path_rules,
}
ORACLE_SQL = {
    "robust_features": ROBUST_SQL, "orientation_match": ORIENTATION_SQL, "projection_ssim": SSIM_SQL, "surface_distances": DISTANCE_SQL, "largest_components": LARGEST_SQL, "volume_helpers": HELPERS_SQL,
    "mask_stats_crop": MASK_SQL, "busiest_slice": SLICE_SQL, "mask_dice": DICE_SQL, "overlap_summary": SUMMARY_SQL, "volume_compare": COMPARE_SQL, "max_projections": MIP_SQL,
    "mutual_information": NMI_SQL, "geometry_rules": GEOMETRY_SQL, "embedding_pool": POOL_SQL, "embedding_fuse": FUSE_SQL, "path_rules": PATH_SQL,
}
