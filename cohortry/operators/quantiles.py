"""Exact quantiles of groups of any size: large groups are narrowed down by histograms, never gathered.

Groups of few rows are sorted as lists. Between two ranks values are ``low * (1 - share) + high * share`` in one rounding of the sum (as DuckDB
computes it), so that what is compared with a quantile falls on the same side of it in both engines. For each rank that is asked of a large group, rows within a bracket of
values are counted in buckets between its ends, and the bucket that holds the rank is the next bracket, until few rows
are left in it or all are equal. What is shuffled in a round is one row for each task and bucket; the driver sees one row for
each large group (fewer than rows / ``SMALL``) and rank.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .spread import literal_rows

#: Rows of a group, or of a bracket, that one task may gather.
SMALL = 1 << 20
BUCKETS = 4096
#: Largest finite double: infinite values are placed there when buckets are cut.
MOST = 1.7976931348623157e308
#: Parts a double into two halves, whose products are exact.
_SPLIT = 134217729.0


def _held(value: Column) -> Column:
    return F.greatest(F.lit(-MOST), F.least(F.lit(MOST), value)) / 2


def _order(value: Column) -> Column:
    """Rises with the value, by its sign and the order of its size: buckets of it part what spans many powers of ten."""
    return F.when(value == 0, 0.0).otherwise(F.signum(value) * (F.ln(F.abs(F.greatest(F.lit(-MOST), F.least(F.lit(MOST), value)))) + 800))


def _bucket(value: Column, low: Column, high: Column) -> Column:
    """Rises with the value; the lowest value of a bracket is a bucket of its own, so every round narrows. Where the ends differ by
    over three powers of ten or in sign, buckets are cut by the order of size: few rounds do, whatever the distribution."""
    even = F.try_divide(_held(value) - _held(low), _held(high) - _held(low))
    by_order = F.try_divide(_order(value) - _order(low), _order(high) - _order(low))
    wide = (low < 0) & (high > 0) | (F.greatest(F.abs(low), F.abs(high)) > 1000 * F.least(F.abs(low), F.abs(high)))
    share = F.when(wide, by_order).otherwise(even)
    return F.when(value == low, 0).otherwise(F.coalesce(F.least(F.lit(BUCKETS), F.floor(share * BUCKETS) + 1), F.lit(1))).cast("int")


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out &= left[k].eqNullSafe(right[f"__key_{k}"])
    return out


def _between(values: Column, n: Column, at: list[float]) -> Column:
    """The quantiles ``at`` of ``n`` sorted ``values``. The one rounding is made of the exact errors of the product and of the sum.

    Each step is a transform of the step before, so a value is computed once however often it is used.
    """

    def ranks(p: Column) -> Column:
        where = (n - 1) * p
        return F.struct(F.get(values, F.floor(where).cast("int")).alias("low"), F.get(values, F.ceil(where).cast("int")).alias("high"), (where - F.floor(where)).alias("share"))

    def products(r: Column) -> Column:
        rest = 1 - r["share"]
        return F.struct(r["low"].alias("low"), r["high"].alias("high"), rest.alias("rest"), (r["low"] * rest).alias("ab"), (r["high"] * r["share"]).alias("c"), (r["low"] * _SPLIT).alias("aw"), (rest * _SPLIT).alias("bw"))

    def halves(r: Column) -> Column:
        ah, bh = r["aw"] - (r["aw"] - r["low"]), r["bw"] - (r["bw"] - r["rest"])
        kept = [r[c].alias(c) for c in ("low", "high", "ab", "c")]
        return F.struct(*kept, ah.alias("ah"), (r["low"] - ah).alias("al"), bh.alias("bh"), (r["rest"] - bh).alias("bl"), (r["ab"] + r["c"]).alias("sum"), (r["ab"] + r["c"] - r["ab"]).alias("back"))

    def rounded(r: Column) -> Column:
        lost = ((r["ah"] * r["bh"] - r["ab"]) + r["ah"] * r["bl"] + r["al"] * r["bh"]) + r["al"] * r["bl"]
        fused = r["sum"] + (((r["ab"] - (r["sum"] - r["back"])) + (r["c"] - r["back"])) + lost)
        fine = F.greatest(F.abs(r["low"]), F.abs(r["high"])) < 1e290
        return F.when(r["low"] == r["high"], r["low"]).when(fine, fused).otherwise(r["sum"])

    found = F.array(*[F.lit(float(p)) for p in at])
    for step in (ranks, products, halves, rounded):
        found = F.transform(found, step)
    return found


def exact_quantiles(values: DataFrame, keys: list[str], at: list[float], value: str = "value", small: int = SMALL) -> DataFrame:
    """``keys``, ``n``, ``low``, ``high``, ``quantiles`` (array, one for each of ``at``) with linear interpolation between ranks.

    Null and NaN are missing: not counted. A group without values has ``n`` 0 and nulls. Null keys are a group. Infinite values are values. ``keys``
    may be empty: one group, also of no rows. ``values`` is read once for the sizes, once for small groups, and once a round if there are large ones.
    """
    own = values.select(*keys, F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double")).alias("__v"))
    ends = [F.count("__v").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")]
    sizes = own.groupBy(*keys).agg(*ends)
    large = sizes.where(F.col("n") > small).collect()

    def direct(df: DataFrame) -> DataFrame:
        held = df.groupBy(*keys).agg(*ends, F.sort_array(F.collect_list("__v")).alias("__sorted"))
        each = _between(F.col("__sorted"), F.col("n"), at)
        return held.select(*keys, "n", "low", "high", F.when(F.col("n") > 0, each).alias("quantiles"))

    if not large:
        return direct(own)
    kinds = [sizes.schema[k].dataType for k in keys]
    spark = values.sparkSession
    names = [f"__key_{k}" for k in keys]
    marks = literal_rows(spark, names, kinds, [tuple(r[k] for k in keys) for r in large]) if keys else None
    rest = direct(own.join(F.broadcast(marks), _same(own, marks, keys), "left_anti")) if keys else None
    # a bracket: group, rank in the group, least and most value, rank within the bracket, rows in it
    open_ = []
    for g, r in enumerate(large):
        ranks = {x for p in at for x in (math.floor((r["n"] - 1) * p), math.ceil((r["n"] - 1) * p))}
        open_ += [(g, rank, r["low"], r["high"], rank, r["n"]) for rank in ranks]
    found: dict[tuple[int, int], float] = {}
    state = ["__group", "__rank", "__low", "__high", "__within"]
    while open_:
        found |= {(g, rank): low for g, rank, low, high, _, _ in open_ if low == high}
        open_ = [b for b in open_ if b[2] != b[3]]
        if not open_:
            break
        brackets = literal_rows(spark, [*names, *state], [*kinds, "int", "bigint", "double", "double", "bigint"], [(*(large[b[0]][k] for k in keys), *b[:5]) for b in open_])
        inside = (F.col("__v") >= F.col("__low")) & (F.col("__v") <= F.col("__high"))
        rows = own.join(F.broadcast(brackets), _same(own, brackets, keys) & inside)
        last = all(b[5] <= small for b in open_)
        bucket = F.col("__v") if last else _bucket(F.col("__v"), F.col("__low"), F.col("__high"))
        counts = rows.groupBy("__group", "__rank", "__within", bucket.alias("__bucket")).agg(F.count(F.lit(1)).alias("__n"), F.min("__v").alias("__from"), F.max("__v").alias("__to"))
        before = Window.partitionBy("__group", "__rank").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
        placed = counts.withColumn("__below", F.coalesce(F.sum("__n").over(before), F.lit(0)))
        hits = placed.where((F.col("__below") <= F.col("__within")) & (F.col("__within") < F.col("__below") + F.col("__n")))
        open_ = [(r["__group"], r["__rank"], r["__from"], r["__to"], r["__within"] - r["__below"], r["__n"]) for r in hits.collect()]
    rows = []
    for g, r in enumerate(large):
        out = []
        for p in at:
            where = (r["n"] - 1) * p
            a, b = math.floor(where), math.ceil(where)
            low, high, share = found[g, a], found[g, b], where - a
            fine = max(abs(low), abs(high)) < 1e290
            out.append(low if low == high else math.fma(low, 1 - share, high * share) if fine else low * (1 - share) + high * share)
        rows.append((*(r[k] for k in keys), r["n"], r["low"], r["high"], out))
    done = literal_rows(spark, [*keys, "n", "low", "high", "quantiles"], [*kinds, "bigint", "double", "double", "array<double>"], rows)
    return done if rest is None else rest.unionByName(done)
