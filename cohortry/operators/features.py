"""Leakage-safe clinical features and embeddings: everything is fitted on training rows and applied to all."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quantiles, spread
from .ranking import md5_number, numbered_within


@dataclass(frozen=True)
class ColumnPolicy:
    """Which columns a model may use; ``discuss`` and ``leakage`` are never used by themselves."""

    allowed: list[str]
    discuss: list[str] = field(default_factory=list)
    leakage: list[str] = field(default_factory=list)

    def usable(self, df: DataFrame) -> list[str]:
        barred = set(self.discuss) | set(self.leakage)
        return [c for c in self.allowed if c in df.columns and c not in barred]


@dataclass(frozen=True)
class FeatureSchema:
    """Fitted values of each column. ``numeric`` and ``fills`` are one entry a column; categories are a table, however many they are."""

    numeric: dict[str, tuple[float, float, float]]  # fill, mean, std
    fills: dict[str, str]  # of each categorical column: what stands for a missing value
    vocabulary: DataFrame | None  # column, value, n (training rows), slot (from len(numeric))
    width: int
    missing_slot: bool = False


MISSING = "__missing__"


def _known(column: str) -> Column:
    """As a double; NaN is missing."""
    return F.nanvl(F.col(column).cast("double"), F.lit(None).cast("double"))


def fit_features(train: DataFrame, numeric: list[str], categorical: list[str], variant: str = "probe", small: int = quantiles.SMALL) -> FeatureSchema:
    """``probe``: median and most frequent value, population std, unknown categories all zero.
    ``schema``: mean, sample std, and ``__missing__`` as a category of its own for missing and unknown values.

    Ties of the most frequent value go to the smallest. Medians are found by narrowing down. Categories are counted with map-side
    combining, numbered by a hash of their text in two levels, and saved as a table; the driver sees one row a column.
    """
    if variant == "probe":
        each = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("v")) for c in numeric])
        found = quantiles.exact_quantiles(train.select(F.inline(each)), ["column"], [0.5], value="v", small=small).collect() if numeric else []
        fills = {r["column"]: r["quantiles"][0] for r in found if r["quantiles"]}
    else:
        fills = train.agg(*[F.avg(_known(c)).alias(c) for c in numeric]).first().asDict() if numeric else {}
    fill = {c: fills.get(c) if fills.get(c) is not None else 0.0 for c in numeric}
    std = F.stddev_pop if variant == "probe" else F.stddev_samp
    known = {c: F.coalesce(_known(c), F.lit(fill[c])) for c in numeric}
    spreads = train.agg(*[a for c in numeric for a in (F.avg(known[c]).alias(f"m_{c}"), std(known[c]).alias(f"s_{c}"))]).first() if numeric else {}
    numbers = {c: (fill[c], spreads[f"m_{c}"] or 0.0, spreads[f"s_{c}"] or 0.0) for c in numeric}
    if not categorical:
        return FeatureSchema(numbers, {}, None, len(numeric), variant != "probe")
    values = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in categorical])
    counts = train.select(F.inline(values)).where("value is not null").groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    if variant != "probe":
        counts = counts.where(F.col("value") != MISSING).unionByName(train.sparkSession.range(0, 1, 1, 1).select(F.explode(F.array(*map(F.lit, categorical))).alias("column"), F.lit(MISSING).alias("value"), F.lit(0).cast("long").alias("n")))
    counts = spread.saved(counts)
    # one row a column: how many categories, and the most frequent one, the smallest of equals
    rows = {r["column"]: r for r in counts.groupBy("column").agg(F.count(F.lit(1)).alias("size"), F.min(F.struct((-F.col("n")).alias("n"), "value")).alias("top")).collect()}
    first, base = len(numeric), []
    for c in categorical:
        base += [F.lit(c), F.lit(first)]
        first += rows[c]["size"] if c in rows else 0
    placed = numbered_within(counts, ["column"], md5_number(F.col("value")), "value", "place")
    vocabulary = spread.saved(placed.select("column", "value", "n", (F.create_map(*base)[F.col("column")] + F.col("place") - 1).cast("int").alias("slot")))
    spread.discard(counts)
    tops = {c: rows[c]["top"]["value"] if variant == "probe" and c in rows else MISSING for c in categorical}
    return FeatureSchema(numbers, tops, vocabulary, first, variant != "probe")


def feature_names(spark: SparkSession, schema: FeatureSchema) -> DataFrame:
    """``slot``, ``feature``: a numeric column, or ``column=category``."""
    numbers = [(k, c) for k, c in enumerate(schema.numeric)]
    own = spread.literal_rows(spark, ["slot", "feature"], ["int", "string"], numbers) if numbers else None
    if schema.vocabulary is None:
        return own
    words = schema.vocabulary.select("slot", F.concat_ws("=", "column", "value").alias("feature"))
    return words if own is None else own.unionByName(words)


def encode_features(rows: DataFrame, schema: FeatureSchema, key: str) -> DataFrame:
    """``key``, ``features``: struct(indices, values) of what is not 0, indices rising. ``key`` tells rows apart.

    A column's categories are joined to the vocabulary, so it may hold any number of them; a category that holds much of the table is
    spread. Missing categories are the fill; unknown ones are nothing, or ``__missing__`` where that is a category. A numeric column
    that is constant in training is 0.
    """
    scaled = [F.when(F.lit(std > 0), (F.coalesce(_known(c), F.lit(fill)) - mean) / std).otherwise(0.0) for c, (fill, mean, std) in schema.numeric.items()]
    cells = F.filter(F.array(*[F.struct(F.lit(k).alias("slot"), v.alias("value")) for k, v in enumerate(scaled)]), lambda x: x["value"] != 0) if scaled else F.array().cast("array<struct<slot:int,value:double>>")
    entries = rows.select(key, F.explode_outer(cells).alias("cell")).select(key, "cell.slot", "cell.value")
    if schema.vocabulary is not None:
        held = F.array(*[F.struct(F.lit(c).alias("column"), F.coalesce(F.col(c).cast("string"), F.lit(fill)).alias("category")) for c, fill in schema.fills.items()])
        words = schema.vocabulary.select("column", F.col("value").alias("category"), "slot", "n")
        heavy = spread.heavy_keys(words, ["column", "category"], "n")
        found = spread.spread_join(rows.select(key, F.inline(held)), words.drop("n"), ["column", "category"], heavy, [key], "left")
        if schema.missing_slot:
            other = schema.vocabulary.where(F.col("value") == MISSING).select("column", "slot").collect()  # one row a column
            found = found.withColumn("slot", F.coalesce("slot", F.create_map(*[x for r in other for x in (F.lit(r["column"]), F.lit(r["slot"]))])[F.col("column")]))
        entries = entries.unionByName(found.select(key, "slot", F.when(F.col("slot").isNotNull(), F.lit(1.0)).alias("value")))
    cell = F.when(F.col("slot").isNotNull(), F.struct("slot", "value"))
    listed = F.array_sort(F.collect_list(cell))
    return entries.groupBy(key).agg(listed.alias("cells")).select(key, F.struct(F.col("cells.slot").alias("indices"), F.col("cells.value").alias("values")).alias("features"))


def dense_features(encoded: DataFrame, schema: FeatureSchema) -> DataFrame:
    """``features`` as an array of doubles of the schema's width."""
    held = F.map_from_arrays("features.indices", "features.values")
    dense = F.transform(F.sequence(F.lit(0), F.lit(schema.width - 1)), lambda k: F.coalesce(F.try_element_at(held, k), F.lit(0.0))) if schema.width else F.array().cast("array<double>")
    return encoded.withColumn("features", dense)


def balanced_weights(train: DataFrame, label: str = "label") -> DataFrame:
    """``train`` with ``weight`` = n / (2 * rows of the class); the weights sum to n."""
    counts = train.groupBy(F.col(label).alias("__l")).agg(F.count(F.lit(1)).alias("__n"))
    total = train.count()
    return train.join(counts, F.col(label) == F.col("__l")).withColumn("weight", F.lit(float(total)) / (2 * F.col("__n"))).drop("__l", "__n")


def pool_slices(slices: DataFrame, keys: list[str], column: str = "embedding", mode: str = "mean") -> DataFrame:
    """One vector a key: mean, max or both joined, position by position."""
    if mode not in ("mean", "max", "mean_max"):
        raise ValueError(f"unknown pooling {mode!r}")
    each = slices.select(*keys, F.posexplode(column).alias("pos", "v"))
    pooled = each.groupBy(*keys, "pos").agg(F.avg("v").alias("mean"), F.max(F.col("v").cast("double")).alias("max"))
    listed = pooled.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("pos", "mean", "max"))).alias("l"))
    parts = {"mean": [F.col("l.mean")], "max": [F.col("l.max")], "mean_max": [F.col("l.mean"), F.col("l.max")]}[mode]
    return listed.select(*keys, F.concat(*parts).alias(column))


def fuse_embeddings(tables: DataFrame, labels: list[str], key: str = "patient_id", label: str = "model_key", column: str = "embedding") -> DataFrame:
    """One concatenated vector for each key that has all labels, in the order asked for, over one shuffle."""
    held = tables.where(F.col(label).isin(labels)).groupBy(key).agg(F.map_from_entries(F.collect_list(F.struct(label, column))).alias("m"))
    return held.where(F.size("m") == len(labels)).select(key, F.concat(*[F.col("m")[name] for name in labels]).alias(column))
