"""Near duplicates by min-max hashing, links confirmed on full shingle sets, and their components.

Each permutation yields its minimum and its maximum over a document's shingles, so half the hash evaluations
make a signature of a given length. Bands over the minima and over the maxima give buckets.

Documents with one shingle set are one class from the start, so copies cost nothing. In each bucket every class
is compared with one pivot, drawn anew for each bucket. After components are formed, classes of a bucket that are
still apart are compared with each other, but only where counts allow a link: an intersection is at most the sum,
over classes of shingles, of the smaller count of shingles that occur in more than one of the sets in question.
No bucket is expanded into all its pairs, none is capped, and a link between different classes is lost only if
no band catches it (see ``miss_rate``).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bucketed, discard, heavy_keys, numbered, possible, remembered, saved, spread_join
from .graph import connected_components

#: Words that a worker remembers; a full memory is emptied.
MEMORY = 250_000
#: Shingles hashed at once; bounds memory for very long texts.
STEP = 1 << 15
#: Classes of shingles whose counts bound an intersection.
PARTS = 32


def miss_rate(similarity: float, bands: int, rows: int) -> float:
    """Chance that no band catches a pair of this similarity."""
    return (1 - similarity**rows) ** bands


class _Words(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def shingle_set(text: str | None, size: int) -> np.ndarray:
    """Sorted distinct 64-bit shingles: ``size`` words each, A-Z lower-cased, words split at ASCII white space.

    With fewer words the whole sequence is one shingle; without words the set is empty.
    """
    words = (text or "").encode().lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    ids = np.fromiter(map(remembered("shingle words", _Words).__getitem__, words), dtype=np.uint64, count=len(words))
    take = min(size, len(ids))
    made = np.full(len(ids) - take + 1, take, dtype=np.uint64)
    for k in range(take):
        made = made * np.uint64(0xA24BAED4963EE407) + ids[k : k + len(made)]
    return np.unique(_mixed(made))


def _extremes(shingles: np.ndarray, factors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    low, high = np.full(len(factors), 2**64 - 1, dtype=np.uint64), np.zeros(len(factors), dtype=np.uint64)
    for at in range(0, len(shingles), STEP):
        values = np.multiply.outer(factors, shingles[at : at + STEP])
        np.minimum(low, values.min(axis=1), out=low)
        np.maximum(high, values.max(axis=1), out=high)
    return low, high


def sketches(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4, bands: int = 24, rows: int = 4, seed: int = 7) -> DataFrame:
    """``id``, ``set_key`` (16 bytes, equal for equal sets; null for the empty set), ``n`` and ``buckets`` (one a band).

    Half the bands are over minima, half over maxima, ``bands * rows / 2`` permutations in all.
    """
    if bands % 2:
        raise ValueError("bands must be even: half for minima, half for maxima")
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    factors = np.random.default_rng(seed).integers(0, 2**63, size=bands * rows // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    weights = np.random.default_rng(seed + 1).integers(0, 2**63, size=rows, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    schema = T.StructType([own.schema["id"], T.StructField("set_key", T.BinaryType()), T.StructField("n", T.LongType()), T.StructField("buckets", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                keys, counts = [], []
                signatures = np.zeros((part.num_rows, bands, rows), dtype=np.uint64)
                for k, text in enumerate(part.column(1).to_pylist()):
                    found = shingle_set(text, size)
                    counts.append(len(found))
                    keys.append(xxhash.xxh3_128_digest(found.tobytes()) if len(found) else None)
                    if len(found):
                        low, high = _extremes(found, factors)
                        signatures[k, : bands // 2] = low.reshape(-1, rows)
                        signatures[k, bands // 2 :] = high.reshape(-1, rows)
                buckets = _mixed((_mixed(signatures) * weights).sum(axis=2, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))
                flat = pa.array(buckets.view(np.int64).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * bands), flat)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), pa.array(counts, pa.int64()), lists], names=["id", "set_key", "n", "buckets"])

    return own.mapInArrow(run, schema)


def shingle_sets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 4) -> DataFrame:
    """``id``, ``set_key``, ``shingles`` (array of long): the full sets."""
    own = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    schema = T.StructType([own.schema["id"], T.StructField("set_key", T.BinaryType()), T.StructField("shingles", T.ArrayType(T.LongType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        for batch in batches:
            for first in range(0, batch.num_rows, 500):
                part = batch.slice(first, 500)
                found = [shingle_set(t, size) for t in part.column(1).to_pylist()]
                keys = [xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in found]
                offsets = np.concatenate([[0], np.cumsum([len(x) for x in found])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found).view(np.int64)))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(keys, pa.binary()), lists], names=["id", "set_key", "shingles"])

    return own.mapInArrow(run, schema)


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose sets have 100 * intersection >= percent * union; ``pairs`` is saved, ``sets`` in buckets by class.

    Most pairs meet the sets where they lie. Those with a class of very many pairs are spread, and only their sets move.
    """
    heavy = [heavy_keys(pairs.groupBy(c).agg(F.count(F.lit(1)).alias("uses")), [c], "uses") for c in ("a", "b")]
    if heavy == [None, None]:
        return _linked(pairs, sets, percent, heavy)
    marked = pairs.withColumn("__hot", F.lit(False))
    for c, keys in zip(("a", "b"), heavy, strict=True):
        if keys is not None:
            marked = marked.join(F.broadcast(keys), c, "left").withColumn("__hot", F.col("__hot") | F.col("__heavy").isNotNull()).drop("__heavy")
    marked = saved(marked)
    light, hot = (marked.where(c).drop("__hot") for c in ("not __hot", "__hot"))
    used = saved(hot.select(F.col("a").alias("class")).unionByName(hot.select(F.col("b").alias("class"))).distinct())
    moved = possible(sets, used, ["class"], used.count()).where("possible").drop("possible")
    return _linked(light, sets, percent, [None, None]).unionByName(_linked(hot, moved, percent, heavy))


def _linked(pairs: DataFrame, sets: DataFrame, percent: int, heavy: list[DataFrame | None]) -> DataFrame:
    left = sets.select(F.col("class").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("class").alias("b"), F.col("shingles").alias("right"))
    common = F.size(F.array_intersect("left", "right"))
    both = spread_join(spread_join(pairs, left, ["a"], heavy[0], ["b"]), right, ["b"], heavy[1], ["a"]).select("a", "b", common.alias("common"), (F.size("left") + F.size("right")).alias("total"))
    return both.where(100 * F.col("common") >= percent * (F.col("total") - F.col("common"))).select("a", "b")


def _near_in_size(percent: int) -> str:
    return f"100 * least(n, other_n) >= {percent} * greatest(n, other_n)"


def _shared_counts(sets: DataFrame) -> DataFrame:
    """``class``, ``shared``: for each part of the shingle space, how many of a set's shingles another set has too."""
    each = sets.select("class", F.explode("shingles").alias("s")).withColumn("part", F.pmod("s", F.lit(PARTS)).cast("int"))
    own = each.groupBy("class", "part").agg(F.count(F.lit(1)).alias("n"))
    once = each.groupBy("s", "part").agg(F.count(F.lit(1)).alias("n"), F.min("class").alias("class")).where("n = 1")
    once = once.groupBy("class", "part").agg(F.count(F.lit(1)).alias("alone"))
    left = own.join(once, ["class", "part"], "left").select("class", "part", (F.col("n") - F.coalesce("alone", F.lit(0))).cast("int").alias("n"))
    counts = left.groupBy("class").agg(F.map_from_entries(F.collect_list(F.struct("part", "n"))).alias("m"))
    return counts.select("class", F.transform(F.sequence(F.lit(0), F.lit(PARTS - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0))).alias("shared"))


def _apart(named: DataFrame, traits: DataFrame, percent: int, bands: int, heavy: DataFrame | None) -> DataFrame:
    """Pairs (a, b) of classes that share a bucket, have different labels, and may be linked by their counts.

    ``named``: class, n, band, bucket, label; ``heavy``: large buckets. In a bucket, all classes meet those outside its largest component; a
    pair is taken at the first band that it shares.
    """
    named = saved(named.join(traits, "class"))
    most = named.groupBy("bucket", "label").agg(F.count(F.lit(1)).alias("members"))
    most = most.groupBy("bucket").agg(F.max(F.struct("members", "label"))["label"].alias("main"))
    rest = spread_join(named, most, ["bucket"], heavy, ["class"]).where("label <> main").select("bucket", *[F.col(c).alias(f"other_{c}") for c in ("class", "n", "label", "shared", "buckets")])
    bound = sum((F.least(F.col("shared")[k], F.col("other_shared")[k]) for k in range(1, PARTS)), F.least(F.col("shared")[0], F.col("other_shared")[0]))
    first = F.when(F.col("buckets")[0] == F.col("other_buckets")[0], 0)
    for k in range(1, bands):
        first = first.when(F.col("buckets")[k] == F.col("other_buckets")[k], k)
    may = (100 + percent) * bound >= percent * (F.col("n") + F.col("other_n"))
    met = spread_join(named, rest, ["bucket"], heavy, ["class"]).where((F.col("label") != F.col("other_label")) & F.expr(_near_in_size(percent)) & (first == F.col("band")) & may)
    return met.select(F.least("class", "other_class").alias("a"), F.greatest("class", "other_class").alias("b")).distinct()


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    size: int = 5,
    percent: int = 80,
    bands: int = 24,
    rows: int = 4,
) -> DataFrame:
    """Every row with its group: ``id_col``, ``n_shingles``, ``component_id``, ``kept``.

    Rows are linked where 100 * intersection >= ``percent`` * union of their sets of ``size``-word shingles;
    ``component_id`` is the smallest id that can be reached over links, ``kept`` whether it is the row's own.

    * Null, empty or blank text: empty set, linked with nothing, ``component_id`` is the row's own id.
    * Rows with equal sets are linked. Repeated rows are all returned, and all ``kept`` if their id is the smallest.
    * Null ids: never the smallest, unless a group has no other. An empty table gives no rows.
    * Other columns of ``docs`` are not read, whatever their names.
    """
    rows_ = saved(sketches(docs, id_col, text_col, size, bands, rows))
    full = rows_.where("set_key is not null")
    lowest_id = F.min(F.struct(F.col("id").isNull().alias("none"), "id"))["id"].alias("first_id")
    placed = full.groupBy("set_key").agg(lowest_id, F.count(F.lit(1)).alias("copies"), F.first("n").alias("n"), F.first("buckets").alias("buckets"))
    placed = saved(placed)
    firsts = placed.select("set_key", "first_id", "copies")
    places = placed.select("set_key", "n", F.posexplode("buckets").alias("band", "bucket"))
    crowded = saved(places.groupBy("bucket").agg(F.count(F.lit(1)).alias("classes")).where("classes > 1"))
    heavy = heavy_keys(crowded, ["bucket"], "classes")
    # most buckets hold one class: their places do not move
    places = possible(places, crowded, ["bucket"], crowded.count()).where("possible").drop("possible")
    found = saved(spread_join(places, crowded.select("bucket"), ["bucket"], heavy, ["set_key"]))
    classes = numbered(found.select("set_key").distinct(), "set_key", name="class")
    met = saved(found.join(classes, "set_key").select("class", "n", "band", "bucket"))
    discard(crowded, found)

    wanted = saved(classes.join(firsts, "set_key").select(F.col("first_id").alias(id_col), F.col("set_key").alias("want_key"), "class"))
    known = wanted.where(F.col(id_col).isNotNull()).select(id_col)
    texts = possible(docs.select(id_col, text_col), known, [id_col], wanted.count(), "__possible").where("__possible").drop("__possible")
    texts = texts.join(known.distinct(), id_col, "left_semi")
    lacking = wanted.where(F.col(id_col).isNull())
    if not lacking.isEmpty():
        texts = texts.unionByName(docs.select(id_col, text_col).where(F.col(id_col).isNull()))
    sets = shingle_sets(texts, id_col, text_col, size).select("set_key", "shingles")
    sets = bucketed(sets.join(wanted.select(F.col("want_key").alias("set_key"), "class"), "set_key").select("class", "shingles"), "class")
    discard(wanted)

    pivots = met.groupBy("bucket").agg(F.min(F.struct(F.xxhash64("class", "bucket"), "class", "n")).alias("p"))
    pivots = pivots.select("bucket", F.col("p.class").alias("other"), F.col("p.n").alias("other_n"))
    near = spread_join(met, pivots, ["bucket"], heavy, ["class"]).where("class <> other").where(_near_in_size(percent))
    pairs = saved(near.select(F.least("class", "other").alias("a"), F.greatest("class", "other").alias("b")).distinct())
    links = saved(_confirmed(pairs, sets, percent))

    labels = saved(connected_components(links))
    named = met.join(labels, met["class"] == labels["node"], "left").select("class", "n", "band", "bucket", F.coalesce("label", "class").alias("label"))
    named = saved(named)
    split = named.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low < high").select("bucket")
    apart = saved(spread_join(named, split, ["bucket"], heavy, ["class"]))
    open_ = apart.select("class").distinct()
    traits = _shared_counts(sets.join(open_, "class", "left_semi"))
    traits = traits.join(placed.join(classes, "set_key").join(open_, "class", "left_semi").select("class", "buckets"), "class")
    more = saved(_apart(apart, traits, percent, bands, heavy).join(pairs, ["a", "b"], "left_anti"))
    late = saved(_confirmed(more, sets, percent))
    if not late.isEmpty():
        # components of the first links stand for their members
        joined = late.join(labels.select(F.col("node").alias("a"), F.col("label").alias("from")), "a", "left").join(labels.select(F.col("node").alias("b"), F.col("label").alias("to")), "b", "left")
        between = saved(joined.select(F.coalesce("from", "a").alias("a"), F.coalesce("to", "b").alias("b")).distinct())
        tops = saved(connected_components(between))
        ends = labels.unionByName(tops.select("node", F.col("node").alias("label")).join(labels.select("node"), "node", "left_anti"))
        sizes = ends.groupBy("label").agg(F.count(F.lit(1)).alias("members"))
        tops_of = saved(sizes.join(tops.select(F.col("node").alias("label"), F.col("label").alias("top")), "label", "left").withColumn("top", F.coalesce("top", "label")))
        renamed = spread_join(ends, tops_of, ["label"], heavy_keys(tops_of, ["label"], "members"), ["node"])
        labels = saved(renamed.select("node", F.col("top").alias("label")))
    discard(met, sets, pairs, links, named, apart, more, late)

    grouped = labels.join(classes, labels["node"] == classes["class"]).join(firsts, "set_key").select("set_key", "label", "first_id")
    lowest = grouped.groupBy("label").agg(F.min("first_id").alias("lowest"), F.count(F.lit(1)).alias("members"))
    lowest = saved(lowest)
    found = spread_join(grouped, lowest, ["label"], heavy_keys(lowest, ["label"], "members"), ["set_key"])
    found = firsts.join(found.select("set_key", "lowest"), "set_key", "left")
    found = saved(found.select("set_key", "copies", F.coalesce("lowest", "first_id").alias("component_id")))
    linked = spread_join(full.select("id", "n", "set_key"), found, ["set_key"], heavy_keys(found, ["set_key"], "copies"), ["id"]).select("id", "n", "component_id")
    alone = rows_.where("set_key is null").select("id", "n", F.col("id").alias("component_id"))
    return linked.unionByName(alone).select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "component_id", F.col("id").eqNullSafe(F.col("component_id")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, one id of each group, with all their columns."""
    found = near_duplicates(docs, id_col, text_col, **options).groupBy(F.col(id_col).alias("__id")).agg(F.bool_or("kept").alias("stays"))
    gone = saved(found.where("not stays").select("__id"))
    # fewer rows go than stay: most stay where they are
    rows = possible(docs.withColumn("__id", F.col(id_col)), gone, ["__id"], gone.count(), "__possible")
    own = [F.col(c) for c in docs.columns]
    judged = rows.where("__possible").join(gone.withColumnRenamed("__id", "__gone_id"), F.col("__id").eqNullSafe(F.col("__gone_id")), "left_anti")
    return rows.where("not __possible").select(*own).unionByName(judged.select(*own))
