"""Stratified paired bootstrap: one table of draws for all runs, weighted metrics, intervals and paired deltas.

A draw is a hash of (seed, replicate, stratum, slot), so every engine and every rerun draws alike. Draws are made from the sizes of strata alone,
by ranges of slots and blocks of replicates, and sent packed to the chunk of slots they drew: two bytes a draw, and no sort. There a chunk's
draws are counted in one matrix, next to the predictions of its subjects by all runs, and what leaves is one row of weights for each
run and distinct score of a chunk and block. So what is shuffled grows with subjects x replicates, not with runs x subjects x replicates, where scores
are few; else with their distinct ones. Rows of weights are dealt by block, run and range of scores, each range is swept from the highest
score down for all replicates of a block at once, and the sums of ranges are merged. The sort spills, and the sweep holds one batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.group_ops import PandasCogroupedOps

from . import metrics, spread
from ..functions.digest import Numbered, numbered
from .ranking import numbered_within, seeded

VALUES = ["auroc", "average_precision", "balanced_accuracy"]
#: Replicates that are swept together.
BLOCK = 100
#: Slots of a stratum whose draws are counted together (at most 65,536).
CHUNK = 1 << 12
#: Slots of a stratum that one task draws from at a time.
SOURCE = 1 << 16
#: Draws that are hashed together.
HASHED = 1 << 14
#: Rows of weights that are swept at a time.
SWEPT = 2048
#: Predictions of a range of scores, all runs together, that one task sweeps for a block of replicates.
RANGE_ROWS = 1 << 20


class Draws(NamedTuple):
    """Draws packed by chunks of ``CHUNK`` slots of a stratum and blocks of ``size`` replicates; columns ``strata`` name the stratum.

    ``subjects``: ``strata``, subject, ``chunk``, ``slot`` (from 0 within the chunk). ``hits``: ``strata``, ``chunk``, ``block`` and ``packed``: how often each
    replicate of the block drew from the chunk, then the slots drawn, replicate after replicate. A chunk has a row for each ``SOURCE`` draws of its stratum.
    """

    subjects: DataFrame
    hits: DataFrame
    strata: list[str]
    replicates: int
    size: int


def draw_blocks(
    subjects: DataFrame, replicates: int, seed: int, strata: tuple[str, ...] = ("dataset", "label"), subject: str = "patient_id", size: int = BLOCK, cohort: str | None = None
) -> Draws:
    """In every replicate a stratum draws as many of its slots as it has subjects.

    ``subjects`` has one row a subject; a stratum with a null is not drawn. Positions within a stratum follow a hash of the subject, then the
    subject. With ``cohort``, one of the ``strata``, each cohort draws by a seed of its own (``child_seed``).
    """
    keys = [f"s{k}" for k in range(len(strata))]
    drawn_by = F.lit(str(seed)) if cohort is None else child_seed(seed, cohort).cast("string")
    rest = F.concat_ws("|", F.lit(""), *[F.col(s).cast("string") for s in strata])
    own = subjects.where(" and ".join(f"`{s}` is not null" for s in strata)).select(*[F.col(s).alias(k) for s, k in zip(strata, keys, strict=True)], subject, drawn_by.alias("head"), rest.alias("rest"))
    sizes = own.groupBy(*keys).agg(F.count(F.lit(1)).alias("size"), F.first("head").alias("head"), F.first("rest").alias("rest"))
    placed = numbered_within(own.select(*keys, subject), keys, seeded(seed, subject), subject, "place")
    at = F.col("place") - 1
    ranked = placed.select(*keys, subject, F.floor(at / CHUNK).cast("int").alias("chunk"), (at % CHUNK).cast("int").alias("slot"))
    # work is few rows beside the draws: it is dealt before the draws are made, or one task would make them all
    work = sizes.withColumn("first", F.explode(F.sequence(F.lit(0), F.lit(replicates - 1), F.lit(size)))).withColumn("start", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(SOURCE).cast("long"))))
    work = work.repartition(4 * int(subjects.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    schema = T.StructType([*(sizes.schema[k] for k in keys), T.StructField("chunk", T.IntegerType()), T.StructField("block", T.IntegerType()), T.StructField("packed", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, parts = None, []
        for batch in batches:
            for k, row in enumerate(batch.select(["size", "head", "rest", "first", "start"]).to_pylist()):
                ends = row["start"], min(row["start"] + SOURCE, row["size"])
                if known != ends:
                    known, parts = ends, numbered(*ends)
                drawn: dict[int, tuple[list[int], list[bytes]]] = {}
                prefixes = [f"{row['head']}|{row['first'] + hit}{row['rest']}|".encode() for hit in range(min(size, replicates - row["first"]))]
                for hit, slots in _slots(prefixes, parts, row["size"]):
                    if row["size"] > CHUNK:
                        slots.sort()
                    chunks = slots // CHUNK
                    starts = [*_changes(chunks).tolist(), len(slots)]
                    for a, b in zip(starts[:-1], starts[1:], strict=True):
                        counts, there = drawn.setdefault(int(chunks[a]), ([0] * size, []))
                        counts[hit] = b - a
                        there.append((slots[a:b] % CHUNK).astype("<u2").tobytes())
                packed = [np.array(counts, "<i4").tobytes() + b"".join(there) for counts, there in drawn.values()]
                n = len(packed)
                made = [pa.array(list(drawn), pa.int32()), pa.array([row["first"] // size] * n, pa.int32()), pa.array(packed, pa.binary())]
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(s)[k], n) for s in keys), *made], names=schema.names)

    return Draws(ranked, work.mapInArrow(run, schema), keys, replicates, size)


def _slots(prefixes: list[bytes], parts: list[Numbered], size: int) -> Iterator[tuple[int, np.ndarray]]:
    """The number of each prefix and the slots it draws; prefixes of one length are hashed together, some ``HASHED`` draws at a time."""
    at, step = 0, max(1, HASHED // sum(p.n for p in parts))
    while at < len(prefixes):
        end = at + 1
        while end < min(at + step, len(prefixes)) and len(prefixes[end]) == len(prefixes[at]):
            end += 1
        yield from enumerate(np.concatenate([p.of(prefixes[at:end]) for p in parts], axis=1) % np.uint32(size), at)
        at = end


def _changes(values: np.ndarray) -> np.ndarray:
    """Where a value differs from the one before it; the first does."""
    return np.flatnonzero(np.r_[True, values[1:] != values[:-1]])


def _beside(draws: Draws, lists: DataFrame) -> PandasCogroupedOps:
    """The hits of each chunk and block next to the chunk's ``lists``, which are copied once a block."""
    keys = [*draws.strata, "chunk", "block"]
    copied = lists.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit((draws.replicates - 1) // draws.size))))
    return draws.hits.groupBy(*keys).cogroup(copied.groupBy(*keys))


def _counted(packed: pa.ChunkedArray, size: int) -> np.ndarray:
    """How often each replicate of a block (columns) drew each slot of a chunk (rows)."""
    places = []
    for one in packed:
        held = one.as_buffer()
        places.append(np.frombuffer(held, "<u2", offset=4 * size).astype(np.int64) * size + np.repeat(np.arange(size), np.frombuffer(held, "<i4", size)))
    return np.bincount(np.concatenate(places), minlength=CHUNK * size).reshape(CHUNK, size).astype(np.int32)


def child_seed(seed: int, cohort: str) -> Column:
    """A cohort's own seed: adding or leaving out other cohorts does not change its draws."""
    return seeded(seed, cohort)


def cohort_classes(subjects: DataFrame, cohort: str = "dataset", label: str = "label") -> DataFrame:
    """One row a cohort: ``n``, ``n_pos``, ``n_neg``, ``draw_status``: ``drawn``, or ``one_class_only`` where there is nothing to resample."""
    pos = F.count_if(F.col(label) == 1)
    found = subjects.groupBy(cohort).agg(F.count(F.lit(1)).alias("n"), pos.alias("n_pos"), F.count_if(F.col(label) == 0).alias("n_neg"))
    return found.withColumn("draw_status", F.when((F.col("n_pos") > 0) & (F.col("n_neg") > 0) & (F.col("n_pos") + F.col("n_neg") == F.col("n")), "drawn").otherwise("one_class_only"))


def with_both_classes(subjects: DataFrame, cohort: str = "dataset", label: str = "label") -> DataFrame:
    """Subjects of the cohorts that are drawn; cohorts are few rows beside their subjects, counted with map-side combining."""
    fine = cohort_classes(subjects, cohort, label).where("draw_status = 'drawn'").select(F.col(cohort).alias("__cohort"))
    return subjects.join(fine, F.col(cohort).eqNullSafe(F.col("__cohort")), "left_semi")


def draw_weights(subjects: DataFrame, replicates: int, seed: int, strata: tuple[str, ...] = ("dataset", "label"), subject: str = "patient_id", cohort: str | None = None) -> DataFrame:
    """``replicate``, ``subject``, ``weight``: how often each subject is drawn; weights of a stratum sum to its size."""
    draws = draw_blocks(subjects, replicates, seed, strata, subject, cohort=cohort)
    size = draws.size
    lists = draws.subjects.groupBy(*draws.strata, "chunk").agg(F.sort_array(F.collect_list(F.struct("slot", F.col(subject).alias("subject")))).alias("held"))
    schema = T.StructType([T.StructField("replicate", T.IntegerType()), subjects.schema[subject], T.StructField("weight", T.LongType())])

    def met(hits: pa.Table, held: pa.Table) -> pa.Table:
        # what is empty has no draws: every chunk has its list
        weights = _counted(hits.column("packed"), size) if hits.num_rows else np.zeros((CHUNK, size), np.int32)
        replicate, slot = np.nonzero(weights.T)
        ids = held.column("held").combine_chunks().flatten().field("subject").take(pa.array(slot))
        first = held.column("block")[0].as_py() * size
        return pa.table([pa.array((replicate + first).astype(np.int32)), ids, pa.array(weights[slot, replicate].astype(np.int64))], names=schema.names)

    return _beside(draws, lists).applyInArrow(met, schema)


def _starts(columns: list[pa.Array]) -> list[int]:
    """Where a row differs from the one before it; the first row does."""
    codes = np.stack([pc.fill_null(c.dictionary_encode().indices, -1).to_numpy() for c in columns])
    return [0, *(np.flatnonzero((codes[:, 1:] != codes[:, :-1]).any(axis=0)) + 1).tolist()] if codes.shape[1] else []


class _Sweep:
    """Sums of one run and block of replicates over a range of scores that come in falling order, behind what lies above the range."""

    def __init__(self, pos: np.ndarray, neg: np.ndarray) -> None:
        self.above, self.pos, self.neg, size = (pos, neg), pos, neg, len(pos)
        self.area, self.steps, self.tp, self.tn = np.zeros((4, size))
        self.score, self.waiting = None, np.zeros((2, 1, size))

    def fold(self, pos: np.ndarray, neg: np.ndarray) -> None:
        """Distinct scores, one a row."""
        above, below = pos.cumsum(axis=0) + self.pos, neg.cumsum(axis=0) + self.neg
        self.area += (neg * (above - pos / 2)).sum(axis=0)
        self.steps += (pos * above / np.maximum(above + below, 1)).sum(axis=0)
        self.pos, self.neg = above[-1], below[-1]

    def add(self, scores: np.ndarray, labels: np.ndarray, predicted: np.ndarray, weights: np.ndarray) -> None:
        """Rows of predictions. The lowest score waits, as the next rows may have it too."""
        pos, neg = weights * (labels == 1)[:, None], weights * (labels == 0)[:, None]
        self.tp += pos[predicted == 1].sum(axis=0)
        self.tn += neg[predicted == 0].sum(axis=0)
        starts = np.flatnonzero(np.r_[True, scores[1:] != scores[:-1]])
        pos, neg = np.add.reduceat(pos, starts, axis=0), np.add.reduceat(neg, starts, axis=0)
        if self.score == scores[0]:
            pos[0] += self.waiting[0][0]
            neg[0] += self.waiting[1][0]
        else:
            self.fold(*self.waiting)
        if len(starts) > 1:
            self.fold(pos[:-1], neg[:-1])
        self.score, self.waiting = scores[-1], (pos[-1:], neg[-1:])

    def sums(self) -> np.ndarray:
        """The range's own ``SUMS``, one column a replicate."""
        self.fold(*self.waiting)
        return np.stack([self.pos - self.above[0], self.neg - self.above[1], self.tp, self.tn, self.area, self.steps])


#: What ranges of scores add up to, for each run and replicate: drawn weight of the classes, of those predicted right, and
#: what AUROC and average precision gather while scores fall.
SUMS = ["pos", "neg", "tp", "tn", "area", "steps"]


def score_cuts(scores: DataFrame, range_rows: int) -> list[float]:
    """Rising scores that part ``scores`` (column ``score``) into ranges of some ``range_rows`` rows; a score that holds more
    rows stands twice or more. Empty if the rows are few. The driver sees one number a range."""
    n = scores.count()
    parts = -(-n // range_rows)
    if parts < 2:
        return []
    at = [k / parts for k in range(1, parts)]
    return sorted(scores.agg(F.percentile_approx("score", at, F.lit(max(10_000, 20 * parts)))).first()[0])


def _range_of(score: Column, cuts: list[float]) -> Column:
    """Number of the range, rising while scores fall: even ranges reach from one cut to the next, odd ones are a score that
    fills ranges by itself (cuts that are the same), which lies at the low end of the even range before it."""
    if not cuts:
        return F.lit(0)
    distinct = sorted(set(cuts))
    alone = [c for c in distinct if cuts.count(c) > 1]
    above = F.size(F.filter(F.array(*map(F.lit, distinct)), lambda c: c > score))
    return above * 2 + (score.isin(alone).cast("int") if alone else F.lit(0))


def _swept(rows: DataFrame, keys: list[str], size: int, sweep: bool) -> DataFrame:
    """``keys``, ``range``, ``replicate`` and ``SUMS`` of ``rows``, which are sorted by block, range, keys, ``kind``, then falling score.

    ``rows``: ``block``, ``range``, ``keys``, ``kind`` (0: what lies above the range, as ``before``; 1: predictions of one score), ``score``,
    ``label``, ``predicted``, ``weights``, ``before``. Without ``sweep`` only the first four sums are made, in any order of scores. One batch is held.
    """
    made = SUMS if sweep else SUMS[:4]
    schema = T.StructType([*(rows.schema[k] for k in keys), T.StructField("range", T.IntegerType()), T.StructField("replicate", T.IntegerType()), *(T.StructField(v, T.DoubleType()) for v in made)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, sums = None, None

        def ended() -> pa.RecordBatch:
            found = sums.sums() if sweep else sums
            there = np.flatnonzero(found[0] + found[1]) if sweep else np.arange(size)
            own = [pa.repeat(k, len(there)) for k in (*now[2:], now[1])]
            return pa.RecordBatch.from_arrays([*own, pa.array(there + now[0].as_py() * size, pa.int32()), *map(pa.array, found[:, there])], names=schema.names)

        for batch in (b.slice(at, SWEPT) for b in batches for at in range(0, b.num_rows, SWEPT)):
            weights = np.zeros((batch.num_rows, size))
            for k, held in enumerate(batch.column("weights")):
                if held.is_valid:
                    weights[k] = _unpacked(held.as_buffer(), size)
            scores, labels, predicted, kinds = (batch.column(c).to_numpy(zero_copy_only=False).astype(float) for c in ("score", "label", "predicted", "kind"))
            columns = [batch.column(c) for c in ("block", "range", *keys)]
            starts = [*_starts(columns), batch.num_rows]
            for first, end in zip(starts[:-1], starts[1:], strict=True):
                key = [c[first] for c in columns]
                if now is None or key != now:
                    if now is not None:
                        yield ended()
                    now, start = key, np.zeros((2, size))
                    if kinds[first] == 0:
                        for hit in batch.column("before")[first].as_py():
                            start[:, hit["hit"]] = hit["pos"], hit["neg"]
                        first += 1
                    sums = _Sweep(*start) if sweep else np.zeros((4, size))
                if first == end:
                    continue
                own = slice(first, end)
                if sweep:
                    sums.add(scores[own], labels[own], predicted[own], weights[own])
                else:
                    pos, neg = labels[own] == 1, labels[own] == 0
                    for k, chosen in enumerate((pos, neg, pos & (predicted[own] == 1), neg & (predicted[own] == 0))):
                        sums[k] += weights[own][chosen].sum(axis=0)
        if now is not None:
            yield ended()

    return rows.mapInArrow(run, schema)


def _packed_weights(weights: np.ndarray) -> list[bytes | None]:
    """A row of weights as bytes, one or four a replicate; none where all are 0."""
    top = weights.max(axis=1, initial=0)
    return [None if m == 0 else row.astype(np.uint8 if m < 256 else "<i4").tobytes() for m, row in zip(top.tolist(), weights, strict=True)]


def _unpacked(held: pa.Buffer, size: int) -> np.ndarray:
    return np.frombuffer(held, np.uint8 if held.size == size else "<i4")


def _weighted_scores(preds: DataFrame, draws: Draws, keys: list[str], subject: str) -> DataFrame:
    """``block``, ``keys``, ``score``, ``label``, ``predicted`` and ``weights``: how often each replicate of the block drew the chunk's
    predictions that are alike in all of these. ``preds``: ``keys``, ``subject``, ``score``, ``label``, ``predicted``."""
    placed = preds.join(draws.subjects, subject)
    lists = placed.groupBy(*draws.strata, "chunk", *keys).agg(F.collect_list(F.struct("slot", "score", "label", "predicted")).alias("rows"))
    schema = T.StructType([T.StructField("block", T.IntegerType()), *(lists.schema[k] for k in keys), *(T.StructField(c, k) for c, k in (("score", T.DoubleType()), ("label", T.IntegerType()), ("predicted", T.IntegerType()), ("weights", T.BinaryType())))])
    size = draws.size

    def met(hits: pa.Table, lists: pa.Table) -> pa.Table:
        parts = []
        if hits.num_rows and lists.num_rows:
            weights = _counted(hits.column("packed"), size)
            for batch in lists.to_batches():
                for k in range(batch.num_rows):
                    rows = batch.column("rows")[k].values
                    slot, score = (rows.field(c).to_numpy(zero_copy_only=False) for c in ("slot", "score"))
                    label, predicted = (pc.fill_null(rows.field(c), -1).to_numpy(zero_copy_only=False) for c in ("label", "predicted"))
                    order = np.lexsort((predicted, label, -score))
                    score, label, predicted = score[order], label[order], predicted[order]
                    starts = np.flatnonzero(np.r_[True, (score[1:] != score[:-1]) | (label[1:] != label[:-1]) | (predicted[1:] != predicted[:-1])])
                    packed = _packed_weights(np.add.reduceat(weights[slot[order]], starts, axis=0))
                    own = [pa.repeat(batch.column(c)[k], len(starts)) for c in ("block", *keys)]
                    made = [pa.array(score[starts]), pa.array(label[starts], pa.int32()), pa.array(predicted[starts], pa.int32()), pa.array(packed, pa.binary())]
                    parts.append(pa.table([*own, *made], names=schema.names).filter(pc.is_valid(pa.array(packed, pa.binary()))))
        return pa.concat_tables(parts) if parts else pa.table([pa.nulls(0)] * len(schema), names=schema.names)

    return _beside(draws, lists).applyInArrow(met, schema)


def replicate_metrics(
    preds: DataFrame, draws: Draws, keys: list[str], threshold: float | str = 0.5, subject: str = "patient_id", size: int = BLOCK, range_rows: int = RANGE_ROWS
) -> DataFrame:
    """Ranking metrics and balanced accuracy of each key and replicate; ``draws`` as ``draw_blocks`` makes them with ``size``.

    A subject has one row in ``preds`` for each run and key. Weights of predictions are dealt by block of replicates, key and range of scores, so the
    number of tasks grows with the rows: a range has some ``range_rows`` predictions. What lies above a range (drawn positives and negatives of
    each run and replicate) is added up first, without moving weights, and summed over the ranges; from there each range is swept
    by itself, and the ranges' sums are added. A score that fills a range by itself is not gathered at all: those sums are all it takes.
    Few predictions are one range, which starts from nothing.

    Ranking metrics are null where a class was not drawn; replicates that drew no row of a key are left out. Null and NaN scores are the lowest.
    """
    cut = F.col(threshold) if isinstance(threshold, str) else F.lit(threshold)
    names = [f"k{n}" for n in range(len(keys))]
    prob = F.col("prob").cast("double")
    score = F.when(F.isnan(prob) | prob.isNull(), F.lit(float("-inf"))).otherwise(prob)
    known = preds.select(subject, *[F.col(k).alias(n) for n, k in zip(names, keys, strict=True)], score.alias("score"), F.col("label").cast("int").alias("label"), metrics.predicted_label(F.col("prob"), cut).alias("predicted"))
    cuts = score_cuts(known.select("score"), range_rows)
    none = F.lit(None).cast("array<struct<hit:int,pos:double,neg:double>>")
    order = ["block", "range", *names, "kind"]
    met = _weighted_scores(known, draws, names, subject).withColumns({"range": _range_of(F.col("score"), cuts).cast("int"), "kind": F.lit(1), "before": none})
    if not cuts:
        swept = _swept(met.repartition("block", *names).sortWithinPartitions(*order, F.desc("score")), names, size, True)
        return _metrics_of(swept, names).toDF(*keys, "replicate", *VALUES)
    met = spread.saved(met)
    # partial sums of a partition are one row for each range, run and replicate, however many predictions there are
    totals = _swept(met.sortWithinPartitions(*order), names, size, False).groupBy(*names, "range", "replicate").agg(*[F.sum(c).alias(c) for c in SUMS[:4]])
    above = Window.partitionBy(*names, "replicate").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumns({f"{c}_before": F.coalesce(F.sum(c).over(above), F.lit(0.0)) for c in ("pos", "neg")})
    high, low = F.col("pos") + F.col("pos_before"), F.col("neg") + F.col("neg_before")
    alone = totals.where("range % 2 = 1 and pos + neg > 0").withColumns({"area": F.col("neg") * (high - F.col("pos") / 2), "steps": F.col("pos") * high / (high + low)})
    block = F.floor(F.col("replicate") / size).cast("int")
    hit = F.struct((F.col("replicate") % size).alias("hit"), F.col("pos_before").alias("pos"), F.col("neg_before").alias("neg"))
    before = totals.where("range % 2 = 0").groupBy(block.alias("block"), "range", *names).agg(F.collect_list(hit).alias("before")).withColumn("kind", F.lit(0))
    dealt = met.where("range % 2 = 0").unionByName(before, allowMissingColumns=True).repartition("block", "range", *names)
    swept = _swept(dealt.sortWithinPartitions(*order, F.desc("score")), names, size, True)
    return _metrics_of(swept.unionByName(alone.select(*swept.columns)).groupBy(*names, "replicate").agg(*[F.sum(c).alias(c) for c in SUMS]), names).toDF(*keys, "replicate", *VALUES)


def _metrics_of(sums: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of whole runs from their ``SUMS``."""
    pos, neg, tp, tn = (F.col(c) for c in SUMS[:4])
    recall, specificity = F.when(pos > 0, tp / pos), F.when(neg > 0, tn / neg)
    both = F.when(pos == 0, specificity).when(neg == 0, recall).otherwise((recall + specificity) / 2)
    found = (F.when((pos > 0) & (neg > 0), F.col("area") / (pos * neg)), F.when((pos > 0) & (neg > 0), F.col("steps") / pos), both)
    return sums.select(*keys, "replicate", *[c.alias(v) for c, v in zip(found, VALUES, strict=True)])


def long_metrics(wide: DataFrame, keys: list[str]) -> DataFrame:
    """One row a metric: ``metric``, ``value``."""
    return wide.unpivot(keys, VALUES, "metric", "value")


def intervals(replicates: DataFrame, points: DataFrame, keys: list[str], alpha: float = 0.05) -> DataFrame:
    """Point value and percentile interval of each key and metric."""
    spread = metrics.percentile_interval(long_metrics(replicates, [*keys, "replicate"]), [*keys, "metric"], "value", alpha)
    return long_metrics(points, keys).join(spread, [*keys, "metric"])


def paired_deltas(replicates: DataFrame, points: DataFrame, baseline: str, keys: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """Each run minus the baseline on the same replicate: point, interval, and the share of replicates above 0.

    ``keys`` name what a run is compared within, such as the cohort.
    """
    keys = keys or []
    draws = long_metrics(replicates, ["run_name", *keys, "replicate"])
    runs = Window.partitionBy(*keys, "replicate", "metric")
    is_base = F.col("run_name") == baseline
    deltas = draws.withColumn("base", F.max(F.when(is_base, F.col("value"))).over(runs)).where(~is_base)
    deltas = deltas.select("run_name", *keys, "metric", (F.col("value") - F.col("base")).alias("delta"))
    own = ["run_name", *keys, "metric"]
    ends = F.percentile("delta", F.array(F.lit(alpha / 2), F.lit(1 - alpha / 2)))
    spread = deltas.groupBy(*own).agg(ends.alias("ends"), F.avg((F.col("delta") > 0).cast("double")).alias("share_above"))
    now = long_metrics(points, ["run_name", *keys])
    now_base = now.where(F.col("run_name") == baseline).select(*keys, "metric", F.col("value").alias("base"))
    point = now.where(F.col("run_name") != baseline).join(now_base, [*keys, "metric"]).select(*own, (F.col("value") - F.col("base")).alias("delta"))
    return point.join(spread, own).select(*own, "delta", F.col("ends")[0].alias("low"), F.col("ends")[1].alias("high"), "share_above")


def consistency_gaps(points: DataFrame, board: DataFrame, tolerance: float = 1e-10) -> DataFrame:
    """Runs whose recomputed metrics differ from the leaderboard's, or that one side lacks."""
    ours, theirs = (long_metrics(t, ["run_name"]).withColumnRenamed("value", n) for t, n in ((points, "ours"), (board, "theirs")))
    both = ours.join(theirs, ["run_name", "metric"], "full")
    same = F.col("ours").eqNullSafe(F.col("theirs")) | (F.abs(F.col("ours") - F.col("theirs")) <= tolerance)
    return both.where(~F.coalesce(same, F.lit(False)))
