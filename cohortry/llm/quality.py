"""Quality classifier by co-training of two views: a document's text, and the metadata of its page.

Each view has a logistic model. In every round each model labels the unlabelled rows it is most sure of, and
those pseudo-labels go to the other model. Held-out labelled rows calibrate both and weigh them against each
other. Labelled rows are a bounded sample (``Bounds``) on the driver. All unlabelled rows take part in the exchange:
their features are written once, and every round scores them, chooses and fits on Spark. Only histograms of scores and
sums of gradients and Hessians reach the driver. Scoring reads every whole text.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, remembered, saved

#: Buckets of hashed words in the text view; of hashed values in the metadata view.
WORD_BUCKETS, VALUE_BUCKETS = 256, 64
MEMORY = 250_000


@dataclass(frozen=True)
class Bounds:
    """Most labelled rows that reach the driver for fitting, and the terms of the exchange.

    ``unlabelled`` bounds the rows of the exchange; None means all. A view gives away the ``part`` of them that it is
    most sure of in each round, split between the classes as the labels are. Together they weigh as much as
    ``per_round`` labelled rows at most, so that labels and pseudo-labels keep their balance at every size.
    """

    labelled: int = 8000
    unlabelled: int | None = None
    held_out: float = 0.3
    rounds: int = 3
    per_round: int = 400
    part: float = 0.1
    sure: float = 0.95


class _WordBuckets(dict):
    def __missing__(self, word: str) -> int:
        import xxhash

        if len(self) >= MEMORY:
            self.clear()
        found = self[word] = xxhash.xxh3_64_intdigest(word.lower()) % WORD_BUCKETS
        return found


_LOWER, _UPPER, _DIGIT, _SPACE, _MARK, _SENTENCE, _OTHER = range(7)


def _byte_classes() -> np.ndarray:
    table = np.full(256, _OTHER, dtype=np.uint8)
    for kind, members in ((_MARK, bytes(range(33, 127))), (_LOWER, bytes(range(97, 123))), (_UPPER, bytes(range(65, 91))), (_DIGIT, b"0123456789"), (_SPACE, b" \t\n\r\v\f"), (_SENTENCE, b".,;:'\"-")):
        table[list(members)] = kind
    return table


_CLASSES = _byte_classes()
TEXT_WIDTH = WORD_BUCKETS + 16


def text_features(text: str | None) -> np.ndarray:
    """Hashed word frequencies, character classes, repetition and shape of a whole text; null counts as empty."""
    out = np.zeros(TEXT_WIDTH)
    text = text or ""
    words = text.split()
    data = np.frombuffer(text.encode(), dtype=np.uint8)
    if not words:
        out[-1] = 1
        return out
    counts = np.bincount(np.fromiter(map(remembered("word buckets", _WordBuckets).__getitem__, words), dtype=np.int64, count=len(words)), minlength=WORD_BUCKETS)
    out[:WORD_BUCKETS] = np.sqrt(counts / len(words))
    classes = np.bincount(_CLASSES[data], minlength=7) / len(data)
    n = len(words)
    out[WORD_BUCKETS : WORD_BUCKETS + 7] = 4 * np.sqrt(classes)
    out[WORD_BUCKETS + 7 : -1] = (
        len(set(words)) / n,
        sum(map(eq, words, words[1:])) / n,
        np.log1p(n) / 5,
        len(data) / n / 10,
        sum(map(str.isupper, words)) / n,
        (text.count(". ") + text.count(".\n") + 1) / n,
        text.count("|") / n,
        (text.count("!!") + text.count("??")) / n,
    )
    return out


def meta_features(values: list, length: int | None) -> np.ndarray:
    """Hashed metadata values (null is a value of its own) and the size the page reports."""
    import xxhash

    out = np.zeros(VALUE_BUCKETS * len(values) + 2)
    for k, value in enumerate(values):
        out[k * VALUE_BUCKETS + xxhash.xxh3_64_intdigest(f"{k}={value!r}") % VALUE_BUCKETS] = 1
    out[-2:] = (0, 1) if length is None else (np.log1p(max(0, length)) / 5, 0)
    return out


def _slopes(w: np.ndarray, x: np.ndarray, y: np.ndarray, weight: np.ndarray | float = 1.0) -> tuple[np.ndarray, np.ndarray]:
    """Gradient and Hessian of the logistic loss, the intercept last."""
    x = np.hstack([x, np.ones((len(x), 1))])
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return x.T @ (weight * (p - y)), (x * (weight * (p * (1 - p) + 1e-6))[:, None]).T @ x


def _newton(w: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, penalty: float) -> np.ndarray:
    ridge = np.full(len(w), penalty)
    ridge[-1] = 1e-3
    return np.linalg.solve(hessian + np.diag(ridge), gradient + ridge * w)


def _fit(x: np.ndarray, y: np.ndarray, penalty: float = 2.0, steps: int = 25) -> np.ndarray:
    """Weights (the last is the intercept) of a ridge logistic regression, by Newton's method."""
    w = np.zeros(x.shape[1] + 1)
    for _ in range(steps):
        step = _newton(w, *_slopes(w, x, y), penalty)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _logit(w: np.ndarray, x: np.ndarray) -> np.ndarray:
    return np.clip(x @ w[:-1] + w[-1], -30, 30)


@dataclass(frozen=True)
class CoTrained:
    """Weights of both views, and of their calibrated logits (text, metadata, intercept)."""

    text: np.ndarray
    meta: np.ndarray
    text_scale: np.ndarray
    meta_scale: np.ndarray
    mix: np.ndarray

    def scores(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Calibrated probabilities of quality: by text, by metadata, combined."""
        own = (_logit(self.text, text), _logit(self.meta, meta))
        views = [np.clip(s[0] * v + s[1], -30, 30) for s, v in zip((self.text_scale, self.meta_scale), own, strict=True)]
        both = np.clip(np.stack(views, axis=1) @ self.mix[:2] + self.mix[2], -30, 30)
        return tuple(1 / (1 + np.exp(-z)) for z in (*views, both))


_MEASURED = T.StructType([T.StructField("id", T.LongType()), T.StructField("text_view", T.BinaryType()), T.StructField("meta_view", T.BinaryType())])


def _measured(rows: DataFrame) -> DataFrame:
    """Both feature vectors of ``rows`` (id, text, length, metadata...), as bytes of 32-bit floats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                ids, texts, *columns = (c.to_pylist() for c in batch.slice(start, 1000).columns)
                text = [text_features(t).astype("<f4").tobytes() for t in texts]
                meta = [meta_features(list(v), n).astype("<f4").tobytes() for n, *v in zip(*columns, strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(text, pa.binary()), pa.array(meta, pa.binary())], names=["id", "text_view", "meta_view"])

    return rows.mapInArrow(run, _MEASURED)


def _matrix(values: list[bytes]) -> np.ndarray:
    return np.frombuffer(b"".join(values), dtype="<f4").reshape(len(values), -1).astype(float)


@dataclass(frozen=True)
class Round:
    """Both views' weights, and for each its bounds: logits from ``high`` up are given as 1, from ``low`` down as 0."""

    weights: tuple[np.ndarray, np.ndarray]
    high: tuple[float, float]
    low: tuple[float, float]


#: Bins of logits between -30 and 30.
BINS = 6000


def _bins(logits: np.ndarray) -> np.ndarray:
    return np.clip(((logits + 30) * (BINS / 60)).astype(int), 0, BINS - 1)


def _given(views: tuple[np.ndarray, np.ndarray], rounds: list[Round]) -> np.ndarray:
    """For each receiving view and row, 2 * round + label of the round that gave it; -1 for rows not given yet."""
    out = np.full((2, len(views[0])), -1)
    for k, r in enumerate(rounds):
        for view in (0, 1):
            bins, to = _bins(_logit(r.weights[view], views[view])), out[1 - view]
            to[(bins >= r.high[view]) & (to < 0)] = 2 * k + 1
            to[(bins <= r.low[view]) & (to < 0)] = 2 * k
    return out


_SUMS = T.StructType([T.StructField("sums", T.BinaryType())])


def _summed(pool: DataFrame, measure: Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray], parts: int = 8) -> np.ndarray:
    """Sum of ``measure`` (a vector of fixed length) over batches of all rows; ``parts`` vectors reach the driver."""

    def total(vectors: Iterator[np.ndarray], sent: str) -> Iterator[pa.RecordBatch]:
        out = None
        for v in vectors:
            out = v.astype(float) if out is None else out + v
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.astype(sent).tobytes()], pa.binary())], names=["sums"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = (b.slice(k, 2000) for b in batches for k in range(0, b.num_rows, 2000))
        return total((measure(tuple(_matrix(c.to_pylist()) for c in step.columns)) for step in steps), "<f4")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return total((np.frombuffer(x, dtype="<f4") for b in batches for x in b.column(0).to_pylist()), "<f8")

    found = pool.select("text_view", "meta_view").mapInArrow(each, _SUMS).repartition(parts).mapInArrow(again, _SUMS).collect()
    return sum((np.frombuffer(r["sums"]) for r in found), np.zeros(1))


def _histograms(rounds: list[Round], weights: list[np.ndarray]) -> Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Counts of each view's logits over the rows that it has not given yet; then the number of all rows."""

    def measure(views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        given = _given(views, rounds)
        counts = [np.bincount(_bins(_logit(w, v))[given[1 - k] < 0], minlength=BINS) for k, (w, v) in enumerate(zip(weights, views, strict=True))]
        return np.concatenate([*counts, [len(views[0])]]).astype(float)

    return measure


def _pool_slopes(rounds: list[Round], scale: np.ndarray, weights: list[np.ndarray]) -> Callable[[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Gradients and Hessians (upper halves) of both views over the rows given to them; ``scale``: weight of a row by view and round."""

    def measure(views: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        out = []
        for k, (w, v, given) in enumerate(zip(weights, views, _given(views, rounds), strict=True)):
            has = given >= 0
            gradient, hessian = _slopes(w, v[has], given[has] % 2, scale[k][given[has] // 2])
            out += [gradient, hessian[np.triu_indices(len(w))]]
        return np.concatenate(out)

    return measure


def _chosen(counts: np.ndarray, total: float, share: float, bounds: Bounds) -> tuple[float, float, float]:
    """Bins from which and to which a view gives labels, and how many rows that are. Rows of one bin go together."""
    edge = np.log(bounds.sure / (1 - bounds.sure))
    most = [int(bounds.part * total * s) + 1 for s in (share, 1 - share)]
    down, up = np.cumsum(counts[::-1])[::-1], np.cumsum(counts)
    high = max(np.ceil((edge + 30) * (BINS / 60)), np.searchsorted(-down, -most[0], side="right") - 1)
    low = min(np.floor((30 - edge) * (BINS / 60)) - 1, np.searchsorted(up, most[1]))
    return float(high), float(low), float(down[int(high)] + up[int(low)])


def _held_out(y: np.ndarray, bounds: Bounds) -> int:
    return max(1, int(len(y) * bounds.held_out))


def _has_both(y: np.ndarray, bounds: Bounds) -> bool:
    """Whether both classes are there, for fitting and for calibration."""
    cut = _held_out(y, bounds)
    return len(np.unique(y[cut:])) == 2 and len(np.unique(y[:cut])) == 2


def co_train(text: np.ndarray, meta: np.ndarray, y: np.ndarray, pool: DataFrame, bounds: Bounds, steps: int = 12) -> CoTrained:
    """Labelled rows in a random order that is fixed; the first ``held_out`` share calibrates. ``pool``: measured rows."""
    cut = _held_out(y, bounds)
    views, labels = (text, meta), y.astype(float)
    if not _has_both(y, bounds):
        raise ValueError("both classes are needed, for fitting and for calibration")
    weights = [_fit(v[cut:], labels[cut:]) for v in views]
    share, rounds, scale = labels[cut:].mean(), [], np.zeros((2, bounds.rounds))
    for k in range(bounds.rounds):
        counts = _summed(pool, _histograms(rounds, weights))
        if counts[-1] == 0:
            break
        picks = [_chosen(c, counts[-1], share, bounds) for c in counts[:-1].reshape(2, BINS)]
        rounds.append(Round(tuple(w.copy() for w in weights), tuple(p[0] for p in picks), tuple(p[1] for p in picks)))
        for view in (0, 1):
            scale[1 - view, k] = min(1.0, bounds.per_round / max(1.0, picks[view][2]))
        for _ in range(steps):
            sums, at, moved = _summed(pool, _pool_slopes(rounds, scale, weights)), 0, 0.0
            for view, w in enumerate(weights):
                gradient, hessian = _slopes(w, views[view][cut:], labels[cut:])
                n, half = len(w), len(w) * (len(w) + 1) // 2
                upper = np.zeros((n, n))
                upper[np.triu_indices(n)] = sums[at + n : at + n + half]
                hessian += upper + np.triu(upper, 1).T
                step = _newton(w, gradient + sums[at : at + n], hessian, 2.0)
                at += n + half
                weights[view] = w - step
                moved = max(moved, np.abs(step).max())
            if moved < 1e-3:
                break
    held = labels[:cut]
    scales = [_fit(_logit(w, v[:cut])[:, None], held, penalty=1e-2) for w, v in zip(weights, views, strict=True)]
    calibrated = np.stack([np.clip(s[0] * _logit(w, v[:cut]) + s[1], -30, 30) for s, w, v in zip(scales, weights, views, strict=True)], axis=1)
    return CoTrained(weights[0], weights[1], scales[0], scales[1], _fit(calibrated, held, penalty=1e-2))


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("source", "lang"),
    length_col: str = "n_chars",
    label_col: str = "quality",
    bounds: Bounds | None = None,
) -> CoTrained | None:
    """The co-trained model; None if the sample lacks a class (no labels, one class, too few rows).

    Null labels or ids are ignored; of several labels of one id the lowest counts.
    """
    bounds = bounds or Bounds()
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id"))
    known = known.agg((F.min(label_col) > 0).cast("int").alias("y")).join(docs.select(F.col(id_col).cast("long").alias("id")).distinct(), "id", "left_semi")
    chosen = {r["id"]: r["y"] for r in known.orderBy(F.xxhash64("id"), "id").limit(bounds.labelled).collect()}
    if not chosen:
        return _no_model("no labelled rows")
    sample = docs.sparkSession.createDataFrame([(i,) for i in chosen], "id long")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), text_col, F.col(length_col).cast("long"), *meta_cols)
    found: dict = {}
    for r in _measured(rows.join(F.broadcast(sample), "id", "left_semi").dropDuplicates(["id"])).toLocalIterator():
        found[r["id"]] = (r["text_view"], r["meta_view"])
    ids = sorted(found, key=lambda i: hash((i * 2654435761) & 0xFFFFFFFF))
    y = np.array([chosen[i] for i in ids])
    if not _has_both(y, bounds):
        return _no_model("labelled rows of one class only")
    if bounds.unlabelled is not None:
        others = rows.select("id").where("id is not null").join(known.select("id"), "id", "left_anti").distinct()
        rows = rows.join(others.orderBy(F.xxhash64("id"), "id").limit(bounds.unlabelled), "id", "left_semi")
    # vectors, not texts, meet the labels
    pool = saved(_measured(rows).join(known.select("id"), "id", "left_anti").select("text_view", "meta_view"))
    try:
        return co_train(*(_matrix([found[i][v] for i in ids]) for v in (0, 1)), y, pool, bounds)
    finally:
        discard(pool)


def _no_model(why: str) -> None:
    warnings.warn(f"no quality model, every row counts as good: {why}", stacklevel=3)


def quality_scores(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    meta_cols: tuple[str, ...] = ("source", "lang"),
    length_col: str = "n_chars",
    label_col: str = "quality",
    threshold: float = 0.5,
    bounds: Bounds | None = None,
) -> DataFrame:
    """``docs`` with ``text_score``, ``meta_score``, ``score`` (probabilities of quality) and ``good`` (score >= ``threshold``).

    * Null and empty texts are scored as empty; null metadata is a value of its own. Repeated rows score alike.
    * Without a model (see ``fit_quality``) scores are null and every row is ``good``.
    * All rows and columns stay; columns named like the four new ones are replaced. An empty table gives no rows.
    """
    model = fit_quality(docs, labels, id_col, text_col, meta_cols, length_col, label_col, bounds)
    new = ["text_score", "meta_score", "score"]
    own = docs.drop(*new, "good")
    if model is None:
        return own.select("*", *[F.lit(None).cast("double").alias(c) for c in new], F.lit(True).alias("good"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    names = [*own.columns, *new]
    places = [names.index(c) for c in (text_col, length_col, *meta_cols)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                texts, lengths, *values = (part.column(p).to_pylist() for p in places)
                text = np.stack([text_features(t) for t in texts])
                meta = np.stack([meta_features(list(v), n if n is None else int(n)) for n, *v in zip(lengths, *values, strict=True)])
                scores = [pa.array(s, pa.float64()) for s in sent.value.scores(text, meta)]
                yield pa.RecordBatch.from_arrays([*part.columns, *scores], names=names)

    schema = T.StructType([*own.schema.fields, *(T.StructField(c, T.DoubleType()) for c in new)])
    return own.mapInArrow(run, schema).withColumn("good", F.col("score") >= threshold)
