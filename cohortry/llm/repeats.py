"""Repeated passages across documents, by prefix-free parsing into content-defined phrases.

A rolling hash over the text sets triggers: the position with the least hash among the next ``reach`` ones. Each
``length``-byte string has exactly one trigger near its start, which depends on its own bytes alone, so equal
strings share it wherever they stand. The strings that share one trigger form a phrase: the bytes from the first
of them to the end of the last. Phrases are the dictionary, a document's sequence of them is its parse.

Two facts about phrases place all strings among their equals, as the order of the corpus would, without writing
down that order:

* A phrase that occurs twice repeats every string in it. Most repeated text is settled here, one row a phrase.
* Strings are equal only if the bytes after their trigger (the phrase's core, in all of its strings) are equal.
  Phrases whose core occurs once are unique, which settles most other text.

Only phrases at the edge of a repeated passage are left: a core seen before in a phrase that is not. There, one
phrase of each kind with that core is opened. The same two facts hold for cells of ``CELL`` strings at equal
distances from the trigger; only strings of the cells that remain are compared one by one, by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import discard, heavy_keys, saved, spread_join, text_of

#: Bytes under the rolling hash.
GRAM = 8
#: Positions parsed at once; bounds memory for very long texts. A cut only makes phrases shorter.
STEP = 1 << 19
#: Strings of an opened phrase that are compared together first.
CELL = 16


def _hashes(data: bytes) -> np.ndarray:
    """A hash of the ``GRAM`` bytes from each position."""
    n = len(data) - GRAM + 1
    grams = np.ndarray(shape=(n,), dtype="<u8", buffer=data, strides=(1,)).copy()
    grams ^= grams >> np.uint64(29)
    grams *= np.uint64(0x9E3779B97F4A7C15)
    grams ^= grams >> np.uint64(32)
    grams *= np.uint64(0xD6E8FEB86659FD93)
    return grams


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` neighbours, from running minima of blocks in both directions."""
    n = len(values)
    rows = -(-n // width)
    padded = np.full(rows * width, np.iinfo(np.uint64).max, dtype=np.uint64)
    padded[:n] = values
    blocks = padded.reshape(rows, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - width + 1], ahead[width - 1 : n])


def parse(data: bytes, length: int, reach: int) -> Iterator[tuple[int, int, int]]:
    """(trigger, first, last) of each phrase: starts of the ``length``-byte strings that share the trigger."""
    for at in range(0, len(data) - length + 1, STEP):
        part = data[at : at + STEP + length - 1]
        keys = _hashes(part[: len(part) - length + reach + GRAM - 1])
        place = np.arange(len(keys), dtype=np.uint64)
        triggers = _sliding_least((keys & ~np.uint64(0xFFFFF)) | place, reach) & np.uint64(0xFFFFF)
        cuts = np.flatnonzero(triggers[1:] != triggers[:-1]) + 1
        firsts = np.concatenate([[0], cuts])
        lasts = np.concatenate([cuts - 1, [len(triggers) - 1]])
        yield from zip((triggers[firsts].astype(np.int64) + at).tolist(), (firsts + at).tolist(), (lasts + at).tolist(), strict=True)


def phrases(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """``core``, ``whole`` (64-bit hashes), ``id``, ``text_key``, ``first``, ``last`` of every phrase of ``texts`` (id, text_key, text)."""
    schema = T.StructType([
        T.StructField("core", T.LongType()), T.StructField("whole", T.LongType()), texts.schema["id"], texts.schema["text_key"],
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()),
    ])
    core_bytes = length - reach

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                rows, core, whole, first, last = [], [], [], [], []
                for k, text in enumerate(part.column(2).to_pylist()):
                    data = text.encode()
                    if len(data) < length:
                        continue
                    for trigger, a, b in parse(data, length, reach):
                        rows.append(k)
                        core.append(digest(data[trigger : trigger + core_bytes]))
                        whole.append(digest(data[a : b + length]))
                        first.append(a)
                        last.append(b)
                hashes = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (core, whole)]
                at = pa.array(rows, pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [*hashes, part.column(0).take(at), part.column(1).take(at), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                    names=["core", "whole", "id", "text_key", "first", "last"],
                )

    return texts.mapInArrow(run, schema)


def _opened(marked: DataFrame, length: int) -> DataFrame:
    """``core``, ``many``, ``id``, ``text_key``, ``first``, ``last``, ``data``: the bytes of each phrase in ``open``."""
    schema = T.StructType([
        T.StructField("core", T.LongType()), T.StructField("many", T.BooleanType()), marked.schema["id"], marked.schema["text_key"],
        T.StructField("first", T.LongType()), T.StructField("last", T.LongType()), T.StructField("data", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in range(0, batch.num_rows, 200):
                part = batch.slice(start, 200)
                rows, found, cut = [], [], []
                for k, (text, opened) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)):
                    data = text.encode()
                    for phrase in opened:
                        rows.append(k)
                        found.append(phrase)
                        cut.append(data[phrase["first"] : phrase["last"] + length])
                take = pa.array(rows, pa.int64())
                of = lambda name, kind: pa.array([x[name] for x in found], kind)  # noqa: B023, E731
                yield pa.RecordBatch.from_arrays(
                    [of("core", pa.int64()), of("many", pa.bool_()), part.column(0).take(take), part.column(1).take(take), of("first", pa.int64()), of("last", pa.int64()), pa.array(cut, pa.binary())],
                    names=schema.names,
                )

    return marked.mapInArrow(run, schema)


def _cells(opened: DataFrame, length: int, reach: int) -> DataFrame:
    """``kind``, ``core``, ``many``, ``cell``, ``inner``, ``outer``, ``low``, ``high`` of the cells of opened phrases.

    ``low`` and ``high`` are starts within the phrase's bytes; ``inner`` hashes what all strings of the cell have in
    common, ``outer`` all that they cover.
    """
    schema = "kind long, core long, many boolean, cell int, inner long, outer long, low long, high long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_64_intdigest as digest

        for batch in batches:
            out: list[tuple] = []
            for kind, core, many, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                last = len(data) - length
                trigger = last + int(np.argmin(_hashes(data[last : last + reach + GRAM - 1]) & ~np.uint64(0xFFFFF)))
                at = 0
                while at <= last:
                    cell = (trigger - at) // CELL
                    # strings of one cell lie at distances cell * CELL to cell * CELL + CELL - 1 before the trigger
                    near, far = trigger - cell * CELL, trigger - cell * CELL - CELL + 1
                    to = min(last, near)
                    out.append((kind, core, many, cell, digest(data[near : far + length]), digest(data[at : to + length]), at, to))
                    at = to + 1
            kinds = [pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.uint64(), pa.uint64(), pa.int64(), pa.int64()]
            columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 8, kinds, strict=True)]
            columns[4:6] = [pa.array(c.to_numpy().view(np.int64)) for c in columns[4:6]]
            yield pa.RecordBatch.from_arrays(columns, names=["kind", "core", "many", "cell", "inner", "outer", "low", "high"])

    return opened.select("kind", "core", "many", "data").mapInArrow(run, schema)


def _strings(marked: DataFrame, length: int) -> DataFrame:
    """``left``, ``right`` (128-bit digest), ``many``, ``kind``, ``at`` of each string in ``open`` of (kind, data, open)."""
    schema = "left long, right long, many boolean, kind long, at long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from xxhash import xxh3_128_digest as digest

        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                found, rows = [], []
                for kind, data, opened in zip(*(c.to_pylist() for c in part.columns), strict=True):
                    for cell in opened:
                        for i in range(cell["low"], cell["high"] + 1):
                            found.append(digest(data[i : i + length]))
                            rows.append((cell["many"], kind, i))
                both = np.frombuffer(b"".join(found), dtype="<i8").reshape(-1, 2)
                many, kinds, at = zip(*rows, strict=True) if rows else ((), (), ())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), pa.array(many, pa.bool_()), pa.array(kinds, pa.int64()), pa.array(at, pa.int64())],
                    names=["left", "right", "many", "kind", "at"],
                )

    return marked.mapInArrow(run, schema)


def repeated_ranges(texts: DataFrame, length: int, reach: int) -> DataFrame:
    """``id``, ``text_key``, ``ranges``: array of struct(first, last), starts of strings that also start elsewhere."""
    parsed = saved(phrases(texts, length, reach))
    cores = saved(parsed.groupBy("core").agg(F.count(F.lit(1)).alias("seen")).where("seen > 1"))
    met = saved(spread_join(parsed, cores.select("core"), ["core"], heavy_keys(cores, ["core"], "seen"), ["whole", "first", "id"]))
    discard(parsed, cores)
    kinds = met.groupBy("core", "whole").agg(
        F.count(F.lit(1)).alias("seen"), F.min(F.struct("id", "text_key", "first", "last")).alias("one")
    )
    kinds = saved(kinds)
    again = kinds.where("seen > 1").select("core", "whole", "seen")
    settled = spread_join(met, again.drop("seen"), ["core", "whole"], heavy_keys(again, ["core", "whole"], "seen"), ["first", "id"]).select("id", "text_key", "first", "last")

    edges = saved(kinds.groupBy("core").agg(F.min("seen").alias("least"), F.count(F.lit(1)).alias("kinds")).where("least = 1 and kinds > 1"))
    chosen = spread_join(kinds, edges.select("core"), ["core"], heavy_keys(edges, ["core"], "kinds"), ["whole"]).groupBy(F.col("one.id").alias("id"), F.col("one.text_key").alias("text_key"))
    chosen = chosen.agg(F.collect_list(F.struct("core", "one.first", "one.last", (F.col("seen") > 1).alias("many"))).alias("open"))
    marked = texts.join(chosen, texts["id"].eqNullSafe(chosen["id"]) & (texts["text_key"] == chosen["text_key"]))
    # rows that repeat another one have no phrase of their own that is alone, so they may be opened twice
    marked = marked.select(texts["id"], texts["text_key"], "text", "open")
    opened = saved(_opened(marked, length).withColumn("kind", F.monotonically_increasing_id()))

    cells = saved(_cells(opened, length, reach))
    alike = cells.groupBy("core", "cell", "inner", "outer").agg(
        F.count(F.lit(1)).alias("seen"), F.max("many").alias("many"), F.min(F.struct("kind", "low", "high")).alias("one")
    )
    alike = saved(alike.withColumn("known", F.col("many") | (F.col("seen") > 1)))
    mixed = alike.groupBy("core", "cell", "inner").agg(F.bool_and("known").alias("all_known"), F.count(F.lit(1)).alias("kinds")).where("kinds > 1 and not all_known")
    mixed = saved(mixed.select("core", "cell", "inner", "kinds"))
    cell, whole_cell = ["core", "cell", "inner"], ["core", "cell", "inner", "outer"]
    known = alike.where("known").select(*whole_cell, "seen")
    settled_cells = spread_join(cells.where("not many"), known.drop("seen"), whole_cell, heavy_keys(known, whole_cell, "seen"), ["kind"])
    open_cells = spread_join(alike, mixed.select(*cell), cell, heavy_keys(mixed, cell, "kinds"), ["outer"])
    open_cells = open_cells.groupBy("one.kind").agg(F.collect_list(F.struct("one.low", "one.high", F.col("known").alias("many"))).alias("open"))
    strings = saved(_strings(opened.select("kind", "data").join(open_cells, "kind").select("kind", "data", "open"), length))
    repeated = saved(strings.groupBy("left", "right").agg(F.count(F.lit(1)).alias("seen"), F.max("many").alias("many")).where("seen > 1 or many"))
    single = spread_join(strings.where("not many"), repeated.select("left", "right"), ["left", "right"], heavy_keys(repeated, ["left", "right"], "seen"), ["kind", "at"])
    single = single.select("kind", F.col("at").alias("low"), F.col("at").alias("high"))

    late = settled_cells.select("kind", "low", "high").unionByName(single).join(opened.select("kind", "id", "text_key", F.col("first").alias("base")), "kind")
    late = late.select("id", "text_key", (F.col("base") + F.col("low")).alias("first"), (F.col("base") + F.col("high")).alias("last"))
    ranges = saved(settled.unionByName(late).groupBy("id", "text_key").agg(F.collect_list(F.struct("first", "last")).alias("ranges")))
    discard(met, kinds, edges, opened, cells, alike, mixed, strings, repeated)
    return ranges


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, reach: int = 300) -> DataFrame:
    """``id_col``, ``n_bytes``, ``spans`` (array of struct(start, end), maximal removed runs) and ``kept`` (binary).

    Texts are UTF-8 bytes. A byte is removed if some ``length``-byte string that covers it also starts anywhere
    else in the table, in the same text too. Strings never cross texts and are judged on the input.

    * Null text is empty. Texts shorter than ``length`` keep everything. An empty table gives no rows.
    * Each row is a document: a row that repeats another one, its id too, repeats its text.
    * ``kept`` joins the remaining bytes; a cut can fall inside a character, so it need not be valid UTF-8.
    * Other columns of ``docs`` are not read, whatever their names.

    Equality of phrases and of cells is that of two 64-bit hashes each (core and whole, inner and outer), of single strings
    that of one of 128 bits; bytes are not looked at again. Of n phrases and cells, two that differ have the same pair
    of hashes with a chance of about n**2 / 2**129: below 1e-12 for 1e13 of them.
    """
    if not GRAM <= length - reach or reach < 1:
        raise ValueError(f"reach must be from 1 to length - {GRAM}")
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select("id", F.xxhash64("text").alias("text_key"), "text")
    ranges = repeated_ranges(texts, length, reach)
    joined = texts.join(ranges, texts["id"].eqNullSafe(ranges["id"]) & (texts["text_key"] == ranges["text_key"]), "left").select(texts["id"], "text", "ranges")
    span = T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    schema = T.StructType([
        T.StructField(id_col, texts.schema["id"].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("spans", T.ArrayType(span)), T.StructField("kept", T.BinaryType()),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sizes, spans, kept = [], [], []
                for text, found in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    data, runs, left, at = text.encode(), [], [], 0
                    for a, b in sorted((r["first"], r["last"] + length) for r in found or ()):
                        if runs and a <= runs[-1]["end"]:
                            runs[-1]["end"] = max(b, runs[-1]["end"])
                        else:
                            runs.append({"start": a, "end": b})
                    for r in runs:
                        left.append(data[at : r["start"]])
                        at = r["end"]
                    left.append(data[at:])
                    sizes.append(len(data))
                    spans.append(runs)
                    kept.append(b"".join(left))
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=[id_col, "n_bytes", "spans", "kept"])

    return joined.mapInArrow(run, schema)
