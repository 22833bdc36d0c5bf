"""Fill-in-middle transformation: unit-chunk pieces, a secondary sort, and digests that see one piece at a time.

A text is a run of units (lines with their line break). Two unit borders cut it into prefix, middle and suffix, which
are put out in another order behind markers. No task holds a text that it puts together: a text leaves the first step as
pieces of whole units of some 64 KB, keyed by document and place in the output. The pieces are dealt by document and
sorted by place within the partition (one shuffle), and stream into an incremental digest, or into a text where texts are
asked for. For restoration the output's pieces are read behind the markers that they follow, sorted again by their place
in the original (within the partition, no second shuffle), and stream into a second digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Markers in the order of the original text: prefix, middle, suffix.
MARKS = (b"<P>", b"<M>", b"<S>")
#: The markers' order in the output of each form.
FORMS = {"psm": (0, 2, 1), "spm": (2, 0, 1)}
#: Bytes of a piece, unless one unit is longer: then it is cut.
CHUNK = 1 << 16
#: Bytes of the bodies in an Arrow batch.
BATCH = 1 << 22
#: Sorts behind every piece of its document.
LAST = 1 << 62
#: Of pieces: the document's own columns, the piece's place in the output, and its bytes.
OWN = ["n", "form", "prefix_chars", "middle_chars"]


def cut_text(data: bytes, own_id: Any, seed: int, fim_percent: int, spm_percent: int) -> tuple[int, str, int, int]:
    """(units, form, end of the prefix, end of the middle) of a text in UTF-8; ends are byte offsets."""
    ends = np.flatnonzero(np.frombuffer(data, dtype=np.uint8) == 10) + 1
    if data and (not len(ends) or ends[-1] != len(data)):
        ends = np.append(ends, len(data))
    digest = hashlib.sha256(f"{seed}:{'' if own_id is None else own_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in range(0, 32, 8))
    n = len(ends)
    if not data or h3 % 100 >= fim_percent or any(m in data for m in MARKS):
        return n, "plain", 0, 0
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    return n, "spm" if h4 % 100 < spm_percent else "psm", int(ends[a - 1]) if a else 0, int(ends[b - 1]) if b else 0


def _chunks(data: bytes, start: int, end: int, chunk: int) -> Iterator[bytes]:
    """Runs of whole units of at most ``chunk`` bytes; a longer unit is cut."""
    while start < end:
        stop = min(end, start + chunk)
        if stop < end:
            stop = data.rfind(b"\n", start, stop) + 1 or stop
        yield data[start:stop]
        start = stop


def output_pieces(data: bytes, form: str, first: int, second: int, chunk: int = CHUNK) -> Iterator[bytes]:
    """The output's bytes in order; a marker is a piece of its own."""
    if form == "plain":
        yield from _chunks(data, 0, len(data), chunk)
        return
    parts = ((0, first), (first, second), (second, len(data)))
    for k in FORMS[form]:
        yield MARKS[k]
        yield from _chunks(data, *parts[k], chunk)


def _batches(rows: Iterator[tuple], names: list[str], types: list[pa.DataType], weight: int) -> Iterator[pa.RecordBatch]:
    """Rows as batches of some ``BATCH`` bytes in column ``weight``, or of 10,000 rows."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += len(row[weight] or b"")
        if size >= BATCH or len(held) >= 10_000:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=names)


def fim_pieces(
    docs: DataFrame, seed: int = 7, fim_percent: int = 100, spm_percent: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK
) -> DataFrame:
    """The outputs in pieces: ``key``, ``id_col``, ``copies``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``place``, ``body``.

    The bodies of a ``key`` in the order of ``place`` (from 0) are the output. ``key`` stands for one id and text; rows that
    repeat both are one in each batch of a task, with their number as ``copies``, and may come in several rows a place:
    ``assembled`` adds them up. So a row that is repeated without end is few pieces.

    * ``form`` is ``plain`` (the text as it is), ``psm`` or ``spm``; the cuts are drawn from a hash of ``seed`` and the id.
      Texts with a marker in them are plain, as they could not be restored.
    * Null text is the empty text: plain, ``n`` 0, one empty piece. A null id is hashed as the empty string.
    * ``prefix_chars``, ``middle_chars``: code points; null if plain. A text without line breaks is one unit.
    * Other columns are not read, whatever their names. An empty table gives no rows.
    """
    own = docs.select(F.col(id_col), F.col(text_col).cast("binary"))
    kind = pa.schema([pa.field("x", _arrow(own.schema[0].dataType))]).field(0).type
    names = ["key", id_col, "copies", *OWN, "place", "body"]
    types = [pa.binary(), kind, pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.binary()]

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in batches:
            ids, texts, found = batch.column(0).to_pylist(), batch.column(1), {}
            for k, own_id in enumerate(ids):
                data = texts[k].as_py() or b""
                key = hashlib.blake2b(f"{own_id!r}\0".encode() + data, digest_size=16).digest()
                found.setdefault(key, [k, 0])[1] += 1
            for key, (k, copies) in found.items():
                data = texts[k].as_py() or b""
                n, form, first, second = cut_text(data, ids[k], seed, fim_percent, spm_percent)
                chars = (None, None) if form == "plain" else (len(data[:first].decode()), len(data[first:second].decode()))
                place = -1
                for place, body in enumerate(output_pieces(data, form, first, second, chunk)):
                    yield key, ids[k], copies, n, form, *chars, place, body
                if place < 0:
                    yield key, ids[k], copies, n, form, *chars, 0, b""

    schema = T.StructType([
        T.StructField("key", T.BinaryType()), own.schema[0], T.StructField("copies", T.LongType()), T.StructField("n", T.LongType()), T.StructField("form", T.StringType()),
        T.StructField("prefix_chars", T.LongType()), T.StructField("middle_chars", T.LongType()), T.StructField("place", T.LongType()), T.StructField("body", T.BinaryType()),
    ])
    return own.mapInArrow(lambda batches: _batches(pieces(batches), names, types, 8), schema)


def _arrow(kind: T.DataType) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return to_arrow_type(kind)


def _sorted_pieces(pieces: DataFrame) -> DataFrame:
    """The secondary sort: dealt by document, in the order of the output within each partition."""
    return pieces.repartition("key").sortWithinPartitions("key", "place")


def _documents(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[dict[str, Any], Iterator[dict[str, Any]]]]:
    """Documents of a sorted stream, each as its first row and an iterator over its rows, one at a time."""
    rows = (row for batch in batches for start in range(0, batch.num_rows, 64) for row in batch.slice(start, 64).to_pylist())
    ahead = next(rows, None)

    def of(first: dict[str, Any]) -> Iterator[dict[str, Any]]:
        nonlocal ahead
        while ahead is not None and ahead["key"] == first["key"]:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        first = ahead
        own = of(first)
        yield first, own
        for _ in own:
            pass


def _assembling(id_col: str, take: Callable[[], tuple[Callable[[bytes], None], Callable[[], Any]]], trail: bool) -> Callable:
    """Rows of a document fed to ``take()``; the last row has what it made. ``trail``: pieces go on, placed as in the original."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for first, own in _documents(batches):
            (feed, made), copies, at, rank = take(), 0, -1, 0
            head = (first["key"], first[id_col])
            for row in own:
                copies += row["copies"] * (row["place"] == 0)
                if row["place"] == at:  # of a repeated row
                    continue
                at, body = row["place"], row["body"]
                feed(body)
                if not trail:
                    continue
                if first["form"] != "plain" and body in MARKS:
                    rank = MARKS.index(body)
                else:
                    yield *head, 0, *[None] * 4, rank << 48 | at, body, None
            yield *head, copies, *[first[c] for c in OWN], LAST, None, made()

    return rows


def _with_tail(pieces: DataFrame, id_col: str, name: str, kind: T.DataType, take: Callable, trail: bool) -> DataFrame:
    schema = T.StructType([*pieces.schema.fields, T.StructField(name, kind)])
    types, names = [_arrow(f.dataType) for f in schema], schema.names
    run = _assembling(id_col, take, trail)
    return _sorted_pieces(pieces).mapInArrow(lambda batches: _batches(run(batches), names, types, names.index("body")), schema)


def _digest() -> tuple[Callable[[bytes], None], Callable[[], str]]:
    state = hashlib.sha256()
    return state.update, state.hexdigest


def _text() -> tuple[Callable[[bytes], None], Callable[[], str]]:
    held: list[bytes] = []
    return held.append, lambda: b"".join(held).decode()


def _copied(ended: DataFrame, columns: list[str]) -> DataFrame:
    """One row for each of the repeated rows that a document stands for."""
    return ended.withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies"))).select(*columns)


def assembled(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``id_col``, ``n``, ``form``, ``prefix_chars``, ``middle_chars``, ``output`` (the whole text) of ``fim_pieces``, one row a row of its input."""
    return _copied(_with_tail(pieces, id_col, "output", T.StringType(), _text, False), [id_col, *OWN, "output"])


def digested(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """As ``assembled``, with ``output_sha256`` and ``restored_sha256`` in place of the text, and no text held anywhere.

    What is restored comes from the output's pieces and its form alone: a piece belongs to the marker before it.
    """
    trail = _with_tail(pieces, id_col, "output_sha256", T.StringType(), _digest, True).sortWithinPartitions("key", "place")
    names = [id_col, "copies", *OWN, "output_sha256", "restored_sha256"]
    schema = T.StructType([*(trail.schema[c] for c in names[:-1]), T.StructField("restored_sha256", T.StringType())])
    types = [_arrow(f.dataType) for f in schema]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for _, own in _documents(batches):
            state = hashlib.sha256()
            for row in own:
                if row["place"] < LAST:
                    state.update(row["body"])
                else:
                    yield *[row[c] for c in names[:-1]], state.hexdigest()

    ended = trail.mapInArrow(lambda batches: _batches(rows(batches), names, types, len(names) - 1), schema)
    return _copied(ended, [c for c in names if c != "copies"])


def restored(outputs: DataFrame, output_col: str = "output", form_col: str = "form", text_col: str = "text") -> DataFrame:
    """``outputs`` with ``text_col``: the text that an assembled output was made of, by DataFrame functions.

    Plain or null forms: the output as it is. A column named as ``text_col`` is replaced.
    """
    marks = {c: m.decode() for c, m in zip("PMS", MARKS, strict=True)}
    out = F.col(output_col)
    at = lambda c: F.instr(out, marks[c])
    part = lambda c, end: F.substring(out, at(c) + F.lit(len(marks[c])), end - at(c) - F.lit(len(marks[c])))
    over = F.length(out) + 1
    psm = F.concat(part("P", at("S")), part("M", over), part("S", at("M")))
    spm = F.concat(part("P", at("M")), part("M", over), part("S", at("P")))
    return outputs.withColumn(text_col, F.when(F.col(form_col) == "psm", psm).when(F.col(form_col) == "spm", spm).otherwise(out))
