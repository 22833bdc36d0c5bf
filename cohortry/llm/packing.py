"""Packing of tokenized documents into fixed-size sequences by linear grouping, then best fit.

Documents become pieces of at most ``capacity`` tokens. Only the number of pieces of each length decides how to pack,
so the plan is made once for all pieces, from a histogram whose size is bounded by the capacity: large lengths are
rounded up within groups of equal cardinality; configurations of the rounded sizes are optimised by a linear program whose columns are
generated, and rounded down; what that leaves goes into the fullest configurations; actual lengths take the places
of their group; small lengths then go where they fit best. Plain best fit is tried beside it, and the better plan taken. Pieces are numbered among those of their length, and a
piece's number says which place of the plan is its own.
"""

from __future__ import annotations

import os
from bisect import bisect_left, insort
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import remembered, saved

#: Words that a worker remembers, some 80 MB at most, in two halves: when the newer is full the older is dropped, and words met
#: since then stay. A word is remembered once it stands twice among the texts at hand, as most others do not come again.
MEMORY = 300_000
MEMORY_CHARS = 64
#: Characters of texts whose words are looked up together.
RUN_CHARS = 4 << 20
#: What of ``WordTokenizer.unusual`` a Latin-1 text can hold.
UNUSUAL_LATIN = ("<|", "\x1c", "\x1d", "\x1e", "\x1f")
#: Bits of a piece's number among those of its length.
NUMBER_BITS = 43


class WordTokenizer:
    """A tokenizer whose pre-tokens never cross white space, called once for the new words of a batch."""

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import re

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.bytes_of = [k.to_bytes(4, "little") for k in range(max(self.tokenizer.get_vocab().values()) + 1)]
        #: What makes words of a text depend on more than themselves, or lower-casing on the library's tables.
        self.unusual = re.compile("[^\x00-ɏ]|[\x1c-\x1f]|<\\|").search
        self.marked = re.compile(r"([^\W\d_]+)([^\w\s'\xad]+)").fullmatch
        self.alphabet = {b: c for c, b in byte_alphabet().items()}

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(x.ids, dtype="<u4").tobytes() for x in self.tokenizer.encode_batch(texts, add_special_tokens=False)]

    def _merge(self, pretoken: str) -> bytes:
        """One pre-token, by the library's model alone: no normalizing, no splitting."""
        spelt = pretoken if pretoken.isascii() and pretoken.isprintable() else pretoken.encode().decode("latin-1").translate(self.alphabet)
        return b"".join([self.bytes_of[x.id] for x in self.tokenizer.model.tokenize(spelt)])

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        """New words. Letters, or letters and marks behind them, are pre-tokens as they stand; others are asked for whole."""
        known, fresh, ask = self.known, {}, []

        def part(pretoken: str) -> bytes:
            found = fresh.get(pretoken) or known.get(pretoken)
            if found is None:
                found = fresh[pretoken] = self._merge(pretoken)
            return found

        for word in words:
            if word.isalpha():
                part(word)
            elif (m := self.marked(word)) and m[1].isalpha():
                fresh[word] = part(m[1]) + part(m[2])
            else:
                ask.append(word)
        fresh.update(zip(ask, self._encode(ask), strict=True))
        return fresh

    def _ids_of(self, words: list[str], again: list[bool]) -> list[bytes]:
        """Ids of each of ``words``, which are distinct; those that are met ``again`` are remembered."""
        found = list(map(self.known.get, words))
        new = []
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = self.older.get(words[k])
            if found[k] is None:
                new.append(words[k])
            else:
                self.known[words[k]] = found[k]
        fresh = self._learn(new)
        for k in [k for k, ids in enumerate(found) if ids is None]:
            found[k] = fresh[words[k]]
            if again[k] and len(words[k]) <= MEMORY_CHARS:
                self.known[words[k]] = found[k]
        if len(self.known) > MEMORY // 2:
            self.older, self.known = self.known, {}
        return found

    def _odd(self, text: str) -> bool:
        """Whether ``unusual`` finds something, asked at less cost where the text is ASCII or Latin-1."""
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return self.unusual(text) is not None
        return any(mark in text for mark in UNUSUAL_LATIN)

    def _encode_usual(self, texts: list[str]) -> list[bytes]:
        """Texts without ``unusual``, split and their words numbered by Arrow: a word is looked up once, however often it stands there."""
        # of white space beyond ASCII, these texts can hold two characters
        lowered = [t.lower() if t.isascii() else t.lower().replace("\x85", " ").replace("\xa0", " ") for t in texts]
        words = pc.ascii_split_whitespace(pa.array(lowered, pa.large_string()))
        numbers = words.flatten().dictionary_encode()
        at = numbers.indices.to_numpy()
        again = np.bincount(at, minlength=len(numbers.dictionary)) > 1
        found = self._ids_of(numbers.dictionary.to_numpy(zero_copy_only=False).tolist(), again.tolist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        n, first = sizes[at], (np.cumsum(sizes) - sizes)[at]
        ends = np.concatenate([[0], np.cumsum(n)])
        place = np.repeat(first - ends[:-1], n) + np.arange(ends[-1])
        ids = np.frombuffer(b"".join(found), dtype="<u4")[place].tobytes()
        return [ids[a:b] for a, b in pairwise((ends[words.offsets.to_numpy()] * 4).tolist())]

    def encode(self, texts: list[str | None]) -> list[bytes]:
        out = [b""] * len(texts)
        usual, whole = [], []
        for k, t in enumerate(texts):
            if t:
                (whole if self._odd(t) else usual).append(k)
        for encode, chosen in ((self._encode_usual, usual), (self._encode, whole)):
            for run in _runs(chosen, texts):
                for k, ids in zip(run, encode([texts[k] for k in run]), strict=True):
                    out[k] = ids
        return out


def _runs(chosen: list[int], texts: list[str | None]) -> Iterator[list[int]]:
    """``chosen`` in runs of at most ``RUN_CHARS`` characters, or of one text."""
    run: list[int] = []
    held = 0
    for k in chosen:
        if run and held + len(texts[k]) > RUN_CHARS:
            yield run
            run, held = [], 0
        run.append(k)
        held += len(texts[k])
    if run:
        yield run


def _tokenizer(tokenizer_json: str) -> WordTokenizer:
    return remembered(f"words {hash(tokenizer_json)}", lambda: WordTokenizer(tokenizer_json))


def document_pieces(
    docs: DataFrame, tokenizer_path: str, end_id: int, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """``id_col``, ``piece``, ``start``, ``length``, ``ids`` (little-endian unsigned 32-bit integers, binary).

    A document is its ids and then ``end_id``; documents longer than ``capacity`` are cut every ``capacity`` ids.
    Null or empty text: one piece that is ``end_id`` alone. Null ids of documents and repeated rows are kept: each row is
    a document of its own. Other columns are not read. An empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    own = docs.select(id_col, text_col)
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _tokenizer(vocabulary.value).encode
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                rows, piece, start, ids = [], [], [], []
                for k, found in enumerate(encode(part.column(1).to_pylist())):
                    found += end
                    for p, at in enumerate(range(0, len(found), 4 * capacity)):
                        rows.append(k)
                        piece.append(p)
                        start.append(at // 4)
                        ids.append(found[at : at + 4 * capacity])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(rows, pa.int64())), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())],
                    names=[id_col, "piece", "start", "length", "ids"],
                )

    schema = T.StructType([
        own.schema[id_col], T.StructField("piece", T.IntegerType()), T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("ids", T.BinaryType()),
    ])
    return own.mapInArrow(run, schema)


def _fullest(sizes: list[int], left: list[int], first: int, capacity: int) -> list[int]:
    """Group numbers of the fullest configuration that holds group ``first`` and what is left of later ones."""
    room = capacity - sizes[first]
    reach, steps = 1, []
    mask = (1 << (room + 1)) - 1
    for g in range(first, len(sizes)):
        size = sizes[g]
        for _ in range(min(left[g] - (g == first), room // size)):
            grown = reach | (reach << size & mask)
            if grown == reach:
                break
            steps.append((g, reach))
            reach = grown
        if reach >> room & 1:
            break
    total, chosen = reach.bit_length() - 1, [first]
    for g, before in reversed(steps):
        if not before >> total & 1:
            chosen.append(g)
            total -= sizes[g]
    return chosen


def _substituted(slots: list[int], times: int, members: list[list[list[int]]]) -> Iterator[tuple[int, list[int]]]:
    """(sequences, lengths) until ``times`` sequences of the groups ``slots`` are filled with actual lengths, which are
    taken from ``members``: for each group, runs of [length, pieces left]."""
    need = {g: slots.count(g) for g in slots}
    while times:
        step = min(times, *(members[g][-1][1] // n for g, n in need.items()))
        lengths = []
        if step:
            for g, n in need.items():
                run = members[g][-1]
                lengths += [run[0]] * n
                run[1] -= step * n
                if not run[1]:
                    members[g].pop()
        else:
            step = 1
            for g in slots:
                run = members[g][-1]
                lengths.append(run[0])
                run[1] -= 1
                if not run[1]:
                    members[g].pop()
        yield step, lengths
        times -= step


def _best_content(values: np.ndarray, sizes: list[int], capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable contents of one sequence (any number of each size): value, and how many of each."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for g in np.argsort(-values / np.array(sizes)):
        size, value = sizes[g], values[g]
        if value <= 1e-12:
            continue
        for start in range(size, capacity + 1, size):  # one more of it on top of each room, a size's width at a time
            end = min(capacity + 1, start + size)
            more = best[start - size : end - size] + value
            better = more > best[start:end] + 1e-12
            best[start:end][better] = more[better]
            last[start:end][better] = g
    counts, room = np.zeros(len(sizes)), int(np.argmax(best))
    value = best[room]
    while room > 0:
        if last[room] < 0:
            room -= 1
            continue
        counts[last[room]] += 1
        room -= sizes[last[room]]
    return float(value), counts


def configurations(sizes: list[int], demand: list[int], capacity: int, steps: int = 4000) -> list[tuple[int, list[int]]]:
    """(sequences, group numbers in each) of whole sequences: configurations of few sizes that a linear program chooses, rounded down.

    Columns are generated: the prices of the sizes under the present configurations say which contents of a sequence would be worth most, and
    those replace a configuration until none is worth more than the sequence that it takes. What rounding leaves over is for the caller.
    """
    if not sizes:
        return []
    m, need = len(sizes), np.array(demand, dtype=float)
    columns = np.diag([float(capacity // n) for n in sizes])
    inverse = np.diag(1 / np.diag(columns))
    amounts = inverse @ need
    for _ in range(steps):
        worth, column = _best_content(inverse.sum(axis=0), sizes, capacity)
        if worth <= 1 + 1e-7:
            break
        direction = inverse @ column
        rising = direction > 1e-9
        ratios = np.full(m, np.inf)
        ratios[rising] = np.maximum(amounts[rising], 0) / direction[rising]
        out = int(np.argmin(ratios))
        step = ratios[out]
        if not np.isfinite(step):
            break
        amounts -= step * direction
        amounts[out] = step
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        columns[:, out] = column
    # never more of a size than there is, whatever rounding errors say
    left, chosen = list(demand), []
    for k in np.argsort(-amounts):
        own = {g: int(round(n)) for g, n in enumerate(columns[:, k]) if n > 0.5}
        times = min([int(amounts[k] + 1e-6), *(left[g] // n for g, n in own.items())])
        if times > 0:
            chosen.append((times, [g for g, n in own.items() for _ in range(n)]))
            for g, n in own.items():
                left[g] -= times * n
    return chosen


#: Groups of large lengths that the linear program sees at most.
PROGRAM_GROUPS = 192


def plan_sequences(counts: dict[int, int], capacity: int, groups: int = 4096, small: int | None = None) -> list[tuple[int, list[tuple[int, int]]]]:
    """(sequences, [(length, pieces of it in each of them)]) for ``counts`` pieces of each length from 1 to ``capacity``.

    Lengths above ``small`` (an eighth of the capacity if not given) are large. Groups of them are of equal cardinality
    and end where the length changes if there are no more than ``groups`` lengths: then nothing is lost by rounding.
    Three plans are made: greedy configurations of ``groups`` groups, best fit decreasing of all lengths, and, unless one of these is as short as
    the tokens alone allow, configurations of at most ``PROGRAM_GROUPS`` groups by a linear program. The one of fewest sequences is
    taken. Work and result grow with the capacity, not with the number of pieces.
    """
    small = capacity // 8 if small is None else small
    size = lambda plan: sum(times for times, _ in plan)
    best = min((_plan(counts, capacity, groups, most, False) for most in (small, capacity)), key=size)
    if size(best) * capacity - sum(n * c for n, c in counts.items()) < capacity:
        return best
    return min(best, _plan(counts, capacity, min(groups, PROGRAM_GROUPS), small, True), key=size)


def _plan(counts: dict[int, int], capacity: int, groups: int, small: int, program: bool) -> list[tuple[int, list[tuple[int, int]]]]:
    """One plan: configurations by linear program first (``program``), then the fullest ones, then small lengths by best fit."""
    large = sorted((n for n in counts if n > small and counts[n]), reverse=True)
    cardinality = max(1, -(-sum(counts[n] for n in large) // groups))
    members: list[list[list[int]]] = []
    sizes: list[int] = []
    for length in large:
        left = counts[length]
        while left:
            if not members or len(large) <= groups or sum(n for _, n in members[-1]) >= cardinality:
                members.append([])
                sizes.append(length)
            take = left if len(large) <= groups else min(left, cardinality - sum(n for _, n in members[-1]))
            members[-1].append([length, take])
            left -= take
    rooms: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    free: list[int] = []

    def put(room: int, times: int, runs: list[tuple[int, int]]) -> None:
        if room not in rooms:
            rooms[room] = []
            insort(free, room)
        rooms[room].append((times, runs))

    left, first = [sum(n for _, n in m) for m in members], 0
    for times, chosen in configurations(sizes, left, capacity) if program else []:
        for g in chosen:
            left[g] -= times
        for step, lengths in _substituted(chosen, times, members):
            put(capacity - sum(lengths), step, [(n, lengths.count(n)) for n in dict.fromkeys(lengths)])
    while first < len(sizes):
        if not left[first]:
            first += 1
            continue
        chosen = _fullest(sizes, left, first, capacity)
        times = min(left[g] // chosen.count(g) for g in set(chosen))
        for g in chosen:
            left[g] -= times
        for step, lengths in _substituted(chosen, times, members):
            put(capacity - sum(lengths), step, [(n, lengths.count(n)) for n in dict.fromkeys(lengths)])
    for length in sorted((n for n in counts if n <= small), reverse=True):
        count = counts[length]
        while count:
            at = bisect_left(free, length)
            if at < len(free):
                room = free[at]
                times, runs = rooms[room].pop()
                if not rooms[room]:
                    del rooms[room], free[at]
            else:
                room, times, runs = capacity, -(-count // (capacity // length)), []
            each = room // length
            full = min(times, count // each)
            if full:
                put(room - each * length, full, [*runs, (length, each)])
            times, count = times - full, count - full * each
            if times and count:
                put(room - count * length, 1, [*runs, (length, count)])
                times, count = times - 1, 0
            if times:
                put(room, times, runs)
    return [bins for room in free for bins in rooms[room]]


def _places(plan: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, np.ndarray]:
    """The plan by length and piece number: lengths in order, and rows of (key, first number, first sequence, pieces of
    the length in a sequence, offset of the first of them); keys are the place of the length, then the first number."""
    lengths = np.unique([n for _, runs in plan for n, _ in runs]).astype(np.int64)
    used, rows, sequence = dict.fromkeys(lengths.tolist(), 0), [], 0
    where = {n: k for k, n in enumerate(lengths.tolist())}
    for times, runs in plan:
        at = 0
        for n, each in runs:
            rows.append(((where[n] << NUMBER_BITS) + used[n], used[n], sequence, each, at))
            used[n] += times * each
            at += n * each
        sequence += times
    return lengths, np.array(sorted(rows), dtype=np.int64).reshape(-1, 5)


def _placed(lengths: np.ndarray, numbers: np.ndarray, table: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """(sequence, offset) of pieces by length and number among the pieces of that length."""
    row = table[1][np.searchsorted(table[1][:, 0], (np.searchsorted(table[0], lengths) << NUMBER_BITS) + numbers, side="right") - 1]
    nth = numbers - row[:, 1]
    return row[:, 2] + nth // row[:, 3], row[:, 4] + nth % row[:, 3] * lengths


def _numbered(lengths: np.ndarray, seen: np.ndarray) -> np.ndarray:
    """Number of each piece among those of its length; ``seen`` counts earlier ones and is brought up to date."""
    order = np.argsort(lengths, kind="stable")
    ordered = lengths[order]
    starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]])) if len(ordered) else np.empty(0, dtype=np.int64)
    out = np.empty(len(lengths), dtype=np.int64)
    out[order] = np.arange(len(ordered)) - np.repeat(starts, np.diff(np.append(starts, len(ordered)))) + seen[ordered]
    seen += np.bincount(lengths, minlength=len(seen))
    return out


def assign_sequences(pieces: DataFrame, capacity: int = 4096, groups: int = 4096, length_col: str = "length") -> DataFrame:
    """``pieces`` with ``sequence_id`` (from 0) and ``offset``: each sequence holds at most ``capacity``, without gaps.

    ``pieces`` is written to the shared folder once (keep wide columns such as ids out and join them on later), each
    row with the partition that wrote it and its number there among pieces of its length. The driver sees one count for
    each length, at most ``capacity`` rows, and sends back a plan of that order of size.
    Lengths must be 1 to ``capacity`` (else ValueError in the task). Ties in length: any order. Columns named
    ``sequence_id`` or ``offset`` are replaced. An empty table gives no rows.
    """
    own = pieces.drop("sequence_id", "offset", "__block", "__nth", "__base")
    place, width = own.columns.index(length_col), len(own.columns)
    dealt = T.StructType([*own.schema.fields, T.StructField("__block", T.LongType()), T.StructField("__nth", T.LongType())])
    names = dealt.names

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, seen = TaskContext.get().partitionId(), np.zeros(capacity + 1, dtype=np.int64)
        for batch in batches:
            lengths = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            if len(lengths) and (lengths.min() < 1 or lengths.max() > capacity):
                raise ValueError(f"piece lengths must be 1 to {capacity}")
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(lengths), block)), pa.array(_numbered(lengths, seen))], names=names)

    table = saved(own.mapInArrow(number, dealt))
    counts = saved(table.groupBy("__block", length_col).agg(F.count(F.lit(1)).alias("n")))
    plan = plan_sequences({r[0]: r[1] for r in counts.groupBy(length_col).agg(F.sum("n")).collect()}, capacity, groups)
    sent = pieces.sparkSession.sparkContext.broadcast(_places(plan))
    before = Window.partitionBy(length_col).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("__block", length_col, F.coalesce(F.sum("n").over(before), F.lit(0)).cast("long").alias("__base"))
    # one row for each partition and length: that grows with the table, so it is not to be broadcast
    based = table.join(bases.hint("merge"), ["__block", length_col]).select(*own.columns, (F.col("__nth") + F.col("__base")).alias("__nth"))
    schema = T.StructType([*own.schema.fields, T.StructField("sequence_id", T.LongType()), T.StructField("offset", T.LongType())])

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths = batch.column(place).to_numpy(zero_copy_only=False).astype(np.int64)
            sequence, offset = _placed(lengths, batch.column(width).to_numpy(), sent.value)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sequence, pa.int64()), pa.array(offset, pa.int64())], names=schema.names)

    return based.mapInArrow(assign, schema)
