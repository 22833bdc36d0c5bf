"""Byte-pair encoding by dynamic programming over prefixes, and decoding.

For each prefix of a pre-token there is exactly one token that ends its encoding. It is found among the tokens
that are suffixes of the prefix (matches of an Aho-Corasick automaton over the vocabulary) by one test: the token
before it, which is the stored one of the shorter prefix, must be able to stand beside it. Following the stored
tokens back from the end gives the ids. The time is linear in the text, however long a pre-token is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import remembered

#: The byte-level pre-token pattern, as published; ``\s`` is spelled by its Unicode property.
PRETOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Pre-tokens (and chunks) that a worker remembers, some 100 MB each at most; a full memory is emptied.
MEMORY = 300_000
#: A longer pre-token is not remembered.
MEMORY_CHARS = 64


def byte_alphabet() -> dict[str, int]:
    """Character -> byte of byte-level vocabularies: printable bytes stand for themselves, others for 256, 257, ..."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(hidden)}


class BytePairModel:
    """Vocabulary, merge order and automaton of a byte-level tokenizer file (its JSON text)."""

    def __init__(self, tokenizer_json: str):
        spec = json.loads(tokenizer_json)
        alphabet = byte_alphabet()
        self.spell = {i: bytes(alphabet[c] for c in t) for t, i in spec["model"]["vocab"].items()}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", [])}
        names = spec["model"]["vocab"]
        self.merge: dict[tuple[int, int], int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.made: dict[int, int] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            left, right, whole = names[a], names[b], names[a + b]
            self.merge[left, right] = rank
            if whole not in self.parts:
                self.parts[whole], self.made[whole] = (left, right), rank
        self.edges: tuple[dict, dict] = ({}, {})
        self.beside: dict[tuple[int, int], bool] = {}
        self.known: dict[str, bytes] = {}
        self.chunks: dict[str, bytes] = {}
        self._prepare()

    def _prepare(self) -> None:
        import ahocorasick
        import regex

        self.automaton = ahocorasick.Automaton()
        for i, spelt in self.spell.items():
            if len(spelt) == 1 or i in self.parts:
                self.automaton.add_word(spelt.decode("latin-1"), (i, len(spelt)))
        self.automaton.make_automaton()
        self.pretokens = regex.compile(PRETOKEN).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")").split if self.special else None
        #: Texts without it consist of words with one space or line break between any two.
        self.spaced = regex.compile(r"\p{White_Space}{2}|^\p{White_Space}|\p{White_Space}$|[^\P{White_Space} \n]").search

    def edge(self, token: int, side: int) -> list[tuple[int, float]]:
        """The tokens that stand at the right (1) or left (0) edge of ``token`` while it is put together, from its
        last or first byte up, each with the rank at which it is used up."""
        found = self.edges[side].get(token)
        if found is None:
            found, until = [], float("inf")
            at = token
            while True:
                found.append((at, until))
                if at not in self.parts:
                    break
                until, at = self.made[at], self.parts[at][side]
            found.reverse()
            self.edges[side][token] = found
        return found

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay beside each other: no merge across the border fires before both are done.

        Of one rule that applies on both sides of a piece, the left application comes first.
        """
        key = (left, right)
        known = self.beside.get(key)
        if known is None:
            a, b, i, j, known = self.edge(left, 1), self.edge(right, 0), 0, 0, True
            while True:
                (x, x_until), (y, y_until) = a[i], b[j]
                rank = self.merge.get((x, y))
                if rank is not None and rank < x_until and rank <= y_until:
                    known = False
                    break
                if i + 1 == len(a) and j + 1 == len(b):
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.beside) >= 4 * MEMORY:
                self.beside.clear()
            self.beside[key] = known
        return known

    def encode_pretoken(self, piece: bytes) -> list[int]:
        last = [-1] * (len(piece) + 1)
        compatible, spell = self.compatible, self.spell
        for end, (token, size) in self.automaton.iter(piece.decode("latin-1")):
            end += 1
            if last[end] < 0:
                start = end - size
                if start == 0 or compatible(last[start], token):
                    last[end] = token
        ids, at = [], len(piece)
        while at:
            ids.append(last[at])
            at -= len(spell[last[at]])
        ids.reverse()
        return ids

    def _pretoken(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            found = np.array(self.encode_pretoken(piece.encode()), dtype=np.int32).tobytes()
            if len(piece) <= MEMORY_CHARS:
                if len(self.known) >= MEMORY:
                    self.known.clear()
                self.known[piece] = found
        return found

    def _chunk(self, chunk: str) -> bytes:
        """A word with the space or line break before it."""
        found = b"".join(map(self._pretoken, self.pretokens(chunk)))
        if len(chunk) <= MEMORY_CHARS:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[chunk] = found
        return found

    def _plain(self, text: str) -> bytes:
        if not text:
            return b""
        if self.spaced(text):
            return b"".join(map(self._pretoken, self.pretokens(text)))
        first, *rest = text.replace("\n", " \n").split(" ")
        get, make = self.chunks.get, self._chunk
        out = [b"".join(map(self._pretoken, self.pretokens(first)))]
        for word in rest:
            found = get(word)
            if found is None:
                # a chunk is remembered by its word, which starts with "\n" or stands for " " + word
                found = make(word) if word[0] == "\n" else self._spaced_word(word)
            out.append(found)
        return b"".join(out)

    def _spaced_word(self, word: str) -> bytes:
        found = b"".join(map(self._pretoken, self.pretokens(" " + word)))
        if len(word) <= MEMORY_CHARS:
            if len(self.chunks) >= MEMORY:
                self.chunks.clear()
            self.chunks[word] = found
        return found

    def encode(self, text: str) -> bytes:
        """The ids as little-endian 32-bit integers; names of special tokens in the text become their ids."""
        if self.cut is None or not any(name in text for name in self.special):
            return self._plain(text)
        return b"".join(
            np.int32(self.special[part]).tobytes() if part in self.special else self._plain(part) for part in self.cut(text)
        )

    def decode_table(self) -> list[bytes]:
        out = [b""] * (max(chain(self.spell, self.special.values())) + 1)
        for i, spelt in self.spell.items():
            out[i] = spelt
        for name, i in self.special.items():
            out[i] = name.encode()
        return out


def model_of(tokenizer_json: str) -> BytePairModel:
    """One model a worker process; the vocabulary text comes by broadcast and is of fixed size."""
    return remembered(f"bpe {hash(tokenizer_json)}", lambda: BytePairModel(tokenizer_json))


def _lists(rows: list[bytes]) -> pa.Array:
    sizes = np.fromiter((len(x) // 4 for x in rows), dtype=np.int64, count=len(rows))
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    if offsets[-1] >= 2**31:
        raise ValueError("an Arrow batch holds over 2**31 ids; lower spark.sql.execution.arrow.maxRecordsPerBatch")
    values = pa.Array.from_buffers(pa.int32(), int(offsets[-1]), [None, pa.py_buffer(b"".join(rows))])
    return pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), values)


def encode_texts(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col`` (array of int): the exact ids of each whole text, no special tokens added.

    ``tokenizer_path`` names a byte-level BPE file on the driver; its text is broadcast (a few MB, fixed).
    Null or empty text: an empty array. All columns and rows stay, repeated ones too; a column named as
    ``ids_col`` is replaced. An empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    own = docs.drop(ids_col)
    names = [*own.columns, ids_col]
    place = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_of(vocabulary.value)
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 1000):
                part = batch.slice(start, 1000)
                ids = _lists([model.encode(t) if t else b"" for t in part.column(place).to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, ids], names=names)

    schema = T.StructType([*own.schema.fields, T.StructField(ids_col, T.ArrayType(T.IntegerType(), True), True)])
    return own.mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, tokenizer_path: str, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``tokens`` with ``text_col``: the text of each row's ids, special tokens by name; bytes that are no UTF-8
    become U+FFFD. Null or empty ids: the empty text. A column named as ``text_col`` is replaced."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = tokens.sparkSession.sparkContext.broadcast(f.read())
    own = tokens.drop(text_col)
    names = [*own.columns, text_col]
    place = names.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spelt = model_of(vocabulary.value).decode_table().__getitem__
        for batch in batches:
            for start in range(0, max(batch.num_rows, 1), 500):
                part = batch.slice(start, 500)
                column = part.column(place)
                values, offsets = column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False))])
                texts = [b"".join(map(spelt, values[a:b].tolist())).decode("utf-8", "replace") for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.string())], names=names)

    return own.mapInArrow(run, T.StructType([*own.schema.fields, T.StructField(text_col, T.StringType(), True)]))


def with_digests(decoded: DataFrame, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``n_tokens``, ``ids_sha256`` (decimal ids joined by commas) and ``decoded_sha256`` beside the columns."""
    joined = F.array_join(F.col(ids_col).cast("array<string>"), ",")
    return decoded.withColumns({
        "n_tokens": F.size(ids_col).cast("long"),
        "ids_sha256": F.sha2(joined.cast("binary"), 256),
        "decoded_sha256": F.sha2(F.col(text_col).cast("binary"), 256),
    })
