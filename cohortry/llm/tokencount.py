"""Token counts without token ids: pieces are counted once for each distinct pre-token.

The texts are read twice. The first reading counts in how many texts each distinct pre-token stands; the pieces of each
are then counted once, wherever it came from. The second reading makes each text's pre-token frequencies and joins them
to those counts. Pre-tokens that make up over ``COMMON`` of all entries (fewer than ``1 / COMMON`` by that
definition, each of at most 64 characters) meet their entries where they are made, so that neither a common word
nor the bulk of the entries is shuffled; all others are joined by a shuffle on the pre-token.
"""

from __future__ import annotations

import hashlib
import os
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe import byte_alphabet
from .common import remembered, saved, text_of

#: A pre-token with over this part of all (text, pre-token) entries is common: fewer than 262,144 of them, some 30 MB in a worker at most.
COMMON = 1 / 262144
#: A longer pre-token is named by its digest, and its pieces are counted where it stands.
KEY_CHARS = 64
#: Distinct pre-tokens that a task adds up before it passes them on.
HELD = 200_000


class PretokenCounter:
    """Pre-tokens of a text, and pieces of a pre-token, as the tokenizer file says; one in a worker."""

    #: Fixed value: the pre-token pattern of the file that ``split`` may spell itself (see ``fast``).
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, tokenizer_json: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json
        import re

        import regex
        from tokenizers import Tokenizer

        spec = json.loads(tokenizer_json)
        self.tokenizer = Tokenizer.from_str(tokenizer_json)
        self.specials = {x["content"] for x in spec.get("added_tokens", [])}
        if any(x["normalized"] or x["single_word"] or x["lstrip"] or x["rstrip"] for x in spec.get("added_tokens", [])):
            raise ValueError("added tokens that look at what is around them are not supported")
        self.at_specials = re.compile("|".join(map(re.escape, sorted(self.specials, key=len, reverse=True)))).split if self.specials else None
        self.number_of_specials = re.compile("|".join(map(re.escape, self.specials))).findall if self.specials else None
        #: Where lower-casing, white space or letters may differ between Python and the library.
        self.unusual = re.compile("[^\x00-ɏ]|[\x1c-\x1f]").search
        self.words = regex.compile(self.PATTERN).findall
        self.letters = {c: b for c, b in byte_alphabet().items()}
        self.alphabet = {b: c for c, b in byte_alphabet().items()}
        splits = [p.get("pattern", {}).get("Regex") for p in spec["pre_tokenizer"].get("pretokenizers", [spec["pre_tokenizer"]])]
        #: Whether texts of usual characters can be split here; all others are split by the library.
        self.fast = splits[0] == self.PATTERN and spec["normalizer"] is not None and [n["type"] for n in spec["normalizer"].get("normalizers", [])] == ["NFC", "Replace", "Lowercase"]

    def pretokens(self, text: str) -> list[str]:
        if self.fast and not self.unusual(text):
            return self.words(text.lower())
        plain = self.tokenizer.normalizer.normalize_str(text) if self.tokenizer.normalizer else text
        return [bytes(map(self.letters.__getitem__, p)).decode() for p, _ in self.tokenizer.pre_tokenizer.pre_tokenize_str(plain)]

    def frequencies(self, text: str) -> tuple[int, Counter[str]]:
        """Names of special tokens in the text, and its pre-tokens with their frequencies."""
        if self.at_specials is None or not any(x in text for x in self.specials):
            return 0, Counter(self.pretokens(text))
        found: Counter[str] = Counter()
        for part in self.at_specials(text):
            found.update(self.pretokens(part))
        return len(self.number_of_specials(text)), found

    def pieces(self, pretoken: str) -> int:
        plain = pretoken.isascii() and pretoken.isprintable()
        spelt = pretoken if plain else pretoken.encode().decode("latin-1").translate(self.alphabet)
        return len(self.tokenizer.model.tokenize(spelt))


def _counter(tokenizer_json: str) -> PretokenCounter:
    return remembered(f"pretokens {hash(tokenizer_json)}", lambda: PretokenCounter(tokenizer_json))


def _key(pretoken: str) -> str:
    """Its name: itself, or a digest behind NUL, which no pre-token joins to letters."""
    return pretoken if len(pretoken) <= KEY_CHARS else "\0" + hashlib.sha256(pretoken.encode()).hexdigest()


def pretoken_pieces(docs: DataFrame, tokenizer_path: str, text_col: str = "text") -> DataFrame:
    """``pretoken`` (or its digest), ``uses`` (texts that hold it) and ``pieces`` of every distinct pre-token, in a saved table."""
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())

    def table(uses: Counter[str], long: dict[str, int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(uses), pa.string()), pa.array(uses.values(), pa.int64()), pa.array([long.get(k) for k in uses], pa.int64())], names=["pretoken", "uses", "pieces"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, uses, long = _counter(vocabulary.value), Counter(), {}
        for batch in batches:
            for text in batch.column(0):
                found = counter.frequencies(text.as_py() or "")[1]
                if any(len(p) > KEY_CHARS for p in found):
                    for p in [p for p in found if len(p) > KEY_CHARS]:
                        if _key(p) not in long:
                            long[_key(p)] = counter.pieces(p)
                    uses.update([_key(p) for p in found])
                else:
                    uses.update(found.keys())
                if len(uses) >= HELD:
                    yield table(uses, long)
                    uses, long = Counter(), {}
        yield table(uses, long)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = _counter(vocabulary.value).pieces
        for batch in batches:
            known = [n if n is not None else pieces(p) for p, n in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(known, pa.int64())], names=["pretoken", "uses", "pieces"])

    schema = "pretoken string, uses long, pieces long"
    seen = docs.select(text_col).mapInArrow(read, schema)
    return saved(seen.groupBy("pretoken").agg(F.sum("uses").alias("uses"), F.max("pieces").alias("pieces")).mapInArrow(count, schema))


def token_counts(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``n_bytes`` (UTF-8) and ``n_tokens`` of each whole text: as the library counts, no ids are made.

    * Names of special tokens inside a text are one token each, as the library reads them by default.
    * Null or empty text: 0 bytes, 0 tokens. Rows that repeat an id are texts of their own; null ids stay.
    * A very long text is its distinct pre-tokens; a very long pre-token travels as a digest.
    * Other columns are not read, whatever their names. An empty table gives no rows.
    """
    with open(tokenizer_path, encoding="utf-8") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    pretokens = pretoken_pieces(docs, tokenizer_path, text_col)
    total = pretokens.agg(F.sum("uses")).first()[0] or 0
    often = {r["pretoken"]: r["pieces"] for r in pretokens.where(F.col("uses") > max(total * COMMON, 1)).select("pretoken", "pieces").collect()}
    common = docs.sparkSession.sparkContext.broadcast(often)
    own = docs.select(F.col(id_col), F.octet_length(text_of(text_col)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    names = [id_col, "n_bytes", "known", "rest"]

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter, get = _counter(vocabulary.value), common.value.get
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part, known, sizes, rest, times = batch.slice(start, 1000), [], [0], [], []
                for text in part.column(2):
                    tokens, found = counter.frequencies(text.as_py() or "")
                    for pretoken, n in found.items():
                        key = _key(pretoken)
                        pieces = get(key)
                        if pieces is None:
                            rest.append(key)
                            times.append(n)
                        else:
                            tokens += n * pieces
                    known.append(tokens)
                    sizes.append(len(rest))
                entries = pa.StructArray.from_arrays([pa.array(rest, pa.string()), pa.array(times, pa.int64())], names=["pretoken", "times"])
                lists = pa.ListArray.from_arrays(pa.array(np.array(sizes, dtype=np.int32)), entries)
                yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(known, pa.int64()), lists], names=names)

    entry = T.StructType([T.StructField("pretoken", T.StringType()), T.StructField("times", T.LongType())])
    schema = T.StructType([*own.schema.fields[:2], T.StructField("known", T.LongType()), T.StructField("rest", T.ArrayType(entry))])
    texts = saved(own.mapInArrow(read, schema).withColumn("__row", F.monotonically_increasing_id()))
    entries = texts.select("__row", F.inline("rest"))
    rare = pretokens.where(F.col("uses") <= max(total * COMMON, 1)).select("pretoken", "pieces")
    sums = entries.join(rare, "pretoken").groupBy("__row").agg(F.sum(F.col("times") * F.col("pieces")).alias("more"))
    counted = texts.select("__row", id_col, "n_bytes", "known").join(sums, "__row", "left")
    return counted.select(id_col, "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).cast("long").alias("n_tokens"))
