"""Exact deduplication by deterministic block naming, in DataFrame operations only.

A text is cut into blocks of a fixed number of bytes. The distinct blocks are sorted and numbered: a block's number is its
name. Adjacent names are then paired, the distinct pairs sorted and numbered, and so on, until each document
has one name. Two documents have the same (level, name) exactly if their texts are equal.

The sort key of a block is (fingerprint, content). Content is looked at once, where equal blocks meet in an
aggregation with map-side combining; if no two contents share a fingerprint, names travel by fingerprint
alone, and only contents that do share one are sorted and joined in full.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_keys, numbered, same, saved, spread_join, text_of

#: Stands for the missing second half of an odd pair; no name takes this value.
NO_NAME = -(2**62)


def block_identities(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    block_chars: int = 4096,
    fingerprint: Callable[[Column], Column] = F.xxhash64,
) -> DataFrame:
    """One row per distinct (id, text): ``id``, ``text_key``, ``level``, ``name``.

    ``(level, name)`` is equal for equal texts and different for different ones, whatever ``fingerprint`` is.
    Blocks are of ``block_chars`` bytes of UTF-8. Null text is the empty text. ``text_key`` tells apart different texts under one id.
    """
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text"))
    count = F.greatest(F.lit(1), F.ceil(F.octet_length("text") / F.lit(block_chars)).cast("int"))
    # a place in bytes is found at once, one in characters by counting from the start; the array binds the bytes once
    cut = lambda raw: F.transform(F.sequence(F.lit(0), F.col("n") - 1), lambda i: F.substring(raw, i * block_chars + 1, F.lit(block_chars)))
    blocks = (
        texts.withColumn("text_key", F.xxhash64("text"))
        .withColumn("n", count)
        .select("id", "text_key", "n", F.posexplode(F.flatten(F.transform(F.array(F.col("text").cast("binary")), cut))).alias("pos", "block"))
        .withColumn("fp", fingerprint(F.col("block")))
    )
    contents = blocks.groupBy("fp", "block").agg(F.count(F.lit(1)).alias("uses"))
    names = numbered(contents.groupBy("fp").agg(F.count(F.lit(1)).alias("contents"), F.sum("uses").alias("uses")), "fp")
    places = blocks.select("id", "text_key", "n", "pos", "fp")
    state = spread_join(places, names, ["fp"], heavy_keys(names, ["fp"], "uses"), ["id", "pos"]).where("contents = 1").select("id", "text_key", "n", "pos", "name")
    if not names.where("contents > 1").isEmpty():
        shared = names.where("contents > 1").select("fp")
        own = numbered(contents.join(shared, "fp", "left_semi").select("fp", "block"), "fp", "block")
        state = state.unionByName(
            blocks.join(own, ["fp", "block"]).select("id", "text_key", "n", "pos", (-1 - F.col("name")).alias("name"))
        )
    state, level, found = saved(state), 0, []
    discard(names)
    while True:
        found.append(state.where("n = 1").select("id", "text_key", F.lit(level).alias("level"), "name").distinct())
        state = state.where("n > 1")
        if state.isEmpty():
            break
        level += 1
        pairs = state.groupBy("id", "text_key", "n", F.expr("pos div 2").cast("int").alias("pos")).agg(
            F.max(F.when(F.col("pos") % 2 == 0, F.col("name"))).alias("a"),
            F.coalesce(F.max(F.when(F.col("pos") % 2 == 1, F.col("name"))), F.lit(NO_NAME)).alias("b"),
        )
        pairs = saved(pairs)
        names = numbered(pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("uses")), "a", "b")
        state = spread_join(pairs, names, ["a", "b"], heavy_keys(names, ["a", "b"], "uses"), ["id", "pos"])
        state = saved(state.select("id", "text_key", F.expr("cast((n + 1) div 2 as int)").alias("n"), "pos", "name"))
        discard(pairs, names)
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_chars: int = 4096, fingerprint: Callable[[Column], Column] = F.xxhash64) -> DataFrame:
    """Every row with its group of equal texts: ``id_col``, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    * Null text counts as empty; all empty texts form one group. An empty table gives no rows.
    * ``keep_id`` is the largest id of the group (null only if all its ids are null); ``group_size`` counts rows.
    * Rows that repeat an id with the same text are all returned and all counted; each row whose id is
      ``keep_id`` is ``kept``.
    * Null ids are ids like others, but never ``keep_id`` where a group has another.
    * Other columns of ``docs`` are not read, whatever their names.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).select(
        "id", F.xxhash64("text").alias("text_key"), F.sha2(F.col("text").cast("binary"), 256).alias("text_sha256")
    )
    names = block_identities(docs, id_col, text_col, block_chars, fingerprint)
    placed = saved(rows.join(names, same(rows, names, "id", "text_key")).select(rows["id"], "level", "name", "text_sha256"))
    groups = saved(placed.groupBy("level", "name").agg(F.max("id").alias("keep_id"), F.count(F.lit(1)).alias("group_size")))
    return spread_join(placed, groups, ["level", "name"], heavy_keys(groups, ["level", "name"], "group_size"), ["id"]).select(
        F.col("id").alias(id_col), "keep_id", "group_size", F.col("id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256"
    )


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    kept = exact_duplicates(docs, id_col, text_col, **options).where("kept").select(F.col(id_col).alias("__kept_id")).distinct()
    return docs.join(kept, docs[id_col].eqNullSafe(kept["__kept_id"]), "left_semi")
