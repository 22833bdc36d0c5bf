"""Boilerplate lines by their frequency within a site, in DataFrame operations.

A site's pages that hold a line, divided by the site's pages, is the line's ratio. Lines at or above a ratio
are dropped from the pages of that site only. Counting moves 16-byte line digests, never texts; a text that may
lose lines moves once, to meet its own list of dropped digests.

Copies of one text are not evidence of boilerplate. Where groups of copies are known, ``page_col`` names the group
of a row, and all rows of a group count as one page of their site, in the pages with a line and in all pages.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import heavy_keys, possible, saved, spread_join, text_of


def _digest(line: Column) -> Column:
    return F.unhex(F.md5(line.cast("binary")))


def _counted(line: Column) -> Column:
    """Blank lines are layout: never counted, never dropped."""
    return F.trim(line) != ""


def _key(host: str) -> Column:
    """A host as a key without null."""
    return F.concat(F.when(F.col(host).isNull(), "-").otherwise("="), F.coalesce(F.col(host).cast("string"), F.lit("")))


def _with_pages(rows: DataFrame, pages: DataFrame) -> DataFrame:
    named = pages.select(F.col("id").alias("__page_id"), "page")
    return rows.join(named, rows["id"].eqNullSafe(named["__page_id"]), "left").drop("__page_id")


def line_ratios(
    docs: DataFrame, host_col: str = "source", text_col: str = "text", page_col: str | None = None, pages: DataFrame | None = None, id_col: str = "doc_id"
) -> DataFrame:
    """``host``, ``digest`` (16 bytes), ``pages`` and ``rows`` (with the line), ``host_pages``, ``ratio`` for every line of every host.

    A page counts once for a line however often it repeats it. Null hosts form one host; null text has no lines.
    Without ``page_col`` each row is a page; with it, the rows of a host with one value (null is a value) are. ``pages`` (``id``, ``page``,
    one row an id) stands for such a column: digests meet it, texts do not move.
    """
    page = [] if page_col is None else [F.col(page_col).alias("page")]
    digests = F.array_distinct(F.transform(F.filter(F.split(text_of(text_col), "\n"), _counted), _digest))
    of_host = docs.select(F.col(host_col).alias("total_host"), *page)
    if pages is None:
        lines = docs.select(F.col(host_col).alias("host"), *page, F.explode(digests).alias("digest"))
    else:
        page = ["page"]
        held = _with_pages(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), digests.alias("digests")), pages)
        # outer, so that no filter makes the digests once more
        lines = held.select("host", "page", F.explode_outer("digests").alias("digest")).where("digest is not null")
        of_host = _with_pages(docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("total_host")), pages).drop("id")
    rows = F.count(F.lit(1)).alias("rows")
    if page:
        of_host = of_host.distinct()
        lines = lines.groupBy("host", lines.columns[1], "digest").agg(rows)
        rows = F.sum("rows").alias("rows")
    counts = lines.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("pages"), rows)
    totals = of_host.groupBy("total_host").agg(F.count(F.lit(1)).alias("host_pages"))
    return counts.join(totals, counts["host"].eqNullSafe(totals["total_host"])).select(
        "host", "digest", "pages", "rows", "host_pages", (F.col("pages") / F.col("host_pages")).alias("ratio")
    )


def drop_boilerplate_lines(
    docs: DataFrame,
    id_col: str = "doc_id",
    host_col: str = "source",
    text_col: str = "text",
    ratio: float = 0.005,
    min_pages: int = 5,
    page_col: str | None = None,
    pages: DataFrame | None = None,
) -> DataFrame:
    """``docs`` with its columns and rows, boilerplate lines cut from ``text_col``; adds ``n_lines``, ``n_dropped``.

    A line is boilerplate on its host if at least ``min_pages`` pages hold it and pages / host pages >= ``ratio``.
    ``min_pages`` keeps small hosts whole: on a host of one page every line has ratio 1.

    * Null or empty text: kept as it is, ``n_lines`` 0. Blank lines stay. Lines compare without change.
    * Null hosts form one host. An empty table gives no rows.
    * Repeated rows are pages of their own, unless ``page_col`` or ``pages`` puts them into one page (see ``line_ratios``).
    * A clashing column named ``n_lines`` or ``n_dropped`` in ``docs`` is replaced.
    """
    often = saved(line_ratios(docs, host_col, text_col, page_col, pages, id_col).where((F.col("pages") >= min_pages) & (F.col("ratio") >= ratio)).select(_key("host").alias("key"), "digest", "rows"))
    base = docs.select(F.col(id_col).alias("id"), F.col(host_col).alias("host"), text_of(text_col).alias("text"))
    lines = base.select(
        "id", "host", _key("host").alias("key"), F.xxhash64("text").alias("text_key"),
        F.explode(F.array_distinct(F.transform(F.filter(F.split("text", "\n"), _counted), _digest))).alias("digest"),
    )
    # a menu line on every page of a large host is one key
    hits = spread_join(lines, often.select("key", "digest"), ["key", "digest"], heavy_keys(often, ["key", "digest"], "rows"), ["id", "text_key"])
    drops = saved(hits.groupBy("id", "host", "text_key").agg(F.collect_set("digest").alias("dropped")))
    own = [c for c in docs.columns if c not in ("n_lines", "n_dropped")]
    rows = docs.select(F.struct(*[docs[c] for c in own]).alias("row"))
    of = lambda c: F.col("row")[c]
    text = text_of(of(text_col))
    # texts that surely lose no line stay where they are; a merge, as lists of digests are small as files and large as rows
    marked = possible(rows.withColumn("__text_key", F.xxhash64(text)), drops.select(F.col("text_key").alias("__text_key")), ["__text_key"], drops.count())
    joined = marked.where("possible").join(drops.hint("merge"), of(id_col).eqNullSafe(drops["id"]) & of(host_col).eqNullSafe(drops["host"]) & (F.col("__text_key") == drops["text_key"]), "left")
    whole = marked.where("not possible").select("row", F.lit(None).cast(drops.schema["dropped"].dataType).alias("dropped"))
    joined = joined.select("row", "dropped").unionByName(whole)
    split = F.split(text, "\n")
    kept = F.filter(split, lambda x: ~_counted(x) | ~F.array_contains(F.col("dropped"), _digest(x)))
    n_lines = F.when(text == "", 0).otherwise(F.size(split))
    cut = F.when(F.col("dropped").isNull(), of(text_col)).otherwise(F.array_join(kept, "\n"))
    n_kept = F.when(F.col("dropped").isNull(), n_lines).otherwise(F.size(kept))
    done = joined.select("row", cut.alias("cut"), n_lines.cast("long").alias("n_lines"), (n_lines - n_kept).cast("long").alias("n_dropped"))
    return done.select(*[(F.col("cut") if c == text_col else of(c)).alias(c) for c in own], "n_lines", "n_dropped")
