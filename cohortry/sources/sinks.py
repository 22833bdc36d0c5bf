"""Writing manifests, summaries and public copies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat(df: DataFrame, mark: str = ";") -> DataFrame:
    """Arrays as delimited text, for text formats only."""
    listed = {f.name: F.array_join(F.col(f.name).cast("array<string>"), mark) for f in df.schema if isinstance(f.dataType, T.ArrayType)}
    return df.withColumns(listed) if listed else df


def write_table(df: DataFrame, path: str, partition_by: str | None = None, fmt: str = "parquet") -> None:
    """Parquet (partitioned if asked), or CSV with a header and delimited lists."""
    out = (flat(df) if fmt == "csv" else df).write.mode("overwrite")
    out = out.partitionBy(partition_by) if partition_by else out
    out.csv(path, header=True) if fmt == "csv" else out.parquet(path)


def write_summary(counts: DataFrame, path: str) -> None:
    """Tidy counts (section, key, n) as JSON lines."""
    counts.write.mode("overwrite").json(path)


def write_summary_object(counts: DataFrame, path: str) -> None:
    """Tidy counts (section, key, n) as one JSON object ``{"section": {"key": n}}`` in one file; sections and keys in order.

    As many numbers as there are counts; a repeated key is their sum, null names are ``missing``.
    """
    name = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("missing"))
    sums = counts.groupBy(name("section").alias("section"), name("key").alias("key")).agg(F.sum("n").alias("n"))
    keys = sums.groupBy("section").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("key", "n")))).alias("counts"))
    by_name = lambda a, b: F.when(a["section"] < b["section"], -1).when(a["section"] > b["section"], 1).otherwise(0)
    whole = keys.groupBy().agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("section", "counts")), by_name)).alias("all"))
    whole.select(F.to_json("all").alias("value")).coalesce(1).write.mode("overwrite").text(path)
