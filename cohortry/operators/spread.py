"""Joins on keys that may hold a large part of all rows, and tables between steps that outlive executors."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Spark's own removal of a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with over this part of all rows is heavy, so fewer than ``1 / HEAVY_PART`` keys can be.
HEAVY_PART = 1 / 1024
#: Rows of one key that are too few to spread, whatever their part.
HEAVY_ROWS = 4096
#: Tasks over which a heavy key is spread.
COPIES = 32
#: Rows of one task where a step sorts or holds what it is given.
TASK_ROWS = 1 << 18


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets
    a new folder of its machine; a cluster gets an error, as its executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local.setdefault(spark.sparkContext.applicationId, "file://" + tempfile.mkdtemp(prefix="spark-shared-"))
    return path.rstrip("/")


_local: dict[str, str] = {}


def saved(df: DataFrame) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and outlives executors.

    The write's shuffle files go when it has ended: from then on the table stands for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` that nothing needs any more: all that reads them has been written."""
    for table in tables:
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(conf).delete(path, True)


def literal_rows(spark: SparkSession, names: list[str], kinds: list, rows: list[tuple]) -> DataFrame:
    """Few rows as literals of the plan: no file, no Python worker."""
    each = [F.struct(*[F.lit(v).cast(t).alias(n) for n, t, v in zip(names, kinds, row, strict=True)]) for row in rows]
    return spark.range(0, 1, 1, 1).select(F.inline(F.array(*each)))


def heavy_keys(counts: DataFrame, keys: list[str], size: str, part: float = HEAVY_PART, least: int | None = None) -> DataFrame | None:
    """Keys of ``counts`` (one row a key; a saved table, or a small one) that hold over ``part`` of all rows, as ``size`` counts
    them; keys of at most ``least`` rows (``HEAVY_ROWS``) are not. Their number is below ``1 / part`` by this definition. None if there are none."""
    total, largest = counts.agg(F.sum(size), F.max(size)).first()
    bound = max((total or 0) * part, HEAVY_ROWS if least is None else least)
    if (largest or 0) <= bound:
        return None
    found = counts.where(F.col(size) > bound).select(*keys)
    return literal_rows(counts.sparkSession, [*keys, "__heavy"], [*(f.dataType for f in found.schema), "boolean"], [(*r, True) for r in found.collect()])


def dealt_by(rows: DataFrame, keys: list[str], size: int) -> DataFrame:
    """``rows`` dealt by ``keys`` into parts of about ``TASK_ROWS`` of the ``size`` rows that a step makes of them, so that what a task holds does
    not grow with the table. Later joins, windows and groups by these keys need no other shuffle."""
    parts = max(rows.sparkSession.sparkContext.defaultParallelism, -(-size // TASK_ROWS))
    return rows.repartition(parts, *keys)


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    out = None
    for k in keys:
        one = left[k].eqNullSafe(right[f"__key_{k}"])
        out = one if out is None else out & one
    return out


def spread_join(rows: DataFrame, others: DataFrame, keys: list[str], heavy: DataFrame | None, by: list[str], how: str = "inner", copies: int = COPIES, size: int | None = None) -> DataFrame:
    """``rows`` joined with ``others`` on ``keys`` (``inner`` or ``left``; nulls match nothing) where a key may hold a large part of ``rows``.

    Rows of ``heavy`` keys are spread over ``copies`` tasks by a hash of ``by``, and the rows of ``others`` that they
    meet are copied as often. All other keys are joined as they are. With ``size`` (of ``rows``) both sides are ``dealt_by`` the keys.
    """
    dealt = (lambda df, by: df) if size is None else (lambda df, by: dealt_by(df, by, size))
    if heavy is None:
        return dealt(rows, keys).join(dealt(others, keys), keys, how)
    named = heavy.select(*[F.col(k).alias(f"__key_{k}") for k in keys], "__heavy")
    marks = F.broadcast(named)
    left = rows.join(marks, _matched(rows, named, keys), "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*by), F.lit(copies)).cast("int")).otherwise(0))
    salts = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(copies - 1))).otherwise(F.array(F.lit(0)))
    right = others.join(marks, _matched(others, named, keys), "left").withColumn("__salt", F.explode(salts))
    drop = ["__heavy", *(f"__key_{k}" for k in keys)]
    salted = [*keys, "__salt"]
    return dealt(left.drop(*drop), salted).join(dealt(right.drop(*drop), salted), salted, how).drop("__salt")


def counted_join(rows: DataFrame, others: DataFrame, keys: list[str], by: list[str], how: str = "inner", size: int | None = None) -> DataFrame:
    """``spread_join`` with the heavy keys of ``rows`` found by counting them (map-side combined; one row a key is saved)."""
    counts = saved(rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("__size")))
    heavy = heavy_keys(counts, keys, "__size")
    discard(counts)
    return spread_join(rows, others, keys, heavy, by, how, size=size)
