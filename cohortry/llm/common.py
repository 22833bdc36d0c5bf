"""What the operators share: shared-storage tables, null-safe keys, and bounded fan-out."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Spark's own removal of a query's shuffle files at its end.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: A key with over this part of all rows is heavy, so fewer than ``1 / HEAVY_PART`` keys can be.
HEAVY_PART = 1 / 1024
#: Rows of one key that are too few to spread, whatever their part.
HEAVY_ROWS = 256
#: Tasks over which a heavy key is spread.
COPIES = 32


def shared_dir(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``. Where it is unset, a local session (tests) gets
    a new folder of its machine; a cluster gets an error, as its executors would not see each other's files."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if path is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = _local.setdefault(spark.sparkContext.applicationId, None) or "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        _local[spark.sparkContext.applicationId] = path
    return path.rstrip("/")


_local: dict[str, str | None] = {}


def saved(df: DataFrame, **options: str) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back: cuts lineage and outlives executors.

    The write's shuffle files go when it has ended: from then on the table stands for them.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/table-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.options(**options).parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table.shared_path = path
    return table


def bucketed(rows: DataFrame, key: str) -> DataFrame:
    """One of the rows of each ``key``, written like ``saved`` but in buckets by ``key``: joins on ``key`` do not shuffle the table again."""
    spark = rows.sparkSession
    name = f"table_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    before = spark.conf.get(CLEANUP)
    spark.conf.set(CLEANUP, "true")
    try:
        once = rows.repartition(parts, key).dropDuplicates([key])
        once.write.format("parquet").bucketBy(parts, key).sortBy(key).option("path", path).saveAsTable(name)
    finally:
        spark.conf.set(CLEANUP, before)
    table = spark.table(name)
    table.shared_path, table.table_name = path, name
    return table


def discard(*tables: DataFrame) -> None:
    """Delete tables made by ``saved`` or ``bucketed`` that nothing needs any more: all that reads them has been written."""
    for table in tables:
        if hasattr(table, "table_name"):
            table.sparkSession.sql(f"DROP TABLE IF EXISTS {table.table_name}")
        jvm, conf = table.sparkSession._jvm, table.sparkSession._jsc.hadoopConfiguration()
        path = jvm.org.apache.hadoop.fs.Path(table.shared_path)
        path.getFileSystem(conf).delete(path, True)


#: Bytes of an Arrow batch on its way to or from a Python worker, and rows of a batch that is read from Parquet.
BATCH_BYTES, READ_ROWS = 4 << 20, 512


def small_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by their bytes and those read from Parquet by their rows, for this session from now on: a batch of 10,000 or 4,096
    long texts is held by the executor, that of Arrow by each of its workers too, and stages with several Python steps hold several."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    spark.conf.set("spark.sql.parquet.columnarReaderBatchSize", str(READ_ROWS))


def text_of(column: str | Column = "text") -> Column:
    """The text, with null read as the empty text."""
    return F.coalesce(F.col(column) if isinstance(column, str) else column, F.lit(""))


def same(left: DataFrame, right: DataFrame, *columns: str) -> Column:
    """Null-safe equality of the named columns of two frames."""
    condition = left[columns[0]].eqNullSafe(right[columns[0]])
    for name in columns[1:]:
        condition &= left[name].eqNullSafe(right[name])
    return condition


def heavy_keys(groups: DataFrame, keys: list[str], size: str) -> DataFrame | None:
    """Keys of ``groups`` (one row a key; a saved table, or a small one) that hold over ``HEAVY_PART`` of all rows, as ``size`` counts
    them. Their number is below ``1 / HEAVY_PART`` by this definition. None if there are none."""
    total, largest = groups.agg(F.sum(size), F.max(size)).first()
    least = max((total or 0) * HEAVY_PART, HEAVY_ROWS)
    if (largest or 0) <= least:
        return None
    found = groups.where(F.col(size) > least).select(*keys).collect()
    types = {f.name: f.dataType for f in groups.select(*keys).schema}
    rows = F.array(*[F.struct(*[F.lit(r[k]).cast(types[k]).alias(k) for k in keys], F.lit(True).alias("__heavy")) for r in found])
    return groups.sparkSession.range(0, 1, 1, 1).select(F.inline(rows))


def spread_join(rows: DataFrame, groups: DataFrame, keys: list[str], heavy: DataFrame | None, by: list[str]) -> DataFrame:
    """Inner join on ``keys`` (no nulls) where a key may hold a large part of ``rows``.

    Rows of ``heavy`` keys are spread over ``COPIES`` tasks by a hash of ``by``, and the rows of ``groups`` that they
    meet are copied as often. All other keys are joined as they are.
    """
    if heavy is None:
        return rows.join(groups, keys)
    marks = F.broadcast(heavy)
    left = rows.join(marks, keys, "left").withColumn("__salt", F.when(F.col("__heavy"), F.pmod(F.xxhash64(*by), F.lit(COPIES)).cast("int")).otherwise(0)).drop("__heavy")
    salts = F.when(F.col("__heavy"), F.sequence(F.lit(0), F.lit(COPIES - 1))).otherwise(F.array(F.lit(0)))
    right = groups.join(marks, keys, "left").withColumn("__salt", F.explode(salts)).drop("__heavy")
    return left.join(right, [*keys, "__salt"]).drop("__salt")


#: Bits of a filter for each of its keys, bits of one row of it, and most rows (8 MB).
FILTER_BITS, FILTER_ROW, FILTER_ROWS = 16, 4096, 16384


def possible(rows: DataFrame, wanted: DataFrame, keys: list[str], size: int, name: str = "possible") -> DataFrame:
    """``rows`` with a boolean ``name``, false where their ``keys`` are surely not among the ``size`` rows of ``wanted``.

    Each key of ``wanted`` sets one bit by its hash, and the bits, 8 MB at most, are broadcast. Of other rows about one in ``FILTER_BITS``
    passes too (more, once the bits are at their most), so a join on ``keys`` follows; but what need not move does not.
    """
    parts = 1
    while parts < FILTER_ROWS and parts * FILTER_ROW < size * FILTER_BITS:
        parts *= 2
    slot = F.pmod(F.xxhash64(*keys), F.lit(parts * FILTER_ROW))
    part, word, bit = (slot / FILTER_ROW).cast("long"), (F.pmod(slot, F.lit(FILTER_ROW)) / 64).cast("int"), F.pmod(slot, F.lit(64)).cast("int")
    words = wanted.groupBy(part.alias("__part"), word.alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), bit)).alias("bits"))
    held = words.groupBy("__part").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("m"))
    held = held.select("__part", F.transform(F.sequence(F.lit(0), F.lit(FILTER_ROW // 64 - 1)), lambda k: F.coalesce(F.col("m")[k], F.lit(0).cast("long"))).alias("__bits"))
    placed = rows.withColumns({"__part": part, "__word": word, "__bit": bit}).join(F.broadcast(held), "__part", "left")
    hit = F.getbit(F.col("__bits")[F.col("__word")], F.col("__bit")) == 1
    return placed.withColumn(name, F.coalesce(hit, F.lit(False))).drop("__part", "__word", "__bit", "__bits")


def numbered(distinct: DataFrame, *order: str, name: str = "name") -> DataFrame:
    """Integer names for distinct rows, in the order of ``order``: a range sort, then a number for each place.

    The table is written before its names are used, so a lost executor cannot rename anything.
    """
    ordered = distinct.repartitionByRange(*order).sortWithinPartitions(*order)
    return saved(ordered.withColumn(name, F.monotonically_increasing_id()))


_held: dict[str, Any] = {}


def remembered(name: str, make: Callable[[], Any]) -> Any:
    """What one operator keeps in a Python worker from task to task. Another operator's is dropped first: workers are
    used again by later stages, and their memories must not add up."""
    if name not in _held:
        _held.clear()
        _held[name] = make()
    return _held[name]
