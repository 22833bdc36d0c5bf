"""Jobs that go on where they stopped: new items once, and corrections where the last batch wins.

What has been done is a keyed state of the stream, not a table that is read again: a batch costs what it brings. Corrections are a
log that is appended to and merged when it is read; compaction rewrites the buckets that the log touches, no others.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.manifests import replace_rows


def not_done(items: DataFrame, done: DataFrame | None, keys: list[str]) -> DataFrame:
    """Items whose key the finished table lacks."""
    return items if done is None else items.join(done.select(*keys).distinct(), keys, "left_anti")


def job_accounting(requested: DataFrame, results: DataFrame, key: str) -> DataFrame:
    """One row: requested, done, failed, missing; ``results`` has ``key`` and ``error`` (null where it went well)."""
    joined = requested.select(key).distinct().join(results.select(key, "error").withColumn("there", F.lit(True)), key, "left")
    return joined.agg(
        F.count(F.lit(1)).alias("requested"), F.count_if(F.col("there") & F.col("error").isNull()).alias("done"),
        F.count_if(F.col("error").isNotNull()).alias("failed"), F.count_if(F.col("there").isNull()).alias("missing"),
    )


def _read_if_any(spark: SparkSession, path: str) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:  # noqa: BLE001  told apart by its error class
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER_SCHEMA" in str(e):
            return None
        raise


#: State on local disk with incremental checkpoints, instead of in the heap.
STATE_STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


@contextmanager
def _settings(spark: SparkSession, settings: dict[str, str]) -> Iterator[None]:
    before = {k: spark.conf.get(k, None) for k in settings}
    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class _Folder:
    """Markers and listings in the store that a path belongs to, by Hadoop's file system: wherever Spark can write."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path.rstrip("/")
        self.fs = self.jvm.org.apache.hadoop.fs.Path(path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def has(self, name: str = "") -> bool:
        return self.fs.exists(self._at(name))

    def mark(self, name: str) -> None:
        self.fs.create(self._at(name), True).close()

    def names(self, pattern: str) -> list[str]:
        """Paths below the folder that fit the pattern."""
        found = self.fs.globStatus(self._at(pattern)) or []
        return sorted(x.getPath().toString().split(self._at("").toUri().getPath().rstrip("/") + "/", 1)[1] for x in found)

    def delete(self, name: str) -> None:
        self.fs.delete(self._at(name), True)


def process_new(stream: DataFrame, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, keys: list[str]) -> None:
    """Run ``work`` over items whose key was not seen before, append, and stop; of rows with one key in a batch one is taken.

    The keys seen are the stream's state (``checkpoint`` holds it, on disk by bucket of the key), so the cost of a batch does not grow with
    what was done before. Two things are left to look up: keys that ``out`` had before the job ever ran, which are saved once beside the checkpoint, and
    ``out`` itself where a batch is tried a second time after a failure, as its rows may be there already.
    """
    spark = stream.sparkSession
    notes = _Folder(spark, f"{checkpoint.rstrip('/')}-notes")
    if not _Folder(spark, checkpoint).has():
        done = _read_if_any(spark, out)
        notes.delete("")
        if done is not None:
            done.select(*keys).distinct().write.parquet(f"{notes.path}/before")
    seed = spark.read.parquet(f"{notes.path}/before") if notes.has("before/_SUCCESS") else None

    def batch(df: DataFrame, number: int) -> None:
        fresh = not_done(df, seed, keys)
        if notes.has(f"tried-{number}"):
            fresh = not_done(fresh, _read_if_any(df.sparkSession, out), keys)
        notes.mark(f"tried-{number}")
        work(fresh).write.mode("append").parquet(out)

    with _settings(spark, STATE_STORE):
        query = stream.dropDuplicates(keys).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()


class CorrectedTable:
    """A table of keyed rows with a log of corrections: all rows of a key are replaced by those of the last batch that has it.

    ``base/bucket=b/gen=g`` holds the rows of bucket ``b`` (a hash of the key) as of batch ``g`` of the log, ``log/batch=n`` what batch ``n`` brought.
    A batch appends itself and reads nothing. ``read`` takes each bucket's last generation and merges the batches behind it. ``compact``
    writes the buckets that those batches touch anew, then a marker that makes them count; until then readers see the old ones, so
    a compaction or a batch that fails half-way is simply run again. Batches are numbered from 1, in the order in which they hold.

    Null keys match nothing: corrections with one are added, never replaced. A batch with columns that the table lacks adds them, null before.
    """

    def __init__(self, spark: SparkSession, root: str, keys: tuple[str, ...] = ("patient_id", "exam_date"), buckets: int = 64):
        self.spark, self.root, self.keys, self.buckets, self.folder = spark, root.rstrip("/"), list(keys), buckets, _Folder(spark, root)

    def _bucketed(self, df: DataFrame) -> DataFrame:
        return df.withColumn("bucket", F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in self.keys]), F.lit(self.buckets)).cast("int"))

    def create(self, rows: DataFrame) -> None:
        """The first generation. Replaces what the root may hold of a creation that failed; a finished one stays as it is."""
        if self.folder.has("commits/0"):
            return
        self._bucketed(rows).withColumn("gen", F.lit(0).cast("long")).repartition("bucket").write.mode("overwrite").partitionBy("bucket", "gen").parquet(f"{self.root}/base")
        self.folder.mark("commits/0")

    def append(self, corrections: DataFrame, number: int) -> None:
        """Batch ``number`` of the log, as often as it is tried."""
        self._bucketed(corrections).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{self.root}/log/batch={number}")

    def append_stream(self, stream: DataFrame, checkpoint: str, first: int = 1) -> None:
        """Every batch of a stream, numbered from ``first`` on; stops when nothing is left."""
        query = stream.writeStream.foreachBatch(lambda df, n: self.append(df, first + n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
        query.awaitTermination()

    def _now(self) -> int:
        return max(int(x.rsplit("/", 1)[1]) for x in self.folder.names("commits/*"))

    def _log(self, after: int) -> tuple[list[int], DataFrame | None]:
        """Numbers and rows of the batches behind ``after``; a batch counts once its write has ended."""
        numbers = sorted(int(x.split("batch=")[1].split("/")[0]) for x in self.folder.names("log/batch=*/_SUCCESS"))
        numbers = [n for n in numbers if n > after]
        if not numbers:
            return [], None
        rows = self.spark.read.option("basePath", f"{self.root}/log").option("mergeSchema", "true").parquet(*[f"{self.root}/log/batch={n}" for n in numbers])
        return numbers, rows.withColumn("batch", F.col("batch").cast("long"))

    def _base(self, now: int, only: list[int] | None = None) -> DataFrame | None:
        """Each bucket's last generation that counts; of the buckets ``only`` if given. One listing of at most buckets x generations names."""
        last: dict[int, int] = {}
        for x in self.folder.names("base/bucket=*/gen=*"):
            b, g = (int(part.split("=")[1]) for part in x.split("/")[1:3])
            if g <= now:
                last[b] = max(g, last.get(b, 0))
        paths = [f"{self.root}/base/bucket={b}/gen={g}" for b, g in sorted(last.items()) if only is None or b in only]
        return self.spark.read.option("basePath", f"{self.root}/base").option("mergeSchema", "true").parquet(*paths).drop("gen") if paths else None

    def _merged(self, base: DataFrame | None, log: DataFrame) -> DataFrame:
        latest = log.groupBy(*self.keys).agg(F.max("batch").alias("__latest"))
        unkeyed = F.lit(False)
        for k in self.keys:
            unkeyed |= log[k].isNull()
        known = log.where(~unkeyed).join(latest, [log[k] == latest[k] for k in self.keys] + [F.col("batch") == F.col("__latest")], "left_semi")
        new = known.unionByName(log.where(unkeyed)).drop("batch")
        return new if base is None else replace_rows(base, new, tuple(self.keys))

    def read(self) -> DataFrame:
        """The table as of now."""
        now = self._now()
        _, log = self._log(now)
        base = self._base(now)
        if log is None:
            return (base if base is not None else self.spark.read.parquet(f"{self.root}/base")).drop("bucket", "gen")
        return self._merged(base, log).drop("bucket")

    def compact(self) -> int:
        """Merge the log into the buckets that it touches; the number of buckets written."""
        now = self._now()
        numbers, log = self._log(now)
        if log is None:
            return 0
        touched = [r["bucket"] for r in log.select("bucket").distinct().collect()]  # at most ``buckets`` numbers
        merged = self._merged(self._base(now, touched), log)
        for b in touched:
            self.folder.delete(f"base/bucket={b}/gen={numbers[-1]}")  # of a compaction that failed
        merged.withColumn("gen", F.lit(numbers[-1]).cast("long")).repartition("bucket").write.mode("append").partitionBy("bucket", "gen").parquet(f"{self.root}/base")
        self.folder.mark(f"commits/{numbers[-1]}")
        return len(touched)

    def vacuum(self) -> None:
        """Delete generations, batches and markers that no new reader needs."""
        now, last = self._now(), {}
        names = self.folder.names("base/bucket=*/gen=*")
        for x in names:
            b, g = (int(part.split("=")[1]) for part in x.split("/")[1:3])
            if g <= now:
                last[b] = max(g, last.get(b, 0))
        for x in names:
            b, g = (int(part.split("=")[1]) for part in x.split("/")[1:3])
            if g < last.get(b, 0):
                self.folder.delete(x)
        for x in self.folder.names("log/batch=*"):
            if int(x.split("batch=")[1]) <= now:
                self.folder.delete(x)
        for x in self.folder.names("commits/*"):
            if int(x.rsplit("/", 1)[1]) < now:
                self.folder.delete(x)
