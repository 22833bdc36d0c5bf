"""Feature preparation, probes, nested metrics, file listings and incremental jobs."""

from __future__ import annotations

import uuid
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import features, probe, spread, status
from ..sources import tables
from ..streaming import incremental
from .common import r6, rounded, table


def _customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as patients with missing balances and segments; every fourth is a test row."""
    c = table(spark, sf_dir, "customer")
    n = F.col("c_custkey")
    return c.select(
        n.alias("patient_id"), F.when(n % 4 == 0, "test").otherwise("train").alias("split"), (n % 3 == 0).cast("int").alias("label"),
        F.when(n % 7 != 0, F.col("c_acctbal")).alias("balance"), F.col("c_nationkey").cast("double").alias("nation"),
        F.when(n % 5 != 0, F.col("c_mktsegment")).alias("segment"), F.lit(None).cast("string").alias("empty"), F.lit(1.0).alias("constant"), F.lit(0).alias("outcome"),
    )


def impute_scale_onehot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The probe's features, fitted on training rows after the column policy, long form."""
    rows = _customers(spark, sf_dir)
    train = rows.where("split = 'train'")
    policy = features.ColumnPolicy(["balance", "nation", "segment", "empty", "constant", "outcome", "absent"], leakage=["outcome"])
    usable = status.usable_columns(train, policy.usable(rows))
    numeric = status.numeric_columns(train, usable)
    return _long_features(rows, features.fit_features(train, numeric, [c for c in usable if c not in numeric]))


def _long_features(rows: DataFrame, schema: features.FeatureSchema) -> DataFrame:
    """One row for each patient and feature, zeros too."""
    dense = features.dense_features(features.encode_features(rows, schema, "patient_id"), schema)
    values = dense.select("patient_id", F.posexplode("features").alias("slot", "value"))
    return values.join(features.feature_names(rows.sparkSession, schema), "slot").select("patient_id", "feature", r6("value").alias("value"))


IMPUTE_SQL = """WITH c AS (SELECT c_custkey AS patient_id, c_custkey % 4 <> 0 AS train, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, c_nationkey::DOUBLE AS nation, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer),
f AS (SELECT median(balance) AS mb, median(nation) AS mn FROM c WHERE train), k AS (SELECT c.*, coalesce(balance, mb) AS b, coalesce(nation, mn) AS n FROM c, f),
s AS (SELECT avg(b) AS ab, stddev_pop(b) AS sb, avg(n) AS an, stddev_pop(n) AS sn FROM k WHERE train),
m AS (SELECT segment AS top FROM c WHERE train AND segment IS NOT NULL GROUP BY segment ORDER BY count(*) DESC, segment LIMIT 1), v AS (SELECT DISTINCT segment AS w FROM c WHERE train AND segment IS NOT NULL)
SELECT patient_id, 'balance' AS feature, round((b - ab) / sb, 6) AS value FROM k, s UNION ALL SELECT patient_id, 'nation', round((n - an) / sn, 6) FROM k, s UNION ALL SELECT patient_id, 'constant', 0.0 FROM k
UNION ALL SELECT patient_id, 'segment=' || w, (coalesce(segment, top) = w)::INT::DOUBLE FROM k, m, v"""


def schema_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The schema variant: mean, sample std, missing as a category; unknown categories become missing."""
    rows = _customers(spark, sf_dir)
    schema = features.fit_features(rows.where("split = 'train' and segment <> 'BUILDING'"), ["balance"], ["segment"], variant="schema")
    return _long_features(rows, schema)


SCHEMA_SQL = """WITH c AS (SELECT c_custkey AS patient_id, CASE WHEN c_custkey % 7 <> 0 THEN c_acctbal END AS balance, CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END AS segment FROM customer),
t AS (SELECT * FROM c WHERE patient_id % 4 <> 0 AND segment <> 'BUILDING'), f AS (SELECT avg(balance) AS mb FROM t), s AS (SELECT avg(coalesce(balance, mb)) AS ab, stddev_samp(coalesce(balance, mb)) AS sb FROM t, f),
v AS (SELECT DISTINCT segment AS w FROM t UNION ALL SELECT '__missing__'), x AS (SELECT patient_id, CASE WHEN segment IN (SELECT w FROM v) THEN segment ELSE '__missing__' END AS g FROM c)
SELECT patient_id, 'balance' AS feature, round((coalesce(balance, mb) - ab) / sb, 6) AS value FROM c, f, s UNION ALL SELECT patient_id, 'segment=' || w, (g = w)::INT::DOUBLE FROM x, v"""


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = features.balanced_weights(_customers(spark, sf_dir).select("patient_id", "label"))
    return rounded(rows, "weight")


WEIGHTS_SQL = """WITH c AS (SELECT c_custkey AS patient_id, (c_custkey % 3 = 0)::INT AS label FROM customer)
SELECT patient_id, label, round(count(*) OVER () / (2 * count(*) OVER (PARTITION BY label)), 6) AS weight FROM c"""


def metrics_json_flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events' properties in the shape of run metrics, parsed and flattened; some lack an object."""
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("int")
    nested = F.to_json(F.struct((k / 100).alias("best_c"), F.struct(k.alias("train"), (k + 1).alias("test")).alias("split_counts"), F.when(k % 3 != 0, F.struct((k / 8).alias("roc_auc"), k.cast("double").alias("tp"))).alias("official_test_metrics_selected_threshold")))
    parsed = e.select("event_id", F.from_json(nested, tables.METRICS_SCHEMA).alias("m")).select("event_id", "m.*")
    return tables.flatten_metrics(parsed).select("event_id", r6("best_c").alias("best_c"), "n_train", "n_test", "test_roc_auc", "test_tp")


JSON_SQL = """WITH e AS (SELECT event_id, json_extract(props, '$.k')::INT AS k FROM events)
SELECT event_id, round(k / 100, 6) AS best_c, k::BIGINT AS n_train, (k + 1)::BIGINT AS n_test, CASE WHEN k % 3 <> 0 THEN k / 8 END AS test_roc_auc, CASE WHEN k % 3 <> 0 THEN k::DOUBLE END AS test_tp FROM e"""


def _probe_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    manifest = e.select(F.col("vec_id").alias("patient_id"), (F.col("label") >= 5).cast("int").alias("label"), F.when(F.col("vec_id") % 5 == 0, "test").otherwise("train").alias("split"), F.concat(F.lit("site"), (F.col("vec_id") % 3).cast("string")).alias("dataset"))
    rows = probe.join_embeddings(manifest, e.select(F.col("vec_id").alias("patient_id"), F.col("embedding").cast("array<double>").alias("embedding")))
    return probe.scale_vectors(rows.where("split = 'train'"), rows).drop("embedding")


def probe_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored test rows of a probe on the embeddings, C from the whole grid."""
    return probe.run_probe(_probe_rows(spark, sf_dir))[0]


def leave_one_cohort_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    return probe.leave_one_cohort_out(_probe_rows(spark, sf_dir), ["site0", "site1", "site2"])


TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every table; each is counted where it is read."""
    return reduce(DataFrame.unionByName, [table(spark, sf_dir, n).agg(F.count(F.lit(1)).alias("rows")).select(F.lit(n).alias("table"), "rows") for n in TABLES])


ROW_COUNTS_SQL = " UNION ALL ".join(f"SELECT '{n}' AS \"table\", count(*) AS \"rows\" FROM {n}" for n in TABLES)


def scan_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files, bytes and rows of every table."""
    rows = [table(spark, sf_dir, n).select(F.lit(n).alias("table"), F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_size").alias("length")) for n in TABLES]
    files = reduce(DataFrame.unionByName, rows).groupBy("table", "path").agg(F.max("length").alias("length"), F.count(F.lit(1)).alias("rows"))
    return files.groupBy("table").agg(F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"), F.sum("rows").alias("rows"))


def resume_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events through a stream that appends what is new, started twice; and the job's accounts."""
    out = f"{spread.shared_dir(spark)}/resume-{uuid.uuid4().hex}"
    events = table(spark, sf_dir, "events")
    for _ in range(2):
        stream = spark.readStream.schema(events.schema).parquet(f"{sf_dir}/events.parquet*")
        incremental.process_new(stream.select("event_id", "user_id", "value"), lambda df: df.withColumn("error", F.when(F.col("event_id") % 100 == 0, "odd")), f"{out}/done", f"{out}/checkpoint", ["event_id"])
    done = spark.read.schema(T.StructType.fromDDL("event_id long, user_id long, value double, error string")).parquet(f"{out}/done")
    return incremental.job_accounting(events.select("event_id"), done, "event_id")


def corrections_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The orders' daily report, corrected by two streams with a compaction between them; the later one holds."""
    report = incremental.CorrectedTable(spark, f"{spread.shared_dir(spark)}/report-{uuid.uuid4().hex}")
    orders = table(spark, sf_dir, "orders")
    keyed = lambda df: df.select(F.col("o_custkey").alias("patient_id"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("exam_date"), "o_orderkey", "o_totalprice")
    report.create(keyed(orders).groupBy("patient_id", "exam_date").agg(F.count(F.lit(1)).alias("rows"), F.sum("o_totalprice").alias("total"), F.lit("first").alias("note")))
    stream = keyed(spark.readStream.schema(orders.schema).parquet(f"{sf_dir}/orders.parquet*"))
    fix = lambda every, note: stream.where(F.col("o_orderkey") % every == 0).select("patient_id", "exam_date", F.lit(1).cast("long").alias("rows"), F.col("o_totalprice").alias("total"), F.lit(note).alias("note"))
    report.append_stream(fix(3, "second"), f"{report.root}/checkpoint-a", first=1)
    report.compact()
    report.append_stream(fix(5, "third"), f"{report.root}/checkpoint-b", first=1_000_000)
    return report.read().select("patient_id", "exam_date", "rows", F.round("total", 2).alias("total"), "note")


CORRECTIONS_SQL = """WITH o AS (SELECT o_custkey AS patient_id, strftime(o_orderdate, '%Y-%m-%d') AS exam_date, o_orderkey, o_totalprice FROM orders),
b AS (SELECT patient_id, exam_date, count(*) AS "rows", sum(o_totalprice) AS total FROM o GROUP BY ALL),
s AS (SELECT * FROM o WHERE o_orderkey % 3 = 0), t AS (SELECT * FROM o WHERE o_orderkey % 5 = 0)
SELECT patient_id, exam_date, 1::BIGINT AS "rows", round(o_totalprice, 2) AS total, 'third' AS note FROM t
UNION ALL SELECT patient_id, exam_date, 1, round(o_totalprice, 2), 'second' FROM s WHERE (patient_id, exam_date) NOT IN (SELECT (patient_id, exam_date) FROM t)
UNION ALL SELECT patient_id, exam_date, "rows", round(total, 2), 'first' FROM b WHERE (patient_id, exam_date) NOT IN (SELECT (patient_id, exam_date) FROM t UNION ALL SELECT (patient_id, exam_date) FROM s)"""


QUERIES = {
    "impute_scale_onehot": impute_scale_onehot, "schema_features": schema_features, "class_weights": class_weights, "metrics_json_flatten": metrics_json_flatten,
    "probe_fit": probe_fit, "leave_one_cohort_out": leave_one_cohort_out, "scan_files": scan_files, "resume_incremental": resume_incremental, "corrections_merged": corrections_merged, "table_row_counts": table_row_counts,
}
ORACLE_SQL = {
    "impute_scale_onehot": IMPUTE_SQL, "schema_features": SCHEMA_SQL, "class_weights": WEIGHTS_SQL, "metrics_json_flatten": JSON_SQL,
    "corrections_merged": CORRECTIONS_SQL, "table_row_counts": ROW_COUNTS_SQL,
    "resume_incremental": "SELECT count(DISTINCT event_id) AS requested, count(DISTINCT event_id) FILTER (event_id % 100 <> 0) AS done, count(DISTINCT event_id) FILTER (event_id % 100 = 0) AS failed, 0::BIGINT AS missing FROM events",
}
