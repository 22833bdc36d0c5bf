"""Every registered query with SQL against DuckDB on the smallest tables."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from cohortry.plans import catalog
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(catalog.QUERIES[name](spark, SF), catalog.ORACLE_SQL[name], con)


def test_entry_has_a_stable_schema(spark):
    found = entry.entry(spark)
    assert found.columns == ["run_name", "metric", "delta", "low", "high", "share_above"] and found.count() > 0


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL) - {"probe_fit", "leave_one_cohort_out"}))
def test_query_without_sql_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_bootstrap_draws_as_often_as_the_reference(spark):
    weights = catalog.QUERIES["bootstrap_weights"](spark, SF).groupBy("replicate").agg(F.sum("weight").alias("n"))
    subjects = spark.read.parquet(f"{SF}/labels.parquet").where("quality is not null").count()
    assert weights.count() == 5000 and weights.where(F.col("n") != subjects).count() == 0
