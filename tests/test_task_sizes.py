"""What a task holds, and what is shuffled, stays in proportion to the input."""

import random

import pytest
from pyspark.sql import functions as F

from cohortry.operators import claims, shapes, spread
from cohortry.plans import catalog

SMALL = "/root/testdata/sf0.001"


def parts_of(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_claims_of_groups_pass_once(spark, monkeypatch):
    rnd = random.Random(9)
    rows, want = [], {}
    for g in (None, *range(12)):
        used = set()
        for a in range(200 if g == 3 else 15):
            own = [0, 1] if g == 5 else rnd.sample(range(9), 4)
            rows += [(g, f"{g}-{a}", s, a, k + 1) for k, s in enumerate(own)]
            got = next((s for s in own if s not in used), None)
            if g is not None and got is not None:
                used.add(got)
                want[f"{g}-{a}"] = got
    df = spark.createDataFrame(rows + [(1, "1-none", None, 99, 1)], "who int, anchor string, series int, turn int, place int").withColumn("more", F.lit("x"))
    written = []
    monkeypatch.setattr(claims, "saved", lambda d: written.append(1) or spread.saved(d))
    args = (["who", "anchor"], ["who", "series"], ["turn"], "place")
    got = claims.one_to_one(df, *args)
    assert {r["anchor"]: r["series"] for r in got.collect()} == want and got.count() == len(want) and len(written) == 2
    # a large group goes by rounds
    got = claims.one_to_one(df, *args, streamed=100)
    assert got.columns == df.columns and {r["anchor"]: r["series"] for r in got.collect()} == want and len(written) > 6
    twice = claims.one_to_one(df.unionByName(df), *args)
    assert twice.count() == 2 * len(want)


@pytest.mark.parametrize("query", ["phase_split_reset", "mutual_information", "candidate_scores", "audit_scores", "series_claims", "family_group_scores", "best_series_per_exam"])
def test_tasks_grow_with_the_table(spark, monkeypatch, query):
    monkeypatch.setattr(spread, "TASK_ROWS", 500)
    assert parts_of(catalog.QUERIES[query](spark, SMALL)) > 4


def test_transforms_are_made_behind_the_shuffle(spark, monkeypatch):
    monkeypatch.setattr(shapes, "SLAB", 16, raising=False)
    rows = [(1, x, y, z, float((7 * x + 5 * y + 3 * z) % 11)) for x in range(3) for y in range(3) for z in range(4)]
    turned = [(i, 2 - y, x, 3 - z, v) for i, x, y, z, v in rows]
    left, right = (spark.createDataFrame(r, "volume_id int, x int, y int, z int, v double") for r in (rows, turned))
    found = shapes.orientation_match(left, right, (3, 3, 4))
    got = found.collect()
    assert len(got) == 1 and got[0]["transform"].startswith("swap") and got[0]["corr"] == pytest.approx(1)
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert -1 < plan.index("Generate") < plan.index("RepartitionByExpression")


def test_a_wanted_series_is_spread(spark, monkeypatch):
    monkeypatch.setattr(spread, "HEAVY_ROWS", 10)
    rows = [(None if k % 19 == 0 else 1 if k % 2 else k % 7, k) for k in range(300, 0, -1)]
    df = spread.saved(spark.createDataFrame(rows, "series int, turn int"))
    got = claims.first_claims(df, ["series"], ["turn"], 300)
    want = {}
    for s, t in sorted(rows, key=lambda r: r[1]):
        if s is not None:
            want.setdefault(s, t)
    assert got.count() == 300 and {r["series"]: r["turn"] for r in got.where("taken").collect()} == want


def test_counts_of_candidates_meet_in_dealt_tasks(spark):
    plan = catalog.QUERIES["candidate_counts"](spark, SMALL)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression") >= 3


def test_components_send_no_table_through_the_driver(spark, monkeypatch):
    plans = []
    monkeypatch.setattr(spread, "saved", lambda d, save=spread.saved: plans.append(d._jdf.queryExecution().executedPlan().toString()) or save(d))
    rows = [(v, x, 0, z) for v in range(30) for x in range(9) for z in range(9) if x % 2 == 0 or z == 8 * (x // 2 % 2)]
    mask = spark.createDataFrame(rows, "volume_id int, x int, y int, z int")
    got = shapes.components(mask, (9, 1, 9))
    assert got.count() == len(rows) and {r["part"] for r in got.collect()} == {0}
    assert any("SortMergeJoin" in p for p in plans) and not [p for p in plans if "Broadcast" in p]
