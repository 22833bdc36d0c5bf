"""Distributed selection, one-to-one claims, and joins on heavy keys against plain versions."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cohortry.functions import text
from cohortry.operators import claims, linkage, quantiles, spread

INF = float("inf")


def plain_quantiles(values, at):
    own = sorted(v for v in values if v is not None and not math.isnan(v))
    if not own:
        return (0, None, None, None)
    out = []
    for p in at:
        where = (len(own) - 1) * p
        a, b = math.floor(where), math.ceil(where)
        out.append(own[a] if own[a] == own[b] else (b - where) * own[a] + (where - a) * own[b])
    return (len(own), own[0], own[-1], out)


@pytest.mark.parametrize("small", [1 << 20, 300, 5])
def test_quantiles_match_sorting(spark, small):
    rnd = random.Random(31)
    groups = {
        "even": [rnd.random() for _ in range(900)], "ties": [rnd.choice([1.0, 2.0, 2.0, 7.5]) for _ in range(700)], "steep": [10.0 ** rnd.randint(-300, 300) * rnd.choice([1, -1]) for _ in range(600)],
        "infinite": [rnd.choice([INF, -INF, 1.0, 1.7e308, -1.7e308]) for _ in range(400)], "one": [3.0] * 500, "few": [2.0, 1.0], "none": [None, float("nan")], None: [float(k) for k in range(401)], "missing": [None, float("nan"), 1.0, 2.0] * 200,
    }
    rows = [(g, v) for g, values in groups.items() for v in values]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, value double").withColumn("n", F.lit("clash"))
    at = [0.0, 0.005, 0.25, 0.5, 0.995, 1.0]
    got = {r["g"]: (r["n"], r["low"], r["high"], r["quantiles"]) for r in quantiles.exact_quantiles(df, ["g"], at, small=small).collect()}
    assert got.keys() == groups.keys()
    for g, values in groups.items():
        n, low, high, want = plain_quantiles(values, at)
        assert got[g][:3] == (n, low, high)
        assert got[g][3] is None if want is None else got[g][3] == pytest.approx(want, nan_ok=True), g


@pytest.mark.parametrize("small", [1 << 20, 3])
def test_quantiles_of_one_group_and_of_nothing(spark, small):
    df = spark.createDataFrame([(float(k % 37),) for k in range(500)], "x double")
    r = quantiles.exact_quantiles(df, [], [0.5, 0.9], value="x", small=small).collect()
    assert len(r) == 1 and (r[0]["n"], r[0]["quantiles"]) == (500, plain_quantiles([float(k % 37) for k in range(500)], [0.5, 0.9])[3])
    none = quantiles.exact_quantiles(df.where("false"), [], [0.5], value="x", small=small).collect()
    assert [(r["n"], r["quantiles"]) for r in none] == [(0, None)]
    assert quantiles.exact_quantiles(df.where("false").withColumn("g", F.lit(1)), ["g"], [0.5], value="x").count() == 0


def chosen(claims_of):
    """Anchors choose one after the other; claims_of: {anchor: series from the best down}."""
    used, out = set(), {}
    for a in sorted(claims_of):
        for s in claims_of[a]:
            if s not in used:
                used.add(s)
                out[a] = s
                break
    return out


@pytest.mark.parametrize("n_series,width", [(40, 6), (6, 6), (200, 3)])
def test_one_to_one_equals_choosing_in_turn(spark, n_series, width):
    rnd = random.Random(32)
    wanted = {a: rnd.sample(range(n_series), width if a % 9 else 1) for a in range(70)}
    wanted |= {100 + k: [0, 1] for k in range(20)}  # everybody wants the same
    rows = [(f"a{a}", s, a, k + 1) for a, own in wanted.items() for k, s in enumerate(own)] + [("null", None, 999, 1)]
    df = spark.createDataFrame(rows, "anchor string, series int, turn int, place int").withColumn("more", F.lit("x"))
    got = claims.one_to_one(df.unionByName(df.where("turn % 10 = 0")).distinct(), ["anchor"], ["series"], ["turn"], "place").collect()
    assert {r["turn"]: r["series"] for r in got} == chosen(wanted) and len(got) == len(chosen(wanted)) and got[0]["more"] == "x"
    assert claims.one_to_one(df.where("false"), ["anchor"], ["series"], ["turn"], "place").count() == 0


def test_first_claim_takes_a_series(spark):
    rnd = random.Random(33)
    rows = [(rnd.choice([None, 1, 2, 3, 4]), None if k == 7 else k) for k in range(60)]
    df = spark.createDataFrame(rows, "series int, turn int").withColumn("taken", F.lit("clash"))
    got = [(r["series"], r["turn"]) for r in claims.first_claims(df, ["series"], ["turn"]).where("taken").collect()]
    firsts = {}
    for s, t in sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0)):
        firsts.setdefault(s, t)
    assert sorted(got, key=str) == sorted(((s, t) for s, t in firsts.items() if s is not None), key=str)


@pytest.mark.parametrize("how", ["inner", "left"])
def test_heavy_keys_are_spread_and_joins_are_whole(spark, monkeypatch, how):
    rows = [(7 if k % 3 == 0 else None if k % 50 == 1 else k % 50, "ab"[k % 2], k) for k in range(900)]
    left = spark.createDataFrame(rows, "key int, kind string, row int")
    right = spark.createDataFrame([(k % 45, "ab"[k % 2], f"v{k}") for k in range(100)] + [(None, "a", "no")], "key int, kind string, value string")
    counts = left.groupBy("key", "kind").count()
    heavy = spread.heavy_keys(counts, ["key", "kind"], "count", least=20)
    assert {tuple(r)[:2] for r in heavy.collect()} == {(7, "a"), (7, "b")} and spread.heavy_keys(counts, ["key"], "count", least=1000) is None
    want = Counter(tuple(r) for r in left.join(right, ["key", "kind"], how).collect())
    joined = spread.spread_join(left, right, ["key", "kind"], heavy, ["row"], how, copies=4)
    assert Counter(tuple(r) for r in joined.collect()) == want
    tasks = joined.where("key = 7").select(F.spark_partition_id().alias("p"), "row")
    assert Counter(tuple(r) for r in spread.counted_join(left, right, ["key", "kind"], ["row"], how).collect()) == want and tasks.count() > 0


def test_saved_tables_are_deleted(spark):
    table = spread.saved(spark.range(3))
    assert table.count() == 3
    path = table.shared_path.removeprefix("file://")
    spread.discard(table)
    import os

    assert not os.path.exists(path)


def test_candidate_pairs_of_a_hot_subject(spark, monkeypatch):
    monkeypatch.setattr(spread, "HEAVY_ROWS", 10)
    series = [("ACR-1" if k % 2 else f"ACR-{k % 9 + 2}", k) for k in range(300)] + [(None, 999)]
    anchors = [("acr_1", 1), ("acr_1", 3), ("acr_4", 2), ("acr_77", 5), (None, 6), ("acr_5", 12345)]
    s = spark.createDataFrame(series, "subject string, uid int")
    a = spark.createDataFrame(anchors, "subject string, uid int")
    got = linkage.candidate_pairs(a, s, normalize=text.subject_id)
    assert got.columns == ["subject", "uid", "anchor_uid"]
    spelt = lambda x: None if x is None else x.upper().replace("_", "-")
    want = Counter((sub, uid, b) for x, b in anchors for sub, uid in series if sub is not None and sub == spelt(x))
    assert Counter(tuple(r) for r in got.collect()) == want and sum(want.values()) > 300
    lost = linkage.unmatched_anchors(a, s, normalize=text.subject_id).collect()
    assert {(r["subject"], r["uid"]) for r in lost} == {("acr_77", 5), (None, 6), ("acr_5", 12345)} and {r["risk_status"] for r in lost} == {"missing_anchor_uid_or_metadata_patient"}
