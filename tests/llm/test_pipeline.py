import pytest
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from cohortry.llm import pii
from cohortry.llm.common import saved
from tests.llm import brute

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark):
    """Each stage's input and output."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in pipeline.STAGES:
        after = saved(stage(spark, docs, SF))
        out.append((name, docs, after))
        docs = after
    return {name: (before, after) for name, before, after in out}


def test_order_and_columns(steps):
    assert list(steps) == ["quality", "line_dedup", "near_dedup", "pii", "packing"]
    assert all(after.columns == pipeline.COLUMNS for name, (_, after) in steps.items() if name != "packing")


def test_quality_keeps_clean_documents(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    before, after = steps["quality"]
    clean, junk = (labels.where(f"quality = {q}").join(before, "doc_id", "left_semi") for q in (1, 0))
    assert clean.join(after, "doc_id", "left_anti").count() <= 0.05 * clean.count()
    assert junk.join(after, "doc_id", "left_semi").count() <= 0.3 * junk.count()


def test_lines_near_copies_and_masks_match_brute_force(steps):
    before, after = ([tuple(r) for r in t.select("doc_id", "source", "text").collect()] for t in steps["line_dedup"])
    assert {i: t for i, _, t in after} == brute.kept_lines(before, 0.005, 5)
    before, after = steps["near_dedup"]
    groups, _ = brute.components([(r["doc_id"], r["text"]) for r in before.collect()], 5, 80)
    assert {r["doc_id"] for r in after.collect()} == set(groups.values())
    before, after = steps["pii"]
    texts = {r["doc_id"]: r["text"] for r in after.collect()}
    assert len(texts) == before.count()
    for r in before.collect():
        found = brute.base_spans(r["text"])
        assert texts[r["doc_id"]] == r["text"] if not found and "[ID]" not in texts[r["doc_id"]] else not brute.base_spans(texts[r["doc_id"]])
    assert after.where(F.length("text") != F.col("n_chars")).count() == 0
    assert pii.KINDS[-1] == "id"


def test_packing_holds_every_document(steps):
    before, after = steps["packing"]
    assert {r[0] for r in before.select("doc_id").collect()} == {r[0] for r in after.select("doc_id").collect()}
    assert after.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.max(F.col("offset") + F.col("length")).alias("end")).where("n > 4096 or n <> end").count() == 0


def test_stages_take_empty_and_odd_tables(spark):
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (None, "x y", None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for docs in (odd, odd.where("false")):
        for _, stage in pipeline.STAGES:
            stage(spark, docs, SF).count()


@pytest.mark.parametrize("near", [False, True])
def test_a_text_whose_copies_hold_a_third_of_the_rows_survives_once(spark, near):
    """Its lines are no boilerplate; a line that different pages share is."""
    whole = [[f"copied{line}w{k}" for k in range(12)] for line in range(10)]
    rows = []
    for k in range(60):
        if k % 3:
            rows.append((k, "\n".join(["menu home about", *(" ".join(f"page{k}line{j}w{x}" for x in range(12)) for j in range(3))]), "en", "s", 0))
        else:
            edited = [list(line) for line in whole]
            if near and k:
                edited[k // 3 % 10][11] = f"edit{k}"
            rows.append((k, "\n".join(" ".join(line) for line in edited), "en", "s", 0))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    cut = saved(pipeline.line_stage(spark, df, SF))
    texts = {r["doc_id"]: r["text"] for r in cut.collect()}
    assert all(texts[k] == t for k, t, *_ in rows if k % 3 == 0)
    assert all(texts[k] == t.split("\n", 1)[1] for k, t, *_ in rows if k % 3)
    kept = {r["doc_id"]: r["text"] for r in pipeline.near_dup_stage(spark, cut, SF).collect()}
    assert sorted(kept) == sorted([0, *(k for k in range(60) if k % 3)]) and kept[0] == rows[0][1]
