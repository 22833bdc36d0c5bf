"""What stays where it is: texts and sets of shingles are not shuffled for rows that a join would drop or pass through."""

from pyspark.sql import functions as F

from cohortry.llm import common, lines, neardup


def test_a_filter_loses_no_key_and_stops_most_others(spark):
    rows = spark.range(20_000).select(F.when(F.col("id") > 0, F.col("id")).alias("k"), F.lit("x").alias("v"))
    wanted = rows.where("k % 100 = 7 or k is null").select("k")
    got = common.possible(rows, wanted, ["k"], wanted.count())
    assert got.columns == ["k", "v", "possible"] and got.count() == 20_000
    assert got.where("(k % 100 = 7 or k is null) and not possible").count() == 0
    assert got.where("possible").count() < 201 + 20_000 / 8
    assert common.possible(rows, wanted.where("false"), ["k"], 0).where("possible").count() == 0


def test_sets_meet_pairs_where_they_lie(spark):
    """A class with very many pairs is spread; all others find their sets in buckets, without a shuffle of the sets."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sets = spark.range(900).select(F.col("id").alias("class"), F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: k + F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") * 10)).cast("array<long>").alias("shingles"))
        held = common.bucketed(sets.unionByName(sets), "class")
        assert held.count() == 900
        hot = [(0, b) for b in range(1, 600)]
        for rows in ([(a, a + d) for a in range(3, 890) for d in (1, 2)], hot + [(a, a + 2) for a in range(3, 800)]):
            pairs = common.saved(spark.createDataFrame(rows, "a long, b long"))
            found = neardup._confirmed(pairs, held, 80)
            assert {tuple(r) for r in found.collect()} == {(a, b) for a, b in rows if a % 2 == b % 2 == 0}
            if rows[0][0]:
                plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]
                assert plan.count("Join") == 2 and plan.count("Exchange hashpartitioning") == 2
        common.discard(held)
        assert held.table_name not in [t.name for t in spark.catalog.listTables()]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_pages_meet_digests(spark):
    rows = [(None if k % 11 == 0 else k, "s" if k % 3 else None, f"menu\nline {k % 7}\n\nline {k}" if k % 5 else None) for k in range(60)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    pages = docs.select(F.col("doc_id").alias("id")).distinct().withColumn("page", F.col("id") % 20)
    joined = docs.join(pages, docs["doc_id"].eqNullSafe(pages["id"]), "left").drop("id")
    want = lines.line_ratios(joined, page_col="page")
    got = lines.line_ratios(docs, pages=pages)
    assert got.count() == want.count() > 20 and got.exceptAll(want).isEmpty()
    cut = lines.drop_boilerplate_lines(docs, ratio=0.2, min_pages=3, pages=pages)
    assert cut.exceptAll(lines.drop_boilerplate_lines(joined, ratio=0.2, min_pages=3, page_col="page").drop("page")).isEmpty() and cut.count() == 60


def test_texts_that_lose_no_line_do_not_move(spark):
    """Only texts with a dropped line meet their list; the others pass beside the join. Ids may be null or repeated."""
    rows = [(None if k % 9 == 0 else k // 2, "s" if k % 3 else None, f"menu\nline {k}" if k % 10 == 0 else f"line {k}\n\nown {k}" if k % 4 else None) for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, source string, text string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        cut = lines.drop_boilerplate_lines(docs)
        got = sorted(map(repr, cut.collect()))
        plan = cut._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    want = [(i, s, t and t.replace("menu\n", ""), t.count("\n") + 1 if t else 0, int("menu" in (t or ""))) for i, s, t in rows]
    assert got == sorted(map(repr, spark.createDataFrame(want, cut.schema).collect()))
    beside = plan[plan.index("Union") :]
    assert beside.count("SortMergeJoin") == 1 and "Filter NOT" in beside


def test_batches_of_long_texts_are_bounded(spark):
    names = ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.parquet.columnarReaderBatchSize")
    before = [spark.conf.get(n) for n in names]
    try:
        common.small_batches(spark)
        assert int(spark.conf.get(names[0])) <= 4 << 20 and int(spark.conf.get(names[1])) <= 512
    finally:
        for n, value in zip(names, before, strict=True):
            spark.conf.set(n, value)


def test_rows_that_stay_do_not_move(spark):
    """Null and repeated ids as before: an id stays where one of its rows is kept."""
    text = " ".join(f"w{k}" for k in range(60))
    rows = [(k, f"{text} x{k}") for k in (5, 3, 9)] + [(None, None), (None, text), (7, None), (7, "own words of seven"), (7, text), (1, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("possible", F.lit(1))
    kept = neardup.near_duplicates(docs).where("kept").select(F.col("doc_id").alias("k")).distinct()
    want = docs.join(kept, docs["doc_id"].eqNullSafe(kept["k"]), "left_semi")
    got = neardup.drop_near_duplicates(docs)
    assert got.columns == docs.columns and got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty() and got.count() < len(rows)
