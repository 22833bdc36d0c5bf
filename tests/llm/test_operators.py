import random
import re

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import bpe, common, exact, graph, lines, neardup, packing, pii, quality, queries, repeats, topk, urls
from cohortry.llm.common import saved
from tests.llm import brute
from tests.oracle import assert_same, connect

SF = "/root/testdata/sf0.001"
DOC = "doc_id long, text string, lang string, source string, n_chars long"
BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
ODD = [None, "", " ", "a", "a" * 3000, "é🙂 日本語\n\n  x", "<|endoftext|> <|ENDOFTEXT|>", "don't  WE'LL\t\r\n", "x\x1cy\x85z ½² Ⅷ", "same text", "same text"]


def docs(spark, texts, **more):
    rows = [(k, t, "en", f"s{k % 3}", None if t is None else len(t)) for k, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, con, name):
    assert_same(queries.QUERIES[name](spark, SF), queries.ORACLE_SQL[name], con)


# 1: tokens


def test_bpe_equals_the_library_and_decodes_back(spark):
    rnd = random.Random(0)
    texts = ODD + ["".join(rnd.choice(" \n\t'aàbsTLL3½!…日\u0301\u200b") for _ in range(rnd.randint(0, 40))) for _ in range(150)]
    got = bpe.with_digests(bpe.decode_ids(bpe.encode_texts(docs(spark, texts).withColumn("ids", F.lit("clash")), BYTES), BYTES)).collect()
    library = Tokenizer.from_file(BYTES)
    for r in got:
        ids = library.encode(texts[r["doc_id"]] or "", add_special_tokens=False).ids
        assert r["ids"] == ids and r["decoded"] == library.decode(ids, skip_special_tokens=False)
        assert r["ids_sha256"] == brute.sha(",".join(map(str, ids))) and r["n_tokens"] == len(ids)
    assert bpe.encode_texts(docs(spark, []), BYTES).count() == 0
    odd = spark.createDataFrame([([0x61, 255],), (None,), ([],)], "ids array<int>")
    library_text = library.decode([0x61, 255], skip_special_tokens=False)
    assert [r["decoded"] for r in bpe.decode_ids(odd, BYTES).collect()] == [library_text, "", ""]


def test_bpe_of_a_very_long_pretoken():
    model = bpe.BytePairModel(open(BYTES, encoding="utf-8").read())
    text = "abcab" * 20000
    ids = np.frombuffer(model.encode(text), dtype=np.int32)
    assert b"".join(model.spell[i] for i in ids.tolist()).decode() == text
    assert all(model.compatible(a, b) for a, b in zip(ids[:-1].tolist(), ids[1:].tolist(), strict=True))


# 2: quality


def labelled(spark, n=400):
    rnd = random.Random(1)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    rows = []
    for k in range(n):
        good = k % 4 != 0
        words = [word() for _ in range(rnd.randint(20, 60))]
        rows.append((k, " ".join(words) + "." if good else " ".join(w.upper() + "!!" for w in words[:20] * 2), "en", "s", 100))
    return spark.createDataFrame(rows, DOC), spark.createDataFrame([(k, int(k % 4 != 0)) for k in range(0, n, 2)], "doc_id long, quality int")


def test_quality_separates_held_out_documents(spark):
    d, y = labelled(spark)
    got = quality.quality_scores(d.withColumn("score", F.lit("clash")), y, bounds=quality.Bounds(labelled=300, unlabelled=300)).collect()
    held = [r for r in got if r["doc_id"] % 2]
    assert len(got) == 400 and sum(r["good"] == (r["doc_id"] % 4 != 0) for r in held) / len(held) > 0.95


def test_quality_without_labels_and_odd_rows(spark):
    d, y = labelled(spark, 40)
    with pytest.warns(UserWarning, match="no quality model"):
        none = quality.quality_scores(d, y.where("false")).collect()
    assert len(none) == 40 and all(r["good"] and r["score"] is None for r in none)
    d2, y2 = labelled(spark)
    odd = d2.unionByName(spark.createDataFrame([(1000 + k, t, None, None, None) for k, t in enumerate(ODD)] + [(None, "x", None, None, None)], DOC))
    got = quality.quality_scores(odd, y2.unionByName(spark.createDataFrame([(None, 1), (3, None)], y2.schema)))
    assert got.count() == 412 and got.where("score is null").count() == 0
    assert quality.quality_scores(d2.where("false"), y2).count() == 0


def test_quality_query_on_the_tables(spark):
    got = queries.op2_quality_classifier(spark, "/root/testdata/sf0.01").join(spark.read.parquet("/root/testdata/sf0.01/labels.parquet"), "doc_id")
    right = got.agg(F.avg((F.col("good") == (F.col("quality") == 1)).cast("double")), F.avg(F.when(F.col("quality") == 1, F.col("good").cast("double")))).first()
    assert right[0] > 0.97 and right[1] > 0.98


def test_quality_exchange_takes_all_unlabelled_rows(spark):
    """Sums over the pool equal those over one matrix, and every row that is sure enough and within the part is given."""
    d, _ = labelled(spark, 9000)
    pool = saved(quality._measured(d.select("doc_id", "text", "n_chars", "source", "lang")))
    views = [quality._matrix([r[c] for r in pool.collect()]) for c in ("text_view", "meta_view")]
    weights = [np.linspace(-1, 1, v.shape[1] + 1) for v in views]
    counts = quality._summed(pool, quality._histograms([], weights))
    assert counts[-1] == 9000 and counts[:-1].reshape(2, -1).sum(axis=1).tolist() == [9000, 9000]
    bounds = quality.Bounds(sure=0.5)
    high, low, n = quality._chosen(counts[: quality.BINS], 9000, 0.5, bounds)
    rounds = [quality.Round(tuple(weights), (high, high), (low, low))]
    given = quality._given(views, rounds)
    assert (given[1] >= 0).sum() == n
    scale = np.full((2, 1), 0.25)
    got = quality._summed(pool, quality._pool_slopes(rounds, scale, weights))
    assert np.allclose(got, quality._pool_slopes(rounds, scale, weights)(views), rtol=1e-4, atol=1e-2) and quality.Bounds().unlabelled is None


# 3: lines


def test_lines_match_brute_force(spark):
    rnd = random.Random(2)
    pool = ["menu", "menu ", "", "  ", "é line", "other"]
    rows = [(k, rnd.choice(["a", "b", None]), None if k % 17 == 0 else "\n".join(rnd.choice(pool) if rnd.random() < 0.4 else f"own {k} {j}" for j in range(rnd.randint(0, 6)))) for k in range(120)]
    rows += [(500, "lone", "menu\nx"), (501, "lone2", "")]
    df = spark.createDataFrame([(i, t, "en", h, 0) for i, h, t in rows], DOC).withColumn("n_lines", F.lit("clash"))
    got = {r["doc_id"]: r for r in lines.drop_boilerplate_lines(df, ratio=0.2, min_pages=3).collect()}
    want = brute.kept_lines(rows, 0.2, 3)
    assert {i: r["text"] for i, r in got.items()} == want
    assert all(r["n_dropped"] == (rows_text(rows, i).count("\n") - (want[i] or "").count("\n") if want[i] not in (None, "") else r["n_dropped"]) for i, r in got.items())
    twice = lines.drop_boilerplate_lines(df.unionByName(df), ratio=0.2, min_pages=3)
    assert twice.count() == 2 * len(rows) and lines.drop_boilerplate_lines(df.where("false")).count() == 0


def rows_text(rows, i):
    return next(t for k, _, t in rows if k == i) or ""


def test_lines_keep_clashing_columns_and_very_long_texts(spark):
    texts = ["menu\n" + f"own {k} " * 20000 for k in range(6)] + [None]
    df = docs(spark, texts).withColumnsRenamed({"lang": "row", "n_chars": "dropped"}).withColumns({"id": F.lit(1), "host": F.lit(2), "text_key": F.lit(3), "source": F.lit("s")})
    got = lines.drop_boilerplate_lines(df)
    assert got.columns == [*df.columns, "n_lines", "n_dropped"]
    assert {r["doc_id"]: r["text"] for r in got.collect()} == {k: t and t.split("\n", 1)[1] for k, t in enumerate(texts)}


# 4: repeats


def test_repeats_match_brute_force(spark):
    rnd = random.Random(3)
    pool = ["".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(30, 200))) for _ in range(10)]
    piece = lambda: rnd.choice(pool)[rnd.randint(0, 20) : rnd.randint(60, 200)] if rnd.random() < 0.6 else "".join(rnd.choice("abcdefgh é") for _ in range(rnd.randint(5, 80)))
    texts = ["".join(piece() for _ in range(rnd.randint(0, 8))) for _ in range(150)] + [None, "", "a" * 500, "ab" * 300, "x" * 39, "x" * 40, "q" * 41, pool[0], pool[0]]
    for length, reach in ((40, 20), (40, 32)):
        got = {r["doc_id"]: (r["n_bytes"], len(b"" if r["kept"] is None else r["kept"]), len(r["spans"]), bytes(r["kept"])) for r in repeats.remove_repeats(docs(spark, texts), length=length, reach=reach).collect()}
        for k, (n, cut, runs, kept) in enumerate(brute.removed(texts, length)):
            assert got[k] == (n, n - cut, runs, kept)
    assert repeats.remove_repeats(docs(spark, [])).count() == 0


def test_repeats_query_on_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, brute.removed(list(texts.values()), 400), strict=True))
    got = queries.op4_repeated_passages(spark, SF).collect()
    assert len(got) == len(texts) and any(n for _, n, _, _ in want.values())
    for r in got:
        size, n, runs, kept = want[r["doc_id"]]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (size, n, runs, brute.sha(kept))


def test_repeats_of_very_long_texts_with_clashing_columns(spark):
    rnd = random.Random(14)
    long = "".join(rnd.choice("abcd ") for _ in range(1_200_000))
    texts = ["x" + long[200_000:700_000], long, "y" * 399, None]
    df = docs(spark, texts).withColumnsRenamed({"lang": "core", "source": "ranges", "n_chars": "kept"})
    got = {r["doc_id"]: (r["n_bytes"], [tuple(s) for s in r["spans"]]) for r in repeats.remove_repeats(df).collect()}
    assert got == {0: (500_001, [(1, 500_001)]), 1: (1_200_000, [(200_000, 700_000)]), 2: (399, []), 3: (0, [])}


def test_repeated_rows_repeat_their_text(spark):
    df = docs(spark, ["abcdefghij" * 3 + "klm", "other"])
    got = repeats.remove_repeats(df.unionByName(df.where("doc_id = 0")), length=20, reach=8).where("doc_id = 0").collect()
    assert len(got) == 2 and all(bytes(r["kept"]) == b"" for r in got)


def test_parse_of_a_text_over_several_steps(monkeypatch):
    data = bytes(random.Random(4).choice(b"abcd") for _ in range(5000))
    whole = [(t, a, b) for t, a, b in repeats.parse(data, 40, 20)]
    monkeypatch.setattr(repeats, "STEP", 700)
    parts = [(t, a, b) for t, a, b in repeats.parse(data, 40, 20)]
    at = lambda found: [t for t, a, b in found for _ in range(a, b + 1)]
    assert at(whole) == at(parts) and [x for _, a, b in parts for x in range(a, b + 1)] == list(range(5000 - 39))


# 5: packing


def test_pieces_equal_the_library(spark):
    texts = ODD + ["word " * 3000]
    got = packing.document_pieces(docs(spark, texts), WORDS, end_id=1, capacity=100).collect()
    library = Tokenizer.from_file(WORDS)
    for k, text in enumerate(texts):
        ids = (library.encode(text, add_special_tokens=False).ids if text else []) + [1]
        mine = sorted((r for r in got if r["doc_id"] == k), key=lambda r: r["piece"])
        assert np.frombuffer(b"".join(bytes(r["ids"]) for r in mine), dtype="<u4").tolist() == ids
        assert [r["start"] for r in mine] == list(range(0, len(ids), 100)) and all(r["length"] <= 100 for r in mine)


def test_packing_is_gapless_complete_and_tight(spark):
    rng = np.random.default_rng(5)
    lengths = np.minimum(4096, rng.lognormal(6.5, 1, 3000).astype(int) + 1).tolist()
    df = spark.createDataFrame([(k, n) for k, n in enumerate(lengths)], "doc_id long, length long").withColumn("offset", F.lit("clash"))
    got = packing.assign_sequences(df.repartition(5)).collect()
    assert sorted((r["doc_id"], r["length"]) for r in got) == list(enumerate(lengths))
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, n in sorted(b):
            assert offset == at
            at += n
        assert at <= 4096
    assert len(bins) <= 1.02 * sum(lengths) / 4096 + 3
    assert packing.assign_sequences(df.where("false")).count() == 0


def _packed_as_sequences(plan, lengths, capacity=4096):
    used = {}
    for times, runs in plan:
        assert times > 0 and sum(n * each for n, each in runs) <= capacity
        for n, each in runs:
            used[n] = used.get(n, 0) + times * each
    assert used == {n: lengths.count(n) for n in set(lengths)}
    return sum(times for times, _ in plan)


@pytest.mark.parametrize("low,high", [(1400, 3000), (200, 4096), (1000, 2500), (None, None), (1, 40)])
def test_packing_needs_no_more_sequences_than_best_fit_decreasing(low, high):
    rng = np.random.default_rng(11)
    drawn = np.minimum(4096, rng.lognormal(6.3, 1, 20480).astype(int) + 1) if low is None else rng.integers(low, high + 1, 20480)
    lengths = drawn.tolist()
    found = _packed_as_sequences(packing.plan_sequences({n: lengths.count(n) for n in set(lengths)}, 4096), lengths)
    assert found <= brute.best_fit_decreasing(lengths, 4096)


HARD = {"thirds": [2049, 1366, 1025, 820, 683, 586], "halves": list(range(1024, 2049)), "mixed": [3000, 1500, 1100, 900, 700, 513, 300, 40]}


@pytest.mark.parametrize("name", sorted(HARD))
def test_packing_by_configurations_beats_best_fit_where_greedy_loses(name):
    rng = np.random.default_rng(17)
    lengths = rng.choice(HARD[name], 20480).tolist()
    found = _packed_as_sequences(packing.plan_sequences({n: lengths.count(n) for n in set(lengths)}, 4096), lengths)
    assert found <= brute.best_fit_decreasing(lengths, 4096)
    if name == "thirds":  # the linear program's own bound, but for rounding down its six configurations
        chosen = packing.configurations(HARD[name], [lengths.count(n) for n in HARD[name]], 4096)
        assert all(sum(HARD[name][g] for g in slots) <= 4096 for _, slots in chosen)
        assert found <= sum(times for times, _ in chosen) + 7 and found < 0.99 * brute.best_fit_decreasing(lengths, 4096)


def test_configurations_of_a_small_problem_are_optimal():
    """Six of size 3 and six of size 2 into sequences of 5: each takes one of both."""
    assert packing.configurations([3, 2], [6, 6], 5) == [(6, [0, 1])] and packing.configurations([], [], 5) == []
    rng = np.random.default_rng(18)
    sizes, demand = [60, 45, 31, 20, 11], rng.integers(50, 400, 5).tolist()
    chosen = packing.configurations(sizes, demand, 100)
    used = [sum(times * slots.count(g) for times, slots in chosen) for g in range(5)]
    assert all(u <= d for u, d in zip(used, demand, strict=True)) and all(sum(sizes[g] for g in slots) <= 100 for _, slots in chosen)


def test_packing_with_fewer_groups_than_lengths_rounds_up():
    """Rounding costs about a group's cardinality of sequences (50 pieces here)."""
    rng = np.random.default_rng(12)
    lengths = rng.integers(700, 2500, 5000).tolist()
    found = _packed_as_sequences(packing.plan_sequences({n: lengths.count(n) for n in set(lengths)}, 4096, groups=100), lengths)
    assert found <= brute.best_fit_decreasing(lengths, 4096) + 2 * 50


def test_packing_refuses_lengths_beyond_the_capacity(spark):
    for n in (0, 4097):
        with pytest.raises(Exception, match="piece lengths must be"):
            packing.assign_sequences(spark.createDataFrame([(1, n)], "doc_id long, length long")).count()


def test_control_and_latin_characters_beside_words(spark):
    texts = [f for c in map(chr, range(0x250)) for f in (f"word{c}", f"{c}word", f"a {c} b", f"Wo{c}rd.")]
    got = packing.document_pieces(docs(spark, texts), WORDS, end_id=1).collect()
    library = Tokenizer.from_file(WORDS)
    for r in got:
        assert np.frombuffer(bytes(r["ids"]), dtype="<u4").tolist() == library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [1], texts[r["doc_id"]]


def test_packing_query_on_the_tables(spark):
    """Every piece equals the library's, and sequences are gapless and no more than best fit decreasing needs."""
    import zlib

    library = Tokenizer.from_file(WORDS)
    library.no_truncation(), library.no_padding()
    want, lengths = {}, []
    for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect():
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids + [1]
        for p, at in enumerate(range(0, len(ids), 4096)):
            cut = ids[at : at + 4096]
            want[r["doc_id"], p] = (at, len(cut), zlib.crc32(np.array(cut, dtype="<u4").tobytes()))
            lengths.append(len(cut))
    got = queries.op5_best_fit_packing(spark, SF).collect()
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in got} == want and len(got) == len(want)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        b.sort()
        assert [o for o, _ in b] == [sum(n for _, n in b[:k]) for k in range(len(b))] and sum(n for _, n in b) <= 4096
    assert len(bins) <= brute.best_fit_decreasing(lengths, 4096)


# 6: urls


def test_urls_match_a_scan_of_the_rules(spark):
    rules = [*queries.URL_RULES, ("allow", "a.net", "/b"), ("block", "a.net", "/b"), ("block", "net", "/ab/c"), ("allow", "x", "")]
    hosts, paths = ["net", "a.net", "q.a.NET", "xnet", "example.net", "é.example.com", "x", "", "a..net", "org"], ["", "/", "/en/", "/en/x", "/b", "/bcd/e", "/ab/c", "/de/?q", "/fr/#/de/", "?x=/en/", "#"]
    found = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "://", "a://b://c/d"]
    df = spark.createDataFrame([(k, u, "clash") for k, u in enumerate(found)], "page_id long, url string, rule string")
    for r in urls.filter_urls(df, rules).collect():
        u = r["url"] or ""
        rest = u.split("://", 1)[1] if "://" in u else ""
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = rest[:cut].translate(str.maketrans(urls.UPPER, urls.LOWER))
        path = rest[cut:].split("?")[0].split("#")[0]
        fits = [(len(h) + len(p), len(h), v == "block", v, h + p) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, max(fits)[4] if fits else None, max(fits)[3] if fits else "allow")
    assert urls.filter_urls(df, []).where("verdict <> 'allow'").count() == 0 and urls.filter_urls(df.where("false"), rules).count() == 0


# 7: top k


def test_top_k_matches_brute_force_with_ties(spark):
    rng = np.random.default_rng(6)
    vectors = [(k, rng.integers(-2, 3, 6).astype(float).tolist()) for k in range(300)]
    odd = [(900, None), (901, [1.0, None, 0, 0, 0, 0]), (902, [float("nan")] * 6), (903, [float("inf")] * 6), (904, [0.0] * 6), (905, [1.0, 2.0]), (906, []), (None, [1.0] * 6)]
    df = spark.createDataFrame(vectors + [(i, None if v is None else [None if x is None else float(x) for x in v]) for i, v in odd] + vectors[:5], "vec_id long, embedding array<double>")
    asked = [k for k, _ in vectors if k % 50 == 0] + [904, 905, 902]
    got = topk.exact_top_k(df, df.where(F.col("vec_id").isin(asked)), k=5, scale=1, block_rows=64, query_rows=4).collect()
    clean = vectors + [(904, [0.0] * 6)]
    for q in asked[:-2]:
        v = dict(clean)[q]
        want = sorted((-int(np.dot(v, w)), i) for i, w in clean if i != q)[:5]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert mine == [(k + 1, i, -s) for k, (s, i) in enumerate(want)]
    assert not [r for r in got if r["query_id"] in (902, 905)]
    assert topk.exact_top_k(df.where("false"), df.where("false")).count() == 0


def test_the_threshold_saves_where_few_components_decide():
    rng = np.random.default_rng(16)
    steep = rng.standard_t(2, (4096, 8)) * 2.0 ** -np.arange(8) * 100
    even = rng.standard_normal((4096, 64)) * 100
    share = {}
    for name, vectors in (("steep", steep), ("even", even)):
        vectors = np.floor(vectors)
        held = topk.SortedLists(np.arange(len(vectors)), vectors)
        for q in range(0, 4096, 512):
            scores = vectors @ vectors[q]
            scores[q] = -np.inf
            want = sorted(zip(-scores, range(len(scores)), strict=True))[:5]
            assert held.top(q, vectors[q], 5) == [(-s, i) for s, i in want]
        share[name] = held.scored / (8 * 4095)
    assert share["steep"] < 0.5 and share["even"] > 0.99


# 8: exact copies


@pytest.mark.parametrize("fingerprint", [F.xxhash64, lambda block: F.xxhash64(block) % 3])
def test_exact_groups_whatever_the_fingerprint(spark, fingerprint):
    rnd = random.Random(7)
    texts = ["".join(rnd.choice("ab") for _ in range(rnd.choice([0, 1, 8, 9, 24, 40]))) for _ in range(120)] + [None, "", "x" * 400, "x" * 400, "x" * 399]
    df = docs(spark, texts)
    got = exact.exact_duplicates(df.unionByName(df.where("doc_id = 3")), block_chars=8, fingerprint=fingerprint).collect()
    rows = [(k, t or "") for k, t in enumerate(texts)] + [(3, texts[3])]
    assert len(got) == len(rows)
    for r in got:
        text = texts[r["doc_id"]] or ""
        same = [k for k, t in rows if t == text]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (max(same), len(same), r["doc_id"] == max(same), brute.sha(text))
    assert exact.exact_duplicates(df.where("false")).count() == 0
    assert exact.drop_exact_duplicates(df, block_chars=8).count() == len({t or "" for t in texts})


# 9: near copies


@pytest.mark.parametrize("size", [4, 5])
def test_near_groups_match_brute_force(spark, size):
    rnd = random.Random(8)
    words = [f"w{k}" for k in range(300)]
    base = [[rnd.choice(words) for _ in range(rnd.choice([1, 3, 5, 8, 60, 100]))] for _ in range(40)]
    rows = []
    for k in range(260):
        t = list(rnd.choice(base))
        for _ in range(rnd.choice([0, 0, 1, 1, 2, 4])):
            t[rnd.randrange(len(t))] = rnd.choice(words)
        rows.append((k, (" " if k % 2 else "\n\t").join(t).upper() if k % 3 == 0 else " ".join(t)))
    rows += [(900, None), (901, ""), (902, " \n"), (903, "")]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    want, sizes = brute.components(rows, size, 80)
    got = neardup.near_duplicates(df, size=size).collect()
    assert {r["doc_id"]: (r["component_id"], r["n_shingles"], r["kept"]) for r in got} == {i: (c, sizes[i], c == i) for i, c in want.items()}
    assert neardup.near_duplicates(df.where("false")).count() == 0


def test_a_large_group_of_near_copies_that_only_meet_through_others(spark):
    """Variants are linked to the base, seldom to each other; chains must still be found."""
    words = [f"w{k}" for k in range(100)]
    rows = [(0, " ".join(words))]
    for k in range(1, 60):
        t = list(words)
        t[k % 90 + 3] = f"x{k}"
        if k % 2:
            t[(k * 37) % 90 + 3] = f"y{k}"
        rows.append((k, " ".join(t)))
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in rows], DOC)
    want, _ = brute.components(rows, 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, size=4).collect()} == want


def test_miss_rate_is_small():
    assert neardup.miss_rate(0.8, 24, 4) < 1e-5


def test_components_of_paths_stars_and_loops(spark):
    edges = [(k, k + 1) for k in range(30)] + [(100, k) for k in range(101, 120)] + [(200, 200), (300, None), (101, 100)]
    got = {r["node"]: r["label"] for r in graph.connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(31)} | {k: 100 for k in range(100, 120)} | {200: 200}
    assert graph.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


# 10: personal data


def test_pii_base_matches_regex_scans(spark):
    rnd = random.Random(9)
    marks = list("a.b@-+%_ 0123456789()é🙂x")
    texts = ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 60))) for _ in range(600)]
    texts += [None, "", "a@b.com_x@y.z@q.r 1.2.3.4.5.6.7.8 4242424242424242", "0000001.2.3.4 +49 (30) 1234567", "1" * 20000, "12 " * 5000, "a" * 20000 + " @", "+1" + "(" * 5000, "\n1.2.3.4\n"]
    df = docs(spark, texts).withColumn("spans", F.lit("clash"))
    got = pii.find_pii(df).select("doc_id", pii.spelled("base").alias("b")).collect()
    for r in got:
        assert r["b"] == ",".join(f"{k}:{a}:{e}" for k, a, e in brute.base_spans(texts[r["doc_id"]]))
    assert len(got) == len(texts) and pii.find_pii(df.where("false")).count() == 0


def test_pii_contexts_discover_unseen_identifiers(spark):
    seen = [f"please call me on +1 ({300 + k}) 555-{4000 + k} soon" for k in range(6)]
    texts = [*seen, "please call me on (0551-77-x). thanks", "version 3.2 of it", "see page 1234 there"]
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(docs(spark, texts)).select("doc_id", pii.spelled("spans").alias("s")).collect()}
    at = texts[6].index("0551")
    assert got[6] == f"id:{at}:{at + len('0551-77-x')}" and got[7] == got[8] == "" and all(got[k].startswith("phone:") for k in range(6))
    masked = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(docs(spark, texts))).collect()}
    assert masked[0] == "please call me on [PHONE] soon" and masked[6] == "please call me on ([ID]). thanks" and masked[7] == texts[7]


@pytest.mark.parametrize("heavy", [False, True])
def test_graph_scores_match_brute_force(spark, monkeypatch, heavy):
    if heavy:
        monkeypatch.setattr(common, "HEAVY_ROWS", 4)
    rnd = random.Random(15)
    seeds = {f"i{k}" for k in range(40) if k % 3 == 0}
    edges = sorted({(f"p{rnd.randint(0, 12) if rnd.random() < 0.6 else 3}", f"i{rnd.randint(0, 39)}") for _ in range(160)})
    edges = [(p, i, i in seeds) for p, i in edges]
    got = pii.score_graph(spark.createDataFrame(edges, "pattern string, instance string, seed boolean"), rounds=3, support=3, least=0.6).collect()
    want = brute.graph_scores(edges, 3, 3, 0.6)
    assert len(got) == len(want)
    for r in got:
        assert (r["confidence"], r["score"]) == pytest.approx(want[r["pattern"], r["instance"]], abs=1e-9)


def test_pii_spreads_over_two_hops(spark):
    """Phones make the first pattern good; what it discovers makes a second one good, which no base match ever stands in."""
    first = [f"please call me on +1 ({300 + k}) 555-{4000 + k} soon" for k in range(12)] + [f"please call me on ext-{k}-77 soon" for k in range(4)]
    second = [f"the secret line is ext-{k}-77 as agreed" for k in range(4)]
    texts = [*first, *second, "the secret line is zz-9-x as agreed", "version 3.2-a of it"]
    found = {k: pii.find_pii(docs(spark, texts), rounds=k).select("doc_id", pii.spelled("spans").alias("s")).collect() for k in (1, 3)}
    new = {k: {r["doc_id"]: r["s"] for r in rows} for k, rows in found.items()}
    at = len("the secret line is ")
    assert new[1][20] == "" and new[3][20] == f"id:{at}:{at + len('zz-9-x')}" and new[3][21] == ""
    assert all(new[3][k].startswith("id:") for k in range(12, 20))


def test_pii_finds_planted_tokens_and_little_else(spark):
    rows = pii.find_pii(spark.read.parquet("/root/testdata/sf0.01/documents.parquet")).select("text", "spans").collect()
    tokens, others = 0, 0
    for r in rows:
        values = [r["text"][s["start"] : s["end"]].lower() for s in r["spans"] if s["kind"] == "id"]
        planted = re.findall('token = "([0-9a-f]{40})"', (r["text"] or "").lower())
        assert set(planted) <= set(values)
        tokens, others = tokens + len(planted), others + len(set(values) - set(planted))
    assert tokens >= 12 and others <= 2


def test_pii_contexts_of_long_words_gaps_and_ends(spark):
    long = "w" * 500
    texts = [f"{long} +49 30 1234567{k} x" for k in range(5)] + [f"id {' ' * 300}+49 30 7654321{k}" for k in range(5)] + ["+49 30 1111111", "4242424242424242", "password=hunter2 x"]
    got = {r["doc_id"]: r["s"] for r in pii.find_pii(docs(spark, texts)).select("doc_id", pii.spelled("base").alias("s")).collect()}
    assert all(got[k].startswith("phone:") for k in range(11)) and got[11] == "card:0:16" and got[12] == ""


def test_pii_keeps_clashing_columns_and_null_ids(spark):
    df = docs(spark, ["mail a@b.com", None]).withColumnsRenamed({"lang": "row", "source": "id", "n_chars": "text_key"}).withColumn("found", F.lit(1))
    df = df.unionByName(df.withColumn("doc_id", F.lit(None).cast("long")))
    got = pii.redact(pii.find_pii(df))
    assert got.columns == df.columns and sorted(r["text"] or "" for r in got.collect()) == ["", "", "mail [EMAIL]", "mail [EMAIL]"]


def test_pii_of_long_texts_is_that_of_their_chunks(spark):
    rnd = random.Random(4)
    words = ["é🙂", "call", "a@b.com", "1.2.3.4", "4242 4242 4242 4242", "+49 30 1234567", "12-", "x.", "7", "\n", "\t\t", "(555) 12", "k=v9"]
    texts = [" ".join(rnd.choice(words) for _ in range(3000)), "12. " * 3000 + "a@b.com", "w" * 9000 + " +49 30 1234567 " + "v" * 4096 + " 1.2.3.4"]
    df = docs(spark, texts)
    assert all("".join(c["text"] for c in r["c"]) == texts[r["doc_id"]] and len(r["c"]) == n for r, n in zip(df.select("doc_id", pii.chunks(F.col("text")).alias("c")).orderBy("doc_id").collect(), [len(pii_chunks(texts[0])), 1, 3], strict=True))
    found = pii.find_pii(df)
    for r in found.select("doc_id", pii.spelled("base").alias("b"), F.col("spans")).collect():
        assert r["b"] == ",".join(f"{k}:{a}:{e}" for k, a, e in brute.base_spans(texts[r["doc_id"]]))
    masked = {}
    for r in found.select("doc_id", "spans").collect():
        at, out, text = 0, "", texts[r["doc_id"]]
        for start, back, kind in sorted((s["start"], -s["end"], s["kind"]) for s in r["spans"]):
            if start >= at:
                out += text[at:start] + f"[{kind.upper()}]"
            at = max(at, -back)
        masked[r["doc_id"]] = out + text[at:]
    assert {r["doc_id"]: r["text"] for r in pii.redact(found).collect()} == masked


def pii_chunks(text):
    """The cut as a loop: at least CHUNK characters, then up to a safe character before white space."""
    out = []
    while text:
        end = next((k + 1 for k in range(pii.CHUNK, len(text) - 1) if text[k] not in " \t\n0123456789().+-" and text[k + 1] in " \t\n"), len(text))
        out, text = [*out, text[:end]], text[end:]
    return out


def test_redaction_merges_overlaps(spark):
    df = docs(spark, ["x 1.2.3.4@a.b.c y é", None, "+12 345 678 90, 4242424242424242"])
    got = {r["doc_id"]: r["text"] for r in pii.redact(pii.find_pii(df)).collect()}
    assert got[0] == "x [EMAIL] y é" and got[1] is None and "4242" not in got[2]


# shared


def test_a_heavy_key_is_spread_and_its_join_is_whole(spark, monkeypatch):
    monkeypatch.setattr(common, "HEAVY_ROWS", 10)
    rows = spark.createDataFrame([(7 if k % 3 == 0 else k % 50, k) for k in range(600)], "key long, row long")
    groups = saved(rows.groupBy("key").agg(F.count(F.lit(1)).alias("size")).where("key <> 5"))
    heavy = common.heavy_keys(groups, ["key"], "size")
    assert 7 in {r["key"] for r in heavy.collect()}
    want = sorted(tuple(r) for r in rows.join(groups, "key").collect())
    assert sorted(tuple(r) for r in common.spread_join(rows, groups, ["key"], heavy, ["row"]).collect()) == want
    assert common.heavy_keys(groups.where("false"), ["key"], "size") is None


def test_operators_on_heavy_groups(spark, monkeypatch):
    """Copies, near copies and a common passage hold most rows; every heavy path is taken."""
    monkeypatch.setattr(common, "HEAVY_ROWS", 3)
    rnd = random.Random(13)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 8)))
    base, passage = [word() for _ in range(60)], " ".join(word() for _ in range(20))
    texts = [" ".join(base)] * 30
    for k in range(40):
        t = list(base)
        t[k + 5] = f"near{k}"
        texts.append(" ".join(t))
    texts += [f"{word()} {word()} {passage} {word()} {word()}" for _ in range(30)] + [" ".join(word() for _ in range(30)) for _ in range(20)]
    df = docs(spark, texts)
    want, sizes = brute.components(list(enumerate(texts)), 4, 80)
    assert {r["doc_id"]: r["component_id"] for r in neardup.near_duplicates(df, size=4).collect()} == want
    assert {r["doc_id"]: r["group_size"] for r in exact.exact_duplicates(df, block_chars=16).collect()} == {k: texts.count(t) for k, t in enumerate(texts)}
    got = {r["doc_id"]: (r["n_bytes"], bytes(r["kept"])) for r in repeats.remove_repeats(df, length=40, reach=20).collect()}
    assert got == {k: (n, kept) for k, (n, _, _, kept) in enumerate(brute.removed(texts, 40))}
