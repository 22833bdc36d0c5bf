"""Fill-in-middle, token counts and conversation repair against plain versions."""

import random
import re
import zlib
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from cohortry.llm import middle, queries, tokencount, turns
from tests.llm import brute
from tests.llm.test_operators import DOC, ODD, docs

SF = "/root/testdata/sf0.001"
WORDS = public_tokenizers.path("word_bpe_49k.json")


# 11: fill in the middle


def fim(doc_id, text, seed=7, percent=100, spm=50):
    text = text or ""
    units = re.findall(r"[^\n]*\n|[^\n]+", text)
    digest = brute.sha(f"{seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]
    a, b = sorted((h[0] % (len(units) + 1), h[1] % (len(units) + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= percent:
        return len(units), "plain", None, None, text
    p, m, s = ("".join(x) for x in (units[:a], units[a:b], units[b:]))
    form = "spm" if h[3] % 100 < spm else "psm"
    return len(units), form, len(p), len(m), f"<S>{s}<P>{p}<M>{m}" if form == "spm" else f"<P>{p}<S>{s}<M>{m}"


FIM_TEXTS = [*ODD, "\n", "\n\n\n", "no break", "a\nb", "é\n🙂\nz\n", "<P>\nx", "a<S>b\n", "< P>\n<", "<S\n>\n<P\n"]


@pytest.mark.parametrize("chunk", [3, 1 << 16])
def test_fim_matches_brute_force(spark, chunk):
    rnd = random.Random(21)
    texts = FIM_TEXTS + ["".join(rnd.choice(["\n", "a", "é", "🙂", "<", "P>", "S>", "M"]) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    df = docs(spark, texts).withColumnsRenamed({"lang": "key", "source": "place", "n_chars": "copies"})
    df = df.unionByName(df.where("doc_id % 7 = 0")).unionByName(df.where("doc_id = 8").withColumn("doc_id", F.lit(None).cast("long")))
    for percent in (100, 60):
        pieces = middle.fim_pieces(df, fim_percent=percent, chunk=chunk)
        want = Counter((r[0], *fim(r[0], r[1], percent=percent)) for r in df.select("doc_id", "text").collect())
        got = middle.assembled(pieces)
        assert Counter(tuple(r) for r in got.collect()) == want
        back = middle.restored(got).select("doc_id", "text").collect()
        assert all(r["text"] == (texts[8 if r["doc_id"] is None else r["doc_id"]] or "") for r in back)
        digests = Counter(tuple(r) for r in middle.digested(pieces).collect())
        texts_of = {(r[0], *fim(r[0], r[1], percent=percent)): r[1] or "" for r in df.select("doc_id", "text").collect()}
        assert digests == Counter({(*k[:5], brute.sha(k[5]), brute.sha(texts_of[k])): n for k, n in want.items()})


def test_fim_pieces_are_whole_units_of_bounded_size():
    text = ("x" * 100 + "\n").encode() * 5000 + b"y" * (3 * middle.CHUNK) + b"\nend"
    for form in ("psm", "spm", "plain"):
        pieces = list(middle.output_pieces(text, form, 101 * 700, 101 * 4000))
        assert max(map(len, pieces)) <= middle.CHUNK
        assert all(p.endswith(b"\n") or p in middle.MARKS or b"y" in p or p == b"\nend" for p in pieces)
    assert b"".join(middle.output_pieces(text, "plain", 0, 0)) == text


def test_fim_of_a_very_long_text_and_no_rows(spark):
    texts = ["line of text\n" * 400_000, "z" * 2_000_000, None]
    got = {r["doc_id"]: tuple(r)[1:] for r in middle.digested(middle.fim_pieces(docs(spark, texts))).collect()}
    for k, t in enumerate(texts):
        *head, out = fim(k, t)
        assert got[k] == (*head, brute.sha(out), brute.sha(t or ""))
    assert middle.digested(middle.fim_pieces(docs(spark, []))).count() == 0


def test_fim_of_a_row_repeated_many_times_is_few_pieces(spark):
    df = spark.range(0, 20_000, 1, 2).select(F.lit(5).cast("long").alias("doc_id"), F.lit("a\nb\nc\n").alias("text"))
    pieces = middle.fim_pieces(df)
    assert pieces.count() <= 40 and middle.digested(pieces).groupBy("output_sha256", "restored_sha256").count().collect()[0]["count"] == 20_000


# 12: token counts


def library_counts(texts):
    library = Tokenizer.from_file(WORDS)
    library.no_truncation(), library.no_padding()
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_token_counts_equal_the_library(spark):
    rnd = random.Random(22)
    marks = list(" \n\t'aàbsTLL3½!…日́​Σσİ²Ⅷ\x00\x1c\x85") + ["<|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "don't", "WE'LL"]
    texts = ODD + ["".join(rnd.choice(marks) for _ in range(rnd.randint(0, 40))) for _ in range(300)]
    texts += [f for c in map(chr, range(0x250)) for f in (f"word{c}x {c}",)] + ["word " * 30_000, "q" * 100_000 + " ok", "q" * 100_000, "\0" + "a" * 64]
    df = docs(spark, texts).withColumnsRenamed({"lang": "rest", "source": "known", "n_chars": "pretoken"})
    got = tokencount.token_counts(df.unionByName(df.where("doc_id % 5 = 0")).repartition(3), WORDS).collect()
    want = library_counts(texts)
    assert Counter((r["doc_id"], r["n_bytes"], r["n_tokens"]) for r in got) == Counter(
        (k, len((t or "").encode()), want[k]) for k, t in enumerate(texts) for _ in range(2 if k % 5 == 0 else 1)
    )
    nulls = docs(spark, ["a b", None]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r["n_tokens"] for r in tokencount.token_counts(nulls, WORDS).collect()) == [0, 2]
    assert tokencount.token_counts(docs(spark, []), WORDS).count() == 0


@pytest.mark.parametrize("common", [0.0, 1.0])
def test_token_counts_whatever_is_common(spark, monkeypatch, common):
    """All pre-tokens that stand in two texts are joined where they are made, or none."""
    monkeypatch.setattr(tokencount, "COMMON", common)
    texts = ["the cat sat", "the dog's day", "a cat, a dog", "x" * 70, "x" * 70]
    got = {r["doc_id"]: r["n_tokens"] for r in tokencount.token_counts(docs(spark, texts), WORDS).collect()}
    assert [got[k] for k in range(5)] == library_counts(texts)


def test_each_pretoken_is_counted_once(spark):
    pretokens = tokencount.pretoken_pieces(docs(spark, ["the cat the", "the dog", "y" * 80 + " " + "y" * 80, None]), WORDS)
    rows = {r["pretoken"]: r["uses"] for r in pretokens.collect()}
    assert len(rows) == pretokens.count() == 4 and rows["the"] == 2 and all(len(k) <= 65 for k in rows)


def test_token_count_query_on_the_tables(spark):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    want = dict(zip(texts, library_counts(list(texts.values())), strict=True))
    got = queries.op12_token_counts(spark, SF).collect()
    assert {r["doc_id"]: (r["n_bytes"], r["n_tokens"], r["over_limit"]) for r in got} == {k: (len((t or "").encode()), want[k], want[k] > 2048) for k, t in texts.items()} and len(got) == len(texts)


# 13: conversations


def cheapest(rows):
    """(cost, edits, repaired roles by edit) over all edits, by a search that merges nothing; rows: (initial, must go, truncated)."""
    best = [(2 * len(rows), "D" * len(rows), [])]

    def walk(k, cost, edits, roles):
        if cost > best[0][0]:
            return
        if k == len(rows):
            if re.fullmatch("(s?(ua)+)?", "".join(roles)):
                best[0] = min(best[0], (cost, edits, roles))
        else:
            initial, must_go, truncated = rows[k]
            walk(k + 1, cost + 2, edits + "D", roles)
            if not must_go:
                if initial:  # a row without a role's initial is not kept as it is
                    walk(k + 1, cost + 5 * truncated, edits + "K", [*roles, initial])
                for r in "ua":
                    walk(k + 1, cost + 1 + 5 * truncated, edits + "R", [*roles, r])
        for r in "ua":
            walk(k, cost + 5, edits + "I", [*roles, r])

    walk(0, 0, "", [])
    return best[0]


def damaged(rows):
    out = []
    for conv, turn, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        kind = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        text, role = show(text), show(role)
        if kind == 1:
            text = ""
        if kind == 2:
            text = re.sub("[.!?]", "", text)
        if kind == 4:
            role = "user"
        out += [(conv, turn, role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)
    return out


def repaired(rows):
    """conv -> the query's columns, for few rows a conversation."""
    out = {}
    left = damaged(rows)
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in left if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], brute_said(r)))
        seen, steps, faults = set(), [], Counter()
        for _, _, role, text in own:
            shown = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
            seen.add((role, text))
            faults[fault] += 1
            steps.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
        cost, edits, roles = cheapest(steps)
        lines, k, r = [], 0, 0
        for e in edits:
            if e == "I":
                lines.append({"u": "user", "a": "assistant"}[roles[r]] + ":")
            elif e == "R":
                lines.append({"u": "user", "a": "assistant"}[roles[r]] + ":" + own[k][3])
            elif e == "K":
                lines.append(own[k][2] + ":" + own[k][3])
            k, r = k + (e != "I"), r + (e != "D")
        numbers = [x[1] for x in own if x[1] is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:], strict=False))
        out[conv] = (gaps, faults["blank"], faults["duplicate"], faults["truncated"], illegal, cost, edits, brute.sha("\n".join(lines)))
    return out


def brute_said(r):
    conv = "" if r[0] is None else f"={r[0]}"
    return brute.sha("|".join([str(len(conv)), conv, str(len(r[2])), r[2], r[3]]))


def summaries(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"said": F.lit(1), "place": F.lit("x"), "conv": F.lit(2)})
    got = turns.summaries_of_all(df, turns.repair_summaries(turns.repair_conversations(turns.damage(df)))).collect()
    assert len(got) == len({r["conv_id"] for r in got})
    return {r["conv_id"]: tuple(r)[1:] for r in got}


def test_repair_matches_all_edits(spark):
    rnd = random.Random(23)
    said = ["hello.", "why?", "cut off", "", " \t", "ok!", "ok! \n", "a.b", None]
    rows = []
    for conv in [*range(160), None]:
        turn = rnd.randint(0, 3)
        for _ in range(rnd.randint(1, 5)):
            rows.append((conv, None if rnd.random() < 0.05 else turn, rnd.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rnd.choice(said)))
            turn += rnd.choice([0, 1, 1, 1, 2])
    assert summaries(spark, rows) == repaired(rows)


def test_repair_query_on_the_tables(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r["conv_id"]: tuple(r)[1:] for r in queries.op13_conversation_repair(spark, SF).collect()}
    assert got == repaired(rows)


def plain_search(rows):
    """The same search with whole strings and no pruning."""
    follow = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
    at = {0: (0, "")}
    inserted = lambda at: [(s, c, e) for s, (c, e) in at.items()]

    def closed(at):
        at = dict(at)
        for _ in range(4):
            for s, c, e in inserted(at):
                for r in "ua":
                    if r in follow[s]:
                        at[follow[s][r]] = min(at.get(follow[s][r], (1 << 60, "")), (c + 5, e + "I"))
        return at

    for initial, must_go, truncated in rows:
        new = {}
        put = lambda s, c, e: new.__setitem__(s, min(new.get(s, (1 << 60, "")), (c, e)))
        for s, (c, e) in at.items():
            put(s, c + 2, e + "D")
        if not must_go:
            for s, (c, e) in closed(at).items():
                if initial in follow[s]:
                    put(follow[s][initial], c + 5 * truncated, e + "K")
                for r in "ua":
                    if r in follow[s]:
                        put(follow[s][r], c + 1 + 5 * truncated, e + "R")
        at = new
    return min(v for s, v in closed(at).items() if s in (0, 3))


@pytest.mark.parametrize("odds", [(8, 8, 1, 1), (1, 1, 1, 1), (9, 1, 1, 0), (1, 0, 0, 9)])
def test_search_holds_little_and_equals_the_plain_one(odds):
    rnd = random.Random(24)
    rows = [(i, i == "x" or rnd.random() < 0.05, rnd.random() < 0.1) for i in rnd.choices("uasx", odds, k=1500)]
    if odds[0] == 8:
        rows = [("ua"[k % 2] if rnd.random() < 0.9 else i, g, t) for k, (i, g, t) in enumerate(rows)]
    search, out, most = turns.Repair(), [], 0
    for k, (initial, must_go, truncated) in enumerate(rows):
        out += search.step(k, initial, must_go, truncated)
        most = max(most, search.size())
    out += search.end()
    cost, edits = plain_search(rows)
    price = {"K": 0, "R": 1, "D": 2, "I": 5}
    assert "".join(e for e, _, _ in out) == edits
    assert sum(price[e] + 5 * (k is not None and rows[k][2] and e != "D") for e, _, k in out) == cost
    assert [k for _, _, k in out if k is not None] == list(range(1500))
    # rows of one role that alternate by reroling keep two survivors apart: which row to delete is open until the end
    assert most < (200 if odds[2] or odds[1] else 1500)


def test_repair_of_long_conversations_texts_and_no_rows(spark):
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", f"turn {k}.") for k in range(3000)] + [(2, 0, "user", "x" * 1_000_000 + "."), (2, 1, "assistant", "y.")]
    rows += [(3, 5, "user", "again.")] * 400
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string")
    got = {r["conv_id"]: r for r in turns.repair_summaries(turns.repair_conversations(df)).collect()}
    assert got[1]["audit"] == "K" * 3000 and got[2]["cost"] == 0 and got[2]["repaired_sha256"] == brute.sha("user:" + "x" * 1_000_000 + ".\nassistant:y.")
    assert got[3]["duplicate"] == 399 and got[3]["audit"] == "D" * 400 and got[3]["cost"] == 800
    edits = turns.repair_conversations(df.where("conv_id = 2")).orderBy("place").collect()
    assert [(r["edit"], r["role"], r["was"], r["fault"]) for r in edits] == [("K", "user", "u", None), ("K", "assistant", "a", None)]
    none = df.where("false")
    assert turns.summaries_of_all(none, turns.repair_summaries(turns.repair_conversations(turns.damage(none)))).count() == 0
