"""The operators of this subpackage as registered queries, with production parameters, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, exact, lines, middle, neardup, packing, pii, quality, repeats, tokencount, topk, turns, urls

#: (verdict, host, path)
URL_RULES = [
    ("block", "net", "/"),
    ("allow", "example.net", "/en/"),
    ("block", "example.com", "/de/"),
    ("allow", "org", "/fr/"),
]


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _vocabulary("byte_bpe_50k.json")
    tokens = bpe.encode_texts(_table(spark, sf_dir, "documents").select("doc_id", "text"), path).drop("text")
    return bpe.with_digests(bpe.decode_ids(tokens, path)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op4_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = repeats.remove_repeats(_table(spark, sf_dir, "documents"), length=400)
    return cut.select(
        "doc_id",
        "n_bytes",
        (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.document_pieces(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"), end_id=1)
    lengths = pieces.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.assign_sequences(lengths)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = quality.quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))
    return scored.select("doc_id", "text_score", "meta_score", "score", "good")


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row is a page of its source, copies too: lines that five copies share go where those are 0.5 % of the source, as the SQL says."""
    kept = lines.drop_boilerplate_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "source", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_table(spark, sf_dir, "pages"), URL_RULES).select("page_id", "host", "path", "rule", "verdict")


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return topk.exact_top_k(vectors, vectors.where("vec_id % 50 = 0"), k=5)


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(_table(spark, sf_dir, "documents"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neardup.near_duplicates(_table(spark, sf_dir, "documents"), size=4, percent=80)


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(_table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    return found.select(
        "doc_id",
        *[pii.count_of(kind, "base").alias(f"n_{kind}") for kind in pii.BASE],
        F.sha2(pii.spelled("base").cast("binary"), 256).alias("base_sha256"),
        pii.spelled("spans").alias("spans"),
    )


def op11_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = middle.fim_pieces(_table(spark, sf_dir, "documents"), seed=7, fim_percent=100, spm_percent=50)
    return middle.digested(pieces)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = tokencount.token_counts(_table(spark, sf_dir, "documents"), _vocabulary("word_bpe_49k.json"))
    return counts.withColumn("over_limit", F.col("n_tokens") > 2048)


def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return turns.summaries_of_all(rows, turns.repair_summaries(turns.repair_conversations(turns.damage(rows))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe_codec": op1_bpe_codec,
    "op2_quality_classifier": op2_quality_classifier,
    "op3_line_dedup": op3_line_dedup,
    "op4_repeated_passages": op4_repeated_passages,
    "op5_best_fit_packing": op5_best_fit_packing,
    "op6_url_filter": op6_url_filter,
    "op7_exact_top_k": op7_exact_top_k,
    "op8_exact_dedup": op8_exact_dedup,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_pii": op10_pii,
    "op11_fill_in_middle": op11_fill_in_middle,
    "op12_token_counts": op12_token_counts,
    "op13_conversation_repair": op13_conversation_repair,
}

OP3_SQL = """
WITH parts AS (
  SELECT doc_id, source, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents
), held AS (
  SELECT source, l, count(*) AS pages FROM (
    SELECT source, unnest(list_distinct(ls)) AS l FROM parts
  ) WHERE trim(l) <> '' GROUP BY source, l
), hosts AS (
  SELECT source, count(*) AS host_pages FROM documents GROUP BY source
), often AS (
  SELECT h.source, list(h.l) AS bad FROM held h JOIN hosts t ON h.source IS NOT DISTINCT FROM t.source
  WHERE h.pages >= 5 AND h.pages / t.host_pages >= 0.005 GROUP BY h.source
), cut AS (
  SELECT p.doc_id, p.source, p.ls,
         list_filter(p.ls, lambda x: trim(x) = '' OR NOT list_contains(coalesce(o.bad, []), x)) AS kept
  FROM parts p LEFT JOIN often o ON p.source IS NOT DISTINCT FROM o.source
)
SELECT doc_id, source,
       CASE WHEN len(ls) = 1 AND ls[1] = '' THEN 0 ELSE len(ls) END::BIGINT AS n_lines,
       (len(ls) - len(kept))::BIGINT AS n_dropped,
       sha256(array_to_string(kept, chr(10))) AS kept_sha256
FROM cut
"""

OP6_SQL = r"""
WITH parsed AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'),
                            'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') AS path
  FROM pages
), ruled AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/'
  END AS rule FROM parsed
)
SELECT page_id, host, path, rule,
       CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict
FROM ruled
"""

OP7_SQL = """
WITH fine AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM fine q JOIN fine c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 5
"""

OP8_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.t) AS text_sha256
FROM d JOIN g USING (t)
"""

OP11_SQL = r"""
WITH drawn AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents
), units AS (
  SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS ls,
         ('0x' || substr(h, 1, 8))::BIGINT AS h1, ('0x' || substr(h, 9, 8))::BIGINT AS h2,
         ('0x' || substr(h, 17, 8))::BIGINT AS h3, ('0x' || substr(h, 25, 8))::BIGINT AS h4
  FROM drawn
), cut AS (
  SELECT *, len(ls) AS n, least(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS a, greatest(h1 % (len(ls) + 1), h2 % (len(ls) + 1)) AS b,
         CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain'
              WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form
  FROM units
), parts AS (
  SELECT doc_id, t, n, form, array_to_string(ls[1:a], '') AS p, array_to_string(ls[a + 1:b], '') AS m, array_to_string(ls[b + 1:n], '') AS s FROM cut
), put AS (
  SELECT *, CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END AS o FROM parts
)
SELECT doc_id, n::BIGINT AS n, form,
       CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
       sha256(o) AS output_sha256,
       sha256(CASE form WHEN 'plain' THEN o
         WHEN 'psm' THEN substr(o, 4, instr(o, '<S>') - 4) || substr(o, instr(o, '<M>') + 3) || substr(o, instr(o, '<S>') + 3, instr(o, '<M>') - instr(o, '<S>') - 3)
         ELSE substr(o, instr(o, '<P>') + 3, instr(o, '<M>') - instr(o, '<P>') - 3) || substr(o, instr(o, '<M>') + 3) || substr(o, 4, instr(o, '<P>') - 4) END) AS restored_sha256
FROM put
"""

ORACLE_SQL: dict[str, str] = {"op11_fill_in_middle": OP11_SQL, "op3_line_dedup": OP3_SQL, "op6_url_filter": OP6_SQL, "op7_exact_top_k": OP7_SQL, "op8_exact_dedup": OP8_SQL}
