"""Series of an exam: names and families, phase splits, spacing, identifiers and dates.

Events stand for slice headers (user: series, event: file order), parts for series descriptions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text
from ..operators import manifests, phases
from ..operators.spread import dealt_by
from .common import r6, table

GAP, TOLERANCE = 1500, 1e-3


def slice_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HHMMSS numbers of the events' times (some missing), a position that climbs and falls back."""
    e = table(spark, sf_dir, "events")
    clock = F.date_format("ts", "HHmmss")
    time = F.when((F.col("user_id") % 3 == 0) & (F.col("event_id") % 50 == 0), None).otherwise(clock)
    return e.select(
        F.col("user_id").alias("series"), F.col("event_id").alias("ord"), text.time_number(time, F.lit(None).cast("string")).alias("t"),
        F.when(F.col("user_id") % 2 == 0, (F.col("event_id") % 1000).cast("double")).otherwise(F.floor("value").cast("double")).alias("proj"),
    )


HEADERS_SQL = """WITH files AS (
  SELECT user_id AS series, event_id AS ord, CASE WHEN user_id % 3 = 0 AND event_id % 50 = 0 THEN NULL ELSE strftime(ts, '%H%M%S')::INTEGER END AS t,
         CASE WHEN user_id % 2 = 0 THEN (event_id % 1000)::DOUBLE ELSE floor(value)::DOUBLE END AS proj FROM events
), cons AS (
  SELECT series, ord, sum(j) OVER (PARTITION BY series ORDER BY ord)::INTEGER AS phase FROM (
    SELECT *, CASE WHEN abs(t - lag(t) OVER (PARTITION BY series ORDER BY ord)) >= 1500 THEN 1 ELSE 0 END AS j FROM files)
), clusters AS (
  SELECT series, t, sum(j) OVER (PARTITION BY series ORDER BY t)::INTEGER AS phase FROM (
    SELECT series, t, CASE WHEN t - lag(t) OVER (PARTITION BY series ORDER BY t) >= 1500 THEN 1 ELSE 0 END AS j FROM (
      SELECT DISTINCT series, t FROM files WHERE series NOT IN (SELECT series FROM files WHERE t IS NULL)))
), grouped AS (SELECT f.series, f.ord, c.phase FROM files f JOIN clusters c ON f.series = c.series AND f.t = c.t),
steps AS (SELECT *, proj - lag(proj) OVER (PARTITION BY series ORDER BY ord) AS step FROM files),
usual AS (SELECT series, CASE WHEN median(step) >= 0 THEN 1.0 ELSE -1.0 END AS direction FROM steps WHERE abs(step) > 1e-3 GROUP BY series),
rs AS (
  SELECT series, ord, sum(CASE WHEN direction * step < -1e-3 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ord)::INTEGER AS phase FROM steps JOIN usual USING (series)
), fine AS (
  SELECT series FROM (SELECT series, phase, count(*) AS size FROM rs GROUP BY ALL) GROUP BY series HAVING count(*) > 1 AND min(size) >= 2 AND max(size) - min(size) <= 2
), reset AS (SELECT * FROM rs WHERE series IN (SELECT series FROM fine))"""


def phase_split_consecutive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases.consecutive_split(slice_headers(spark, sf_dir), GAP)


def phase_split_grouped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phases.grouped_split(slice_headers(spark, sf_dir), GAP)


def phase_split_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions that run up again and again, one run an order."""
    return phases.reset_split(_runs(spark, sf_dir), TOLERANCE)


def _runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    orders = dealt_by(orders, ["o_custkey"], 4 * orders.count())  # some four files an order
    four = orders.withColumn("k", F.explode(F.sequence(F.lit(1), F.when(F.col("o_custkey") % 4 == 0, F.col("o_orderkey") % 4 + 3).otherwise(4).cast("int"))))
    return four.select(F.col("o_custkey").alias("series"), (F.col("o_orderkey") * 10 + F.col("k")).alias("ord"), F.col("k").cast("double").alias("proj"), (F.col("o_orderkey") % 86400).cast("int").alias("t"))


RUNS_SQL = """WITH files AS (
  SELECT o_custkey AS series, o_orderkey * 10 + k AS ord, k::DOUBLE AS proj FROM (
    SELECT *, unnest(range(1, (CASE WHEN o_custkey % 4 = 0 THEN o_orderkey % 4 + 3 ELSE 4 END)::BIGINT + 1)) AS k FROM orders)
), steps AS (SELECT *, proj - lag(proj) OVER (PARTITION BY series ORDER BY ord) AS step FROM files),
usual AS (SELECT series, CASE WHEN median(step) >= 0 THEN 1.0 ELSE -1.0 END AS direction FROM steps WHERE abs(step) > 1e-3 GROUP BY series),
rs AS (
  SELECT series, ord, sum(CASE WHEN direction * step < -1e-3 THEN 1 ELSE 0 END) OVER (PARTITION BY series ORDER BY ord)::INTEGER AS phase FROM steps JOIN usual USING (series)
), fine AS (
  SELECT series FROM (SELECT series, phase, count(*) AS size FROM rs GROUP BY ALL) GROUP BY series HAVING count(*) > 1 AND min(size) >= 2 AND max(size) - min(size) <= 2
)
SELECT * FROM rs WHERE series IN (SELECT series FROM fine)"""


def phase_split_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = phases.choose_split(slice_headers(spark, sf_dir), GAP, TOLERANCE)
    return found.withColumn("balance", r6("balance"))


CHOICE_SQL = f"""{HEADERS_SQL}, everything AS (
  SELECT series, ord, 0 AS phase, 'as_is' AS kind, 0 AS prio FROM files UNION ALL SELECT *, 'consecutive', 1 FROM cons
  UNION ALL SELECT *, 'reset', 2 FROM reset UNION ALL SELECT *, 'grouped', 3 FROM grouped
), rated AS (
  SELECT series, kind, prio, count(*) AS n_phases, min(size) AS least, min(size) / max(size) AS balance
  FROM (SELECT series, kind, prio, phase, count(*) AS size FROM everything GROUP BY ALL) GROUP BY series, kind, prio
), ranked AS (
  SELECT *, row_number() OVER (PARTITION BY series ORDER BY (least >= 2 AND (n_phases = 1 OR balance >= 0.5))::INT DESC, n_phases DESC, balance DESC, prio DESC) AS r FROM rated
)
SELECT series, kind, n_phases, round(balance, 6) AS balance FROM ranked WHERE r = 1"""


def phase_reorder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Consecutive phases numbered by their earliest time."""
    files = slice_headers(spark, sf_dir)
    return phases.reorder_by_time(files, phases.consecutive_split(files, GAP))


REORDER_SQL = f"""{HEADERS_SQL}, starts AS (SELECT series, phase, min(t) AS start FROM cons JOIN files USING (series, ord) GROUP BY ALL),
ranked AS (SELECT *, (row_number() OVER (PARTITION BY series ORDER BY start NULLS LAST, phase) - 1)::INTEGER AS new FROM starts)
SELECT c.series, c.ord, r.new AS phase FROM cons c JOIN ranked r USING (series, phase)"""


def exam_phase_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Phases of an exam's series one after the other: conversations as exams, roles as series."""
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role")
    return phases.exam_phase_index(rows, ["conv_id"], [F.desc("role")], "turn")


EXAM_PHASE_SQL = "SELECT conv_id, turn, role, (dense_rank() OVER (PARTITION BY conv_id ORDER BY role DESC, turn) - 1)::INTEGER AS phase_index FROM conversations"


def neighbour_spacing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = slice_headers(spark, sf_dir).withColumn("spacing_between", F.when(F.col("series") % 5 == 0, 2.5)).withColumn("thickness", F.lit(3.0))
    return phases.neighbour_spacing(files, ["spacing_between", "thickness"])


SPACING_SQL = f"""{HEADERS_SQL}, s AS (SELECT series, abs(proj - lag(proj) OVER (PARTITION BY series ORDER BY proj)) AS step FROM files)
SELECT series, coalesce(median(step) FILTER (step > 1e-8), CASE WHEN series % 5 = 0 THEN 2.5 END, 3.0)::DOUBLE AS spacing FROM s GROUP BY series"""


def _descriptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series names with camel case, phases, doses and contrast words around the parts' own."""
    p = table(spark, sf_dir, "part")
    name = F.concat(
        F.element_at(F.array(*[F.lit(x) for x in ("LEFT: ", "axT1 ", "Ph1 ", "sag STIR ", "dynMp ", "post2 ")]), (F.col("p_partkey") % 6 + 1).cast("int")), F.col("p_name"), F.lit(" "),
        F.element_at(F.array(*[F.lit(x) for x in ("pre-contrast", "Phase 3", "20 ml inject", "Repeat with 12", "ISPY2 vibe")]), (F.col("p_partkey") % 5 + 1).cast("int")),
    )
    return p.select("p_partkey", "p_brand", "p_type", "p_size", name.alias("name"))


NAMES_SQL = r"""WITH names AS (
  SELECT p_partkey, p_brand, p_type, p_size, ['LEFT: ', 'axT1 ', 'Ph1 ', 'sag STIR ', 'dynMp ', 'post2 '][(p_partkey % 6 + 1)::INT] || p_name || ' '
    || ['pre-contrast', 'Phase 3', '20 ml inject', 'Repeat with 12', 'ISPY2 vibe'][(p_partkey % 5 + 1)::INT] AS name FROM part
), r AS (
  SELECT *, trim(regexp_replace(lower(
    regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(replace(
      regexp_replace(trim(name), '([a-z0-9])([A-Z])', '\1 \2', 'g'), ':', ' '),
      'ispy\s*2', ' ', 'gi'), 'ph\s*\d+', ' ', 'gi'), 'phase\s*\d+', ' ', 'gi'), 'pre\s*--\s*registered', ' ', 'gi'),
      'pre[-\s]*contrast', ' ', 'gi'), 'post[-\s]*contrast', ' ', 'gi'), '(prepost|delayed|delay|post|pre|registered|repeat|test)', ' ', 'gi'),
      '(\d+(?:\.\d+)?)\s*ml', ' ', 'gi')), '[^a-z0-9]+', ' ', 'g')) AS normal FROM names
), tokens AS (
  SELECT *, list_sort(list_distinct(list_filter(string_split(normal, ' '), lambda t: t <> '' AND NOT regexp_full_match(t, '\d+') AND t NOT IN
    ('aligned','contrast','cropped','inject','injection','original','registered','repeat','test','to','uni','unilateral','with')))) AS tok FROM r
)"""


def series_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptions(spark, sf_dir)
    return d.select("p_partkey", "name", text.normalize_series_name(F.col("name")).alias("normal"), text.family_key(F.col("name")).alias("family_key"), F.size(text.family_tokens(F.col("name"))).alias("n_tokens"))


TOKENS_SQL = f"{NAMES_SQL} SELECT p_partkey, name, normal, array_to_string(tok, ' ') AS family_key, len(tok)::INTEGER AS n_tokens FROM tokens"


def family_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name against the first one of its brand."""
    d = _descriptions(spark, sf_dir).select("p_partkey", "p_brand", text.family_tokens(F.col("name")).alias("tokens"))
    anchor = d.groupBy("p_brand").agg(F.min_by("tokens", "p_partkey").alias("anchor"))
    return d.join(anchor, "p_brand").select("p_partkey", r6(text.family_similarity(F.col("anchor"), F.col("tokens"))).alias("similarity"))


SIMILARITY_SQL = f"""{NAMES_SQL}, a AS (SELECT p_brand, arg_min(tok, p_partkey) AS anchor FROM tokens GROUP BY p_brand),
o AS (SELECT p_partkey, tok, anchor, len(list_intersect(tok, anchor)) AS c FROM tokens JOIN a USING (p_brand))
SELECT p_partkey, round(CASE WHEN len(tok) = 0 OR len(anchor) = 0 THEN 0.0 ELSE greatest(2.0 * c / (len(tok) + len(anchor)), c / len(anchor)) END, 6) AS similarity FROM o"""


def text_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptions(spark, sf_dir)
    dims = F.concat_ws("x", F.col("p_size").cast("string"), F.lit("64"), (F.col("p_size") % 3).cast("string"))
    folder = F.concat_ws("-", F.col("p_partkey").cast("string"), F.col("p_brand"), F.col("p_type"), F.lit("9"))
    return d.select(
        "p_partkey", text.sequence_family(F.col("name")).alias("family"), text.folder_description(folder).alias("folder"), text.phase_number(F.col("name")).alias("phase"),
        F.array_join(text.parse_dims(dims).cast("array<string>"), ",").alias("dims"), text.parse_bool(F.when(F.col("p_partkey") % 2 == 0, " Yes ").otherwise("no")).alias("flag"),
        F.size(text.split_list(F.concat_ws(" | ", F.col("p_brand"), F.lit(""), F.col("p_type")))).alias("n_listed"), text.slug(F.col("name")).alias("slug"),
    )


TEXT_RULES_SQL = NAMES_SQL + r"""SELECT p_partkey, lower(trim(regexp_replace(regexp_replace(trim(regexp_replace(name, '\s+', ' ', 'g')), '^(left|right|lt|rt|bilateral)\s*[-: ]+\s*', '', 'i'), '\s+', ' ', 'g'))) AS family,
  p_brand || '-' || p_type AS folder,
  coalesce(try_cast(nullif(regexp_extract(name, 'ph\s*(\d+)', 1, 'i'), '') AS INT), try_cast(nullif(regexp_extract(name, 'post\s*(\d+)', 1, 'i'), '') AS INT),
    CASE WHEN contains(' ' || lower(name) || ' ', ' pre ') OR lower(name) LIKE '% pre' OR contains(lower(name), 'pre -- registered') THEN 0 END) AS phase,
  p_size || ',64,' || (p_size % 3) AS dims, p_partkey % 2 = 0 AS flag, 2 AS n_listed,
  regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '_', 'g'), '^_+|_+$', '', 'g') AS slug FROM names"""


def plane_and_contrast_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _descriptions(spark, sf_dir)
    te, tr = F.when(F.col("p_partkey") % 7 != 0, (F.col("p_size") * 2).cast("double")), (F.col("p_size") * 100).cast("double")
    c = text.contrast_class(F.col("name"), tr, te)
    return d.select("p_partkey", text.infer_plane(F.col("name"), F.lit("axial_by_header")).alias("plane"), c["contrast"].alias("contrast"), c["reason"].alias("reason"))


PLANE_SQL = NAMES_SQL + r""", v AS (SELECT *, lower(name) AS low, CASE WHEN p_partkey % 7 <> 0 THEN p_size * 2.0 END AS te, p_size * 100.0 AS tr FROM names),
w AS (SELECT *, regexp_matches(low, '\b(t1|spgr|fspgr|ir[-_ ]?spgr|3d\s*f?gre|3dfgre|fgre|vibe|flash|tfl|thrive|dyn|dynamic|dce)\b') AS t1, coalesce(tr <= 1200 AND te <= 30, false) AS short,
  regexp_matches(low, '\b(sub|subtract|subtraction|mip|cad|ser|pe1?|segmentation|mask|voi)\b') AS derived, regexp_matches(low, '\b(t2|stir|tirm|ssfse|frfse|tse\s*t2|fse\s*t2)\b') AS t2 FROM v)
SELECT p_partkey, CASE WHEN regexp_matches(low, '\bsag(it+al)?\b') THEN 'sagittal' WHEN regexp_matches(low, '\b(ax|axial|tra|transverse)\b') THEN 'axial'
    WHEN regexp_matches(low, '\bcor(on?al)?\b') THEN 'coronal' ELSE 'axial_by_header' END AS plane,
  CASE WHEN derived THEN 'derived_or_map' WHEN t2 OR te >= 50 THEN 't2_like' WHEN t1 OR short THEN 't1_like' ELSE 'unknown' END AS contrast,
  CASE WHEN derived THEN 'derived_keyword' WHEN t2 THEN 't2_keyword' WHEN te >= 50 THEN 'long_te' WHEN t1 AND short THEN 't1_keyword;short_tr_te' WHEN t1 THEN 't1_keyword'
       WHEN short THEN 'short_tr_te' ELSE 'no_t1_t2_clue' END AS reason FROM w"""


def id_and_date_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    day = F.date_format("o_orderdate", "MM-dd-yyyy")
    patient = F.concat(F.lit("TRIAL-"), F.col("o_custkey").cast("string"))
    other = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(F.col("o_orderkey") % 3 == 1, F.date_format("o_orderdate", "M/d/yyyy")).otherwise(F.lit("not/known"))
    return o.select(
        "o_orderkey", text.canonical_id(patient, "TRIAL").alias("canonical"), text.subject_id(text.canonical_id(patient, "TRIAL")).alias("subject"), text.subject_id(patient, "SITE-BR").alias("site_subject"),
        text.iso_date(F.when(F.col("o_orderkey") % 5 == 0, F.lit("02-31x2020")).otherwise(day)).cast("string").alias("iso"), text.folder_date(other).alias("folder"),
        text.date_prefix(F.when(F.col("o_orderkey") % 2 == 0, F.concat(day, F.lit("-MRI"))).otherwise(F.lit("MRI"))).alias("prefix"),
        text.case_id(patient, day, F.lit(3)).alias("case_id"), text.time_number(F.concat(F.date_format("o_orderdate", "HHmmss"), F.lit(".25")), F.lit(None).cast("string")).alias("time"),
    )


IDS_SQL = r"""SELECT o_orderkey, 'TRIAL_' || o_custkey AS canonical, 'TRIAL-' || o_custkey AS subject, printf('SITE-BR-%02d', o_custkey) AS site_subject,
  CASE WHEN o_orderkey % 5 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS iso,
  CASE WHEN o_orderkey % 3 = 2 THEN 'not-known' ELSE strftime(o_orderdate, '%m-%d-%Y') END AS folder,
  CASE WHEN o_orderkey % 2 = 0 THEN strftime(o_orderdate, '%m-%d-%Y') ELSE 'unknown_date' END AS prefix,
  'trial_' || o_custkey || '_' || strftime(o_orderdate, '%m%d%Y') || '_0003' AS case_id, strftime(o_orderdate, '%H%M%S')::INTEGER AS time FROM orders"""


def description_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts by section with blanks as missing."""
    p = table(spark, sf_dir, "part").select("p_type", F.when(F.col("p_size") % 4 == 0, " ").otherwise(F.col("p_brand")).alias("p_brand"))
    return manifests.value_counts(p, "p_type", "p_brand")


COUNTS_SQL = """SELECT 'p_type' AS section, p_type AS key, count(*) AS n FROM part GROUP BY ALL
UNION ALL SELECT 'p_brand', CASE WHEN p_size % 4 = 0 THEN 'missing' ELSE p_brand END, count(*) FROM part GROUP BY ALL"""

QUERIES = {
    "phase_split_consecutive": phase_split_consecutive, "phase_split_grouped": phase_split_grouped, "phase_split_reset": phase_split_reset,
    "phase_split_choice": phase_split_choice, "phase_reorder": phase_reorder, "exam_phase_index": exam_phase_index, "neighbour_spacing": neighbour_spacing,
    "series_tokens": series_tokens, "family_similarity": family_similarity, "text_rules": text_rules, "plane_and_contrast_rules": plane_and_contrast_rules,
    "id_and_date_normalize": id_and_date_normalize, "description_counts": description_counts,
}
ORACLE_SQL = {
    "phase_split_consecutive": f"{HEADERS_SQL} SELECT * FROM cons", "phase_split_grouped": f"{HEADERS_SQL} SELECT * FROM grouped", "phase_split_reset": RUNS_SQL,
    "phase_split_choice": CHOICE_SQL, "phase_reorder": REORDER_SQL, "exam_phase_index": EXAM_PHASE_SQL, "neighbour_spacing": SPACING_SQL,
    "series_tokens": TOKENS_SQL, "family_similarity": SIMILARITY_SQL, "text_rules": TEXT_RULES_SQL, "plane_and_contrast_rules": PLANE_SQL,
    "id_and_date_normalize": IDS_SQL, "description_counts": COUNTS_SQL,
}
