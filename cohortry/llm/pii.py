"""Personal data: base patterns with exact places, and identifiers that their contexts give away.

Everything here is DataFrame functions. Base matches take their places from the texts between them. Base matches,
and strings of a secret's shape, are also the seeds of a bootstrap: the words before, around and behind a seed make
lexical patterns, patterns and the strings in their slots make a graph, and scores pass to and fro over it. What is
discovered supports further patterns in the next round. What stands in the slot of a pattern that nearly always
surrounds personal data is reported too, as kind ``id``; a secret's shape alone is not.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import discard, heavy_keys, saved, spread_join, text_of

#: Fixed values. Each begins where the plain pattern would: not inside a run that an earlier start would have taken.
BASE = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = [*BASE, "id"]
OCTETS = r"^0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])(?:\.0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])){3}$"
#: A string that may be an identifier: no white space, a digit or ``@`` in it.
TOKEN = r"(?<!\S)[^\s0-9@]*+[0-9@]\S*+"
#: What a token sheds at its ends.
HEAD, TAIL = r"^[(\[{<\"'“‘#*&%$|]+", r"[)\]}>\"'”’.,;:!?#*&%$|]+$"
#: A name glued to its value, as in ``key=value``.
GLUED = r"^[A-Za-z_.-]+[=:](?!/)[(\[{<\"'“‘]*"
#: Shape of a secret: a long run of letters and digits, both in it.
SECRET = r"^(?=\S*[0-9])(?=\S*[A-Za-z])[A-Za-z0-9+/_-]{20,}=*$"
#: Characters on either side of a slot in which the words of its patterns are looked for. Words that do not fit in make
#: no pattern; the ends of a text count as words.
REACH = 200
#: A long text is looked at in chunks of at least so many characters, so that work is linear in its length. A chunk ends at white
#: space behind a character that no pattern carries on over, so a chunk's matches are the whole text's.
CHUNK = 4096
CHUNKS = r"(?s).{1,%d}+(?:.*?[^\s0-9().+-](?=\s)|.*+\z)" % CHUNK


def _digits(match: Column) -> Column:
    return F.regexp_replace(match, "[^0-9]", "")


def luhn_valid(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check."""
    back = F.reverse(digits)
    values = F.transform(
        F.sequence(F.lit(1), F.length(digits)),
        lambda i: F.substring(back, i, F.lit(1)).try_cast("int") * F.when(i % 2 == 0, 2).otherwise(1),
    )
    return F.aggregate(values, F.lit(0), lambda total, v: total + v - F.when(v > 9, 9).otherwise(0)) % 10 == 0


def _valid(kind: str, match: Column) -> Column:
    if kind == "ip":
        return match.rlike(OCTETS)
    size = F.length(_digits(match))
    if kind == "card":
        return F.when(size.between(13, 19), luhn_valid(_digits(match))).otherwise(False)
    return size.between(9, 15) if kind == "phone" else F.lit(True)


def _places(text: Column, pattern: str, keep, gate: Column) -> Column:
    """Array of struct(start, end, value) of the matches that ``keep`` holds for; offsets in code points."""
    none = F.array().cast("array<struct<start:bigint,end:bigint,value:string>>")
    parts = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("match"), F.split(text, pattern, -1).alias("gap"))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), none.alias("found"))

    def step(state: Column, part: Column) -> Column:
        match, begin = part["match"], state["at"] + F.length(part["gap"])
        end = begin + F.length(match)
        place = F.array(F.struct(begin.alias("start"), end.alias("end"), match.alias("value")))
        found = F.when(match.isNotNull() & keep(match), F.concat(state["found"], place)).otherwise(state["found"])
        return F.struct(F.coalesce(end, begin).alias("at"), found.alias("found"))

    return F.when(gate, F.aggregate(parts, start, step, lambda state: state["found"])).otherwise(none)


def chunks(text: Column) -> Column:
    """Array of struct(at, text): the chunks of a text with their places in it; they concatenate to the text."""
    parts = F.when(F.length(text) <= CHUNK, F.array(text)).otherwise(F.regexp_extract_all(text, F.lit(CHUNKS), F.lit(0)))
    start = F.struct(F.lit(0).cast("bigint").alias("at"), F.array().cast("array<struct<at:bigint,text:string>>").alias("all"))
    step = lambda s, x: F.struct((s["at"] + F.length(x)).alias("at"), F.concat(s["all"], F.array(F.struct(s["at"].alias("at"), x.alias("text")))).alias("all"))
    return F.aggregate(parts, start, step, lambda s: s["all"])


def _moved(places: Column, by: Column) -> Column:
    return F.transform(places, lambda p: F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end"), p["value"].alias("value")))


def base_spans(text: Column) -> dict[str, Column]:
    """Kind -> array of struct(start, end, value): leftmost matches that do not overlap, failing ones dropped. ``text``: a chunk, or a short text."""
    digit = text.rlike("[0-9]")
    gates = {"email": F.contains(text, F.lit("@")), "ip": digit, "card": digit, "phone": F.contains(text, F.lit("+")) & digit}
    return {k: _places(text, p, lambda m, k=k: _valid(k, m), gates[k]) for k, p in BASE.items()}


def _plain(words: Column) -> Column:
    """Lower-cased, digits as 0, single spaces; null if empty."""
    return F.nullif(F.lower(F.regexp_replace(F.regexp_replace(F.trim(words), r"\s+", " "), "[0-9]", "0")), F.lit(""))


def _patterns(near: Column, start: Column, end: Column, first: Column, last: Column) -> Column:
    """Array of the lexical patterns of a slot: two words before it, one on either side, two behind it.

    ``near``: text around the slot, ``REACH`` characters on either side of it or up to an end of the whole text; ``start``, ``end``:
    the slot's place in ``near``; ``first``, ``last``: whether the whole text begins or ends within ``REACH``."""
    begin = F.greatest(F.lit(0), start - REACH)
    before = F.concat(F.when(first, F.lit("^ ^ ")).otherwise(""), F.substring(near, (begin + 1).cast("int"), (start - begin).cast("int")))
    after = F.concat(F.substring(near, (end + 1).cast("int"), F.lit(REACH)), F.when(last, F.lit(" $ $")).otherwise(""))
    opening, closing = r"\s*[(\[{<\"'“‘]*$", r"^[)\]}>\"'”’]*\s*"
    two_before = _plain(F.regexp_extract(before, r"(?:^|\s)(\S+\s+\S+?)" + opening, 1))
    one_before = _plain(F.regexp_extract(before, r"(?:^|\s)(\S+?)" + opening, 1))
    one_after = _plain(F.regexp_extract(after, closing + r"(\S+)(?=\s)", 1))
    two_after = _plain(F.regexp_extract(after, closing + r"(\S+\s+\S+)(?=\s|$)", 1))
    slot = F.lit(" _ ")
    return F.array_compact(F.array(F.concat(two_before, slot), F.concat(one_before, slot, one_after), F.concat(slot, two_after)))


def slots(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id``, ``text_key``, ``start``, ``end``, ``pattern``, ``instance``, ``base``, ``seed``: base matches and tokens beside
    them, a row for each pattern. ``seed``: a base match, or of a secret's shape."""
    texts = docs.select(F.col(id_col).alias("id"), text_of(text_col).alias("text")).where(F.col("text").rlike("[0-9@]"))
    cut = texts.select("id", F.xxhash64("text").alias("text_key"), F.length("text").alias("n"), chunks(F.col("text")).alias("chunks"))
    beside = lambda i: F.coalesce(F.try_element_at("chunks", i)["text"], F.lit(""))
    # a chunk with what lies within reach of it; the chunk before it, if there is one, is longer than that
    edges = F.transform("chunks", lambda c, i: F.struct(c["at"].alias("at"), c["text"].alias("text"), F.when(i > 0, F.right(beside(F.greatest(i, F.lit(1))), F.lit(REACH))).otherwise("").alias("left"), F.left(beside(i + 2), F.lit(REACH)).alias("right")))
    base = cut.select("id", "text_key", "n", F.explode(edges).alias("c")).select("id", "text_key", "n", "c.*").where(F.col("text").rlike("[0-9@]"))
    found = base.select(*base.columns, F.concat(*base_spans(F.col("text")).values()).alias("seeds"), _places(F.col("text"), TOKEN, lambda m: F.length(m) >= 4, F.lit(True)).alias("tokens"))
    head = lambda v: F.coalesce(F.nullif(F.regexp_extract(v, GLUED, 0), F.lit("")), F.regexp_extract(v, HEAD, 0))
    opened = F.transform("tokens", lambda t: F.struct((t["start"] + F.length(head(t["value"]))).alias("start"), F.substring(t["value"], F.length(head(t["value"])) + 1, F.length(t["value"])).alias("value")))
    trimmed = F.transform(opened, lambda t: F.struct(t["start"].alias("start"), F.regexp_replace(t["value"], TAIL, "").alias("value")))
    placed = F.transform(trimmed, lambda t: F.struct(t["start"].alias("start"), (t["start"] + F.length(t["value"])).alias("end"), t["value"].alias("value")))
    free = lambda t: ~F.exists("seeds", lambda s: (s["start"] < t["end"]) & (t["start"] < s["end"]))
    fits = lambda t: (F.length(t["value"]) >= 4) & t["value"].rlike("[0-9@]") & free(t)
    slot = lambda s, base: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["value"].alias("value"), F.lit(base).alias("base"))
    both = F.concat(F.transform("seeds", lambda s: slot(s, True)), F.transform(F.filter(placed, fits), lambda t: slot(t, False)))
    near, shift = F.concat("left", "text", "right"), F.length("left")
    start, end = F.col("at") + F.col("s.start"), F.col("at") + F.col("s.end")
    each = found.select("id", "text_key", "n", "at", shift.alias("shift"), near.alias("near"), F.explode(both).alias("s"))
    listed = _patterns(F.col("near"), F.col("s.start") + F.col("shift"), F.col("s.end") + F.col("shift"), start <= REACH, F.col("n") <= end + REACH)
    each = each.select("id", "text_key", start.alias("start"), end.alias("end"), "s.value", "s.base", F.explode(listed).alias("pattern"))
    return each.select("id", "text_key", "start", "end", "pattern", F.lower("value").alias("instance"), "base", (F.col("base") | F.col("value").rlike(SECRET)).alias("seed"))


def score_graph(edges: DataFrame, rounds: int = 3, support: int = 3, least: float = 0.7) -> DataFrame:
    """``pattern``, ``instance``, ``confidence`` (of the pattern), ``score`` (of the instance) for each edge.

    ``edges``: distinct ``pattern``, ``instance``, with ``seed``; an instance is a seed if one of its edges says so. Seeds score 1, others 0 at first. In each round a pattern's
    confidence is the sum of its instances' scores over their number and one more, and 0 with fewer than ``support``
    instances of at least ``least``; an instance that is no seed then scores 1 minus the product of its patterns'
    doubts. So an instance that one round discovers supports other patterns in the next.
    """
    base = saved(edges.select("pattern", "instance", "seed"))
    uses = saved(base.groupBy("instance").agg(F.count(F.lit(1)).alias("uses"), F.max("seed").alias("seed")))
    of_instance = heavy_keys(uses, ["instance"], "uses")
    scores, of_pattern, spent = uses.select("instance", F.col("seed").cast("double").alias("score")), None, []
    for k in range(rounds):
        now = spread_join(base.select("pattern", "instance"), scores, ["instance"], of_instance, ["pattern"])
        sums = now.groupBy("pattern").agg(F.sum("score").alias("total"), F.count(F.lit(1)).alias("n"), F.count_if(F.col("score") >= least).alias("known"))
        patterns = saved(sums.select("pattern", "n", (F.when(F.col("known") >= support, F.col("total")).otherwise(0.0) / (F.col("n") + 1)).alias("confidence")))
        of_pattern = heavy_keys(patterns, ["pattern"], "n") if k == 0 else of_pattern
        doubts = spread_join(base, patterns.where("confidence > 0").select("pattern", "confidence"), ["pattern"], of_pattern, ["instance"])
        own = doubts.groupBy("instance").agg((1 - F.exp(F.sum(F.log1p(-F.col("confidence"))))).alias("own"))
        scores = saved(uses.join(own, "instance", "left").select("instance", F.when(F.col("seed"), 1.0).otherwise(F.coalesce("own", F.lit(0.0))).alias("score")))
        spent += [patterns, scores]
    with_confidence = spread_join(base, patterns.select("pattern", "confidence"), ["pattern"], of_pattern, ["instance"])
    out = saved(spread_join(with_confidence, scores, ["instance"], of_instance, ["pattern"]).select("pattern", "instance", "confidence", "score"))
    discard(base, uses, *spent)
    return out


def discovered_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rounds: int = 3, support: int = 3, least: float = 0.7) -> DataFrame:
    """``id``, ``text_key``, ``found`` (array of struct(start, end)): tokens in slots of patterns and with scores of at least ``least``."""
    places = saved(slots(docs, id_col, text_col))
    edges = places.groupBy("pattern", "instance").agg(F.max("seed").alias("seed"))
    # a pattern with fewer instances than ``support`` can never gain confidence
    counts = saved(edges.groupBy("pattern").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= support))
    heavy = heavy_keys(counts, ["pattern"], "n")
    edges = spread_join(edges, counts.select("pattern"), ["pattern"], heavy, ["instance"])
    scored = score_graph(edges, rounds, support, least)
    good = saved(scored.where((F.col("confidence") >= least) & (F.col("score") >= least)).select("pattern", "instance"))
    uses = saved(places.where("not base").groupBy("pattern", "instance").agg(F.count(F.lit(1)).alias("n")).join(good, ["pattern", "instance"]))
    hits = spread_join(places.where("not base"), uses.select("pattern", "instance"), ["pattern", "instance"], heavy_keys(uses, ["pattern", "instance"], "n"), ["id", "start"])
    out = saved(hits.groupBy("id", "text_key").agg(F.array_sort(F.collect_set(F.struct("start", "end"))).alias("found")))
    discard(places, counts, scored, good, uses)
    return out


def find_pii(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` with ``base`` and ``spans``: arrays of struct(kind_no, start, end, kind) by kind, then start.

    ``base``: email, ip, card, phone. ``spans``: those and what the bootstrap found (kind ``id``; see
    ``discovered_spans`` for the options). Offsets count code points, ``end`` exclusive.

    * Null or empty text: no spans. All rows and columns stay, repeated rows too; columns named ``base`` or
      ``spans`` are replaced. An empty table gives no rows. Kinds are found apart and may overlap each other.
    """
    extra = discovered_spans(docs, id_col, text_col, **options)
    own = docs.drop("base", "spans")
    rows = own.select(F.struct(*[own[c] for c in own.columns]).alias("row"))
    text = text_of(F.col("row")[text_col])
    joined = rows.join(extra, F.col("row")[id_col].eqNullSafe(extra["id"]) & (F.xxhash64(text) == extra["text_key"]), "left")

    def named(kind: str, places: Column) -> Column:
        number = KINDS.index(kind) + 1
        return F.transform(places, lambda p: F.struct(F.lit(number).alias("kind_no"), p["start"].alias("start"), p["end"].alias("end"), F.lit(kind).alias("kind")))

    none = F.array().cast("array<struct<kind_no:int,start:bigint,end:bigint,kind:string>>")
    cut = joined.select("row", "found", chunks(text).alias("chunks"))
    whole = lambda k: F.flatten(F.transform("chunks", lambda c: _moved(base_spans(c["text"])[k], c["at"])))
    base = F.concat(*[named(k, whole(k)) for k in BASE])
    more = F.coalesce(named("id", F.col("found")), none)
    spans = cut.select("row", base.alias("base"), more.alias("more"))
    return spans.select("row.*", "base", F.concat("base", "more").alias("spans"))


def spelled(spans: str | Column) -> Column:
    """``kind:start:end``, joined by commas in the order of the array."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def count_of(kind: str, spans: str | Column = "spans") -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def redact(found: DataFrame, text_col: str = "text") -> DataFrame:
    """The result of ``find_pii`` with its spans masked in ``text_col`` (``[EMAIL]``, ...), without ``base`` and ``spans``.

    Spans that overlap become one mask, named by the first of them. Rows without spans keep their text, null too.
    """
    by_place = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    state = F.struct(F.lit(0).cast("bigint").alias("at"), F.lit("").alias("out"))

    def masked(text: Column, at: Column, inside: Column) -> Column:
        piece = lambda a, b: F.substring(text, (a + 1).cast("int"), (b - a).cast("int"))

        def step(s: Column, x: Column) -> Column:
            out = F.when(x["start"] - at >= s["at"], F.concat(s["out"], piece(s["at"], x["start"] - at), F.lit("["), F.upper(x["kind"]), F.lit("]"))).otherwise(s["out"])
            return F.struct(F.greatest(s["at"], -x["back"] - at).alias("at"), out.alias("out"))

        return F.aggregate(inside, state, step, lambda s: F.concat(s["out"], piece(s["at"], F.length(text).cast("bigint"))))

    # no span goes beyond its chunk
    within = lambda c: F.filter("__by_place", lambda s: (s["start"] >= c["at"]) & (s["start"] < c["at"] + F.length(c["text"])))
    own = [c for c in found.columns if c not in ("base", "spans")]
    rows = found.select(F.struct(*own).alias("__row"), by_place.alias("__by_place"))
    text = F.col("__row")[text_col]
    cut = rows.select("__row", "__by_place", F.when(F.size("__by_place") > 0, chunks(text_of(text))).alias("__chunks"))
    whole = F.when(F.col("__chunks").isNull(), text).otherwise(F.array_join(F.transform("__chunks", lambda c: masked(c["text"], c["at"], within(c))), ""))
    return cut.select(*[(whole if c == text_col else F.col("__row")[c]).alias(c) for c in own])
