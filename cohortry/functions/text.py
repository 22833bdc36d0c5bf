"""Identifiers, dates, series names and free-text rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that say nothing about a series family.
STOPWORDS = ["aligned", "contrast", "cropped", "inject", "injection", "original", "registered", "repeat", "test", "to", "uni", "unilateral", "with"]
#: Patterns replaced by a space, in this order, when a series name is normalized.
NAME_RULES = [
    r"(?<=[a-z0-9])(?=[A-Z])", ":", r"(?i)ispy\s*2", r"(?i)ph\s*\d+", r"(?i)phase\s*\d+", r"(?i)pre\s*--\s*registered",
    r"(?i)pre[-\s]*contrast", r"(?i)post[-\s]*contrast", r"(?i)(prepost|delayed|delay|post|pre|registered|repeat|test)", r"(?i)(\d+(?:\.\d+)?)\s*ml",
]
#: Spellings of one dynamic family.
FAMILY_ALIASES = {
    "sagittal-ir_3dfgre": "dynamic-3dfgre",
    "sagittal-ir3dfgre": "dynamic-3dfgre",
    "sagittal-ir3dfgre pe1": "dynamic-3dfgre pe1",
    "sagittal-ir3dfgre ser": "dynamic-3dfgre ser",
}
PHASE_ONLY = "phase_only_dynamic"
#: Plane and contrast words, in the order they are tried.
PLANES = [("sagittal", r"\bsag(it+al)?\b"), ("axial", r"\b(ax|axial|tra|transverse)\b"), ("coronal", r"\bcor(on?al)?\b")]
DERIVED = r"\b(sub|subtract|subtraction|mip|cad|ser|pe1?|segmentation|mask|voi)\b"
T2 = r"\b(t2|stir|tirm|ssfse|frfse|tse\s*t2|fse\s*t2)\b"
T1 = r"\b(t1|spgr|fspgr|ir[-_ ]?spgr|3d\s*f?gre|3dfgre|fgre|vibe|flash|tfl|thrive|dyn|dynamic|dce)\b"


def canonical_id(patient: Column, prefix: str) -> Column:
    """``PREFIX-x`` -> ``PREFIX_x``."""
    return F.regexp_replace(patient, rf"^{prefix}-", f"{prefix}_")


def subject_id(patient: Column, site: str | None = None, width: int = 2) -> Column:
    """The source's subject id: upper case with ``-``; with ``site``, that prefix and the trailing number, padded, never cut."""
    if site is None:
        return F.replace(F.upper(patient), F.lit("_"), F.lit("-"))
    number = F.regexp_extract(patient, r"(\d+)$", 1).try_cast("int")
    return F.format_string(f"{site}-%0{width}d", number)


def slug(text: Column) -> Column:
    """Lower case, everything but letters and digits as single underscores."""
    return F.regexp_replace(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def case_id(patient: Column, date: Column, phase: Column) -> Column:
    return F.concat_ws("_", slug(patient), F.replace(date, F.lit("-"), F.lit("")), F.lpad(phase.cast("string"), 4, "0"))


def squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def normalize_series_name(text: Column) -> Column:
    """Camel words apart; phase, contrast and dose words out; ``[a-z0-9]`` words with single spaces."""
    out = F.trim(text)
    for rule in NAME_RULES:
        out = F.regexp_replace(out, rule, " ")
    return F.trim(F.regexp_replace(F.lower(out), "[^a-z0-9]+", " "))


def is_phase_only(text: Column) -> Column:
    """Whether a name has nothing but pre, post, ph and phase words."""
    plain = F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"(?i)ispy\s*2", " ")), "[^a-z0-9]+", " "))
    return (plain != "") & F.forall(F.split(plain, " "), lambda t: t.rlike(r"^(pre|post\d*|ph\d+|phase\d+)$"))


def family_tokens(text: Column) -> Column:
    """Sorted distinct words of the normalized name, without stopwords and numbers."""
    words = F.filter(F.split(normalize_series_name(text), " "), lambda t: (t != "") & ~t.isin(STOPWORDS) & ~t.rlike(r"^\d+$"))
    found = F.array_sort(F.array_distinct(words))
    return F.when((F.size(found) == 0) & is_phase_only(text), F.array(F.lit(PHASE_ONLY))).otherwise(found)


def family_key(text: Column) -> Column:
    return F.array_join(family_tokens(text), " ")


def family_similarity(anchor: Column, other: Column) -> Column:
    """max(Dice, share of the anchor's tokens); 0 if either is empty. Not symmetric."""
    common = F.size(F.array_intersect(anchor, other)).cast("double")
    score = F.greatest(2 * common / (F.size(anchor) + F.size(other)), common / F.size(anchor))
    return F.when((F.size(anchor) == 0) | (F.size(other) == 0), 0.0).otherwise(score)


def sequence_family(text: Column) -> Column:
    """The name without its side, lower-cased, aliases resolved."""
    plain = F.lower(squeezed(F.regexp_replace(squeezed(text), r"(?i)^(left|right|lt|rt|bilateral)\s*[-: ]+\s*", "")))
    known = F.create_map(*[F.lit(x) for pair in FAMILY_ALIASES.items() for x in pair])
    return F.coalesce(known[plain], plain)


def folder_description(folder: Column) -> Column:
    """Without the first and last ``-`` part, if there are three or more."""
    parts = F.split(folder, "-")
    return F.when(F.size(parts) >= 3, F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(1))), "-")).otherwise(folder)


def phase_number(text: Column) -> Column:
    """The number after ``ph``, else after ``post``, else 0 for a pre name, else null."""
    number = lambda p: F.nullif(F.regexp_extract(text, p, 1), F.lit("")).try_cast("int")
    low = F.lower(text)
    pre = F.contains(F.concat(F.lit(" "), low, F.lit(" ")), F.lit(" pre ")) | low.endswith(" pre") | F.contains(low, F.lit("pre -- registered"))
    return F.coalesce(number(r"(?i)ph\s*(\d+)"), number(r"(?i)post\s*(\d+)"), F.when(pre, 0))


def parse_dims(text: Column) -> Column:
    """``AxBxC`` -> three ints; null unless there are exactly three."""
    return F.when(text.rlike(r"^\d+x\d+x\d+$"), F.transform(F.split(text, "x"), lambda x: x.cast("int")))


def format_dims(values: Column) -> Column:
    """Three numbers -> ``AxBxC`` with six significant digits each, no trailing zeros; null unless there are three."""
    six = lambda v: F.format_string("%.5e", v.cast("double")).cast("decimal(38,12)").cast("string")
    short = lambda v: F.regexp_replace(F.regexp_replace(six(v), r"(\.\d*?)0+$", "$1"), r"\.$", "")
    return F.when(F.size(values) == 3, F.array_join(F.transform(values, short), "x"))


def plane_by_stem(text: Column) -> Column:
    """The plane by the word stems of a series text, tried in this order; empty if none."""
    low = F.lower(text)
    return F.when(F.contains(low, F.lit("sagitt")), "sagittal").when(F.contains(low, F.lit("axial")) | F.contains(low, F.lit("transverse")), "axial").when(F.contains(low, F.lit("coron")), "coronal").otherwise("")


def exam_contrast(classes: Column) -> Column:
    """One class of all series of an exam, ``mixed:`` and the sorted classes, or empty without series."""
    distinct = F.array_sort(F.array_distinct(classes))
    return F.when(F.size(distinct) == 0, "").when(F.size(distinct) == 1, distinct[0]).otherwise(F.concat(F.lit("mixed:"), F.array_join(distinct, "|")))


def all_within(observed: Column, reference: Column) -> Column:
    """Whether all observed values are among the reference's; null (unknown) if either side is empty."""
    return F.when((F.size(observed) > 0) & (F.size(reference) > 0), F.size(F.array_except(observed, reference)) == 0)


def parse_bool(text: Column) -> Column:
    """``true``, ``1``, ``yes`` in any case are true; all else, null too, is false."""
    return F.coalesce(F.lower(F.trim(text.cast("string"))).isin("true", "1", "yes"), F.lit(False))


def split_list(text: Column, mark: str = "|") -> Column:
    """Parts of a delimited text, trimmed, empty ones dropped."""
    return F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), F.lit(f"\\{mark}")), lambda x: F.trim(x)), lambda x: x != "")


def infer_plane(text: Column, fallback: Column | None = None) -> Column:
    low, out = F.lower(text), None
    for name, pattern in PLANES:
        out = F.when(low.rlike(pattern), name) if out is None else out.when(low.rlike(pattern), name)
    return F.coalesce(out, fallback if fallback is not None else F.lit(""))


def contrast_class(text: Column, tr: Column, te: Column, values: bool = False) -> Column:
    """struct(contrast, reason): derived words, T2 words, T1 words, a long TE, short TR and TE; T1 words lose to a long TE.

    With ``values`` the reasons name the times that decided.
    """
    low = F.lower(text)
    word = low.rlike(T1)
    short = F.coalesce((tr <= 1200) & (te <= 30), F.lit(False))
    number = lambda v: F.regexp_replace(v.cast("double").cast("string"), r"\.0$", "")
    reasons = F.array_join(F.array_compact(F.array(F.when(word, F.lit("t1_keyword")), F.when(short, F.concat(F.lit("short_tr_te:"), number(tr), F.lit("/"), number(te))))), ";") if values else F.array_join(F.array_compact(F.array(F.when(word, F.lit("t1_keyword")), F.when(short, F.lit("short_tr_te")))), ";")
    long_te = F.concat(F.lit("long_te:"), number(te)) if values else "long_te"
    of = lambda c, r: F.struct(F.lit(c).alias("contrast"), (r if isinstance(r, Column) else F.lit(r)).alias("reason"))
    return (
        F.when(low.rlike(DERIVED), of("derived_or_map", "derived_keyword"))
        .when(low.rlike(T2), of("t2_like", "t2_keyword"))
        .when(te >= 50, of("t2_like", long_te))
        .when(word | short, of("t1_like", reasons))
        .otherwise(of("unknown", "no_t1_t2_clue"))
    )


def path_parts(path: Column) -> Column:
    """struct(cohort, patient, exam, phase) of ``.../cohort/patient/exam/volume_phaseN.nii.gz``; null if it does not fit."""
    pattern = r"([^/]+)/([^/]+)/([^/]+)/volume_phase(\d+)\.nii\.gz$"
    part = lambda k: F.regexp_extract(path, pattern, k)
    return F.when(path.rlike(pattern), F.struct(part(1).alias("cohort"), part(2).alias("patient"), part(3).alias("exam"), part(4).cast("int").alias("phase")))


def iso_date(text: Column) -> Column:
    """``MM-DD-YYYY`` -> date; null if it does not parse."""
    return F.when(text.rlike(r"^\d{2}-\d{2}-\d{4}$"), F.try_to_timestamp(text, F.lit("MM-dd-yyyy")).cast("date"))


def folder_date(text: Column) -> Column:
    """Any of the usual date texts -> ``MM-DD-YYYY``; others keep their text with ``/`` as ``-``."""
    kinds = [(r"^\d{4}-\d{2}-\d{2}$", "yyyy-MM-dd"), (r"^\d{1,2}/\d{1,2}/\d{4}$", "M/d/yyyy"), (r"^\d{2}-\d{2}-\d{4}$", "MM-dd-yyyy"), (r"^\d{8}$", "yyyyMMdd")]
    parsed = F.coalesce(*[F.when(text.rlike(p), F.try_to_timestamp(text, F.lit(f))) for p, f in kinds])
    return F.coalesce(F.date_format(parsed, "MM-dd-yyyy"), F.replace(text, F.lit("/"), F.lit("-")))


def date_prefix(folder: Column) -> Column:
    """The ``MM-DD-YYYY`` a folder name starts with, or ``unknown_date``."""
    return F.coalesce(F.nullif(F.regexp_extract(folder, r"^(\d{2}-\d{2}-\d{4})", 1), F.lit("")), F.lit("unknown_date"))


def time_number(acquisition: Column, content: Column) -> Column:
    """HHMMSS(.f) text -> integer, of the acquisition time, else of the content time."""
    one = lambda t: F.regexp_replace(t.cast("string"), "[^0-9.]", "").try_cast("double").cast("int")
    return F.coalesce(one(acquisition), one(content))


def release_contiguity(indices: Column) -> Column:
    """``contiguous_from_zero`` or ``non_contiguous_or_not_zero`` (``missing`` if empty)."""
    ordered = F.array_sort(indices)
    run = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.when(F.size(indices) == 0, "missing").when(ordered == run, "contiguous_from_zero").otherwise("non_contiguous_or_not_zero")


def audit_contiguity(indices: Column) -> Column:
    """``contiguous_from_zero``, ``does_not_start_at_zero``, ``non_contiguous`` or ``missing``."""
    ordered = F.array_sort(indices)
    run = F.sequence(F.lit(0), F.greatest(F.size(ordered) - 1, F.lit(0)))
    return F.when(F.size(indices) == 0, "missing").when(ordered == run, "contiguous_from_zero").when(ordered[0] != 0, "does_not_start_at_zero").otherwise("non_contiguous")


def joined_set(column: Column, mark: str = ";") -> Column:
    """Aggregate: distinct sorted non-empty texts, joined."""
    return F.array_join(F.array_sort(F.collect_set(F.nullif(F.trim(column.cast("string")), F.lit("")))), mark)


def issues(*rules: tuple[Column, Column | str], none: str = "ok", mark: str = "|") -> Column:
    """Names of the rules that fail (a null verdict does not), sorted and distinct; ``none`` if there are none."""
    named = [F.when(c, n if isinstance(n, Column) else F.lit(n)) for c, n in rules]
    found = F.array_join(F.array_sort(F.array_distinct(F.array_compact(F.array(*named)))), mark)
    return F.when(found == "", none).otherwise(found)
