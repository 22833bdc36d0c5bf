"""Choosing series for an exam: best series, family groups, scores, rules and terms. Ties always have an order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import family_similarity


def best_series(candidates: DataFrame, exam: list[str], images: str = "images", name: str = "name") -> DataFrame:
    """The series with most images, ties by name."""
    order = Window.partitionBy(*exam).orderBy(F.desc_nulls_last(images), name)
    return candidates.withColumn("r", F.row_number().over(order)).where("r = 1").drop("r")


def family_groups(candidates: DataFrame, exam: list[str], anchor_key: str, anchor_tokens: str, anchor_uid: str, bonus_on_anchor_only: bool = False) -> DataFrame:
    """Per exam and family ``key``: the union of tokens, ``score``, and its rank.

    Similarity of the anchor to the union; +1 for the anchor's own key, +2 if the group holds the anchor series
    (with ``bonus_on_anchor_only`` just where ``is_anchor_exam``).
    """
    union = F.array_sort(F.array_distinct(F.flatten(F.collect_list("tokens"))))
    has = F.bool_or(F.col("uid") == F.col(anchor_uid))
    if bonus_on_anchor_only:
        has = has & F.bool_or("is_anchor_exam")
    groups = candidates.groupBy(*exam, "key").agg(union.alias("tokens"), has.alias("has_anchor"), F.first(anchor_key).alias("anchor_key"), F.first(anchor_tokens).alias("anchor_tokens"), F.count(F.lit(1)).alias("series"))
    score = family_similarity(F.col("anchor_tokens"), F.col("tokens")) + (F.col("key") == F.col("anchor_key")).cast("int") + 2 * F.coalesce(F.col("has_anchor"), F.lit(False)).cast("int")
    rank = Window.partitionBy(*exam).orderBy(F.desc("score"), "key")
    return groups.withColumn("score", F.round(score, 9)).withColumn("rank", F.row_number().over(rank))


def select_family(groups: DataFrame, exam: list[str], least: float = 0.45, tie: float = 0.05) -> DataFrame:
    """The chosen group of each exam: the anchor's own key if nothing reaches 1, else the best; ``note`` on ties and misses."""
    ordered = Window.partitionBy(*exam)
    with_second = groups.withColumn("second", F.max(F.when(F.col("rank") == 2, F.col("score"))).over(ordered)).withColumn("top", F.max("score").over(ordered))
    own = (F.col("key") == F.col("anchor_key")) & (F.col("top") < 1)
    pick = Window.partitionBy(*exam).orderBy(F.desc(own.cast("int")), "rank")
    first = with_second.withColumn("p", F.row_number().over(pick)).where("p = 1")
    score = F.when((F.col("key") == F.col("anchor_key")) & (F.col("top") < 1), 1.0).otherwise(F.col("top"))
    note = F.when(score < least, "no_family_match").when(F.abs(score - F.col("second")) < tie, "near_tie").otherwise("selected")
    return first.select(*exam, F.when(score < least, None).otherwise(F.col("key")).alias("key"), score.alias("score"), note.alias("note"))


def scored(candidates: DataFrame, terms: list[tuple[Column, float | Column, str]]) -> DataFrame:
    """``score`` (sum of the terms that hold) and ``reasons`` (their names)."""
    points = sum((F.when(F.coalesce(c, F.lit(False)), v).otherwise(0.0) for c, v, _ in terms[1:]), F.when(F.coalesce(terms[0][0], F.lit(False)), terms[0][1]).otherwise(0.0))
    names = F.array_compact(F.array(*[F.when(c, F.lit(n)) for c, _, n in terms]))
    return candidates.withColumn("score", points).withColumn("reasons", F.array_join(names, ";"))


#: Points of a candidate series against the anchor, by factor; of a factor the first that holds counts.
CANDIDATE_POINTS = {
    "exact_normalized_name": 6.0, "same_sequence_family": 4.0,
    "same_orientation": 4.0, "different_orientation": -4.0,
    "same_num_files": 4.0, "very_close_num_files": 3.0, "close_num_files": 1.5, "far_num_files": -2.0,
    "has_180_files": 0.5,
    "same_num_phases": 3.5, "close_num_phases": 1.0, "different_num_phases": -1.5,
    "same_matrix": 2.0, "close_matrix": 0.5, "different_matrix": -1.0,
    "same_spacing": 2.0, "close_spacing": 0.5, "different_spacing": -1.0,
}
#: Points of the audit's score.
AUDIT_POINTS = {
    "same_family_key": 1.0, "anchor_uid": 2.0, "same_plane": 0.7, "different_plane": -1.0, "same_num_images": 0.6, "close_num_images": 0.3, "far_num_images": -0.3,
    "same_matrix": 0.5, "different_matrix": -0.2, "same_spacing": 0.5, "different_spacing": 0.0,
}
#: Points of the rules by which a mask source was found.
RULE_POINTS = {"voi_pair": 3, "paired_segmentation": 2, "analysis_mask": 2, "segmentation_pair_fallback": 1}


def _factor(points: dict[str, float], *rules: tuple[Column, str]) -> Column:
    """struct(points, reason) of the first rule that holds; nulls if none does."""
    out = None
    for rule, name in rules:
        value = F.struct(F.lit(float(points[name])).alias("points"), F.lit(name).alias("reason"))
        out = F.when(rule, value) if out is None else out.when(rule, value)
    return out


def _named(factor: Column, what: Column) -> Column:
    """The factor with what it was about behind its reason."""
    return F.when(factor.isNotNull(), F.struct(factor["points"].alias("points"), F.concat(factor["reason"], F.lit(":"), what).alias("reason")))


def _summed(factors: list[Column]) -> tuple[Column, Column]:
    held = F.array_compact(F.array(*factors))
    return F.aggregate(held, F.lit(0.0), lambda s, f: s + f["points"]), F.array_join(F.transform(held, lambda f: f["reason"]), ";")


def candidate_score(candidates: DataFrame) -> DataFrame:
    """``score`` and ``reasons`` of candidates by all factors; what is null on either side gives no points.

    Columns, each also as ``anchor_...``: name, family, orientation, files, phases, rows, cols, spacing (array of two).
    """
    c = lambda name: (F.col(name), F.col(f"anchor_{name}"))
    (name, a_name), (family, a_family), (plane, a_plane), (phases, a_phases) = c("name"), c("family"), c("orientation"), c("phases")
    files = F.abs(F.col("files") - F.col("anchor_files"))
    rows, cols = (F.abs(F.col(x) - F.col(f"anchor_{x}")) for x in ("rows", "cols"))
    apart = F.abs(F.col("spacing")[0] - F.col("anchor_spacing")[0]) + F.abs(F.col("spacing")[1] - F.col("anchor_spacing")[1])
    score, reasons = _summed([
        _factor(CANDIDATE_POINTS, (name == a_name, "exact_normalized_name"), (family == a_family, "same_sequence_family")),
        _factor(CANDIDATE_POINTS, (plane == a_plane, "same_orientation"), (plane != a_plane, "different_orientation")),
        _factor(CANDIDATE_POINTS, (files == 0, "same_num_files"), (files <= 5, "very_close_num_files"), (files <= 20, "close_num_files"), (files >= 80, "far_num_files")),
        _factor(CANDIDATE_POINTS, (files.isNotNull() & (F.col("files") == 180), "has_180_files")),
        _factor(CANDIDATE_POINTS, (phases == a_phases, "same_num_phases"), (F.abs(phases - a_phases) == 1, "close_num_phases"), (phases != a_phases, "different_num_phases")),
        _factor(CANDIDATE_POINTS, ((rows == 0) & (cols == 0), "same_matrix"), ((rows <= 16) & (cols <= 16), "close_matrix"), (rows.isNotNull() & cols.isNotNull(), "different_matrix")),
        _factor(CANDIDATE_POINTS, (apart < 1e-4, "same_spacing"), (apart < 0.2, "close_spacing"), (apart.isNotNull(), "different_spacing")),
    ])
    return candidates.withColumns({"score": score, "reasons": reasons})


def audit_score(candidates: DataFrame) -> DataFrame:
    """``audit_score`` and ``audit_reasons`` of each series against the anchor.

    Columns, each also as ``anchor_...``: uid, key, tokens, plane, images, shape, spacing; empty planes are unknown.
    """
    c = lambda name: (F.col(name), F.col(f"anchor_{name}"))
    (uid, a_uid), (key, a_key), (tokens, a_tokens), (plane, a_plane), (shape, a_shape), (spacing, a_spacing) = map(c, ("uid", "key", "tokens", "plane", "shape", "spacing"))
    images, known = F.abs(F.col("images") - F.col("anchor_images")), (plane != "") & (a_plane != "")
    likeness = family_similarity(a_tokens, tokens)
    similar = F.when(likeness > 0, F.struct(likeness.cast("double").alias("points"), F.concat(F.lit("token_similarity:"), F.format_number(likeness, 3)).alias("reason")))
    score, reasons = _summed([
        _factor(AUDIT_POINTS, (key == a_key, "same_family_key")), similar, _factor(AUDIT_POINTS, (uid == a_uid, "anchor_uid")),
        _named(_factor(AUDIT_POINTS, (known & (plane == a_plane), "same_plane"), (known & (plane != a_plane), "different_plane")), plane),
        _factor(AUDIT_POINTS, (images == 0, "same_num_images"), (images <= 10, "close_num_images"), (images >= 80, "far_num_images")),
        _factor(AUDIT_POINTS, (shape == a_shape, "same_matrix"), (shape != a_shape, "different_matrix")),
        _factor(AUDIT_POINTS, (spacing == a_spacing, "same_spacing"), (spacing != a_spacing, "different_spacing")),
    ])
    return candidates.withColumns({"audit_score": F.round(score, 9), "audit_reasons": reasons})


def pick_scored(candidates: DataFrame, exam: list[str], order: str, least: float = 4.0, lead: float = 1.0) -> DataFrame:
    """Every candidate with its ``rank``, and the exam's ``verdict``: low, ambiguous or selected."""
    w = Window.partitionBy(*exam).orderBy(F.desc("score"), order)
    whole = Window.partitionBy(*exam)
    ranked = candidates.withColumn("rank", F.row_number().over(w))
    best, second = F.max(F.when(F.col("rank") == 1, F.col("score"))).over(whole), F.max(F.when(F.col("rank") == 2, F.col("score"))).over(whole)
    verdict = F.when(best < least, "low").when(best - second < lead, "ambiguous").otherwise("selected")
    return ranked.withColumn("verdict", verdict).withColumn("selected", (F.col("rank") == 1) & (verdict == "selected"))


def rule_score(rule: Column) -> Column:
    """Points of a mask source's rule; null for an unknown one."""
    out = None
    for name, points in RULE_POINTS.items():
        out = F.when(rule == name, points) if out is None else out.when(rule == name, points)
    return out


def unique_best(candidates: DataFrame, keys: list[str], score: str = "rule_score") -> DataFrame:
    """Per key: the best rule score, how many reach it, and whether that is one."""
    top = F.max(score).over(Window.partitionBy(*keys))
    found = candidates.withColumn("best", top).groupBy(*keys).agg(F.max("best").alias("best"), F.count_if(F.col(score) == F.col("best")).alias("ties"))
    return found.withColumn("status", F.when(F.col("ties") > 1, "ambiguous").otherwise("unique"))


def first_term(candidates: DataFrame, keys: list[str], terms: list[str], text: str) -> DataFrame:
    """Candidates whose text holds the first of the terms that any candidate of the key holds; ``term`` names it."""
    hits = candidates.withColumn("t", F.explode(F.array(*[F.struct(F.lit(k).alias("pos"), F.lit(term).alias("term")) for k, term in enumerate(terms)])))
    hits = hits.where(F.contains(F.lower(text), F.col("t.term")))
    least = F.min("t.pos").over(Window.partitionBy(*keys))
    return hits.withColumn("least", least).where("t.pos = least").withColumn("term", F.col("t.term")).drop("t", "least")


def best_first(candidates: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """``place`` (from 1) of each candidate in its group."""
    return candidates.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))


def ordered_series(candidates: DataFrame, keys: list[str], time: str = "time", phase: str = "phase", name: str = "name") -> DataFrame:
    """``place`` in a group: time, then phase number, then name, unknown ones last."""
    w = Window.partitionBy(*keys).orderBy(F.asc_nulls_last(time), F.asc_nulls_last(phase), name)
    return candidates.withColumn("place", F.row_number().over(w))
