"""Series that several anchors ask for: each series is used once."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import dealt_by, discard, heavy_keys, saved, spread_join


def _first(order: list[str]) -> Column:
    """Sorts claims of a series: by the order of the anchors, unknown ones first."""
    return F.struct(*[x for c in order for x in (F.col(c).isNotNull(), F.col(c))])


def first_claims(claims: DataFrame, series: list[str], order: list[str], size: int | None = None) -> DataFrame:
    """``claims`` with ``taken``: true where the row is the first, by ``order``, that names its series. Later claims of a series get nothing.

    ``order`` tells all claims of a series apart (repeated rows are all first). A series that very many claim is one row once each task has
    combined its claims; only that row is joined back. A null series is never taken. With ``size`` (rows of ``claims``, a saved table then) series are
    dealt into tasks of bounded size, and claims of a series that holds much of the table are spread.
    """
    firsts = claims.where(_known(series)).groupBy(*series).agg(F.min(_first(order)).alias("__least"), F.count(F.lit(1)).alias("__size"))
    if size is None:
        joined = claims.join(firsts.drop("__size"), series, "left")
    else:
        firsts = saved(firsts)
        joined = spread_join(claims.drop("taken"), firsts.drop("__size"), series, heavy_keys(firsts, series, "__size"), order, "left", size=size)
    return joined.withColumn("taken", F.coalesce(_first(order) == F.col("__least"), F.lit(False))).drop("__least")


def _known(series: list[str]) -> Column:
    out = F.lit(True)
    for c in series:
        out &= F.col(c).isNotNull()
    return out


#: Claims of a group that one task may stream; larger groups are settled in rounds.
STREAMED = 1 << 20


def one_to_one(claims: DataFrame, anchor: list[str], series: list[str], order: list[str], place: str, streamed: int = STREAMED) -> DataFrame:
    """Each anchor's series where an anchor that finds its best series used moves on to its next: the result of letting anchors choose one after
    the other, by ``order``, among what is left. Rows of ``claims`` that are granted.

    ``claims``: one row for each anchor and series it would take, with ``order`` (of the anchor, the same in its rows, different for any two
    anchors) and ``place`` (of the series for that anchor, from 1 without gaps). Anchors without a free series are not in the result; null series are no claims.

    What ``anchor`` and ``series`` have in common (a patient) parts the claims into groups that do not touch each other. A group of up to ``streamed``
    claims passes once, sorted by ``order`` and ``place``, and only the series that it has used are held. Larger ones, and claims without such
    a column, are settled in rounds (see ``_rounds``). Claims are written once, shuffled once to be counted and once to be sorted.
    """
    common = [c for c in anchor if c in series]
    known = saved(claims.where(_known([*dict.fromkeys([*anchor, *series])])))
    if not common:
        return _rounds(known, anchor, series, order, place)
    sizes = known.groupBy(*common).agg(F.count(F.lit(1)).alias("__size"))
    large = saved(sizes.where(F.col("__size") > streamed).select(*common))
    if large.isEmpty():
        return _in_turn(known, common, anchor, series, order, place)
    small = _in_turn(known.join(large, common, "left_anti"), common, anchor, series, order, place)
    return small.unionByName(_rounds(known.join(large, common, "left_semi"), anchor, series, order, place).select(*claims.columns))


def _in_turn(claims: DataFrame, common: list[str], anchor: list[str], series: list[str], order: list[str], place: str) -> DataFrame:
    """Every group as a sorted stream; repeated rows of a granted claim are all granted."""
    at = {c: k for k, c in enumerate(claims.columns)}
    own, other, group = ([at[c] for c in names] for names in (anchor, series, common))
    dealt = dealt_by(claims, common, claims.count()).sortWithinPartitions(*common, *order, *anchor, place)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now = who = granted = None
        used: set = set()
        for batch in batches:
            lists = {k: batch.column(k).to_pylist() for k in {*own, *other, *group}}
            groups, anchors, wanted = (zip(*[lists[k] for k in names], strict=True) for names in (group, own, other))
            keep = []
            for g, a, s in zip(groups, anchors, wanted, strict=True):
                if g != now:
                    now, who, used = g, None, set()
                if a != who:
                    who, granted = a, None
                if granted is None and s not in used:
                    granted = s
                    used.add(s)
                keep.append(granted is not None and s == granted)
            yield batch.filter(pa.array(keep, pa.bool_()))

    return dealt.mapInArrow(run, claims.schema)


def _rounds(claims: DataFrame, anchor: list[str], series: list[str], order: list[str], place: str) -> DataFrame:
    """Every anchor asks for the series at its place; a series keeps the first of those that ask, by ``order``; the others ask for the one at
    their next place. As all series rank anchors alike, the end does not depend on who asked when. It ends when nobody has to move, after
    at most as many rounds as there are places times anchors of the most wanted series.

    A round shuffles what is asked, and looks up the next claims of those only that move; it is written, so a lost executor costs a round.
    """
    both = list(dict.fromkeys([*anchor, *series]))
    named = list(dict.fromkeys([*both, *order]))
    own = saved(claims.select(*named, F.col(place).alias("__place")).distinct())
    asked = saved(own.where("__place = 1"))
    while True:
        kept = asked.groupBy(*series).agg(F.min(_first(order)).alias("__least"))
        judged = saved(asked.join(kept, series).withColumn("__lost", _first(order) != F.col("__least")).drop("__least").select(*named, "__place", "__lost"))
        discard(asked)
        lost = judged.where("__lost").select(*anchor, (F.col("__place") + 1).alias("__place"))
        asked = judged.where("not __lost").drop("__lost")
        if lost.isEmpty():
            return claims.join(asked.select(*both), both, "left_semi")
        asked = saved(asked.unionByName(own.join(lost, [*anchor, "__place"]).select(*asked.columns)))
        discard(judged)
