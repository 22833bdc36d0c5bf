"""Candidate series of an anchor: every series of the same subject."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .spread import counted_join


def candidate_pairs(anchors: DataFrame, series: DataFrame, subject: str = "subject", normalize=None, prefix: str = "anchor_", size: int | None = None) -> DataFrame:
    """Each anchor with every series of its subject: the series' columns, and the anchor's under ``prefix``.

    Subjects meet by ``normalize`` of ``subject`` (a Column function such as ``text.subject_id``) or as they are. A subject that holds much of
    the series table is counted first and spread, its anchors copied. Anchors without a subject or a series have no pairs (``unmatched_anchors``
    tells them); repeated rows give repeated pairs. ``subject`` of the result is the series' own. ``size`` (rows of ``series``, where known) deals
    subjects into tasks of bounded size.
    """
    key = normalize or (lambda c: c)
    left = series.withColumn("__subject", key(F.col(subject)))
    right = anchors.select(key(F.col(subject)).alias("__subject"), *[F.col(c).alias(prefix + c) for c in anchors.columns if c != subject])
    known = F.col("__subject").isNotNull()
    return counted_join(left.where(known), right.where(known), ["__subject"], series.columns, size=size).drop("__subject")


def unmatched_anchors(anchors: DataFrame, series: DataFrame, uid: str = "uid", subject: str = "subject", normalize=None, reason: str = "missing_anchor_uid_or_metadata_patient") -> DataFrame:
    """Anchors whose series the table does not know, or whose subject has no series: the anchor's columns and ``risk_status``."""
    key = normalize or (lambda c: c)
    subjects = series.select(key(F.col(subject)).alias("__subject")).distinct().withColumn("__s", F.lit(True))
    uids = series.select(F.col(uid).alias("__uid")).distinct().withColumn("__u", F.lit(True))
    joined = anchors.withColumns({"__subject": key(F.col(subject)), "__uid": F.col(uid)}).join(subjects, "__subject", "left").join(uids, "__uid", "left")
    missing: Column = F.col("__s").isNull() | F.col("__u").isNull()
    return joined.where(missing).select(*anchors.columns, F.lit(reason).alias("risk_status"))
