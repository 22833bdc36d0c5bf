"""URL filter: a trie over reversed host labels and path segments, broadcast; the longest rule wins."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Most rules that are broadcast as one trie (some 300 MB in a worker); more are refused rather than sent.
MAX_RULES = 1_000_000
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


class RuleTrie:
    """Host labels from the last to the first, then path segments; the end of a rule's path is a prefix of a segment."""

    def __init__(self, rules: Iterable[tuple[str, str, str]]):
        """rules: (verdict, host, path). Where two rules are equal, ``block`` holds."""
        self.hosts: dict = {}
        for verdict, host, path in rules:
            node = self.hosts
            for label in reversed(host.split(".")):
                node = node.setdefault(label, {})
            node = node.setdefault(("paths",), {})
            *whole, last = path.split("/")
            for segment in whole:
                node = node.setdefault(segment, {})
            ends = node.setdefault(("ends",), {})
            if ends.get(last, "allow") == "allow":
                ends[last] = verdict
            node[("longest",)] = max(len(last), node.get(("longest",), 0))

    def _paths(self, node: dict, path: str) -> Iterator[tuple[int, str]]:
        """(length, verdict) of each rule path that ``path`` starts with."""
        start = 0
        while True:
            cut = path.find("/", start)
            if ("ends",) in node:
                stop = min(start + node[("longest",)], len(path) if cut < 0 else cut)
                for end in range(start, stop + 1):
                    if verdict := node[("ends",)].get(path[start:end]):
                        yield end, verdict
            node = node.get(path[start:cut]) if cut >= 0 else None
            if node is None:
                return
            start = cut + 1

    def match(self, host: str, path: str) -> tuple[str | None, str | None]:
        """(rule, verdict) of the rule with most characters; of equals, the one of the longer host."""
        best: tuple[int, int] | None = None
        found: tuple[str | None, str | None] = (None, None)
        node, labels = self.hosts, host.split(".")
        for depth, label in enumerate(reversed(labels), 1):
            node = node.get(label)
            if node is None:
                break
            if ("paths",) in node:
                own = ".".join(labels[-depth:])
                for length, verdict in self._paths(node[("paths",)], path):
                    if best is None or (len(own) + length, len(own)) > best:
                        best, found = (len(own) + length, len(own)), (own + path[:length], verdict)
        return found


def url_host(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased; empty where there is none."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end; empty where there is none."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def filter_urls(pages: DataFrame, rules: Iterable[tuple[str, str, str]], url_col: str = "url", default: str = "allow") -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits) and ``verdict`` (the rule's, or ``default``).

    A rule (verdict, host, path) fits its host and all subdomains where the path starts with the rule's. The one
    with most characters wins; of equals, the one with the longer host; the same rule twice: block.

    * Null url, or one without ``://``: empty host and path. Columns named like the four new ones are replaced.
    * Rows are kept one to one, repeated ones too; an empty table gives no rows; no rules: all ``default``.
    """
    rules = list(rules)
    if len(rules) > MAX_RULES:
        raise ValueError(f"{len(rules)} rules; a broadcast trie takes {MAX_RULES} at most")
    trie = pages.sparkSession.sparkContext.broadcast(RuleTrie(rules))

    @F.pandas_udf("rule string, verdict string")
    def judged(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        match = trie.value.match
        return pd.DataFrame([match(h, p) for h, p in zip(host, path, strict=True)], columns=["rule", "verdict"], dtype=object)

    own = [F.col(c) for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    parsed = pages.select(*own, url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    found = parsed.withColumn("__found", judged("host", "path"))
    return found.select(
        *own, "host", "path", F.col("__found.rule").alias("rule"), F.coalesce("__found.verdict", F.lit(default)).alias("verdict")
    )
