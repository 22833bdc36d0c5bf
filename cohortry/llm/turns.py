"""Repair of conversations by the cheapest edits: a Viterbi search that gives out edits as soon as its survivors agree.

A repaired conversation's roles read ``(s?(ua)+)?``: nothing, or user and assistant in turns, perhaps after one system
row. Faults of rows are found by DataFrame functions. Rows then stream by conversation and turn through a search over four states
(nothing yet, system, user, assistant). Each state's survivor is the end of a path in a tree of edits with
back-pointers; a path that no survivor reaches is freed by its count of references. Once all survivors stand on one child of the tree's
root, that edit is final: it goes out, and the child is the new root. So what is held is the part of the tree over
which survivors still differ, however long a conversation is (it is all of the tree only where they differ to the end, such as
in a conversation of one role only). Of two paths of one cost into one state, the one with the
ASCII-least edits stays; both are compared in full back to the root, which all survivors share. (Equal costs rule out that one is
the beginning of the other: it would differ by inserts, which cost.)
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
ROLES = {2: "user", 3: "assistant"}
#: State -> the states that none, one, ... inserts before a row lead to; more inserts come back to one of them.
INSERTS = {0: (0, 2, 3), 1: (1, 2, 3), 2: (2, 3), 3: (3, 2)}
#: Initial of a kept row -> states it may follow, state it leads to.
KEEP = {"s": ((0,), 1), "u": ((0, 1, 3), 2), "a": ((2,), 3)}
BLANK = r"\x20\x09-\x0D"
#: Characters that are no text, for trimming.
SPACE = " \t\n\x0b\f\r"
FAULTS = ["blank", "duplicate", "truncated"]


def damage(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``rows`` after the damage drawn from a checksum of conversation and turn: dropped, emptied, without end marks, twice, or role user.

    In what is hashed, and as role and text, null is one space.
    """
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spelt(conv_col), F.lit(":"), spelt(turn_col)).cast("binary")) % 20
    rows = rows.withColumn("__kind", kind).where("__kind <> 0")
    text = F.when(F.col("__kind") == 1, "").when(F.col("__kind") == 2, F.regexp_replace(spelt(text_col), "[.!?]", "")).otherwise(spelt(text_col))
    role = F.when(F.col("__kind") == 4, "user").otherwise(spelt(role_col))
    twice = F.explode(F.sequence(F.lit(1), F.when(F.col("__kind") == 3, 2).otherwise(1)))
    return rows.withColumns({role_col: role, text_col: text, "__copy": twice}).drop("__kind", "__copy")


def _before(turn: Column) -> Column:
    """Sorts turns, nulls first."""
    return F.struct(turn.isNotNull(), turn)


def faulty_rows(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """``conv``, ``turn``, ``role``, ``text``, ``said``, ``late``, ``fault``: each row's own fault, and whether its
    conversation has said the same in an earlier turn.

    ``said`` is a digest of conversation, role and text. Only what is said more than once meets its first turn; the
    same within one turn is for the sorted stream to tell.
    """
    spelt = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    own = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).alias("turn"), spelt(role_col).alias("role"), spelt(text_col).alias("text"))
    conv = F.coalesce(F.concat(F.lit("="), F.col("conv").cast("string")), F.lit(""))
    said = F.sha2(F.concat_ws("|", F.length(conv), conv, F.length("role"), F.col("role"), F.col("text")).cast("binary"), 256)
    body = F.rtrim(F.col("text"), F.lit(SPACE))
    own = own.withColumns({"said": said, "fault": F.when(body == "", "blank").when(~F.right(body, F.lit(1)).isin(".", "!", "?"), "truncated")})
    first = own.groupBy("said").agg(F.min(_before(F.col("turn"))).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n")
    late = F.coalesce(_before(F.col("turn")) > F.col("first"), F.lit(False))
    return own.join(first, "said", "left").select("conv", "turn", "role", "text", "said", late.alias("late"), "fault")


class Node:
    """An edit on the way to some survivors: its letter, role and row, and those that follow it."""

    __slots__ = ("parent", "edit", "role", "rows", "kids", "held")

    def __init__(self, parent: Node | None, edit: str, role: str | None, rows: list[Any]):
        self.parent, self.edit, self.role, self.rows, self.kids, self.held = parent, edit, role, rows, [], False
        if parent is not None:
            parent.kids.append(self)

    def letters(self) -> str:
        return self.edit * max(1, len(self.rows))


class Repair:
    """The search over one conversation. ``step`` and ``end`` yield final edits (letter, role, row); ``row`` is None for an insert."""

    def __init__(self) -> None:
        self.root = Node(None, "", None, [])
        self.root.held = True
        self.at: dict[int, tuple[int, Node]] = {0: (0, self.root)}
        self.gone: list[Any] | None = None

    def _path(self, node: Node) -> str:
        out = []
        while node is not self.root:
            out.append(node.letters())
            node = node.parent
        return "".join(reversed(out))

    def _least(self, found: list[tuple[int, Node, str, int]]) -> tuple[int, Node, str, int]:
        """Of (cost, node, further letters, state): the cheapest, then the one whose whole unresolved edits are least."""
        low = min(f[0] for f in found)
        tied = [f for f in found if f[0] == low]
        return tied[0] if len(tied) == 1 else min(tied, key=lambda f: self._path(f[1]) + f[2])

    def _move(self, chosen: dict[int, tuple[int, Node, str, int]], target: dict[int, str | None], row: Any) -> None:
        old, new = [node for _, node in self.at.values()], {}
        for state, (cost, node, letters, start) in chosen.items():
            for m in range(len(letters) - 1):
                node = Node(node, "I", ROLES[INSERTS[start][m + 1]], [])
            new[state] = (cost, Node(node, letters[-1], target[state] if letters[-1] == "R" else None, [row]))
        self._hold(old, new)

    def _hold(self, old: list[Node], new: dict[int, tuple[int, Node]]) -> None:
        for node in old:
            node.held = False
        for _, node in new.values():
            node.held = True
        for node in old:
            while node is not self.root and not node.kids and not node.held:
                node.parent.kids.remove(node)
                node = node.parent
        self.at = new

    def _prune(self) -> None:
        """A state that no continuation can bring below another one: whatever follows on nothing or a system row also follows on
        an assistant row, at no more than the removal of one system row."""
        if 3 not in self.at and 2 not in self.at:
            return
        ahead = min(self.at.get(3, (1 << 62,))[0], self.at.get(2, (1 << 62,))[0] + INSERT)
        keep = {s: x for s, x in self.at.items() if s > 1 or x[0] <= ahead + (DELETE if s == 0 else 0)}
        if len(keep) < len(self.at):
            self._hold([x[1] for s, x in self.at.items()], keep)

    def _final(self) -> Iterator[tuple[str, str | None, Any]]:
        """Edits that all survivors share. The root's last run of forced deletions is not final while it can grow."""
        while len(self.root.kids) == 1 and not self.root.held and self.root.kids[0].rows is not self.gone:
            self.root = self.root.kids[0]
            yield from self._edits(self.root)
            self.root.parent, self.root.rows = None, []

    @staticmethod
    def _edits(node: Node) -> Iterator[tuple[str, str | None, Any]]:
        for row in node.rows or [None]:
            yield node.edit, node.role, row

    def step(self, row: Any, initial: str, must_go: bool, truncated: bool) -> Iterator[tuple[str, str | None, Any]]:
        if must_go:
            # inserts before it are never better than behind it; a run of such rows is one node of each survivor, with one list of rows
            if len(self.at) == 1:  # a lone survivor is the root
                self.at = {s: (cost + DELETE, node) for s, (cost, node) in self.at.items()}
                yield "D", None, row
            elif self.gone is not None:
                self.gone.append(row)
                self.at = {s: (cost + DELETE, node) for s, (cost, node) in self.at.items()}
            else:
                self.gone = [row]
                self._hold([n for _, n in self.at.values()], {s: (cost + DELETE, Node(node, "D", None, self.gone)) for s, (cost, node) in self.at.items()})
            return
        self.gone = None
        found: dict[int, list] = {}
        more = TRUNCATED if truncated else 0
        befores, after = KEEP.get(initial, ((), 0))
        for start, (cost, node) in self.at.items():
            found.setdefault(start, []).append((cost + DELETE, node, "D", start))
            for m, state in enumerate(INSERTS[start]):
                now = cost + INSERT * m + more
                if state in befores:
                    found.setdefault(after, []).append((now, node, "I" * m + "K", start))
                found.setdefault(3 if state == 2 else 2, []).append((now + REROLE, node, "I" * m + "R", start))
        self._move({s: self._least(f) for s, f in found.items()}, ROLES | {0: None, 1: None}, row)
        self._prune()
        yield from self._final()

    def size(self) -> int:
        """Edits that are held."""
        found, left = 0, [self.root]
        while left:
            found += len(left)
            left = [k for node in left for k in node.kids]
        return found - 1

    def end(self) -> Iterator[tuple[str, str | None, Any]]:
        found = [(cost + INSERT * m, node, "I" * m, s) for s, (cost, node) in self.at.items() for m, state in enumerate(INSERTS[s]) if state in (0, 3)]
        _, node, letters, start = self._least(found)
        path = []
        while node is not self.root:
            path.append(node)
            node = node.parent
        for node in reversed(path):
            yield from self._edits(node)
        for m in range(len(letters)):
            yield "I", ROLES[INSERTS[start][m + 1]], None


EDITS = [("edit", T.StringType()), ("role", T.StringType()), ("text", T.StringType()), ("was", T.StringType()), ("fault", T.StringType())]


def repair_conversations(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The edits of each conversation in order, one a row: ``conv_col``, ``place`` (from 0), ``turn_col``, ``edit``, ``role``,
    ``text``, ``was`` (initial of the role before), ``fault``. Rows with an ``edit`` other than D are the repaired conversation.

    Keep (K) is free, Rerole to user or assistant (R) costs 1, Delete (D) 2, Insert of an empty user or assistant row (I) 5, a truncated row
    that stays 5 more. Blank rows and duplicates go. Of the cheapest edits the ASCII-least are taken.

    * Rows are taken by turn, nulls first; of one turn by role, then a digest of the text, so equal rows are adjacent.
    * ``fault`` is the first of: ``blank`` (no visible character), ``duplicate`` (role and text seen earlier in the conversation),
      ``truncated`` (last visible character none of ``.!?``). Rows repeated in a table are duplicates.
    * Null conversations are one conversation; null role or text is one space. A row whose role has no initial of s, u or a is not kept as it is.
    * Very long texts pass through one at a time; other columns are not read. An empty table gives no rows.
    * Rows of one conversation stream through one task, in its sort order, and within a partition come out in that order;
      what the task holds is one batch and the rows over which survivors differ. Runs of blank and repeated rows are held without texts.
    """
    own = faulty_rows(rows, conv_col, turn_col, role_col, text_col)
    dealt = own.repartition("conv").sortWithinPartitions("conv", _before(F.col("turn")), "role", "said")
    schema = T.StructType([T.StructField(conv_col, own.schema["conv"].dataType), T.StructField("place", T.LongType()), T.StructField(turn_col, own.schema["turn"].dataType), *(T.StructField(n, k) for n, k in EDITS)])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]

    def edits(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        now, search, place, last = None, None, 0, None

        def out(found: Iterator[tuple[str, str | None, Any]]) -> Iterator[tuple]:
            nonlocal place
            for edit, role, row in found:
                turn, was, text, fault = row or (None, None, "", None)
                yield now[0], place, turn, edit, None if edit == "D" else role or was, None if edit == "D" else text, None if was is None else was[:1], fault
                place += 1

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for conv, turn, role, text, said, late, fault in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if now is None or (conv,) != now:
                        if now is not None:
                            yield from out(search.end())
                        now, search, place, last = (conv,), Repair(), 0, None
                    if fault != "blank" and (late or (turn, said) == last):
                        fault = "duplicate"
                    last = (turn, said)
                    must_go = fault in ("blank", "duplicate")
                    yield from out(search.step((turn, role, None if must_go else text, fault), role[:1], must_go, fault == "truncated"))
        if now is not None:
            yield from out(search.end())

    def batched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for row in edits(batches):
            held.append(row)
            size += len(row[5] or "")
            if size >= 1 << 22 or len(held) >= 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)
                held, size = [], 0
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)

    return dealt.mapInArrow(batched, schema)


SUMMARY = ["gaps", *FAULTS, "illegal", "cost"]


def repair_summaries(edits: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """One row a conversation of ``repair_conversations`` (its result as it is: no shuffle, the order is used): ``conv_col``, ``gaps``, ``blank``,
    ``duplicate``, ``truncated``, ``illegal``, ``cost``, ``audit`` (the edits' letters), ``repaired_sha256`` (of the repaired
    ``role:text``, joined by line breaks, in an incremental digest).

    ``gaps``: turns missing between the first and the last; ``illegal``: adjacent rows before the repair that are neither
    su, ua nor au. Only the letters of a conversation are held.
    """
    schema = T.StructType([edits.schema[conv_col], *(T.StructField(n, T.LongType()) for n in SUMMARY), T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])
    from pyspark.sql.pandas.types import to_arrow_type

    types = [to_arrow_type(f.dataType) for f in schema]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, letters, counts, turns, state, before, kept = None, [], {}, None, None, None, 0

        def ended() -> tuple:
            first, last, distinct = turns
            gaps = 0 if first is None else last - first + 1 - distinct
            return now[0], gaps, *(counts[c] for c in SUMMARY[1:]), "".join(letters), state.hexdigest()

        held: list[tuple] = []

        def table() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*held, strict=True), types, strict=True)], names=schema.names)

        for batch in batches:
            for start in range(0, batch.num_rows, 256):
                for conv, _, turn, edit, role, text, was, fault in zip(*(c.to_pylist() for c in batch.slice(start, 256).columns), strict=True):
                    if now is None or (conv,) != now:
                        if now is not None:
                            held.append(ended())
                            if len(held) >= 1000:
                                yield table()
                                held = []
                        now, letters, counts, turns, state, before, kept = (conv,), [], dict.fromkeys(SUMMARY, 0), (None, None, 0), hashlib.sha256(), None, 0
                    letters.append(edit)
                    counts["cost"] += {"K": 0, "R": REROLE, "D": DELETE, "I": INSERT}[edit] + TRUNCATED * (fault == "truncated" and edit != "D")
                    if edit != "I":
                        if fault:
                            counts[fault] += 1
                        if before is not None and before + was not in ("su", "ua", "au"):
                            counts["illegal"] += 1
                        before = was
                        if turn is not None and turn != turns[1]:
                            turns = (turn if turns[0] is None else turns[0], turn, turns[2] + 1)
                    if edit != "D":
                        state.update(f"{chr(10) * (kept > 0)}{role}:{text}".encode())
                        kept += 1
        if now is not None:
            held.append(ended())
        if held:
            yield table()

    return edits.mapInArrow(run, schema)


def summaries_of_all(rows: DataFrame, summaries: DataFrame, conv_col: str = "conv_id") -> DataFrame:
    """``summaries`` with a row of zeros, an empty ``audit`` and the digest of nothing for each conversation of ``rows`` that has none."""
    all_of_them = rows.select(F.col(conv_col).alias("__conv")).distinct()
    joined = all_of_them.join(summaries, F.col("__conv").eqNullSafe(F.col(conv_col)), "left")
    nothing = hashlib.sha256().hexdigest()
    return joined.select(
        F.col("__conv").alias(conv_col), *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in SUMMARY],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(nothing)).alias("repaired_sha256"),
    )
