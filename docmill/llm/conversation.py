"""Repair of conversation structure: the cheapest edits after which roles read `(s?(ua)+)?`.

Rows of a conversation are taken in order of their turns. Blank rows and repeats have to go; a row may be kept, given the
role user or assistant, or deleted, and empty turns may be inserted. A Viterbi search over four states (nothing yet,
system, user, assistant) finds the cheapest edits, of equally cheap ones those whose initials are least in ASCII. Each
state's survivor is a leaf of one tree of back pointers whose nodes count their children. A survivor that is replaced
takes with it the branch that only it held; as soon as the root has a single child, all survivors share that edit, so it
is emitted and the child becomes the root. Memory thus holds what is still undecided, not the conversation.

Equal costs are settled by the whole undecided edits of both, from the ancestor they share: paths of equal cost over the
same rows are never prefixes of each other, since all that one could have more are insertions, which cost. How two
survivors compare is remembered with them, so their descendants need not walk back again. Two dominance rules keep
survivors close: none that costs more than the assistant state's and the deletion of one more row can win, and a system
state that is not better than the assistant state's has no advantage left.

One shuffle brings a conversation's rows together, sorted; a function streams through them in Arrow batches and keeps the
state across batches, so a conversation with a third of all rows is never held in memory. It does pass through one task,
as its contract asks for one sha256 of all its repaired text, a function that takes the bytes in order. Repeats are told
apart before, by aggregated first turns of 128-bit hashes of (role, text) within a conversation, where a text that a
third of all rows share is one row.

Defined results: a null role or text counts as one space, so such a text is blank; texts may be empty or of any length;
rows with a null turn come first, of equal turns those with the lesser role, then text; rows equal in all of them are
repeats but for the first; null is a conversation; extra columns take no part, whatever their names; a conversation
whose rows are all said to be absent has zeros and no edits; gaps beyond the largest long count as it; an empty table
gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import SPACE

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
COSTS = {KEEP: 0, REROLE: 1, DELETE: 2, INSERT: 5}
TRUNCATED = 5
#: States: nothing, system, user, assistant; the role that a state's edits give, and where each may come from.
NONE, SYSTEM, USER, ASSISTANT = range(4)
ROLE = {USER: "user", ASSISTANT: "assistant"}
BEFORE = {USER: (NONE, SYSTEM, ASSISTANT), ASSISTANT: (USER,)}
LEGAL = {"su", "ua", "au"}
LONGS = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
MOST = (1 << 63) - 1


class Node:
    """An edit, and how many survivors or later edits follow it."""

    __slots__ = ("parent", "edit", "row", "depth", "kids", "serial")

    def __init__(self, parent: Node | None, edit: str, row: tuple | None, serial: int):
        self.parent, self.edit, self.row, self.serial = parent, edit, row, serial
        self.depth = parent.depth + 1 if parent else 0
        self.kids: dict[int, Node] = {}
        if parent:
            parent.kids[serial] = self


class Survivors:
    """The search over one conversation; emits (edit, row) in order, row being (turn, role, text) or None."""

    def __init__(self):
        self.serial = 0
        self.root = Node(None, "", None, 0)
        self.best: list[tuple[int, Node] | None] = [(0, self.root), None, None, None]
        self.order: dict[tuple[int, int], bool] = {}
        self.fresh: list[Node] = []
        self.insertions(self.best)

    def child(self, parent: Node, edit: str, row: tuple | None) -> Node:
        self.serial += 1
        node = Node(parent, edit, row, self.serial)
        self.fresh.append(node)
        return node

    def less(self, x: Node, y: Node) -> bool:
        """Whether x's edits are before y's in ASCII, both over the same rows."""
        a, b = x.parent, y.parent
        if a is b and x.edit != y.edit:
            return x.edit < y.edit
        for p, q in ((x, y), (a, b), (x, b), (a, y)):
            if p and q and (p.serial, q.serial) in self.order:
                return self.order[p.serial, q.serial]
        left, right = [], []
        while x is not y:
            if x.depth >= y.depth:
                left.append(x.edit)
                x = x.parent
            else:
                right.append(y.edit)
                y = y.parent
        return left[::-1] < right[::-1]

    def offer(self, best: list, state: int, cost: int, parent: Node, edit: str, row: tuple | None) -> None:
        """Takes parent and one more edit as the state's survivor if that is better."""
        now = best[state]
        if now and now[0] < cost:
            return
        node = self.child(parent, edit, row)
        if not now or cost < now[0] or self.less(node, now[1]):
            best[state] = (cost, node)

    def forget(self, node: Node) -> None:
        """Cuts a branch back to the first edit that others need."""
        while node.parent and not node.kids and not any(s and s[1] is node for s in self.best):
            parent, node.parent = node.parent, None
            del parent.kids[node.serial]
            node = parent

    def insertions(self, best: list) -> None:
        for state in (USER, ASSISTANT):
            for before in BEFORE[state]:
                if best[before]:
                    cost, node = best[before]
                    self.offer(best, state, cost + COSTS[INSERT], node, INSERT, (None, ROLE[state], ""))

    def add(self, row: tuple, must_go: bool, truncated: bool) -> Iterator[tuple[str, tuple | None]]:
        """Takes the next row; yields the edits that are settled now."""
        turn, role, text = row
        best: list[tuple[int, Node] | None] = [None] * 4
        for state, old in enumerate(self.best):
            if old:
                self.offer(best, state, old[0] + COSTS[DELETE], old[1], DELETE, None)
        if not must_go:
            extra, initial = TRUNCATED * truncated, role[:1]
            if initial == "s" and self.best[NONE]:
                self.offer(best, SYSTEM, self.best[NONE][0] + extra, self.best[NONE][1], KEEP, row)
            for state, own in ((USER, "u"), (ASSISTANT, "a")):
                for before in BEFORE[state]:
                    if old := self.best[before]:
                        if initial == own:
                            self.offer(best, state, old[0] + extra, old[1], KEEP, row)
                        else:
                            self.offer(best, state, old[0] + extra + COSTS[REROLE], old[1], REROLE, (turn, ROLE[state], text))
        self.insertions(best)
        least, ended = best[ASSISTANT]
        for state in (NONE, USER):
            if best[state] and best[state][0] > least + COSTS[DELETE]:
                best[state] = None
        if (s := best[SYSTEM]) and (s[0] > least or (s[0] == least and self.less(ended, s[1]))):
            best[SYSTEM] = None
        self.replace(best)
        yield from self.settled()

    def replace(self, best: list) -> None:
        """best are the survivors from now on; the tree keeps only what they come from."""
        alive = [s[1] for s in best if s]
        order = {}
        for x in alive:
            for y in alive:
                if x is not y and x.parent is not y and y.parent is not x and (x.parent is None or y.parent is None or x.parent.parent is not y and y.parent.parent is not x):
                    order[x.serial, y.serial] = self.less(x, y)
        made, old = self.fresh, [s[1] for s in self.best if s]
        self.best, self.order, self.fresh = best, order, []
        for node in [*reversed(made), *old]:
            self.forget(node)

    def settled(self) -> Iterator[tuple[str, tuple | None]]:
        while len(self.root.kids) == 1 and not any(s and s[1] is self.root for s in self.best):
            (kid,) = self.root.kids.values()
            kid.parent, self.root = None, kid
            yield kid.edit, kid.row

    def undecided(self) -> int:
        return max(s[1].depth for s in self.best if s) - self.root.depth

    def end(self) -> tuple[int, list[tuple[str, tuple | None]]]:
        """The cost of it all and the edits that were still open."""
        cost, node = self.best[ASSISTANT]
        if (none := self.best[NONE]) and (none[0] < cost or (none[0] == cost and self.less(none[1], node))):
            cost, node = none
        rest = []
        while node is not self.root:
            rest.append((node.edit, node.row))
            node = node.parent
        return cost, rest[::-1]


class Conversation:
    """Figures of one conversation, row by row."""

    def __init__(self):
        self.search, self.sha, self.audit = Survivors(), hashlib.sha256(), []
        self.blank = self.duplicate = self.truncated = self.illegal = self.turns = 0
        self.first = self.last = self.before = None
        self.places = 0

    def row(self, turn: int | None, role: str, text: str, blank: bool, seen: bool, cut: bool) -> Iterator[tuple]:
        if turn is not None:
            self.turns += self.last != turn
            self.first, self.last = turn if self.first is None else self.first, turn
        self.illegal += self.before is not None and self.before[1][:1] + role[:1] not in LEGAL
        seen = seen or self.before == (turn, role, text)
        self.before = (turn, role, text)
        self.blank += blank
        self.duplicate += seen and not blank
        self.truncated += cut and not blank and not seen
        for edit in self.search.add((turn, role, text), blank or seen, cut and not blank and not seen):
            yield self.done(*edit)

    def done(self, edit: str, row: tuple | None) -> tuple:
        """Writes an edit into the audit and the digest."""
        self.audit.append(edit)
        if row:
            self.sha.update(f"{chr(10) if self.places else ''}{row[1]}:{row[2]}".encode())
            self.places += 1
        return (len(self.audit), edit, *(row or (None, None, None)))

    def end(self) -> tuple[tuple, list[tuple]]:
        cost, rest = self.search.end()
        edits = [self.done(*e) for e in rest]
        gaps = 0 if self.first is None else min(MOST, self.last - self.first + 1 - self.turns)
        return (gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(self.audit), self.sha.hexdigest()), edits


def damaged(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> tuple[DataFrame, Column]:
    """Conversations with planted damage, by crc32 of `conv:turn` % 20, and a condition that is false for rows it drops.

    0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it, 4 gives it the role user; nulls are one
    space.
    """
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(spaced(conv_col), F.lit(":"), spaced(turn_col)).cast("binary")) % 20
    text = F.when(kind == 1, "").when(kind == 2, F.regexp_replace(spaced(text_col), "[.!?]", "")).otherwise(spaced(text_col))
    role = F.when(kind == 4, "user").otherwise(spaced(role_col))
    copies = F.explode(F.when(kind == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    out = rows.select(F.col(conv_col), F.col(turn_col), role.alias(role_col), text.alias(text_col), (kind != 0).alias("present"), copies.alias("copy")).drop("copy")
    return out, F.col("present")


def marked(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str, present: Column | None) -> DataFrame:
    """(conv, turn, role, text, present, blank, seen, cut); seen: role and text occur at an earlier turn of the conversation."""
    spaced = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    here = F.lit(True) if present is None else F.coalesce(present, F.lit(False))
    d = rows.select(F.col(conv_col).alias("conv"), F.col(turn_col).cast("long").alias("turn"), spaced(role_col).alias("role"), spaced(text_col).alias("text"), here.alias("present"))
    end = F.right(F.rtrim("text", F.lit(SPACE)), F.lit(1))
    d = d.withColumns({"blank": end == "", "cut": ~end.isin(".", "!", "?"), "h1": F.xxhash64("role", "text"), "h2": F.xxhash64(F.lit("second"), "text", "role"), "at": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn").alias("turn"))})
    firsts = d.where("present").groupBy("conv", "h1", "h2").agg(F.min("at").alias("first"), F.max("at").alias("last")).where("first < last")
    firsts = firsts.select(F.col("conv").alias("f_conv"), F.col("h1").alias("f1"), F.col("h2").alias("f2"), "first")
    same = F.col("conv").eqNullSafe(F.col("f_conv")) & (F.col("h1") == F.col("f1")) & (F.col("h2") == F.col("f2"))
    seen = F.coalesce(F.col("at") > F.col("first"), F.lit(False)).alias("seen")
    return d.join(firsts, same, "left").select("conv", "turn", "role", "text", "present", "blank", seen, "cut")


def repair(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", present: Column | None = None, edits: bool = False
) -> DataFrame:
    """One row for each conversation: conv_col, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    Rows for which present is not true are not there, but their conversation is. With edits, the edits themselves
    instead, as they are settled: conv_col, place from 1, edit, turn, role, text, the last three null for deletions; the
    rows that have a role are the repaired conversation.
    """
    kind = rows.schema[conv_col].dataType
    d = marked(rows, conv_col, turn_col, role_col, text_col, present)
    d = d.repartition("conv").sortWithinPartitions("conv", F.col("turn").asc_nulls_first(), "role", "text")
    name = T.StructField(conv_col, kind)
    if edits:
        out = T.StructType([name, T.StructField("place", T.LongType()), T.StructField("edit", T.StringType()), T.StructField("edit_turn", T.LongType()), T.StructField("edit_role", T.StringType()), T.StructField("edit_text", T.StringType())])
    else:
        out = T.StructType([name, *[T.StructField(c, T.LongType()) for c in LONGS], T.StructField("audit", T.StringType()), T.StructField("repaired_sha256", T.StringType())])

    def repaired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, conv, names, found, key_type = None, None, [], [], pa.null()

        def flush() -> pa.RecordBatch:
            columns = [pa.array(names, key_type), *[pa.array(c, f) for c, f in zip(zip(*found, strict=True), forms, strict=True)]]
            batch = pa.RecordBatch.from_arrays(columns, names=out.names)
            names.clear()
            found.clear()
            return batch

        def close() -> None:
            summary, rest = now.end()
            for x in rest if edits else [summary]:
                names.append(conv)
                found.append(x)

        forms = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string()] if edits else [*[pa.int64()] * len(LONGS), pa.string(), pa.string()]
        for batch in batches:
            key_type = batch.column(0).type
            for key, turn, role, text, here, blank, seen, cut in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if now is None or key != conv:
                    if now:
                        close()
                    now, conv = Conversation(), key
                if here:
                    for edit in now.row(turn, role, text, blank, seen, cut):
                        if edits:
                            names.append(conv)
                            found.append(edit)
                if len(found) >= 1000:
                    yield flush()
        if now:
            close()
        if found:
            yield flush()

    return d.mapInArrow(repaired, out)
