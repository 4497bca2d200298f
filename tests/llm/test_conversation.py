"""Conversation repair against all edits tried out, and against a plain table of best edits for longer ones."""

import hashlib
import random
import re
import zlib
from functools import cache

from pyspark.sql import functions as F

from docmill.llm import conversation as cv

FORM = re.compile(r"(s?(ua)+)?")


def marks(rows):
    """Rows in order with their first fault."""
    seen, out = set(), []
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end not in ".!?" else ""
        seen.add((role, text))
        out.append((role, text, fault))
    return out


def exhaustive(rows):
    """Every sequence of edits with at most three insertions; only for very few rows."""
    best = None

    def go(i, cost, audit, roles, inserted):
        nonlocal best
        if i == len(rows) and FORM.fullmatch("".join(r[:1] for r, _ in roles)):
            best = min(best, (cost, audit, roles), key=lambda x: x[:2]) if best else (cost, audit, roles)
        if inserted < 3:
            for r in ("user", "assistant"):
                go(i, cost + 5, audit + "I", (*roles, (r, "")), inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            go(i + 1, cost + 2, audit + "D", roles, inserted)
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                go(i + 1, cost + extra, audit + "K", (*roles, (role, text)), inserted)
                for r in ("user", "assistant"):
                    go(i + 1, cost + 1 + extra, audit + "R", (*roles, (r, text)), inserted)

    go(0, 0, "", (), 0)
    return best


def tabled(rows):
    """The same from the end: least (cost, audit, roles) from each row and state, with whole strings."""

    @cache
    def go(i, state, inserted):
        options = [(0, "", ())] if i == len(rows) and state in ("", "a") else []

        def then(cost, edit, role, nxt, j, more=0):
            rest = go(j, nxt, more)
            if rest:
                options.append((cost + rest[0], edit + rest[1], (*([role] if role else []), *rest[2])))

        after = "a" if state == "u" else "u"
        name = {"a": "assistant", "u": "user"}[after]
        if inserted < 2:
            then(5, "I", (name, ""), after, i, inserted + 1)
        if i < len(rows):
            role, text, fault = rows[i]
            then(2, "D", None, state, i + 1)
            if fault in ("", "truncated"):
                extra = 5 if fault else 0
                if role[:1] == after or (state == "" and role[:1] == "s"):
                    then(extra, "K", (role, text), role[:1], i + 1)
                then(extra + 1, "R", (name, text), after, i + 1)
        return min(options, key=lambda x: x[:2]) if options else None

    return go(0, "", 0)


def plain(rows, solve=tabled):
    m = marks(rows)
    turns = [t for t, _, _ in rows if t is not None]
    illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(m, m[1:]))
    cost, audit, roles = solve(m)
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    body = "\n".join(f"{r}:{t}" for r, t in roles)
    return (gaps, *[sum(f == k for _, _, f in m) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256(body.encode()).hexdigest())


def some_rows(r, n, roles=("user", "assistant", "system", "tool", " ")):
    weights = [6, 6, 1, 0.5, 0.3][: len(roles)]
    return [(r.choice([None, i, i, i, i + 2]), r.choices(roles, weights)[0], r.choice([f"text {i}.", f"text {i}?", f"open {i}", "same.", "", " \n"] + [f"t{i}!"] * 6)) for i in range(n)]


def searched(rows):
    c = cv.Conversation()
    seen, longest = set(), 0
    for turn, role, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode())):
        end = text.rstrip(" \t\n\x0b\x0c\r")[-1:]
        list(c.row(turn, role, text, not end, (role, text) in seen, end not in (".", "!", "?")))
        seen.add((role, text))
        longest = max(longest, c.search.undecided())
    return c.end()[0], longest


def test_search_equals_all_edits_tried_out():
    r = random.Random(3)
    for _ in range(400):
        rows = some_rows(r, r.randint(0, 4))
        assert plain(rows, exhaustive) == plain(rows) == searched(rows)[0], rows


def test_search_equals_the_table_on_longer_ones():
    r = random.Random(5)
    for k in range(600):
        rows = some_rows(r, r.randint(5, 60), [("user", "assistant", "system", "tool", " "), ("assistant",), ("user", "assistant"), ("system", "user")][k % 4])
        assert plain(rows) == searched(rows)[0], rows


def test_memory_holds_only_what_is_undecided():
    r = random.Random(6)
    rows = [(i, r.choice(["user", "assistant"]), f"text {i}.") for i in range(20_000)]
    assert searched(rows)[1] < 200
    alternating = [(i, ("user", "assistant")[i % 2], f"text {i}.") for i in range(20_000)]
    got, longest = searched(alternating)
    assert got[5] == 0 and got[6] == "K" * 20_000 and longest < 10
    one_role = [(i, "assistant", f"text {i}.") for i in range(20_001)]  # where the deletion goes is open until the end
    assert searched(one_role)[0][6] == "D" + "RK" * 10_000


def test_operator_on_tables(spark):
    r = random.Random(8)
    rows = [(c, *row) for c in [None, *range(60)] for row in some_rows(r, r.randint(1, 12))]
    rows += [(100, i, r.choice(["user", "assistant"]), f"row {i % 900}.") for i in range(3000)]  # a third of all rows
    d = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({x: F.lit(7) for x in ("conv", "present", "blank", "seen", "cut", "h1", "at", "first", "place", "edit")}).repartition(7)
    d = d.withColumn("turn", F.when(F.col("conv_id") == 3, None).otherwise(F.col("turn")))
    got = {x.conv_id: tuple(x)[1:] for x in cv.repair(d).collect()}
    by = {c: [(None if c == 3 else t, role, text) for k, t, role, text in rows if k == c] for c in {k for k, *_ in rows}}
    for c, own in by.items():
        if c != 100:
            assert got[c] == plain(own), (c, own)
    assert got[100] == searched(by[100])[0] and set(got) == set(by)
    edits = cv.repair(d, edits=True).collect()
    for c in by:
        own = sorted((x.place, x.edit, x.edit_role, x.edit_text) for x in edits if x.conv_id == c)
        assert "".join(e for _, e, _, _ in own) == got[c][6]
        assert hashlib.sha256("\n".join(f"{a}:{t}" for _, _, a, t in own if a is not None).encode()).hexdigest() == got[c][7]
    assert cv.repair(d.limit(0)).count() == 0


def test_damage_and_absent_conversations(spark):
    rows = [(c, t, ("user", "assistant", None)[(c + t) % 3], f"Row {t} of {c}. Yes!" if t % 5 else None) for c in range(40) for t in range(6)] + [(None, 2, "user", "Hi."), (7, None, "user", "x.")]
    hurt, present = cv.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    by = {c: [] for c in {r[0] for r in rows}}
    for c, t, role, text in rows:
        role, text = role or " ", " " if text is None else text
        k = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        if k == 0:
            continue
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        by[c] += [(t, "user" if k == 4 else role, text)] * (2 if k == 3 else 1)
    got = {x.conv_id: tuple(x)[1:] for x in cv.repair(hurt, present=present).collect()}
    assert got == {c: plain(own) for c, own in by.items()}
    none = cv.repair(spark.createDataFrame([(1, 1, "user", "a.")], "conv_id long, turn long, role string, text string"), present=F.lit(False)).first()
    assert tuple(none) == (1, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
