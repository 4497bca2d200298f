"""Line-first cleaning against a plain version, line by line and word by word."""

import random
import re
from collections import defaultdict

from docmill.llm import quality_rules as qr

SPACE = " \t\n\x0b\x0c\r"


def low(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def fault(line):
    w = split(line)
    if sum(x in qr.SEPARATORS for x in w) >= max(3, len(w) / 5):
        return "navigation"
    if any(p in low(line) for p in qr.PHRASES):
        return "boilerplate"
    signs = sum(bool(re.search(r"[#*$%&|<>]{2}", x)) for x in w)
    shouts = sum(x.endswith("!!") for x in w)
    if not re.search(r"[.!?…。！？:;][\"'”’»)\]]*$", w[-1]) or signs * 4 >= len(w) or shouts * 4 >= len(w):
        return "punctuation"
    return None


def plain(text):
    text = text or ""
    w, lines = split(text), text.split("\n")
    windows = defaultdict(list)
    for i in range(len(w) - 2):
        windows[tuple(w[i : i + 3])].append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(3)}
    worded = [x for x in lines if split(x)]
    faults = {x: fault(x) for x in worded}
    by = {r: sum(len(split(x)) for x in worded if faults[x] == r) for r in ("navigation", "boilerplate", "punctuation")}
    base = len(w) < 50 or 100 * len(repeated) > 50 * len(w)
    lost = sum(by.values())
    kept = not base and lost * 100 <= len(w) * 30 and len(w) - lost >= 50
    return (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(worded) - len(set(worded)), len(repeated), *by.values(), lost, base, kept, "\n".join(x for x in lines if not faults.get(x)))


def texts():
    r = random.Random(4)
    words = ["tree", "river", "stone", "água", "light's", "cloud,", "|", "»", "a$$", "b##", "NO!!", "x*y", "日本", "end.", "(so.)", "why?"]
    out = [None, "", "\n", " \t\n \r", "a", "a b", "a b c", "a b c a b c", "\n\nx. \n", "Click here.\nclick HERE now.", "| | |", "a | b | c | d", "end.\nend.\n end.\nend.", "x\x0by\x0cz.", "||", "!!"]
    for n in (5, 30, 60, 200, 900):
        for _ in range(25):
            few = words[: r.randint(3, len(words))] + [f"w{i}" for i in range(r.choice([0, 40, 400]))]
            lines, left = [], n
            while left > 0:
                k = r.randint(1, 30)
                lines.append(" ".join(r.choice(few) for _ in range(k)) + r.choice([".", ".", ".", "", "!!", '."', " All Rights reserved.", " \r"]))
                left -= k
            out.append("\n".join(lines + lines[: r.randint(0, 2)]))
    return out + ["word. " * 30_000, "q" * 60_000]


def test_equals_the_plain_version(spark):
    rows = list(enumerate(texts()))
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (*[r.rules[c] for c in qr.LONGS], r.rules.base_failed, r.rules.kept, r.rules.kept_text) for r in qr.clean_lines(d, slice_bytes=3000).collect()}
    for i, t in rows:
        assert got[i] == plain(t), (i, t[:200] if t else t)
    assert {g[10] for g in got.values()} == {True, False} and sum(g[9] for g in got.values()) < len(rows) - 10


def test_verdicts(spark):
    clean = " ".join(f"The {a}{b} word{a}{b} stands{b}{a} here." for a in "abcdefgh" for b in "stuvwxyz")
    menu = " ".join(f"Item{i} |" for i in range(300))
    rows = [(0, clean), (1, f"{clean}\n{menu}"), (2, f"{clean}\nHome | About | Help | Contact\nAll rights reserved."), (3, clean[:200]), (4, "Say it again. " * 60), (5, clean.replace(" ", "$$$ "))]
    got = {r.doc_id: r.rules.reason for r in qr.clean_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {0: None, 1: "too_much_lost", 2: None, 3: "too_few_words", 4: "too_many_repeats", 5: "too_much_lost"}
