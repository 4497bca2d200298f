"""Toxicity scoring behind a noisy channel: Viterbi decoding of disguised words, then a lexical classifier.

The channel turns letters into digits and signs, draws a letter out, or sets letters apart. A word that shows such
signs spans a character lattice: each sign may stand for itself or for the letters it imitates, a run of three or more
equal letters for one, two or all of them, and single letters set apart for one word or several. The path with the best sum of
channel costs and log probabilities under a character trigram model of the whole corpus is the restored word. Words
without such signs have one path and stay as they are.

The classifier learns weights of restored words and word beginnings from a bounded sample of labelled rows, and a
logistic curve over their sum. A weight is a smoothed log-odds, for or against, drawn to 0 by some of its standard
deviations; no feature is dropped for being rare, so small tables teach as well. The curve is fitted on each labelled
text's evidence without what the text itself taught, and so is the number of deviations chosen. The lexicon's size is bounded by the sample's; whole texts, words
of any length and all evidence count.

Defined results: null and empty texts have no words and get the curve's value at 0; a text's score depends on it
alone, so repeated rows and ties agree; other columns pass through, whatever their names; without labels every score is 0, and
with labels of one kind only no word tells anything, so all scores are equal; an empty table gives an
empty result.
"""

from __future__ import annotations

import math
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import slices
from .common import free_name, staged
from .training import held_out, labelled_sample

#: What signs stand for in disguised words.
LEET = {"0": "o", "1": "il", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l"}
EDGES = ".,;:!?\"'()[]{}<>*#%&$-_"
#: Standard deviations by which weights may be drawn to 0; the labelled texts tell which does best.
CERTAIN = (2.0, 2.5, 3.0, 3.5)
SIGN = re.compile(r"[^\W\d_]+[0-9@$!|+(€£]|[0-9@$|+(€£][^\W\d_]")
DRAWN = re.compile(r"([^\W\d_])\1\1")
APART = re.compile(r"(?<!\S)(?:[\w@$!|+€£][ .\-_*]){2,}[\w@$!|+€£](?!\S)")
#: Exclamation marks and repeated signs behind a word say nothing about its letters.
TAIL = re.compile(r"(?:!+|([^\w\s])\1{2,})$")
SEPARATORS = str.maketrans("", "", " .-_*")
#: Symbols of the character model: 0 edge of a word, 1-26 letters, 27 other letters, 28 digits and signs.
SYMBOLS, OTHER, SIGNS = 29, 27, 28
SUBSTITUTE, SHORTEN, JOIN = -1.0, -0.2, -0.5
MEMO = 300_000


def symbol_table() -> np.ndarray:
    table = np.full(256, SIGNS, np.int64)
    table[[32, 9, 10, 11, 12, 13]] = 0
    table[65:91] = table[97:123] = np.arange(1, 27)
    table[192:] = OTHER
    return table


BYTE_SYMBOL = symbol_table()


def symbol(c: str) -> int:
    return ord(c) - 96 if "a" <= c <= "z" else OTHER if c.isalpha() else SIGNS


def character_model(docs: DataFrame, text_col: str) -> np.ndarray:
    """log10 P(c | a b) over the whole corpus, add-one smoothed; what is gathered is one small table."""

    def count(batches):
        total = np.zeros(SYMBOLS**3, np.int64)
        for batch in batches:
            for _, data, _ in slices(batch, "text", 1 << 20):
                s = BYTE_SYMBOL[data[(data < 128) | (data >= 192)]]
                s = s[np.append(True, (s[1:] != 0) | (s[:-1] != 0))] if len(s) else s
                s = np.repeat(s, 1 + (s == 0))  # every word starts behind two edges
                if len(s) > 2:
                    total += np.bincount((s[:-2] * SYMBOLS + s[1:-1]) * SYMBOLS + s[2:], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["k", "n"])

    rows = docs.select(F.col(text_col).alias("text")).mapInArrow(count, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).collect()
    n = np.ones((SYMBOLS, SYMBOLS, SYMBOLS))
    for r in rows:
        n.ravel()[r.k] += r.n
    return np.log10(n / n.sum(2, keepdims=True))


def spelled(path: tuple | None) -> str:
    """The text of a path of back-pointers; a step costs the same in a word of any length."""
    out = []
    while path:
        out.append(path[0])
        path = path[1]
    return "".join(reversed(out))


class Decoder:
    def __init__(self, model: np.ndarray):
        self.model = model.tolist()
        self.memo: dict[str, str] = {}

    def lattice(self, word: str) -> list[list[tuple[str, float]]]:
        """For each run of equal characters what it may stand for, with channel costs."""
        steps, at = [], 0
        while at < len(word):
            c, to = word[at], at
            while to < len(word) and word[to] == c:
                to += 1
            n, letters = to - at, LEET.get(c, "")
            reads = [(c * n, 0.0)]
            if c.isalpha() and n >= 3:
                reads += [(c, SHORTEN), (c + c, SHORTEN)]
            for x in letters:
                reads += [(x * k, SUBSTITUTE * k + SHORTEN * (k < n)) for k in {n, *((1, 2) if n >= 3 else ())}]
            steps.append(reads)
            at = to
        return steps

    def best(self, word: str) -> tuple[str, float]:
        """The Viterbi path of a word between two edges, and its score."""
        m = self.model
        states = {(0, 0): (0.0, None)}
        for reads in self.lattice(word):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for (a, b), (score, path) in states.items():
                for out, cost in reads:
                    x, y, s = a, b, score + cost
                    for c in out:
                        z = symbol(c)
                        s += m[x][y][z]
                        x, y = y, z
                    if (x, y) not in after or after[x, y][0] < s:
                        after[x, y] = (s, (out, path))
            states = after
        return max(((spelled(path), s + m[a][b][0]) for (a, b), (s, path) in states.items()), key=lambda p: (p[1], p[0]))

    def words(self, signs: str) -> tuple[str, float]:
        """Signs set apart, as the words that read best; each space costs JOIN. Letters and signs that stay signs share no word."""
        m = self.model
        states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}
        for reads in self.lattice(signs):
            after: dict[tuple[int, int], tuple[float, tuple | None]] = {}
            for out, cost in reads:
                for (a, b), (score, path) in states.items():
                    # Any character may begin a word, also within a run.
                    now = {(a, b): (score + cost, path)}
                    for c in out:
                        z, then = symbol(c), {}
                        for (x, y), (s, p) in now.items():
                            on = [(x, y, s, p)] if not y or (y == SIGNS) == (z == SIGNS) else []
                            for u, v, t, q in [*on, (0, 0, s + JOIN + m[x][y][0], (" ", p))] if y else on:
                                t += m[u][v][z]
                                if (v, z) not in then or then[v, z][0] < t:
                                    then[v, z] = (t, (c, q))
                        now = then
                    for k, x in now.items():
                        if k not in after or after[k][0] < x[0]:
                            after[k] = x
            states = after
        return max(((spelled(path), s + m[a][b][0]) for (a, b), (s, path) in states.items()), key=lambda p: (p[1], p[0]))

    def word(self, word: str) -> str:
        """A lower-case word without edge punctuation, restored."""
        if (found := self.memo.get(word)) is None:
            core = word.strip(EDGES)
            bare = TAIL.sub("", word.rstrip(".,;:?\"')]}>*#%&-_").lstrip("\"'([{<*#%&-_"))
            found = core
            if SIGN.search(bare) or DRAWN.search(core):
                decoded = self.best(bare)[0]
                found = decoded if decoded.isalpha() else (self.best(core)[0] if core else core)
            if len(self.memo) >= MEMO:
                self.memo.clear()
            self.memo[word] = found
        return found

    def apart(self, spaced: str) -> str | None:
        """Letters set apart, as the words they read best as, if that is better than the single letters."""
        joined = spaced.translate(SEPARATORS)
        if len(joined) < 3:
            return None
        text, score = self.words(joined)
        single = sum(self.best(c)[1] for c in joined)
        if score + JOIN <= single or not any(len(w) > 1 and w.isalpha() for w in text.split(" ")):
            return None
        return " ".join([w if w.isalpha() else " ".join(w) for w in text.split(" ")])

    def restored(self, text: str) -> str:
        low = text.lower()
        low = APART.sub(lambda m: self.apart(m[0]) or m[0], low)
        return " ".join([self.word(w) for w in low.split()])


def features(word: str) -> list[str]:
    """A word and its beginnings of 4 to 6 characters."""
    return [word, *(word[:k] + "~" for k in (4, 5, 6) if len(word) > k)]


def weight(pos: float, neg: float, n_pos: float, n_neg: float, certain: float) -> float:
    """What a feature tells: its smoothed log-odds, drawn to 0 by some standard deviations.

    One pseudo-text is shared by the classes as their texts are, so what is in no text says nothing.
    """
    p, n = pos + n_pos / (n_pos + n_neg), neg + n_neg / (n_pos + n_neg)
    odds = math.log(p / n_pos) - math.log(n / n_neg)
    return math.copysign(max(0.0, abs(odds) - certain * math.sqrt(1 / p + 1 / n)), odds)


def weigh(sample: DataFrame, decoder: Decoder) -> tuple[dict[str, tuple[int, int]], int, int]:
    """(positive, negative) texts of every feature whose weight is not 0, for toxic and clean alike, and of all.

    How rare a feature is shows in its weight's deviation only; there is no least number of texts.
    """

    def count(batches):
        for batch in batches:
            seen: dict[str, list[int]] = {}
            for text, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for f in {f for w in set(decoder.restored(text).split(" ")) if len(w) >= 2 for f in features(w)}:
                    seen.setdefault(f, [0, 0])[y] += 1
            yield pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array([x[0] for x in seen.values()], pa.int64()), pa.array([x[1] for x in seen.values()], pa.int64())], names=["f", "neg", "pos"])

    totals = sample.agg(F.coalesce(F.sum("y"), F.lit(0)), F.count("*")).first()
    pos, neg = totals[0], totals[1] - totals[0]
    if not pos or not neg:
        return {}, pos, neg
    counts = sample.select("text", "y").mapInArrow(count, "f string, neg long, pos long").groupBy("f").agg(F.sum("neg").alias("neg"), F.sum("pos").alias("pos"))
    p, n = F.col("pos") + pos / (pos + neg), F.col("neg") + neg / (pos + neg)
    odds = F.log(p / pos) - F.log(n / neg)
    told = counts.where(F.abs(odds) > CERTAIN[0] * F.sqrt(1 / p + 1 / n)).select("f", "pos", "neg").collect()
    return {r.f: (r.pos, r.neg) for r in told}, pos, neg


def evidence(decoder: Decoder, told: dict[str, tuple[int, int]], n_pos: int, n_neg: int, levels: tuple[float, ...]):
    """A function from a text to sums of its words' strongest weights, each word once; one sum for each of levels.

    Given a text's own label, what the text itself taught is left out: counts are those of all other texts.
    """
    memos: dict[int | None, dict[str, tuple[float, ...]]] = {None: {}, 0: {}, 1: {}}
    known: dict[tuple[int, int, int | None], tuple[float, ...]] = {}
    nothing = (0.0,) * len(levels)

    def weights(f: str, own: int | None) -> tuple[float, ...]:
        if (counts := told.get(f)) is None:
            return nothing
        if (x := known.get((*counts, own))) is None:
            p, n, p_all, n_all = counts[0] - (own == 1), counts[1] - (own == 0), n_pos - (own == 1), n_neg - (own == 0)
            x = known[*counts, own] = tuple(weight(p, n, p_all, n_all, k) for k in levels) if min(p, n) >= 0 and min(p_all, n_all) > 0 else nothing
        return x

    def of(text: str, own: int | None = None) -> list[float]:
        low = text.lower()
        extra = [w for m in APART.finditer(low) if (t := decoder.apart(m[0])) for w in t.split()]
        memo, told_of = memos[own], []
        for w in {*low.split(), *extra}:
            if (x := memo.get(w)) is None:
                x = tuple(max(each, key=abs) for each in zip(*[weights(f, own) for f in features(decoder.word(w))], strict=True))
                if not any(x):
                    x = nothing
                if len(memo) >= MEMO:
                    memo.clear()
                memo[w] = x
            if x is not nothing:
                told_of.append(x)
        return [math.fsum(each) for each in zip(*told_of, strict=True)] if told_of else list(nothing)

    return of


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 50) -> tuple[float, float, float]:
    """Intercept, slope and log likelihood of a one-dimensional logistic curve, by Newton steps; the slope is not negative."""
    a, b = 0.0, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a + b * x, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-9)
        g = np.array([(p - y).sum(), ((p - y) * x).sum() + ridge * b])
        h = np.array([[w.sum(), (w * x).sum()], [(w * x).sum(), (w * x * x).sum() + ridge]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
    b = max(0.0, float(b))
    z = np.clip(a + b * x, -30, 30)
    return float(a), b, float((y * z - np.log1p(np.exp(z))).sum())


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", threshold: float = 0.7, train_rows: int = 20_000, keep_text: bool = True) -> DataFrame:
    """docs with a struct column toxicity: held_out, score, predicted, restored (the restored text, null without keep_text)."""
    decoder = Decoder(character_model(docs, text_col))
    sample = staged(labelled_sample(docs, labels, id_col, text_col, label_col, train_rows), "toxic-sample")
    told, n_pos, n_neg = weigh(sample, decoder)
    tried = evidence(decoder, told, n_pos, n_neg, CERTAIN)

    def sums(batches):
        for batch in batches:
            rows = [tried(t, y) for t, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column(1)], names=["x", "y"])

    points = sample.select("text", "y").mapInArrow(sums, "x array<double>, y int").collect()
    y = np.array([float(p.y) for p in points])
    fits = [(k, *logistic(np.array([p.x[i] for p in points]), y)) for i, k in enumerate(CERTAIN)] if points else []
    certain, a, b, _ = max(fits, key=lambda f: f[3], default=(CERTAIN[0], -math.inf, 0.0, 0.0))
    of = evidence(decoder, told, n_pos, n_neg, (certain,))
    name = free_name(docs, "toxicity")
    schema = T.StructType([*docs.schema.fields, T.StructField(name, T._parse_datatype_string("held_out boolean, score double, predicted int, restored string"))])
    flag = free_name(docs, "__dm_held")

    def run(batches):
        for batch in batches:
            texts = [t or "" for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
            z = np.clip(a + b * np.array([of(t)[0] for t in texts]), -700, 700) if len(texts) else np.zeros(0)
            p = np.where(z <= -700, 0.0, 1 / (1 + np.exp(-z)))
            figures = pa.StructArray.from_arrays([batch.column(batch.num_columns - 1), pa.array(p), pa.array((p >= threshold).astype(np.int32)), pa.array([decoder.restored(t) for t in texts] if keep_text else [None] * len(texts), pa.string())], names=["held_out", "score", "predicted", "restored"])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], figures], names=[*batch.schema.names[:-1], name])

    return docs.withColumn(flag, held_out(F.col(id_col))).mapInArrow(run, schema)
