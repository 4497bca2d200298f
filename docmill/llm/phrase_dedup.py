"""Substring deduplication by repeated-phrase automata.

Passages that recur are confirmed, compiled into sharded Aho-Corasick automata over word sequences (pyahocorasick),
and what the documents hold is streamed through the automaton of their shard to locate every occurrence. Which passages
and documents meet in a shard is decided by content-defined anchors (see anchors.py), so a shard's automaton is bounded
and no document visits a shard that cannot match in it; equal surroundings of an anchor are streamed once for all
documents that have them. Anchors with more than `hot_contexts` different surroundings are not gathered in a shard:
their windows are counted, and located, by hash over the cluster.

Defined results: null or empty texts have no words and lose none; texts shorter than a window lose nothing; texts and
words may be of any length; repeated rows are occurrences of their own, so each loses all windows; rows equal in id and
text lose the same; other columns pass through, whatever their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .anchors import Windows, removed, repeated_ranges
from .common import text_key


def locate(window: int, gram: int):
    """A resolver for anchors.repeated_ranges: confirm, compile, stream."""

    def resolve(shard: pa.Table) -> pa.Table:
        ids: dict[bytes, int] = defaultdict(lambda: len(ids) + 1)
        pos = shard.column("pos").to_pylist()
        rows = {}
        for i, (a, c, n, left, body) in enumerate(zip(*(shard.column(k).to_pylist() for k in ("a", "c", "n", "left", "body")), strict=True)):
            rows[a, c] = (i, a, n, left, tuple([ids[w] for w in body.split(b" ")]))
        # Passages are windows that hold the anchor, by anchor and offset, where a context that occurs once has them too;
        # and contexts that occur more than once, as a whole.
        lone = {a for _, a, n, _, _ in rows.values() if n == 1}
        seen: Counter = Counter()
        single = set()
        passages: dict[tuple, set] = defaultdict(set)
        for (_, c), (_, a, n, left, seq) in rows.items():
            if n > 1 and len(seq) >= window:
                passages[seq].add((a, None, c))
            if a in lone:
                for o in range(max(0, window - (len(seq) - left)), min(left, window - gram) + 1):
                    place = (a, o, seq[left - o : left - o + window])
                    seen[place] += n
                    if n == 1:
                        single.add(place)
        for a, o, seq in single:
            if seen[a, o, seq] > 1:
                passages[seq].add((a, o))
        seen.clear()
        single.clear()
        automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        out: dict[str, list] = {k: [] for k in ("row", "lo", "hi", "a", "c")}
        if passages:
            for seq, places in passages.items():
                automaton.add_word(seq, places)
            automaton.make_automaton()
            for (a, c), (i, _, n, left, seq) in rows.items():
                if len(seq) < window:
                    continue
                if n == 1:
                    starts = [end - window + 1 for end, places in automaton.iter(seq) if (a, left - (end - window + 1)) in places]
                    found = (i, pos[i] - left + starts[0], pos[i] - left + starts[-1] + window, None, None) if starts else None
                else:
                    whole = any((a, None, c) in places for _, places in automaton.iter(seq))
                    found = (None, -left, len(seq) - left, a, c) if whole else None
                if found:
                    for k, v in zip(out, found, strict=True):
                        out[k].append(v)
        take = pa.array(out["row"], pa.int64())
        return pa.table([shard.column("id").take(take), shard.column("th").take(take), pa.array(out["lo"], pa.int32()), pa.array(out["hi"], pa.int32()), pa.array(out["a"], pa.int64()), pa.array(out["c"], pa.int64())], names=["id", "th", "lo", "hi", "a", "c"])

    return resolve


def remove_phrases(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 35, gram: int = 8, shard_contexts: int = 3000, hot_contexts: int = 1000, keep_text: bool = True) -> DataFrame:
    """docs with a struct column phrase_dedup: n_units (words), n_removed, n_spans, kept_sha256, spans, kept."""
    w = Windows(window, min(gram, window), True)
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    ranges = repeated_ranges(texts, w, locate(window, w.gram), shard_contexts, hot_contexts, True)
    return removed(docs, ranges, id_col, text_col, "phrase_dedup", w, keep_text)
