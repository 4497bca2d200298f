"""Line-first cleaning: rules for lines, then one for what is left of the document.

Every line of a text is judged by itself, in this order: navigation (words that only separate, as in a menu, are at
least three and every fifth), boilerplate (a fixed phrase of licences, notices, prompts or site furniture), punctuation (no
sentence end at its end, or every fourth word carries signs, or every fourth word ends in a doubled exclamation mark).
Lines that fail are removed; lines without words are neither judged nor counted. A document that loses more than
`most_lost_percent` of its words, or keeps fewer than `least_words`, is rejected. Before that, two rules on the whole text
apply: too few words, and too many words in three-word windows that the text repeats.

A document's verdict depends on its own text alone, so it is found in one pass where the row lies, and nothing is
shuffled: a function over Arrow batches takes slices of bounded bytes (one text at least) and works on all their bytes,
words and lines at once. Repeated windows are told by 64-bit hashes of three words in a row, within one text.

Defined results: null and empty texts have no words and fail the whole-text rules; texts, lines and words may be of any
length; a text's verdict depends on it alone, so repeated rows and ties agree; other columns pass through, whatever
their names; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .blocks import IS_SPACE, TO_LOWER, grams, slices, word_hashes, word_spans
from .common import free_name

#: Signs that count as symbols, words that separate menu entries, ends of sentences, phrases of boilerplate.
SYMBOLS = "#*$%&|<>"
SEPARATORS = ["|", "/", "\\", ">", ">>", "<", "<<", "»", "«", "›", "‹", "•", "·", "::", "→", "←", "~"]
SENTENCE_END = "[.!?…。！？:;][\"'”’»)\\]]*$"
PHRASES = [
    "all rights reserved", "terms of use", "terms of service", "terms and conditions", "privacy policy", "cookie policy", "uses cookies", "use cookies", "accept cookies", "enable javascript", "javascript is disabled",
    "lorem ipsum", "click here", "sign in", "log in", "sign up", "subscribe to our", "unsubscribe", "share this", "skip to content", "skip to main", "back to top", "powered by", "page not found", "read more", "licensed under", "released under the",
]
IS_SYMBOL = np.zeros(256, bool)
IS_SYMBOL[list(SYMBOLS.encode())] = True
LONGS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_navigation", "n_boilerplate", "n_punctuation", "n_lost"]


def summed(flags: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sums of flags between consecutive bounds."""
    up = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=up[1:])
    return np.diff(up[bounds])


def repeated_words(hashes: np.ndarray, owner: np.ndarray, width: int) -> np.ndarray:
    """Which words are in windows of `width` words that occur twice or more in their text."""
    hit = np.zeros(len(hashes) + 1, np.int64)
    windows = grams(hashes, width)
    whole = np.flatnonzero(owner[: len(windows)] == owner[width - 1 :])
    order = whole[np.lexsort((windows[whole], owner[whole]))]
    same = (windows[order][1:] == windows[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(order), bool)
    twice[1:] |= same
    twice[:-1] |= same
    np.add.at(hit, order[twice], 1)
    np.add.at(hit, order[twice] + width, -1)
    return np.cumsum(hit)[:-1] > 0


def text_lines(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all lines, without their newlines, and the text that each is in; an empty text has one empty line."""
    breaks = np.flatnonzero(data == 10)
    owner = np.searchsorted(offsets, breaks, "right") - 1
    starts = np.concatenate([offsets[:-1], breaks + 1])
    ends = np.concatenate([breaks, offsets[1:]])
    own = np.concatenate([np.arange(len(offsets) - 1), owner])
    by_start = np.lexsort((starts, own))
    by_end = np.lexsort((ends, np.concatenate([owner, np.arange(len(offsets) - 1)])))
    return starts[by_start], ends[by_end], own[by_start]


def pieces(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Slices of data as one text array."""
    lengths = ends - starts
    out = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(lengths, out=out[1:])
    inside = np.arange(out[-1]) - np.repeat(out[:-1], lengths) + np.repeat(starts, lengths)
    return pa.Array.from_buffers(pa.large_string(), len(starts), [None, pa.py_buffer(out), pa.py_buffer(data[inside])])


def judge(data: np.ndarray, offsets: np.ndarray, width: int, keep_text: bool) -> tuple[dict[str, np.ndarray], pa.Array | None]:
    """Figures of each text, and its cleaned text."""
    n = len(offsets) - 1
    word_starts, word_ends, word_text = word_spans(data, offsets)
    hashes = word_hashes(data, word_starts, word_ends) if len(word_starts) else np.zeros(0, np.uint64)
    line_starts, line_ends, line_text = text_lines(data, offsets)
    word_bounds = np.searchsorted(word_starts, np.append(line_starts, len(data)))
    words = np.diff(word_bounds)
    per_text = lambda weights: np.bincount(line_text, weights, n).astype(np.int64)

    own = np.array([word_hashes(np.frombuffer(x.encode(), np.uint8), np.array([0]), np.array([len(x.encode())]))[0] for x in SEPARATORS], np.uint64)
    symbol = IS_SYMBOL[data]
    pairs = np.zeros(len(data) + 1, np.int64)
    np.cumsum(symbol[:-1] & symbol[1:], out=pairs[1:-1]) if len(data) > 1 else None
    signed = pairs[np.maximum(word_ends - 1, 0)] > pairs[word_starts]
    loud = (word_ends - word_starts > 1) & (data[word_ends - 1] == 33) & (data[word_ends - 2] == 33) if len(word_starts) else np.zeros(0, bool)
    separators, signs, shouts = (summed(x, word_bounds) for x in (np.isin(hashes, own), signed, loud))

    has = words > 0
    lines = pieces(data, line_starts, line_ends)
    phrase = pc.match_substring_regex(pieces(TO_LOWER[data], line_starts, line_ends), "|".join(PHRASES)).to_numpy(False)
    last = word_bounds[1:][has] - 1
    ended = np.zeros(len(words), bool)
    ended[has] = pc.match_substring_regex(pieces(data, word_starts[last], word_ends[last]), SENTENCE_END).to_numpy(False)

    navigation = has & (separators >= 3) & (separators * 5 >= words)
    boilerplate = has & ~navigation & phrase
    punctuation = has & ~navigation & ~boilerplate & (~ended | (signs * 4 >= words) | (shouts * 4 >= words))
    codes = pc.dictionary_encode(lines.filter(pa.array(has))).indices.to_numpy(False)
    distinct = np.unique(line_text[has] * (len(codes) + 1) + codes)
    figures = {
        "n_words": np.bincount(word_text, minlength=n),
        "word_chars": summed(((data & 0xC0) != 0x80) & ~IS_SPACE[data], offsets),
        "n_symbols": summed(symbol, offsets),
        "n_dup_lines": per_text(has) - np.bincount(distinct // (len(codes) + 1), minlength=n),
        "n_repeat_words": np.bincount(word_text[repeated_words(hashes, word_text, width)], minlength=n),
        "n_navigation": per_text(words * navigation),
        "n_boilerplate": per_text(words * boilerplate),
        "n_punctuation": per_text(words * punctuation),
    }
    figures["n_lost"] = figures["n_navigation"] + figures["n_boilerplate"] + figures["n_punctuation"]
    if not keep_text:
        return figures, None
    stays = ~(navigation | boilerplate | punctuation)
    at = np.zeros(n + 1, np.int64)
    np.cumsum(np.bincount(line_text[stays], minlength=n), out=at[1:])
    return figures, pc.binary_join(pa.LargeListArray.from_arrays(pa.array(at), lines.filter(pa.array(stays))), pa.scalar("\n", pa.large_string())).cast(pa.string())


def clean_lines(
    docs: DataFrame, text_col: str = "text", least_words: int = 50, most_repeat_percent: int = 50, most_lost_percent: int = 30, repeat_width: int = 3, keep_text: bool = True, slice_bytes: int = 4 << 20
) -> DataFrame:
    """docs with a struct column rules.

    n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words; words in failed lines by rule, n_navigation,
    n_boilerplate and n_punctuation, and in all, n_lost; base_failed; kept; reason; with keep_text kept_text, the lines
    that pass, joined.
    """
    name = free_name(docs, "rules")
    fields = [*[T.StructField(x, T.LongType()) for x in LONGS], T.StructField("base_failed", T.BooleanType()), T.StructField("kept", T.BooleanType()), T.StructField("reason", T.StringType())]
    out = T.StructType([*fields, *([T.StructField("kept_text", T.StringType())] if keep_text else [])])

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows, data, offsets in slices(batch, text_col, slice_bytes):
                f, text = judge(data, offsets, repeat_width, keep_text)
                few, repeated = f["n_words"] < least_words, f["n_repeat_words"] * 100 > f["n_words"] * most_repeat_percent
                lost, little = f["n_lost"] * 100 > f["n_words"] * most_lost_percent, f["n_words"] - f["n_lost"] < least_words
                reason = np.select([few, repeated, lost, little], ["too_few_words", "too_many_repeats", "too_much_lost", "too_little_left"], "")
                kept = ~(few | repeated | lost | little)
                columns = [*[pa.array(f[x], pa.int64()) for x in LONGS], pa.array(few | repeated), pa.array(kept), pa.array(reason, pa.string(), mask=kept), *([text] if keep_text else [])]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.StructArray.from_arrays(columns, names=out.names)], names=[*rows.schema.names, name])

    return docs.mapInArrow(cleaned, T.StructType([*docs.schema.fields, T.StructField(name, out)]))
