"""Language-model scoring with Elias-Fano n-gram tries.

The model is a trigram model whose counts fall back linearly, through bigrams, to the unigram base:

    P(w | u v) = (count(u v w) + back * count(v w) + prior * base(w)) / (count(u v) + back * count(v) + prior)

It sums to one over words. The numerator depends on the predicted word w and its contexts, the denominator on v and
its context u, and v is itself a word of the text. So if tries are rooted at a word, with its contexts leading
backwards from it, each shard of words can score its share of every document by itself: the numerators of its words,
and the denominators of what follows them. The sum over shards is exact, and nothing but the words' own shard has to
be in one place.

One pass turns each block of documents into one packed row for each shard that it has words of: words, contexts
relative to them, and the documents (by number in the block) that hold each. A shard counts the training part over all
blocks and builds its trie: words, their contexts v, and the contexts u of those, contexts in Elias-Fano code with
monotone pointers into the next level, next to quantised smoothed log numerators and denominators, all in memory-mapped files
that vanish with the task. Then the blocks' tokens are streamed through it, each by successor search relative to its
context. What a shard returns of a block is one figure for each document that occurs in both, so the bytes shuffled per
token are bounded at any number of shards. Blocks are named by partition and number, not by content.

Words with more than a quarter of a shard's share of all tokens are split over the shards by context; their counts, at
most four for each shard of 6 MB of text, come from the unigram table and are broadcast. One pair of words is never
split: all that a document adds to it is two bytes.

Words and contexts are known by hashes: words by 64 bits, v within its word by 40, u within its pair by 32.

Defined results: null and empty texts are one end token; each row is a document of its own, repeated rows included;
the held-out part and the training part follow from the id as text (null: the empty text); texts and words may be of
any length; other columns pass through, whatever their names; an empty table gives an empty result. Without training
tokens the base is uniform.
"""

from __future__ import annotations

import math
import tempfile
import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .blocks import TO_LOWER, U, mixed, slices, word_hashes, word_spans
from .common import free_name, joined_back, staged, text_key

END, START = U(0x51ED270B7A2F9C41), U(0x2D358DCCAA6C78A5)
BLOCK_BYTES = 4 << 20
V_BITS, U_BITS = 40, 32
STEPS = 65535
#: So many (document, triple) entries are looked up at once.
STREAM_REFS = 250_000


def select_table() -> np.ndarray:
    """Place of the k-th set bit of each byte."""
    out = np.zeros((256, 8), np.int64)
    for byte in range(256):
        places = [i for i in range(8) if byte >> i & 1]
        out[byte, : len(places)] = places
    return out


SELECT = select_table()


class EliasFano:
    """A monotone sequence of 64-bit numbers in memory-mapped low and high parts."""

    def __init__(self, values: np.ndarray, folder):
        self.n = len(values)
        top = int(values[-1]) + 1 if self.n else 1
        self.low_bits = max(0, (top // max(1, self.n)).bit_length() - 1)
        low = values & U((1 << self.low_bits) - 1)
        high = (values >> U(self.low_bits)).astype(np.int64) + np.arange(self.n)
        words = np.zeros(self.n * self.low_bits // 64 + 2, U)
        if self.low_bits and self.n:
            bit = np.arange(self.n, dtype=np.int64) * self.low_bits
            at, shift = bit >> 6, (bit & 63).astype(U)
            np.bitwise_or.at(words, at, low << shift)
            spill = np.flatnonzero((bit & 63) + self.low_bits > 64)
            np.bitwise_or.at(words, at[spill] + 1, low[spill] >> (U(64) - shift[spill]))
        self.low = mapped(words, folder)
        bits = np.zeros(((int(high[-1]) if self.n else 0) // 64 + 1) * 64, np.uint8)
        bits[high] = 1
        self.high = mapped(np.packbits(bits, bitorder="little"), folder)
        self.ranks = mapped(np.concatenate([[0], np.cumsum(np.bitwise_count(self.high), dtype=np.int64)[:-1]]).astype(np.uint32), folder)  # set bits before each byte

    def select(self, k: np.ndarray) -> np.ndarray:
        """Position of the k-th set bit (from 0) of the high part."""
        byte = np.searchsorted(self.ranks, k.astype(np.uint32), "right") - 1
        return byte * 8 + SELECT[self.high[byte], k - self.ranks[byte]]

    def __getitem__(self, k: np.ndarray) -> np.ndarray:
        high = (self.select(k) - k).astype(U) << U(self.low_bits)
        if not self.low_bits:
            return high
        bit = k * self.low_bits
        at, shift = bit >> 6, (bit & 63).astype(U)
        low = self.low[at] >> shift
        over = np.where(shift > 0, self.low[at + 1] << ((U(64) - shift) & U(63)), U(0))
        return high | ((low | over) & U((1 << self.low_bits) - 1))

    def successor(self, low: np.ndarray, high: np.ndarray, value: np.ndarray) -> np.ndarray:
        """For each range [low, high) the first place whose number is value or more."""
        low, high = low.copy(), high.copy()
        live = np.flatnonzero(low < high)
        while live.size:
            mid = (low[live] + high[live]) >> 1
            less = self[mid] < value[live]
            low[live] = np.where(less, mid + 1, low[live])
            high[live] = np.where(less, high[live], mid)
            live = live[low[live] < high[live]]
        return low


def mapped(values: np.ndarray, folder) -> np.ndarray:
    """values in a memory-mapped file without a name, gone when the task drops it."""
    if not len(values):
        return values
    file = tempfile.TemporaryFile(dir=folder)
    out = np.memmap(file, values.dtype, "w+", shape=values.shape)
    out[:] = values
    out.flush()
    return out


class Codes:
    """Numbers quantised to 16 bits, in a memory-mapped file."""

    def __init__(self, values: np.ndarray, folder):
        self.base = float(values.min()) if len(values) else 0.0
        self.step = ((float(values.max()) - self.base) / STEPS if len(values) else 1.0) or 1.0
        self.codes = mapped(np.round((values - self.base) / self.step).astype(np.uint16), folder)

    def __getitem__(self, at: np.ndarray) -> np.ndarray:
        return self.base + self.step * self.codes[at]


class Trie:
    """Words, their contexts v, and the contexts u of those, the latter two Elias-Fano sequences relative to the level above.

    What follows a word has its denominator at (word, v), or at the word alone; the word's own numerator is at the
    longest context known.
    """

    def __init__(self, words: np.ndarray, n_word: np.ndarray, pairs: np.ndarray, n_pair: np.ndarray, triples: np.ndarray, n_triple: np.ndarray, base: np.ndarray, back: float, prior: float, folder=None):
        """pairs: word number << V_BITS | v, triples: pair number << U_BITS | u; all ascending, with their counts."""
        own, pair = (pairs >> U(V_BITS)).astype(np.int64), (triples >> U(U_BITS)).astype(np.int64)
        self.n_words = len(words)
        self.words = mapped(words, folder)
        self.to_pairs = EliasFano(np.searchsorted(own, np.arange(len(words) + 1)).astype(U), folder)
        self.pairs = EliasFano(pairs, folder)
        self.to_triples = EliasFano(np.searchsorted(pair, np.arange(len(pairs) + 1)).astype(U), folder)
        self.triples = EliasFano(triples, folder)
        low = prior * base
        middle = low[own] + back * n_pair
        self.scores = [Codes(np.log10(low), folder), Codes(np.log10(middle), folder), Codes(np.log10(middle[pair] + n_triple), folder)]
        self.follows = [Codes(np.log10(back * n_word + prior), folder), Codes(np.log10(n_pair + back * n_word[own] + prior), folder)]
        self.base = mapped(np.log10(base), folder)

    def child(self, level: EliasFano, pointers: EliasFano, parent: np.ndarray, bits: int, context: np.ndarray) -> np.ndarray:
        """Number of each context below its parent, -1 where it is not known or the parent is -1."""
        out = np.full(len(parent), -1, np.int64)
        live = np.flatnonzero(parent >= 0)
        if level.n and live.size:
            p = parent[live]
            low, high = pointers[p].astype(np.int64), pointers[p + 1].astype(np.int64)
            key = p.astype(U) << U(bits) | context[live]
            at = level.successor(low, high, key)
            there = np.flatnonzero(at < high)
            there = there[level[at[there]] == key[there]]
            out[live[there]] = at[there]
        return out

    def find_words(self, h: np.ndarray) -> np.ndarray:
        if not self.n_words:
            return np.full(len(h), -1, np.int64)
        at = np.minimum(np.searchsorted(self.words, h), self.n_words - 1)
        return np.where(self.words[at] == h, at, -1)

    def numerators(self, word: np.ndarray, pair: np.ndarray, triple: np.ndarray, unknown: float) -> np.ndarray:
        out = np.full(len(triple), unknown)
        for codes, at in zip(self.scores, (word, pair, triple), strict=True):
            known = np.flatnonzero(at >= 0)
            out[known] = codes[at[known]]
        return out

    def denominators(self, word: np.ndarray, pair: np.ndarray, unknown: float) -> np.ndarray:
        out = np.full(len(pair), unknown)
        for codes, at in zip(self.follows, (word, pair), strict=True):
            known = np.flatnonzero(at >= 0)
            out[known] = codes[at[known]]
        return out


def tokens_of(data: np.ndarray, offsets: np.ndarray, texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """For every token its hash, the hashes of the one and the two before it (START before a text), and its text; ends included."""
    low = TO_LOWER[data]
    starts, ends, owner = word_spans(low, offsets)
    h = word_hashes(low, starts, ends)
    h[(h == END) | (h == START)] ^= U(1)
    counts = np.bincount(owner, minlength=texts)
    text = np.repeat(np.arange(texts), counts + 1)
    last = np.cumsum(counts + 1) - 1
    word = np.full(len(text), END)
    inside = np.ones(len(text), bool)
    inside[last] = False
    word[inside] = h
    first = last - counts
    v, u = np.full(len(text), START), np.full(len(text), START)
    v[1:] = word[:-1]
    v[first] = START
    u[1:] = v[:-1]
    u[first] = START
    return word, v, u, text


def narrow(x: np.ndarray) -> bytes:
    """Counts, in a byte each where they fit, compressed."""
    wide = len(x) and int(x.max()) > 255
    return (b"w" if wide else b"n") + zlib.compress(x.astype(np.int32 if wide else np.uint8).tobytes(), 1)


def wide(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x[1:]), np.int32 if x[:1] == b"w" else np.uint8).astype(np.int64)


def cut(x: np.ndarray, size: int) -> bytes:
    """The low bytes of each number."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size]).tobytes()


def uncut(x: bytes, size: int) -> np.ndarray:
    out = np.zeros((len(x) // size, 8), np.uint8)
    out[:, :size] = np.frombuffer(x, np.uint8).reshape(-1, size)
    return out.view("<u8").ravel()


def run_starts(*columns: np.ndarray) -> np.ndarray:
    fresh = np.ones(len(columns[0]), bool)
    fresh[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    return np.flatnonzero(fresh)


def doc_kind(n: int):
    return np.uint32 if n > 65535 else np.uint16


class Block:
    """One packed row: words, pairs and triples of a block in a shard, and the documents that hold each triple."""

    def __init__(self, row: dict):
        self.words = np.frombuffer(row["words"], U)
        self.n_pairs = wide(row["n_pairs"])
        self.v = uncut(row["vs"], V_BITS // 8)
        self.n_triples = wide(row["n_triples"])
        self.u = uncut(row["us"], U_BITS // 8)
        self.n_refs = wide(row["n_refs"])
        self.doc = np.frombuffer(row["refs"], doc_kind(row["n_docs"])).astype(np.int64)
        self.times = wide(row["times"])
        self.n_docs, self.n_train = row["n_docs"], row["n_train"]

    def word_of_pair(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.words)), self.n_pairs)

    def pair_of_triple(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.v)), self.n_triples)

    def triple_of_ref(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.u)), self.n_refs)

    def counted(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Word, v, u and training count of the triples that the training part holds."""
        n = np.bincount(self.triple_of_ref(), weights=self.times * (self.doc < self.n_train), minlength=len(self.u))
        seen = np.flatnonzero(n)
        pair = self.pair_of_triple()[seen]
        return self.words[self.word_of_pair()[pair]], self.v[pair], self.u[seen], n[seen]


def together(blocks: list[Block]) -> Block:
    """Several blocks as one, whose documents are numbered on; its words may repeat."""
    out = Block.__new__(Block)
    for k in ("words", "n_pairs", "v", "n_triples", "u", "n_refs", "times"):
        setattr(out, k, np.concatenate([getattr(b, k) for b in blocks]))
    starts = np.cumsum([0, *(b.n_docs for b in blocks)])
    out.doc = np.concatenate([b.doc + at for b, at in zip(blocks, starts, strict=False)])
    out.starts = starts
    return out


def summed(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = run_starts(keys) if len(keys) else np.zeros(0, np.int64)
    return keys[first], np.add.reduceat(n, first) if len(keys) else n


def trie_of(blocks: list[Block], total: int, types: int, hot: dict[int, int], back: float, prior: float) -> Trie:
    """The trie of the blocks' training part."""
    parts = [b.counted() for b in blocks]
    word, v, u, n = (np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, U) for i in range(4))
    del parts
    words, at = np.unique(word, return_inverse=True)
    del word
    pairs, pair = np.unique(at.astype(U) << U(V_BITS) | v, return_inverse=True)
    del at, v
    triples, n_triple = summed(pair.astype(U) << U(U_BITS) | u, n)
    del pair, u, n
    n_pair = np.bincount((triples >> U(U_BITS)).astype(np.int64), weights=n_triple, minlength=len(pairs))
    n_word = np.bincount((pairs >> U(V_BITS)).astype(np.int64), weights=n_pair, minlength=len(words))
    for h, count in hot.items():
        place = int(np.searchsorted(words, U(h)))
        if place < len(words) and words[place] == U(h):
            n_word[place] = count
    return Trie(words, n_word, pairs, n_pair, triples, n_triple, (n_word + 0.1) / (total + 0.1 * (types + 1)), back, prior)


def streamed(block: Block, trie: Trie, unknown_base: float, prior: float) -> tuple[np.ndarray, ...]:
    """Documents of the block that occur here: numbers, known tokens, base score, score."""
    word = trie.find_words(block.words)
    word_of_pair = block.word_of_pair()
    pair = trie.child(trie.pairs, trie.to_pairs, word[word_of_pair], V_BITS, block.v)
    pair_of_triple = block.pair_of_triple()
    triple = trie.child(trie.triples, trie.to_triples, pair[pair_of_triple], U_BITS, block.u)
    score = trie.numerators(word[word_of_pair][pair_of_triple], pair[pair_of_triple], triple, math.log10(prior * 10**unknown_base))
    ends = block.words[word_of_pair] == END  # nothing follows an end
    follow = np.where(ends, 0.0, trie.denominators(word[word_of_pair], pair, math.log10(prior)))
    score -= follow[pair_of_triple]
    base = np.full(len(word), unknown_base)
    base[word >= 0] = trie.base[word[word >= 0]]
    of = block.triple_of_ref()
    word_of_ref = word_of_pair[pair_of_triple][of]
    docs, local = np.unique(block.doc, return_inverse=True)
    add = lambda x: np.bincount(local, weights=block.times * x, minlength=len(docs))
    return docs, add((word >= 0)[word_of_ref]), add(base[word_of_ref]), add(score[of])


def score_texts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 10, back: float = 0.001, prior: float = 3.0, shard_bytes: int = 6 << 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with a struct column lm: held_out, n_tokens, n_known, train_tokens, base_score, score."""
    held = F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % folds == 0
    texts = docs.select(F.col(id_col).alias("id"), text_key(F.col(text_col)).alias("th"), F.col(text_col).alias("text"), held.alias("held"))
    size = texts.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    shards = max(1, math.ceil(size / shard_bytes))

    def unigrams(batches):
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", block_bytes):
                word, _, _, text = tokens_of(data, offsets, rows.num_rows)
                train = ~np.asarray(rows.column(3).to_numpy(zero_copy_only=False), bool)
                w, n = np.unique(word[train[text]], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(w.view(np.int64)), pa.array(n)], names=["w", "n"])

    counts = staged(texts.mapInArrow(unigrams, "w long, n long").groupBy("w").agg(F.sum("n").alias("n")), "unigrams")
    end = int(END.astype(np.int64))
    total, types, train_docs = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(F.col("w") == end, F.col("n"))), F.lit(0))).first()
    hot_rows = counts.where(F.col("n") > max(1, total) / (4 * shards)).collect() if shards > 1 else []
    hot_counts = {r.w & (1 << 64) - 1: r.n for r in hot_rows}
    hot_words = np.array(sorted(hot_counts), U)
    id_type = docs.schema[id_col].dataType
    lead = [T.StructField("block", T.StringType()), T.StructField("ids", T.ArrayType(id_type)), *T._parse_datatype_string("ths array<long>, lengths binary, n_docs int, n_train int").fields]
    blob = T.StructType([T.StructField("shard", T.IntegerType()), *lead, *T._parse_datatype_string("words binary, n_pairs binary, vs binary, n_triples binary, us binary, n_refs binary, refs binary, times binary").fields])
    partial = T.StructType([*lead, *T._parse_datatype_string("docs binary, known binary, base binary, score binary").fields])

    def arrow_schema(of: T.StructType, id_kind: pa.DataType) -> pa.Schema:
        kinds = {"shard": pa.int32(), "block": pa.string(), "ids": pa.list_(id_kind), "ths": pa.list_(pa.int64()), "n_docs": pa.int32(), "n_train": pa.int32()}
        return pa.schema([(n, kinds.get(n, pa.binary())) for n in of.names])

    def pack(batches):
        number = 0
        for batch in batches:
            for rows, data, offsets in slices(batch, "text", block_bytes):
                n_docs = rows.num_rows
                held_ = np.asarray(rows.column(3).to_numpy(zero_copy_only=False), bool)
                turn = np.argsort(held_, kind="stable")  # the training part comes first
                place = np.empty(n_docs, np.int64)
                place[turn] = np.arange(n_docs)
                n_train = int((~held_).sum())
                word, v, u, text = tokens_of(data, offsets, n_docs)
                shard = (mixed(word) % U(shards)).astype(np.int32)
                if len(hot_words):
                    at = np.minimum(np.searchsorted(hot_words, word), len(hot_words) - 1)
                    hot = hot_words[at] == word
                    shard[hot] = (mixed(word[hot] ^ mixed(v[hot])) % U(shards)).astype(np.int32)
                lengths = np.bincount(text, minlength=n_docs)[turn]
                v &= U((1 << V_BITS) - 1)
                last = (u & U((1 << U_BITS) - 1)) << U(32) | place[text].astype(U)
                del u, text
                order = np.lexsort((last, v, word))
                order = order[np.argsort(shard[order].astype(np.uint16 if shards <= 65536 else np.int32), kind="stable")]
                shard, word, v, last = shard[order], word[order], v[order], last[order]
                del order
                ref = run_starts(shard, word, v, last)
                times = np.diff(np.append(ref, len(word)))
                shard, word, v, last = shard[ref], word[ref], v[ref], last[ref]
                u, doc = last >> U(32), (last & U((1 << 32) - 1)).astype(doc_kind(n_docs))
                triple = run_starts(shard, word, v, u)
                n_refs = np.diff(np.append(triple, len(word)))
                pair = run_starts(shard[triple], word[triple], v[triple])
                n_triples = np.diff(np.append(pair, len(triple)))
                first = run_starts(shard[triple[pair]], word[triple[pair]])
                n_pairs = np.diff(np.append(first, len(pair)))
                edges = np.arange(shards + 1)
                cuts = [np.searchsorted(x, edges) for x in (shard, shard[triple], shard[triple[pair]], shard[triple[pair[first]]])]
                del shard, last
                name = f"{TaskContext.get().partitionId()}/{number}/{zlib.crc32(rows.column(1).to_numpy().tobytes())}"
                number += 1
                same = {"block": name, "n_docs": n_docs, "n_train": n_train}
                kept = rows.take(pa.array(turn))
                out = [same | {"shard": zlib.crc32(name.encode()) % shards, "ids": kept.column(0).to_pylist(), "ths": kept.column(1).to_pylist(), "lengths": narrow(lengths)}]
                for s in np.flatnonzero(np.diff(cuts[0])).tolist():
                    r, t, p, w = (slice(c[s], c[s + 1]) for c in cuts)
                    out.append(same | {"shard": s, "words": word[triple[pair[first[w]]]].tobytes(), "n_pairs": narrow(n_pairs[w]), "vs": cut(v[triple[pair[p]]], V_BITS // 8), "n_triples": narrow(n_triples[p]), "us": cut(u[triple[t]], U_BITS // 8), "n_refs": narrow(n_refs[t]), "refs": doc[r].tobytes(), "times": narrow(times[r])})
                yield pa.RecordBatch.from_pylist(out, schema=arrow_schema(blob, batch.schema.field(0).type))

    unknown_base = math.log10(0.1 / (total + 0.1 * (types + 1)))

    def score(group: pa.Table) -> pa.Table:
        leads = group.filter(group.column("ids").is_valid()).select(partial.names[:6])
        rest = group.filter(group.column("ids").is_null())
        rows = [{k: rest.column(k)[i].as_py() for k in blob.names if k not in ("ids", "ths", "lengths")} for i in range(rest.num_rows)]
        blocks = [Block(r) for r in rows]
        trie = trie_of(blocks, total, types, hot_counts, back, prior)
        out, at = [], 0
        while at < len(blocks):
            to, refs = at, 0
            while to < len(blocks) and (to == at or refs + len(blocks[to].doc) <= STREAM_REFS):
                refs += len(blocks[to].doc)
                to += 1
            many = together(blocks[at:to])
            docs_, *sums = streamed(many, trie, unknown_base, prior)
            for i, edges in enumerate(zip(*(np.searchsorted(docs_, x) for x in (many.starts[:-1], many.starts[1:])), strict=True)):
                row, (known, base, value) = rows[at + i], (x[slice(*edges)] for x in sums)
                out.append({"block": row["block"], "n_docs": row["n_docs"], "n_train": row["n_train"], "docs": (docs_[slice(*edges)] - many.starts[i]).astype(doc_kind(row["n_docs"])).tobytes(), "known": narrow(known.astype(np.int64)), "base": base.tobytes(), "score": value.astype(np.float32).tobytes()})
            at = to
        kind = arrow_schema(partial, group.schema.field("ids").type.value_type)
        figures = pa.Table.from_pylist(out, schema=kind)
        for k in partial.names[6:]:
            leads = leads.append_column(k, pa.nulls(leads.num_rows, pa.binary()))
        return pa.concat_tables([leads.cast(kind), figures])

    parts = texts.mapInArrow(pack, blob).groupBy("shard").applyInArrow(score, partial)
    final = T.StructType([T.StructField("id", id_type), *T._parse_datatype_string("th long, held boolean, n_tokens long, n_known long, base double, score double").fields])
    opening = math.log10(train_docs * (1 + back) + prior)  # the denominator of a text's first token

    def united(group: pa.Table) -> pa.Table:
        lead = group.filter(group.column("ids").is_valid())
        if lead.num_rows != 1:
            raise RuntimeError("the rows of a block come from different runs of its task")
        rest = group.filter(group.column("ids").is_null())
        n = lead.column("n_docs")[0].as_py()
        known, base, value = np.zeros(n, np.int64), np.zeros(n), np.full(n, -opening)
        for r in sorted(rest.select(partial.names[6:]).to_pylist(), key=lambda x: (x["docs"], x["base"])):  # one order of adding
            d = np.frombuffer(r["docs"], doc_kind(n))
            known[d] += wide(r["known"])
            base[d] += np.frombuffer(r["base"], np.float64)
            value[d] += np.frombuffer(r["score"], np.float32)
        ids, ths = (lead.column(k).combine_chunks().flatten() for k in ("ids", "ths"))
        return pa.table([ids, ths, pa.array(np.arange(n) >= lead.column("n_train")[0].as_py()), pa.array(wide(lead.column("lengths")[0].as_py())), pa.array(known), pa.array(base), pa.array(value)], names=final.names)

    scored = parts.groupBy("block").applyInArrow(united, final)
    per = scored.groupBy("id", "th").agg(*[F.min(c).alias(c) for c in final.names[2:]])
    d, f = joined_back(docs, per, id_col, text_col)
    figures = F.struct(F.col(f"{f}.held").alias("held_out"), F.col(f"{f}.n_tokens").alias("n_tokens"), F.col(f"{f}.n_known").alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), F.col(f"{f}.base").alias("base_score"), F.col(f"{f}.score").alias("score"))
    return d.select(*[F.col(c) for c in docs.columns], figures.alias(free_name(docs, "lm")))
