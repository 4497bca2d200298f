"""The chunk pipeline: blocks kept whole, sentences packed to a size with overlap, small chunks merged.

Packing is a fold over a document's sentences, so it runs per document in Arrow batches, without a shuffle.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .filters import SECTION_NOISE

SCHEMA = "document_id string, chunk_index int, chunk_id string, content string, start_char int, end_char int, token_count int, heading string, block_type string"
MARK = "\x01"
#: Characters of chunks that a worker holds before it hands them on.
HELD_CHARS = 2_000_000
HEADING = re.compile(r"(?m)^#{1,6}\s+(.+)$")
FENCE = re.compile(r"```.*?```", re.S)
ROWS = re.compile(r"(?m)(?:^\|.+\|$\n?)+")
ENDS = re.compile(r"(?<=[.!?])\s+|(?<=\n)\n|(?<=\n)(?=#{1,6}\s)")
NOISE = [re.compile(p) for p in SECTION_NOISE]


@dataclass(frozen=True)
class Sizes:
    size: int = 600
    overlap: int = 100
    least: int = 100
    most: int = 2048
    merge_tokens: int = 100


@dataclass(frozen=True)
class Piece:
    content: str
    start: int
    end: int
    kind: str = "text"
    heading: str | None = None


def sentences(c: Column) -> Column:
    """F3 as a column: sentences with their ends, empty ones left out."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(c, "([.!?]\\s+)", f"$1{MARK}"), "(\\n\\n)", f"$1{MARK}"), "\\n(#{1,6}\\s)", f"\n{MARK}$1")
    return F.filter(F.split(marked, MARK), lambda s: F.regexp_replace(s, "\\s+", "") != "")


def sentence_list(text: str) -> list[str]:
    cuts = [0, *(m.end() for m in ENDS.finditer(text)), len(text)]
    return [p for p in (text[a:b] for a, b in zip(cuts, cuts[1:])) if p.strip()]


def tokens(text: str) -> int:
    if not text:
        return 0
    hangul = sum("가" <= c <= "힯" for c in text)
    other = len(re.sub("[가-힯]", " ", text).split())
    return max(1, int(hangul / 3.0 + other * 1.3))


def runs(text: str) -> Iterator[Piece]:
    """code and tables of two rows or more, and the text between them; of overlapping blocks the first stays."""
    found = [(m.start(), m.end(), "code") for m in FENCE.finditer(text)]
    found += [(m.start(), m.end(), "table") for m in ROWS.finditer(text) if m[0].strip().count("\n") >= 1]
    at = 0
    for start, end, kind in [*sorted(found, key=lambda b: b[0]), (len(text), len(text), "end")]:
        if start < at:
            continue
        if text[at:start].strip():
            yield Piece(text[at:start], at, start)
        if text[start:end].strip():
            yield Piece(text[start:end], start, end, kind)
        at = end


def tail(packed: list[str], most: int) -> list[str]:
    """The last sentences that fit into the overlap, never all of them."""
    keep, length = len(packed), 0
    while keep and length + len(packed[keep - 1]) <= most:
        keep -= 1
        length += len(packed[keep])
    return packed[max(keep, 1) :]


def pack(run: Piece, s: Sizes) -> list[Piece]:
    """sentences up to a size; a short rest joins the piece before it; short pieces in the middle are dropped."""
    out: list[Piece] = []
    held: list[str] = []
    at = 0
    for sentence in sentence_list(run.content):
        if held and sum(map(len, held)) + len(sentence) > s.size:
            joined = "".join(held)
            if len(joined.strip()) >= s.least:
                out.append(Piece(joined.strip(), run.start + at, run.start + at + len(joined)))
            again = tail(held, s.overlap)
            at += len(joined) - sum(map(len, again))
            held = again
        held = [*held, sentence]
    rest = "".join(held)
    if rest.strip():
        last = Piece(rest.strip(), run.start + at, run.start + at + len(rest))
        together = f"{out[-1].content} {last.content}" if out else ""
        if out and len(last.content) < s.least and len(together) <= s.most:
            out[-1] = Piece(together, out[-1].start, run.start + len(run.content))
        else:
            out.append(last)
    return out


def split_block(run: Piece, s: Sizes) -> list[Piece]:
    """an oversized block, by blank lines if code, by rows if a table."""
    body, glue = run.content.strip(), "\n\n" if run.kind == "code" else "\n"
    if len(body) <= s.most:
        return [replace(run, content=body)]
    groups: list[list[str]] = [[]]
    for part in body.split(glue):
        if groups[-1] and sum(map(len, groups[-1])) + len(part) > s.most:
            groups.append([])
        groups[-1].append(part)
    return [replace(run, content=glue.join(g)) for g in groups]


def pieces(text: str, s: Sizes) -> list[Piece]:
    """F6 for one text, each piece with the last heading before it."""
    if not text or not text.strip():
        return []
    out = [p for run in runs(text) for p in (pack(run, s) if run.kind == "text" else split_block(run, s))]
    heads = [(m.end(), m[1].strip()) for m in HEADING.finditer(text)]
    return [replace(p, heading=next((h for end, h in reversed(heads) if end <= p.start), None)) for p in out]


def merge_small(chunks: list[Piece], s: Sizes) -> list[Piece]:
    """pieces of few tokens go to the piece before them, else to the next, within the largest size."""
    out: list[Piece] = []
    todo = list(reversed(chunks)) if len(chunks) > 1 else []
    while todo:
        now = todo.pop()
        small = tokens(now.content) < s.merge_tokens
        if small and out and len(out[-1].content) + len(now.content) + 1 <= s.most:
            out[-1] = replace(out[-1], content=f"{out[-1].content}\n{now.content}", end=now.end)
        elif small and todo and len(todo[-1].content) + len(now.content) + 1 <= s.most:
            todo[-1] = replace(todo[-1], content=f"{now.content}\n{todo[-1].content}", start=now.start)
        else:
            out.append(now)
    return out if len(chunks) > 1 else chunks


def sections(text: str) -> list[tuple[str, str]]:
    """A4 for one text: (title, body) of each Markdown heading; what stands before the first is dropped."""
    marks = list(HEADING.finditer(text))
    ends = [m.start() for m in marks[1:]] + [len(text)]
    return [(m[1].strip(), text[m.end() : end].strip("\n")) for m, end in zip(marks, ends)]


def document_chunks(text: str, s: Sizes) -> list[Piece]:
    """By sections where there are headings, else the whole text."""
    parts = sections(text or "")
    if not parts:
        return pieces(text, s)
    out, offset = [], 0
    for title, body in parts:
        clean = body.strip()
        if clean and not any(p.search(clean) for p in NOISE) and len(clean) >= s.least:
            shifted = [replace(p, heading=title, start=p.start + offset, end=p.end + offset) for p in pieces(clean, s)]
            out += merge_small(shifted, s)
        offset += len(body)
    return out


def chunk_corpus(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sizes: Sizes = Sizes(), held_chars: int = HELD_CHARS) -> DataFrame:
    """all chunks of all documents; ids are content hashes, so reruns agree.

    A worker makes strings of one document at a time and hands on its chunks before they hold many more than held_chars
    characters, however long the texts of a batch are.
    """
    columns = [c.split() for c in SCHEMA.split(", ")]
    kinds = [pa.string() if kind == "string" else pa.int32() for _, kind in columns]
    made = lambda rows: pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=[n for n, _ in columns])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, held = [], 0
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                doc = doc.as_py()
                for i, p in enumerate(document_chunks(text.as_py(), sizes)):
                    name = hashlib.sha256(f"{doc}|{i}|{p.content}".encode()).hexdigest()
                    rows.append((doc, i, name, p.content, p.start, p.end, tokens(p.content), p.heading, None if p.kind == "text" else p.kind))
                    held += len(p.content)
                    if held >= held_chars:
                        yield made(rows)
                        rows, held = [], 0
            if rows:
                yield made(rows)

    return docs.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, SCHEMA)
