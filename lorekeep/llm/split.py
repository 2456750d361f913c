"""Splitting oversized Markdown at natural boundaries, by structure-tree packing.

A text is parsed into a tree of byte spans: sections by heading level, in them blocks (front matter, code fences, lists,
paragraphs), in lists items by indentation, in all of these lines, then sentences, then words, then characters. Children are
parsed only where a node is oversized; sibling subtrees are merged bottom-up while they fit. Pieces after the first begin
with an overlap of 200 to 400 bytes, shifted to whole characters and to a natural boundary where one lies in that range.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Span = tuple[int, int]

LIMIT, LEAST_OVERLAP, MOST_OVERLAP = 5000, 200, 400
_HEADING = re.compile(rb"^(#{1,6})[ \t]", re.M)
_FENCE = re.compile(rb"^[ \t]*(?:```|~~~)[^\n]*$", re.M)
_FRONT = re.compile(rb"---\r?\n.*?\n---[ \t]*(?:\r?\n|$)", re.S)
_BLANK = re.compile(rb"\n(?:[ \t]*\r?\n)+")
_ITEM = re.compile(rb"^([ \t]*)(?:[-*+]|\d{1,9}[.)])[ \t]", re.M)
_LINE = re.compile(rb"\n")
_SENTENCE = re.compile(rb"(?:[.!?][\"')\]]*[ \t]+)|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
_WORD = re.compile(rb"[ \t\r\n]+|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")
#: Space, tab, CR, LF and the marks U+3002, U+FF01, U+FF1F: text between them has no natural boundary.
_GAP = re.compile(rb"[ \t\r\n]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f")


def _spans(cuts: list[int], a: int, b: int) -> list[Span]:
    """The parts of [a, b) between the cuts that lie inside it."""
    at = [a, *sorted({c for c in cuts if a < c < b}), b]
    return list(zip(at, at[1:], strict=False))


class _Tree:
    """Headings, fences and list items are parsed once and looked up by position, so a node costs what lies in it."""

    def __init__(self, data: bytes):
        self.data = data
        self.front = m.end() if (m := _FRONT.match(data)) else 0
        marks = [m.span() for m in _FENCE.finditer(data, self.front)]
        self.opened = [a for a, _ in marks[::2]]
        self.closed = [b + 1 for _, b in marks[1::2]] + [len(data)] * (len(marks) % 2)
        self.fence_ends = sorted(self.opened + self.closed)
        headings = [(m.start(), len(m[1])) for m in _HEADING.finditer(data, self.front) if not self._fenced(m.start())]
        self.heading_at, self.heading_level = [at for at, _ in headings], [n for _, n in headings]
        items = [(m.start(), len(m[1].expandtabs(4))) for m in _ITEM.finditer(data, self.front) if not self._fenced(m.start())]
        self.item_at, self.item_indent = [at for at, _ in items], [n for _, n in items]
        #: The longest stretch without a natural boundary that had to be cut at characters, in bytes.
        self.cut_run = 0

    def _fenced(self, at: int) -> bool:
        i = bisect_right(self.opened, at) - 1
        return i >= 0 and at < self.closed[i]

    def children(self, a: int, b: int, kind: str) -> tuple[list[Span], str]:
        """The next finer parts of the span, and their kind. The kinds in order: section 1 to 6, block, item, line, sentence, word, char."""
        while True:
            if kind.startswith("section"):
                level = int(kind[7:])
                first, last = bisect_left(self.heading_at, a), bisect_left(self.heading_at, b)
                cuts = [self.heading_at[i] for i in range(first, last) if self.heading_level[i] <= level]
                cuts.append(self.front)
                kind = f"section{level + 1}" if level < 6 else "block"
            elif kind == "block":
                cuts = [m.end() for m in _BLANK.finditer(self.data, a, b) if not self._fenced(m.end() - 1)]
                cuts += self.fence_ends[bisect_left(self.fence_ends, a) : bisect_left(self.fence_ends, b)]
                kind = "item"
            elif kind == "item":
                first, last = bisect_left(self.item_at, a), bisect_left(self.item_at, b)
                first += first < last and self.item_at[first] == a
                least = min(self.item_indent[first:last], default=0)
                cuts = [self.item_at[i] for i in range(first, last) if self.item_indent[i] == least]
                kind = "item" if len(_spans(cuts, a, b)) > 1 else "line"
            elif kind == "line":
                cuts, kind = [m.end() for m in _LINE.finditer(self.data, a, b)], "sentence"
            elif kind == "sentence":
                cuts, kind = [m.end() for m in _SENTENCE.finditer(self.data, a, b)], "word"
            else:
                cuts, kind = [m.end() for m in _WORD.finditer(self.data, a, b)], "char"
            parts = _spans(cuts, a, b)
            if len(parts) > 1 or kind == "char":
                return parts, kind

    def start_of_char(self, at: int, step: int) -> int:
        while 0 < at < len(self.data) and self.data[at] & 0xC0 == 0x80:
            at += step
        return at

    def pack(self, a: int, b: int, cap: int) -> list[Span]:
        """Spans of at most `cap` bytes that cover [a, b). Without recursion, so that depth costs no stack."""
        out: list[list[Span]] = [[]]
        work: list[tuple] = [(a, b, "section1")]
        while work:
            a, b, kind = work.pop()
            if kind == "merge":
                merged = self._merge(out.pop(), cap)
                out[-1].extend(merged)
            elif b - a <= cap:
                out[-1].append((a, b))
            elif kind == "char":
                self.cut_run = max(self.cut_run, max(map(len, _GAP.split(self.data[a:b]))))
                while b - a > cap:
                    cut = self.start_of_char(a + cap, -1)
                    cut = cut if cut > a else a + cap  # not UTF-8: can't come from a string
                    out[-1].append((a, cut))
                    a = cut
                out[-1].append((a, b))
            else:
                parts, finer = self.children(a, b, kind)
                out.append([])
                work.append((0, 0, "merge"))
                work += [(x, y, finer) for x, y in reversed(parts)]
        return out[0]

    @staticmethod
    def _merge(spans: list[Span], cap: int) -> list[Span]:
        done: list[Span] = []
        for a, b in spans:
            if done and b - done[-1][0] <= cap:
                done[-1] = (done[-1][0], b)
            else:
                done.append((a, b))
        return done

    def kind_of_cut(self, at: int) -> str:
        before = self.data[max(0, at - 8) : at]
        if at == len(self.data):
            return "end"
        if (i := bisect_left(self.heading_at, at)) < len(self.heading_at) and self.heading_at[i] == at:
            return "heading"
        if re.search(rb"\n[ \t]*\r?\n$", before):
            return "block"
        if before.endswith(b"\n"):
            return "item" if _ITEM.match(self.data, at) else "line"
        if re.search(rb"(?:[.!?][\"')\]]*[ \t]+|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)$", before):
            return "sentence"
        return "word" if before[-1:] in b" \t\r" else "forced"

    def overlap_start(self, lo: int, hi: int) -> int:
        """In [lo, hi]: after a line, else after a sentence, else after white space, else at a character; the earliest of its kind."""
        for pattern in (_LINE, _SENTENCE, _WORD):
            for m in pattern.finditer(self.data, max(0, lo - 1), hi):
                if lo <= m.end() <= hi:
                    return m.end()
        return self.start_of_char(lo, 1)


def split_bytes(data: bytes, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> tuple[list[tuple[int, int, int, str]], str]:
    """(start of the new bytes, end, overlap in bytes, kind of the cut at the end) per piece, and `forced` if the tree came down to a stretch
    longer than the limit without a natural boundary, else `natural`. A text within the limit is one piece."""
    if len(data) <= limit:
        return [(0, len(data), 0, "end")], "natural"
    tree = _Tree(data)
    spans = tree.pack(0, len(data), limit - least - 4)
    if spans[0][1] < least:  # too short to lend an overlap; the first piece has none itself, so both fit in it
        spans[:2] = [(0, spans[1][1])]
    pieces, before = [], 0
    for i, (a, b) in enumerate(spans):
        at = tree.overlap_start(max(a - most, b - limit, before), a - least) if i else a
        pieces.append((a, b, a - at, tree.kind_of_cut(b)))
        before = at
    return pieces, "forced" if tree.cut_run > limit else "natural"


_OUT = "piece int, start bigint, end bigint, overlap int, boundary string, cut string, text string"


def _split(limit: int, least: int, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for key, value in zip(b.column(0), b.column(1), strict=True):  # a row at a time: a text may be very long
                data = value.as_py().encode("utf-8", "surrogatepass")
                pieces, cut = split_bytes(data, limit, least, most)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([key.as_py()] * len(pieces), b.column(0).type),
                        pa.array(range(len(pieces)), pa.int32()),
                        pa.array([p[0] for p in pieces], pa.int64()),
                        pa.array([p[1] for p in pieces], pa.int64()),
                        pa.array([p[2] for p in pieces], pa.int32()),
                        pa.array([p[3] for p in pieces], pa.string()),
                        pa.array([cut] * len(pieces), pa.string()),
                        pa.array([data[p[0] - p[2] : p[1]].decode("utf-8", "surrogatepass") for p in pieces], pa.string()),
                    ],
                    ["id", "piece", "start", "end", "overlap", "boundary", "cut", "text"],
                )

    return run


def split_oversized(docs: DataFrame, key: str, text: str, limit: int = LIMIT, least: int = LEAST_OVERLAP, most: int = MOST_OVERLAP) -> DataFrame:
    """id, piece, start, end, overlap, boundary, cut, text for each piece of the texts with more than `limit` UTF-8 bytes.

    start and end are the bytes a piece adds; text begins `overlap` bytes before start. boundary is what the piece ends at;
    cut is `forced` if the text has a stretch longer than the limit without a natural boundary, else `natural`. Null, empty and
    small texts give no rows; repeated rows give their pieces again; a null key stays null. One pass, no exchange: only oversized texts leave the JVM.
    """
    if not 0 < least <= most - 4 or limit < most + least:
        raise ValueError("the limit must exceed both overlaps, and the overlaps must leave room to shift to a character")
    big = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.octet_length("text") > limit)
    kind = big.schema["id"].dataType.simpleString()
    return big.mapInArrow(_split(limit, least, most), f"id {kind}, {_OUT}")
