"""The search index: which pages hold which three characters, and how long pages are.

Of every indexed column, lower-cased, each three characters in a row are a gram; the column's end is padded, so a keyword of one or two characters
is the beginning of a gram wherever it stands. A keyword can only stand in a page that has all its grams. A task makes segments of the pages that it
reads: a row for each gram with the places of its pages in the segment, and a row for the empty gram with the ids at those places. So nothing is
exchanged, and there are as many rows as segments have grams. Each file lies sorted by gram, so that a search reads the pages of the file that hold
its own grams and the ids; what they leave over is checked on the pages themselves.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcastable, materialise

GRAM = 3
_PAD = "\x00" * (GRAM - 1)
#: A segment is closed once it has so many characters or pages.
SEGMENT_CHARS, SEGMENT_PAGES = 4 << 20, 1 << 13
#: A segment of fewer pages is joined with others by the next update.
SMALL_PAGES = 64
SCHEMA = "gram string, segment string, places array<int>, ids array<string>"
_ARROW = pa.schema([("gram", pa.string()), ("segment", pa.string()), ("places", pa.list_(pa.int32())), ("ids", pa.list_(pa.string()))])


@dataclass
class SearchIndex:
    """postings (SCHEMA) and sizes (id, length)."""

    postings: DataFrame
    sizes: DataFrame


def _one_by_one(pages: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """As `_at_once`, for a very long page or very many different characters."""
    by: dict[str, list[int]] = defaultdict(list)
    for place, columns in enumerate(pages):
        found: set[str] = set()
        for value in columns:
            text = value + _PAD
            found.update(text[i : i + GRAM] for i in range(len(value)))
        for gram in found:
            by[gram].append(place)
    grams = sorted(by)
    return grams, np.cumsum([0, *(len(by[g]) for g in grams)]), np.array([p for g in grams for p in by[g]], np.int64)


def _at_once(pages: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Grams in order; where the places of each begin in the third, and the end; places, in order for each gram."""
    columns = [value + _PAD for page in pages for value in page]
    text = np.frombuffer("".join(columns).encode("utf-32-le"), "<u4")
    seen = np.zeros(0x110000, bool)
    seen[text] = True
    letters = np.flatnonzero(seen)
    n, bits = len(letters), len(pages).bit_length()
    if n**GRAM << bits >= 1 << 63:
        return _one_by_one(pages)
    ends = np.cumsum([len(c) for c in columns])
    begins = np.ones(len(text), bool)  # where a gram begins: nowhere in the padding
    begins[ends - 1] = begins[ends - 2] = False
    at = np.flatnonzero(begins)
    number = np.zeros(0x110000, np.int64)
    number[letters] = np.arange(n)
    text = number[text]
    key = (text[at] * n + text[at + 1]) * n + text[at + 2]
    key <<= bits
    key |= np.repeat(np.arange(len(pages)), [sum(map(len, page)) for page in pages])
    key.sort()
    key = key[np.append(True, key[1:] != key[:-1])[: len(key)]]
    gram = key >> bits
    first = np.flatnonzero(np.append(True, gram[1:] != gram[:-1])[: len(gram)])
    gram = gram[first]
    spelt = letters[np.stack([gram // (n * n), gram // n % n, gram % n], axis=1)].astype("<u4").tobytes().decode("utf-32-le")
    return [spelt[i : i + GRAM] for i in range(0, len(spelt), GRAM)], np.append(first, len(key)), key & (1 << bits) - 1


def _segment(name: str, ids: list[str | None], pages: list[list[str]], chars: int) -> pa.RecordBatch:
    grams, begins, places = (_one_by_one if chars > 2 * SEGMENT_CHARS else _at_once)(pages)
    many = len(grams)
    listed = pa.ListArray.from_arrays(pa.array(np.append(begins[:1], begins), pa.int32()), pa.array(places, pa.int32()))
    own = pa.ListArray.from_arrays(pa.array(np.append(0, np.full(many + 1, len(ids))), pa.int32()), pa.array(ids, pa.string()))
    return pa.RecordBatch.from_arrays([pa.array(["", *grams], pa.string()), pa.array([name] * (many + 1), pa.string()), listed, own], schema=_ARROW)


def _segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    task, made = TaskContext.get().partitionId(), 0
    ids: list[str | None] = []
    pages: list[list[str]] = []
    chars = 0

    def closed() -> pa.RecordBatch:
        # the same pages in the same task have the same name: it doesn't matter which attempt of a task is read
        return _segment(f"{task}-{made}-{hashlib.blake2b(repr(ids).encode(), digest_size=8).hexdigest()}", ids, pages, chars)

    for b in batches:
        for row in zip(*b.columns, strict=True):
            columns = [value.as_py() for value in row[1:]]
            more = sum(map(len, columns))
            if pages and (chars + more > SEGMENT_CHARS or len(pages) == SEGMENT_PAGES):
                yield closed()
                ids, pages, chars, made = [], [], 0, made + 1
            ids.append(row[0].as_py())
            pages.append(columns)
            chars += more
    if pages:
        yield closed()


def postings_of(pages: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The segments of the pages, as SCHEMA. Null columns count as empty."""
    low = [F.lower(F.coalesce(F.col(c), F.lit(""))).alias(f"c{i}") for i, c in enumerate(columns)]
    return pages.select("id", *low).mapInArrow(_segments, SCHEMA)


def sorted_postings(postings: DataFrame) -> DataFrame:
    """In the order they are written in."""
    return postings.sortWithinPartitions("gram", "segment")


def updated(postings: DataFrame, pages: DataFrame, touched: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The postings of all `pages`, from older ones and the ids of pages that are new, changed or gone: the segments that hold one of these, and
    small ones, are made again."""
    held = postings.where("gram = ''").select("segment", F.size("ids").alias("n"), F.explode("ids").alias("id"))
    stale = held.join(touched, "id", "left_semi").select("segment").unionByName(held.where(F.col("n") < SMALL_PAGES).select("segment")).distinct()
    again = held.join(stale, "segment", "left_semi").select("id").unionByName(touched.select("id"))
    return postings.join(stale, "segment", "left_anti").select(postings.columns).unionByName(postings_of(pages.join(again, "id", "left_semi"), columns))


def candidates(postings: DataFrame, keywords: list[str]) -> DataFrame:
    """id of the pages that have all grams of some keyword."""
    wanted = []
    for k in keywords:
        low = k.lower()
        grams = sorted({low[i : i + GRAM] for i in range(len(low) - GRAM + 1)})
        wanted.append(grams or [low])
    whole = sorted({g for w in wanted for g in w if len(g) == GRAM})
    begin = sorted({g for w in wanted for g in w if len(g) < GRAM})
    mine = reduce(lambda x, y: x | y, [F.col("gram").isin(["", *whole])] + [F.col("gram").startswith(g) for g in begin])
    has = [F.count_if(F.col("gram").isin(w)) == len(w) if len(w[0]) == GRAM else F.max(F.col("gram").startswith(w[0])) for w in wanted]
    named = F.transform("ids", lambda x, i: F.struct(i.alias("place"), x.alias("id")))
    placed = F.transform("places", lambda p: F.struct(p.alias("place"), F.lit(None).cast("string").alias("id")))
    pages = postings.where(mine).select("gram", "segment", F.inline(F.when(F.col("gram") == "", named).otherwise(placed)))
    found = pages.groupBy("segment", "place").agg(F.max("id").alias("id"), *[h.alias(f"k{i}") for i, h in enumerate(has)])
    return found.where(reduce(lambda x, y: x | y, [F.col(f"k{i}") for i in range(len(has))])).select("id")


def narrowed(pages: DataFrame, index: SearchIndex, keywords: list[str]) -> DataFrame:
    """The pages that can hold some keyword. A wildcard in a keyword too short for a gram can stand for anything: then all of them."""
    if any(len(k) < GRAM and set(k) & {"%", "_"} for k in keywords):
        return pages
    ids = materialise(candidates(index.postings, keywords), "candidates")
    return pages.join(broadcastable(ids), "id", "left_semi")
