"""Evaluation passages inside training text.

The items are cut into shards of bounded size, each with a generalised suffix automaton of its items' words, built in the tasks and written
to the shared folder. The corpus is read once, whatever the number of shards: a bitmap of bounded size over the items' stretches of
GRAM words is broadcast, and a document can hold `min_words` words of an item only where so many neighbouring stretches are all in the bitmap
(vectorised, without loss). What is left, a few documents, is looked up exactly by its stretches' hashes and goes to just the
shards that hold them, where its words are streamed through the automaton and the longest matching lengths are tracked.
A match is a stretch of `min_words` words, or all words of a shorter item. Items longer than a shard are cut into parts that overlap by a match.
"""

from __future__ import annotations

import pickle
import unicodedata
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcastable, materialise, spread
from .automaton import SuffixAutomaton
from .words import WORD, WordHashes, mix

MIN_WORDS, SHARD_CHARS, GRAM = 16, 400_000, 8
#: Limits beyond which a document is trimmed or dropped: words of a leaked span, and share of the document's characters.
MAX_SPAN, MAX_COVERAGE = 16, 0.5
#: Bits of the bitmap per stretch, and the powers of two between which its size lies (32 MiB at most).
BITS_PER_GRAM, LEAST_BITS, MOST_BITS = 32, 16, 28
#: Documents that one set-up of a shard's automaton is for.
SALT_ROWS = 500
_BITS = 22


def normalised(text: str) -> str:
    return (text if text.isascii() else unicodedata.normalize("NFKC", text)).lower()


class ItemIndex:
    """The automaton of a set of items and what is needed to read texts quickly."""

    def __init__(self, items: list[tuple[int, list[str]]], min_words: int):
        self.min_words = min_words
        self.vocabulary: dict[str, int] = {}
        self.automaton = SuffixAutomaton()
        self.short: dict[int, list[tuple[int, int]]] = defaultdict(list)  # state: (words, owner) of items shorter than min_words
        self.ids: list[int] = []
        self.least = min_words
        sequences = []
        for item_id, words in items:
            if words:
                sequences.append([self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words])
                self.ids.append(item_id)
        self.near = np.zeros(1 << _BITS, bool)
        ends = []
        for owner, s in enumerate(sequences):
            ends.append(self.automaton.add(s, owner))
            if len(s) > 1:
                self.near[self._slot(np.array(s[:-1]), np.array(s[1:]))] = True
            self.least = min(self.least, len(s))
        for owner, s in enumerate(sequences):
            if len(s) < min_words:  # later items may have split the state
                state = self.automaton.suffix_state(ends[owner], len(s))
                self.short[state].append((len(s), owner))

    @staticmethod
    def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return ((a.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + b.astype(np.uint64)) * np.uint64(0xC2B2AE3D27D4EB4F)) >> np.uint64(64 - _BITS)

    def runs(self, ids: np.ndarray) -> list[tuple[int, int]]:
        """Stretches [i, j) of known words whose neighbours all are neighbours in some item, of at least the shortest match."""
        good = ids >= 0
        if self.least == 1:
            step = np.flatnonzero(np.diff(np.concatenate(([0], good.view(np.int8), [0]))))
            return list(zip(step[::2].tolist(), step[1::2].tolist(), strict=True))
        if len(ids) < self.least:
            return []
        pair = good[:-1] & good[1:]
        at = np.flatnonzero(pair)
        if len(at) < self.least - 1:
            return []
        pair[at] = self.near[self._slot(ids[at], ids[at + 1])]
        step = np.flatnonzero(np.diff(np.concatenate(([0], pair.view(np.int8), [0]))))
        return [(i, j + 1) for i, j in zip(step[::2].tolist(), step[1::2].tolist(), strict=True) if j - i >= self.least - 1]

    def find(self, words: list[str]) -> dict[int, list[tuple[int, int]]]:
        """owner: maximal spans [i, j) of words that it shares, each of at least min_words words or the whole of a shorter item."""
        get = self.vocabulary.get
        ids = np.fromiter((get(w, -1) for w in words), np.int64, len(words))
        found: dict[int, list[tuple[int, int]]] = {}
        sa, k = self.automaton, self.min_words
        for i, j in self.runs(ids):
            for at, (v, n) in enumerate(sa.matches(ids[i:j].tolist()), i + 1):
                if n >= k:
                    for owner in sa.owners(sa.suffix_state(v, k)):
                        self._span(found, owner, at - k, at)
                if self.short and n >= self.least:
                    u = v
                    while u > 0:
                        for size, owner in self.short.get(u, ()):
                            if size <= n:
                                self._span(found, owner, at - size, at)
                        u = sa.link[u]
        return found

    @staticmethod
    def _span(found: dict, owner: int, i: int, j: int) -> None:
        spans = found.setdefault(owner, [])
        if spans and spans[-1][1] >= i and spans[-1][1] == j - 1:
            spans[-1] = (spans[-1][0], j)
        elif not spans or spans[-1][1] < j:
            spans.append((i, j))


def original_spans(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Word spans of the normalised text as character spans of the text itself.

    The text is normalised in the smallest parts that add up to the normalised whole: single characters with what combines with them,
    or, where characters compose across such parts, stretches between white space. A span grows to whole parts."""
    parts: list[tuple[int, str]] = []
    begin = 0
    for i in range(1, len(text) + 1):
        if i == len(text) or not (unicodedata.combining(text[i]) or 0x1160 <= ord(text[i]) <= 0x11FF or 0xFF9E <= ord(text[i]) <= 0xFF9F):
            parts.append((begin, normalised(text[begin:i])))
            begin = i
    whole = normalised(text)
    if "".join(p for _, p in parts) != whole:
        parts, begin = [], 0
        for i in range(1, len(text) + 1):
            if i == len(text) or (text[i - 1].isspace() and not unicodedata.combining(text[i])):
                parts.append((begin, normalised(text[begin:i])))
                begin = i
    starts = np.array([s for s, _ in parts] + [len(text)])
    ends = np.cumsum([len(p) for _, p in parts])
    words = [m.span() for m in WORD.finditer(whole)]
    out = []
    for i, j in spans:
        a, b = words[i][0], words[j - 1][1]
        first, last = np.searchsorted(ends, a, "right"), np.searchsorted(ends, b, "left")
        out.append((int(starts[first]), int(starts[min(last + 1, len(parts))])))
    return out


_WEIGHTS = mix(np.arange(501, 501 + GRAM, dtype=np.uint64)) | np.uint64(1)


def _grams(h: np.ndarray, k: int) -> np.ndarray:
    """Hashes of all k consecutive words (1 to GRAM) of word hashes."""
    n = len(h) - k + 1
    if n < 1:
        return np.empty(0, np.uint64)
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out += h[i : i + n] * _WEIGHTS[i]
    return mix(out)


_SHORT = np.uint64(0x9E3779B97F4A7C15)
#: One stretch alone, not a run, says that a shorter item may stand in a text; so it has more places in the bitmap.
_MORE_PLACES = 3


def _place(g: np.ndarray, n: int) -> np.ndarray:
    return mix(g + np.uint64(n)) if n else g


def _parts(min_words: int, shard_chars: int):
    """Items as words, in parts of at most about shard_chars characters, with the hashes by which documents are routed: of a whole item's stretches all, of an
    item shorter than a match its first (length is that stretch's words, 0 for the others), and the places they have in the bitmap."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, k = WordHashes(), min(GRAM, min_words)
        for b in batches:
            rows = []
            for item, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                words = WORD.findall(normalised(value.as_py()))
                if not words:
                    continue
                size = max(2 * min_words, shard_chars * len(words) // (sum(map(len, words)) + len(words)))
                for n, a in enumerate(range(0, max(1, len(words) - min_words + 1), size)):
                    part = words[a : a + size + min_words - 1]
                    h = np.fromiter(map(hashes.__getitem__, part), np.uint64, len(part))
                    if len(words) < min_words:
                        length = min(len(words), k)
                        g = _grams(h[:length], length) ^ _SHORT
                        places = np.concatenate([_place(g, i) for i in range(_MORE_PLACES + 1)])
                    else:
                        length = 0
                        g = places = np.unique(_grams(h, k))
                    rows.append((item, n, part, length, g.view(np.int64), places.view(np.int64)))
            kinds = (pa.int64(), pa.int32(), pa.list_(pa.string()), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], ["item", "part", "words", "length", "grams", "places"])

    return run


def _build(min_words: int):
    """Rows come by shard."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = lambda shard, held: pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([pickle.dumps(ItemIndex(held, min_words), 5)], pa.binary())], ["shard", "index"])
        now, held = None, []
        for b in batches:
            for shard, item, words in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                if shard != now and held:
                    yield out(now, held)
                    held = []
                now = shard
                held.append((item, words))
        if held:
            yield out(now, held)

    return run


def _suspects(shared, min_words: int):
    """Documents that may hold a match, with the hashes of the stretches that say so."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, log, lengths, whole = shared.value
        bitmap = np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little").view(bool)
        hashes, k, shift = WordHashes(), min(GRAM, min_words), np.uint64(64 - log)
        need = min_words - k + 1
        for b in batches:
            rows, found = [], []
            for n, value in enumerate(b.column(1)):
                words = WORD.findall(normalised(value.as_py()))
                h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
                hits = []
                if whole and len(words) >= min_words:
                    g = _grams(h, k)
                    step = np.flatnonzero(np.diff(np.concatenate(([0], bitmap[g >> shift].view(np.int8), [0]))))
                    hits = [g[i:j] for i, j in zip(step[::2].tolist(), step[1::2].tolist(), strict=True) if j - i >= need]
                for length in lengths:
                    g = _grams(h, length) ^ _SHORT
                    for i in range(_MORE_PLACES + 1):
                        g = g[bitmap[_place(g, i) >> shift]]
                    hits.append(g)
                if any(map(len, hits)):
                    rows.append(n)
                    found.append(np.unique(np.concatenate(hits)).view(np.int64))
            yield pa.RecordBatch.from_arrays([*(c.take(pa.array(rows, pa.int64())) for c in b.columns), pa.array(found, pa.list_(pa.int64()))], ["doc_id", "text", "hits"])

    return run


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come by shard, in it the automaton before the texts to stream."""
    index: ItemIndex | None = None
    for b in batches:
        digests, items, starts, ends, words_of = [], [], [], [], []
        for i in range(b.num_rows):
            if (data := b.column(2)[i].as_py()) is not None:
                index = pickle.loads(data)
                continue
            text = b.column(1)[i].as_py()
            if not (found := index.find(WORD.findall(normalised(text)))):
                continue
            flat = [(o, s) for o, spans in found.items() for s in spans]
            for (owner, span), (a, e) in zip(flat, original_spans(text, [s for _, s in flat]), strict=True):
                digests.append(b.column(0)[i].as_py())
                items.append(index.ids[owner])
                starts.append(a)
                ends.append(e)
                words_of.append(span[1] - span[0])
        yield pa.RecordBatch.from_arrays(
            [pa.array(digests, pa.binary()), pa.array(items, pa.int64()), pa.array(words_of, pa.int32()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())],
            ["digest", "item_id", "n_words", "start", "end"],
        )


def _bitmap(grams: DataFrame, n: int) -> tuple[bytes, int]:
    """(bits, log2 of their number) of n hashes, by their highest bits: put together in the tasks, bounded on the driver."""
    log = min(MOST_BITS, max(LEAST_BITS, (n * BITS_PER_GRAM).bit_length()))
    place = F.shiftrightunsigned("gram", 64 - log)
    size = (1 << log) // 8
    bits = bytearray(size)
    rows = grams.groupBy(F.bitmap_bucket_number(place + 1).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(place + 1)).alias("bits"))
    for r in rows.toLocalIterator():
        at = (r.bucket - 1) * 4096
        bits[at : at + 4096] = r.bits[: size - at]
    return bytes(bits), log


def find_leaks(docs: DataFrame, key: str, text: str, items: DataFrame, item_key: str, item_text: str, min_words: int = MIN_WORDS, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """doc_id, item_id, n_words, start, end: the spans (in characters of the text as it stands) that documents share with items.

    Texts and items are compared in Unicode form NFKC, lower-cased, as words. A span has at least min_words words or all words of a shorter item; one
    that crosses the parts of an item longer than a shard comes out in pieces that overlap. Null, empty or wordless texts and items match nothing; null item ids are ignored; null doc_ids stay null; repeated
    rows give their spans again. Items with equal texts are all reported. Other columns are not read.
    """
    sc = docs.sparkSession.sparkContext
    docs = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).where(F.col("text").isNotNull())
    kind = docs.schema["doc_id"].dataType.simpleString()
    items = items.where(F.col(item_key).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_key).cast("bigint"), F.col(item_text)).distinct()
    parts = items.mapInArrow(_parts(min_words, shard_chars), "item bigint, part int, words array<string>, length int, grams array<bigint>, places array<bigint>")
    parts = materialise(parts, "item-parts")
    chars = F.aggregate("words", F.lit(0), lambda n, w: n + F.length(w) + 1)
    # lengths are GRAM + 1 different values at most
    totals = parts.agg(F.sum(chars.cast("bigint")).alias("chars"), F.sum(F.size("places")).alias("places"), F.collect_set("length").alias("lengths")).first()
    shards = max(1, -(-(totals.chars or 0) // shard_chars))
    parts = parts.withColumn("shard", F.pmod(F.xxhash64("item", "part"), F.lit(shards)).cast("int"))
    grams = parts.select(F.explode("grams").alias("gram"), "shard").distinct()
    built = parts.select("shard", "item", "words").repartition(min(shards, 4 * sc.defaultParallelism), "shard").sortWithinPartitions("shard", "item")
    built = materialise(built.mapInArrow(_build(min_words), "shard int, index binary"), "item-indexes")

    bits = _bitmap(parts.select(F.explode("places").alias("gram")), totals.places or 0)
    shared = sc.broadcast((*bits, sorted(n for n in totals.lengths if n), 0 in totals.lengths))
    found = spread(docs, "doc_id").mapInArrow(_suspects(shared, min_words), f"doc_id {kind}, text string, hits array<bigint>")
    found = materialise(found.withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary")))), "suspects")
    shared.destroy()
    routes = found.select("digest", F.explode("hits").alias("gram")).join(grams, "gram").select("digest", "shard").distinct()
    routes = materialise(routes, "leak-routes")
    salts = routes.groupBy("shard").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    tasks = min(salts.agg(F.sum("salts")).first()[0] or 1, 20_000)
    salt = lambda c: F.pmod(F.xxhash64(c), F.col("salts")).cast("int")
    texts = found.select("digest", "text").dropDuplicates(["digest"])
    none = F.lit(None)
    streams = routes.join(salts, "shard").join(texts, "digest").select("shard", salt("digest").alias("salt"), "digest", "text", none.cast("binary").alias("index"))
    indexes = built.join(salts, "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), none.cast("binary").alias("digest"), none.cast("string").alias("text"), "index")
    work = indexes.unionByName(streams).repartition(tasks, "shard", "salt").sortWithinPartitions("shard", "salt", F.asc_nulls_first("digest"))
    spans = work.select("digest", "text", "index").mapInArrow(_scan, "digest binary, item_id bigint, n_words int, start bigint, end bigint")
    return found.select("doc_id", "digest").join(spans, "digest").drop("digest")


def merged(spans: DataFrame, key: str) -> DataFrame:
    """The union of spans [start, end) per key, as disjoint spans."""
    w = Window.partitionBy(key).orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    opened = spans.select(key, "start", "end").distinct().withColumn("opens", F.when(reach >= F.col("start"), 0).otherwise(1))
    grouped = opened.withColumn("run", F.sum("opens").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return grouped.groupBy(key, "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def without(text: Column, spans: Column) -> Column:
    """The text without the disjoint, sorted spans: what lies between the end of one and the start of the next."""
    start = F.concat(F.array(F.lit(0).cast("bigint")), spans["end"])
    end = F.concat(spans["start"], F.array(F.length(text).cast("bigint")))
    kept = F.zip_with(start, end, lambda a, b: F.substring(text, (a + 1).cast("int"), F.greatest(b - a, F.lit(0)).cast("int")))
    return F.array_join(kept, "")


def decontaminated(docs: DataFrame, key: str, text: str, leaks: DataFrame, max_span: int = MAX_SPAN, max_coverage: float = MAX_COVERAGE, min_words: int = MIN_WORDS) -> DataFrame:
    """doc_id, action, n_removed, coverage, text of every affected document.

    Spans of at least max_span words are removed, and whole items of fewer than min_words (the least match of find_leaks, so that shorter spans are
    just these); a document of whose characters they cover more than max_coverage is dropped (text null). Keys must be distinct; documents without leaks don't come out.
    """
    long = leaks.where((F.col("n_words") >= max_span) | (F.col("n_words") < min_words))
    spans = merged(long, "doc_id").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = broadcastable(materialise(spans, "leak-spans"))
    hit = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).join(spans, "doc_id")
    removed = F.aggregate("spans", F.lit(0).cast("bigint"), lambda x, s: x + s["end"] - s["start"])
    out = hit.select("doc_id", removed.alias("n_removed"), (removed / F.length("text")).alias("coverage"), without(F.col("text"), F.col("spans")).alias("text"))
    drop = F.col("coverage") > max_coverage
    return out.select("doc_id", F.when(drop, "drop").otherwise("trim").alias("action"), "n_removed", "coverage", F.when(~drop, F.col("text")).alias("text"))
