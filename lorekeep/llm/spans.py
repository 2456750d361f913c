"""Long exact spans shared between texts.

Suffix automata of every reference shard can't be broadcast to all documents: here every text is a reference, so that would be
shards times corpus. Instead each shard's automaton is set up where it can match, and only what can match is streamed through it.

Texts are winnowed: of the hashes of all stretches of least / 2 code points in a window so long that every stretch of `least`
code points holds a whole window, the least is kept; two texts that share such a stretch share a kept hash, at the same place in
it. Of each text the surroundings of its shared hashes are cut out as segments: just what a stretch of `least` code points that
holds the hash can reach. Segments meet under their hash, equal ones as one row whatever number of texts they stand in. A hash
with more than HOT different segments is split: its stretches by where they begin, in halves again and again, each half under a hash of all that its
stretches have in common, until what differs lies outside. So each segment goes to one place, a passage that very many texts share
collapses into a few rows, and no text, however long, goes anywhere as a whole.

A task sets up one automaton after the other, each over the segments of at most SHARD_CHARS code points, and streams these through it.
It reads them as sequences of chunks between boundaries that depend on the few code points around them (again winnowing), about one symbol for a dozen code
points: any common stretch of `least` code points holds the same chunks except for its ends, so the matching statistics over chunks name
every segment that can share one. The spans are then made exact, to the code point. Equal texts and equal segments are told apart by 128-bit digests.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import broadcastable, materialise, spread
from .automaton import SuffixAutomaton
from .leak import merged, without
from .words import mix

LEAST, SHARD_CHARS, HOT = 400, 500_000, 32
#: Code points of segments that one partition is meant for, and the most partitions that are planned.
PART_CHARS, MOST_PARTS = 4_000_000, 20_000
CHUNK_GRAM, CHUNK_WINDOW = 8, 24
#: Long texts are hashed in blocks of so many code points, which overlap.
BLOCK = 1 << 20

_BASE = 0x9E3779B97F4A7C15


class _Powers:
    """Powers of the base and of its inverse modulo 2^64, made as far as needed."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 2 * len(self.up))
            self.up, self.down = self._grow(_BASE, size), self._grow(pow(_BASE, -1, 1 << 64), size)
        return self.up[:n], self.down[:n]

    @staticmethod
    def _grow(base: int, n: int) -> np.ndarray:
        out = np.ones(n, np.uint64)
        out[1:] = np.uint64(base)
        return np.multiply.accumulate(out)


_POWERS = _Powers()


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _totals(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sums, down): the hash of points[a:b] is (sums[b] - sums[a]) * down[a]."""
    up, down = _POWERS.get(len(points) + 1)
    sums = np.zeros(len(points) + 1, np.uint64)
    np.cumsum(mix(points.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return sums, down


def gram_hashes(points: np.ndarray, k: int) -> np.ndarray:
    """64-bit hash of every k consecutive code points."""
    out = [np.empty(0, np.uint64)]
    for a in range(0, len(points) - k + 1, BLOCK):
        part = points[a : a + BLOCK + k - 1]
        sums, down = _totals(part)
        out.append(mix((sums[k:] - sums[:-k]) * down[: len(part) - k + 1]))
    return np.concatenate(out)


def sliding_least(h: np.ndarray, w: int) -> np.ndarray:
    """The least of every w consecutive values."""
    n = len(h) - w + 1
    if n < 1:
        return np.empty(0, h.dtype)
    padded = np.full(-(-len(h) // w) * w, np.iinfo(h.dtype).max, h.dtype)
    padded[: len(h)] = h
    blocks = padded.reshape(-1, w)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    behind = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[:n], ahead[w - 1 : w - 1 + n])


def kept_grams(points: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions, hashes) of the kept stretches of least / 2 code points: every one that is the least of some window. In a stretch
    that two texts have in common, both keep the same ones."""
    k = least // 2
    w = least - k + 1
    at, kept = [np.empty(0, np.int64)], [np.empty(0, np.uint64)]
    for a in range(0, max(1, len(points) - least + 1), BLOCK):
        h = gram_hashes(points[a : a + BLOCK + least - 1], k)
        mine = _window_minima(h, w)
        at.append(mine + a)
        kept.append(h[mine])
    at, first = np.unique(np.concatenate(at), return_index=True)
    return at, np.concatenate(kept)[first]


def _window_minima(h: np.ndarray, w: int) -> np.ndarray:
    """Positions that are the least of some window of w that holds them: they equal the greatest of these windows' minima."""
    m = sliding_least(h, w)
    if not len(m):
        return np.empty(0, np.int64)
    tops = np.zeros(len(h) + w - 1, np.uint64)
    tops[w - 1 : w - 1 + len(m)] = m
    return np.flatnonzero(h == ~sliding_least(~tops, w))


def _chunks(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    bounds = _window_minima(gram_hashes(points, CHUNK_GRAM), CHUNK_WINDOW)
    if not len(bounds):
        return bounds, np.empty(0, np.uint64)
    sums, down = _totals(points)
    a, b = bounds[:-1], bounds[1:]
    return bounds, mix((sums[b] - sums[a]) * down[a] + (b - a).astype(np.uint64))


def chunks(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bounds, symbols): boundaries of the chunks, and a hash of each chunk between two of them. Boundaries lie where the hash of the
    next CHUNK_GRAM code points is the least of a window of CHUNK_WINDOW; none are more than that apart inside the text."""
    if len(points) <= BLOCK:
        return _chunks(points)
    margin, all_bounds, all_symbols = 2 * _EDGE, [], []
    for a in range(0, len(points), BLOCK):
        low = max(0, a - margin)
        bounds, symbols = _chunks(points[low : a + BLOCK + margin])
        bounds = bounds + low
        mine = (bounds >= a) & (bounds < a + BLOCK)
        all_bounds.append(bounds[mine])
        all_symbols.append(symbols[mine[:-1]])
    return np.concatenate(all_bounds), np.concatenate(all_symbols)[: sum(map(len, all_bounds)) - 1]


#: What a common stretch may lose at its ends before it consists of whole common chunks.
_EDGE = 2 * (CHUNK_GRAM + CHUNK_WINDOW)


def _joined(at: np.ndarray, least: int) -> list[tuple[int, int]]:
    """The union of the stretches of `least` that start at the sorted positions."""
    breaks = np.flatnonzero(np.diff(at) > least)
    first, last = np.concatenate(([0], breaks + 1)), np.concatenate((breaks, [len(at) - 1]))
    return [(int(at[i]), int(at[j]) + least) for i, j in zip(first, last, strict=True)]


class Stretches:
    """All stretches of `least` code points of a text, found by hash."""

    def __init__(self, points: np.ndarray, least: int):
        self.points, self.least = points, least
        self.hashes = gram_hashes(points, least)
        self.order = np.argsort(self.hashes, kind="stable")
        self.sorted = self.hashes[self.order]

    def among(self, other: Stretches) -> np.ndarray:
        """Which of its stretches have a hash of the other's, by position."""
        at = np.searchsorted(other.sorted, self.sorted)
        at[at == len(other.sorted)] = 0
        out = np.zeros(len(self.hashes), bool)
        if len(other.sorted):
            out[self.order] = other.sorted[at] == self.sorted
        return out

    def bytes_at(self, i: int) -> bytes:
        return self.points[i : i + self.least].tobytes()


def _enough(at: np.ndarray, least: int) -> list[int]:
    """Positions whose stretches cover those of all the sorted positions `at`: the first in every half of `least`, the last of every run."""
    firsts = np.flatnonzero(np.diff(at // (least // 2), prepend=-1))
    lasts = np.flatnonzero(np.diff(at, append=at[-1] + 2) > 1)
    return at[np.union1d(firsts, lasts)].tolist()


def shared_spans(a: Stretches, b: Stretches) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """The parts of a, and of b, covered by stretches that stand in both. Hashes propose, the code points decide."""
    at_b = np.flatnonzero(b.among(a))
    if not len(at_b):
        return [], []
    at_a = np.flatnonzero(a.among(b))
    some = _enough(at_b, a.least)
    partners = a.order[np.searchsorted(a.sorted, b.hashes[some])].tolist()
    if all(np.array_equal(a.points[j : j + a.least], b.points[i : i + a.least]) for i, j in zip(some, partners, strict=True)):
        return _joined(at_a, a.least), _joined(at_b, a.least)
    # two different stretches have one hash: decide by the stretches themselves
    have = {a.bytes_at(i) for i in at_a.tolist()} & {b.bytes_at(i) for i in at_b.tolist()}
    at_a = np.array([i for i in at_a.tolist() if a.bytes_at(i) in have], int)
    at_b = np.array([i for i in at_b.tolist() if b.bytes_at(i) in have], int)
    return (_joined(at_a, a.least), _joined(at_b, a.least)) if have else ([], [])


def _winnow(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            prints = [np.unique(kept_grams(code_points(t.as_py()), least)[1]).view(np.int64) for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([*b.columns[:3], pa.array(prints, pa.list_(pa.int64()))], ["id", "digest", "n_chars", "prints"])

    return run


def _segments(least: int):
    """The surroundings of a text's shared hashes, equal ones once with all their starts."""

    def rows(b: pa.RecordBatch, held: list[tuple]) -> pa.RecordBatch:
        columns = [pa.array([h[1] for h in held], pa.int64()), b.column(0).take(pa.array([h[0] for h in held], pa.int64()))]
        columns += [pa.array([h[2] for h in held], pa.int32()), pa.array([h[4] for h in held], pa.list_(pa.int64())), pa.array([h[3] for h in held], pa.string())]
        return pa.RecordBatch.from_arrays(columns, ["key", "class", "off", "starts", "text"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        side = least - least // 2
        for b in batches:
            held: list[tuple] = []
            for n, (value, prints) in enumerate(zip(b.column(1), b.column(2), strict=True)):
                text = value.as_py()
                at, hashes = kept_grams(code_points(text), least)
                hashes = hashes.view(np.int64)
                shared = np.isin(hashes, prints.values.to_numpy())
                found: dict[tuple, list[int]] = {}
                for p, h in zip(at[shared].tolist(), hashes[shared].tolist(), strict=True):
                    start = max(0, p - side)
                    found.setdefault((h, p - start, text[start : p + least]), []).append(start)
                held += [(n, *k, starts) for k, starts in found.items()]
                if len(held) > 2_000:
                    yield rows(b, held)
                    held = []
            yield rows(b, held)

    return run


class _Shard:
    """Segments of several hashes, in order of hash, and their automaton."""

    def __init__(self, least: int):
        self.least, self.automaton, self.ids, self.chars = least, SuffixAutomaton(), {}, 0
        self.rows: list[tuple] = []  # (key, segment, first class, last class)
        self.points: list[np.ndarray] = []
        self.read: list[tuple[np.ndarray, list[int]]] = []  # chunk boundaries and symbols
        self._stretches: dict[int, Stretches] = {}

    def add(self, key: int, segment: bytes, text: str, lo, hi) -> None:
        points = code_points(text)
        bounds, symbols = chunks(points)
        self.read.append((bounds, [self.ids.setdefault(s, len(self.ids)) for s in symbols.tolist()]))
        self.automaton.add(self.read[-1][1], len(self.rows))
        self.rows.append((key, segment, lo, hi))
        self.points.append(points)
        self.chars += len(points)

    def stretches(self, i: int) -> Stretches:
        if i not in self._stretches:
            if len(self._stretches) > 4 * HOT:  # segments of one hash stand together
                self._stretches.clear()
            self._stretches[i] = Stretches(self.points[i], self.least)
        return self._stretches[i]

    def candidates(self, i: int) -> set[int]:
        """Segments that hold, in whole chunks, what a stretch of `least` code points of segment i must have in common with them."""
        bounds, symbols = self.read[i]
        sa, found, need = self.automaton, set(), self.least - _EDGE
        # the fewest chunks ending at each chunk that make up `need` code points
        first = np.searchsorted(bounds, bounds[1:] - need, "right") - 1 if len(bounds) else bounds
        for at, ((v, n), start) in enumerate(zip(sa.matches(symbols), first.tolist(), strict=True)):
            if start >= 0 and n >= at + 1 - start:
                found |= sa.owners(sa.suffix_state(v, at + 1 - start))
        return found

    def pairs(self) -> Iterator[tuple[int, int, list, list]]:
        """Pairs of segments of one hash and of different texts, with the spans of each that stand in the other."""
        for i, (key, _, lo, hi) in enumerate(self.rows):
            for j in sorted(self.candidates(i)):
                other = self.rows[j]
                if j >= i or other[0] != key or (lo == hi == other[2] == other[3]):
                    continue
                theirs, ours = shared_spans(self.stretches(j), self.stretches(i))
                if theirs:
                    yield j, i, theirs, ours


def _value(x):
    """A class as it came, comparable."""
    return tuple(x.values())


def _shards(batches: Iterator[pa.RecordBatch], least: int, shard_chars: int) -> Iterator[_Shard]:
    """Rows come by key; the segments of one key are never divided."""
    shard = _Shard(least)
    for b in batches:
        for i in range(b.num_rows):
            key = b.column(0)[i].as_py()
            if shard.chars > shard_chars and key != shard.rows[-1][0]:
                yield shard
                shard = _Shard(least)
            shard.add(key, b.column(1)[i].as_py(), b.column(2)[i].as_py(), _value(b.column(3)[i].as_py()), _value(b.column(4)[i].as_py()))
    if shard.rows:
        yield shard


def _match(least: int, shard_chars: int):
    """Pairs of segments."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, least, shard_chars):
            found = [(shard.rows[j], shard.rows[i]) for j, i, _, _ in shard.pairs()]
            columns = [pa.array([a[0] for a, _ in found], pa.int64()), *(pa.array([x[n][1] for x in found], pa.binary()) for n in (0, 1))]
            yield pa.RecordBatch.from_arrays(columns, ["key", "seg_a", "seg_b"])

    return run


_SPAN = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_SPAN_SQL = "array<struct<start: bigint, end: bigint>>"


def _cover(least: int, shard_chars: int):
    """Per segment the spans that stand in another text, and those that stand in an earlier one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard in _shards(batches, least, shard_chars):
            other: dict[int, list] = {}
            earlier: dict[int, list] = {}
            for j, i, theirs, ours in shard.pairs():
                for x, y, spans in ((j, i, theirs), (i, j, ours)):
                    other.setdefault(x, []).extend(spans)
                    if shard.rows[y][2] < shard.rows[x][2]:
                        earlier.setdefault(x, []).extend(spans)
            seen = sorted(other)
            lists = [pa.array([[{"start": a, "end": b} for a, b in sorted(set(of.get(x, ())))] for x in seen], _SPAN) for of in (other, earlier)]
            yield pa.RecordBatch.from_arrays([pa.array([shard.rows[x][0] for x in seen], pa.int64()), pa.array([shard.rows[x][1] for x in seen], pa.binary()), *lists], ["key", "seg", "other", "earlier"])

    return run


def _halves(cells: DataFrame, least: int) -> DataFrame:
    """Rows (their stretches begin lo to hi code points after the hash) by halves of that range, under a hash of all that the stretches
    of a half have in common. A half whose common part isn't wholly in the text has no stretch."""
    mid = F.floor((F.col("lo") + F.col("hi")) / 2).cast("int")
    half = F.explode(F.array(F.struct(F.col("lo").alias("a"), mid.alias("b")), F.struct((mid + 1).alias("a"), F.col("hi").alias("b"))))
    out = cells.select("*", half.alias("half")).select("*", "half.a", "half.b").where("a <= b")
    core_from, core_to = F.col("off") + F.col("b"), F.col("off") + F.col("a") + least
    out = out.where((core_from >= 0) & (core_to <= F.length("text")))
    begin = F.greatest(F.col("off") + F.col("a"), F.lit(0))
    end = F.least(F.col("off") + F.col("b") + least, F.length("text"))
    core = F.substring(F.col("text"), core_from + 1, core_to - core_from)
    return out.select(
        F.xxhash64("key", "a", core).alias("key"), "class", (F.col("off") - begin).cast("int").alias("off"), "starts", (F.col("shift") + begin).alias("shift"),
        F.substring(F.col("text"), begin + 1, end - begin).alias("text"), F.col("a").alias("lo"), F.col("b").alias("hi"),
    )


# Joins of tables that grow with the corpus are hinted to merge: a broadcast of either side would only be right for small inputs.


def _parts(df: DataFrame, chars: int) -> int:
    return min(MOST_PARTS, max(df.sparkSession.sparkContext.defaultParallelism, chars // PART_CHARS))


def _cut(docs: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(members, cells, segments): members is digest, id, n_chars of each row of a text; cells is key, seg, class, starts, shift: the segments of each class
    (a struct of the least id with a text, and its digest), which begin `shift` after each of the starts; segments is key, seg, text, lo, hi, n: the different ones of each key, their first
    and last class, and how many the key has."""
    docs = docs.select(F.col(key).alias("id"), F.md5(F.col(text).cast("binary")).alias("digest"), F.length(text).alias("n_chars"), F.col(text).alias("text"))
    docs = docs.withColumn("digest", F.unhex("digest")).where(F.col("id").isNotNull() & (F.col("n_chars") >= least))
    kind = docs.schema["id"].dataType.simpleString()
    hashed = materialise(spread(docs, "id").mapInArrow(_winnow(least), f"id {kind}, digest binary, n_chars int, prints array<bigint>"), "winnowed")
    members = hashed.select("digest", "id", "n_chars").distinct()
    prints = hashed.select(F.explode("prints").alias("print"), "digest")
    short = F.xxhash64("digest")
    met = prints.groupBy("print").agg(F.min(short).alias("x"), F.max(short).alias("y")).where("x < y").select("print")
    shared = prints.join(met.hint("merge"), "print").groupBy("digest").agg(F.collect_set("print").alias("prints"))  # of one text: bounded by it
    lead = members.groupBy("digest").agg(F.min("id").alias("lead"), F.first("n_chars").alias("n_chars"))
    cands = materialise(shared.join(lead.hint("merge"), "digest"), "candidates")
    parts = _parts(docs, cands.agg(F.sum("n_chars")).first()[0] or 0)
    texts = docs.join(broadcastable(cands.select(F.col("lead").alias("id"), "digest")), ["id", "digest"]).select("digest", "text").dropDuplicates(["digest"])
    texts = texts.repartition(parts, "digest").join(cands.hint("merge").repartition(parts, "digest"), "digest")
    texts = texts.select(F.struct("lead", "digest").alias("class"), "text", "prints")
    cells = texts.mapInArrow(_segments(least), f"key bigint, class struct<lead: {kind}, digest: binary>, off int, starts array<bigint>, text string")
    cells = materialise(cells.withColumn("lo", F.lit(least // 2 - least)).withColumn("hi", F.lit(0)).withColumn("shift", F.lit(0)), "segments")
    done = None
    while True:
        sizes = cells.select("key", "hi", "lo", F.md5(F.col("text").cast("binary")).alias("s")).groupBy("key", "s").agg(F.max(F.col("hi") - F.col("lo")).alias("wide"))
        hot = materialise(sizes.groupBy("key").agg(F.count("*").alias("n"), F.max("wide").alias("wide")).where((F.col("n") > HOT) & (F.col("wide") > 0)).select("key"), "hot")
        cold = cells if hot.isEmpty() else cells.join(hot.hint("merge"), "key", "left_anti")
        done = cold if done is None else done.unionByName(cold)
        if hot.isEmpty():
            break
        cells = materialise(_halves(cells.join(hot.hint("merge"), "key"), least), "segments")
    cells = done.withColumn("seg", F.unhex(F.md5(F.col("text").cast("binary"))))
    each = cells.groupBy("key", "seg").agg(F.min("class").alias("lo"), F.max("class").alias("hi"), F.first("text").alias("text"))  # equal ones meet in the tasks first
    w = Window.partitionBy("key")  # of at most HOT rows
    each = each.withColumn("n", F.count("*").over(w)).withColumn("_lo", F.min("lo").over(w)).withColumn("_hi", F.max("hi").over(w)).where("_lo < _hi").drop("_lo", "_hi")
    return members, cells.select("key", "seg", "class", "starts", "shift"), materialise(each, "different-segments")


def _by_shard(segments: DataFrame) -> DataFrame:
    chars = segments.agg(F.sum(F.length("text"))).first()[0] or 0
    rows = segments.where("n > 1").select("key", "seg", "text", "lo", "hi")
    return rows.repartition(_parts(segments, chars), "key").sortWithinPartitions("key", "seg")


def shared_between(docs: DataFrame, key: str, text: str, least: int = LEAST, shard_chars: int = SHARD_CHARS) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members is digest, id, n_chars of every text of at least `least` code points; pairs is class_a, class_b: the digests of
    each two texts that have a stretch of so many code points in common, once.

    A class is a text (its 128-bit digest); texts of one class share everything. Shorter, empty and null texts can share nothing and
    are in no class. Null keys are ignored; a repeated key with the same text counts once. Other columns are not read.
    """
    members, cells, segments = _cut(docs, key, text, least)
    found = materialise(_by_shard(segments).mapInArrow(_match(least, shard_chars), "key bigint, seg_a binary, seg_b binary"), "matched")
    # the segments of one passage mostly stand in the same texts: pairs are made once for each different set of texts, not for each segment
    held = cells.join(segments.select("key", "seg").hint("merge"), ["key", "seg"]).select("key", "seg", F.col("class.digest").alias("digest")).distinct()
    held = materialise(held, "held")
    name = F.struct(F.bit_xor(F.xxhash64("digest")).alias("x"), F.bit_xor(F.xxhash64("digest", F.lit(1))).alias("y"), F.count("*").alias("n"))
    sets = materialise(held.groupBy("key", "seg").agg(name.alias("set")), "sets")
    texts = materialise(held.join(sets.hint("merge"), ["key", "seg"]).select("set", "digest").distinct(), "set-texts")
    named = lambda x: sets.select("key", F.col("seg").alias(f"seg_{x}"), F.col("set").alias(f"set_{x}")).hint("merge")
    across = found.join(named("a"), ["key", "seg_a"]).join(named("b"), ["key", "seg_b"]).select("set_a", "set_b")
    within = sets.where("set.n > 1").select(F.col("set").alias("set_a"), F.col("set").alias("set_b"))
    links = across.unionByName(within).distinct()
    pairs = links.join(texts.toDF("set_a", "x").hint("merge"), "set_a").join(texts.toDF("set_b", "y").hint("merge"), "set_b").where("x <> y")
    pairs = pairs.select(F.least("x", "y").alias("class_a"), F.greatest("x", "y").alias("class_b")).distinct()
    return members, materialise(pairs, "shared-pairs")


def _covered(docs: DataFrame, key: str, text: str, least: int, shard_chars: int) -> tuple[DataFrame, DataFrame]:
    """(members, spans): spans is digest, start, end, earlier: the parts of each text that stand in another one, and whether in one with a smaller id."""
    members, cells, segments = _cut(docs, key, text, least)
    found = _by_shard(segments).mapInArrow(_cover(least, shard_chars), f"key bigint, seg binary, other {_SPAN_SQL}, earlier {_SPAN_SQL}")
    found = materialise(found, "covered")
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.length("text").cast("bigint").alias("end")))
    own = segments.select("key", "seg", "lo", "hi", whole.alias("whole")).join(found, ["key", "seg"], "left")
    rows = cells.join(own, ["key", "seg"])
    none = F.array().cast(_SPAN_SQL)
    other = F.when(F.col("lo") < F.col("hi"), F.col("whole")).otherwise(F.coalesce("other", none))
    earlier = F.when(F.col("lo") < F.col("class"), F.col("whole")).otherwise(F.coalesce("earlier", none))
    tag = lambda spans, e: F.transform(spans, lambda s: F.named_struct(F.lit("start"), s["start"], F.lit("end"), s["end"], F.lit("earlier"), F.lit(e)))
    tagged = F.concat(tag(other, False), tag(earlier, True))
    spans = rows.select("class.*", F.explode("starts").alias("at"), "shift", tagged.alias("spans")).select("digest", (F.col("at") + F.col("shift")).alias("at"), F.inline("spans"))
    return members, spans.select("digest", (F.col("at") + F.col("start")).alias("start"), (F.col("at") + F.col("end")).alias("end"), "earlier").distinct()


def coverage(docs: DataFrame, key: str, text: str, least: int = LEAST, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """id, n_chars, n_shared, copies: per text with shared stretches, how many of its characters stand in other rows' texts too, and how
    many rows have just this text. Makes no pairs of texts. Nulls and repeats as above."""
    members, spans = _covered(docs, key, text, least, shard_chars)
    covered = merged(spans.where("NOT earlier"), "digest").groupBy("digest").agg(F.sum(F.col("end") - F.col("start")).alias("n_part"))
    copies = members.groupBy("digest").agg(F.count("*").alias("copies"))
    out = members.join(copies, "digest").join(covered, "digest", "left").where("n_part IS NOT NULL OR copies > 1")
    n = F.when(F.col("copies") > 1, F.col("n_chars").cast("bigint")).otherwise(F.col("n_part"))
    return out.select("id", "n_chars", n.alias("n_shared"), "copies")


def removed(docs: DataFrame, key: str, text: str, least: int = LEAST, shard_chars: int = SHARD_CHARS) -> DataFrame:
    """id, n_removed, text of every text that loses something: the maximal spans of stretches of `least` code points that stand in the text of a row with
    a smaller id are taken out, so the first text with a passage keeps it; a later copy of a whole text loses all. Nulls and repeats as above."""
    members, spans = _covered(docs, key, text, least, shard_chars)
    lead = members.groupBy("digest").agg(F.min("id").alias("lead"))
    cut = merged(spans.where("earlier"), "digest").groupBy("digest").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))  # of one text
    whole = F.array(F.struct(F.lit(0).cast("bigint").alias("start"), F.col("n_chars").cast("bigint").alias("end")))
    cut = members.join(lead, "digest").join(cut, "digest", "left").select("id", "digest", F.when(F.col("id") > F.col("lead"), whole).otherwise(F.col("spans")).alias("spans"))
    cut = broadcastable(materialise(cut.where("spans IS NOT NULL"), "spans-to-remove"))
    rows = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).withColumn("digest", F.unhex(F.md5(F.col("text").cast("binary"))))
    hit = rows.join(cut, ["id", "digest"])
    gone = F.aggregate("spans", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    return hit.select("id", gone.alias("n_removed"), without(F.col("text"), F.col("spans")).alias("text")).dropDuplicates(["id", "text"])
