"""Near-duplicate texts by b-bit MinHash.

One pass over the texts turns each into its set of word shingles and that into K = BANDS * ROWS minima. Of every minimum
only the lowest B bits are retained, packed into 64-bit words; the bands' keys hash ROWS whole minima each. Texts with equal sets are one class, so a
group of copies costs one row. Candidates are classes that share a band: a band value that two classes have gives
its pair from count, least and greatest of one aggregation, without a join; only values of more classes are joined.
Candidates whose packed signatures, counted bit-parallel and corrected for chance agreement (2^-B), estimate a similarity
below threshold - SLACK (more than five standard deviations) are dropped; the rest is verified on the shingle sets.

With ROWS = 5 and BANDS = 100 a pair of similarity 0.6 is missed with probability (1 - 0.6^5)^100 = 0.0003, one of 0.65
with 0.000004; one of 0.05 is a candidate with probability 0.00003.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcastable, materialise, spread
from .words import WordHashes, mix, shingles

ROWS, BANDS, B, SLACK = 5, 100, 2, 0.15
_K = ROWS * BANDS
_PER_WORD = 64 // B
_WORDS = -(-_K // _PER_WORD)
_LOW = sum(1 << (i * B) for i in range(_PER_WORD))
EPS = 1e-9


def _seeds() -> tuple[np.ndarray, np.ndarray]:
    s = mix(np.arange(1, 2 * _K + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    return s[:_K].astype(np.uint32)[:, None], (s[_K:].astype(np.uint32) | np.uint32(1))[:, None]


def minima(h: np.ndarray, xors: np.ndarray, odds: np.ndarray, block: int = 2048) -> np.ndarray:
    """The K minima of the (32-bit folded) shingle hashes; long texts go through in blocks."""
    low = (h ^ (h >> np.uint64(32))).astype(np.uint32)
    out = np.full(_K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(low), block):
        x = low[None, i : i + block] ^ xors
        x *= odds
        np.minimum(out, x.min(axis=1), out=out)
    return out


def pack(m: np.ndarray) -> np.ndarray:
    """The lowest B bits of the minima, packed."""
    bits = np.zeros(_WORDS * _PER_WORD, np.uint64)
    bits[:_K] = mix(m.astype(np.uint64)) & np.uint64((1 << B) - 1)
    shifts = (np.arange(_PER_WORD, dtype=np.uint64) * np.uint64(B))[None, :]
    return np.bitwise_or.reduce(bits.reshape(_WORDS, _PER_WORD) << shifts, axis=1)


def _lists(rows: list[np.ndarray], width: int) -> pa.Array:
    flat = pa.array(np.concatenate(rows).view(np.int64))
    return pa.FixedSizeListArray.from_arrays(flat, width).cast(pa.list_(pa.int64()))


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hashes, (xors, odds) = WordHashes(), _seeds()
    weights = mix(np.arange(11, 11 + ROWS, dtype=np.uint64)) | np.uint64(1)
    salt = mix(np.arange(1001, 1001 + BANDS, dtype=np.uint64))
    for b in batches:
        ids, n, keys, checks, bands, sigs = [], [], [], [], [], []
        for key, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
            h = shingles(text.as_py() or "", hashes)
            if not len(h):
                continue
            m = minima(h, xors, odds)
            ids.append(key)
            n.append(len(h))
            keys.append(_class_key(h, 1))
            checks.append(_class_key(h, 2))
            bands.append(mix((m.reshape(BANDS, ROWS).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64) ^ salt))
            sigs.append(pack(m))
        if ids:
            k, k2 = (pa.array(np.array(x, np.uint64).view(np.int64)) for x in (keys, checks))
            columns = [pa.array(ids, b.column(0).type), pa.array(n, pa.int32()), k, k2, _lists(bands, BANDS), _lists(sigs, _WORDS)]
            yield pa.record_batch(columns, ["id", "n", "k", "k2", "bands", "sig"])


def _class_key(h: np.ndarray, salt: int) -> np.uint64:
    return mix(mix(h + np.uint64(salt)).sum(dtype=np.uint64, keepdims=True))[0]


def _shingle_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """k, sh: the sorted shingle hashes of the texts whose set has the second hash k2."""
    hashes = WordHashes()
    for b in batches:
        sets = [shingles(t.as_py() or "", hashes) for t in b.column(2)]
        own = [len(h) > 0 and int(_class_key(h, 2).view(np.int64)) == k2 for h, k2 in zip(sets, b.column(1).to_pylist(), strict=True)]
        out = pa.record_batch([b.column(0), pa.array([h.view(np.int64) for h in sets], pa.list_(pa.int64()))], ["k", "sh"])
        yield out.filter(pa.array(own, pa.bool_()))


def told_apart(signed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(signed, classes): the rows with a k of its own for each (k, k2), and per k its least id, its rows and its k2."""
    classes = lambda df: materialise(df.groupBy("k").agg(F.min("id").alias("id"), F.count("*").alias("copies"), F.min("k2").alias("k2"), F.max("k2").alias("_k2")), "classes")
    per_class = classes(signed)
    clashes = per_class.where("k2 <> _k2").select("k", F.lit(True).alias("clash"))
    if not clashes.isEmpty():  # a few in 10^10 sets
        renamed = F.when(F.col("clash"), F.xxhash64("k", "k2")).otherwise(F.col("k"))
        signed = materialise(signed.join(clashes, "k", "left").withColumn("k", renamed).drop("clash"), "signatures")
        per_class = classes(signed)
    return signed, per_class.drop("_k2")


def _verified(docs: DataFrame, signed: DataFrame, per_class: DataFrame, pairs: DataFrame, threshold: float) -> DataFrame:
    """The candidates (k_a, k_b) that are similar: by signature first, then by shingle sets."""
    pairs = materialise(pairs.distinct(), "candidates")
    sigs = signed.select("k", *[F.col("sig")[i].alias(f"s{i}") for i in range(_WORDS)])
    wanted = pairs.select(F.explode(F.array("k_a", "k_b")).alias("k")).distinct()
    wanted = broadcastable(materialise(wanted, "candidate-keys"))
    sigs = materialise(sigs.join(wanted, "k").dropDuplicates(["k"]), "candidate-signatures")
    side = lambda x: sigs.select(F.col("k").alias(f"k_{x}"), *[F.col(f"s{i}").alias(f"{x}{i}") for i in range(_WORDS)])
    unlike = F.lit(0)
    for i in range(_WORDS):
        x = F.col(f"a{i}").bitwiseXOR(F.col(f"b{i}"))
        folded = x
        for j in range(1, B):
            folded = folded.bitwiseOR(F.shiftrightunsigned(x, j))
        unlike = unlike + F.bit_count(folded.bitwiseAND(F.lit(_LOW)))
    chance = 2.0**-B
    estimate = ((1 - unlike / _K) - chance) / (1 - chance)
    # the estimate's standard deviation is at most 0.03, so a pair at the threshold falls below this with a probability under 10^-6
    near = pairs.join(side("a"), "k_a").join(side("b"), "k_b").where(estimate >= threshold - SLACK).select("k_a", "k_b")
    near = materialise(near, "near")

    keys = near.select(F.explode(F.array("k_a", "k_b")).alias("k")).distinct()
    keys = broadcastable(materialise(keys.join(per_class.select("k", "k2", "id"), "k"), "near-keys"))
    texts = docs.join(keys, "id").select("k", "k2", "text")
    sets = materialise(texts.mapInArrow(_shingle_sets, "k bigint, sh array<bigint>").dropDuplicates(["k"]), "near-sets")
    common = F.size(F.array_intersect("sh_a", "sh_b"))
    return (
        near.join(sets.toDF("k_a", "sh_a"), "k_a")
        .join(sets.toDF("k_b", "sh_b"), "k_b")
        .withColumn("common", common)
        .withColumn("similarity", F.col("common") / (F.size("sh_a") + F.size("sh_b") - F.col("common")))
        .where(F.col("similarity") >= threshold - EPS)
        .select("k_a", "k_b", "similarity")
    )


def similar_texts(docs: DataFrame, key: str, text: str, threshold: float, connected: bool = False) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members is k, id, n (shingles); pairs is k_a, k_b (k_a < k_b), similarity, all exact.

    With `connected` the pairs need only connect what is similar, directly or through others: of the classes that share a band each is compared with the
    least one, and only those unlike it with all others; so a band that very many versions of one text share costs one comparison each.

    k numbers a class of texts with equal shingle sets, told apart by 128 bits (two hashes of the set; where two sets have one k, both get
    another). Texts of fewer than three words, empty and
    null ones have no shingles and are in no class. Rows with a null key are ignored; a repeated key with the same text
    counts once. Further columns are not read.
    """
    docs = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).where(F.col("id").isNotNull() & F.col("text").isNotNull())
    kind = docs.schema["id"].dataType.simpleString()
    signed = spread(docs, "id").mapInArrow(_sign, f"id {kind}, n int, k bigint, k2 bigint, bands array<bigint>, sig array<bigint>")
    signed = materialise(signed, "signatures")
    signed, per_class = told_apart(signed)
    members = signed.select("k", "id", "n").distinct()
    # Of a class of several rows only the representative's row is banded.
    copied = broadcastable(materialise(per_class.where("copies > 1").select("k", F.col("id").alias("rep")), "copied"))
    reps = signed.join(copied, "k", "left").where(F.col("rep").isNull() | (F.col("id") == F.col("rep")))
    banded = reps.select(F.explode("bands").alias("band"), "k")
    met = banded.groupBy("band").agg(F.min("k").alias("k_a"), F.max("k").alias("k_b"), F.count("*").alias("classes")).where("k_a < k_b")
    met = materialise(met, "bands-met")
    twos = met.where("classes = 2").select("k_a", "k_b")
    many = banded.join(broadcastable(met.where("classes > 2").select("band")), "band")
    many = materialise(many, "bands-many")
    if not connected:
        more = many.toDF("band", "k_a").join(many.toDF("band", "k_b"), "band").where("k_a < k_b").select("k_a", "k_b")
        return members, _verified(docs, signed, per_class, twos.unionByName(more), threshold)
    least = met.where("classes > 2").select("band", "k_a")
    star = many.join(least, "band").where("k <> k_a").select("band", "k_a", F.col("k").alias("k_b"))
    first = twos.unionByName(star.select("k_a", "k_b"))
    along = materialise(_verified(docs, signed, per_class, first, threshold), "along-stars")
    unlike = materialise(star.join(along.select("k_a", "k_b"), ["k_a", "k_b"], "left_anti").select("band", F.col("k_b").alias("x")), "unlike")
    rest = unlike.join(many, "band").where("x <> k").select(F.least("x", "k").alias("k_a"), F.greatest("x", "k").alias("k_b"))
    rest = rest.join(first, ["k_a", "k_b"], "left_anti")
    return members, along.unionByName(_verified(docs, signed, per_class, rest, threshold))
