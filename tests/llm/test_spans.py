import random
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm import spans
from lorekeep.llm.spans import Stretches, chunks, code_points, coverage, gram_hashes, kept_grams, removed, shared_between, shared_spans, sliding_least


def brute(rows, least):
    at = defaultdict(set)
    texts = {k: t for k, t, *_ in rows if k is not None and t}
    for k, t in texts.items():
        for i in range(len(t) - least + 1):
            at[t[i : i + least]].add(k)
    pairs = {(a, b) for ks in at.values() for a in ks for b in ks if a < b}
    cover = {}
    for k, t in texts.items():
        mask = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if len(at[t[i : i + least]]) > 1:
                mask[i : i + least] = b"\1" * least
        if any(mask):
            cover[k] = sum(mask)
    return pairs, cover


def brute_removed(rows, least):
    first = {}
    texts = {k: t for k, t, *_ in rows if k is not None and t}
    for k in sorted(texts):
        for i in range(len(texts[k]) - least + 1):
            first.setdefault(texts[k][i : i + least], k)
    out = {}
    for k, t in texts.items():
        mask = bytearray(len(t))
        for i in range(len(t) - least + 1):
            if first[t[i : i + least]] < k:
                mask[i : i + least] = b"\1" * least
        if any(mask):
            out[k] = (sum(mask), "".join(c for c, m in zip(t, mask, strict=True) if not m))
    return out


def rows_with_shared_parts():
    rng = random.Random(11)
    text = lambda n: "".join(rng.choices("abcdefg 字句\n🙂é", k=n))
    shared = [text(n) for n in (399, 400, 401, 700, 1500)]
    rows = []
    for i in range(60):
        parts = [text(rng.randrange(0, 600))]
        for _ in range(rng.randrange(3)):
            s = rng.choice(shared)
            a = rng.randrange(0, 60)
            parts += [s[a:] if rng.random() < 0.4 else s, text(rng.randrange(0, 300))]
        rows.append((i, "".join(parts), "x"))
    rows += [(100 + i, rows[0][1] + "tail" * 120, "x") for i in range(10)]
    rows += [(200, "a" * 3000, "x"), (201, "b" + "a" * 900, "x"), (202, "ab" * 1000, "x"), (203, "ba" * 500, "x"), (204, "Ab" * 1000, "x")]
    return rows + [(300, None, "x"), (301, "", "x"), (302, "short", "x"), (None, rows[0][1], "x"), (0, rows[0][1], "x")]


@pytest.mark.parametrize(("shard_chars", "hot"), [(1_000_000, 1_000), (5_000, 32), (5_000, 2)])
def test_pairs_and_coverage(spark, monkeypatch, shard_chars, hot):
    monkeypatch.setattr(spans, "HOT", hot)
    rows = rows_with_shared_parts()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, class string")
    pairs, cover = brute(rows, 400)
    members, found = shared_between(df, "doc_id", "text", 400, shard_chars)
    names = defaultdict(set)
    for r in members.collect():
        names[bytes(r["digest"])].add(r.id)
    got = {(a, b) for g in names.values() for a in g for b in g if a < b}
    listed = [(bytes(r.class_a), bytes(r.class_b)) for r in found.collect()]
    assert len(set(listed)) == len(listed)
    for a, b in listed:
        got |= {(min(x, y), max(x, y)) for x in names[a] for y in names[b]}
    assert got == pairs
    assert {r.id: r.n_shared for r in coverage(df, "doc_id", "text", 400, shard_chars).collect()} == cover
    assert {r.id: (r.n_removed, r.text) for r in removed(df, "doc_id", "text", 400, shard_chars).collect()} == brute_removed(rows, 400)


def test_empty(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string, class string")
    members, found = shared_between(df, "doc_id", "text")
    assert members.count() == found.count() == 0
    assert coverage(df, "doc_id", "text").count() == removed(df, "doc_id", "text").count() == 0


def test_a_passage_in_very_many_texts(spark, monkeypatch):
    """However many texts hold it, the rows written per text don't grow."""
    rng = random.Random(5)
    text = lambda n: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=n))
    passage, written = text(900), []
    real = spans.materialise
    monkeypatch.setattr(spans, "materialise", lambda df, label: (out := real(df, label), written.append((label, out.count())) if label != "hot" else None)[0])
    sizes = {}
    for n in (500, 2000):
        written.clear()
        df = spark.createDataFrame([(i, text(450) + passage + text(450)) for i in range(n)], "doc_id bigint, text string")
        got = coverage(df, "doc_id", "text")
        assert got.count() == n and got.where("n_shared NOT BETWEEN 900 AND 912").isEmpty()
        sizes[n] = sum(rows for _, rows in written), sum(rows for label, rows in written if label == "different-segments")
    assert sizes[2000][0] < 5 * sizes[500][0] and sizes[2000][1] < 6 * sizes[500][1]  # chance gives neighbours the same letter


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 8))
def test_sliding_and_grams(values, w):
    v = np.array(values, np.uint64)
    assert sliding_least(v, w).tolist() == [min(values[i : i + w]) for i in range(len(values) - w + 1)]
    h = gram_hashes(np.array(values, np.uint32), w).tolist()
    grams = [tuple(values[i : i + w]) for i in range(len(values) - w + 1)]
    assert len(h) == len(grams) and len(set(zip(h, grams, strict=True))) == len(set(h)) == len(set(grams))


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(4)
    points = code_points("".join(rng.choices("abcd", k=5000)) + "z" * 2000)
    whole = chunks(points), gram_hashes(points, 200), [x.tolist() for x in kept_grams(points, 400)]
    monkeypatch.setattr(spans, "BLOCK", 700)
    again = chunks(points), gram_hashes(points, 200), [x.tolist() for x in kept_grams(points, 400)]
    assert np.array_equal(whole[0][0], again[0][0]) and np.array_equal(whole[0][1], again[0][1])
    assert np.array_equal(whole[1], again[1]) and whole[2] == again[2]


def test_equal_hashes_are_decided_by_the_text(monkeypatch):
    monkeypatch.setattr(spans, "gram_hashes", lambda p, k: np.zeros(max(0, len(p) - k + 1), np.uint64))
    a, b = Stretches(code_points("xxabcdexx"), 5), Stretches(code_points("yabcdez"), 5)
    assert shared_spans(a, b) == ([(2, 7)], [(1, 6)])
    assert shared_spans(a, Stretches(code_points("0123456"), 5)) == ([], [])
