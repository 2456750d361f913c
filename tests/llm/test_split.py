import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.split import split_bytes, split_oversized

PARTS = ["# Heading\n", "## Sub\n\n", "- item one\n", "  - nested item\n", "1. first\n", "```\ncode\n```\n", "word ", "sentence. ", "句子。", "字" * 40, "x" * 150, "\r\n", "\n\n", "| a | b |\n", "é" * 90, "---\ntitle: t\n---\n", "🙂" * 30]


def check(text, limit, least, most):
    data = text.encode()
    pieces, cut = split_bytes(data, limit, least, most)
    runs = re.split(rb"[ \t\r\n]|\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f", data)
    assert cut == ("forced" if max(map(len, runs)) > limit else "natural")
    assert pieces[0][0] == 0 and pieces[0][2] == 0 and pieces[-1][1] == len(data)
    before = 0
    for i, (a, b, overlap, _) in enumerate(pieces):
        assert b - a + overlap <= limit and b > a or len(data) == 0
        assert data[a - overlap : b].decode()  # whole characters
        if i:
            assert a == pieces[i - 1][1]
            assert least <= overlap <= most
            assert a - overlap >= before
        before = a - overlap
    return pieces


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(PARTS), min_size=1, max_size=60))
def test_pieces_rejoin_and_fit(parts):
    check("".join(parts), 400, 40, 80)


def test_natural_cuts_are_kept():
    text = "\n\n".join(f"## Part {i}\n\n" + f"Sentence {i} of some length. " * 30 for i in range(20))
    pieces = check(text, 5000, 200, 400)
    assert {p[3] for p in pieces[:-1]} <= {"heading", "block"}


def test_runs_without_boundary():
    for n in (4999, 5000, 5001, 20_000):
        pieces = check("Start here. " * 50 + "字" * (n // 3) + "z" * (n % 3) + " end. " * 50, 5000, 200, 400)
        assert any(p[3] == "forced" for p in pieces) == (n > 5000 - 204)


def test_deep_nesting_and_long_text():
    deep = "".join("  " * i + f"- level {i}\n" for i in range(400))
    check(deep * 3, 5000, 200, 400)
    check("a" * 300_000, 5000, 200, 400)


@pytest.mark.parametrize("part", ["```\ncode\n```\n", "# H\n", "- item\n", "```\n# no heading\n- no item\n\n```\n## H\n- item\n\n"])
def test_time_grows_with_size(part):
    data = (part * (10_000_000 // len(part))).encode()
    begun = time.monotonic()
    pieces, _ = split_bytes(data)
    assert pieces[-1][1] == len(data) and time.monotonic() - begun < 30


def test_rows(spark):
    rows = [(1, "x " * 3000, 9), (2, None, 9), (3, "", 9), (4, "small", 9), (5, "y" * 6000, 9), (None, "z " * 2600, 9), (1, "x " * 3000, 9)]
    df = spark.createDataFrame(rows, "id bigint, content string, piece int")
    out = split_oversized(df, "id", "content").collect()
    assert {(r.id, r.cut) for r in out} == {(1, "natural"), (5, "forced"), (None, "natural")}
    for key, text in ((5, "y" * 6000), (None, "z " * 2600)):
        mine = sorted((r for r in out if r.id == key), key=lambda r: r.piece)
        assert "".join(r.text.encode()[r.overlap :].decode() for r in mine) == text
        assert all(len(r.text.encode()) <= 5000 for r in mine)
    assert sum(r.id == 1 and r.piece == 0 for r in out) == 2
    assert split_oversized(df.limit(0), "id", "content").collect() == []
    assert re.match("id", split_oversized(df, "id", "content").columns[0])
