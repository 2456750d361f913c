import hashlib
from datetime import UTC, datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.functions import frontmatter as fm
from lorekeep.functions import notes as nt
from lorekeep.functions import text as tx


def one(spark, expression, **columns):
    row = spark.createDataFrame([tuple(columns.values())], ", ".join(f"{c} {'int' if isinstance(v, int) else 'string'}" for c, v in columns.items()))
    return row.select(expression.alias("x")).first().x


def test_header_forms():
    h = fm.parse_header('title: "A: b"\nempty: ""\nlist:\n  - "x"\n- y\ninline: [a, "b"]\n  - stray\nnone: []\nplain: a, b\nlist2: [] # note\ntitle: last')
    assert h == {"title": "last", "empty": "", "list": ["x", "y"], "inline": '[a, "b"]', "none": [], "plain": "a, b", "list2": "[] # note"}
    assert fm.as_list(h["inline"]) == ["a", "b"] and fm.as_list("a, b") == ["a", " b"] and fm.as_list("") is None and fm.as_list("[] # note") == ["[] # note"]


def test_epoch_and_authority():
    assert fm.epoch("1970-01-02") == 86400 and fm.epoch("1970-01-01T01:00:00+01:00") == 0 and fm.epoch("1970-01-01T00:00:05Z") == 5
    assert fm.epoch("1970-13-02") == fm.epoch("soon") == 0
    assert [fm.authority_of(x) for x in ("5", "0", "6", "x", None, ["4"])] == [5, 3, 3, 3, 3, 3]


def test_header_of_pages(spark):
    text = "---\ntitle: T\ntype: concept\nsources:\n  - raw/a.md\ntags: x, y\n---\n\nBody [[One]] and [[Two|2]]\n"
    rows = [("a", text), ("b", text.replace("\n", "\r\n")), ("c", "# Hello\n\nPlain text."), ("d", None), ("e", "")]
    df = spark.createDataFrame(rows, "id string, content string").select("id", fm.header_fields(fm.header_of(F.col("content"))).alias("h"), fm.wikilinks(fm.body_of(F.col("content"))).alias("w"), fm.body_of(F.col("content")).alias("b"))
    got = {r.id: r for r in df.collect()}
    assert (got["a"].h.title, got["a"].h.kind, got["a"].h.sources, got["a"].h.tags) == ("T", "concept", ["raw/a.md"], ["x", " y"])
    assert got["a"].w == ["One", "Two|2"] and got["a"].b == "Body [[One]] and [[Two|2]]"
    assert got["b"].h.title == "" and got["c"].b == "# Hello\n\nPlain text." and got["d"].h.authority == 3


def test_note_fields():
    n = fm.note_fields('---\ntitle: "A note"\ntags: [x, "y"]\nkey_claims:\n  - "one"\n  - two\'s\nother: z\n  - lost\n---\nbody')
    assert n == {"title": "A note", "description": "", "tags": ["x", "y"], "key_claims": ["one", "two's"]}
    assert fm.note_fields("no header")["title"] == "" and fm.note_fields("")["tags"] == []


@pytest.mark.parametrize(
    ("f", "value", "want"),
    [
        (tx.slug, "wiki/a/Big Page.md", "big-page"), (tx.reference_key, "\t x.md # see\n", "x.md"), (tx.reference_key, " a　", "a"), (tx.reference_key, None, None),
        (tx.normal_tag, " karpathy ", "Karpathy"), (tx.normal_tag, "OpenAI", "OpenAI"), (tx.normal_tag, "模型", "模型"), (tx.display_title, "wiki/x/big-red_page.md", "Big Red Page"),
        (tx.plain_title, "raw/a-b_c.md", "a b_c"), (tx.layer, "wiki/a.md", "wiki"), (tx.layer, "other/a.md", "raw"), (tx.layer, "wiki", "raw"), (tx.topic_slug, "  Große Frage: 模型?!", "große-frage-模型"),
        (tx.topic_slug, "x" * 100, "x" * 80), (tx.import_slug, " Ab-É 字! ", "ab-字"), (tx.safe_id, "a b/c_d", "a-b-c_d"), (tx.normal_url, "[x](https://A.b/C/) ", "https://a.b/c"),
        (tx.normal_url, "http://A//", "http://a"), (tx.normal_text, "  A  b\n", "a b"), (tx.clean_cell, "a\tb\r\nc ", "a b  c"), (tx.clean_cell, None, ""), (tx.without_fences, "```md\nhi\n```", "hi"),
        (tx.without_fences, "```md\nhi", "```md\nhi"), (lambda c: tx.note_title(c, F.lit("f")), "---\ntitle: 'T'\n", "T"), (lambda c: tx.note_title(c, F.lit("f")), "x", "f"),
    ],
)
def test_strings(spark, f, value, want):
    assert one(spark, f(F.col("v")), v=value) == want


def test_tags_and_entities(spark):
    bad = ["x", "y" * 21, "技术", "nbsp", "Nbsp", "https://a", "[x", "wiki]"]
    rows = spark.createDataFrame([(t,) for t in [*bad, "Good", "模型"]], "t string")
    assert {r.t for r in rows.where(~tx.noisy_tag(F.col("t"))).collect()} == {"Good", "模型"}
    assert one(spark, tx.entity_names(F.col("v")), v="【甲|产品】x【b c|概念】【none】") == ["甲", "b c"]


def test_counts_and_hashes(spark):
    assert one(spark, tx.topic_id(F.col("v")), v="u/topic/42/x") == 42 and one(spark, tx.topic_id(F.col("v")), v="u") == 0
    assert one(spark, tx.content_hash(F.col("v")), v="é") == hashlib.sha256("é".encode()).hexdigest()[:16]
    assert one(spark, tx.source_count(F.col("v")), v="---\nsource_count: 3\n---\n") == 3
    assert one(spark, tx.with_source_count(F.col("v"), F.lit(2)), v="---\nsource_count: 3\n---\nb") == "---\nsource_count: 5\n---\nb"
    assert one(spark, tx.with_source_count(F.col("v"), F.lit(2)), v="---\na: b\n---\nb") == "---\nsource_count: 2\na: b\n---\nb"
    h = tx.note_hash(F.col("t"), F.col("d"), F.col("p"), F.array(F.lit("x")), F.array(F.lit("c")))
    assert one(spark, h, t="T", d=None, p="P") == hashlib.sha256(b"T\0\0P\0x\0claim:c\0").hexdigest()


@pytest.mark.parametrize("text", ["a" * 5000, "a" * 5001, "a" * 4999 + "é", "字" * 2000, "a" + "字" * 2000, "aa" + "字" * 2000, "🙂" * 1300, "a🙂" * 1100, ""])
def test_truncation(spark, text):
    want = text.encode()[:5000].decode("utf-8", "ignore")
    assert one(spark, tx.truncated(F.col("v")), v=text) == want


def test_catalogue(spark):
    assert one(spark, tx.technical_catalogue(F.col("v")), v="\n".join(["M01 x"] * 5 + ["y"] * 45))
    assert one(spark, tx.technical_catalogue(F.col("v")), v="\n".join(["  | a |"] * 15 + ["y"] * 35))
    assert one(spark, tx.technical_catalogue(F.col("v")), v="\n".join(["DIM_x"] * 10 + ["y"] * 40))
    assert not one(spark, tx.technical_catalogue(F.col("v")), v="\n".join(["M01 x"] * 49))


def test_jaccard(spark):
    a, b = tx.token_set(F.col("a")), tx.token_set(F.col("b"))
    assert one(spark, tx.jaccard(a, b), a="The cat a sat", b="the CAT ran") == pytest.approx(2 / 4)
    assert one(spark, tx.jaccard(a, b), a="", b="x y") == 0 and one(spark, tx.jaccard(a, b), a=None, b="xx") == 0


def test_sources_and_provenance():
    for head in ("sources: [a, b]\n", "sources:\n  - a\n  - b\n", ""):
        assert nt.set_sources(f"---\ntitle: T\n{head}---\nbody", ["raw/x.md"]) == "---\ntitle: T\nsources:\n  - raw/x.md\n---\nbody"
    assert nt.set_sources("no header", ["x"]) == "no header"
    raw = '---\nsource_url: "https://x.y"\nauthor: Ann\n---\ntext of 2020-01-01'
    note = "resource: https://made.up\n## Source\n- **Author**: Bob\n- Published: 2020-01-01\n- Imported: never\n## Next\n- Author: Bob"
    got = nt.ground(note, raw, datetime(2026, 6, 20, tzinfo=UTC)).split("\n")
    assert got == ['resource: "https://x.y"', "## Source", "- Author: Ann", "- Published: 2020-01-01", "- Imported: 2026-06-20", "## Next", "- Author: Bob"]
    assert nt.ground("resource: https://made.up\n## Source\n- Author: Bob", "plain", datetime(2026, 6, 20, tzinfo=UTC)) == f'resource: ""\n## Source\n- Author: {nt.NOT_GIVEN}'
    assert nt.ground("resource: in.text", "see in.text", datetime(2026, 6, 20, tzinfo=UTC)) == "resource: in.text"


def test_light_note(spark):
    text = "intro\n**Bold one**\n# Heading\n![a](data:image/png;base64," + "A" * 30 + ")![b](media/x.png)end"
    note = one(spark, nt.light_note(F.col("p"), F.col("c"), "2026-01-01T00:00:00Z"), p="raw/a.md", c=text)
    assert 'title: "Bold one"' in note and "  - raw/a.md\n" in note and "(an image stood here)end" in note and note.endswith("\n")
    assert one(spark, nt.light_title(F.col("p"), F.col("c")), p="raw/a-b.md", c="nothing") == "a-b"
    assert 'title: "say \\"x\\" \\\\"' in one(spark, nt.light_note(F.col("p"), F.col("c"), "s"), p="raw/a.md", c='# say "x" \\')


def test_prompts_and_addresses():
    assert nt.endpoint("http://h/v1/", "/v1/chat") == "http://h/v1/chat" and nt.endpoint("http://h", "v1/chat") == "http://h/v1/chat"
    assert nt.unfenced("```json\n[1]\n```") == "[1]" and nt.unfenced(" x ") == "x"
    assert nt.system_prompt("Base\n", {"b": "B", "a": " "}) == "Base\n\n## b\n\nB" and nt.related_context([]) == ""
    assert "[T](p): d" in nt.related_context([("p", "T", "d")])
