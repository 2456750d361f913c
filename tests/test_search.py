import math
import random

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import context, graph, postings, search

COLUMNS = "id string, path string, layer string, kind string, title string, description string, content string, authority int, doc_timestamp bigint"


def page(id_, title, kind, body, authority=3, stamp=0, description=""):
    return (id_, id_, id_.split("/")[0], kind, title, description, body, authority, stamp)


PAGES = [
    page("raw/go-intro.md", "Go Introduction", "source-note", "Go is a programming language."),
    page("raw/python-intro.md", "Python Introduction", "source-note", "Python is a programming language."),
    page("wiki/concepts/go.md", "Go Language", "concept", "Go is fast and compiled. aaaa banana"),
    page("wiki/concepts/nul.md", None, None, None),
    page("wiki/source-notes/py.md", "Éclair", "source-note", "PYTHON éclair Programming programming", 5, 1_700_000_000),
]


@pytest.fixture(scope="module")
def pages(spark):
    return spark.createDataFrame(PAGES, COLUMNS)


def bm25(keywords):
    docs = [[(x or "").lower() for x in (p[0], p[4], p[6], p[3], p[2])] for p in PAGES]
    length = [sum(max(0, len(c) - 2) for c in d) for d in docs]
    average = sum(length) / len(docs)
    count = lambda d, k: sum(c.startswith(k, i) for c in d for i in range(len(c)))
    out = {}
    for p, d, n in zip(PAGES, docs, length, strict=True):
        rank = 0.0
        for k in keywords:
            holds = sum(count(x, k) > 0 for x in docs)
            idf = math.log((len(docs) - holds + 0.5) / (holds + 0.5))
            idf = idf if idf > 0 else 1e-6
            f = count(d, k)
            rank -= idf * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * n / average))
        if any(count(d, k) for k in keywords):
            out[p[0]] = rank
    return out


@pytest.mark.parametrize("query", ["programming", "python, language", "aaa", "éclair", "ana fast", "concept"])
def test_rank_equals_formula(pages, query):
    hits = search.find_hits(pages, query)
    got = {r.id: r["rank"] for r in hits.rows.collect()}
    assert got == pytest.approx(bm25(hits.keywords))


def test_keywords():
    assert search.split_keywords(" Go, Python，机器  x ") == ["Go", "Python", "机器", "x"]
    assert search.split_keywords(" ,， ") == []


def test_searches(pages):
    ids = lambda q, **k: [r.id for r in search.search(pages, q, **k).orderBy("position").collect()]
    assert len(ids("programming")) == 3
    assert set(ids("Go", layer="wiki")) == {"wiki/concepts/go.md"}
    assert ids("zebra") == [] and search.search(pages, "  ") is None
    assert len(ids("Go, Python")) >= 2 and len(ids("programming", limit=1)) == 1


def test_phases(pages):
    rows = {r.id: r for r in search.search(pages, "python programming is").collect()}
    assert rows["raw/python-intro.md"].match_phase == 0 and rows["raw/python-intro.md"].coverage == 3
    assert rows["raw/go-intro.md"].match_phase == 1 and rows["wiki/concepts/go.md"].match_phase == 2
    assert rows["wiki/concepts/go.md"].fts_rank == 0 and rows["wiki/concepts/go.md"].snippet == ""


def test_sorting_keys(spark):
    base = dict(path="", layer="wiki", kind="", title="t", description="", authority=3, doc_timestamp=0, snippet="", long_hits=1)
    rows = [dict(base, id="a", wiki_priority=0.0, rank=-9.0), dict(base, id="b", wiki_priority=1.0, rank=-1.0), dict(base, id="c", wiki_priority=1.0, rank=-2.0), dict(base, id="d", wiki_priority=1.0, rank=-1.0, title="kwd")]
    hits = search.Hits(spark.createDataFrame(rows), ["kwd"], ["kwd"], [])
    assert [r.id for r in search.phases(hits, None, None, 10).orderBy("position").collect()] == ["d", "c", "b", "a"]


def test_snippet(spark):
    df = spark.createDataFrame([("the big Go language and more go",), ("go",), ("none",)], "c string")
    assert [r.s for r in df.select(search.snippet(F.col("c"), ["go"]).alias("s")).collect()] == ["...[Go] language ...", "[go]", ""]
    assert [r.s for r in df.select(search.snippet(F.col("c"), ["big"]).alias("s")).collect()] == ["...[big] Go langu...", "", ""]


def test_fusion_and_layers(spark, pages):
    hits = search.find_hits(pages, "programming")
    fused = {r.id: r for r in search.search_kinds(hits, None, None, 10).collect()}
    assert fused["wiki/source-notes/py.md"].lists == 2 and fused["raw/go-intro.md"].lists == 1
    assert fused["wiki/source-notes/py.md"].rrf == pytest.approx(1 / 61 + 1 / 61)
    # with a layer but no kind the wiki's lists run too; a strict layer keeps them out
    assert "wiki/source-notes/py.md" in {r.id for r in search.search_kinds(hits, "raw", None, 10).collect()}
    assert {r.layer for r in search.search_kinds(hits, "raw", None, 10, strict_layer=True).collect()} == {"raw"}


def test_layered_scores(spark, pages):
    links = spark.createDataFrame([("x", "wiki/source-notes/py.md", "cites", 1.0)] * 3, "source_doc_id string, target_doc_id string, relation string, confidence double")
    as_of = 1_700_000_000 + 100 * 86400
    got = {r.id: r for r in search.layered(pages, links, "programming", as_of).collect()}
    top = got["wiki/source-notes/py.md"]
    assert top.score == pytest.approx(1 / 61 + 2 * 0.005 + 0.3 * 0.01 + 0.012 * math.exp(-0.00126 * 100)) and top.place == 1
    pools = search.layered(pages, links, "Go programming fast", as_of, sources=1, synths=1)
    assert sorted(r.pool for r in pools.collect()) == ["note", "synth"]
    assert search.pools_for(10) == (10, 3) and search.pools_for(1) == (1, 1) and search.layered(pages, links, "", 0) is None


def test_synthesized_factor(spark):
    df = spark.createDataFrame([(1, "concept", 3), (1, "source-note", 3)], "position int, kind string, authority int")
    s = [r.s for r in df.select(search.hybrid_score(F.col("position"), F.col("kind"), F.col("authority"), F.lit(0.0), F.lit(0), 0).alias("s")).collect()]
    assert s[0] / s[1] == pytest.approx(1.3)


@pytest.fixture(scope="module")
def graph_tables(spark):
    rows = [page("wiki/concepts/a.md", "A", "concept", ""), page("wiki/concepts/b.md", "B", "concept", ""), page("wiki/concepts/c.md", "C", "concept", ""), page("raw/x.md", "Raw X", "raw", "")]
    links = [("wiki/concepts/a.md", "raw/x.md", "cites"), ("wiki/concepts/a.md", "b", "wikilink"), ("wiki/concepts/b.md", "wiki/concepts/a.md", "contradicts"), ("wiki/concepts/c.md", "wiki/concepts/a.md", "supports"), (None, None, None)]
    return spark.createDataFrame(rows, COLUMNS), spark.createDataFrame(links, "source_doc_id string, target_doc_id string, relation string")


def seeds(spark, *ids):
    return spark.createDataFrame([(i,) for i in ids], "id string")


def test_link_graph(spark, graph_tables):
    pages, links = graph_tables
    boost = {r.doc_id: r.graph_boost for r in search.graph_boost(links).collect()}
    assert boost["wiki/concepts/a.md"] == pytest.approx(0.2) and None not in boost
    near = [r.id for r in graph.expand(seeds(spark, "wiki/concepts/a.md"), links, pages, 10).collect()]
    assert near == ["wiki/concepts/c.md", "raw/x.md"]
    assert [(r.source_id, r.relation) for r in graph.conflicts(links, seeds(spark, "wiki/concepts/a.md")).collect()] == [("wiki/concepts/b.md", "contradicts")]
    assert [r.id for r in graph.cited_sources(seeds(spark, "wiki/concepts/a.md"), links, pages).collect()] == ["raw/x.md"]
    assert [(r.seed, r.id) for r in graph.related(links, pages, 3, seeds(spark, "wiki/concepts/a.md")).collect()] == [("wiki/concepts/a.md", "wiki/concepts/c.md")]
    assert graph.expand(seeds(spark), links, pages, 10).count() == 0


def test_tag_graph(spark):
    pages = spark.createDataFrame([page(f"p/{x}", x.upper(), "concept", "") for x in "abcd"] + [page(f"pad/{i}", f"pad {i}", "concept", "") for i in range(96)], COLUMNS)
    tags = [("p/a", "RAG"), ("p/b", "RAG"), ("p/b", "LLM"), ("p/c", "LLM"), ("p/d", "Other"), ("p/a", None), (None, "RAG")] + [(f"pad/{i}", "everywhere") for i in range(96)] + [("p/a", "everywhere")]
    tags = spark.createDataFrame(tags, "doc_id string, tag string")
    ids = lambda *s, hops, limit=10: {r.id for r in graph.tag_expand(seeds(spark, *s), tags, pages, hops, limit).collect()}
    assert ids("p/a", hops=1) == {"p/b"} and ids("p/a", hops=2) == {"p/b", "p/c"} and ids(hops=1) == set() and len(ids("p/a", hops=2, limit=1)) == 1
    near = {(r.seed, r.id) for r in graph.tag_related(tags, pages, 1).collect()}
    assert near == {("p/a", "p/b"), ("p/b", "p/a"), ("p/c", "p/b")}


def test_merge(spark):
    schema = "seed string, id string, kind string, title string, place int"
    a = spark.createDataFrame([("s", "x", "k", "X", 1), ("s", "y", "k", "Y", 2)], schema)
    b = spark.createDataFrame([("s", "y", "k", "Y", 1), ("s", "z", "k", "Z", 2), ("s", "w", "k", "W", 3)], schema)
    assert [r.id for r in graph.merge_related([a, b], 3).orderBy("place").collect()] == ["x", "y", "z"]


def test_compression(spark):
    rows = [("a", "concept", "short", 0.5, 1), ("b", "note", "one two three four", 0.5, 2), ("c", "note", "one two three five", 0.4, 3), ("d", "note", "other words here", 0.3, 4), ("e", "note", "low", 0.001, 5), ("f", "note", None, 0.3, 6)]
    df = spark.createDataFrame(rows, "id string, kind string, description string, score double, position int")
    assert [r.id for r in context.compressed(df, 10).collect()] == ["b", "d", "f"]
    assert [r.id for r in context.compressed(df, 1).collect()] == ["b"]
    assert [r.id for r in context.compressed(df.where("id = 'e'"), 5).collect()] == ["e"]
    assert context.compressed(df.limit(0), 5).count() == 0


def test_bundle(spark, pages):
    links = spark.createDataFrame([("wiki/concepts/go.md", "raw/go-intro.md", "cites"), ("wiki/concepts/go.md", "wiki/source-notes/py.md", "contradicts")], "source_doc_id string, target_doc_id string, relation string")
    b = context.build(pages, links, "Go compiled")
    assert [r.id for r in b.pages.collect()][:1] == ["wiki/concepts/go.md"]
    assert [r.id for r in b.raw.collect()] == ["raw/go-intro.md"] and b.conflicts.count() == 1
    assert context.build(pages, links, " ").pages is None
    r = context.search_with_neighbours(pages, links, "compiled")
    assert r.pages.count() == 1 and [x.id for x in r.neighbours.collect()] == ["raw/go-intro.md"]


@pytest.fixture(scope="module")
def search_index(pages):
    return postings.SearchIndex(postings.postings_of(pages, search.INDEXED).persist(), pages.select("id", search.page_length().alias("length")))


@pytest.mark.parametrize("query", ["programming", "python, go", "go", "G", "é", "na anana", "_rogramming", "o_", "%", "nothing here", "aaa", "is a p", "wiki"])
def test_search_index_changes_nothing(pages, search_index, query):
    scanned, found = search.find_hits(pages, query), search.find_hits(pages, query, search_index)
    rows = lambda hits: sorted(map(str, hits.rows.collect()))
    assert rows(scanned) == rows(found)


def test_only_candidates_are_left(pages, search_index):
    ids = lambda *keywords: {r.id for r in postings.candidates(search_index.postings, list(keywords)).collect()}
    assert ids("banana") == {"wiki/concepts/go.md"} and ids("Éc") == {"wiki/source-notes/py.md"} and ids("zzz") == set()
    assert ids("compiled", "éclair") == {"wiki/concepts/go.md", "wiki/source-notes/py.md"}
    assert postings.postings_of(pages.limit(0), search.INDEXED).count() == 0


def test_postings_are_written_where_pages_are_read(pages):
    """A row for each gram of a segment, not for each page that holds it; no task has to take the rows of others."""
    found = postings.postings_of(pages.coalesce(1), search.INDEXED)
    grams = {(c.lower() + "\x00\x00")[i : i + 3] for p in PAGES for c in (p[0], p[4], p[6], p[3], p[2]) if c for i in range(len(c))}
    rows = found.collect()
    assert sorted(r.gram for r in rows) == ["", *sorted(grams)] and len({r.segment for r in rows}) == 1
    assert "Exchange" not in postings.sorted_postings(found)._jdf.queryExecution().executedPlan().toString()


def test_both_ways_to_a_segment():
    pick = random.Random(5)
    for letters in ("ab", "ab\x00é模😀", "".join(map(chr, range(97, 600)))):
        pages = [["".join(pick.choices(letters, k=pick.choice((0, 1, 2, 3, 50)))) for _ in range(3)] for _ in range(40)] + [["", "", ""]]
        for some in (pages, pages[:1], pages[-1:]):
            once, slow = postings._at_once(some), postings._one_by_one(some)
            assert [list(x) for x in once] == [list(x) for x in slow]
            for g, begin, end in zip(once[0], once[1][:-1], once[1][1:], strict=True):
                assert list(once[2][begin:end]) == [i for i, p in enumerate(some) if any(c[j : j + 3] == g for v in p for c in [v + "\x00\x00"] for j in range(len(v)))]


def test_many_segments_and_updates(spark, monkeypatch):
    """Segments by task; after an update they hold what a new index would."""
    monkeypatch.setattr(postings, "SMALL_PAGES", 2)
    text = lambda n: f"number {n} of words{n % 7}"
    made = lambda numbers: spark.createDataFrame([page(f"wiki/{n}.md", f"T{n}", "concept", text(n + shift)) for n, shift in numbers], COLUMNS)
    old = made([(n, 0) for n in range(60)]).repartitionByRange(4, "id")
    built = postings.postings_of(old, search.INDEXED).persist()
    ids = lambda index, *keywords: sorted(r.id for r in postings.candidates(index, list(keywords)).collect())
    assert built.select("segment").distinct().count() == 4
    assert ids(built, "words3", "T59") == sorted(f"wiki/{n}.md" for n in range(60) if n % 7 == 3 or n == 59)
    now = made([(n, 0) for n in range(60) if n != 3] + [(60, 0)]).where("id <> 'wiki/10.md'").unionByName(made([(10, 100)]))
    touched = spark.createDataFrame([("wiki/3.md",), ("wiki/10.md",), ("wiki/60.md",)], "id string")
    after = postings.updated(built, now, touched, search.INDEXED).persist()
    left = {r.segment for r in built.select("segment").distinct().collect()} & {r.segment for r in after.select("segment").distinct().collect()}
    assert 0 < len(left) < 4
    assert ids(after, "words3") == sorted(f"wiki/{n}.md" for n in range(61) if n % 7 == 3 and n not in (3, 10)) and ids(after, "words5") == sorted(["wiki/10.md", *(f"wiki/{n}.md" for n in range(61) if n % 7 == 5)])
    assert ids(after, "wiki") == sorted(f"wiki/{n}.md" for n in range(61) if n != 3) and ids(after, "3.m") == ["wiki/13.md", "wiki/23.md", "wiki/33.md", "wiki/43.md", "wiki/53.md"]


def test_wide_limits_are_kept_under_the_exchange(spark, pages):
    """The first rows of a list are taken in the tasks, whatever the limit."""
    spark.conf.unset("spark.sql.optimizer.windowGroupLimitThreshold")
    lists = search.ranked_lists(search.find_hits(pages, "programming go"), [search.Wanted("wiki", None, 5_000), search.Wanted(None, None, 20)])
    plan = lists._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit [list" in plan and plan.count("Partial") >= 2
    assert {r.list for r in lists.collect()} == {0, 1}
