import io
import json
import zipfile
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from lorekeep.operators import evaluate, index, orphans, queue, synthesis, wiki
from lorekeep.sources import connectors, kb_files
from lorekeep.streaming import watch

NOW = 1_000


def q(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, status string, retry_count int, last_error string, queued_at bigint, updated_at bigint")


def test_queue(spark):
    paths = spark.createDataFrame([("a.md",), ("b.md",), ("a.md",), (None,)], "path string")
    first = queue.enqueue(q(spark), paths, NOW)
    assert first.count() == 2 and queue.enqueue(first, paths, NOW).count() == 0
    rows = q(spark, ("a", "pending", 0, None, 5, 5), ("b", "pending", 3, None, 4, 4), ("c", "processing", 4, None, 1, 1), ("d", "failed", 5, "x", 0, 0))
    assert [r.path for r in queue.next_pending(rows, 1).collect()] == ["b"]
    started = queue.start(rows, queue.next_pending(rows, 1), NOW)
    assert {r.path: r.status for r in started.collect()}["b"] == "processing"
    errors = spark.createDataFrame([("b", "late"), ("c", "late")], "path string, error string")
    after = {r.path: r for r in queue.failed(rows, errors, NOW).collect()}
    assert (after["b"].status, after["b"].retry_count) == ("pending", 4) and (after["c"].status, after["c"].last_error, after["c"].updated_at) == ("failed", "late", NOW)
    assert {r.path: r.status for r in queue.recover_stale(rows, NOW).collect()}["c"] == "pending"
    assert {r.path for r in queue.done(rows, errors).collect()} == {"a", "d"}
    assert {r.path: r.available_at for r in queue.available_at(rows).collect()} == {"a": 5, "b": 4 + 40}
    assert [r.path for r in queue.ready(rows, 43, 9).collect()] == ["a"] and [r.path for r in queue.ready(rows, 44, 9).collect()] == ["b", "a"]
    assert {r.status: r.n for r in queue.stats(rows).collect()} == {"pending": 2, "processing": 1, "failed": 1}
    assert {r.status: r.n for r in queue.stats(q(spark)).collect()} == {"pending": 0, "processing": 0, "failed": 0}


def files(spark, **texts):
    return spark.createDataFrame([(k, v, 77) for k, v in texts.items()], "id string, content string, mtime bigint")


def test_index_runs(spark):
    doc = '---\ntitle: T\nsources:\n  - raw/s.md\nkey_claims:\n  - "【karpathy|人物】 and 【OpenAI|组织】 and 【技术|库】 and 【x|y】"\n---\nsee [[Other Page]] [[Other Page]]'
    empty = [spark.createDataFrame([], s) for s in ("id string, path string, layer string, kind string, title string, description string, content string, content_hash string, source_uri string, updated_at bigint, authority int, doc_timestamp bigint", "source_doc_id string, target_doc_id string, relation string, confidence double", "doc_id string, tag string, source string")]
    scanned = files(spark, **{"wiki/concepts/a-b.md": doc, "raw/plain.md": "text"})
    run = index.index_run(*empty, scanned, NOW)
    assert run["written"].count() == 2
    pages = {r.id: r for r in run["pages"].collect()}
    assert pages["raw/plain.md"].title == "plain" and pages["raw/plain.md"].doc_timestamp == 77 and pages["wiki/concepts/a-b.md"].layer == "wiki" and pages["raw/plain.md"].authority == 3
    assert Counter((r.target_doc_id, r.relation) for r in run["links"].collect()) == {("raw/s.md", "cites"): 1, ("other-page", "wikilink"): 2}
    assert {(r.tag, r.source) for r in run["tags"].collect()} == {("Karpathy", "claim"), ("OpenAI", "claim")}
    again = index.index_run(run["pages"], run["links"], run["tags"], scanned, NOW)
    assert again["written"].count() == 0 and again["links"].count() == 3
    assert index.index_run(run["pages"], run["links"], run["tags"], scanned, NOW, force=True)["written"].count() == 2
    gone = index.index_run(run["pages"], run["links"], run["tags"], scanned.where("id = 'raw/plain.md'"), NOW)
    assert [r.id for r in gone["purged"].collect()] == ["wiki/concepts/a-b.md"] and gone["links"].count() == gone["tags"].count() == 0
    assert index.migrated(spark.range(1), {"x": ("string", None)}).columns == ["id", "x"]
    for bad in ("", " ", "../x", "a/../b"):
        with pytest.raises(ValueError, match="file name"):
            index.valid_name(bad)


def test_orphans(spark):
    links = [(1, "a.md", "b.md#part", "cites", 100), (2, " a.md", "big-page", "wikilink", 100), (3, "a.md", "big-page", "cites", 100), (4, "a.md", "late.md", "cites", 100), (4, "a.md", "late.md", "cites", 100), (5, None, " ", None, None), (6, "A.md", "#x", "wikilink", 100), (7, "a.md", "b.md", "cites", None)] + [(100 + i, "a.md", "hub.md", "cites", 100) for i in range(600)]
    pages = [("a.md", 1), ("b.md", 100), ("w/Big Page.md", 50), ("w/big page.md", 500), ("late.md", 101), (None, 1), ("a.md", 90)]
    links = spark.createDataFrame(links, "id bigint, source_doc_id string, target_doc_id string, relation string, indexed_at bigint").withColumn("key", F.lit("clash"))
    pages = spark.createDataFrame(pages, "id string, first_indexed_at bigint").withColumn("since", F.lit("clash"))
    ends = orphans.orphan_ends(links, pages)
    want = Counter({(3, "target"): 1, (4, "target"): 2, (5, "source"): 1, (5, "target"): 1, (6, "source"): 1, (6, "target"): 1, (7, "target"): 1, (7, "source"): 1})
    want.update({(100 + i, "target"): 1 for i in range(600)})
    assert Counter((r.link_id, r.side) for r in ends.collect()) == want
    purged = spark.createDataFrame([("hub.md",), ("hub.md",), (None,)], "doc_id string")
    report = {(r.side, r.reason): (r.n_ends, r.n_keys) for r in orphans.orphan_report(links.where("indexed_at = 100 AND relation = 'cites'"), pages, purged).collect()}
    assert report == {("target", "purged"): (600, 1), ("target", "missing"): (1, 1), ("target", "late"): (2, 1)}
    assert orphans.orphan_ends(links.limit(0), pages).count() == 0
    assert orphans.orphan_ends(links, pages.limit(0)).count() == 2 * links.count()


def test_wiki_checks(spark):
    ok = "---\ntitle: T\ntype: c\nsources:\n  - raw/x.md\ntimestamp: 2026-01-01\n---\n"
    rows = {"wiki/a.md": ok, "wiki/concepts/b.md": "---\ntitle: ''\nkind: c\nsources: []\n---\n", "wiki/concepts/c.md": ok.replace("raw/x.md", "raw/ghost.md"), "wiki/index.md": "", "wiki/concepts/_draft/d.md": "", "raw/x.md": ""}
    parsed = index.parse(files(spark, **rows))
    assert {(r.path, r.detail) for r in wiki.missing_fields(parsed).collect()} == {("wiki/concepts/b.md", "title"), ("wiki/concepts/b.md", "type"), ("wiki/concepts/b.md", "timestamp")}
    assert [(r.path, r.detail) for r in wiki.broken_sources(parsed, parsed.select("id")).collect()] == [("wiki/concepts/c.md", "raw/ghost.md")]
    pages = index.pages_of(parsed, NOW)
    links = spark.createDataFrame([("p", "[]  # related wiki pages", "related_to"), ("p", "wiki/concepts/missing.md", "supports"), ("p", "数字经济", "related_to"), ("q", "数字经济", "supports"), ("p", "wiki/a.md", "supports"), ("p", "gone", "cites"), ("p", "gone", None)], "source_doc_id string, target_doc_id string, relation string")
    broken = wiki.broken_links(links, pages)
    assert Counter(r.link_type for r in broken.collect()) == {"placeholder": 1, "path": 1, "concept": 2}
    assert list(wiki.red_link_records(broken)) == [{"concept": "数字经济", "count": 2, "referenced_by": ["p", "q"]}]
    assert list(wiki.red_link_records(broken.limit(0))) == []
    assert Counter(r.kind for r in wiki.link_warnings(broken).collect()) == {"broken_related": 1, "missing_concept": 2}
    assert wiki.clean_links(links, pages).count() == 3
    made: dict[str, str] = {}
    for path, text in wiki.index_texts(pages):
        made[path] = made.get(path, "") + text
    assert made["wiki/index.md"].endswith("# wiki\n\n* [concepts](concepts/) — 3 page(s)\n") and "* [T](c.md)" in made["wiki/concepts/index.md"]
    assert {r.kind: r.n for r in wiki.kind_counts(pages).collect()}["decision"] == 0
    status = wiki.status(pages, q(spark)).first()
    assert status.documents == 6 and status.by_layer == {"raw": 1, "wiki": 5} and status.queue["done"] == 0
    long = spark.createDataFrame([("p.md", "p.md", None, None, "x" * 6000), ("p.txt", "p.txt", None, None, "t")], "id string, path string, title string, kind string, content string")
    got = wiki.fetch(long, ["nope", "p.txt", "p.md"]).orderBy("place").collect()
    assert [(r.id, r.truncated, r.unsupported, len(r.content)) for r in got] == [("p.txt", False, True, 0), ("p.md", True, False, 5000)]
    assert len(wiki.fetch(long, ["p.md"], full=True).first().content) == 6000
    with pytest.raises(ValueError):
        wiki.fetch(long, [])


def test_file_scans(spark, tmp_path):
    for name in ("raw/a.md", "raw/b c.txt", "raw/converted/d.md", "raw/.hidden/x.md", "raw/e.pdf", "raw/d.pdf", "wiki/source-notes/a.md", "wiki/source-notes/lost.md", "wiki/index.md", "wiki/concepts/_draft/z.md", "other/y.md", "schema/s.rst"):
        p = tmp_path / name
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text("text of " + name)
    listed = kb_files.files(spark, f"file://{tmp_path}")
    pages = kb_files.page_files(spark, f"file://{tmp_path}")
    assert {r.id for r in pages.collect()} == {"raw/a.md", "raw/b c.txt", "raw/converted/d.md", "wiki/source-notes/a.md", "wiki/source-notes/lost.md", "schema/s.rst"}
    assert {r.content for r in pages.where("id = 'raw/b c.txt'").collect()} == {"text of raw/b c.txt"}
    assert {r.path for r in kb_files.raw_listing(listed).collect()} == {"raw/a.md", "raw/b c.txt", "raw/e.pdf", "raw/d.pdf"}
    assert {r.path for r in kb_files.undistilled(listed).collect()} == {"converted/d.md"}
    assert {r.path for r in kb_files.convertible(listed).collect()} == {"e.pdf"}
    assert {r.id for r in kb_files.orphan_stems(listed).collect()} == {"wiki/source-notes/lost.md"}
    assert kb_files.orphan_stems(listed.where("id NOT LIKE 'raw/%' OR id LIKE 'raw/converted/%'")).count() == 0
    assert kb_files.page_files(spark, f"file://{tmp_path}", "2999-01-01T00:00:00").count() == 0
    (tmp_path / "q.json").write_text(json.dumps([{"question": "a?", "ground_truth": "b"}]))
    assert kb_files.eval_questions(spark, [f"{tmp_path}/none.json", f"{tmp_path}/q.json"]).first().question == "a?"


def test_synthesis(spark):
    rows = [("n/a.md", "Alpha", "d", ["X", "y"], []), ("n/b.md", "Beta", "d", ["x"], []), ("n/c.md", "Gamma", None, ["z"], ["c"]), ("n/d.md", None, None, [], [])]
    notes = synthesis.with_hash(spark.createDataFrame(rows, "path string, title string, description string, tags array<string>, key_claims array<string>"))
    assert {r.path for r in synthesis.topic_filter(notes, "X").collect()} == {"n/a.md", "n/b.md"} and synthesis.topic_filter(notes, "").count() == 4
    empty = spark.createDataFrame([], "path string, hash string")
    state = synthesis.recorded(empty, notes.where("path <> 'n/c.md'"))
    assert [r.path for r in synthesis.new_or_changed(notes, state).collect()] == ["n/c.md"] and synthesis.new_or_changed(notes, synthesis.recorded(state, notes)).count() == 0
    near = {(r.seed, r.path): r.place for r in synthesis.tag_overlap(notes).collect()}
    assert near == {("n/a.md", "n/a.md"): 1, ("n/a.md", "n/b.md"): 2, ("n/b.md", "n/b.md"): 1, ("n/b.md", "n/a.md"): 2, ("n/c.md", "n/c.md"): 1, ("n/d.md", "n/d.md"): 1}
    answer = '```json\n[{"type": "concept", "title": "T", "slug": "t", "sources": ["a", "b"]}, {"type": "concept", "title": "U", "slug": "u", "sources": ["a"]}, {"type": "concept", "slug": "v", "sources": []}]\n```'
    plans = synthesis.viable(synthesis.plans_of(spark.createDataFrame([(answer,), ("no json",), (None,)], "answer string")))
    pages = spark.createDataFrame([("wiki/concepts/u.md", "---\nsource_count: 4\n---\n"), ("wiki/concepts/_draft/w.md", "---\nsource_count: 2\n---\n")], "id string, content string")
    got = {r.slug: (r.dest, r.is_draft, r.step) for r in synthesis.routed(plans, pages).collect()}
    assert got == {"t": ("wiki/concepts/t.md", False, "create"), "u": ("wiki/concepts/u.md", False, "rewrite")}
    none = pages.limit(0)
    assert {r.slug: (r.dest, r.step) for r in synthesis.routed(plans, none).collect()}["u"] == ("wiki/concepts/_draft/u.md", "create")
    assert [r.dest for r in synthesis.graduates(pages).collect()] == ["wiki/concepts/w.md"]
    path, report = synthesis.gap_report(notes, "Alpha", lambda s, u: u)
    assert path == "index/gaps/alpha.md" and "n/a.md" in report and "n/b.md" not in report
    with pytest.raises(ValueError):
        synthesis.gap_report(notes, "nothing", lambda s, u: u)
    with pytest.raises(ValueError):
        synthesis.note_list(notes, 10)


def test_distil(spark):
    def llm(system, text):
        if "bad" in text:
            raise RuntimeError("429")
        return "```md\n---\ntitle: T\nresource: http://made.up\n---\nbody\n```"

    raw = [("raw/a.md", "fine", 0), ("raw/b.md", "bad", 0), ("raw/c.md", "\n".join(["M01"] * 60), 0)]
    made = {r.path: r for r in synthesis.distil(spark.createDataFrame(raw, "id string, content string, mtime bigint"), llm, "s", "now").collect()}
    assert made["raw/a.md"].note == '---\ntitle: T\nresource: ""\nsources:\n  - raw/a.md\n---\nbody' and made["raw/b.md"].error == "429" and "processing: lightweight" in made["raw/c.md"].note
    paths = spark.createDataFrame([("raw/converted/x/a.b.md",), ("raw/y.txt",)], "p string")
    assert [r.n for r in paths.select(synthesis.note_path(F.col("p")).alias("n")).collect()] == ["wiki/source-notes/x/a.b.md", "wiki/source-notes/y.md"]


def test_evaluation(spark):
    pages = spark.createDataFrame([("p/a.md", "---\nfoo\n---\nfoo foo bar"), ("p/b.md", "foo"), ("p/c.md", "foofoofoo"), ("p/d.md", None)], "id string, content string")
    asked = spark.createDataFrame([(1, "Foo, foo?", "a.md", "s"), (2, "bar", "", "s"), (3, "of", "p/b.md", "s"), (4, None, None, "s")], "item_id bigint, question string, expected_page string, suite string")
    found = evaluate.keyword_retrieval(pages, asked, 2)
    assert {(r.item_id, r.id, r.score, r.place) for r in found.collect()} == {(1, "p/c.md", 6, 1), (1, "p/a.md", 4, 2), (2, "p/a.md", 1, 1)}
    scored = evaluate.hits(found, asked)
    assert {(r.item_id, r.hit, r.rr) for r in scored.collect()} == {(1, 1, 0.5), (2, 0, 0.0), (3, 0, 0.0), (4, 0, 0.0)}
    both = scored.withColumn("system", F.lit("x")).unionByName(scored.withColumn("system", F.lit("y")).withColumn("rr", F.lit(0.0)))
    assert {r.metric: r.delta for r in evaluate.comparison(both, ["hit", "rr"], "x", "y").collect()} == {"hit": 0.0, "rr": 0.125}
    rows = spark.createDataFrame([("q", "a")], "question string, answer string")
    assert evaluate.judged(rows, lambda s, u: "score: 0.75" if s == "f" else "?", {"faith": ("f", "{answer}"), "rel": ("r", "{question}")}).first()[2:] == (0.75, 0.5)
    assert evaluate.keyword_retrieval(pages.limit(0), asked).count() == 0 and evaluate.keyword_retrieval(pages, asked.limit(0)).count() == 0


def fake_runner(request):
    if request["kind"] == "document":
        return {"ok": True, "data": {"content": "<title>T</title>", "document_id": "d", "revision_id": "4"}}
    if request["table"] == "broken":
        return {"ok": False, "error": "no"}
    rows = [["a", 1], ["b", None], ["c", {"x": "é"}]][request["offset"] : request["offset"] + 2]
    return {"ok": True, "data": {"fields": ["name", "value"], "data": rows, "has_more": request["offset"] + len(rows) < 3}}


def test_connectors(spark):
    assert connectors.fetch_document(fake_runner, "u")["revision_id"] == 4
    assert [len(rows) for _, rows in connectors.record_pages(fake_runner, "t", "x")] == [2, 1]
    with pytest.raises(RuntimeError):
        list(connectors.record_pages(fake_runner, "t", "broken"))
    spark.sparkContext.addPyFile(__file__)
    records = connectors.read_records(spark, "test_pipeline:fake_runner", [("t", "one"), ("t", "two")])
    tables = connectors.as_tables(records)
    assert [t for t, _ in tables] == ["one", "two"] and [tuple(r) for r in tables[0][1].orderBy("row").collect()] == [("a", "1", 0), ("b", None, 1), ("c", '{"x":"é"}', 2)]
    page = "<html><head><title>A b</title><style>x</style></head><body><h2>Head</h2><p>Tom &amp; <b>Jerry</b><br/>x</p><ul><li>one</li><li><a href=\"u\">two</a></li></ul><script>no</script></body></html>"
    df = spark.createDataFrame([(page,), (None,)], "h string").select(connectors.html_text(F.col("h")).alias("t"), connectors.html_title(F.col("h")).alias("n")).collect()
    assert df[0].n == "A b" and df[0].t.startswith("## Head\n\nTom & Jerry") and "- [two](u)" in df[0].t and "no" not in df[0].t.split() and df[1].t is None
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        z.writestr("word/embeddings/s1.xlsx", b"1")
    md = connectors.inject_sheets("a ![x](data:image/png;base64,AA) b ![y](data:image/png;base64,BB)", data.getvalue(), lambda b: r"| NaN | a\_b |")
    assert md == "a |  | a_b | b ![y](data:image/png;base64,BB)" and connectors.inject_sheets("m", b"no zip", str) == "m"
    binary = spark.createDataFrame([("a.pdf", bytearray(b"x")), ("b.pdf", bytearray(b""))], "id string, content binary")
    out = {r.path: (r.markdown, r.ok) for r in connectors.converted(binary, lambda n, b: b.decode() if b else 1 / 0).collect()}
    assert out == {"a.pdf": ("x", True), "b.pdf": (None, False)}
    assert connectors.command_converter(["cat"])("n", b"hi") == "hi" and connectors.command_converter(["false"])("n", b"") is None


def test_file_stream(spark, tmp_path):
    root, seen = tmp_path / "kb", []
    (root / "raw").mkdir(parents=True)
    (root / "wiki").mkdir()
    (root / "raw/a.md").write_text("one")
    (root / "wiki/log.md").write_text("log")
    handle = lambda batch, n: seen.extend((r.id, r.content) for r in batch.collect())
    for text in ("two", None):
        watch.follow(watch.changed_files(spark, f"file://{root}"), handle, str(tmp_path / "ck")).awaitTermination()
        if text:
            (root / "raw/b.md").write_text(text)
    assert seen == [("raw/a.md", "one"), ("raw/b.md", "two")]


def test_bursts(spark):
    rows = [("k", datetime(2026, 1, 1, 0, 0, s)) for s in (0, 2, 4, 10, 20, 22)]
    df = spark.createDataFrame(rows, "key string, ts timestamp")
    got = [(r.fires_at.second, r.n) for r in watch.debounced(df, "ts", ["key"]).orderBy("fires_at").collect()]
    assert got == [(7, 3), (13, 1), (25, 2)]


def test_queue_stream(spark, tmp_path):
    def send(n, *events):
        spark.createDataFrame(list(events), "path string, event string, error string, at bigint").coalesce(1).write.parquet(f"{tmp_path}/in/{n}")
        stream = spark.readStream.schema("path string, event string, error string, at bigint").option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
        out = []
        keep = lambda b, _: out.extend(b.collect())
        watch.queue_states(stream).writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start().awaitTermination()
        return {r.path: (r.status, r.retry_count) for r in out}

    assert send(1, ("a", "enqueued", None, 1), ("a", "enqueued", None, 2), ("b", "enqueued", None, 1), ("c", "failed", "x", 1)) == {"a": ("pending", 0), "b": ("pending", 0)}
    assert send(2, ("a", "started", None, 3), ("a", "failed", "x", 4), ("b", "started", None, 3)) == {"a": ("pending", 1), "b": ("processing", 0)}
    assert send(3, *[("a", "failed", "x", 5 + i) for i in range(4)], ("b", "done", None, 9)) == {"a": ("failed", 5), "b": ("done", 0)}


def test_references_of_any_table(spark):
    rows = spark.createDataFrame([("a.md",), ("gone.md#x",), (" gone.md",), (None,), (" ",), ("gone2.md",)], "ref string").withColumn("key", F.lit("clash"))
    timed = spark.createDataFrame([("gone.md", 0), ("gone.md", 86_400 * 40), ("gone.md", None)], "ref string, at bigint")
    pages = spark.createDataFrame([("a.md",), (None,), ("a.md",)], "id string")
    refs = [orphans.references(rows, "tags", "ref"), orphans.references(timed, "links", "ref", "at")]
    got = {tuple(r) for r in orphans.missing_parents(refs, pages, "id").collect()}
    assert got == {("tags", "ref", None, 3, 2), ("links", "ref", "1970-01", 1, 1), ("links", "ref", "1970-02", 1, 1), ("links", "ref", None, 1, 1)}
    assert orphans.missing_parents([r.limit(0) for r in refs], pages, "id").count() == 0


def test_judged_lists(spark):
    rows = spark.createDataFrame([("q1", ["a", "b", "c", "d"]), ("q2", ["a", "b"]), ("q3", []), ("q4", None), ("q5", ["a"]), ("q6", ["a"])], "question string, contexts array<string>")

    def judge(system, text):
        return {"q1": "I say [1, 0, 1, 0, 1]", "q2": "[1]", "q5": "no idea", "q6": "[1]"}[text[:2]]

    got = {r.question: r.precision for r in evaluate.judged_list(rows, judge, "sys").collect()}
    assert got == {"q1": 0.5, "q2": 0.5, "q3": 0.0, "q4": 0.0, "q5": 0.5, "q6": 1.0}
