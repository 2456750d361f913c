import json
import threading
import urllib.request
from http.server import BaseHTTPRequestHandler, HTTPServer
from pathlib import Path

import pytest

import __spark_entry__ as entry
from lorekeep.api import KnowledgeBase, RequestError, init, main
from lorekeep import tools
from lorekeep.service import Service, Settings
from lorekeep.session import shared_dir
from lorekeep.sources.model_client import HttpModel

PAGE = "---\ntitle: Go\ntype: concept\nsources:\n  - raw/go.md\ntimestamp: 2026-01-01\n---\nGo compiles fast. [[Other]]\n"


@pytest.fixture(scope="module")
def kb(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("kb")
    init(str(root))
    (root / "raw/go.md").write_text("Go is a compiled language.")
    (root / "wiki/concepts/go.md").write_text(PAGE)
    (root / "wiki/concepts/rust.md").write_text("---\ntitle: Rust\ntype: concept\nsources: []\ntimestamp: 2026-01-01\nrelated_to:\n  - 数字经济\n---\nRust compiles too.\n")
    base = KnowledgeBase(spark, str(root), now=lambda: 1_800_000_000)
    assert base.reindex() == 10 and base.reindex() == 0  # seven of them came with it
    return base


def test_reading(kb):
    s = kb.status()
    assert s["documents"] == 10 and s["by_kind"]["concept"] == 2 and s["queue"]["pending"] == 1 and s["index_size"] > 0
    found = kb.search("compiles")
    assert {r["id"] for r in found["results"]} == {"wiki/concepts/go.md", "wiki/concepts/rust.md"} and found["results"][0]["pool"] == "synth"
    assert kb.search(" ")["results"] == [] and kb.query_log().count() == 2
    assert kb.page(["wiki/concepts/go.md"], full=True)[0]["content"] == PAGE
    with pytest.raises(RequestError):
        kb.page([])
    assert kb.context("compiles")["raw_sources"][0]["id"] == "raw/go.md" and [f["path"] for f in kb.files()] == ["raw/go.md"]
    assert (Path(kb.root) / "wiki/index.md").read_text().endswith("* [concepts](concepts/) — 2 page(s)\n")


def test_scratch_tables_go_with_the_call(kb, spark):
    at = Path(shared_dir(spark).removeprefix("file://"), "lorekeep")
    before = set(at.iterdir())
    kb.search("compiles", log=False)
    kb.context("compiles")
    kb.reindex()
    assert set(at.iterdir()) <= before
    assert kb.purge_orphans() == []


def test_index_of_an_older_version_is_made_anew(kb):
    at = Path(kb.root) / "index/tables/manifest.json"
    manifest = json.loads(at.read_text())
    manifest["tables"]["postings"] = manifest["tables"].pop("grams")
    at.write_text(json.dumps(manifest))
    assert kb.search_index() is None and len(kb.search("compiles", log=False)["results"]) == 2  # by a scan
    assert kb.reindex() == 0 and "postings" not in kb._manifest()["tables"]
    held = kb.table("grams").where("gram = ''").selectExpr("explode(ids) AS id").collect()
    assert sorted(r.id for r in held) == sorted(r.id for r in kb.table("pages").select("id").collect())
    assert len(kb.search("compiles", log=False)["results"]) == 2


def test_lint_and_red_links(kb):
    assert kb.lint() == []
    warned = kb.lint(clean=True)
    assert [(w["kind"], w["detail"]) for w in warned] == [("missing_concept", "数字经济")]
    assert kb.red_links()[0]["count"] == 1 and kb.red_links(drop="数字经济") == [] and kb.table("links").where("relation = 'related_to'").count() == 0


def test_writing(kb):
    assert kb.add("new/note.md", "words", "http://x") == "raw/new/note.md" and kb.table("pages").where("id = 'raw/new/note.md'").first().content.startswith("<!-- source: http://x -->")
    for bad in (lambda: kb.add("new/note.md", "again"), lambda: kb.add("../x", ""), lambda: kb.upload("", b"")):
        with pytest.raises(RequestError):
            bad()
    assert kb.upload("/a/b/up.bin", b"1") == "raw/up.bin"


class Model:
    """Plans what it is told, and keeps what it was asked."""

    def __init__(self, *plans):
        self.plans, self.asked = list(plans), []

    def __call__(self, system, text):
        self.asked.append((system, text))
        return json.dumps(self.plans) if "JSON" in system else "---\ntitle: Page\ntype: concept\n---\nSome page."


def plan(slug, *sources, type="concept"):
    return {"type": type, "title": slug.title(), "slug": slug, "description": "d", "sources": list(sources)}


def note_model(answer="[]"):
    """Runs in tasks, so it refers to nothing of this module."""

    def model(system, text):
        return answer if "JSON" in system else f"---\ntitle: Note\ntype: source-note\ntags: [x]\n---\nOn {text}."

    return model


def test_notes_and_pages(kb):
    assert kb.distil(note_model(), n=1) == {"done": 2, "failed": 0} and (Path(kb.root) / "wiki/source-notes/go.md").exists()  # round after round
    assert kb.table("queue").count() == 0 and (Path(kb.root) / "wiki/log.md").read_text().count("ingest | Note\n") == 2
    note, other, third = "wiki/source-notes/go.md", "wiki/source-notes/new/note.md", "wiki/concepts/go.md"
    llm = Model(plan("zig", note, other), plan("y", note), plan("../../evil", note, type="../x"))
    assert kb.synthesize(llm) == 2 and kb.synthesize(llm) == 0
    asked = [text for _, text in llm.asked]
    assert note in asked[0] and "Existing pages:\n- Go\n- Rust" in asked[0]
    assert "d" in asked[1] and "On Go is a compiled" in asked[1] and "Y" in asked[1]  # the draft's page is asked for first, with its note's text
    assert "On Go is a compiled" in asked[2] and "On <!-- source: http" in asked[2] and "What it is" in llm.asked[2][0] and "Citation rules" in llm.asked[2][0]
    page = (Path(kb.root) / "wiki/concepts/zig.md").read_text()
    assert "source_count: 2" in page and f"sources:\n  - {note}\n  - {other}" in page and (Path(kb.root) / "wiki/concepts/_draft/y.md").exists()
    assert kb.synthesize(Model(plan("zig", other, third), plan("y", other)), full=True) == 2
    page = (Path(kb.root) / "wiki/concepts/zig.md").read_text()
    assert "source_count: 3" in page and f"sources:\n  - {note}\n  - {other}\n  - {third}" in page  # none is lost, and the count is theirs
    assert not (Path(kb.root) / "wiki/concepts/_draft/y.md").exists() and (Path(kb.root) / "wiki/concepts/y.md").exists()
    assert (Path(kb.root) / kb.gaps(lambda s, u: "report", "note")).read_text() == "report"


def test_worker_takes_up_what_was_left(kb):
    kb.add("left.md", "left over")
    kb._take(5)
    assert kb.table("queue").first().status == "processing"
    plans = json.dumps([plan("worked", "wiki/source-notes/left.md", "wiki/source-notes/go.md")])
    kb.work(note_model(plans), workers=2, rounds=2, sleep=lambda s: None)
    assert kb.table("queue").count() == 0 and "wiki/source-notes/left.md" in (Path(kb.root) / "wiki/concepts/worked.md").read_text()

    def refuse(system, text):
        raise RuntimeError("503")

    kb.add("bad.md", "text")
    assert kb.distil(refuse) == {"done": 0, "failed": 1} and kb.table("queue").first().last_error == "503"
    (Path(kb.root) / "raw/bad.md").unlink()
    kb._save(queue=kb.table("queue").limit(0))
    kb.reindex()


def test_command_line(tmp_path):
    assert main(["--root", str(tmp_path / "x"), "init"]) == 0 and (tmp_path / "x/wiki/decisions").is_dir()


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_import_convert_and_watch(kb, spark):
    spark.sparkContext.addPyFile(str(Path(__file__).parent / "import_runner.py"))
    got = kb.import_document("http://x/doc", "import_runner:runner")
    at = "raw/imported/a-b"
    assert got == {"document_path": f"{at}/a-b.md", "table_paths": [f"{at}/t1.tsv", f"{at}/etc-t2.tsv"], "total_rows": 4, "unique_rows": 3, "duplicates_removed": 1}
    lines = (Path(kb.root) / at / "a-b-records.txt").read_text().splitlines()
    assert lines[2] == "nickname\turl\ttitle\t来源表格" and len(lines) == 6 and "https://h/topic/100" in lines[3]
    text = (Path(kb.root) / got["document_path"]).read_text()
    assert "holds 3 records" in text and "<bitable" not in text and text.index("(t1.tsv)") < text.index("(etc-t2.tsv)") < text.index("end of text")
    assert kb.import_document("http://x/doc", "import_runner:runner") == got  # an import may be made again
    mine = Path(kb.root) / "raw/a-b/keep.md"
    other = Path(kb.root) / "raw/imported/mine/keep.md"
    for p in (mine, other):
        p.parent.mkdir(parents=True)
        p.write_text("mine")
    kb.import_document("http://x/doc", "import_runner:runner")
    with pytest.raises(RequestError):
        kb.import_document("http://x/doc", "import_runner:runner", "Mine")
    assert mine.read_text() == other.read_text() == "mine" and not list(Path(kb.root, "index/import").iterdir())
    kb.upload("page.html", b"<h1>T</h1><p>hi</p>")
    kb.upload("page2.docx", b"PKno")
    assert kb.convert(lambda name, data: "office " + name) == 2 and (Path(kb.root) / "raw/converted/page.md").read_text() == "# T\n\nhi"
    assert (Path(kb.root) / "raw/converted/page2.md").read_text() == "office raw/page2.docx" and kb.convert() == 0
    kb.watch().awaitTermination()
    assert kb.table("pages").where("id = 'raw/converted/page.md'").count() == 1
    kb.upload("page3.html", b"<p>zebra</p>")
    before = kb._manifest()["tables"]
    kb.watch().awaitTermination()  # the batch has the HTML file: it is converted
    kb.watch().awaitTermination()  # and this one what came of it
    assert kb.search("zebra", log=False)["results"][0]["id"] == "raw/converted/page3.md" and kb._manifest()["tables"].get("state") == before.get("state") and kb._manifest()["tables"]["pages"] != before["pages"]


def test_service(kb, tmp_path):
    at = str(tmp_path / "settings")
    Settings(api_key="k", port=0).save(at)
    assert Path(at).stat().st_mode & 0o777 == 0o600
    settings = Settings.load(at, {"LOREKEEP_WORKERS": "5"})
    assert settings.workers == 5 and settings.shown()["api_key"] == "set"
    service, key = Service(kb, settings, at), {"X-Api-Key": "k"}
    assert service.handle("GET", "/api/status")[0] == 401
    assert service.handle("GET", "/api/status", headers=key)[1]["documents"] > 3
    assert service.handle("GET", "/api/search", {"q": "compiles", "limit": "4"}, headers=key)[1]["results"]
    for bad in (("GET", "/api/search", {}), ("GET", "/api/page", {}), ("POST", "/api/add", {}), ("POST", "/api/import", {})):
        assert service.handle(*bad, headers=key)[0] == 400
    assert service.handle("GET", "/api/nothing", headers=key)[0] == 404 and service.handle("GET", "/api/red-links", headers=key) == (200, [])
    assert service.handle("PUT", "/api/settings", body=b'{"workers": 7}', headers=key)[1]["workers"] == 7 and Settings.load(at, {}).workers == 7
    for body in (b'{"nothing": 7}', b'{"import_runner": "os:system"}', b'{"shown": 1}'):
        assert service.handle("PUT", "/api/settings", body=body, headers=key)[0] == 400
    assert service.handle("POST", "/api/import", body=b'{"url": "touch /tmp/x", "runner": "os:system"}', headers=key)[0] == 400
    server = service.serve()
    threading.Thread(target=server.handle_request, daemon=True).start()
    request = urllib.request.Request(f"http://127.0.0.1:{server.server_port}/api/settings", headers=key)
    assert json.loads(urllib.request.urlopen(request, timeout=20).read())["workers"] == 7
    server.server_close()


def test_agent_tools(kb):
    asked = [
        {"id": 1, "method": "initialize"}, {"method": "notifications/initialized"}, {"id": 2, "method": "tools/list"}, {"id": 3, "method": "nothing"},
        {"id": 4, "method": "tools/call", "params": {"name": "kb_page", "arguments": {"ids": ["wiki/concepts/go.md"]}}}, {"id": 5, "method": "tools/call", "params": {"name": "kb_search", "arguments": {}}},
        {"id": 6, "method": "tools/call", "params": {"name": "kb_search", "arguments": {"query": "compiles", "limit": 2}}},
    ]
    out: list[str] = []
    tools.serve(kb, iter([*map(json.dumps, asked), "", "no json"]), out.append)
    got = {r["id"]: r for r in map(json.loads, out)}
    assert [t["name"] for t in got[2]["result"]["tools"]] == ["kb_search", "kb_page", "kb_add"] and got[3]["error"]["code"] == -32601
    assert "Go compiles fast" in got[4]["result"]["content"][0]["text"] and got[5]["result"]["isError"] and got[None]["error"]
    assert json.loads(got[6]["result"]["content"][0]["text"])["results"]


def echo_model(system, user):
    return json.dumps([]) if "JSON" in system else "---\ntitle: E\n---\nx"


def test_more_commands(kb, spark, capsys):
    (Path(kb.root) / "questions.json").write_text(json.dumps([{"question": "what compiles", "ground_truth": "x", "expected_page": "wiki/concepts/go.md"}]))
    for command in (["evaluate", f"{kb.root}/questions.json"], ["convert"], ["status"], ["search", "compiles", "--limit", "2"], ["lint"], ["index"], ["distil", "--model", "test_api:echo_model"], ["synthesize", "--full", "--model", "test_api:echo_model"]):
        assert main(["--root", kb.root, *command]) == 0
        assert json.loads(capsys.readouterr().out) is not None


@pytest.mark.parametrize("style", ["chat", "messages"])
def test_http_model(style):
    seen = {}

    class Handler(BaseHTTPRequestHandler):
        def do_POST(self):
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            seen.update(body, path=self.path, version=self.headers.get("anthropic-version"), key=self.headers.get("x-api-key") or self.headers.get("Authorization"))
            refused = body["model"] == "busy"
            answer = {"content": [{"type": "text", "text": "hi"}]} if style == "messages" else {"choices": [{"message": {"content": "hi"}}]}
            self.send_response(429 if refused else 200)
            self.end_headers()
            self.wfile.write(json.dumps(answer).encode())

        def log_message(self, *_):
            pass

    server = HTTPServer(("127.0.0.1", 0), Handler)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    base = f"http://127.0.0.1:{server.server_port}/v1"
    assert HttpModel(base, "t", "m", style)("sys", "user") == "hi"
    assert seen["path"] == ("/v1/messages" if style == "messages" else "/v1/chat/completions") and "t" in seen["key"] and seen["messages"][-1]["content"] == "user"
    assert (seen["version"] is not None) == (style == "messages")
    with pytest.raises(RuntimeError, match="429"):
        HttpModel(base, "t", "busy", style)("s", "u")
    for bad in (HttpModel("", "t", "m"), HttpModel(base, "t", "m", "other")):
        with pytest.raises(ValueError):
            bad("s", "u")
    server.shutdown()
