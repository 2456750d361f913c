"""One knowledge base on disk: its files, its tables, and the calls that tools, services and the command line make."""

from __future__ import annotations

import argparse
import functools
import json
import shlex
import shutil
import sys
import threading
import time
import uuid
from collections.abc import Callable
from datetime import UTC, datetime
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import prompts
from .functions.notes import set_sources, sources_of, unfenced
from .functions.text import import_slug, note_title, source_count, stem, with_source_count
from .operators import context, evaluate, graph, index, postings, queue, records, search, synthesis, wiki
from .session import materialise, scratch_scope
from .sources import connectors, kb_files
from .streaming import watch

FOLDERS = ("raw", "wiki/source-notes", "wiki/concepts", "wiki/comparisons", "wiki/decisions", "schema", "index", "models")
SCHEMAS = {
    "pages": "id string, path string, layer string, kind string, title string, description string, content string, content_hash string, source_uri string, updated_at bigint, authority int, doc_timestamp bigint",
    "links": "source_doc_id string, target_doc_id string, relation string, confidence double",
    "tags": "doc_id string, tag string, source string",
    "queue": "path string, status string, retry_count int, last_error string, queued_at bigint, updated_at bigint",
    "state": "path string, hash string",
    "grams": postings.SCHEMA,
    "sizes": "id string, length int",
}
MOST_UPLOAD = 100 << 20
#: Imports lie in a folder of their own; a folder in it that holds this file is one.
IMPORTS, IMPORT_MARK = "raw/imported", ".import"


class RequestError(ValueError):
    """A call that its caller has to change."""

    code = 400


def init(root: str, force: bool = False) -> None:
    """The folders of a knowledge base with its rules and templates; forced, those that came with it are written again."""
    for f in FOLDERS:
        Path(root, f).mkdir(parents=True, exist_ok=True)
    for path, text in prompts.bundled().items():
        at = Path(root, path)
        at.parent.mkdir(parents=True, exist_ok=True)
        if force or not at.exists():
            at.write_text(text)


def _one_at_a_time(f):
    @functools.wraps(f)
    def run(self, *args, **kwargs):
        with self.lock, scratch_scope(self.spark):
            return f(self, *args, **kwargs)

    return run


def _reading(f):
    """The scratch tables of the call go with it."""

    @functools.wraps(f)
    def run(self, *args, **kwargs):
        with scratch_scope(self.spark):
            return f(self, *args, **kwargs)

    return run


class KnowledgeBase:
    """The root is a folder that the driver and all executors share. Each table is written as a folder of its own whenever it changes; index/tables/manifest.json says which
    folder is each table's and is replaced as a whole, so a reader never sees half a run. Calls that write wait for one another."""

    def __init__(self, spark: SparkSession, root: str, now=time.time):
        self.spark, self.root, self.now = spark, str(Path(root).absolute()), now
        self.lock = threading.RLock()

    # tables

    def _manifest(self) -> dict:
        at = Path(self.root, "index/tables/manifest.json")
        return json.loads(at.read_text()) if at.exists() else {"version": 0, "tables": {}, "before": {}}

    def table(self, name: str) -> DataFrame:
        folder = self._manifest()["tables"].get(name)
        if not folder:
            return self.spark.createDataFrame([], SCHEMAS[name])
        read = self.spark.read.parquet(f"file://{self.root}/index/tables/{folder}")
        return index.migrated(read, {c.split()[0]: (c.split()[1], None) for c in SCHEMAS[name].split(", ")})

    def search_index(self) -> postings.SearchIndex | None:
        return postings.SearchIndex(self.table("grams"), self.table("sizes")) if "grams" in self._manifest()["tables"] else None

    @_one_at_a_time
    def _save(self, since: float | None = None, **tables: DataFrame) -> None:
        """Writes the given tables; the others stay as they are. `since` is when the scan they come from began."""
        old, at = self._manifest(), Path(self.root, "index/tables")
        at.mkdir(parents=True, exist_ok=True)
        new = {"version": old["version"] + 1, "tables": {k: v for k, v in old["tables"].items() if k in SCHEMAS}, "before": old["tables"], "since": old.get("since") if since is None else since}
        for name, df in tables.items():
            folder = f"{name}-{new['version']}-{uuid.uuid4().hex[:8]}"
            df.write.parquet(f"file://{at / folder}")
            new["tables"][name] = folder
        part = at / f".manifest-{uuid.uuid4().hex}"
        part.write_text(json.dumps(new))
        part.replace(at / "manifest.json")
        kept = set(new["tables"].values()) | set(new["before"].values())  # those before stay for readers that have begun
        for p in at.iterdir():
            if p.is_dir() and p.name not in kept:
                shutil.rmtree(p, ignore_errors=True)

    # reading

    def status(self) -> dict:
        row = wiki.status(self.table("pages"), self.table("queue")).first()
        folders = [Path(self.root, "index/tables", f) for f in self._manifest()["tables"].values()]
        size = sum(p.stat().st_size for r in folders for p in r.rglob("*") if p.is_file())
        return row.asDict() | {"index_path": f"{self.root}/index/tables", "index_size": size}

    @_reading
    def search(self, query: str, layer: str | None = None, kind: str | None = None, limit: int = 10, log: bool = True) -> dict:
        notes, synths = search.pools_for(limit)
        pages, links = self.table("pages"), self.table("links")
        found = search.layered(pages, links, query, int(self.now()), layer, kind, notes, synths, self.search_index())
        if log:
            self._log("kb_search", query)
        if found is None:
            return {"results": [], "conflicts": []}
        rows = [r.asDict() for r in found.orderBy(F.col("pool"), "place").collect()]  # bounded by the limit
        if rows:
            seeds = self.spark.createDataFrame([(r["id"],) for r in rows], "id string")
            near = [graph.related(links, pages, 3, seeds), graph.tag_related(self.table("tags"), pages, 5, seeds)]
            related = {r.seed: [x.asDict() for x in r.related] for r in graph.related_list(graph.merge_related(near, 8)).collect()}
            clashes = [r.asDict() for r in graph.conflicts(links, seeds).collect()]
        else:
            related, clashes = {}, []
        return {"results": [r | {"related": related.get(r["id"], [])} for r in rows], "conflicts": clashes}

    def page(self, ids: list[str], full: bool = False) -> list[dict]:
        if not ids:
            raise RequestError("no ids")
        return [r.asDict() for r in wiki.fetch(self.table("pages"), ids[: wiki.MOST_PAGES], full).orderBy("place").collect()]

    @_reading
    def context(self, question: str, limit: int = 10) -> dict:
        b = context.build(self.table("pages"), self.table("links"), question, limit, self.search_index())
        rows = lambda df: [] if df is None else [r.asDict() for r in df.collect()]  # noqa: E731 - bounded by the limit
        return {"question": question, "wiki_pages": rows(b.pages), "raw_sources": rows(b.raw), "graph_pages": rows(b.neighbours), "conflicts": rows(b.conflicts)}

    def files(self) -> list[dict]:
        return [r.asDict() for r in kb_files.raw_listing(self._files()).orderBy("path").toLocalIterator()]

    # writing

    def _files(self) -> DataFrame:
        return kb_files.files(self.spark, f"file://{self.root}")

    @_one_at_a_time
    def reindex(self, full: bool = False, batch: DataFrame | None = None, catch_up: bool = False) -> int:
        """Files into tables, index pages, and new raw files into the queue. Returns how many pages were written. A batch (id, content, mtime) holds all files that
        changed; catching up reads only files that were modified since the last run began. Tables that did not change are not written."""
        begun, last = self.now(), self._manifest().get("since")
        ids = self._files().where(kb_files.is_page(F.col("id"))).select("id")
        scanned = batch
        if scanned is None:
            after = f"{datetime.fromtimestamp(last - 1, UTC):%Y-%m-%dT%H:%M:%S}" if catch_up and last else None
            scanned = kb_files.page_files(self.spark, f"file://{self.root}", after)
        else:
            scanned = scanned.where(kb_files.is_page(F.col("id")))
        run = index.index_run(self.table("pages"), self.table("links"), self.table("tags"), scanned, int(begun), full, ids)
        n = run["written"].count()
        tables, moved = {}, n or not run["purged"].isEmpty()
        if moved or not {"pages", "grams"} <= self._manifest()["tables"].keys():
            touched = run["written"].unionByName(run["purged"])
            fresh = run["pages"].join(run["written"], "id", "left_semi")
            left = lambda name: self.table(name).join(touched, "id", "left_anti")
            grams = postings.updated(self.table("grams"), run["pages"], touched.select("id"), search.INDEXED) if self.search_index() else postings.postings_of(run["pages"], search.INDEXED)
            tables = {x: run[x] for x in ("pages", "links", "tags")}
            tables |= {"grams": postings.sorted_postings(grams), "sizes": left("sizes").select("id", "length").unionByName(fresh.select("id", search.page_length().alias("length")))}
        waiting = self.table("queue")
        new = materialise(queue.enqueue(waiting, kb_files.undistilled(ids), int(begun)), "enqueued")
        if not new.isEmpty() or "queue" not in self._manifest()["tables"]:
            tables["queue"] = waiting.unionByName(new)
        self._save(begun if batch is None else None, **tables)
        if moved or not Path(self.root, "wiki/index.md").exists():
            self.write_index_pages()
        return n

    def write_index_pages(self) -> None:
        begun: set[str] = set()
        for path, text in wiki.index_texts(self.table("pages")):
            Path(self.root, path).parent.mkdir(parents=True, exist_ok=True)
            with Path(self.root, path).open("a" if path in begun else "w") as f:
                f.write(text)
            begun.add(path)

    def add(self, name: str, content: str, url: str = "", overwrite: bool = False) -> str:
        try:
            at = Path(self.root, "raw", index.valid_name(name))
        except ValueError as e:
            raise RequestError(str(e)) from e
        if at.exists() and not overwrite:
            raise RequestError(f"{name} exists")
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(index.with_source(content, url))
        self.reindex()
        return str(at.relative_to(self.root))

    def upload(self, name: str, data: bytes) -> str:
        base = Path(name).name
        if not base or base.startswith("."):
            raise RequestError("no file name")
        if len(data) > MOST_UPLOAD:
            raise RequestError("too large")
        Path(self.root, "raw", base).write_bytes(data)
        return f"raw/{base}"

    @_one_at_a_time
    def lint(self, strict: bool = False, clean: bool = False) -> list[dict]:
        """Warnings on pages; with `clean` also those on links, whose broken rows leave the table, and the list of missing concepts is written."""
        pages = index.parse(self.table("pages"))
        found = wiki.missing_fields(pages).unionByName(wiki.broken_sources(pages, self._files().select("id")))
        if clean:
            links = self.table("links")
            broken = wiki.broken_links(links, self.table("pages"))
            found = found.unionByName(wiki.link_warnings(broken))
        rows = [r.asDict() for r in found.orderBy("path", "kind", "detail").toLocalIterator()]
        if clean:
            Path(self.root, "wiki/index").mkdir(parents=True, exist_ok=True)
            with self._red().open("w") as f:
                f.write("[")
                for i, record in enumerate(wiki.red_link_records(broken)):
                    f.write((",\n" if i else "\n") + json.dumps(record, ensure_ascii=False))
                f.write("\n]\n")
            self._save(links=wiki.clean_links(links, self.table("pages")))
        if strict and rows:
            raise RequestError(f"{len(rows)} warnings")
        return rows

    @_one_at_a_time
    def purge_orphans(self, delete: bool = False) -> list[str]:
        """Notes and converted files whose raw file is gone. They are deleted only when that is asked for, and the tables follow."""
        gone = [r.id for r in kb_files.orphan_stems(self._files().select("id")).orderBy("id").toLocalIterator()]
        if delete and gone:
            for path in gone:
                Path(self.root, path).unlink(missing_ok=True)
            self.reindex()
        return gone

    def _red(self) -> Path:
        return Path(self.root, "wiki/index/red_links.json")

    def red_links(self, drop: str | None = None) -> list[dict]:
        red = json.loads(self._red().read_text()) if self._red().exists() else []
        if drop is not None:
            red = [r for r in red if r["concept"] != drop]
            self._red().write_text(json.dumps(red, ensure_ascii=False, indent=1))
        return red

    def _log(self, tool: str, query: str, **more) -> None:
        """One JSON line per call, in a file per day outside the watched folders."""
        now = datetime.fromtimestamp(self.now(), UTC)
        at = Path(self.root, "index/logs", f"query_log_{now:%Y-%m-%d}.jsonl")
        at.parent.mkdir(parents=True, exist_ok=True)
        with at.open("a") as f:
            f.write(json.dumps({"ts": f"{now:%Y-%m-%dT%H:%M:%SZ}", "tool": tool, "query": query} | more, ensure_ascii=False) + "\n")

    def query_log(self) -> DataFrame:
        return self.spark.read.schema("ts timestamp, tool string, query string").json(f"file://{self.root}/index/logs")

    # notes and synthesis

    def distil(self, llm: synthesis.Llm, system: str | None = None, n: int = 100, workers: int = 1, incremental: bool = False) -> dict[str, int]:
        """All files of the queue that may be tried into notes, n at a time, with so many calls of the model at once; failures go back to the queue and wait longer each
        time. Incrementally, each new note is worked into the pages at once, as far as that succeeds."""
        system = prompts.for_kind(self.root, prompts.NOTE, "source-note") if system is None else system
        done = failed = 0
        while True:
            taken = self._take(n)
            if not taken:
                return {"done": done, "failed": failed}
            notes, errors = self._distil(taken, llm, system, workers)
            done, failed = done + len(notes), failed + errors
            if incremental:
                for path in notes:
                    try:
                        self.synthesize_note(llm, path)
                    except Exception:  # noqa: BLE001 - the note is there; its pages are a best effort
                        continue

    @_one_at_a_time
    def _take(self, n: int) -> list[str]:
        now = int(self.now())
        taken = [r.path for r in queue.ready(self.table("queue"), now, n).collect()]
        if taken:
            self._save(queue=queue.start(self.table("queue"), self.spark.createDataFrame([(p,) for p in taken], "path string"), now))
        return taken

    @_one_at_a_time
    def _distil(self, taken: list[str], llm: synthesis.Llm, system: str, workers: int) -> tuple[list[str], int]:
        now = int(self.now())
        stamp = f"{datetime.fromtimestamp(now, UTC):%Y-%m-%dT%H:%M:%SZ}"
        paths = self.spark.createDataFrame([(p,) for p in taken], "path string")
        raw = self.table("pages").join(paths.select(F.concat(F.lit("raw/"), "path").alias("id")), "id", "left_semi")
        raw = raw.withColumn("mtime", F.col("doc_timestamp")).repartition(workers)
        made = materialise(synthesis.distil(raw, llm, system, stamp).withColumn("dest", synthesis.note_path(F.col("path"))), "notes")
        good = made.where("note IS NOT NULL")
        connectors.save_texts(good.select(F.col("dest").alias("path"), F.col("note").alias("text")), self.root).count()
        rows = good.select("path", "dest", note_title(F.col("note"), stem(F.col("dest"))).alias("title")).orderBy("path").collect()
        with Path(self.root, "wiki/log.md").open("a") as f:
            for r in rows:
                f.write(synthesis.log_line(stamp[:10], r.title))
        bad = {r.path: r.error for r in made.where("note IS NULL").select("path", "error").collect()}
        seen = {r.path for r in rows} | set(bad)
        errors = [(p, bad.get(f"raw/{p}", "no such page")) for p in taken if f"raw/{p}" in bad or f"raw/{p}" not in seen]
        ok = self.spark.createDataFrame([(r.path.removeprefix("raw/"),) for r in rows], "path string")
        q = queue.done(self.table("queue"), ok)
        self._save(queue=queue.failed(q, self.spark.createDataFrame(errors, "path string, error string"), now))
        self.reindex()
        return [r.dest for r in rows], len(errors)

    def work(self, llm: synthesis.Llm, workers: int = 3, wait: float = 5.0, rounds: int | None = None, sleep=time.sleep) -> None:
        """Follows the queue: what a stopped process left in work is taken up again, then the queue is emptied again and again."""
        self._save(queue=queue.recover_stale(self.table("queue"), int(self.now())))
        while rounds is None or rounds > 0:
            self.distil(llm, workers=workers, incremental=True)
            rounds = None if rounds is None else rounds - 1
            if rounds != 0:
                sleep(wait)

    def synthesize(self, llm: synthesis.Llm, topic: str = "", full: bool = False) -> int:
        """Plans pages from the notes of a topic if any of them changed, and has each written. Returns how many were."""
        notes = synthesis.with_hash(synthesis.topic_filter(synthesis.source_notes(self.table("pages")), topic))
        if not full and synthesis.new_or_changed(notes, self.table("state")).isEmpty():
            return 0
        return self.synthesize_notes(llm, notes, topic)

    def synthesize_note(self, llm: synthesis.Llm, path: str) -> int:
        """A note and the notes that share a tag with it, worked into pages. A page that fails leaves the others."""
        notes = synthesis.source_notes(self.table("pages"))
        seed = self.spark.createDataFrame([(path,)], "path string")
        near = notes.join(synthesis.tag_overlap(notes, seeds=seed).select("path"), "path", "left_semi")
        return 0 if near.isEmpty() else self.synthesize_notes(llm, synthesis.with_hash(near), "", best_effort=True)

    @_one_at_a_time
    def synthesize_notes(self, llm: synthesis.Llm, notes: DataFrame, topic: str, best_effort: bool = False) -> int:
        pages = self.table("pages")
        notes = materialise(notes, "notes")
        titles = [r.title for r in kb_files.existing_titles(pages).orderBy("title").toLocalIterator()]
        answer = llm(prompts.PLAN, synthesis.plan_prompt(notes, titles, topic))
        plans = synthesis.safe_plans(synthesis.viable(synthesis.plans_of(self.spark.createDataFrame([(answer,)], "answer string"))))
        have = pages.select("id", "content").unionByName(self.drafts())
        n = 0
        for p in synthesis.routed(plans, have).orderBy("dest").toLocalIterator():
            try:
                self._write_page(llm, p)
                n += 1
            except Exception:
                if not best_effort:
                    raise
        for r in synthesis.graduates(self.drafts()).toLocalIterator():
            Path(self.root, r.id).rename(Path(self.root, r.dest))
        self._save(state=synthesis.recorded(self.table("state"), notes))
        self.reindex()
        return n

    def _write_page(self, llm: synthesis.Llm, p) -> None:
        """One planned page, from its notes and from what it says already. Its sources are those it had and the plan's; the count goes up by the new ones."""
        at = Path(self.root, p.dest)
        old = at.read_text() if at.exists() else ""
        rows = self.table("pages").where(F.col("id").isin(*p.sources)).select("id", "content").collect()  # a plan's few sources
        texts = {r.id: r.content or "" for r in rows}
        asked = prompts.page_prompt(p.step, p.type, p.title or "", p.description or "", old, [(s, texts[s]) for s in p.sources if s in texts])
        answer = unfenced(llm(prompts.for_kind(self.root, prompts.PAGE, p.type), asked))
        had = sources_of(old)
        sources = list(dict.fromkeys([*had, *p.sources]))
        both = self.spark.createDataFrame([(old, set_sources(answer, sources))], "old string, new string")
        fresh = F.regexp_replace("new", r"(?m)^source_count:.*\n", "")
        text = both.select(with_source_count(fresh, source_count(F.col("old")) + len(set(sources) - set(had)))).first()[0]
        at.parent.mkdir(parents=True, exist_ok=True)
        part = at.with_name(f".{at.name}")
        part.write_text(text)
        part.replace(at)

    def drafts(self) -> DataFrame:
        """id, content of the wiki's drafts, which are no pages yet. Spark lists no folder that begins with `_` unless it is named."""
        folders = [f"file://{p}" for p in Path(self.root, "wiki").glob("*/_draft") if any(p.iterdir())]
        if not folders:
            return self.spark.createDataFrame([], "id string, content string")
        found = self.spark.read.format("binaryFile").option("pathGlobFilter", "*.md").load(folders)
        return found.select(kb_files.relative(self.root, F.col("path")).alias("id"), F.decode("content", "UTF-8").alias("content"))

    def gaps(self, llm: synthesis.Llm, topic: str) -> str:
        path, report = synthesis.gap_report(synthesis.source_notes(self.table("pages")), topic, llm)
        at = Path(self.root, path)
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(report)
        return path

    def synthesize_each(self, llm: synthesis.Llm, wait: float = 30.0, pause: float = 0.5, sleep=time.sleep) -> int:
        """Every note with its related notes, one after the other; a refusal for too many calls (429) waits and is tried once more."""
        paths = [r.path for r in synthesis.source_notes(self.table("pages")).select("path").orderBy("path").toLocalIterator()]
        n = 0
        for path in paths:
            for attempt in (1, 2):
                try:
                    n += self.synthesize_note(llm, path)
                    break
                except Exception as e:  # noqa: BLE001 - each note is a best effort
                    if "429" not in str(e) or attempt == 2:
                        break
                    sleep(wait)
            sleep(pause)
        return n

    @_reading
    def evaluate(self, questions: list[str]) -> dict:
        """Hit rate and mean reciprocal rank of keyword retrieval for the questions of the first file that is there."""
        asked = kb_files.eval_questions(self.spark, [f"file://{Path(q).absolute()}" for q in questions]).withColumn("item_id", F.monotonically_increasing_id())
        asked = materialise(asked, "questions")
        scored = evaluate.hits(evaluate.keyword_retrieval(self.table("pages"), asked), asked)
        return scored.agg(F.count("*").alias("questions"), F.coalesce(F.avg("hit"), F.lit(0.0)).alias("hit"), F.coalesce(F.avg("rr"), F.lit(0.0)).alias("mrr")).first().asDict()

    # from outside

    @_reading
    def convert(self, convert: Callable[[str, bytes], str | None] | None = None) -> int:
        """Raw files of convertible kinds into Markdown under raw/converted/; returns how many could be. HTML is converted here, other kinds by `convert` (name, bytes), to
        which embedded workbooks are given too. The tasks write the files; their texts never reach the driver."""
        waiting = kb_files.convertible(self._files()).select(F.concat(F.lit("raw/"), "path").alias("id"))
        if waiting.isEmpty():
            return 0
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(f"file://{self.root}/raw")
        files = found.select(kb_files.relative(self.root, F.col("path")).alias("id"), "content").join(waiting, "id", "left_semi")
        dest = lambda c: F.concat(F.lit("raw/converted/"), F.regexp_replace(F.regexp_replace(c, "^raw/", ""), r"\.[^./]*$", ""), F.lit(".md"))
        is_html = F.regexp_like("id", F.lit(r"(?i)\.html$"))
        made = files.where(is_html).select(dest(F.col("id")).alias("path"), connectors.html_text(F.decode("content", "UTF-8")).alias("text"))
        n = connectors.save_texts(made, self.root).count()
        if convert:
            other = connectors.converted(files.where(~is_html), connectors.with_sheets(convert)).where("ok")
            n += connectors.save_texts(other.select(dest(F.col("path")).alias("path"), F.col("markdown").alias("text")), self.root).count()
        return n

    @_reading
    def import_document(self, url: str, runner: str, name: str = "") -> dict:
        """A document with the tables embedded in it: the text with a reference in place of each table, a snapshot of each table, and one data set of their distinct records. `runner` is
        the import path (module:name) of the callable that fetches. Everything is made in a folder of its own, then moved to raw/imported/; only an earlier import is ever replaced."""
        got = connectors.fetch_document(_imported(runner), url)
        text, refs = got["content"], records.table_refs(got["content"])
        title = name or records.document_title(text) or got["document_id"]
        slug = self.spark.range(1).select(import_slug(F.lit(title))).first()[0] or "document"
        target = Path(self.root, IMPORTS, slug)
        if target.exists() and not (target / IMPORT_MARK).exists():
            raise RequestError(f"{IMPORTS}/{slug} is no import; give the document another name")
        stage = Path(self.root, "index/import", f"{slug}-{uuid.uuid4().hex}")
        stage.mkdir(parents=True)
        try:
            (stage / IMPORT_MARK).write_text(json.dumps({"url": url}))
            totals, files = {"total": 0, "unique": 0, "removed": 0}, {}
            if refs:
                order = [t for _, t in refs]
                tables = sorted(connectors.as_tables(materialise(connectors.read_records(self.spark, runner, refs), "imported")), key=lambda x: order.index(x[0]))
                files, shown = records.file_names([t for t, _ in tables]), {}
                for table_id, df in tables:
                    columns = [c for c in df.columns if c != "row"]
                    lines = records.tsv_lines(records.union_tables([(table_id, df)]).orderBy("ordinal"), columns)
                    n = self._write_lines(stage / files[table_id], columns, lines, f"Source URL: {url}\nTable ID: {table_id}\n\n")
                    shown[table_id] = records.render_reference(files[table_id], table_id, columns, n)
                text = records.with_refs_replaced(text, shown)
                all_ = materialise(records.union_tables(tables), "imported-rows")
                column = lambda names: F.col(f"`{c}`") if (c := records.pick_column(all_.columns[:-2], names)) else F.lit("")
                kept = records.deduplicate(records.record_keys(all_, column(records.URL_NAMES), column(records.NICKNAME_NAMES), column(records.TITLE_NAMES)))
                columns = all_.columns[:-1]
                rows = kept.join(all_, "ordinal").orderBy("position")
                self._write_lines(stage / f"{slug}-records.txt", columns, records.tsv_lines(rows, columns), f"Source URL: {url}\n\n")
                totals = records.import_totals(all_, kept).first().asDict()
                text += records.render_summary(f"{slug}-records.txt", *totals.values())
            (stage / f"{slug}.md").write_text(records.render_document(url, got["document_id"], got["revision_id"], text))
            self._publish(stage, target)
        finally:
            shutil.rmtree(stage, ignore_errors=True)
        return {"document_path": f"{IMPORTS}/{slug}/{slug}.md", "table_paths": [f"{IMPORTS}/{slug}/{f}" for f in files.values()], "total_rows": totals["total"], "unique_rows": totals["unique"], "duplicates_removed": totals["removed"]}

    @_one_at_a_time
    def _publish(self, stage: Path, target: Path) -> None:
        """Puts the folder in its place by renaming; an earlier import steps aside first and goes only when the new one is there."""
        target.parent.mkdir(parents=True, exist_ok=True)
        aside = stage.with_name(f"{stage.name}-old")
        if target.exists():
            target.rename(aside)
        try:
            stage.rename(target)
        except OSError:
            if aside.exists():
                aside.rename(target)
            raise
        shutil.rmtree(aside, ignore_errors=True)

    @staticmethod
    def _write_lines(at: Path, columns: list[str], lines: DataFrame, head: str) -> int:
        n = 0
        with at.open("w") as f:
            f.write(head + "\t".join(columns) + "\n")
            for r in lines.toLocalIterator():
                f.write(r.value + "\n")
                n += 1
        return n

    def watch(self, continuous: str | None = None, convert: Callable[[str, bytes], str | None] | None = None):
        """Follows the files: what happened while nobody watched is caught up first; then each batch of changes is converted, indexed (just the files of the batch are read) and put in the queue.
        Without an interval it handles what there is and ends; its checkpoint picks up from there."""

        def handle(batch: DataFrame, _: int) -> None:
            if not batch.where(kb_files.is_convertible(F.col("id"))).isEmpty():
                self.convert(convert)
            self.reindex(batch=batch.select("id", "content", "mtime"))

        self.reindex(catch_up=True)
        changes = watch.changed_files(self.spark, f"file://{self.root}")
        return watch.follow(changes, handle, f"file://{self.root}/index/watch", continuous)


def _imported(path: str):
    """What `module:name` names."""
    import importlib

    module, _, name = path.partition(":")
    return getattr(importlib.import_module(module), name)


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="lorekeep")
    parser.add_argument("--root", default=".")
    parser.add_argument("--settings", default="", help="file of the model's address, token and name, and of the server's")
    sub = parser.add_subparsers(dest="command", required=True)
    for name in ("status", "files", "serve", "stdio", "watch", "convert"):
        sub.add_parser(name)
    for name in ("search", "context"):
        p = sub.add_parser(name)
        p.add_argument("query")
        p.add_argument("--limit", type=int, default=10)
    sub.add_parser("index").add_argument("--full", action="store_true")
    sub.add_parser("lint").add_argument("--strict", action="store_true")
    sub.add_parser("orphans").add_argument("--delete", action="store_true")
    sub.add_parser("init").add_argument("--force", action="store_true")
    p = sub.add_parser("import")
    p.add_argument("url")
    p.add_argument("--runner", default="", help="module:name of the callable that fetches, instead of the settings'")
    p.add_argument("--name", default="")
    sub.add_parser("evaluate").add_argument("questions", nargs="+", help="files of questions; the first that is there counts")
    for name in ("distil", "synthesize", "work"):
        sub.add_parser(name).add_argument("--model", default="", help="module:name of a callable instead of the settings' model")
    p = sub.choices["synthesize"]
    p.add_argument("--topic", default="")
    for flag in ("--full", "--gaps", "--incremental-all"):
        p.add_argument(flag, action="store_true")
    a = parser.parse_args(argv)
    if a.command == "init":
        init(a.root, a.force)
        return 0
    from . import service, tools
    from .sources.model_client import HttpModel

    settings = service.Settings.load(a.settings)
    spark = SparkSession.builder.appName("lorekeep").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    kb = KnowledgeBase(spark, a.root)
    model = lambda: _imported(a.model) if a.model else HttpModel(settings.llm_base, settings.llm_token, settings.llm_model, settings.llm_style)
    converter = connectors.command_converter(shlex.split(settings.convert_command)) if settings.convert_command else None

    def synthesize():
        if a.gaps:
            return {"report": kb.gaps(model(), a.topic)}
        return {"pages": kb.synthesize_each(model()) if a.incremental_all else kb.synthesize(model(), a.topic, a.full)}

    try:
        if a.command == "serve":
            kb.watch("5 seconds", converter)
            if settings.llm_base and settings.workers:
                llm = HttpModel(settings.llm_base, settings.llm_token, settings.llm_model, settings.llm_style)
                threading.Thread(target=kb.work, args=(llm, settings.workers), daemon=True).start()
            service.Service(kb, settings, a.settings).serve().serve_forever()
        if a.command == "stdio":
            tools.serve(kb, sys.stdin, lambda line: (sys.stdout.write(line), sys.stdout.flush()))
            return 0
        out = {
            "status": kb.status, "files": kb.files, "search": lambda: kb.search(a.query, limit=a.limit), "context": lambda: kb.context(a.query, a.limit),
            "index": lambda: {"written": kb.reindex(a.full)}, "lint": lambda: kb.lint(a.strict), "orphans": lambda: kb.purge_orphans(a.delete), "import": lambda: kb.import_document(a.url, a.runner or settings.import_runner, a.name),
            "distil": lambda: kb.distil(model(), workers=settings.workers, incremental=True), "synthesize": synthesize, "watch": lambda: kb.watch("5 seconds", converter).awaitTermination(),
            "work": lambda: kb.work(model(), settings.workers), "convert": lambda: {"converted": kb.convert(converter)}, "evaluate": lambda: kb.evaluate(a.questions),
        }[a.command]()
    except RequestError as e:
        print(e, file=sys.stderr)
        return 1
    print(json.dumps(out, ensure_ascii=False, default=str, indent=1))
    return 0


if __name__ == "__main__":
    sys.exit(main())
