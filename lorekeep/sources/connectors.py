"""Documents and tables fetched from outside through a runner, and files converted to Markdown.

A runner is a picklable callable that takes a request (a dict) and returns the response (a dict), so tests need no network."""

from __future__ import annotations

import html
import io
import json
import re
import uuid
import zipfile
from collections.abc import Callable, Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

Runner = Callable[[dict], dict]
PAGE_ROWS = 200


def fetch_document(runner: Runner, url: str) -> dict:
    """content, document_id, revision_id of a document."""
    got = runner({"kind": "document", "url": url})
    if not got.get("ok", True):
        raise RuntimeError(f"{url}: {got.get('error', 'not fetched')}")
    data = got.get("data", got)
    return {"content": data.get("content", ""), "document_id": data.get("document_id", ""), "revision_id": int(data.get("revision_id") or 0)}


def record_pages(runner: Runner, token: str, table: str, size: int = PAGE_ROWS) -> Iterator[tuple[list[str], list[list]]]:
    """(fields, rows) page after page, until the source says there is no more or a page is empty; the first page fixes the fields."""
    offset, fields = 0, None
    while True:
        got = runner({"kind": "records", "token": token, "table": table, "offset": offset, "limit": size})
        if not got.get("ok", True):
            raise RuntimeError(f"{table}: {got.get('error', 'not fetched')}")
        data = got["data"]
        fields = fields if fields is not None else data["fields"]
        rows = data["data"]
        if rows:
            yield fields, rows
        if not rows or not data.get("has_more"):
            return
        offset += len(rows)


class RecordsSource(DataSource):
    """Spark source `records`: rows of outside tables as JSON cells. Options: runner (import path `module:name`), tables (JSON list of [token, table])."""

    @classmethod
    def name(cls):
        return "records"

    def schema(self):
        return "table string, row bigint, fields array<string>, cells array<string>"

    def reader(self, schema):
        return _Reader(self.options)


class _Table(InputPartition):
    def __init__(self, token: str, table: str):
        super().__init__(None)
        self.token, self.table = token, table


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.runner, self.tables = options["runner"], json.loads(options["tables"])

    def partitions(self):
        return [_Table(*t) for t in self.tables]

    def read(self, partition):
        import importlib

        module, _, name = self.runner.partition(":")
        n = 0
        for fields, rows in record_pages(getattr(importlib.import_module(module), name), partition.token, partition.table):
            for row in rows:
                cells = [None if c is None else c if isinstance(c, str) else json.dumps(c, ensure_ascii=False, separators=(",", ":")) for c in row]
                yield partition.table, n, fields, cells
                n += 1


def read_records(spark: SparkSession, runner: str, tables: list[tuple[str, str]]) -> DataFrame:
    spark.dataSource.register(RecordsSource)
    return spark.read.format("records").option("runner", runner).option("tables", json.dumps(tables)).load()


def as_tables(records: DataFrame) -> list[tuple[str, DataFrame]]:
    """(table, rows with its fields as columns and `row`) of each outside table. The list of tables and their fields is small: one row each."""
    shapes = records.groupBy("table").agg(F.first("fields").alias("fields")).orderBy("table").collect()
    of = lambda t, fields: records.where(F.col("table") == t).select(*[F.get("cells", F.lit(i)).alias(f) for i, f in enumerate(fields)], "row")
    return [(s.table, of(s.table, s.fields)) for s in shapes]


def html_text(page):
    """An HTML page as Markdown-like text: headings, items and paragraphs on lines of their own, links and images kept, scripts and styles dropped, entities read."""
    t = F.regexp_replace(page, r"(?is)<(script|style|head|noscript)\b.*?</\1\s*>|<!--.*?-->", "")
    for n in range(1, 7):
        t = F.regexp_replace(t, rf"(?is)<h{n}\b[^>]*>\s*(.*?)\s*</h{n}\s*>", "\n\n" + "#" * n + " $1\n\n")
    t = F.regexp_replace(t, r"(?is)<li\b[^>]*>\s*", "\n- ")
    t = F.regexp_replace(t, r"(?is)<img\b[^>]*\bsrc=\"([^\"]*)\"[^>]*>", "![]($1)")
    t = F.regexp_replace(t, r"(?is)<a\b[^>]*\bhref=\"([^\"]*)\"[^>]*>(.*?)</a\s*>", "[$2]($1)")
    t = F.regexp_replace(t, r"(?i)<br\s*/?>|</(p|div|tr|ul|ol|table|section)\s*>", "\n\n")
    t = F.regexp_replace(t, r"(?s)<[^>]*>", "")
    t = F.arrow_udf(lambda a: pa.array([None if x is None else html.unescape(x) for x in a.to_pylist()], pa.string()), "string")(t)
    t = F.regexp_replace(F.regexp_replace(t, r"[ \t]+\n", "\n"), r"\n{3,}", "\n\n")
    return F.regexp_replace(t, r"^\s+|\s+$", "")


def html_title(page):
    return F.trim(F.regexp_extract(page, r"(?is)<title\b[^>]*>(.*?)</title\s*>", 1))


def inject_sheets(markdown: str, archive: bytes, convert: Callable[[bytes], str]) -> str:
    """Each embedded workbook of an office file, converted, in place of the first embedded image that is still there; NaN cells blank, escaped underscores plain."""
    try:
        names = sorted(n for n in zipfile.ZipFile(io.BytesIO(archive)).namelist() if re.search(r"embeddings/[^/]*\.xlsx$", n))
    except zipfile.BadZipFile:
        return markdown
    for name in names:
        sheet = convert(zipfile.ZipFile(io.BytesIO(archive)).read(name))
        sheet = re.sub(r"\|\s*NaN\s*(?=\|)", "|  ", sheet).replace("\\_", "_")
        markdown = re.sub(r"!\[[^\]]*\]\(data:image/[^)]*\)", lambda _: sheet, markdown, count=1)  # noqa: B023
    return markdown


def converted(files: DataFrame, convert: Callable[[str, bytes], str | None]) -> DataFrame:
    """path, markdown, ok of binary files (id, content): `convert` gets a file's name and bytes; a failure is that file's alone. Files go to tasks in batches of bytes, not rows, through the scan's splits."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for path, data in zip(b.column(0), b.column(1), strict=True):
                try:
                    out.append(convert(path.as_py(), data.as_py()))
                except Exception:  # noqa: BLE001 - a file that can't be converted must not end the others
                    out.append(None)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.string()), pa.array([x is not None for x in out], pa.bool_())], ["path", "markdown", "ok"])

    return files.select("id", "content").mapInArrow(run, "path string, markdown string, ok boolean")


def with_sheets(convert: Callable[[str, bytes], str | None]) -> Callable[[str, bytes], str | None]:
    """A converter that puts the workbooks embedded in office files into what it makes of them."""

    def both(name: str, data: bytes) -> str | None:
        made = convert(name, data)
        if made is None or not data.startswith(b"PK"):
            return made
        return inject_sheets(made, data, lambda sheet: convert("sheet.xlsx", sheet) or "")

    return both


def save_texts(files: DataFrame, root: str) -> DataFrame:
    """path of each file (path below the root, text), written by the task that has it, whole or not at all; writing it again changes nothing. The root is a folder that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, text in zip(b.column(0), b.column(1), strict=True):
                at = Path(root, path.as_py())
                at.parent.mkdir(parents=True, exist_ok=True)
                part = at.with_name(f".{at.name}.{uuid.uuid4().hex}")
                part.write_text(text.as_py())
                part.replace(at)
            yield pa.RecordBatch.from_arrays([b.column(0)], ["path"])

    return files.select("path", "text").mapInArrow(run, "path string")


def command_converter(command: list[str], seconds: int = 120) -> Callable[[str, bytes], str | None]:
    """A converter that gives a file to an outside command and reads Markdown from its output."""
    import subprocess

    def convert(_: str, data: bytes) -> str | None:
        done = subprocess.run(command, input=data, capture_output=True, timeout=seconds)
        return done.stdout.decode("utf-8", "replace") if done.returncode == 0 else None

    return convert
