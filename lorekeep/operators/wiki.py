"""Index pages, page fetch, lint and status."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..sources.kb_files import RESERVED

REQUIRED = ("title", "type", "sources", "timestamp")
CHECKED = ("related_to", "supports", "contradicts")
KINDS = ("source-note", "concept", "comparison", "decision")
MOST_PAGES, PAGE_BYTES = 5, 5000


def _listed(pages: DataFrame) -> DataFrame:
    keep = F.regexp_like("id", F.lit(r"(?i)^wiki/.*\.md$")) & ~tx.file_name(F.col("id")).isin(*RESERVED)
    return pages.where(keep)


def index_entries(pages: DataFrame) -> DataFrame:
    """dir, file, line: the line of each wiki page in its folder's index page."""
    title = F.when(F.coalesce("title", F.lit("")) != "", F.col("title")).otherwise(tx.display_title(F.col("id")))
    described = F.when(F.coalesce("description", F.lit("")) != "", F.concat(F.lit(" — "), "description")).otherwise("")
    file = tx.file_name(F.col("id"))
    line = F.concat(F.lit("* ["), title, F.lit("]("), file, F.lit(")"), described)
    return _listed(pages).select(F.regexp_replace("id", "/[^/]*$", "").alias("dir"), file.alias("file"), line.alias("line"))


#: The head of the root's index page and its line for a folder.
ROOT_HEAD, FOLDER_LINE = '---\nokf_version: "0.1"\n---\n\n# wiki\n\n', "* [{0}]({0}/) — {1} page(s)\n"


def index_texts(pages: DataFrame) -> Iterator[tuple[str, str]]:
    """(path, text) in pieces, in order, of the index page of every wiki folder: a head, then a line at a time, so no folder's list is ever held. The root lists its folders with their page counts."""
    now = None
    for r in index_entries(pages).where("dir <> 'wiki'").orderBy("dir", "file").toLocalIterator():
        path = f"{r.dir}/index.md"
        if path != now:
            now = path
            yield path, f"# {r.dir.rsplit('/', 1)[-1]}\n\n"
        yield path, r.line + "\n"
    yield "wiki/index.md", ROOT_HEAD
    for r in folder_counts(pages).orderBy("folder").toLocalIterator():
        yield "wiki/index.md", FOLDER_LINE.format(r.folder, r.n_pages)


def folder_counts(pages: DataFrame) -> DataFrame:
    """folder, n_pages of the wiki's folders, with what lies below them."""
    deep = _listed(pages).where(F.regexp_like("id", F.lit("^wiki/[^/]+/")))
    return deep.groupBy(F.split("id", "/")[1].alias("folder")).agg(F.count("*").alias("n_pages"))


def fetch(pages: DataFrame, ids: list[str], full: bool = False) -> DataFrame:
    """id, path, title, kind, content, truncated, unsupported, place of the pages asked for, in the order asked. Contents end at PAGE_BYTES bytes unless one page
    is asked for in full; what is no Markdown comes without content; ids that aren't there are left out."""
    if not 1 <= len(ids) <= MOST_PAGES:
        raise ValueError(f"one to {MOST_PAGES} ids")
    whole = full and len(ids) == 1
    found = pages.where(F.col("id").isin(*ids))
    markdown = F.regexp_like("path", F.lit(r"\.md$"))
    content = F.coalesce("content", F.lit(""))
    shown = content if whole else tx.truncated(content, PAGE_BYTES)
    place = F.array_position(F.array(*map(F.lit, ids)), F.col("id")).cast("int")
    return found.select(
        "id", "path", F.coalesce("title", F.lit("")).alias("title"), F.coalesce("kind", F.lit("")).alias("kind"), F.when(markdown, shown).otherwise("").alias("content"),
        (markdown & F.lit(not whole) & (F.octet_length(content) > PAGE_BYTES)).alias("truncated"), (~markdown).alias("unsupported"), place.alias("place"),
    )


def missing_fields(parsed: DataFrame) -> DataFrame:
    """path, kind, detail: every required field that a wiki page's front matter lacks or leaves blank; an explicit empty list is there. Drafts are not checked."""
    checked = _listed(parsed).where(~F.contains("id", F.lit("/_draft/")))
    raw = lambda f: F.try_element_at("header.raw", F.lit(f))
    absent = [F.when(raw(f).isNull() | (raw(f)["items"].isNull() & (tx.trim_any(F.coalesce(raw(f)["text"], F.lit(""))) == "")), F.lit(f)) for f in REQUIRED]
    names = F.filter(F.array(*absent), lambda x: x.isNotNull())
    return checked.select(F.col("id").alias("path"), F.lit("missing_field").alias("kind"), F.explode(names).alias("detail"))


def broken_sources(parsed: DataFrame, ids: DataFrame) -> DataFrame:
    """path, kind, detail: sources of wiki pages that are no file (ids: all files, of any kind)."""
    named = _listed(parsed).where(~F.contains("id", F.lit("/_draft/"))).select(F.col("id").alias("path"), F.explode_outer("header.sources").alias("detail"))  # outer: no filter is inferred that would parse twice
    named = named.withColumn("detail", tx.trim_any(F.col("detail"))).where("detail <> ''")
    lost = named.join(ids.select(F.col("id").alias("detail")), "detail", "left_anti")
    return lost.select("path", F.lit("broken_source").alias("kind"), "detail")


def broken_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The checked relations whose target is no page, with link_type: placeholder (blank, `#…`, `[…`), path or concept."""
    target = F.col("target_doc_id")
    kind = F.when((F.trim(target) == "") | target.startswith("#") | target.startswith("["), "placeholder").when(F.contains(target, F.lit("/")), "path").otherwise("concept")
    checked = links.where(F.col("relation").isin(*CHECKED))
    return checked.join(pages.select(F.col("id").alias("target_doc_id")), "target_doc_id", "left_anti").withColumn("link_type", kind)


def link_warnings(broken: DataFrame) -> DataFrame:
    kind = F.when(F.col("link_type") == "path", "broken_related").otherwise("missing_concept")
    return broken.where("link_type <> 'placeholder'").select(F.col("source_doc_id").alias("path"), kind.alias("kind"), F.col("target_doc_id").alias("detail"))


def red_links(broken: DataFrame) -> DataFrame:
    """concept, n: missing concepts and how often pages name them."""
    return broken.where("link_type = 'concept'").groupBy(F.col("target_doc_id").alias("concept")).agg(F.count("*").alias("n"))


def red_link_references(broken: DataFrame) -> DataFrame:
    """concept, referenced_by, n: the pages that name each missing concept, a row for each, so that a concept of very many pages gathers them nowhere."""
    concepts = broken.where("link_type = 'concept'")
    return concepts.groupBy(F.col("target_doc_id").alias("concept"), F.col("source_doc_id").alias("referenced_by")).agg(F.count("*").alias("n"))


def red_link_records(broken: DataFrame) -> Iterator[dict]:
    """concept, count, referenced_by (repeats kept, in order) of each missing concept, the most named first; one record at a time."""
    total = red_links(broken).withColumnRenamed("n", "total")
    rows = red_link_references(broken).join(total, "concept").orderBy(F.desc("total"), "concept", "referenced_by")
    record: dict | None = None
    for r in rows.toLocalIterator():
        if record is None or record["concept"] != r.concept:
            if record:
                yield record
            record = {"concept": r.concept, "count": r.total, "referenced_by": []}
        record["referenced_by"] += [r.referenced_by] * r.n
    if record:
        yield record


def clean_links(links: DataFrame, pages: DataFrame) -> DataFrame:
    """The links without the broken ones of the checked relations. Null targets of those relations are broken."""
    checked = F.col("relation").isin(*CHECKED)
    good = links.where(checked).join(pages.select(F.col("id").alias("target_doc_id")), "target_doc_id", "left_semi").select(links.columns)
    return links.where(F.coalesce(~checked, F.lit(True))).unionByName(good)


def layer_counts(pages: DataFrame) -> DataFrame:
    """layer, n, and the total in a row of layer null."""
    return pages.rollup("layer").agg(F.count("*").alias("n"))


def zero_filled(counts: DataFrame, key: str, known: tuple[str, ...]) -> DataFrame:
    """Counts by key (columns key, n) with the known keys that don't occur."""
    base = counts.sparkSession.createDataFrame([(k,) for k in known], f"{key} string").withColumn("n", F.lit(0).cast("bigint"))
    return counts.select(key, "n").unionByName(base).groupBy(key).agg(F.sum("n").alias("n"))


def kind_counts(pages: DataFrame) -> DataFrame:
    """kind, n of the wiki pages; a null kind counts as a source note, an empty one as itself."""
    wiki = pages.where("layer = 'wiki'").groupBy(F.coalesce("kind", F.lit("source-note")).alias("kind")).agg(F.count("*").alias("n"))
    return zero_filled(wiki, "kind", KINDS)


def status(pages: DataFrame, queue: DataFrame) -> DataFrame:
    """documents, by_layer, by_kind, queue: one row."""
    from .queue import stats

    as_map = lambda df, k, name: df.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce(k, F.lit("")), "n")))).alias(name))
    layers = pages.groupBy("layer").agg(F.count("*").alias("n"))
    one = layers.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("documents")).withColumn("_", F.lit(1))
    parts = [as_map(layers, "layer", "by_layer"), as_map(kind_counts(pages), "kind", "by_kind"), as_map(stats(queue, ("pending", "processing", "failed", "done")), "status", "queue")]
    for p in parts:
        one = one.join(p.withColumn("_", F.lit(1)), "_")
    return one.drop("_")
