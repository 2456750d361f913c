"""Turning files into the tables of the knowledge base, all at once or only what changed."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as tx
from ..session import materialise

RELATIONS = (("sources", "cites"), ("contradicts", "contradicts"), ("supersedes", "supersedes"), ("supports", "supports"), ("related_to", "related_to"))
PAGE_COLUMNS = ["id", "path", "layer", "kind", "title", "description", "content", "content_hash", "source_uri", "updated_at", "authority", "doc_timestamp"]


def parse(files: DataFrame) -> DataFrame:
    """id, content (and mtime, layer if there) with `header`, the struct of the front matter. A null content has no header."""
    return files.withColumn("header", fm.header_fields(fm.header_of(F.col("content"))))


def pages_of(parsed: DataFrame, as_of: int) -> DataFrame:
    """The rows of the page table. The title falls back on the file name, the timestamp on the file's time."""
    mtime = F.col("mtime") if "mtime" in parsed.columns else F.lit(0).cast("bigint")
    title = F.when(F.col("header.title") != "", F.col("header.title")).otherwise(tx.plain_title(F.col("id")))
    stamp = F.when(F.col("header.timestamp") != 0, F.col("header.timestamp")).otherwise(mtime)
    return parsed.select(
        "id", F.col("id").alias("path"), tx.layer(F.col("id")).alias("layer"), F.col("header.kind").alias("kind"), title.alias("title"),
        F.col("header.description").alias("description"), "content", tx.content_hash(F.col("content")).alias("content_hash"), F.lit(None).cast("string").alias("source_uri"),
        F.lit(as_of).cast("bigint").alias("updated_at"), F.col("header.authority").alias("authority"), stamp.alias("doc_timestamp"),
    )


def links_of(parsed: DataFrame) -> DataFrame:
    """source_doc_id, target_doc_id, relation, confidence: every relation a page states, with repeats. Wikilinks lead to slugs."""
    one = lambda targets, relation, confidence: F.transform(
        targets, lambda t: F.struct(t.alias("target_doc_id"), F.lit(relation).alias("relation"), F.lit(confidence).alias("confidence"))
    )
    slugs = F.transform(fm.wikilinks(fm.body_of(F.col("content"))), lambda t: F.lower(F.replace(t, F.lit(" "), F.lit("-"))))
    lists = [one(F.col(f"header.{f}"), r, 1.0) for f, r in RELATIONS] + [one(slugs, "wikilink", 0.9)]
    return parsed.select(F.col("id").alias("source_doc_id"), F.inline(F.concat(*lists)))


def tags_of(parsed: DataFrame) -> DataFrame:
    """doc_id, tag, source: the entities named in the key claims, normalised, without noise, each once."""
    names = F.flatten(F.transform("header.key_claims", tx.entity_names))
    tags = parsed.select(F.col("id").alias("doc_id"), F.explode(F.array_distinct(F.transform(names, tx.normal_tag))).alias("tag"))
    return tags.where(~tx.noisy_tag(F.col("tag"))).withColumn("source", F.lit("claim"))


def changed(current: DataFrame, scanned: DataFrame, force: bool = False) -> DataFrame:
    """The scanned files (id, content …) that are new or whose hash differs from the page table's; all of them if forced."""
    if force:
        return scanned
    have = current.select("id", F.col("content_hash").alias("_had"))
    return scanned.join(have, "id", "left").where(~F.col("_had").eqNullSafe(tx.content_hash(F.col("content")))).drop("_had")


def upsert(current: DataFrame, new: DataFrame, key: str = "id") -> DataFrame:
    """The current rows with those of `new` put in place of rows of the same key."""
    return current.join(new.select(key).distinct(), key, "left_anti").select(new.columns).unionByName(new)


def replace_by(current: DataFrame, new: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows of links or tags with all rows of the given ids (their column `id`) replaced by the new ones."""
    kept = current.join(ids.select(F.col("id").alias(column)).distinct(), column, "left_anti")
    return kept.select(new.columns).unionByName(new)


def purge(pages: DataFrame, links: DataFrame, tags: DataFrame, current_ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """(pages, links, tags, purged): pages whose files are gone leave, with their tags and the links at either end. Links to what never was a page stay."""
    gone = pages.select("id").join(current_ids.select("id"), "id", "left_anti")
    without = lambda df, c: df.join(gone.select(F.col("id").alias(c)), c, "left_anti")
    links_left = without(without(links, "source_doc_id"), "target_doc_id")
    return without(pages, "id"), links_left, without(tags, "doc_id"), gone


def index_run(pages: DataFrame, links: DataFrame, tags: DataFrame, scanned: DataFrame, as_of: int, force: bool = False, current_ids: DataFrame | None = None) -> dict[str, DataFrame]:
    """One run over the scanned files: pages, links and tags as they are afterwards, and the ids `written` and `purged`. Files that changed are read and parsed once, into a
    table. current_ids are all files there are, where only some of them were scanned."""
    new = materialise(parse(changed(pages, scanned, force)), "changed-files")
    ids = new.select("id")
    pages, links, tags, gone = purge(pages, links, tags, scanned if current_ids is None else current_ids)
    return {
        "pages": upsert(pages.select(PAGE_COLUMNS), pages_of(new, as_of)),
        "links": replace_by(links, links_of(new), "source_doc_id", ids),
        "tags": replace_by(tags, tags_of(new), "doc_id", ids),
        "written": ids,
        "purged": gone,
    }


def migrated(df: DataFrame, defaults: dict[str, object]) -> DataFrame:
    """Older tables with the columns they lack, each a (type, default) pair."""
    missing = {c: v for c, v in defaults.items() if c not in df.columns}
    return reduce(lambda d, c: d.withColumn(c, F.lit(missing[c][1]).cast(missing[c][0])), missing, df)


def with_source(text: str, url: str) -> str:
    """A document with the comment that keeps its address."""
    return f"<!-- source: {url} -->\n\n{text}" if url else text


def valid_name(name: str) -> str:
    """The file name of a document to add, below raw/; blank names and ways out of the folder are refused."""
    name = name.strip().replace("\\", "/").lstrip("/")
    if not name or ".." in name:
        raise ValueError(f"not a file name: {name!r}")
    return name
