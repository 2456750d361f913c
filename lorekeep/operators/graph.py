"""The graph of typed links and the graph of shared tags.

Seeds are a table with a column `id`, so every operator works on one page, on search results or on all pages. Where a result is
limited per seed, the limit is pushed into the exchange (top rows per seed), so a hub with a tenth of all links sends each
task's few best neighbours only.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialise

OUTBOUND = ("cites", "supports", "wikilink", "related_to")
INBOUND = ("supports", "wikilink")
CONFLICTING = ("contradicts", "supersedes")


def _page() -> list:
    return ["id", "path", "layer", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("title", F.lit("")).alias("title")]


def adjacency(links: DataFrame) -> DataFrame:
    """seed, id: pages reachable over an outbound or inbound relation, each once; null ends lead nowhere."""
    out = links.where(F.col("relation").isin(*OUTBOUND)).select(F.col("source_doc_id").alias("seed"), F.col("target_doc_id").alias("id"))
    back = links.where(F.col("relation").isin(*INBOUND)).select(F.col("target_doc_id").alias("seed"), F.col("source_doc_id").alias("id"))
    return out.unionByName(back).where("seed IS NOT NULL AND id IS NOT NULL")


def expand(seeds: DataFrame, links: DataFrame, pages: DataFrame, limit: int) -> DataFrame:
    """The pages next to any seed, without the seeds: id, path, layer, kind, title, the first `limit` by title, then id."""
    near = adjacency(links).join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi").select("id").distinct()
    near = near.join(seeds.select("id"), "id", "left_anti")
    return pages.select(*_page()).join(near, "id", "left_semi").orderBy("title", "id").limit(limit)


def related(links: DataFrame, pages: DataFrame, limit: int, seeds: DataFrame | None = None) -> DataFrame:
    """seed, id, kind, title, place: for each seed (all pages if none are given) its first `limit` wiki neighbours by kind, title and id."""
    edges = adjacency(links).where("seed <> id")
    if seeds is not None:
        edges = edges.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    wiki = pages.where("layer = 'wiki'").select(*_page()).drop("path", "layer")
    near = edges.distinct().join(wiki, "id")
    place = F.row_number().over(Window.partitionBy("seed").orderBy("kind", "title", "id"))
    return near.withColumn("place", place).where(F.col("place") <= limit).select("seed", "id", "kind", "title", "place")


def most_common(n_pages: int) -> int:
    """A tag of more pages than this connects nothing: a twentieth of all, five at least."""
    return max(5, n_pages // 20)


def tag_pages(tags: DataFrame) -> DataFrame:
    """tag, n_docs: how many distinct pages have each tag."""
    return tags.where("tag IS NOT NULL").select("tag", "doc_id").distinct().groupBy("tag").agg(F.count("doc_id").alias("n_docs"))


def connecting_tags(tags: DataFrame, n_pages: int) -> DataFrame:
    """tag, doc_id (distinct) of the tags rare enough to connect pages. The common ones, which hold most rows, are dropped by the size of their
    group before anything is joined."""
    pairs = tags.where("tag IS NOT NULL AND doc_id IS NOT NULL").select("tag", "doc_id").distinct()
    rare = pairs.groupBy("tag").agg(F.count("*").alias("n_docs")).where(F.col("n_docs") <= most_common(n_pages)).select("tag")  # one exchange makes both distinct
    return pairs.join(rare, "tag", "left_semi")


def tag_expand(seeds: DataFrame, tags: DataFrame, pages: DataFrame, hops: int, limit: int) -> DataFrame:
    """The pages within one or two hops over shared connecting tags, without the seeds; the first `limit` by title, then id."""
    rare = materialise(connecting_tags(tags, pages.count()), "connecting-tags")
    start = seeds.select(F.col("id").alias("doc_id")).distinct()
    found = frontier = start
    for _ in range(hops):
        over = rare.join(frontier, "doc_id", "left_semi").select("tag").distinct()
        frontier = rare.join(over, "tag", "left_semi").select("doc_id").distinct().join(found, "doc_id", "left_anti")
        frontier = materialise(frontier, "hop")
        found = found.unionByName(frontier)
    ids = found.join(start, "doc_id", "left_anti").select(F.col("doc_id").alias("id"))
    return pages.select(*_page()).join(ids, "id", "left_semi").orderBy("title", "id").limit(limit)


def tag_related(tags: DataFrame, pages: DataFrame, limit: int, seeds: DataFrame | None = None) -> DataFrame:
    """seed, id, kind, title, place: for each seed its first `limit` pages by title and id that share a connecting tag.

    Of each tag only the first limit + 1 pages can be among a seed's first `limit` (one may be the seed), so tags are cut
    to those before they are joined with the seeds: the join grows with the rows of tags, not with pairs of pages."""
    rare = connecting_tags(tags, pages.count())
    named = rare.join(pages.select(*_page()).drop("path", "layer"), rare["doc_id"] == F.col("id")).drop("doc_id")
    first = Window.partitionBy("tag").orderBy("title", "id")
    heads = named.withColumn("n", F.row_number().over(first)).where(F.col("n") <= limit + 1).drop("n")
    mine = rare.withColumnRenamed("doc_id", "seed")
    if seeds is not None:
        mine = mine.join(seeds.select(F.col("id").alias("seed")).distinct(), "seed", "left_semi")
    near = mine.join(heads, "tag").where("seed <> id").select("seed", "id", "kind", "title").distinct()
    place = F.row_number().over(Window.partitionBy("seed").orderBy("title", "id"))
    return near.withColumn("place", place).where(F.col("place") <= limit)


def conflicts(links: DataFrame, seeds: DataFrame | None = None) -> DataFrame:
    """source_id, target_id, relation of the contradicts and supersedes links with a seed at either end, each once."""
    all_ = links.where(F.col("relation").isin(*CONFLICTING)).select(F.col("source_doc_id").alias("source_id"), F.col("target_doc_id").alias("target_id"), "relation").distinct()
    if seeds is None:
        return all_
    ids = seeds.select("id").distinct()
    by_source = all_.join(ids, all_["source_id"] == ids["id"], "left_semi")
    by_target = all_.join(ids, all_["target_id"] == ids["id"], "left_semi")
    return by_source.unionByName(by_target).distinct()


def cited_sources(seeds: DataFrame, links: DataFrame, pages: DataFrame) -> DataFrame:
    """id, path, title of the raw pages that any seed cites, each once."""
    cited = links.where("relation = 'cites'").join(seeds.select(F.col("id").alias("source_doc_id")), "source_doc_id", "left_semi")
    raw = pages.where("layer = 'raw'").select("id", "path", F.coalesce("title", F.lit("")).alias("title"))
    return raw.join(cited.select(F.col("target_doc_id").alias("id")), "id", "left_semi")


def merge_related(lists: list[DataFrame], most: int) -> DataFrame:
    """seed, id, kind, title, place: ordered lists one after the other, the first row of an id kept, `most` per seed."""
    numbered = reduce(DataFrame.unionByName, [x.withColumn("list", F.lit(n)) for n, x in enumerate(lists)])
    once = numbered.groupBy("seed", "id").agg(F.min(F.struct("list", "place", "kind", "title")).alias("x"))
    w = Window.partitionBy("seed").orderBy("x.list", "x.place")
    kept = once.withColumn("at", F.row_number().over(w)).where(F.col("at") <= most)
    return kept.select("seed", "id", "x.kind", "x.title", F.col("at").alias("place"))


def related_list(merged: DataFrame) -> DataFrame:
    """seed, related: each seed's neighbours as one array, in order."""
    items = F.sort_array(F.collect_list(F.struct("place", "id", "title", "kind")))
    return merged.groupBy("seed").agg(items.alias("x")).select("seed", F.transform("x", lambda r: F.struct(r["id"].alias("id"), r["title"].alias("title"), r["kind"].alias("kind"))).alias("related"))


def resolved_wikilinks(links: DataFrame, pages: DataFrame, slug: Column) -> DataFrame:
    """links with target_doc_id of wikilinks replaced by the least page id with that slug, where one has it (`slug` is an expression on pages)."""
    names = pages.select(slug.alias("target_doc_id"), "id").groupBy("target_doc_id").agg(F.min("id").alias("page_id"))
    is_wiki = F.coalesce(F.col("relation") == "wikilink", F.lit(False))
    wiki = links.where(is_wiki).join(names, "target_doc_id", "left").withColumn("target_doc_id", F.coalesce("page_id", "target_doc_id"))
    return links.where(~is_wiki).unionByName(wiki.drop("page_id").select(links.columns))
