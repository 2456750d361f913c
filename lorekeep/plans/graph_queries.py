"""Queries on links and tags, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph
from ..operators.search import graph_boost as boost
from ..session import table

LIMIT, RELATED, BY_TAG, MERGED = 50, 3, 5, 8


def _tables(spark, sf_dir):
    return tuple(table(spark, sf_dir, t) for t in ("kb_documents", "links", "document_tags"))


def _decisions(pages):
    return pages.where("kind = 'decision'").select("id")


def graph_boost(spark, sf_dir):
    return boost(table(spark, sf_dir, "links"))


def graph_expand(spark, sf_dir):
    pages, links, _ = _tables(spark, sf_dir)
    return graph.expand(_decisions(pages), links, pages, LIMIT)


def fetch_related_batch(spark, sf_dir):
    pages, links, _ = _tables(spark, sf_dir)
    return graph.related(links, pages, RELATED)


def tag_document_frequency(spark, sf_dir):
    return graph.tag_pages(table(spark, sf_dir, "document_tags"))


def tag_expand_1hop(spark, sf_dir):
    pages, _, tags = _tables(spark, sf_dir)
    return graph.tag_expand(_decisions(pages), tags, pages, 1, LIMIT)


def tag_expand_2hop(spark, sf_dir):
    pages, _, tags = _tables(spark, sf_dir)
    return graph.tag_expand(_decisions(pages), tags, pages, 2, LIMIT)


def tag_related_batch(spark, sf_dir):
    pages, _, tags = _tables(spark, sf_dir)
    return graph.tag_related(tags, pages, BY_TAG)


def merge_related(spark, sf_dir):
    pages, links, tags = _tables(spark, sf_dir)
    return graph.merge_related([graph.related(links, pages, RELATED), graph.tag_related(tags, pages, BY_TAG)], MERGED)


def conflict_links(spark, sf_dir):
    pages, links, _ = _tables(spark, sf_dir)
    return graph.conflicts(links, _decisions(pages))


def cited_sources(spark, sf_dir):
    pages, links, _ = _tables(spark, sf_dir)
    return graph.cited_sources(pages.where("layer = 'wiki'").select("id"), links, pages)


def resolved_wikilink_boost(spark, sf_dir):
    from ..functions.text import slug

    pages, links, _ = _tables(spark, sf_dir)
    return boost(graph.resolved_wikilinks(links, pages, slug(F.col("id"))))


ADJACENCY = """
WITH adjacency AS (
  SELECT source_doc_id AS seed, target_doc_id AS id FROM links WHERE relation IN ('cites', 'supports', 'wikilink', 'related_to')
  UNION SELECT target_doc_id, source_doc_id FROM links WHERE relation IN ('supports', 'wikilink')),
seeds AS (SELECT id FROM kb_documents WHERE kind = 'decision'),
page AS (SELECT id, path, layer, coalesce(kind, '') AS kind, coalesce(title, '') AS title FROM kb_documents)
"""
_TAGS = """,
most AS (SELECT greatest(5, count(*) // 20) AS n FROM kb_documents),
rare AS (SELECT DISTINCT tag, doc_id FROM document_tags WHERE tag IN (
  SELECT tag FROM document_tags GROUP BY tag HAVING count(DISTINCT doc_id) <= (SELECT n FROM most)))
"""
_RELATED = f""",
related AS (SELECT * FROM (SELECT a.seed, p.id, p.kind, p.title, row_number() OVER (PARTITION BY seed ORDER BY kind, title, p.id)::INT AS place
  FROM adjacency a JOIN page p ON a.id = p.id WHERE p.layer = 'wiki' AND a.seed <> p.id) WHERE place <= {RELATED})
"""
_BY_TAG = f""",
by_tag AS (SELECT * FROM (SELECT seed, id, kind, title, row_number() OVER (PARTITION BY seed ORDER BY title, id)::INT AS place FROM (
  SELECT DISTINCT a.doc_id AS seed, p.id, p.kind, p.title FROM rare a JOIN rare b ON a.tag = b.tag AND a.doc_id <> b.doc_id JOIN page p ON p.id = b.doc_id))
  WHERE place <= {BY_TAG})
"""
_HOP1 = """,
hop1 AS (SELECT DISTINCT b.doc_id FROM rare a JOIN rare b ON a.tag = b.tag WHERE a.doc_id IN (FROM seeds) AND b.doc_id NOT IN (FROM seeds))
"""
MERGED_SQL = _TAGS + _RELATED + _BY_TAG + f""",
both_lists AS (SELECT 0 AS l, * FROM related UNION ALL SELECT 1, * FROM by_tag),
once AS (SELECT * FROM both_lists QUALIFY row_number() OVER (PARTITION BY seed, id ORDER BY l, place) = 1),
merged AS (SELECT seed, id, kind, title, row_number() OVER (PARTITION BY seed ORDER BY l, place)::INT AS place FROM once QUALIFY row_number() OVER (PARTITION BY seed ORDER BY l, place) <= {MERGED})
"""
_BOOST = """SELECT target_doc_id AS doc_id, count(*) AS n_inbound, least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) AS graph_boost FROM {} WHERE target_doc_id IS NOT NULL GROUP BY 1"""

QUERIES = {
    f.__name__: f
    for f in (graph_boost, graph_expand, fetch_related_batch, tag_document_frequency, tag_expand_1hop, tag_expand_2hop, tag_related_batch, merge_related, conflict_links, cited_sources, resolved_wikilink_boost)
}
SQL = {
    "graph_boost": _BOOST.format("links"),
    "graph_expand": ADJACENCY + f"SELECT * FROM page WHERE id IN (SELECT a.id FROM adjacency a JOIN seeds s ON a.seed = s.id) AND id NOT IN (FROM seeds) ORDER BY title, id LIMIT {LIMIT}",
    "fetch_related_batch": ADJACENCY + _RELATED + "SELECT * FROM related",
    "tag_document_frequency": "SELECT tag, count(DISTINCT doc_id) AS n_docs FROM document_tags WHERE tag IS NOT NULL GROUP BY tag",
    "tag_expand_1hop": ADJACENCY + _TAGS + _HOP1 + f"SELECT * FROM page WHERE id IN (FROM hop1) ORDER BY title, id LIMIT {LIMIT}",
    "tag_expand_2hop": ADJACENCY + _TAGS + _HOP1
    + f""", hop2 AS (SELECT DISTINCT b.doc_id FROM rare a JOIN rare b ON a.tag = b.tag WHERE a.doc_id IN (FROM hop1) AND b.doc_id NOT IN (FROM seeds))
SELECT * FROM page WHERE id IN (FROM hop1 UNION FROM hop2) ORDER BY title, id LIMIT {LIMIT}""",
    "tag_related_batch": ADJACENCY + _TAGS + _BY_TAG + "SELECT * FROM by_tag",
    "merge_related": ADJACENCY + MERGED_SQL + "SELECT * FROM merged",
    "conflict_links": """SELECT DISTINCT source_doc_id AS source_id, target_doc_id AS target_id, relation FROM links WHERE relation IN ('contradicts', 'supersedes')
  AND (source_doc_id IN (SELECT id FROM kb_documents WHERE kind = 'decision') OR target_doc_id IN (SELECT id FROM kb_documents WHERE kind = 'decision'))""",
    "cited_sources": """SELECT id, path, coalesce(title, '') AS title FROM kb_documents WHERE layer = 'raw' AND id IN (
  SELECT target_doc_id FROM links WHERE relation = 'cites' AND source_doc_id IN (SELECT id FROM kb_documents WHERE layer = 'wiki'))""",
    "resolved_wikilink_boost": r"""WITH names AS (SELECT replace(lower(regexp_replace(regexp_extract(id, '[^/]*$'), '\.md$', '')), ' ', '-') AS s, min(id) AS page_id FROM kb_documents GROUP BY 1),
resolved AS (SELECT CASE WHEN relation = 'wikilink' THEN coalesce(page_id, target_doc_id) ELSE target_doc_id END AS target_doc_id FROM links LEFT JOIN names ON s = target_doc_id)
""" + _BOOST.format("resolved"),
}
