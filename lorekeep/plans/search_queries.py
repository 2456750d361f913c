"""Search queries over the whole knowledge base, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import graph, postings, search
from ..session import materialise, spread, table
from .graph_queries import ADJACENCY, MERGED_SQL

QUERY, AS_OF = "pipeline, incident 模板，db", 1767225600
LIMIT, SOURCES, SYNTHS = 10, 10, 3


def _tables(spark, sf_dir):
    return table(spark, sf_dir, "kb_documents"), table(spark, sf_dir, "links")


def _rounded(df, *names):
    for n in names:
        df = df.withColumn(n, F.round(n, 9))
    return df


def fts_and(spark, sf_dir):
    """All pages with every long keyword, with their BM25 rank."""
    hits = search.find_hits(_tables(spark, sf_dir)[0], QUERY)
    return _rounded(hits.rows.where(F.col("long_hits") == len(hits.long)).select("id", F.col("rank").alias("fts_rank")), "fts_rank")


def fts_or(spark, sf_dir):
    """All pages with any long keyword, with their BM25 rank, snippet and number of long keywords."""
    hits = search.find_hits(_tables(spark, sf_dir)[0], QUERY)
    return _rounded(hits.rows.where("long_hits > 0").select("id", "long_hits", "snippet", F.col("rank").alias("fts_rank")), "fts_rank")


def like_short(spark, sf_dir):
    """All pages with a short keyword in title or content."""
    hits = search.find_hits(_tables(spark, sf_dir)[0], QUERY)
    return hits.rows.where("short_0 OR short_1").select("id", F.col("short_0").alias("first"), F.col("short_1").alias("second"))


def fts_three_phase(spark, sf_dir):
    return _rounded(search.search(_tables(spark, sf_dir)[0], QUERY, limit=LIMIT).drop("doc_timestamp"), "fts_rank")


def fts_postings(spark, sf_dir):
    """The same search over a search index, which is written first."""
    pages = _tables(spark, sf_dir)[0]
    grams = materialise(postings.sorted_postings(postings.postings_of(spread(pages, "id"), search.INDEXED)), "postings")
    index = postings.SearchIndex(grams, pages.select("id", search.page_length().alias("length")))
    return _rounded(search.search(pages, QUERY, limit=LIMIT, index=index).drop("doc_timestamp"), "fts_rank")


def rrf_multi_kind(spark, sf_dir):
    hits = search.find_hits(_tables(spark, sf_dir)[0], QUERY)
    return _rounded(search.search_kinds(hits, None, None, LIMIT), "rrf").select("id", "kind", "title", "rrf", "lists", "position")


def rrf_strict_layer(spark, sf_dir):
    hits = search.find_hits(_tables(spark, sf_dir)[0], QUERY)
    return _rounded(search.search_kinds(hits, "raw", None, LIMIT, strict_layer=True), "rrf").select("id", "layer", "rrf", "lists", "position")


def search_one_kind(spark, sf_dir):
    hits = search.find_hits(_tables(spark, sf_dir)[0], QUERY)
    return search.search_kinds(hits, "wiki", "concept", LIMIT).select("id", "kind", "match_phase", "coverage", "position")


def hybrid_rank(spark, sf_dir):
    pages, links = _tables(spark, sf_dir)
    ranked = search.hybrid_rank(search.with_boost(search.search(pages, QUERY, limit=LIMIT), links))
    return _rounded(ranked, "score").select("id", "kind", "graph_boost", "score")


def layered_search(spark, sf_dir):
    pages, links = _tables(spark, sf_dir)
    found = search.layered(pages, links, QUERY, AS_OF, sources=SOURCES, synths=SYNTHS)
    return _rounded(found, "score", "rrf").select("id", "kind", "title", "authority", "graph_boost", "rrf", "score", "pool", "place")


def layered_search_related(spark, sf_dir):
    """The layered results with their related pages, from links and from tags."""
    pages, links = _tables(spark, sf_dir)
    found = materialise(search.layered(pages, links, QUERY, AS_OF, sources=SOURCES, synths=SYNTHS).select("id", "pool", "place"), "results")
    seeds = found.select("id")
    near = [graph.related(links, pages, 3, seeds), graph.tag_related(table(spark, sf_dir, "document_tags"), pages, 5, seeds)]
    related = graph.merge_related(near, 8)
    return found.join(related.select(F.col("seed").alias("id"), F.col("id").alias("related_id"), F.col("place").alias("related_place")), "id", "left")


def search_expand(spark, sf_dir):
    """The neighbours of the best pages of the wiki."""
    pages, links = _tables(spark, sf_dir)
    hits = search.find_hits(pages, QUERY)
    best = materialise(search.search_kinds(hits, "wiki", None, 4 * LIMIT).where(F.col("position") <= LIMIT).select("id"), "results")
    return graph.expand(best, links, pages, LIMIT)


_LONG, _SHORT = ("pipeline", "incident"), ("模板", "db")
_COUNT = " + ".join("(length(l_{c}) - length(replace(l_{c}, '{{k}}', ''))) // {{n}}".format(c=c) for c in search.INDEXED)
BASE = f"""
WITH low AS (SELECT *, {", ".join(f"lower(coalesce({c}, '')) AS l_{c}" for c in search.INDEXED)} FROM kb_documents),
n AS (SELECT *, {" + ".join(f"greatest(length(l_{c}) - 2, 0)" for c in search.INDEXED)} AS d,
  {", ".join(f"{_COUNT.format(k=k, n=len(k))} AS f{i}" for i, k in enumerate(_LONG))},
  {", ".join(f"coalesce(title ILIKE '%{k}%', false) OR coalesce(content ILIKE '%{k}%', false) AS s{i}" for i, k in enumerate(_SHORT))} FROM low),
t AS (SELECT count(*) AS n, sum(d) / count(*) AS avgd, {", ".join(f"count(*) FILTER (f{i} > 0) AS n{i}" for i in range(2))} FROM n),
idf AS (SELECT *, {", ".join(f"CASE WHEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) > 0 THEN ln((n - n{i} + 0.5) / (n{i} + 0.5)) ELSE 1e-6 END AS i{i}" for i in range(2))} FROM t),
places AS (SELECT n.*, least({", ".join(f"nullif(strpos(l_content, '{k}'), 0)" for k in _LONG)}) AS pos FROM n),
hits AS (SELECT id, path, layer, coalesce(kind, '') AS kind, coalesce(title, '') AS title, coalesce(description, '') AS description, coalesce(authority, 3) AS authority,
  coalesce(doc_timestamp, 0) AS doc_timestamp, CASE WHEN layer = 'wiki' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS wiki_priority, s0, s1, (f0 > 0)::INT + (f1 > 0)::INT AS long_hits,
  {" ".join(f"- i{i} * f{i} * 2.2 / (f{i} + 1.2 * (0.25 + 0.75 * d / avgd))" for i in range(2))} AS rank,
  CASE WHEN pos IS NULL THEN '' ELSE CASE WHEN pos > 1 THEN '...' ELSE '' END
    || regexp_replace(regexp_replace(substr(content, pos, 12), '(?i)(pipeline)', '[\\1]', 'g'), '(?i)(incident)', '[\\1]', 'g')
    || CASE WHEN pos + 11 < length(content) THEN '...' ELSE '' END END AS snippet
  FROM places, idf WHERE f0 > 0 OR f1 > 0 OR s0 OR s1)
"""


def phases_sql(name: str, where: str, limit: int) -> str:
    """SQL of the three phases over the filtered hits, as CTEs that end in `name`."""
    top = f"ORDER BY wiki_priority DESC, fts_rank, id LIMIT {limit * 4}"
    base = f"SELECT *, rank AS fts_rank, snippet AS shown FROM hits WHERE {where}"
    like = f"SELECT *, 0.0 AS fts_rank, '' AS shown FROM hits WHERE {where}"
    covered = " + ".join(f"contains(lower(title || ' ' || shown), '{k}')::INT" for k in (*_LONG, *_SHORT))
    return f""", {name}_all AS (
  (SELECT *, 0 AS match_phase FROM ({base}) WHERE long_hits = 2 {top}) UNION ALL (SELECT *, 1 FROM ({base}) WHERE long_hits > 0 {top})
  UNION ALL (SELECT *, 2 FROM ({like}) WHERE s0 {top}) UNION ALL (SELECT *, 2 FROM ({like}) WHERE s1 {top})),
{name}_one AS (SELECT *, CASE WHEN match_phase = 0 THEN 4 ELSE {covered} END AS coverage FROM {name}_all QUALIFY row_number() OVER (PARTITION BY id ORDER BY match_phase) = 1),
{name} AS (SELECT * REPLACE (shown AS snippet), row_number() OVER (ORDER BY wiki_priority DESC, match_phase, coverage DESC, fts_rank, id)::INT AS position FROM {name}_one
  QUALIFY position <= {limit})
"""


def _fused(limit: int, layer: str | None = None) -> str:
    lists = [("l0", "layer = 'wiki' AND kind = 'source-note'", limit * 10), *((f"l{i}", f"layer = 'wiki' AND kind = '{k}'", limit * 3) for i, k in enumerate(("concept", "comparison", "decision"), 1))]
    lists.append(("l4", f"layer = '{layer}'" if layer else "true", limit * 3))
    both = " UNION ALL ".join(f"SELECT {i} AS list, * FROM {n}" for i, (n, _, _) in enumerate(lists))
    return "".join(phases_sql(*x) for x in lists) + f""", lists AS ({both}),
scores AS (SELECT id, sum(1.0 / (60 + position)) AS rrf, count(*) AS lists FROM lists GROUP BY id),
attributes AS (SELECT * FROM lists QUALIFY row_number() OVER (PARTITION BY id ORDER BY list) = 1),
fused AS (SELECT a.* EXCLUDE (position, list), rrf, s.lists, row_number() OVER (ORDER BY rrf DESC, s.id)::INT AS position FROM scores s JOIN attributes a ON s.id = a.id QUALIFY row_number() OVER (ORDER BY rrf DESC, s.id) <= {limit}),
boost AS (SELECT target_doc_id AS id, least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) AS graph_boost FROM links GROUP BY 1)
"""


_SYNTH = "kind IN ('concept', 'comparison', 'decision', 'wiki-concept', 'wiki-comparison', 'wiki-decision')"
_SCORE = f"""1.0 / (60 + position) * CASE WHEN {_SYNTH} THEN 1.3 ELSE 1 END + CASE WHEN authority > 0 THEN (authority - 3) * 0.005 ELSE 0 END + coalesce(graph_boost, 0) * 0.01"""
_AGE = f""" + CASE WHEN doc_timestamp > 0 THEN 0.012 * exp(-(CASE WHEN {_SYNTH} THEN 0.00063 ELSE 0.00126 END) * ({AS_OF} - doc_timestamp) / 86400.0) ELSE 0 END"""
_LAYERED = BASE + _fused((SOURCES + SYNTHS) * 4) + f""", scored AS (SELECT f.*, coalesce(graph_boost, 0) AS graph_boost, {_SCORE} {_AGE} AS score, CASE WHEN {_SYNTH} THEN 'synth' ELSE 'note' END AS pool
  FROM fused f LEFT JOIN boost b ON f.id = b.id),
layered AS (SELECT *, row_number() OVER (PARTITION BY pool ORDER BY score DESC, id)::INT AS place FROM scored QUALIFY place <= CASE WHEN pool = 'synth' THEN {SYNTHS} ELSE {SOURCES} END)
"""

QUERIES = {
    f.__name__: f
    for f in (fts_and, fts_or, like_short, fts_three_phase, fts_postings, rrf_multi_kind, rrf_strict_layer, search_one_kind, hybrid_rank, layered_search, layered_search_related, search_expand)
}
SQL = {
    "fts_and": BASE + "SELECT id, round(rank, 9) AS fts_rank FROM hits WHERE long_hits = 2",
    "fts_or": BASE + "SELECT id, long_hits, snippet, round(rank, 9) AS fts_rank FROM hits WHERE long_hits > 0",
    "like_short": BASE + 'SELECT id, s0 AS "first", s1 AS "second" FROM hits WHERE s0 OR s1',
    "fts_three_phase": BASE + phases_sql("p", "true", LIMIT)
    + "SELECT id, path, layer, kind, title, description, snippet, wiki_priority, authority, round(fts_rank, 9) AS fts_rank, match_phase, coverage, position FROM p",
    "rrf_multi_kind": BASE + _fused(LIMIT) + "SELECT id, kind, title, round(rrf, 9) AS rrf, lists, position FROM fused",
    "rrf_strict_layer": BASE + phases_sql("p", "layer = 'raw'", LIMIT * 3) + f"SELECT id, layer, round(1.0 / (60 + position), 9)::DOUBLE AS rrf, 1::BIGINT AS lists, position FROM p WHERE position <= {LIMIT}",
    "search_one_kind": BASE + phases_sql("p", "layer = 'wiki' AND kind = 'concept'", LIMIT) + "SELECT id, kind, match_phase, coverage, position FROM p",
    "hybrid_rank": BASE + phases_sql("p", "true", LIMIT)
    + f""", boost AS (SELECT target_doc_id AS id, least(count(*) / 10.0::DOUBLE, 1.0::DOUBLE) AS graph_boost FROM links GROUP BY 1)
SELECT p.id, kind, coalesce(graph_boost, 0) AS graph_boost, round({_SCORE}, 9) AS score FROM p LEFT JOIN boost b ON p.id = b.id""",
    "layered_search": _LAYERED + "SELECT id, kind, title, authority, graph_boost, round(rrf, 9) AS rrf, round(score, 9) AS score, pool, place FROM layered",
    "search_expand": BASE
    + _fused(4 * LIMIT, "wiki")
    + ADJACENCY.replace("WITH", ",", 1)
    + f""", best AS (SELECT id FROM fused WHERE position <= {LIMIT})
SELECT * FROM page WHERE id IN (SELECT a.id FROM adjacency a JOIN best b ON a.seed = b.id) AND id NOT IN (FROM best) ORDER BY title, id LIMIT {LIMIT}""",
    "layered_search_related": _LAYERED
    + ADJACENCY.replace("WITH", ",", 1)
    + MERGED_SQL
    + "SELECT l.id, l.pool, l.place, m.id AS related_id, m.place AS related_place FROM layered l LEFT JOIN merged m ON m.seed = l.id",
}
SQL["fts_postings"] = SQL["fts_three_phase"]
