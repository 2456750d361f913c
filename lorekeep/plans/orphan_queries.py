"""Queries of problem 1, with their SQL."""

from __future__ import annotations

from ..operators.orphans import missing_parents, orphan_ends, orphan_report, references
from ..session import table


def p1_found(spark, sf_dir):
    ends = orphan_ends(table(spark, sf_dir, "links"), table(spark, sf_dir, "kb_documents"))
    return ends.select("link_id", "side").distinct()


def p1_report(spark, sf_dir):
    return orphan_report(*(table(spark, sf_dir, t) for t in ("links", "kb_documents", "purge_log")))


def p1_tables(spark, sf_dir):
    """References of every table that names pages, by exact id, to pages that are not there, per table, field and month."""
    links, tags, items, pages = (table(spark, sf_dir, t) for t in ("links", "document_tags", "eval_items", "kb_documents"))
    refs = [references(links, "links", "source_doc_id", "indexed_at"), references(links, "links", "target_doc_id", "indexed_at")]
    refs += [references(tags, "document_tags", "doc_id"), references(items, "eval_items", "expected_page")]
    return missing_parents(refs, pages, "id")


_ENDS = r"""
WITH raw_ends AS (
  SELECT id AS link_id, 'source' AS side, relation, indexed_at, split_part(source_doc_id, '#', 1) AS v, false AS wl FROM links
  UNION ALL
  SELECT id, 'target', relation, indexed_at, split_part(target_doc_id, '#', 1), coalesce(relation = 'wikilink', false) FROM links),
ends AS (SELECT link_id, side, relation, indexed_at, wl, regexp_replace(v, '^[\s\x1c-\x1f\x{85}\pZ]+|[\s\x1c-\x1f\x{85}\pZ]+$', '', 'g') AS key FROM raw_ends),
ids AS (SELECT id AS key, min(first_indexed_at) AS since FROM kb_documents GROUP BY 1),
slugs AS (SELECT replace(lower(regexp_replace(regexp_extract(id, '[^/]*$'), '\.md$', '')), ' ', '-') AS key,
                 min(first_indexed_at) AS since FROM kb_documents GROUP BY 1),
joined AS (SELECT e.*, CASE WHEN wl THEN least(i.since, s.since) ELSE i.since END AS since
           FROM ends e LEFT JOIN ids i ON e.key = i.key LEFT JOIN slugs s ON e.key = s.key),
orphans AS (SELECT * FROM joined WHERE coalesce(key, '') = '' OR since IS NULL OR indexed_at IS NULL OR indexed_at < since)
"""

def _lost(name: str, field: str, month: str) -> str:
    key = rf"regexp_replace(split_part({field}, '#', 1), '^[\s\x1c-\x1f\x{{85}}\pZ]+|[\s\x1c-\x1f\x{{85}}\pZ]+$', '', 'g')"
    return f"""SELECT '{name}' AS "table", '{field}' AS field, {month} AS month, count(*) AS n_rows, count(DISTINCT key) AS n_keys
FROM (SELECT *, {key} AS key FROM {name}) WHERE key <> '' AND key NOT IN (SELECT id FROM kb_documents WHERE id IS NOT NULL) GROUP BY ALL HAVING count(*) > 0"""


_MONTH = "strftime(make_timestamp(indexed_at * 1000000), '%Y-%m')"
QUERIES = {"p1_found": p1_found, "p1_report": p1_report, "p1_tables": p1_tables}
SQL = {
    "p1_found": _ENDS + "SELECT DISTINCT link_id, side FROM orphans",
    "p1_report": _ENDS
    + """, purged AS (SELECT DISTINCT doc_id FROM purge_log WHERE doc_id IS NOT NULL)
SELECT 'links' AS "table", side, relation, strftime(make_timestamp(indexed_at * 1000000), '%Y-%m') AS month,
  CASE WHEN coalesce(key, '') = '' THEN 'blank' WHEN since IS NOT NULL THEN 'late' WHEN p.doc_id IS NOT NULL THEN 'purged' ELSE 'missing' END AS reason,
  count(*) AS n_ends, count(DISTINCT key) AS n_keys
FROM orphans LEFT JOIN purged p ON orphans.key = p.doc_id GROUP BY ALL""",
    "p1_tables": " UNION ALL ".join(
        [_lost("links", "source_doc_id", _MONTH), _lost("links", "target_doc_id", _MONTH), _lost("document_tags", "doc_id", "NULL::VARCHAR"), _lost("eval_items", "expected_page", "NULL::VARCHAR")]
    ),
}
