"""Queries on parsing, indexing, lint, status and the queue, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import text as tx
from ..operators import index, queue, wiki
from ..session import table
from ..sources import kb_files

AS_OF = 1767225600


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "kb_documents")


def _parsed(spark, sf_dir):
    return index.parse(_pages(spark, sf_dir).select("id", "content", "doc_timestamp"))


def frontmatter_fields(spark, sf_dir):
    h = F.col("header")
    lists = [F.array_join(h[k], "|").alias(k) for k in fm.LISTS]
    return _parsed(spark, sf_dir).select("id", h["title"].alias("title"), h["kind"].alias("kind"), h["description"].alias("description"), h["authority"].alias("authority"), h["timestamp"].alias("timestamp"), *lists)


def page_links(spark, sf_dir):
    """The links that the pages state, counted with repeats."""
    return index.links_of(_parsed(spark, sf_dir)).groupBy("source_doc_id", "target_doc_id", "relation", "confidence").agg(F.count("*").alias("n"))


def wikilinks(spark, sf_dir):
    body = fm.body_of(F.col("content"))
    return _pages(spark, sf_dir).select("id", F.explode(fm.wikilinks(body)).alias("name")).groupBy("id", "name").agg(F.count("*").alias("n"))


def _claims(title, id_, concat):
    """A page's text with claims that name its title and its id as entities; both sides build it."""
    return concat("---\nkey_claims:\n  - 【", title, "|概念】 and 【", id_, "|项目】\n  - 【技术|技术】 【x|概念】 【 ", title, "|概念】\n---\ntext")


def entity_tags(spark, sf_dir):
    """Tags from claims. The pages state none, so each gets claims made of its title and its id."""
    pages = _pages(spark, sf_dir)
    text = _claims(F.coalesce("title", F.lit("")), F.substr("id", F.lit(-12)), lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))
    return index.tags_of(index.parse(pages.select("id", text.alias("content"))))


def content_hash(spark, sf_dir):
    return _pages(spark, sf_dir).select("id", tx.content_hash(F.col("content")).alias("content_hash"))


def hash_gated_upsert(spark, sf_dir):
    """Pages that an index run would write, where the table holds no decisions yet, and texts without description have changed since."""
    pages = _pages(spark, sf_dir)
    have = pages.where(F.coalesce("kind", F.lit("")) != "decision")
    now = pages.select("id", F.when(F.col("description").isNull(), F.concat("content", F.lit("\n"))).otherwise(F.col("content")).alias("content"))
    return index.changed(have, now).select("id")


def stale_purge(spark, sf_dir):
    """Rows left in pages, links and tags after the pages that the log says were purged are taken out."""
    pages, links, tags, log = (table(spark, sf_dir, t) for t in ("kb_documents", "links", "document_tags", "purge_log"))
    alive = pages.select("id").join(log.select(F.col("doc_id").alias("id")), "id", "left_anti")
    left = index.purge(pages, links, tags, alive)
    counts = [x.agg(F.lit(n).alias("table"), F.count("*").alias("n")) for n, x in zip(("pages", "links", "tags", "purged"), left, strict=True)]
    return counts[0].unionByName(counts[1]).unionByName(counts[2]).unionByName(counts[3])


def undistilled(spark, sf_dir):
    return kb_files.undistilled(_pages(spark, sf_dir).select("id"))


def orphan_stems(spark, sf_dir):
    return kb_files.orphan_stems(_pages(spark, sf_dir).select("id"))


def existing_titles(spark, sf_dir):
    return kb_files.existing_titles(_pages(spark, sf_dir)).groupBy("title").agg(F.count("*").alias("n"))


def index_entries(spark, sf_dir):
    return wiki.index_entries(_pages(spark, sf_dir))


def index_folder_counts(spark, sf_dir):
    return wiki.folder_counts(_pages(spark, sf_dir))


def page_fetch_truncated(spark, sf_dir):
    """Every page as a fetch of several pages shows it: its size after the cut."""
    pages = _pages(spark, sf_dir)
    return pages.select("id", F.octet_length(tx.truncated(F.col("content"))).cast("bigint").alias("n_bytes"), (F.octet_length("content") > 5000).alias("truncated"))


def missing_fields(spark, sf_dir):
    return wiki.missing_fields(_parsed(spark, sf_dir))


def broken_sources(spark, sf_dir):
    return wiki.broken_sources(_parsed(spark, sf_dir), _pages(spark, sf_dir).select("id"))


def _broken(spark, sf_dir):
    return wiki.broken_links(table(spark, sf_dir, "links"), _pages(spark, sf_dir))


def broken_links_classified(spark, sf_dir):
    return _broken(spark, sf_dir).select("id", "link_type")


def broken_link_counts(spark, sf_dir):
    return _broken(spark, sf_dir).groupBy("relation", "link_type").agg(F.count("*").alias("n"))


def link_warnings(spark, sf_dir):
    return wiki.link_warnings(_broken(spark, sf_dir)).groupBy("path", "kind", "detail").agg(F.count("*").alias("n"))


def red_links(spark, sf_dir):
    return wiki.red_links(_broken(spark, sf_dir))


def red_link_references(spark, sf_dir):
    return wiki.red_link_references(_broken(spark, sf_dir))


def clean_links(spark, sf_dir):
    return wiki.clean_links(table(spark, sf_dir, "links"), _pages(spark, sf_dir)).select("id")


def layer_counts(spark, sf_dir):
    return wiki.layer_counts(_pages(spark, sf_dir))


def kind_counts_zero_filled(spark, sf_dir):
    return wiki.kind_counts(_pages(spark, sf_dir))


def queue_stats(spark, sf_dir):
    return queue.stats(table(spark, sf_dir, "distill_queue"), ("pending", "processing", "failed", "done"))


def queue_enqueue(spark, sf_dir):
    return queue.enqueue(table(spark, sf_dir, "distill_queue"), kb_files.undistilled(_pages(spark, sf_dir).select("id")), AS_OF)


def queue_next_pending(spark, sf_dir):
    return queue.next_pending(table(spark, sf_dir, "distill_queue"), 10)


def queue_mark_failed(spark, sf_dir):
    """The queue after everything in processing failed."""
    q = table(spark, sf_dir, "distill_queue")
    return queue.failed(q, q.where("status = 'processing'").select("path", F.lit("timeout").alias("error")), AS_OF)


def queue_mark_done(spark, sf_dir):
    q = table(spark, sf_dir, "distill_queue")
    return queue.done(q, q.where("status = 'processing'"))


def queue_recover_stale(spark, sf_dir):
    return queue.recover_stale(table(spark, sf_dir, "distill_queue"), AS_OF)


def queue_available_at(spark, sf_dir):
    return queue.available_at(table(spark, sf_dir, "distill_queue"))


def scalar_functions(spark, sf_dir):
    """Names and slugs derived from ids and titles."""
    i, t = F.col("id"), F.coalesce("title", F.lit(""))
    return _pages(spark, sf_dir).select(
        "id", tx.layer(i).alias("layer"), tx.plain_title(i).alias("plain_title"), tx.display_title(i).alias("display_title"), tx.topic_slug(t).alias("topic_slug"),
        tx.import_slug(t).alias("import_slug"), tx.safe_id(t).alias("safe_id"), tx.normal_text(t).alias("normal_text"), tx.normal_tag(t).alias("normal_tag"),
        tx.source_count(F.col("content")).alias("source_count"), tx.technical_catalogue(F.col("content")).alias("catalogue"),
    )


#: Lines that make catalogues of some pages: of raw files with table rows, of notes with numbered entries, of concepts with too few of them.
ROWS, ENTRIES, FEW = "\n| a | b |" * 60, "\nline" * 50 + "\nsee M12" * 5, "\nline" * 500 + "\nsee M12x" * 9 + "\nsee M12" * 4


def technical_catalogue(spark, sf_dir):
    """Catalogues among the pages, where some were made catalogues."""
    more = F.when(F.col("layer") == "raw", ROWS).when(F.col("kind") == "source-note", ENTRIES).when(F.col("kind") == "concept", FEW).otherwise("")
    pages = _pages(spark, sf_dir).select("id", F.concat("content", more).alias("content"))
    return pages.where(tx.technical_catalogue(F.col("content"))).select("id")


_HEADER = r"""
WITH hd AS (SELECT id, content, regexp_extract(content, '(?s)^---\n(.*?)\n---\n?', 1) AS header FROM kb_documents),
ln AS (SELECT id, unnest(string_split(header, chr(10))) AS line, unnest(range(1, len(string_split(header, chr(10))) + 1)) AS n FROM hd WHERE header <> ''),
c1 AS (SELECT *, (starts_with(line, '- ') OR starts_with(line, '  - ')) AS item, rtrim(line, ' ') AS t FROM ln),
c2 AS (SELECT *, NOT item AND contains(t, ':') AS keyed, trim(split_part(t, ':', 1)) AS k, trim(substr(t, strpos(t, ':') + 1)) AS raw FROM c1),
c3 AS (SELECT *, trim(raw, '"''') AS val, max(CASE WHEN keyed THEN n END) OVER (PARTITION BY id ORDER BY n) AS owner FROM c2),
c4 AS (SELECT *, val = '[]' OR (val = '' AND raw <> '""' AND raw <> '''''') AS opens FROM c3),
ks AS (SELECT * FROM c4 WHERE keyed QUALIFY row_number() OVER (PARTITION BY id, k ORDER BY n DESC) = 1),
its AS (SELECT id, owner, list(trim(trim(regexp_replace(regexp_replace(line, '^  - ', ''), '^- ', '')), '"''') ORDER BY n) AS items FROM c4 WHERE item GROUP BY id, owner),
kv AS (SELECT ks.id, k, opens, CASE WHEN opens THEN NULL WHEN starts_with(raw, '[') THEN raw ELSE val END AS v,
  CASE WHEN opens THEN coalesce(its.items, []) WHEN starts_with(raw, '[') AND ends_with(raw, ']') THEN [x for x in [trim(trim(y), '"''') for y in string_split(raw[2:-2], ',')] if x <> '']
       WHEN v = '' THEN [] ELSE string_split(v, ',') END AS l
  FROM ks LEFT JOIN its ON ks.id = its.id AND ks.n = its.owner)
"""


_PLANTED = _claims(None, None, lambda *parts: " || ".join("'" + p.replace("\n", "' || chr(10) || '") + "'" if p is not None else x for p, x in zip(parts, ("", "coalesce(title, '')", "", "right(id, 12)", "", "coalesce(title, '')", ""), strict=True)))


def _scalar(key: str) -> str:
    return f"coalesce(max(CASE WHEN k = '{key}' AND NOT opens THEN v END), '')"


_STAMP = r"""CASE WHEN regexp_full_match(s, '\d{4}-\d\d-\d\d') THEN epoch(try_cast(s AS DATE))::BIGINT
  WHEN regexp_full_match(s, '\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d+)?(Z|[+-]\d\d:\d\d)') THEN epoch(try_cast(s AS TIMESTAMPTZ))::BIGINT END"""
_BODY = r"""CASE WHEN regexp_matches(content, '(?s)^---\n(.*?)\n---\n?') THEN regexp_replace(regexp_replace(content, '(?s)^---\n(.*?)\n---\n?', ''), '^\s+|\s+$', '', 'g') ELSE content END"""
_BROKEN = """
WITH broken AS (SELECT *, CASE WHEN trim(target_doc_id) = '' OR target_doc_id LIKE '#%' OR target_doc_id LIKE '[%' THEN 'placeholder'
  WHEN contains(target_doc_id, '/') THEN 'path' ELSE 'concept' END AS link_type FROM links
  WHERE relation IN ('related_to', 'supports', 'contradicts') AND NOT EXISTS (SELECT 1 FROM kb_documents d WHERE d.id = target_doc_id))
"""
_LISTED = r"regexp_matches(id, '(?i)^wiki/.*\.md$') AND regexp_extract(id, '[^/]*$') NOT IN ('index.md', 'log.md')"
_UNDISTILLED = r"""SELECT substr(id, 5) AS path FROM kb_documents WHERE regexp_matches(id, '^raw/.*\.md$') AND regexp_extract(id, '[^/]*$') NOT IN ('index.md', 'log.md')
  AND regexp_replace(substr(id, 5), '^converted/', '') NOT IN (SELECT substr(id, 19) FROM kb_documents WHERE starts_with(id, 'wiki/source-notes/'))"""
_STEM = r"regexp_replace(regexp_extract(id, '[^/]*$'), '\.[^.]*$', '')"
_CAPITAL = "[upper(w[1]) || w[2:] for w in regexp_split_to_array({}, '\\s+') if w <> '']"
_CATALOGUE = rf"""(len(string_split(content, chr(10))) >= 50 AND (len([x for x in string_split(content, chr(10)) if regexp_matches(x, '{tx.CATALOGUE_ENTRY}')]) >= 5
  OR len([x for x in string_split(content, chr(10)) if regexp_matches(x, '{tx.CATALOGUE_TABLE}')]) >= 10
  OR len([x for x in string_split(content, chr(10)) if regexp_matches(x, '^\s*\|')]) / len(string_split(content, chr(10))) >= 0.3))"""
#: SQL for a tag that is no noise, of the fixed values.
GOOD_TAG = f"length(tag) BETWEEN 2 AND {tx.LONGEST_TAG} AND tag NOT IN {tx.ENTITY_TYPES} AND tag NOT IN {tx.ARTEFACTS} AND NOT regexp_matches(tag, '{tx.NOISE}')"
_WS = r"[\s\x1c-\x1f\x{85}\pZ]+"


def _trimmed(value: str) -> str:
    return f"regexp_replace({value}, '^{_WS}|{_WS}$', '', 'g')"


QUERIES = {
    f.__name__: f
    for f in (
        frontmatter_fields, page_links, wikilinks, entity_tags, content_hash, hash_gated_upsert, stale_purge, undistilled, orphan_stems, existing_titles, index_entries,
        index_folder_counts, page_fetch_truncated, missing_fields, broken_sources, broken_links_classified, broken_link_counts, link_warnings, red_links, red_link_references, clean_links,
        layer_counts, kind_counts_zero_filled, queue_stats, queue_enqueue, queue_next_pending, queue_mark_failed, queue_mark_done, queue_recover_stale, queue_available_at,
        scalar_functions, technical_catalogue,
    )
}
SQL = {
    "frontmatter_fields": _HEADER
    + f""", f AS (SELECT id, {_scalar('title')} AS title, CASE WHEN {_scalar('kind')} <> '' THEN {_scalar('kind')} ELSE {_scalar('type')} END AS kind, {_scalar('description')} AS description,
  {_scalar('authority')} AS a, {_scalar('timestamp')} AS s, {", ".join(f"coalesce(max(CASE WHEN k = '{k}' THEN array_to_string(l, '|') END), '') AS l_{k}" for k in fm.LISTS)} FROM kv GROUP BY id)
SELECT hd.id, coalesce(title, '') AS title, coalesce(kind, '') AS kind, coalesce(description, '') AS description, CASE WHEN try_cast(a AS INT) BETWEEN 1 AND 5 THEN try_cast(a AS INT) ELSE 3 END AS authority,
  coalesce({_STAMP}, 0) AS "timestamp", {", ".join(f"coalesce(l_{k}, '') AS {k}" for k in fm.LISTS)} FROM hd LEFT JOIN f ON hd.id = f.id""",
    "page_links": _HEADER
    + rf""", l AS (SELECT id, unnest(l) AS target, CASE k WHEN 'sources' THEN 'cites' ELSE k END AS relation, 1.0::DOUBLE AS confidence FROM kv WHERE k IN ('sources', 'contradicts', 'supersedes', 'supports', 'related_to')
  UNION ALL SELECT id, lower(replace(unnest(regexp_extract_all({_BODY}, '\[\[([^\]]+)\]\]', 1)), ' ', '-')), 'wikilink', 0.9::DOUBLE FROM hd)
SELECT id AS source_doc_id, target AS target_doc_id, relation, confidence, count(*) AS n FROM l GROUP BY ALL""",
    "wikilinks": rf"SELECT id, name, count(*) AS n FROM (SELECT id, unnest(regexp_extract_all({_BODY}, '\[\[([^\]]+)\]\]', 1)) AS name FROM kb_documents) GROUP BY ALL",
    "entity_tags": _HEADER.replace("FROM kb_documents", f"FROM (SELECT id, {_PLANTED} AS content FROM kb_documents)")
    + rf""", e AS (SELECT id, unnest(regexp_extract_all(c, '【([^|】]+)\|([^】]+)】', 1)) AS name FROM (SELECT id, unnest(l) AS c FROM kv WHERE k = 'key_claims')),
t AS (SELECT id, {_trimmed("name")} AS t FROM e), m AS (SELECT id, CASE WHEN t = lower(t) AND regexp_matches(t, '^[a-zA-Z]') THEN upper(t[1]) || t[2:] ELSE t END AS tag FROM t)
SELECT DISTINCT id AS doc_id, tag, 'claim' AS source FROM m WHERE {GOOD_TAG}""",
    "content_hash": "SELECT id, substr(sha256(content), 1, 16) AS content_hash FROM kb_documents",
    "hash_gated_upsert": "SELECT id FROM kb_documents WHERE kind = 'decision' OR content_hash IS DISTINCT FROM substr(sha256(CASE WHEN description IS NULL THEN content || chr(10) ELSE content END), 1, 16)",
    "stale_purge": """WITH gone AS (SELECT id FROM kb_documents WHERE id IN (SELECT doc_id FROM purge_log))
SELECT 'pages' AS "table", count(*) AS n FROM kb_documents WHERE id NOT IN (FROM gone) UNION ALL
SELECT 'links', count(*) FROM links WHERE coalesce(source_doc_id NOT IN (FROM gone), true) AND coalesce(target_doc_id NOT IN (FROM gone), true) UNION ALL
SELECT 'tags', count(*) FROM document_tags WHERE coalesce(doc_id NOT IN (FROM gone), true) UNION ALL SELECT 'purged', count(*) FROM gone""",
    "undistilled": _UNDISTILLED,
    "orphan_stems": rf"""SELECT id FROM kb_documents WHERE regexp_matches(id, '^(wiki/source-notes|raw/converted)/.*\.md$') AND regexp_extract(id, '[^/]*$') NOT IN ('index.md', 'log.md')
  AND {_STEM} NOT IN (SELECT {_STEM} FROM kb_documents WHERE starts_with(id, 'raw/') AND NOT starts_with(id, 'raw/converted/'))""",
    "existing_titles": r"""SELECT title, count(*) AS n FROM kb_documents WHERE regexp_matches(id, '^wiki/(concepts|comparisons|decisions)/[^/]+\.md$') AND title <> '' AND regexp_extract(id, '[^/]*$') NOT IN ('index.md', 'log.md') GROUP BY 1""",
    "index_entries": rf"""SELECT regexp_replace(id, '/[^/]*$', '') AS dir, regexp_extract(id, '[^/]*$') AS file,
  '* [' || CASE WHEN coalesce(title, '') <> '' THEN title ELSE array_to_string({_CAPITAL.format(f"translate({_STEM}, '-_', '  ')")}, ' ') END || '](' || regexp_extract(id, '[^/]*$') || ')'
  || CASE WHEN coalesce(description, '') <> '' THEN ' — ' || description ELSE '' END AS line FROM kb_documents WHERE {_LISTED}""",
    "index_folder_counts": f"SELECT split_part(id, '/', 2) AS folder, count(*) AS n_pages FROM kb_documents WHERE {_LISTED} AND regexp_matches(id, '^wiki/[^/]+/') GROUP BY 1",
    "page_fetch_truncated": """SELECT id, CASE WHEN strlen(content) <= 5000 THEN strlen(content) ELSE list_max([x for x in list_prefix if x <= 5000]) END AS n_bytes, strlen(content) > 5000 AS truncated
FROM (SELECT id, content, CASE WHEN strlen(content) > 5000 THEN [strlen(substr(content, 1, i)) for i in range(1, 5001)] ELSE [] END AS list_prefix FROM kb_documents)""",
    "missing_fields": _HEADER
    + rf"""SELECT p.id AS path, 'missing_field' AS kind, r AS detail FROM kb_documents p, (SELECT unnest(['title', 'type', 'sources', 'timestamp']) AS r) LEFT JOIN kv ON kv.id = p.id AND kv.k = r
WHERE {_LISTED.replace("(id,", "(p.id,")} AND NOT contains(p.id, '/_draft/') AND (kv.id IS NULL OR (NOT kv.opens AND trim(kv.v) = ''))""",
    "broken_sources": _HEADER
    + f"""SELECT id AS path, 'broken_source' AS kind, trim(d) AS detail FROM (SELECT id, unnest(l) AS d FROM kv WHERE k = 'sources') WHERE {_LISTED} AND NOT contains(id, '/_draft/')
  AND trim(d) <> '' AND trim(d) NOT IN (SELECT id FROM kb_documents)""",
    "broken_links_classified": _BROKEN + "SELECT id, link_type FROM broken",
    "broken_link_counts": _BROKEN + "SELECT relation, link_type, count(*) AS n FROM broken GROUP BY ALL",
    "link_warnings": _BROKEN + "SELECT source_doc_id AS path, CASE link_type WHEN 'path' THEN 'broken_related' ELSE 'missing_concept' END AS kind, target_doc_id AS detail, count(*) AS n FROM broken WHERE link_type <> 'placeholder' GROUP BY ALL",
    "red_links": _BROKEN + "SELECT target_doc_id AS concept, count(*) AS n FROM broken WHERE link_type = 'concept' GROUP BY 1",
    "red_link_references": _BROKEN + "SELECT target_doc_id AS concept, source_doc_id AS referenced_by, count(*) AS n FROM broken WHERE link_type = 'concept' GROUP BY ALL",
    "clean_links": "SELECT id FROM links WHERE relation IS NULL OR relation NOT IN ('related_to', 'supports', 'contradicts') OR target_doc_id IN (SELECT id FROM kb_documents)",
    "layer_counts": "SELECT layer, count(*) AS n FROM kb_documents GROUP BY ROLLUP (layer)",
    "kind_counts_zero_filled": """SELECT kind, sum(n)::BIGINT AS n FROM (SELECT coalesce(kind, 'source-note') AS kind, 1 AS n FROM kb_documents WHERE layer = 'wiki'
  UNION ALL SELECT unnest(['source-note', 'concept', 'comparison', 'decision']), 0) GROUP BY kind""",
    "queue_stats": "SELECT status, sum(n)::BIGINT AS n FROM (SELECT status, 1 AS n FROM distill_queue UNION ALL SELECT unnest(['pending', 'processing', 'failed', 'done']), 0) GROUP BY status",
    "queue_enqueue": f"""SELECT DISTINCT path, 'pending' AS status, 0 AS retry_count, NULL::VARCHAR AS last_error, {AS_OF}::BIGINT AS queued_at, {AS_OF}::BIGINT AS updated_at
FROM ({_UNDISTILLED}) WHERE path NOT IN (SELECT path FROM distill_queue)""",
    "queue_next_pending": "SELECT * FROM distill_queue WHERE status = 'pending' ORDER BY queued_at, path LIMIT 10",
    "queue_mark_failed": f"""SELECT path, CASE WHEN status <> 'processing' THEN status WHEN retry_count + 1 >= 5 THEN 'failed' ELSE 'pending' END AS status,
  retry_count + (status = 'processing')::INT AS retry_count, CASE WHEN status = 'processing' THEN 'timeout' ELSE last_error END AS last_error, queued_at,
  CASE WHEN status = 'processing' THEN {AS_OF} ELSE updated_at END AS updated_at FROM distill_queue""",
    "queue_mark_done": "SELECT * FROM distill_queue WHERE path NOT IN (SELECT path FROM distill_queue WHERE status = 'processing')",
    "queue_recover_stale": f"SELECT path, CASE WHEN status = 'processing' THEN 'pending' ELSE status END AS status, retry_count, last_error, queued_at, CASE WHEN status = 'processing' THEN {AS_OF} ELSE updated_at END AS updated_at FROM distill_queue",
    "queue_available_at": "SELECT path, retry_count, updated_at + CASE WHEN retry_count > 0 THEN (10 * 2 ** (retry_count - 1))::BIGINT ELSE 0 END AS available_at FROM distill_queue WHERE status = 'pending'",
    "scalar_functions": rf"""SELECT id, CASE WHEN split_part(id, '/', 1) IN ('raw', 'wiki', 'schema') AND contains(id, '/') THEN split_part(id, '/', 1) ELSE 'raw' END AS layer,
  replace({_STEM}, '-', ' ') AS plain_title, array_to_string({_CAPITAL.format(f"translate({_STEM}, '-_', '  ')")}, ' ') AS display_title,
  substr(regexp_replace(regexp_replace(lower(t), '[^\pL\p{{Nd}}]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 80) AS topic_slug,
  regexp_replace(regexp_replace(lower({_trimmed("t")}), '[^a-z0-9\x{{4E00}}-\x{{9FFF}}]+', '-', 'g'), '^-+|-+$', '', 'g') AS import_slug,
  regexp_replace(regexp_replace(t, '[^A-Za-z0-9_-]+', '-', 'g'), '^-+|-+$', '', 'g') AS safe_id, lower({_trimmed(f"regexp_replace(t, '{_WS}', ' ', 'g')")}) AS normal_text,
  CASE WHEN {_trimmed("t")} = lower({_trimmed("t")}) AND regexp_matches({_trimmed("t")}, '^[a-zA-Z]') THEN upper({_trimmed("t")}[1]) || ({_trimmed("t")})[2:] ELSE {_trimmed("t")} END AS normal_tag,
  coalesce(try_cast(regexp_extract(content, '(?m)^source_count:\s*(\d+)', 1) AS INT), 0) AS source_count, {_CATALOGUE} AS catalogue
  FROM (SELECT *, coalesce(title, '') AS t FROM kb_documents)""",
    "technical_catalogue": f"""SELECT id FROM (SELECT id, content || CASE WHEN layer = 'raw' THEN '{ROWS}' WHEN kind = 'source-note' THEN '{ENTRIES}' WHEN kind = 'concept' THEN '{FEW}' ELSE '' END AS content
  FROM kb_documents) WHERE {_CATALOGUE}""",
}
