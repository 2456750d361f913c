"""Queries on notes, synthesis, imports, evaluation and events, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import notes as nt
from ..functions import text as tx
from ..operators import context, evaluate, records, search, synthesis
from ..operators.search import is_synthesized
from ..session import materialise, table
from ..streaming.watch import debounced
from . import search_queries
from .search_queries import QUERY
from .wiki_queries import _STEM, GOOD_TAG, _trimmed

TOPIC, STAMP, GAP_S, RESULTS = "api", "2026-01-01T00:00:00Z", 180, 50


def _pages(spark, sf_dir):
    return table(spark, sf_dir, "kb_documents")


def _notes(spark, sf_dir):
    """Source notes with the tags of the tag table."""
    tags = table(spark, sf_dir, "document_tags").where("tag IS NOT NULL").groupBy(F.col("doc_id").alias("id")).agg(F.collect_set("tag").alias("tags"))
    pages = _pages(spark, sf_dir).where("kind = 'source-note'")
    return pages.join(tags, "id", "left").select(F.col("id").alias("path"), "title", "description", F.coalesce("tags", F.array().cast("array<string>")).alias("tags"), F.array().cast("array<string>").alias("key_claims"), "content")


def topic_filter(spark, sf_dir):
    return synthesis.topic_filter(_notes(spark, sf_dir), TOPIC).select("path")


def note_fields(spark, sf_dir):
    """The stricter reading of the source notes' headers."""
    return synthesis.source_notes(_pages(spark, sf_dir)).select("path", "title", "description", F.size("tags").alias("n_tags"), F.size("key_claims").alias("n_claims"))


def note_hashes(spark, sf_dir):
    notes = _notes(spark, sf_dir).withColumn("tags", F.sort_array("tags"))
    return synthesis.with_hash(notes).select("path", "hash")


def notes_changed(spark, sf_dir):
    """Notes whose hash isn't in a state that was recorded before their descriptions were filled in."""
    notes = _notes(spark, sf_dir)
    state = synthesis.with_hash(notes.withColumn("description", F.lit("")))
    return synthesis.new_or_changed(synthesis.with_hash(notes), state).select("path")


def tag_overlap_notes(spark, sf_dir):
    return synthesis.tag_overlap(_notes(spark, sf_dir))


def draft_routes(spark, sf_dir):
    """Where pages planned from the synthesized titles would go: sources are the raw files that their pages cite."""
    pages, links = _pages(spark, sf_dir), table(spark, sf_dir, "links")
    cited = links.where("relation = 'cites'").groupBy(F.col("source_doc_id").alias("id")).agg(F.collect_set("target_doc_id").alias("sources"))
    planned = pages.where(is_synthesized(F.col("kind"))).join(cited, "id")
    plans = planned.select(F.col("kind").alias("type"), "title", tx.stem(F.col("id")).alias("slug"), "description", "sources")
    return synthesis.routed(synthesis.viable(plans), pages).groupBy("dest", "is_draft", "step").agg(F.count("*").alias("n"))


def light_notes(spark, sf_dir):
    """Titles and sizes of the notes that raw files would get without a model."""
    raw = _pages(spark, sf_dir).where("layer = 'raw'")
    note = nt.light_note(F.col("id"), F.col("content"), STAMP)
    return raw.select("id", nt.light_title(F.col("id"), F.col("content")).alias("title"), F.octet_length(note).alias("n_bytes"))


def entity_mentions(spark, sf_dir):
    """Entities named anywhere in pages, normalised, without noise."""
    names = _pages(spark, sf_dir).select("id", F.explode(tx.entity_names(F.col("content"))).alias("name"))
    tags = names.select("id", tx.normal_tag(F.col("name")).alias("tag"))
    return tags.where(~tx.noisy_tag(F.col("tag"))).groupBy("id", "tag").agg(F.count("*").alias("n"))


def _records(spark, sf_dir):
    """Documents as imported submissions: an address by language and size, source as nickname."""
    docs = table(spark, sf_dir, "documents")
    url = F.concat(F.lit("(https://KB.example/"), F.coalesce("lang", F.lit("und")), F.lit("/topic/"), F.col("n_chars"), F.lit("/)"))
    return docs.select(F.col("doc_id").alias("ordinal"), url.alias("url"), F.col("source").alias("nickname"), F.col("title"))


def record_keys(spark, sf_dir):
    return records.record_keys(_records(spark, sf_dir), F.col("url"), F.col("nickname"), F.col("title"))


def record_dedup(spark, sf_dir):
    return records.deduplicate(record_keys(spark, sf_dir))


def import_totals(spark, sf_dir):
    keys = record_keys(spark, sf_dir)
    return records.import_totals(keys, records.deduplicate(keys))


def naive_keyword_score(spark, sf_dir):
    raw = _pages(spark, sf_dir).where("layer = 'raw'")
    return evaluate.keyword_retrieval(raw, table(spark, sf_dir, "eval_items"))


def eval_hit_mrr(spark, sf_dir):
    questions = table(spark, sf_dir, "eval_items")
    return evaluate.hits(evaluate.keyword_retrieval(_pages(spark, sf_dir), questions), questions)


def eval_means(spark, sf_dir):
    """Mean hit rate and reciprocal rank per suite."""
    suites = table(spark, sf_dir, "eval_items").select("item_id", "suite")
    scored = eval_hit_mrr(spark, sf_dir).join(suites, "item_id")
    return evaluate.means(scored, ["suite"], ["hit", "rr"]).select("suite", F.round("hit", 9).alias("hit"), F.round("rr", 9).alias("rr"))


def eval_comparison(spark, sf_dir):
    """Retrieval over all pages against retrieval over raw files only."""
    questions, pages = table(spark, sf_dir, "eval_items"), _pages(spark, sf_dir)
    ours = evaluate.hits(evaluate.keyword_retrieval(pages, questions), questions).withColumn("system", F.lit("all"))
    theirs = evaluate.hits(evaluate.keyword_retrieval(pages.where("layer = 'raw'"), questions), questions).withColumn("system", F.lit("raw"))
    out = evaluate.comparison(ours.unionByName(theirs), ["hit", "rr"], "all", "raw")
    return out.select("metric", *[F.round(c, 9).alias(c) for c in ("ours", "theirs", "delta")])


def alike_descriptions(spark, sf_dir):
    """Pairs of the results of a search whose descriptions are more than 20 % alike."""
    pages = _pages(spark, sf_dir)
    seeds = materialise(search.search(pages, QUERY, limit=RESULTS).select("id"), "results")
    out = context.alike_descriptions(pages, seeds, 0.2)
    return out.select("a", "b", F.round("similarity", 9).alias("similarity"))


def context_pages(spark, sf_dir):
    return context.build(_pages(spark, sf_dir), table(spark, sf_dir, "links"), QUERY).pages.select("id", "kind", "position")


def debounce_sessions(spark, sf_dir):
    out = debounced(table(spark, sf_dir, "events"), "ts", ["event_type"], f"{GAP_S} seconds")
    return out.select("event_type", F.unix_micros(F.col("started_at").cast("timestamp")).alias("started_us"), F.unix_micros(F.col("fires_at").cast("timestamp")).alias("fires_us"), "n")


def query_log_days(spark, sf_dir):
    """Distinct log rows per day of the log file and tool, and those of them that are late."""
    rows = table(spark, sf_dir, "query_log").distinct()
    late = F.col("log_date") > F.date_format("ts", "yyyy-MM-dd")
    return rows.groupBy("log_date", "tool").agg(F.count("*").alias("n"), F.count_if(late).alias("n_late"), F.coalesce(F.sum("hits"), F.lit(0)).alias("n_hits"))


_NOTES = """
WITH tg AS (SELECT doc_id, list(DISTINCT tag) AS tags FROM document_tags WHERE tag IS NOT NULL GROUP BY 1),
notes AS (SELECT d.id AS path, title, description, coalesce(tags, []) AS tags, content FROM kb_documents d LEFT JOIN tg ON tg.doc_id = d.id WHERE kind = 'source-note')
"""
_HASH = "sha256(coalesce(title, '') || chr(0) || {0} || chr(0) || path || chr(0) || array_to_string([t || chr(0) for t in list_sort(tags)], ''))"


def _retrieved(pages: str) -> str:
    return rf"""
WITH kw AS (SELECT item_id, lower(unnest(regexp_split_to_array(question, '[^\pL\pN_]+'))) AS k FROM eval_items),
ks AS (SELECT item_id, k, count(*) AS times FROM kw WHERE length(k) > 2 GROUP BY ALL),
p AS (SELECT id, lower(regexp_replace(content, '(?s)^---.*?---\s*', '')) AS t FROM kb_documents {pages}),
per AS (SELECT id, k, (length(t) - length(replace(t, k, ''))) // length(k) AS n FROM p, (SELECT DISTINCT k FROM ks)),
sc AS (SELECT item_id, id, sum(n * times)::BIGINT AS score FROM per JOIN ks USING (k) WHERE n > 0 GROUP BY ALL),
retrieved AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id)::INT AS place FROM sc QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) <= 5)
"""


_HITS = """SELECT e.item_id, (min(place) IS NOT NULL)::INT AS hit, coalesce(1.0::DOUBLE / min(place), 0::DOUBLE) AS rr FROM eval_items e
  LEFT JOIN retrieved r ON r.item_id = e.item_id AND e.expected_page <> '' AND (contains(id, expected_page) OR contains(expected_page, id)) GROUP BY e.item_id"""

_RECORDS = r"""
WITH RECURSIVE keys AS (SELECT doc_id AS ordinal, lower('https://kb.example/' || coalesce(lang, 'und') || '/topic/' || n_chars) AS url,
  CASE WHEN coalesce(source, '') = '' OR coalesce(title, '') = '' THEN '' ELSE lower(trim(regexp_replace(source, '\s+', ' ', 'g'))) || chr(0) || lower(trim(regexp_replace(title, '\s+', ' ', 'g'))) END AS submit,
  n_chars AS topic FROM documents)
"""
#: One record after the other against those kept so far: their places, and which of them a submission was last kept as.
_KEPT = _RECORDS + """, k AS (SELECT *, row_number() OVER (ORDER BY ordinal) AS n FROM keys WHERE url <> '' OR submit <> ''),
r AS (SELECT 0::BIGINT AS n, []::STRUCT(pos BIGINT, ord BIGINT, topic BIGINT, url VARCHAR)[] AS kept, MAP {}::MAP(VARCHAR, BIGINT) AS subs
UNION ALL
SELECT n, CASE WHEN hit IS NULL THEN list_append(kept, {'pos': ordinal, 'ord': ordinal, 'topic': topic, 'url': url})
    WHEN topic > kept[hit].topic THEN kept[:hit - 1] || [{'pos': kept[hit].pos, 'ord': ordinal, 'topic': topic, 'url': url}] || kept[hit + 1:] ELSE kept END,
  CASE WHEN submit <> '' AND (hit IS NULL OR topic > kept[hit].topic) THEN map_concat(subs, MAP {submit: coalesce(hit, len(kept) + 1)}) ELSE subs END
FROM (SELECT k.*, kept, subs, coalesce(CASE WHEN url <> '' THEN nullif(list_position([x.url for x in kept], url), 0) END, CASE WHEN submit <> '' THEN subs[submit] END) AS hit FROM r JOIN k ON k.n = r.n + 1)),
kept_rows AS (SELECT x.pos AS position, x.ord AS ordinal FROM (SELECT unnest(kept) AS x FROM (SELECT kept FROM r ORDER BY n DESC LIMIT 1))
  UNION ALL SELECT ordinal, ordinal FROM keys WHERE url = '' AND submit = '')
"""
_COUNTED = r"""sum(CASE WHEN key = '{0}' AND value LIKE '[%' THEN len([x for x in string_split(trim(value, '[]'), ',') if trim(x, ' ' || chr(34) || chr(39)) <> '']) WHEN bare LIKE '-%' AND filling = '{0}' THEN 1 ELSE 0 END)"""
_UNQUOTED = "CASE WHEN length({0}) >= 2 AND left({0}, 1) = right({0}, 1) AND left({0}, 1) IN (chr(34), chr(39)) THEN trim({0}[2:-2]) ELSE {0} END"
_NOTE_FIELDS = rf"""
WITH hd AS (SELECT id, regexp_extract(content, '(?s)^---.*?\n---') AS h FROM kb_documents WHERE regexp_matches(id, '^wiki/source-notes/.*\.md$') AND regexp_extract(id, '[^/]*$') NOT IN ('index.md', 'log.md')),
ln AS (SELECT id, unnest(ls) AS raw, unnest(range(1, len(ls) + 1)) AS n FROM (SELECT id, string_split(substr(h, 4, length(h) - 7), chr(10)) AS ls FROM hd WHERE h <> '')),
tr AS (SELECT id, n, rtrim(raw, ' ' || chr(13)) AS line FROM ln),
kv AS (SELECT *, trim(line, ' ' || chr(9) || chr(13)) AS bare, split_part(line, ':', 1) AS key, CASE WHEN contains(line, ':') THEN trim(substr(line, strpos(line, ':') + 1), ' ' || chr(9) || chr(13)) ELSE '' END AS value FROM tr),
st AS (SELECT *, CASE WHEN key IN ('title', 'description') THEN '' WHEN key IN ('tags', 'key_claims') AND contains(line, ':') THEN CASE WHEN value LIKE '[%' THEN '' ELSE key END
  WHEN bare LIKE '-%' THEN NULL WHEN line <> '' AND left(line, 1) NOT IN (' ', chr(9)) THEN '' END AS opens FROM kv),
fl AS (SELECT *, last_value(opens IGNORE NULLS) OVER (PARTITION BY id ORDER BY n) AS filling FROM st),
n AS (SELECT id, arg_max(value, n) FILTER (key = 'title') AS title, arg_max(value, n) FILTER (key = 'description') AS description, {_COUNTED.format("tags")} AS n_tags, {_COUNTED.format("key_claims")} AS n_claims FROM fl GROUP BY id),
q AS (SELECT hd.id, coalesce(title, '') AS t, coalesce(description, '') AS d, coalesce(n_tags, 0)::INT AS n_tags, coalesce(n_claims, 0)::INT AS n_claims FROM hd LEFT JOIN n ON n.id = hd.id)
SELECT id AS path, {_UNQUOTED.format("t")} AS title, {_UNQUOTED.format("d")} AS description, n_tags, n_claims FROM q"""

QUERIES = {
    f.__name__: f
    for f in (
        topic_filter, note_fields, note_hashes, notes_changed, tag_overlap_notes, draft_routes, light_notes, entity_mentions, record_keys, record_dedup, import_totals,
        naive_keyword_score, eval_hit_mrr, eval_means, eval_comparison, alike_descriptions, context_pages, debounce_sessions, query_log_days,
    )
}
SQL = {
    "topic_filter": _NOTES + f"SELECT path FROM notes WHERE contains(lower(coalesce(title, '')), '{TOPIC}') OR len([t for t in tags if contains(lower(t), '{TOPIC}')]) > 0",
    "note_hashes": _NOTES + f"SELECT path, {_HASH.format("coalesce(description, '')")} AS hash FROM notes",
    "notes_changed": _NOTES + "SELECT path FROM notes WHERE coalesce(description, '') <> ''",
    "tag_overlap_notes": _NOTES
    + """, t AS (SELECT DISTINCT path, lower(unnest(tags)) AS tag FROM notes),
near AS (SELECT DISTINCT a.path AS seed, b.path FROM t a JOIN t b ON a.tag = b.tag AND a.path <> b.path)
SELECT path AS seed, path, 1 AS place FROM notes UNION ALL
SELECT seed, path, (1 + row_number() OVER (PARTITION BY seed ORDER BY path))::INT AS place FROM near QUALIFY row_number() OVER (PARTITION BY seed ORDER BY path) <= 9""",
    "draft_routes": r"""
WITH cited AS (SELECT source_doc_id AS id, count(DISTINCT target_doc_id) AS n FROM links WHERE relation = 'cites' GROUP BY 1),
pl AS (SELECT kind, regexp_replace(regexp_extract(d.id, '[^/]*$'), '\.[^.]*$', '') AS slug, n FROM kb_documents d JOIN cited USING (id)
  WHERE kind IN ('concept', 'comparison', 'decision', 'wiki-concept', 'wiki-comparison', 'wiki-decision')),
h AS (SELECT id, coalesce(try_cast(regexp_extract(content, '(?m)^source_count:\s*(\d+)', 1) AS INT), 0) AS c FROM kb_documents),
j AS (SELECT pl.*, 'wiki/' || kind || 's/' || slug || '.md' AS page, 'wiki/' || kind || 's/_draft/' || slug || '.md' AS draft, p.c AS pc, q.c AS qc
  FROM pl LEFT JOIN h p ON p.id = 'wiki/' || kind || 's/' || slug || '.md' LEFT JOIN h q ON q.id = 'wiki/' || kind || 's/_draft/' || slug || '.md'),
r AS (SELECT *, CASE WHEN pc IS NOT NULL THEN false WHEN qc IS NOT NULL THEN true ELSE n < 2 END AS is_draft FROM j)
SELECT CASE WHEN is_draft THEN draft ELSE page END AS dest, is_draft, CASE WHEN coalesce(pc, qc) IS NULL THEN 'create' WHEN coalesce(pc, qc) + n >= 5 THEN 'rewrite' ELSE 'append' END AS step, count(*) AS n
FROM r GROUP BY ALL""",
    "entity_mentions": r"""
WITH e AS (SELECT id, unnest(regexp_extract_all(content, '【([^|】]+)\|([^】]+)】', 1)) AS name FROM kb_documents),
t AS (SELECT id, trim(name) AS t FROM e), m AS (SELECT id, CASE WHEN t = lower(t) AND regexp_matches(t, '^[a-zA-Z]') THEN upper(t[1]) || t[2:] ELSE t END AS tag FROM t)
SELECT id, tag, count(*) AS n FROM m WHERE """
    + f"{GOOD_TAG} GROUP BY ALL",
    "record_keys": _RECORDS + "SELECT ordinal, url AS url_key, submit AS submit_key, topic AS topic_id FROM keys",
    "record_dedup": _KEPT + "SELECT * FROM kept_rows",
    "import_totals": _KEPT + 'SELECT (SELECT count(*) FROM keys) AS total, count(*) AS "unique", (SELECT count(*) FROM keys) - count(*) AS removed FROM kept_rows',
    "note_fields": _NOTE_FIELDS,
    "light_notes": rf"""
WITH t AS (SELECT id, content, regexp_extract(content, '(?m)^[ \t]*(# [^\n]*|\*\*[^\n]*\*\*)[ \t\r]*$', 1) AS line FROM kb_documents WHERE layer = 'raw'),
u AS (SELECT id, content, CASE WHEN line = '' THEN {_STEM} WHEN starts_with(line, '# ') THEN {_trimmed("substr(line, 3)")} ELSE regexp_replace(line, '^\*+|\*+$', '', 'g') END AS title FROM t),
v AS (SELECT *, regexp_replace(regexp_replace(content, '{nt._DATA_IMAGE}', '(an image stood here)', 'g'), '{nt._MEDIA_IMAGE}', '', 'g') AS cleaned FROM u)
SELECT id, title, ({len(nt._LIGHT_HEAD % ("", "", STAMP, ""))} + strlen(replace(replace(title, '\', '\\'), '"', '\"')) + strlen(id) + strlen({_trimmed("cleaned")}))::INT AS n_bytes FROM v""",
    "naive_keyword_score": _retrieved("WHERE layer = 'raw'") + "SELECT item_id, id, score, place FROM retrieved",
    "eval_hit_mrr": _retrieved("") + _HITS,
    "eval_means": _retrieved("") + f", s AS ({_HITS}) SELECT suite, round(avg(hit), 9) AS hit, round(avg(rr), 9) AS rr FROM s JOIN eval_items USING (item_id) GROUP BY suite",
    "eval_comparison": f"WITH a AS ({_retrieved('')} {_HITS}), b AS ({_retrieved("WHERE layer = 'raw'")} {_HITS}) "
    + " UNION ALL ".join(
        f"SELECT '{m}' AS metric, round(x, 9) AS ours, round(y, 9) AS theirs, round(x - y, 9) AS delta FROM (SELECT avg({m}) AS x FROM a), (SELECT avg({m}) AS y FROM b)" for m in ("hit", "rr")
    ),
    "alike_descriptions": search_queries.BASE
    + search_queries.phases_sql("p", "true", RESULTS)
    + r""", d AS (SELECT id, list_distinct([w for w in regexp_split_to_array(lower(description), '\s+') if length(w) >= 2]) AS w FROM p WHERE description <> ''),
q AS (SELECT a.id AS a, b.id AS b, len(list_intersect(a.w, b.w)) AS k, len(a.w) + len(b.w) AS n FROM d a JOIN d b ON a.id < b.id)
SELECT a, b, round(k / (n - k), 9) AS similarity FROM q WHERE k / (n - k) > 0.2""",
    "debounce_sessions": f"""
WITH o AS (SELECT event_type, epoch_us(ts) AS t, coalesce(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY event_type ORDER BY ts) >= {GAP_S} * 1000000, true) AS opens FROM events),
g AS (SELECT *, sum(opens::INT) OVER (PARTITION BY event_type ORDER BY t ROWS UNBOUNDED PRECEDING) AS s FROM o)
SELECT event_type, min(t) AS started_us, max(t) + {GAP_S} * 1000000 AS fires_us, count(*) AS n FROM g GROUP BY event_type, s""",
    "query_log_days": """SELECT log_date, tool, count(*) AS n, count(*) FILTER (log_date > strftime(ts, '%Y-%m-%d')) AS n_late, coalesce(sum(hits), 0)::BIGINT AS n_hits
FROM (SELECT DISTINCT * FROM query_log) GROUP BY ALL""",
}
