"""Queries of problem 8: long stretches shared between documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .spans import coverage, removed, shared_between


def p8_found(spark, sf_dir):
    members, pairs = shared_between(table(spark, sf_dir, "documents"), "doc_id", "text")
    one, two = members.select("digest", F.col("id").alias("x")), members.select("digest", F.col("id").alias("y"))
    across = pairs.join(one.withColumnRenamed("digest", "class_a").hint("merge"), "class_a").join(two.withColumnRenamed("digest", "class_b").hint("merge"), "class_b").select("x", "y")
    within = one.join(two.hint("merge"), "digest").where("x < y").select("x", "y")
    both = across.where("x <> y").unionByName(within)
    return both.select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b")).distinct()


def p8_coverage(spark, sf_dir):
    """Per document with shared stretches: its characters, those of them that stand in other documents, and the copies of the whole text."""
    return coverage(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


def p8_removed(spark, sf_dir):
    """Every document that loses a span, without what stands in a document before it."""
    return removed(table(spark, sf_dir, "documents"), "doc_id", "text").withColumnRenamed("id", "doc_id")


_SHARED = """
WITH w AS (SELECT doc_id, i, md5(substr(text, i, 400)) AS h FROM (SELECT doc_id, text, unnest(range(1, length(text) - 398)) AS i FROM documents WHERE length(text) >= 400)),
s AS (SELECT h FROM w GROUP BY h HAVING min(doc_id) < max(doc_id))
"""

QUERIES = {"p8_found": p8_found, "p8_coverage": p8_coverage, "p8_removed": p8_removed}
SQL = {
    "p8_found": _SHARED
    + """, m AS (SELECT DISTINCT doc_id, h FROM w JOIN s USING (h))
SELECT DISTINCT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b FROM m a JOIN m b ON a.h = b.h AND a.doc_id < b.doc_id""",
    "p8_coverage": _SHARED
    + """, m AS (SELECT doc_id, least(coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 400), 400) AS n FROM w JOIN s USING (h)),
c AS (SELECT doc_id, sum(n)::BIGINT AS n_shared FROM m GROUP BY doc_id)
SELECT doc_id, length(text)::INT AS n_chars, n_shared, count(*) OVER (PARTITION BY md5(text)) AS copies FROM c JOIN documents USING (doc_id)""",
    "p8_removed": _SHARED.replace("SELECT h FROM w", "SELECT h, min(doc_id) AS lead FROM w")
    + """, m AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM w JOIN s USING (h) WHERE doc_id > lead),
k AS (SELECT doc_id, text, i, coalesce(p + 400, 1) AS a, i - coalesce(p + 400, 1) AS n, min(length(text)) OVER (PARTITION BY doc_id) AS l FROM m JOIN documents USING (doc_id)),
r AS (SELECT doc_id, any_value(text) AS text, max(i) + 400 AS t, any_value(l) AS l, string_agg(CASE WHEN n > 0 THEN substr(text, a, n) ELSE '' END, '' ORDER BY i) AS kept FROM k GROUP BY doc_id)
SELECT doc_id, l - length(kept || substr(text, t)) AS n_removed, kept || substr(text, t) AS text FROM r""",
}
