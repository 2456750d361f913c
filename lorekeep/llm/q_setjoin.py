"""Queries of problem 3: pages with similar tag sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .q_terms import TAGS
from .setjoin import expand_pairs, record_sets, similar_between, similar_sets

LEAST, THRESHOLD = 3, 0.6


def _similar(spark, sf_dir):
    return similar_sets(record_sets(table(spark, sf_dir, "document_tags"), "doc_id", "tag", LEAST), THRESHOLD)


def p3_found(spark, sf_dir):
    return expand_pairs(*_similar(spark, sf_dir)).toDF("doc_id_a", "doc_id_b")


def p3_links_per_page(spark, sf_dir):
    """Per page its class (the least page with the same tags) and the number of pages similar to it, without expanding copies into pairs."""
    members, pairs = _similar(spark, sf_dir)
    sizes = members.groupBy("class_id").agg(F.count("*").alias("n"), F.min("record").alias("class_page"))
    sides = pairs.select(F.col("class_a").alias("class_id"), F.col("class_b").alias("other"))
    sides = sides.unionByName(pairs.select(F.col("class_b").alias("class_id"), F.col("class_a").alias("other")))
    reach = sides.join(sizes.select(F.col("class_id").alias("other"), "n"), "other").groupBy("class_id").agg(F.sum("n").alias("others"))
    links = F.col("n") - 1 + F.coalesce("others", F.lit(0))
    return (
        members.join(sizes, "class_id").join(reach, "class_id", "left").select(F.col("record").alias("doc_id"), "class_page", links.alias("n_links"))
    )


def p3_between(spark, sf_dir):
    """Raw files and wiki pages with similar tags: pairs between two tables."""
    tags = table(spark, sf_dir, "document_tags")
    raw, wiki = (record_sets(tags.where(F.col("doc_id").startswith(layer)), "doc_id", "tag", LEAST) for layer in ("raw/", "wiki/"))
    return similar_between(raw, wiki, THRESHOLD).toDF("raw_id", "wiki_id")


_SETS = f"""
WITH {TAGS},
d AS (SELECT DISTINCT doc_id, tag FROM tags WHERE doc_id IS NOT NULL AND tag <> ''),
s AS (SELECT doc_id, count(*) AS n FROM d GROUP BY 1 HAVING count(*) >= {LEAST}),
o AS (SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, count(*) AS k
      FROM d a JOIN d b ON a.tag = b.tag AND a.doc_id < b.doc_id GROUP BY 1, 2),
pairs AS (SELECT doc_id_a, doc_id_b FROM o JOIN s sa ON sa.doc_id = doc_id_a JOIN s sb ON sb.doc_id = doc_id_b
          WHERE 10 * k >= 6 * (sa.n + sb.n - k))
"""

QUERIES = {"p3_found": p3_found, "p3_links_per_page": p3_links_per_page, "p3_between": p3_between}
SQL = {
    "p3_found": _SETS + "SELECT doc_id_a, doc_id_b FROM pairs",
    "p3_between": _SETS
    + """, both_ways AS (SELECT doc_id_a AS raw_id, doc_id_b AS wiki_id FROM pairs UNION ALL SELECT doc_id_b, doc_id_a FROM pairs)
SELECT * FROM both_ways WHERE raw_id LIKE 'raw/%' AND wiki_id LIKE 'wiki/%'""",
    "p3_links_per_page": _SETS
    + """, both_ways AS (SELECT doc_id_a AS doc_id, doc_id_b AS o FROM pairs UNION ALL SELECT doc_id_b, doc_id_a FROM pairs),
sets AS (SELECT doc_id, string_agg(tag, chr(1) ORDER BY tag) AS tags FROM d JOIN s USING (doc_id) GROUP BY 1),
classes AS (SELECT tags, min(doc_id) AS class_page FROM sets GROUP BY 1)
SELECT doc_id, class_page, count(o) AS n_links FROM sets JOIN classes USING (tags) LEFT JOIN both_ways USING (doc_id) GROUP BY 1, 2""",
}
