"""Queries of problem 2: tag frequencies."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .terms import tag_frequencies


def p2_found(spark, sf_dir):
    marked = tag_frequencies(table(spark, sf_dir, "document_tags"), table(spark, sf_dir, "kb_documents"))
    return marked.where(F.col("mark").isNotNull()).select(F.col("term").alias("tag"), "mark")


def p2_frequencies(spark, sf_dir):
    return tag_frequencies(table(spark, sf_dir, "document_tags"), table(spark, sf_dir, "kb_documents")).withColumnRenamed("term", "tag")


#: Tags cleaned as the operator does it.
TAGS = r"""tags AS (SELECT doc_id, lower(regexp_replace(tag, '^[\s\x1c-\x1f\x{85}\pZ]+|[\s\x1c-\x1f\x{85}\pZ]+$', '', 'g')) AS tag FROM document_tags)"""
_COUNTS = f"""
WITH {TAGS},
n AS (SELECT greatest(5, count(*) // 20) AS most FROM kb_documents),
c AS (SELECT tag, count(*) AS n_rows, count(DISTINCT doc_id) AS n_records FROM tags WHERE tag <> '' GROUP BY tag),
marked AS (SELECT tag, n_rows, n_records, CASE WHEN n_records < 3 THEN 'rare' WHEN n_records > most THEN 'common' END AS mark FROM c, n)
"""

QUERIES = {"p2_found": p2_found, "p2_frequencies": p2_frequencies}
SQL = {
    "p2_found": _COUNTS + "SELECT tag, mark FROM marked WHERE mark IS NOT NULL",
    "p2_frequencies": _COUNTS + "SELECT tag, n_rows, n_records, mark FROM marked",
}
