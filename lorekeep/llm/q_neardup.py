"""Queries of problem 4: versions of one page."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from ..operators.components import components
from .neardup import similar_texts

THRESHOLD = 0.6


def p4_found(spark, sf_dir):
    members, pairs = similar_texts(table(spark, sf_dir, "kb_documents"), "id", "content", THRESHOLD)
    one, two = members.select("k", F.col("id").alias("x")), members.select("k", F.col("id").alias("y"))
    across = pairs.join(one.withColumnRenamed("k", "k_a"), "k_a").join(two.withColumnRenamed("k", "k_b"), "k_b").where("x <> y").select("x", "y")
    within = one.join(two, "k").where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("id_a"), F.greatest("x", "y").alias("id_b")).distinct()


def p4_groups(spark, sf_dir):
    """One row per page that has versions: its group (the least id in it) and the group's size. Groups are the connected components
    of similar pages; copies are linked through their class, never expanded into pairs."""
    members, pairs = similar_texts(table(spark, sf_dir, "kb_documents"), "id", "content", THRESHOLD, connected=True)
    roots = components(pairs.toDF("u", "v", "similarity"))
    placed = members.join(roots, members["k"] == roots["node"], "left").select("id", F.coalesce("root", "k").alias("root")).distinct()
    groups = placed.groupBy("root").agg(F.min("id").alias("group_id"), F.count("*").alias("n_pages")).where("n_pages > 1")
    return placed.join(groups, "root").select("id", "group_id", "n_pages")


_PAIRS = r"""
WITH w AS (SELECT id, regexp_extract_all(regexp_replace(lower(content), '([\x{4E00}-\x{9FFF}])', ' \1 ', 'g'), '[\p{L}\p{N}]+') AS ws FROM kb_documents),
g AS (SELECT DISTINCT id, s FROM (SELECT id, unnest([ws[i] || ' ' || ws[i+1] || ' ' || ws[i+2] for i in range(1, len(ws) - 1)]) AS s FROM w WHERE len(ws) >= 3)),
n AS (SELECT id, count(*) AS n FROM g GROUP BY id),
o AS (SELECT a.id AS id_a, b.id AS id_b, count(*) AS k FROM g a JOIN g b ON a.s = b.s AND a.id < b.id GROUP BY 1, 2),
pairs AS (SELECT id_a, id_b FROM o JOIN n na ON na.id = id_a JOIN n nb ON nb.id = id_b WHERE 10 * k >= 6 * (na.n + nb.n - k))
"""

QUERIES = {"p4_found": p4_found, "p4_groups": p4_groups}
SQL = {
    "p4_found": _PAIRS + "SELECT id_a, id_b FROM pairs",
    "p4_groups": _PAIRS.replace("WITH w AS", "WITH RECURSIVE w AS")
    + """, e AS (SELECT id_a AS x, id_b AS y FROM pairs UNION SELECT id_b, id_a FROM pairs),
r AS (SELECT x, y FROM e UNION SELECT r.x, e.y FROM r JOIN e ON r.y = e.x),
l AS (SELECT x AS id, min(y) AS group_id FROM r GROUP BY x)
SELECT id, group_id, count(*) OVER (PARTITION BY group_id) AS n_pages FROM l""",
}
