"""Queries of problem 5: oversized pages in pieces."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .split import split_oversized


def p5_found(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "kb_documents"), "id", "content").select("id", "cut").distinct()


def p5_pieces(spark, sf_dir):
    return split_oversized(table(spark, sf_dir, "kb_documents"), "id", "content")


def p5_added_bytes(spark, sf_dir):
    """Per page, the bytes its pieces add: all of the page's."""
    pieces = split_oversized(table(spark, sf_dir, "kb_documents"), "id", "content")
    return pieces.groupBy("id").agg(F.sum(F.octet_length("text") - F.col("overlap")).alias("n_bytes"))


def p5_invariants(spark, sf_dir):
    """What must hold of each page's pieces: all of at most 5,000 bytes; overlaps of 200 to 400 bytes after the first; joined without overlaps they are the page
    (its MD5); forced cuts only where a stretch without boundary does not fit beside an overlap (more than 4,796 bytes)."""
    pieces = split_oversized(table(spark, sf_dir, "kb_documents"), "id", "content")
    size, n, first = F.octet_length("text"), F.col("overlap"), F.col("piece") == 0
    added = F.expr("substring(encode(text, 'UTF-8'), overlap + 1)")
    joined = F.aggregate(F.sort_array(F.collect_list(F.struct("piece", added.alias("added")))), F.lit(b""), lambda x, y: F.concat(x, y["added"]))
    checks = [F.every(size <= 5000).alias("fits"), F.every(F.when(first, n == 0).otherwise(n.between(200, 400))).alias("overlaps"), F.md5(joined).alias("rejoined"), F.some(F.col("boundary") == "forced").alias("forced")]
    return pieces.groupBy("id").agg(*checks)


QUERIES = {"p5_found": p5_found, "p5_pieces": p5_pieces, "p5_added_bytes": p5_added_bytes, "p5_invariants": p5_invariants}
_RUN = r"list_max([strlen(x) for x in regexp_split_to_array(content, '[ \t\r\n\x{3002}\x{FF01}\x{FF1F}]')])"
SQL = {
    "p5_found": f"SELECT DISTINCT id, CASE WHEN {_RUN} > 5000 THEN 'forced' ELSE 'natural' END AS cut FROM kb_documents WHERE strlen(content) > 5000",
    "p5_invariants": f"SELECT id, true AS fits, true AS overlaps, md5(content) AS rejoined, {_RUN} > 4796 AS forced FROM kb_documents WHERE strlen(content) > 5000",
    "p5_added_bytes": "SELECT id, sum(strlen(content))::BIGINT AS n_bytes FROM kb_documents WHERE strlen(content) > 5000 GROUP BY id",
}
