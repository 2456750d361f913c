"""Queries of problem 6: documents in containers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import table
from .pack import CAPACITY, pack


def _packed(spark, sf_dir):
    return pack(table(spark, sf_dir, "documents"), "doc_id", "text")


def p6_found(spark, sf_dir):
    items = _packed(spark, sf_dir).select(F.inline("items"))
    return items.where("piece > 0").select(F.col("id").alias("doc_id")).distinct()


def p6_assignments(spark, sf_dir):
    items = _packed(spark, sf_dir).select("container", F.inline("items"))
    return items.select(F.col("id").alias("doc_id"), "piece", "start", "tokens", "container")


def p6_tokens(spark, sf_dir):
    """Per document its tokens over all containers."""
    return p6_assignments(spark, sf_dir).groupBy("doc_id").agg(F.sum("tokens").alias("tokens"))


def p6_summary(spark, sf_dir):
    """Containers used, the least number any packing needs, and the share of capacity used."""
    fills = _packed(spark, sf_dir).agg(F.count("*").alias("containers"), F.sum("fill").alias("tokens"), F.max("fill").alias("fullest"))
    least = F.ceil(F.col("tokens") / CAPACITY)
    return fills.select("containers", "tokens", "fullest", least.alias("least"), (F.col("tokens") / (F.col("containers") * CAPACITY)).alias("used"))


def p6_bounds(spark, sf_dir):
    """What must hold of the containers: no more than a hundredth (and one) above the least number that any packing needs, none overfull, each filled as its items say,
    no item cut that fits a container, and all tokens there."""
    packed = _packed(spark, sf_dir)
    held = F.aggregate("items", F.lit(0), lambda n, x: n + x["tokens"])
    sums = packed.agg(F.count("*").alias("n"), F.sum("fill").alias("tokens"), F.every((F.col("fill") <= CAPACITY) & (F.col("fill") == held)).alias("fits"))
    items = packed.select(F.inline("items")).groupBy("id").agg(F.max("piece").alias("last"), F.sum("tokens").alias("size"))
    cut = items.agg(F.coalesce(F.every((F.col("last") == 0) | (F.col("size") > CAPACITY)), F.lit(True)).alias("whole"), F.count("*").alias("n_documents"))
    least = F.ceil(F.col("tokens") / CAPACITY)
    return sums.withColumn("_", F.lit(1)).join(cut.withColumn("_", F.lit(1)), "_").select("tokens", "n_documents", "fits", "whole", (F.col("n") <= F.ceil(least * 1.01) + 1).alias("few"))


QUERIES = {"p6_found": p6_found, "p6_assignments": p6_assignments, "p6_tokens": p6_tokens, "p6_summary": p6_summary, "p6_bounds": p6_bounds}
SQL = {
    "p6_found": f"SELECT DISTINCT doc_id FROM documents WHERE strlen(text) + 1 > {CAPACITY}",
    "p6_tokens": "SELECT doc_id, sum(coalesce(strlen(text), 0) + 1)::BIGINT AS tokens FROM documents GROUP BY doc_id",
    "p6_bounds": "SELECT sum(coalesce(strlen(text), 0) + 1)::BIGINT AS tokens, count(DISTINCT doc_id) AS n_documents, true AS fits, true AS whole, true AS few FROM documents",
}
