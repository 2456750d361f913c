"""Queries of problem 7: evaluation passages in the corpus."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..session import materialise, table
from .leak import decontaminated, find_leaks


def _leaks(spark, sf_dir):
    return find_leaks(table(spark, sf_dir, "documents"), "doc_id", "text", table(spark, sf_dir, "eval_items"), "item_id", "ground_truth")


def p7_found(spark, sf_dir):
    return _leaks(spark, sf_dir).select("doc_id", "item_id").distinct()


def p7_leaked_items(spark, sf_dir):
    """The items that leaked, in how many documents, and the longest stretch of words found."""
    return _leaks(spark, sf_dir).groupBy("item_id").agg(F.countDistinct("doc_id").alias("n_documents"), F.max("n_words").alias("longest"))


def p7_decontaminated(spark, sf_dir):
    leaks = materialise(_leaks(spark, sf_dir), "leaks")
    return decontaminated(table(spark, sf_dir, "documents"), "doc_id", "text", leaks)


def _words(column: str) -> str:
    """SQL for the words of a column. DuckDB has no NFKC: composing is its own, and the compatibility characters of these tables (full-width forms,
    the ellipsis, wide and hard blanks) are replaced before."""
    wide, plain = "".join(chr(c) for c in range(0xFF01, 0xFF5F)), "".join(chr(c) for c in range(0x21, 0x7F)).replace("'", "''")
    plain_text = f"lower(nfc_normalize(translate(replace({column}, '\u2026', '...'), '{wide}\u3000\xa0', '{plain}  ')))"
    return rf"regexp_extract_all(regexp_replace({plain_text}, '([\x{{4E00}}-\x{{9FFF}}])', ' \1 ', 'g'), '[\p{{L}}\p{{N}}]+')"


_RUNS = f"""
WITH d AS (SELECT doc_id, {_words("text")} AS ws FROM documents), i AS (SELECT item_id, {_words("ground_truth")} AS ws FROM eval_items),
ig AS (SELECT DISTINCT item_id, least(16, len(ws)) AS n, array_to_string(ws[j : j + least(16, len(ws)) - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - least(16, len(ws)) + 2)) AS j FROM i WHERE len(ws) > 0)),
dg AS (SELECT doc_id, n, j, array_to_string(ws[j : j + n - 1], ' ') AS g FROM (SELECT *, unnest(range(1, len(ws) - n + 2)) AS j FROM d, (SELECT DISTINCT n FROM ig) WHERE len(ws) >= n)),
m AS (SELECT doc_id, item_id, n, j, j - row_number() OVER (PARTITION BY doc_id, item_id ORDER BY j) AS run FROM dg JOIN ig USING (n, g)),
runs AS (SELECT doc_id, item_id, count(*) + n - 1 AS n_words FROM m GROUP BY doc_id, item_id, n, run)
"""

QUERIES = {"p7_found": p7_found, "p7_leaked_items": p7_leaked_items, "p7_decontaminated": p7_decontaminated}
SQL = {
    "p7_found": _RUNS + "SELECT DISTINCT doc_id, item_id FROM runs",
    "p7_leaked_items": _RUNS + "SELECT item_id, count(DISTINCT doc_id) AS n_documents, max(n_words)::INT AS longest FROM runs GROUP BY item_id",
}
