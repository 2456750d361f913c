from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from lorekeep.llm.terms import _PARTIAL, _aggregate, tag_frequencies, term_counts

ROWS = (
    [(f"d{i % 7}", " Hot　", "x") for i in range(300)]
    + [("d1", " Rare ", None), ("d1", "rare", "s"), (None, "rare", "s"), ("d2", None, "s"), ("d3", "  ", "s"), ("d4", "", "s"), ("d5", "Ünï Tag", "s")]
    + [(f"d{i}", f"t{i % 50}", "s") for i in range(200)]
)


def expected(rows):
    n, docs = Counter(), defaultdict(set)
    for doc, tag, _ in rows:
        t = (tag or "").strip().lower()
        if t:
            n[t] += 1
            docs[t] |= {doc} - {None}
    return {(t, n[t], len(docs[t])) for t in n}


@pytest.mark.parametrize(("leaf_rows", "leaf_bytes"), [(1_000_000, 1 << 26), (8, 1 << 26), (1_000_000, 500)])
def test_counts(spark, leaf_rows, leaf_bytes):
    df = spark.createDataFrame(ROWS, "doc_id string, tag string, term string")
    assert {tuple(r) for r in term_counts(df, "tag", "doc_id", leaf_rows, leaf_bytes).collect()} == expected(ROWS)
    assert term_counts(df, "tag", "doc_id", leaf_rows, leaf_bytes).count() == len(expected(ROWS))


def test_long_terms_split_by_bytes(tmp_path):
    """Rows of a legal leaf's number, with long terms, are split by bytes before DuckDB's memory is full, and the folder is gone afterwards."""
    n, size = 300_000, 400
    terms = [f"{i:0{size}d}" for i in range(n)]
    h = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, n)
    table = pa.table([pa.array(h), pa.array(terms), pa.array([1] * n), pa.array([1] * n)], schema=_PARTIAL)
    out = list(_aggregate(f"file://{tmp_path}", (1_000_000, 16 << 20), 3)(iter(table.to_batches(10_000))))
    assert sum(b.num_rows for b in out) == n and max(b.nbytes for b in out) <= 17 << 20
    assert [p for p in tmp_path.rglob("*") if p.is_file()] == []


def test_marks(spark):
    df = spark.createDataFrame(ROWS, "doc_id string, tag string, mark string")
    for n, hot in ((100, "common"), (140, None)):
        marks = {r.term: r.mark for r in tag_frequencies(df, spark.range(n)).collect()}
        assert marks["hot"] == hot and marks["rare"] == "rare" and marks["t1"] is None


def test_empty(spark):
    df = spark.createDataFrame(ROWS, "doc_id string, tag string, source string").limit(0)
    assert term_counts(df, "tag", "doc_id").collect() == []
