from collections import Counter

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lorekeep.llm.pack import _Bins, cut_text, pack


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 100), max_size=80), st.integers(1, 5))
def test_bins_hold_everything_once(sizes, most):
    bins = _Bins(100, most, 0)
    for i, n in enumerate(sizes):
        bins.put((i, 0, 0, n), n)
        assert len(bins.room) <= most
    done = bins.take() + bins.left()
    assert Counter(i[0] for b in done for i in b[2]) == Counter(range(len(sizes)))
    assert all(b[1] == sum(i[3] for i in b[2]) <= 100 for b in done)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="aé字🙂", max_size=60), st.integers(8, 20))
def test_cut_text(text, capacity):
    data = text.encode()
    parts = list(cut_text(data, capacity))
    assert b"".join(data[a : a + n] for a, n in parts) == data
    assert all(n <= capacity for _, n in parts) and parts[-1][1] + 1 <= capacity
    for a, n in parts:
        data[a : a + n].decode()


def test_rows(spark):
    texts = ["a" * n for n in (10, 99, 100, 250, 0, 60, 39)] + [None, "字" * 50]
    rows = [(i, t, "x") for i, t in enumerate(texts)] + [(0, "a" * 10, "x"), (None, "b", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, container string").repartition(3)
    bins = pack(df, "doc_id", "text", capacity=100, open_bins=2).collect()
    assert len({b.container for b in bins}) == len(bins)
    got = Counter()
    for b in bins:
        assert b.fill == sum(i.tokens for i in b["items"]) <= 100
        got.update({(i.id, i.piece) for i in b["items"]})
        for i in b["items"]:
            got[("tokens", i.id)] += i.tokens
    want = Counter()
    for i, t, _ in rows:
        want[i] += len((t or "").encode()) + 1
    assert {k[1]: n for k, n in got.items() if k[0] == "tokens"} == want
    cut = {k[0] for k in got if k[0] != "tokens" and k[1]}
    assert cut == {i for i, t, _ in rows if len((t or "").encode()) + 1 > 100}
    assert pack(df.limit(0), "doc_id", "text").count() == 0


def test_few_containers(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.repeat(F.lit("a"), (F.hash("id") % 1500 + 1500).cast("int")).alias("text")).repartition(6)
    a = pack(df, "doc_id", "text").agg(F.count("*").alias("n"), F.sum("fill").alias("t")).first()
    assert a.n <= 1.02 * (a.t / 8192) + 1
