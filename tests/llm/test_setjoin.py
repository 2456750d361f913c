import random

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.setjoin import expand_pairs, record_sets, similar_between, similar_sets


def brute(rows, least, threshold):
    sets = {}
    for r, t, *_ in rows:
        t = (t or "").strip().lower()
        if r is not None and t:
            sets.setdefault(r, set()).add(t)
    sets = {k: v for k, v in sets.items() if len(v) >= least}
    return {(a, b) for a in sets for b in sets if a < b and len(sets[a] & sets[b]) >= threshold * len(sets[a] | sets[b]) - 1e-9}


def found(spark, rows, least, threshold):
    df = spark.createDataFrame(rows, "record string, tag string, item string")
    return [tuple(r) for r in expand_pairs(*similar_sets(record_sets(df, "record", "tag", least), threshold)).collect()]


def test_random_sets_with_copies_and_dirt(spark):
    rng = random.Random(5)
    rows = []
    for i in range(250):
        base = rng.randrange(60)
        for t in [f"T{base}a", f"t{base}b ", f"t{base}c", "common", f"x{rng.randrange(40)}", f"t{base}d"][: rng.randrange(1, 7)]:
            rows.append((f"d{i:03d}", t, "e"))
    rows += [(f"copy{i}", t, None) for i in range(20) for t in ("p", "q", "r")]
    rows += [(None, "p", "e"), ("d001", None, "e"), ("d001", " ", "e"), ("d001", "COMMON", "e")]
    for least, threshold in ((3, 0.6), (1, 0.5), (2, 1.0)):
        got = found(spark, rows, least, threshold)
        assert len(got) == len(set(got))
        assert set(got) == brute(rows, least, threshold)


def test_two_tables(spark):
    rng = random.Random(6)
    sets = lambda n: [(f"d{i % 90}", f"t{rng.randrange(9)}", "x") for i in range(n)]
    rows = {"l": sets(500), "r": sets(400) + [("d0", t, "x") for t in "pqr"]}
    rows["l"] += [(f"copy{i}", t, "x") for i in range(5) for t in "pqr"]
    left, right = (record_sets(spark.createDataFrame(rows[x], "record string, tag string, side string"), "record", "tag", 2) for x in "lr")
    got = [tuple(r) for r in similar_between(left, right, 0.5).collect()]
    both = [(x + r, t) for x in "lr" for r, t, _ in rows[x]]
    want = {(a[1:], b[1:]) for a, b in brute(both, 2, 0.5) if a[0] == "l" and b[0] == "r"}
    assert len(got) == len(set(got)) and set(got) == want and len(want) > 20
    assert similar_between(left, right.limit(0), 0.5).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from("abcdefgh"), st.sampled_from("12345678")), min_size=1, max_size=40))
def test_any_sets(spark, rows):
    rows = [(a, b, "z") for a, b in rows]
    assert set(found(spark, rows, 1, 0.6)) == brute(rows, 1, 0.6)


def test_empty(spark):
    df = spark.createDataFrame([("a", "b")], "record string, tag string").limit(0)
    assert expand_pairs(*similar_sets(record_sets(df, "record", "tag", 3), 0.6)).collect() == []
