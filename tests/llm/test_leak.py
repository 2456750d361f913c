import random
import unicodedata

from hypothesis import given, settings
from hypothesis import strategies as st

from lorekeep.llm.automaton import SuffixAutomaton
from lorekeep.llm.leak import ItemIndex, decontaminated, find_leaks, merged, normalised, original_spans
from lorekeep.llm.words import WORD


def words(text):
    return WORD.findall(unicodedata.normalize("NFKC", text or "").lower())


def brute(docs, items, k):
    out = set()
    for d, t, *_ in docs:
        w = words(t)
        for i, g in items:
            v = words(g)
            n = min(k, len(v))
            parts = {tuple(v[j : j + n]) for j in range(len(v) - n + 1)} if n and i is not None else set()
            if any(tuple(w[j : j + n]) in parts for j in range(len(w) - n + 1)):
                out.add((d, i))
    return out


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abc"), min_size=1, max_size=12), min_size=1, max_size=6), st.lists(st.sampled_from("abcd"), max_size=30), st.integers(1, 6))
def test_index_equals_brute_force(items, text, k):
    index = ItemIndex(list(enumerate(items)), k)
    items = [(i, " ".join(x)) for i, x in enumerate(items)]
    assert {(1, index.ids[o]) for o in index.find(text)} == brute([(1, " ".join(text))], items, k)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.integers(0, 2), max_size=10), min_size=1, max_size=4), st.lists(st.integers(0, 3), max_size=20))
def test_automaton(sequences, text):
    sa = SuffixAutomaton()
    for owner, s in enumerate(sequences):
        sa.add(s, owner)
    inside = lambda x, s: any(s[i : i + len(x)] == x for i in range(len(s) - len(x) + 1))
    for at, (v, n) in enumerate(sa.matches(text), 1):
        assert n == max(m for m in range(at + 1) if any(inside(text[at - m : at], s) for s in sequences))
        for m in range(1, n + 1):
            assert sa.owners(sa.suffix_state(v, m)) == {o for o, s in enumerate(sequences) if inside(text[at - m : at], s)}


def test_documents(spark):
    rng = random.Random(2)
    word = lambda: rng.choice("alpha beta gamma delta epsilon zeta eta theta iota kappa".split())
    items = [(i, " ".join(word() for _ in range(rng.choice([3, 5, 16, 30])))) for i in range(30)] + [(90, None), (91, ""), (92, "--"), (None, "beta"), (93, "当会话替换稀疏的引擎时"), (94, "Ｆｕｌｌ　ｗｉｄｔｈ ﬁle")]
    docs = [(i, " ".join(word() for _ in range(60)), "x") for i in range(40)]
    docs += [(100 + i, f"before {t.upper().replace(' ', ' -- ')} after", "x") for i, t in items[:30]]
    docs += [(200, None, "x"), (201, "", "x"), (202, "说当会话替换稀疏的引擎时了", "x"), (203, "see full width FILE here", "x"), (None, items[4][1], "x"), (100, "again " + items[0][1], "x")]
    df = spark.createDataFrame(docs, "doc_id bigint, text string, item_id string")
    it = spark.createDataFrame(items, "item_id bigint, ground_truth string")
    for shard_chars, least in ((400_000, 16), (300, 16), (60, 16), (300, 5)):
        got = {(r.doc_id, r.item_id) for r in find_leaks(df, "doc_id", "text", it, "item_id", "ground_truth", least, shard_chars).collect()}
        assert got == brute(docs, items, least)
    assert find_leaks(df.limit(0), "doc_id", "text", it, "item_id", "ground_truth").count() == 0
    assert find_leaks(df, "doc_id", "text", it.limit(0), "item_id", "ground_truth").count() == 0


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="aé ȩ́ﬁ㎏ｶﾞ한한½  字A_", max_size=40))
def test_original_spans_cover_the_words(text):
    w = WORD.findall(normalised(text))
    for i in range(len(w)):
        a, b = original_spans(text, [(i, i + 1)])[0]
        assert w[i] in normalised(text[a:b]) or w[i] in normalised(text)[:]
        assert 0 <= a < b <= len(text)


def test_removal(spark):
    text = "one two three LEAKED passage four five six"
    docs = spark.createDataFrame([(1, text, "a"), (2, "clean", "b"), (3, "LEAKED passage", "c")], "doc_id bigint, text string, action string")
    leaks = spark.createDataFrame([(1, 7, 2, 14, 28), (1, 8, 2, 21, 28), (3, 7, 2, 0, 14)], "doc_id bigint, item_id bigint, n_words int, start bigint, end bigint")
    out = {r.doc_id: r for r in decontaminated(docs, "doc_id", "text", leaks).collect()}
    assert out[1].text == text[:14] + text[28:] and out[1].action == "trim" and out[1].n_removed == 14
    assert out[3].text is None and out[3].action == "drop" and set(out) == {1, 3}
    assert {r.doc_id for r in decontaminated(docs, "doc_id", "text", leaks, min_words=2).collect()} == set()  # spans of a match's length below the limit stay
    assert {r.doc_id for r in decontaminated(docs, "doc_id", "text", leaks, max_span=2, min_words=2).collect()} == {1, 3}
    spans = spark.createDataFrame([("k", 0, 5), ("k", 5, 7), ("k", 1, 2), ("k", 9, 10), (None, 1, 2)], "k string, start bigint, end bigint")
    assert {tuple(r) for r in merged(spans, "k").collect()} == {("k", 0, 7), ("k", 9, 10), (None, 1, 2)}
