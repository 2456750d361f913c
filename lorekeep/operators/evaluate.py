"""Retrieval quality: keyword retrieval for a set of questions in one pass, hit rate, reciprocal rank, means and comparison."""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import spread

TOP, CHUNK_CHARS, MOST_QUESTION_CHARS = 5, 500, 8_000_000
_HEADER = r"(?s)^---.*?---\s*"


def question_keywords(question: str) -> list[str]:
    """Lower-case runs of word characters longer than two."""
    return [w.lower() for w in re.split(r"\W+", question) if len(w) > 2]


def keyword_retrieval(pages: DataFrame, questions: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, id, score, place: for each question the `top` pages by the number of times its keywords stand in them (a keyword that a question has twice counts twice), then by id.

    The questions are the stated set, in blocks of at most MOST_QUESTION_CHARS characters; one block's distinct keywords are one Aho-Corasick automaton that every page is
    read through once. Each task keeps its best pages per question, so what is exchanged is top rows per question and task. Null questions and contents count as empty."""
    sized = questions.select("item_id", F.coalesce("question", F.lit("")).alias("question"))
    chars = sized.agg(F.sum(F.length("question"))).first()[0] or 0
    blocks, out = max(1, -(-chars // MOST_QUESTION_CHARS)), None
    pages = spread(pages.select("id", F.lower(F.regexp_replace(F.coalesce("content", F.lit("")), _HEADER, "")).alias("text")), "id")
    for n in range(blocks):
        mine = sized if blocks == 1 else sized.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == n)
        asked: dict[str, list[int]] = defaultdict(list)
        for item, question in mine.collect():
            for k in question_keywords(question):
                asked[k].append(item)
        shared = pages.sparkSession.sparkContext.broadcast(dict(asked))
        found = pages.mapInArrow(_counted(shared, top), "item_id bigint, id string, score bigint")
        out = found if out is None else out.unionByName(found)
    place = F.row_number().over(Window.partitionBy("item_id").orderBy(F.desc("score"), "id"))
    return out.withColumn("place", place).where(F.col("place") <= top)


def _counted(shared, top: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import heapq

        import ahocorasick

        asked = shared.value
        automaton = ahocorasick.Automaton()
        for k in asked:
            automaton.add_word(k, k)
        if not asked:
            return
        automaton.make_automaton()
        best: dict[int, list] = defaultdict(list)
        for b in batches:
            for page, value in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                counts: dict[str, int] = defaultdict(int)
                free: dict[str, int] = {}
                for end, k in automaton.iter(value.as_py()):
                    if end - len(k) >= free.get(k, -1):  # occurrences of one keyword don't overlap
                        counts[k] += 1
                        free[k] = end
                scores: dict[int, int] = defaultdict(int)
                for k, c in counts.items():
                    for item in asked[k]:
                        scores[item] += c
                for item, score in scores.items():
                    entry = (score, _Last(page))
                    heap = best[item]
                    if len(heap) < top:
                        heapq.heappush(heap, entry)
                    elif entry > heap[0]:
                        heapq.heapreplace(heap, entry)
        rows = [(item, e[1].id, e[0]) for item, heap in best.items() for e in heap]
        for i in range(0, len(rows), 10_000):
            part = list(zip(*rows[i : i + 10_000], strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(part[0], pa.int64()), pa.array(part[1], pa.string()), pa.array(part[2], pa.int64())], ["item_id", "id", "score"])

    return run


class _Last:
    """Orders ids backwards, so that of equal scores the later id leaves a heap first."""

    __slots__ = ("id",)

    def __init__(self, id_):
        self.id = id_

    def __lt__(self, other):
        return (self.id or "") > (other.id or "")

    def __eq__(self, other):
        return self.id == other.id


def hits(retrieved: DataFrame, questions: DataFrame) -> DataFrame:
    """item_id, hit, rr of every question: whether any retrieved page (item_id, id, place) is the expected one, either containing the other's name, and 1 / the first such place."""
    expected = questions.select("item_id", "expected_page")
    is_hit = F.contains("id", F.col("expected_page")) | F.contains("expected_page", F.col("id"))
    usable = F.coalesce(F.col("expected_page") != "", F.lit(False))
    place = F.min(F.when(usable & is_hit, F.col("place")))
    found = expected.join(retrieved, "item_id", "left").groupBy("item_id").agg(place.alias("first"))
    return found.select("item_id", F.col("first").isNotNull().cast("int").alias("hit"), F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("rr"))


def means(scores: DataFrame, by: list[str], metrics: list[str]) -> DataFrame:
    """Means per group; 0 for a metric without values."""
    return scores.groupBy(*by).agg(*[F.coalesce(F.avg(m), F.lit(0.0)).alias(m) for m in metrics])


def comparison(scores: DataFrame, metrics: list[str], ours: str, theirs: str) -> DataFrame:
    """metric, ours, theirs, delta of two systems (column system)."""
    long = means(scores, ["system"], metrics).unpivot("system", metrics, "metric", "value")
    wide = long.groupBy("metric").pivot("system", [ours, theirs]).agg(F.first("value"))
    one, two = F.coalesce(F.col(f"`{ours}`"), F.lit(0.0)), F.coalesce(F.col(f"`{theirs}`"), F.lit(0.0))
    return wide.select("metric", one.alias("ours"), two.alias("theirs"), (one - two).alias("delta"))


def judged(rows: DataFrame, judge: Callable[[str, str], str], prompts: dict[str, tuple[str, str]]) -> DataFrame:
    """rows (question, answer, context, ground_truth) with a score of 0 to 1 per prompt (system, template); the first number of the judge's answer counts, 0.5 if it has none."""
    names = list(prompts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores: list[list[float]] = [[] for _ in names]
            for row in b.to_pylist():
                for i, name in enumerate(names):
                    system, template = prompts[name]
                    m = re.search(r"\d*\.?\d+", judge(system, template.format(**row)))
                    scores[i].append(min(1.0, float(m[0])) if m else 0.5)
            yield pa.RecordBatch.from_arrays([*b.columns, *(pa.array(s, pa.float64()) for s in scores)], [*b.schema.names, *names])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + "".join(f", `{n}` double" for n in names))


def judged_list(rows: DataFrame, judge: Callable[[str, str], str], system: str, name: str = "precision") -> DataFrame:
    """rows (question, contexts: array<string>) with the share of the contexts that the judge, asked once for all of a row, marks with 1 in its answer, a list of zeros and
    ones; 0.5 if the answer is no such list, 0 without contexts. Marks beyond the contexts don't count; missing ones count as 0."""

    def score(question: str, contexts: list[str]) -> float:
        if not contexts:
            return 0.0
        asked = f"{question}\n\n" + "\n\n".join(f"[{i}] {c}" for i, c in enumerate(contexts, 1))
        m = re.search(r"\[[01,\s]*\]", judge(system, asked))
        marks = re.findall("[01]", m[0]) if m else []
        return marks[: len(contexts)].count("1") / len(contexts) if marks else 0.5

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            scores = [score(r["question"] or "", r["contexts"] or []) for r in b.to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], [*b.schema.names, name])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields)
    return rows.mapInArrow(run, fields + f", `{name}` double")
