"""A ready bundle of pages for one question."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import jaccard, token_set
from ..session import materialise
from . import graph
from .postings import SearchIndex
from .search import Wanted, find_hits, is_synthesized, ranked_lists, search_kinds, with_boost

LEAST_SCORE, LEAST_SYNTH, LEAST_DESCRIPTION, ALIKE = 0.025, 0.012, 30, 0.5
MOST_RAW, MOST_NEIGHBOURS = 3, 3


def passing(results: DataFrame) -> DataFrame:
    """Results (position, kind, description, score) that pass: if any score is above 0, scores of at least LEAST_SCORE (LEAST_SYNTH for synthesized pages);
    synthesized pages with a description of LEAST_DESCRIPTION characters; the first result if none passes."""
    synth = is_synthesized(F.col("kind"))
    all_ = Window.partitionBy(F.lit(1))  # over a result list, which is bounded by its limit
    scored = F.max("score").over(all_) > 0
    good = (~scored | (F.col("score") >= F.when(synth, LEAST_SYNTH).otherwise(LEAST_SCORE))) & (~synth | (F.length("description") >= LEAST_DESCRIPTION))
    marked = results.withColumn("_good", good)
    fallback = ~F.max("_good").over(all_) & (F.col("position") == F.min("position").over(all_))
    return marked.withColumn("_keep", F.col("_good") | fallback).where("_keep").drop("_good", "_keep")


def _greedy(limit: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: list[set] = []
        for b in batches:
            keep = []
            for words in b.column("words").to_pylist():
                s = set(words or ())
                alike = any(s and k and len(s & k) > ALIKE * len(s | k) for k in kept)
                keep.append(not alike and len(kept) < limit)
                if keep[-1]:
                    kept.append(s)
            yield b.filter(pa.array(keep, pa.bool_()))

    return run


def compressed(results: DataFrame, limit: int) -> DataFrame:
    """What passes, without results whose description is more than half alike to one kept before, the first `limit`. The list is bounded by its search, so one task goes through it in order."""
    words = passing(results).withColumn("words", token_set(F.coalesce("description", F.lit("")))).coalesce(1).sortWithinPartitions("position")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(_greedy(limit), schema).drop("words")


def alike_descriptions(pages: DataFrame, seeds: DataFrame, threshold: float = ALIKE) -> DataFrame:
    """a, b, similarity: pairs of seed pages (a bounded list) with descriptions more alike than the threshold."""
    words = pages.join(F.broadcast(seeds.select("id")), "id", "left_semi").select("id", token_set(F.coalesce("description", F.lit(""))).alias("w"))
    a, b = words.toDF("a", "wa"), words.toDF("b", "wb")
    shared = a.select("a", "wa", F.explode("wa").alias("w")).join(b.select("b", "wb", F.explode("wb").alias("w")), "w").where("a < b")
    return shared.select("a", "b", jaccard(F.col("wa"), F.col("wb")).alias("similarity")).distinct().where(F.col("similarity") > threshold)


@dataclass
class Bundle:
    question: str
    pages: DataFrame | None = None
    raw: DataFrame | None = None
    neighbours: DataFrame | None = None
    conflicts: DataFrame | None = None


def build(pages: DataFrame, links: DataFrame, question: str, limit: int = 10, index: SearchIndex | None = None) -> Bundle:
    """Synthesized pages first, up to half the limit, then notes that pass compression; the raw files they cite, their neighbours in the wiki, and conflicts."""
    hits = find_hits(pages, question, index)
    if hits is None:
        return Bundle(question)
    columns = ["id", "path", "kind", "title", "description", "snippet", "score", "position"]
    found = search_kinds(hits, "wiki", None, limit * 8).where(F.col("position") <= limit * 2)
    found = found.withColumn("score", F.col("rrf")).select(*columns, F.lit(0).alias("list"))
    extra = ranked_lists(hits, [Wanted("wiki", kind, limit) for kind in ("concept", "comparison", "decision")])
    extra = extra.withColumn("score", F.lit(LEAST_SYNTH)).select(*columns, (F.col("list") + 1).alias("list"))
    both = found.unionByName(extra)
    once = both.withColumn("_n", F.row_number().over(Window.partitionBy("id").orderBy("list"))).where("_n = 1").drop("_n")
    once = once.withColumn("position", F.row_number().over(Window.orderBy("list", "position")))  # a bounded list
    once = materialise(once, "context")
    synth = once.where(is_synthesized(F.col("kind"))).orderBy("position").limit(max(1, limit // 2))
    synth = materialise(synth, "context-synth")
    notes = compressed(once.where(~is_synthesized(F.col("kind"))), max(1, limit - synth.count()))
    chosen = synth.withColumn("part", F.lit(0)).unionByName(notes.withColumn("part", F.lit(1)))
    chosen = materialise(chosen.withColumn("position", F.row_number().over(Window.orderBy("part", "position"))).drop("part", "list"), "context-pages")
    seeds = chosen.select("id")
    near = graph.expand(seeds, links, pages, limit * 2).where("layer = 'wiki'").orderBy("title", "id").limit(MOST_NEIGHBOURS)
    raw = graph.cited_sources(seeds, links, pages).orderBy("id").limit(MOST_RAW)
    return Bundle(question, chosen, raw, near, graph.conflicts(links, seeds))


def search_with_neighbours(pages: DataFrame, links: DataFrame, query: str, layer: str | None = None, kind: str | None = None, limit: int = 10) -> Bundle:
    """The best pages with their boost (which leaves their order), their neighbours and conflicts."""
    hits = find_hits(pages, query)
    if hits is None:
        return Bundle(query)
    best = with_boost(search_kinds(hits, layer, kind, limit * 4).where(F.col("position") <= limit), links)
    best = materialise(best, "results")
    seeds = best.select("id")
    return Bundle(query, best, None, graph.expand(seeds, links, pages, limit), graph.conflicts(links, seeds))
