"""Keyword search over pages: phases, BM25, rank fusion, boosts and pools.

One pass over the pages finds every row that any keyword hits, with all that ranking needs, and observes the statistics of BM25 in
that same pass; with a search index only the pages that can be hit are read. What is hit is a written table without page contents. Everything after reads that table: each phase is a
distributed top-k, and windows only ever run over the rows of a bounded list.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import materialise, spread
from .postings import SearchIndex, narrowed

K1, B_LENGTH, LEAST_IDF = 1.2, 0.75, 1e-6
RRF_K = 60
SYNTHESIZED = ("concept", "comparison", "decision", "wiki-concept", "wiki-comparison", "wiki-decision")
SYNTH_FACTOR, AUTHORITY_STEP, GRAPH_STEP = 1.3, 0.005, 0.01
DECAY_NOTE, DECAY_SYNTH, DECAY_BONUS = 0.00126, 0.00063, 0.012
SNIPPET_CHARS = 12  # ten trigrams
INDEXED = ("id", "title", "content", "kind", "layer")
_SPLIT = re.compile(r"[,，]+|\s+")


def split_keywords(query: str) -> list[str]:
    return [p for p in (x.strip() for x in _SPLIT.split(query.strip())) if p]


def is_synthesized(kind: Column) -> Column:
    return kind.isin(*SYNTHESIZED)


def occurrences(text: Column, keyword: str) -> Column:
    """Overlapping occurrences of a lower-cased keyword in lower-cased text."""
    if any(keyword.startswith(keyword[i:]) for i in range(1, len(keyword))):  # it can overlap itself
        return F.regexp_count(text, F.lit("(?=" + "".join(f"\\x{{{ord(c):X}}}" for c in keyword) + ")"))
    return ((F.length(text) - F.length(F.replace(text, F.lit(keyword), F.lit("")))) / len(keyword)).cast("int")


def snippet(content: Column, keywords: list[str]) -> Column:
    """SNIPPET_CHARS characters of the content from the first hit of any keyword on, with `...` where it is cut and every whole hit in brackets.
    Empty if no keyword stands in the content. The lower-cased text places the hit."""
    low = F.lower(content)
    places = [F.when(F.instr(low, k) > 0, F.instr(low, k)) for k in keywords]
    at = places[0] if len(places) == 1 else F.least(*places)
    window = F.substring(content, at, F.lit(SNIPPET_CHARS))
    for k in keywords:
        window = F.regexp_replace(window, "(?i)(" + "".join(f"\\x{{{ord(c):X}}}" for c in k) + ")", "[$1]")
    before = F.when(at > 1, "...").otherwise("")
    after = F.when(at - 1 + SNIPPET_CHARS < F.length(content), "...").otherwise("")
    return F.when(at.isNotNull(), F.concat(before, window, after)).otherwise("")


@dataclass
class Hits:
    """The rows that a query hits. long_hits counts the keywords of three or more characters found; short_i says whether short keyword i was."""

    rows: DataFrame
    keywords: list[str]
    long: list[str]
    short: list[str]


def page_length(columns: dict[str, Column] | None = None) -> Column:
    """Trigrams of a page's indexed columns: what BM25 takes for its length."""
    columns = columns or {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in INDEXED}
    return reduce(lambda x, y: x + y, (F.greatest(F.length(columns[c]) - 2, F.lit(0)) for c in INDEXED))


def find_hits(pages: DataFrame, query: str, index: SearchIndex | None = None) -> Hits | None:
    """None for a query without keywords. A null column holds no keyword and has no length; a null content, title or kind reads as empty."""
    keywords = split_keywords(query)
    if not keywords:
        return None
    long = [k for k in keywords if len(k) >= 3]
    short = [k for k in keywords if len(k) < 3]
    text = {c: F.lower(F.coalesce(F.col(c), F.lit(""))) for c in INDEXED}
    length = page_length(text)
    counts = [reduce(lambda x, y: x + y, (occurrences(text[c], k.lower()) for c in INDEXED)).alias(f"f{i}") for i, k in enumerate(long)]
    likes = [
        (F.col("title").ilike(f"%{k}%") | F.col("content").ilike(f"%{k}%")).alias(f"like{i}") if "\\" not in k
        else (F.contains(text["title"], F.lit(k.lower())) | F.contains(text["content"], F.lit(k.lower()))).alias(f"like{i}")
        for i, k in enumerate(short)
    ]
    if index:
        pages = narrowed(pages, index, keywords)
    seen = spread(pages, "id").select(
        "id", "path", "layer", F.coalesce("kind", F.lit("")).alias("kind"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce("description", F.lit("")).alias("description"), F.coalesce("authority", F.lit(3)).alias("authority"),
        F.coalesce("doc_timestamp", F.lit(0)).alias("doc_timestamp"), length.alias("length"), *counts, *likes,
        (snippet(F.coalesce("content", F.lit("")), [k.lower() for k in long]) if long else F.lit("")).alias("snippet"),
    )
    stats = Observation()
    totals = [F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")]
    seen = seen.observe(stats, *totals, *[F.count_if(F.col(f"f{i}") > 0).alias(f"n{i}") for i in range(len(long))])
    hit = [F.col(f"f{i}") > 0 for i in range(len(long))] + [F.coalesce(F.col(f"like{i}"), F.lit(False)) for i in range(len(short))]
    rows = materialise(seen.where(reduce(lambda x, y: x | y, hit)), "hits")
    s = dict(stats.get)
    if index:
        s |= index.sizes.agg(F.count(F.lit(1)).alias("n"), F.sum("length").alias("length")).first().asDict()
    average = (s["length"] or 0) / s["n"] if s["n"] else 1.0
    rank = F.lit(0.0)
    for i in range(len(long)):
        n = s[f"n{i}"]
        idf = math.log((s["n"] - n + 0.5) / (n + 0.5)) if s["n"] else LEAST_IDF
        idf = idf if idf > 0 else LEAST_IDF
        f = F.col(f"f{i}").cast("double")
        rank = rank - F.lit(idf) * (f * (K1 + 1)) / (f + K1 * (1 - B_LENGTH + B_LENGTH * F.col("length") / (average or 1.0)))
    found = reduce(lambda x, y: x + y, [(F.col(f"f{i}") > 0).cast("int") for i in range(len(long))], F.lit(0))
    rows = rows.select(
        "id", "path", "layer", "kind", "title", "description", "authority", "doc_timestamp", "snippet",
        F.when(F.col("layer") == "wiki", 1.0).otherwise(0.0).alias("wiki_priority"), rank.alias("rank"), found.alias("long_hits"),
        *[F.coalesce(F.col(f"like{i}"), F.lit(False)).alias(f"short_{i}") for i in range(len(short))],
    )
    return Hits(rows, keywords, long, short)


_BEST = ["wiki_priority DESC", "fts_rank", "id"]
_ORDER = ["wiki_priority DESC", "match_phase", "coverage DESC", "fts_rank", "id"]


def _sorting(names: list[str]) -> list[Column]:
    return [F.desc(n.split()[0]) if n.endswith(" DESC") else F.asc(n) for n in names]


@dataclass(frozen=True)
class Wanted:
    """One ranked list: pages of a layer and a kind (None for any), the first `limit`."""

    layer: str | None
    kind: str | None
    limit: int


def _keep_limit(df: DataFrame, most: int) -> None:
    """The optimizer takes the first rows of a window's groups in the tasks, before they are exchanged, only up to a limit that is a setting; a
    limit beyond it would bring whole groups into one task."""
    name = "spark.sql.optimizer.windowGroupLimitThreshold"
    if int(df.sparkSession.conf.get(name)) < most:
        df.sparkSession.conf.set(name, most)


def ranked_lists(hits: Hits, wanted: list[Wanted]) -> DataFrame:
    """All lists in one job, told apart by `list`; `position` counts from 1 in each.

    A list has three phases: all long keywords (0), any long keyword (1), each short keyword (2); a page counts in its first phase.
    Each phase takes its best limit * keywords rows before pages of earlier phases are taken out. A list is sorted by layer, phase, coverage and
    rank. Every window takes the first rows of its group, so tasks send only those."""
    steps = [F.col("long_hits") == len(hits.long)] if len(hits.long) >= 2 else []
    steps += [F.col("long_hits") > 0] if hits.long else []
    first_short = len(steps)
    steps += [F.col(f"short_{i}") for i in range(len(hits.short))]
    places = []
    for n, w in enumerate(wanted):
        inside = F.lit(True)
        inside = inside if w.layer is None else inside & (F.col("layer") == w.layer)
        inside = inside if w.kind is None else inside & (F.col("kind") == w.kind)
        places += [F.when(inside & c, F.struct(F.lit(n).alias("list"), F.lit(i).alias("step"))) for i, c in enumerate(steps)]
    rows = hits.rows.select("*", F.inline(F.filter(F.array(*places), lambda x: x.isNotNull())))
    is_short = F.col("step") >= first_short
    rows = rows.withColumn("fts_rank", F.when(is_short, 0.0).otherwise(F.col("rank"))).withColumn("snippet", F.when(is_short, "").otherwise(F.col("snippet")))
    limit = F.element_at(F.array(*[F.lit(w.limit) for w in wanted]), F.col("list") + 1)
    most = max(w.limit for w in wanted)
    _keep_limit(rows, most * len(hits.keywords))
    top = F.row_number().over(Window.partitionBy("list", "step").orderBy(*_sorting(_BEST)))
    rows = rows.withColumn("_n", top).where(F.col("_n") <= most * len(hits.keywords)).where(F.col("_n") <= limit * len(hits.keywords))
    once = F.row_number().over(Window.partitionBy("list", "id").orderBy("step"))
    rows = rows.withColumn("_n", once).where("_n = 1").drop("_n")
    phase = F.when(is_short, 2).when(F.lit(len(hits.long) >= 2) & (F.col("step") == 0), 0).otherwise(1)
    shown = F.lower(F.concat_ws(" ", "title", "snippet"))
    covered = reduce(lambda x, y: x + y, (F.contains(shown, F.lit(k.lower())).cast("int") for k in hits.keywords))
    rows = rows.withColumn("match_phase", phase).withColumn("coverage", F.when(F.col("match_phase") == 0, len(hits.keywords)).otherwise(covered))
    position = F.row_number().over(Window.partitionBy("list").orderBy(*_sorting(_ORDER)))
    rows = rows.withColumn("position", position).where(F.col("position") <= most).where(F.col("position") <= limit)
    columns = ["id", "path", "layer", "kind", "title", "description", "snippet", "wiki_priority", "authority", "doc_timestamp", "fts_rank", "match_phase", "coverage"]
    return rows.select("list", *columns, "position")


def phases(hits: Hits, layer: str | None, kind: str | None, limit: int) -> DataFrame:
    """One list, as ranked_lists has it."""
    return ranked_lists(hits, [Wanted(layer, kind, limit)]).drop("list")


def search(pages: DataFrame, query: str, layer: str | None = None, kind: str | None = None, limit: int = 10, index: SearchIndex | None = None) -> DataFrame | None:
    hits = find_hits(pages, query, index)
    return phases(hits, layer, kind, limit) if hits else None


def fuse(lists: DataFrame, limit: int) -> DataFrame:
    """Reciprocal rank fusion of lists (columns list, position): the sum of 1 / (60 + position) per id; a page's columns come from the
    first list that has it; ties go by id."""
    columns = [c for c in lists.columns if c not in ("id", "position", "list")]
    fused = lists.groupBy("id").agg(
        F.min_by(F.struct(*columns), "list").alias("page"), F.sum(1.0 / (RRF_K + F.col("position"))).alias("rrf"), F.count("*").alias("lists")
    )
    best = fused.orderBy(F.desc("rrf"), "id").limit(limit).select("id", "page.*", "rrf", "lists")
    return best.withColumn("position", F.row_number().over(Window.orderBy(F.desc("rrf"), "id")))  # of `limit` rows


def search_kinds(hits: Hits, layer: str | None, kind: str | None, limit: int, strict_layer: bool = False) -> DataFrame:
    """Per-kind lists fused. With a kind: its phases alone (rrf 0). Without: source notes and the three synthesized kinds of the wiki, and one
    list of any kind in the caller's layer. strict_layer keeps pages of other layers out."""
    if kind is not None:
        return phases(hits, layer, kind, limit).withColumn("rrf", F.lit(0.0)).withColumn("lists", F.lit(1).cast("bigint"))
    wanted = [Wanted("wiki", "source-note", limit * 10), *(Wanted("wiki", k, limit * 3) for k in ("concept", "comparison", "decision"))]
    if strict_layer and layer not in (None, "wiki"):
        wanted = []
    return fuse(ranked_lists(hits, [*wanted, Wanted(layer, None, limit * 3)]), limit)


def graph_boost(links: DataFrame) -> DataFrame:
    """doc_id, graph_boost: links to each target, of every relation and with repeats, as tenths up to 1."""
    inbound = links.where(F.col("target_doc_id").isNotNull()).groupBy(F.col("target_doc_id").alias("doc_id")).agg(F.count("*").alias("n_inbound"))
    return inbound.withColumn("graph_boost", F.least(F.col("n_inbound") / 10.0, F.lit(1.0)))


def with_boost(results: DataFrame, links: DataFrame) -> DataFrame:
    """graph_boost of the results' ids; the order stays. Only links to the few results are counted: their ids (a bounded list) are broadcast."""
    ids = results.select(F.col("id").alias("target_doc_id")).distinct()
    boost = graph_boost(links.select("target_doc_id").join(F.broadcast(ids), "target_doc_id")).select(F.col("doc_id").alias("id"), "graph_boost")
    return results.join(boost, "id", "left").withColumn("graph_boost", F.coalesce("graph_boost", F.lit(0.0)))


def hybrid_score(position: Column, kind: Column, authority: Column, boost: Column, timestamp: Column, as_of: int) -> Column:
    score = 1.0 / (RRF_K + position)
    score = F.when(is_synthesized(kind), score * SYNTH_FACTOR).otherwise(score)
    score = score + F.when(authority > 0, (authority - 3) * AUTHORITY_STEP).otherwise(0.0) + boost * GRAPH_STEP
    days = (F.lit(as_of) - timestamp) / 86400.0
    decay = F.when(is_synthesized(kind), DECAY_SYNTH).otherwise(DECAY_NOTE)
    return score + F.when(timestamp > 0, DECAY_BONUS * F.exp(-decay * days)).otherwise(0.0)


def layered(pages: DataFrame, links: DataFrame, query: str, as_of: int, layer: str | None = None, kind: str | None = None, sources: int = 10, synths: int = 3, index: SearchIndex | None = None) -> DataFrame | None:
    """The layered search: fused lists, boosted by kind, authority, links and age at `as_of`, then the best of two pools, notes first.
    `pool` is note or synth, `place` the position in the pool. None for a query without keywords."""
    hits = find_hits(pages, query, index)
    if hits is None:
        return None
    fused = materialise(search_kinds(hits, layer, kind, (sources + synths) * 4), "fused")  # read twice below
    results = with_boost(fused, links)
    score = hybrid_score(F.col("position"), F.col("kind"), F.col("authority"), F.col("graph_boost"), F.col("doc_timestamp"), as_of)
    scored = results.withColumn("score", score).withColumn("pool", F.when(is_synthesized(F.col("kind")), "synth").otherwise("note"))
    ranked = scored.withColumn("place", F.row_number().over(Window.partitionBy("pool").orderBy(F.desc("score"), "id")))
    return ranked.where(F.col("place") <= F.when(F.col("pool") == "synth", synths).otherwise(sources))


def hybrid_rank(results: DataFrame) -> DataFrame:
    """Results with a position and a boost, scored as in `layered` but without age or pools."""
    score = hybrid_score(F.col("position"), F.col("kind"), F.col("authority"), F.col("graph_boost"), F.lit(0), 0)
    return results.withColumn("score", score)


def pools_for(limit: int = 10) -> tuple[int, int]:
    """(notes, synthesized) that a caller's limit asks for."""
    return limit, max(1, min(3, limit // 2))
