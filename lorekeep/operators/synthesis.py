"""From raw files to notes, and from notes to synthesized pages. The language model is a callable that the caller gives."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import UTC, datetime

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import frontmatter as fm
from ..functions import notes as nt
from ..functions import text as tx
from ..functions.prompts import GAPS

Llm = Callable[[str, str], str]
PLAN_SCHEMA = "array<struct<type: string, title: string, slug: string, description: string, sources: array<string>>>"
DRAFT_BELOW, REWRITE_FROM, MOST_RELATED = 2, 5, 10


def source_notes(pages: DataFrame) -> DataFrame:
    """path, title, description, tags, key_claims, content of the source notes, read the stricter way."""
    name = tx.file_name(F.col("id"))
    notes = pages.where(F.regexp_like("id", F.lit(r"^wiki/source-notes/.*\.md$")) & ~name.isin("index.md", "log.md"))
    read = notes.select(F.col("id").alias("path"), "content", fm.note_struct(F.col("content")).alias("note"))
    return read.select("path", "note.*", "content")


def topic_filter(notes: DataFrame, topic: str) -> DataFrame:
    """Notes with the topic in their title or a tag, whatever the case; all for an empty topic."""
    if not topic:
        return notes
    has = lambda c: F.contains(F.lower(c), F.lit(topic.lower()))
    return notes.where(has(F.coalesce("title", F.lit(""))) | F.exists(F.coalesce("tags", F.array().cast("array<string>")), has))


def with_hash(notes: DataFrame) -> DataFrame:
    return notes.withColumn("hash", tx.note_hash(F.col("title"), F.col("description"), F.col("path"), F.col("tags"), F.col("key_claims")))


def new_or_changed(notes: DataFrame, state: DataFrame) -> DataFrame:
    """Notes (with hash) whose hash isn't the one in the state table (path, hash)."""
    old = state.select("path", F.col("hash").alias("_old"))
    return notes.join(old, "path", "left").where(~F.col("hash").eqNullSafe(F.col("_old"))).drop("_old")


def recorded(state: DataFrame, notes: DataFrame) -> DataFrame:
    """The state after the notes succeeded."""
    new = notes.select("path", "hash")
    return state.join(new.select("path"), "path", "left_anti").select("path", "hash").unionByName(new)


def plans_of(answers: DataFrame) -> DataFrame:
    """type, title, slug, description, sources of every plan in the answers (column answer); an answer that is no JSON list gives none."""
    plans = F.from_json(tx.without_fences(F.col("answer")), PLAN_SCHEMA)
    return answers.select(F.inline(plans))


def viable(plans: DataFrame) -> DataFrame:
    return plans.where(F.size("sources") >= 1)


def safe_plans(plans: DataFrame) -> DataFrame:
    """Plans as a model gave them, made fit for file names: of the known types, with a slug of letters, digits and dashes; others are left out."""
    named = plans.withColumn("slug", tx.topic_slug(F.coalesce("slug", "title", F.lit(""))))
    return named.where(F.col("type").isin("concept", "comparison", "decision") & (F.col("slug") != ""))


def routed(plans: DataFrame, pages: DataFrame) -> DataFrame:
    """Plans with dest, is_draft and step (create, append or rewrite): a page stays where it is, as page or as draft; a new one of
    fewer than DRAFT_BELOW sources is a draft; one that reaches REWRITE_FROM sources is written anew."""
    home = F.concat(F.lit("wiki/"), "type", F.lit("s/"))
    named = plans.withColumn("page", F.concat(home, "slug", F.lit(".md"))).withColumn("draft", F.concat(home, F.lit("_draft/"), "slug", F.lit(".md")))
    have = pages.select("id", tx.source_count(F.col("content")).alias("n"))
    found = named.join(have.toDF("page", "page_n"), "page", "left").join(have.toDF("draft", "draft_n"), "draft", "left")
    is_draft = F.when(F.col("page_n").isNotNull(), False).when(F.col("draft_n").isNotNull(), True).otherwise(F.size("sources") < DRAFT_BELOW)
    have_n = F.coalesce("page_n", "draft_n")
    step = F.when(have_n.isNull(), "create").when(have_n + F.size("sources") >= REWRITE_FROM, "rewrite").otherwise("append")
    out = found.withColumn("is_draft", is_draft).withColumn("dest", F.when(F.col("is_draft"), F.col("draft")).otherwise(F.col("page")))
    return out.withColumn("step", step).drop("page", "draft", "page_n", "draft_n")


def graduates(pages: DataFrame) -> DataFrame:
    """id, dest of the drafts with enough sources to leave the draft folder."""
    drafts = pages.where(F.contains("id", F.lit("/_draft/")) & (tx.source_count(F.col("content")) >= DRAFT_BELOW))
    return drafts.select("id", F.replace("id", F.lit("/_draft/"), F.lit("/")).alias("dest"))


def tag_overlap(notes: DataFrame, most: int = MOST_RELATED, seeds: DataFrame | None = None) -> DataFrame:
    """seed, path, place: each note first, then in order of path the notes that share a tag with it, whatever the case, `most` in all.

    Of each tag only the first `most` + 1 notes by path can come up for any seed, so tags are cut to those before the join."""
    tagged = notes.select("path", F.explode(F.array_distinct(F.transform("tags", F.lower))).alias("tag")).distinct()
    heads = tagged.withColumn("n", F.row_number().over(Window.partitionBy("tag").orderBy("path"))).where(F.col("n") <= most + 1).drop("n")
    mine = tagged.withColumnRenamed("path", "seed")
    own = notes.select(F.col("path").alias("seed"))
    if seeds is not None:
        own = own.join(seeds.select(F.col("path").alias("seed")), "seed", "left_semi")
        mine = mine.join(own, "seed", "left_semi")
    near = mine.join(heads, "tag").where("seed <> path").select("seed", "path").distinct()
    place = F.row_number().over(Window.partitionBy("seed").orderBy("path")) + 1
    others = near.withColumn("place", place).where(F.col("place") <= most)
    return own.select("seed", F.col("seed").alias("path"), F.lit(1).alias("place")).unionByName(others)


def note_list(notes: DataFrame, most_bytes: int = 32 << 20) -> str:
    """The notes as a prompt's list, in order of path. A prompt is one string on the driver: more than most_bytes of it is an error, not a cut."""
    line = F.concat(F.lit("- "), "path", F.lit(": "), F.coalesce("title", F.lit("")), F.lit(" — "), F.coalesce("description", F.lit("")), F.lit(" ["), F.array_join("tags", ", "), F.lit("]"))
    lines = notes.select("path", line.alias("line"))
    size = lines.agg(F.sum(F.octet_length("line") + 1)).first()[0] or 0
    if size > most_bytes:
        raise ValueError(f"{size} bytes of notes do not fit a prompt; choose a topic")
    return "\n".join(r.line for r in lines.orderBy("path").collect())


def plan_prompt(notes: DataFrame, titles: list[str], topic: str) -> str:
    about = f"Topic: {topic}\n\n" if topic else ""
    return f"{about}Existing pages:\n" + "".join(f"- {t}\n" for t in titles) + "\nNotes:\n" + note_list(notes)


def gap_report(notes: DataFrame, topic: str, llm: Llm, system: str = GAPS) -> tuple[str, str]:
    """(path, report) on what the notes of a topic leave out; no notes are an error."""
    mine = topic_filter(notes, topic)
    if mine.isEmpty():
        raise ValueError(f"no notes on {topic!r}")
    slug = mine.sparkSession.range(1).select(tx.topic_slug(F.lit(topic))).first()[0]
    return f"index/gaps/{slug or 'gaps'}.md", llm(system, f"Topic: {topic}\n\n{note_list(mine)}")


def distil(raw: DataFrame, llm: Llm, system: str, stamp: str) -> DataFrame:
    """path, note, error of each raw file (id, content, mtime): catalogues become light notes in the JVM; other texts go through the model, and their answers are unfenced, grounded in
    the raw text and pointed at it. A model's failure is that row's error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            notes, errors = [], []
            for path, content, mtime in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                try:
                    answer = nt.unfenced(llm(system, content or ""))
                    notes.append(nt.set_sources(nt.ground(answer, content or "", datetime.fromtimestamp(mtime or 0, UTC)), [path]))
                    errors.append(None)
                except Exception as e:  # noqa: BLE001 - any failure of the model is the row's
                    notes.append(None)
                    errors.append(str(e) or type(e).__name__)
            yield pa.RecordBatch.from_arrays([b.column(0).cast(pa.string()), pa.array(notes, pa.string()), pa.array(errors, pa.string())], ["path", "note", "error"])

    is_light = tx.technical_catalogue(F.coalesce("content", F.lit("")))
    light = raw.where(is_light).select(F.col("id").alias("path"), nt.light_note(F.col("id"), F.col("content"), stamp).alias("note"), F.lit(None).cast("string").alias("error"))
    made = raw.where(~is_light).select("id", "content", F.col("mtime").cast("bigint")).mapInArrow(run, "path string, note string, error string")
    return light.unionByName(made)


def note_path(path) -> object:
    """Where the note of a raw file lies."""
    rel = F.regexp_replace(F.regexp_replace(path, "^raw/", ""), "^converted/", "")
    return F.concat(F.lit("wiki/source-notes/"), F.regexp_replace(rel, r"\.[^./]*$", ""), F.lit(".md"))


def log_line(day: str, title: str) -> str:
    return f"## [{day}] ingest | {title}\n"
