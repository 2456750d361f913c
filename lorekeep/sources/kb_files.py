"""Knowledge bases on disk: which files are pages, and what is missing among them.

Spark's file sources list no file or folder whose name begins with `.` or `_`, so such files are never pages here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import file_name, layer

RESERVED = ("index.md", "log.md")
CONVERTIBLE = ("pdf", "html", "docx", "doc", "epub", "odt")


def relative(root: str, path: Column) -> Column:
    """The slash-separated path below the root, with escapes of the file URI undone."""
    plain = root.removeprefix("file://").rstrip("/") + "/"
    tail = F.element_at(F.split(path, "\\Q" + plain.replace(" ", "%20") + "\\E", 2), -1)
    return F.url_decode(F.replace(tail, F.lit("+"), F.lit("%2B")))


def is_page(id_: Column) -> Column:
    """A text file in a layer that is neither reserved nor a draft."""
    text = F.regexp_like(id_, F.lit(r"(?i)^(raw|wiki|schema)/.*\.(md|txt|rst)$"))
    return text & ~file_name(id_).isin(*RESERVED) & ~F.regexp_like(id_, F.lit("(^|/)_draft/"))


def files(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """id, size, mtime (seconds) of every file; contents are not read. modified_after (ISO, UTC) prunes in the listing."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    listed = reader.load(root).select(relative(root, F.col("path")).alias("id"), F.col("length").alias("size"), F.unix_timestamp("modificationTime").alias("mtime"))
    return listed


def page_files(spark: SparkSession, root: str, modified_after: str | None = None) -> DataFrame:
    """id, layer, content, mtime of the pages."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if modified_after:
        reader = reader.option("modifiedAfter", modified_after)
    found = reader.load(root).select(relative(root, F.col("path")).alias("id"), F.col("content"), F.unix_timestamp("modificationTime").alias("mtime"))
    return found.where(is_page(F.col("id"))).select("id", layer(F.col("id")).alias("layer"), F.decode("content", "UTF-8").alias("content"), "mtime")


def raw_listing(listed: DataFrame) -> DataFrame:
    """name, path, size, mtime of the raw files, without dot files and folders and without converted/."""
    kept = listed.where(F.col("id").startswith("raw/") & ~F.col("id").startswith("raw/converted/") & ~F.regexp_like("id", F.lit(r"/\.")))
    return kept.select(file_name(F.col("id")).alias("name"), F.col("id").alias("path"), "size", "mtime")


def without_converted(rel: Column) -> Column:
    return F.regexp_replace(rel, "^converted/", "")


def undistilled(ids: DataFrame) -> DataFrame:
    """path (below raw/) of the raw Markdown files that have no source note of the same relative path; a leading converted/ doesn't count."""
    raw = ids.where(F.regexp_like("id", F.lit(r"^raw/.*\.md$")) & ~file_name(F.col("id")).isin(*RESERVED)).select(F.substr("id", F.lit(5)).alias("path"))
    notes = ids.where(F.col("id").startswith("wiki/source-notes/")).select(F.substr("id", F.lit(19)).alias("rel"))
    return raw.withColumn("rel", without_converted(F.col("path"))).join(notes, "rel", "left_anti").select("path")


def is_convertible(id_: Column) -> Column:
    """A raw file of a kind that is converted to Markdown."""
    return F.regexp_like(id_, F.lit(rf"(?i)^raw/.*\.({'|'.join(CONVERTIBLE)})$")) & ~id_.startswith("raw/converted/")


def convertible(listed: DataFrame) -> DataFrame:
    """path (below raw/) of the raw files of a convertible kind whose Markdown is not in raw/converted/ yet."""
    raw = listed.where(is_convertible(F.col("id")))
    raw = raw.select(F.substr("id", F.lit(5)).alias("path")).withColumn("made", F.concat(F.lit("raw/converted/"), F.regexp_replace("path", r"\.[^./]*$", ""), F.lit(".md")))
    return raw.join(listed.select(F.col("id").alias("made")), "made", "left_anti").select("path")


def orphan_stems(ids: DataFrame) -> DataFrame:
    """id of the source notes and converted files whose stem no raw file outside converted/ has, in whatever folder or of whatever kind. Without any raw file nothing is
    an orphan. It only reports; deleting is the caller's step."""
    from ..functions.text import stem

    raw = ids.where(F.col("id").startswith("raw/") & ~F.col("id").startswith("raw/converted/")).select(stem(F.col("id")).alias("stem")).distinct()
    made = ids.where(F.regexp_like("id", F.lit(r"^(wiki/source-notes|raw/converted)/.*\.md$")) & ~file_name(F.col("id")).isin(*RESERVED))
    if raw.isEmpty():
        return made.select("id").limit(0)
    return made.select("id", stem(F.col("id")).alias("stem")).join(raw, "stem", "left_anti").select("id")


def existing_titles(pages: DataFrame) -> DataFrame:
    """title of the synthesized pages, directly in their folders, so drafts are left out."""
    direct = F.regexp_like("id", F.lit(r"^wiki/(concepts|comparisons|decisions)/[^/]+\.md$"))
    return pages.where(direct & (F.coalesce("title", F.lit("")) != "") & ~file_name(F.col("id")).isin(*RESERVED)).select("title")


def eval_questions(spark: SparkSession, paths: list[str]) -> DataFrame:
    """question, ground_truth, expected_page of the first question file that is there."""
    for path in paths:
        at = spark._jvm.org.apache.hadoop.fs.Path(path)
        if at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
            return spark.read.schema("question string, ground_truth string, expected_page string").json(path, multiLine=True)
    raise FileNotFoundError(f"no question file in {paths}")
