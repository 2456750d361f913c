"""References to records that do not exist.

The ends of child rows name parent keys. The distinct non-null keys are counted first (map-side combined,
so a key that holds a third of the rows shuffles one row per task), anti-joined with the parents' keys, and
only the keys left over go back to the child rows. Keys and parents are both aggregated on the join key,
so that join needs no exchange of its own. In the way back, a key with more than 1/HOT_SHARE of all
ends is joined by broadcast (there are fewer than HOT_SHARE such keys by arithmetic); the rest shuffles without skew.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import reference_key, slug
from ..session import materialise

HOT_SHARE = 256


def link_ends(links: DataFrame) -> DataFrame:
    """One row per end of a link: link_id, side, relation, indexed_at, key, by_slug (whether a slug may resolve it)."""
    wiki = F.coalesce(F.col("relation") == "wikilink", F.lit(False))
    ends = F.array(
        F.struct(F.lit("source").alias("side"), reference_key(F.col("source_doc_id")).alias("key"), F.lit(False).alias("by_slug")),
        F.struct(F.lit("target").alias("side"), reference_key(F.col("target_doc_id")).alias("key"), wiki.alias("by_slug")),
    )
    return links.select(F.col("id").alias("link_id"), "relation", "indexed_at", F.inline(ends))


def parent_keys(pages: DataFrame) -> DataFrame:
    """key, by_slug, since: the earliest entry of a page that answers to the key."""
    names = F.array(
        F.struct(F.col("id").alias("key"), F.lit(False).alias("by_slug")),
        F.struct(F.col("id").alias("key"), F.lit(True).alias("by_slug")),
        F.struct(slug(F.col("id")).alias("key"), F.lit(True).alias("by_slug")),
    )
    named = pages.select("first_indexed_at", F.inline(names))
    return named.groupBy("key", "by_slug").agg(F.min("first_indexed_at").alias("since"))


def orphan_ends(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Every end that does not resolve: link_id, side, relation, indexed_at, key, since.

    `since` is null where no page answers to the key, else the entry of the page that came too late. Null and
    blank values never resolve (key null or empty). An end without indexed_at, or whose page has no
    first_indexed_at, does not resolve either. Repeated link rows give repeated ends; other columns are ignored.
    """
    ends = link_ends(links)
    blank = F.coalesce(F.col("key") == "", F.lit(True))
    refs = (
        ends.where(~blank)
        .groupBy("key", "by_slug")
        .agg(F.count("*").alias("n"), F.min("indexed_at").alias("first_ref"), F.count("indexed_at").alias("timed"))
    )
    gone = F.col("since").isNull() | (F.col("first_ref") < F.col("since")) | (F.col("timed") < F.col("n"))
    lost = materialise(refs.join(parent_keys(pages), ["key", "by_slug"], "left").where(gone).select("key", "by_slug", "since", "n"), "orphan-keys")

    total = 2 * links.count()
    hot = lost.where(F.col("n") * HOT_SHARE > total)
    cold = lost.where(F.col("n") * HOT_SHARE <= total)
    unresolved = F.col("since").isNull() | F.col("indexed_at").isNull() | (F.col("indexed_at") < F.col("since"))
    columns = ["link_id", "side", "relation", "indexed_at", "key", "since"]
    blanks = ends.where(blank).withColumn("since", F.lit(None).cast("bigint")).select(columns)
    named = ends.where(~blank)
    if not hot.isEmpty():
        few = F.broadcast(hot.select("key", "by_slug", "since"))
        heavy = named.join(few, ["key", "by_slug"]).where(unresolved).select(columns)
        named = named.join(F.broadcast(hot.select("key", "by_slug")), ["key", "by_slug"], "left_anti")
        blanks = blanks.unionByName(heavy)
    light = named.join(cold.drop("n"), ["key", "by_slug"]).where(unresolved).select(columns)
    return light.unionByName(blanks)


def orphan_report(links: DataFrame, pages: DataFrame, purges: DataFrame) -> DataFrame:
    """Counts of orphan ends per table, side, relation, calendar month (UTC) and reason.

    Reasons: `blank` (no value), `late` (the page came after the link), `purged` (no page, but the key was removed by
    an index run), `missing` (never known). n_ends counts ends, n_keys distinct keys.
    """
    removed = purges.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").alias("key"), F.lit(True).alias("removed")).distinct()
    per_key = (
        orphan_ends(links, pages)
        .withColumn("month", F.date_format(F.timestamp_seconds("indexed_at"), "yyyy-MM"))
        .groupBy("key", "side", "relation", "month", F.col("since").isNotNull().alias("late"))
        .agg(F.count("*").alias("n"))
        .join(removed, "key", "left")
    )
    reason = (
        F.when(F.coalesce(F.col("key"), F.lit("")) == "", "blank").when(F.col("late"), "late").when(F.col("removed"), "purged").otherwise("missing")
    )
    return per_key.groupBy(F.lit("links").alias("table"), "side", "relation", "month", reason.alias("reason")).agg(
        F.sum("n").alias("n_ends"), F.countDistinct("key").alias("n_keys")
    )


def references(rows: DataFrame, table: str, field: str, at: str | None = None) -> DataFrame:
    """table, field, month, key, n: the cleaned values of a foreign key and how many rows have each, per calendar month (UTC) of `at` (epoch seconds; null without one)."""
    month = F.date_format(F.timestamp_seconds(at), "yyyy-MM") if at else F.lit(None).cast("string")
    named = rows.select(F.lit(table).alias("table"), F.lit(field).alias("field"), month.alias("month"), reference_key(F.col(field)).alias("key"))
    return named.where(F.col("key") != "").groupBy("table", "field", "month", "key").agg(F.count("*").alias("n"))


def missing_parents(refs: list[DataFrame], parents: DataFrame, key: str) -> DataFrame:
    """table, field, month, n_rows, n_keys: references of any number of tables (each as `references` gives it) to keys that no parent has. Null and blank keys refer to nothing.
    Rows are counted per key before anything is joined, so the anti-join moves distinct keys, and no way back to the rows is needed."""
    all_ = refs[0]
    for r in refs[1:]:
        all_ = all_.unionByName(r)
    lost = all_.join(parents.select(F.col(key).alias("key")).where("key IS NOT NULL").distinct(), "key", "left_anti")
    return lost.groupBy("table", "field", "month").agg(F.sum("n").alias("n_rows"), F.countDistinct("key").alias("n_keys"))
