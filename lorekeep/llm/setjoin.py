"""All pairs of set-valued records, within a table or between two, whose Jaccard similarity reaches a threshold.

Prefix-filtered join. Records with equal sets become one class first, so a group of copies costs one row. The
members of a set are ordered by rarity (document frequency among classes, then text). For threshold t a set of n
members can only meet the threshold with a set that shares one of its first n - ceil(t n) + 1 members, so only those prefixes are
indexed; partners must have t n <= m <= n / t members, and a shared prefix member at positions i and j leaves at
most 1 + min(n - i, m - j) members in common, which must reach t (n + m) / (1 + t). What is left is verified on the whole sets.
Only classes in which two prefixes meet are looked up; a member is common only if the rare ones before it ran out, so the
hottest member is in almost no prefix. Prefix groups are split by AQE's skew join where one is large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import broadcastable, materialise
from .terms import clean_term

#: Slack for products of binary fractions, so that equality at the threshold counts.
EPS = 1e-9


def record_sets(rows: DataFrame, record: str, item: str, least: int) -> DataFrame:
    """record, items (sorted, distinct, cleaned) of the records with at least `least` items."""
    pairs = rows.select(F.col(record).alias("record"), clean_term(F.col(item)).alias("item"))
    pairs = pairs.where(F.col("record").isNotNull() & (F.col("item") != ""))
    sets = pairs.groupBy("record").agg(F.sort_array(F.collect_set("item")).alias("items"))  # repeated items end in the tasks that read them
    return sets.where(F.size("items") >= least)


def similar_sets(sets: DataFrame, threshold: float) -> tuple[DataFrame, DataFrame]:
    """(members, pairs): members is class_id, record, side; pairs is class_a, class_b (class_a < class_b), common, similarity.

    Every record with a set is a member of one class; members of a class have equal sets. Records need distinct keys within a table. With a
    column `side` (1 or 2, the tables) only classes that some record of one table and some record of the other belong to are paired.
    """
    side = F.col("side") if "side" in sets.columns else F.lit(3)
    keyed = sets.select("record", "items", F.unhex(F.md5(F.to_json("items"))).alias("class_id"), side.alias("side"))
    keyed = materialise(keyed, "sets")
    classes = keyed.groupBy("class_id").agg(F.first("items").alias("items"), F.bit_or("side").alias("sides"))
    tokens = classes.select("class_id", "sides", F.size("items").alias("n"), F.explode("items").alias("item"))
    ranks = materialise(tokens.groupBy("item").agg(F.count("*").alias("df")).where("df > 1"), "set-items")
    # an item that isn't among them stands in one class; where they are few enough to be broadcast, the classes need not move
    ordered = (
        tokens.join(broadcastable(ranks), "item", "left")
        .groupBy("class_id", "sides", "n")
        .agg(F.sort_array(F.collect_list(F.struct(F.coalesce("df", F.lit(1)).alias("df"), "item"))).alias("by_rarity"))
    )
    ordered = materialise(ordered.select("class_id", "sides", "n", F.col("by_rarity.item").alias("items"), F.col("by_rarity.df").alias("dfs")), "sets-ordered")
    prefix = F.col("n") - F.ceil(F.col("n") * threshold - EPS) + 1
    zipped = F.slice(F.arrays_zip("items", "dfs"), F.lit(1), prefix.cast("int"))
    index = (
        ordered.select("class_id", "sides", "n", F.posexplode(zipped).alias("at", "x"))
        .where("x.dfs > 1")  # a member that no other class has meets nobody: its posting is not shuffled
        .select("class_id", "sides", "n", "at", F.col("x.items").alias("item"))
    )
    a = index.select("item", F.col("class_id").alias("class_a"), F.col("n").alias("na"), F.col("at").alias("ia"), F.col("sides").alias("sa"))
    b = index.select("item", F.col("class_id").alias("class_b"), F.col("n").alias("nb"), F.col("at").alias("ib"), F.col("sides").alias("sb"))
    need = F.ceil((F.col("na") + F.col("nb")) * (threshold / (1 + threshold)) - EPS)
    left = 1 + F.least(F.col("na") - F.col("ia") - 1, F.col("nb") - F.col("ib") - 1)
    met = (
        a.join(b, "item")
        .where(F.col("class_a") < F.col("class_b"))
        .where((F.col("na") >= F.col("nb") * threshold - EPS) & (F.col("nb") >= F.col("na") * threshold - EPS))
        .where(left >= need)
        .where(F.col("sa").bitwiseOR(F.col("sb")) == 3)  # not both of one table alone
        .select("class_a", "class_b")
        .distinct()
    )
    full = ordered.select("class_id", "items")
    common = F.size(F.array_intersect("items_a", "items_b"))
    union = F.size("items_a") + F.size("items_b") - F.col("common")
    pairs = (
        met.join(full.toDF("class_a", "items_a"), "class_a")
        .join(full.toDF("class_b", "items_b"), "class_b")
        .withColumn("common", common)
        .withColumn("similarity", F.col("common") / union)
        .where(F.col("similarity") >= threshold - EPS)
        .select("class_a", "class_b", "common", "similarity")
    )
    return keyed.select("class_id", "record", "side"), pairs


def similar_between(left: DataFrame, right: DataFrame, threshold: float) -> DataFrame:
    """a, b: every record of `left` with every record of `right` of similar sets (both as record_sets gives them; their keys may be the same)."""
    both = left.withColumn("side", F.lit(1)).unionByName(right.withColumn("side", F.lit(2)))
    members, pairs = similar_sets(both, threshold)
    one = members.where("side = 1").select(F.col("class_id").alias("class_a"), F.col("record").alias("a"))
    two = members.where("side = 2").select(F.col("class_id").alias("class_b"), F.col("record").alias("b"))
    classes = pairs.select("class_a", "class_b").unionByName(pairs.select(F.col("class_b").alias("class_a"), F.col("class_a").alias("class_b")))
    across = classes.join(one, "class_a").join(two, "class_b").select("a", "b")
    return across.unionByName(one.join(two, F.col("class_a") == F.col("class_b")).select("a", "b"))


def expand_pairs(members: DataFrame, pairs: DataFrame) -> DataFrame:
    """a, b: every pair of records, the smaller key first, within a class and across similar classes."""
    one, two = members.select(F.col("class_id").alias("class_a"), F.col("record").alias("x")), members.select(F.col("class_id").alias("class_b"), F.col("record").alias("y"))
    across = pairs.select("class_a", "class_b").join(one, "class_a").join(two, "class_b").select("x", "y")
    within = one.join(two, F.col("class_a") == F.col("class_b")).where("x < y").select("x", "y")
    both = across.unionByName(within)
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"))
