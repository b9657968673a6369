"""Exact duplicates by skew-safe combining, in DataFrame operations only.

Texts are equal when they are identical after every run of white space became one space. Copies are combined in three steps,
each of which groups by the digest *and* the full normalised text: inside a task (the partial aggregation), per salt (a
group of any size is spread over ``salts`` tasks), and over the winners of the salts. What follows moves digests and ids only:
the result is handed from the global winner to the salts and from the salts to the rows, so no step meets a whole group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored

SALTS = 16
SPACE_RUN = r"[\x20\x09-\x0D]+"


def normalised(text: str | Column) -> Column:
    return F.regexp_replace(F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit("")), SPACE_RUN, " ")


def digest(text: Column) -> Column:
    return F.sha2(text.cast("binary"), 256)


def exact_groups(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """One row per row of ``df``: key, ``keep_id``, ``group_size``, ``kept``, ``text_sha256``.

    The smallest key of a group stays; null keys come last. Of rows that share key and text, exactly one is kept. Null text
    counts as empty, so all null and empty texts are one group, while a text of white space alone is one space. An empty
    table gives no rows, and other columns are not read. Two different texts with one SHA-256 would be an error, not a merge.
    """
    source = df.select(F.col(key).alias("k"), normalised(text).alias("t"))
    row = F.monotonically_increasing_id()
    rows = stored(source.select("k", digest(F.col("t")).alias("h"), row.alias("r")).withColumn("salt", (F.col("r") % salts).cast("int")), "dedup-rows")

    # full content at every stage: local (partial), salted, global
    content = source.select("k", "t", digest(F.col("t")).alias("h"), (row % salts).cast("int").alias("salt"))
    salted = content.groupBy("h", "t", "salt").agg(F.min("k").alias("k"), F.count(F.lit(1)).alias("n"))
    winners = salted.groupBy("h", "t").agg(F.min("k").alias("k"), F.sum("n").alias("n"))
    by_digest = winners.groupBy("h").agg(F.min("k").alias("keep_id"), F.sum("n").alias("n"), F.count(F.lit(1)).alias("texts"))
    size = F.when(F.col("texts") == 1, F.col("n")).otherwise(F.raise_error(F.lit("two texts share a SHA-256")).cast("long"))
    groups = by_digest.select("h", "keep_id", size.alias("group_size"))

    # the one row that stays, decided on ids: smallest key, nulls last, then the first row
    first = F.struct(F.col("k").isNull().alias("none"), "k", "r")
    per_salt = rows.groupBy("h", "salt").agg(F.min(first).alias("first"))
    chosen = per_salt.groupBy("h").agg(F.min("first").getField("r").alias("keep_row"))
    told = per_salt.select("h", "salt").join(groups.join(chosen, "h"), "h")
    kept = (F.col("r") == F.col("keep_row")).alias("kept")
    return rows.join(told, ["h", "salt"]).select(F.col("k").alias(key), "keep_id", "group_size", kept, F.col("h").alias("text_sha256"))


def deduplicate(df: DataFrame, key: str = "doc_id", text: str = "text", salts: int = SALTS) -> DataFrame:
    """``df`` with one row of each group of equal texts: the one with the smallest key.

    Rows that share key and text are first reduced inside each task and then per key, so repeated rows leave one. All columns
    of the row that stays are kept as they are.
    """
    kept = exact_groups(df, key, text, salts).filter("kept").select(F.col(key).alias("__keep_key"), F.col("text_sha256").alias("__keep_sha"))
    marked = df.withColumn("__keep_sha", digest(normalised(text))).dropDuplicates([key, "__keep_sha"])
    same = F.col(key).eqNullSafe(F.col("__keep_key")) & (marked["__keep_sha"] == kept["__keep_sha"])
    return marked.join(kept, same, "left_semi").drop("__keep_sha")
