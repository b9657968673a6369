"""Incremental ingest and encoding: the batch operators, run on what has newly arrived.

Both use ``availableNow``: take everything that is there, then stop. A micro-batch replayed after a failure finds its
keys already stored and adds nothing, so every key is written once. Payloads have no arrival time: of several good ones
of a title in a micro-batch the one with the smallest content digest is stored, and a stored title stays as it is. What
differs from it is kept beside the rejections, each distinct one once.

Stored tables are laid out in folders by a hash class of the key. A micro-batch reads the folders of its own keys' classes and
no others, so what a small batch of n keys reads is at most n of ``KEY_CLASSES`` parts of the table, however large it grows.
Each batch adds a file to each class it has keys of: land payloads in batches of many keys.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from ..functions.text import passage
from ..operators.eligibility import with_plot
from ..operators.encoders import Encoder
from ..sources.payloads import MOVIE_COLUMNS, good_rows, parse_payloads, quarantine

NOT_STORED = "another payload of this title is stored"
KEY_CLASSES = 256  # part of the stored layout: a table must be rewritten to change it
PART_BYTES = 32 << 20  # payload text of a part of a batch; parsed and kept, it is some times as large


def _spread(batch: DataFrame) -> DataFrame:
    """A batch of many payloads dealt into parts of bounded size, however many files Spark reads in one split."""
    size = batch.agg(F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()[0]
    parts = -(-size // PART_BYTES)
    return batch.repartition(max(parts, batch.sparkSession.sparkContext.defaultParallelism)) if parts > 1 else batch


def _key_class() -> Column:
    return F.pmod(F.xxhash64("tid"), F.lit(KEY_CLASSES)).cast("int")


def key_classes(batch: DataFrame) -> list[int]:
    """The key classes of a batch, at most ``KEY_CLASSES`` numbers."""
    return sorted(r[0] for r in batch.select(_key_class().alias("c")).distinct().collect())


def read_stored(spark: SparkSession, path: str, schema: T.StructType | str, classes: list[int] | None = None) -> DataFrame:
    """Rows of a table that a stream has written, of the given key classes only if there are any; without a table no rows."""
    wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    try:
        rows = spark.read.schema(T.StructType([*wanted.fields, T.StructField("key_class", T.IntegerType())])).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], wanted)
    return (rows if classes is None else rows.filter(F.col("key_class").isin(classes))).drop("key_class")


def _unseen(batch: DataFrame, path: str, classes: list[int]) -> DataFrame:
    """Rows of ``batch`` whose key the table at ``path`` lacks, one row per key; null is a key like any other.

    Stored keys are first cut down to those of the batch, so a small batch never shuffles the stored table.
    """
    once = batch.dropDuplicates(["tid"])
    stored = read_stored(batch.sparkSession, path, "tid long", classes).select(F.col("tid").alias("held"))
    same = F.col("tid").eqNullSafe(F.col("held"))
    return once.join(stored.join(once.select("tid"), same, "left_semi"), same, "left_anti")


def _content() -> Column:
    return F.sha2(F.to_json(F.struct(*MOVIE_COLUMNS)), 256)


def _one_each(good: DataFrame) -> DataFrame:
    """Of the good rows of a title the one with the smallest content digest."""
    rest = [c for c in MOVIE_COLUMNS if c != "tid"]
    return good.groupBy("tid").agg(F.min(F.struct(_content().alias("content"), *rest)).alias("row")).select("tid", "row.*").select(*MOVIE_COLUMNS)


def _not_stored(parsed: DataFrame, path: str, classes: list[int]) -> DataFrame:
    """Good payloads that differ from what the table at ``path`` holds for their title, as rows of the quarantine."""
    good = parsed.filter("error is null").select("tid", F.lit(NOT_STORED).alias("error"), "raw", _content().alias("content"))
    stored = read_stored(parsed.sparkSession, path, good_rows(parsed).schema, classes)
    held = stored.select(F.col("tid").alias("held"), _content().alias("same"))
    return good.join(held, F.col("tid").eqNullSafe(F.col("held")) & (F.col("content") == F.col("same")), "left_anti").drop("content")


def _new_rejections(rejected: DataFrame, path: str, classes: list[int]) -> DataFrame:
    """Distinct rejections that the table at ``path`` lacks."""
    once = rejected.distinct()
    stored = read_stored(rejected.sparkSession, path, rejected.schema, classes)
    held = stored.select(*[F.col(c).alias(f"held_{c}") for c in rejected.columns])
    same = [F.col(c).eqNullSafe(F.col(f"held_{c}")) for c in rejected.columns]
    return once.join(held, same[0] & same[1] & same[2], "left_anti")


def _append(rows: DataFrame, path: str) -> None:
    """Add rows by key class, a file for each class, or several where a class's rows are many."""
    placed = rows.withColumn("key_class", _key_class()).hint("rebalance", "key_class").sortWithinPartitions("key_class", "tid")
    placed.write.mode("append").option("compression", "snappy").partitionBy("key_class").parquet(path)


def ingest_payloads(payloads: DataFrame, movies_path: str, rejected_path: str, checkpoint: str) -> StreamingQuery:
    """Parse a stream of ``(tid, raw)`` into the movies table, with bad payloads kept apart."""

    def store(batch: DataFrame, _: int) -> None:
        parsed = parse_payloads(_spread(batch)).persist()
        classes = key_classes(parsed)
        _append(_unseen(_one_each(good_rows(parsed)), movies_path, classes), movies_path)
        rejected = quarantine(parsed).unionByName(_not_stored(parsed, movies_path, classes))
        _append(_new_rejections(rejected, rejected_path, classes), rejected_path)
        parsed.unpersist()

    return (
        payloads.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def encode_titles(movies: DataFrame, encoder: Encoder, path: str, checkpoint: str) -> StreamingQuery:
    """Encode the plots of a stream of titles into ``(tid, plot_embedding)``; stored titles are not encoded again."""

    def store(batch: DataFrame, _: int) -> None:
        todo = _unseen(with_plot(batch), path, key_classes(batch))
        _append(encoder.encode(todo, "tid", passage(F.col("plot")), "plot_embedding"), path)

    return (
        movies.writeStream.foreachBatch(store)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )
