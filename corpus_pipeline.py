"""A corpus pipeline: language, exact copies, near copies, mixture, packing. Each stage takes ``(spark, docs, sf_dir)``.

Every stage works on all rows of ``docs``; all but the last return the columns of ``docs``. Rows with null text count as empty: the
first stage rejects them with all other texts that have no letter or are like no language that the labels name.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marquee.llm import exact_dedup, language, mixing, ngram_join, packing
from marquee.llm.common import crc_fold, stored
from marquee.llm.queries import vocabulary


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents without a letter (null and empty texts too), and those that share no n-gram with the profile of any language (score 0).

    Without any labelled row, only those without a letter. Rows are judged one by one: repeated rows share their fate. Columns that are
    called as the operator's results are kept as they are; an empty table stays empty.
    """
    model = language.fit(docs, crc_fold(F.col("doc_id"), 5) != 0)
    if not model.names:
        return docs.filter(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    found = language.identify(docs, model, names=("__lang_pred", "__lang_score"))
    return found.filter((F.col("__lang_pred") != language.UNKNOWN) & (F.col("__lang_score") > 0)).select(*docs.columns)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest ``doc_id`` of equal texts; a row with a null ``doc_id`` only where no other has one.

    Null texts count as empty and are copies of each other. Of rows that share key and text one stays, whichever Spark meets first. An
    empty table stays empty.
    """
    return exact_dedup.deduplicate(docs).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest ``doc_id`` of each component of similar documents.

    Rows with a null ``doc_id``, and null or wordless texts, are linked with nothing and stay. Rows that share a key stay or go
    together. An empty table stays empty.
    """
    return ngram_join.keep_one(docs).select(*docs.columns)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeat each document by its Poisson number: shares of sources by the square root of their size, one epoch.

    A null ``source`` is a source of its own. The number of a row follows from its key, so rows that share one are repeated alike. A
    column called as the operator's copy number is kept as it is; an empty table stays empty.
    """
    return mixing.poisson_mix(docs, seed=7, into="__copy").select(*docs.columns)


def pack_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 tokens.

    Null and empty texts are one end token each. Repeated rows are packed as often as they come. An empty table gives no pieces.
    """
    return packing.piece_rows(packing.pack(docs, *vocabulary()))


STAGES = [
    ("language", identify_language),
    ("exact_copies", drop_exact_copies),
    ("near_copies", drop_near_copies),
    ("mixture", mix_sources),
    ("packing", pack_windows),
]

ORACLE_SQL = None  # learned profiles and byte-pair encoding are not SQL; tests hold the stages against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
