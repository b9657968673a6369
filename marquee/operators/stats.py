"""Catalogue statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def catalog_stats(movies: DataFrame, vocab: DataFrame, dimension: int) -> DataFrame:
    """One row of counts, year range, mean rating, vocabulary sizes and vector length."""
    entries = vocab.agg(
        F.struct(
            F.count_if(F.col("kind") == "country").alias("country"),
            F.count_if(F.col("kind") == "language").alias("language"),
        )
    ).scalar()
    return movies.agg(
        F.count("*").alias("total_titles"),
        F.min("year").alias("year_min"),
        F.max("year").alias("year_max"),
        F.avg("rating").alias("avg_rating"),
    ).select(
        "*",
        entries["country"].alias("total_countries"),
        entries["language"].alias("total_languages"),
        F.lit(dimension).cast("int").alias("embedding_dimension"),
        F.col("total_titles").alias("index_size"),
    )
