"""Rating fusion and scalar normalisation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import ratings as R
from ..functions.core import one_row

DEFAULT_COLUMNS = ["year", "runtime", "rating", "votes", "metascore"]
STAGE_COLUMNS = ["year", "runtime", "votes"]


def unit_scores(movies: DataFrame) -> DataFrame:
    """Votes with zero as unknown, and both ratings on a 0..1 scale."""
    return movies.withColumns(
        {
            "votes": R.known_votes(F.col("votes")),
            "n_rating": R.unit_rating(F.col("rating")),
            "n_metascore": R.unit_metascore(F.col("metascore")),
        }
    )


def _means() -> list[Column]:
    return [
        F.avg("votes").alias("mean_votes"),
        F.avg("n_rating").alias("mean_rating"),
        F.avg("n_metascore").alias("mean_metascore"),
    ]


def rating_means(movies: DataFrame) -> DataFrame:
    """The three global means, in one scan."""
    return unit_scores(movies).agg(*_means())


def fuse_ratings(movies: DataFrame) -> DataFrame:
    """Bayesian rating, final rating and controversy. Rows without any rating are dropped.

    The means are a scalar subquery over the same input: two scans, no shuffle of rows, no join.
    """
    scored = unit_scores(movies)
    users = F.col("votes").isNotNull() & F.col("n_rating").isNotNull()
    rated = scored.filter(users | F.col("n_metascore").isNotNull()).withColumn("_means", one_row(scored, *_means()))
    shrunk = R.bayes(F.col("votes"), F.col("n_rating"), F.col("_means.mean_votes"), F.col("_means.mean_rating"))
    critics = F.col("n_metascore")
    return (
        rated.withColumn("bayes_rating", shrunk)
        .withColumn("final_rating", R.final_rating(F.col("bayes_rating"), critics))
        .withColumn(
            "controversy_score",
            R.controversy(F.col("bayes_rating"), critics, F.col("votes"), F.col("_means.mean_votes")),
        )
        .drop("_means")
    )


def normalize_scalars(movies: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """Add ``sn_<column>``: min-max scaled copies of the columns."""
    names = columns or DEFAULT_COLUMNS
    bounds = one_row(
        movies,
        *[F.min(n).alias(f"{n}_low") for n in names],
        *[F.max(n).alias(f"{n}_high") for n in names],
    )
    scaled = {f"sn_{n}": R.min_max(F.col(n), F.col(f"_bounds.{n}_low"), F.col(f"_bounds.{n}_high")) for n in names}
    return movies.withColumn("_bounds", bounds).withColumns(scaled).drop("_bounds")


def mean_final_rating(processed: DataFrame) -> DataFrame:
    return processed.agg(F.avg("final_rating").alias("mean_final_rating"))
