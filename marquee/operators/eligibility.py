"""Selection of eligible and searchable titles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..config import ELIGIBLE_TYPES, MIN_RATING, MIN_VOTES, MIN_YEAR
from ..functions.ids import key_from_text


def eligible_ids(
    titles: DataFrame,
    ratings: DataFrame,
    min_year: int = MIN_YEAR,
    min_votes: int = MIN_VOTES,
    min_rating: float = MIN_RATING,
) -> DataFrame:
    """Keys of films new enough and rated often and well enough. Unrated titles drop out, so the join is inner."""
    kept = titles.filter(F.col("titleType").isin(*ELIGIBLE_TYPES) & (F.col("startYear") >= min_year)).select("tconst")
    rated = ratings.filter((F.col("numVotes") >= min_votes) & (F.col("averageRating") >= min_rating)).select("tconst")
    return kept.join(rated, "tconst").select(key_from_text(F.col("tconst")).alias("tid"))


def searchable(movies: DataFrame) -> DataFrame:
    """Titles with a non-empty plot (null plots drop out as well)."""
    return movies.filter(F.col("plot") != "")


def with_plot(movies: DataFrame) -> DataFrame:
    """Rows whose plot can be encoded; an empty text counts."""
    return movies.filter(F.col("plot").isNotNull())


def with_genre(movies: DataFrame) -> DataFrame:
    """Rows whose genres can be encoded; an empty list counts."""
    return movies.filter(F.col("genre").isNotNull())


def column_errors(movies: DataFrame) -> dict[str, str]:
    """What the columns lack for encoding: a key, and at least one of plot and genre. Empty if nothing."""
    present, errors = set(movies.columns), {}
    if "tid" not in present:
        errors["tid"] = "missing required column: tid"
    if not present & {"plot", "genre"}:
        errors["plot, genre"] = "at least one of the columns plot and genre is required"
    return errors


def require_columns(movies: DataFrame) -> None:
    """Fail unless the table can be encoded."""
    for message in column_errors(movies).values():
        raise ValueError(message)


def encoding_report(movies: DataFrame) -> DataFrame:
    """What :func:`require_columns` and an encoding run would fail on, as rows ``(field, n, error)``.

    A missing column has no number of rows. For a present plot or genre, ``n`` is the number of rows that can be encoded, and
    none of them is an error. One aggregated scan; an error in the columns does not hide one in the rows.
    """
    spark, errors = movies.sparkSession, column_errors(movies)
    rows = [(field, message) for field, message in errors.items()]
    report = spark.createDataFrame(rows, "field string, error string").select("field", F.lit(None).cast("long").alias("n"), "error")
    present = [c for c in ("plot", "genre") if c in movies.columns]
    if not present:
        return report
    counts = movies.agg(*[F.count(c).alias(c) for c in present])
    each = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("n")) for c in present])).alias("r")
    nothing = F.when(F.col("n") == 0, F.concat(F.lit("no titles with a "), F.col("field")))
    return report.unionByName(counts.select(each).select("r.*").withColumn("error", nothing))


def first_keys(ids: DataFrame, count: int) -> DataFrame:
    """The ``count`` smallest keys (a top-k, not a total sort)."""
    return ids.orderBy("tid").limit(count)


def not_done(ids: DataFrame, done: DataFrame) -> DataFrame:
    """Keys without a finished row."""
    return ids.join(done.select("tid"), "tid", "left_anti")

