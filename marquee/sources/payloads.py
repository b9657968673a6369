"""Metadata payloads: one JSON object of texts per title, parsed into typed rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.core import compute_once
from ..functions.parsing import parse_float, parse_int, parse_list, parse_minutes, parse_text

# The keys of a payload.
KEYS = [
    "Response", "Error", "Title", "Year", "Rated", "Runtime", "Genre", "Director", "Actors", "Plot", "Language",
    "Country", "Awards", "Poster", "imdbRating", "imdbVotes", "Metascore",
]

SCHEMA = ", ".join(f"`{key}` string" for key in KEYS) + ", _corrupt_record string"
MOVIE_COLUMNS = [
    "tid", "title", "year", "rated", "runtime", "genre", "director", "actors", "plot", "language", "country", "awards",
    "poster", "rating", "votes", "metascore",
]


def _typed(p: Column) -> dict[str, Column]:
    return {
        "title": parse_text(p["Title"]),
        "year": parse_int(p["Year"]),
        "rated": parse_text(p["Rated"]),
        "runtime": parse_minutes(p["Runtime"]),
        "genre": parse_list(p["Genre"]),
        "director": parse_list(p["Director"]),
        "actors": parse_list(p["Actors"]),
        "plot": parse_text(p["Plot"]),
        "language": parse_list(p["Language"]),
        "country": parse_list(p["Country"]),
        "awards": parse_list(p["Awards"], "&"),
        "poster": parse_text(p["Poster"]),
        "rating": parse_float(p["imdbRating"]),
        "votes": parse_int(p["imdbVotes"]),
        "metascore": parse_int(p["Metascore"]),
    }


def parse_payloads(payloads: DataFrame) -> DataFrame:
    """``(tid, raw)`` -> typed columns plus ``raw`` and ``error`` (null for a good row).

    Whole numbers are 64 bits wide, so no size of a number rejects a title; one that does not fit is null, as other unreadable
    numbers are.
    """
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_corrupt_record"}
    parsed = compute_once(payloads, "_p", F.from_json("raw", SCHEMA, options))
    p = F.col("_p")
    typed = parsed.withColumns(_typed(p))
    error = (
        F.when(p.isNull() | p["_corrupt_record"].isNotNull(), F.lit("malformed payload"))
        .when(~p["Response"].eqNullSafe(F.lit("True")), F.coalesce(p["Error"], F.lit("Unknown error")))
    )
    return typed.withColumn("error", error).drop("_p")


def good_rows(parsed: DataFrame) -> DataFrame:
    """The typed movies table."""
    return parsed.filter(F.col("error").isNull()).select(*MOVIE_COLUMNS)


def quarantine(parsed: DataFrame) -> DataFrame:
    """Payloads that could not be used, with the reason."""
    return parsed.filter(F.col("error").isNotNull()).select("tid", "error", "raw")


def require_good(parsed: DataFrame) -> DataFrame:
    """Strict reading: any bad payload fails the job that reads the result."""
    message = F.concat(F.lit("payload of "), F.col("tid").cast("string"), F.lit(": "), F.col("error"))
    checked = parsed.withColumn("error", F.when(F.col("error").isNotNull(), F.raise_error(message)).cast("string"))
    return good_rows(checked)
