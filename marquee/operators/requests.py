"""Request tables: validation, presets, weight overrides and defaults.

A request table has ``qid long`` (unique) plus any of the columns in :data:`SEARCH_DEFAULTS` /
:data:`RECOMMEND_DEFAULTS`; columns that are absent count as unset. Null means unset; for interface compatibility, zero
or less does so too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import config as C
from ..functions.ids import try_key_from_text
from ..functions.parsing import strip

WEIGHT_NAMES = ["plot", "genre", "localization", "popularity"]

SEARCH_DEFAULTS = {
    "query": "string",
    "countries": "array<string>",
    "languages": "array<string>",
    "max_results": "int",
    "min_rating": "double",
    "min_votes": "long",
    "year_from": "int",
    "year_to": "int",
    "preset": "string",
    **{f"{w}_weight": "double" for w in WEIGHT_NAMES},
}
RECOMMEND_DEFAULTS = {
    "item_id": "string",
    "max_results": "int",
    "use_cultural_weights": "boolean",
    "preset": "string",
    **{f"{w}_weight": "double" for w in WEIGHT_NAMES},
}


def complete(requests: DataFrame, defaults: dict[str, str]) -> DataFrame:
    """Add the columns that are absent as nulls."""
    absent = {name: F.lit(None).cast(kind) for name, kind in defaults.items() if name not in requests.columns}
    return requests.withColumns(absent) if absent else requests


def _set(name: str) -> Column:
    """The value of a numeric column if it is positive."""
    return F.when(F.col(name) > 0, F.col(name))


def resolved_weights(fallback: C.Weights, zero_allowed: bool = False) -> dict[str, Column]:
    """Four weight columns: the request's own, else its preset's, else the fallback's.

    The compatible reading takes a weight of zero as unset; ``zero_allowed`` lets it switch a component off. A preset
    unknown to the interface means the search default.
    """
    preset = F.lower(F.coalesce(F.col("preset"), F.lit("")))
    columns = {}
    for name in WEIGHT_NAMES:
        base = F.when(preset == "", F.lit(getattr(fallback, name)))
        for key, weights in C.PRESETS.items():
            base = base.when(preset == key, F.lit(getattr(weights, name)))
        base = base.otherwise(F.lit(getattr(C.SEARCH_WEIGHTS, name)))
        column = f"{name}_weight"
        own = F.col(column) if zero_allowed else _set(column)
        columns[column] = F.coalesce(own, base)
    return columns


def _errors(df: DataFrame, *checks: tuple[Column, int, str | Column]) -> DataFrame:
    code, message = F, F
    for condition, number, text in checks:
        text = F.lit(text) if isinstance(text, str) else text
        code, message = code.when(condition, F.lit(number)), message.when(condition, text)
    return df.withColumns(
        {"error_code": code.otherwise(F.lit(C.ERROR_NONE)), "error_message": message.otherwise(F.lit(None))}
    )


def _blank(name: str) -> Column:
    return F.coalesce(strip(F.col(name)), F.lit("")) == ""


def validate_search(requests: DataFrame) -> DataFrame:
    """Add ``error_code`` and ``error_message``; code 0 means the request can run."""
    return _errors(
        complete(requests, SEARCH_DEFAULTS),
        (_blank("query"), C.ERROR_INVALID_QUERY, "Search query cannot be empty"),
        (F.col("max_results") < 0, C.ERROR_INVALID_PARAMETERS, "max_results cannot be negative"),
        (
            ~F.coalesce(F.col("min_rating"), F.lit(0.0)).between(0.0, 10.0),
            C.ERROR_INVALID_PARAMETERS,
            "min_rating must be between 0 and 10",
        ),
    )


def validate_recommend(requests: DataFrame) -> DataFrame:
    """As :func:`validate_search` for recommendation requests; adds the source key ``source``."""
    keyed = complete(requests, RECOMMEND_DEFAULTS).withColumn("source", try_key_from_text(F.col("item_id")))
    return _errors(
        keyed,
        (_blank("item_id"), C.ERROR_INVALID_ID, "IMDb ID cannot be empty"),
        (
            F.col("source").isNull(),
            C.ERROR_INVALID_ID,
            F.concat(F.lit("Invalid IMDb ID format: "), F.col("item_id")),
        ),
        (F.col("max_results") < 0, C.ERROR_INVALID_PARAMETERS, "max_results cannot be negative"),
    )


def resolve_search(requests: DataFrame, zero_allowed: bool = False) -> DataFrame:
    """Validated requests with every default filled in; ``k`` is the number of titles to rank."""
    checked = validate_search(requests)
    some_year = (F.col("year_from") > 0) | (F.col("year_to") > 0)
    return checked.withColumns(
        {
            **resolved_weights(C.SEARCH_WEIGHTS, zero_allowed),
            "max_results": F.coalesce(_set("max_results"), F.lit(C.SEARCH_RESULTS)),
            "min_rating": _set("min_rating"),
            "min_votes": _set("min_votes"),
            "year_from": F.when(some_year, F.coalesce(_set("year_from"), F.lit(C.YEAR_FROM_DEFAULT))),
            "year_to": F.when(some_year, F.coalesce(_set("year_to"), F.lit(C.YEAR_TO_DEFAULT))),
        }
    ).withColumn("k", F.col("max_results").cast("int"))


def resolve_recommend(requests: DataFrame, zero_allowed: bool = False) -> DataFrame:
    """Validated recommendation requests with defaults. Without cultural weights, the search defaults apply."""
    checked = validate_recommend(requests)
    cultural = F.coalesce(F.col("use_cultural_weights"), F.lit(False))
    weights = {
        name: F.when(cultural, value).otherwise(F.lit(getattr(C.SEARCH_WEIGHTS, name.removesuffix("_weight"))))
        for name, value in resolved_weights(C.RECOMMEND_WEIGHTS, zero_allowed).items()
    }
    return checked.withColumns(
        {
            **weights,
            "use_cultural_weights": cultural,
            "max_results": F.coalesce(_set("max_results"), F.lit(C.RECOMMEND_RESULTS)),
        }
    )
