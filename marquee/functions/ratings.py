"""Rating formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def known_votes(votes: Column) -> Column:
    """Zero votes mean unknown."""
    return F.nullif(votes.cast("double"), F.lit(0.0))


def unit_rating(rating: Column) -> Column:
    return rating.cast("double") / 10


def unit_metascore(metascore: Column) -> Column:
    return metascore.cast("double") / 100


def bayes(votes: Column, rating: Column, mean_votes: Column, mean_rating: Column) -> Column:
    """Rating shrunk towards the mean by the number of votes; null unless both inputs are known."""
    total = votes + mean_votes
    return votes / total * rating + mean_votes / total * mean_rating


def final_rating(bayes_rating: Column, metascore: Column) -> Column:
    """Mean of both sources when both exist, else the one that does."""
    return F.coalesce((bayes_rating + metascore) / 2, bayes_rating, metascore)


def controversy(bayes_rating: Column, metascore: Column, votes: Column, mean_votes: Column) -> Column:
    """Disagreement of users and critics, damped when there are few votes; null unless both exist."""
    return F.abs(bayes_rating - metascore) * (F.least(votes, mean_votes) / mean_votes)


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Min-max scaling; a constant (or entirely null) column gives 0.5 on every row, nulls included."""
    low, high = low.cast("double"), high.cast("double")
    return F.when(high.eqNullSafe(low), F.lit(0.5)).otherwise((value.cast("double") - low) / (high - low))
