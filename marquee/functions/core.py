"""Small helpers shared by the column functions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bind(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluate ``value`` once and use it any number of times in ``body``.

    Higher-order functions re-evaluate what their lambda refers to for every element; binding the value to the variable
    of a one-element ``transform`` avoids that.
    """
    return F.transform(F.array(value), body)[0]


def compute_once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Add a costly column that later filters read.

    A plain projection would be copied into every filter pushed below it; a one-element generator stays where it is.
    """
    return df.withColumn(name, F.explode(F.array(value)))


def one_row(df: DataFrame, *aggregates: Column) -> Column:
    """Global aggregates of ``df`` as a struct-valued scalar subquery: one partial-aggregated scan, no join."""
    return df.agg(F.struct(*aggregates).alias("row")).scalar()


def fixed(c: Column, digits: int = 6) -> Column:
    """Round half up by plain floating-point steps, the same on every SQL engine."""
    scale = float(10**digits)
    return F.floor(c * scale + 0.5) / F.lit(scale)
