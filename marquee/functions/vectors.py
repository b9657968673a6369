"""Vector arithmetic on array columns. Sums of squares and norms are bound once per row, not once per element."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .core import bind

TINY = 1e-12


def zeros(dim: int) -> Column:
    return F.array_repeat(F.lit(0.0), dim)


def squared_norm(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double"))


def fit(v: Column, dim: int) -> Column:
    """Pad with zeros or truncate to ``dim``."""
    return F.slice(F.concat(v.cast("array<double>"), zeros(dim)), 1, dim)


def scale(v: Column, by: Column | float) -> Column:
    return F.transform(v, lambda x: x.cast("double") * by)


def l2_normalize(v: Column) -> Column:
    """Unit length; a zero vector stays zero."""
    return bind(
        v,
        lambda w: bind(
            F.greatest(F.sqrt(squared_norm(w)), F.lit(TINY)),
            lambda n: F.transform(w, lambda x: x.cast("double") / n),
        ),
    )


def merge_weighted(a: Column, b: Column, weight_a: float, weight_b: float) -> Column:
    """Two vectors, scaled by weights that are made to sum to one, concatenated and normalised."""
    if weight_a < 0 or weight_b < 0:
        raise ValueError("weights must not be negative")
    total = weight_a + weight_b
    if total == 0:
        raise ValueError("at least one weight must be positive")
    return l2_normalize(F.concat(scale(a, weight_a / total), scale(b, weight_b / total)))


def combine_components(plot: Column, genre: Column, loc: Column, pop: Column, weights) -> Column:
    """The four weighted components as one unit vector."""
    return l2_normalize(
        F.concat(
            scale(plot, weights.plot),
            scale(genre, weights.genre),
            scale(loc, weights.localization),
            F.array(pop.cast("double") * weights.popularity),
        )
    )


def dense(places: Column, values: Column, dim: int) -> Column:
    """Vector of length ``dim`` with ``values`` at the strictly ascending ``places`` and zeros between them.

    The zeros come in runs, so the work of a row grows with its entries and not with entries times dimensions.
    """

    def spread(s: Column) -> Column:
        at, value = s["at"], s["value"]
        runs = F.transform(
            at,
            lambda p, i: F.concat(
                F.array_repeat(F.lit(0.0), p - F.coalesce(F.get(at, i - 1), F.lit(-1)) - 1), F.array(F.get(value, i))
            ),
        )
        last = F.coalesce(F.get(at, F.size(at) - 1), F.lit(-1))
        return F.concat(F.flatten(runs), F.array_repeat(F.lit(0.0), F.lit(dim - 1) - last))

    return bind(F.struct(places.cast("array<int>").alias("at"), values.cast("array<double>").alias("value")), spread)


def multi_hot(active: Column, size: int) -> Column:
    """0/1 vector of length ``size`` with ones at the ``active`` ordinals, in any order; null counts as none."""
    if size == 0:
        return F.array().cast("array<double>")
    known = F.filter(F.coalesce(active, F.array().cast("array<int>")), lambda i: (i >= 0) & (i < size))
    places = F.sort_array(F.array_distinct(known))
    return bind(places, lambda p: dense(p, F.array_repeat(F.lit(1.0), F.size(p)), size))
