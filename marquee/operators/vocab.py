"""Vocabularies: distinct list values with their ordinals, and lists turned into active ordinals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import LOOKUP_VOCAB_MAX
from ..functions.core import bind
from ..functions.parsing import list_from_array, list_from_text, strip

SPLITTERS = 1024  # ranges the order of a vocabulary is cut into, about
STEPS = [2**n for n in range(13, -1, -1)]  # of the binary search among the cuts; enough for 16383 of them


def list_column(df: DataFrame, name: str) -> Column:
    """A list field as an array, whether it is stored as an array or as comma-separated text."""
    is_text = isinstance(df.schema[name].dataType, T.StringType)
    return list_from_text(F.col(name)) if is_text else list_from_array(F.col(name))


def stripped_list(df: DataFrame, name: str) -> Column:
    """As :func:`list_column`, with stripped members."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return list_column(df, name)
    return F.filter(F.transform(list_column(df, name), strip), lambda v: v != "")


def tagged_lists(df: DataFrame, columns: dict[str, str]) -> Column:
    """The list fields as one array of ``(kind, values)``."""
    return F.array(
        *[F.struct(F.lit(kind).alias("kind"), stripped_list(df, c).alias("values")) for kind, c in columns.items()]
    )


def list_entries(df: DataFrame, columns: dict[str, str], *keep: str) -> DataFrame:
    """``(kind, value)`` of every non-empty member of the list fields.

    The outer form of explode is used because the inner one makes Catalyst parse each list again to test its size.
    """
    pairs = df.select(*keep, F.explode(tagged_lists(df, columns)).alias("f"))
    return pairs.select(*keep, "f.kind", F.explode_outer("f.values").alias("value")).filter("value is not null")


def list_values(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Distinct ``(kind, value)`` pairs of several list columns, found in one scan.

    The first aggregation happens before the shuffle, so a value held by a third of all rows moves once per task.
    """
    return list_entries(df, columns).distinct()


def _cuts(values: DataFrame) -> DataFrame:
    """About ``SPLITTERS`` sorted values per kind, picked by hash; all of them when there are fewer."""
    sizes = values.groupBy("kind").agg(F.count("*").alias("n"))
    step = F.greatest(F.lit(1), F.floor(F.col("n") / SPLITTERS))
    picked = values.join(F.broadcast(sizes), "kind").filter(F.pmod(F.xxhash64("value"), step) == 0)
    return picked.groupBy("kind").agg(F.sort_array(F.collect_list("value")).alias("cuts"))


def _range_of(value: Column, cuts: Column) -> Column:
    """Number of cuts that are not above the value, by binary search."""
    return bind(
        cuts,
        lambda c: F.aggregate(
            F.array(*[F.lit(s) for s in STEPS]),
            F.lit(0),
            lambda low, s: F.when((low + s <= F.size(c)) & (F.get(c, low + s - 1) <= value), low + s).otherwise(low),
        ),
    )


def with_ordinals(values: DataFrame) -> DataFrame:
    """Add ``idx``: position of each distinct value among the sorted values of its kind, from 0.

    No task ever sorts all values: a hash sample per kind cuts the order into ranges, the ranges are counted, and rows
    are numbered within their range. Only the cuts and the range counts meet in one place, and their number is bounded
    by ``SPLITTERS`` whatever the size of the vocabulary.
    """
    cuts = _cuts(values).agg(F.map_from_entries(F.collect_list(F.struct("kind", "cuts")))).scalar()
    ranged = values.withColumn("_cuts", cuts).select(
        "kind", "value", F.coalesce(_range_of(F.col("value"), F.col("_cuts")[F.col("kind")]), F.lit(0)).alias("range")
    )
    per_range = ranged.groupBy("kind", "range").agg(F.count("*").alias("n"))
    before = Window.partitionBy("kind").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = per_range.select("kind", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("kind", "range").orderBy("value")
    return (
        ranged.withColumn("place", F.row_number().over(inside) - 1)
        .join(F.broadcast(offsets), ["kind", "range"])
        .select("kind", "value", (F.col("offset") + F.col("place")).cast("int").alias("idx"))
    )


def build_vocab(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Vocabulary table ``(kind, value, idx)`` of several list columns."""
    return with_ordinals(list_values(df, columns))


def vocab_size(vocab: DataFrame, kind: str | list[str]) -> int:
    """Number of entries of one or more kinds: one number to the driver, needed to fix vector lengths."""
    kinds = [kind] if isinstance(kind, str) else kind
    return vocab.filter(F.col("kind").isin(*kinds)).count()


def _offset_vocab(vocab: DataFrame, kinds: list[str], sizes: dict[str, int]) -> DataFrame:
    """Entries of the kinds, numbered one kind after the other."""
    start, offset = F.lit(None).cast("int"), 0
    for kind in kinds:
        start = F.when(F.col("kind") == kind, F.lit(offset)).otherwise(start)
        offset += sizes[kind]
    return vocab.filter(F.col("kind").isin(*kinds)).select("kind", "value", (F.col("idx") + start).alias("feature"))


def active_features(
    df: DataFrame,
    vocab: DataFrame,
    columns: dict[str, str],
    out: str,
    key: str = "tid",
    sizes: dict[str, int] | None = None,
    lookup_max: int = LOOKUP_VOCAB_MAX,
) -> DataFrame:
    """Add ``out``: the sorted ordinals of the row's known list values, kinds numbered one after the other.

    Small vocabularies (checked) are a lookup map from a scalar subquery, so rows are not shuffled. Larger ones take the
    route explode -> join -> collect per key. Unknown values are ignored on both routes.
    """
    kinds = list(columns)
    sizes = sizes or {kind: vocab_size(vocab, kind) for kind in kinds}
    entries = _offset_vocab(vocab, kinds, sizes)
    if sum(sizes.values()) <= lookup_max:
        return _features_by_lookup(df, entries, columns, out)
    return _features_by_join(df, entries, columns, out, key)


def _features_by_lookup(df: DataFrame, entries: DataFrame, columns: dict[str, str], out: str) -> DataFrame:
    lookup = entries.agg(
        F.map_from_entries(
            F.collect_list(F.struct(F.concat_ws("\u0001", "kind", "value").alias("k"), F.col("feature").alias("v")))
        )
    ).scalar()


    def known(m: Column, kind: str, values: Column) -> Column:
        return F.transform(values, lambda v: m[F.concat_ws("\u0001", F.lit(kind), v)])

    def features(m: Column) -> Column:
        found = [known(m, kind, stripped_list(df, c)) for kind, c in columns.items()]
        return F.sort_array(F.array_distinct(F.array_compact(F.concat(*found))))

    # Bound, so the map is referred to once and stays a constant of the expression instead of a column of every row.
    return df.withColumn("_lookup", lookup).select(*df.columns, bind(F.col("_lookup"), features).alias(out))


def _features_by_join(df: DataFrame, entries: DataFrame, columns: dict[str, str], out: str, key: str) -> DataFrame:
    found = (
        list_entries(df, columns, key)
        .join(entries, ["kind", "value"])
        .groupBy(key)
        .agg(F.sort_array(F.collect_set("feature")).alias(out))
    )
    empty = F.array().cast("array<int>")
    return df.join(found, key, "left").withColumn(out, F.coalesce(F.col(out), empty))


def feature_combos(features: DataFrame, column: str) -> DataFrame:
    """Size of each distinct set of active features."""
    return features.groupBy(column).agg(F.count("*").alias("members"))
