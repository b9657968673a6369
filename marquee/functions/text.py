"""Text helpers of search and recommendation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import GENRE_KEYWORDS, PASSAGE_PREFIX

WORD_BREAK = r"[^\p{L}\p{N}]+"


def words(text: Column) -> Column:
    """Lower-cased runs of letters and digits."""
    return F.filter(F.split(F.lower(text), WORD_BREAK), lambda w: w != "")


def passage(text: Column) -> Column:
    return F.concat(F.lit(PASSAGE_PREFIX), text)


def item_query(genres: Column, plot: Column, chars: int | None = None) -> Column:
    """Query text that stands for an item: its genres, then its plot, or the first ``chars`` characters of it."""
    snippet = F.coalesce(plot if chars is None else F.substring(plot, 1, chars), F.lit(""))
    return F.concat(F.lower(F.array_join(genres, " ")), F.lit(" "), snippet)


def keyword_genres(text: Column, keywords: dict[str, list[str]] = GENRE_KEYWORDS) -> Column:
    """Genres one of whose keywords occurs anywhere in the text, in table order."""
    lowered = F.lower(text)

    def mentioned(names: list[str]) -> Column:
        hit = F.contains(lowered, F.lit(names[0]))
        for name in names[1:]:
            hit = hit | F.contains(lowered, F.lit(name))
        return hit

    return F.array_compact(F.array(*[F.when(mentioned(ws), F.lit(g)) for g, ws in keywords.items()]))


def diversity_bucket(genres: Column, largest: Column, buckets: int) -> Column:
    """Number of genres placed on ``buckets`` evenly spaced edges from 1 to the largest number; 0 if none exceeds 1."""
    count = genres.cast("long")
    span = largest.cast("long") - 1
    place = F.floor((count - 1) * (buckets - 1) / span) + 1
    return F.when(span > 0, F.when(count < 1, 0).otherwise(F.least(place, F.lit(buckets)))).otherwise(0).cast("int")
