"""Language identification by rank-order n-gram profiles.

A profile is the list of a language's ``profile`` most frequent n-grams (1 to 3 letters, words padded by a blank) in order of
frequency. A document's own list is compared with each profile: every n-gram counts the difference of its two ranks, or
``profile`` if the language's list lacks it. The smallest sum of these out-of-place distances wins.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_batches, text_slices, worker_cache

PROFILE = 400
TRAIN_ROWS = 20_000  # bound of the labelled rows that profiles are learned from, shared out over the languages
LEAST_ROWS = 64  # rows that a language may have in any case
GRAM_CHUNK = 1 << 19
FLUSH = 1_000_000
UNKNOWN = "und"


def _letters() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and whether it belongs to a word (letters and combining marks)."""

    def make():
        import unicodedata

        letter = np.fromiter((chr(i).isalpha() for i in range(0x110000)), bool, 0x110000)
        mark = np.fromiter((unicodedata.category(chr(i))[0] == "M" for i in range(0x110000)), bool, 0x110000)
        return letter, letter | mark

    return worker_cache("letters", make)


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Row, n-gram and count of each distinct n-gram of each text, and which texts have a letter.

    An n-gram is a number: its code points in steps of 21 bits, with 1 for the blank at a word's edge.
    """
    letter, inside = _letters()
    rows = [" " + t.lower() if t else " " for t in texts]
    size = np.array([len(r) for r in rows], np.int64)
    point = np.frombuffer("".join(rows).encode("utf-32-le", "surrogatepass"), np.uint32)
    row = np.repeat(np.arange(len(rows)), size)
    has_letter = np.zeros(len(rows), bool)
    has_letter[row[letter[point]]] = True
    code = np.append(np.where(inside[point], point, 1), 1).astype(np.int64)
    one, two, three = code[:-1], code[1:], np.append(code[2:], 1)
    own, second = one > 1, two > 1
    pair, triple = own | second, second
    pair[1:] &= ~((one[1:] == 1) & (row[1:] != np.append(row[2:], -1)))  # a blank at a row's end belongs to no word
    triple = triple & (np.append(row[1:], -1) == row)
    pair &= own | (np.append(row[1:], -1) == row)
    gram = np.concatenate([one[own], (one << 21 | two)[pair], (one << 42 | two << 21 | three)[triple]])
    of = np.concatenate([row[own], row[pair], row[triple]])
    if not len(gram):
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, has_letter
    index, values = pd.factorize(gram)
    key = np.sort(of * len(values) + index)
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    count = np.diff(np.append(first, len(key)))
    key = key[first]
    return key // len(values), values[key % len(values)], count, has_letter


def learn_profiles(df: DataFrame, text: str, lang: str, profile: int = PROFILE) -> dict[str, list[int]]:
    """The n-grams of each non-null language in order of frequency, ties by code point. ``df`` is a bounded sample."""
    bounded_batches(df.sparkSession)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[tuple[str, int], int] = {}

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([k[0] for k in kept], pa.string()), pa.array([k[1] for k in kept], pa.int64()), pa.array(list(kept.values()), pa.int64())], ["lang", "gram", "n"])
            kept.clear()
            return out

        for batch in batches:
            for a, b in text_slices(batch.column(0), GRAM_CHUNK):
                part = batch.slice(a, b - a)
                row, gram, n, _ = grams(part.column(0).to_pylist())
                named = np.array(part.column(1).to_pylist(), object)
                found = pd.DataFrame({"lang": named[row], "gram": gram, "n": n}).groupby(["lang", "gram"])["n"].sum()
                for k, v in found.items():
                    kept[k] = kept.get(k, 0) + v
                if len(kept) > FLUSH:
                    yield flush()
        yield flush()

    counted = df.select(F.col(text).alias("text"), F.col(lang).alias("lang")).filter("lang is not null and text is not null")
    total = counted.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    out: dict[str, list[int]] = {}
    for r in total.withColumn("rank", rank).filter(F.col("rank") <= profile).orderBy("lang", "rank").collect():  # languages x profile rows
        out.setdefault(r.lang, []).append(r.gram)
    return out


class RankModel:
    """Profiles as one table: known n-grams, and their rank in each language (``profile`` where a language lacks one)."""

    def __init__(self, profiles: dict[str, list[int]], profile: int = PROFILE):
        self.names, self.profile = sorted(profiles), profile
        self.known = np.unique(np.array([g for p in profiles.values() for g in p], np.int64))
        self.rank = np.full((len(self.known) + 1, len(self.names)), profile, np.int32)
        for j, name in enumerate(self.names):
            self.rank[np.searchsorted(self.known, profiles[name]), j] = np.arange(len(profiles[name]))

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        row, gram, count, has_letter = grams(texts)
        if not self.names or not len(row):
            return [UNKNOWN] * len(texts), np.zeros(len(texts))
        order = np.lexsort((gram, -count, row))
        row, gram = row[order], gram[order]
        first = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        place = np.arange(len(row)) - np.repeat(first, np.diff(np.append(first, len(row))))
        top = place < self.profile
        row, gram, place = row[top], gram[top], place[top]
        at = np.minimum(np.searchsorted(self.known, gram), len(self.known) - 1)
        at = np.where(self.known[at] == gram, at, len(self.known))
        distance = np.stack([np.bincount(row, np.where(self.rank[at, j] < self.profile, np.abs(self.rank[at, j] - place), self.profile), len(texts)) for j in range(len(self.names))], 1)
        best = distance.argmin(1)
        used = np.bincount(row, minlength=len(texts))
        score = 1 - distance[np.arange(len(texts)), best] / np.maximum(used * self.profile, 1)
        score = np.where(has_letter, np.clip(score, 0, 1), 0.0)  # 0 too if the nearest profile has none of the n-grams
        return [self.names[b] if ok else UNKNOWN for b, ok in zip(best, has_letter, strict=True)], score


def language_sample(labelled: DataFrame, key: str, text: str, lang: str, bound: int) -> DataFrame:
    """About ``bound`` rows, chosen in each language by a hash of key and text: equal shares, and all rows of a language below its share.

    Every language that has rows is in the sample, at any size of the others.
    """
    held = [(r[0], r[1]) for r in labelled.groupBy(lang).count().collect()]  # a row per language, as the profiles are
    if sum(n for _, n in held) <= bound:
        return labelled
    left, share = bound, 0
    for i, n in enumerate(sorted(n for _, n in held)):  # what small languages leave goes to the larger ones
        share = left // (len(held) - i)
        left -= min(n, share)
    rates = labelled.sparkSession.createDataFrame([(name, max(share, LEAST_ROWS) / n) for name, n in held], "__lang string, __rate double")
    digest = F.concat_ws(":", F.lit("language"), F.coalesce(F.col(key).cast("string"), F.lit("")), F.xxhash64(text).cast("string"))
    u = F.conv(F.substring(F.md5(digest), 1, 13), 16, 10).cast("long") / float(1 << 52)
    return labelled.join(F.broadcast(rates), F.col(lang) == F.col("__lang")).filter(u < F.col("__rate")).drop("__lang", "__rate")


def fit(df: DataFrame, chosen: Column, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS, profile: int = PROFILE) -> RankModel:
    """A model learned from at most about ``train_rows`` of the rows that ``chosen`` selects and whose language is known (``language_sample``)."""
    labelled = df.filter(chosen & F.col(lang).isNotNull()).select(key, text, lang)
    return RankModel(learn_profiles(language_sample(labelled, key, text, lang, train_rows), text, lang, profile), profile)


def identify(df: DataFrame, model: RankModel, text: str = "text", carry: list[str] | None = None, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``lang_pred`` and ``score`` of every whole text beside the columns ``carry`` (all, if not given).

    Null, empty and letterless texts, and all texts if no language was learned, are ``und`` with score 0. Languages at equal distance:
    the first by name, so a text that shares no n-gram with any profile (such as one in a script that no learned language has) has that
    name with score 0. The score is 1 for a list equal to the profile.
    Rows are handled one by one, so repeated rows and any number of rows of one source or language do no harm; columns that
    are already called as the results are replaced. An empty table gives an empty table.
    """
    bounded_batches(df.sparkSession)
    rest = [c for c in (df.columns if carry is None else carry) if c not in names]
    schema = df.select(*rest).withColumns({names[0]: F.lit(""), names[1]: F.lit(0.0)}).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, scores, texts = [], [np.zeros(0)], batch.column(len(rest))
            for a, b in text_slices(texts, GRAM_CHUNK):
                own, score = model.predict(texts.slice(a, b - a).to_pylist())
                found += own
                scores.append(score)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(found, pa.string()), pa.array(np.concatenate(scores), pa.float64())], [*rest, *names])

    return df.select(*rest, F.col(text).alias("__text")).mapInArrow(run, schema)
