"""Toxicity scores: gradient-boosted trees over dense features, calibrated by isotonic regression.

The lexicon (words, and word beginnings for inflected languages) is learned from labelled rows by log-odds. The features of a
training row come from a lexicon of the other folds, entries chosen without it, so the trees see the same kind of evidence there as
on new rows. How often and how clearly an entry must be toxic is chosen by cross-validation among the training rows. Features: lexicon densities, nearness of a second-person word to a lexicon word, capitals, punctuation, and obfuscation.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, hash_words, sampled, stored, text_slices, words_of

TRAIN_ROWS = 20_000  # bound of the labelled rows that lexicon, trees and calibration are learned from
LEXICON = 20_000  # entries kept, by log-odds
MIN_TOXIC = (2, 3, 5, 8)  # choices: toxic rows that must hold an entry
MIN_ODDS = (1.0, 1.5, 2.0, 2.5, 3.0)  # choices: log-odds that an entry must have
CV_FOLDS = 4
ROWS_PER_TASK = 2500  # feature rows of the sample; each pass of the trees is short
PREFIXES = (4, 5, 6)
WINDOW = 5
SECOND_PERSON = ["you", "your", "yours", "yourself", "u", "ur", "du", "dich", "dir", "dein", "deine", "ihr", "euch", "tu", "toi", "te", "ton", "ta", "tes", "vous", "votre", "vos", "tú", "ti", "tus", "usted", "ustedes", "vosotros"]
FEATURES = ["hit_density", "hits", "weight_sum", "weight_max", "second_best", "distinct_hits", "near_second_person", "second_person_density", "capitals", "shouted_words", "exclamations", "punctuation", "obfuscated", "elongated", "log_words"]
NOT_LETTERS = [b for b in range(128) if not (65 <= b <= 90 or 97 <= b <= 122)]


def _hash(words: list[str]) -> np.ndarray:
    data, offsets = flat(pa.array(words, pa.string()))
    return hash_words(data, offsets[:-1], offsets[1:])


def _entries(texts: pa.Array):
    """Hashes of each word and of its beginnings, one row per kind of entry, with the word's document."""
    lower = pa.array([t.lower() if t else "" for t in texts.to_pylist()], pa.string())
    data, offsets = flat(lower)
    starts, ends, rows = words_of(data, offsets, NOT_LETTERS)
    kinds = [hash_words(data, starts, ends)]
    for i, size in enumerate(PREFIXES):
        cut = hash_words(data, starts, np.minimum(ends, starts + size)) ^ np.uint64(0xA5A5A5A5 + i)
        kinds.append(np.where(ends - starts > size, cut, np.uint64(0)))  # 0: the word is no longer than that
    return np.stack(kinds).view(np.int64), rows, data, offsets


@dataclass
class Lexicon:
    entry: np.ndarray  # sorted hashes
    weight: np.ndarray  # log-odds of each entry
    min_odds: float  # of a hit in a text

    def words(self, kinds: np.ndarray) -> np.ndarray:
        """The largest weight among each word's entries, 0 without one."""
        weight = np.zeros(kinds.shape[1])
        if len(self.entry):
            for hashed in kinds:
                at = np.minimum(np.searchsorted(self.entry, hashed), len(self.entry) - 1)
                weight = np.maximum(weight, np.where(self.entry[at] == hashed, self.weight[at], 0.0))
        return weight


def count_entries(train: DataFrame) -> DataFrame:
    """``entry, toxic_f, clean_f``: rows of each kind that hold an entry, by fold f. From ``text, label, fold`` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            label, fold = np.array(batch.column(1).to_pylist(), np.int64), np.array(batch.column(2).to_pylist(), np.int64)
            for a, b in text_slices(batch.column(0)):
                kinds, rows, _, _ = _entries(batch.column(0).slice(a, b - a))
                pair = np.unique(np.stack([np.tile(rows, len(kinds)), kinds.ravel()], 1), axis=0)
                pair = pair[pair[:, 1] != 0]
                entry, at = np.unique(pair[:, 1], return_inverse=True)
                held = np.bincount(at * 2 * CV_FOLDS + 2 * fold[a:b][pair[:, 0]] + label[a:b][pair[:, 0]], minlength=len(entry) * 2 * CV_FOLDS)
                held = held.reshape(-1, 2 * CV_FOLDS).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(entry), *[pa.array(held[:, c]) for c in range(2 * CV_FOLDS)]], ["entry", *columns])

    columns = [f"{kind}_{f}" for f in range(CV_FOLDS) for kind in ("clean", "toxic")]
    counted = train.select("text", "label", "fold").mapInArrow(count, ", ".join(["entry long", *[f"{c} long" for c in columns]]))
    return counted.groupBy("entry").agg(*[F.sum(c).alias(c) for c in columns])


def learn_lexicons(counted: DataFrame, rows: dict[tuple[int, int], int], wanted: list[tuple[int | None, int, float]]) -> list[Lexicon]:
    """A lexicon for each wanted (fold left out or None, ``MIN_TOXIC``, ``MIN_ODDS``). ``rows``: their number by fold and label."""
    parts = []
    for i, (without, min_toxic, min_odds) in enumerate(wanted):
        folds = [f for f in range(CV_FOLDS) if f != without]
        n_clean, n_toxic = (sum(rows.get((f, y), 0) for f in folds) for y in (0, 1))
        toxic, clean = (sum((F.col(f"{kind}_{f}") for f in folds), F.lit(0)) for kind in ("toxic", "clean"))
        odds = F.log((toxic + 0.5) / (n_toxic + 1)) - F.log((clean + 0.5) / (n_clean + 1))
        found = counted.select(F.lit(i).alias("i"), "entry", toxic.alias("toxic"), clean.alias("clean"), odds.alias("odds"))
        parts.append(found.filter((F.col("toxic") >= min_toxic) & (F.col("odds") >= min_odds)).orderBy(F.desc("odds"), F.desc("toxic"), "entry").limit(LEXICON))
    table = reduce(DataFrame.union, parts).select("i", "entry", "odds").toArrow()  # at most LEXICON rows for each wanted
    i, entry, odds = (table[c].to_numpy() for c in ("i", "entry", "odds"))
    out = []
    for j, (_, _, min_odds) in enumerate(wanted):
        at = np.flatnonzero(i == j)
        at = at[np.argsort(entry[at])]
        out.append(Lexicon(entry[at], odds[at], min_odds))
    return out


def average_precision(score: np.ndarray, toxic: np.ndarray) -> float:
    """Precision at each score that occurs, averaged over the toxic rows; equal scores count together."""
    if not len(score):
        return 0.0
    order = np.argsort(-score, kind="stable")
    found, last = np.cumsum(toxic[order]), np.flatnonzero(np.append(np.diff(score[order]) != 0, True))
    gained = np.diff(np.append(0, found[last]))
    return float((gained * found[last] / (last + 1)).sum() / max(found[-1], 1))


def choose_bounds(train: DataFrame, counted: DataFrame, rows: dict[tuple[int, int], int]) -> tuple[int, float]:
    """``MIN_TOXIC`` and ``MIN_ODDS`` by cross-validation: each fold is scored by lexicons learned from the others.

    A text's score is the sum of its weights over the root of its number of words, by which chance hits vary. The choice of
    the largest average precision wins, ties go to the stricter one.
    """
    spark = train.sparkSession
    wanted = [(f, t, MIN_ODDS[0]) for f in range(CV_FOLDS) for t in MIN_TOXIC]
    lexicons = spark.sparkContext.broadcast(dict(zip([w[:2] for w in wanted], learn_lexicons(counted, rows, wanted), strict=True)))
    choices = [(t, o) for t in MIN_TOXIC for o in MIN_ODDS]
    names = ["label", *[f"s{j}" for j in range(len(choices))]]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fold = np.array(batch.column(2).to_pylist(), np.int64)
            for a, b in text_slices(batch.column(0)):
                kinds, of, _, _ = _entries(batch.column(0).slice(a, b - a))
                root = np.sqrt(np.maximum(np.bincount(of, minlength=b - a), 1))
                sums = np.zeros((len(choices), b - a))
                for f in np.unique(fold[a:b]):
                    here = np.flatnonzero(fold[a:b][of] == f)
                    for i, t in enumerate(MIN_TOXIC):
                        weight = lexicons.value[f, t].words(kinds[:, here])
                        for j, o in enumerate(MIN_ODDS):
                            sums[i * len(MIN_ODDS) + j] += np.bincount(of[here], weight * (weight >= o), b - a)
                yield pa.RecordBatch.from_arrays([batch.column(1).slice(a, b - a), *[pa.array(s / root) for s in sums]], names)

    schema = ", ".join(["label long", *[f"{c} double" for c in names[1:]]])
    table = train.select("text", "label", "fold").mapInArrow(score, schema).toArrow()  # numbers of the bounded sample
    toxic = table["label"].to_numpy()
    worth = [(average_precision(table[f"s{j}"].to_numpy(), toxic), choice) for j, choice in enumerate(choices)]
    return max(worth)[1]


def features_of(texts: pa.Array, lexicon: Lexicon) -> np.ndarray:
    """One row of ``FEATURES`` per text; empty texts have zeros."""
    kinds, rows, data, offsets = _entries(texts)
    n = len(texts)
    weight = lexicon.words(kinds)
    words = np.bincount(rows, minlength=n)
    hit = np.flatnonzero(weight >= lexicon.min_odds)
    of = rows[hit]
    hits = np.bincount(of, minlength=n)
    order = np.lexsort((-weight[hit], of))
    ranked, first = of[order], np.zeros(n, np.int64)
    best, second = np.zeros(n), np.zeros(n)
    lead = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1])) if len(ranked) else np.zeros(0, np.int64)
    first[ranked[lead]] = lead
    top = weight[hit][order]
    best[ranked[lead]] = top[lead]
    again = np.flatnonzero(hits >= 2)
    second[again] = top[first[again] + 1]
    pairs = np.unique(np.stack([of, kinds[0][hit]], 1), axis=0) if len(hit) else np.zeros((0, 2), np.int64)
    distinct = np.bincount(pairs[:, 0], minlength=n)
    person = np.flatnonzero(np.isin(kinds[0], _hash(SECOND_PERSON).view(np.int64)))
    near = np.zeros(len(hit), bool)
    if len(person):
        for side in (0, -1):  # the next second-person word on either side, in the same text
            j = np.searchsorted(person, hit) + side
            ok = (j >= 0) & (j < len(person))
            p = person[np.clip(j, 0, len(person) - 1)]
            near |= ok & (np.abs(p - hit) <= WINDOW) & (rows[p] == of)
    body, bounds = flat(texts)
    table = np.zeros((4, 256), bool)
    table[0, 65:91] = True
    table[1, [33, 63]] = True
    table[2, [b for b in range(33, 127) if not chr(b).isalnum()]] = True
    row = np.repeat(np.arange(n), np.diff(bounds))
    size = np.maximum(np.diff(bounds), 1)
    rate = lambda flags: np.bincount(row[flags], minlength=n) / size
    letter = np.ones(256, bool)
    letter[NOT_LETTERS] = False
    a = letter[body]
    odd = np.zeros(len(body), bool)  # a symbol or digit between letters
    odd[1:-1] = a[:-2] & a[2:] & (table[2][body[1:-1]] | ((body[1:-1] >= 48) & (body[1:-1] < 58)))
    odd &= ~np.isin(body, np.frombuffer(b"'-./,|", np.uint8))
    long = np.zeros(len(body), bool)  # the third equal letter in a row
    long[2:] = (body[2:] == body[1:-1]) & (body[1:-1] == body[:-2]) & a[2:]
    upper = table[0][body]
    loud = np.zeros(len(body), bool)
    loud[1:] = upper[1:] & upper[:-1]
    some = np.maximum(words, 1)
    columns = [hits / some, hits, np.bincount(of, weight[hit], n), best, second, distinct, np.bincount(of, near, n), np.bincount(rows[person], minlength=n) / some,
               rate(upper), rate(loud), rate(table[1][body]), rate(table[2][body]), rate(odd), rate(long), np.log1p(words)]
    return np.stack([np.asarray(c, float) for c in columns], 1)


def with_features(df: DataFrame, lexicons: list[Lexicon], text: str, carry: list[str], fold: str | None = None) -> DataFrame:
    """``carry`` and the features; with ``fold``, an integer column, a row's features come from the lexicon of that number."""
    bounded_batches(df.sparkSession)
    schema = df.select(*carry).withColumns({f: F.lit(0.0) for f in FEATURES}).schema
    held = df.sparkSession.sparkContext.broadcast(lexicons)  # at most LEXICON entries each

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, of = batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1).to_numpy()
            values = np.zeros((len(texts), len(FEATURES)))
            for a, b in text_slices(texts):
                for f in np.unique(of[a:b]):
                    at = a + np.flatnonzero(of[a:b] == f)
                    values[at] = features_of(texts.take(pa.array(at)), held.value[f])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *[pa.array(values[:, j]) for j in range(len(FEATURES))]], [*carry, *FEATURES])

    return df.select(*carry, F.col(text).alias("__text"), (F.col(fold) if fold else F.lit(0)).alias("__fold")).mapInArrow(run, schema)


class ToxicityModel:
    """Lexicon, trees and calibration; without both kinds of labels, the constant share of toxic rows."""

    def __init__(self, lexicon: Lexicon | None, trees, calibration, share: float):
        self.lexicon, self.trees, self.calibration, self.share = lexicon, trees, calibration, share

    def score(self, df: DataFrame, text: str, carry: list[str]) -> DataFrame:
        if self.trees is None:
            return df.select(*carry, F.lit(self.share).alias("score"))
        found = with_features(df, [self.lexicon], text, carry)
        found = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(found)
        found = self.trees.transform(found).withColumn("raw_score", vector_to_array("probability")[1])
        if self.calibration is not None:
            found = self.calibration.transform(found.drop("prediction")).withColumn("raw_score", F.col("prediction"))
        return found.select(*carry, F.least(F.greatest(F.col("raw_score"), F.lit(0.0)), F.lit(1.0)).alias("score"))


def fit(df: DataFrame, labels: DataFrame, chosen: Column, calibrates: Column, key: str = "doc_id", text: str = "text", label: str = "toxic", train_rows: int = TRAIN_ROWS) -> ToxicityModel:
    """A model from at most about ``train_rows`` labelled rows that ``chosen`` selects; those where ``calibrates`` holds fit
    the calibration, the others the trees, and all of them the lexicon and its bounds. Labels of one key are merged to the largest; null labels are left out."""
    spark = df.sparkSession
    bounded_batches(spark)
    known = labels.filter(chosen & F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(key).agg(F.max(label).cast("long").alias("label"))
    known = sampled(stored(known, "toxicity-labels"), F.col(key), train_rows, "toxicity")
    train = df.select(key, F.coalesce(F.col(text), F.lit("")).alias("text")).join(F.broadcast(known), key)
    train = stored(train.withColumn("fold", F.pmod(F.xxhash64(F.col(key).cast("string"), F.lit("fold")), F.lit(CV_FOLDS)).cast("int")), "toxicity-train")  # a bounded sample of rows
    held = {(r.fold, int(r.label)): r["count"] for r in train.groupBy("fold", "label").count().collect()}
    n_clean, n_toxic = (sum(n for (_, y), n in held.items() if y == label) for label in (0, 1))
    share = n_toxic / max(n_toxic + n_clean, 1)
    if not n_toxic or not n_clean:
        return ToxicityModel(None, None, None, share)
    counted = stored(count_entries(train), "toxicity-entries")
    bounds = choose_bounds(train, counted, held)
    *others, lexicon = learn_lexicons(counted, held, [(f, *bounds) for f in [*range(CV_FOLDS), None]])
    rows = with_features(train.withColumn("calibrates", calibrates), others, "text", ["calibrates", "label"], "fold")
    rows = stored(VectorAssembler(inputCols=FEATURES, outputCol="features").transform(rows).select("calibrates", "features", F.col("label").cast("double").alias("label")).coalesce(-(-(n_clean + n_toxic) // ROWS_PER_TASK)), "toxicity-features")
    kinds = {(r.calibrates, r.label): r["count"] for r in rows.groupBy("calibrates", "label").count().collect()}
    apart = all(kinds.get((c, y), 0) >= 5 for c in (True, False) for y in (0.0, 1.0))
    trees = GBTClassifier(featuresCol="features", labelCol="label", maxIter=20, maxDepth=4, stepSize=0.2, subsamplingRate=0.9, seed=11, cacheNodeIds=False).fit(rows.filter(~F.col("calibrates")) if apart else rows)
    calibration = None
    if apart:
        held = trees.transform(rows.filter("calibrates")).withColumn("raw_score", vector_to_array("probability")[1]).select("label", "raw_score")
        calibration = IsotonicRegression(featuresCol="raw_score", labelCol="label").fit(held)
    return ToxicityModel(lexicon, trees, calibration, share)


def score_toxicity(df: DataFrame, model: ToxicityModel, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``score`` (0 to 1, higher is likelier toxic) of every whole text beside ``carry`` (all columns, if not given).

    Null and empty texts have all features zero and the score that goes with them. Rows are handled one by one: repeated rows
    get equal scores, clashing columns called ``score`` are replaced, and an empty table gives an empty table.
    """
    rest = [c for c in (df.columns if carry is None else carry) if c != "score"]
    return model.score(df.withColumn("__score_text", F.col(text)), "__score_text", rest)
