"""Secrets in whole texts: fixed patterns, and a battery of randomness tests with length-aware control of false discoveries.

Candidates are runs of 20 and more characters of the encodings' alphabets. For each, the smallest encoding that holds it is
inferred, and three tests ask whether its symbols could be drawn at random from that alphabet: chi-squared uniformity, runs
about the middle of the alphabet, and lag-1 serial correlation. One that fails any of them is ordinary.

Passing is no evidence by itself: a short word also looks random. So each survivor is tested against ordinary writing too. Under
that null its symbols follow the frequencies of the whole corpus; the chi-squared statistic, which counts equal symbol pairs, then
has a known mean and variance for each length, and the p-value is the chance of so few equal pairs. A candidate that fails the
battery gets the p-value 1, which keeps every p-value valid under the null. So one rule decides over one p-value each, and its rate
is that of the result: discoveries are chosen by Benjamini-Hochberg within each encoding and length class, so that the many short
words do not decide over long keys.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, flat, stored, text_slices

# fixed values: patterns of the base spans
ASSIGN = re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
KINDS = ["assign", "access", "hex", "random"]
MIN_ASSIGN, MIN_ACCESS, MIN_HEX, MIN_RANDOM = 6, 20, 24, 20

CANDIDATE = re.compile(r"[A-Za-z0-9+/_-]{%d,}" % MIN_RANDOM)
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [  # from the smallest alphabet on
    ("digits", DIGITS), ("hex", DIGITS + "abcdef"), ("HEX", DIGITS + "ABCDEF"), ("lower", LOWER), ("upper", UPPER), ("base32", UPPER + "234567"),
    ("base36", DIGITS + LOWER), ("BASE36", DIGITS + UPPER), ("letters", UPPER + LOWER), ("base62", DIGITS + UPPER + LOWER), ("base64", UPPER + LOWER + DIGITS + "+/"), ("base64url", UPPER + LOWER + DIGITS + "-_"),
    ("mixed", UPPER + LOWER + DIGITS + "+/-_"),
]
LENGTHS = [24, 32, 40, 48, 64, 96, 128]  # upper bounds of the length classes, the last one open
FALSE_DISCOVERIES = 0.01
RANDOM_LEVEL = 0.001
STEP, LEVELS = 0.05, 2000  # resolution of -log10 p and number of levels of the stored counts


def tail(z: float) -> float:
    """Upper tail of the normal distribution."""
    return 0.5 * math.erfc(z / math.sqrt(2))


def infer(token: str) -> int:
    symbols = set(token)
    return next(i for i, (_, alphabet) in enumerate(ENCODINGS) if symbols <= set(alphabet))


def randomness(value: np.ndarray, k: int) -> float:
    """Smallest of the three tests' p-values, times three. ``value``: symbols as numbers below ``k``."""
    n = len(value)
    count = np.bincount(value, minlength=k)
    chi = k / n * float((count.astype(float) ** 2).sum()) - n
    p = [tail((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    high = value >= k / 2
    a, b = int(high.sum()), n - int(high.sum())
    if a and b:
        runs = 1 + int((high[1:] != high[:-1]).sum())
        mean = 2 * a * b / n + 1
        var = (mean - 1) * (mean - 2) / (n - 1)
        p.append(2 * tail(abs(runs - mean) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        p.append(2.0 ** (1 - n))
    centred = value - value.mean()
    spread = float((centred**2).sum())
    r = float((centred[1:] * centred[:-1]).sum()) / spread if spread else 1.0
    p.append(2 * tail(abs(r + 1 / n) * math.sqrt(n)) if spread else 0.0)
    return min(1.0, 3 * min(p))


def ordinary(value: np.ndarray, frequency: np.ndarray) -> float:
    """-log10 of the chance that ordinary writing has as few equal symbol pairs."""
    n = len(value)
    count = np.bincount(value, minlength=len(frequency)).astype(float)
    pairs = float((count * (count - 1)).sum()) / 2
    s2, s3 = float((frequency**2).sum()), float((frequency**3).sum())
    two, three = n * (n - 1) / 2, n * (n - 1) * (n - 2) / 6
    mean, var = two * s2, two * (s2 - s2 * s2) + 6 * three * max(s3 - s2 * s2, 0.0)
    z = (mean - pairs - 0.5) / math.sqrt(var) if var > 0 else 0.0
    p = tail(z)
    return -math.log10(p) if p > 0 else z * z / 2 / math.log(10)


def character_counts(df: DataFrame, text: str) -> list[int]:
    """How often each ASCII character stands in all texts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(128, np.int64)
        for batch in batches:
            data, _ = flat(batch.column(0))
            for i in range(0, len(data), 1 << 22):
                total += np.bincount(data[i : i + (1 << 22)], minlength=256)[:128]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(128), pa.int32()), pa.array(total, pa.int64())], ["c", "n"])

    counts = df.select(text).mapInArrow(count, "c int, n long").groupBy("c").agg(F.sum("n").alias("n"))
    out = [0] * 128
    for r in counts.collect():  # 128 rows
        out[r.c] = r.n
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the fixed patterns, leftmost and non-overlapping per kind, too short ones dropped."""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    found += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= MIN_ACCESS]
    found += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= MIN_HEX]
    return sorted(found)


def length_class(n: int) -> int:
    return sum(n >= limit for limit in LENGTHS)


def scan(df: DataFrame, counts: list[int], key: str, text: str) -> DataFrame:
    """Per row: key, base spans, and the candidates that pass the randomness battery with their class and level."""
    places, frequencies = [], []
    for _, alphabet in ENCODINGS:
        place = np.zeros(128, np.int64)
        place[[ord(c) for c in alphabet]] = np.arange(len(alphabet))
        places.append(place)
        weight = np.array([counts[ord(c)] + 1.0 for c in alphabet])
        frequencies.append(weight / weight.sum())
    span = "array<struct<start:int,kind:int,end:int>>"
    found = "array<struct<start:int,kind:int,end:int,class:int,level:int>>"
    schema = f"key {df.schema[key].dataType.simpleString()}, base {span}, found {found}, tested array<struct<class:int,level:int>>"
    span_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end")]))
    found_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("start", "kind", "end", "class", "level")]))
    tested_type = pa.list_(pa.struct([(n, pa.int32()) for n in ("class", "level")]))

    def candidates(body: str) -> tuple[list[dict], list[dict]]:
        good, tested = [], []
        for m in CANDIDATE.finditer(body):
            token = m[0]
            encoding = infer(token)
            value = places[encoding][np.frombuffer(token.encode(), np.uint8)]
            # a hexadecimal token of digits and six letters may be ordinary only by its length: all are tested alike
            level = min(LEVELS - 1, int(ordinary(value, frequencies[encoding]) / STEP))
            if level * STEP > 1 and randomness(value, len(ENCODINGS[encoding][1])) < RANDOM_LEVEL:
                level = 0
            of = encoding * (len(LENGTHS) + 1) + length_class(len(token))
            tested.append({"class": of, "level": level})
            if level * STEP > 1:
                good.append({"start": m.start(), "kind": 3, "end": m.end(), "class": of, "level": level})
        return good, tested

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, good, tested, texts = [], [], [], batch.column(1).fill_null("")
            fixed = pc.match_substring_regex(texts, r"(?i)(password|passwd|secret|token|api_?key)[\"']? *[:=]")
            fixed = pc.or_(fixed, pc.match_substring_regex(texts, "AKIA[A-Z0-9]{16}|[0-9a-f]{%d}" % MIN_HEX)).to_pylist()
            long = pc.match_substring_regex(texts, "[A-Za-z0-9+/_-]{%d}" % MIN_RANDOM).to_pylist()
            for i in range(len(texts)):
                body = texts[i].as_py() if fixed[i] or long[i] else ""
                base.append([{"start": s, "kind": k, "end": e} for s, k, e in base_spans(body)] if fixed[i] else [])
                own, all_tested = candidates(body) if long[i] else ([], [])
                good.append([g for g in own if not any(b["start"] < g["end"] and g["start"] < b["end"] for b in base[-1])])
                tested.append(all_tested)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(base, span_type), pa.array(good, found_type), pa.array(tested, tested_type)], ["key", "base", "found", "tested"])

    return df.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, schema)


def thresholds(scanned: DataFrame, rate: float = FALSE_DISCOVERIES) -> dict[int, int]:
    """Smallest accepted level of each class by the Benjamini-Hochberg rule, from counts per class and level."""
    tested = scanned.select(F.explode("tested").alias("t")).groupBy("t.class", "t.level").agg(F.count(F.lit(1)).alias("n"))
    counts: dict[int, dict[int, int]] = {}
    for r in tested.collect():  # at most classes x LEVELS rows
        counts.setdefault(r["class"], {})[r["level"]] = r["n"]
    out = {}
    for of, levels in counts.items():
        total, above = sum(levels.values()), 0
        for level in sorted(levels, reverse=True):
            above += levels[level]
            if total * 10 ** (-level * STEP) <= rate * above:
                out[of] = level  # the largest p-value that still satisfies the rule
    return out


def joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(F.array_sort(spans), lambda s: F.concat_ws(":", names[s["kind"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", rate: float = FALSE_DISCOVERIES) -> DataFrame:
    """Per row: key, ``base`` and ``random`` spans (start, kind, end in code points, end exclusive), sorted.

    A random span never overlaps a base span. Null and empty texts have no spans. Rows are scanned one by one; repeated rows
    each give their spans and count each in the corpus statistics. Other columns are not read. An empty table gives no rows.
    """
    bounded_batches(df.sparkSession)
    scanned = stored(scan(df, character_counts(df, text), key, text), "secrets")
    limit = thresholds(scanned, rate)
    accepted = F.create_map(*[F.lit(x) for pair in limit.items() for x in pair]) if limit else F.lit(None).cast("map<int,int>")
    random = F.filter("found", lambda c: F.coalesce(c["level"] >= accepted[c["class"]], F.lit(False)))
    plain = F.transform(random, lambda c: F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end")))
    return scanned.select(F.col("key").alias(key), "base", F.array_sort(plain).alias("random"))
