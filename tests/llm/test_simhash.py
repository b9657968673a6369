"""Fingerprints and links within two bits against brute force."""

import random
import re

import xxhash

from marquee.llm import simhash
from marquee.llm.queries import QUERIES

M64 = (1 << 64) - 1


def plain_print(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    runs = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else [" ".join(words)] * bool(words)
    h = [xxhash.xxh64_intdigest(r.encode(), 42) for r in runs]
    return sum(1 << j for j in range(64) if 2 * sum(x >> j & 1 for x in h) > len(h))


def roots(prints):
    """For each of the distinct numbers, the smallest of its component: all pairs."""
    prints, root = sorted(prints), {p: p for p in prints}

    def find(p):
        while root[p] != p:
            root[p] = p = root[root[p]]
        return p

    for i, a in enumerate(prints):
        for b in prints[:i]:
            if (a ^ b).bit_count() <= 2:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {p: find(p) for p in prints}


def expected(rows):
    prints = [plain_print(t) for _, t in rows]
    root, least = roots(set(prints)), {}
    for (k, _), p in zip(rows, prints, strict=True):
        least.setdefault(root[p], []).append(k)
    name = {r: min((k for k in ks if k is not None), default=None) for r, ks in least.items()}
    return sorted(((k, f"{p:016x}", name[root[p]]) for (k, _), p in zip(rows, prints, strict=True)), key=str)


def found(df):
    return sorted(((r[0], r.fingerprint, r.component_id) for r in df.collect()), key=str)


def test_masks_cover_every_two_positions():
    masks = simhash.covering_masks()
    assert len(masks) == 7 and all(m.bit_count() <= 40 for m in masks)
    assert all(any(not m >> i & 1 and not m >> j & 1 for m in masks) for i in range(64) for j in range(64))


def test_query_equals_brute_force(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert found(QUERIES["op13_covering_simhash"](spark, sf_dir)) == expected(rows)


def test_near_texts_equal_brute_force(spark):
    random.seed(4)
    rows = []
    for size in (1, 2, 3, 4, 30, 200, 800):
        base = [f"Word{random.randrange(5000)}" for _ in range(size)]
        for _ in range(25):
            words = list(base)
            for _ in range(random.randrange(3)):
                words[random.randrange(size)] = "other"
            rows.append((len(rows) * 7 % 1000, random.choice([" ", "\t\n", "  "]).join(words)))
    want = expected(rows)
    assert len({r[1] for r in want}) > len({r[2] for r in want}) > 7  # some differ and are linked, some are not
    for pair_rows in (1, 24):
        assert found(simhash.simhash_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(5), pair_rows=pair_rows)) == want


def test_large_buckets_link_like_all_pairs(spark):
    random.seed(6)
    prints = set()
    for _ in range(6):
        seed = random.getrandbits(64)
        for _ in range(120):
            p = seed
            for bit in random.sample(range(0, 64, 3), random.randrange(5)):
                p ^= 1 << bit
            prints.add(p)
    df = spark.createDataFrame([(simhash.signed(p),) for p in prints], "fp long").repartition(3)
    for pair_rows in (1, 8, 1000):
        links = [(r.a & M64, r.b & M64) for r in simhash.near_prints(df, pair_rows).collect()]
        assert all((a ^ b).bit_count() <= 2 for a, b in links)
        root = {p: p for p in prints}

        def find(p, root=root):
            while root[p] != p:
                p = root[p]
            return p

        for a, b in links:
            x, y = sorted((find(a), find(b)))
            root[y] = x
        assert {p: find(p) for p in prints} == roots(prints)


def test_awkward_rows(spark, awkward, nothing):
    rows = [(r.doc_id, r.text) for r in awkward.collect()]
    assert found(simhash.simhash_components(awkward)) == expected(rows)
    assert simhash.simhash_components(nothing).collect() == []


def test_long_text_is_voted_in_blocks(spark, monkeypatch):
    text = " ".join(f"w{i * i % 997}" for i in range(5000))
    import pyarrow as pa

    whole = simhash.simhash(pa.array([text, "", "a b", text + " x"]))
    monkeypatch.setattr(simhash, "VOTES", 700)
    assert simhash.simhash(pa.array([text, "", "a b", text + " x"])).tolist() == whole.tolist() == [plain_print(t) for t in (text, "", "a b", text + " x")]


def test_no_all_pairs_in_the_plan(spark, sf_dir):
    plan = QUERIES["op13_covering_simhash"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
