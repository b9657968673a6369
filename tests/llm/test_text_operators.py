"""Dedup, mixing, shards, tokens, packing, languages, secrets and toxicity on awkward rows and against plain Python."""

import hashlib
import itertools
import math
import random
import re
import string
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import exact_dedup, language, mixing, packing, secrets, shards, tokens, toxicity
from marquee.llm.queries import vocabulary


def plain(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def test_exact_groups(awkward, nothing):
    found = exact_dedup.exact_groups(awkward, salts=3).collect()
    rows = [(r.doc_id, plain(r.text)) for r in awkward.collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    assert len(found) == len(rows)
    for r in found:
        own = next(t for i, t in rows if i == r.doc_id and hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        ids = [i for i in groups[own] if i is not None]
        assert (r.keep_id, r.group_size) == (min(ids) if ids else None, len(groups[own]))
        assert not r.kept or r.doc_id == r.keep_id
    assert sum(r.kept for r in found) == len(groups)  # repeated rows leave one
    kept = exact_dedup.deduplicate(awkward).collect()
    assert len(kept) == len(groups) and kept[0].__fields__ == awkward.columns
    assert exact_dedup.exact_groups(nothing).count() == 0 and exact_dedup.deduplicate(nothing).count() == 0


def test_poisson_mix(spark, awkward, nothing):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 10 < 7, "hot").when(F.col("id") % 10 < 9, "mid").alias("source"))
    mixed = mixing.poisson_mix(docs, weights={"hot": 0.5, "mid": 0.25, None: 0.25})
    rows = {r.source: r["count"] for r in mixed.groupBy("source").count().collect()}
    assert rows["hot"] == pytest.approx(10_000, rel=0.05) and rows["mid"] == pytest.approx(5_000, rel=0.06) and rows[None] == pytest.approx(5_000, rel=0.06)
    times = Counter(r.doc_id for r in mixed.filter("source = 'mid'").collect())
    assert np.mean([times[i] ** 2 for i in range(20_000) if 7 <= i % 10 < 9]) == pytest.approx(1.25 + 1.25**2, rel=0.1)  # variance of a Poisson number
    assert mixed.select("doc_id", "copy").distinct().count() == mixed.count()
    assert "Python" not in mixed._jdf.queryExecution().executedPlan().toString()
    large = mixing.poisson_mix(docs.filter("source is null"), weights={None: 1.0}, epochs=50.0)  # a sum of several Poisson numbers
    assert large.count() == pytest.approx(100_000, rel=0.02)
    assert mixing.poisson_mix(awkward, epochs=40.0).columns == [c for c in awkward.columns if c != "copy"] + ["copy"]
    assert mixing.poisson_mix(awkward, epochs=60.0).select("doc_id", "text").distinct().count() == awkward.select("doc_id", "text").distinct().count()
    assert mixing.poisson_mix(nothing).count() == 0


def test_shards(spark, awkward, nothing, sf_dir):
    placed = shards.shard_rows(awkward).collect()
    assert len(placed) == awkward.count() and Counter(r.size for r in placed) == Counter(len((r.text or "").encode()) + 1 for r in awkward.collect())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = shards.shard_rows(docs).collect()
    load, slots = Counter(), defaultdict(list)
    texts = {r.doc_id: (r.text or "").encode() for r in docs.collect()}
    for r in found:
        load[r.shard] += r.size
        slots[r.shard].append(r.slot)
        assert (r.size, r.text_crc32) == (len(texts[r.doc_id]) + 1, zlib.crc32(texts[r.doc_id]))
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and set(slots) == set(range(8))
    assert max(load.values()) - min(load.values()) <= max(r.size for r in found)
    assert shards.shard_rows(nothing).count() == 0


def test_rebalancing_moves_little():
    weight = np.random.default_rng(1).integers(1, 100, 4096)
    first = shards.rebalanced(np.arange(4096) % 8, weight, 8)
    assert shards.rebalanced(first, weight, 8).tolist() == first.tolist() or (shards.rebalanced(first, weight, 8) != first).mean() < 0.01
    grown = shards.rebalanced(first, weight, 9)
    assert 1 / 9 * 0.95 < weight[grown != first].sum() / weight.sum() < 1 / 9 * 1.05
    loads = np.bincount(grown, weight)
    assert loads.max() - loads.min() <= 100


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary()[0])


def test_tokens_equal_the_library(library):
    random.seed(4)
    bits = [" ", "  ", "\n", "\t", "a", "word", "été", "ß", "'s", "'ll", "12", "...", "<|endoftext|>", "<|end", " ", "　", "你", "日本", "ñ", "-", "😀", "́", "Ж", "\x1c", "\x85"]
    coder = tokens.Codec(*vocabulary())
    for size in (0, 1, 5, 50, 500):
        texts = ["".join(random.choices(bits, k=size)) for _ in range(20)]
        expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
        for huge in (40, tokens.HUGE_BYTES):
            ids, count = tokens.encode_rows(pa.array([None, *texts]), coder, huge)
            assert count.tolist() == [0] + [len(e) for e in expected] and ids.tolist() == [i for e in expected for i in e]
        for text, ids in zip(texts, expected, strict=True):
            data = np.frombuffer(text.encode(), np.uint8)
            assert not len(data) or tokens.resynchronised(data, coder.encode, coder.width, 32, 4).tolist() == ids


def test_count_tokens(awkward, nothing, library):
    rows = tokens.count_tokens(awkward, *vocabulary()).collect()
    assert rows[0].__fields__ == [c for c in awkward.columns if c != "n_tokens"] + ["n_tokens"]
    assert all(r.n_tokens == len(library.encode(r.text or "", add_special_tokens=False).ids) for r in rows)
    assert tokens.count_tokens(nothing, *vocabulary()).count() == 0


def test_packing_round_trip(spark, awkward, nothing, library, sf_dir):
    for docs in (awkward.drop("k"), spark.read.parquet(f"{sf_dir}/documents.parquet")):
        pieces = packing.pack(docs, *vocabulary(), shard_tokens=60_000).collect()
        expected = Counter((r.doc_id, tuple([*library.encode(r.text or "", add_special_tokens=False).ids, 1])) for r in docs.collect())
        sequences, whole = defaultdict(list), defaultdict(list)
        for p in pieces:
            sequences[p.sequence_id].append(p)
            whole[(p.doc_id, p.doc_tokens, p.start)].append(np.frombuffer(p.ids, "<u4"))
            assert len(p.ids) == 4 * p.length
        for own in sequences.values():
            own.sort(key=lambda p: p.offset)
            assert [p.offset for p in own] == np.cumsum([0] + [p.length for p in own])[:-1].tolist()
            total = sum(p.length for p in own)
            assert total <= 2048 and total & (total - 1) == 0
        assert sum(len(ids) * n for (_, ids), n in expected.items()) == sum(p.length for p in pieces)
        unique = {k for k, n in Counter(i for i, _ in expected.elements()).items() if n == 1}
        for (key, ids), _ in expected.items():
            if key in unique:
                own = sorted((p for p in pieces if p.doc_id == key), key=lambda p: p.start)
                assert np.concatenate([np.frombuffer(p.ids, "<u4") for p in own]).tolist() == list(ids)
    assert packing.pack(nothing, *vocabulary()).count() == 0


def test_packing_finds_lexical_neighbours():
    topics = [[np.array([t * 50 + i for i in range(40)], np.uint32)] * 4 for t in range(5)]
    documents = [topics[t][j] for j in range(4) for t in range(5)]
    for sequence in packing.pack_shard(documents, np.ones(400, np.float32), 160)[:5]:
        assert len({documents[d][0] for d, _, _ in sequence}) == 1


def test_packing_reaches_neighbours_of_other_partitions(spark):
    words = lambda t: " ".join(f"{string.ascii_lowercase[t]}{string.ascii_lowercase[i]}{string.ascii_lowercase[t]}q" for i in range(26))
    rows = [(t * 100 + j, words(t)) for j in range(8) for t in range(12)]
    docs = spark.createDataFrame(spark.sparkContext.parallelize(rows, 8), "doc_id long, text string")  # a partition holds each text once
    for shard_tokens in (1_000_000, 3000):  # one shard, and several
        topics = defaultdict(set)
        for p in packing.pack(docs, *vocabulary(), window=512, shard_tokens=shard_tokens).collect():
            topics[p.sequence_id].add(p.doc_id // 100)
        assert len(topics) > 8 and np.mean([len(t) for t in topics.values()]) <= 2, topics


def test_packing_asks_with_all_ids_and_tries_all_neighbours():
    own, shared, idf = np.arange(40), np.arange(100, 150), np.ones(400, np.float32)
    idf[:40] = 9  # the heaviest ids of the seed are in no other document
    documents = [np.concatenate([own, shared]), np.arange(200, 250), shared]
    first = packing.pack_shard([d.astype(np.uint32) for d in documents], idf, 140)[0]
    assert [d for d, _, _ in first] == [0, 2]
    seed, long, fits = np.arange(20), np.concatenate([np.arange(20), np.arange(300, 330)]), np.arange(10)
    documents = [seed, *[long] * 12, fits]  # twelve better neighbours are too long for the room
    first = packing.pack_shard([d.astype(np.uint32) for d in documents], np.ones(400, np.float32), 32)[0]
    assert first[:2] == [(0, 0, 20), (13, 0, 10)]


def test_packing_scores_are_plain_bm25():
    random = np.random.default_rng(4)
    documents = [(3000 * random.random(random.integers(1, 200)) ** 4).astype(np.uint32) for _ in range(60)]
    idf = random.random(3000).astype(np.float32) + 0.1
    index, mean = packing.Bm25Index(documents, idf), np.mean([len(d) for d in documents])
    assert 0 < len(index.dense) < len(np.unique(np.concatenate(documents)))  # both forms of postings
    for seed in range(10):
        for d, score in enumerate(index.scores(seed)):
            tf = {t: (documents[d] == t).sum() for t in set(documents[seed].tolist())}
            assert score == pytest.approx(sum(idf[t] * n * 2.2 / (n + 1.2 * (0.25 + 0.75 * len(documents[d]) / mean)) for t, n in tf.items()), rel=1e-4)


def test_languages(spark, awkward, nothing, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    found = language.identify(docs, model, carry=["doc_id", "lang"]).filter("doc_id % 5 = 0").collect()
    assert np.mean([r.lang == r.lang_pred for r in found]) >= 0.95
    rows = {(r.doc_id, r.text): r for r in language.identify(awkward, model).collect()}
    assert all(r.lang_pred == "und" and r.score == 0 for (_, t), r in rows.items() if not any(c.isalpha() for c in t or ""))
    assert all(0 <= r.score <= 1 for r in rows.values())
    assert language.identify(nothing, model).count() == 0
    none = language.fit(nothing, F.lit(True))
    assert {r.lang_pred for r in language.identify(awkward, none).collect()} == {"und"}


def test_rare_languages_are_learned_beside_a_hot_one(spark):
    rare = F.col("id") % 1500 == 0
    docs = spark.range(30_000).select(
        F.when(F.col("id") % 3 == 1, 5).otherwise(F.col("id")).alias("doc_id"),  # a third of all rows share an id
        F.when(rare, F.concat(F.lit("кот и пёс "), F.col("id"))).otherwise(F.concat(F.lit("the cat and the dog "), F.col("id"))).alias("text"),
        F.when(rare, "ru").otherwise("en").alias("lang"),
    )
    counts = dict(language.language_sample(docs, "doc_id", "text", "lang", 300).groupBy("lang").count().collect())
    assert counts["ru"] == 20 and 200 < counts["en"] < 380
    assert language.fit(docs, F.lit(True), train_rows=300).names == ["en", "ru"]


def test_texts_like_no_language_are_rejected(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    other = docs.limit(2).withColumns({"doc_id": F.col("doc_id") + 10**9, "text": F.lit("漢字仮名交じり文 ひらがな"), "lang": F.lit(None).cast("string")})
    kept = {r.doc_id for r in corpus_pipeline.identify_language(spark, docs.union(other), sf_dir).collect()}
    clean = {r.doc_id for r in docs.collect() if any(c.isalpha() for c in r.text or "")}  # of every language
    assert kept == clean and len({r.lang for r in docs.filter("lang is not null").collect()}) > 1


def plain_rank_order(docs, texts, profile=400):
    """Languages by out-of-place distance, with counters and lists."""
    def ordered(counts):
        return sorted(counts, key=lambda g: (-counts[g], g))[:profile]

    total = {}
    for text, lang in docs:
        _, gram, count, _ = language.grams([text])
        own = total.setdefault(lang, Counter())
        for g, n in zip(gram.tolist(), count.tolist(), strict=True):
            own[g] += n
    place = {name: {g: i for i, g in enumerate(ordered(c))} for name, c in total.items()}
    out = []
    for text in texts:
        _, gram, count, letters = language.grams([text])
        mine = ordered(dict(zip(gram.tolist(), count.tolist(), strict=True)))
        far = {name: sum(abs(p[g] - i) if g in p else profile for i, g in enumerate(mine)) for name, p in place.items()}
        out.append(min(sorted(far), key=far.get) if letters[0] else "und")
    return out


def test_languages_equal_a_plain_model(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang").collect()]
    extra = [(-1, "漢字漢字", None), (-2, "Ж", None), (-3, "q", None), (-4, "12 !", None), (-5, None, None), (-6, "", None)]
    docs = spark.createDataFrame(rows + extra, "doc_id long, text string, lang string")
    model = language.fit(docs, F.col("doc_id") % 5 != 0)
    found = {r.doc_id: r for r in language.identify(docs, model, carry=["doc_id"]).collect()}
    want = plain_rank_order([(t, g) for i, t, g in rows if i % 5 and g is not None and t is not None], [t for _, t, _ in rows + extra], model.profile)
    assert [found[i].lang_pred for i, _, _ in rows + extra] == want
    assert found[-1].lang_pred == model.names[0] and found[-1].score == 0 and {found[i].lang_pred for i in (-4, -5, -6)} == {"und"}
    assert all(found[i].lang_pred != "und" for i in (-1, -2, -3))


def test_slot_map_is_edited(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    path = str(tmp_path / "map")
    where = lambda df: {(r.doc_id, r.text_crc32): (r.virtual_slot, r.shard, r.map_version) for r in df.collect()}
    first = where(shards.shard_rows(docs, path=path))
    assert {v for _, _, v in first.values()} == {1}
    same = where(shards.shard_rows(docs, path=path))
    assert {x[2] for x in same.values()} == {2} and sum(same[k][1] != x[1] for k, x in first.items()) <= 8  # at most one heavy slot a shard
    (tmp_path / "map" / "version=3").mkdir()  # what a failed run leaves
    more = docs.union(docs.filter("doc_id < 20").select(F.col("doc_id") + 1_000_000, F.concat("text", F.lit(" again"))))
    found = shards.shard_rows(more, shards=9, path=path)
    grown, store = where(found), shards.SlotMap(spark, path)
    assert store.latest() == 3 and {x[2] for x in grown.values()} == {3}
    before, after = store.owners(2, shards.SLOTS), store.owners(3, shards.SLOTS)
    load = {r.virtual_slot: r.bytes for r in store.read(3).collect()}
    moved = sum(load[s] for s in range(shards.SLOTS) if before[s] != after[s])
    assert 0 < moved <= 0.25 * sum(load.values())
    assert all(grown[k][1] == x[1] for k, x in same.items() if before[x[0]] == after[x[0]])
    sizes = Counter()
    for r in found.collect():
        sizes[r.shard] += r.size
    assert set(sizes) == set(range(9)) and max(sizes.values()) - min(sizes.values()) <= max(r.size for r in found.collect())
    with pytest.raises(ValueError, match="virtual slots"):
        shards.shard_rows(docs, path=path, slots=64)


def test_profile_distance_by_hand():
    model = language.RankModel({"a": language.grams(["abc"])[1].tolist(), "b": language.grams(["xyz"])[1].tolist()}, 20)
    assert model.predict(["abc", "zyx", None, "12"])[0] == ["a", "b", "und", "und"]
    row, gram, count, _ = language.grams(["ab ab", "b"])
    blank, a, b = 1, ord("a"), ord("b")
    expected = {a: 2, b: 2, blank << 21 | a: 2, a << 21 | b: 2, b << 21 | blank: 2, blank << 42 | a << 21 | b: 2, a << 42 | b << 21 | blank: 2}
    assert {int(g): int(n) for r, g, n in zip(row, gram, count, strict=True) if r == 0} == expected


def test_secrets(spark, awkward, nothing):
    random.seed(3)
    key = "".join(random.choices(string.ascii_letters + string.digits, k=48))
    coded = "".join(random.choices("0123456789abcdef", k=40))
    words = "the committee discussed internationalization misunderstandings counterrevolutionaries " * 40
    texts = [(1, f"{words} value {key} end"), (2, f'é api_key: "{coded}" and AKIA{"Z" * 16}'), (3, "Token=abcde secret = abcdef PASSWD:'x1/+_.=-'"), (4, words + "abcdefghijklmnopqrstuvwxyzabcdef")]
    found = {r.doc_id: r for r in secrets.find_secrets(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    span = [(s.start, s.end) for s in found[1].random]
    assert [texts[0][1][a:b] for a, b in span] == [key] and not found[4].random and not found[3].random
    assert [(texts[1][1][s.start : s.end], s.kind) for s in found[2].base] == [(f'api_key: "{coded}', 0), (coded, 2), ("AKIA" + "Z" * 16, 1)]
    assert [texts[2][1][s.start : s.end] for s in found[3].base] == ["secret = abcdef", "PASSWD:'x1/+_.=-"]
    rows = secrets.find_secrets(awkward).collect()
    assert len(rows) == awkward.count() and not any(r.base or r.random for r in rows)
    assert secrets.find_secrets(nothing).count() == 0


def plain_p_value(token, alphabet, frequency):
    """The two p-values of a candidate by plain loops: of the battery, and as -log10 that against ordinary writing."""
    n, k, symbols = len(token), len(alphabet), [alphabet.index(c) for c in token]
    upper = lambda z: 0.5 * math.erfc(z / math.sqrt(2))
    chi = sum((symbols.count(v) - n / k) ** 2 / (n / k) for v in range(k))
    battery = [upper((chi - (k - 1)) / math.sqrt(2 * (k - 1) * (n - 1) / n))]
    high = [v >= k / 2 for v in symbols]
    a, b = high.count(True), high.count(False)
    if a and b:
        expected = 2 * a * b / n + 1
        var = (expected - 1) * (expected - 2) / (n - 1)
        battery.append(2 * upper(abs(len(list(itertools.groupby(high))) - expected) / math.sqrt(var)) if var > 0 else 1.0)
    else:
        battery.append(2 * 0.5**n)
    mean = sum(symbols) / n
    spread = sum((v - mean) ** 2 for v in symbols)
    serial = sum((v - mean) * (w - mean) for v, w in zip(symbols, symbols[1:])) / spread if spread else 0
    battery.append(2 * upper(abs(serial + 1 / n) * math.sqrt(n)) if spread else 0.0)
    equal = sum(symbols[i] == symbols[j] for i in range(n) for j in range(i))
    s2, s3 = sum(f**2 for f in frequency), sum(f**3 for f in frequency)
    var = math.comb(n, 2) * (s2 - s2**2) + 6 * math.comb(n, 3) * max(s3 - s2**2, 0)
    z = (math.comb(n, 2) * s2 - equal - 0.5) / math.sqrt(var) if var > 0 else 0.0
    return min(1, 3 * min(battery)), -math.log10(upper(z)) if upper(z) > 0 else z * z / 2 / math.log(10)


def test_secrets_of_a_whole_table_equal_plain_python(spark, awkward, sf_dir):
    """All texts of the table with planted keys of every length class, against loops over one text at a time."""
    rng = random.Random(11)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    rows += [(r.doc_id, r.text) for r in awkward.select("doc_id", "text").collect()]
    alphabets = {"base62": string.ascii_letters + string.digits, "upper": string.ascii_uppercase, "hex": "0123456789ABCDEF"}
    for name, alphabet in alphabets.items():
        for n in (20, 24, 32, 40, 48, 64, 96, 128):
            rows += [(len(rows), f"the {name} is " + "".join(rng.choice(alphabet) for _ in range(n)) + " here") for _ in range(3)]
    rows += [(len(rows), "Aa" * 30 + " and " + string.ascii_letters + " are in order"), (len(rows), "internationalisationalism-of-everything")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)

    counts = Counter("".join(t or "" for _, t in rows))
    patterns = {0: r"(?ai:(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+))", 1: r"AKIA[A-Z0-9]+", 2: r"[0-9a-f]+"}
    expected_base, tested, classes = [], [], defaultdict(list)
    for at, (_, text) in enumerate(rows):
        spans = [(m.start(), k, m.end(), m) for k, p in patterns.items() for m in re.finditer(p, text or "")]
        base = sorted((s, k, e) for s, k, e, m in spans if (len(m[2]) >= 6 if k == 0 else e - s >= {1: 20, 2: 24}[k]))
        expected_base.append(base)
        for m in re.finditer(r"[A-Za-z0-9+/_-]{20,}", text or ""):
            kind, alphabet = next((i, a) for i, (_, a) in enumerate(secrets.ENCODINGS) if set(m[0]) <= set(a))
            total = sum(counts[c] + 1 for c in alphabet)
            battery, level = plain_p_value(m[0], alphabet, [(counts[c] + 1) / total for c in alphabet])
            level = 0 if battery < secrets.RANDOM_LEVEL else min(int(level / secrets.STEP), secrets.LEVELS - 1) * secrets.STEP
            of = (kind, sum(len(m[0]) >= limit for limit in secrets.LENGTHS))
            classes[of].append(10**-level)
            tested.append((at, m.span(), of, 10**-level, any(s < m.end() and m.start() < e for s, _, e in base)))
    limit = {}
    for of, values in classes.items():
        values.sort()
        limit[of] = max((p for i, p in enumerate(values, 1) if p * len(values) <= secrets.FALSE_DISCOVERIES * i), default=0.0)
    expected = [
        (row_id, tuple(base), tuple((s, 3, e) for at, (s, e), of, p, taken in tested if at == i and p <= limit[of] and not taken))
        for i, ((row_id, _), base) in enumerate(zip(rows, expected_base))
    ]
    found = [(r.doc_id, tuple(tuple(s) for s in r.base), tuple(tuple(s) for s in r.random)) for r in secrets.find_secrets(df).collect()]
    assert Counter(found) == Counter(expected)
    planted = {rows[i][1] for i in range(len(rows)) if expected[i][2]}
    assert sum(t.startswith("the base62") for t in planted) >= 12 and not any(t.startswith(("Aa", "inter")) for t in planted)


def test_average_precision():
    assert toxicity.average_precision(np.array([0.9, 0.8, 0.1]), np.array([1, 0, 1])) == pytest.approx((1 + 2 / 3) / 2)
    assert toxicity.average_precision(np.array([0.5, 0.5, 0.5, 0.5]), np.array([1, 0, 0, 0])) == 0.25
    assert toxicity.average_precision(np.zeros(0), np.zeros(0)) == 0.0


def test_toxicity_bounds_by_cross_validation(spark):
    """Words of one toxic row alone are chance; the bounds that leave them out are found from training rows, as plain Python finds them."""
    random.seed(3)
    rows = []
    for i in range(240):
        words = [random.choice(["river", "stone", "garden", "winter"]) for _ in range(20)] + [f"odd{random.randrange(60)}x" for _ in range(6)]
        rows.append((i, " ".join(words + (["scumbag"] if i % 6 == 0 else [])), int(i % 6 == 0), i // 6 % toxicity.CV_FOLDS))
    train = spark.createDataFrame(rows, "doc_id long, text string, label long, fold int")
    held = defaultdict(int)
    for _, _, y, f in rows:
        held[f, y] += 1
    counted = toxicity.count_entries(train)
    got = {r.entry: tuple(r)[1:] for r in counted.collect()}
    scum = got[int(toxicity._hash(["scumbag"]).view(np.int64)[0])]
    assert sum(scum) == 40 and sum(scum[1::2]) == 40  # in toxic rows only
    bounds = toxicity.choose_bounds(train, counted, held)
    worth = {}
    for t in toxicity.MIN_TOXIC:
        for o in toxicity.MIN_ODDS:
            score = np.zeros(len(rows))
            for f in range(toxicity.CV_FOLDS):
                (lexicon,) = toxicity.learn_lexicons(counted, held, [(f, t, o)])
                for i, text, _, fold in rows:
                    if fold == f:
                        kinds, at, _, _ = toxicity._entries(pa.array([text]))
                        score[i] = lexicon.words(kinds).sum() / np.sqrt(len(at))
            worth[t, o] = toxicity.average_precision(score, np.array([r[2] for r in rows]))
    assert worth[bounds] == pytest.approx(max(worth.values()))


def test_toxicity(spark, awkward, nothing):
    random.seed(9)
    calm = ["river", "stone", "garden", "winter", "letter", "music", "paper", "window"]
    make = lambda bad: " ".join(random.choice(["idiotic", "moronic", "you"]) if bad and random.random() < 0.3 else random.choice(calm) for _ in range(40))
    rows = [(i, make(i % 4 == 0), int(i % 4 == 0)) for i in range(400)]
    docs, labels = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels, F.col("doc_id") % 5 != 0, F.col("doc_id") % 5 == 1)
    held = [r for r in toxicity.score_toxicity(docs, model, carry=["doc_id"]).collect() if r.doc_id % 5 == 0]
    assert np.mean([(r.score >= 0.3) == (r.doc_id % 4 == 0) for r in held]) >= 0.95
    scored = toxicity.score_toxicity(awkward, model)
    assert scored.columns == [c for c in awkward.columns if c != "score"] + ["score"]
    assert all(0 <= r.score <= 1 for r in scored.collect()) and scored.count() == awkward.count()
    assert toxicity.score_toxicity(nothing, model).count() == 0
    bare = toxicity.fit(nothing, labels.limit(0), F.lit(True), F.lit(False))
    assert {r.score for r in toxicity.score_toxicity(awkward, bare).collect()} == {0.0}


def test_packing_routes_by_the_frequencies_of_all_documents(spark, sf_dir, monkeypatch):
    docs = spark.createDataFrame([(i, f"common words and number {i} of many" if i else "one rare zebra") for i in range(60)], "doc_id long, text string")
    seen, route = [], packing.routed
    monkeypatch.setattr(packing, "routed", lambda held, idf: (seen.append((held.count(), idf)), route(held, idf))[1])
    pieces = packing.pack(docs.repartition(7), *vocabulary()).toPandas()
    held = [set(np.concatenate([np.frombuffer(x, "<u4") for x in own])) for _, own in pieces.groupby("doc_id")["ids"]]
    n, idf = seen[0]
    assert n == len(held) == 60
    for term in set().union(*held):
        count = sum(term in own for own in held)
        assert np.isclose(idf[term], np.log1p((n - count + 0.5) / (count + 0.5)))
