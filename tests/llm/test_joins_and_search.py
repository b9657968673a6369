"""The sketch join and the tree search against brute force, the components, the pipeline, and the queries' SQL."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from oracle import connect, differences
from pyspark.sql import functions as F

import corpus_pipeline
from marquee.llm import ngram_join, tree_search
from marquee.llm.components import components
from marquee.llm.queries import ORACLES, QUERIES


def shingles(text):
    words = [w for w in re.split(r"[\x20\x09-\x0D]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")) if w]
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)} if len(words) >= 5 else ({tuple(words)} if words else set())


def closed(sets):
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def edited(words, n):
    words = list(words)
    for _ in range(n):
        words[random.randrange(len(words))] = f"w{random.random()}"
    return words


def passages(n):
    """Texts that share a passage of 60 words and differ in the rest."""
    random.seed(9)
    return [(i, " ".join([f"p{j}" for j in range(60)] + [f"r{random.random()}" for _ in range(random.randint(10, 60))])) for i in range(n)]


def test_a_shared_passage_brings_few_candidates(spark, monkeypatch):
    """Twice the documents around one passage make about twice the rows, and they meet in no group of rare shingles."""
    made = {}
    write = ngram_join.stored

    def counted(df, name):
        out = write(df, name)
        made[name] = made.get(name, 0) + out.count()
        return out

    monkeypatch.setattr(ngram_join, "stored", counted)
    rows = []
    for n in (300, 600):
        made.clear()
        found = ngram_join.similar_components(spark.createDataFrame(passages(n), "doc_id long, text string").repartition(4))
        assert found.filter("doc_id <> component_id").isEmpty()
        rows.append(dict(made))
    for name, before in rows[0].items():
        assert rows[1].get(name, 0) <= 2.2 * before + 100, (name, before, rows[1].get(name, 0))
    assert rows[1]["rare-groups"] == 0


def test_join_equals_all_pairs(spark):
    random.seed(2)
    texts, passage = [], [f"p{i}" for i in range(60)]
    for size in (3, 5, 6, 7, 8, 9, 12, 20, 40, 90, 300):
        for _ in range(3):
            base = [f"b{random.random()}" for _ in range(size)]
            texts += [base] + [edited(base, random.randint(0, max(1, size // 25))) for _ in range(6)]
    base = [f"c{i}" for i in range(120)]
    texts += [edited(base, random.randint(1, 5)) for _ in range(60)]  # a large part with several components
    texts += [passage + [f"r{random.random()}" for _ in range(random.randint(10, 60))] for _ in range(60)]
    rows = [(i, " ".join(t).upper() if i % 2 else "\t".join(t)) for i, t in enumerate(texts)]
    found = {r.doc_id: r for r in ngram_join.similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    sets = [shingles(t) for _, t in rows]
    for i, root in enumerate(closed(sets)):
        assert (found[i].n_shingles, found[i].component_id) == (len(sets[i]), root)


def test_join_on_awkward_rows(awkward, nothing):
    rows = ngram_join.similar_components(awkward).collect()
    assert Counter((r.doc_id, r.component_id) for r in rows) == Counter({(1, 1): 1, (2, 2): 1, (3, 3): 1, (4, 4): 1, (5, 5): 1, (6, 5): 1, (7, 1): 2, (8, 8): 1, (9, 9): 1, (None, None): 1, (10, 5): 1})
    kept = ngram_join.keep_one(awkward)
    assert kept.columns == awkward.columns and {r.doc_id for r in kept.collect()} == {1, 2, 3, 4, 5, 8, 9, None}
    assert ngram_join.similar_components(nothing).count() == 0


def test_sketch_distance_bounds_the_difference():
    random.seed(5)
    for _ in range(200):
        a = np.unique(np.array([random.getrandbits(64) for _ in range(random.randint(1, 300))], np.uint64))
        b = np.unique(np.concatenate([a[random.randint(0, len(a) - 1) :], np.array([random.getrandbits(64) for _ in range(random.randint(0, 60))], np.uint64)]))
        assert ngram_join.distance(ngram_join.sketch(a), ngram_join.sketch(b)) <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_signature():
    random.seed(6)
    bands = ngram_join.Bands((75, 100))
    for size in [*range(3, 40), 100, 333, 1000]:
        a = np.unique(np.array([random.getrandbits(64) for _ in range(size)], np.uint64))
        gone = random.randint(0, int(len(a) * 0.25))
        b = a[gone:]
        if 100 * len(b) < 75 * len(a) or not len(b):
            continue
        frequent = np.sort(np.array(random.sample(a.tolist(), len(a) // 2), np.uint64))
        both = np.concatenate([a, b])
        for hot in (frequent, np.sort(a), a[:0]):
            sig, of = ngram_join.signatures(both, np.array([0, len(a), len(both)]), bands, hot)
            assert set(sig[of == 0].tolist()) & set(sig[of == 1].tolist()) or len(a) < 3


def test_every_row_is_searched_for_frequent_shingles(spark, monkeypatch):
    """Of 30 000 rows the shingles of 6 rows are frequent, each of them, and those of 5 are not."""

    class Seen(Exception):
        pass

    def taken(df, text, bands, frequent):
        raise Seen(set(frequent.tolist()))

    passage = lambda kind, i: " ".join(f"{kind}{i}{c}" for c in "abcde")
    texts = [passage("six", i) for i in range(200) for _ in range(6)] + [passage("five", i) for i in range(200) for _ in range(5)]
    texts += [passage("one", i) for i in range(30_000 - len(texts))]
    monkeypatch.setattr(ngram_join, "candidates", taken)
    with pytest.raises(Seen) as seen:
        ngram_join.similar_components(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5))
    wanted, _ = ngram_join.shingle_sets(pa.array(sorted({x for x in texts if x.startswith("six")})))
    assert len(wanted) == 200 and seen.value.args[0] == set(wanted.tolist())


@pytest.mark.parametrize("one_task", [0, None])
def test_components(spark, one_task):
    path = [(i, i + 1) for i in range(60)] + [(100, 101), (102, 101), (5, 5), (0, 0)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path, "a long, b long").repartition(3), one_task).collect()}
    assert found == {**dict.fromkeys(range(61), 0), 100: 100, 101: 100, 102: 100}
    assert components(spark.createDataFrame([], "a long, b long"), one_task).count() == 0
    named = components(spark.createDataFrame([("c", "b"), ("d", "c"), ("x", "y")], "a string, b string"), one_task)
    assert {r.node: r.component for r in named.collect()} == {"b": "b", "c": "b", "d": "b", "x": "x", "y": "x"}


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, 0.0) for i, v in rows], "vec_id long, embedding array<float>, rank int, score double").repartition(3)


def test_search_recall(spark):
    x = np.random.default_rng(1).normal(size=(3000, 16)).astype(np.float32)
    x[1000:1900] = x[7]  # a third of all rows are one vector
    df = vectors(spark, [(i, [float(c) for c in v]) for i, v in enumerate(x)])
    index = tree_search.TreeIndex(df)
    queries = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    found = defaultdict(list)
    for r in index.search(queries).orderBy("query_id", "rank").collect():
        found[r.query_id].append((r.vec_id, r.score))
    y = x.astype(np.float64)
    norm = np.sqrt((y * y).sum(1))
    hits = []
    for q in range(0, 3000, 50):
        score = (y * y[q]).sum(1) / (norm * norm[q])
        order = [i for i in np.lexsort((np.arange(3000), -score)) if i != q][:5]
        hits.append(len({i for i, _ in found[q]} & set(order)) / 5)
        assert all(s == pytest.approx(score[i], abs=1e-12) for i, s in found[q]) and len(found[q]) == 5
        if 1000 <= q < 1900:
            assert [i for i, _ in found[q]] == order  # ties go to the smaller id
    assert np.mean(hits) >= 0.9


def test_sample_of_a_hot_id_stays_bounded(spark, monkeypatch):
    bound, n = 100, 3000
    hot = next(i for i in range(n, 2 * n) if int(hashlib.md5(f"tree:{i}".encode()).hexdigest()[:13], 16) < (1 << 52) * bound // n)
    x = np.random.default_rng(1).normal(size=(n, 4))
    rows = [(hot if i % 3 == 0 else i, [1.0, 2.0, 3.0, 4.0] if i % 6 == 0 else [float(c) for c in v]) for i, v in enumerate(x)]
    seen, init = [], tree_search.KMeansTree.__init__
    monkeypatch.setattr(tree_search.KMeansTree, "__init__", lambda self, sample: seen.append(len(sample)) or init(self, sample))
    index = tree_search.TreeIndex(vectors(spark, rows), sample_rows=bound)
    assert 30 < seen[0] < 2 * bound and [w.rows.count() for w in index.widths] == [n]


def test_search_awkward(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 0.0]), (50, [1.0, 0.0]), (1, None), (2, [0.0, 0.0]), (3, [nan, 1.0]), (4, [inf, 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (6, [2.0, 0.0]), (7, []), (8, [1.0, 2.0, 3.0]), (None, [1.0, 1.0]), (9, [0.0, 1.0])]
    df = vectors(spark, rows)
    queries = df.filter("vec_id % 50 = 0 or vec_id < 6").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    found = sorted((r.query_id, r["rank"], r.vec_id, r.score) for r in tree_search.TreeIndex(df).search(queries).collect())
    assert found == [(0, 1, 6, 1.0), (0, 2, 50, 1.0), (0, 3, 9, 0.0), (50, 1, 0, 1.0), (50, 2, 6, 1.0), (50, 3, 9, 0.0)]
    empty = vectors(spark, [(1, None)])
    assert tree_search.TreeIndex(empty).search(queries).count() == 0


def test_search_of_large_and_tiny_components(spark):
    """Cosines are those of the vectors at an ordinary scale, whatever the scale of each row."""
    x = np.random.default_rng(4).normal(size=(300, 6))
    scale = [2.0**900, 2.0**-900, 1.0, 2.0**-1000]
    rows = [(i, [float(c * scale[i % 4]) for c in v]) for i, v in enumerate(x)] + [(300, [5e-324, 0.0, 0.0, 0.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    queries = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
    plain = np.concatenate([x, [[1.0, 0, 0, 0, 0, 0]]])
    norm = np.sqrt((plain**2).sum(1))
    found = tree_search.TreeIndex(df).search(queries).collect()
    assert len(found) == 7 * 5
    for r in found:
        assert r.score == pytest.approx((plain[r.vec_id] * plain[r.query_id]).sum() / (norm[r.vec_id] * norm[r.query_id]), abs=1e-9)
    for q in range(0, 301, 50):
        score = (plain @ plain[q]) / (norm * norm[q])
        true = {i for i in np.argsort(-score) if i != q and score[i] >= np.sort(np.delete(score, q))[-5]}
        assert len(true & {r.vec_id for r in found if r.query_id == q}) >= 4


def test_search_of_every_width(spark):
    df = vectors(spark, [*[(i, [1.0, float(i)]) for i in range(40)], (50, [1.0, 0.0, 2.0]), (51, [2.0, 0.0, 4.0]), (100, [1.0])])
    queries = df.filter("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").cast("array<double>").alias("q"))
    found = sorted((r.query_id, r["rank"], r.vec_id) for r in tree_search.TreeIndex(df).search(queries).collect())
    assert found == [*[(0, i, i) for i in range(1, 6)], (50, 1, 51)]  # the only row of its width finds none


def test_best_bins_visits_every_leaf_once():
    tree = tree_search.KMeansTree(np.random.default_rng(2).normal(size=(2000, 8)))
    assert sorted(tree.best_bins(np.ones(8), tree.leaves)) == list(range(tree.leaves))
    assert tree.best_bins(np.ones(8), 5) == tree.best_bins(np.ones(8), tree.leaves)[:5]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLES[name]) == []


def test_pipeline(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    after = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, sf_dir).cache()
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        after[name] = Counter(r.doc_id for r in docs.collect())
    lettered = {i for i, t in texts.items() if any(c.isalpha() for c in t or "")}
    assert set(after["language"]) == lettered
    firsts = {}
    for i in sorted(lettered):
        firsts.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", texts[i]), i)
    assert set(after["exact_copies"]) == set(firsts.values())
    order = sorted(firsts.values())
    roots = closed([shingles(texts[i]) for i in order])
    assert set(after["near_copies"]) == {order[r] for r in roots}
    assert set(after["mixture"]) <= set(after["near_copies"])
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).collect()
    whole = Counter(p.doc_id for p in pieces if p.start == 0)
    assert whole == after["mixture"]


def test_pipeline_stages_on_awkward_rows(spark, awkward, nothing, sf_dir):
    docs, other = awkward, nothing
    for _, stage in corpus_pipeline.STAGES[:-1]:
        before = Counter((r.doc_id, r.text) for r in docs.collect())
        docs, other = stage(spark, docs, sf_dir).cache(), stage(spark, other, sf_dir)
        assert docs.columns == awkward.columns and {(r.doc_id, r.text) for r in docs.collect()} <= set(before)
        assert other.columns == awkward.columns and other.isEmpty()
    assert {r[1] for r in docs.collect()} <= {r.text for r in awkward.collect() if any(c.isalpha() for c in r.text or "")}
    for given in (awkward, docs):  # as it comes, and what the stages left
        pieces = corpus_pipeline.STAGES[-1][1](spark, given, sf_dir).collect()
        assert Counter(p.doc_id for p in pieces if p.start == 0) == Counter(r.doc_id for r in given.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, nothing, sf_dir).isEmpty()
