import gzip

import pytest
from pyspark.sql import functions as F

from marquee.config import FeatureConfig
from marquee.operators.encoders import HashEncoder
from marquee.operators.locale import api_countries, merge_languages
from marquee.plans import views as W
from marquee.plans.build import build_catalogue, ingest
from marquee.operators.search import batch_search
from marquee.session import cut_lineage, scratch_path, shared_dir
from marquee.sources.tables import RAW_TITLES, VersionedTable, read_delimited
from marquee.streaming.jobs import KEY_CLASSES, encode_titles, ingest_payloads, key_classes, read_stored


def test_delimited(spark, tmp_path):
    text = 'tconst\tstartYear\ttitleType\tother\ntt1\t\\N\tmovie\tx\ntt2\t1999\t"quoted\ty\n'
    path = tmp_path / "title.basics.tsv.gz"
    path.write_bytes(gzip.compress(text.encode() + b"tt3\t2000\tcaf\xff\tz\n"))
    rows = {r["tconst"]: r for r in read_delimited(spark, str(path), RAW_TITLES, partitions=3).collect()}
    assert rows["tt1"]["startYear"] is None and rows["tt2"]["startYear"] == 1999
    assert rows["tt2"]["titleType"] == '"quoted' and rows["tt3"]["titleType"] == "caf�"
    plain = tmp_path / "some.csv"
    plain.write_text("a,b\n1,\\N\n2,x\n")
    inferred = read_delimited(spark, str(plain))
    assert dict(inferred.dtypes) == {"a": "int", "b": "string"}
    assert [tuple(r) for r in inferred.orderBy("a").collect()] == [(1, None), (2, "x")]


def test_shared_dir_is_the_configured_one(spark):
    assert shared_dir(spark) == spark.conf.get("spark.checkpoint.dir", shared_dir(spark))
    assert scratch_path(spark, "a") != scratch_path(spark, "a")
    assert cut_lineage(spark.range(5)).count() == 5


def test_versions(spark):
    store = VersionedTable(spark, scratch_path(spark, "t"))
    assert not store.exists()
    with pytest.raises(FileNotFoundError):
        store.load()
    store.publish(spark.range(3))
    store.publish(store.load().union(spark.range(3, 5)))
    assert store.exists() and store.load().count() == 5 and store.load(back=1).count() == 3
    store.append(spark.range(5, 6))
    assert store.load().count() == 6 and store.load(back=1).count() == 5 and store.load(back=2).count() == 3
    with pytest.raises(FileNotFoundError):
        store.load(back=3)


def test_resumed_ingest_equals_one_run(spark, sf_dir):
    payloads = W.payloads(spark, sf_dir)
    ids = payloads.select("tid")
    once = ingest(ids, payloads, VersionedTable(spark, scratch_path(spark, "a")))
    store = VersionedTable(spark, scratch_path(spark, "b"))
    first = ingest(ids, payloads, store, limit=20)
    assert first.agg(F.max("tid")).first()[0] <= 19
    again = ingest(ids, payloads, store)
    assert sorted(r["tid"] for r in again.collect()) == sorted(r["tid"] for r in once.collect())


def test_streams_write_each_key_once(spark, sf_dir):
    root = scratch_path(spark, "s")
    W.payloads(spark, sf_dir).write.parquet(f"{root}/landed")
    for restart in (0, 1):  # the second run starts from nothing, as after a lost checkpoint
        stream = spark.readStream.schema("tid long, raw string").parquet(f"{root}/landed")
        ingest_payloads(stream, f"{root}/movies", f"{root}/bad", f"{root}/cp{restart}").awaitTermination()
    movies = spark.read.parquet(f"{root}/movies")
    total = movies.count() + spark.read.parquet(f"{root}/bad").count()
    assert total == W.payloads(spark, sf_dir).count() and movies.select("tid").distinct().count() == movies.count()
    movies.select("tid", "plot").write.parquet(f"{root}/texts")
    for restart in (0, 1):
        stream = spark.readStream.schema("tid long, plot string").parquet(f"{root}/texts")
        encode_titles(stream, HashEncoder(8), f"{root}/vectors", f"{root}/vcp{restart}").awaitTermination()
    assert spark.read.parquet(f"{root}/vectors").count() == movies.filter("plot is not null").count()


def test_streams_keep_every_payload_of_a_title(spark):
    good = lambda title: f'{{"Title": "{title}", "Response": "True"}}'
    wrong = '{"Response": "False", "Error": "Incorrect id."}'
    first, second = [(1, good("A")), (1, good("B")), (2, "{bad"), (2, wrong), (2, "{bad")], [(1, good("C")), (1, good("A")), (2, "{bad"), (2, "{other")]
    titles = set()
    for turned in (1, -1):
        root = scratch_path(spark, "payloads")
        for restart, rows in (("a", first[::turned]), ("a", second[::turned]), ("b", [])):  # at last all again, after a lost checkpoint
            spark.createDataFrame(rows, "tid long, raw string").coalesce(1).write.mode("append").parquet(f"{root}/landed")
            stream = spark.readStream.schema("tid long, raw string").parquet(f"{root}/landed")
            ingest_payloads(stream, f"{root}/movies", f"{root}/bad", f"{root}/cp{restart}").awaitTermination()
        movies = spark.read.parquet(f"{root}/movies").collect()
        assert [r.tid for r in movies] == [1] and movies[0].title in ("A", "B")
        titles.add(movies[0].title)
        expected = [(1, good(t)) for t in "ABC" if t != movies[0].title] + [(2, wrong), (2, "{bad"), (2, "{other")]
        assert sorted((r.tid, r.raw) for r in spark.read.parquet(f"{root}/bad").collect()) == sorted(expected)
    assert len(titles) == 1


def test_a_small_batch_reads_few_folders_of_the_stored_table(spark):
    root = scratch_path(spark, "seen")
    plots = spark.range(3000).select(F.col("id").alias("tid"), F.concat(F.lit("plot "), "id").alias("plot"))
    plots.write.parquet(f"{root}/texts")

    def encode(checkpoint):
        stream = spark.readStream.schema("tid long, plot string").parquet(f"{root}/texts")
        encode_titles(stream, HashEncoder(4), f"{root}/vectors", f"{root}/{checkpoint}").awaitTermination()

    encode("first")
    few = spark.createDataFrame([(5,), (1700,), (90001,), (None,)], "tid long")
    classes = key_classes(few)
    seen = read_stored(spark, f"{root}/vectors", "tid long", classes)
    files = seen.select(F.input_file_name()).distinct().count()
    assert len(classes) <= 4 and files <= 4 and 0 < seen.count() < 3000 * 20 / KEY_CLASSES
    assert {5, 1700} <= {r.tid for r in seen.collect()}
    assert "key_class" in seen._jdf.queryExecution().executedPlan().toString().split("PartitionFilters: [")[1].split("]")[0]
    few.withColumn("plot", F.lit("other")).write.mode("append").parquet(f"{root}/texts")
    encode("first")  # two stored keys, a new one and a null one
    encode("second")  # all again, after a lost checkpoint
    stored = read_stored(spark, f"{root}/vectors", "tid long, plot_embedding array<double>")
    assert stored.count() == 3002 and stored.select("tid").distinct().count() == 3002
    assert read_stored(spark, f"{root}/nothing", "tid long").count() == 0


def test_a_stream_of_no_payloads_leaves_empty_tables(spark):
    root = scratch_path(spark, "empty")
    spark.createDataFrame([], "tid long, raw string").write.parquet(f"{root}/landed")
    stream = spark.readStream.schema("tid long, raw string").parquet(f"{root}/landed")
    ingest_payloads(stream, f"{root}/movies", f"{root}/bad", f"{root}/cp").awaitTermination()
    assert read_stored(spark, f"{root}/movies", "tid long").count() == read_stored(spark, f"{root}/bad", "tid long").count() == 0


def test_whole_build(spark, sf_dir):
    raw = W.raw_titles(spark, sf_dir)
    out = scratch_path(spark, "build")
    films, model = build_catalogue(
        spark, raw, raw, W.payloads(spark, sf_dir), HashEncoder(32), out, FeatureConfig(plot_dim=32, genre_dim=40, loc_dim=64)
    )
    assert films.count() == model.components.count() > 0
    norms = model.components.select("plot_n2", "genre_n2", "loc_n2").toPandas()
    assert (((norms - 1).abs() < 1e-6) | (norms == 0)).all().all() and (norms > 0).any().all()
    asked = W.benchmark_requests(spark, sf_dir)
    assert batch_search(asked, films, model, HashEncoder(32)).count() > 0


def test_language_order(spark):
    df = spark.sql(
        "select array('English', 'French') a, array('French', 'Dutch') b, array('Breton', 'French', 'Latin') c, 'x' d, 'x' e, '' f"
    )
    row = df.select(
        merge_languages(F.col("a"), F.col("b"), F.col("c")),
        merge_languages(F.lit(None), F.lit(None), F.col("c")),
        api_countries(F.col("d"), F.col("e")),
        api_countries(F.col("f"), F.col("e")),
    ).first()
    assert row[0] == ["Latin", "Breton", "English", "French", "Dutch"]
    assert row[1] == ["Latin", "French", "Breton"]
    assert row[2] == ["x"] and row[3] == ["x"]


def test_a_batch_of_many_payloads_is_dealt_into_bounded_parts(spark, monkeypatch):
    from marquee.streaming import jobs

    batch = spark.range(200).selectExpr("id as tid", "repeat('x', 1000) as raw").coalesce(1)
    assert jobs._spread(batch).rdd.getNumPartitions() == 1
    monkeypatch.setattr(jobs, "PART_BYTES", 10_000)
    dealt = jobs._spread(batch)
    assert dealt.rdd.getNumPartitions() == 20
    assert dealt.count() == 200
