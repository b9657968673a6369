"""One named query per operator, each over the whole given tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions import features as V
from ..functions import parsing as P
from ..functions.core import fixed, one_row
from ..functions.ids import key_from_text, text_from_key, try_key_from_text
from ..functions.text import diversity_bucket, keyword_genres
from ..functions.vectors import fit, l2_normalize, multi_hot
from ..operators import features as A
from ..operators import locale as L
from ..operators import ratings as R
from ..operators import search as S
from ..operators.eligibility import eligible_ids, first_keys, not_done, searchable, with_genre, with_plot
from ..operators.eligibility import encoding_report as report_of
from ..operators.encoders import HashEncoder, JoinEncoder
from ..operators.kmeans import table_kmeans
from ..operators.requests import resolve_recommend, resolve_search, validate_recommend, validate_search
from ..operators.stats import catalog_stats
from ..operators.vocab import active_features, build_vocab, feature_combos, list_column, vocab_size
from ..session import cut_lineage, scratch_path
from ..sources import payloads as Y
from ..sources.tables import RAW_RATINGS, RAW_TITLES, VersionedTable, read_delimited
from ..streaming.jobs import encode_titles, ingest_payloads, read_stored
from . import views as W
from .build import build_catalogue, ingest, new_plot_embeddings, plot_embeddings
from .views import rounded, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

LIGHT = {"ratings": False, "plots": False}
LOC = {"country": "country", "language": "language"}


def query(fn: Query) -> Query:
    """Register ``fn`` under its name; a trailing underscore only keeps it apart from an operator."""
    QUERIES[fn.__name__.rstrip("_")] = fn
    return fn


def joined(c: Column) -> Column:
    return F.array_join(c, "|")


def entries(df: DataFrame, vector: str, key: str = "tid") -> DataFrame:
    """Non-zero entries of a vector column as ``(key, pos, value)`` rows."""
    exploded = df.select(key, F.posexplode_outer(vector).alias("pos", "v"))
    return exploded.filter(F.col("v") != 0).select(key, "pos", fixed(F.col("v").cast("double")).alias("value"))


# --- sources, selection and parsing ----------------------------------------------------------------------------------


@query
def delimited_scan(spark, sf_dir):
    path = scratch_path(spark, "titles") + ".tsv"
    raw = W.raw_titles(spark, sf_dir).select("tconst", "titleType", "startYear")
    raw.write.option("sep", "\t").option("header", True).option("nullValue", "\\N").option("quote", "").csv(path)
    return read_delimited(spark, path, RAW_TITLES).select("tconst", "titleType", "startYear")


@query
def eligible_ids_(spark, sf_dir):
    path = scratch_path(spark, "ratings") + ".tsv.gz"
    raw = W.raw_titles(spark, sf_dir)
    rated = raw.select("tconst", "averageRating", "numVotes")
    writer = rated.write.option("sep", "\t").option("header", True).option("nullValue", "\\N").option("quote", "")
    writer.option("compression", "gzip").csv(path)
    return eligible_ids(raw, read_delimited(spark, path, RAW_RATINGS))


@query
def tid_text_id(spark, sf_dir):
    keys = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 1009).alias("tid")).distinct()
    text = text_from_key(F.col("tid"))
    return keys.select("tid", text.alias("text_id"), key_from_text(text).alias("back"))


@query
def text_id_quarantine(spark, sf_dir):
    asked = W.odd_requests(spark, sf_dir)
    return asked.select("qid", "item_id", try_key_from_text(F.col("item_id")).alias("tid"))


@query
def first_ids(spark, sf_dir):
    return first_keys(W.raw_titles(spark, sf_dir).select("tid"), 25)


@query
def payload_parse(spark, sf_dir):
    rows = Y.good_rows(Y.parse_payloads(W.payloads(spark, sf_dir)))
    texts = ["genre", "director", "actors", "language", "country", "awards"]
    return rows.select(
        "tid", "title", "year", "rated", "runtime", *[joined(F.col(c)).alias(c) for c in texts],
        F.md5(F.col("plot").cast("binary")).alias("plot_md5"), fixed(F.col("rating")).alias("rating"),
        "votes", "metascore", "poster",
    )


@query
def payload_quarantine(spark, sf_dir):
    return Y.quarantine(Y.parse_payloads(W.payloads(spark, sf_dir))).select("tid", "error")


@query
def split_field(spark, sf_dir):
    return W.loose_texts(spark, sf_dir).select("tid", joined(P.parse_list(F.col("genre_text"))).alias("parts"))


@query
def awards_split(spark, sf_dir):
    return W.loose_texts(spark, sf_dir).select("tid", joined(P.parse_list(F.col("awards_text"), "&")).alias("parts"))


@query
def parse_int(spark, sf_dir):
    texts = W.loose_texts(spark, sf_dir)
    return texts.select(
        "tid",
        P.parse_int(F.col("votes_text")).alias("votes"),
        P.parse_int(F.col("year_text")).alias("year"),
        P.parse_int(F.col("rating_text")).alias("not_int"),
    )


@query
def parse_float(spark, sf_dir):
    return W.loose_texts(spark, sf_dir).select("tid", P.parse_float(F.col("rating_text")).alias("rating"))


@query
def parse_duration(spark, sf_dir):
    return W.loose_texts(spark, sf_dir).select("tid", P.parse_minutes(F.col("runtime_text")).alias("minutes"))


@query
def parse_string(spark, sf_dir):
    return W.loose_texts(spark, sf_dir).select("tid", P.parse_text(F.col("title_text")).alias("title"))


@query
def list_field(spark, sf_dir):
    """Both overloads: a list stored as an array and as text."""
    both = W.titles(spark, sf_dir, ratings=False, plots=False).withColumn("text_list", F.concat_ws(" ,, ", "country"))
    return both.select(
        "tid",
        joined(list_column(both, "country")).alias("from_array"),
        joined(list_column(both, "text_list")).alias("from_text"),
    )


@query
def searchable_titles(spark, sf_dir):
    return searchable(W.titles(spark, sf_dir, locale=False, ratings=False)).select("tid", "title")


@query
def encodable_counts(spark, sf_dir):
    movies = W.titles(spark, sf_dir, locale=False, ratings=False)
    plots = with_plot(movies).agg(F.count("*").alias("with_plot"))
    return plots.withColumn("with_genre", with_genre(movies).agg(F.count("*")).scalar())


@query
def encoding_report(spark, sf_dir):
    """What can be encoded and what is missing, for titles, titles whose plots are all unknown, keyless and bare ones."""
    movies = W.titles(spark, sf_dir, locale=False, ratings=False)
    given = {
        "titles": movies,
        "unplotted": movies.withColumn("plot", F.lit(None).cast("string")),
        "keyless": movies.drop("tid", "genre"),
        "bare": movies.select("title", "runtime"),
    }
    reports = [report_of(df).withColumn("source", F.lit(name)) for name, df in given.items()]
    return reduce(DataFrame.unionByName, reports)


# --- ratings and scaling ---------------------------------------------------------------------------------------------


def _rated(spark, sf_dir):
    return W.titles(spark, sf_dir, locale=False, plots=False)


@query
def rating_means(spark, sf_dir):
    return rounded(R.rating_means(_rated(spark, sf_dir)), "mean_votes", "mean_rating", "mean_metascore")


@query
def rating_fusion(spark, sf_dir):
    fused = R.fuse_ratings(_rated(spark, sf_dir))
    columns = ["votes", "n_rating", "n_metascore", "bayes_rating", "final_rating"]
    return rounded(fused.select("tid", *columns), *columns)


@query
def controversy(spark, sf_dir):
    fused = R.fuse_ratings(_rated(spark, sf_dir))
    return rounded(fused.select("tid", "controversy_score"), "controversy_score")


@query
def mean_final_rating(spark, sf_dir):
    return rounded(R.mean_final_rating(R.fuse_ratings(_rated(spark, sf_dir))), "mean_final_rating")


@query
def scalar_norm(spark, sf_dir):
    scaled = R.normalize_scalars(_rated(spark, sf_dir))
    columns = [f"sn_{c}" for c in R.DEFAULT_COLUMNS]
    return rounded(scaled.select("tid", *columns), *columns)


@query
def scalar_norm_const(spark, sf_dir):
    """A constant column with nulls and an all-null column both give 0.5."""
    base = _rated(spark, sf_dir).select(
        "tid",
        F.when(F.col("rating").isNotNull(), F.lit(7)).alias("same"),
        F.lit(None).cast("double").alias("nothing"),
        "votes",
    )
    scaled = R.normalize_scalars(base, ["same", "nothing", "votes"])
    return rounded(scaled.select("tid", "sn_same", "sn_nothing", "sn_votes"), "sn_same", "sn_nothing", "sn_votes")


# --- vocabularies and features ---------------------------------------------------------------------------------------


def _light(spark, sf_dir):
    return W.titles(spark, sf_dir, **LIGHT)


def _vocab(spark, sf_dir, kind: str):
    return build_vocab(_light(spark, sf_dir), {kind: kind}).select("value", "idx")


@query
def vocab_country(spark, sf_dir):
    return _vocab(spark, sf_dir, "country")


@query
def vocab_language(spark, sf_dir):
    return _vocab(spark, sf_dir, "language")


@query
def vocab_genre(spark, sf_dir):
    return _vocab(spark, sf_dir, "genre")


@query
def vocab_words(spark, sf_dir):
    """A large vocabulary: every whitespace-separated piece of every document."""
    pieces = W.spread_table(spark, sf_dir, "documents").select(F.split("text", r"\s+").alias("pieces"))
    return build_vocab(pieces, {"piece": "pieces"}).select("value", "idx")


def _active(spark, sf_dir, columns: dict[str, str]) -> tuple[DataFrame, dict[str, int]]:
    movies = _light(spark, sf_dir)
    vocab = cut_lineage(build_vocab(movies, columns))
    sizes = {kind: vocab_size(vocab, kind) for kind in columns}
    return active_features(movies, vocab, columns, "active", sizes=sizes), sizes


@query
def feature_combos_(spark, sf_dir):
    active, _ = _active(spark, sf_dir, LOC)
    return feature_combos(active, "active").select(V.combo_text(F.col("active")).alias("combo"), "members")


@query
def feature_combos_by_join(spark, sf_dir):
    """The route of vocabularies too large for a lookup gives the same result."""
    movies = _light(spark, sf_dir)
    vocab = cut_lineage(build_vocab(movies, LOC))
    active = active_features(movies, vocab, LOC, "active", lookup_max=0)
    return feature_combos(active, "active").select(V.combo_text(F.col("active")).alias("combo"), "members")


@query
def multi_hot_genre(spark, sf_dir):
    active, sizes = _active(spark, sf_dir, {"genre": "genre"})
    return entries(active.select("tid", multi_hot(F.col("active"), sizes["genre"]).alias("v")), "v")


@query
def pad_truncate(spark, sf_dir):
    vectors = W.given_vectors(spark, sf_dir).select(
        "tid", fit(F.col("plot_embedding"), 70).alias("padded"), fit(F.col("plot_embedding"), 5).alias("cut")
    )
    both = vectors.select("tid", F.concat("padded", "cut").alias("v"))
    return entries(both, "v").unionByName(
        both.select("tid", F.lit(-1).alias("pos"), F.size("v").cast("double").alias("value"))
    )


@query
def l2_normalize_(spark, sf_dir):
    vectors = W.given_vectors(spark, sf_dir)
    return entries(vectors.select("tid", l2_normalize(F.col("plot_embedding")).alias("v")), "v")


@query
def genre_vectors(spark, sf_dir):
    """Genre embeddings without plot correlation, with a dimension for every genre, normalised."""
    movies = _light(spark, sf_dir)
    vocab = cut_lineage(build_vocab(movies, {"genre": "genre"}))
    size = vocab.count()
    cfg = C.FeatureConfig(genre_dim=size)
    return entries(A.genre_embeddings(movies, vocab, size, None, cfg), "genre_embedding")


@query
def full_join_embeddings(spark, sf_dir):
    plots = W.given_vectors(spark, sf_dir).select("tid", "plot_embedding")
    movies = W.titles(spark, sf_dir, ratings=False, locale=False, plots=False)
    genres = movies.select("tid", F.col("genre").alias("genre_embedding"))
    both = A.join_embeddings(plots, genres)
    return both.select(
        "tid", F.col("plot_embedding").isNotNull().alias("has_plot"), F.col("genre_embedding").isNotNull().alias("has_genre")
    )


@query
def merge_weighted(spark, sf_dir):
    movies = _light(spark, sf_dir)
    vocab = cut_lineage(build_vocab(movies, {"genre": "genre"}))
    genres = A.genre_embeddings(movies, vocab, vocab.count(), None, C.FeatureConfig(genre_dim=32))
    plots = W.given_vectors(spark, sf_dir).select("tid", l2_normalize(F.col("plot_embedding")).alias("plot_embedding"))
    merged = A.merged_embeddings(plots.join(genres, "tid"), 0.7, 0.5)
    return entries(merged, "combined_embedding")


@query
def popularity_boost(spark, sf_dir):
    scaled = R.normalize_scalars(R.fuse_ratings(_rated(spark, sf_dir)), ["votes"])
    return rounded(A.with_popularity(scaled).select("tid", "pop"), "pop")


@query
def popularity_uniform(spark, sf_dir):
    return A.with_popularity(_rated(spark, sf_dir).select("tid")).select("tid", "pop")


@query
def loc_vector_128(spark, sf_dir):
    active, _ = _active(spark, sf_dir, LOC)
    return entries(active.select("tid", V.loc_vector(F.col("active"), 128).alias("v")), "v")


@query
def loc_vector_small(spark, sf_dir):
    active, _ = _active(spark, sf_dir, LOC)
    return entries(active.select("tid", V.loc_vector(F.col("active"), 30).alias("v")), "v")


@query
def subcluster_plan(spark, sf_dir):
    active, sizes = _active(spark, sf_dir, {"genre": "genre"})
    points = active.select("tid", F.col("active").alias("grp")).join(W.given_vectors(spark, sf_dir).select("tid"), "tid")
    plan = A.subcluster_plan(points, sizes["genre"], 32, 5, C.FeatureConfig())
    return plan.select(V.combo_text(F.col("grp")).alias("combo"), "members", "k")


@query
def cluster_signature(spark, sf_dir):
    """Genre and localisation vectors of titles whose sub-cluster is the given label of their vector."""
    genres, sizes = _active(spark, sf_dir, {"genre": "genre"})
    locs, _ = _active(spark, sf_dir, LOC)
    labels = W.given_vectors(spark, sf_dir).select("tid", "label")
    both = (
        genres.select("tid", F.col("active").alias("g"))
        .join(locs.select("tid", F.col("active").alias("l")), "tid")
        .join(labels, "tid")
    )
    genre = V.clustered_genre_vector(F.col("g"), F.col("label"), sizes["genre"], 32)
    loc = V.clustered_loc_vector(F.col("l"), F.col("label"), F.lit(10), 128)
    return entries(both.select("tid", F.concat(genre, loc).alias("v")), "v")


@query
def hash_encode(spark, sf_dir):
    texts = W.spread_table(spark, sf_dir, "documents")
    return entries(HashEncoder(64).encode(texts, "doc_id", F.col("text"), "v"), "v", "doc_id")


@query
def join_encode(spark, sf_dir):
    encoder = JoinEncoder(W.given_vectors(spark, sf_dir), "tid", "plot_embedding")
    texts = table(spark, sf_dir, "documents").withColumn("tid", F.col("doc_id"))
    return entries(encoder.encode(texts, "tid", F.col("text"), "v"), "v")


@query
def grouped_kmeans(spark, sf_dir):
    """Sub-clusters of every genre combination."""
    from ..operators.kmeans import grouped_kmeans as run

    active, sizes = _active(spark, sf_dir, {"genre": "genre"})
    vectors = W.given_vectors(spark, sf_dir).select("tid", F.col("plot_embedding").alias("v"))
    points = active.select("tid", F.col("active").alias("grp")).join(vectors, "tid")
    room = max(1, 128 - sizes["genre"])
    clusters = V.cluster_count(F.col("members"), sizes["genre"], 128, 5)
    labels = run(points, clusters, room)
    return labels.select("tid", V.combo_text(F.col("grp")).alias("combo"), "cluster", "k", fixed(F.col("distance")).alias("distance"))


@query
def grouped_kmeans_plan(spark, sf_dir):
    """Members per clustered combination: fixed by the plan, whatever the labels."""
    labels = grouped_kmeans(spark, sf_dir)
    return labels.groupBy("combo").agg(
        F.count("*").alias("members"), F.first("k").alias("k"), (F.max("cluster") < F.first("k")).alias("in_range")
    )


@query
def plot_kmeans(spark, sf_dir):
    vectors = W.given_vectors(spark, sf_dir).select("tid", F.col("plot_embedding").alias("v"))
    return table_kmeans(vectors, _light(spark, sf_dir).select("tid"), 16)


@query
def genre_diversity(spark, sf_dir):
    sized = _light(spark, sf_dir).select("tid", F.size(F.array_distinct("genre")).alias("genres"))
    largest = one_row(sized, F.max("genres").alias("top"))["top"]
    return sized.select("tid", diversity_bucket(F.col("genres"), largest, 8).alias("bucket"))


@query
def genre_keywords(spark, sf_dir):
    return W.spread_table(spark, sf_dir, "conversations").select(
        "conv_id", "turn", joined(keyword_genres(F.col("text"))).alias("genres")
    )


# --- joins by key, stored tables and incremental jobs ----------------------------------------------------------------


@query
def semi_searchable(spark, sf_dir):
    films = searchable(W.titles(spark, sf_dir, ratings=False, locale=False))
    return W.given_vectors(spark, sf_dir).select("tid", "label").join(films.select("tid"), "tid", "left_semi")


@query
def anti_resume(spark, sf_dir):
    """Payloads in two instalments: the second run parses only what the first has not stored."""
    rated = _rated(spark, sf_dir)
    parts = W.payloads(spark, sf_dir)

    def work(todo):
        return Y.good_rows(Y.parse_payloads(parts.join(todo, "tid", "left_semi")))

    store = VersionedTable(spark, scratch_path(spark, "movies"))
    store.resume(rated.filter("votes > 25").select("tid"), work)
    stored = store.resume(rated.select("tid"), work)
    return stored.select("tid", "title", "votes")


@query
def versioned_table(spark, sf_dir):
    """Two versions of the rated titles; the previous one stays readable."""
    store = VersionedTable(spark, scratch_path(spark, "versions"))
    rows = _rated(spark, sf_dir).select("tid", "votes")
    store.publish(rows)
    store.publish(rows.filter("votes > 0"))
    old, new = store.load(back=1), store.load().withColumn("kept", F.lit(True)).select("tid", "kept")
    return old.join(new, "tid", "left").select("tid", "votes", F.coalesce("kept", F.lit(False)).alias("kept"))


@query
def model_store(spark, sf_dir):
    """Vocabulary and dimensions after a round trip through storage."""
    _, model = W.stored_model(spark, sf_dir)
    cfg = model.config
    return model.vocab.select(
        "kind", "value", "idx",
        F.lit(cfg.plot_dim).alias("plot_dim"), F.lit(cfg.genre_dim).alias("genre_dim"), F.lit(cfg.loc_dim).alias("loc_dim"),
    )


@query
def resume_embedding(spark, sf_dir):
    """Encoding in two instalments equals encoding at once."""
    films = W.titles(spark, sf_dir, ratings=False, locale=False)
    done = plot_embeddings(films.filter("runtime < 20"), W.ENCODER)
    return entries(new_plot_embeddings(films, done, W.ENCODER), "plot_embedding")


@query
def resume_union(spark, sf_dir):
    ids = _rated(spark, sf_dir).select("tid")
    labels = W.given_vectors(spark, sf_dir).select("tid", "label")
    return labels.unionByName(not_done(ids, labels).withColumn("label", F.lit(-1)))


@query
def build_catalogue_(spark, sf_dir):
    """Every stage from raw dumps and whole payloads to stored components, taken up where a run had stopped.

    The first run has parsed and stored about half of the eligible titles.
    """
    out, raw, payloads = scratch_path(spark, "build"), W.raw_titles(spark, sf_dir), W.payloads(spark, sf_dir)
    some = eligible_ids(raw, raw).filter("tid % 2 = 0")
    ingest(some, payloads, VersionedTable(spark, f"{out}/movies"))
    _, model = build_catalogue(spark, raw, raw, payloads, W.ENCODER, out, W.SEARCH_CONFIG, subclusters=False)
    stacked = F.concat("plot", "genre", "loc", F.array(F.col("pop").cast("float")))
    return entries(model.components.select("tid", stacked.alias("v")), "v")


@query
def incremental_ingest(spark, sf_dir):
    """Payloads landed as files, taken in by a stream that runs twice."""
    root = scratch_path(spark, "ingest")
    landed = W.payloads(spark, sf_dir)
    for good in (True, False):
        landed.filter(F.contains("raw", F.lit('"Response":"True"')) == good).write.mode("append").parquet(f"{root}/landed")
        stream = spark.readStream.schema("tid long, raw string").parquet(f"{root}/landed")
        job = ingest_payloads(stream, f"{root}/movies", f"{root}/rejected", f"{root}/checkpoint")
        job.awaitTermination()
    movies = read_stored(spark, f"{root}/movies", "tid long, title string, votes long")
    rejected = read_stored(spark, f"{root}/rejected", "tid long, error string, raw string")
    return movies.select("tid", "title", "votes", F.lit(None).cast("string").alias("error")).unionByName(
        rejected.select("tid", F.lit(None).cast("string").alias("title"), F.lit(None).cast("long").alias("votes"), "error")
    )


@query
def incremental_encode(spark, sf_dir):
    """Plots encoded by a stream over the documents table."""
    root = scratch_path(spark, "encode")
    schema = table(spark, sf_dir, "documents").schema
    stream = spark.readStream.schema(schema).parquet(f"{sf_dir}/documents.parquet*")  # one file, or a folder of them
    movies = stream.select(F.col("doc_id").alias("tid"), F.col("text").alias("plot"))
    for _ in range(2):
        encode_titles(movies, W.ENCODER, f"{root}/vectors", f"{root}/checkpoint").awaitTermination()
    return entries(read_stored(spark, f"{root}/vectors", "tid long, plot_embedding array<double>"), "plot_embedding")


# --- components and request vectors ----------------------------------------------------------------------------------


@query
def components(spark, sf_dir):
    """All four components of every searchable title, built from the raw tables."""
    _, model = W.search_model(spark, sf_dir)
    stacked = F.concat("plot", "genre", "loc", F.array(F.col("pop").cast("float")))
    return entries(model.components.select("tid", stacked.alias("v")), "v")


@query
def clustered_components(spark, sf_dir):
    """Components with plot-driven sub-clusters in the genre and localisation vectors."""
    _, model = W.stored_model(spark, sf_dir, subclusters=True)
    stacked = F.concat("plot", "genre", "loc", F.array(F.col("pop").cast("float")))
    return entries(model.components.select("tid", stacked.alias("v")), "v")


@query
def component_quality(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    return A.quality_check(films, model.components)


@query
def combined_embedding(spark, sf_dir):
    _, model = W.stored_model(spark, sf_dir)
    return entries(S.materialized_vector(model.components, C.LOW_LEVEL_WEIGHTS), "combined")


def _resolved(spark, sf_dir):
    resolved = resolve_search(W.benchmark_requests(spark, sf_dir))
    return resolved.filter(F.col("error_code") == C.ERROR_NONE)


@query
def query_loc_vector(spark, sf_dir):
    _, model = W.stored_model(spark, sf_dir)
    return entries(S.request_loc_vectors(_resolved(spark, sf_dir), model), "loc", "qid")


@query
def query_genre_vector(spark, sf_dir):
    _, model = W.stored_model(spark, sf_dir)
    encoded = S.encode_requests(_resolved(spark, sf_dir), model, W.ENCODER)
    return entries(S.neighbour_genres(cut_lineage(encoded), model), "genre", "qid")


# --- search and recommendation ---------------------------------------------------------------------------------------


def _hits(df: DataFrame, *more) -> DataFrame:
    return df.select("qid", F.col("rank").cast("long").alias("rank"), "tid", fixed(F.col("similarity")).alias("similarity"), *more)


@query
def weighted_search(spark, sf_dir):
    """Ten best titles of every benchmark text under the low-level weights."""
    films, model = W.stored_model(spark, sf_dir)
    weights = {f"{p}_weight": F.lit(getattr(C.LOW_LEVEL_WEIGHTS, p)) for p in ("plot", "genre", "localization", "popularity")}
    asked = W.benchmark_requests(spark, sf_dir).withColumns(weights | {"k": F.lit(10)})
    return _hits(S.weighted_search(asked, films, model, W.ENCODER), "cultural_match")


@query
def batch_search(spark, sf_dir):
    """Every conversation turn as a search with default options: one batch."""
    films, model = W.stored_model(spark, sf_dir)
    return _hits(S.batch_search(W.conversation_requests(spark, sf_dir), films, model, W.ENCODER))


@query
def search_filtered(spark, sf_dir):
    """Benchmark texts with presets, overrides, preferences and filters."""
    films, model = W.stored_model(spark, sf_dir)
    return _hits(S.batch_search(W.benchmark_requests(spark, sf_dir), films, model, W.ENCODER), "cultural_match")


@query
def search_records(spark, sf_dir):
    """The same search as result records."""
    films, model = W.stored_model(spark, sf_dir)
    found = S.project_results(S.batch_search(W.benchmark_requests(spark, sf_dir), films, model, W.ENCODER))
    lists = [joined(F.col(c)).alias(c) for c in ("countries", "languages", "genres")]
    return _hits(
        found, "imdb_id", "title", "year", fixed(F.col("rating")).alias("rating"), "votes",
        fixed(F.col("popularity_score")).alias("popularity_score"), *lists,
        F.md5(F.col("plot").cast("binary")).alias("plot_md5"), "poster",
    )


@query
def search_simple(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    return _hits(S.search_simple(W.benchmark_requests(spark, sf_dir), films, model, W.ENCODER))


@query
def recommend(spark, sf_dir):
    """Titles similar to every labelled document's title."""
    films, model = W.stored_model(spark, sf_dir)
    return _hits(S.recommend(W.labelled_items(spark, sf_dir), films, model, W.ENCODER))


@query
def recommend_by_title(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    return _hits(S.recommend_by_title(W.title_requests(spark, sf_dir), films, model, W.ENCODER))


@query
def title_lookup(spark, sf_dir):
    films, _ = W.stored_model(spark, sf_dir)
    return S.titles_by_text(W.title_requests(spark, sf_dir), films)


@query
def title_fragments(spark, sf_dir):
    """Empty, short and inner pieces of names as requests."""
    films, _ = W.stored_model(spark, sf_dir)
    return S.titles_by_text(W.fragment_requests(spark, sf_dir), films)


@query
def title_fragments_by_join(spark, sf_dir):
    """The route of many requests, with frequent trigrams dealt over several tasks."""
    films, _ = W.stored_model(spark, sf_dir)
    return S.titles_by_text(W.fragment_requests(spark, sf_dir), films, broadcast_rows=0, lookup_rows=50)


@query
def recommend_status(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    asked = W.labelled_items(spark, sf_dir)
    return S.recommend_status(asked, S.recommend(asked, films, model, W.ENCODER))


@query
def weight_sweep(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    asked = W.benchmark_requests(spark, sf_dir).select("qid", "query", "countries", "languages")
    return S.weight_sweep(asked, films, model, W.ENCODER, C.SWEEP)


@query
def clustered_search(spark, sf_dir):
    """Search over the components with sub-clusters."""
    films, model = W.stored_model(spark, sf_dir, subclusters=True)
    return _hits(S.batch_search(W.benchmark_requests(spark, sf_dir), films, model, W.ENCODER))


@query
def resolve_requests(spark, sf_dir):
    resolved = resolve_search(W.odd_requests(spark, sf_dir))
    weights = [fixed(F.col(c)).alias(c) for c in S.WEIGHT_COLUMNS]
    return resolved.select("qid", "error_code", *weights, "max_results", "min_rating", "year_from", "year_to", "k")


@query
def resolve_recommendations(spark, sf_dir):
    resolved = resolve_recommend(W.odd_requests(spark, sf_dir))
    weights = [fixed(F.col(c)).alias(c) for c in S.WEIGHT_COLUMNS]
    return resolved.select("qid", "error_code", "source", *weights, "max_results", "use_cultural_weights")


@query
def validate_requests(spark, sf_dir):
    asked = W.odd_requests(spark, sf_dir)
    searches = validate_search(asked).select("qid", F.lit("search").alias("kind"), "error_code", "error_message")
    items = validate_recommend(asked).select("qid", F.lit("recommend").alias("kind"), "error_code", "error_message")
    return searches.unionByName(items)


@query
def catalog_stats_(spark, sf_dir):
    films, model = W.stored_model(spark, sf_dir)
    return rounded(catalog_stats(films, model.vocab, model.dimension), "avg_rating")


@query
def cultural_match(spark, sf_dir):
    """Whether any country of each title is among those wanted."""
    wanted = F.array(F.lit("NATION_1"), F.lit("NATION_12"), F.lit("Nowhere"))
    return _light(spark, sf_dir).select("tid", S.cultural_match(F.col("country"), wanted).alias("match"))


# --- locale ----------------------------------------------------------------------------------------------------------


@query
def locale_languages(spark, sf_dir):
    located = L.with_languages(W.users(spark, sf_dir))
    return located.select("user_id", joined(F.col("languages")).alias("languages"))


@query
def timezone_country(spark, sf_dir):
    return L.from_timezone(W.users(spark, sf_dir)).select("user_id", "country", "code")


@query
def locale_preferences(spark, sf_dir):
    wanted = L.preferences(W.users(spark, sf_dir))
    return wanted.select(
        "user_id", joined(F.col("countries")).alias("countries"), joined(F.col("languages")).alias("languages")
    )


# --- flagship --------------------------------------------------------------------------------------------------------


@query
def top_titles(spark, sf_dir):
    """Titles ranked by final rating within their year."""
    fused = R.fuse_ratings(_rated(spark, sf_dir))
    score = fixed(F.col("final_rating"))
    order = Window.partitionBy("year").orderBy(F.desc("score"), "tid")
    ranked = fused.select("tid", "title", "year", score.alias("score")).withColumn("place", F.row_number().over(order))
    return ranked.filter(F.col("place") <= 10)

