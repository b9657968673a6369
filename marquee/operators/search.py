"""Weighted similarity search and recommendation for whole request tables.

A batch runs as follows. Requests are resolved, encoded and stored as a table. A first scan of the items (``scoring.top_k``) finds the
nearest plots of every request; the genre vectors made from them are stored beside the requests, and a second scan ranks the items.
Requests go to the items in rounds of bounded size, through Spark's broadcast.
"""

from __future__ import annotations

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.stat import Summarizer
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..functions.features import loc_vector
from ..functions.ids import text_from_key
from ..functions.parsing import list_from_array
from ..functions.text import item_query, passage
from ..functions.vectors import combine_components, zeros
from ..session import cut_lineage
from .encoders import Encoder
from .features import NORMS, PARTS, Model
from .requests import WEIGHT_NAMES, resolve_recommend, resolve_search
from .scoring import FILTERED, LIMITS, measure, top_k
from .vocab import active_features

WEIGHT_COLUMNS = [f"{name}_weight" for name in WEIGHT_NAMES]
GRAM = 3  # characters of the longest pieces of names in the title index


# --- request vectors -------------------------------------------------------------------------------------------------


def request_loc_vectors(requests: DataFrame, model: Model) -> DataFrame:
    """``(qid, loc)``: preference vector of each request, not normalised.

    Without countries and languages a neutral set is used at full strength; unknown values are ignored.
    """
    given = [list_from_array(F.col(name)) for name in ("countries", "languages")]
    neutral = (F.size(given[0]) == 0) & (F.size(given[1]) == 0)
    places = requests.select(
        "qid",
        F.when(neutral, _texts(C.NEUTRAL_COUNTRIES)).otherwise(given[0]).alias("country"),
        F.when(neutral, _texts(C.NEUTRAL_LANGUAGES)).otherwise(given[1]).alias("language"),
    )
    active = active_features(
        places,
        model.vocab,
        {"country": "country", "language": "language"},
        "active",
        key="qid",
        sizes={kind: model.sizes[kind] for kind in ("country", "language")},
    )
    return active.select("qid", loc_vector(F.col("active"), model.config.loc_dim, model.config).alias("loc"))


def _texts(values: list[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def encode_requests(requests: DataFrame, model: Model, encoder: Encoder) -> DataFrame:
    """``(qid, plot, loc, k, weights)`` of resolved requests. A text that the encoder has no vector for is a zero vector."""
    plot = encoder.encode(requests, "qid", passage(F.col("query")), "plot")
    cut = plot.select("qid", F.slice("plot", 1, model.config.plot_dim).alias("plot"))
    limits = [F.col(c).cast("double").alias(c) for c in LIMITS if c in requests.columns]
    kept = requests.select("qid", "k", *WEIGHT_COLUMNS, *limits)
    known = kept.join(cut, "qid", "left").join(request_loc_vectors(requests, model), "qid", "left")
    filled = {"plot": F.coalesce("plot", zeros(model.config.plot_dim)), "loc": F.coalesce("loc", zeros(model.config.loc_dim))}
    return known.withColumns(filled)


# --- scoring ---------------------------------------------------------------------------------------------------------


def neighbour_genres(encoded: DataFrame, model: Model) -> DataFrame:
    """``(qid, genre)``: softmax-weighted mean genre vector of the nearest plots of every request, in one job."""
    cfg = model.config
    asked = encoded.select("qid", F.lit(cfg.neighbours).alias("k"), "plot")
    near = top_k(model.components, asked, ["plot"], ["plot_n2"], cfg.plot_dim, model.sample)
    # the neighbours are the large side: a title near very many requests is a skewed key there, which the adaptive join splits
    gathered = near.join(model.components.select("tid", "genre"), "tid")
    weight = F.exp(F.col("similarity") * cfg.neighbour_sharpness)
    mean = Summarizer.mean(array_to_vector(F.col("genre").cast("array<double>")), weight)
    return gathered.groupBy("qid").agg(vector_to_array(mean).alias("genre"))


def _with_filtered(items: DataFrame | None, movies: DataFrame) -> DataFrame | None:
    """Components beside the title's columns that conditions read, written once."""
    return None if items is None else cut_lineage(items.join(movies.select("tid", *FILTERED), "tid"))


def _rank(encoded: DataFrame, model: Model, movies: DataFrame | None = None) -> tuple[DataFrame, int]:
    """Ranked items and the number of rows they can have at most. Conditions of requests hold before the ranking.

    The neighbours of all requests are found by a first scan; their genre vectors are stored with the requests, and the second scan
    reads that table.
    """
    cfg = model.config
    encoded = cut_lineage(encoded if movies is not None else encoded.drop(*LIMITS))  # read by both scans
    asked = encoded.join(neighbour_genres(encoded, model), "qid", "left")
    weights = F.array(*[F.col(c).cast("double") for c in WEIGHT_COLUMNS]).alias("weights")
    genre = F.coalesce("genre", zeros(cfg.genre_dim)).alias("genre")
    limits = [c for c in LIMITS if c in encoded.columns]
    asked = cut_lineage(asked.select("qid", "k", weights, "plot", genre, "loc", F.lit(C.QUERY_POPULARITY).alias("pop"), *limits))
    size = measure(asked)
    items, sample = model.components, model.sample
    if size.limited:
        items, sample = _with_filtered(items, movies), _with_filtered(sample, movies)
    else:
        asked = asked.drop(*LIMITS)
    return top_k(items, asked, PARTS, NORMS, model.dimension, sample, size), size.total


def rank_items(encoded: DataFrame, model: Model) -> DataFrame:
    """``(qid, tid, similarity, rank)``: the ``k`` best items of every encoded request.

    The similarity is the inner product of the weighted, concatenated and normalised vectors. It is computed from the
    parts (weights squared, stored squared norms), so no weighted copy of the items is ever made.
    """
    return _rank(encoded, model)[0]


# --- results ---------------------------------------------------------------------------------------------------------


def cultural_match(countries: Column, wanted: Column) -> Column:
    """Whether any country of the title is wanted; languages do not count."""
    return F.coalesce(F.arrays_overlap(list_from_array(countries), list_from_array(wanted)), F.lit(False))


def _first_per_request(df: DataFrame, limit: str = "max_results") -> DataFrame:
    """The best ranked rows of each request."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("rank"))
    return df.withColumn("_place", place).filter(F.col("_place") <= F.col(limit)).drop("_place")


def weighted_search(
    requests: DataFrame, movies: DataFrame, model: Model, encoder: Encoder, filtered: bool = False
) -> DataFrame:
    """Rank items for requests that carry ``qid, query, countries, languages, k`` and four weights.

    Returns the title's columns with ``qid, rank, similarity, cultural_match``. With ``filtered``, requests carry
    conditions on rating, votes and year; only titles that meet them are ranked, and an unknown value fails a condition
    that is set.
    """
    ranked, rows = _rank(encode_requests(requests, model, encoder), model, movies if filtered else None)
    if rows <= C.BROADCAST_RESULTS:
        ranked = F.broadcast(ranked)  # the titles are scanned, not shuffled
    wanted = requests.select("qid", F.col("countries").alias("_countries"))
    return (
        ranked.join(movies, "tid")
        .join(wanted, "qid")
        .withColumn("cultural_match", cultural_match(F.col("country"), F.col("_countries")))
        .drop("_countries")
    )


def search(resolved: DataFrame, movies: DataFrame, model: Model, encoder: Encoder) -> DataFrame:
    """Search for resolved requests: the ``max_results`` best of the titles that pass. Invalid requests give no rows."""
    return weighted_search(resolved.filter(F.col("error_code") == C.ERROR_NONE), movies, model, encoder, filtered=True)


def batch_search(
    requests: DataFrame, movies: DataFrame, model: Model, encoder: Encoder, zero_allowed: bool = False
) -> DataFrame:
    """Search for a raw request table."""
    return search(resolve_search(requests, zero_allowed), movies, model, encoder)


def search_simple(requests: DataFrame, movies: DataFrame, model: Model, encoder: Encoder, count: int = 10) -> DataFrame:
    """Plain query texts ``(qid, query)`` with default weights."""
    return batch_search(requests.select("qid", "query", F.lit(count).alias("max_results")), movies, model, encoder)


def item_requests(sources: DataFrame, movies: DataFrame) -> DataFrame:
    """Turn resolved recommendation requests (with key ``source``) into search requests built from the source title.

    With cultural weights the title's countries and languages become the preferences. Requests whose title is not in
    the catalogue drop out.
    """
    titles = movies.select(F.col("tid").alias("source"), "genre", "plot", "country", "language")
    sources = sources.select("qid", "source", "error_code", "use_cultural_weights", "max_results", *WEIGHT_COLUMNS)
    if sources.limit(C.BROADCAST_REQUESTS + 1).count() <= C.BROADCAST_REQUESTS:
        sources = F.broadcast(sources)  # the titles are scanned, not shuffled
    cultural = F.col("use_cultural_weights")
    none = F.array().cast("array<string>")
    wanted = F.col("max_results") + 1
    return sources.join(titles, "source").select(
        "qid",
        "source",
        "error_code",
        item_query(list_from_array(F.col("genre")), F.col("plot")).alias("query"),
        F.when(cultural, list_from_array(F.col("country"))).otherwise(none).alias("countries"),
        F.when(cultural, list_from_array(F.col("language"))).otherwise(none).alias("languages"),
        wanted.alias("max_results"),
        wanted.cast("int").alias("k"),
        *WEIGHT_COLUMNS,
        *[F.lit(None).cast(kind).alias(name) for name, kind in _NO_FILTERS.items()],
    )


_NO_FILTERS = {"min_rating": "double", "min_votes": "long", "year_from": "int", "year_to": "int"}


def recommend(requests: DataFrame, movies: DataFrame, model: Model, encoder: Encoder) -> DataFrame:
    """Titles similar to the title named by each request (``item_id``), without that title itself."""
    resolved = resolve_recommend(requests)
    # Written once: the requests are read several times below, and each reading would scan the titles again.
    asked = cut_lineage(item_requests(resolved.filter(F.col("error_code") == C.ERROR_NONE), movies))
    found = search(asked, movies, model, encoder)
    limits = asked.select("qid", "source", (F.col("max_results") - 1).alias("_limit"))
    others = found.join(limits, "qid").filter(F.col("tid") != F.col("source"))
    return _first_per_request(others, "_limit").drop("_limit", "source")


def _grams(name: Column, size: int) -> Column:
    """All substrings of ``size`` characters."""
    places = F.sequence(F.lit(1), F.length(name) - size + 1)
    cut = F.transform(places, lambda i: F.substring(name, i, F.lit(size)))
    return F.when(F.length(name) >= size, cut).otherwise(F.array().cast("array<string>"))


def _names(movies: DataFrame) -> DataFrame:
    return movies.select("tid", F.lower("title").alias("name")).filter(F.col("name").isNotNull())


def title_grams(movies: DataFrame) -> DataFrame:
    """``(gram, n, first)``: for every piece of one to three characters, the number of titles that hold it and the smallest key.

    It depends on the titles alone, so it can be stored beside the model and passed to :func:`titles_by_text`.
    """
    name = F.col("name")
    pieces = F.array_distinct(F.concat(*[_grams(name, size) for size in range(1, GRAM + 1)]))
    held = _names(movies).select("tid", F.explode(pieces).alias("gram"))
    return held.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), F.min("tid").alias("first"))


def titles_by_text(
    requests: DataFrame, movies: DataFrame, index: DataFrame | None = None, broadcast_rows: int | None = None, lookup_rows: int | None = None
) -> DataFrame:
    """``(qid, tid)``: the first title (smallest key) whose name contains the request's ``title``, ignoring case.

    The empty text is in every name: one minimum answers it. Texts of up to three characters are entries of the index of pieces
    (:func:`title_grams`), which names their first title. A longer text is looked up by the rarest of its trigrams, and dropped if one of
    them is in no title: only names that hold that trigram are tested. A trigram held by more than ``lookup_rows`` names is dealt
    over several tasks. Equal texts are looked up once. Up to ``broadcast_rows`` texts are sent to the names; more are joined by
    trigram.
    """
    limit = C.BROADCAST_REQUESTS if broadcast_rows is None else broadcast_rows
    wanted = requests.select("qid", F.lower("title").alias("wanted")).filter(F.col("wanted").isNotNull())
    names = _names(movies)
    index = cut_lineage(title_grams(movies)) if index is None else index
    texts = cut_lineage(wanted.select("wanted").distinct())

    whole = texts.filter("wanted = ''").withColumn("tid", names.agg(F.min("tid")).scalar())
    short = texts.join(index, (F.col("wanted") == F.col("gram")) & (F.length("wanted") <= GRAM)).select("wanted", F.col("first").alias("tid"))

    longer = texts.filter(F.length("wanted") > GRAM).select("wanted", F.explode(F.array_distinct(_grams(F.col("wanted"), GRAM))).alias("gram"))
    rarest = longer.join(index, "gram", "left").groupBy("wanted").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("rarest"))
    anchored = cut_lineage(rarest.select("wanted", "rarest.gram", "rarest.n").filter("n > 0"))
    postings = names.select("tid", "name", F.explode(F.array_distinct(_grams(F.col("name"), GRAM))).alias("gram"))
    found = F.contains(F.col("name"), F.col("wanted"))
    if anchored.limit(limit + 1).count() <= limit:
        hits = postings.join(F.broadcast(anchored.select("wanted", "gram")), "gram").filter(found)
    else:
        # at most 10 000 trigrams can each be a ten-thousandth of all postings
        total = index.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first().n
        least = max(lookup_rows or C.LOOKUP_ROWS, total // 10_000)
        hot = anchored.filter(F.col("n") > least).select("gram", F.ceil(F.col("n") / least).cast("int").alias("salts")).distinct()
        dealt = lambda df, salt: df.join(F.broadcast(hot), "gram", "left").withColumn("salt", salt).drop("salts")
        own = F.pmod(F.xxhash64("tid"), F.coalesce("salts", F.lit(1))).cast("int")
        every = F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))
        asked = dealt(anchored.select("wanted", "gram"), every)
        hits = dealt(postings.join(anchored.select("gram").distinct(), "gram", "left_semi"), own).join(asked, ["gram", "salt"]).filter(found)
    answers = whole.select("wanted", "tid").unionByName(short).unionByName(hits.select("wanted", "tid"))
    answers = answers.filter("tid is not null").groupBy("wanted").agg(F.min("tid").alias("tid"))
    return wanted.join(answers, "wanted").select("qid", "tid")


def recommend_by_title(requests: DataFrame, movies: DataFrame, model: Model, encoder: Encoder) -> DataFrame:
    """As :func:`recommend`, for requests that name a ``title``. Requests without a match give no rows."""
    keys = titles_by_text(requests, movies).select("qid", text_from_key(F.col("tid")).alias("item_id"))
    options = requests.drop("title", *[c for c in ("item_id",) if c in requests.columns])
    return recommend(options.join(keys, "qid"), movies, model, encoder)


def recommend_status(requests: DataFrame, found: DataFrame) -> DataFrame:
    """``(qid, error_code)`` of recommendation requests: an empty answer is an error here, unlike in search."""
    answered = found.select("qid").distinct().withColumn("_answered", F.lit(True))
    checked = resolve_recommend(requests).join(answered, "qid", "left")
    code = F.when(
        (F.col("error_code") == C.ERROR_NONE) & F.col("_answered").isNull(), F.lit(C.ERROR_NOT_FOUND)
    ).otherwise(F.col("error_code"))
    return checked.select("qid", code.alias("error_code"))


def weight_sweep(
    queries: DataFrame, movies: DataFrame, model: Model, encoder: Encoder, configs: dict[str, C.Weights], k: int = 10
) -> DataFrame:
    """Run every query under every weight setting in one batch; count cultural matches among the ``k`` best.

    ``queries``: ``qid, query, countries, languages``.
    """
    settings = F.array(
        *[
            F.struct(
                F.lit(name).alias("setting"),
                F.lit(i).alias("number"),
                *[F.lit(getattr(w, part)).alias(f"{part}_weight") for part in WEIGHT_NAMES],
            )
            for i, (name, w) in enumerate(configs.items())
        ]
    )
    swept = queries.withColumn("s", F.explode(settings)).select(
        (F.col("qid") * len(configs) + F.col("s.number")).alias("qid"),
        F.col("qid").alias("base_qid"),
        "query",
        "countries",
        "languages",
        F.lit(k).alias("k"),
        "s.setting",
        *[f"s.{c}" for c in WEIGHT_COLUMNS],
    )
    found = weighted_search(swept, movies.select("tid", "country"), model, encoder)
    named = found.join(swept.select("qid", "base_qid", "setting"), "qid")
    return named.groupBy(F.col("base_qid").alias("qid"), "setting").agg(
        F.sum(F.col("cultural_match").cast("int")).alias("matches"), F.count("*").alias("results")
    )


def project_results(found: DataFrame) -> DataFrame:
    """The result record of the interface; unknown values become 0, empty text or an empty list."""
    poster = F.col("poster") if "poster" in found.columns else F.lit(None)

    def text(c: Column) -> Column:
        return F.coalesce(c.cast("string"), F.lit(""))

    def number(name: str, kind: str) -> Column:
        return F.coalesce(F.col(name).cast(kind), F.lit(0).cast(kind))

    return found.select(
        "qid",
        "rank",
        "tid",
        text_from_key(F.col("tid")).alias("imdb_id"),
        text(F.col("title")).alias("title"),
        number("year", "int").alias("year"),
        number("final_rating", "double").alias("rating"),
        number("votes", "long").alias("votes"),
        number("sn_votes", "double").alias("popularity_score"),
        list_from_array(F.col("country")).alias("countries"),
        list_from_array(F.col("language")).alias("languages"),
        list_from_array(F.col("genre")).alias("genres"),
        text(F.col("plot")).alias("plot"),
        text(poster).alias("poster"),
        "similarity",
        "cultural_match",
    )


def materialized_vector(components: DataFrame, weights: C.Weights) -> DataFrame:
    """``(tid, combined)``: the weighted unit vector of every item, for export."""
    combined = combine_components(F.col("plot"), F.col("genre"), F.col("loc"), F.col("pop"), weights)
    return components.select("tid", combined.alias("combined"))
