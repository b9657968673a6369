"""Catalogue, payload, request and user tables derived from the given star-schema tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import PRESETS, FeatureConfig
from ..functions.core import fixed
from ..functions.ids import text_from_key
from ..operators.eligibility import searchable
from ..operators.encoders import HashEncoder
from ..operators.features import Model, build_model
from ..operators.ratings import STAGE_COLUMNS, fuse_ratings, normalize_scalars
from ..session import cut_lineage, scratch_path
from ..sources.tables import ModelStore, read_parquet, read_spread, write_parquet
from .build import plot_embeddings

PLOT_DIM = 64
SEARCH_CONFIG = FeatureConfig(plot_dim=PLOT_DIM, genre_dim=32, loc_dim=128)
ENCODER = HashEncoder(PLOT_DIM)
USER_COUNTRIES = ["Hong Kong", "Canada", "Switzerland", "United Kingdom", "KR", "Atlantis", "Brazil", "South Africa", ""]
USER_CODES = ["HK", "CA", "GB", "US", "BE", "XX", "IN"]
USER_REGIONS = ["Quebec", "Scotland", "Catalonia", "Macau", "Nowhere"]
USER_ZONES = ["Europe/Paris", "Asia/Tokyo", "America/Chicago", "Mars/Olympus"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_parquet(spark, f"{sf_dir}/{name}.parquet")


def spread_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_spread(spark, f"{sf_dir}/{name}.parquet")


def titles(spark: SparkSession, sf_dir: str, ratings: bool = True, locale: bool = True, plots: bool = True) -> DataFrame:
    """One title per part. Only the joins a caller needs are planned."""
    parts = spread_table(spark, sf_dir, "part").withColumn("tid", F.col("p_partkey"))
    columns = [
        "tid",
        F.col("p_name").alias("title"),
        F.col("p_size").alias("runtime"),
        F.concat(F.array("p_type"), F.split("p_name", " ")).alias("genre"),
    ]
    if ratings:
        parts = parts.join(_line_totals(spark, sf_dir), "tid", "left")
        key, lines = F.col("tid"), F.col("n_lines")
        columns += [
            (F.col("year_max") - key % 40).cast("int").alias("year"),
            F.when(key % 11 != 0, F.floor(F.col("quantity").cast("double") / lines * 2) / 10).alias("rating"),
            F.when(key % 7 == 0, F.lit(0)).otherwise(lines).alias("votes"),
            F.when(key % 3 != 0, F.floor(F.col("discount").cast("double") * 10 / lines)).cast("int").alias("metascore"),
            F.col("quantity"),
        ]
    if locale:
        parts = parts.join(_places(spark, sf_dir), "tid", "left")
        columns += ["country", "language"]
    made = parts.select(*columns)
    return _with_plots(spark, sf_dir, made) if plots else made


def _with_plots(spark: SparkSession, sf_dir: str, parts: DataFrame) -> DataFrame:
    # few facts are sent to the texts, so what is written of a joined title lies as the texts are read
    texts = spread_table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), F.col("text").alias("plot"))
    return parts.join(texts, "tid", "left")


def _line_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy(F.col("l_partkey").alias("tid"))
        .agg(
            F.count("*").alias("n_lines"),
            F.max(F.year("l_shipdate")).alias("year_max"),
            F.sum(F.col("l_quantity").cast("long")).alias("quantity"),
            F.sum(F.round(F.col("l_discount") * 100).cast("long")).alias("discount"),
        )
    )


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of the nations and regions of each part's suppliers.

    Lines are reduced to keys of parts and nations, laid out by part once and made distinct there; names come last, so sets of
    texts are never shuffled.
    """
    nations = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey")
    lines = table(spark, sf_dir, "lineitem").join(suppliers, F.col("l_suppkey") == F.col("s_suppkey"))
    pairs = lines.select(F.col("l_partkey").alias("tid"), "s_nationkey").repartition("tid").distinct()
    return (
        pairs.join(F.broadcast(nations.select("n_nationkey", "n_name", "r_name")), F.col("s_nationkey") == F.col("n_nationkey"))
        .groupBy("tid")
        .agg(
            F.sort_array(F.collect_set("n_name")).alias("country"),
            F.sort_array(F.collect_set("r_name")).alias("language"),
        )
    )


def processed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles after rating fusion and scaling.

    All but the plots is written once, as the means and bounds of all titles read it again; the texts are shuffled once.
    """
    facts = cut_lineage(titles(spark, sf_dir, plots=False))
    return normalize_scalars(fuse_ratings(_with_plots(spark, sf_dir, facts)), STAGE_COLUMNS)


def given_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(
        F.col("vec_id").alias("tid"), F.col("embedding").alias("plot_embedding"), "label"
    )


# --- payloads --------------------------------------------------------------------------------------------------------


def loose_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Title values in the loose text forms that the parsers have to read, one row per part."""
    key = F.col("tid")
    base = titles(spark, sf_dir, locale=False, plots=False)
    minutes = F.col("runtime").cast("string")
    hours = F.floor(F.col("runtime") / 60).cast("string")
    rest = (F.col("runtime") % 60).cast("string")
    return base.select(
        "tid",
        F.when(key % 9 == 0, "N/A")
        .when(key % 9 == 1, F.concat(F.lit("  "), F.col("title"), F.lit(" ")))
        .otherwise(F.col("title"))
        .alias("title_text"),
        F.when(key % 8 == 0, F.concat(F.col("year").cast("string"), F.lit("–"), (F.col("year") + 4).cast("string")))
        .when(key % 8 == 1, "")
        .otherwise(F.col("year").cast("string"))
        .alias("year_text"),
        F.when(key % 7 == 0, F.concat(hours, F.lit("h "), rest, F.lit("min")))
        .when(key % 7 == 1, F.concat(minutes, F.lit(" min")))
        .when(key % 7 == 2, minutes)
        .when(key % 7 == 3, F.concat(minutes, F.lit("H")))
        .when(key % 7 == 4, F.concat(F.lit("1,0"), minutes, F.lit(" min")))
        .when(key % 7 == 5, "unknown")
        .otherwise("N/A")
        .alias("runtime_text"),
        F.concat_ws(", ", "genre").alias("genre_text"),
        F.concat(F.lit(" "), F.concat_ws(" & ", "genre"), F.lit(" &  & ")).alias("awards_text"),
        F.when(key % 10 == 0, "N/A")
        .when(key % 10 == 1, "nan")
        .when(key % 10 == 2, "ten")
        .otherwise(F.col("rating").cast("string"))
        .alias("rating_text"),
        F.when(key % 6 == 0, "N/A")
        .otherwise(F.concat((F.col("votes") % 9 + 1).cast("string"), F.lit(","), F.lpad((key % 1000).cast("string"), 3, "0")))
        .alias("votes_text"),
        F.coalesce(F.col("metascore").cast("string"), F.lit("N/A")).alias("metascore_text"),
        _pick(["PG-13", " R ", "N/A", "", "TV-14"], key).alias("rated_text"),
        F.when(key % 4 == 0, "N/A").otherwise(F.array_join(F.slice("genre", 2, 2), ", ")).alias("director_text"),
        F.array_join(F.slice("genre", 3, 9), " , ,").alias("actors_text"),
        F.when(key % 5 == 0, "N/A").otherwise(F.concat(F.lit("posters/"), key.cast("string"), F.lit(".jpg"))).alias("poster_text"),
    )


def payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One payload per title, with every key: mostly good, some reporting an error, some broken."""
    key = F.col("tid")
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("tid"), "text")
    record = F.to_json(
        F.struct(
            F.when(key % 13 == 0, "False").otherwise("True").alias("Response"),
            F.when(key % 26 == 0, "Incorrect id.").alias("Error"),
            F.col("title_text").alias("Title"),
            F.col("year_text").alias("Year"),
            F.col("rated_text").alias("Rated"),
            F.col("runtime_text").alias("Runtime"),
            F.col("genre_text").alias("Genre"),
            F.col("director_text").alias("Director"),
            F.col("actors_text").alias("Actors"),
            F.coalesce("text", F.lit("N/A")).alias("Plot"),
            F.concat_ws(", ", "language").alias("Language"),
            F.when(key % 12 == 0, "N/A").otherwise(F.concat_ws(", ", "country")).alias("Country"),
            F.col("awards_text").alias("Awards"),
            F.col("poster_text").alias("Poster"),
            F.col("rating_text").alias("imdbRating"),
            F.col("votes_text").alias("imdbVotes"),
            F.col("metascore_text").alias("Metascore"),
        )
    )
    raw = F.when(key % 17 == 0, F.concat(F.lit("{"), F.substring(F.col("title_text"), 1, 3))).otherwise(record)
    whole = loose_texts(spark, sf_dir).join(texts, "tid", "left").join(_places(spark, sf_dir), "tid", "left")
    return whole.select("tid", raw.alias("raw"))


def raw_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles and ratings in the form of the raw dumps, side by side."""
    key = F.col("tid")
    return titles(spark, sf_dir, locale=False, plots=False).select(
        "tid",
        text_from_key(key).alias("tconst"),
        F.when(key % 5 == 0, "tvSeries").when(key % 5 == 1, "tvMovie").otherwise("movie").alias("titleType"),
        F.when(key % 19 != 0, F.col("year")).alias("startYear"),
        F.col("rating").alias("averageRating"),
        (F.col("quantity") * 4).alias("numVotes"),
    )


# --- requests --------------------------------------------------------------------------------------------------------


def _pick(values: list[str], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index % len(values) + 1).cast("int"))


def benchmark_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One search request per benchmark text, with varied options."""
    key = F.col("item_id")
    presets = [*PRESETS, ""]
    nation = F.concat(F.lit("NATION_"), (key % 30).cast("string"))
    return table(spark, sf_dir, "benchmark").select(
        key.cast("long").alias("qid"),
        F.col("text").alias("query"),
        F.when(key % 4 != 0, F.array(nation, F.lit("NATION_7"))).alias("countries"),
        F.when(key % 3 != 0, F.array(F.lit("ASIA"), F.lit("Klingon"))).alias("languages"),
        (key % 5 * 15).cast("int").alias("max_results"),
        F.when(key % 3 == 0, F.lit(0.5)).alias("min_rating"),
        F.when(key % 4 == 1, F.lit(20)).cast("long").alias("min_votes"),
        F.when(key % 5 == 2, F.lit(1980)).cast("int").alias("year_from"),
        F.when(key % 7 == 3, F.lit(1990)).cast("int").alias("year_to"),
        _pick(presets, key).alias("preset"),
        F.when(key % 6 == 1, F.lit(0.9)).alias("plot_weight"),
        F.when(key % 6 == 2, F.lit(0.0)).alias("popularity_weight"),
    )


def conversation_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every turn of every conversation as a plain query."""
    return spread_table(spark, sf_dir, "conversations").select(
        (F.col("conv_id") * 1000 + F.col("turn")).cast("long").alias("qid"), F.col("text").alias("query")
    )


def odd_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests of both kinds with many invalid values, one per conversation turn."""
    key = F.col("conv_id") * 1000 + F.col("turn")
    return table(spark, sf_dir, "conversations").select(
        key.cast("long").alias("qid"),
        F.when(key % 5 == 0, F.lit(" \t")).when(key % 11 == 0, F.lit(None)).otherwise(F.col("text")).alias("query"),
        _pick(["tt0000012", "xx", "tt", "", "tt12345678", "tt1x", "tt0000007"], key).alias("item_id"),
        (key % 9 - 2).cast("int").alias("max_results"),
        (key % 13 - 1).cast("double").alias("min_rating"),
        _pick([*PRESETS, "other", ""], key).alias("preset"),
        F.when(key % 4 == 1, F.lit(0.33)).when(key % 4 == 2, F.lit(0.0)).alias("genre_weight"),
        F.when(key % 6 == 0, F.lit(1975)).cast("int").alias("year_from"),
        F.when(key % 10 == 0, F.lit(1999)).cast("int").alias("year_to"),
        (key % 2 == 0).alias("use_cultural_weights"),
    )


def labelled_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recommendation request per labelled document."""
    return table(spark, sf_dir, "labels").select(
        F.col("doc_id").alias("qid"),
        text_from_key(F.col("doc_id")).alias("item_id"),
        (F.col("quality") == 1).alias("use_cultural_weights"),
        F.when(F.col("toxic") == 1, F.lit(5)).cast("int").alias("max_results"),
    )


def title_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One recommendation request per distinct part name, in capitals."""
    return (
        table(spark, sf_dir, "part")
        .groupBy("p_name")
        .agg(F.min("p_partkey").alias("qid"))
        .select("qid", F.upper("p_name").alias("title"), F.lit(True).alias("use_cultural_weights"))
    )


def fragment_requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One title request per part: up to eight characters from inside its name, none for every ninth."""
    key = F.col("p_partkey")
    cut = F.substring(F.upper("p_name"), (1 + key % 7).cast("int"), (key % 9).cast("int"))
    return table(spark, sf_dir, "part").select(key.cast("long").alias("qid"), cut.alias("title"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One located user per user of the events table."""
    key = F.col("user_id")
    return (
        table(spark, sf_dir, "events")
        .select("user_id")
        .distinct()
        .select(
            "user_id",
            F.when(key % 10 != 9, _pick(USER_COUNTRIES, key)).alias("country"),
            F.when(key % 3 != 2, _pick(USER_CODES, key)).alias("code"),
            F.when(key % 4 != 3, _pick(USER_REGIONS, key)).alias("region"),
            _pick(USER_ZONES, key).alias("tz"),
        )
    )


# --- the search catalogue --------------------------------------------------------------------------------------------

_built: dict[tuple, tuple[DataFrame, Model]] = {}


def search_model(
    spark: SparkSession, sf_dir: str, subclusters: bool = False, cfg: FeatureConfig = SEARCH_CONFIG
) -> tuple[DataFrame, Model]:
    """Searchable titles and components, from the raw tables. Plots are encoded by the hashed bag of words."""
    films = cut_lineage(searchable(processed(spark, sf_dir)))
    return films, build_model(films, plot_embeddings(films, ENCODER), cfg, subclusters)


def stored_model(spark: SparkSession, sf_dir: str, subclusters: bool = False) -> tuple[DataFrame, Model]:
    """The catalogue as a search service holds it: built once per application, written, then only read."""
    key = (spark.sparkContext.applicationId, sf_dir, subclusters)
    if key not in _built:
        root = scratch_path(spark, "catalogue")
        write_parquet(searchable(processed(spark, sf_dir)), f"{root}/films")
        films = read_parquet(spark, f"{root}/films")
        store = ModelStore(spark, root)
        store.save(build_model(films, cut_lineage(plot_embeddings(films, ENCODER)), SEARCH_CONFIG, subclusters))
        _built[key] = (films, store.load(SEARCH_CONFIG))
    return _built[key]


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: fixed(F.col(c)) for c in columns})
