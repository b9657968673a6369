"""From raw inputs to a searchable catalogue. Only results that later stages read again are written."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions.text import passage
from ..operators.eligibility import eligible_ids, first_keys, require_columns, searchable, with_plot
from ..operators.encoders import Encoder, encode_new
from ..operators.features import Model, build_model, genre_embeddings, join_embeddings, merged_embeddings
from ..operators.ratings import STAGE_COLUMNS, fuse_ratings, normalize_scalars
from ..operators.vocab import build_vocab
from ..session import cut_lineage
from ..sources.payloads import good_rows, parse_payloads, quarantine, require_good
from ..sources.tables import ModelStore, VersionedTable, write_parquet


def plot_embeddings(movies: DataFrame, encoder: Encoder) -> DataFrame:
    """``(tid, plot_embedding)`` of every title with a plot."""
    return encoder.encode(with_plot(movies), "tid", passage(F.col("plot")), "plot_embedding")


def new_plot_embeddings(movies: DataFrame, done: DataFrame, encoder: Encoder) -> DataFrame:
    """As :func:`plot_embeddings`, encoding only titles that ``done`` lacks."""
    return encode_new(with_plot(movies), done, encoder, "tid", passage(F.col("plot")), "plot_embedding")


def embed(
    movies: DataFrame,
    encoder: Encoder,
    cfg: FeatureConfig = FeatureConfig(),
    correlate: bool = True,
    merge: tuple[float, float] | None = None,
) -> DataFrame:
    """Plot and genre embeddings side by side, and their weighted merge if asked for."""
    require_columns(movies)
    plots = cut_lineage(plot_embeddings(movies, encoder))  # an expensive model runs once
    if plots.isEmpty():
        raise ValueError("no titles with a plot")
    vocab = cut_lineage(build_vocab(movies, {"genre": "genre"}))
    size = vocab.count()
    by_plot = plots.select("tid", F.col("plot_embedding").alias("plot")) if correlate else None
    both = join_embeddings(plots, genre_embeddings(movies, vocab, size, by_plot, cfg))
    return merged_embeddings(both, *merge) if merge else both


def ingest(
    ids: DataFrame, payloads: DataFrame, store: VersionedTable, limit: int | None = None, strict: bool = False
) -> DataFrame:
    """Parse payloads of keys not stored yet; the limit is applied to the keys before finished ones are removed."""
    wanted = first_keys(ids, limit) if limit is not None else ids

    def work(todo: DataFrame) -> DataFrame:
        parsed = parse_payloads(payloads.join(todo.select("tid"), "tid", "left_semi"))
        return require_good(parsed) if strict else good_rows(parsed)

    return store.resume(wanted, work)


def rejected(ids: DataFrame, payloads: DataFrame) -> DataFrame:
    return quarantine(parse_payloads(payloads.join(ids.select("tid"), "tid", "left_semi")))


def build_catalogue(
    spark: SparkSession,
    titles: DataFrame,
    ratings: DataFrame,
    payloads: DataFrame,
    encoder: Encoder,
    out: str,
    cfg: FeatureConfig = FeatureConfig(),
    subclusters: bool = True,
) -> tuple[DataFrame, Model]:
    """Run every stage and write its table below ``out``; returns searchable titles and the stored model."""

    def stage(df: DataFrame, name: str) -> DataFrame:
        write_parquet(df, f"{out}/{name}")
        return spark.read.parquet(f"{out}/{name}")

    ids = stage(eligible_ids(titles, ratings), "ids")
    movies = ingest(ids, payloads, VersionedTable(spark, f"{out}/movies"))
    processed = stage(normalize_scalars(fuse_ratings(movies), STAGE_COLUMNS), "movies_processed_sn")
    embeddings = stage(embed(processed, encoder, cfg, correlate=subclusters), "movies_embeddings")
    films = searchable(processed)
    model = build_model(films, embeddings.select("tid", "plot_embedding"), cfg, subclusters, genres=embeddings)
    store = ModelStore(spark, f"{out}/model")
    store.save(model)
    return films, store.load(cfg)
