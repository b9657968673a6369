"""Embedding and component tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import FeatureConfig
from ..functions import features as V
from ..functions.core import one_row
from ..functions.vectors import fit, l2_normalize, merge_weighted, squared_norm
from ..session import cut_lineage
from .kmeans import group_plan, grouped_kmeans
from .vocab import active_features, build_vocab

LOC_COLUMNS = {"country": "country", "language": "language"}
GENRE_COLUMNS = {"genre": "genre"}
PARTS = ["plot", "genre", "loc", "pop"]
NORMS = ["plot_n2", "genre_n2", "loc_n2", "pop_n2"]


@dataclass
class Model:
    """What requests need to know about a built catalogue."""

    components: DataFrame
    vocab: DataFrame
    sizes: dict[str, int]
    config: FeatureConfig
    sample: DataFrame | None = None  # some of the components, to bound scores before the full scan

    @property
    def dimension(self) -> int:
        return self.config.plot_dim + self.config.genre_dim + self.config.loc_dim + 1


def with_popularity(movies: DataFrame, cfg: FeatureConfig = FeatureConfig()) -> DataFrame:
    """Add ``pop`` from ``sn_votes``; a catalogue without that column gets a uniform 1."""
    if "sn_votes" not in movies.columns:
        return movies.withColumn("pop", F.lit(1.0))
    raw = V.raw_popularity(F.col("sn_votes"), cfg)
    bounds = one_row(movies, F.min(raw).alias("low"), F.max(raw).alias("high"))
    scaled = V.scaled_popularity(raw, F.col("_bounds.low"), F.col("_bounds.high"), cfg)
    return movies.withColumn("_bounds", bounds).withColumn("pop", scaled).drop("_bounds")


def _clusters(vocab: int, dim: int, per_cluster: int, cfg: FeatureConfig) -> Column:
    return V.cluster_count(F.col("members"), vocab, dim, per_cluster, cfg.min_clusters)


def subcluster_plan(points: DataFrame, vocab: int, dim: int, per_cluster: int, cfg: FeatureConfig) -> DataFrame:
    """Members and number of sub-clusters of each combination ``grp``."""
    return group_plan(points, _clusters(vocab, dim, per_cluster, cfg))


def _subclusters(
    active: DataFrame, plots: DataFrame, vocab: int, dim: int, per_cluster: int, cfg: FeatureConfig
) -> DataFrame | None:
    """Sub-cluster of every member of a clustered combination, or None when the dimensions leave no room for any."""
    room = max(1, dim - vocab)
    if room <= 1:
        return None
    points = active.select("tid", F.col("active").alias("grp")).join(plots.select("tid", F.col("plot").alias("v")), "tid")
    return grouped_kmeans(points, _clusters(vocab, dim, per_cluster, cfg), room).select("tid", "cluster", "k")


def _vectors(rows: DataFrame, labels: DataFrame | None, plain: Column, rich: Column, out: str) -> DataFrame:
    """Add ``out``: the clustered vector of rows with a label, the plain one of the others."""
    if labels is None:
        return rows.withColumn(out, plain)
    labelled = rows.join(labels, "tid", "left")
    vector = F.when(F.col("cluster").isNotNull(), rich).otherwise(plain)
    return labelled.withColumn(out, vector).drop("cluster", "k")


def add_genre_vectors(rows: DataFrame, size: int, plots: DataFrame | None, cfg: FeatureConfig) -> DataFrame:
    """Replace ``active_genre`` by the normalised ``genre_embedding``; ``plots(tid, plot)`` switch sub-clusters on."""
    active = F.col("active_genre")
    labels = None
    if plots is not None:
        sets = rows.select("tid", active.alias("active"))
        labels = _subclusters(sets, plots, size, cfg.genre_dim, cfg.genre_members_per_cluster, cfg)
    plain = V.genre_vector(active, size, cfg.genre_dim)
    rich = V.clustered_genre_vector(active, F.col("cluster"), size, cfg.genre_dim, cfg)
    vectors = _vectors(rows, labels, plain, rich, "genre_embedding")
    return vectors.withColumn("genre_embedding", l2_normalize(F.col("genre_embedding"))).drop("active_genre")


def add_loc_vectors(rows: DataFrame, size: int, plots: DataFrame | None, cfg: FeatureConfig) -> DataFrame:
    """Replace ``active_loc`` by ``loc`` (not normalised); ``plots(tid, plot)`` switch sub-clusters on."""
    active = F.col("active_loc")
    labels = None
    if plots is not None:
        sets = rows.select("tid", active.alias("active"))
        labels = _subclusters(sets, plots, size, cfg.loc_dim, cfg.loc_members_per_cluster, cfg)
    plain = V.loc_vector(active, cfg.loc_dim, cfg)
    rich = V.clustered_loc_vector(active, F.col("cluster"), F.col("k"), cfg.loc_dim, cfg)
    return _vectors(rows, labels, plain, rich, "loc").drop("active_loc")


def genre_embeddings(
    movies: DataFrame,
    vocab: DataFrame,
    size: int,
    plots: DataFrame | None = None,
    cfg: FeatureConfig = FeatureConfig(),
) -> DataFrame:
    """``(tid, genre_embedding)``, normalised; with ``plots(tid, plot)`` combinations are split by plot similarity."""
    known = movies.filter(F.col("genre").isNotNull()).select("tid", "genre")
    rows = active_features(known, vocab, GENRE_COLUMNS, "active_genre", sizes={"genre": size})
    return add_genre_vectors(rows.select("tid", "active_genre"), size, plots, cfg)


def join_embeddings(plots: DataFrame, genres: DataFrame) -> DataFrame:
    """All keys of both embeddings, each with what it has."""
    return plots.join(genres, "tid", "full")


def merged_embeddings(embeddings: DataFrame, plot_weight: float, genre_weight: float) -> DataFrame:
    """Add ``combined_embedding`` to rows of ``(plot_embedding, genre_embedding)``."""
    return embeddings.withColumn(
        "combined_embedding",
        merge_weighted(F.col("plot_embedding"), F.col("genre_embedding"), plot_weight, genre_weight),
    )


def _stored(v: Column, dim: int) -> Column:
    """Truncated unit vector as stored: single precision halves what every search reads."""
    cut = F.slice(v, 1, dim)
    return F.coalesce(l2_normalize(cut), F.array_repeat(F.lit(0.0), dim)).cast("array<float>")


def component_table(rows: DataFrame, cfg: FeatureConfig) -> DataFrame:
    """``(tid, plot, genre, loc, pop)`` with squared norms, from rows of ``plot_embedding, genre_embedding, loc, pop``.

    ``pop`` keeps its magnitude on purpose; a missing genre vector counts as zero.
    """
    genre = fit(F.coalesce("genre_embedding", F.array().cast("array<double>")), cfg.genre_dim)
    stored = rows.select(
        "tid",
        _stored(F.col("plot_embedding"), cfg.plot_dim).alias("plot"),
        _stored(genre, cfg.genre_dim).alias("genre"),
        _stored(F.col("loc"), cfg.loc_dim).alias("loc"),
        "pop",
    )
    return stored.select(
        "*",
        squared_norm(F.col("plot")).alias("plot_n2"),
        squared_norm(F.col("genre")).alias("genre_n2"),
        squared_norm(F.col("loc")).alias("loc_n2"),
        (F.col("pop") * F.col("pop")).alias("pop_n2"),
    )


def build_vocabularies(movies: DataFrame) -> DataFrame:
    """Country, language and genre vocabularies in one pass."""
    return build_vocab(movies, LOC_COLUMNS | GENRE_COLUMNS)


def vocabulary_sizes(vocab: DataFrame) -> dict[str, int]:
    """Entries per kind: three numbers to the driver, which fix vector lengths."""
    sizes = {row["kind"]: row["n"] for row in vocab.groupBy("kind").agg(F.count("*").alias("n")).collect()}
    return {kind: sizes.get(kind, 0) for kind in ("country", "language", "genre")}


def quality_check(movies: DataFrame, components: DataFrame) -> DataFrame:
    """One row: titles, components, and titles that lack a component row."""
    titles = movies.select("tid", F.lit(1).alias("t"))
    parts = components.select("tid", F.lit(1).alias("c"))
    return titles.join(parts, "tid", "full").agg(
        F.count("t").alias("titles"),
        F.count("c").alias("components"),
        F.count_if(F.col("t").isNotNull() & F.col("c").isNull()).alias("missing"),
    )


def build_model(
    movies: DataFrame,
    plots: DataFrame,
    cfg: FeatureConfig = FeatureConfig(),
    subclusters: bool = True,
    vocab: DataFrame | None = None,
    genres: DataFrame | None = None,
) -> Model:
    """Components and vocabularies of searchable ``movies`` with plot vectors ``plots(tid, plot_embedding)``.

    ``genres(tid, genre_embedding)`` are computed here unless an earlier stage has stored them.
    """
    # Vocabularies are small and read several times below: written once, not recomputed from the catalogue.
    vocab = cut_lineage(build_vocabularies(movies) if vocab is None else vocab)
    sizes = vocabulary_sizes(vocab)
    by_plot = plots.select("tid", F.col("plot_embedding").alias("plot")) if subclusters else None
    loc_sizes = {kind: sizes[kind] for kind in LOC_COLUMNS}
    # Everything a title's own columns determine is computed in place; plots, labels and stored genre vectors are joined
    # on the same key one after the other, so the titles are laid out by key once.
    rows = with_popularity(movies, cfg)
    rows = active_features(rows, vocab, LOC_COLUMNS, "active_loc", sizes=loc_sizes)
    if genres is None:
        rows = active_features(rows, vocab, GENRE_COLUMNS, "active_genre", sizes={"genre": sizes["genre"]})
        rows = rows.select("tid", "pop", "active_loc", "active_genre")
        rows = add_genre_vectors(rows.join(plots.select("tid", "plot_embedding"), "tid"), sizes["genre"], by_plot, cfg)
    else:
        stored = plots.select("tid", "plot_embedding").join(genres.select("tid", "genre_embedding"), "tid", "left")
        rows = rows.select("tid", "pop", "active_loc").join(stored, "tid")
    rows = add_loc_vectors(rows, sum(loc_sizes.values()), by_plot, cfg)
    return Model(component_table(rows, cfg), vocab, sizes, cfg)
