"""Feature vectors of a title or a request, computed from its sorted active feature ordinals (``array<int>``)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import FeatureConfig
from .core import bind
from .vectors import dense, fit, multi_hot, zeros


def combo_text(active: Column) -> Column:
    """Canonical text of a combination: ``()``, ``(3,)``, ``(1, 2)``."""
    body = F.array_join(active.cast("array<string>"), ", ")
    return F.concat(F.lit("("), body, F.when(F.size(active) == 1, ",)").otherwise(")"))


def list_text(active: Column) -> Column:
    """Canonical list text: ``[1, 2]``."""
    return F.concat(F.lit("["), F.array_join(active.cast("array<string>"), ", "), F.lit("]"))


def hash_bytes(text: Column, count: int, strength: Column | float) -> Column:
    """The first ``count`` bytes of the md5 of ``text``, scaled to [0, strength]."""
    if count <= 0:
        return F.array().cast("array<double>")
    return bind(
        F.md5(text.cast("binary")),
        lambda digest: F.transform(
            F.sequence(F.lit(0), F.lit(count - 1)),
            lambda i: F.conv(F.substring(digest, i * 2 + 1, F.lit(2)), 16, 10).cast("double") / 255.0 * strength,
        ),
    )


def cluster_text(active: Column, cluster: Column) -> Column:
    return F.concat_ws("_", F.md5(combo_text(active).cast("binary")), cluster.cast("string"))


def cluster_count(members: Column, vocab_size: int, dim: int, per_cluster: int, at_least: int = 2) -> Column:
    """Number of sub-clusters of a group; 1 means the group is not clustered."""
    wanted = F.greatest(F.lit(at_least), F.floor(members / per_cluster))
    room = max(1, dim - vocab_size)
    return F.when(members <= 1, F.lit(1)).otherwise(F.least(members, wanted, F.lit(room))).cast("int")


def genre_vector(active: Column, vocab_size: int, dim: int) -> Column:
    """0/1 genre vector, padded or truncated."""
    return fit(multi_hot(active, min(vocab_size, dim)), dim)


def clustered_genre_vector(
    active: Column, cluster: Column, vocab_size: int, dim: int, cfg: FeatureConfig = FeatureConfig()
) -> Column:
    """Genre vector followed by a signature of its combination and sub-cluster, where room is left."""
    base = multi_hot(active, min(vocab_size, dim))
    room = min(dim - min(vocab_size, dim), cfg.genre_signature_dims)
    signature = hash_bytes(cluster_text(active, cluster), room, cfg.genre_signature_strength)
    return fit(F.concat(base, signature), dim)


def loc_vector(active: Column, dim: int, cfg: FeatureConfig = FeatureConfig()) -> Column:
    """Localisation vector. Wide vectors give each feature up to three fixed positions, narrow ones hold a hash of the set.

    A position takes the strongest signal that maps to it, so the order of features does not matter beyond the first
    few getting the third position.
    """
    if dim < cfg.direct_dim:
        vector = fit(hash_bytes(list_text(active), min(dim, cfg.small_dim_bytes), cfg.small_dim_strength), dim)
        return F.when(F.size(active) > 0, vector).otherwise(zeros(dim))

    half, quarter = dim // 2, dim // 4

    specs = [cfg.first_hash, cfg.second_hash, cfg.third_hash]
    levels = sorted({max(0.0, float(strength)) for _, _, strength in specs})

    def signals(features: Column, spec: tuple, width: int, start: int) -> Column:
        """Position and rank of the strength in one number, so that sorting puts the strongest of a position last."""
        factor, offset, strength = spec
        rank = levels.index(max(0.0, float(strength)))
        place = lambda f: F.pmod(f * factor + offset, F.lit(width)) + start
        return F.transform(features, lambda f: (place(f) * len(specs) + rank).cast("int"))

    def strongest(codes: Column) -> Column:
        place = lambda x: F.floor(x / len(specs)).cast("int")
        kept = F.filter(codes, lambda x, i: F.coalesce(place(F.get(codes, i + 1)) != place(x), F.lit(True)))
        strength = F.array(*[F.lit(level) for level in levels])
        return bind(
            kept,
            lambda k: dense(F.transform(k, place), F.transform(k, lambda x: F.get(strength, F.pmod(x, F.lit(len(specs))))), dim),
        )

    few = F.slice(active, 1, cfg.third_hash_features)
    every = F.concat(
        signals(active, cfg.first_hash, half, 0), signals(active, cfg.second_hash, half, half), signals(few, cfg.third_hash, quarter, 0)
    )
    return bind(F.sort_array(F.coalesce(every, F.array().cast("array<int>"))), strongest)


def clustered_loc_vector(
    active: Column, cluster: Column, clusters: Column, dim: int, cfg: FeatureConfig = FeatureConfig()
) -> Column:
    """Localisation vector whose last dimensions are overwritten by the sub-cluster id and its signature."""
    base = loc_vector(active, dim, cfg)
    if dim <= cfg.tail_dims:
        return base
    many = clusters.cast("double")
    identity = F.when(clusters > 1, cluster / (many - 1)).otherwise(0.0) * cfg.tail_id_strength
    signature = hash_bytes(
        cluster_text(active, cluster), cfg.tail_dims - 1, F.lit(cfg.tail_hash_strength) / F.greatest(many, F.lit(1.0))
    )
    return F.concat(F.slice(base, 1, dim - cfg.tail_dims), F.array(identity), signature)


def raw_popularity(votes: Column, cfg: FeatureConfig = FeatureConfig()) -> Column:
    """Popularity before rescaling: log term, plus a power term for the most voted titles."""
    v = F.coalesce(F.nanvl(votes.cast("double"), F.lit(0.0)), F.lit(0.0))
    lift = F.when(v > cfg.pop_high, F.pow(v, F.lit(cfg.pop_power))).otherwise(0.0)
    return F.log10((v + cfg.pop_epsilon) * cfg.pop_log_scale + cfg.pop_log_offset) + lift


def scaled_popularity(raw: Column, low: Column, high: Column, cfg: FeatureConfig = FeatureConfig()) -> Column:
    span = high - low
    stretched = (raw - low) / span * (cfg.pop_max - cfg.pop_min) + cfg.pop_min
    return F.when(span > cfg.pop_flat, stretched).otherwise(F.lit(1.0))
