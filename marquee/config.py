"""Weights, presets and feature settings."""

from __future__ import annotations

from dataclasses import dataclass

# ---------------------------------------------------------------------------------------------------------------------
# Results depend on them, so they are stated as they are.
# ---------------------------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Weights:
    """Weight of each component in the similarity."""

    plot: float
    genre: float
    localization: float
    popularity: float


SEARCH_WEIGHTS = Weights(0.5, 0.25, 0.1, 0.15)
RECOMMEND_WEIGHTS = Weights(0.44, 0.13, 0.1, 0.33)
LOW_LEVEL_WEIGHTS = Weights(0.5, 0.25, 0.05, 0.2)

PRESETS = {
    "balanced": Weights(0.57, 0.15, 0.07, 0.16),
    "popular": Weights(0.515, 0.215, 0.05, 0.2),
    "cultural": Weights(0.532, 0.1, 0.16, 0.128),
    "niche": Weights(0.7, 0.2, 0.05, 0.05),
}

SWEEP = {
    "western_default": Weights(0.5, 0.25, 0.05, 0.2),
    "balanced_cultural": Weights(0.4, 0.2, 0.2, 0.2),
    "high_cultural": Weights(0.3, 0.2, 0.3, 0.2),
    "cultural_low_popularity": Weights(0.4, 0.25, 0.25, 0.1),
}

NEUTRAL_COUNTRIES = ["USA", "United States", "UK", "United Kingdom"]
NEUTRAL_LANGUAGES = ["English"]
FALLBACK_COUNTRY = "United States"

PASSAGE_PREFIX = "passage: "
QUERY_POPULARITY = 1.5
SEARCH_RESULTS = 20
RECOMMEND_RESULTS = 10
YEAR_FROM_DEFAULT = 1900
YEAR_TO_DEFAULT = 2030

KMEANS_STARTS = 10

ELIGIBLE_TYPES = ["movie", "tvMovie"]
MIN_YEAR = 1970
MIN_VOTES = 2500
MIN_RATING = 1.0


@dataclass(frozen=True)
class FeatureConfig:
    """Settings of the feature vectors. Pass a changed copy to use other values."""

    plot_dim: int = 1024
    genre_dim: int = 128
    loc_dim: int = 128
    genre_members_per_cluster: int = 5
    loc_members_per_cluster: int = 3
    min_clusters: int = 2
    # localisation: (multiplier, offset, strength) of the three positions a feature maps to
    first_hash: tuple = (17, 0, 0.8)
    second_hash: tuple = (31, 7, 0.6)
    third_hash: tuple = (53, 13, 0.3)
    third_hash_features: int = 3
    direct_dim: int = 64
    small_dim_bytes: int = 16
    small_dim_strength: float = 0.7
    # sub-cluster tail of the localisation vector
    tail_dims: int = 16
    tail_id_strength: float = 0.3
    tail_hash_strength: float = 0.2
    # sub-cluster signature of the genre vector
    genre_signature_dims: int = 8
    genre_signature_strength: float = 0.5
    # popularity boost
    pop_epsilon: float = 1e-6
    pop_log_scale: float = 1000.0
    pop_log_offset: float = 1.0
    pop_high: float = 0.1
    pop_power: float = 1.5
    pop_min: float = 0.01
    pop_max: float = 2.0
    pop_flat: float = 1e-10
    # genre vector of a query
    neighbours: int = 20
    neighbour_sharpness: float = 3.0


# Keywords that point at a genre when a query contains them.
GENRE_KEYWORDS = {
    "Crime": ["crime", "criminal", "mafia", "gangster", "mob", "heist", "robbery", "murder", "detective", "police"],
    "Drama": ["family", "loyalty", "relationship", "emotion", "character", "drama", "tragic", "serious"],
    "Action": ["action", "fight", "chase", "explosion", "combat", "battle", "war", "hero"],
    "Thriller": ["thriller", "suspense", "tension", "mystery", "dangerous", "edge"],
    "Comedy": ["funny", "comedy", "humor", "laugh", "hilarious", "comic"],
    "Horror": ["horror", "scary", "fear", "monster", "ghost", "terror", "nightmare"],
    "Romance": ["love", "romance", "romantic", "relationship", "couple", "wedding"],
    "Sci-Fi": ["science", "future", "space", "alien", "robot", "technology", "sci-fi"],
    "Fantasy": ["magic", "fantasy", "wizard", "dragon", "supernatural", "mythical"],
}

# Error codes of the request interface.
ERROR_NONE = 0
ERROR_INVALID_QUERY = 1
ERROR_INVALID_ID = 2
ERROR_NOT_FOUND = 3
ERROR_INVALID_PARAMETERS = 4

# ---------------------------------------------------------------------------------------------------------------------
# Size bounds of what is shipped to every task. Above a bound another exact route is taken.
# ---------------------------------------------------------------------------------------------------------------------

REQUESTS_PER_BLOCK = 2048  # request vectors of a block
ROUND_BYTES = 32 << 20  # request vectors sent to all scoring tasks at a time, in double precision
CELL_BYTES = 4 << 20  # item vectors of a chunk, in single precision
CELL_TASKS = 1000  # partitions that pack a round's requests at most
BROADCAST_REQUESTS = 200_000  # resolved requests, a few numbers each, sent to the titles they name
BROADCAST_RESULTS = 1_000_000  # ranked rows of four numbers sent to the titles; beyond, both sides are shuffled
LOOKUP_ROWS = 100_000  # names that one task tests for the texts of a trigram
SAMPLE_ONE_IN = 256  # share of the components that bounds the scores of a large catalogue
SAMPLE_MIN = 10_000  # rows the sample needs to be worth a pass of its own
LOOKUP_VOCAB_MAX = 2048  # vocabulary entries held as an in-row lookup; beyond, the lists are exploded and joined
BLOCK_ROWS = 8192  # vectors of one group held by one clustering task; larger groups are salted
