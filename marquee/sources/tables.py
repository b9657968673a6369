"""Delimited text, Parquet, and versioned tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import SAMPLE_MIN, SAMPLE_ONE_IN

RAW_TITLES = "tconst string, titleType string, startYear int"
RAW_RATINGS = "tconst string, averageRating double, numVotes long"


def read_delimited(
    spark: SparkSession, path: str, schema: T.StructType | str | None = None, partitions: int | None = None
) -> DataFrame:
    r"""Header, ``\N`` as null, no quoting; tab for ``.tsv``/``.tsv.gz``, else comma.

    With a schema the file is read once and columns are picked by their header name; without one it is inferred, which
    costs a second pass. A gzip file cannot be split: ``partitions`` spreads its rows after the read.
    """
    lowered = path.lower()
    sep = "\t" if lowered.endswith((".tsv", ".tsv.gz")) else ","
    reader = spark.read.option("sep", sep).option("header", True).option("nullValue", "\\N").option("quote", "")
    if schema is None:
        df = reader.option("inferSchema", True).csv(path)
    else:
        wanted = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
        texts = reader.csv(path)
        df = texts.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in wanted.fields])
    return df.repartition(partitions) if partitions else df


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_spread(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table whose rows feed costly per-row work.

    A scan with fewer splits than cores is dealt out over all of them; that is at most some splits per core, so little
    data moves. A scan with enough splits is left as it is.
    """
    df = spark.read.parquet(path)
    cores = spark.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def write_parquet(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).option("compression", "snappy").parquet(path)


class VersionedTable:
    """A table kept as numbered versions below ``root``.

    The rows of a version are written first and published by one appended pointer row, so readers see the last complete
    version whatever happens to a running write. A version that adds rows writes only those and refers to the folders
    before it. Earlier versions stay readable.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def _pointer(self, back: int = 0):
        """``(version, first)``: the version and the first folder it consists of; None if there is no such version."""
        try:
            pointers = self.spark.read.schema("version long, first long").parquet(f"{self.root}/versions")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return None
        newest = pointers.agg(F.max("version")).first()[0]
        return pointers.filter(F.col("version") == newest - back).first()

    def exists(self) -> bool:
        return self._pointer() is not None

    def _write(self, df: DataFrame, version: int, first: int) -> int:
        write_parquet(df, f"{self.root}/v={version}")
        pointer = self.spark.range(1).select(F.lit(version).alias("version"), F.lit(first).alias("first"))
        pointer = pointer.select(F.col("version").cast("long"), F.col("first").cast("long")).coalesce(1)
        write_parquet(pointer, f"{self.root}/versions", mode="append")
        return version

    def publish(self, df: DataFrame) -> int:
        """A version that consists of ``df`` alone."""
        newest = self._pointer()
        version = newest["version"] + 1 if newest else 1
        return self._write(df, version, version)

    def append(self, df: DataFrame) -> int:
        """A version that adds ``df`` to the one before it."""
        newest = self._pointer()
        return self._write(df, newest["version"] + 1, newest["first"]) if newest else self.publish(df)

    def load(self, back: int = 0) -> DataFrame:
        """The latest version, or the one ``back`` steps before it."""
        chosen = self._pointer(back)
        if chosen is None:
            raise FileNotFoundError(f"no version of {self.root} to load")
        folders = [f"{self.root}/v={n}" for n in range(chosen["first"], chosen["version"] + 1)]
        return self.spark.read.parquet(*folders)

    def resume(self, ids: DataFrame, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
        """Run ``work`` on keys without a stored row, add its rows, return the whole table."""
        if self.exists():
            self.append(work(ids.join(self.load().select("tid"), "tid", "left_anti")))
        else:
            self.publish(work(ids))
        return self.load()


class ModelStore:
    """Components, vocabularies and dimensions of a built catalogue."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def save(self, model) -> None:
        """Components are written sorted by key within files, so key lookups skip row groups."""
        write_parquet(model.components.sortWithinPartitions("tid"), f"{self.root}/components")
        stored = self.spark.read.parquet(f"{self.root}/components")
        some = stored.filter(F.pmod(F.xxhash64("tid"), F.lit(SAMPLE_ONE_IN)) == 0)
        write_parquet(some, f"{self.root}/components_sample")
        write_parquet(model.vocab, f"{self.root}/vocab")
        cfg = model.config
        meta = self.spark.range(1).select(
            F.lit(cfg.plot_dim).alias("plot_dim"), F.lit(cfg.genre_dim).alias("genre_dim"), F.lit(cfg.loc_dim).alias("loc_dim")
        )
        write_parquet(meta.coalesce(1), f"{self.root}/model_meta")

    def load(self, config=None):
        """Dimensions come from the store; any further columns of older metadata (weights) are ignored."""
        from dataclasses import replace

        from ..config import FeatureConfig
        from ..operators.features import Model, vocabulary_sizes

        meta = self.spark.read.parquet(f"{self.root}/model_meta").select("plot_dim", "genre_dim", "loc_dim").first()
        vocab = self.spark.read.parquet(f"{self.root}/vocab")
        components = read_spread(self.spark, f"{self.root}/components")
        sample = self.spark.read.parquet(f"{self.root}/components_sample")
        cfg = replace(config or FeatureConfig(), **meta.asDict())
        useful = sample.count() >= SAMPLE_MIN
        return Model(components, vocab, vocabulary_sizes(vocab), cfg, sample if useful else None)
