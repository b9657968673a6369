"""Mixing sources to target weights by Poisson replication, in DataFrame operations only.

A source of ``n`` rows with target share ``w`` gets the mean repetition rate ``w * total / n``. Each row's number of copies is
the inverse of that Poisson distribution at a uniform number hashed from the seed and the row's key, so it needs no state,
no order and no knowledge of other rows, and repeats on any cluster. Rows are then exploded by their count and dealt out by
the hash of (seed, key, copy), which also orders each partition: a global shuffle in one exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PART_RATE = 16.0  # a larger rate is a sum of independent Poisson numbers of at most this mean
BROADCAST_SOURCES = 10_000
SOURCE_SALTS = 32


def uniform(*parts: Column) -> Column:
    """A number in [0, 1) from the first 13 hexadecimal digits of an MD5."""
    return F.conv(F.substring(F.md5(F.concat_ws(":", *parts)), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def target_rates(df: DataFrame, source: str = "source", weights: dict | None = None, temperature: float = 0.5, epochs: float = 1.0) -> DataFrame:
    """``source, rows, rate`` of each source: the mean number of copies that brings it to its target share.

    Without ``weights`` the target share is proportional to ``rows ** temperature``. With ``weights``, sources that are not
    named get weight 0 and none of their rows. Shares are of ``epochs`` times the number of rows.
    """
    sizes = df.groupBy(F.col(source).alias("source")).agg(F.count(F.lit(1)).alias("rows"))
    if weights is None:
        weight = F.pow(F.col("rows").cast("double"), F.lit(float(temperature)))
    else:
        weight = F.lit(0.0)
        for name, value in weights.items():
            weight = F.when(F.col("source").eqNullSafe(F.lit(name)), F.lit(float(value))).otherwise(weight)
    sizes = sizes.withColumn("weight", weight)
    total = sizes.agg(F.struct(F.sum("rows").alias("rows"), F.sum("weight").alias("weight")).alias("t")).scalar()
    rate = F.when(total["weight"] > 0, F.lit(float(epochs)) * F.col("weight") / total["weight"] * total["rows"] / F.col("rows")).otherwise(F.lit(0.0))
    return sizes.select("source", "rows", rate.alias("rate"))


def poisson_table(rates: DataFrame) -> DataFrame:
    """``rates`` with ``parts`` and ``cdf``: the cumulative probabilities of 0, 1, 2, … at mean ``rate / parts``."""
    parts = F.greatest(F.ceil(F.col("rate") / PART_RATE), F.lit(1)).cast("int")
    mean = F.col("rate") / F.col("parts")
    upto = F.ceil(F.col("mean") + 12 * F.sqrt(F.col("mean")) + 24).cast("int")
    start = F.struct(F.exp(-F.col("mean")).alias("p"), F.exp(-F.col("mean")).alias("c"), F.array(F.exp(-F.col("mean"))).alias("all"))

    def step(acc: Column, k: Column) -> Column:
        p = acc["p"] * F.col("mean") / k
        return F.struct(p.alias("p"), (acc["c"] + p).alias("c"), F.concat(acc["all"], F.array(acc["c"] + p)).alias("all"))

    table = rates.withColumn("parts", parts).withColumn("mean", mean)
    return table.withColumn("cdf", F.aggregate(F.sequence(F.lit(1), upto), start, step, lambda acc: acc["all"])).drop("mean")


def poisson_mix(df: DataFrame, source: str = "source", key: str = "doc_id", seed: int = 0, into: str = "copy", **targets) -> DataFrame:
    """Every row of ``df`` as often as its Poisson number says, numbered from 1 in ``into``, in a global random order.

    ``targets`` are those of ``target_rates``. A null source is a source of its own. Rows that share a key share their number
    of copies, as the key is the only thing hashed; a null key counts as empty text. Texts, also empty and very long ones, pass
    unchanged. An empty table gives an empty table. Other columns are kept; one called ``into`` is replaced.
    """
    df = df.drop(into)
    rates = poisson_table(target_rates(df, source, **targets)).select(
        F.col("source").alias("__mix_source"), F.col("parts").alias("__mix_parts"), F.col("cdf").alias("__mix_cdf")
    )
    few = rates.limit(BROADCAST_SOURCES + 1).count() <= BROADCAST_SOURCES
    same = F.col(source).eqNullSafe(F.col("__mix_source"))
    if few:
        rated = df.join(F.broadcast(rates), same)
    else:  # hot sources: rows are salted, the few numbers of a source are repeated for each salt
        salt = F.pmod(F.xxhash64(F.col(key)), F.lit(SOURCE_SALTS))
        salted = rates.withColumn("__mix_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SOURCE_SALTS - 1).cast("long"))))
        rated = df.withColumn("__mix_own", salt).join(salted, same & (F.col("__mix_own") == F.col("__mix_salt"))).drop("__mix_own", "__mix_salt")
    name = F.coalesce(F.col(key).cast("string"), F.lit(""))

    def drawn(total: Column, part: Column) -> Column:
        u = uniform(F.lit(str(seed)), name, part.cast("string"))
        return total + F.aggregate(F.col("__mix_cdf"), F.struct(u.alias("u"), F.lit(0).alias("n")), lambda a, c: F.struct(a["u"].alias("u"), (a["n"] + (c <= a["u"]).cast("int")).alias("n")), lambda a: a["n"])

    times = F.aggregate(F.sequence(F.lit(1), F.col("__mix_parts")), F.lit(0), drawn)
    copies = rated.withColumn("__mix_times", times).filter("__mix_times > 0").withColumn(into, F.explode(F.sequence(F.lit(1), F.col("__mix_times"))))
    place = F.md5(F.concat_ws(":", F.lit(f"{seed} order"), name, F.col(into).cast("string")))
    columns = [*df.columns, into]
    return copies.withColumn("__mix_place", place).select(*columns, "__mix_place").repartition("__mix_place").sortWithinPartitions("__mix_place").drop("__mix_place")
