"""Preferences from a user's location: country, languages and time zone."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import FALLBACK_COUNTRY

# ---------------------------------------------------------------------------------------------------------------------
# Names and code of each country with its languages, in order of preference.
# ---------------------------------------------------------------------------------------------------------------------
COUNTRY_LANGUAGES = [
    (["Hong Kong", "HK"], ["Cantonese", "Chinese", "English"]),
    (["China", "CN"], ["Chinese", "Mandarin"]),
    (["Taiwan", "TW"], ["Chinese", "Mandarin"]),
    (["Japan", "JP"], ["Japanese"]),
    (["Korea", "KR", "South Korea"], ["Korean"]),
    (["France", "FR"], ["French"]),
    (["Germany", "DE"], ["German"]),
    (["Italy", "IT"], ["Italian"]),
    (["Spain", "ES"], ["Spanish"]),
    (["Mexico", "MX"], ["Spanish"]),
    (["Brazil", "BR"], ["Portuguese"]),
    (["Portugal", "PT"], ["Portuguese"]),
    (["Russia", "RU"], ["Russian"]),
    (["India", "IN"], ["Hindi", "English"]),
    (["United Kingdom", "GB"], ["English"]),
    (["United States", "US"], ["English"]),
    (["Canada", "CA"], ["English", "French"]),
    (["Australia", "AU"], ["English"]),
    (["New Zealand", "NZ"], ["English"]),
    (["Singapore", "SG"], ["English", "Chinese", "Mandarin"]),
    (["Malaysia", "MY"], ["English", "Chinese", "Mandarin"]),
    (["Thailand", "TH"], ["Thai"]),
    (["Vietnam", "VN"], ["Vietnamese"]),
    (["Philippines", "PH"], ["English", "Filipino"]),
    (["Indonesia", "ID"], ["Indonesian"]),
    (["Netherlands", "NL"], ["Dutch"]),
    (["Belgium", "BE"], ["Dutch", "French"]),
    (["Switzerland", "CH"], ["German", "French", "Italian"]),
    (["Austria", "AT"], ["German"]),
    (["Sweden", "SE"], ["Swedish"]),
    (["Norway", "NO"], ["Norwegian"]),
    (["Denmark", "DK"], ["Danish"]),
    (["Finland", "FI"], ["Finnish"]),
    (["Poland", "PL"], ["Polish"]),
    (["Czech Republic", "CZ"], ["Czech"]),
    (["Hungary", "HU"], ["Hungarian"]),
    (["Romania", "RO"], ["Romanian"]),
    (["Greece", "GR"], ["Greek"]),
    (["Turkey", "TR"], ["Turkish"]),
    (["Israel", "IL"], ["Hebrew", "English"]),
    (["Egypt", "EG"], ["Arabic"]),
    (["Saudi Arabia", "SA"], ["Arabic"]),
    (["United Arab Emirates", "AE"], ["Arabic", "English"]),
    (["South Africa", "ZA"], ["English", "Afrikaans"]),
    (["Nigeria", "NG"], ["English"]),
    (["Kenya", "KE"], ["English", "Swahili"]),
    (["Argentina", "AR"], ["Spanish"]),
    (["Chile", "CL"], ["Spanish"]),
    (["Colombia", "CO"], ["Spanish"]),
    (["Peru", "PE"], ["Spanish"]),
    (["Venezuela", "VE"], ["Spanish"]),
]

REGION_LANGUAGES = [
    ("Hong Kong", ["Cantonese", "Chinese", "English"]),
    ("Macau", ["Cantonese", "Chinese", "Portuguese"]),
    ("Quebec", ["French", "English"]),
    ("Catalonia", ["Catalan", "Spanish"]),
    ("Bavaria", ["German"]),
    ("Lombardy", ["Italian"]),
    ("Andalusia", ["Spanish"]),
    ("Scotland", ["English", "Scottish Gaelic"]),
    ("Wales", ["English", "Welsh"]),
    ("Brittany", ["French", "Breton"]),
    ("Flanders", ["Dutch"]),
    ("Wallonia", ["French"]),
]

TIMEZONE_COUNTRY = [
    ("America/New_York", "United States", "US"),
    ("America/Los_Angeles", "United States", "US"),
    ("America/Chicago", "United States", "US"),
    ("America/Denver", "United States", "US"),
    ("Europe/London", "United Kingdom", "GB"),
    ("Europe/Paris", "France", "FR"),
    ("Europe/Berlin", "Germany", "DE"),
    ("Europe/Rome", "Italy", "IT"),
    ("Europe/Madrid", "Spain", "ES"),
    ("Asia/Tokyo", "Japan", "JP"),
    ("Asia/Shanghai", "China", "CN"),
    ("Asia/Kolkata", "India", "IN"),
    ("Australia/Sydney", "Australia", "AU"),
    ("America/Toronto", "Canada", "CA"),
    ("America/Sao_Paulo", "Brazil", "BR"),
]


def country_table(spark: SparkSession) -> DataFrame:
    rows = [(name, languages) for names, languages in COUNTRY_LANGUAGES for name in names]
    return spark.createDataFrame(rows, "place string, languages array<string>")


def region_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(REGION_LANGUAGES, "place string, languages array<string>")


def timezone_table(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(TIMEZONE_COUNTRY, "zone string, zone_country string, zone_code string")


def api_countries(country: Column, code: Column) -> Column:
    """Country, then its code when it differs; empty texts count as absent."""
    named = F.nullif(country, F.lit(""))
    coded = F.nullif(code, F.lit(""))
    return F.array_distinct(F.array_compact(F.array(named, coded)))


def merge_languages(of_country: Column, of_code: Column, of_region: Column) -> Column:
    """Country languages, then new ones of the code, with the region's new ones in front.

    Regional languages are put in front one after the other, so they come out in reverse order.
    """
    empty = F.array().cast("array<string>")
    base = F.array_distinct(F.concat(F.coalesce(of_country, empty), F.coalesce(of_code, empty)))
    regional = F.array_except(F.array_distinct(F.coalesce(of_region, empty)), base)
    return F.concat(F.reverse(regional), base)


def from_timezone(users: DataFrame) -> DataFrame:
    """Fill an absent country (and its code) from the time zone."""
    zones = F.broadcast(timezone_table(users.sparkSession))  # a fixed table of a few rows
    absent = F.coalesce(F.col("country"), F.lit("")) == ""
    joined = users.join(zones, F.col("tz") == F.col("zone"), "left")
    return joined.withColumns(
        {
            "country": F.when(absent, F.col("zone_country")).otherwise(F.col("country")),
            "code": F.when(absent, F.col("zone_code")).otherwise(F.col("code")),
        }
    ).drop("zone", "zone_country", "zone_code")


def with_fallback(users: DataFrame, country: str = FALLBACK_COUNTRY) -> DataFrame:
    absent = F.coalesce(F.col("country"), F.lit("")) == ""
    return users.withColumn("country", F.when(absent, F.lit(country)).otherwise(F.col("country")))


def with_languages(users: DataFrame) -> DataFrame:
    """Add ``languages`` looked up by country, code and region: three joins with small fixed tables, no shuffle."""
    spark = users.sparkSession

    def table(source: DataFrame, prefix: str) -> DataFrame:
        return F.broadcast(
            source.select(F.col("place").alias(f"_{prefix}"), F.col("languages").alias(f"_{prefix}_languages"))
        )

    joined = (
        users.join(table(country_table(spark), "country"), F.col("country") == F.col("_country"), "left")
        .join(table(country_table(spark), "code"), F.col("code") == F.col("_code"), "left")
        .join(table(region_table(spark), "region"), F.col("region") == F.col("_region"), "left")
    )
    merged = merge_languages(F.col("_country_languages"), F.col("_code_languages"), F.col("_region_languages"))
    return joined.withColumn("languages", merged).select(*users.columns, "languages")


def preferences(users: DataFrame, fallback: str = FALLBACK_COUNTRY) -> DataFrame:
    """Users ``(user_id, country, code, region, tz)`` with ``countries`` and ``languages`` ready for requests."""
    located = with_languages(with_fallback(from_timezone(users), fallback))
    return located.withColumn("countries", api_countries(F.col("country"), F.col("code")))
