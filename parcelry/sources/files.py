"""Reading configuration and CSV tables, and the sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CITIES = "city_id string, city_name string, state string, price_min long, price_max long"


def load_cities(spark: SparkSession, path: str, city_id: str | None = None) -> DataFrame:
    """City configuration from JSON lines; an unknown city is an error."""
    cities = spark.read.schema(CITIES).json(path)
    if city_id is None:
        return cities
    one = cities.filter(F.col("city_id") == city_id)
    if not one.head(1):
        raise KeyError(f"unknown city {city_id!r}")
    return one


def load_seed_corridors(spark: SparkSession, path: str) -> DataFrame:
    """(city_id, ordinal, name) from one JSON object that maps cities to lists of area names."""
    text = spark.read.option("wholetext", True).text(path)
    lists = text.select(F.explode(F.from_json("value", "map<string, array<string>>")).alias("city_id", "names"))
    return lists.select("city_id", F.posexplode("names").alias("ordinal", "name"))


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """A CSV file with a header, all columns as text; quoted fields may hold line breaks."""
    return spark.read.csv(path, header=True, multiLine=True, quote='"', escape='"')


def flat(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """The columns as CSV text: arrays joined by semicolons, booleans as 0 or 1, NULL as nothing."""
    kinds = dict(df.dtypes)

    def text(c: str) -> F.Column:
        if kinds[c].startswith("array"):
            return F.array_join(F.col(c).cast("array<string>"), ";")
        return F.col(c).cast("int").cast("string") if kinds[c] == "boolean" else F.col(c).cast("string")

    return df.select(*[F.coalesce(text(c), F.lit("")).alias(c) for c in columns])


def write_csv(df: DataFrame, path: str, columns: Sequence[str]) -> None:
    flat(df, columns).write.mode("overwrite").csv(path, header=True, emptyValue="", nullValue="", escape='"')


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def as_raw(df: DataFrame, city: str) -> DataFrame:
    """The row as one JSON text, beside its city and load time."""
    return df.select(F.col(city).alias("city_id"), F.to_json(F.struct("*")).alias("raw_text"), F.current_timestamp().alias("scraped_at"))


def append_raw(df: DataFrame, path: str, city: str) -> None:
    as_raw(df, city).write.mode("append").partitionBy("city_id").parquet(path)


def replace_slice(df: DataFrame, path: str, city: str, value: str) -> None:
    """Replace one city's rows; an empty result leaves an empty slice, and other cities stay as they are."""
    df.filter(F.col(city) == value).drop(city).write.mode("overwrite").parquet(f"{path.rstrip('/')}/{city}={value}")
