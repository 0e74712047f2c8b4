"""The normalise job and scans of listings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions import columns as C

PAYLOAD = ("source", "corridor", "title", "society_name_raw", "price_raw", "status", "transaction_type", "carpet_area_raw", "posted_by_raw", "posted_recency_raw", "description_raw", "detail_url")
# Names that stand for a missing poster or project.
PLACEHOLDER_OWNERS = ("mb user", "magicbricks user")
PLACEHOLDER_AGENTS = (*PLACEHOLDER_OWNERS, "magicbricks", "real estate")
JUNK_NAMES = ("javascript:void(0)",)
# What a listing must say for a flag. A call to "buy or invest" in a city says nothing about the property and is in none of them.
FLAG_RULES = {
    "flag_nri_mention": (r"(?i)\bnri\b|non[- ]resident indian|(owner|seller) (lives|living|lives and works) abroad", None),
    "flag_poa_mention": (r"(?i)power of attorney|\bpoa\b|attorney holder", None),
    "flag_owner_abroad": (r"(?i)(owner|seller) (is |lives |living |based |settled |currently )*(abroad|overseas)", None),
    "flag_owner_not_local": (r"(?i)(owner|seller) (is )?not local|out of station|(owner|seller) (lives|resides|stays|is) in (another|a different) city", None),
    "flag_visit_by_appointment_only": (r"(?i)by (prior )?appointment|appointment only|prior appointment", None),
    "flag_calling_hours_hint": (r"(?i)call (only )?(after|before|between) \d", None),
    "flag_long_vacant_or_tenanted": (r"(?i)(vacant|tenanted) (for|since)|long[- ](vacant|tenanted)|\bre-?listed", None),
    "flag_investment_property_mention": (r"(?i)rental income|currently (rented|tenanted|leased|on rent)|(bought|held|kept) (as|for) (an )?investment|is an investment property", None),
}
STRONG_FLAGS = ("flag_nri_mention", "flag_poa_mention", "flag_owner_abroad", "intl_contact_hint")
WEAK_FLAGS = ("flag_owner_not_local", "flag_visit_by_appointment_only", "flag_calling_hours_hint", "flag_long_vacant_or_tenanted", "flag_investment_property_mention")


def decode_payload(df: DataFrame, json_col: str = "raw_text", fields: Sequence[str] = PAYLOAD) -> DataFrame:
    """The string fields of a JSON text, as columns; absent keys are NULL."""
    schema = ", ".join(f"{f} string" for f in fields)
    return df.withColumn("__p", F.from_json(json_col, schema)).select(*[c for c in df.columns if c not in (json_col, *fields)], "__p.*")


def canonical_listings(df: DataFrame, dup_col: str = "duplicate_of_id") -> DataFrame:
    return df.filter(F.col(dup_col).isNull())


def normalise_listings(raw: DataFrame, as_of: Column) -> DataFrame:
    """Typed columns from the text fields of a listing; the other columns stay."""
    posted, text = F.col("posted_by_raw"), F.col("description_raw")
    return raw.withColumns(
        {
            "price_inr": C.price_inr(F.col("price_raw")),
            "area_sqft": C.area_sqft(F.col("carpet_area_raw")),
            "bhk": C.bhk(F.col("title")),
            "role": C.role(posted),
            "poster": C.poster_name(posted),
            "mentions_registration": C.mentions(text, "rera"),
            "days_since_posted": C.days_since(F.col("posted_recency_raw"), as_of),
            "possession_status": C.possession_status(F.col("status")),
            "intl_contact_hint": C.intl_contact_hint(text, F.col("title"), posted),
        }
    ).transform(with_entity_key, "society_name_raw", "society_key")


def with_entity_key(df: DataFrame, name: str, out: str) -> DataFrame:
    """The grouping key of a name, in place, so that no row moves."""
    return df.withColumn(out, C.entity_key(C.name_key(F.col(name))))


def text_flags(df: DataFrame, text_cols: Sequence[str], rules: Mapping[str, tuple[str, str | None]] = FLAG_RULES) -> DataFrame:
    """A boolean column per rule: the joined texts match the first pattern and not the second."""
    text = F.concat_ws(" ", *text_cols)
    flag = lambda yes, no: text.rlike(yes) & ~text.rlike(no) if no else text.rlike(yes)
    return df.withColumns({name: flag(*rule) for name, rule in rules.items()})


def in_band(df: DataFrame, cities: DataFrame, city: str = "city", price: str = "price") -> tuple[DataFrame, DataFrame]:
    """Listings inside the price band of their city, and the cities that are skipped because they have none."""
    bands = cities.filter("price_min IS NOT NULL AND price_max IS NOT NULL").select(F.col("city_id").alias(city), "price_min", "price_max")
    kept = df.join(bands, city).filter(F.col(price).between(F.col("price_min"), F.col("price_max"))).drop("price_min", "price_max")
    skipped = cities.join(bands.select(F.col(city).alias("city_id")), "city_id", "left_anti").select("city_id", F.lit("skipped_no_price_band").alias("status"))
    return kept, skipped


def unclassified(raw: DataFrame, classified: DataFrame, key: str) -> DataFrame:
    return raw.join(classified, key, "left_anti")


def classified_with_raw(classified: DataFrame, raw: DataFrame, key: str) -> DataFrame:
    return classified.join(raw, key)
