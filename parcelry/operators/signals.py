"""Candidate signals with their evidence, and links that identify one poster."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import matched_keywords
from parcelry.operators.listings import PLACEHOLDER_OWNERS
from parcelry.operators.lookups import looked_up
from parcelry.sources.scratch import keep

# Phrases that say a home was never lived in.
NEVER_OCCUPIED = ("never used", "unused", "never occupied", "possession not taken")


def owner_groups(df: DataFrame, id_col: str, city: str, owner: str, min_listings: int = 2, placeholders: Sequence[str] = PLACEHOLDER_OWNERS) -> DataFrame:
    """A row per listing of an owner with several: the city, ``group_id`` (the owner's smallest listing) and ``n``, their number. Linear in the listings.

    ``owner`` is a normalised name of at least two words; ``df`` holds canonical owner rows. The owners of very many listings are few, and are joined where the listings are.
    """
    named = _named(df, owner, placeholders)
    rows = keep(named.select(id_col, city, F.to_json(F.struct(city, owner)).alias("__owner")), "owners")
    large = keep(rows.groupBy("__owner").agg(F.min(id_col).alias("group_id"), F.count("*").alias("n")).filter(F.col("n") >= min_listings), "groups")
    return looked_up(rows, large, "__owner", "n").select(id_col, city, "group_id", "n")


def owner_counts(df: DataFrame, city: str, poster: str, owner: Callable[[Column], Column], min_listings: int = 2, placeholders: Sequence[str] = PLACEHOLDER_OWNERS) -> DataFrame:
    """The owners of owner_groups with the number of their listings (``n``): the city and the owner, a row each. ``owner`` makes the normalised name of a ``poster``, once for each written form."""
    written = df.groupBy(city, poster).agg(F.count("*").alias("n"))
    named = _named(written.withColumn("owner", owner(F.col(poster))), "owner", placeholders)
    return named.groupBy(city, "owner").agg(F.sum("n").alias("n")).filter(F.col("n") >= min_listings)


def _named(df: DataFrame, owner: str, placeholders: Sequence[str]) -> DataFrame:
    """Rows whose owner has a name of at least two words. The name stands in the condition once, because a filter computes it as often as it names it."""
    return df.filter(F.exists(F.array(owner), lambda name: F.coalesce(~name.isin(list(placeholders)) & (F.size(F.split(name, " ")) >= 2), F.lit(False))))


def multi_listing_owners(df: DataFrame, id_col: str, city: str, owner: str, min_listings: int = 2, placeholders: Sequence[str] = PLACEHOLDER_OWNERS) -> DataFrame:
    """A row per listing of an owner with several, with their number and the sibling listings; ids only, never names."""
    return with_siblings(owner_groups(df, id_col, city, owner, min_listings, placeholders), id_col, city)


def with_siblings(groups: DataFrame, id_col: str, city: str) -> DataFrame:
    """owner_groups with each listing's siblings written out as evidence, which takes the square of a group: for exports, not for tables between jobs."""
    ids = groups.groupBy("group_id").agg(F.array_sort(F.collect_list(id_col)).alias("ids"), F.any_value(city).alias(city))
    each = ids.select(city, F.size("ids").alias("n"), "ids", F.explode("ids").alias(id_col))
    siblings = F.array_except("ids", F.array(id_col))
    return each.select(id_col, city, F.lit("multi_property_owner").alias("signal"), F.col("n").cast("string").alias("score"), F.concat(F.lit("siblings: "), F.array_join(siblings.cast("array<string>"), ", ")).alias("evidence"))


def never_occupied(df: DataFrame, id_col: str, city: str, text: str, words: Sequence[str] = NEVER_OCCUPIED) -> DataFrame:
    """Listings whose text holds one of the phrases; the evidence lists them in their given order."""
    hit = df.withColumn("__words", matched_keywords(F.col(text), words)).filter(F.size("__words") > 0)
    return hit.select(id_col, city, F.lit("never_occupied").alias("signal"), F.lit("confirmed_genuine").alias("score"), F.concat(F.lit("keywords: "), F.array_join("__words", ", ")).alias("evidence"))


def candidate_signals(owners: DataFrame, unused: DataFrame) -> DataFrame:
    """Both signals; a listing with both has two rows."""
    return owners.unionByName(unused)


def attach_candidates(entities: DataFrame, candidates: DataFrame, keys: Sequence[str], id_col: str) -> DataFrame:
    """The sorted candidate listings of every entity, an empty array for none."""
    linked = candidates.groupBy(*keys).agg(F.array_sort(F.collect_set(id_col)).alias("candidate_ids"))
    none = F.array().cast(linked.schema["candidate_ids"].dataType)
    return entities.join(linked, list(keys), "left").withColumn("candidate_ids", F.coalesce("candidate_ids", none)).withColumn("n_candidates", F.size("candidate_ids"))


def exclusive_sample(df: DataFrame, scope: Sequence[str], link: str, identity: str, keys: Sequence[str], only: str | None = None) -> DataFrame:
    """The smallest link per key that exactly one identity uses within the scope; NULL where there is none.

    Every identity blocks, also placeholders and other roles; ``only`` restricts the rows that receive a sample.
    """
    linked = df.filter(F.col(link).isNotNull() & (F.col(link) != ""))
    # Two identities show in the smallest and largest one, which aggregate without a distinct.
    exclusive = linked.groupBy(*scope, link).agg(F.min(identity).alias("__a"), F.max(identity).alias("__b")).filter("__a = __b").select(*scope, link)
    wanted = df.filter(only) if only else df
    samples = wanted.join(exclusive, [*scope, link]).groupBy(*keys).agg(F.min(link).alias("sample_link"))
    return wanted.select(*keys).distinct().join(samples, list(keys), "left")
