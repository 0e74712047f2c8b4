"""Joined exports, coverage and roll-ups for publishing and dashboards."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import display_score
from parcelry.operators.ranks import numbered


def society_export(entities: DataFrame, details: DataFrame, samples: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Entities with detail enrichment and a sample link; ``detail_available`` says whether there was a detail row."""
    return with_details(entities, details, keys).join(samples, list(keys), "left")


def with_details(entities: DataFrame, details: DataFrame, keys: Sequence[str]) -> DataFrame:
    known = details.withColumn("detail_available", F.lit(True))
    return entities.join(known, list(keys), "left").withColumn("detail_available", F.coalesce("detail_available", F.lit(False)))


def broker_export(agents: DataFrame, contacts: DataFrame, samples: DataFrame, contact_keys: Sequence[str], sample_keys: Sequence[str]) -> DataFrame:
    """Agents per area with their contact (known per city, without the area) and a sample link, ``traceable`` if they have one."""
    out = agents.join(contacts, list(contact_keys), "left").join(samples, list(sample_keys), "left")
    return out.withColumn("traceable", F.col("sample_link").isNotNull())


def corridor_export(scored: DataFrame, metrics: DataFrame, key: str) -> DataFrame:
    """Scored areas beside their raw metrics, with the score on a scale of 10."""
    return scored.join(metrics, key).withColumn("display_score", display_score(F.col("composite")))


def city_summary(cities: DataFrame, areas: DataFrame) -> DataFrame:
    """Areas per city, and whether the city has a price band."""
    n = areas.groupBy("city_id").agg(F.count("*").alias("n_areas"))
    band = F.col("price_min").isNotNull() & F.col("price_max").isNotNull()
    return cities.join(n, "city_id", "left").select("city_id", F.coalesce("n_areas", F.lit(0)).alias("n_areas"), band.alias("has_price_band"))


def global_stats(**counts: DataFrame) -> DataFrame:
    """One row beside each other from frames that aggregate to one row each, which is what makes them small enough to broadcast."""
    return reduce(lambda a, b: a.join(F.broadcast(b)), counts.values())


def export_stats(cities: DataFrame, corridors: DataFrame, societies: DataFrame, brokers: DataFrame, candidates: DataFrame, directory: DataFrame, n_candidates: str | None = None) -> DataFrame:
    """Nine counts over the exported datasets. Only the rows are read, with ``city_id``, ``has_price_band``, ``detail_available`` and ``contact_available``.

    ``n_candidates`` is the column that says how many candidates a row of ``candidates`` stands for, if not one.
    """
    count = lambda df, name, c=F.lit(1): df.agg(F.count(c).alias(name))
    n = F.coalesce(F.sum(n_candidates), F.lit(0)) if n_candidates else F.count("*")
    return global_stats(
        brokers=brokers.agg(F.count("*").alias("total_brokers_indexed"), F.count_if("contact_available").alias("total_brokers_contact_resolved")),
        candidates=candidates.agg(n.alias("total_absentee_candidates")),
        cities=cities.agg(F.count_distinct("city_id").alias("total_cities_live"), F.count_distinct(F.when(F.col("has_price_band"), F.col("city_id"))).alias("total_cities_fully_scored")),
        directory=count(directory, "total_directory_links"),
        corridors=count(corridors, "total_corridors_ranked"),
        societies=societies.agg(F.count("*").alias("total_societies_scored"), F.count_if("detail_available").alias("total_societies_detail_resolved")),
    )


def coverage(names: DataFrame, candidates: DataFrame, key: str) -> DataFrame:
    """Discovered names, each flagged whether configured metrics allow a score now."""
    known = candidates.select(key, F.lit("scoreable_now").alias("coverage")).distinct()
    return names.join(known, key, "left").withColumn("coverage", F.coalesce("coverage", F.lit("not_yet_scoreable")))


def only_in(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_anti")


def in_both(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.join(b, key, "left_semi")


def backfill_column(df: DataFrame, updates: DataFrame, id_col: str, col: str, order: str, default: str) -> DataFrame:
    """Replace one column by the update of the highest order per id, or a default text; the others stay."""
    last = updates.groupBy(id_col).agg(F.max_by(col, order).alias("__new"))
    return df.drop(col).join(last, id_col, "left").withColumn(col, F.coalesce("__new", F.lit(default))).drop("__new")


def typed(df: DataFrame, types: Mapping[str, str], lists: Sequence[str] = (), separator: str = ";") -> DataFrame:
    """Typed columns from CSV text: empty is NULL, unreadable is NULL, and lists are split."""
    cols = {c: F.nullif(F.col(c), F.lit("")).try_cast(t) for c, t in types.items()}
    cols |= {c: F.split(F.nullif(F.col(c), F.lit("")), separator) for c in lists}
    return df.withColumns(cols)


def match_coverage(df: DataFrame, city: str, flag: str) -> DataFrame:
    return df.groupBy(city).agg(F.count_if(F.col(flag)).alias("matched"), F.count_if(~F.col(flag)).alias("unmatched"))


def with_reasons(df: DataFrame, reasons: Sequence[tuple[Column, str, Sequence[str]]], most: int, out: str = "reasons") -> DataFrame:
    """Up to ``most`` sentences whose conditions hold, in order; each is a format string and its columns."""
    lines = [F.when(F.coalesce(cond, F.lit(False)), F.format_string(text, *cols)) for cond, text, cols in reasons]
    return df.withColumn(out, F.slice(F.array_compact(F.array(*lines)), 1, most))


def with_alias(df: DataFrame, col: str, aliases: Mapping[str, str], out: str) -> DataFrame:
    """A canonical id for free-text spellings; NULL for unknown ones."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair])
    return df.withColumn(out, F.try_element_at(table, F.lower(F.trim(F.col(col)))))


def rollup_counts(dimension: DataFrame, facts: Mapping[str, DataFrame], keys: Sequence[str]) -> DataFrame:
    """A count of every fact per row of the dimension, zero where there is none."""
    out = dimension
    for name, fact in facts.items():
        out = out.join(fact.groupBy(*keys).agg(F.count("*").alias(name)), list(keys), "left")
    return out.withColumns({name: F.coalesce(F.col(name), F.lit(0)) for name in facts})


def age_histogram(df: DataFrame, age: str, edges: Sequence[int] = (30, 60, 90)) -> DataFrame:
    """Listings by age bucket; empty buckets are kept."""
    labels = [f"<={edges[0]}", *[f"{a + 1}-{b}" for a, b in zip(edges, edges[1:])], f">{edges[-1]}", "unknown"]
    bucket = reduce(lambda c, x: c.when(F.col(age) <= x[0], x[1]), zip(edges, labels), F.when(F.col(age).isNull(), "unknown")).otherwise(labels[-2])
    counted = df.groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))
    all_buckets = df.sparkSession.range(1).select(F.posexplode(F.array(*map(F.lit, labels))).alias("ordinal", "bucket"))
    return all_buckets.join(counted, "bucket", "left").withColumn("n", F.coalesce("n", F.lit(0)))


def load_volume(df: DataFrame, keys: Sequence[str], minimum: int = 200) -> DataFrame:
    n = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return n.withColumn("volume", F.when(F.col("n") >= minimum, "OK").otherwise("BELOW MINIMUM"))


def search(df: DataFrame, columns: Sequence[str], text: str) -> DataFrame:
    """Rows that hold the text in any of the columns, in whatever case."""
    return df.filter(reduce(lambda a, b: a | b, (F.coalesce(F.contains(F.lower(c), F.lit(text.lower())), F.lit(False)) for c in columns)))


def drill_down(df: DataFrame, **equal: str) -> DataFrame:
    return df.filter(reduce(lambda a, b: a & b, (F.col(c) == v for c, v in equal.items())))


def eligible_only(df: DataFrame, ranked: DataFrame, key: str) -> DataFrame:
    """Rows of all eligible areas, in rank order."""
    best = numbered(ranked.filter("eligible").select(key, "composite", "ordinal"), [F.desc("composite"), "ordinal"], "area_rank")
    return df.join(best.select(key, F.col("area_rank").cast("int").alias("area_rank")), key).orderBy("area_rank")


def page_of(df: DataFrame, order: Sequence[Column | str], size: int, page: int = 0) -> DataFrame:
    return df.orderBy(*order).offset(size * page).limit(size)


def sorted_by(df: DataFrame, key: str, tie: Sequence[str], ascending: bool = False) -> DataFrame:
    """By a chosen key; an unknown value counts as the smallest."""
    return df.orderBy(F.col(key).asc_nulls_first() if ascending else F.col(key).desc_nulls_last(), *tie)


def match_first(df: DataFrame, col: str, value: str, tie: Sequence[Column | str]) -> DataFrame:
    """All rows, those of the current city first; ``tie`` is the order that the rows keep beyond that."""
    return df.orderBy(F.desc(F.coalesce(F.col(col) == value, F.lit(False))), *tie)


def by_name(df: DataFrame, city: str, area: str, order: Sequence[Column | str]) -> DataFrame:
    """Areas in the order of their names, with the rows of an area in the given order."""
    return df.orderBy(city, area, *order)


def in_city_order(df: DataFrame, city: str, cities: Sequence[str], order: Sequence[Column | str]) -> DataFrame:
    """The rows of the named cities in that order, each beside the number of its city's rows (``n_city``)."""
    place = F.create_map(*[F.lit(x) for i, c in enumerate(cities) for x in (c, i)])
    named = df.filter(F.col(city).isin(list(cities)))
    counts = named.groupBy(city).agg(F.count("*").alias("n_city"))  # one row per city of a list
    return named.join(F.broadcast(counts), city).orderBy(F.try_element_at(place, F.col(city)), *order)


def combine(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)
