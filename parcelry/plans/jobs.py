"""Composite jobs over listings, made of the operators. All cities go through one plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from parcelry.functions import columns as C
from parcelry.operators import duplicates, exports, listings, matching, ranks, scores, signals
from parcelry.sources import files, tables
from parcelry.sources.scratch import keep


class Deduplicated(NamedTuple):
    listings: DataFrame
    groups: DataFrame
    report: DataFrame


_DUPLICATE_KEYS = ["city", "project", "price_inr"]


def _open_rows(df: DataFrame) -> DataFrame:
    return listings.canonical_listings(df).withColumn("project", C.name_key(C.filled(F.col("society_name_raw"))))


def dedup_listings(df: DataFrame, tokens: Sequence[str] = (), similarity: str = "ratio") -> Deduplicated:
    """Mark duplicates among the canonical listings: same city, project and price, and a like text or an equal owner.

    Needs ``id``, ``city``, ``corridor``, ``society_name_raw``, ``price_inr``, ``description_raw``, ``poster`` and ``duplicate_of_id``.
    """
    pairs = duplicates.find_duplicates(_open_rows(df), _DUPLICATE_KEYS, "id", "description_raw", "poster", "corridor", tokens, similarity=similarity)
    marked = duplicates.apply_marks(df, pairs, "id")
    return Deduplicated(marked, duplicates.duplicate_groups(pairs), duplicates.dedup_report(marked, "city"))


def comparable(df: DataFrame, tokens: Sequence[str] | Column = ()) -> DataFrame:
    """The canonical listings with what batches are compared by, written once: batches that come from one source are taken out of it by their ``id``."""
    return duplicates.compared(_open_rows(df), _DUPLICATE_KEYS, "id", "description_raw", "poster", "corridor", tokens)


def dedup_batch(batch: DataFrame, root: str, tokens: Sequence[str] | Column = (), similarity: str = "ratio") -> DataFrame:
    """The duplicates of a new batch against itself and the leaders of all earlier batches, whose table at ``root`` then gets the batch's own leaders.

    Leaders are sliced by city; of the earlier ones only those with a key of the batch are read. Batches in the order of their ids give the pairs of one run over all.
    """
    return dedup_compared(comparable(batch, tokens), root, similarity)


def dedup_compared(batch: DataFrame, root: str, similarity: str = "ratio") -> DataFrame:
    """dedup_batch of rows as ``comparable`` has written them, which are not written again."""
    spark = batch.sparkSession
    earlier = tables.read_current(spark, root).drop("city") if tables.current_version(spark, root) else None
    found = duplicates.find_in_batch(batch, similarity=similarity, leaders=earlier)
    new = found.leaders.withColumn("city", F.get_json_object("key", "$.city"))
    tables.append_version(new, root, slice_col="city", cluster_by="key")
    return found.pairs


def store_marks(spark: SparkSession, root: str, pairs: DataFrame, id_col: str = "id") -> tables.Version:
    """Put the marks of ``pairs`` into the stored listings, as a new version."""
    return tables.change_current(spark, root, lambda df: duplicates.apply_marks(df, pairs, id_col))


def store_lookups(spark: SparkSession, root: str, fresh: DataFrame, keys: Sequence[str]) -> tables.Version:
    """Put looked-up rows into the stored lookups, instead of those with the same keys, as a new version."""
    return tables.change_current(spark, root, lambda old: matching.upsert(old, fresh, keys))


def store_seed(spark: SparkSession, root: str, names: DataFrame) -> tables.Version:
    """Add the names that the stored dimension lacks, as a new version; without new names nothing changes but its number."""
    return tables.change_current(spark, root, lambda dim: matching.seed_dimension(dim, names))


def ingest(df: DataFrame, root: str, city: str, cluster_by: str | None = None) -> tables.Version:
    """Append a batch of raw listings to the stored ones, one JSON text a row, sliced by city; ``cluster_by`` is kept as a column beside the text and sorts the files."""
    raw = files.as_raw(df, city)
    raw = raw.withColumn(cluster_by, F.get_json_object("raw_text", f"$.{cluster_by}")) if cluster_by else raw
    return tables.append_version(raw, root, slice_col="city_id", cluster_by=cluster_by)


def stored_raw(spark: SparkSession, root: str, cities: DataFrame | Sequence[str] | None = None, fields: Sequence[str] = listings.PAYLOAD) -> DataFrame:
    """Raw listings decoded, of all cities, of the named ones, or of those with a price band in a table of cities; other cities' files are not read."""
    raw = tables.read_current(spark, root)
    if isinstance(cities, DataFrame):
        # A band is a row per city. The comparison, which nulls fail, is what makes Spark prune by the join.
        raw = raw.join(F.broadcast(cities.filter("price_min <= price_max").select("city_id")), "city_id", "left_semi")
    elif cities is not None:
        raw = raw.filter(F.col("city_id").isin(list(cities)))
    return listings.decode_payload(raw, "raw_text", fields)


def classify_listings(raw: DataFrame, classified: DataFrame, key: str, as_of: Column, rules: Mapping[str, tuple[str, str | None]] = listings.FLAG_RULES) -> DataFrame:
    """Normalised columns and text flags (by default the eight of FLAG_RULES) of the listings that are not classified yet."""
    todo = listings.unclassified(raw, classified, key)
    return listings.text_flags(listings.normalise_listings(todo, as_of), ["title", "description_raw"], rules)


def candidates(df: DataFrame) -> DataFrame:
    """Both candidate signals of canonical listings (``id``, ``city``, ``role``, ``poster``, ``description_raw``)."""
    owners, unused = _candidates(df)
    return signals.candidate_signals(signals.with_siblings(owners, "id", "city"), unused)


def _candidates(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The groups of owners with several listings, and the listings never occupied."""
    rows = listings.canonical_listings(df)
    owners = signals.owner_groups(rows.filter("role = 'owner'").withColumn("owner", C.name_key(F.col("poster"))), "id", "city", "owner")
    return owners, signals.never_occupied(rows, "id", "city", "description_raw")


def broker_activity(df: DataFrame) -> DataFrame:
    """Activity of the agents among canonical listings (``id``, ``city``, ``corridor``, ``role``, ``poster``, ``detail_url``)."""
    agents = listings.canonical_listings(df).filter("role = 'agent' AND poster IS NOT NULL").withColumn("agent", C.name_key(F.col("poster")))
    agents = agents.filter(~F.col("agent").isin(list(listings.PLACEHOLDER_AGENTS)))
    return scores.broker_activity(agents, "city", "corridor", "agent", "detail_url", "poster", ["id"]).orderBy(F.desc("activity_score"), "city", "corridor", "agent")


class Fit(NamedTuple):
    scores: DataFrame
    status: DataFrame


def society_fit(df: DataFrame, cities: DataFrame, ratings: DataFrame) -> Fit:
    """Fit scores of the projects of all cities with a price band, with their candidate listings, and the status of every city."""
    rows = listings.canonical_listings(df).filter(C.filled(F.col("society_name_raw")).isNotNull() & ~F.lower(F.trim("society_name_raw")).isin(list(listings.JUNK_NAMES)))
    columns = ["id", "city", "corridor", "society_name_raw", "price_inr", "days_since_posted"]
    rows = keep(listings.with_entity_key(rows, "society_name_raw", "society_key").select(*columns, "society_key"), "keyed")
    kept, skipped = listings.in_band(rows, cities, "city", "price_inr")
    banded = kept.withColumns({"price": F.col("price_inr"), "age": F.col("days_since_posted")})
    scored = scores.society_fit(banded, ratings.withColumnRenamed("society", "society_key"), "city", "corridor", "society_key", "society_name_raw", ["id"])
    # Ids alone, without the siblings' texts.
    owners, unused = _candidates(df)
    found = owners.select("id").unionByName(unused.select("id")).join(rows.select("id", "city", "corridor", "society_key"), "id")
    linked = signals.attach_candidates(scored, found, ["city", "corridor", "society_key"], "id")
    ok = cities.join(skipped, "city_id", "left_anti").select("city_id", F.lit("ok").alias("status"))
    return Fit(linked.orderBy(F.desc("fit_score"), "city", "corridor", "society_key"), ok.unionByName(skipped))


def society_fit_run(df: DataFrame, cities: DataFrame, ratings: DataFrame, root: str) -> Fit:
    """society_fit with its scores stored: the slices of all cities are replaced in one commit, also of those that are skipped or left without a score. Gives what is stored now."""
    fit = society_fit(df, cities, ratings)
    names = [r["city_id"] for r in cities.select("city_id").distinct().collect()]  # a row per city
    tables.replace_slices(fit.scores, root, "city", names)
    return Fit(tables.read_current(df.sparkSession, root), fit.status)


class Resolved(NamedTuple):
    dimension: DataFrame
    rows: DataFrame
    report: DataFrame
    unmatched: DataFrame


def resolve_entities(df: DataFrame, id_col: str, name_col: str, dim: DataFrame, canonical: DataFrame, cutoff: float = 0.85, how: str = "levenshtein") -> Resolved:
    """Add the canonical names (``name``) to the dimension, give every row its entry, and report what matched and what did not."""
    seeded = keep(matching.seed_dimension(dim, canonical), "dimension")
    rows = keep(matching.resolve(df, id_col, name_col, seeded, cutoff, how), "resolved")
    return Resolved(seeded, rows, matching.match_report(rows, name_col), matching.unmatched(rows, id_col, name_col))


def society_vacancy(df: DataFrame, id_col: str, keys: Sequence[str], name_col: str, dim: DataFrame, cutoff: float = 0.85, days: tuple[int, int] = (60, 90), cap: float = 180) -> DataFrame:
    """Vacancy of the dimension's entities: listings count for the entry that their written name resolves to, others for none."""
    resolved = matching.resolve(df, id_col, name_col, dim, cutoff).filter("dim_id IS NOT NULL")
    known = dim.select("dim_id", F.col("name").alias("society_name"))
    return scores.society_vacancy(resolved.join(known, "dim_id"), [*keys, "society_name"], days, cap).orderBy(F.desc("vacancy_probability"), *keys, "society_name")


def coverage(names: DataFrame, candidates: DataFrame, base_url: str) -> DataFrame:
    """The plan for discovered areas (``city_id``, ``name``): whether configured metrics allow a score now, and the link of the first page."""
    flagged = exports.coverage(names, candidates, "name")
    return flagged.withColumn("sample_url", C.listing_url(base_url, F.col("name"), F.col("city_id"), F.lit(1)))


# The names of the exported datasets.
DATASETS = ("cities", "corridors", "societies", "brokers", "absentee_candidates", "nri_directory")


def export_datasets(cities: DataFrame, corridors: DataFrame, societies: DataFrame, brokers: DataFrame, candidates: DataFrame, directory: DataFrame) -> dict[str, DataFrame]:
    """The seven datasets of the dashboards by name, the last one with the counts over the others."""
    out = dict(zip(DATASETS, (cities, corridors, societies, brokers, candidates, directory)))
    return out | {"stats": exports.export_stats(cities, corridors, societies, brokers, candidates, directory)}


def write_exports(datasets: Mapping[str, DataFrame], path: str) -> dict[str, int]:
    """One folder of JSON lines per dataset, and a manifest of their row counts.

    Each dataset is computed and written once; ``stats``, if it is among them, is counted from what was written, not from the datasets' sources. Returns the counts.
    """
    spark, base = next(iter(datasets.values())).sparkSession, path.rstrip("/")
    read = {}
    for name, df in datasets.items():
        if name != "stats":
            files.write_json(df, f"{base}/{name}")
            read[name] = spark.read.schema(df.schema).json(f"{base}/{name}")
    if "stats" in datasets:
        files.write_json(exports.export_stats(*[read[n] for n in DATASETS]), f"{base}/stats")
        read["stats"] = spark.read.schema(datasets["stats"].schema).json(f"{base}/stats")
    counts = {name: df.count() for name, df in read.items()}
    files.write_json(spark.createDataFrame(list(counts.items()), "dataset string, n long").coalesce(1), f"{base}/manifest")  # a row per dataset
    return counts


def replace_cities(df: DataFrame, path: str, city: str, cities: Sequence[str]) -> tables.Version:
    """Replace the slices of the given cities by a job's result, in one commit; a city without rows is left with an empty slice."""
    return tables.replace_slices(df, path, city, cities)


class Enriched(NamedTuple):
    lookups: DataFrame
    coverage: DataFrame


def enrich_from_snapshot(df: DataFrame, cache: DataFrame, snapshot: DataFrame, city: str, name: str, order: Sequence[str]) -> Enriched:
    """One lookup per distinct business: what the cache holds stays, the rest is matched against the snapshot, and only answered lookups are stored.

    ``cache`` has the columns that confidence_match returns, with ``query``.
    """
    subjects = df.withColumn("subject", C.name_key(F.col(name)))
    subjects = ranks.unique_subjects(subjects, [city, "subject"], name, order)
    subjects = subjects.withColumn("query", F.concat_ws(" ", "display", city))
    _, misses = matching.split_cached(subjects, cache.select("query"), ["query"])
    answered = misses.join(snapshot.filter("status IN ('OK', 'ZERO_RESULTS')").select("query").distinct(), "query", "left_semi")
    fresh = matching.confidence_match(answered, snapshot, "display", city).select(cache.columns)
    table = matching.upsert(cache, fresh, ["query"])
    return Enriched(table, exports.match_coverage(table.join(subjects.select("query", city), "query"), city, "matched"))
