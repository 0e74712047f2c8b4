"""Name resolution against a dimension, gated matching against a places snapshot, and lookup tables."""

from __future__ import annotations

import difflib
from collections.abc import Iterator, Sequence

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from parcelry.functions.columns import name_key, significant_words, similarity
from parcelry.operators.prefixes import common_tokens, name_posts, token_hash
from parcelry.operators.ranks import numbered

# Words that say nothing about which business is meant.
STOPWORDS = ("real", "estate", "realty", "realtors", "properties", "property", "consultants", "consultancy", "agency", "group")


@F.pandas_udf(T.DoubleType())
def sequence_ratio(name: pd.Series, known: pd.Series) -> pd.Series:
    """difflib's ratio with the known name first."""
    return pd.Series([difflib.SequenceMatcher(None, k, n).ratio() for n, k in zip(name, known)])


def resolve(df: DataFrame, id_col: str, name_col: str, dim: DataFrame, cutoff: float = 0.85, how: str = "levenshtein") -> DataFrame:
    """The dimension entry of every name: equal name keys first, else the most similar one at the cutoff (of equally similar ones the largest name key).

    ``dim`` has ``dim_id`` and ``name``. Names that match nothing keep a NULL id. ``how``: "levenshtein", or "parity" for difflib's ratio. Fuzzy matching
    compares the pairs of candidate_pairs, which miss no match at any cutoff. Runs a job.
    """
    if not 0 < cutoff <= 1:
        raise ValueError("cutoff must be above 0 and at most 1")
    dim = dim.select("dim_id", name_key(F.col("name")).alias("known"))
    dim = dim.groupBy("known").agg(F.min("dim_id").alias("dim_id"))
    rows = df.withColumn("key", name_key(F.col(name_col)))
    exact = rows.join(dim.withColumnRenamed("known", "key"), "key", "left").withColumnRenamed("dim_id", "exact_id")
    # Distinct names are matched once, however often they occur.
    names = exact.filter("exact_id IS NULL AND key IS NOT NULL AND key <> ''").select("key").distinct()
    pairs = candidate_pairs(names, dim.select("known"), cutoff)
    score = similarity(F.col("key"), F.col("known")) if how == "levenshtein" else sequence_ratio("key", "known")
    best = pairs.withColumn("score", score).filter(F.col("score") >= cutoff).groupBy("key").agg(F.max(F.struct("score", "known")).alias("m"))
    best = best.select("key", "m.score", "m.known").join(dim, "known").select("key", F.col("dim_id").alias("fuzzy_id"), "score")
    out = exact.join(best, "key", "left")
    return out.select(*df.columns, F.coalesce("exact_id", "fuzzy_id").alias("dim_id"), F.when(F.col("exact_id").isNotNull(), 1.0).otherwise(F.col("score")).alias("match_score"))


def candidate_pairs(names: DataFrame, known: DataFrame, cutoff: float) -> DataFrame:
    """The pairs (key, known) of two columns of distinct names that can be similar to the cutoff or more, by edit distance or difflib's ratio.

    They have lengths that the cutoff allows and share one of their rarest pairs of letters (or letters, where a match may have no pair in
    common), of which each name lists as many as a match needs. Rarity is counted in both columns. Runs a job.
    """
    both = names.toDF("name").unionByName(known.toDF("name")).filter("name <> ''")
    grams = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substring("name", i, F.lit(2)))
    # Frequent first occurrences stand for all; any order gives the same matches.
    common = common_tokens(both.select(F.explode(F.array_union(grams, F.split("name", ""))).alias("t")).select(F.concat("t", F.lit("\1" + "1"))))

    def posted(df: DataFrame, column: str) -> DataFrame:
        return df.toDF(column).filter(F.col(column) != "").mapInArrow(lambda batches: _name_posts(batches, column, cutoff, common), f"{column} string, token long")

    a, b = F.length("key"), F.length("known")
    fits = (b >= a * F.lit(cutoff / (2 - cutoff)) - 1e-9) & (b <= a * F.lit((2 - cutoff) / cutoff) + 1e-9)
    return posted(names, "key").join(posted(known, "known"), "token").filter(fits).select("key", "known").distinct()


def _name_posts(batches: Iterator[pa.RecordBatch], column: str, cutoff: float, common: dict[str, int]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [(name, t) for name in batch.column(column).to_pylist() for t in {token_hash(*post) for post in name_posts(name, cutoff, common)}]
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in found], pa.string()), pa.array([t for _, t in found], pa.int64())], names=[column, "token"])


def match_report(resolved: DataFrame, name_col: str) -> DataFrame:
    """Counts of one resolution and the share of named rows that matched, NULL without any named row."""
    named = F.coalesce(F.length(F.trim(name_col)), F.lit(0)) > 0
    n = F.nullif(F.count_if(named), F.lit(0))
    rate = F.floor(F.count_if(named & F.col("dim_id").isNotNull()) / n * 1e4 + 0.5) / 1e4
    return resolved.agg(F.count("*").alias("total"), F.count_if(~named).alias("unnamed"), F.count_if(named & F.col("dim_id").isNotNull()).alias("matched"), rate.alias("match_rate"))


def unmatched(resolved: DataFrame, id_col: str, name_col: str) -> DataFrame:
    """The named rows that match_report counts as not matched, with the name as it is written."""
    named = F.coalesce(F.length(F.trim(name_col)), F.lit(0)) > 0
    return resolved.filter(named & F.col("dim_id").isNull()).select(id_col, name_col)


def seed_dimension(dim: DataFrame, names: DataFrame) -> DataFrame:
    """The dimension with new names added; ids go on from the largest, in the order of the name keys."""
    known = dim.select(name_key(F.col("name")).alias("key"))
    fresh = names.select(F.col("name"), name_key(F.col("name")).alias("key")).filter("key <> ''").groupBy("key").agg(F.min("name").alias("name")).join(known, "key", "left_anti")
    last = dim.agg(F.coalesce(F.max("dim_id"), F.lit(0)).alias("last")).collect()[0][0]
    return dim.select("dim_id", "name").unionByName(numbered(fresh, ["key"], "n").select((F.lit(last) + F.col("n")).alias("dim_id"), "name"))


def split_cached(df: DataFrame, cache: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Rows that the cache can serve, with what it holds, and rows to look up."""
    return df.join(cache, list(keys)), df.join(cache, list(keys), "left_anti")


def upsert(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The old table with rows of equal keys replaced by the new ones."""
    return old.join(new, list(keys), "left_anti").unionByName(new)


def confidence_match(subjects: DataFrame, snapshot: DataFrame, name: str, city: str, query: str = "query", stopwords: Sequence[str] = STOPWORDS) -> DataFrame:
    """Accept a snapshot's place for a subject only if the names share a significant word and the address names the city; the note always says why."""
    joined = subjects.join(snapshot.withColumnsRenamed({"name": "place_name"}), query, "left")
    words = F.array_intersect(significant_words(F.col(name), stopwords), significant_words(F.coalesce("place_name", F.lit("")), stopwords))
    right_name = F.size(F.filter(words, lambda w: w != "")) > 0
    right_city = F.coalesce(F.lower("formatted_address").contains(F.lower(F.col(city))), F.lit(False))
    found = F.coalesce(F.col("status") == "OK", F.lit(False)) & F.col("place_name").isNotNull()
    note = (
        F.when(~found, "no result")
        .when(~right_name & ~right_city, "name and city differ")
        .when(~right_name, "name differs")
        .when(~right_city, "city differs")
        .otherwise("accepted")
    )
    ok = found & right_name & right_city
    details = [F.when(F.col("matched"), F.col(c)).alias(c) for c in ("place_id", "rating", "reviews")]
    return joined.withColumns({"matched": ok, "note": note}).select(*subjects.columns, "matched", "note", *details)
