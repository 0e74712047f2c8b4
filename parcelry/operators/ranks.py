"""Percentile ranks and group representatives."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from parcelry.sources.scratch import keep


def numbered(df: DataFrame, order: Sequence[str | Column], out: str) -> DataFrame:
    """All rows numbered from 1 in the given order, by ranges: each task numbers its own range, and the ranges before it are added. Runs a job."""
    ranged = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # Within a partition the number counts up from a multiple of 2 ** 33.
    held = keep(ranged.withColumns({"__range": F.spark_partition_id(), "__at": F.monotonically_increasing_id() % F.lit(1 << 33)}), "numbered")
    sizes, before, done = {r["__range"]: r["count"] for r in held.groupBy("__range").count().collect()}, [], 0
    for part in sorted(sizes):
        before.append((part, done))
        done += sizes[part]
    starts = df.sparkSession.createDataFrame(before, "__range int, __before long")  # one row per task
    return held.join(F.broadcast(starts), "__range").withColumn(out, F.col("__before") + F.col("__at") + 1).drop("__range", "__at", "__before")


def with_percentile_rank(df: DataFrame, partition: Sequence[str], value: str, out: str, method: str = "histogram") -> DataFrame:
    """Rank from 0 to 1 within the partition, ties averaged; 1 for a single value, NULL for NULL values, which take no part.

    ``histogram`` counts distinct values first and runs over those only, so a partition that
    holds most rows costs one row per distinct value; ``window`` sorts all rows.
    """
    if method == "histogram":
        return with_percentile_ranks(df, partition, {value: out})
    whole = Window.partitionBy(*partition)
    n = F.count(value).over(whole)
    below = F.rank().over(whole.orderBy(F.col(value).asc_nulls_last())) - 1
    ties = F.count(value).over(Window.partitionBy(*partition, value))
    rank = (below + (ties - 1) / 2) / F.nullif(n - 1, F.lit(0))
    return df.withColumn(out, F.when(F.col(value).isNotNull(), F.coalesce(rank, F.lit(1.0))))


def with_percentile_ranks(df: DataFrame, partition: Sequence[str], values: Mapping[str, str]) -> DataFrame:
    """Histogram ranks of several values at once. Runs a job, and ``df`` is read once more, so pass a written table if it is costly.

    The distinct values of all columns form one table, cut into ranges; sums of whole ranges are added to sums within them, so no task holds a partition.
    """
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("__of"), F.col(v).cast("double").alias("__v")) for v in values]))
    long = df.select(*partition, pairs.alias("__p")).select(*partition, "__p.*").filter("__v IS NOT NULL")
    groups = [*partition, "__of"]
    bins = long.groupBy(*groups, "__v").agg(F.count("*").alias("__ties"))
    bins = keep(bins.repartitionByRange(*groups, "__v").withColumn("__range", F.spark_partition_id()), "bins")
    inside = Window.partitionBy(*groups, "__range").orderBy("__v").rowsBetween(Window.unboundedPreceding, -1)
    sums = bins.groupBy(*groups, "__range").agg(F.sum("__ties").alias("__sum"))  # a few rows per range
    earlier = Window.partitionBy(*groups).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)), "__n": F.sum("__sum").over(Window.partitionBy(*groups))}).drop("__sum")
    below = F.col("__before") + F.coalesce(F.sum("__ties").over(inside), F.lit(0))
    rank = (below + (F.col("__ties") - 1) / 2) / F.nullif(F.col("__n") - 1, F.lit(0))
    s = sums.toDF(*[f"__s{c}" for c in sums.columns])
    known = bins.join(s, reduce(lambda x, y: x & y, (bins[k].eqNullSafe(s[f"__s{k}"]) for k in [*groups, "__range"])))
    known = known.withColumnsRenamed({"__s__before": "__before", "__s__n": "__n"}).withColumn("__rank", F.coalesce(rank, F.lit(1.0)))
    known = keep(known.select(*groups, "__v", "__rank"), "ranks")
    ranked = df
    for value, out in values.items():
        one = known.filter(F.col("__of") == value).select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(partition)], F.col("__v").alias("__kv"), F.col("__rank").alias(out))
        match = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"__k{i}")) for i, k in enumerate(partition)), F.col(value).cast("double") == F.col("__kv"))
        ranked = ranked.join(one, match, "left").drop("__kv", *[f"__k{i}" for i in range(len(partition))])
    return ranked.select(*df.columns, *values.values())


def most_common_display(df: DataFrame, keys: Sequence[str], display: str, order: Sequence[str], out: str) -> DataFrame:
    """The most frequent spelling per key; of equally frequent ones the first seen in the given order."""
    counted = df.groupBy(*keys, display).agg(F.count("*").alias("__n"), F.min(F.struct(*order)).alias("__first"))
    # The most frequent count first, then the earliest of the spellings that reach it.
    top = counted.groupBy(*keys).agg(F.max("__n").alias("__top"))
    return counted.join(top, list(keys)).filter("__n = __top").groupBy(*keys).agg(F.min_by(display, "__first").alias(out))


def unique_subjects(df: DataFrame, keys: Sequence[str], display: str, order: Sequence[str]) -> DataFrame:
    """One row per key with the spelling to show."""
    return most_common_display(df, keys, display, order, "display")


def with_group_median(df: DataFrame, keys: Sequence[str], value: Column, out: str) -> DataFrame:
    """The group's exact median of a value, beside each of its rows; NULL values take no part. Runs a job, and ``df`` is read once more.

    Groups with a null key are left out of the medians, so their rows get NULL.
    """
    medians = group_medians(df.select(*keys, value.alias("__v")), keys, "__v", out)
    return df.join(medians, list(keys), "left")


def group_medians(df: DataFrame, keys: Sequence[str], value: str, out: str) -> DataFrame:
    """The exact median of each group by selection: counts of ranges of the sorted distinct values say which range holds the middle, and only that one is looked into.

    So no task or buffer holds a group. An even number of values gives the mean of the middle two. Runs a job.
    """
    rows = df.select(*keys, F.col(value).cast("double").alias("__v")).dropna()
    bins = rows.groupBy(*keys, "__v").agg(F.count("*").alias("__ties"))
    bins = keep(bins.repartitionByRange(*keys, "__v").withColumn("__range", F.spark_partition_id()), "bins")
    sums = bins.groupBy(*keys, "__range").agg(F.sum("__ties").alias("__sum"))  # a few rows per range
    whole = Window.partitionBy(*keys)
    earlier = whole.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumns({"__before": F.coalesce(F.sum("__sum").over(earlier), F.lit(0)), "__n": F.sum("__sum").over(whole)})
    # Places from 0: the lower and the upper of the middle.
    places = sums.withColumn("__place", F.explode(F.array_distinct(F.array(F.expr("(__n - 1) DIV 2"), F.expr("__n DIV 2")))))
    held = places.filter((F.col("__place") >= F.col("__before")) & (F.col("__place") < F.col("__before") + F.col("__sum"))).select(*keys, "__range", "__before", "__place")
    upto = Window.partitionBy(*keys, "__range", "__place").orderBy("__v").rowsBetween(Window.unboundedPreceding, 0)
    # At most two ranges of a group are looked into.
    inside = bins.join(held, [*keys, "__range"]).withColumn("__upto", F.col("__before") + F.sum("__ties").over(upto))
    found = inside.filter((F.col("__upto") > F.col("__place")) & (F.col("__upto") - F.col("__ties") <= F.col("__place")))
    return found.groupBy(*keys).agg((F.min("__v") * 0.5 + F.max("__v") * 0.5).alias(out))


def with_areas_seen(df: DataFrame, keys: Sequence[str], area: str, out: str) -> DataFrame:
    """The sorted set of areas in which an entity qualifies, beside each of its rows."""
    areas = df.groupBy(*keys).agg(F.array_sort(F.collect_set(area)).alias(out))
    return df.join(areas, list(keys))
