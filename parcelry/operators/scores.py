"""The four scores. They answer different questions and are never merged into one."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parcelry.functions.columns import lead_tier, round_half_up, sample_confidence
from parcelry.operators.ranks import most_common_display, with_areas_seen, with_group_median, with_percentile_rank, with_percentile_ranks
from parcelry.sources.scratch import keep


@dataclass(frozen=True)
class GateThresholds:
    """An area passes a gate at its threshold and fails just past it."""

    min_share_in_band: float = 0.35
    max_anchor_km: float = 8.0
    min_clean_share: float = 0.75
    min_comps: float = 25
    max_days_on_market: float = 60.0
    min_resales: float = 20


@dataclass(frozen=True)
class CompositeCaps:
    """Scales that turn metrics into shares."""

    anchor_km: float = 8.0
    comps: float = 60.0
    days_on_market: float = 60.0
    resales: float = 50.0


def with_gates(df: DataFrame, t: GateThresholds = GateThresholds()) -> DataFrame:
    """The names of the failed gates, and whether none failed."""
    checks = {
        "product_in_band": F.col("share_in_band") < t.min_share_in_band,
        "demand_adjacent": F.col("anchor_km") > t.max_anchor_km,
        "clean_title": F.col("clean_share") < t.min_clean_share,
        "comp_density": F.col("comps") < t.min_comps,
        "resale_velocity": (F.col("days_on_market") > t.max_days_on_market) | (F.col("resales") < t.min_resales),
    }
    failed = F.array_compact(F.array(*[F.when(fails, F.lit(name)) for name, fails in checks.items()]))
    return df.withColumn("failed_gates", failed).withColumn("eligible", F.size("failed_gates") == 0)


def with_composite(df: DataFrame, caps: CompositeCaps = CompositeCaps()) -> DataFrame:
    """Five sub-scores, and the mean of the rounded five for eligible areas."""
    left = lambda c, cap: F.greatest(F.lit(0.0), 1 - F.col(c) / cap)
    up_to = lambda c, cap: F.least(F.col(c) / cap, F.lit(1.0))
    parts = {
        "price_score": F.col("share_in_band"),
        "anchor_score": left("anchor_km", caps.anchor_km),
        "clean_score": F.col("clean_share"),
        "comp_score": up_to("comps", caps.comps),
        "velocity_score": (left("days_on_market", caps.days_on_market) + up_to("resales", caps.resales)) / 2,
    }
    df = df.withColumns({name: round_half_up(c, 4) for name, c in parts.items()})
    mean = sum((F.col(name) for name in parts), F.lit(0.0)) / len(parts)
    return df.withColumn("composite", F.when(F.col("eligible"), round_half_up(mean, 4)))


def rank_corridors(df: DataFrame, thresholds: GateThresholds = GateThresholds(), caps: CompositeCaps = CompositeCaps()) -> DataFrame:
    """Eligible areas first by composite, the others after; equal scores in the order of ``ordinal``."""
    return with_composite(with_gates(df, thresholds), caps).orderBy(F.desc("eligible"), F.desc_nulls_last("composite"), "ordinal")


def listing_fit(df: DataFrame, keys: Sequence[str], band: tuple[float, float], density_cap: int = 10, recency_days: float = 30) -> DataFrame:
    """Per entity the shares of listings in the band, ready and with a registration, its density and its freshness, and their mean."""
    share = lambda c: F.avg(F.when(c, 1.0).otherwise(0.0))
    fresh = F.avg(F.greatest(F.lit(0.0), 1 - F.col("age") / recency_days))
    parts = {
        "band_share": share(F.coalesce(F.col("price").between(*band), F.lit(False))),
        "ready_share": share(F.col("ready")),
        "registered_share": share(F.col("registered")),
        "density": F.least(F.count("*") / density_cap, F.lit(1.0)),
        "freshness": F.coalesce(fresh, F.lit(0.5)),
    }
    scored = df.groupBy(*keys).agg(F.count("*").alias("n_listings"), *[round_half_up(c, 4).alias(n) for n, c in parts.items()])
    return scored.withColumn("fit", round_half_up(sum((F.col(n) for n in parts), F.lit(0.0)) / len(parts), 4))


def listing_leads(df: DataFrame, strong: Sequence[str], weak: Sequence[str], area_keys: Sequence[str], listed: DataFrame, entity: str, below: float = 0.7, points: tuple[int, int, int] = (40, 20, 10)) -> DataFrame:
    """Lead points of each listing: strong flags, weak flags, a price per area below a share of its area's median, and an entity on a list."""
    per_area = F.col("price") / F.nullif(F.col("area"), F.lit(0))
    df = with_group_median(df, area_keys, per_area, "median_per_area").join(listed.select(entity, F.lit(True).alias("__listed")).distinct(), entity, "left")
    signals = [(f, F.col(f), points[0]) for f in strong] + [(f, F.col(f), points[1]) for f in weak]
    signals += [("below_market", per_area < below * F.col("median_per_area"), points[2]), ("listed_entity", F.col("__listed"), points[2])]
    hit = lambda c: F.coalesce(c, F.lit(False))
    score = sum((F.when(hit(c), p).otherwise(0) for _, c, p in signals), F.lit(0))
    matched = F.array_compact(F.array(*[F.when(hit(c), F.lit(name)) for name, c, _ in signals]))
    return df.withColumns({"matched_signals": matched, "lead_score": score}).withColumn("tier", lead_tier(F.col("lead_score"))).drop("__listed", "median_per_area")


def absentee_density(leads: DataFrame, keys: Sequence[str], most: int = 280) -> DataFrame:
    """Per entity the mean lead score, counts by tier, and the mean as a share of the most possible points."""
    counts = [F.count_if(F.col("tier") == t).alias(f"n_{t}") for t in ("hot", "warm", "cold")]
    out = leads.groupBy(*keys).agg(round_half_up(F.avg("lead_score"), 2).alias("mean_score"), *counts)
    return out.withColumn("density", round_half_up(F.col("mean_score") / most, 4))


def corridor_absentee(
    df: DataFrame, keys: Sequence[str], stale_days: int = 90, distressed_days: int = 60, below: float = 0.85, weights: tuple[float, float, float] = (0.45, 0.35, 0.20), decay: float = 5
) -> DataFrame:
    """Per area: mean age and stale share of known ages, vacant and distressed shares of all rows, and a score bounded by 10.

    Shares are in percent. The score is NULL where the stale or the distressed share is.
    """
    per_area = F.when(F.col("price") > 0, F.col("price")) / F.when(F.col("area") > 0, F.col("area"))
    df = with_group_median(df, keys, per_area, "__median")
    distressed = F.coalesce((per_area < below * F.col("__median")) & (F.col("age") >= distressed_days), F.lit(False))
    known = F.nullif(F.count("age"), F.lit(0))
    out = df.groupBy(*keys).agg(
        F.count("*").alias("n_listings"),
        round_half_up(F.avg("age"), 2).alias("avg_age"),
        (100 * F.count_if(F.col("age") >= stale_days) / known).alias("stale_pct"),
        (100 * F.count_if("vacant") / F.count("*")).alias("vacancy_pct"),
        F.when(F.max("__median").isNotNull(), 100 * F.count_if(distressed) / F.count("*")).alias("distressed_pct"),
    )
    raw = F.col("stale_pct") * weights[0] + F.col("vacancy_pct") * weights[1] + F.col("distressed_pct") * weights[2]
    out = out.withColumn("absentee_score", round_half_up(10 * (1 - F.exp(-raw / decay)), 1))
    return out.withColumns({c: round_half_up(F.col(c), 2) for c in ("stale_pct", "vacancy_pct", "distressed_pct")})


def society_vacancy(df: DataFrame, keys: Sequence[str], days: tuple[int, int] = (60, 90), cap: float = 180) -> DataFrame:
    """Per entity, over listings of known age: counts past two ages, mean age, stale rate and the mean of rate and capped age."""
    known = df.filter(F.col("age").isNotNull())
    rate = F.count_if(F.col("age") >= days[1]) / F.count("*")
    out = known.groupBy(*keys).agg(
        F.count("*").alias("n_known"),
        F.count_if(F.col("age") >= days[0]).alias("n_first"),
        F.count_if(F.col("age") >= days[1]).alias("n_second"),
        round_half_up(F.avg("age"), 1).alias("avg_age"),
        round_half_up(rate, 4).alias("stale_rate"),
        round_half_up((rate + F.least(F.avg("age") / cap, F.lit(1.0))) / 2, 4).alias("vacancy_probability"),
    )
    return out.withColumn("confidence", sample_confidence(F.col("n_known")))


def band_metrics(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Supply, mean known age and coefficient of variation of the price."""
    return df.groupBy(*keys).agg(
        F.count("*").alias("supply"), round_half_up(F.avg("age"), 1).alias("velocity_days"), F.coalesce(round_half_up(F.stddev_samp("price") / F.avg("price"), 4), F.lit(0.0)).alias("price_cov")
    )


def weighted_rating(rating: Column, reviews: Column) -> Column:
    return rating / 5 * F.log1p(F.coalesce(reviews, F.lit(0)).cast("double"))


def society_fit(df: DataFrame, ratings: DataFrame, city: str, corridor: str, entity: str, display: str, order: Sequence[str], min_listings: int = 3, weights: tuple[float, float, float, float] = (0.3, 0.3, 0.2, 0.2)) -> DataFrame:
    """Score 0 to 10 of every entity with enough in-band listings, from percentile ranks within its city.

    Ranks are taken of rounded metrics; age and price spread count inverted, and an unknown
    age as the middle. Without a rating the other three weights are scaled up. ``ratings`` holds ``entity``, ``rating``, ``reviews`` per city.
    """
    keys = [city, corridor, entity]
    # One row per listing, read by the metrics and twice by the spellings.
    df = keep(df.select(*dict.fromkeys([*keys, display, *order, "price", "age"])), "listings")
    groups = band_metrics(df, keys).filter(F.col("supply") >= min_listings)
    groups = groups.join(most_common_display(df, keys, display, order, "display"), keys)
    groups = groups.join(ratings.select(city, entity, "rating", "reviews"), [city, entity], "left").withColumn("rating_value", weighted_rating(F.col("rating"), F.col("reviews")))
    groups = with_areas_seen(groups, [city, entity], corridor, "appears_in")
    # One row per entity, read five times.
    groups = with_percentile_ranks(keep(groups, "entities"), [city], {"supply": "supply_rank", "velocity_days": "velocity_rank", "price_cov": "cov_rank", "rating_value": "rating_rank"})
    w = weights
    base = w[0] * F.col("supply_rank") + w[1] * F.coalesce(1 - F.col("velocity_rank"), F.lit(0.5)) + w[2] * (1 - F.col("cov_rank"))
    score = F.when(F.col("rating_rank").isNull(), base / (w[0] + w[1] + w[2])).otherwise(base + w[3] * F.col("rating_rank"))
    return groups.withColumn("fit_score", round_half_up(10 * score, 1)).drop("rating_value", "supply_rank", "velocity_rank", "cov_rank", "rating_rank")


def broker_activity(df: DataFrame, city: str, corridor: str, agent: str, link: str, display: str | None = None, order: Sequence[str] = ()) -> DataFrame:
    """Listings per agent and area (distinct links, and every row without one), scored by percentile rank within the city; with the most frequent ``display``, if it is given."""
    keys = [city, corridor, agent]
    linked = F.nullif(F.col(link), F.lit(""))
    counted = df.groupBy(*keys).agg((F.count_distinct(linked) + F.count_if(linked.isNull())).alias("n_listings"))
    counted = counted.join(most_common_display(df, keys, display, order, "display"), keys) if display else counted
    counted = keep(counted, "agents")
    ranked = with_percentile_rank(counted, [city], "n_listings", "rank")
    return ranked.withColumn("activity_score", round_half_up(10 * F.col("rank"), 1)).drop("rank")


def ranked_society_table(fit: DataFrame, density: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Fit scores with the absentee density beside them; entities without leads keep NULL scores and zero counts."""
    counts = {c: F.coalesce(F.col(c), F.lit(0)) for c in ("n_hot", "n_warm", "n_cold")}
    return fit.join(density, list(keys), "left").withColumns(counts).orderBy(F.desc("fit"), *keys)


def share_of_max(df: DataFrame, value: str, out: str) -> DataFrame:
    """Each row's value as a share of the largest, for bars; at least 1 is taken as the largest."""
    top = df.agg(F.greatest(F.max(value), F.lit(1)).alias("__max"))
    return df.join(F.broadcast(top)).withColumn(out, F.col(value) / F.col("__max")).drop("__max")  # one row
