"""The given tables bound as listings: ``line_listings`` has a row per order line, ``order_listings`` a row per order."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BAND = (20000, 60000)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _places(spark: SparkSession, sf_dir: str) -> DataFrame:
    nation, region = read(spark, sf_dir, "nation"), read(spark, sf_dir, "region")
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select("n_nationkey", F.col("n_name").alias("corridor"), F.col("r_name").alias("city"))


def line_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings from order lines: the supplier's nation is the area, the part the project, the order the link."""
    line, part, supplier = (read(spark, sf_dir, t) for t in ("lineitem", "part", "supplier"))
    buyers = read(spark, sf_dir, "orders").join(read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "c_custkey")
    rows = line.join(part, F.col("l_partkey") == F.col("p_partkey")).join(supplier, F.col("l_suppkey") == F.col("s_suppkey")).join(buyers, F.col("l_orderkey") == F.col("o_orderkey"))
    rows = rows.join(_places(spark, sf_dir), F.col("s_nationkey") == F.col("n_nationkey"))
    suffix = F.when(F.col("p_size") % 3 == 0, " Phase 2").when(F.col("p_size") % 3 == 1, " CHS").otherwise("")
    agent = F.concat(F.lit("Agent: "), "s_name")
    owner = F.concat(F.lit("Owner: "), "c_mktsegment", F.lit(" "), F.col("c_custkey").cast("string"))
    return rows.select(
        F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey").alias("listing_id"),
        "l_orderkey",
        "l_linenumber",
        "l_partkey",
        "l_suppkey",
        "city",
        "corridor",
        F.concat("p_name", suffix).alias("society_raw"),
        F.lower("p_name").alias("society"),
        F.floor(F.col("l_extendedprice") + 0.5).alias("price"),
        F.floor("l_quantity").alias("area"),
        F.date_diff(F.lit("2002-01-01").cast("date"), F.col("l_shipdate").cast("date")).cast("long").alias("age"),
        F.when(F.col("l_suppkey") % 2 == 0, agent).otherwise(owner).alias("posted_by"),
        F.when(F.col("l_suppkey") % 2 == 0, F.lower("s_name")).alias("agent"),
        F.when(F.col("l_linestatus") == "O", "Ready to Move").otherwise("Under Construction").alias("status"),
        F.when(F.col("l_orderkey") % 10 == 0, "").otherwise(F.concat(F.lit("http://x/"), F.col("l_orderkey").cast("string"))).alias("url"),
        (F.col("l_returnflag") == "R").alias("registered"),
        (F.col("l_discount") >= 0.08).alias("vacant"),
    )


def order_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Listings from orders: every third owner has a one-word name, and every seventh order is already marked a duplicate."""
    customer = read(spark, sf_dir, "customer").join(_places(spark, sf_dir), F.col("c_nationkey") == F.col("n_nationkey"))
    rows = read(spark, sf_dir, "orders").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    name = F.when(F.col("c_custkey") % 3 == 0, F.col("c_name")).otherwise(F.concat("c_mktsegment", F.lit(" "), "c_name"))
    return rows.select(
        F.col("o_orderkey").alias("listing_id"),
        "city",
        "corridor",
        "c_custkey",
        F.concat(F.lit("Owner: "), name).alias("posted_by"),
        F.floor(F.col("o_totalprice") + 0.5).alias("price"),
        F.date_diff(F.lit("2002-01-01").cast("date"), F.col("o_orderdate").cast("date")).cast("long").alias("age"),
        F.col("o_orderstatus").alias("status"),
        F.lower("o_orderpriority").alias("society"),
        F.when(F.col("o_orderkey") % 7 == 0, F.col("o_orderkey") - 7).alias("duplicate_of_id"),
    )


def raw_listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order-line listings as the text fields that a listing source shows."""
    li = line_listings(spark, sf_dir)
    days = F.when(F.col("age") % 5 == 0, F.format_string("Posted: %s", F.date_format(F.date_sub(F.lit("2002-01-01").cast("date"), F.col("age").cast("int")), "MMM dd, ''yy")))
    days = days.when(F.col("age") % 5 == 1, F.format_string("Updated %d days ago", "age")).when(F.col("age") % 5 == 2, F.format_string("%d weeks", "area")).when(F.col("age") % 5 == 3, F.lit("Updated today"))
    price = F.when(F.col("price") % 2 == 0, F.format_string("Rs %.5f Lac", F.col("price") / 1e5)).otherwise(F.format_string("Rs %.7f Cr", F.col("price") / 1e7))
    return li.select(
        "listing_id",
        "city",
        F.col("corridor"),
        F.format_string("%d BHK Flat", F.col("area") % 5 + 1).alias("title"),
        F.col("society_raw").alias("society_name_raw"),
        F.when(F.col("area") % 11 == 0, "Call for price").otherwise(price).alias("price_raw"),
        "status",
        F.format_string("%,d sqft", F.col("area") * 100).alias("carpet_area_raw"),
        F.col("posted_by").alias("posted_by_raw"),
        days.alias("posted_recency_raw"),
        F.when(F.col("registered"), F.format_string("RERA approved, call +44 %d", "area")).otherwise("call +91 98").alias("description_raw"),
        F.col("url").alias("detail_url"),
    )


def cities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A price band for every city but the one with the largest key."""
    region = read(spark, sf_dir, "region")
    has = F.col("r_regionkey") < 4
    return region.select(F.col("r_name").alias("city_id"), F.when(has, F.lit(BAND[0])).cast("long").alias("price_min"), F.when(has, F.lit(BAND[1])).cast("long").alias("price_max"))


def corridor_metrics(spark: SparkSession, sf_dir: str, li: DataFrame | None = None) -> DataFrame:
    """Candidate areas with metrics aggregated from their listings."""
    li = line_listings(spark, sf_dir) if li is None else li
    in_band = F.col("price").between(*BAND)
    out = li.groupBy("city", "corridor").agg(
        F.avg(F.when(in_band, 1.0).otherwise(0.0)).alias("share_in_band"),
        (F.min("l_suppkey") % 10 + F.count("*") % 3).cast("double").alias("anchor_km"),
        F.avg(F.when(F.col("registered"), 0.5).otherwise(1.0)).alias("clean_share"),
        (F.count("*") % 90).cast("double").alias("comps"),
        (F.sum("age") % 75).cast("double").alias("days_on_market"),
        (F.count_if("vacant") % 60).cast("double").alias("resales"),
    )
    ordinal = read(spark, sf_dir, "nation").select(F.col("n_name").alias("corridor"), F.col("n_nationkey").alias("ordinal"))
    return out.join(ordinal, "corridor")
