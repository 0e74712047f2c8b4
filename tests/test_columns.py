"""Value tables of the column rules."""

import pytest
from pyspark.sql import functions as F

from parcelry.functions import columns as C


def values(spark, rule, inputs):
    df = spark.createDataFrame([(i, x) for i, x in enumerate(inputs)], "i int, x string")
    return [r["y"] for r in df.select("i", rule(F.col("x")).alias("y")).orderBy("i").collect()]


AS_OF = "2026-07-05"
CASES = {
    "price": (lambda c: C.price_inr(c), {"₹1.25 Cr": 12500000, "85 lac": 8500000, "Call": None, "1.2.3 Cr": None, "": None, None: None}),
    "area": (lambda c: C.area_sqft(c), {"1,250 sqft": 1250, "900 SQFT": 900, "90 sqm": None}),
    "bhk": (lambda c: C.bhk(c), {"3 BHK Flat": 3, "Studio": None}),
    "role": (lambda c: C.role(c), {"Owner: A B": "owner", "Dealer: X": "agent", "Agent: X": "agent", "Builder: X": "agent", "Seller: X": "unknown", "": "unknown", None: "unknown"}),
    "days": (
        lambda c: C.days_since(c, F.lit(AS_OF).cast("date")),
        {"Updated today": 0, "Posted: Yesterday": 1, "Updated 15 hours ago": 0, "Updated 3 days ago": 3, "2 weeks": 14, "2 months": 60, "Posted: May 07, '26": 59, "Feb 30, '26": None, "Jul 09, '26": 0, "September 12, 2025": None, "5 minutes ago": None, None: None, "99999999999 hours ago": 0, "999999999 weeks": None},
    ),
    "possession": (lambda c: C.possession_status(c), {"Ready to Move": "ready_to_move", "Under Construction": "under_construction", "New": "unknown", None: "unknown"}),
    "intl": (lambda c: C.intl_contact_hint(c), {"call +44 7": True, "+91 98": False, "+1-2": True, None: False}),
    "poster": (lambda c: C.poster_name(c), {"Owner: A B ": "A B", "Owner:": None, "no colon": None, "a: b: c": "b: c"}),
    "entity": (
        lambda c: C.entity_key(C.name_key(c)),
        {"Alpha Phase 1 CHS": "alpha", "Beta C Wing": "beta", "Society": "society", "CHS Society": "chs", "Apartment Phase 2 CHS": "apartment", "A Wing Wing B": "a wing", "X Co-op Housing Society CHS": "x co-op housing", "x" + " chs" * 12: "x", "y" + " phase 1 society wing b" * 40: "y", "": "", None: None},
    ),
    "tier": (lambda c: C.lead_tier(c.cast("int")), {"60": "hot", "59": "warm", "30": "warm", "29": "cold"}),
    "confidence": (lambda c: C.sample_confidence(c.cast("int")), {"2": "low", "3": "medium", "9": "medium", "10": "high"}),
    "url name": (
        lambda c: C.name_from_url(c, F.lit("metro"), F.array(F.lit("hill-view"), F.lit("view"))),
        {"http://s/blue-arch-hill-view-metro-pdpid-4d": "Blue Arch", "javascript:void(0)": None, "#": None, "http://s/plain": None, "/p/my-home-metro-pdpid-1": "My Home", "HTTP://h/my-home-metro": "My Home", "https://h/my-home--metro": "My Home", "ftp://h/my-home": None, "my-home": None, "http://h/-view": None, "http://h/my-home-pdpid-1/": None, "": None, None: None},
    ),
    "display": (lambda c: C.display_score(c.cast("double")), {"0.76": 7.6, "0.125": 1.3, None: None}),
}


@pytest.mark.parametrize("name", CASES)
def test_column_rule(spark, name):
    rule, table = CASES[name]
    assert values(spark, rule, list(table)) == list(table.values())


def test_first_text_and_keywords(spark):
    row = spark.createDataFrame([("", "b", "Never Used, unused flat")], "a string, b string, t string").select(
        C.first_text(F.col("a"), F.col("b")).alias("f"), C.matched_keywords(F.col("t"), ("unused", "vacant", "never used")).alias("k"), C.strip_tokens(F.col("t"), ("Used", "flat")).alias("s")
    ).first()
    assert row["f"] == "b" and row["k"] == ["unused", "never used"] and row["s"] == "never , un "
