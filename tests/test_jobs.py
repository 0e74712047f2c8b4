"""The composite jobs on small invented listings."""

from pyspark.sql import functions as F

from parcelry.plans import jobs

COLUMNS = "id long, city string, corridor string, society_name_raw string, price_inr long, days_since_posted int, description_raw string, role string, poster string, detail_url string, duplicate_of_id long"
ROWS = [
    (1, "m", "x", "Alpha CHS", 15, 3, "", "owner", "Ann Bee", "u1", None),
    (2, "m", "x", "alpha  chs", 15, 5, "", "owner", "Cee Dee", "u2", None),
    (3, "m", "y", "Alpha CHS", 15, 9, "", "owner", "cee dee", "u3", None),
    (4, "m", "x", "Alpha", 18, None, "never used flat", "agent", "GLOBAL", "u4", None),
    (5, "m", "x", "Alpha Phase 2", 12, 2, None, "agent", "Global", "u4", None),
    (6, "m", "x", "javascript:void(0)", 12, 2, None, "agent", "Magicbricks", "u5", None),
    (7, "n", "z", "Alpha", 12, 2, None, "owner", "Ann Bee", None, None),
    (8, "m", "x", "Alpha", 14, 1, "x", "owner", "Cee Dee", "u6", 2),
    (9, "m", "y", None, None, None, None, None, None, None, None),
]


def table(spark):
    return spark.createDataFrame(ROWS, COLUMNS)


def test_dedup_marks_within_a_project_and_price(spark):
    out = jobs.dedup_listings(table(spark))
    assert [tuple(r) for r in out.groups.collect()] == [(2, [3], [0.0], ["x", "y"])]
    assert {r["id"]: r["duplicate_of_id"] for r in out.listings.collect() if r["duplicate_of_id"]} == {3: 2, 8: 2}
    assert {r["city"]: (r["total"], r["canonical"], r["marked"]) for r in out.report.collect()} == {"m": (8, 6, 2), "n": (1, 1, 0)}
    assert jobs.dedup_listings(out.listings).groups.count() == 0


def test_candidates_and_brokers(spark):
    got = sorted((r["id"], r["signal"], r["score"]) for r in jobs.candidates(table(spark)).collect())
    assert got == [(2, "multi_property_owner", "2"), (3, "multi_property_owner", "2"), (4, "never_occupied", "confirmed_genuine")]
    agents = jobs.broker_activity(table(spark)).collect()
    assert [(r["agent"], r["display"], r["n_listings"], r["activity_score"]) for r in agents] == [("global", "GLOBAL", 1, 10.0)]


def test_society_fit_over_all_cities(spark):
    cities = spark.createDataFrame([("m", 10, 20), ("n", None, None)], "city_id string, price_min long, price_max long")
    ratings = spark.createDataFrame([], "city string, society string, rating double, reviews long")
    out = jobs.society_fit(table(spark), cities, ratings)
    got = [(r["corridor"], r["society_key"], r["supply"], r["candidate_ids"], r["n_candidates"]) for r in out.scores.collect()]
    assert got == [("x", "alpha", 4, [2, 4], 2)]
    assert sorted(tuple(r) for r in out.status.collect()) == [("m", "ok"), ("n", "skipped_no_price_band")]


def test_classify_takes_only_new_listings(spark):
    raw = spark.createDataFrame([(1, "2 BHK", "NRI owner"), (2, "3 BHK", "local")], "id long, title string, description_raw string")
    for c in ("price_raw", "carpet_area_raw", "posted_by_raw", "posted_recency_raw", "status", "society_name_raw"):
        raw = raw.withColumn(c, F.lit(None).cast("string"))
    done = spark.createDataFrame([(2,)], "id long")
    out = jobs.classify_listings(raw, done, "id", F.lit("2026-01-01").cast("date"), {"flag_nri": (r"(?i)\bnri\b", None)})
    assert [(r["id"], r["bhk"], r["flag_nri"]) for r in out.collect()] == [(1, 2, True)]


def test_enrich_asks_once_per_business_and_stores_answers_only(spark):
    df = spark.createDataFrame([("Pune", "ACME One", 1), ("Pune", "Acme one", 2), ("Pune", "ACME One", 3), ("Pune", "Held", 4), ("Pune", "Fails", 5), ("Pune", "Gone", 6)], "city string, name string, i int")
    cache = spark.createDataFrame([("Held Pune", True, "accepted")], "query string, matched boolean, note string")
    snapshot = spark.createDataFrame(
        [("ACME One Pune", "OK", "Acme", "Pune 1", "p", 4.0, 2), ("Fails Pune", "OVER_QUERY_LIMIT", None, None, None, None, None), ("Gone Pune", "ZERO_RESULTS", None, None, None, None, None)],
        "query string, status string, name string, formatted_address string, place_id string, rating double, reviews long",
    )
    out = jobs.enrich_from_snapshot(df, cache, snapshot, "city", "name", ["i"])
    assert sorted((r["query"], r["matched"], r["note"]) for r in out.lookups.collect()) == [("ACME One Pune", True, "accepted"), ("Gone Pune", False, "no result"), ("Held Pune", True, "accepted")]
    assert [tuple(r) for r in out.coverage.collect()] == [("Pune", 2, 1)]


def test_society_fit_computes_listings_once_for_scores_and_once_per_signal(spark):
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    df = table(spark)
    cities = spark.createDataFrame([("m", 10, 20), ("n", None, None)], "city_id string, price_min long, price_max long")
    ratings = spark.createDataFrame([], "city string, society string, rating double, reviews long")
    out = jobs.society_fit(df.mapInArrow(passed, df.schema), cities, ratings)
    out.scores.write.format("noop").mode("overwrite").save()
    assert seen.value <= 3 * len(ROWS)
