"""Boundaries of the listing operators on small invented rows."""

import re
import difflib
import math
import random

import pytest
from pyspark.sql import functions as F

from parcelry.functions import columns as C
from parcelry.operators import duplicates, exports, listings, matching, pages, ranks, scores, signals
from parcelry.plans import jobs
from parcelry.sources import files, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


@pytest.mark.parametrize("method", ["histogram", "window"])
@pytest.mark.parametrize("given, want", [([7], [1.0]), ([1, 2, 2, 3], [0, 0.5, 0.5, 1]), ([5, 5, 5], [0.5] * 3), ([None, 4], [None, 1.0])])
def test_percentile_rank(spark, method, given, want):
    df = spark.createDataFrame([("c", i, v) for i, v in enumerate(given)], "city string, i int, v int")
    assert [r["r"] for r in ranks.with_percentile_rank(df, ["city"], "v", "r", method).orderBy("i").collect()] == want


def test_percentile_rank_against_the_formula(spark):
    rng = random.Random(1)
    data = [(rng.choice("ab"), i, rng.randrange(9)) for i in range(200)]
    got = {r["i"]: r["r"] for r in ranks.with_percentile_rank(spark.createDataFrame(data, "city string, i int, v int"), ["city"], "v", "r").collect()}
    for city in "ab":
        own = sorted(v for c, _, v in data if c == city)
        for c, i, v in data:
            if c == city:
                places = [p for p, x in enumerate(own) if x == v]
                assert math.isclose(got[i], sum(places) / len(places) / (len(own) - 1))


def test_most_common_display_takes_the_first_seen_of_a_tie(spark):
    names = ["GLOBAL", "Global", "Global", "GLOBAL"]
    df = spark.createDataFrame([("k", n, i) for i, n in enumerate(names)], "k string, n string, i int")
    assert rows(ranks.most_common_display(df, ["k"], "n", ["i"], "d")) == [("k", "GLOBAL")]


def gate_row(**change):
    base = dict(name="a", ordinal=1, share_in_band=0.35, anchor_km=8.0, clean_share=0.75, comps=25.0, days_on_market=60.0, resales=20.0)
    return base | change


def test_gates_pass_at_the_threshold_and_fail_past_it(spark):
    cases = [gate_row(), gate_row(share_in_band=0.349), gate_row(anchor_km=8.01), gate_row(clean_share=0.74), gate_row(comps=24.0), gate_row(resales=19.0, days_on_market=61.0)]
    df = spark.createDataFrame([c | {"ordinal": i} for i, c in enumerate(cases)])
    got = [r["failed_gates"] for r in scores.with_gates(df).orderBy("ordinal").collect()]
    assert got == [[], ["product_in_band"], ["demand_adjacent"], ["clean_title"], ["comp_density"], ["resale_velocity"]]


def test_composite_of_a_published_row(spark):
    df = spark.createDataFrame([gate_row(share_in_band=0.58, anchor_km=0.8, clean_share=0.82, comps=55.0, days_on_market=38.0, resales=40.0)])
    r = scores.rank_corridors(df).first()
    assert [r[c] for c in ("price_score", "anchor_score", "clean_score", "comp_score", "velocity_score")] == [0.58, 0.9, 0.82, 0.9167, 0.5833]
    assert round(r["composite"] * 10, 1) == 7.6


@pytest.mark.parametrize("stale, want", [(10.5, 8.8), (12, 9.1), (3.566, 5.1)])
def test_absentee_curve(spark, stale, want):
    raw = F.lit(float(stale))
    assert spark.range(1).select((F.floor(10 * (1 - F.exp(-raw / 5)) * 10 + 0.5) / 10).alias("s")).first()["s"] == want


def test_corridor_absentee_keeps_its_three_denominators(spark):
    data = [("c", 100, 10, 95, True), ("c", 100, 10, None, False), ("c", 50, 10, 70, False), ("c", 100, 10, 10, False)]
    r = scores.corridor_absentee(spark.createDataFrame(data, "corridor string, price long, area long, age int, vacant boolean"), ["corridor"]).first()
    assert (r["n_listings"], r["stale_pct"], r["vacancy_pct"], r["distressed_pct"]) == (4, 33.33, 25.0, 25.0)
    unknown = spark.createDataFrame([("c", 100, 10, None, False)], "corridor string, price long, area long, age int, vacant boolean")
    assert scores.corridor_absentee(unknown, ["corridor"]).first()["absentee_score"] is None


def test_society_fit_without_rating_and_with_unknown_age(spark):
    data = [("m", c, s, s.upper(), p, a, i) for i, (c, s, p, a) in enumerate([("x", "a", 10, 5), ("x", "a", 12, 7), ("x", "a", 14, 9), ("y", "a", 10, None), ("y", "a", 10, None), ("y", "a", 11, None), ("x", "b", 10, 50), ("x", "b", 30, 60), ("x", "b", 90, 70), ("x", "b", 10, 80), ("x", "few", 10, 1)])]
    df = spark.createDataFrame(data, "city string, corridor string, society string, shown string, price long, age int, i int")
    ratings = spark.createDataFrame([("m", "b", 4.0, 100)], "city string, society string, rating double, reviews long")
    got = {(r["corridor"], r["society"]): r for r in scores.society_fit(df, ratings, "city", "corridor", "society", "shown", ["i"]).collect()}
    assert set(got) == {("x", "a"), ("y", "a"), ("x", "b")}
    assert got["y", "a"]["velocity_days"] is None and got["y", "a"]["appears_in"] == ["x", "y"]
    assert got["y", "a"]["fit_score"] == math.floor(10 * (0.3 * 0.25 + 0.3 * 0.5 + 0.2 * 1.0) / 0.8 * 10 + 0.5) / 10
    assert got["x", "b"]["fit_score"] == 5.0  # supply 1, velocity 0, consistency 0, rating 1


def test_broker_count(spark):
    data = [("m", "x", "g", u, "G", i) for i, u in enumerate(["u1", "u1", "u2", None, ""])]
    out = scores.broker_activity(spark.createDataFrame(data, "city string, corridor string, agent string, url string, shown string, i int"), "city", "corridor", "agent", "url", "shown", ["i"])
    assert out.first()["n_listings"] == 4 and out.first()["activity_score"] == 10.0


def test_broker_activity_without_a_spelling(spark, monkeypatch):
    monkeypatch.setattr(scores, "most_common_display", None)  # not called
    data = [("m", "x", "g", "u1"), ("m", "x", "g", None), ("m", "x", "h", "u2"), ("m", None, "g", "u3")]
    out = scores.broker_activity(spark.createDataFrame(data, "city string, corridor string, agent string, url string"), "city", "corridor", "agent", "url")
    assert sorted(rows(out), key=repr) == sorted([("m", "x", "g", 2, 10.0), ("m", "x", "h", 1, 2.5), ("m", None, "g", 1, 2.5)], key=repr)


def test_multi_listing_owners(spark):
    data = [(1, "m", "ann bee"), (2, "m", "ann bee"), (3, "m", "ann bee"), (4, "m", "solo"), (5, "m", "solo"), (6, "m", "mb user"), (7, "m", "mb user"), (8, "m", None)]
    out = signals.multi_listing_owners(spark.createDataFrame(data, "id long, city string, owner string"), "id", "city", "owner")
    assert rows(out.select("id", "score", "evidence"), "id") == [(1, "3", "siblings: 2, 3"), (2, "3", "siblings: 1, 3"), (3, "3", "siblings: 1, 2")]


def test_exclusive_sample(spark):
    data = [("m", "x", "g", "u1", "g"), ("m", "x", "g", "u0", "g"), ("m", "x", None, "u0", "an owner"), ("m", "y", "h", "u2", "h"), ("m", "y", None, "u2", "mb user")]
    out = signals.exclusive_sample(spark.createDataFrame(data, "city string, corridor string, agent string, url string, who string"), ["city"], "url", "who", ["city", "corridor", "agent"], "agent IS NOT NULL")
    assert rows(out, "corridor") == [("m", "x", "g", "u1"), ("m", "y", "h", None)]


def leaders(items, how, threshold=0.6):
    """The plain loop: (id, text, owner) in id order."""
    out, clusters = [], []
    for i, text, owner in sorted(items):
        for c in clusters:
            words, own = set(c[1].split()), set(text.split())
            near = len(words & own) / max(len(words | own), 1) if how == "jaccard" else difflib.SequenceMatcher(None, c[1], text, autojunk=how == "parity").ratio()
            near = near if c[1] and text else 0.0
            if near >= threshold or (owner and owner == c[2]):
                out.append((c[0], i, round(near, 4)))
                break
        else:
            clusters.append((i, text, owner))
    return out


@pytest.mark.parametrize("how", ["ratio", "parity", "jaccard"])
def test_leader_clusters_match_a_plain_loop(spark, how):
    rng = random.Random(2)
    data = [(k, i, "".join(rng.choice("ab ") for _ in range(12)), rng.choice([None, None, "p", "q"]), "x") for k in "uvw" for i in rng.sample(range(1000), 30)]
    data += [(k, 1000 + i, rng.choice(["a a bb", "ab ba", "  ", "", "a a bb"]), rng.choice([None, "p", "q", ""]), "x") for i, k in enumerate("uvw" * 40)]
    data += [("solo", 5, "text", None, "x"), (None, 6, "text", None, "x")]
    pairs = duplicates.find_duplicates(spark.createDataFrame(data, "k string, id long, t string, o string, c string"), ["k"], "id", "t", "o", "c", similarity=how)
    want = sorted(p for k in "uvw" for p in leaders([(i, t, o) for kk, i, t, o, _ in data if kk == k], how))
    assert sorted(tuple(r)[:3] for r in pairs.collect()) == want


def test_equal_owner_joins_and_empty_texts_do_not(spark):
    df = spark.createDataFrame([("k", 1, "", "p", "x"), ("k", 2, "", "q", "y"), ("k", 3, "", "q", "x"), ("k", 4, "", None, "z")], "k string, id long, t string, o string, c string")
    groups = duplicates.duplicate_groups(duplicates.find_duplicates(df, ["k"], "id", "t", "o", "c"))
    assert rows(groups) == [(2, [3], [0.0], ["x", "y"])]
    marked = duplicates.apply_marks(df.withColumn("duplicate_of_id", F.lit(None).cast("long")), duplicates.find_duplicates(df, ["k"], "id", "t", "o", "c"), "id")
    assert rows(marked.select("id", "duplicate_of_id"), "id") == [(1, None), (2, None), (3, 2), (4, None)]


@pytest.mark.parametrize("how", ["levenshtein", "parity"])
def test_resolve(spark, how):
    dim = spark.createDataFrame([(1, "Green Meadow Park"), (2, "Blue Arch"), (3, "Ash")], "dim_id long, name string")
    names = spark.createDataFrame([(1, "green  meadow park"), (2, "Green Meadow Parc"), (3, "Unrelated Name"), (4, None), (5, "Blue Arck"), (6, "")], "i int, n string")
    out = matching.resolve(names, "i", "n", dim, how=how)
    assert rows(out.select("i", "dim_id"), "i") == [(1, 1), (2, 1), (3, None), (4, None), (5, 2), (6, None)]
    assert rows(matching.match_report(out, "n")) == [(6, 2, 3, 0.75)]


def test_resolve_finds_every_match_at_the_cutoff(spark):
    rng = random.Random(3)
    known = ["".join(rng.choice("abcde") for _ in range(rng.randrange(4, 24))) for _ in range(60)]
    given = []
    for name in known:
        letters = list(name)
        for _ in range(rng.randrange(0, 3)):
            letters[rng.randrange(len(letters))] = rng.choice("abcdez")
        given.append("".join(letters))
    out = matching.resolve(spark.createDataFrame(list(enumerate(given)), "i int, n string"), "i", "n", spark.createDataFrame(list(enumerate(known)), "dim_id int, name string"))
    def near(a, b):
        d = list(range(len(b) + 1))
        for x, ca in enumerate(a, 1):
            d, old = [x], d
            for y, cb in enumerate(b, 1):
                d.append(min(old[y] + 1, d[-1] + 1, old[y - 1] + (ca != cb)))
        return 1 - d[-1] / max(len(a), len(b))
    for r in out.collect():
        best = max(near(given[r["i"]], k) for k in known)
        assert (r["dim_id"] is not None) == (best >= 0.85)


def test_seed_split_and_upsert(spark):
    dim = spark.createDataFrame([(4, "Blue")], "dim_id long, name string")
    assert rows(matching.seed_dimension(dim, spark.createDataFrame([("blue",), ("Ash",), ("Zed",)], "name string")), "dim_id") == [(4, "Blue"), (5, "Ash"), (6, "Zed")]
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert rows(matching.upsert(old, new, ["k"]), "k") == [(1, "a"), (2, "c"), (3, "d")]


def test_confidence_match(spark):
    subjects = spark.createDataFrame([("q1", "Acme Realty", "Pune"), ("q2", "Acme Realty", "Pune"), ("q3", "Acme Realty", "Pune"), ("q4", "Acme Realty", "Pune")], "query string, name string, city string")
    snapshot = spark.createDataFrame([("q1", "OK", "ACME", "1 Road, Pune", "p1", 4.0, 3), ("q2", "OK", "ACME", "Mumbai", "p2", 4.0, 3), ("q3", "OK", "Other Realty", "Pune", "p3", 4.0, 3)], "query string, status string, name string, formatted_address string, place_id string, rating double, reviews long")
    got = rows(matching.confidence_match(subjects, snapshot, "name", "city").select("query", "matched", "note", "place_id"), "query")
    assert got == [("q1", True, "accepted", "p1"), ("q2", False, "city differs", None), ("q3", False, "name differs", None), ("q4", False, "no result", None)]


def test_page_facts(spark):
    html = [
        "<title> A\n b </title> RERA: P52100012345 with 450 units, ready to move",
        "<title>t</title><meta name=\"description\" content=\"words first\"> AB1234567890 far from any mark" + " " * 80 + "rera",
        "x" * 10 + " P52100012345 rera",
        None,
    ]
    out = pages.page_facts(spark.createDataFrame(list(enumerate(html)), "i int, html string"), "html").orderBy("i").collect()
    assert [r["registration"] for r in out] == ["P52100012345", None, "P52100012345", None]
    assert (out[0]["units"], out[0]["possession"], out[0]["description"]) == (450, "ready to move", "A b")
    assert out[1]["description"] == "words first" and out[3]["description"] is None


def first_registration(page):
    for m in re.finditer(r"\b[A-Z]{1,3}\d{10,13}\b", page):
        if "rera" in page[max(0, m.start() - 60) : m.end() + 10].lower():
            return m.group()


def test_registrations_equal_a_plain_search(spark):
    rng = random.Random(4)
    pieces = ["P12345678901", "MH1234567890", "abcdefg", "RERA", "rera ", " ", "x" * 55, "ab ", "P1234567890123", "P1"]
    html = ["P12345678901 abcdefg RERA", "P12345678901 abcd RERA", "MH1234567890 rera P12345678901", "rera" + "x" * 55 + " P12345678901", "rera" + "x" * 56 + " P12345678901", ""]
    html += [" ".join(rng.choice(pieces) for _ in range(rng.randrange(1, 12))) for _ in range(200)]
    out = pages.page_facts(spark.createDataFrame(list(enumerate(html)), "i int, html string"), "html").orderBy("i").collect()
    assert [r["registration"] for r in out] == [first_registration(p) for p in html] and out[0]["registration"] is None


def test_an_empty_description_is_kept(spark):
    html = '<title>t</title><meta name="description" content=" ">'
    assert pages.page_facts(spark.createDataFrame([(html,)], "html string"), "html").first()["description"] == ""


def test_age_histogram_and_volume(spark):
    df = spark.createDataFrame([(a,) for a in (30, 31, 60, 61, 90, 91, None)], "age int")
    assert [n for _, _, n in rows(exports.age_histogram(df, "age").select("ordinal", "bucket", "n"), "ordinal")] == [1, 2, 2, 1, 1]


def test_backfill_takes_the_last_signal(spark):
    df = spark.createDataFrame([(1, "old"), (2, "old")], "id int, evidence string")
    new = spark.createDataFrame([(1, "first", 1), (1, "second", 2)], "id int, evidence string, o int")
    assert rows(exports.backfill_column(df, new, "id", "evidence", "o", "none"), "id") == [(1, "second"), (2, "none")]


def test_band_skips_cities_without_one(spark):
    cities = spark.createDataFrame([("a", 10, 20), ("b", None, None)], "city_id string, price_min long, price_max long")
    kept, skipped = listings.in_band(spark.createDataFrame([("a", 10), ("a", 21), ("b", 15)], "city string, price long"), cities)
    assert rows(kept) == [("a", 10)] and rows(skipped) == [("b", "skipped_no_price_band")]


def test_replace_slice_empties_a_city_and_keeps_the_others(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "city string, v int")
    for city in "ab":
        files.replace_slice(df, path, "city", city)
    files.replace_slice(df.filter("v > 1"), path, "city", "a")
    assert rows(spark.read.parquet(path).select("city", "v")) == [("b", 2)]


def test_csv_round_trip_and_raw_append(spark, tmp_path):
    df = spark.createDataFrame([("a\nb", [1, 2], True, None), ('q"x', [], False, 3)], "s string, l array<int>, f boolean, n int")
    files.write_csv(df, str(tmp_path / "c"), ["s", "l", "f", "n"])
    back = files.read_csv(spark, str(tmp_path / "c"))
    assert sorted(tuple(x or "" for x in r) for r in back.collect()) == [("a\nb", "1;2", "1", ""), ('q"x', "", "0", "3")]
    for _ in range(2):
        files.append_raw(spark.createDataFrame([("m", 1)], "city string, price int"), str(tmp_path / "raw"), "city")
    raw = spark.read.parquet(str(tmp_path / "raw"))
    assert raw.count() == 2 and listings.decode_payload(raw, "raw_text", ("price",)).first()["price"] == "1"
    (tmp_path / "cities.json").write_text('{"a": ["x", "y"], "b": []}')
    assert rows(files.load_seed_corridors(spark, str(tmp_path / "cities.json"))) == [("a", 0, "x"), ("a", 1, "y")]
    (tmp_path / "conf.json").write_text('{"city_id": "a", "price_min": 1, "price_max": 2}')
    assert files.load_cities(spark, str(tmp_path / "conf.json"), "a").count() == 1
    with pytest.raises(KeyError):
        files.load_cities(spark, str(tmp_path / "conf.json"), "zz")
    files.write_json(df, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2


@pytest.mark.parametrize("how", ["levenshtein", "parity"])
@pytest.mark.parametrize("cutoff", [0.3, 0.6, 0.85, 0.95])
def test_resolve_loses_no_match_at_any_cutoff(spark, how, cutoff):
    rng = random.Random(int(cutoff * 10))
    word = lambda n: "".join(rng.choice("abcdeé 1") for _ in range(n)).strip() or "a"
    known = sorted({word(rng.randrange(1, 14)) for _ in range(40)})
    known = [k for k in known if k == " ".join(k.split())]
    names = [word(rng.randrange(1, 14)) for _ in range(60)] + [k[: len(k) // 2] + "x" + k[len(k) // 2 :] for k in known] + ["abcdxxabcdxx", "zzz"]

    def lev(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            prev, row[0] = row[0], i
            for j, y in enumerate(b, 1):
                prev, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, prev + (x != y))
        return 1 - row[-1] / max(len(a), len(b))

    score = lev if how == "levenshtein" else lambda a, b: difflib.SequenceMatcher(None, b, a).ratio()
    dim = spark.createDataFrame(list(enumerate(known)), "dim_id long, name string")
    got = matching.resolve(spark.createDataFrame(list(enumerate(names)), "id int, name string"), "id", "name", dim, cutoff, how).collect()
    for r in got:
        key = " ".join(r["name"].lower().split())
        best = max((1.0 if k == key else score(key, k), k) for k in known)
        assert (r["dim_id"] is None) == (best[0] < cutoff), (r, best)
        if r["dim_id"] is not None:
            assert math.isclose(r["match_score"], best[0]) and known[r["dim_id"]] == best[1]


def test_numbers_run_through_all_ranges(spark):
    got = ranks.numbered(spark.range(1000).select((F.col("id") * 7919 % 1000).alias("k")).repartition(7), ["k"], "n").collect()
    assert sorted((r["n"], r["k"]) for r in got) == [(k + 1, k) for k in range(1000)]


def test_flags_follow_their_rules_and_not_a_general_call(spark):
    said = {
        "Owner is an NRI": "flag_nri_mention", "POA available": "flag_poa_mention", "seller currently settled overseas": "flag_owner_abroad", "Owner not local": "flag_owner_not_local",
        "visit by prior appointment": "flag_visit_by_appointment_only", "call only after 7 pm": "flag_calling_hours_hint", "vacant for 8 months": "flag_long_vacant_or_tenanted",
        "currently rented at 30000": "flag_investment_property_mention", "Buy or invest in Pune today": None, "": None,
    }
    df = spark.createDataFrame([(t,) for t in said], "t string")
    got = {r["t"]: [c for c in listings.FLAG_RULES if r[c]] for r in listings.text_flags(df, ["t"]).collect()}
    assert got == {t: [f] if f else [] for t, f in said.items()}


def test_city_outputs_come_in_a_given_order(spark):
    df = spark.createDataFrame([("b", 2), ("a", 1), ("b", 1), ("c", 9)], "city string, k int")
    assert [tuple(r) for r in exports.in_city_order(df, "city", ["b", "a", "z"], ["k"]).select("city", "k", "n_city").collect()] == [("b", 1, 2), ("b", 2, 2), ("a", 1, 1)]


def test_fuzzy_ties_go_to_the_largest_name(spark):
    dim = spark.createDataFrame([(1, "abcdefghij"), (2, "abcdefghkj")], "dim_id long, name string")
    for how in ("levenshtein", "parity"):
        got = matching.resolve(spark.createDataFrame([(7, "abcdefghzj")], "id long, name string"), "id", "name", dim, how=how).collect()
        assert [r["dim_id"] for r in got] == [2]
    assert difflib.get_close_matches("abcdefghzj", ["abcdefghij", "abcdefghkj"], 1, 0.85) == ["abcdefghkj"]


@pytest.mark.parametrize("cutoff", [0.6, 0.85, 0.95])
def test_candidate_pairs_miss_no_match_and_are_few(spark, cutoff):
    rng = random.Random(7)
    parts = ["green", "park", "hill", "view", "lake", "royal", "garden", "heights", "city", "palm", "silver", "oak", "river", "sun", "north"]
    name = lambda: " ".join(rng.sample(parts, rng.randrange(1, 4))) + rng.choice(["", " a", " 2", " xi"])
    edit = lambda s: s[: (k := rng.randrange(len(s)))] + rng.choice(["", "z", "qu"]) + s[k + rng.randrange(2) :]
    known = sorted({name() for _ in range(300)})
    names = sorted({edit(rng.choice(known)) for _ in range(200)} | {"a", "zz"})
    df = lambda xs, c: spark.createDataFrame([(x,) for x in xs], f"{c} string")
    pairs = {tuple(r) for r in matching.candidate_pairs(df(names, "key"), df(known, "known"), cutoff).collect()}
    found = {(n, k) for n in names for k in known if n and difflib.SequenceMatcher(None, k, n).ratio() >= cutoff}
    assert found <= pairs
    if cutoff >= 0.85:
        assert len(pairs) < 0.2 * len(names) * len(known)


def plain_median(values):
    values = sorted(values)
    return (values[(len(values) - 1) // 2] + values[len(values) // 2]) / 2


def test_group_medians_by_selection(spark):
    rng = random.Random(3)
    data = [(rng.choice("aab"), rng.choice([None, rng.randrange(9), rng.random()])) for _ in range(4001)] + [("one", 5), ("none", None), (None, 4), ("two", 1), ("two", 4)]
    df = spark.createDataFrame([(k, None if v is None else float(v)) for k, v in data], "k string, v double").repartition(6)
    got = {r["k"]: r["m"] for r in ranks.group_medians(df, ["k"], "v", "m").collect()}
    assert got == {k: plain_median([v for x, v in data if x == k and v is not None]) for k in ("a", "b", "one", "two")}
    beside = ranks.with_group_median(df, ["k"], F.col("v") * 2, "m").select("k", "m").distinct().collect()
    assert {r["k"]: r["m"] for r in beside} == {**{k: 2 * m for k, m in got.items()}, "none": None, None: None}


def test_a_group_of_many_distinct_values(spark):
    df = spark.range(0, 2_000_001, numPartitions=8).select((F.col("id") % 1).alias("k"), (F.col("id") * 7919 % 2_000_001).cast("double").alias("v"))
    assert ranks.group_medians(df, ["k"], "v", "m").collect()[0]["m"] == 1_000_000.0


@pytest.mark.parametrize("seed", range(2))
def test_clusters_of_any_block_size_match_the_plain_loop(spark, monkeypatch, seed):
    """26 tables a seed, as buckets, with blocks and chunks of a few rows; also in two batches."""
    monkeypatch.setattr(duplicates, "_BLOCK", 4)
    monkeypatch.setattr(duplicates, "_CHUNK", 7)
    rng = random.Random(seed)
    how = ["jaccard", "ratio"][seed % 2]
    data = []
    for at, k in enumerate("abcdefghijklmnopqrstuvwxyz"):
        vocabulary = ["w%d" % i for i in range(rng.choice([6, 12, 40]))]
        for i in rng.sample(range(1000), 30):
            data.append((k, 1000 * at + i, " ".join(rng.choices(vocabulary, k=rng.randrange(0, 9))), rng.choice([None, None, None, "p", "q"]), "x"))
    schema = "k string, id long, t string, o string, c string"
    args = (["k"], "id", "t", "o", "c")
    want = sorted(p for k in "abcdefghijklmnopqrstuvwxyz" for p in leaders([(i, t, o) for kk, i, t, o, _ in data if kk == k], how))
    got = duplicates.find_duplicates(spark.createDataFrame(data, schema), *args, similarity=how)
    assert sorted(tuple(r)[:3] for r in got.collect()) == want
    early, late = (spark.createDataFrame([r for r in data if (r[1] % 1000 < 400) == first], schema) for first in (True, False))
    one = duplicates.find_duplicates(early, *args, similarity=how)
    two = duplicates.find_duplicates(late, *args, similarity=how, leaders=duplicates.new_leaders(early, one, *args))
    assert sorted(tuple(r)[:3] for r in one.unionByName(two).collect()) == want


def test_a_large_bucket_is_split(spark):
    """One key: near copies of one text, which fall in the first round, and texts that share no word with any other."""
    n = 20_000
    text = F.when(F.col("id") % 2 == 0, F.concat(F.lit("bright corner flat with lift and parking near the lake "), F.col("id").cast("string"))).otherwise(
        F.concat_ws(" ", *[F.concat(F.lit(p), F.col("id").cast("string")) for p in "abcdefgh"])
    )
    df = spark.range(n).select(F.lit("k").alias("k"), "id", text.alias("t"), F.lit(None).cast("string").alias("o"), F.lit("x").alias("c"))
    got = duplicates.find_duplicates(df, ["k"], "id", "t", "o", "c", similarity="jaccard").groupBy("canonical_id").count().collect()
    assert [tuple(r) for r in got] == [(0, n // 2 - 1)]


def test_names_lose_white_space_of_every_kind(spark):
    df = spark.createDataFrame([("A\u00a0B\u2003 C\x1f", "Owner:\tBob Roy\n", "\tOwner : x"), (None, "Owner:\u00a0", " agent\x1c: y")], "a string, b string, c string")
    from parcelry.functions import columns as C

    got = [tuple(r) for r in df.select(C.name_key(F.col("a")), C.poster_name(F.col("b")), C.role(F.col("c"))).collect()]
    assert got == [("a b c", "Bob Roy", "owner"), (None, None, "agent")]


def test_registrations_in_one_pass(spark):
    rng = random.Random(5)

    def plain(page):
        for m in re.finditer(pages.REGISTRATION, page):
            if "rera" in page[max(m.start() - 60, 0) : m.end() + 10].lower():
                return m.group()
        return None

    ident = lambda: rng.choice(["P", "AB", "XYZ", "WXYZ"]) + "".join(rng.choice("0123456789") for _ in range(rng.randrange(9, 15)))
    texts = ["".join(rng.choice([ident(), "RERA", "rera ", "re", "\n", " " * rng.randrange(1, 30), "no. ", "é😀 "]) + rng.choice(["", " "]) for _ in range(rng.randrange(1, 25))) for _ in range(400)]
    texts += ["P5550000000001" + " " * 6 + "rera", "P5550000000001" + " " * 7 + "rera", "rera" + " " * 56 + "P5550000000001", "rera" + " " * 57 + "P5550000000001", "P5550000000001 " * 50_000 + " " * 40 + "rera"]
    got = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", pages.registration(F.col("t")).alias("r")).collect()
    assert {r["i"]: r["r"] for r in got} == {i: plain(t) for i, t in enumerate(texts)}


def test_owner_groups_grow_with_the_listings(spark):
    n = 100_000
    df = spark.range(n).select("id", F.lit("m").alias("city"), F.when(F.col("id") % 4 == 0, F.lit("ann bee")).otherwise(F.concat(F.lit("bo "), (F.col("id") % 3000).cast("string"))).alias("owner"))
    out = signals.owner_groups(df, "id", "city", "owner")
    assert out.count() == n and out.filter("n = 25000").agg(F.count("*"), F.min("group_id")).collect()[0][:] == (25_000, 0)


def test_owner_counts_are_those_of_the_groups(spark):
    names = ["Ann Bee", " ann  bee", "ANN BEE", "solo", "solo", "MB User", "mb user", None, None, "", "", "Cy Dee", "cy dee", "Ed Fox"]
    data = [(i, c, n) for i, (c, n) in enumerate((c, n) for c in ("m", "n", None) for n in names)] + [(99, "n", "ed fox")]
    df = spark.createDataFrame(data, "id long, city string, poster string")
    name = lambda p: C.name_key(C.stripped(p))
    counts = signals.owner_counts(df, "city", "poster", name)
    groups = signals.owner_groups(df.withColumn("owner", name(F.col("poster"))), "id", "city", "owner")
    assert sorted(rows(counts), key=repr) == sorted([(c, *o) for c in ("m", "n", None) for o in (("ann bee", 3), ("cy dee", 2))] + [("n", "ed fox", 2)], key=repr)
    assert groups.count() == counts.agg(F.sum("n")).first()[0] == 17
    assert signals.owner_counts(df, "city", "poster", name, min_listings=3).count() == 3
    assert signals.owner_groups(df.withColumn("owner", name(F.col("poster"))), "id", "city", "owner", placeholders=()).count() == 23


def test_export_stats_of_counted_candidates(spark):
    none = spark.createDataFrame([], "city_id string, has_price_band boolean, detail_available boolean, contact_available boolean")
    three = spark.createDataFrame([(2,), (1,)], "n long")
    for candidates, n, want in ((three, "n", 3), (three, None, 2), (three.filter("n > 5"), "n", 0)):
        assert exports.export_stats(none, none, none, none, candidates, none, n).first()["total_absentee_candidates"] == want


@pytest.mark.parametrize("how", ["ratio", "parity"])
def test_rows_without_text_meet_by_their_owners_only(spark, monkeypatch, how):
    """One bucket: rows without text, most of them of owners of their own, take no round of blocks; those that share an owner with a text or one another are found."""
    monkeypatch.setattr(duplicates, "_BLOCK", 4)
    rounds, sized = [], duplicates._sized
    monkeypatch.setattr(duplicates, "_sized", lambda *tables: rounds.append(1) or sized(*tables))
    data = [("k", i, "", f"o{i % 30}", "x") for i in range(40)] + [("k", 40, "some words", "o3", "x"), ("k", 41, "some word", "", "x"), ("k", 42, None, "", "x")]
    pairs = duplicates.find_duplicates(spark.createDataFrame(data, "k string, id long, t string, o string, c string"), ["k"], "id", "t", "o", "c", similarity=how)
    assert sorted(tuple(r)[:3] for r in pairs.collect()) == sorted(leaders([(i, t or "", o) for _, i, t, o, _ in data], how))
    assert not rounds


def counted(spark, df):
    """The table, and how many of its rows were computed."""
    seen = spark.sparkContext.accumulator(0)

    def passed(batches):
        for batch in batches:
            seen.add(batch.num_rows)
            yield batch

    return df.mapInArrow(passed, df.schema), seen


def test_society_fit_computes_listings_once(spark):
    df = spark.createDataFrame([("m", "x", "a", "A", i, 10 + i, i % 3) for i in range(20)], "city string, corridor string, society string, shown string, i int, price long, age long")
    df, seen = counted(spark, df)
    ratings = spark.createDataFrame([], "city string, society string, rating double, reviews long")
    assert [r["supply"] for r in scores.society_fit(df, ratings, "city", "corridor", "society", "shown", ["i"]).collect()] == [20]
    assert seen.value == 20


@pytest.mark.parametrize("batch", [False, True])
def test_find_duplicates_computes_rows_once(spark, batch):
    data = [("k%d" % (i % 7), i, "bright flat number %d" % (i % 3), None, "x") for i in range(40)]
    args = (["k"], "id", "t", "o", "c")
    df, seen = counted(spark, spark.createDataFrame(data, "k string, id long, t string, o string, c string"))
    before = spark.createDataFrame([('{"k":"k0"}', -1, "x", "bright flat number 0", None, True)], "key string, id long, corridor string, text string, owner string, has_text boolean") if batch else None
    pairs = duplicates.find_duplicates(df, *args, similarity="jaccard", leaders=before)
    got = {r[0] for r in pairs.collect()}
    assert got == ({-1} if batch else {0}) | set(range(1, 7))
    assert seen.value == 40


_LISTING = "id string, city string, corridor string, society_name_raw string, price_inr long, description_raw string, poster string, duplicate_of_id string"


@pytest.mark.parametrize("how, block", [("jaccard", 512), ("ratio", 512), ("parity", 512), ("jaccard", 4), ("ratio", 4)])
def test_three_batches_match_the_plain_loop(spark, monkeypatch, tmp_path, how, block):
    """Copies of texts and owners within and across batches, also of a text that difflib's junk rule finds unlike itself; buckets go on over several record batches of a task."""
    monkeypatch.setattr(duplicates, "_BLOCK", block)
    monkeypatch.setattr(duplicates, "_CHUNK", 7)
    rng, texts = random.Random(9), ["a a bb", "ab ba", "  ", "", "a bb c", "d e f g", "d e f h", "x" * 250]
    data = [("m", k, "%03d" % i, rng.choice(texts), rng.choice([None, None, "p", "q", f"o{i}"])) for i, k in enumerate("uvwxyz" * 20 + "one")]
    want = sorted((*p, k) for k in set("uvwxyzone") for p in leaders([(i, t, o) for _, kk, i, t, o in data if kk == k], how))
    df = spark.createDataFrame([(i, c, k, k, 5, t, o, None) for c, k, i, t, o in data], _LISTING)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        rows = jobs.comparable(df)
        found = [jobs.dedup_compared(rows.filter(f"id >= '{low}' AND id < '{high}'"), str(tmp_path / "leaders"), how) for low, high in (("000", "030"), ("030", "060"))]
        found.append(jobs.dedup_batch(df.filter("id >= '060'"), str(tmp_path / "leaders"), similarity=how))
        got = [tuple(r) for f in found for r in f.select("canonical_id", "duplicate_id", "similarity", "corridor").collect()]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert sorted(got) == want
    marked = {r[1] for r in want}
    assert sorted(r["id"] for r in tables.read_current(spark, str(tmp_path / "leaders")).collect()) == sorted(i for _, _, i, _, _ in data if i not in marked)


def test_a_batch_is_written_once(spark, monkeypatch, tmp_path):
    """Rows alone in their bucket are written by what they are compared by, and as leaders; no other table holds them."""
    written, keep = [], duplicates.keep

    def counted_keep(df, name):
        out = keep(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(duplicates, "keep", counted_keep)
    monkeypatch.setattr(jobs, "keep", counted_keep)
    df = spark.createDataFrame([("%03d" % i, "m", "x", f"n{min(i, 60)}", 5, "bright flat", None, None) for i in range(63)], _LISTING)
    pairs = jobs.dedup_batch(df, str(tmp_path / "leaders"), similarity="jaccard")
    assert sorted(r["duplicate_id"] for r in pairs.collect()) == ["061", "062"]
    assert sum(written) == 63 + 1 + 3  # rows, the shared bucket's count, and its pairs and leader
