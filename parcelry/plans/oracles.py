"""DuckDB SQL for the registered queries, over the same tables."""

_LI = """
WITH places AS (
  SELECT n_nationkey, n_name AS corridor, r_name AS city FROM nation JOIN region ON n_regionkey = r_regionkey
), li AS (
  SELECT l_orderkey || '-' || l_linenumber || '-' || l_partkey || '-' || l_suppkey AS listing_id, l_orderkey, l_linenumber, l_partkey, l_suppkey, city, corridor,
         p_name || CASE p_size % 3 WHEN 0 THEN ' Phase 2' WHEN 1 THEN ' CHS' ELSE '' END AS society_raw, lower(p_name) AS society,
         floor(l_extendedprice + 0.5)::BIGINT AS price, floor(l_quantity)::BIGINT AS area, date_diff('day', l_shipdate::DATE, DATE '2002-01-01') AS age,
         CASE WHEN l_suppkey % 2 = 0 THEN 'Agent: ' || s_name ELSE 'Owner: ' || c_mktsegment || ' ' || c_custkey END AS posted_by,
         CASE WHEN l_suppkey % 2 = 0 THEN lower(s_name) END AS agent,
         CASE l_linestatus WHEN 'O' THEN 'Ready to Move' ELSE 'Under Construction' END AS status,
         CASE WHEN l_orderkey % 10 = 0 THEN '' ELSE 'http://x/' || l_orderkey END AS url,
         l_returnflag = 'R' AS registered, l_discount >= 0.08 AS vacant
  FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN places ON s_nationkey = n_nationkey
), lo AS (
  SELECT o_orderkey AS listing_id, city, corridor, c_custkey,
         'Owner: ' || CASE WHEN c_custkey % 3 = 0 THEN c_name ELSE c_mktsegment || ' ' || c_name END AS posted_by,
         floor(o_totalprice + 0.5)::BIGINT AS price, date_diff('day', o_orderdate::DATE, DATE '2002-01-01') AS age, o_orderstatus AS status,
         lower(o_orderpriority) AS society, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey - 7 END AS duplicate_of_id
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN places ON c_nationkey = n_nationkey
), cities AS (
  SELECT r_name AS city, CASE WHEN r_regionkey < 4 THEN 20000 END AS price_min, CASE WHEN r_regionkey < 4 THEN 60000 END AS price_max FROM region
), band AS (
  SELECT li.* FROM li JOIN cities USING (city) WHERE price BETWEEN price_min AND price_max
)"""


def _half_up(x: str, digits: int) -> str:
    return f"floor(({x}) * {float(10**digits)} + 0.5) / {float(10**digits)}"


def _rank(partition: str, value: str) -> str:
    n = f"count({value}) OVER (PARTITION BY {partition})"
    below = f"(rank() OVER (PARTITION BY {partition} ORDER BY {value} NULLS LAST) - 1)"
    ties = f"(count({value}) OVER (PARTITION BY {partition}, {value}) - 1) / 2.0"
    return f"CASE WHEN {value} IS NOT NULL THEN coalesce(({below} + {ties}) / nullif({n} - 1, 0), 1.0) END"


_KEY = "trim(regexp_replace(lower({0}), '\\s+', ' ', 'g'))"

_AGENTS = f"""{_LI}, linked AS (
  SELECT city, corridor, agent, nullif(url, '') AS url, substr(posted_by, 8) AS shown, l_orderkey, l_linenumber, l_partkey, l_suppkey FROM li WHERE agent IS NOT NULL
), n AS (
  SELECT city, corridor, agent, (count(DISTINCT url) + count(*) FILTER (url IS NULL))::BIGINT AS n_listings, min(shown) AS display FROM linked GROUP BY ALL
), activity AS (
  SELECT city, corridor, agent, n_listings, display, {_half_up("10 * (" + _rank("city", "n_listings") + ")", 1)} AS activity_score FROM n
)"""

_METRICS = f"""{_LI}, metrics AS (
  SELECT city, corridor, avg(CASE WHEN price BETWEEN 20000 AND 60000 THEN 1.0 ELSE 0.0 END) AS share_in_band, (min(l_suppkey) % 10 + count(*) % 3)::DOUBLE AS anchor_km,
         avg(CASE WHEN registered THEN 0.5 ELSE 1.0 END) AS clean_share, (count(*) % 90)::DOUBLE AS comps, (sum(age) % 75)::DOUBLE AS days_on_market,
         (count(*) FILTER (vacant) % 60)::DOUBLE AS resales
  FROM li GROUP BY ALL
), gated AS (
  SELECT m.*, n_nationkey AS ordinal, list_filter([CASE WHEN share_in_band < 0.3 THEN 'product_in_band' END, CASE WHEN anchor_km > 8 THEN 'demand_adjacent' END, CASE WHEN clean_share < 0.75 THEN 'clean_title' END,
         CASE WHEN comps < 10 THEN 'comp_density' END, CASE WHEN days_on_market > 70 OR resales < 5 THEN 'resale_velocity' END], lambda x: x IS NOT NULL) AS failed_gates,
         {_half_up("share_in_band", 4)} AS price_score, {_half_up("greatest(0.0, 1 - anchor_km / 8)", 4)} AS anchor_score, {_half_up("clean_share", 4)} AS clean_score,
         {_half_up("least(comps / 60, 1.0)", 4)} AS comp_score, {_half_up("(greatest(0.0, 1 - days_on_market / 60) + least(resales / 50, 1.0)) / 2", 4)} AS velocity_score
  FROM metrics m JOIN nation ON n_name = corridor
), ranked AS (
  SELECT city, corridor, ordinal, failed_gates, len(failed_gates) = 0 AS eligible, price_score, anchor_score, clean_score, comp_score, velocity_score,
         CASE WHEN len(failed_gates) = 0 THEN {_half_up("(price_score + anchor_score + clean_score + comp_score + velocity_score) / 5", 4)} END AS composite
  FROM gated
)"""

_OWNERS = f"""{_LI}, named AS (
  SELECT listing_id, city, {_KEY.format("substr(posted_by, 8)")} AS owner FROM lo WHERE duplicate_of_id IS NULL
), grouped AS (
  SELECT city, list(listing_id ORDER BY listing_id) AS ids FROM named WHERE contains(owner, ' ') GROUP BY city, owner HAVING count(*) >= 2
), owners AS (
  SELECT id AS listing_id, city, 'multi_property_owner' AS signal, len(ids)::VARCHAR AS score,
         'siblings: ' || array_to_string(list_filter(ids, lambda x: x <> id), ', ') AS evidence
  FROM (SELECT city, ids, unnest(ids) AS id FROM grouped)
)"""

_LEADS = f"""{_LI}, medians AS (
  SELECT city, corridor, median(price / nullif(area, 0)) AS m FROM li GROUP BY ALL
), listed AS (
  SELECT DISTINCT lower(p_name) AS society FROM part WHERE p_size > 40
), hits AS (
  SELECT li.*, age > 2000 AS old, price / nullif(area, 0) < 0.7 * m AS below, l.society IS NOT NULL AS listed
  FROM li JOIN medians USING (city, corridor) LEFT JOIN listed l USING (society)
), leads AS (
  SELECT *, 40 * registered::INT + 20 * vacant::INT + 20 * old::INT + 10 * below::INT + 10 * listed::INT AS lead_score,
         concat_ws(';', CASE WHEN registered THEN 'flag_registered' END, CASE WHEN vacant THEN 'flag_vacant' END, CASE WHEN old THEN 'flag_old' END,
           CASE WHEN below THEN 'below_market' END, CASE WHEN listed THEN 'listed_entity' END) AS signals
  FROM hits
), tiered AS (
  SELECT *, CASE WHEN lead_score >= 60 THEN 'hot' WHEN lead_score >= 30 THEN 'warm' ELSE 'cold' END AS tier FROM leads
), density AS (
  SELECT city, society, {_half_up("avg(lead_score)", 2)} AS mean_score, count(*) FILTER (tier = 'hot') AS n_hot, count(*) FILTER (tier = 'warm') AS n_warm, count(*) FILTER (tier = 'cold') AS n_cold
  FROM tiered GROUP BY ALL
), dense AS (
  SELECT *, {_half_up("mean_score / 280", 4)} AS density FROM density
), fit_parts AS (
  SELECT city, society, count(*) AS n_listings, {_half_up("avg(CASE WHEN price BETWEEN 20000 AND 60000 THEN 1.0 ELSE 0.0 END)", 4)} AS band_share,
         {_half_up("avg(CASE WHEN status = 'Ready to Move' THEN 1.0 ELSE 0.0 END)", 4)} AS ready_share, {_half_up("avg(CASE WHEN registered THEN 1.0 ELSE 0.0 END)", 4)} AS registered_share,
         {_half_up("least(count(*) / 10, 1.0)", 4)} AS density, {_half_up("coalesce(avg(greatest(0.0, 1 - age / 3000)), 0.5)", 4)} AS freshness
  FROM li GROUP BY ALL
), fits AS (
  SELECT *, {_half_up("(band_share + ready_share + registered_share + density + freshness) / 5", 4)} AS fit FROM fit_parts
)"""

_SAMPLES = """, exclusive AS (
  SELECT city, url FROM li WHERE url <> '' GROUP BY ALL HAVING min({0}) = max({0})
)"""

_ROLLUP = f"""{_LI}, counted AS (
  SELECT p.city, p.corridor, count(li.city) AS n_listings, count(DISTINCT agent) AS n_agents, count(*) FILTER (vacant AND price > 90000) AS n_vacant, min(age) AS freshest
  FROM places p LEFT JOIN li USING (city, corridor) GROUP BY ALL
)"""

_WRITTEN = """
WITH dim AS (
  SELECT p_name AS name, min(p_partkey) AS dim_id FROM part GROUP BY ALL
), written AS (
  SELECT p_partkey, CASE WHEN p_partkey % 4 = 0 THEN p_name || 'x' WHEN p_partkey % 4 = 1 THEN upper(p_name) WHEN p_partkey % 11 = 0 THEN 'zzzz qqqq' WHEN p_partkey % 13 <> 0 THEN p_name END AS written FROM part
), known AS (
  SELECT lower(name) AS known, min(dim_id) AS dim_id FROM dim GROUP BY ALL
), scored AS (
  SELECT w.*, k.dim_id, known, known = lower(written) AS exact, 1 - levenshtein(lower(written), known) / greatest(length(written), length(known)) AS s FROM written w JOIN known k ON true
), best AS (
  SELECT * FROM scored WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY exact DESC, s DESC, known DESC) = 1
), resolved AS (
  SELECT w.p_partkey, w.written, b.dim_id, floor(s * 10000.0 + 0.5) / 10000.0 AS score FROM written w LEFT JOIN best b USING (p_partkey)
)"""

_SNAPSHOT = """
WITH subjects AS (
  SELECT s_suppkey, s_name, n_name AS city_name, s_acctbal, s_name || ' ' || n_name AS query FROM supplier JOIN nation ON s_nationkey = n_nationkey
), snapshot AS (
  SELECT query, CASE WHEN s_suppkey % 5 = 0 THEN 'Real Estate Group' ELSE s_name || ' Realty' END AS name,
         CASE WHEN s_suppkey % 3 = 0 THEN 'Elsewhere 1' ELSE '1 Road, ' || city_name END AS address, 'p' || s_suppkey AS place_id, (s_suppkey % 5)::DOUBLE AS rating, s_suppkey % 100 AS reviews
  FROM subjects WHERE s_acctbal > 0
), judged AS (
  SELECT s.*, p.query IS NOT NULL AS found, s_suppkey % 5 <> 0 AS right_name, contains(lower(coalesce(address, '')), lower(city_name)) AS right_city, place_id, rating, reviews
  FROM subjects s LEFT JOIN snapshot p USING (query)
), matched AS (
  SELECT s_suppkey, s_name, city_name, found AND right_name AND right_city AS matched,
         CASE WHEN NOT found THEN 'no result' WHEN NOT right_name AND NOT right_city THEN 'name and city differ' WHEN NOT right_name THEN 'name differs' WHEN NOT right_city THEN 'city differs' ELSE 'accepted' END AS note,
         CASE WHEN found AND right_name AND right_city THEN place_id END AS place_id, CASE WHEN found AND right_name AND right_city THEN rating END AS rating,
         CASE WHEN found AND right_name AND right_city THEN reviews END AS reviews
  FROM judged
)"""

_RAW = f"""{_LI}, raw AS (
  SELECT li.*, CASE WHEN age % 5 = 0 THEN strftime(DATE '2002-01-01' - age::INT, '%b %d, ''%y') END AS posted FROM li
)"""

_CSV = f"""{_LI}, rows AS (
  SELECT city, corridor, count(*) FILTER (duplicate_of_id IS NULL) AS n, string_agg(DISTINCT status, ';' ORDER BY status) AS statuses, max(price) AS top_price FROM lo GROUP BY ALL
)"""

# Leader clustering: a bucket's rows in the order of their ids, each against the leaders so far.
_CLUSTERS = _LI.replace("WITH ", "WITH RECURSIVE ", 1) + """, b AS (
  SELECT listing_id AS id, city, corridor, lower(society_raw) AS project, price, lower(trim(substr(posted_by, 8))) AS owner,
         list_distinct(string_split(lower(CASE WHEN registered THEN 'RERA approved, call +44 ' || area ELSE 'call +91 98' END), ' ')) AS words,
         row_number() OVER (PARTITION BY city, lower(society_raw), price ORDER BY listing_id) AS rn
  FROM li WHERE area % 11 > 0
), walk AS (
  SELECT city, project, price, 1::BIGINT AS n, id, corridor, NULL::VARCHAR AS leader, NULL::VARCHAR AS leader_corridor, [{'id': id, 'words': words, 'owner': owner, 'corridor': corridor}] AS leaders FROM b WHERE rn = 1
  UNION ALL
  SELECT city, project, price, n, id, corridor, f[1].id, f[1].corridor, CASE WHEN len(f) = 0 THEN list_append(leaders, me) ELSE leaders END
  FROM (
    SELECT w.city, w.project, w.price, b.rn AS n, b.id, b.corridor, leaders, {'id': b.id, 'words': b.words, 'owner': b.owner, 'corridor': b.corridor} AS me,
           list_filter(leaders, lambda l: l.owner = b.owner OR len(list_intersect(l.words, b.words)) / len(list_distinct(list_concat(l.words, b.words))) >= 0.6) AS f
    FROM walk w JOIN b ON b.city = w.city AND b.project = w.project AND b.price = w.price AND b.rn = w.n + 1
  )
)"""

# What segment and priority stand for in the descriptions of orders.
_DESCRIBED = """WITH f AS (
  SELECT o_orderkey AS listing_id, o_orderpriority, floor(o_totalprice)::BIGINT AS price_inr, floor(o_totalprice)::BIGINT % 900 + 100 AS area_sqft, lower(c_mktsegment) AS society_key,
         c_mktsegment = 'AUTOMOBILE' AS flag_nri_mention, c_mktsegment = 'BUILDING' AS flag_poa_mention, o_orderpriority = '4-NOT SPECIFIED' AS flag_owner_abroad,
         o_orderpriority = '5-LOW' AS intl_contact_hint, o_orderpriority = '3-MEDIUM' AS flag_owner_not_local, c_mktsegment = 'HOUSEHOLD' AS flag_visit_by_appointment_only,
         o_orderpriority = '1-URGENT' AS flag_calling_hours_hint, o_orderpriority = '2-HIGH' AS flag_long_vacant_or_tenanted, c_mktsegment = 'MACHINERY' AS flag_investment_property_mention
  FROM orders JOIN customer ON o_custkey = c_custkey WHERE o_orderstatus <> 'F'
)"""
_FLAGS = "flag_nri_mention flag_poa_mention flag_owner_abroad intl_contact_hint flag_owner_not_local flag_visit_by_appointment_only flag_calling_hours_hint flag_long_vacant_or_tenanted flag_investment_property_mention".split()

_BROKERS = f"""{_AGENTS}, exported AS (
  SELECT agent, n_listings, s_acctbal > 5000 AS contact_available FROM activity JOIN supplier ON lower(s_name) = agent
), projects AS (
  SELECT city, society, society IN (SELECT lower(p_name) FROM part WHERE p_size > 25) AS detail_available FROM li GROUP BY ALL
), found AS (
  SELECT listing_id FROM (SELECT listing_id, city, {_KEY.format("substr(posted_by, 8)")} AS owner FROM lo WHERE duplicate_of_id IS NULL)
  WHERE contains(owner, ' ') QUALIFY count(*) OVER (PARTITION BY city, owner) >= 2
  UNION ALL SELECT doc_id FROM documents WHERE contains(lower(text), 'worthless') OR contains(lower(text), 'license') OR contains(lower(text), 'trash')
)"""

ORACLES = {
    "duplicate_clusters": f"""{_CLUSTERS}
SELECT leader AS canonical_id, count(*)::INT AS n, string_agg(id, ';' ORDER BY id) AS duplicates, array_to_string(list_sort(list_distinct(list_append(list(corridor), any_value(leader_corridor)))), ';') AS seen
FROM walk WHERE leader IS NOT NULL GROUP BY leader""",
    "dedup_listings": f"""{_CLUSTERS}, marks AS (SELECT id FROM walk WHERE leader IS NOT NULL)
SELECT city, count(*) AS total, count(*) - count(marks.id) AS canonical, count(marks.id) AS marked FROM li LEFT JOIN marks ON marks.id = listing_id GROUP BY city""",
    "classify_listings": f"{_DESCRIBED} SELECT listing_id, price_inr, area_sqft, 'owner' AS role, 3::INT AS days_since_posted, society_key, {', '.join(_FLAGS)} FROM f",
    "classified_leads": f"""{_DESCRIBED}, m AS (
  SELECT o_orderpriority, median(price_inr / area_sqft) AS m FROM f GROUP BY ALL
), s AS (
  SELECT listing_id, {' + '.join(f"{40 if i < 4 else 20} * {c}::INT" for i, c in enumerate(_FLAGS))} + 10 * (price_inr / area_sqft < 0.7 * m)::INT + 10 * (society_key = 'building')::INT AS lead_score,
         concat_ws(';', {', '.join(f"CASE WHEN {c} THEN '{c}' END" for c in _FLAGS)}, CASE WHEN price_inr / area_sqft < 0.7 * m THEN 'below_market' END, CASE WHEN society_key = 'building' THEN 'listed_entity' END) AS signals
  FROM f JOIN m USING (o_orderpriority)
)
SELECT listing_id, lead_score, CASE WHEN lead_score >= 60 THEN 'hot' WHEN lead_score >= 30 THEN 'warm' ELSE 'cold' END AS tier, signals FROM s""",
    "resolve_entities": f"""{_WRITTEN}, old AS (
  SELECT p_name AS name, min(p_partkey) AS dim_id FROM part WHERE p_size <= 10 GROUP BY ALL
), seeded AS (
  SELECT * FROM old UNION ALL
  SELECT name, (SELECT max(dim_id) FROM old) + row_number() OVER (ORDER BY lower(name)) FROM dim WHERE name NOT IN (SELECT name FROM old)
), pairs AS (
  SELECT p_partkey, s.name, s.dim_id, lower(s.name) = lower(written) AS exact, 1 - levenshtein(lower(written), lower(s.name)) / greatest(length(written), length(s.name)) AS s FROM written JOIN seeded s ON true
), matched AS (
  SELECT * FROM pairs WHERE s >= 0.85 QUALIFY row_number() OVER (PARTITION BY p_partkey ORDER BY exact DESC, s DESC, lower(name) DESC) = 1
)
SELECT w.p_partkey, w.written, m.dim_id, m.name FROM written w LEFT JOIN matched m USING (p_partkey)""",
    "resolved_vacancy": f"""{_LI}, dim AS (
  SELECT p_name AS name, min(p_partkey) AS dim_id FROM part GROUP BY ALL
), names AS (
  SELECT DISTINCT society_raw FROM li
), pairs AS (
  SELECT society_raw, name, dim_id, 1 - levenshtein(lower(society_raw), lower(name)) / greatest(length(society_raw), length(name)) AS s FROM names JOIN dim ON true
), matched AS (
  SELECT * FROM pairs WHERE s >= 0.7 QUALIFY row_number() OVER (PARTITION BY society_raw ORDER BY s DESC, lower(name) DESC) = 1
), s AS (
  SELECT city, name AS society_name, count(*) AS n_known, count(*) FILTER (age >= 600) AS n_first, count(*) FILTER (age >= 1000) AS n_second, avg(age) AS a, count(*) FILTER (age >= 1000) / count(*) AS r
  FROM li JOIN matched USING (society_raw) GROUP BY ALL
)
SELECT city, society_name, n_known, n_first, n_second, {_half_up("a", 1)} AS avg_age, {_half_up("r", 4)} AS stale_rate, {_half_up("(r + least(a / 3000, 1.0)) / 2", 4)} AS vacancy_probability,
       CASE WHEN n_known < 3 THEN 'low' WHEN n_known < 10 THEN 'medium' ELSE 'high' END AS confidence
FROM s""",
    "coverage_plan": f"""{_METRICS}
SELECT city AS city_id, corridor AS name, CASE WHEN corridor IN (SELECT corridor FROM metrics WHERE comps >= 10) THEN 'scoreable_now' ELSE 'not_yet_scoreable' END AS coverage,
       'http://s/' || replace(lower(trim(corridor)), ' ', '-') || '-' || replace(lower(trim(city)), ' ', '-') AS sample_url
FROM places""",
    "export_stats": f"""{_BROKERS}
SELECT (SELECT count(*) FROM exported) AS total_brokers_indexed, (SELECT count(*) FILTER (contact_available) FROM exported) AS total_brokers_contact_resolved, (SELECT count(*) FROM found) AS total_absentee_candidates,
       (SELECT count(DISTINCT city) FROM cities) AS total_cities_live, (SELECT count(price_min) FROM cities) AS total_cities_fully_scored, (SELECT count(*) FROM pages) AS total_directory_links,
       (SELECT count(DISTINCT corridor) FROM li) AS total_corridors_ranked, (SELECT count(*) FROM projects) AS total_societies_scored, (SELECT count(*) FILTER (detail_available) FROM projects) AS total_societies_detail_resolved""",
    "exports_written": f"""{_BROKERS}
SELECT 'cities' AS dataset, count(*) AS n FROM cities UNION ALL SELECT 'corridors', count(DISTINCT corridor) FROM li UNION ALL SELECT 'societies', count(*) FROM projects UNION ALL SELECT 'brokers', count(*) FROM exported
UNION ALL SELECT 'absentee_candidates', count(*) FROM found UNION ALL SELECT 'nri_directory', count(*) FROM pages UNION ALL SELECT 'stats', 1""",
    "broker_slices": f"{_AGENTS} SELECT city, count(*) AS n, sum(n_listings)::BIGINT AS n_listings FROM activity WHERE city IN ('ASIA', 'EUROPE') GROUP BY city",
    "enriched_lookups": """SELECT s_name || ' ' || n_name AS query, s_acctbal >= 1000 AS matched, CASE WHEN s_acctbal > 5000 THEN 'cached' WHEN s_acctbal >= 1000 THEN 'accepted' ELSE 'no result' END AS note,
       CASE WHEN s_acctbal >= 1000 THEN 'p' || s_suppkey END AS place_id, CASE WHEN s_acctbal >= 1000 THEN s_suppkey END AS reviews
FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal >= 0""",
    "config_rows": f"""{_LI}
SELECT city AS city_id, row_number() OVER (PARTITION BY city ORDER BY corridor) - 1 AS ordinal, corridor AS name, lower(city) AS state, price_min, price_max FROM places JOIN cities USING (city)""",
    "csv_round_trip": r"""SELECT page_id, replace(regexp_extract(url, '//([^/]*)', 1), '.', ';') AS host, (page_id % 2 = 0)::INT::VARCHAR AS even,
       sha256(CASE WHEN page_id % 5 > 0 THEN regexp_replace(coalesce(html, ''), '\r\n?', chr(10), 'g') ELSE '' END) AS html_sha256 FROM pages""",
    "shown_names": f"""{_LI}
SELECT listing_id, coalesce(CASE WHEN l_partkey % 3 = 0 THEN society END, CASE WHEN l_orderkey % 2 = 0 THEN nullif(url, '') END, agent) AS shown FROM li""",
    "stored_lookups": f"""{_SNAPSHOT}
SELECT query, place_id, CASE WHEN rating < 3 THEN 'fresh' ELSE 'cached' END AS origin, CASE WHEN rating >= 2 THEN 'cached' END AS origin_before, 2 AS version FROM snapshot""",
    "stored_marks": f"""{_LI}, open_rows AS (
  SELECT listing_id, min(listing_id) OVER (PARTITION BY city, c_custkey, floor(price / 20000)) AS f FROM lo WHERE duplicate_of_id IS NULL
)
SELECT listing_id, city, coalesce(duplicate_of_id, CASE WHEN f < listing_id THEN f END) AS duplicate_of_id FROM lo LEFT JOIN open_rows USING (listing_id)""",
    "stored_dimension": f"""{_WRITTEN}, fresh AS (
  SELECT lower(trim(s_name)) AS key, min(s_name) AS name FROM supplier GROUP BY ALL
)
SELECT dim_id, name FROM dim UNION ALL SELECT (SELECT max(dim_id) FROM dim) + row_number() OVER (ORDER BY key), name FROM fresh WHERE key NOT IN (SELECT known FROM known)""",
    "raw_store": f"{_LI} SELECT listing_id, city, corridor, price, status FROM lo WHERE city = 'ASIA' AND duplicate_of_id IS NULL",
    "banded_raw": f"{_LI} SELECT city, corridor, count(*) AS n, sum(price)::BIGINT AS total_price FROM lo JOIN cities USING (city) WHERE price_min IS NOT NULL GROUP BY ALL",
    "replaced_slices": f"{_AGENTS} SELECT city, corridor, agent, n_listings, activity_score FROM activity WHERE city NOT IN ('ASIA', 'EUROPE') OR (city = 'ASIA' AND activity_score >= 5)",
    "incremental_duplicates": f"{_CLUSTERS} SELECT leader AS canonical_id, id AS duplicate_id, corridor FROM walk WHERE leader IS NOT NULL",
    "society_fit_run": f"""{_LI}, canon AS (
  SELECT li.*, lower(regexp_replace(society_raw, ' (Phase 2|CHS)$', '')) AS key, lower(substr(posted_by, 8)) AS owner FROM li WHERE l_linenumber <> 7
), groups AS (
  SELECT city, corridor, key, count(*) AS supply, {_half_up("avg(age)", 1)} AS velocity_days, coalesce({_half_up("stddev_samp(price) / avg(price)", 4)}, 0.0) AS price_cov
  FROM canon JOIN cities USING (city) WHERE price BETWEEN price_min AND price_max GROUP BY ALL HAVING count(*) >= 3
), ranks AS (
  SELECT *, {_rank("city", "supply")} AS r1, {_rank("city", "velocity_days")} AS r2, {_rank("city", "price_cov")} AS r3 FROM groups
), found AS (
  SELECT listing_id, city, corridor, key FROM canon WHERE agent IS NULL AND contains(owner, ' ') QUALIFY count(*) OVER (PARTITION BY city, owner) >= 2
  UNION SELECT listing_id, city, corridor, key FROM canon WHERE vacant
), linked AS (
  SELECT city, corridor, key, list(listing_id ORDER BY listing_id) AS ids FROM found GROUP BY ALL
)
SELECT c.city, CASE WHEN price_min IS NULL THEN 'skipped_no_price_band' ELSE 'ok' END AS status, corridor, key AS society, supply,
       {_half_up("10 * ((0.3 * r1 + 0.3 * coalesce(1 - r2, 0.5) + 0.2 * (1 - r3)) / (0.3 + 0.3 + 0.2))", 1)} AS fit_score,
       CASE WHEN key IS NOT NULL THEN coalesce(array_to_string(ids, ';'), '') END AS candidates, CASE WHEN key IS NOT NULL THEN coalesce(len(ids), 0) END AS n_candidates
FROM cities c LEFT JOIN (SELECT * FROM ranks LEFT JOIN linked USING (city, corridor, key)) r ON r.city = c.city""",
    "owner_groups": f"""{_LI}, named AS (
  SELECT listing_id, city, {_KEY.format("substr(posted_by, 8)")} AS owner FROM lo WHERE duplicate_of_id IS NULL
)
SELECT listing_id, city, min(listing_id) OVER g AS group_id, count(*) OVER g AS n FROM named WHERE contains(owner, ' ') WINDOW g AS (PARTITION BY city, owner) QUALIFY n >= 2""",
    "group_medians": f"""{_LI}
SELECT 'price' AS kind, city || '/' || corridor AS of, median(price)::DOUBLE AS median FROM li GROUP BY city, corridor
UNION ALL SELECT 'age', l_linenumber::VARCHAR, median(age)::DOUBLE FROM li GROUP BY l_linenumber UNION ALL SELECT 'all', '', median(price)::DOUBLE FROM li""",
    "agents_by_area": f"{_AGENTS} SELECT city, corridor, agent, n_listings FROM activity",
    "cities_in_order": f"{_LI} SELECT listing_id, city, count(*) OVER (PARTITION BY city) AS n_city FROM lo WHERE city IN ('EUROPE', 'ASIA', 'AMERICA')",
    "broker_activity": f"{_AGENTS} SELECT * FROM activity",
    "society_fit": f"""{_LI}, keyed AS (
  SELECT *, lower(regexp_replace(society_raw, ' (Phase 2|CHS)$', '')) AS key FROM band
), rated AS (
  SELECT lower(p_name) AS society, min(p_size % 5 + 1)::DOUBLE AS rating, max(p_size * 10)::BIGINT AS reviews FROM part WHERE p_size > 12 GROUP BY ALL
), shown AS (
  SELECT city, corridor, key, society_raw AS display FROM (SELECT city, corridor, key, society_raw, count(*) AS n, min(ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS f FROM keyed GROUP BY ALL)
  QUALIFY row_number() OVER (PARTITION BY city, corridor, key ORDER BY n DESC, f) = 1
), groups AS (
  SELECT city, corridor, key AS society, count(*) AS supply, {_half_up("avg(age)", 1)} AS velocity_days, coalesce({_half_up("stddev_samp(price) / avg(price)", 4)}, 0.0) AS price_cov
  FROM keyed GROUP BY ALL HAVING count(*) >= 3
), joined AS (
  SELECT g.*, display, rating, reviews, rating / 5 * ln(1 + reviews) AS value, list(g.corridor) OVER (PARTITION BY g.city, g.society) AS areas
  FROM groups g JOIN shown s ON s.city = g.city AND s.corridor = g.corridor AND s.key = g.society LEFT JOIN rated r ON r.society = g.society
), ranks AS (
  SELECT *, {_rank("city", "supply")} AS r1, {_rank("city", "velocity_days")} AS r2, {_rank("city", "price_cov")} AS r3, {_rank("city", "value")} AS r4 FROM joined
), base AS (
  SELECT *, 0.3 * r1 + 0.3 * coalesce(1 - r2, 0.5) + 0.2 * (1 - r3) AS b FROM ranks
)
SELECT city, corridor, society, supply, velocity_days, price_cov, display, rating, reviews, list_sort(areas) AS appears_in,
       {_half_up("10 * CASE WHEN r4 IS NULL THEN b / (0.3 + 0.3 + 0.2) ELSE b + 0.2 * r4 END", 1)} AS fit_score
FROM base""",
    "rank_corridors": f"{_METRICS} SELECT * EXCLUDE (ordinal) FROM ranked",
    "corridor_drill_down": f"""{_METRICS}, best AS (
  SELECT corridor, row_number() OVER (ORDER BY composite DESC, ordinal)::INT AS area_rank FROM ranked WHERE eligible
)
SELECT corridor, count(*) AS n, area_rank FROM li JOIN best USING (corridor) GROUP BY ALL""",
    "normalise_listings": f"""{_RAW}
SELECT listing_id, CASE WHEN area % 11 > 0 THEN price END AS price_inr, area * 100 AS area_sqft, (area % 5 + 1)::INT AS bhk, CASE WHEN agent IS NULL THEN 'owner' ELSE 'agent' END AS role, substr(posted_by, 8) AS poster,
       registered AS mentions_registration,
       CASE age % 5 WHEN 0 THEN greatest(date_diff('day', strptime(regexp_replace(posted, '''(\\d\\d)$', '20\\1'), '%b %d, %Y')::DATE, DATE '2002-01-01'), 0) WHEN 1 THEN age WHEN 2 THEN area * 7 WHEN 3 THEN 0 END::INT AS days_since_posted,
       CASE status WHEN 'Ready to Move' THEN 'ready_to_move' ELSE 'under_construction' END AS possession_status, registered AS intl_contact_hint, lower(regexp_replace(society_raw, ' (Phase 2|CHS)$', '')) AS society_key
FROM raw""",
    "canonical_scan": f"{_LI} SELECT city, corridor, count(*) AS n, sum(price)::BIGINT AS total_price FROM lo WHERE duplicate_of_id IS NULL GROUP BY ALL",
    "decode_payload": "SELECT event_id, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, json_extract_string(props, '$.missing') AS missing FROM events",
    "candidate_signals": f"""{_OWNERS}, found AS (
  SELECT doc_id, lang, list_filter(['worthless', 'license', 'trash'], lambda k: contains(lower(text), k)) AS ks FROM documents
)
SELECT * FROM owners
UNION ALL SELECT doc_id, lang, 'never_occupied', 'confirmed_genuine', 'keywords: ' || array_to_string(ks, ', ') FROM found WHERE len(ks) > 0""",
    "attach_candidates": f"""{_OWNERS}, c AS (
  SELECT corridor, society, list(DISTINCT listing_id ORDER BY listing_id) AS ids FROM owners JOIN lo USING (listing_id) GROUP BY ALL
)
SELECT corridor, society, coalesce(array_to_string(ids, ';'), '') AS ids, coalesce(len(ids), 0)::BIGINT AS n FROM (SELECT DISTINCT corridor, society FROM lo) LEFT JOIN c USING (corridor, society)""",
    "evidence_backfill": f"""{_OWNERS}
SELECT listing_id, lo.city, CASE WHEN status = 'P' THEN 'later signal' ELSE coalesce(o.evidence, 'no evidence recorded') END AS evidence FROM lo LEFT JOIN owners o USING (listing_id)""",
    "exclusive_sample": f"""{_LI}{_SAMPLES.format("lower(posted_by)")}
SELECT li.city, corridor, agent, min(e.url) AS sample_link FROM li LEFT JOIN exclusive e ON e.city = li.city AND e.url = li.url WHERE agent IS NOT NULL GROUP BY ALL""",
    "listing_fit": f"{_LEADS} SELECT city, society, n_listings, band_share, ready_share, registered_share, density, freshness, fit FROM fits",
    "listing_leads": f"{_LEADS} SELECT listing_id, lead_score, tier, signals, count(*) AS n FROM tiered GROUP BY ALL",
    "absentee_density": f"{_LEADS} SELECT * FROM dense",
    "corridor_absentee": f"""{_LI}, medians AS (
  SELECT city, corridor, median(price / area) AS m FROM li GROUP BY ALL
), s AS (
  SELECT city, corridor, count(*) AS n_listings, avg(age) AS a, 100 * count(*) FILTER (age >= 2400) / count(age) AS p, 100 * count(*) FILTER (vacant) / count(*) AS v,
         100 * count(*) FILTER (price / area < 0.85 * m AND age >= 600) / count(*) AS x
  FROM li JOIN medians USING (city, corridor) GROUP BY ALL
)
SELECT city, corridor, n_listings, {_half_up("a", 2)} AS avg_age, {_half_up("p", 2)} AS stale_pct, {_half_up("v", 2)} AS vacancy_pct, {_half_up("x", 2)} AS distressed_pct,
       {_half_up("10 * (1 - exp(-(p * 0.45 + v * 0.35 + x * 0.20) / 5))", 1)} AS absentee_score
FROM s""",
    "society_vacancy": f"""{_LI}, s AS (
  SELECT city, society, count(*) AS n_known, count(*) FILTER (age >= 600) AS n_first, count(*) FILTER (age >= 1000) AS n_second, avg(age) AS a, count(*) FILTER (age >= 1000) / count(*) AS r FROM li GROUP BY ALL
)
SELECT city, society, n_known, n_first, n_second, {_half_up("a", 1)} AS avg_age, {_half_up("r", 4)} AS stale_rate, {_half_up("(r + least(a / 3000, 1.0)) / 2", 4)} AS vacancy_probability,
       CASE WHEN n_known < 3 THEN 'low' WHEN n_known < 10 THEN 'medium' ELSE 'high' END AS confidence
FROM s""",
    "ranked_society_table": f"""{_LEADS}
SELECT f.city, f.society, fit, mean_score, coalesce(n_hot, 0) AS n_hot, coalesce(n_warm, 0) AS n_warm, coalesce(n_cold, 0) AS n_cold, d.density
FROM fits f LEFT JOIN dense d ON d.city = f.city AND d.society = f.society AND mean_score > 20""",
    "band_metrics": f"""{_LI}
SELECT city, corridor, society, count(*) AS supply, {_half_up("avg(age)", 1)} AS velocity_days, coalesce({_half_up("stddev_samp(price) / avg(price)", 4)}, 0.0) AS price_cov
FROM band GROUP BY ALL HAVING count(*) >= 3""",
    "band_status": f"{_LI} SELECT DISTINCT city AS city_id, 'ok' AS status FROM band UNION ALL SELECT city, 'skipped_no_price_band' FROM cities WHERE price_min IS NULL",
    "percentile_rank": f"""WITH v AS (SELECT o_orderkey, o_orderpriority, CASE WHEN o_orderkey % 9 > 0 THEN floor(o_totalprice / 1000) END AS v FROM orders), r AS (
  SELECT o_orderkey, {_rank("o_orderpriority", "v")} AS r FROM v
)
SELECT o_orderkey, {_half_up("r", 6)} AS by_histogram, {_half_up("r", 6)} AS by_window FROM r""",
    "unique_subjects": f"""{_LI}, n AS (
  SELECT city, agent, CASE WHEN l_orderkey % 3 = 0 THEN upper(agent) ELSE array_to_string(list_transform(string_split(agent, ' '), lambda w: upper(w[1]) || w[2:]), ' ') END AS display,
         count(*) AS n, min(ROW(l_orderkey, l_linenumber, l_partkey, l_suppkey)) AS f
  FROM li WHERE agent IS NOT NULL GROUP BY ALL
)
SELECT city, agent, display FROM n QUALIFY row_number() OVER (PARTITION BY city, agent ORDER BY n DESC, f) = 1""",
    "duplicate_marks": f"""{_LI}, first AS (
  SELECT listing_id, min(listing_id) OVER (PARTITION BY city, c_custkey, floor(price / 20000)) AS f FROM lo WHERE duplicate_of_id IS NULL
), marked AS (
  SELECT city, coalesce(lo.duplicate_of_id, CASE WHEN f < listing_id THEN f END) AS mark FROM lo LEFT JOIN first USING (listing_id)
)
SELECT city, count(*) AS total, count(*) FILTER (mark IS NULL) AS canonical, count(mark) AS marked FROM marked GROUP BY ALL""",
    "resolve_names": f"{_WRITTEN} SELECT * FROM resolved",
    "match_report": f"""{_WRITTEN} SELECT count(*) AS total, count(*) FILTER (written IS NULL) AS unnamed, count(dim_id) AS matched,
       {_half_up("count(dim_id) / count(written)", 4)} AS match_rate FROM resolved""",
    "seed_dimension": f"""{_WRITTEN}, fresh AS (
  SELECT lower(trim(s_name)) AS key, min(s_name) AS name FROM supplier GROUP BY ALL
), added AS (
  SELECT (SELECT max(dim_id) FROM dim) + row_number() OVER (ORDER BY key) AS dim_id, name FROM fresh WHERE key NOT IN (SELECT known FROM known)
)
SELECT dim_id, name FROM dim UNION ALL SELECT * FROM added""",
    "confidence_match": f"{_SNAPSHOT} SELECT * FROM matched",
    "match_coverage": f"{_SNAPSHOT} SELECT city_name, count(*) FILTER (matched) AS matched, count(*) FILTER (NOT matched) AS unmatched FROM matched GROUP BY ALL",
    "cache_upsert": f"{_SNAPSHOT} SELECT query, place_id, CASE WHEN rating >= 2 THEN 'cached' ELSE 'fresh' END AS origin, rating >= 2 AS served FROM snapshot",
    "page_facts": r"""SELECT page_id, try_cast(nullif(regexp_extract(html, '(?i)\b(\d{1,4})\s*(?:units|apartments|flats)\b', 1), '') AS INT) AS units,
       CASE WHEN contains(lower(html), 'ready to move') THEN 'ready to move' WHEN contains(lower(html), 'under construction') THEN 'under construction' WHEN contains(lower(html), 'possession by') THEN 'possession by'
            WHEN contains(lower(html), 'possession in') THEN 'possession in' WHEN contains(lower(html), 'ready for possession') THEN 'ready for possession' END AS possession,
       substr(CASE WHEN regexp_matches(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["''](.*?)["'']')
                THEN regexp_replace(regexp_extract(html, '(?is)<meta[^>]+name=["'']description["''][^>]+content=["''](.*?)["'']', 1), '^\s+|\s+$', '', 'g')
                WHEN regexp_matches(html, '(?is)<title[^>]*>(.*?)</title>') THEN trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '\s+', ' ', 'g')) END, 1, 300) AS description
FROM pages""",
    "page_registrations": r"""WITH h AS (
  SELECT page_id, CASE WHEN page_id % 2 = 0 THEN 'RERA no. ' ELSE 'No. ' END || 'P' || lpad(page_id::VARCHAR, 11, '5') || ' ' || html AS html FROM pages
), m AS (
  SELECT page_id, html, regexp_extract_all(html, '\b[A-Z]{1,3}\d{10,13}\b') AS ids, string_split_regex(html, '\b[A-Z]{1,3}\d{10,13}\b') AS parts FROM h
), n AS (
  SELECT page_id, html, unnest(ids) AS id, generate_subscripts(ids, 1) AS i, ids, parts FROM m
), p AS (
  SELECT page_id, html, id, i, list_sum(list_transform(parts[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ids[1:i - 1], lambda x: length(x))), 0) AS start FROM n
)
SELECT page_id, first AS registration FROM pages LEFT JOIN (
  SELECT page_id, arg_min(id, i) AS first FROM p
  WHERE contains(lower(substr(html, (greatest(start - 60, 0) + 1)::BIGINT, (start + length(id) + 10 - greatest(start - 60, 0))::BIGINT)), 'rera') GROUP BY page_id
) USING (page_id)""",
    "page_fragments": r"""WITH m AS (
  SELECT page_id, list_filter(regexp_extract_all(html, '[a-z]{3,12} [a-z]{3,12} the'), lambda x: NOT contains(lower(x), 'script') AND NOT contains(lower(x), 'style'))[1:8] AS f FROM pages
)
SELECT page_id, array_to_string(f, ';') AS fragments, len(f)::BIGINT AS n FROM m""",
    "text_flags": r"""SELECT doc_id, regexp_matches(text, '(?i)licen[sc]e') AS flag_license,
       regexp_matches(text, '[\w.]+@[\w.]+') AND NOT regexp_matches(text, '(?i)no reply') AS flag_contact, regexp_matches(text, '\d{3}') AND NOT regexp_matches(text, '(?i)copyright') AS flag_number
FROM documents""",
    "text_tokens": r"""WITH w AS (
  SELECT doc_id, text, list_distinct(regexp_extract_all(lower(text), '[a-z0-9]+')) AS ws FROM documents
), s AS (
  SELECT *, list_filter(ws, lambda x: length(x) > 2 AND x NOT IN ('the', 'and', 'with')) AS strong FROM w
)
SELECT doc_id, length(replace(replace(replace(lower(text), 'the', ''), 're', ''), 'on ', ''))::BIGINT AS left_chars,
       array_to_string(list_sort(CASE WHEN len(strong) > 0 THEN strong ELSE ws END), ' ') AS words, regexp_matches(text, '(\+1|\+44|\+971|\+61|\+65)[\s-]?\d') AS intl,
       concat_ws(';', CASE WHEN contains(lower(text), 'worthless') THEN 'worthless' END, CASE WHEN contains(lower(text), 'trash') THEN 'trash' END, CASE WHEN contains(lower(text), 'license') THEN 'license' END) AS keywords,
       contains(lower(text), 'vacant') OR contains(lower(text), 'scum') AS vacant
FROM s""",
    "page_links": r"""WITH n AS (
  SELECT page_id, replace(replace(regexp_extract(url, '//([^/]*)/', 1), '.', '-'), '-', ' ') AS name FROM pages
)
SELECT page_id, array_to_string(list_transform(string_split(name, ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS society,
       'http://s/hill-view-metro' || CASE WHEN page_id % 3 = 1 THEN '' ELSE '/page-' || page_id % 3 END AS listing_url
FROM n""",
    "csv_rows": f"{_CSV} SELECT city, corridor, n::VARCHAR AS n, statuses, top_price::VARCHAR AS top_price, (n > 500)::INT::VARCHAR AS large FROM rows",
    "typed_rows": f"{_CSV} SELECT city, corridor, n, top_price, NULL::BIGINT AS bad, string_split(statuses, ';')[1] AS first_status, len(string_split(statuses, ';'))::BIGINT AS n_statuses FROM rows",
    "coverage": f"{_LI} SELECT n_name AS name, CASE WHEN n_name IN (SELECT corridor FROM li) THEN 'scoreable_now' ELSE 'not_yet_scoreable' END AS coverage FROM nation",
    "name_sets": """WITH a AS (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9500), b AS (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000)
SELECT k, CASE WHEN k IN (SELECT k FROM b) THEN 'both' ELSE 'only' END AS side FROM a""",
    "society_export": f"""{_LI}{_SAMPLES.format("society")}, details AS (
  SELECT lower(p_name) AS society, max(p_brand) AS builder FROM part WHERE p_size > 25 GROUP BY ALL
), e AS (
  SELECT li.city, society, count(*) AS supply, min(x.url) AS sample_link FROM li LEFT JOIN exclusive x ON x.city = li.city AND x.url = li.url GROUP BY ALL
)
SELECT city, society, supply, builder, builder IS NOT NULL AS detail_available, sample_link FROM e LEFT JOIN details USING (society)""",
    "broker_export": f"""{_AGENTS}{_SAMPLES.format("lower(posted_by)")}, samples AS (
  SELECT li.city, corridor, agent, min(e.url) AS sample_link FROM li LEFT JOIN exclusive e ON e.city = li.city AND e.url = li.url WHERE agent IS NOT NULL GROUP BY ALL
)
SELECT city, corridor, agent, n_listings, activity_score, CASE WHEN s_acctbal > 5000 THEN '+91 ' || s_suppkey END AS phone, sample_link, sample_link IS NOT NULL AS traceable
FROM activity LEFT JOIN samples USING (city, corridor, agent) LEFT JOIN supplier ON lower(s_name) = agent""",
    "corridor_export": f"{_METRICS} SELECT corridor, composite, eligible, comps, resales, {_half_up('composite * 10', 1)} AS display_score FROM ranked JOIN metrics USING (corridor)",
    "city_summary": f"{_LI} SELECT c.city AS city_id, count(p.city) AS n_areas, any_value(price_min IS NOT NULL) AS has_price_band FROM cities c LEFT JOIN places p USING (city) GROUP BY ALL",
    "global_stats": f"""{_LI}
SELECT (SELECT count(*) FROM li) AS n_listings, (SELECT count(DISTINCT city) FROM li) AS n_cities, (SELECT count(DISTINCT society) FROM li) AS n_societies, (SELECT count(agent) FROM li) AS n_agent_listings,
       (SELECT count(*) FROM lo) AS n_orders, (SELECT count(duplicate_of_id) FROM lo) AS n_duplicates, (SELECT count(price_min) FROM cities) AS n_bands, (SELECT count(*) FROM pages) AS n_pages""",
    "rollup_counts": f"{_ROLLUP} SELECT * FROM counted",
    "age_histogram": f"""{_LI}, b AS (
  SELECT CASE WHEN l_linenumber >= 7 THEN 'unknown' WHEN age <= 100 THEN '<=100' WHEN age <= 600 THEN '101-600' WHEN age <= 5000 THEN '601-5000' ELSE '>5000' END AS bucket FROM li
)
SELECT k.ordinal, k.bucket, count(b.bucket) AS n FROM (VALUES (0, '<=100'), (1, '101-600'), (2, '601-5000'), (3, '>5000'), (4, 'unknown')) k(ordinal, bucket) LEFT JOIN b USING (bucket) GROUP BY ALL""",
    "load_volume": f"{_LI} SELECT city, corridor, count(*) AS n, CASE WHEN count(*) >= 2500 THEN 'OK' ELSE 'BELOW MINIMUM' END AS volume FROM li GROUP BY ALL",
    "share_of_max": f"{_LI}, n AS (SELECT city, corridor, count(*) AS n FROM li GROUP BY ALL) SELECT *, {_half_up('n / greatest(max(n) OVER (), 1)', 6)} AS share FROM n",
    "search": "SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE contains(lower(c_name), 'auto') OR contains(lower(c_mktsegment), 'auto')",
    "drill_down": f"{_LI} SELECT listing_id, corridor, price FROM lo WHERE city = 'ASIA' AND status = 'O'",
    "city_membership": f"{_LI} SELECT city, count(*) AS n FROM lo WHERE city IN (SELECT city FROM cities WHERE price_min IS NOT NULL) GROUP BY ALL",
    "top_page": f"{_LI} SELECT listing_id, price FROM lo ORDER BY price DESC, listing_id LIMIT 30 OFFSET 30",
    "sorted_listings": f"{_LI} SELECT listing_id, city, CASE WHEN listing_id % 4 > 0 THEN price END AS shown FROM lo",
    "lowest_listings": f"{_LI} SELECT listing_id, CASE WHEN listing_id % 400 > 0 THEN price END AS shown FROM lo",
    "city_alias": "SELECT c_custkey, c_mktsegment, CASE lower(c_mktsegment) WHEN 'automobile' THEN 'auto' WHEN 'building' THEN 'home' WHEN 'furniture' THEN 'home' END AS segment_id FROM customer",
    "area_reasons": f"""{_ROLLUP}, r AS (
  SELECT corridor, list_filter([CASE WHEN n_listings > 2000 THEN n_listings || ' listings' END, CASE WHEN n_agents > 1 THEN n_agents || ' agents in ' || corridor END,
         CASE WHEN n_vacant = 0 THEN 'nothing vacant' END, CASE WHEN freshest < 80 THEN 'newest ' || freshest || ' days old' END], lambda x: x IS NOT NULL)[1:2] AS r
  FROM counted
)
SELECT corridor, coalesce(array_to_string(r, '; '), '') AS reasons FROM r""",
    "unclassified": """SELECT lang, count(*) FILTER (l.doc_id IS NULL) AS todo, nullif(count(l.doc_id), 0) AS done, sum(toxic)::BIGINT AS toxic
FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY lang HAVING count(*) FILTER (l.doc_id IS NULL) > 0""",
}
