"""Every registered query that has SQL gives the rows that DuckDB gives, on the smallest tables."""

import os

import duckdb
import pytest

from parcelry.operators import ranks, scores, signals
from parcelry.plans import queries, views
from parcelry.plans.oracles import ORACLES
from parcelry.plans.queries import QUERIES

DATA = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{DATA}/{t}.parquet')")
    return con


def canonical(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = lambda v: tuple(v) if isinstance(v, list) else float(v) if isinstance(v, (int, float)) and not isinstance(v, bool) else v
    return sorted(names), sorted((tuple(plain(row[i]) for i in order) for row in data), key=repr)


@pytest.mark.parametrize("name", ORACLES)
def test_query_equals_sql(spark, duck, name):
    out = QUERIES[name](spark, DATA)
    duck.execute(ORACLES[name])
    want = canonical([c[0] for c in duck.description], duck.fetchall())
    assert canonical(out.columns, [list(r) for r in out.collect()]) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_other_queries_run(spark, name):
    assert QUERIES[name](spark, DATA).collect() is not None


@pytest.mark.parametrize("name", ["export_stats", "exports_written"])
def test_exports_compute_listings_once(spark, monkeypatch, name):
    made, plain = [], views.line_listings
    counting = lambda *where: made.append(1) or plain(*where)
    monkeypatch.setattr(views, "line_listings", counting)
    monkeypatch.setattr(queries, "line_listings", counting)
    QUERIES[name](spark, DATA)
    assert len(made) == 1


def test_export_stats_writes_no_table_of_listings(spark, monkeypatch):
    kept = []
    for module in (queries, ranks, scores, signals):
        plain = module.keep
        monkeypatch.setattr(module, "keep", lambda df, name, plain=plain: kept.append((name, out := plain(df, name))) or out)
    assert QUERIES["export_stats"](spark, DATA).count() == 1
    sizes = {name: table.count() for name, table in kept}
    listings, orders = (views.read(spark, DATA, t).count() for t in ("lineitem", "orders"))
    assert all(n < min(listings, orders) / 2 for n in sizes.values()), sizes


def test_export_stats_counts_the_whole_datasets(spark):
    assert QUERIES["export_stats"](spark, DATA).collect() == queries._datasets(spark, DATA)["stats"].collect()


def test_exports_of_an_area_without_a_name(spark, tmp_path):
    con = duckdb.connect()
    for t in TABLES:
        name = "* REPLACE (CASE WHEN n_nationkey <> 8 THEN n_name END AS n_name)" if t == "nation" else "*"
        con.execute(f"COPY (SELECT {name} FROM read_parquet('{DATA}/{t}.parquet')) TO '{tmp_path}/{t}.parquet' (FORMAT parquet)")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tmp_path}/{t}.parquet')")
    in_area = con.execute("SELECT count(*) FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE s_nationkey = 8 AND s_suppkey % 2 = 0").fetchone()[0]
    assert in_area > 0
    for name in ("export_stats", "exports_written"):
        con.execute(ORACLES[name])
        want = canonical([c[0] for c in con.description], con.fetchall())
        out = QUERIES[name](spark, str(tmp_path))
        assert canonical(out.columns, [list(r) for r in out.collect()]) == want
