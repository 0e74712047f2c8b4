"""The versioned table store: a failed write leaves the old version, slices are swapped in one commit, and reads prune."""

import pytest
from pyspark.sql import functions as F

from parcelry.plans import jobs
from parcelry.sources import tables


def frame(spark, rows):
    return spark.createDataFrame(rows, "k long, city string, v string")


def shown(df):
    return sorted((tuple(r) for r in df.select("k", "city", "v").collect()), key=repr)


def test_versions_and_retention(spark, tmp_path):
    root = str(tmp_path / "t")
    assert tables.current_version(spark, root) is None
    with pytest.raises(FileNotFoundError):
        tables.read_current(spark, root)
    one = tables.write_version(frame(spark, [(1, "a", "x")]), root, retain=1)
    opened = tables.read_current(spark, root)
    two = tables.write_version(frame(spark, [(2, "b", "y")]), root, retain=1)
    assert (one.number, two.number) == (1, 2)
    assert shown(opened) == [(1, "a", "x")] == shown(tables.read_version(spark, root, one)) and shown(tables.read_current(spark, root)) == [(2, "b", "y")]
    tables.write_version(frame(spark, []), root, retain=1)
    assert tables.read_current(spark, root).collect() == [] and shown(tables.read_version(spark, root, two)) == [(2, "b", "y")]
    assert not (tmp_path / "t" / "data" / one.paths[0]).exists() and (tmp_path / "t" / "data" / two.paths[0]).exists()


@pytest.mark.parametrize("sliced", [False, True])
def test_a_write_that_dies_before_the_rename_leaves_the_old_version(spark, tmp_path, monkeypatch, sliced):
    root, column = str(tmp_path / "t"), "city" if sliced else None
    tables.write_version(frame(spark, [(1, "a", "x"), (2, "b", "y")]), root, slice_col=column)

    def dies(self, name, text):
        raise OSError("the driver is gone")

    with monkeypatch.context() as m:
        m.setattr(tables._Files, "replace", dies)
        with pytest.raises(OSError):
            tables.change_current(spark, root, lambda df: df.withColumn("v", F.lit("new")))
        if sliced:
            with pytest.raises(OSError):
                tables.replace_slices(frame(spark, [(9, "a", "z")]), root, "city", ["a", "b"])
    assert shown(tables.read_current(spark, root)) == [(1, "a", "x"), (2, "b", "y")] and tables.current_version(spark, root).number == 1
    assert len(tables.remove_orphans(spark, root)) == 1 + sliced and tables.remove_orphans(spark, root) == []
    tables.change_current(spark, root, lambda df: df.withColumn("v", F.lit("new")))
    assert shown(tables.read_current(spark, root)) == [(1, "a", "new"), (2, "b", "new")]


def test_a_task_that_fails_leaves_the_old_version(spark, tmp_path):
    root = str(tmp_path / "t")
    tables.write_version(frame(spark, [(1, "a", "x")]), root)
    with pytest.raises(Exception, match="no such row"):
        tables.change_current(spark, root, lambda df: df.withColumn("v", F.when(F.col("k") == 1, F.raise_error(F.lit("no such row")).cast("string"))))
    assert shown(tables.read_current(spark, root)) == [(1, "a", "x")]


def test_a_change_of_an_older_version_is_refused(spark, tmp_path):
    root = str(tmp_path / "t")
    first = tables.write_version(frame(spark, [(1, "a", "x")]), root)
    tables.write_version(frame(spark, [(2, "a", "x")]), root, based_on=first.number)
    with pytest.raises(tables.ConcurrentWrite):
        tables.write_version(frame(spark, [(3, "a", "x")]), root, based_on=first.number)
    assert shown(tables.read_current(spark, root)) == [(2, "a", "x")]


def test_slices_are_replaced_in_one_commit(spark, tmp_path):
    root = str(tmp_path / "t")
    odd = "a/b=c d%"
    tables.replace_slices(frame(spark, [(1, "a", "x"), (2, "b", "y"), (3, odd, "z"), (4, None, "n"), (5, "other", "o")]), root, "city", ["a", "b", odd, None])
    assert shown(tables.read_current(spark, root)) == [(1, "a", "x"), (2, "b", "y"), (3, odd, "z"), (4, None, "n")]
    before = tables.current_version(spark, root)
    after = tables.replace_slices(frame(spark, [(6, "a", "new")]), root, "city", ["a", "b", None])
    assert shown(tables.read_current(spark, root)) == [(3, odd, "z"), (6, "a", "new")] and shown(tables.read_version(spark, root, before))[0] == (1, "a", "x")
    # An empty slice is an entry, and what stays is not copied.
    assert after.slices[tables._name("b")] is None and after.slices[tables._name(odd)] == before.slices[tables._name(odd)]
    with pytest.raises(ValueError):
        tables.replace_slices(spark.createDataFrame([("a", 1)], "city string, other int"), root, "city", ["a"])


def test_upserts_marks_and_seeds_through_versions(spark, tmp_path):
    cache, listed, dim = (str(tmp_path / n) for n in ("cache", "listings", "dim"))
    tables.write_version(frame(spark, [(1, "a", "old"), (2, "b", "old")]), cache)
    jobs.store_lookups(spark, cache, frame(spark, [(2, "b", "new"), (3, "c", "new")]), ["k"])
    assert shown(tables.read_current(spark, cache)) == [(1, "a", "old"), (2, "b", "new"), (3, "c", "new")]
    tables.write_version(spark.createDataFrame([(1, "m", None), (2, "m", None), (3, "n", 1)], "id long, city string, duplicate_of_id long"), listed, slice_col="city")
    jobs.store_marks(spark, listed, spark.createDataFrame([(1, 2), (9, 3)], "canonical_id long, duplicate_id long"))
    assert sorted(tuple(r) for r in tables.read_current(spark, listed).select("id", "duplicate_of_id").fillna(0).collect()) == [(1, 0), (2, 1), (3, 9)]
    tables.write_version(spark.createDataFrame([(4, "Alpha")], "dim_id long, name string"), dim)
    for _ in range(2):
        jobs.store_seed(spark, dim, spark.createDataFrame([("beta",), (" alpha ",)], "name string"))
    assert sorted(tuple(r) for r in tables.read_current(spark, dim).collect()) == [(4, "Alpha"), (5, "beta")]


def test_the_raw_store_prunes_cities_and_keeps_batches(spark, tmp_path):
    root = str(tmp_path / "raw")
    batch = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("c"), (F.col("id") % 3).cast("string")).alias("city"), (F.col("id") % 7).cast("string").alias("project"))
    jobs.ingest(batch(0, 30), root, "city", "project")
    jobs.ingest(batch(30, 60), root, "city", "project")
    one = jobs.stored_raw(spark, root, ["c1"], ("id", "project"))
    assert sorted(int(r["id"]) for r in one.collect()) == [i for i in range(60) if i % 3 == 1]
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(city_id" in plan or "PartitionFilters: [city_id" in plan
    bands = spark.createDataFrame([("c0", 1, 2), ("c1", None, None)], "city_id string, price_min long, price_max long")
    banded = jobs.stored_raw(spark, root, bands, ("id",))
    assert sorted(int(r["id"]) for r in banded.collect()) == [i for i in range(60) if i % 3 == 0]
    assert "dynamicpruning" in banded._jdf.queryExecution().executedPlan().toString()
    assert spark.read.parquet(f"{root}/data").filter("city_id = 'c1'").count() == 20


def test_exports_are_written_once_and_counted_from_what_was_written(spark, tmp_path):
    calls = spark.sparkContext.accumulator(0)

    def counted(df):
        return df.mapInArrow(lambda batches: (calls.add(b.num_rows) or b for b in batches), df.schema)

    df = lambda rows, schema: counted(spark.createDataFrame(rows, schema))
    datasets = jobs.export_datasets(
        df([("m", True), ("n", False)], "city_id string, has_price_band boolean"), df([("x",)], "corridor string"), df([("s", True), ("t", False)], "society string, detail_available boolean"),
        df([("g", False)], "agent string, contact_available boolean"), df([(1,)], "id long"), df([("u",), ("v",)], "link string"),
    )
    counts = jobs.write_exports(datasets, str(tmp_path / "e"))
    assert counts == {"cities": 2, "corridors": 1, "societies": 2, "brokers": 1, "absentee_candidates": 1, "nri_directory": 2, "stats": 1}
    assert calls.value == 9  # each row once
    stats = spark.read.json(str(tmp_path / "e" / "stats")).collect()[0]
    assert (stats["total_cities_live"], stats["total_cities_fully_scored"], stats["total_societies_scored"], stats["total_directory_links"]) == (2, 1, 2, 2)
    assert {r["dataset"]: r["n"] for r in spark.read.json(str(tmp_path / "e" / "manifest")).collect()} == counts
