"""Intermediate tables: where they are written and when they go."""

import os

import pytest

from parcelry.sources import scratch


def there(table):
    return os.path.isdir(table._kept_at)


def test_tables_go_when_they_are_discarded(spark):
    a, b = (scratch.keep(spark.range(5), "test") for _ in range(2))
    scratch.discard(a)
    assert not there(a) and there(b) and b.count() == 5


def test_a_block_leaves_only_what_it_names(spark):
    stay = []
    outer = scratch.keep(spark.range(3), "test")
    with scratch.tables_of(spark, but=stay):
        inner = scratch.keep(outer, "test")
        with pytest.raises(ValueError), scratch.tables_of(spark, but=[]):
            failed = scratch.keep(outer, "test")
            raise ValueError
        stay.append(scratch.keep(inner, "test"))
    assert there(outer) and there(stay[0]) and not there(inner) and not there(failed)
    assert stay[0].count() == 3


def test_a_cluster_needs_a_shared_folder():
    class Context:
        master = "spark://somewhere"

        def getCheckpointDir(self):
            return None

    class Session:
        sparkContext = Context()
        conf = type("Conf", (), {"get": staticmethod(lambda name, default: default)})

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch.shared_dir(Session())
