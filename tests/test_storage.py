"""Tables between jobs: where they lie, and when they go."""

import os

import pytest

from kmerweave import storage


def test_scratch_tables_go(spark):
    kept = storage.new_path(spark, "kept")
    spark.range(3).write.parquet(kept)
    with storage.scratch(spark):
        path = storage.new_path(spark, "gone")
        spark.range(5).write.parquet(path)
        assert spark.read.parquet(path).count() == 5
    exists = lambda p: os.path.exists(p.removeprefix("file:"))
    assert exists(kept) and not exists(path)
    storage.remove(spark, kept)
    assert not exists(kept)


def test_a_cluster_needs_a_shared_folder():
    class Conf:
        def get(self, key):
            return None

    class Unset:
        def __getattr__(self, name):
            return lambda *a: self

        def isEmpty(self):  # noqa: N802
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = Unset()

        def getConf(self):  # noqa: N802
            return Conf()

    class Session:
        sparkContext = Context()  # noqa: N815

    with pytest.raises(ValueError):
        storage.shared_folder(Session())
