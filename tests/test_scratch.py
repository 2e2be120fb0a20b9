import os

import pytest

from geoloom import scratch
from geoloom.scratch import Scratch


def test_local_tables_start_no_children_for_folders_checksums_or_markers(spark, tmp_path):
    """Each chmod that Hadoop starts shares its JVM's memory until it runs, which is then seen twice."""
    work = Scratch(spark, "alone")
    work.path = f"file://{tmp_path}/alone"
    found = work.table(spark.range(1000).repartition(3), "one")
    files = os.listdir(tmp_path / "alone/one")
    assert len(files) == 3 and all(f.endswith(".parquet") for f in files)
    assert found.count() == 1000
    work.close()
    assert not (tmp_path / "alone").exists()


def test_a_table_of_the_same_name_replaces_the_first(spark):
    work = Scratch(spark, "again")
    work.table(spark.range(10), "one")
    assert work.table(spark.range(3), "one").count() == 3
    assert work.table(spark.range(0), "one").count() == 0
    work.close()


@pytest.mark.parametrize(("share", "times"), [(0.0, 2), (1.0, 0)])
def test_a_grown_heap_is_collected_after_a_table(spark, monkeypatch, share, times):
    """The plans of many small queries, without any broadcast, leave their garbage in the driver's heap."""
    freed = []
    monkeypatch.setattr(scratch, "_HEAP", share)
    monkeypatch.setattr(scratch, "release", freed.append)
    work = Scratch(spark, "grown")
    for name in ("one", "two"):
        work.table(spark.range(3), name)
    assert len(freed) == times
