from types import SimpleNamespace

import pytest

from graphloom import lineage


def test_tables_are_written_read_and_deleted(spark):
    one = lineage.written(spark.range(5), "some")
    two = lineage.written(one.where("id > 2"), "some")
    assert two.count() == 2 and {one.written_to, two.written_to} <= lineage.WRITTEN
    lineage.forget(one)
    with pytest.raises(Exception):  # noqa: B017 - its files are gone
        spark.read.parquet(one.written_to).count()
    assert two.count() == 2
    lineage.sweep(spark)
    assert not lineage.WRITTEN


def test_no_folder_is_made_up_on_a_cluster():
    none = SimpleNamespace(isDefined=lambda: False)
    for master in ("spark://h:7077", "yarn", "local-cluster[2,1,1024]"):
        spark = SimpleNamespace(conf=SimpleNamespace(get=lambda *_: None), sparkContext=SimpleNamespace(master=master, _jsc=SimpleNamespace(sc=lambda: SimpleNamespace(getCheckpointDir=lambda: none))))
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            lineage.shared_dir(spark)
