from __future__ import annotations

from types import SimpleNamespace

import pytest

from quittance.session import _handed_out, drop_work_folders, shuffle_width, work_folder
from quittance.sources.files import exists


def _session(master, **conf):
    settings = {k.replace("_", "."): v for k, v in conf.items()}
    return SimpleNamespace(
        conf=SimpleNamespace(get=lambda key, default=None: settings.get(key, default)),
        sparkContext=SimpleNamespace(master=master, getCheckpointDir=lambda: None),
    )


def test_intermediate_tables_go_to_the_shared_folder():
    cluster = _session("spark://host:7077", spark_checkpoint_dir="hdfs://shared/checkpoints/")
    first, second = work_folder(cluster, "raw"), work_folder(cluster, "raw")
    assert first.startswith("hdfs://shared/checkpoints/quittance/raw-")
    assert first != second


def test_a_cluster_without_a_shared_folder_is_refused():
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        work_folder(_session("spark://host:7077"), "raw")


def test_only_a_local_session_gets_a_folder_of_its_own():
    assert "quittance" in work_folder(_session("local[2]"), "raw")


def test_shuffle_width_follows_the_session(spark):
    key = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
    plain = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert shuffle_width(spark) == plain
    spark.conf.set(key, str(plain + 5))
    try:
        assert shuffle_width(spark) == plain + 5
    finally:
        spark.conf.unset(key)


def test_work_folders_can_be_dropped(spark):
    _handed_out.clear()
    folder = work_folder(spark, "test")
    spark.range(3).write.parquet(folder)
    assert spark.read.parquet(folder).count() == 3
    assert drop_work_folders(spark) >= 1
    assert not exists(spark, folder)
    assert drop_work_folders(spark) == 0
