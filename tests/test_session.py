import os
import uuid
from types import SimpleNamespace

import pytest

from fitweave.session import checkpointed, owned_steps, step_folder


def test_owned_steps_are_deleted(spark):
    with owned_steps(spark):
        kept = checkpointed(spark.range(5))
        path = kept.inputFiles()[0].removeprefix("file://")
        assert kept.count() == 5 and os.path.exists(path)
    assert not os.path.exists(path)
    free = checkpointed(spark.range(5))
    assert os.path.exists(free.inputFiles()[0].removeprefix("file://"))


class Cluster:
    """The test session, under the master of a cluster and with settings of its own."""

    def __init__(self, spark, **settings):
        self.spark, self.settings, self.sparkContext, self.conf = spark, settings, SimpleNamespace(
            master="spark://head:7077", applicationId=uuid.uuid4().hex, defaultParallelism=2, getCheckpointDir=lambda: None), self

    def get(self, name, default=None):
        return self.settings.get(name, default)

    def __getattr__(self, name):
        return getattr(self.spark, name)


def test_a_mounted_folder_without_a_scheme_holds_the_steps_of_a_cluster(spark, tmp_path):
    assert step_folder(Cluster(spark, **{"spark.checkpoint.dir": str(tmp_path)})) == str(tmp_path)
    assert list(tmp_path.iterdir()) == []  # the probe is gone


def test_the_warehouse_holds_the_steps_of_a_cluster_without_a_folder(spark, tmp_path):
    assert step_folder(Cluster(spark, **{"spark.sql.warehouse.dir": f"file:{tmp_path}"})) == f"file:{tmp_path}/fitweave-steps"


def test_a_folder_that_loses_rows_is_refused(spark, tmp_path):
    cluster = Cluster(spark, **{"spark.checkpoint.dir": str(tmp_path)})
    cluster.read = SimpleNamespace(schema=lambda schema: SimpleNamespace(parquet=lambda path: SimpleNamespace(count=lambda: 3)))
    with pytest.raises(RuntimeError, match="not shared"):
        step_folder(cluster)


def test_a_named_folder_that_loses_rows_leaves_the_steps_to_the_warehouse(spark, tmp_path):
    """Tasks of a cluster that does not share the folder write elsewhere, or may not write there; the warehouse is shared by contract."""
    shut = tmp_path / "shut"
    shut.write_text("a file, so nothing can be written below")
    cluster = Cluster(spark, **{"spark.checkpoint.dir": str(shut), "spark.sql.warehouse.dir": f"file:{tmp_path}/tables"})
    folder = step_folder(cluster)
    assert folder == f"file:{tmp_path}/tables/fitweave-steps"
    spark.range(3).write.parquet(f"{folder}/step")
    assert spark.read.parquet(f"{folder}/step").count() == 3


def test_a_cluster_of_one_machine_has_no_folder_of_the_driver_alone(spark, tmp_path):
    cluster = Cluster(spark, **{"spark.sql.warehouse.dir": f"file:{tmp_path}"})
    cluster.sparkContext.master = "local-cluster[3,4,2000]"
    assert step_folder(cluster) == f"file:{tmp_path}/fitweave-steps"
