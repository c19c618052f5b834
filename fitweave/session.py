"""Session helpers: local sessions for tests, materialised steps for jobs."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, suppress

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, memory: str = "12g") -> SparkSession:
    """A session for tests and the local bench; clusters bring their own."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fitweave")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", memory)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )


_shared: dict[tuple[str, str], bool] = {}


def _is_shared(spark: SparkSession, folder: str) -> bool:
    """Whether what tasks write to the folder is there for all; tried once for each application and folder."""
    key = (spark.sparkContext.applicationId, folder)
    if key not in _shared:
        path, tasks = f"{folder}/fitweave-probe-{uuid.uuid4().hex}", 4 * spark.sparkContext.defaultParallelism
        rows = spark.range(0, tasks, 1, tasks)
        try:
            rows.write.parquet(path)
            _shared[key] = spark.read.schema(rows.schema).parquet(path).count() == tasks
        except (PySparkException, Py4JJavaError):  # tasks may not write there, or what they wrote can't be listed or read
            _shared[key] = False
        finally:
            with suppress(Py4JJavaError):
                delete(spark, path)
    return _shared[key]


def step_folder(spark: SparkSession) -> str:
    """Folder for intermediate tables: the cluster's ``spark.checkpoint.dir``, else a folder of its warehouse.

    Only a local session without that setting gets a folder of its own. A path of a cluster that may be one
    machine's, without a scheme or of the warehouse, is tried once: a mounted folder is as good as a file system's name,
    and where the named folder loses rows the steps go to the warehouse.
    """
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster"):
        if named is None:
            named = tempfile.mkdtemp(prefix="fitweave-steps-", dir="/tmp")
            spark.sparkContext.setCheckpointDir(named)
        return named
    if named and "://" in named:
        return named
    warehouse = spark.conf.get("spark.sql.warehouse.dir", None)
    folders = [f for f in (named, warehouse and f"{warehouse.rstrip('/')}/fitweave-steps") if f]
    for folder in folders:
        if _is_shared(spark, folder):
            return folder
    raise RuntimeError(f"{' and '.join(folders) or 'no folder'} not shared: rows that tasks write there are not read back. Set spark.checkpoint.dir to a shared folder.")


_owners: list[list[str]] = []


@contextmanager
def owned_steps(spark: SparkSession) -> Iterator[None]:
    """Delete the steps written inside the block when it ends; write or collect results before that."""
    _owners.append([])
    try:
        yield
    finally:
        for path in _owners.pop():
            delete(spark, path)


def own(path: str) -> None:
    """Leave a step to the innermost ``owned_steps`` block, if there is one."""
    if _owners:
        _owners[-1].append(path)


def delete(spark: SparkSession, path: str) -> None:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write an intermediate result once and read it back.

    Lineage ends at the written table, so lost executors cost a re-read only,
    and the planner knows the real size of what follows.
    """
    spark = df.sparkSession
    path, before = f"{step_folder(spark)}/fitweave-{uuid.uuid4().hex}", spark.conf.get(_CLEANUP)
    own(path)
    spark.conf.set(_CLEANUP, "true")  # the step's shuffle files go once it is written
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def drop(*steps: DataFrame) -> None:
    """Delete steps of ``checkpointed`` that nothing reads any more."""
    for step in steps:
        delete(step.sparkSession, step.stored_at)
