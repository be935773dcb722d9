"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_SCRATCH: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """A new folder name below the folder the cluster shares, in one folder for each application.

    The base is ``spark.checkpoint.dir``; where that is unset, a cluster uses the warehouse folder and a
    local session a temporary one. The application's folder is deleted when the driver's Python ends, as
    results that were not read by then can still need it.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        local = spark.conf.get("spark.master", "local").split("[")[0] == "local"
        base = tempfile.gettempdir() if local else spark.conf.get("spark.sql.warehouse.dir")
    sc = spark.sparkContext
    own = f"{base.rstrip('/')}/lodestone/{sc.applicationId}"
    if own not in _SCRATCH:
        _SCRATCH.add(own)
        atexit.register(_remove, sc._jvm, sc._jsc.hadoopConfiguration(), own)
    return f"{own}/{uuid.uuid4().hex}"


def _remove(jvm, conf, folder: str) -> None:
    with contextlib.suppress(Exception):  # the JVM may be gone
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession):
    """Within it, an action's shuffle files go when the action ends; what is written stays."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, "false")
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def materialize(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back, so that its lineage ends there.

    A lost executor then costs only its running tasks, and a table used twice is computed once.
    """
    spark = df.sparkSession
    path = shared_dir(spark)
    with freeing_shuffles(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.scratch_path = path
    return out


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialize`` wrote, once nothing will read them again."""
    for df in tables:
        sc = df.sparkSession.sparkContext
        _remove(sc._jvm, sc._jsc.hadoopConfiguration(), df.scratch_path)
