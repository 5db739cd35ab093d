"""Intermediate tables in the folder that all executors share.

A table that is read more than once is written once and read back: this cuts its
lineage and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir`` of the session. Where it is unset, one machine (tests)
    uses a folder under /tmp/checkpoints; a cluster has to name one."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir is unset: name a folder that all executors share")
        os.makedirs("/tmp/checkpoints", exist_ok=True)
        folder = "file://" + tempfile.mkdtemp(prefix="lamina-", dir="/tmp/checkpoints")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def _at_exit(spark: SparkSession, path: str) -> None:
    if spark.sparkContext._jsc is not None:
        try:
            delete(spark, path)
        except Exception:  # the gateway is gone: the cluster's own clean-up is left
            pass


#: Whether Spark drops the shuffle files of a query when it ends; else they stay until the driver collects its garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def saved(frame: DataFrame, conf: dict[str, str] | None = None) -> DataFrame:
    """The frame as a table, which goes when the driver process ends. The shuffle files that it took go at once.
    ``conf``: settings that hold while it is made."""
    spark = frame.sparkSession
    path = f"{shared_folder(spark)}/lamina-{uuid.uuid4().hex}"
    atexit.register(_at_exit, spark, path)
    held = {CLEANUP: "true"} | (conf or {})
    before = {k: spark.conf.get(k, None) for k in held}
    for k, v in held.items():
        spark.conf.set(k, v)
    try:
        frame.write.option("compression", "zstd").parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v) if v is not None else spark.conf.unset(k)
    return spark.read.schema(frame.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Removes a ``saved`` table that nothing reads any more."""
    for folder in {f.rpartition("/")[0] for f in table.inputFiles()}:
        delete(table.sparkSession, folder)
