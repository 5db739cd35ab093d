"""Intermediate tables in the folder that all executors share.

A table that is read more than once is written once and read back: this cuts
its lineage, keeps only its columns, and survives the loss of an executor.
"""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession

from lamina.operators.tables import delete, shared_folder


class Scratch:
    """Tables of one operator call. What the returned plan still reads stays
    until the driver process ends; ``drop`` removes a table before that."""

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.folder = f"{shared_folder(spark)}/lamina-{uuid.uuid4().hex}"
        self.paths: dict[int, str] = {}
        atexit.register(self.close)

    def save(self, frame: DataFrame) -> DataFrame:
        path = f"{self.folder}/{len(self.paths)}-{uuid.uuid4().hex[:8]}"
        frame.write.parquet(path)
        back = self.spark.read.schema(frame.schema).parquet(path)
        self.paths[id(back)] = path
        return back

    def drop(self, saved: DataFrame) -> None:
        if path := self.paths.get(id(saved)):
            delete(self.spark, path)

    def close(self) -> None:
        if self.spark.sparkContext._jsc is not None:
            try:
                delete(self.spark, self.folder)
            except Exception:  # the gateway is gone: the cluster's own clean-up is left
                pass
