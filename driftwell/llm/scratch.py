"""Shared-folder tables that cut lineage between the steps of one operator.

Every table goes to a folder below ``spark.checkpoint.dir``, which all executors see, so a lost executor costs only the
tasks it ran.
"""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

from driftwell.sources.shared import folder

#: Drops the shuffle files of a job when the job has written its table; peak disk is then one step, not their sum.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def settings(spark: SparkSession, **values: str):
    """Session settings that hold inside the block only."""
    names = {k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k, None) for k in names}
    for k, v in names.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


class Scratch:
    """Tables of one operator run; ``keep`` writes one and reads it back, ``drop`` deletes one that is used up."""

    def __init__(self, spark: SparkSession, label: str):
        self.spark = spark
        self.root = folder(spark, label)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def keep(self, df: DataFrame, name: str) -> DataFrame:
        with settings(self.spark, **{_CLEAN.replace(".", "__"): "true"}):
            df.write.mode("overwrite").parquet(self.path(name))
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(path, True)
