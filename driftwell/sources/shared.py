"""Tables in the folder that driver and executors share: they cut lineage, and a lost executor costs only its tasks."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def folder(spark: SparkSession, label: str) -> str:
    """A new folder below spark.checkpoint.dir; where that isn't set, below one of this process on one machine only.

    ValueError on a cluster without spark.checkpoint.dir: no folder of the driver's is seen by its executors.
    """
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not top:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _OWN:
            _OWN.append("file://" + tempfile.mkdtemp(prefix="driftwell-"))
        top = _OWN[0]
    return f"{top.rstrip('/')}/{label}-{uuid.uuid4().hex[:12]}"


def keep(df: DataFrame, label: str) -> DataFrame:
    """``df`` written as a table and read back."""
    path = folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
