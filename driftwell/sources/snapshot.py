"""Tables that are looked up by key: rows in blocks of key ranges, and a directory that says which block has a key.

A lookup reads the one block, a folder of its own, and of that only the row groups whose statistics or bloom filter let the key
be there.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators.prefix import cuts_of, range_of


class Snapshot:
    """A table at ``root``, in the shared store, clustered by ``key``, a number or a time; rows without a key are in no block."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        facts = spark.read.parquet(f"{self.root}/directory").first()
        self.key, self.cuts, self.blocks = facts["key"], list(facts["cuts"] or []), set(facts["blocks"])
        self._schema = spark.read.parquet(f"{self.root}/empty").schema

    @classmethod
    def write(cls, df: DataFrame, key: str, root: str, ranges: int | None = None) -> Snapshot:
        """Clusters ``df`` into ``ranges`` blocks at most, as many as its rows ask for by default."""
        spark, root = df.sparkSession, root.rstrip("/")
        cuts = cuts_of(df, key, ranges)
        placed = df.withColumn("_block", range_of(key, cuts)).where("_block is not null")
        out = placed.repartition(len(cuts) + 1, "_block").sortWithinPartitions("_block", key)
        out.write.mode("overwrite").partitionBy("_block").option(f"parquet.bloom.filter.enabled#{key}", "true").parquet(f"{root}/rows")
        blocks = [r["_block"] for r in spark.read.parquet(f"{root}/rows").select("_block").distinct().collect()] if placed.limit(1).count() else []
        df.limit(0).write.mode("overwrite").parquet(f"{root}/empty")
        kind = dict(df.dtypes)[key]
        spark.createDataFrame([(key, cuts, blocks)], f"key string, cuts array<{kind}>, blocks array<int>").write.mode("overwrite").parquet(f"{root}/directory")
        return cls(spark, root)

    def block(self, value) -> str | None:
        """The folder that has the rows of a key, if there are any."""
        number = bisect_right(self.cuts, value)
        return f"{self.root}/rows/_block={number}" if number in self.blocks else None

    def find(self, value) -> DataFrame:
        """The rows of a key, read from its block alone."""
        folder = self.block(value)
        if folder is None:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.schema(self._schema).parquet(folder).where(F.col(self.key) == F.lit(value))

    def table(self) -> DataFrame:
        """All rows."""
        if not self.blocks:
            return self.spark.createDataFrame([], self._schema)
        return self.spark.read.parquet(f"{self.root}/rows").select(*self._schema.names)
