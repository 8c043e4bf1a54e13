"""Counts over all rows of a stream, batch by batch: they have no key to keep state under.

Each micro-batch is counted like a table, and the totals of the batches before are added.  The totals are a few tables of
falling size: one that the later ones have caught up with is folded with them, so that a batch reads few, however many came
before.  A batch writes its features, then its totals, and last a manifest that names the tables of totals and the last time;
the manifest commits it.  A batch that is sent again starts from the state before it and writes the same.  Times must rise
from batch to batch: rows at or before the last committed time stop the query in strict mode and are left out otherwise.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwell.operators import history
from driftwell.operators.prefix import cuts_of

_TOTALS = "name string, value string, rows long"
_MANIFEST = "last_time double, parts array<struct<path:string,rows:long>>"
#: The name under which every row is counted.
EVERY = "*"


def state(spark: SparkSession, root: str, batch: int) -> tuple[float | None, list[tuple[str, int]]]:
    """The last time and the tables of totals with their rows, as they were before ``batch``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits")
    files = path.getFileSystem(spark._jsc.hadoopConfiguration())
    numbers = sorted((int(s.getPath().getName().removeprefix("batch-")) for s in files.listStatus(path)), reverse=True) if files.exists(path) else []
    for n in numbers:
        if n < batch and files.exists(spark._jvm.org.apache.hadoop.fs.Path(f"{root}/commits/batch-{n}/_SUCCESS")):
            row = spark.read.schema(_MANIFEST).parquet(f"{root}/commits/batch-{n}").first()
            return row["last_time"], [(p["path"], p["rows"]) for p in row["parts"]]
    return None, []


def _totals(spark: SparkSession, parts: list[tuple[str, int]]) -> DataFrame:
    tables = [spark.read.schema(_TOTALS).parquet(p) for p, _ in parts]
    return reduce(DataFrame.unionByName, tables) if tables else spark.createDataFrame([], _TOTALS)


def counting(root: str, strict: bool = True) -> Callable[[DataFrame, int], None]:
    """A foreachBatch handler; features go to ``root``/features/batch-<n>."""

    def run(rows: DataFrame, batch: int) -> None:
        spark = rows.sparkSession
        last, parts = state(spark, root, batch)
        if last is not None:
            late = rows.where(F.col("TransactionDT") <= last)
            if strict and not late.isEmpty():
                raise ValueError(f"rows at or before {last} in batch {batch}")
            rows = rows.where(F.col("TransactionDT") > last)
        old = _totals(spark, parts)
        keyed = history.with_keys(rows)
        each = keyed.select("TransactionID", "TransactionDT", F.lit(EVERY).alias("name"), F.lit("").alias("value"))
        counted = history.prior_counts(history.category_cells(keyed).unionByName(each), cuts_of(rows, "TransactionDT"))
        own = old.groupBy("name", "value").agg(F.sum("rows").alias("own_before"))
        every = old.groupBy("name").agg(F.sum("rows").alias("all_before"))
        zero = F.lit(0).cast("long")
        whole = counted.join(own, ["name", "value"], "left").join(every, "name", "left").withColumns({"own": F.col("own") + F.coalesce("own_before", zero), "everyone": F.col("everyone") + F.coalesce("all_before", zero)})
        names = tuple(history.FREQUENCIES)
        total = whole.where(F.col("name") == EVERY).select("TransactionID", "TransactionDT", F.col("own").alias("prior_global_count"))
        features = total.join(history.by_row(whole.where(F.col("name") != EVERY), names), "TransactionID", "left")
        features.write.mode("overwrite").parquet(f"{root}/features/batch-{batch}")

        def write(totals: DataFrame, name: str) -> tuple[str, int]:
            path = f"{root}/totals/{name}-{batch}"
            totals.groupBy("name", "value").agg(F.sum("rows").alias("rows")).write.mode("overwrite").parquet(path)
            return path, spark.read.schema(_TOTALS).parquet(path).count()

        parts = [*parts, write(counted.select("name", "value", F.lit(1).cast("long").alias("rows")), "batch")]
        caught_up = [i for i in range(len(parts) - 1) if sum(n for _, n in parts[i + 1 :]) >= parts[i][1]]
        if caught_up:
            parts = [*parts[: caught_up[0]], write(_totals(spark, parts[caught_up[0] :]), "folded")]
        newest = rows.agg(F.max("TransactionDT")).first()[0]
        manifest = (last if newest is None else newest, parts)
        spark.createDataFrame([manifest], _MANIFEST).coalesce(1).write.mode("overwrite").parquet(f"{root}/commits/batch-{batch}")

    return run
