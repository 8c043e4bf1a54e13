"""Taking documents out of a table by their ids."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W


def _packed(docs: DataFrame) -> DataFrame:
    """(id, salt, row): rows packed, so that no column meets another; rows without doc_id are spread by their text."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    salt = F.when(F.col("row.doc_id").isNull(), F.xxhash64(F.col("row.text").cast("string"))).otherwise(F.lit(0).cast("long"))
    return row.select(F.col("row.doc_id").alias("id"), salt.alias("salt"), "row")


def without(docs: DataFrame, gone: DataFrame, once: bool = False) -> DataFrame:
    """``docs`` without the rows whose doc_id is in ``gone`` (doc_id), columns as they are.

    Rows without doc_id can't be named and stay.  With ``once``, of rows equal in doc_id and text one stays, the same
    one in every run.  ``gone`` is a
    table, so that Spark knows its size: a small one is sent to the rows, a large one meets them by id, and what ``once``
    then asks for is together already.
    """
    kept = _packed(docs).join(gone.select(F.col("doc_id").alias("id"), F.lit(0).cast("long").alias("salt")), ["id", "salt"], "left_anti")
    if once:
        again = W.partitionBy("id", "salt", F.col("row.text")).orderBy(F.xxhash64("row"))
        kept = kept.withColumn("place", F.row_number().over(again)).where("place = 1")
    return kept.select(*[F.col("row").getField(c).alias(c) for c in docs.columns])
