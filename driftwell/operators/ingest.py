"""Joining transactions with their optional identity rows, and chronological parts."""

from __future__ import annotations

from math import floor

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwell.operators import validate
from driftwell.operators.prefix import order_statistics

DAY = 86_400


def join_identity(transactions: DataFrame, identity: DataFrame, key: str = "TransactionID", check: bool = True) -> DataFrame:
    """Every transaction with its identity row where there is one; has_identity tells a row from an empty row."""
    if check:
        validate.separate_columns(transactions, identity, key, ("has_identity",))
        validate.unique_key(transactions, key)
        validate.unique_key(identity, key)
        validate.no_orphans(transactions, identity, key)
    marked = identity.withColumn("has_identity", F.lit(True))
    return transactions.join(marked, key, "left").withColumn("has_identity", F.coalesce("has_identity", F.lit(False)))


def audit(joined: DataFrame) -> DataFrame:
    """One row: rows, rows with identity, their share, positive labels, zero amounts."""
    return joined.agg(
        F.count("*").alias("joined_rows"), F.sum(F.col("has_identity").cast("long")).alias("identity_rows"), F.avg(F.col("has_identity").cast("double")).alias("identity_coverage"),
        F.sum("isFraud").cast("long").alias("positive_rows"), F.avg(F.col("isFraud").cast("double")).alias("positive_rate"), F.sum((F.col("TransactionAmt") == 0).cast("long")).alias("zero_amount_rows"),
    )


def boundaries(df: DataFrame, shares: list[float], time: str = "TransactionDT", cuts: list | None = None) -> list:
    """Times at the given shares of the rows in order of time; ``cuts`` of the times, where they are known."""
    return order_statistics(df, time, lambda n: [floor(n * s) for s in shares], cuts=cuts)


def chronological_split(df: DataFrame, train: float = 0.6, validation: float = 0.2, time: str = "TransactionDT", check: bool = True) -> DataFrame:
    """Adds split: train, validation or test, compared by time so that equal times stay together."""
    first, second = boundaries(df, [train, train + validation], time)
    t = F.col(time)
    out = df.withColumn("split", F.when(t < first, "train").when(t < second, "validation").otherwise("test"))
    if check and out.select("split").distinct().count() != 3:
        raise ValueError("the split needs three parts with rows")
    return out


def halves(validation: DataFrame, share: float = 0.5, time: str = "TransactionDT", check: bool = True) -> DataFrame:
    """Adds calibration: true before the boundary time, whose whole group belongs to the audit."""
    (cut,) = boundaries(validation, [share], time)
    out = validation.withColumn("calibration", F.col(time) < cut)
    if check and out.select("calibration").distinct().count() != 2:
        raise ValueError("both halves need rows")
    return out


def folds(df: DataFrame, count: int = 3, delay_days: float = 0.0, time: str = "TransactionDT") -> DataFrame:
    """(fold, part, row columns): equal-duration windows of the validation time; a fold trains before its start less the delay."""
    from numpy import inf, linspace, nextafter

    lo, hi = df.where("split = 'validation'").agg(F.min(time), F.max(time)).first()
    if lo is None:
        raise ValueError("no validation rows")
    edges = [float(x) for x in linspace(lo, nextafter(hi, inf), count + 1)]
    cases = F.array(*[F.struct(F.lit(i + 1).alias("fold"), F.lit(a).alias("start"), F.lit(b).alias("stop")) for i, (a, b) in enumerate(zip(edges[:-1], edges[1:], strict=True))])
    each = df.where("split in ('train', 'validation')").withColumn("_f", F.explode(cases))
    t = F.col(time)
    part = F.when((t >= F.col("_f.start")) & (t < F.col("_f.stop")), "audit").when(t < F.col("_f.start") - delay_days * DAY, "train")
    return each.withColumn("fold", F.col("_f.fold")).withColumn("part", part).drop("_f").where("part is not null")


def blocks(df: DataFrame, hours: float, time: str = "TransactionDT") -> DataFrame:
    """Adds block: the number of whole spans of ``hours`` since the first row."""
    (first,) = df.agg(F.min(time)).first()
    return df.withColumn("block", F.floor((F.col(time) - F.lit(first)) / (hours * 3600)).cast("long"))
