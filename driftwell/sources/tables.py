"""Sources and sinks: canonical transaction views, CSV, Parquet and JSON readers and writers, integrity scans."""

from __future__ import annotations

import hashlib
import json
import math
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

TRANSACTION = T.StructType(
    [
        T.StructField("TransactionID", T.LongType()),
        T.StructField("TransactionDT", T.DoubleType()),
        T.StructField("TransactionAmt", T.DoubleType()),
        *[T.StructField(c, T.DoubleType()) for c in ("card1", "card2", "card3", "card5", "addr1")],
        *[T.StructField(c, T.StringType()) for c in ("card4", "ProductCD", "P_emaildomain", "R_emaildomain", "DeviceInfo")],
        T.StructField("has_identity", T.BooleanType()),
    ]
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _seconds(ts) -> F.Column:
    """Seconds since 2024-01-01 of a wall-clock time; the session's time zone cancels out."""
    return F.unix_seconds(ts.cast("timestamp")) - F.unix_seconds(F.to_timestamp(F.lit("2024-01-01 00:00:00")))


def transactions(spark: SparkSession, sf_dir: str, tick: int = 60) -> DataFrame:
    """The ``events`` table as transactions; times are floored to ``tick`` seconds, which makes ties.

    Derived columns are fixed functions of the event, so that any engine can derive the same ones.
    """
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", "value", "props")
    e = e.withColumn("k", F.get_json_object("props", "$.k").cast("int"))
    time = F.floor(_seconds(F.col("ts")) / tick) * tick
    part = lambda n: (F.col("user_id") % n).cast("double")
    tag = lambda prefix, value: F.concat(F.lit(prefix), value.cast("string"))
    return e.select(
        F.col("event_id").alias("TransactionID"), time.cast("double").alias("TransactionDT"), F.col("value").alias("TransactionAmt"),
        F.col("user_id").cast("double").alias("card1"), part(7).alias("card2"), part(3).alias("card3"), part(5).alias("card5"),
        F.when(F.col("event_id") % 13 != 0, part(11)).alias("addr1"), tag("brand", F.col("user_id") % 4).alias("card4"), F.col("event_type").alias("ProductCD"),
        F.when(F.col("k") % 17 != 0, tag("d", F.col("k") % 10)).alias("P_emaildomain"), F.when(F.col("k") % 19 != 0, tag("d", F.floor(F.col("k") / 10))).alias("R_emaildomain"),
        F.when(F.col("k") % 5 != 0, tag("dev", F.col("k") % 23)).alias("DeviceInfo"), (F.col("event_id") % 29 == 0).cast("int").alias("isFraud"),
    )


def identities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The optional side of the transaction join: one row for some transactions."""
    e = table(spark, sf_dir, "events").where("event_id % 4 = 0")
    return e.select(F.col("event_id").alias("TransactionID"), F.get_json_object("props", "$.k").cast("int").alias("id_score"))


def order_transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as transactions of customers by day: many ties in time."""
    o = table(spark, sf_dir, "orders")
    days = F.date_diff(F.col("o_orderdate").cast("date"), F.lit("1995-01-01").cast("date"))
    return o.select(F.col("o_orderkey").alias("TransactionID"), (days * 86400).cast("double").alias("TransactionDT"), F.col("o_totalprice").alias("TransactionAmt"), F.col("o_custkey").alias("entity"), F.col("o_orderpriority").alias("ProductCD"), F.col("o_orderstatus").alias("card4"))


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """A CSV with a header that names every column of the schema, rows of another width refused."""
    wanted = [f.name for f in T.StructType.fromDDL(schema)] if isinstance(schema, str) else schema.fieldNames()
    header = spark.read.option("header", True).option("inferSchema", False).csv(path).columns
    if len(set(header)) != len(header):
        raise ValueError(f"repeated columns in {path}")
    if header != wanted:
        raise ValueError(f"columns of {path} are {header}, not {wanted}")
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def write_split(df: DataFrame, path: str) -> None:
    """A Parquet table with a folder for each split, so that later reads of a split skip the rest."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def plain(value):
    """Numbers, texts and containers with NaN and infinities as null."""
    if isinstance(value, float):
        return value if math.isfinite(value) else None
    if isinstance(value, dict):
        return {str(k): plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, list | tuple) else value


def write_json(path: str | Path, value) -> None:
    Path(path).write_text(json.dumps(value, allow_nan=False, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")


def _once(pairs):
    names = [k for k, _ in pairs]
    if len(set(names)) != len(names):
        raise ValueError(f"repeated JSON keys: {sorted({n for n in names if names.count(n) > 1})}")
    return dict(pairs)


def read_json(text: str):
    """JSON in which no object repeats a key."""
    return json.loads(text, object_pairs_hook=_once)


def digest(value) -> str:
    """SHA-256 of a value's canonical JSON."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, separators=(",", ":"), allow_nan=False, ensure_ascii=False).encode()).hexdigest()


def integrity(spark: SparkSession, path: str, key: str, label: str | None = None) -> dict:
    """What a CSV delivery holds: bytes digest, columns, rows, rows of a wrong width, repeated or missing keys, bad labels.

    Quoted values may have line ends.  The file digest is that of the sorted digests of its parts, so that it is taken where
    the bytes are; a part is 2 GB at most.
    """
    header = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).csv(path).columns
    width = len(header)
    # The reader itself says which rows have another width.
    named = T.StructType([*[T.StructField(c, T.StringType()) for c in header], T.StructField("_wrong", T.StringType())])
    raw = spark.read.schema(named).option("header", True).option("multiLine", True).option("escape", '"').option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_wrong").csv(path)
    keys = raw.agg(F.count("*").alias("rows"), F.sum(F.col("_wrong").isNotNull().cast("int")).alias("wrong"), F.sum(F.col(key).isNull().cast("int")).alias("missing"), F.count_distinct(key).alias("distinct")).first()
    parts = spark.read.format("binaryFile").load(path).select(F.sha2("content", 256).alias("d")).orderBy("d").collect()
    out = {"columns": width, "unique_header": len(set(header)) == width, "rows": keys["rows"], "wrong_width": keys["wrong"] or 0, "missing_keys": keys["missing"] or 0, "unique_keys": keys["distinct"] == keys["rows"] - (keys["missing"] or 0), "sha256": hashlib.sha256("".join(p["d"] for p in parts).encode()).hexdigest()}
    if label:
        out["bad_labels"] = raw.where(~F.coalesce(F.col(label).isin("0", "1"), F.lit(False))).count()
    return out


def point(df: DataFrame, key: str, value: int) -> dict:
    """The one row with a key; KeyError where there is none."""
    found = df.where(F.col(key) == value).limit(2).collect()
    if not found:
        raise KeyError(value)
    if len(found) > 1:
        raise ValueError(f"{key} {value} is not unique")
    return plain(found[0].asDict(recursive=True))
