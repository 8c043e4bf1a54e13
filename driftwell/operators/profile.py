"""Profiles of columns, categories, combinations and entities."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.functions.columns import ratio
from driftwell.operators.prefix import cuts_of, quantiles, sums_before
from driftwell.sources.shared import keep

#: Column names with a role of their own.
ROLES = {"TransactionID": "identifier", "isFraud": "target", "TransactionDT": "elapsed_time"}
CATEGORY_NAMES = ("ProductCD", "P_emaildomain", "R_emaildomain", "DeviceType", "DeviceInfo", "addr1", "addr2")


def roles(df: DataFrame, sample: int = 200) -> dict[str, str]:
    """identifier, target, elapsed_time, categorical, datetime or numeric: by name first, then by type and a small sample."""
    import re

    out = {}
    for name, kind in df.dtypes:
        if name in ROLES:
            out[name] = ROLES[name]
        elif name in CATEGORY_NAMES or re.fullmatch(r"card\d|M\d|id_(1[2-9]|2\d|3[0-8])", name):
            out[name] = "categorical"
        elif kind in ("timestamp", "timestamp_ntz", "date"):
            out[name] = "datetime"
        elif kind in ("string", "boolean"):
            out[name] = "string" if kind == "string" else "categorical"
        else:
            out[name] = "numeric"
    texts = [n for n, r in out.items() if r == "string"]
    for n in texts:
        seen = df.where(F.col(n).isNotNull()).select(F.col(n).alias("v"), F.try_to_timestamp(F.col(n)).isNotNull().alias("ok")).limit(sample)
        shape = seen.agg(F.count("*").alias("n"), F.min((F.col("ok") & F.col("v").rlike(r"^\d{4}-\d{2}-\d{2}([ T]\d{2}:\d{2}.*)?$")).cast("int")).alias("all")).first()
        out[n] = "datetime" if shape["n"] and shape["all"] else "categorical"
    return out


def column_profile(df: DataFrame) -> DataFrame:
    """One row a column: rows, nulls, distinct values and their shares, whether constant or of high cardinality."""
    names = df.columns
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in names])).alias("x")).select("x.column", "x.value")
    by = cells.groupBy("column", "value").agg(F.count("*").alias("n")).groupBy("column").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("nulls"), F.count("value").alias("distinct_values"))
    there = F.col("rows") - F.col("nulls")
    unique = ratio(F.col("distinct_values"), there)
    high = (F.col("distinct_values") >= 100) | ((F.col("distinct_values") >= 20) & F.coalesce(unique >= 0.05, F.lit(False)))
    return by.withColumns({"null_ratio": ratio(F.col("nulls"), F.col("rows")), "unique_ratio": unique, "constant": F.col("distinct_values") <= 1, "high_cardinality": high})


def numeric_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row a column, over finite values: extremes, quantiles, mean, population deviation, IQR outliers."""
    cells = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns])).alias("x")).select("x.column", "x.value")
    infinite = F.isnan("value") | F.col("value").isin(float("inf"), float("-inf"))
    cells = cells.withColumn("infinite", F.coalesce(infinite, F.lit(False))).withColumn("finite", F.when(~F.col("infinite"), F.col("value")))
    q = quantiles(cells, "finite", [0.01, 0.25, 0.5, 0.75, 0.99], ("column",)).select("column", "q")
    by = cells.groupBy("column").agg(F.count("finite").alias("finite_count"), F.sum(F.col("infinite").cast("long")).alias("infinite_count"), F.min("finite").alias("min"), F.max("finite").alias("max"), F.avg("finite").alias("mean"), F.stddev_pop("finite").alias("std"))
    by = by.join(q, "column", "left")
    by = by.withColumns({"p01": F.col("q")[0], "p25": F.col("q")[1], "median": F.col("q")[2], "p75": F.col("q")[3], "p99": F.col("q")[4]}).drop("q").withColumn("iqr", F.col("p75") - F.col("p25")).withColumn("zero_iqr", F.col("iqr") == 0)
    edges = cells.join(by.select("column", "p25", "p75", "iqr"), "column")
    out = (F.col("finite") < F.col("p25") - 1.5 * F.col("iqr")) | (F.col("finite") > F.col("p75") + 1.5 * F.col("iqr"))
    return by.join(edges.groupBy("column").agg(F.avg(out.cast("double")).alias("outlier_ratio")), "column", "left")


def category_frequency(df: DataFrame, column: str, top: int = 10) -> DataFrame:
    """The ``top`` values (count, then value), one row for all others and one for missing ones, with their place."""
    by = df.groupBy(F.col(column).cast("string").alias("value")).agg(F.count("*").alias("n"))
    best = by.where("value is not null").orderBy(F.col("n").desc(), "value").limit(top)
    place = F.row_number().over(W.orderBy(F.col("n").desc(), "value"))  # over ``top`` rows
    best = best.withColumn("place", place.cast("long"))
    totals = by.agg(F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("there"), F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("gone"))
    taken = best.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("taken"))
    rest = totals.crossJoin(taken).select(F.explode(F.array(F.struct(F.lit("(other)").alias("value"), (F.col("there") - F.col("taken")).alias("n"), F.lit(top + 1).cast("long").alias("place")), F.struct(F.lit("(missing)").alias("value"), F.col("gone").alias("n"), F.lit(top + 2).cast("long").alias("place")))).alias("x")).select("x.*")
    return best.select("value", "n", "place").unionByName(rest)


def rare_combinations(df: DataFrame, a: str, b: str, at_most: int = 5) -> DataFrame:
    """One row: complete rows, rows left out, distinct pairs, and the pairs and rows of at most ``at_most`` occurrences."""
    by = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n"))
    rare = F.col("n") <= at_most
    out = by.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("pairs"), F.coalesce(F.sum(rare.cast("long")), F.lit(0)).alias("rare_pairs"), F.coalesce(F.sum(F.when(rare, F.col("n"))), F.lit(0)).alias("rare_rows"))
    gone = df.agg(F.coalesce(F.sum((F.col(a).isNull() | F.col(b).isNull()).cast("long")), F.lit(0)).alias("excluded_rows"))
    return out.crossJoin(gone)


def rare_examples(df: DataFrame, a: str, b: str, at_most: int = 5, examples: int = 15) -> DataFrame:
    by = df.where(F.col(a).isNotNull() & F.col(b).isNotNull()).groupBy(a, b).agg(F.count("*").alias("n")).where(F.col("n") <= at_most)
    return by.orderBy("n", a, b).limit(examples)


def _presence(df: DataFrame, columns: list[str]) -> dict[str, int]:
    """For each column a number that columns which are missing in the same rows (by _id) share; -1 for one that is never missing."""
    mark = F.xxhash64("_id").cast("decimal(38,0)")
    row = df.agg(F.count("*").alias("_n"), *[F.struct(F.count(c).alias("n"), F.sum(F.when(F.col(c).isNotNull(), mark)).alias("marks")).alias(c) for c in columns]).first()
    seen: dict[tuple, int] = {}
    return {c: -1 if row[c]["n"] == row["_n"] else seen.setdefault((row[c]["n"], row[c]["marks"]), len(seen)) for c in columns}


def _moments(pairs: list[tuple[int, int]], width: int):
    """Each task's sums of squares and products of centred ranks, a row for each pair of rank columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pairs), 4))
        for batch in batches:
            lists = batch.column(0)
            cells = lists.flatten()
            ranks = np.full((len(lists), width), np.nan)
            row = np.repeat(np.arange(len(lists)), lists.value_lengths().to_numpy(zero_copy_only=False))
            ranks[row, cells.field("k").to_numpy(zero_copy_only=False)] = cells.field("r").to_numpy(zero_copy_only=False)
            there = ~np.isnan(ranks)
            ranks = np.where(there, ranks, 0.0)
            for p, (i, j) in enumerate(pairs):
                both = there[:, i] & there[:, j]
                x, y = ranks[both, i], ranks[both, j]
                total[p] += both.sum(), x @ y, x @ x, y @ y
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(pairs)), pa.int32()), *[pa.array(total[:, k]) for k in range(4)]], ["pair", "n", "xy", "xx", "yy"])

    return run


def spearman(df: DataFrame, pairs: list[tuple[str, str]], least: int = 100) -> DataFrame:
    """(first, second, n, rho) of each pair over the rows that have both; null below ``least`` rows or without spread.

    All columns go in one pass, however many pairs there are.  A column is ranked among the rows that have it, and again for each
    set of rows that some of its partners are missing in; columns that are missing together share one.  Ranks are those of
    different values, joined back, so that a value of very many rows is one row until then; centred on their exact mean they
    are put together by row, and each task sums up its own squares and products.
    """
    columns = list(dict.fromkeys(c for pair in pairs for c in pair))
    table = keep(df.select(*[F.col(c).cast("double").alias(c) for c in columns]).withColumn("_id", F.monotonically_increasing_id()), "spearman")
    group = _presence(table, columns)
    holder = {g: c for c, g in group.items()}
    cells: dict[tuple[str, int], int] = {}

    def cell(column: str, partner: str) -> int:
        """The number of a column's ranks among the rows that have the partner."""
        g = group[partner] if group[partner] not in (-1, group[column]) else -1
        return cells.setdefault((column, g), len(cells))

    wanted = [(cell(a, b), cell(b, a)) for a, b in pairs]
    each = [F.struct(F.lit(k).alias("k"), (F.col(c) if g < 0 else F.when(F.col(holder[g]).isNotNull(), F.col(c))).alias("x")) for (c, g), k in cells.items()]
    long = table.select("_id", F.explode(F.filter(F.array(*each), lambda v: v["x"].isNotNull())).alias("v")).select("_id", "v.k", "v.x")
    long = keep(long, "spearman-cells")
    values = long.groupBy("k", "x").agg(F.count("*").alias("n"))
    placed = sums_before(values, "x", ["n"], ("k",), cuts_of(long, "x")).join(values.groupBy("k").agg(F.sum("n").alias("all")), "k")
    ranks = keep(placed.select("k", "x", (F.col("n_before") + (F.col("n") - F.col("all")) / 2).alias("r")), "spearman-ranks")
    rows = long.join(ranks, ["k", "x"]).groupBy("_id").agg(F.collect_list(F.struct("k", "r")).alias("cells")).select("cells")
    sums = rows.mapInArrow(_moments(wanted, len(cells)), "pair int, n double, xy double, xx double, yy double").groupBy("pair").agg(*[F.sum(c).alias(c) for c in ("n", "xy", "xx", "yy")])
    named = df.sparkSession.createDataFrame([(i, a, b) for i, (a, b) in enumerate(pairs)], "pair int, first string, second string")
    known = (F.col("n") >= least) & (F.col("xx") > 0) & (F.col("yy") > 0)
    return named.join(sums, "pair", "left").select("first", "second", F.coalesce("n", F.lit(0.0)).cast("long").alias("n"), F.when(known, F.col("xy") / F.sqrt(F.col("xx") * F.col("yy"))).alias("rho"))


def spearman_top(df: DataFrame, columns: list[str], least: int = 100, most: int = 30, nulls: float = 0.95) -> DataFrame:
    """The ``most`` pairs of ``columns`` of the largest |rho|, as ``spearman`` has them.

    Columns without spread, and those of which ``nulls`` of the rows or more are missing, are in no pair.
    """
    facts = df.agg(F.count("*").alias("n"), *[F.count(c).alias(f"n_{c}") for c in columns], *[(F.min(c) < F.max(c)).alias(f"v_{c}") for c in columns]).first()
    used = [c for c in columns if facts[f"v_{c}"] and facts["n"] - facts[f"n_{c}"] < nulls * facts["n"]]
    found = spearman(df, list(combinations(used, 2)), least) if len(used) > 1 else spearman(df.limit(0), [(columns[0], columns[0])])
    return found.where("rho is not null").orderBy(F.abs("rho").desc(), "first", "second").limit(most)


def entity_profile(df: DataFrame, key: list[str]) -> DataFrame:
    """One row an entity whose key is complete: transactions, amounts, first and last time, distinct products and domains, active days."""
    have = F.lit(True)
    for k in key:
        have = have & F.col(k).isNotNull()
    return df.where(have).groupBy(*key).agg(
        F.count("*").alias("transactions"), F.avg("TransactionAmt").alias("mean_amount"), F.stddev_samp("TransactionAmt").alias("std_amount"), F.min("TransactionDT").alias("first_time"), F.max("TransactionDT").alias("last_time"),
        F.count_distinct("ProductCD").alias("products"), F.count_distinct("P_emaildomain").alias("email_domains"), F.count_distinct(F.floor(F.col("TransactionDT") / 86400)).alias("active_days"),
    )


def entity_gaps(df: DataFrame, key: list[str]) -> DataFrame:
    """Seconds between consecutive transactions of an entity, by time and then id."""
    have = F.lit(True)
    for k in key:
        have = have & F.col(k).isNotNull()
    gap = F.col("TransactionDT") - F.lag("TransactionDT").over(W.partitionBy(*key).orderBy("TransactionDT", "TransactionID"))
    return df.where(have).select("TransactionID", gap.alias("gap")).where("gap is not null")


def entity_summary(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: eligible and excluded rows, entities, singletons, quantiles of their sizes, median gap and zero gaps."""
    by = entity_profile(df, key)
    sizes = by.agg(F.coalesce(F.sum("transactions"), F.lit(0)).alias("eligible_rows"), F.count("*").alias("entities"), F.coalesce(F.sum((F.col("transactions") == 1).cast("long")), F.lit(0)).alias("singletons"))
    sizes = sizes.crossJoin(quantiles(by, "transactions", [0.5, 0.9, 0.99]).select("q"))
    gaps = entity_gaps(df, key)
    median = quantiles(gaps, "gap", [0.5]).select(F.col("q")[0].alias("median_gap"))
    gaps = gaps.agg(F.coalesce(F.sum((F.col("gap") == 0).cast("long")), F.lit(0)).alias("zero_gaps")).crossJoin(median)
    total = df.agg(F.count("*").alias("rows"))
    return sizes.crossJoin(gaps).crossJoin(total).select("eligible_rows", (F.col("rows") - F.col("eligible_rows")).alias("excluded_rows"), "entities", "singletons", F.col("q")[0].alias("size_p50"), F.col("q")[1].alias("size_p90"), F.col("q")[2].alias("size_p99"), "median_gap", "zero_gaps")


def varying_columns(train: DataFrame, columns: list[str]) -> list[str]:
    """The columns that have two different values at least."""
    row = train.agg(*[(F.min(c) < F.max(c)).alias(c) for c in columns]).first()
    return [c for c in columns if row[c]]


def null_ratios(df: DataFrame, columns: list[str], by: str = "split") -> DataFrame:
    """(by, column, null_ratio)."""
    cells = df.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).isNull().cast("double").alias("gone")) for c in columns])).alias("x"))
    return cells.groupBy(by, F.col("x.column").alias("column")).agg(F.avg("x.gone").alias("null_ratio"))


def counted(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))
