"""Running sums, order statistics, quantiles and ranks over a whole table without a one-task window.

The ordering column is cut into ranges at approximate quantiles, more of them the more rows there are.  Ranges are summed,
the sums added up range by range (one row a range), and only inside a range are rows sorted.  Nulls are in no order and are
left out.
"""

from __future__ import annotations

from collections.abc import Callable
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.sources.shared import keep

#: Rows that a range should have, about, and the fewest and most ranges: a range of more rows is sorted with spills.
RANGE_ROWS, LEAST_RANGES, MOST_RANGES = 100_000, 8, 4096
#: Wide rows that a task of a join or of windows should have, about.
TASK_ROWS = 50_000
#: Cuts that are looked through at once.
_STEP = 64


def dealt(df: DataFrame, rows: int, *keys: str, task: int | None = None) -> DataFrame:
    """``df`` by ``keys``, in as many tasks as its ``rows`` ask for, whatever number of partitions is set and AQE would put together."""
    return df.repartition(max(1, ceil(rows / (task or TASK_ROWS))), *keys)


def cuts_of(df: DataFrame, order: str, ranges: int | None = None) -> list:
    """Values at approximate quantiles, ascending and different: ``ranges`` - 1 at most, as many as the rows ask for by default."""

    def at(parts: int) -> Column:
        return F.expr(f"percentile_approx(`{order}`, array({', '.join(f'{i / parts}D' for i in range(1, parts))}), {max(1000, 4 * parts)})")

    first = ranges or LEAST_RANGES
    n, found = df.agg(F.count(order), at(first)).first()
    wanted = min(MOST_RANGES, n // RANGE_ROWS)
    if not ranges and wanted > first:
        found = df.agg(at(wanted)).first()[0]
    return sorted(set(found or []))


def range_of(order: str, cuts: list) -> Column:
    """The number of the range that a row's ``order`` falls in; null where it is null."""
    x = F.col(order)
    table = F.array(*[F.lit(c) for c in cuts])
    below = lambda part: F.size(F.filter(part, lambda c: c <= x))
    if not cuts:
        found = F.lit(0)
    elif len(cuts) <= _STEP:
        found = below(table)
    else:
        # First among every 64th cut, then among the 64 from there.
        coarse = F.array(below(F.array(*[F.lit(c) for c in cuts[::_STEP]])))
        found = F.transform(coarse, lambda k: F.when(k == 0, F.lit(0)).otherwise((k - 1) * _STEP + below(F.slice(table, (k - 1) * _STEP + 1, _STEP))))[0]
    return F.when(x.isNotNull(), found)


def sums_before(df: DataFrame, order: str, sums: list[str], by: tuple[str, ...] = (), cuts: list | None = None) -> DataFrame:
    """``df``, one row for each (by, order), with ``<sum>_before``: the sum over the rows of its group with less ``order``.

    Rows without ``order`` are left out.
    """
    cuts = cuts_of(df, order) if cuts is None else cuts
    # As many tasks as ranges: left to itself AQE puts many ranges in one task, which sorts all of them in memory.
    spread = df.where(F.col(order).isNotNull()).withColumn("_range", range_of(order, cuts)).repartition(len(cuts) + 1, *by, "_range")
    whole = spread.groupBy(*by, "_range").agg(*[F.sum(s).alias(f"_{s}") for s in sums])
    above = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)
    carried = whole.select(*by, "_range", *[F.coalesce(F.sum(f"_{s}").over(above), F.lit(0)).alias(f"_{s}_carried") for s in sums])
    inside = W.partitionBy(*by, "_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)
    placed = spread.select("*", *[F.coalesce(F.sum(s).over(inside), F.lit(0)).alias(f"_{s}_inside") for s in sums])
    joined = placed.join(carried, [*by, "_range"])
    return joined.select(*df.columns, *[(F.col(f"_{s}_inside") + F.col(f"_{s}_carried")).alias(f"{s}_before") for s in sums])


def order_statistics(df: DataFrame, order: str, positions: list[int] | Callable[[int], list[int]], ranges: int | None = None, cuts: list | None = None) -> list:
    """Values at the given 0-based positions of the ascending order (nulls left out), exactly; None beyond its ends.

    Ranges are counted first, and only those that hold a position are sorted.  ``positions`` may depend on the number of values.
    """
    spread = df.where(F.col(order).isNotNull()).select(order).withColumn("_range", range_of(order, cuts_of(df, order, ranges) if cuts is None else cuts))
    counts = sorted((r["_range"], r["count"]) for r in spread.groupBy("_range").count().collect())
    positions = positions(sum(n for _, n in counts)) if callable(positions) else positions
    wanted, seen = {}, 0
    for number, n in counts:
        own = [p for p in positions if seen <= p < seen + n]
        if own:
            wanted[number] = (seen, own)
        seen += n
    if not wanted:
        return [None] * len(positions)
    rows = spread.where(F.col("_range").isin(list(wanted))).groupBy("_range", order).agg(F.count("*").alias("n"))
    rows = rows.withColumn("before", F.coalesce(F.sum("n").over(W.partitionBy("_range").orderBy(order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0)))
    cells = F.array(*[F.struct(F.lit(number).alias("range"), F.lit(p - start).cast("long").alias("inside"), F.lit(p).cast("long").alias("position")) for number, (start, own) in wanted.items() for p in own])
    hits = rows.select(order, F.filter(cells, lambda c: (c["range"] == F.col("_range")) & (c["inside"] >= F.col("before")) & (c["inside"] < F.col("before") + F.col("n"))).alias("at")).where(F.size("at") > 0).collect()
    values = {c["position"]: row[order] for row in hits for c in row["at"]}
    return [values.get(p) for p in positions]


def quantiles(df: DataFrame, value: str, shares: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by, n, q): the number of values of each group and their linearly interpolated quantiles, exactly.

    Groups may be of any size: what a task holds is a range.  One row without ``by``, with null quantiles where there is no
    value; groups without a value have no row.
    """
    rows = df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    placed = sums_before(rows, value, ["_n"], by, cuts_of(df, value))
    total = rows.groupBy(*by).agg(F.sum("_n").alias("n"))
    placed = placed.join(total, list(by)) if by else placed.crossJoin(F.broadcast(total))

    def at(position: Column) -> Column:
        return F.max(F.when((F.col("_n_before") <= position) & (position < F.col("_n_before") + F.col("_n")), F.col(value).cast("double")))

    ends = []
    for i, share in enumerate(shares):
        place = (F.col("n") - 1) * F.lit(share)
        ends += [at(F.floor(place)).alias(f"_lo{i}"), at(F.ceil(place)).alias(f"_hi{i}"), F.max(place - F.floor(place)).alias(f"_part{i}")]
    found = placed.groupBy(*by).agg(F.coalesce(F.max("n"), F.lit(0)).alias("n"), *ends)
    return found.select(*by, "n", F.array(*[F.col(f"_lo{i}") + (F.col(f"_hi{i}") - F.col(f"_lo{i}")) * F.col(f"_part{i}") for i in range(len(shares))]).alias("q"))


def higher_quantile(df: DataFrame, order: str, q: float):
    """The smallest value at or above the linear quantile's position."""
    n = df.where(F.col(order).isNotNull()).count()
    return order_statistics(df, order, [ceil((n - 1) * q)])[0] if n else None


def cells_of(df: DataFrame, columns: list[str], *keep: str) -> DataFrame:
    """(keep, name, x): the values there are in ``columns``, one row each."""
    each = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("x")) for c in columns])
    return df.select(*keep, F.explode(F.filter(each, lambda c: c["x"].isNotNull())).alias("_c")).select(*keep, "_c.name", "_c.x")


def strict_ranks(reference: DataFrame, df: DataFrame, columns: dict[str, str], key: str = "TransactionID", among: dict[str, str] | None = None) -> DataFrame:
    """``df`` with a rank for each of ``columns`` (column to rank): the share of the reference's values below the row's.

    A column is ranked among the reference's of its name, or of that which ``among`` has for it.  ``key`` is unique in ``df``.  Missing values have no rank, nor has a column without reference values.  All columns are
    ranked in one pass: only keys and values travel, different values are placed once, and the rows get theirs by one join.
    """
    known = cells_of(reference, list(dict.fromkeys((among or {}).get(c, c) for c in columns)))
    return ranks_among(known.groupBy("name", "x").agg(F.count("*").alias("n")), df, columns, key, cuts_of(known.unionByName(cells_of(df, list(columns))), "x"), among)


def ranks_among(known: DataFrame, df: DataFrame, columns: dict[str, str], key: str = "TransactionID", cuts: list | None = None, among: dict[str, str] | None = None) -> DataFrame:
    """``strict_ranks`` where the reference is its different values (name, x, n).  ``cuts`` are of both sides: either may be the larger."""
    cells, own, among = cells_of(df, list(columns), key), "name", {c: c for c in columns} | (among or {})
    if any(c != name for c, name in among.items()):
        own, names = "_column", F.create_map(*[F.lit(x) for pair in among.items() for x in pair])
        cells = cells.select(key, F.col("name").alias(own), names[F.col("name")].alias("name"), "x")
    cuts = cuts_of(known.select("x").unionByName(cells.select("x")), "x") if cuts is None else cuts
    rows, no, one = df.count(), F.lit(0).cast("long"), F.lit(1).cast("long")
    both = known.select("name", "x", F.col("n").cast("long").alias("n"), no.alias("m")).unionByName(cells.select("name", "x", no.alias("n"), one.alias("m")))
    both = keep(both.groupBy("name", "x").agg(F.sum("n").alias("n"), F.sum("m").alias("m")), "values")
    facts = both.groupBy("name").agg(F.sum("n").alias("n"), F.max("m").alias("m")).collect()  # one row a column
    totals = {r["name"]: r["n"] for r in facts if r["n"]}
    # A value that very many rows have is met in parts; there are fewer such values than rows of a range would fill ranges.
    share = F.greatest(F.ceil(F.col("m") / RANGE_ROWS), F.lit(1)).cast("long")
    if any(r["m"] > RANGE_ROWS for r in facts):
        cells = cells.join(F.broadcast(both.where(F.col("m") > RANGE_ROWS).select("name", "x", share.alias("_parts"))), ["name", "x"], "left")
        cells = cells.withColumn("_part", F.pmod(F.xxhash64(key), F.coalesce("_parts", F.lit(1)))).drop("_parts")
    else:
        cells = cells.withColumn("_part", no)
    placed = sums_before(both, "x", ["n"], ("name",), cuts).select("name", "x", "n_before", F.explode(F.sequence(no, share - 1)).alias("_part"))
    of = lambda c: F.max(F.when(F.col(own) == c, F.col("n_before") / F.lit(float(totals[among[c]]))))
    some = [(of(c) if among[c] in totals else F.lit(None).cast("double")).alias(name) for c, name in columns.items()]
    # They meet by the values' hashes, for Spark deals floating-point keys out anew, in as many tasks as are set; then by the values.
    by = ["name", "_hash", "_part"]
    placed = placed.select("name", "_part", F.xxhash64("x").alias("_hash"), F.col("x").alias("_x"), "n_before")
    cells, placed = (dealt(side, rows * len(columns), *by, task=RANGE_ROWS) for side in (cells.withColumn("_hash", F.xxhash64("x")), placed))
    # Several rows for each of ``df``, which Spark takes for no larger than it: merged, lest the cells be broadcast.
    met = cells.hint("merge").join(placed, by).where(F.col("x").between(F.col("_x"), F.col("_x")))
    ranks = dealt(met.select(key, own, "n_before"), rows, key).groupBy(key).agg(*some)
    return dealt(df.drop(*columns.values()), rows, key).join(ranks, key, "left")


def strict_rank(reference: DataFrame, df: DataFrame, column: str, name: str, key: str = "TransactionID") -> DataFrame:
    """``strict_ranks`` of one column."""
    return strict_ranks(reference, df, {column: name}, key)
