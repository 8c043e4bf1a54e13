"""Causal history features: what was known strictly before a transaction's time.

Rows of equal time never see each other.  Per entity, an ordinal of distinct times makes that a plain RANGE frame; over
all rows, counts are taken per distinct (value, time) and added up range by range, so that no window spans the table.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.functions.columns import code, flag, ratio
from driftwell.operators.prefix import TASK_ROWS, cuts_of, dealt, range_of, sums_before
from driftwell.sources.shared import keep

#: The parts of the entity key, and the names and order of the features.
ENTITY_PARTS = ("card1", "card2", "card3", "card5", "addr1")
FEATURES = (
    "amount", "log_amount", "relative_day", "hour_phase", "hour_sin", "hour_cos", "hour", "day_of_week", "is_weekend", "is_business_hours", "calendar_available",
    "has_identity", "entity_known", "prior_transaction_count", "prior_mean_amount", "prior_std_amount", "amount_to_prior_mean", "amount_zscore", "prior_count_1h",
    "prior_count_24h", "seconds_since_previous", "history_span_days", "prior_distinct_products", "prior_distinct_email_domains", "prior_distinct_devices",
    "entity_product_is_new", "entity_email_is_new", "entity_device_is_new", "entity_hour_probability", "prior_global_count", "product_prior_frequency",
    "email_prior_frequency", "device_prior_frequency", "product_card_prior_frequency", "email_pair_prior_frequency", "product_card_prior_support",
    "email_pair_prior_support", "email_domains_match", "history_sufficient", "frequent_entity", "usual_amount",
)

DAY = 86_400
#: Rows up to which an entity is sorted in one task.
HOT_ROWS = 500_000
_RELATIONS = {"product": "_product", "email": "_email", "device": "_device"}
_PLURAL = {"product": "products", "email": "email_domains", "device": "devices"}


def with_keys(df: DataFrame) -> DataFrame:
    """Canonical codes of all categories, and _known: all parts of the entity key are there."""
    kinds = dict(df.dtypes)
    named = {f"_{p}": code(F.col(p), kinds[p]) for p in ENTITY_PARTS}
    named |= {"_product": code(F.col("ProductCD"), kinds["ProductCD"]), "_email": code(F.col("P_emaildomain"), kinds["P_emaildomain"]), "_recipient": code(F.col("R_emaildomain"), kinds["R_emaildomain"]), "_device": code(F.col("DeviceInfo"), kinds["DeviceInfo"]), "_card": code(F.col("card4"), kinds["card4"])}
    out = df.withColumns(named)
    known = F.lit(True)
    for p in ENTITY_PARTS:
        known = known & F.col(f"_{p}").isNotNull()
    return out.withColumn("_known", known).withColumn("_entity", F.when(F.col("_known"), F.struct(*[F.col(f"_{p}") for p in ENTITY_PARTS])))


def row_features(df: DataFrame, reference: str | None = None) -> DataFrame:
    """Features of the row alone.  ``reference`` is an ISO time with offset that elapsed second 0 stands for."""
    t, amount = F.col("TransactionDT").cast("double"), F.col("TransactionAmt").cast("double")
    phase = (F.floor(t / 3600) % 24).cast("long")
    out = df.withColumns(
        {"amount": amount, "log_amount": F.log1p(amount), "relative_day": F.floor(t / DAY).cast("long"), "hour_phase": phase, "hour_sin": F.sin(2 * F.pi() * (t % DAY) / DAY), "hour_cos": F.cos(2 * F.pi() * (t % DAY) / DAY)}
    )
    if reference is None:
        calendar: dict[str, Column] = {c: F.lit(None).cast("double") for c in ("hour", "day_of_week", "is_weekend", "is_business_hours")}
    else:
        start = datetime.fromisoformat(reference)
        if start.tzinfo is None:
            raise ValueError("the reference time needs an offset")
        local = t + (start.replace(tzinfo=None) - datetime(1970, 1, 1)).total_seconds()
        hour, day = F.floor(local / 3600) % 24, (F.floor(local / DAY) + 3) % 7
        calendar = {"hour": hour.cast("double"), "day_of_week": day.cast("double"), "is_weekend": flag(day >= 5), "is_business_hours": flag((day < 5) & (hour >= 9) & (hour < 17))}
    return out.withColumns(calendar).withColumns({"calendar_available": F.lit(0.0 if reference is None else 1.0), "has_identity": F.col("has_identity").cast("double"), "entity_known": F.col("_known").cast("double"), "email_domains_match": flag(F.col("_email") == F.col("_recipient"))})


def _by_windows(df: DataFrame, rows: int) -> DataFrame:
    """What was before each of the ``rows`` rows of its entity, by windows: an entity is in one task."""
    t = F.col("TransactionDT").cast("double")
    # Rows of unknown entities share no key: each gets its own, so that they don't pile up in one group.
    df = df.withColumn("_own", F.when(F.col("_known"), F.lit(None).cast("long")).otherwise(F.col("TransactionID")))
    key = ["_known", "_entity", "_own"]
    # Ten sorts hold a row at once: a task has a bounded number of rows, however many there are and whatever AQE would put together.
    df = dealt(df, rows, *key, task=TASK_ROWS)
    df = df.withColumn("_d", F.dense_rank().over(W.partitionBy(*key).orderBy(t)))
    prior = W.partitionBy(*key).orderBy("_d").rangeBetween(W.unboundedPreceding, -1)
    in_hour = W.partitionBy(*key, "hour_phase").orderBy("_d").rangeBetween(W.unboundedPreceding, -1)
    peers = F.count("*").over(W.partitionBy(*key, "_d"))
    back = lambda s: F.count("*").over(W.partitionBy(*key).orderBy(t).rangeBetween(-s, 0)) - peers
    first = {name: F.row_number().over(W.partitionBy(*key, c).orderBy(t, "TransactionID")) for name, c in _RELATIONS.items()}
    seen = {name: F.min(t).over(W.partitionBy(*key, c)) for name, c in _RELATIONS.items()}
    df = df.withColumns({"_n": F.count("*").over(prior), "_mean": F.avg("amount").over(prior), "_std": F.stddev_pop("amount").over(prior), "_first": F.min(t).over(prior), "_last": F.max(t).over(prior), "_1h": back(3600), "_24h": back(DAY), "_in_hour": F.count("*").over(in_hour)})
    df = df.withColumns({f"_new_{n}": F.when(F.col(c).isNotNull() & (first[n] == 1), 1).otherwise(0) for n, c in _RELATIONS.items()} | {f"_seen_{n}": seen[n] for n in _RELATIONS})
    df = df.withColumns({f"_distinct_{n}": F.coalesce(F.sum(f"_new_{n}").over(prior), F.lit(0)) for n in _RELATIONS})
    return df.drop("_own", "_d", *[f"_new_{n}" for n in _RELATIONS])


def _by_segments(df: DataFrame, hot: DataFrame, cuts: list) -> DataFrame:
    """The same for the rows of entities in ``hot`` (_entity, _center, _start), whose times are cut in segments.

    A segment's rows are summed up, the sums of an entity's segments added up in their order, and only inside a segment are its
    times sorted: many tasks share an entity, and what they hand on is one row a segment.  What was more than an hour or
    a day ago is asked for as a time of its own.
    """
    rows = keep(df.join(hot, "_entity").withColumn("_t", F.col("TransactionDT").cast("double")), "hot-rows")
    sums = ["n", "s1", "s2", *[f"d_{r}" for r in _RELATIONS]]
    at = lambda frame, **given: frame.select("_entity", "_t", *[given.get(c, F.lit(0)).cast("double" if c in ("s1", "s2") else "long").alias(c) for c in sums])
    off = F.col("amount") - F.col("_center")
    times = keep(rows.groupBy("_entity", "_t").agg(F.count("*").alias("n"), F.sum(off).alias("s1"), F.sum(off * off).alias("s2")), "hot-times")
    parts = [at(times, n=F.col("n"), s1=F.col("s1"), s2=F.col("s2")), *[at(times.select("_entity", (F.col("_t") - w).alias("_t"))) for w in (3600, DAY)]]
    seen = {}
    for name, c in _RELATIONS.items():
        seen[name] = keep(rows.where(F.col(c).isNotNull()).groupBy("_entity", c).agg(F.min("_t").alias(f"_seen_{name}")), f"hot-{name}")
        parts.append(at(seen[name].select("_entity", F.col(f"_seen_{name}").alias("_t")), **{f"d_{name}": F.lit(1)}))
    table = parts[0]
    for part in parts[1:]:
        table = table.unionByName(part)
    placed = keep(sums_before(table.groupBy("_entity", "_t").agg(*[F.sum(c).alias(c) for c in sums]), "_t", sums, ("_entity",), cuts), "hot-sums")
    hours = rows.groupBy("_entity", "hour_phase", "_t").agg(F.count("*").alias("n"))
    hours = sums_before(hours, "_t", ["n"], ("_entity", "hour_phase"), cuts).select("_entity", "_t", "hour_phase", F.col("n_before").alias("_in_hour"))

    # The time before: of its segment, or the last of an earlier segment.
    segment = times.select("_entity", "_t", range_of("_t", cuts).alias("_segment"))
    ends = segment.groupBy("_entity", "_segment").agg(F.max("_t").alias("_end"))
    ends = ends.select("_entity", "_segment", F.max("_end").over(W.partitionBy("_entity").orderBy("_segment").rowsBetween(W.unboundedPreceding, -1)).alias("_end"))
    last = segment.withColumn("_back", F.lag("_t").over(W.partitionBy("_entity", "_segment").orderBy("_t"))).join(ends, ["_entity", "_segment"]).select("_entity", "_t", F.coalesce("_back", "_end").alias("_last"))

    n, s1, s2 = F.col("n_before"), F.col("s1_before"), F.col("s2_before")
    spread = F.greatest(s2 / n - (s1 / n) * (s1 / n), F.lit(0.0))
    before = placed.select("_entity", "_t", n.alias("_n"), s1.alias("_s1"), F.when(n > 0, F.when(spread > 1e-13 * (s2 / n), F.sqrt(spread)).otherwise(0.0)).alias("_std"), *[F.col(f"d_{r}_before").alias(f"_distinct_{r}") for r in _RELATIONS])
    # Times that were asked for are matched as they were made: added up again they might miss by the last bit.
    asked = lambda w, name: placed.select("_entity", F.col("_t").alias(f"_at{w}"), F.col("n_before").alias(name))
    whole = times.select("_entity", "_t", (F.col("_t") - 3600).alias("_at3600"), (F.col("_t") - DAY).alias(f"_at{DAY}"))
    whole = whole.join(before, ["_entity", "_t"]).join(last, ["_entity", "_t"]).join(asked(3600, "_gone1"), ["_entity", "_at3600"]).join(asked(DAY, "_gone24"), ["_entity", f"_at{DAY}"])
    whole = keep(whole.select("_entity", "_t", "_n", "_s1", "_std", "_last", (F.col("_n") - F.col("_gone1")).alias("_1h"), (F.col("_n") - F.col("_gone24")).alias("_24h"), *[f"_distinct_{r}" for r in _RELATIONS]), "hot-history")
    out = rows.join(whole, ["_entity", "_t"]).join(keep(hours, "hot-hours"), ["_entity", "_t", "hour_phase"])
    for name, c in _RELATIONS.items():
        # A value that very many rows have meets one row; both sides are tables, so that Spark may split it.
        out = keep(out, f"hot-with-{name}").join(seen[name], ["_entity", c], "left")
    out = out.withColumns({"_mean": F.when(F.col("_n") > 0, F.col("_center") + F.col("_s1") / F.col("_n")), "_first": F.when(F.col("_n") > 0, F.col("_start"))})
    return out.select(*df.columns, *_BEFORE)


_BEFORE = ("_n", "_mean", "_std", "_first", "_last", "_1h", "_24h", "_in_hour", *[f"_seen_{n}" for n in _RELATIONS], *[f"_distinct_{n}" for n in _RELATIONS])


def entity_features(df: DataFrame, cuts: list | None = None, hot_rows: int = HOT_ROWS) -> DataFrame:
    """History of the entity.  Rows of unknown entities have none and are no one's history.

    The rows of an entity are windows of one exchange, but for entities of more than ``hot_rows`` rows: those are cut by time into
    segments that many tasks share.  The results are the same.  (Where all of a hot entity's earlier amounts are alike but for
    the last few bits, their deviation counts as none.)
    """
    known, t = F.col("_known"), F.col("TransactionDT").cast("double")
    counts = df.groupBy("_entity").agg(F.count("*").alias("_rows"), F.avg("amount").alias("_center"), F.min(t).alias("_start"))
    hot = counts.where(F.col("_entity").isNotNull() & (F.col("_rows") > hot_rows))
    rows, hot_ones = counts.agg(F.coalesce(F.sum("_rows"), F.lit(0)), F.coalesce(F.sum(F.when(F.col("_entity").isNotNull() & (F.col("_rows") > hot_rows), F.col("_rows"))), F.lit(0))).first()
    if hot_ones:
        hot = keep(hot.drop("_rows"), "hot-entities")
        cold = _by_windows(df.join(hot.select("_entity"), "_entity", "left_anti"), rows - hot_ones)
        df = cold.select(*df.columns, *_BEFORE).unionByName(_by_segments(df, hot, cuts_of(df, "TransactionDT") if cuts is None else cuts))
    else:
        df = _by_windows(df, rows)
    n, mean, std = F.col("_n"), F.col("_mean"), F.col("_std")
    if_known = lambda c: F.when(known, c)
    has = known & (n > 0)
    span = (t - F.col("_first")) / DAY
    relative = F.when(has & (mean > 0), F.col("amount") / mean)
    features: dict[str, Column] = {
        "prior_transaction_count": if_known(n).cast("long"), "prior_mean_amount": F.when(has, mean), "prior_std_amount": F.when(known & (n >= 2), std),
        "amount_to_prior_mean": relative, "amount_zscore": F.when(known & (n >= 5) & (std > 0), (F.col("amount") - mean) / std),
        "prior_count_1h": if_known(F.col("_1h")).cast("long"), "prior_count_24h": if_known(F.col("_24h")).cast("long"),
        "seconds_since_previous": F.when(has, t - F.col("_last")), "history_span_days": F.when(has, span),
        "entity_hour_probability": F.when(has, (F.col("_in_hour") + 1) / (n + 24)),
        "history_sufficient": (known & (n >= 5)).cast("double"), "frequent_entity": F.coalesce((known & (n >= 20) & (span >= 7)).cast("double"), F.lit(0.0)),
        "usual_amount": F.when(known & (n >= 5), flag(relative.between(2 / 3, 1.5))),
    }
    for name, c in _RELATIONS.items():
        count = F.col(f"_distinct_{name}")
        features[f"prior_distinct_{_PLURAL[name]}"] = if_known(count).cast("long")
        features[f"entity_{name}_is_new"] = F.when(known & F.col(c).isNotNull() & (count > 0), flag(F.col(f"_seen_{name}") >= t))
    return df.withColumns(features)


def global_counts(rows: DataFrame, cuts: list) -> DataFrame:
    """(TransactionDT, prior_global_count): rows of an earlier time, whatever their entity."""
    by_time = rows.groupBy("TransactionDT").agg(F.count("*").alias("rows"))
    return sums_before(by_time, "TransactionDT", ["rows"], cuts=cuts).select("TransactionDT", F.col("rows_before").cast("long").alias("prior_global_count"))


#: Frequencies: the columns of the value, and whether the count itself is a feature too.
FREQUENCIES = {"product": (["_product"], False), "email": (["_email"], False), "device": (["_device"], False), "product_card": (["_product", "_card"], True), "email_pair": (["_email", "_recipient"], True)}


def category_cells(rows: DataFrame, names: tuple[str, ...] = tuple(FREQUENCIES)) -> DataFrame:
    """(TransactionID, TransactionDT, name, value): the values that each keyed row has, pairs as one text."""

    def value(parts: list[str]) -> Column:
        # The first part's length keeps ("ab", "c") and ("a", "bc") apart.
        both = F.concat(F.length(parts[0]).cast("string"), F.lit(":"), *parts)
        return both if len(parts) > 1 else F.col(parts[0])

    pairs = F.array(*[F.struct(F.lit(n).alias("name"), value(FREQUENCIES[n][0]).alias("value")) for n in names])
    return rows.select("TransactionID", "TransactionDT", F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("x")).select("TransactionID", "TransactionDT", "x.name", "x.value")


def prior_counts(cells: DataFrame, cuts: list) -> DataFrame:
    """``cells`` with own and everyone: earlier cells of the name with the value, and with any value.

    Times are cut in ranges: a cell's rank inside its range is what was before it there, and ranges are added up, a row for each
    value and range, so that a value of very many rows is in many tasks.
    """
    placed = cells.withColumn("_range", range_of("TransactionDT", cuts)).where("_range is not null")
    sizes = placed.groupBy("name", "value", "_range").agg(F.count("*").alias("n"))
    before = lambda *by: F.coalesce(F.sum("n").over(W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    own = sizes.select("name", "value", "_range", before("name", "value").alias("_own"))
    everyone = sizes.groupBy("name", "_range").agg(F.sum("n").alias("n")).select("name", "_range", before("name").alias("_everyone"))
    inside = lambda *by: F.rank().over(W.partitionBy(*by, "_range").orderBy("TransactionDT")) - 1
    # As many tasks as names have ranges: AQE would put many of them in one, which sorts all of them in memory.
    parts = len(FREQUENCIES) * (len(cuts) + 1)
    out = placed.repartition(parts, "name", "value", "_range").withColumn("own", inside("name", "value")).join(own, ["name", "value", "_range"])
    out = out.repartition(parts, "name", "_range").withColumn("everyone", inside("name")).join(everyone, ["name", "_range"])
    return out.select(*cells.columns, (F.col("own") + F.col("_own")).cast("long").alias("own"), (F.col("everyone") + F.col("_everyone")).cast("long").alias("everyone"))


def by_row(counted: DataFrame, names: tuple[str, ...]) -> DataFrame:
    """(TransactionID, <name>_prior_frequency, <name>_prior_support) of counted cells."""
    mine = lambda n, c: F.max(F.when(F.col("name") == n, c))
    out = [mine(n, ratio(F.col("own"), F.col("everyone"))).alias(f"{n}_prior_frequency") for n in names]
    out += [mine(n, F.col("own")).alias(f"{n}_prior_support") for n in names if FREQUENCIES[n][1]]
    return counted.groupBy("TransactionID").agg(*out)


def frequencies(rows: DataFrame, cuts: list, names: tuple[str, ...] = tuple(FREQUENCIES)) -> DataFrame:
    """(TransactionID, <name>_prior_frequency, <name>_prior_support): earlier rows with the value, over those with any value.

    Null without a value; the frequency is null before the first one.  ``rows`` are keyed rows with unique ids.
    """
    return by_row(prior_counts(category_cells(rows, names), cuts), names)


def features(df: DataFrame, reference: str | None = None, keep: tuple[str, ...] = ("TransactionID", "TransactionDT", "ProductCD"), wanted: tuple[str, ...] = FEATURES, cuts: list | None = None) -> DataFrame:
    """The ``wanted`` features, and the columns of ``keep``, one row for each row of ``df``; counts that no one wants aren't made."""
    rows = with_keys(df)
    cuts = cuts_of(df, "TransactionDT") if cuts is None else cuts
    out = entity_features(row_features(rows, reference), cuts)
    if "prior_global_count" in wanted:
        out = out.join(global_counts(rows, cuts), "TransactionDT")
    names = tuple(n for n in FREQUENCIES if {f"{n}_prior_frequency", f"{n}_prior_support"} & set(wanted))
    if names:
        out = out.join(frequencies(rows, cuts, names), "TransactionID", "left")
    return out.select(*keep, *[f for f in FEATURES if f in wanted])
