"""Evaluation: confusion at thresholds and budgets, ranking metrics, paired effects, selections and bootstraps."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.functions.columns import ratio
from driftwell.operators import boosting, validate
from driftwell.operators.prefix import MOST_RANGES, RANGE_ROWS, cells_of, cuts_of, order_statistics, quantiles, sums_before
from driftwell.operators.profile import varying_columns
from driftwell.sources.shared import keep


def _n(condition: Column) -> Column:
    return F.coalesce(F.sum(condition.cast("long")), F.lit(0))


def confusion(df: DataFrame, decided: Column, label: str = "isFraud") -> DataFrame:
    """One row: alerts, tp, fp, fn, tn, precision, recall, fpr; a share of nothing is null."""
    y = F.col(label) == 1
    out = df.agg(_n(decided).alias("alerts"), _n(decided & y).alias("tp"), _n(decided & ~y).alias("fp"), _n(~decided & y).alias("fn"), _n(~decided & ~y).alias("tn"))
    return out.withColumns({"precision": ratio(F.col("tp"), F.col("alerts")), "recall": ratio(F.col("tp"), F.col("tp") + F.col("fn")), "fpr": ratio(F.col("fp"), F.col("fp") + F.col("tn"))})


def at_threshold(df: DataFrame, score: str, threshold: float, label: str = "isFraud") -> DataFrame:
    return confusion(df, F.coalesce(F.col(score) >= threshold, F.lit(False)), label)


def top_k(df: DataFrame, score: str, k: int, key: str = "TransactionID") -> DataFrame:
    """The k rows of the highest scores, equal ones by key; missing scores come last.

    The k-th score is found first, then, of the rows tied with it, the key that is the last to go in; none are sorted in one
    place.  ``key`` is unique, a number or a time.
    """
    if k <= 0:
        return df.limit(0)
    scored = df.withColumn("_s", F.coalesce(F.col(score), F.lit(float("-inf"))))
    n = scored.count()
    if k >= n:
        return df
    (kth,) = order_statistics(scored, "_s", [n - k])
    above = scored.where(F.col("_s") > kth)
    tied = scored.where(F.col("_s") == kth)
    (last,) = order_statistics(tied, key, [k - above.count() - 1])
    return above.unionByName(tied.where(F.col(key) <= last)).drop("_s")


def budget(rows: int, rate: float) -> int:
    return ceil(rows * rate)


def at_budget(df: DataFrame, score: str, k: int, label: str = "isFraud", key: str = "TransactionID") -> DataFrame:
    """Confusion when the k highest scores are reviewed."""
    picked = top_k(df, score, k, key).select(key).withColumn("_picked", F.lit(True))
    return confusion(df.join(picked, key, "left").withColumn("_picked", F.coalesce("_picked", F.lit(False))), F.col("_picked"), label)


def ranking_metrics(df: DataFrame, score: str, label: str = "isFraud", by: tuple[str, ...] = ()) -> DataFrame:
    """(by, average_precision, roc_auc): equal scores are taken together; null without both kinds of labels."""
    scores = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(_n(F.col(label) == 1).alias("p"), _n(F.col(label) != 1).alias("q"))
    placed = sums_before(scores, "s", ["p", "q"], by, cuts_of(df, score))
    total = scores.groupBy(*by).agg(F.sum("p").alias("all_p"), F.sum("q").alias("all_q"))
    # Above a score lie all but those below it: seen counts from the top down to it.
    j = (placed.join(total, list(by)) if by else placed.crossJoin(F.broadcast(total))).withColumn("tp", F.col("all_p") - F.col("p_before")).withColumn("fp", F.col("all_q") - F.col("q_before"))
    ap = F.sum(F.col("p") * F.col("tp") / (F.col("tp") + F.col("fp"))) / F.max("all_p")
    auc = F.sum(F.col("p") * (F.col("q_before") + F.col("q") / 2)) / (F.max("all_p") * F.max("all_q"))
    both = (F.max("all_p") > 0) & (F.max("all_q") > 0)
    return j.groupBy(*by).agg(F.when(both, ap).alias("average_precision"), F.when(both, auc).alias("roc_auc"))


def paired_effect(df: DataFrame, before: str, after: str, threshold: float, label: str = "isFraud") -> DataFrame:
    """What an adjustment changes at one threshold."""
    b, a, y = F.col(before) >= threshold, F.col(after) >= threshold, F.col(label) == 1
    return df.agg(_n(b & ~a & ~y).alias("removed_false_positives"), _n(~b & a & ~y).alias("added_false_positives"), _n(b & ~a & y).alias("lost_true_positives"), _n(~b & a & y).alias("added_true_positives"))


def break_even(effect: dict, alerts_before: int, alerts_after: int, prevention: float = 0.5) -> dict:
    """How much a missed case may cost, in false alarms or reviews, before the adjustment stops paying."""
    fp = effect["removed_false_positives"] - effect["added_false_positives"]
    tp = effect["lost_true_positives"] - effect["added_true_positives"]
    out = {"net_false_positives_removed": fp, "net_true_positives_lost": tp, "removed_reviews": alerts_before - alerts_after}
    if tp <= 0:
        return {"status": "no_fraud_lost", **out}
    return {"status": "ok", **out, "false_positive_cost_only": fp / tp, "every_review_costs": out["removed_reviews"] / tp, "partial_prevention": fp / tp / prevention}


def break_even_ratios(df: DataFrame, before: str, after: str, threshold: float, label: str = "isFraud", prevention: float = 0.5) -> DataFrame:
    """``break_even`` of an adjustment at one threshold as a row; the ratios are null where no true positive is lost."""
    b, a = (F.coalesce(F.col(c) >= threshold, F.lit(False)) for c in (before, after))
    y = F.col(label) == 1
    out = df.agg((_n(b & ~y) - _n(a & ~y)).alias("net_false_positives_removed"), (_n(b & y) - _n(a & y)).alias("net_true_positives_lost"), (_n(b) - _n(a)).alias("removed_reviews"))
    lost = F.when(F.col("net_true_positives_lost") > 0, F.col("net_true_positives_lost"))
    fp = F.col("net_false_positives_removed") / lost
    return out.withColumns({"false_positive_cost_only": fp, "every_review_costs": F.col("removed_reviews") / lost, "partial_prevention": fp / F.lit(prevention)})


def equal_volume_threshold(df: DataFrame, score: str, k: int) -> tuple[float | None, int | None]:
    """The k-th highest score and how many rows reach it; nothing where there are no k rows or k is 0."""
    n = df.where(F.col(score).isNotNull()).count()
    if not 0 < k <= n:
        return None, None
    (kth,) = order_statistics(df, score, [n - k])
    return kth, df.where(F.col(score) >= kth).count()


def select_strength(candidates: DataFrame, threshold: float, max_recall_drop: float, label: str = "isFraud") -> DataFrame:
    """(strength, score, label) rows, strength 0 the baseline: one row a strength, eligible and chosen marked.

    All strengths are counted in one pass.  Chosen is the one that removes most false positives within the allowed loss
    of recall, then the one that loses less, then the smaller.
    """
    hit, y = F.col("score") >= threshold, F.col(label) == 1
    by = candidates.groupBy("strength").agg(_n(hit & y).alias("tp"), _n(hit & ~y).alias("fp"), _n(y).alias("positives"))
    base = F.broadcast(by.where("strength = 0").select(F.col("tp").alias("_tp"), F.col("fp").alias("_fp")))
    by = by.crossJoin(base).withColumn("recall_drop", ratio(F.col("_tp") - F.col("tp"), F.col("positives"))).withColumn("false_positives_removed", F.col("_fp") - F.col("fp"))
    by = by.withColumn("eligible", F.coalesce(F.col("recall_drop") <= max_recall_drop + 1e-12, F.lit(False)))
    order = W.partitionBy().orderBy(F.col("eligible").desc(), F.col("false_positives_removed").desc(), "recall_drop", "strength")
    # One row for each candidate strength, a handful.
    return by.withColumn("chosen", (F.row_number().over(order) == 1) & F.col("eligible")).select("strength", "tp", "fp", "recall_drop", "false_positives_removed", "eligible", "chosen")


def select_by_capacity(candidates: dict[float, DataFrame], k: int, score: str = "score", label: str = "isFraud", key: str = "TransactionID") -> tuple[float, list[dict]]:
    """The strength whose k highest rows hold most positives, then of the better average precision, then the smaller."""
    rows = []
    for strength, df in candidates.items():
        hits = top_k(df, score, k, key).agg(_n(F.col(label) == 1)).first()[0]
        rows.append({"strength": strength, "tp": hits, "average_precision": ranking_metrics(df, score, label).first()[0]})
    return max(rows, key=lambda r: (r["tp"], r["average_precision"] or 0.0, -r["strength"]))["strength"], rows


def overlap(df: DataFrame, first: str, second: str, rate: float, label: str = "isFraud", key: str = "TransactionID") -> DataFrame:
    """Two review lists of one budget: shared, either one's own hits, and both together."""
    k = budget(df.count(), rate)
    a = top_k(df, first, k, key).select(key, label, F.lit(1).alias("a"))
    b = top_k(df, second, k, key).select(key, F.col(label).alias("_y"), F.lit(1).alias("b"))
    j = a.join(b, key, "full_outer").withColumn("y", F.coalesce(label, "_y") == 1)
    in_a, in_b = F.col("a").isNotNull(), F.col("b").isNotNull()
    return j.agg(F.lit(k).cast("long").alias("reviews_each"), _n(in_a & in_b).alias("shared_reviews"), _n(in_a & ~in_b & F.col("y")).alias("first_only_tp"), _n(in_b & ~in_a & F.col("y")).alias("second_only_tp"), F.count("*").alias("union_reviews"), _n(F.col("y")).alias("union_tp"))


def hits_at(df: DataFrame, by: tuple[str, ...], score: str, rate: float, label: str = "isFraud", key: str = "TransactionID") -> DataFrame:
    """(by, reviews, hits): the ``rate`` of each group's rows with the highest scores, equal ones by key, and the positives in it.

    Groups may be of any size: scores are counted, and only the rows tied at a group's last score are placed by key.
    """
    rows = df.select(*by, F.col(key).alias("_k"), F.coalesce(F.col(score), F.lit(float("-inf"))).alias("_s"), (F.col(label) == 1).cast("long").alias("_y"))
    each = rows.groupBy(*by, "_s").agg(F.count("*").alias("_n"), F.sum("_y").alias("_h"))
    total = each.groupBy(*by).agg(F.sum("_n").alias("_all")).withColumn("_budget", F.ceil(F.col("_all") * F.lit(rate)).cast("long"))
    placed = sums_before(each, "_s", ["_n"], by, cuts_of(rows, "_s")).join(total, list(by)).withColumn("_above", F.col("_all") - F.col("_n_before") - F.col("_n"))
    whole = placed.where(F.col("_above") + F.col("_n") <= F.col("_budget")).groupBy(*by).agg(F.sum("_h").alias("_h"))
    last = placed.where((F.col("_above") < F.col("_budget")) & (F.col("_above") + F.col("_n") > F.col("_budget"))).select(*by, "_s", (F.col("_budget") - F.col("_above")).alias("_room"))
    tied = rows.join(last, [*by, "_s"]).withColumn("_n", F.lit(1).cast("long"))
    taken = sums_before(tied, "_k", ["_n"], by, cuts_of(rows, "_k")).where(F.col("_n_before") < F.col("_room")).groupBy(*by).agg(F.sum("_y").alias("_h"))
    hits = whole.unionByName(taken).groupBy(*by).agg(F.sum("_h").alias("hits"))
    return total.join(hits, list(by), "left").select(*by, F.col("_budget").alias("reviews"), F.coalesce("hits", F.lit(0)).cast("long").alias("hits"))


def compare(df: DataFrame, before: str, after: str, threshold: float, rate: float, label: str = "isFraud", key: str = "TransactionID") -> DataFrame:
    """One row: alerts and hits of two scores at one threshold, their hits at one budget, and what changes between them."""
    k = budget(df.count(), rate)
    y, out = F.col(label) == 1, paired_effect(df, before, after, threshold, label)
    for name, score in (("before", before), ("after", after)):
        hit = F.coalesce(F.col(score) >= threshold, F.lit(False))
        out = out.crossJoin(df.agg(_n(hit).alias(f"{name}_alerts"), _n(hit & y).alias(f"{name}_tp")))
        out = out.crossJoin(top_k(df, score, k, key).agg(_n(y).alias(f"{name}_budget_tp")))
    return out.withColumn("budget", F.lit(k).cast("long"))


def _replicates(df: DataFrame, score: str, rate: float, weigh: Callable[[np.ndarray, np.ndarray], np.ndarray], count: int) -> tuple[np.ndarray, np.ndarray]:
    """Hits within the budget, and weight, of each of ``count`` replicates of the rows of ``df`` (k, b, y, score).

    ``weigh`` gives the rows' weights in all replicates, by key and block.  The order (score, then key) is cut into ranges
    of about equal size, ties or not; a range's weights are added up where its rows are, and the rows of a range are read
    again only for the replicates whose budget ends in it.
    """
    rows = df.select(F.col("k").cast("long").alias("k"), F.col("b").cast("int").alias("b"), F.col("y").cast("int").alias("y"), F.col(score).cast("double").alias("s"))
    ranges = max(1, min(MOST_RANGES, rows.count() // RANGE_ROWS))
    placed = keep(rows.repartitionByRange(ranges, F.col("s").desc_nulls_last(), "k").withColumn("r", F.spark_partition_id()), "replicates")

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            k, b, y, r = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in "kbyr")
            w = weigh(k, b)
            for one in np.unique(r):
                own = r == one
                yield pa.RecordBatch.from_arrays([pa.array([one], pa.int32()), pa.array([w[own].sum(axis=0).astype(float)]), pa.array([(w[own] * y[own, None]).sum(axis=0).astype(float)])], ["r", "w", "h"])

    def add(key: tuple, part: pa.Table) -> pa.Table:
        total = {c: np.stack(part[c].to_numpy()).sum(axis=0) for c in "wh"}
        return pa.table({"r": pa.array([key[0].as_py()], pa.int32()), **{c: pa.array([total[c]]) for c in "wh"}})

    shape = "r int, w array<double>, h array<double>"
    sums = sorted(placed.mapInArrow(weights, shape).groupBy("r").applyInArrow(add, shape).collect(), key=lambda x: x["r"])  # a row a range
    if not sums:
        return np.zeros(count), np.zeros(count)
    w, h, number = np.array([x["w"] for x in sums]), np.array([x["h"] for x in sums]), np.array([x["r"] for x in sums])
    drawn, upto = w.sum(axis=0), w.cumsum(axis=0)
    need = np.ceil(drawn * rate)
    at = np.minimum((upto < need).sum(axis=0), len(number) - 1)
    each = np.arange(count)
    sure, room = np.where(at > 0, h.cumsum(axis=0)[at - 1, each], 0), need - np.where(at > 0, upto[at - 1, each], 0)

    def finish(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["s", "k"], ascending=[False, True])
        mine = np.flatnonzero(number[at] == key[0])
        times = weigh(part["k"].to_numpy(), part["b"].to_numpy())[:, mine]
        taken = np.clip(room[mine] - (times.cumsum(axis=0) - times), 0, times)
        return pd.DataFrame({"replicate": mine, "hits": (taken * part["y"].to_numpy()[:, None]).sum(axis=0)})

    ends = placed.where(F.col("r").isin([int(x) for x in set(number[at])])).groupBy("r").applyInPandas(finish, "replicate int, hits double").collect()  # a row a replicate
    hits = sure.astype(float)
    for e in ends:
        hits[e["replicate"]] += e["hits"]
    return hits, drawn


_INTERVAL = "status string, {} long, observed long, ci_low double, ci_high double, excludes_zero boolean"


def _interval(df: DataFrame, rate: float, weigh: Callable, count: int, units: tuple[str, int]) -> DataFrame:
    """The observed gap in hits of s1 to s0 within the budget and its 95 % interval over replicates, as for the rows there are."""
    n = df.count()
    hits = [_replicates(df, c, rate, weigh, count) for c in ("s0", "s1")]
    scaled = (hits[1][0] - hits[0][0]) / np.maximum(hits[0][1], 1) * n
    low, high = (float(x) for x in np.percentile(scaled, [2.5, 97.5]))
    seen = [top_k(df, c, budget(n, rate), "k").agg(_n(F.col("y") == 1)).first()[0] for c in ("s0", "s1")]
    return df.sparkSession.createDataFrame([("ok", units[1], int(seen[1] - seen[0]), low, high, low > 0 or high < 0)], _INTERVAL.format(units[0]))


def block_bootstrap(df: DataFrame, base: str, challenger: str, rate: float, resamples: int, least_blocks: int = 8, seed: int = 17, label: str = "isFraud", key: str = "TransactionID", block: str = "block", check: bool = False) -> DataFrame:
    """One row: observed gap in hits and its 95 % interval over draws of whole blocks with replacement.

    A draw weighs each block by how often it is drawn; both rankings get the same draws.
    """
    if check:
        for c in (base, challenger):
            validate.metric_inputs(df, label, c, key)
    blocks = sorted(r[0] for r in df.select(block).distinct().collect())  # spans of time
    if len(blocks) < least_blocks:
        return df.sparkSession.createDataFrame([("insufficient_blocks", len(blocks), None, None, None, None)], _INTERVAL.format("blocks"))
    rng = np.random.default_rng(seed)
    draws = np.array([np.bincount(rng.integers(0, len(blocks), len(blocks)), minlength=len(blocks)) for _ in range(resamples)])
    number = F.array_position(F.array(*[F.lit(b) for b in blocks]), F.col(block)) - 1
    small = df.select(F.col(key).alias("k"), number.cast("int").alias("b"), (F.col(label) == 1).cast("int").alias("y"), F.col(base).alias("s0"), F.col(challenger).alias("s1"))
    return _interval(small, rate, lambda k, b: draws[:, b].T, resamples, ("blocks", len(blocks)))


#: Cumulative Poisson(1) probabilities.
_POISSON = np.array([0.36787944117144233, 0.7357588823428847, 0.9196986029286058, 0.9810118431238462, 0.9963401531726563, 0.9994058151824183, 0.9999167588507119])


def poisson_weights(keys: np.ndarray, resamples: int, seed: int = 17) -> np.ndarray:
    """Weights of rows in every replicate, from their keys alone, so that all rankings and reruns agree."""
    with np.errstate(over="ignore"):
        h = keys.astype(np.uint64)[:, None] * np.uint64(0x9E3779B97F4A7C15) + (np.arange(resamples, dtype=np.uint64) + np.uint64(seed << 20)) * np.uint64(0xD6E8FEB86659FD93)
        for shift, times in ((32, 0xD6E8FEB86659FD93), (29, 0xBF58476D1CE4E5B9), (32, 1)):
            h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return np.searchsorted(_POISSON, (h >> np.uint64(11)).astype(float) / float(1 << 53), side="right")


def row_bootstrap(df: DataFrame, base: str, challenger: str, rate: float, resamples: int, seed: int = 17, label: str = "isFraud", key: str = "TransactionID", check: bool = False) -> DataFrame:
    """One row: observed gap in hits and its 95 % interval over replicates in which every row has a Poisson weight.

    Both rankings get the same weights; a gap is scaled to the number of rows there are.
    """
    if check:
        for c in (base, challenger):
            validate.metric_inputs(df, label, c, key)
    small = df.select(F.col(key).alias("k"), F.lit(0).alias("b"), (F.col(label) == 1).cast("int").alias("y"), F.col(base).alias("s0"), F.col(challenger).alias("s1"))
    return _interval(small, rate, lambda k, b: poisson_weights(k, resamples, seed), resamples, ("resamples", resamples))


def supervised_scores(train: DataFrame, df: DataFrame, columns: list[str], label: str = "isFraud", kind: str = "logistic", name: str = "supervised", rounds: int = 20) -> DataFrame:
    """``df`` with ``name``: the probability by a ranker that ``supervised`` fits on ``train``."""
    return supervised(train, columns, label, kind, rounds)(df, name)


def supervised(train: DataFrame, columns: list[str], label: str = "isFraud", kind: str = "logistic", rounds: int = 20) -> Callable[[DataFrame, str], DataFrame]:
    """What adds to rows, by a name, the probability by a ranker (logistic or boosted) fitted on ``train``, classes balanced by weight.

    Boosting takes missing values as they are; logistic regression has the training median and a flag for them; NaN is missing.  Columns that
    are constant or empty in training are left out.
    """
    used = varying_columns(train, columns)
    if kind == "boosted":
        boosted = boosting.fit(train, used, label, boosting.Boosting(rounds=rounds)).probability()
        return lambda df, name: df.withColumn(name, boosted)
    if kind != "logistic":
        raise ValueError(f"unknown kind of ranker: {kind}")
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.feature import StandardScaler, VectorAssembler
    from pyspark.ml.functions import vector_to_array

    there = lambda c: F.nanvl(F.col(c).cast("double"), F.lit(None).cast("double"))
    facts = train.agg(*[_n(there(c).isNull()).alias(f"g_{c}") for c in used], F.count("*").alias("n"), _n(F.col(label) == 1).alias("p")).first()
    medians = {r["name"]: r["q"][0] for r in quantiles(cells_of(train.select(*[there(c).alias(c) for c in used]), used), "x", [0.5], ("name",)).collect()}  # one row a column
    flags = [c for c in used if facts[f"g_{c}"]]
    fill = lambda d: d.withColumns({f"_x_{c}": F.coalesce(there(c), F.lit(float(medians[c]))) for c in used} | {f"_g_{c}": there(c).isNull().cast("double") for c in flags})
    n, p = facts["n"], facts["p"]
    weight = F.when(F.col(label) == 1, n / (2.0 * max(p, 1))).otherwise(n / (2.0 * max(n - p, 1)))
    ranker = LogisticRegression(featuresCol="_v", labelCol=label, weightCol="_w", predictionCol="_y", probabilityCol="_p", rawPredictionCol="_r", regParam=1.0 / max(n, 1), standardization=False)
    names = [f"_x_{c}" for c in used] + [f"_g_{c}" for c in flags]
    model = Pipeline(stages=[VectorAssembler(inputCols=names, outputCol="_a"), StandardScaler(inputCol="_a", outputCol="_v", withMean=True), ranker]).fit(fill(train).withColumn("_w", weight))
    return lambda df, name: model.transform(fill(df)).withColumn(name, vector_to_array("_p")[1]).select(*df.columns, name)


def _sign(x: float) -> int:
    return (x > 0) - (x < 0)


def interval_sign(low: float, high: float) -> int:
    """1 or -1 where an interval lies on one side of zero, 0 where it has zero in it or at its end."""
    return _sign(low) if _sign(low) == _sign(high) else 0


def reading(gap: float, intervals: list[tuple[float, float] | None], halves: tuple[float, float]) -> str:
    """What a gap, its intervals at several block lengths and its values in two halves say together.

    uncomputed or partial where intervals are missing; conflict where they contradict each other or the gap; flat without
    a gap; none where the halves disagree; weak where an interval has zero in it; else gain or loss.
    """
    known = [i for i in intervals if i is not None]
    if len(known) < len(intervals) or not known:
        return "partial" if known else "uncomputed"
    signs = {interval_sign(*i) for i in known}
    sure = signs.pop() if len(signs) == 1 else None if signs >= {1, -1} else 0
    way, period = _sign(gap), _sign(halves[0]) if _sign(halves[0]) == _sign(halves[1]) else 0
    if sure is None or (sure and sure != way):
        return "conflict"
    if not way:
        return "flat"
    if not period:
        return "none"
    if not sure:
        return "weak"
    return "none" if period != way else "gain" if way > 0 else "loss"
