"""Layers, ranks, combination, context and the product-risk term."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import context, forest, history, layers, prefix
from driftwell.operators.prefix import cuts_of, higher_quantile, order_statistics, range_of, strict_rank, strict_ranks, sums_before
from driftwell.plans import queries
from driftwell.sources.shared import keep


def test_strict_rank(spark):
    ref = spark.createDataFrame([(0.0,), (0.0,), (0.0,), (2.0,)], "x double")
    df = spark.createDataFrame([(i, v) for i, v in enumerate((0.0, 1.0, 2.0, 3.0, None))], "i int, x double")
    assert [r.n for r in strict_rank(ref, df, "x", "n", "i").orderBy("i").collect()] == [0, 0.75, 0.75, 1, None]


def test_ranks_of_several_columns_at_once(spark):
    rng = np.random.default_rng(6)
    rows = [(i, None if i % 5 == 0 else float(rng.integers(0, 30)), float(rng.normal()), None) for i in range(400)]
    df = spark.createDataFrame(rows, "i long, x double, y double, gone double")
    ref = df.where("i < 250")
    got = {r.i: r for r in strict_ranks(ref, df, {"x": "rx", "y": "ry", "gone": "rg"}, "i").collect()}
    assert len(got) == 400
    for c, name in ((1, "rx"), (2, "ry")):
        known = [r[c] for r in rows[:250] if r[c] is not None]
        for r in rows:
            assert got[r[0]][name] == (None if r[c] is None else pytest.approx(sum(k < r[c] for k in known) / len(known))) and got[r[0]].rg is None


def test_many_ranges(spark):
    """More cuts than are looked through at once give the same ranges as a plain search."""
    from bisect import bisect_right

    cuts = [float(c) for c in range(0, 1000, 3)]
    df = spark.createDataFrame([(float(x),) for x in range(-5, 1010, 2)] + [(None,)], "x double")
    assert all(r.n == (None if r.x is None else bisect_right(cuts, r.x)) for r in df.withColumn("n", range_of("x", cuts)).collect())


def test_order_statistics_and_prefix_sums(spark):
    rng = np.random.default_rng(5)
    values = [float(x) for x in rng.integers(0, 300, 2000)]
    df = spark.createDataFrame([(v,) for v in values], "x double")
    assert order_statistics(df, "x", [0, 7, 1000, 1999]) == [sorted(values)[i] for i in (0, 7, 1000, 1999)]
    by = df.groupBy("x").agg(F.count("*").alias("n"))
    got = {r.x: r.n_before for r in sums_before(by, "x", ["n"], cuts=cuts_of(df, "x", 8)).collect()}
    assert got == {v: sum(w < v for w in values) for v in set(values)}
    hundred = spark.range(1, 101).select(F.col("id").cast("double").alias("x"))
    assert higher_quantile(hundred, "x", 0.95) == 96


def test_robust_reference_falls_back(spark):
    df = spark.createDataFrame([(0.0,)] * 10, "x double")
    r = layers.robust(df, {"x": F.col("x")}).first()
    assert (r.centre, r.scale) == (0, 1)
    got = spark.createDataFrame([(0.0,), (3.0,)], "x double").select(layers.deviation(F.col("x"), layers.Robust(0, 1)).alias("d")).collect()
    assert [g.d for g in got] == [0, 3]


def test_weights_are_shared_among_available_layers(spark):
    cols = "TransactionID long, column_normalized double, multivariate_normalized double, entity_normalized double, temporal_normalized double"
    df = spark.createDataFrame([(1, 1.0, 1.0, None, None), (2, 0.4, 0.4, 0.4, 0.4), (3, None, None, None, None)], cols)
    a, b, c = layers.combined(df).orderBy("TransactionID").collect()
    assert (a.raw_anomaly_score, a.available_weight, a.column_effective_weight, a.entity_contribution) == (1, 0.5, 0.5, 0)
    assert b.raw_anomaly_score == pytest.approx(0.4) and c.raw_anomaly_score is None
    with pytest.raises(ValueError):
        layers.checked_weights({"column": 1.0})


def test_forest_isolates_outliers():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(600, 3))
    f = forest.Forest(np.zeros(3), x, forest.ForestConfig(trees=40, rows=128))
    far, near = f.score(np.array([[9.0, 9.0, 9.0]]))[0], f.score(np.zeros((1, 3)))[0]
    assert 0 < near < far < 1
    both = f.score(np.array([[0.0, 0, 0], [9, 9, 9]]))
    assert both[0] == near and both[1] == far


def row(**changes):
    base = {
        "TransactionID": 1, "TransactionDT": 1e6, "ProductCD": "W", "amount": 5.0, "prior_transaction_count": 30, "amount_to_prior_mean": 1.0, "prior_count_1h": 2, "frequent_entity": 1.0, "usual_amount": 1.0,
        "entity_hour_probability": 0.1, "entity_product_is_new": 0.0, "entity_email_is_new": 0.0, "entity_device_is_new": 0.0, "calendar_available": 1.0, "is_business_hours": 1.0, "is_weekend": 0.0,
        "raw_anomaly_score": 0.8, "column_normalized": 0.95, "multivariate_normalized": 0.8, "entity_raw": 0.2, "column_contribution": 0.2, "multivariate_contribution": 0.2, "entity_contribution": 0.2, "temporal_contribution": 0.2,
    }
    return base | changes


_KINDS = ", ".join(f"{k} {'long' if k in ('TransactionID', 'prior_transaction_count', 'prior_count_1h') else 'string' if k == 'ProductCD' else 'double'}" for k in row())


def applied(spark, cfg=context.Context(), reference=None, external=None, enabled=None, **changes):
    df = spark.createDataFrame([tuple(row(**changes).values())], _KINDS)
    return context.apply_context(df, cfg, reference, external, None if enabled is None else frozenset(enabled), check=True).first()


def test_all_rules_meet_the_cap(spark):
    r = applied(spark)
    assert r.context_reduction == pytest.approx(0.05) and r.context_entity_reduction == 0


@pytest.mark.parametrize("sign", [{"entity_raw": 3.0}, {"multivariate_normalized": 0.99}, {"prior_count_1h": 10}, {"entity_email_is_new": 1.0}])
def test_guard(spark, sign):
    r = applied(spark, **sign)
    assert r.context_guard_active and r.context_reduction == 0


def test_single_rules(spark):
    assert applied(spark, enabled=["business_hours"]).context_temporal_reduction == pytest.approx(0.02)
    assert applied(spark, prior_transaction_count=None).context_reduction == 0
    free = context.Context(max_absolute_reduction=1.0, max_relative_reduction=1.0)
    r = applied(spark, free, enabled=["business_hours", "frequent_familiar_activity"])
    assert r.context_temporal_reduction == pytest.approx(0.04) and r.context_temporal_reason == "frequent_familiar_activity"
    assert applied(spark, context.Context(max_relative_reduction=0.01)).context_reduction == pytest.approx(0.008)
    raw = applied(spark, context.Context(strength=0.0))
    assert raw.context_reduction == 0 and raw.context_match_business_hours


@pytest.mark.parametrize(("at", "expected"), [(999999.0, 0.02), (1000000.0, 0.0), (1000001.0, 0.0)])
def test_trust_is_observed_before(spark, at, expected):
    e = spark.createDataFrame([(1, True, at, "desk")], "TransactionID long, trusted_entity boolean, trust_observed_at double, trust_source string")
    assert applied(spark, external=e, enabled=["verified_trust"]).context_multivariate_reduction == pytest.approx(expected)


@pytest.mark.parametrize(("ratio", "stable"), [(0.7999999999999998, True), (1.2500000000000002, True), (0.79999999, False), (1.25000001, False)])
def test_last_bits_of_a_mean_decide_nothing(spark, ratio, stable):
    """amounts in cents come exactly to the bounds of a stable ratio, and a mean's last bits depend on the order of its sum."""
    assert applied(spark, amount_to_prior_mean=ratio).context_match_business_hours == stable


def test_evidence_must_be_complete(spark):
    e = spark.createDataFrame([(1, True, 5.0, " ")], "TransactionID long, trusted_entity boolean, trust_observed_at double, trust_source string")
    with pytest.raises(ValueError):
        applied(spark, external=e)


def test_product_reference(spark):
    train = spark.createDataFrame([("W", float(i), "train") for i in range(10)] + [("C", 1.0, "train")], "ProductCD string, amount double, split string")
    ref = context.product_reference(train, context.Context(product_minimum_support=10)).collect()
    assert [(r.ProductCD, r.lower, r.upper) for r in ref] == [("W", pytest.approx(0.9), pytest.approx(8.1))]


def test_rows_of_a_product_do_not_meet_in_one_task(spark):
    """F7-F24: rows aren't dealt by product to join its usual amounts."""
    train = spark.createDataFrame([("W", float(i), "train") for i in range(10)], "ProductCD string, amount double, split string")
    cfg = context.Context(product_minimum_support=10)
    df = spark.createDataFrame([tuple(row().values())], _KINDS)
    plan = context.apply_context(df, cfg, context.product_reference(train, cfg))._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.splitlines() if "Join" in line and "[ProductCD#" in line]
    assert any("BroadcastHashJoin" in line and "LeftOuter" in line for line in joins) and not any("SortMergeJoin" in line and "LeftOuter" in line for line in joins)


def test_bad_context():
    with pytest.raises(ValueError):
        context.Context(strength=1.5)
    with pytest.raises(ValueError):
        context.Context(stable_ratio_min=1.1)


@pytest.mark.parametrize(("product", "time", "sign"), [("high", 101.0, 1), ("low", 101.0, -1), ("small", 101.0, 0), ("unseen", 101.0, 0), ("high", 100.0, 0)])
def test_product_risk(spark, product, time, sign):
    policy = context.ProductRisk(0.05, 100.0)
    rows = [(p, n, k, policy.relative(n, k)) for p, n, k in (("high", 2000, 200), ("low", 2000, 20), ("small", 100, 20))]
    profiles = spark.createDataFrame(rows, "ProductCD string, support long, positive long, log_relative_risk double")
    df = spark.createDataFrame([tuple(row(ProductCD=product, TransactionDT=time).values())], _KINDS)
    got = context.apply_product_risk(df, profiles, policy).first().product_context_adjustment
    assert (got > 0) - (got < 0) == sign


def test_registered_chain_has_the_forest(spark, sf):
    """The full queries against plain Python: trees walked row by row, ranks, the mean of what is there, guard and rules."""
    from bisect import bisect_left
    from math import log1p

    from driftwell.plans import registry
    from driftwell.plans import queries
    from driftwell.sources.shared import keep

    features = keep(queries.feature_table(spark, sf), "features")
    grown = forest.fit(features.where("split = 'train'"))

    def isolated(r) -> float:
        x = [None if r[c] is None else log1p(r[c]) if c in forest.LOGGED else float(r[c]) for c in forest.MULTIVARIATE]
        x = [m if v is None else v for v, m in zip(x, grown.medians)] + [float(x[i] is None) for i in grown.flagged]
        total = 0.0
        for feature, cut, left, length in grown.trees:
            at = 0
            while feature[at] >= 0:
                at = left[at] + int(x[feature[at]] > cut[at])
            total += length[at]
        return round(2.0 ** (-total / len(grown.trees) / float(forest._path(grown.size))), 9)

    raw = {r.TransactionID: (r.split, isolated(r)) for r in features.collect()}
    train = sorted(v for split, v in raw.values() if split == "train")
    rows = {r.TransactionID: r for r in queries.full(queries.scored)(spark, sf).collect()}
    matches = {r.TransactionID: r for r in registry.QUERIES["full_rule_matches"](spark, sf).collect()}
    guards = {r.TransactionID: r.context_guard_active for r in registry.QUERIES["full_context_guard"](spark, sf).collect()}
    assert registry.FLAGSHIP == "full_rule_decisions" and set(rows) == set(raw) == set(matches)
    for i, r in rows.items():
        assert abs(r.multivariate_raw - raw[i][1]) < 2e-9
        high = bisect_left(train, r.multivariate_raw) / len(train)
        assert abs(r.multivariate_normalized - high) <= 1.5 / len(train)
        have = [r[f"{x}_normalized"] for x in layers.LAYERS if r[f"{x}_normalized"] is not None]
        assert abs(r.raw_anomaly_score - sum(have) / len(have)) < 1e-9
        m, old = r.multivariate_normalized, r.prior_transaction_count is not None and r.prior_transaction_count >= 5
        assert guards[i] or m < 0.98
        assert matches[i].rule_match_R01_multi_entity_deviation == (m >= 0.98 and r.entity_raw is not None and r.entity_raw >= 3 and old)
        assert matches[i].rule_match_R05_new_device_anomaly == (m >= 0.95 and r.entity_device_is_new == 1 and old)
    assert any(r.multivariate_normalized >= 0.98 for r in rows.values())
    assert {r.multivariate_raw for r in queries.scored(spark, sf).collect()} == {None}


def test_rows_times_scenarios_are_not_broadcast(spark):
    """What an explode makes is as large as its rows times their cells, whatever Spark takes its size for."""
    rows = keep(spark.range(20).select(F.col("id").alias("TransactionID"), F.lit(5.0).alias("TransactionDT"), (F.col("id") % 7).cast("double").alias("x_raw"), F.lit(1.0).alias("y_raw")), "rows")
    each = rows.withColumn("k", F.explode(F.array(*map(F.lit, range(4))))).withColumn("TransactionID", F.col("TransactionID") * 4 + F.col("k"))
    evidence = each.select("TransactionID", (F.col("k") == 0).alias("trusted_entity"), F.lit(1.0).alias("trust_observed_at"), F.lit("desk").alias("trust_source"))
    held = context.with_external(each, evidence)
    ranked = strict_ranks(rows, each, {"x_raw": "x", "y_raw": "y"})
    for df, joined in ((held, "[TransactionID#"), (ranked, "knownfloatingpointnormalized")):
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not [line for line in plan.splitlines() if "BroadcastHashJoin" in line and joined in line], plan
    assert held.where("_trusted").count() == 20
    assert {r.x for r in ranked.collect()} == {0.0, 3 / 20, 6 / 20, 9 / 20, 12 / 20, 15 / 20, 18 / 20}


def test_tasks_have_a_bounded_number_of_rows(spark, sf, monkeypatch):
    """More rows make more tasks of the same size, whatever AQE would put together."""
    tasks = lambda df: df.groupBy(F.spark_partition_id()).count().count()
    monkeypatch.setattr(history, "TASK_ROWS", 50, raising=False)
    rows = queries.keyed(spark, sf)
    assert tasks(history.entity_features(rows)) > rows.count() / 50 / 2
    some = spark.range(4000).select((F.col("id") % 2).alias("g"), F.col("id").cast("double").alias("x"), F.lit(1).alias("n"))
    out = sums_before(some, "x", ["n"], ("g",), cuts=[100.0 * i for i in range(1, 40)])
    assert tasks(out) > 15
    assert out.where(F.col("n_before") != F.floor(F.col("x") / 2)).count() == 0


def test_ranks_have_tasks_for_their_rows(spark, monkeypatch):
    """F7-F24: more rows make more tasks of rank joins, and a value of very many rows is in many of them; the ranks are the same."""
    rows = keep(spark.range(4000).select(F.col("id").alias("i"), F.when(F.col("id") < 3000, -0.0).otherwise(F.col("id").cast("double")).alias("x"), F.when(F.col("id") % 2 == 0, float("nan")).alias("y")), "rows")
    expected = sorted(map(tuple, strict_ranks(rows, rows, {"x": "rx", "y": "ry"}, "i").select("i", "rx", "ry").collect()))
    monkeypatch.setattr(prefix, "TASK_ROWS", 100, raising=False)
    monkeypatch.setattr(prefix, "RANGE_ROWS", 100)
    ranked = strict_ranks(rows, rows, {"x": "rx", "y": "ry"}, "i")
    assert ranked.groupBy(F.spark_partition_id()).count().count() > 20
    assert sorted(map(tuple, ranked.select("i", "rx", "ry").collect())) == expected
    assert expected[0] == (0, 0.0, 0.0) and expected[1] == (1, 0.0, None) and expected[3500] == (3500, 3500 / 4000, 0.0)
