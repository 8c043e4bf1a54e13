"""The registered queries of the transaction engine: each applies operators to whole tables."""

from __future__ import annotations

from collections.abc import Callable
from contextvars import ContextVar
from functools import reduce, wraps

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from driftwell.functions.columns import every, flag, printed, ratio
from driftwell.operators import context, evaluate, forest, history, ingest, layers, profile, ranking, retrieval
from driftwell.operators.prefix import cuts_of, higher_quantile, quantiles, strict_rank, strict_ranks
from driftwell.operators.rules import DEFAULT, RuleSet
from driftwell.plans import experiment
from driftwell.sources import tables as src
from driftwell.sources.shared import folder, keep
from driftwell.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Elapsed second 0 of the views.
REFERENCE = "2024-01-01T00:00:00+00:00"
ENTITY = list(history.ENTITY_PARTS)


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def joined(spark: SparkSession, sf_dir: str, tick: int = 60) -> DataFrame:
    return ingest.join_identity(src.transactions(spark, sf_dir, tick), src.identities(spark, sf_dir), check=False)


def keyed(spark: SparkSession, sf_dir: str, tick: int = 60) -> DataFrame:
    return history.row_features(history.with_keys(joined(spark, sf_dir, tick)), REFERENCE)


def entity(spark: SparkSession, sf_dir: str, tick: int = 3600) -> DataFrame:
    """Entity history at hourly ticks, which make many ties."""
    return history.entity_features(keyed(spark, sf_dir, tick))


def feature_table(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = history.FEATURES) -> DataFrame:
    """The features, with label and split."""
    t, times = F.col("TransactionDT"), src.transactions(spark, sf_dir)
    cuts = cuts_of(times, "TransactionDT")
    first, second = ingest.boundaries(times, [0.6, 0.8], cuts=cuts)
    out = history.features(joined(spark, sf_dir), REFERENCE, ("TransactionID", "TransactionDT", "ProductCD", "isFraud"), wanted, cuts)
    return out.withColumn("split", F.when(t < first, "train").when(t < second, "validation").otherwise("test"))


def labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents with labels as scored rows: isFraud is toxic, the score its length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "n_chars", "lang", "source")
    return d.join(table(spark, sf_dir, "labels"), "doc_id").select(F.col("doc_id").alias("TransactionID"), F.col("n_chars").cast("double").alias("score"), (F.col("doc_id") * 7919 % 1000 / 1000.0).alias("other"), F.col("toxic").cast("int").alias("isFraud"), "quality", "lang", "source")


#: Whether the queries on scored rows have the multivariate layer; those that SQL states have three layers.
_FOREST: ContextVar[bool] = ContextVar("forest", default=False)


def full(f: Query) -> Query:
    """The query on all four layers, by the name of full_..."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        before = _FOREST.set(True)
        try:
            return f(spark, sf_dir)
        finally:
            _FOREST.reset(before)

    run.__name__ = f"full_{f.__name__}"
    return run


def told() -> list[str]:
    """The layers that scored rows have."""
    return [x for x in layers.LAYERS if x != "multivariate" or _FOREST.get()]


#: What layers and context read; the rules read three counts more.
_COUNTS = ("prior_global_count", *(f"{n}_prior_{x}" for n in history.FREQUENCIES for x in ("frequency", "support")))
PLAIN = tuple(f for f in history.FEATURES if f not in _COUNTS)
RULED = (*PLAIN, "prior_global_count", "product_card_prior_frequency", "email_pair_prior_frequency")


def scored(spark: SparkSession, sf_dir: str, wanted: tuple[str, ...] = PLAIN) -> DataFrame:
    """Layers, ranked against training rows and combined, as a table, with the ``wanted`` features; all of them with the forest, whose
    scores are written once and then ranked."""
    features = keep(feature_table(spark, sf_dir, history.FEATURES if _FOREST.get() else wanted), "features")
    train = features.where("split = 'train'")
    raw = layers.raw_layers(features, layers.fit_references(train, check=False), forest.scores(forest.fit(train)) if _FOREST.get() else None)
    raw = raw.withColumns({f"{x}_raw": F.round(f"{x}_raw", 9) for x in layers.LAYERS})
    raw = keep(raw, "raw") if _FOREST.get() else raw
    return keep(layers.combined(layers.normalised(raw.where("split = 'train'"), raw)), "scored")


def small_context() -> context.Context:
    """The default policy with a product support that the views reach."""
    return context.Context(product_minimum_support=100, minimum_prior_count=5)


def discounted(s: DataFrame, cfg: context.Context | None = None, enabled: frozenset[str] | None = None, external: DataFrame | None = None, check: bool = False) -> DataFrame:
    """Scored rows with the context discounts."""
    cfg = cfg or small_context()
    return context.apply_context(s, cfg, context.product_reference(s.where("split = 'train'"), cfg, check=check), external, enabled, check)


def decided(s: DataFrame, check: bool = False) -> DataFrame:
    """Scored rows with the decisions of the default rules."""
    return RuleSet(DEFAULT).evaluate(discounted(s), keep=("split", "isFraud", "TransactionDT"), check=check)


def audited(s: DataFrame) -> DataFrame:
    """The later half of the validation rows; the earlier one is for choosing."""
    return ingest.halves(s.where("split = 'validation'"), check=False).where("not calibration")


def p(name: str, as_: str | None = None) -> Column:
    return printed(F.col(name)).alias(as_ or name)


# Joins, checks and parts


@query
def join_presence_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = ingest.audit(joined(spark, sf_dir))
    return a.withColumns({"identity_coverage": printed(F.col("identity_coverage")), "positive_rate": printed(F.col("positive_rate"))})


@query
def join_presence_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return joined(spark, sf_dir).select("TransactionID", "TransactionDT", "id_score", "has_identity")


@query
def orphan_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id", "left_anti").select("doc_id", "lang", "source")


@query
def labelled_semi(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars")
    return d.join(table(spark, sf_dir, "labels").where("toxic = 1"), "doc_id", "left_semi")


@query
def key_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null, repeated and distinct keys of the fact table, and values out of their domain."""
    t = src.transactions(spark, sf_dir)
    keys = t.groupBy("TransactionID").agg(F.count("*").alias("n"), F.sum((F.col("TransactionAmt") < 0).cast("long")).alias("neg"), F.sum(F.col("addr1").isNull().cast("long")).alias("gone"))
    return keys.agg(F.count("*").alias("keys"), F.sum(F.col("TransactionID").isNull().cast("long")).alias("null_keys"), F.sum((F.col("n") > 1).cast("long")).alias("repeated_keys"), F.sum("neg").alias("negative_amounts"), F.sum("gone").alias("incomplete_entities"))


@query
def split_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.chronological_split(src.transactions(spark, sf_dir), check=False)
    return s.groupBy("split").agg(F.count("*").alias("rows"), F.min("TransactionDT").alias("first_time"), F.max("TransactionDT").alias("last_time"))


@query
def split_ties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders by day: equal days never straddle a boundary."""
    s = ingest.chronological_split(src.order_transactions(spark, sf_dir), check=False)
    return s.groupBy("split").agg(F.count("*").alias("rows"), F.min("TransactionDT").alias("first_time"), F.max("TransactionDT").alias("last_time"))


@query
def split_halves(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.chronological_split(src.order_transactions(spark, sf_dir), check=False).where("split = 'validation'")
    return ingest.halves(s, check=False).groupBy("calibration").agg(F.count("*").alias("rows"), F.max("TransactionDT").alias("last_time"))


@query
def fold_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.chronological_split(src.order_transactions(spark, sf_dir), check=False)
    return ingest.folds(s, 3, 7.0).groupBy("fold", "part").agg(F.count("*").alias("rows"), F.min("TransactionDT").alias("first_time"), F.max("TransactionDT").alias("last_time"))


@query
def block_bucket_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ingest.blocks(src.transactions(spark, sf_dir), 24).groupBy("block").agg(F.count("*").alias("rows"), F.sum("isFraud").cast("long").alias("positives"))


# History


@query
def entity_prior_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).select("TransactionID", "prior_transaction_count", *map(p, ("prior_mean_amount", "prior_std_amount", "amount_to_prior_mean", "amount_zscore")))


@query
def velocity_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, 60).select("TransactionID", "prior_count_1h", "prior_count_24h")


@query
def recency_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir, 60).select("TransactionID", "seconds_since_previous", p("history_span_days"))


@query
def distinct_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).select("TransactionID", "prior_distinct_products", "prior_distinct_email_domains", "prior_distinct_devices")


@query
def novelty_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).select("TransactionID", "entity_product_is_new", "entity_email_is_new", "entity_device_is_new")


@query
def hour_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).select("TransactionID", p("entity_hour_probability"))


@query
def history_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    return entity(spark, sf_dir).select("TransactionID", "history_sufficient", "frequent_entity", "usual_amount")


@query
def calendar_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = keyed(spark, sf_dir)
    return k.select("TransactionID", "relative_day", "hour_phase", "hour", "day_of_week", "is_weekend", "is_business_hours", "email_domains_match", "entity_known", *map(p, ("hour_sin", "hour_cos", "log_amount")))


@query
def global_prefix_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir, 3600)
    return rows.join(history.global_counts(rows, cuts_of(rows, "TransactionDT")), "TransactionDT").select("TransactionID", "prior_global_count")


@query
def category_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir, 3600)
    names = ("product", "email", "device")
    found = history.frequencies(rows, cuts_of(rows, "TransactionDT"), names)
    return rows.select("TransactionID").join(found, "TransactionID", "left").select("TransactionID", *[p(f"{n}_prior_frequency") for n in names])


@query
def pair_support(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = keyed(spark, sf_dir, 3600)
    found = history.frequencies(rows, cuts_of(rows, "TransactionDT"), ("product_card", "email_pair"))
    return rows.select("TransactionID").join(found, "TransactionID", "left").select("TransactionID", "product_card_prior_support", "email_pair_prior_support", p("product_card_prior_frequency"), p("email_pair_prior_frequency"))


@query
def feature_null_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.null_ratios(feature_table(spark, sf_dir), ["prior_mean_amount", "prior_std_amount", "entity_device_is_new", "email_prior_frequency", "usual_amount"]).withColumn("null_ratio", printed(F.col("null_ratio")))


@query
def customer_day_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer strictly before the day: ties by day."""
    o = src.order_transactions(spark, sf_dir).withColumn("d", F.dense_rank().over(W.partitionBy("entity").orderBy("TransactionDT")))
    prior = W.partitionBy("entity").orderBy("d").rangeBetween(W.unboundedPreceding, -1)
    return o.select("TransactionID", F.count("*").over(prior).alias("prior_orders"), printed(F.avg("TransactionAmt").over(prior), 4).alias("prior_mean"))


# Profiles


@query
def column_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.column_profile(src.transactions(spark, sf_dir).select("card1", "addr1", "card4", "ProductCD", "P_emaildomain", "DeviceInfo", "isFraud")).withColumns({"null_ratio": printed(F.col("null_ratio")), "unique_ratio": printed(F.col("unique_ratio"))})


@query
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.transactions(spark, sf_dir).select("TransactionAmt", "card2", "addr1")
    out = profile.numeric_profile(t, ["TransactionAmt", "card2", "addr1"])
    return out.select("column", "finite_count", "infinite_count", "zero_iqr", *map(p, ("min", "max", "mean", "std", "p01", "p25", "median", "p75", "p99", "iqr", "outlier_ratio")))


@query
def category_topn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.category_frequency(src.transactions(spark, sf_dir), "DeviceInfo")


@query
def rare_combos(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rare_combinations(src.transactions(spark, sf_dir), "R_emaildomain", "DeviceInfo", 95)


@query
def rare_combo_examples(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.rare_examples(src.transactions(spark, sf_dir), "R_emaildomain", "DeviceInfo", 95)


@query
def spearman_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.transactions(spark, sf_dir)
    return profile.spearman(t, [("TransactionAmt", "card1"), ("card1", "addr1"), ("TransactionDT", "TransactionAmt")]).withColumn("rho", printed(F.col("rho")))


@query
def spearman_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The three strongest pairs of four columns."""
    t = src.transactions(spark, sf_dir).select("TransactionAmt", "card1", "addr1", "TransactionDT", F.lit(1.0).alias("constant"), F.when(F.col("TransactionID") % 50 == 0, F.col("card1")).alias("sparse"))
    return profile.spearman_top(t, ["TransactionAmt", "card1", "addr1", "TransactionDT", "constant", "sparse"], most=3).withColumn("rho", printed(F.col("rho")))


@query
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = profile.entity_profile(src.transactions(spark, sf_dir), ENTITY)
    return e.select("card1", "transactions", p("mean_amount"), p("std_amount"), "first_time", "last_time", "products", "email_domains", "active_days")


@query
def gap_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = profile.entity_summary(src.transactions(spark, sf_dir, 3600), ENTITY)
    return s.select("eligible_rows", "excluded_rows", "entities", "singletons", p("size_p50"), p("size_p90"), p("size_p99"), p("median_gap"), "zero_gaps")


@query
def entity_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.entity_gaps(src.transactions(spark, sf_dir), ENTITY)


@query
def daily_volume(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = src.transactions(spark, sf_dir)
    return t.groupBy(F.floor(F.col("TransactionDT") / 86400).alias("day")).agg(F.count("*").alias("rows"), printed(F.sum("TransactionAmt"), 2).alias("amount"))


@query
def part_supply_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Group statistics through a fact and two dimension joins."""
    li, pa, su = (table(spark, sf_dir, n) for n in ("lineitem", "part", "supplier"))
    j = li.select("l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").join(pa.select("p_partkey", "p_brand"), F.col("l_partkey") == F.col("p_partkey")).join(su.select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    n = table(spark, sf_dir, "nation").join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return j.join(n, F.col("s_nationkey") == F.col("n_nationkey")).groupBy("r_name", "p_brand").agg(F.count("*").alias("rows"), F.sum("l_quantity").alias("quantity"), printed(F.sum("l_extendedprice"), 2).alias("price"))


# Layers and scores


@query
def robust_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.chronological_split(src.transactions(spark, sf_dir), check=False).where("split = 'train'")
    named = layers.robust(s, {"amount": F.log1p("TransactionAmt"), "addr": F.col("addr1")})
    one = lambda n, c: F.max(F.when(F.col("name") == n, F.col(c))).alias(f"{n}_{c}")
    return named.agg(*[one(n, c) for n in ("amount", "addr") for c in ("centre", "scale")]).select(*map(p, ("amount_centre", "amount_scale", "addr_centre", "addr_scale")))


@query
def column_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("TransactionID", p("column_raw"))


@query
def entity_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("TransactionID", p("entity_amount_deviation"), "entity_relation_novelty", p("entity_raw"))


@query
def temporal_layer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("TransactionID", *map(p, ("temporal_velocity_1h", "temporal_velocity_24h", "temporal_hour_rarity", "temporal_raw")))


@query
def strict_rank_norm(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = ingest.chronological_split(src.transactions(spark, sf_dir), check=False)
    return strict_rank(t.where("split = 'train'"), t, "TransactionAmt", "rank").select("TransactionID", "split", p("rank"))


@query
def aggregate_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("TransactionID", *map(p, ("available_weight", *(f"{x}_normalized" for x in told()), "column_effective_weight", "entity_contribution", "raw_anomaly_score")))


@query
def score_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    q = quantiles(s, "raw_anomaly_score", [0.5, 0.9, 0.99], ("split",)).select("split", "q")
    by = s.groupBy("split").agg(F.avg(F.col("entity_available").cast("double")).alias("entity_coverage"), F.avg(F.col("temporal_available").cast("double")).alias("temporal_coverage"), F.avg(F.col("multivariate_available").cast("double")).alias("multivariate_coverage")).join(q, "split")
    return by.select("split", *[printed(F.col("q")[i]).alias(n) for i, n in enumerate(("q50", "q90", "q99"))], p("entity_coverage"), p("temporal_coverage"), p("multivariate_coverage"))


@query
def contribution_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    total = sum((F.col(f"{x}_contribution") for x in layers.LAYERS[1:]), F.col("column_contribution"))
    off = (F.abs(total - F.col("raw_anomaly_score")) > 1e-9).cast("long")
    return scored(spark, sf_dir).agg(F.count("*").alias("rows"), F.sum(off).alias("unequal_sums"), F.sum((~F.col("raw_anomaly_score").between(0, 1)).cast("long")).alias("out_of_range"))


@query
def forest_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The multivariate layer by the isolation forest."""
    f = keep(feature_table(spark, sf_dir), "features")
    grown = forest.fit(f.where("split = 'train'"))
    return f.select("TransactionID", "split", forest.scores(grown).alias("multivariate_raw"))


# Context


@query
def product_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir).where("split = 'train'")
    return context.product_reference(s, small_context(), check=False).select("ProductCD", "support", p("lower"), p("upper"))


@query
def context_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discounted(scored(spark, sf_dir), check=True).select("TransactionID", "context_guard_active", *[f"context_match_{r}" for r in context.RULES])


@query
def context_discounts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = discounted(scored(spark, sf_dir))
    return d.select("TransactionID", *[p(f"context_{x}_reduction") for x in told()], "context_column_reason", "context_temporal_reason")


@query
def context_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return discounted(scored(spark, sf_dir)).select("TransactionID", *map(p, ("raw_anomaly_score", "context_reduction", "adjusted_anomaly_score")))


@query
def context_ablation(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = discounted(scored(spark, sf_dir), enabled=frozenset({"business_hours"}))
    return d.select("TransactionID", p("context_reduction"), "context_temporal_reason")


@query
def product_risk(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scored(spark, sf_dir)
    train = s.where("split = 'train'")
    facts = train.agg(F.avg("isFraud").alias("g"), F.max("TransactionDT").alias("t")).first()
    policy = context.ProductRisk(facts["g"], facts["t"], prior=100, support=100)
    out = context.apply_product_risk(s, context.risk_profiles(train, policy), policy, small_context())
    return out.select("TransactionID", "product_context_available", "product_context_reduction_blocked", *map(p, ("product_context_log_relative_risk", "product_context_adjustment", "adjusted_anomaly_score")))


# Rules


@query
def rule_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(scored(spark, sf_dir, RULED), check=True).select("TransactionID", "matched_rule_count", *[f"rule_match_{r.id}" for r in RuleSet(DEFAULT).rules])


@query
def rule_decisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decided(scored(spark, sf_dir, RULED)).select("TransactionID", "split", "rule_action", "winning_rule", "winning_priority", "matched_rule_count", "rule_action_conflict")


@query
def rule_activity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Matches of each rule, those in the audit half of validation, and rows that it decides."""
    d = decided(scored(spark, sf_dir, RULED))
    (cut,) = ingest.boundaries(d.where("split = 'validation'"), [0.5])
    audit = F.coalesce((F.col("split") == "validation") & (F.col("TransactionDT") >= cut), F.lit(False)).alias("audit")
    cells = d.select("winning_rule", audit, F.explode(F.array(*[F.struct(F.lit(r.id).alias("rule"), F.col(f"rule_match_{r.id}").alias("hit")) for r in RuleSet(DEFAULT).rules])).alias("x"))
    return cells.groupBy(F.col("x.rule").alias("rule")).agg(
        F.sum(F.col("x.hit").cast("long")).alias("matches"), profile.counted(F.col("x.hit") & F.col("audit")).alias("audit_matches"), profile.counted(F.coalesce(F.col("winning_rule") == F.col("x.rule"), F.lit(False))).alias("wins")
    )


@query
def action_transitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How actions change between the undiscounted and the discounted scores, by split."""
    s = scored(spark, sf_dir, RULED)
    old = RuleSet(DEFAULT).evaluate(discounted(s, small_context().at(0.0)), keep=("split",)).select("TransactionID", "split", F.col("rule_action").alias("old_action"))
    new = decided(s).select("TransactionID", F.col("rule_action").alias("new_action"))
    return old.join(new, "TransactionID").groupBy("split", "old_action", "new_action").agg(F.count("*").alias("rows"))


@query
def decision_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = evaluate.confusion(decided(scored(spark, sf_dir, RULED)).where("split <> 'train'"), F.col("rule_action") == "review")
    return d.select("alerts", "tp", "fp", "fn", "tn", p("precision"), p("recall"), p("fpr"))


# Evaluation


@query
def confusion_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.at_threshold(labelled(spark, sf_dir), "score", 2000.0).select("alerts", "tp", "fp", "fn", "tn", p("precision"), p("recall"), p("fpr"))


@query
def confusion_budget(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return evaluate.at_budget(df, "other", evaluate.budget(df.count(), 0.05)).select("alerts", "tp", "fp", "fn", "tn", p("precision"), p("recall"), p("fpr"))


@query
def budget_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return evaluate.top_k(df, "other", evaluate.budget(df.count(), 0.1)).select("TransactionID", "other", "isFraud")


@query
def budget_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of two rankings at several budgets, in one pass over ranked rows."""
    df = labelled(spark, sf_dir)
    n = df.count()
    out = None
    for score in ("score", "other"):
        for rate in (0.01, 0.05, 0.1):
            one = evaluate.top_k(df, score, evaluate.budget(n, rate)).agg(F.lit(score).alias("ranking"), F.lit(rate).alias("rate"), F.count("*").alias("reviews"), profile.counted(F.col("isFraud") == 1).alias("hits"))
            out = one if out is None else out.unionByName(one)
    return out


@query
def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(labelled(spark, sf_dir), "other").select(p("average_precision"))


@query
def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.ranking_metrics(labelled(spark, sf_dir), "score").select(p("roc_auc"))


@query
def paired_effect(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = discounted(scored(spark, sf_dir)).where("split = 'validation'").withColumns({c: F.round(c, 9) for c in ("raw_anomaly_score", "adjusted_anomaly_score")})
    return evaluate.paired_effect(d, "raw_anomaly_score", "adjusted_anomaly_score", 0.7)


@query
def break_even_ratios(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a missed case may cost before the discounts stop paying, by split and at three thresholds."""
    d = discounted(scored(spark, sf_dir)).withColumns({c: F.round(c, 9) for c in ("raw_anomaly_score", "adjusted_anomaly_score")}).select("split", "isFraud", "raw_anomaly_score", "adjusted_anomaly_score")
    d = keep(d, "discounted")
    out = None
    for split in ("train", "validation", "test"):
        for threshold in (0.5, 0.7, 0.9):
            one = evaluate.break_even_ratios(d.where(F.col("split") == split), "raw_anomaly_score", "adjusted_anomaly_score", threshold).withColumns({"split": F.lit(split), "threshold": F.lit(threshold)})
            out = one if out is None else out.unionByName(one)
    return out.withColumns({c: p(c) for c in ("false_positive_cost_only", "every_review_costs", "partial_prevention")})


@query
def higher_quantile_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    return df.agg(F.lit(higher_quantile(df, "score", 0.95)).alias("threshold"), profile.counted(F.col("score") >= F.lit(higher_quantile(df, "score", 0.95))).alias("alerts"))


@query
def equal_volume_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = labelled(spark, sf_dir)
    threshold, alerts = evaluate.equal_volume_threshold(df, "other", 25)
    return df.agg(F.lit(threshold).alias("threshold"), F.lit(alerts).cast("long").alias("alerts"))


@query
def strength_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strengths compared in one pass: the reduction scales with the strength before its caps."""
    d = discounted(scored(spark, sf_dir)).where("split = 'validation'")
    strengths = F.array(*[F.lit(x) for x in (0.0, 0.25, 0.5, 1.0)])
    each = d.select("isFraud", "raw_anomaly_score", "context_reduction", F.explode(strengths).alias("strength")).withColumn("score", F.round(F.col("raw_anomaly_score") - F.col("strength") * F.col("context_reduction"), 9))
    return evaluate.select_strength(each, 0.7, 0.01).withColumn("recall_drop", printed(F.col("recall_drop")))


#: Candidate weights of column, multivariate, entity and temporal layer; the first is what others are held against.
WEIGHTS = {
    "equal": (0.25, 0.25, 0.25, 0.25),
    "column_emphasis": (0.55, 0.15, 0.15, 0.15),
    "multivariate_emphasis": (0.15, 0.55, 0.15, 0.15),
    "entity_emphasis": (0.15, 0.15, 0.55, 0.15),
    "temporal_emphasis": (0.15, 0.15, 0.15, 0.55),
    "multivariate_entity": (0.10, 0.40, 0.40, 0.10),
    "entity_temporal": (0.10, 0.10, 0.40, 0.40),
    "multivariate_temporal": (0.10, 0.40, 0.10, 0.40),
    "behavior_emphasis": (0.10, 0.30, 0.30, 0.30),
}
#: Share of the rows that is reviewed.
RATE = 0.05


def weighted(weights: dict[str, Column]) -> Column:
    """The score of a row under weights of the layers it has."""
    there = lambda x: F.when(F.col(f"{x}_normalized").isNotNull(), weights[x]).otherwise(0.0)
    top = [there(x) * F.coalesce(f"{x}_normalized", F.lit(0.0)) for x in weights]
    return F.round(ratio(sum(top[1:], top[0]), sum((there(x) for x in list(weights)[1:]), there(next(iter(weights))))), 9)


@query
def weight_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The candidate weights by their smallest gain in hits over the two halves of early validation, then all hits, then average precision."""
    s = ingest.halves(scored(spark, sf_dir).where("split = 'validation'"), check=False).where("calibration").drop("calibration")
    s = ingest.halves(s, check=False).withColumn("part", F.when(F.col("calibration"), "first").otherwise("second"))
    names = told()
    cand = F.array(*[F.struct(F.lit(i).alias("place"), F.lit(n).alias("candidate"), *[F.lit(dict(zip(layers.LAYERS, w, strict=True))[x]).alias(x) for x in names]) for i, (n, w) in enumerate(WEIGHTS.items())])
    each = s.select("TransactionID", "isFraud", "part", *[f"{x}_normalized" for x in names], F.explode(cand).alias("w"))
    each = each.select("TransactionID", "isFraud", "part", F.col("w.place").alias("place"), F.col("w.candidate").alias("candidate"), weighted({x: F.col(f"w.{x}") for x in names}).alias("score"))
    each = keep(each, "candidates")
    group = ("place", "candidate", "part")
    hits = evaluate.hits_at(each, group, "score", RATE).unionByName(evaluate.hits_at(each.withColumn("part", F.lit("both")), group, "score", RATE))
    of = lambda part: F.max(F.when(F.col("part") == part, F.col("hits"))).alias(part)
    by = hits.groupBy("place", "candidate").agg(*map(of, ("first", "second", "both"))).join(evaluate.ranking_metrics(each, "score", by=("place", "candidate")), ["place", "candidate"])
    base = F.broadcast(by.where("place = 0").select(F.col("first").alias("_a"), F.col("second").alias("_b")))
    by = by.crossJoin(base).withColumns({"minimum_gain": F.least(F.col("first") - F.col("_a"), F.col("second") - F.col("_b")), "precise": F.round("average_precision", 9)})
    # One row a candidate, a handful.
    order = W.partitionBy().orderBy(F.col("minimum_gain").desc(), F.col("both").desc(), F.col("precise").desc(), "place")
    return by.select("candidate", "minimum_gain", F.col("both").alias("hits"), p("average_precision"), (F.row_number().over(order) == 1).alias("chosen"))


@query
def layer_contribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits within the budget in the audit half, of all layers, each alone, and all but one; unscored rows come last."""
    names = told()
    s = audited(scored(spark, sf_dir)).select("TransactionID", "isFraud", *[f"{x}_normalized" for x in names])
    rankings = {"raw": names} | {f"only_{x}": [x] for x in names} | {f"without_{x}": [y for y in names if y != x] for x in names}
    cells = F.array(*[F.struct(F.lit(n).alias("ranking"), weighted({x: F.lit(1.0) for x in own}).alias("score")) for n, own in rankings.items()])
    each = keep(s.select("TransactionID", "isFraud", F.explode(cells).alias("c")).select("TransactionID", "isFraud", "c.ranking", F.coalesce("c.score", F.lit(-1.0)).alias("score")), "rankings")
    unscored = each.groupBy("ranking").agg(profile.counted(F.col("score") < 0).alias("unscored"))
    return evaluate.hits_at(each, ("ranking",), "score", RATE).join(unscored, "ranking")


@query
def compare_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Raw and adjusted scores at one threshold and at one budget, and what changes between them."""
    d = audited(discounted(scored(spark, sf_dir))).select("TransactionID", "isFraud", *[F.round(c, 9).alias(c) for c in ("raw_anomaly_score", "adjusted_anomaly_score")])
    return evaluate.compare(keep(d, "compared"), "raw_anomaly_score", "adjusted_anomaly_score", 0.7, RATE)


@query
def coverage_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hits of both scores at several budgets, among all audit rows and those with and without the entity's history."""
    d = audited(discounted(scored(spark, sf_dir)))
    groups = F.array(F.lit("all"), F.when(F.col("entity_available"), "with_history").otherwise("without_history"))
    cells = F.array(*[F.struct(F.lit(n).alias("ranking"), F.round(c, 9).alias("score")) for n, c in (("raw", "raw_anomaly_score"), ("adjusted", "adjusted_anomaly_score"))])
    each = d.select("TransactionID", "isFraud", F.explode(groups).alias("coverage"), cells.alias("c")).withColumn("c", F.explode("c")).select("TransactionID", "isFraud", "coverage", "c.ranking", "c.score")
    each = keep(each, "coverage")
    out = [evaluate.hits_at(each, ("ranking", "coverage"), "score", rate).withColumn("rate", F.lit(rate)) for rate in (0.01, 0.05, 0.1)]
    return out[0].unionByName(out[1]).unionByName(out[2])


@query
def context_external(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Context with external evidence: some entities are trusted and some weekends planned, observed before the row or not."""
    s = scored(spark, sf_dir)
    t, i = F.col("TransactionDT"), F.col("TransactionID")
    external = s.select(
        "TransactionID", (i % 3 == 0).alias("trusted_entity"), F.greatest(t + i % 7 - 3, F.lit(0.0)).alias("trust_observed_at"), F.lit("desk").alias("trust_source"),
        (i % 2 == 0).alias("weekend_activity_expected"), F.greatest(t - 1, F.lit(0.0)).alias("schedule_observed_at"), F.lit("roster").alias("schedule_source"),
    )
    d = discounted(s, external=external, check=True)
    return d.select("TransactionID", "context_match_verified_trust", "context_match_expected_weekend", "context_trust_available", "context_weekend_schedule_available", "context_temporal_reason", p("context_reduction"), p("adjusted_anomaly_score"))


@query
def validated_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The checked and joined input as it is written by split: rows, rows with identity and positives of each."""
    path, _ = experiment.prepare(spark, src.transactions(spark, sf_dir), src.identities(spark, sf_dir))
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("rows"), profile.counted(F.col("has_identity")).alias("identity_rows"), F.sum("isFraud").cast("long").alias("positives"))


@query
def score_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with what a file of scores has for it, or null."""
    return table(spark, sf_dir, "documents").select("doc_id", "lang").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "left")


@query
def overlap_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return evaluate.overlap(labelled(spark, sf_dir), "score", "other", 0.1)


@query
def fold_disjointness(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit windows of the folds: rows covered, rows covered twice, rows missed."""
    s = ingest.chronological_split(src.order_transactions(spark, sf_dir), check=False)
    audit = ingest.folds(s, 3, 0.0).where("part = 'audit'").groupBy("TransactionID").agg(F.count("*").alias("n"))
    rows = s.where("split = 'validation'").select("TransactionID").join(audit, "TransactionID", "left")
    return rows.agg(F.count("n").alias("covered"), profile.counted(F.coalesce(F.col("n") > 1, F.lit(False))).alias("twice"), profile.counted(F.col("n").isNull()).alias("missed"))


@query
def hybrid_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 20 places of each source, in turns of two rankings."""
    return ranking.hybrid_ranking(labelled(spark, sf_dir).withColumn("fold", F.col("source")), "score", "other", 0.5, 20)


@query
def block_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = ingest.blocks(scored(spark, sf_dir).where("split = 'validation'"), 12).select("TransactionID", "isFraud", "block", F.coalesce("column_normalized", F.lit(-1.0)).alias("column"), "raw_anomaly_score")
    return evaluate.block_bootstrap(s, "column", "raw_anomaly_score", 0.05, 200, check=True)


@query
def row_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gap in hits between two rankings of labelled documents, and its interval."""
    return evaluate.row_bootstrap(labelled(spark, sf_dir), "score", "other", 0.1, 400, check=True)


@query
def supervised_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Validation rows by a ranker of each kind on all features that vary in training."""
    f = keep(feature_table(spark, sf_dir), "features")
    train, out = f.where("split = 'train'"), f.where("split = 'validation'")
    names = experiment.input_sets(train)["full"]
    for kind in ("logistic", "boosted"):
        out = evaluate.supervised_scores(train, out, names, kind=kind, name=kind)
    return out.select("TransactionID", "isFraud", "logistic", "boosted")


@query
def walk_forward(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two folds, labels a day late, with all input sets; boosting on the matched one, which the hybrid takes."""
    rankers = (("full", "logistic"), ("without_time", "logistic"), ("matched", "logistic"), ("matched", "boosted"))
    return experiment.walk_forward(keep(feature_table(spark, sf_dir), "features"), experiment.Protocol(2, 1.0, rankers=rankers, resamples=100))


# Retrieval, streaming, scenarios


@query
def cosine_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors to the first vector's, of at least 0.05."""
    e = table(spark, sf_dir, "embeddings")
    q = e.where("vec_id = 0").first()["embedding"]
    return retrieval.top_similar(e, q, 5, 0.05).select("vec_id", "label", p("similarity"))


@query
def cosine_topk_each(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five nearest vectors of every vector whose id is divisible by 50, among all."""
    e = table(spark, sf_dir, "embeddings")
    found = retrieval.top_similar_each(e, e.where("vec_id % 50 = 0"), 5)
    return found.select("query_id", "vec_id", "place", p("similarity"))


@query
def vector_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    return e.groupBy("label").agg(F.count("*").alias("rows"), printed(F.avg(retrieval.norm(F.col("embedding"))), 4).alias("mean_norm"))


def streamed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History features of the events as a stateful stream, replayed in files of whole times."""
    from driftwell.streaming.history import history_stream, replay

    root = folder(spark, "stream")
    stream = history_stream(replay(src.transactions(spark, sf_dir, 3600), f"{root}/in", 4), ENTITY)
    run = stream.writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{root}/out")


def _streamed_columns() -> list[Column | str]:
    return ["TransactionID", "late", "prior_transaction_count", *map(p, ("prior_mean_amount", "prior_std_amount")), "prior_count_1h", "prior_count_24h", "seconds_since_previous", "prior_distinct_products", "entity_product_is_new", p("entity_hour_probability")]


@query
def stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed features of every event, with null ones where the entity is unknown; full_stream_history has all relations."""
    return streamed(spark, sf_dir).select(*_streamed_columns())


@query
def full_stream_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Streamed features of every event, of all relations, with null ones where the entity is unknown."""
    return streamed(spark, sf_dir).select(*_streamed_columns(), p("history_span_days"), "prior_distinct_email_domains", "entity_email_is_new", "prior_distinct_devices", "entity_device_is_new")


#: What the scenarios change: the amount's factor, more transactions within the hour, trust and calendar.
AMOUNTS, PACES, TRUST, CALENDARS = (0.5, 1.0, 1.5, 3.0), (0, 5, 12), ("none", "before"), ("weekday", "weekend_planned")


def _changes(factor: Column, pace: Column, weekday: Column) -> dict[str, Column]:
    """The features of a row that a scenario changes."""
    amount, usual = F.col("amount") * factor, F.col("prior_mean_amount")
    relative = F.when(usual > 0, ratio(amount, usual))
    return {
        "amount": amount, "log_amount": F.log1p(amount), "amount_to_prior_mean": relative, "prior_count_1h": F.col("prior_count_1h") + pace, "prior_count_24h": F.col("prior_count_24h") + pace,
        "calendar_available": F.lit(1.0), "is_business_hours": F.when(weekday, 1.0).otherwise(0.0), "is_weekend": F.when(weekday, 0.0).otherwise(1.0),
        "usual_amount": F.when(F.col("prior_transaction_count") >= 5, flag(relative.between(2 / 3, 1.5))),
    }


def _evidence() -> dict[str, Column]:
    """The external evidence of a row under its scenario."""
    before = F.greatest(F.col("TransactionDT") - 1, F.lit(0.0))
    return {"trusted_entity": F.col("g_trust") == "before", "trust_observed_at": before, "trust_source": F.lit("desk"), "weekend_activity_expected": F.col("g_calendar") == "weekend_planned", "schedule_observed_at": before, "schedule_source": F.lit("roster")}


#: The amounts and paces that change a layer: it has the same value under all scenarios of one of them, whatever else they change.
_CHANGING = {"column": (AMOUNTS, (0,)), "multivariate": (AMOUNTS, PACES), "entity": (AMOUNTS, (0,)), "temporal": ((1.0,), PACES)}


def _named(layer: str, kind: str, amount: float, pace: int) -> str:
    """The column that has a layer's value under the scenarios of an amount and a pace."""
    amounts, paces = _CHANGING[layer]
    return f"{layer}_{kind}_{amounts.index(amount) if len(amounts) > 1 else 0}_{paces.index(pace) if len(paces) > 1 else 0}"


def scenarios(s: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Features of every row of ``s`` under all scenarios, as rows of their own, and the external evidence of those.

    Numbered from the row's id, so that every one is a transaction.  Where ``s`` has columns of layers by amount and pace, a row
    gets those of its scenario.
    """
    grid = [(a, b, c, d) for a in AMOUNTS for b in PACES for c in TRUST for d in CALENDARS]
    held = [(x, kind) for x in layers.LAYERS for kind in ("raw", "normalized") if _named(x, kind, 1.0, 0) in s.columns]
    cells = F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(a).alias("g_amount"), F.lit(b).alias("g_pace"), F.lit(c).alias("g_trust"), F.lit(d).alias("g_calendar")) for i, (a, b, c, d) in enumerate(grid)])
    given = {"TransactionID": F.col("TransactionID") * len(grid) + F.col("_i")}
    for x, kind in held:
        amounts, paces = _CHANGING[x]
        own = {_named(x, kind, a, b): [F.col(f"g_{c}") == v for c, v, some in (("amount", a, amounts), ("pace", b, paces)) if len(some) > 1] for a in amounts for b in paces}
        given[f"{x}_{kind}"] = reduce(lambda out, n: out.when(every(own[n]), F.col(n)), own, F)
    each = s.select("*", F.inline(cells)).withColumns(_changes(F.col("g_amount"), F.col("g_pace"), F.col("g_calendar") == "weekday") | given)
    each = each.drop("_i", *{_named(x, kind, a, b) for x, kind in held for a in AMOUNTS for b in PACES})
    return each, each.select("TransactionID", *[c.alias(n) for n, c in _evidence().items()])


def _apart(c: Column) -> Column:
    """``c``, worked out in a step of its own: Spark puts a row's whole way into one method, which the JVM runs uncompiled beyond 8,000 bytes.

    Functions with a lambda have no compiled form, so the method ends before this step and another begins behind it.
    """
    return F.transform(F.array(c), lambda x: x)[0]


@query
def scenario_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every validation row under 48 what-if changes of amount, pace, trust and calendar: scored, ranked and discounted anew, by scenario.

    What is ranked and travels is a row's different values of each layer.  The rows of all scenarios are made from them last, and
    each is added up where it is made.
    """
    features = keep(feature_table(spark, sf_dir, history.FEATURES if _FOREST.get() else PLAIN), "features")
    train = features.where("split = 'train'")
    references, grown = layers.fit_references(train, check=False), forest.fit(train) if _FOREST.get() else None
    known = keep(layers.raw_layers(train, references, grown and forest.scores(grown)).select(*[f"{x}_raw" for x in told()]), "known")
    changes = lambda a, b: _changes(F.lit(a), F.lit(b), F.lit(True))
    cases = {_named(x, "raw", a, b): (x, a, b) for x in told() for a in _CHANGING[x][0] for b in _CHANGING[x][1]}
    raw = {n: layers.raw_values(references, changes(a, b))[f"{x}_raw"] for n, (x, a, b) in cases.items() if x != "multivariate"}
    isolated = {n: (a, b) for n, (x, a, b) in cases.items() if x == "multivariate"}
    rows = features.where("split = 'validation'")
    if grown:
        rows = rows.withColumn("_isolated", forest.scores_each(grown, [changes(a, b) for a, b in isolated.values()]))
        raw |= {n: F.col("_isolated")[i] for i, n in enumerate(isolated)}
    rows = keep(rows.withColumns(raw).drop("_isolated"), "raw")
    ranked = strict_ranks(known, rows, {n: n.replace("_raw_", "_normalized_") for n in cases}, among={n: f"{x}_raw" for n, (x, _, _) in cases.items()})
    each, _ = scenarios(ranked)
    each = layers.combined(each.withColumns({"g_amount": _apart(F.col("g_amount"))} | {f"{x}_normalized": F.lit(None).cast("double") for x in layers.LAYERS if x not in told()}))
    each, cfg = each.withColumn("raw_anomaly_score", _apart(F.col("raw_anomaly_score"))), small_context()
    out = context.apply_context(each, cfg, context.product_reference(train, cfg, check=False), _evidence())
    group = ["g_amount", "g_pace", "g_trust", "g_calendar"]
    return out.groupBy(*group).agg(F.count("*").alias("rows"), printed(F.avg("raw_anomaly_score")).alias("mean_raw"), printed(F.avg("adjusted_anomaly_score")).alias("mean_adjusted"), profile.counted(F.col("context_guard_active")).alias("guarded"), profile.counted(F.col("context_match_verified_trust")).alias("trusted"), profile.counted(F.col("context_match_expected_weekend")).alias("planned"))


# The same on all four layers; SQL can't grow the forest

for _f in (
    aggregate_available, score_quantiles, contribution_audit, context_guard, context_discounts, context_capped, context_ablation, product_risk, rule_matches, rule_decisions,
    rule_activity, action_transitions, decision_metrics, paired_effect, compare_scores, coverage_sensitivity, context_external, strength_selection, weight_search,
    layer_contribution, block_bootstrap, scenario_grid,
):
    query(full(_f))
