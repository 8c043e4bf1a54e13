"""Context discounts on anomaly scores: guarded, capped, one reason a layer; and the product-risk term."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace
from math import isfinite, log

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.columns import held
from driftwell.operators import validate
from driftwell.operators.layers import LAYERS
from driftwell.operators.prefix import quantiles


@dataclass(frozen=True)
class Context:
    """Fixed values of the default policy."""

    strength: float = 1.0
    max_absolute_reduction: float = 0.05
    max_relative_reduction: float = 0.15
    minimum_prior_count: int = 20
    stable_ratio_min: float = 0.8
    stable_ratio_max: float = 1.25
    stable_entity_deviation_max: float = 1.0
    guard_entity_deviation: float = 3.0
    guard_multivariate_rank: float = 0.98
    guard_hourly_count: int = 10
    frequent_temporal_discount: float = 0.20
    familiar_amount_discount: float = 0.15
    business_hours_discount: float = 0.10
    expected_weekend_discount: float = 0.10
    trusted_entity_discount: float = 0.10
    product_amount_discount: float = 0.10
    product_minimum_support: int = 1000
    product_lower_quantile: float = 0.10
    product_upper_quantile: float = 0.90
    high_amount_rank: float = 0.90

    def __post_init__(self) -> None:
        shares = [f.name for f in fields(self) if f.name.endswith("_discount") or f.name in ("strength", "max_absolute_reduction", "max_relative_reduction", "guard_multivariate_rank", "high_amount_rank")]
        refused = [n for n in shares if not (isfinite(getattr(self, n)) and 0 <= getattr(self, n) <= 1)]
        if refused or not all(isfinite(getattr(self, f.name)) for f in fields(self)):
            raise ValueError(f"context parameters out of [0, 1] or not finite: {refused}")
        sound = (
            self.minimum_prior_count >= 5, self.guard_hourly_count >= 1, 0 < self.stable_ratio_min <= 1 <= self.stable_ratio_max,
            0 <= self.stable_entity_deviation_max < self.guard_entity_deviation, self.product_minimum_support >= 1, 0 <= self.product_lower_quantile < self.product_upper_quantile <= 1,
        )
        if not all(sound):
            raise ValueError("context parameters contradict each other")

    def at(self, strength: float) -> Context:
        return replace(self, strength=strength)


#: Rule, the layer it discounts, and its rate; of rules on one layer the largest discount wins, and of equal ones the first.
RULES = {
    "product_typical_amount": ("column", "product_amount_discount"),
    "frequent_familiar_activity": ("temporal", "frequent_temporal_discount"),
    "familiar_high_amount": ("column", "familiar_amount_discount"),
    "business_hours": ("temporal", "business_hours_discount"),
    "expected_weekend": ("temporal", "expected_weekend_discount"),
    "verified_trust": ("multivariate", "trusted_entity_discount"),
}


def product_reference(train: DataFrame, cfg: Context = Context(), check: bool = True) -> DataFrame:
    """(ProductCD, support, lower, upper): the usual amounts of products with enough training rows."""
    if check:
        validate.training_only(train)
    by = quantiles(train.where("ProductCD is not null"), "amount", [cfg.product_lower_quantile, cfg.product_upper_quantile], ("ProductCD",)).where(F.col("n") >= cfg.product_minimum_support)
    return by.select("ProductCD", F.col("n").alias("support"), F.col("q")[0].alias("lower"), F.col("q")[1].alias("upper"))


def with_external(scored: DataFrame, external: DataFrame | dict[str, Column] | None, check: bool = True) -> DataFrame:
    """Adds _trusted and _weekend_expected: evidence of a named source, observed strictly before the transaction.

    Evidence is a table by TransactionID, or columns of the rows themselves, which need no join.
    """
    if external is None:
        return scored.withColumns({"_trusted": F.lit(False), "_weekend_expected": F.lit(False)})
    sets = {"_trusted": ("trusted_entity", "trust_observed_at", "trust_source"), "_weekend_expected": ("weekend_activity_expected", "schedule_observed_at", "schedule_source")}
    allowed = {"TransactionID", *(c for names in sets.values() for c in names)}
    own = external if isinstance(external, dict) else None
    if own is not None:
        external = scored.select("TransactionID", *[c.alias(n) for n, c in own.items()])
    if set(external.columns) - allowed:
        raise ValueError(f"unexpected context fields: {sorted(set(external.columns) - allowed)}")
    if check:
        validate.unique_key(external, "TransactionID")
    evidence = external if own is None else scored.withColumns({f"_own_{n}": c for n, c in own.items()})
    at = "" if own is None else "_own_"
    for name, (flag, time, source) in sets.items():
        if flag not in external.columns:
            evidence = evidence.withColumns({name: F.lit(False), f"{name}_at": F.lit(None).cast("double")})
            continue
        if check:
            validate.external_evidence(external, flag, time, source)
        evidence = evidence.withColumns({name: held(F.col(at + flag)), f"{name}_at": F.col(at + time).cast("double")})
    # A row a transaction at most: merged, for Spark takes what an explode makes for no larger than its input, and would broadcast it.
    joined = evidence.drop(*[f"_own_{n}" for n in own]) if own is not None else scored.join(evidence.select("TransactionID", *(c for n in sets for c in (n, f"{n}_at"))).hint("merge"), "TransactionID", "left")
    return joined.withColumns({n: held(F.col(n) & (F.col(f"{n}_at") < F.col("TransactionDT"))) for n in sets}).drop(*(f"{n}_at" for n in sets))


def guard(cfg: Context) -> Column:
    """Signs too strong to be discounted."""
    new = [F.col(f"entity_{x}_is_new") == 1 for x in ("product", "email", "device")]
    signs = [F.col("entity_raw") >= cfg.guard_entity_deviation, F.col("multivariate_normalized") >= cfg.guard_multivariate_rank, F.col("prior_count_1h") >= cfg.guard_hourly_count, *new]
    out = F.lit(False)
    for s in signs:
        out = out | held(s)
    return out


def stable(cfg: Context) -> Column:
    # Rounded: a mean's last bits depend on the order of its sum, and amounts in cents do come exactly to the bounds.
    return held(
        (F.col("prior_transaction_count") >= cfg.minimum_prior_count) & (F.col("usual_amount") == 1) & F.round("amount_to_prior_mean", 9).between(cfg.stable_ratio_min, cfg.stable_ratio_max)
        & (F.col("entity_raw") <= cfg.stable_entity_deviation_max) & (F.col("entity_product_is_new") == 0) & ~F.col("context_guard_active")
    )


def apply_context(scored: DataFrame, cfg: Context = Context(), reference: DataFrame | None = None, external: DataFrame | dict[str, Column] | None = None, enabled: frozenset[str] | None = None, check: bool = False) -> DataFrame:
    """Adds the rules' matches, each layer's reduction, reason and contribution, and the adjusted score."""
    enabled = frozenset(RULES) if enabled is None else enabled
    if enabled - set(RULES):
        raise ValueError(f"unknown context rules: {sorted(enabled - set(RULES))}")
    if check:
        validate.contributions(scored, LAYERS)
        validate.unique_key(scored, "TransactionID")
    df = with_external(scored, external, check)
    if reference is None:
        df = df.withColumns({"_lower": F.lit(None).cast("double"), "_upper": F.lit(None).cast("double")})
    else:
        # One short row a product with support: broadcast, lest all rows of a product meet in one task.
        df = df.join(F.broadcast(reference.select("ProductCD", F.col("lower").alias("_lower"), F.col("upper").alias("_upper"))), "ProductCD", "left")
    df = df.withColumn("context_guard_active", guard(cfg)).withColumn("_stable", stable(cfg)).withColumn("_calendar", held(F.col("calendar_available") == 1))
    frequent = F.col("_stable") & held(F.col("frequent_entity") == 1)
    high = held(F.col("column_normalized") >= cfg.high_amount_rank)
    when = {
        "product_typical_amount": held((F.col("amount") >= F.col("_lower")) & (F.col("amount") <= F.col("_upper"))) & ~F.col("context_guard_active") & high,
        "frequent_familiar_activity": frequent & held(F.col("entity_hour_probability") >= 1 / 24),
        "familiar_high_amount": frequent & high,
        "business_hours": F.col("_stable") & F.col("_calendar") & held(F.col("is_business_hours") == 1),
        "expected_weekend": F.col("_stable") & F.col("_calendar") & held(F.col("is_weekend") == 1) & F.col("_weekend_expected"),
        "verified_trust": F.col("_stable") & F.col("_trusted"),
    }
    df = df.withColumns({f"context_match_{r}": when[r] if r in enabled else F.lit(False) for r in RULES})
    proposed, reasons = {}, {}
    for layer in LAYERS:
        offers = [(r, F.when(F.col(f"context_match_{r}"), F.col(f"{layer}_contribution") * getattr(cfg, rate) * cfg.strength).otherwise(0.0)) for r, (x, rate) in RULES.items() if x == layer]
        best = F.lit(0.0)
        for _, offer in offers:
            best = F.when(offer > best, offer).otherwise(best)
        reason = F.lit("none")
        for r, offer in reversed(offers):
            reason = F.when((offer > 0) & (offer == F.col(f"_{layer}_best")), F.lit(r)).otherwise(reason)
        proposed[f"_{layer}_best"], reasons[layer] = best, reason
    df = df.withColumns(proposed)
    total = sum((F.col(f"_{x}_best") for x in LAYERS[1:]), F.col("_column_best"))
    df = df.withColumn("_total", total).withColumn("_limit", F.least(F.lit(cfg.max_absolute_reduction), F.col("raw_anomaly_score") * cfg.max_relative_reduction))
    df = df.withColumn("_scale", F.when(F.col("_total") > 0, F.least("_total", "_limit") / F.col("_total")).otherwise(0.0))
    df = df.withColumns({f"context_{x}_reduction": F.col(f"_{x}_best") * F.col("_scale") for x in LAYERS})
    df = df.withColumns({f"context_{x}_reason": F.when(F.col(f"context_{x}_reduction") > 0, reasons[x]).otherwise("none") for x in LAYERS})
    df = df.withColumns({f"context_{x}_contribution": F.col(f"{x}_contribution") - F.col(f"context_{x}_reduction") for x in LAYERS})
    df = df.withColumn("context_reduction", sum((F.col(f"context_{x}_reduction") for x in LAYERS[1:]), F.col("context_column_reduction")))
    df = df.withColumns({"adjusted_anomaly_score": F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("raw_anomaly_score") - F.col("context_reduction"))), "context_calendar_available": F.col("_calendar"), "context_trust_available": F.col("_trusted"), "context_weekend_schedule_available": F.col("_weekend_expected")})
    return df.drop(*[c for c in df.columns if c.startswith("_")])


@dataclass(frozen=True)
class ProductRisk:
    """The product-risk policy: what it was fitted on, and how strongly it acts."""

    global_rate: float
    training_end: float
    strength: float = 0.1
    prior: int = 1000
    support: int = 1000

    def __post_init__(self) -> None:
        if not (0 <= self.strength <= 0.1 and 0 < self.global_rate < 1 and isfinite(self.training_end) and self.training_end >= 0 and self.prior > 0 and self.support > 0):
            raise ValueError("product-risk parameters out of their domain")

    def relative(self, rows: int, positive: int) -> float:
        """Log relative risk of one product, clipped to [-1, 1]; nothing below the support."""
        if not 0 <= positive <= rows or rows <= 0:
            raise ValueError("impossible product counts")
        rate = (positive + self.prior * self.global_rate) / (rows + self.prior)
        return max(-1.0, min(1.0, log(rate / self.global_rate))) if rows >= self.support else 0.0


def risk_profiles(train: DataFrame, policy: ProductRisk) -> DataFrame:
    """(ProductCD, support, positive, smoothed_rate, log_relative_risk) over training rows."""
    g = policy.global_rate
    by = train.where("ProductCD is not null").groupBy("ProductCD").agg(F.count("*").alias("support"), F.sum("isFraud").cast("long").alias("positive"))
    by = by.withColumn("smoothed_rate", (F.col("positive") + policy.prior * g) / (F.col("support") + policy.prior))
    clipped = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.log(F.col("smoothed_rate") / g)))
    return by.withColumn("log_relative_risk", F.when(F.col("support") >= policy.support, clipped).otherwise(0.0))


def check_profiles(profiles: DataFrame, policy: ProductRisk) -> None:
    """Stored rates and risks are those that follow from the stored counts."""
    for r in profiles.select("ProductCD", "support", "positive", "log_relative_risk").collect():  # one row a product
        if abs(policy.relative(r["support"], r["positive"]) - r["log_relative_risk"]) > 1e-9:
            raise ValueError(f"the profile of {r['ProductCD']} does not follow from its counts")


def apply_product_risk(scored: DataFrame, profiles: DataFrame, policy: ProductRisk, cfg: Context = Context(), external: DataFrame | None = None, check: bool = False) -> DataFrame:
    """Behaviour context without the product discount, and a signed product term after the end of training."""
    if check:
        check_profiles(profiles, policy)
    base = apply_context(scored, cfg, None, external, frozenset(RULES) - {"product_typical_amount"})
    supported = profiles.where(F.col("support") >= policy.support).select("ProductCD", F.col("support").alias("_support"), F.col("log_relative_risk").alias("_risk"))
    known = base.join(F.broadcast(supported), "ProductCD", "left")
    known = known.withColumn("product_context_available", held((F.col("_support") >= policy.support) & (F.col("TransactionDT") > policy.training_end)))
    known = known.withColumn("product_context_log_relative_risk", F.when(F.col("product_context_available"), F.coalesce("_risk", F.lit(0.0))).otherwise(0.0))
    wanted = policy.strength * F.col("product_context_log_relative_risk")
    known = known.withColumn("product_context_reduction_blocked", (wanted < 0) & F.col("context_guard_active")).withColumn("behavior_adjusted_anomaly_score", F.col("adjusted_anomaly_score"))
    moved = F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("behavior_adjusted_anomaly_score") + F.when(F.col("product_context_reduction_blocked"), 0.0).otherwise(wanted)))
    known = known.withColumn("adjusted_anomaly_score", moved)
    return known.withColumns({"product_context_adjustment": F.col("adjusted_anomaly_score") - F.col("behavior_adjusted_anomaly_score"), "context_net_adjustment": F.col("adjusted_anomaly_score") - F.col("raw_anomaly_score")}).drop("_support", "_risk")
