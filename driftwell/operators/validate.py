"""Checks of inputs: each is one aggregate job that raises ValueError with what it found."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.functions.columns import held


def _bad(condition: Column, name: str) -> Column:
    return F.coalesce(F.sum(held(condition).cast("long")), F.lit(0)).alias(name)


def _refuse(counts: dict, what: str) -> None:
    wrong = {k: v for k, v in counts.items() if v}
    if wrong:
        raise ValueError(f"{what}: {wrong}")


def _infinite(c: Column) -> Column:
    return F.isnan(c) | c.isin(float("inf"), float("-inf"))


def unique_key(df: DataFrame, key: str) -> None:
    """The key is there, an integer, never null and never repeated."""
    kinds = dict(df.dtypes)
    if kinds.get(key) not in ("int", "bigint", "smallint", "tinyint"):
        raise ValueError(f"{key} must be an integer column, is {kinds.get(key)}")
    repeated = df.groupBy(key).agg(F.count("*").alias("n")).agg(_bad(F.col(key).isNull(), "null"), _bad(F.col("n") > 1, "repeated")).first()
    _refuse(repeated.asDict(), f"bad {key}")


def transaction_values(df: DataFrame, time: str = "TransactionDT", amount: str = "TransactionAmt", label: str | None = "isFraud") -> None:
    """Finite, non-negative times and amounts; labels 0 or 1."""
    checks = [_bad(F.col(c).isNull() | _infinite(F.col(c).cast("double")) | (F.col(c) < 0), c) for c in (time, amount)]
    if label:
        checks.append(_bad(F.col(label).isNull() | ~F.col(label).isin(0, 1), label))
    _refuse(df.agg(*checks).first().asDict(), "values out of their domain")


def separate_columns(left: DataFrame, right: DataFrame, key: str, reserved: tuple[str, ...] = ()) -> None:
    """No column of both tables but the key, and none of the reserved names."""
    clash = (set(left.columns) & set(right.columns)) - {key} | (set(left.columns) | set(right.columns)) & set(reserved)
    if clash:
        raise ValueError(f"columns clash: {sorted(clash)}")


def no_orphans(left: DataFrame, right: DataFrame, key: str) -> None:
    n = right.join(left, key, "left_anti").count()
    if n:
        raise ValueError(f"{n} rows without a partner in {key}")


def training_only(df: DataFrame) -> None:
    """Whatever is fitted sees the training split only."""
    _refuse(df.agg(_bad(F.col("split").isNull() | (F.col("split") != "train"), "other_split")).first().asDict(), "fit on rows outside training")


def scoring_features(df: DataFrame, required: list[str], nonnegative: list[str]) -> None:
    """Nothing infinite, amounts present, histories not negative, probabilities in (0, 1]."""
    gone = [c for c in required if c not in df.columns]
    if gone:
        raise ValueError(f"missing features: {gone}")
    checks = [_bad(_infinite(F.col(c).cast("double")), f"{c}_infinite") for c in required]
    checks += [_bad(F.col(c).isNull(), f"{c}_null") for c in ("amount", "log_amount")]
    checks += [_bad(F.col(c) < 0, f"{c}_negative") for c in ("amount", "log_amount", *nonnegative)]
    p = F.col("entity_hour_probability")
    checks.append(_bad((p <= 0) | (p > 1), "probability"))
    found = df.agg(F.count("*").alias("_rows"), *checks).first().asDict()
    if not found.pop("_rows"):
        raise ValueError("nothing to score")
    _refuse(found, "bad scoring features")


def contributions(df: DataFrame, layers: tuple[str, ...], score: str = "raw_anomaly_score") -> None:
    """Contributions are not negative, scores lie in [0, 1] and are their contributions' sum."""
    total = sum((F.coalesce(F.col(f"{x}_contribution"), F.lit(0.0)) for x in layers), F.lit(0.0))
    off = F.abs(total - F.col(score)) > 1e-12 + 1e-10 * F.abs(F.col(score))
    below = [_bad(F.col(f"{x}_contribution") < 0, x) for x in layers]
    _refuse(df.agg(_bad(off | F.col(score).isNull(), "sum"), _bad((F.col(score) < 0) | (F.col(score) > 1), "range"), *below).first().asDict(), "bad contributions")


def aligned(left: DataFrame, right: DataFrame, key: str) -> None:
    """The same keys on both sides, and the same values in the columns both have."""
    both = [c for c in left.columns if c in right.columns and c != key]
    l = left.select(key, *[F.col(c).alias(f"_l_{c}") for c in both], F.lit(True).alias("_l"))
    r = right.select(key, *[F.col(c).alias(f"_r_{c}") for c in both], F.lit(True).alias("_r"))
    differs = [_bad(F.col("_l") & F.col("_r") & ~F.col(f"_l_{c}").eqNullSafe(F.col(f"_r_{c}")), c) for c in both]
    _refuse(l.join(r, key, "full_outer").agg(_bad(F.col("_l").isNull() | F.col("_r").isNull(), "unmatched"), *differs).first().asDict(), "tables not aligned")


def external_evidence(df: DataFrame, flag: str, time: str, source: str) -> None:
    """A set flag has a named source and a finite, non-negative time."""
    named = held(F.length(F.trim(F.col(source))) > 0)
    timed = held(F.col(time).isNotNull() & ~_infinite(F.col(time).cast("double")) & (F.col(time) >= 0))
    _refuse(df.agg(_bad(F.col(flag) & ~(named & timed), flag)).first().asDict(), "evidence incomplete")


def metric_inputs(df: DataFrame, label: str, score: str, key: str | None = None) -> None:
    checks = [_bad(F.col(label).isNull() | ~F.col(label).isin(0, 1), label), _bad(F.col(score).isNull() | _infinite(F.col(score)), score)]
    _refuse(df.agg(*checks).first().asDict(), "bad metric inputs")
    if key:
        unique_key(df, key)


def rule_inputs(df: DataFrame, fields: frozenset[str], normalised: frozenset[str], key: str = "TransactionID") -> None:
    """All fields are there, numeric or boolean, finite; normalised ones lie in [0, 1]; keys are unique."""
    kinds = dict(df.dtypes)
    gone = sorted(fields - set(kinds))
    if gone:
        raise ValueError(f"missing rule inputs: {gone}")
    odd = sorted(f for f in fields if kinds[f] not in ("int", "bigint", "smallint", "tinyint", "float", "double", "boolean"))
    if odd:
        raise ValueError(f"rule inputs must be numeric or boolean: {odd}")
    unique_key(df, key)
    checks = [_bad(_infinite(F.col(f)), f"{f}_infinite") for f in sorted(fields) if kinds[f] in ("float", "double")]
    checks += [_bad((F.col(f) < 0) | (F.col(f) > 1), f"{f}_range") for f in sorted(fields & normalised)]
    if checks:
        _refuse(df.agg(*checks).first().asDict(), "bad rule inputs")
