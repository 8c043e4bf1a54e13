"""The anomaly layers and their combination into one score."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwell.operators import validate
from driftwell.operators.prefix import cells_of, quantiles, strict_ranks

LAYERS = ("column", "multivariate", "entity", "temporal")
LEAST_HISTORY = 5


@dataclass(frozen=True)
class Robust:
    """A centre and a scale that outliers don't move."""

    centre: float
    scale: float


def robust(df: DataFrame, values: dict[str, Column]) -> DataFrame:
    """(name, n, centre, scale) of each of ``values`` that is there: median and IQR / 1.349, else (p90 - p10) / 2.563 where that is nothing, else 1."""
    cells = cells_of(df.select(*[v.cast("double").alias(k) for k, v in values.items()]), list(values))
    by = quantiles(cells, "x", [0.1, 0.25, 0.5, 0.75, 0.9], ("name",))
    iqr, wide = (F.col("q")[3] - F.col("q")[1]) / 1.349, (F.col("q")[4] - F.col("q")[0]) / 2.563
    return by.select("name", "n", F.col("q")[2].alias("centre"), F.when(iqr >= 1e-8, iqr).when(wide >= 1e-8, wide).otherwise(1.0).alias("scale"))


def _temporal(value: Callable[[str], Column] = F.col) -> dict[str, Column]:
    return {"velocity_1h": F.log1p(value("prior_count_1h")), "velocity_24h": F.log1p(value("prior_count_24h")), "hour_rarity": -F.log(value("entity_hour_probability"))}


def fit_references(train: DataFrame, check: bool = True) -> dict[str, Robust]:
    """Centre and scale of the amount over training rows, of the temporal signals over those with enough history."""
    if check:
        validate.training_only(train)
    enough = F.col("prior_transaction_count") >= LEAST_HISTORY
    wanted = {"amount": F.col("log_amount")} | {k: F.when(enough, v) for k, v in _temporal().items()}
    rows = {r["name"]: r for r in robust(train, wanted).collect()}  # one row a signal
    if set(rows) != set(wanted):
        raise ValueError("no training row has enough history")
    return {k: Robust(rows[k]["centre"], rows[k]["scale"]) for k in wanted}


def deviation(x: Column, reference: Robust, upper_only: bool = False) -> Column:
    d = (x - reference.centre) / reference.scale
    return F.greatest(d, F.lit(0.0)) if upper_only else F.abs(d)


#: Features that the layers read, and those of them that can't be negative.
REQUIRED = ("amount", "log_amount", "prior_transaction_count", "prior_mean_amount", "prior_std_amount", "prior_count_1h", "prior_count_24h", "entity_hour_probability", "entity_product_is_new", "entity_email_is_new", "entity_device_is_new")
_HISTORIES = ("prior_transaction_count", "prior_mean_amount", "prior_std_amount", "prior_count_1h", "prior_count_24h")


def raw_values(references: dict[str, Robust], changed: dict[str, Column] | None = None) -> dict[str, Column]:
    """The raw values of all layers but the multivariate one, and their parts, with some of the features ``changed``."""
    value = lambda c: (changed or {}).get(c, F.col(c))
    enough, mean = value("prior_transaction_count") >= LEAST_HISTORY, value("prior_mean_amount")
    scale = F.greatest(value("prior_std_amount"), mean * 0.1, F.lit(1.0))
    novelty = F.greatest(*[value(f"entity_{x}_is_new") for x in ("product", "email", "device")])
    out = {"column_raw": deviation(value("log_amount"), references["amount"]), "entity_amount_deviation": F.when(enough, F.abs(value("amount") - mean) / scale), "entity_relation_novelty": F.when(enough, 2.0 * novelty)}
    temporal = {f"temporal_{k}": F.when(enough, F.when(v.isNotNull(), deviation(v, references[k], upper_only=True))) for k, v in _temporal(value).items()}
    return out | temporal | {"entity_raw": F.greatest(out["entity_amount_deviation"], out["entity_relation_novelty"]), "temporal_raw": F.greatest(*temporal.values())}


def raw_layers(features: DataFrame, references: dict[str, Robust], multivariate: Column | None = None, check: bool = False) -> DataFrame:
    """Adds <layer>_raw and <layer>_available; a layer that can't be told is null."""
    if check:
        validate.scoring_features(features, list(REQUIRED), list(_HISTORIES))
    out = features.withColumns(raw_values(references) | {"multivariate_raw": F.lit(None).cast("double") if multivariate is None else multivariate})
    return out.withColumns({f"{x}_available": F.col(f"{x}_raw").isNotNull() for x in LAYERS})


def checked_weights(weights: dict[str, float]) -> dict[str, float]:
    """The four layers' weights, scaled to a sum of 1."""
    from math import isfinite

    if set(weights) != set(LAYERS) or not all(isfinite(w) and w >= 0 for w in weights.values()) or not sum(weights.values()) > 0:
        raise ValueError("weights must be four finite, non-negative numbers with a positive sum")
    total = sum(weights.values())
    return {k: weights[k] / total for k in LAYERS}


EVEN = dict.fromkeys(LAYERS, 0.25)


def normalised(train: DataFrame, scored: DataFrame) -> DataFrame:
    """Adds <layer>_normalized: the share of training rows whose raw value is strictly less, all layers in one pass."""
    return strict_ranks(train, scored, {f"{x}_raw": f"{x}_normalized" for x in LAYERS})


def combined(scored: DataFrame, weights: dict[str, float] = EVEN) -> DataFrame:
    """Adds available_weight, raw_anomaly_score and each layer's effective weight and contribution.

    Weights are shared among the layers that a row has; a row with none has a null score.
    """
    w = checked_weights(weights)
    norm = {x: F.col(f"{x}_normalized") for x in LAYERS}
    have = sum((F.when(norm[x].isNotNull(), w[x]).otherwise(0.0) for x in LAYERS), F.lit(0.0))
    out = scored.withColumn("available_weight", have)
    share = {x: F.when(norm[x].isNotNull() & (F.col("available_weight") > 0), F.lit(w[x]) / F.col("available_weight")).otherwise(0.0) for x in LAYERS}
    out = out.withColumns({f"{x}_effective_weight": share[x] for x in LAYERS})
    out = out.withColumns({f"{x}_contribution": F.col(f"{x}_effective_weight") * F.coalesce(norm[x], F.lit(0.0)) for x in LAYERS})
    total = sum((F.col(f"{x}_contribution") for x in LAYERS[1:]), F.col("column_contribution"))
    return out.withColumn("raw_anomaly_score", F.when(F.col("available_weight") > 0, total))
