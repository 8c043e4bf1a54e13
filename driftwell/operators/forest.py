"""An isolation forest: fitted on a bounded sample, scored where the rows are.

The method of Liu, Ting and Zhou (2008).  The sample is the rows with the smallest hashes of their key, ``trees`` times
``rows`` at most, so refits agree; the trees are a few arrays that travel with the scoring function.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The features of the multivariate layer, and those taken by log1p.
MULTIVARIATE = (
    "log_amount", "hour_sin", "hour_cos", "has_identity", "entity_known", "prior_transaction_count", "prior_mean_amount", "prior_std_amount", "amount_to_prior_mean",
    "prior_count_1h", "prior_count_24h", "seconds_since_previous", "prior_distinct_products", "prior_distinct_email_domains", "prior_distinct_devices",
    "product_prior_frequency", "email_prior_frequency", "device_prior_frequency", "product_card_prior_frequency", "email_pair_prior_frequency", "email_domains_match",
)
LOGGED = frozenset(("prior_transaction_count", "prior_mean_amount", "prior_std_amount", "amount_to_prior_mean", "prior_count_1h", "prior_count_24h", "seconds_since_previous", "prior_distinct_products", "prior_distinct_email_domains", "prior_distinct_devices"))


@dataclass(frozen=True)
class ForestConfig:
    trees: int = 128
    rows: int = 1024
    seed: int = 42


def _path(n: np.ndarray | float) -> np.ndarray:
    """Mean length of an unsuccessful search in a binary tree of n keys."""
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


class Forest:
    """Medians for missing values, and the trees as arrays: feature (-1 a leaf), cut, left child (the right one follows), depth."""

    def __init__(self, medians: np.ndarray, sample: np.ndarray, cfg: ForestConfig):
        rng = np.random.default_rng(cfg.seed)
        self.medians = medians
        self.flagged = np.flatnonzero(np.isnan(sample).any(axis=0))
        x = self._filled(sample)
        self.size = min(cfg.rows, len(x))
        self.trees = [self._grow(x[rng.choice(len(x), self.size, replace=False)], rng) for _ in range(cfg.trees)]

    def _filled(self, x: np.ndarray) -> np.ndarray:
        gone = np.isnan(x)
        return np.column_stack([np.where(gone, self.medians, x), gone[:, self.flagged].astype(float)])

    def _grow(self, x: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        limit = int(np.ceil(np.log2(max(len(x), 2))))
        feature, cut, left, length, todo = [-1], [0.0], [0], [0.0], [(0, np.arange(len(x)), 0)]
        while todo:
            node, rows, depth = todo.pop()
            lo, hi = (x[rows].min(axis=0), x[rows].max(axis=0)) if len(rows) else (np.zeros(0), np.zeros(0))
            usable = np.flatnonzero(hi > lo)
            if depth >= limit or len(rows) <= 1 or not len(usable):
                length[node] = depth + float(_path(len(rows)))
                continue
            f = int(rng.choice(usable))
            at = float(rng.uniform(lo[f], hi[f]))
            below = x[rows, f] <= at
            feature[node], cut[node], left[node] = f, at, len(feature)
            for part in (rows[below], rows[~below]):
                todo.append((len(feature), part, depth + 1))
                for values, start in ((feature, -1), (cut, 0.0), (left, 0), (length, 0.0)):
                    values.append(start)
        return np.array(feature), np.array(cut), np.array(left), np.array(length)

    def state(self) -> dict:
        """Everything as plain lists, for JSON."""
        return {"medians": self.medians.tolist(), "flagged": self.flagged.tolist(), "size": self.size, "trees": [[part.tolist() for part in t] for t in self.trees]}

    @classmethod
    def restored(cls, state: dict) -> Forest:
        out = object.__new__(cls)
        out.medians, out.flagged, out.size = np.array(state["medians"], float), np.array(state["flagged"], int), state["size"]
        out.trees = [(np.array(f, int), np.array(c, float), np.array(l, int), np.array(d, float)) for f, c, l, d in state["trees"]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        """Between 0 and 1, higher the sooner a row is isolated."""
        x = self._filled(x)
        total = np.zeros(len(x))
        for feature, cut, left, length in self.trees:
            at = np.zeros(len(x), int)
            moving = np.flatnonzero(feature[at] >= 0)
            while len(moving):
                node = at[moving]
                at[moving] = left[node] + (x[moving, feature[node]] > cut[node])
                moving = moving[feature[at[moving]] >= 0]
            total += length[at]
        return 2.0 ** (-total / len(self.trees) / max(float(_path(self.size)), 1e-9))


def matrix(changed: dict[str, Column] | None = None) -> list[Column]:
    """The features as the trees take them, with some of them ``changed``."""
    value = {c: F.col(c) for c in MULTIVARIATE} | (changed or {})
    return [(F.log1p(value[c]) if c in LOGGED else value[c].cast("double")).alias(c) for c in MULTIVARIATE]


def fit(train: DataFrame, cfg: ForestConfig = ForestConfig(), key: str = "TransactionID") -> Forest:
    """A forest of training rows; medians over all of them, trees over the bounded sample."""
    rows = train.select(key, *matrix())
    medians = rows.agg(*[F.percentile_approx(c, 0.5, 10_000).alias(c) for c in MULTIVARIATE]).first()
    sample = rows.orderBy(F.xxhash64(key), key).limit(cfg.trees * cfg.rows).select(*MULTIVARIATE).toPandas()
    if sample.empty:
        raise ValueError("no training rows")
    values = np.array([0.0 if medians[c] is None else float(medians[c]) for c in MULTIVARIATE])
    return Forest(values, sample.to_numpy(float, na_value=np.nan), cfg)


def scores(forest: Forest) -> Column:
    """The score column of rows with the multivariate features."""

    @F.pandas_udf("double")
    def isolate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.Series]:
        for batch in batches:
            yield pd.Series(forest.score(batch.to_numpy(float, na_value=np.nan)))

    return isolate(F.struct(*matrix()))


def scores_each(forest: Forest, cases: list[dict[str, Column]]) -> Column:
    """An array of a row's scores, with the features of each case changed: one call, and no rows but the row's own."""

    @F.pandas_udf("array<double>")
    def isolate(batches: Iterator[tuple[pd.DataFrame, ...]]) -> Iterator[pd.Series]:
        for parts in batches:
            yield pd.Series(list(np.column_stack([forest.score(part.to_numpy(float, na_value=np.nan)) for part in parts])))

    return isolate(*[F.struct(*matrix(c)) for c in cases])
