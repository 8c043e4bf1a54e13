"""Histogram boosting against a plain NumPy twin on the same bins, row by row and node by node."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwell.operators import boosting, evaluate
from driftwell.operators.boosting import Boosting

COLUMNS = ["a", "b", "c", "empty"]


def rows_of(seed: int, n: int) -> list[tuple]:
    """A label that depends on two columns, one of them by being missing; ties, heavy values, an empty column."""
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        a = rnd.choice([None, float(rnd.randrange(6)), rnd.gauss(0, 2)])
        b = rnd.choice([rnd.random(), 0.5, float("nan")])
        c = None if rnd.random() < 0.4 else rnd.gauss(0, 1)
        odds = (2 if a is None else a / 3) + (1.5 if c is None else 0) + (b if b == b else -1)
        rows.append((i, a, b, c, None, int(rnd.random() < 1 / (1 + np.exp(2 - odds)))))
    return rows


def table(spark, rows):
    return spark.createDataFrame(rows, "TransactionID long, a double, b double, c double, empty double, isFraud int")


def plain_edges(values, bins):
    """The first value of each share of the sorted values."""
    values = sorted(v for v in values if v is not None and v == v)
    shares: dict[int, float] = {}
    for i, v in enumerate(values):
        shares.setdefault(values.index(v) * bins // len(values), v)
    return sorted(set(shares.values()))[1:]


def plain_boost(x, y, cfg):
    """Raw scores of the training rows: every node and cut looked at with masks."""
    w = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    raw = np.zeros(len(y))
    for _ in range(cfg.rounds):
        p = 1 / (1 + np.exp(-raw))
        g, h = w * (p - y), w * p * (1 - p)
        step = np.zeros(len(y))
        todo = [(np.ones(len(y), bool), 0)]
        while todo:
            mask, level = todo.pop()
            best = (1e-9, None)
            for c in range(x.shape[1]) if level < cfg.depth else ():
                for side in (False, True):
                    for cut in np.unique(x[mask & (x[:, c] != 255), c]):
                        left = mask & np.where(x[:, c] == 255, side, x[:, c] <= cut)
                        right = mask & ~left
                        if min(left.sum(), right.sum()) < cfg.least:
                            continue
                        gain = g[left].sum() ** 2 / h[left].sum() + g[right].sum() ** 2 / h[right].sum() - g[mask].sum() ** 2 / h[mask].sum()
                        if gain > best[0] + 1e-12:
                            best = (gain, (left, right))
            if best[1] is None:
                step[mask] = -cfg.rate * g[mask].sum() / h[mask].sum()
            else:
                todo += [(m, level + 1) for m in best[1]]
        raw += step
    return raw


@pytest.mark.parametrize("cfg", [Boosting(rounds=4, depth=3, bins=12, least=15), Boosting(rounds=18, depth=2, bins=5, rate=0.3, least=5)])
def test_boosting_equals_its_plain_twin(spark, cfg):
    rows = rows_of(3, 400)
    df = table(spark, rows).repartition(5)
    edges = boosting.bin_edges(df, COLUMNS, cfg.bins)
    assert [e.tolist() for e in edges] == [plain_edges([r[i] for r in rows], cfg.bins) if i < 4 else [] for i in range(1, 5)]
    model = boosting.fit(df, COLUMNS, cfg=cfg)
    got = {r.TransactionID: r.p for r in df.select("TransactionID", model.probability().alias("p")).collect()}
    x = model.binned([np.array([np.nan if r[i] is None else r[i] for r in rows], float) for i in range(1, 5)])
    raw = plain_boost(x, np.array([r[5] for r in rows]), cfg)
    assert len(model.trees) == cfg.rounds and max(abs(got[r[0]] - 1 / (1 + np.exp(-s))) for r, s in zip(rows, raw, strict=True)) < 1e-9


def test_missing_values_have_a_side_of_their_own(spark):
    """The label is whether a value is missing: one cut finds it, without a fill and without a flag."""
    rnd = random.Random(4)
    rows = [(i, rnd.random(), 0.0, None if i % 3 == 0 else rnd.random(), None, int(i % 3 == 0)) for i in range(300)]
    df = table(spark, rows)
    model = boosting.fit(df, COLUMNS, cfg=Boosting(rounds=1, depth=1))
    assert model.trees[0].column[0] == 2
    scores = {r.TransactionID: r.p for r in df.select("TransactionID", model.probability().alias("p")).collect()}
    assert min(scores[i] for i in range(0, 300, 3)) > max(v for i, v in scores.items() if i % 3)


def test_boosting_ranks_rows_it_has_not_seen(spark):
    train, other = table(spark, rows_of(5, 1500)), table(spark, rows_of(6, 800))
    auc = {}
    for kind in ("boosted", "logistic"):
        out = evaluate.supervised_scores(train, other, COLUMNS, kind=kind, name="s")
        assert out.columns == [*other.columns, "s"]
        auc[kind] = evaluate.ranking_metrics(out, "s").first().roc_auc
    assert auc["boosted"] > 0.7 and auc["boosted"] > auc["logistic"] - 0.02
    with pytest.raises(ValueError):
        evaluate.supervised_scores(train, other, COLUMNS, kind="other")


def test_boosting_without_rows_of_both_kinds(spark):
    df = table(spark, rows_of(7, 60))
    for part in (df.where("isFraud = 1"), df.limit(0), df.withColumn("isFraud", F.lit(None).cast("int"))):
        assert {r.p for r in df.select(boosting.fit(part, COLUMNS).probability().alias("p")).collect()} == {0.5}
    with pytest.raises(ValueError):
        Boosting(depth=0)
