"""Metrics, budgets, selections, profiles, ingest, retrieval and the request service."""

from __future__ import annotations

import json
import math
import random
import threading
from collections import Counter

import pytest
from pyspark.sql import functions as F

from driftwell.operators import evaluate, forest, history, ingest, prefix, profile, ranking, retrieval, validate
from driftwell.operators.rules import DEFAULT, RuleSet
from driftwell.plans import experiment, service
from driftwell.sources import tables
from driftwell.sources.snapshot import Snapshot


def scored(spark, labels, **scores):
    rows = [(i + 1, y, *(s[i] for s in scores.values())) for i, y in enumerate(labels)]
    return spark.createDataFrame(rows, "TransactionID long, isFraud int, " + ", ".join(f"{n} double" for n in scores))


def test_paired_effect_and_thresholds(spark):
    df = scored(spark, [0, 0, 1, 1], raw=[0.9, 0.6, 0.8, 0.1], adjusted=[0.7, 0.6, 0.7, 0.1])
    before, after = evaluate.at_threshold(df, "raw", 0.75).first(), evaluate.at_threshold(df, "adjusted", 0.75).first()
    assert (before.tp, before.fp, before.fn, before.tn, before.fpr) == (1, 1, 1, 1, 0.5)
    assert after.precision is None
    e = evaluate.paired_effect(df, "raw", "adjusted", 0.75).first()
    assert (e.removed_false_positives, e.lost_true_positives) == (1, 1)


def test_budget_ties_go_by_key(spark):
    df = spark.createDataFrame([(2, 0, 0.5), (1, 1, 0.5), (3, 0, 0.2)], "TransactionID long, isFraud int, s double")
    assert evaluate.at_budget(df, "s", 1).first().tp == 1


def test_equal_volume(spark):
    assert evaluate.equal_volume_threshold(scored(spark, [0] * 4, s=[0.9, 0.8, 0.8, 0.1]), "s", 2) == (0.8, 3)
    assert evaluate.equal_volume_threshold(scored(spark, [0] * 4, s=[0.9, 0.8, 0.7, 0.1]), "s", 5) == (None, None)


def test_break_even():
    effect = {"removed_false_positives": 115, "added_false_positives": 0, "lost_true_positives": 17, "added_true_positives": 0}
    out = evaluate.break_even(effect, 2207, 2075)
    assert (out["false_positive_cost_only"], out["every_review_costs"], out["partial_prevention"]) == (115 / 17, 132 / 17, pytest.approx(230 / 17))
    assert evaluate.break_even(effect | {"lost_true_positives": 0}, 9, 8)["status"] == "no_fraud_lost"


def test_ranking_metrics(spark):
    m = evaluate.ranking_metrics(scored(spark, [1, 0, 1, 0], s=[0.9, 0.8, 0.7, 0.1]), "s").first()
    assert m.average_precision == pytest.approx((1 + 2 / 3) / 2) and m.roc_auc == pytest.approx(0.75)


def ranked(spark, seed: int, n: int, groups: int = 1):
    """Rows with ties, missing scores and labels, and the same as a table."""
    rnd = random.Random(seed)
    rows = [(i * 3 + 1, rnd.randrange(groups), int(rnd.random() < 0.3), rnd.choice([None, round(rnd.random(), 1), rnd.random()]), round(rnd.random(), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "TransactionID long, fold int, isFraud int, a double, b double")


def turns(rows, share, slots):
    """(place, id): turn by turn over all rows, from the definition; ``rows`` are (id, first score, second score)."""
    orders = [sorted(rows, key=lambda r, c=c: (r[c] is None, -(r[c] or 0), r[0])) for c in (1, 2)]
    done: dict = {}
    for place in range(1, min(slots, len(rows)) + 1):
        mine = math.ceil(place * share) - math.ceil((place - 1) * share) == 1
        done[next(r[0] for r in orders[not mine] if r[0] not in done)] = place
    return {(p, k) for k, p in done.items()}


@pytest.mark.parametrize(("share", "slots", "step"), [(0.5, 17, 500_000), (0.3, 17, 4), (0.8, 30, 7), (0.25, 1, 1), (0.5, 500, 13)])
def test_hybrid_takes_turns(spark, share, slots, step):
    rows, df = ranked(spark, 5, 90, 3)
    got = [(r.fold, r.place, r.TransactionID) for r in ranking.hybrid_ranking(df, "a", "b", share, slots, step=step).collect()]
    want = {(fold, *x) for fold in range(3) for x in turns([(r[0], r[3], r[4]) for r in rows if r[1] == fold], share, slots)}
    assert len(got) == len(want) and set(got) == want
    assert ranking.hybrid_ranking(df.limit(0), "a", "b", share, 5).count() == 0


@pytest.mark.parametrize("noise", [0.0, 0.05, 1.0])
def test_hybrid_of_a_share_of_a_large_fold(spark, noise, monkeypatch):
    """5 % of a fold, rankings alike, nearly alike and not; ranks in many ranges, places in many steps."""
    monkeypatch.setattr(ranking, "RANGE_ROWS", 500)
    rnd = random.Random(31)
    rows = [(i, x, x + noise * rnd.random()) for i, x in ((i, rnd.random()) for i in range(6_000))]
    df = spark.createDataFrame(rows, "TransactionID long, a double, b double").withColumn("fold", F.lit("f"))
    got = [(r.place, r.TransactionID) for r in ranking.hybrid_ranking(df, "a", "b", 0.4, 300, step=60).collect()]
    assert len(got) == 300 and set(got) == turns(rows, 0.4, 300)
    with pytest.raises(ValueError):
        ranking.hybrid_ranking(df, "a", "b", 1.0, 5)


def test_ranks_of_ties_and_missing_scores(spark, monkeypatch):
    monkeypatch.setattr(ranking, "RANGE_ROWS", 20)
    rows, df = ranked(spark, 8, 300, 2)
    got = {r.TransactionID: r.place for r in ranking.ranks(df, "a", "place", "fold", "TransactionID").collect()}
    for fold in range(2):
        own = sorted((r for r in rows if r[1] == fold), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
        assert [got[r[0]] for r in own] == list(range(1, len(own) + 1))


def test_top_k_of_tied_rows(spark):
    """Very many rows at the last score, or without one: by key, without a sort of them in one place."""
    rows = [(7919 * i % 5003, None if i % 2 else round(i % 3 / 2, 1)) for i in range(5003)]
    df = spark.createDataFrame(rows, "TransactionID long, s double")
    for k in (1, 900, 2_000, 4_000, 5_003, 6_000):
        got = evaluate.top_k(df, "s", k)
        assert {r.TransactionID for r in got.collect()} == {r[0] for r in sorted(rows, key=lambda r: (r[1] is None, -(r[1] or 0), r[0]))[:k]}
        assert "TakeOrdered" not in got._jdf.queryExecution().executedPlan().toString()


def test_hits_in_groups(spark):
    rows, df = ranked(spark, 6, 200, 4)
    for rate in (0.05, 0.33, 1.0):
        got = {r.fold: (r.reviews, r.hits) for r in evaluate.hits_at(df, ("fold",), "a", rate).collect()}
        for fold in range(4):
            own = sorted((r for r in rows if r[1] == fold), key=lambda r: (r[3] is None, -(r[3] or 0), r[0]))
            k = math.ceil(len(own) * rate)
            assert got[fold] == (k, sum(r[2] for r in own[:k]))


def test_compare(spark):
    rows, df = ranked(spark, 7, 120)
    r = evaluate.compare(df, "b", "a", 0.5, 0.1).first()
    hit = lambda x: x is not None and x >= 0.5
    assert r.before_alerts == sum(hit(x[4]) for x in rows) and r.after_tp == sum(hit(x[3]) and x[2] for x in rows)
    best = sorted(rows, key=lambda x: (-x[4], x[0]))[:12]
    assert (r.budget, r.before_budget_tp) == (12, sum(x[2] for x in best))


def replicated(rows, column, times, rate):
    """Hits within the budget of one replicate, row by row."""
    order = sorted(rows, key=lambda r: (-r[column], r[0]))
    drawn = sum(times[r[0]] for r in rows)
    left, hits = math.ceil(drawn * rate), 0
    for r in order:
        take = min(left, times[r[0]])
        hits, left = hits + take * r[2], left - take
    return hits, drawn


def test_bootstraps_equal_plain_replicates(spark, monkeypatch):
    import numpy as np

    monkeypatch.setattr(evaluate, "RANGE_ROWS", 20)
    rnd = random.Random(8)
    rows = [(i * 3 + 1, i // 12, int(rnd.random() < 0.4), rnd.choice([0.1, 0.5, round(rnd.random(), 2)]), rnd.random()) for i in range(150)]
    df = spark.createDataFrame(rows, "TransactionID long, block long, isFraud int, a double, b double")

    def interval(times_of, count):
        gaps = []
        for i in range(count):
            times = times_of(i)
            (x, n), (y, _) = (replicated(rows, c, times, 0.1) for c in (3, 4))
            gaps.append((y - x) / n * len(rows))
        return np.percentile(gaps, [2.5, 97.5])

    drawn = evaluate.poisson_weights(np.array([r[0] for r in rows]), 60)
    assert 0.9 < drawn.mean() < 1.1 and 0.85 < drawn.var() < 1.15
    r = evaluate.row_bootstrap(df, "a", "b", 0.1, 60, check=True).first()
    low, high = interval(lambda i: {row[0]: int(w) for row, w in zip(rows, drawn[:, i], strict=True)}, 60)
    assert (r.ci_low, r.ci_high, r.resamples) == (pytest.approx(low), pytest.approx(high), 60)
    rng = np.random.default_rng(17)
    draws = [np.bincount(rng.integers(0, 13, 13), minlength=13) for _ in range(40)]
    r = evaluate.block_bootstrap(df, "a", "b", 0.1, 40).first()
    low, high = interval(lambda i: {row[0]: int(draws[i][row[1]]) for row in rows}, 40)
    assert (r.ci_low, r.ci_high, r.blocks) == (pytest.approx(low), pytest.approx(high), 13)
    best = [sum(x[2] for x in sorted(rows, key=lambda x: (-x[c], x[0]))[:15]) for c in (3, 4)]
    assert r.observed == best[1] - best[0]
    same = evaluate.block_bootstrap(df, "b", "b", 0.1, 20).first()
    assert (same.observed, same.ci_low, same.ci_high, same.excludes_zero) == (0, 0, 0, False)
    assert evaluate.block_bootstrap(df.where("block < 7"), "a", "b", 0.1, 5).first().status == "insufficient_blocks"
    for bad in ("cast(null as double)", "cast('Infinity' as double)"):
        with pytest.raises(ValueError):
            evaluate.row_bootstrap(df.withColumn("a", F.expr(bad)), "a", "b", 0.1, 5, check=True)


def test_split(spark):
    df = spark.createDataFrame([(i, float(t)) for i, t in enumerate([1, 1, 2, 3, 4, 4, 4, 5, 6, 7])], "TransactionID long, TransactionDT double")
    got = {r.split: sorted(r.t) for r in ingest.chronological_split(df).groupBy("split").agg(F.collect_list("TransactionDT").alias("t")).collect()}
    assert got == {"train": [1, 1, 2, 3], "validation": [4, 4, 4, 5], "test": [6, 7]}
    with pytest.raises(ValueError):
        ingest.chronological_split(df.withColumn("TransactionDT", F.lit(1.0)))


def test_join(spark):
    tx = spark.createDataFrame([(3, 30, 8.0, 0), (1, 10, 10.0, 1), (2, 20, 0.0, 0)], "TransactionID long, TransactionDT long, TransactionAmt double, isFraud int")
    idn = spark.createDataFrame([(1, None)], "TransactionID long, DeviceType string")
    joined = ingest.join_identity(tx, idn)
    assert [r.has_identity for r in joined.orderBy("TransactionID").collect()] == [True, False, False]
    a = ingest.audit(joined).first()
    assert (a.joined_rows, a.zero_amount_rows, a.positive_rows) == (3, 1, 1)
    for bad in ([(1, "a"), (1, "b")], [(900, "a")], [(None, "a")]):
        with pytest.raises(ValueError):
            ingest.join_identity(tx, spark.createDataFrame(bad, "TransactionID long, DeviceType string"))
    with pytest.raises(ValueError):
        validate.transaction_values(tx.withColumn("TransactionAmt", F.lit(-1.0)))


def test_numeric_profile(spark):
    df = spark.createDataFrame([(v,) for v in (0.0, 0.0, 0.0, 0.0, 100.0, None, float("inf"))], "value double")
    r = profile.numeric_profile(df, ["value"]).first()
    assert (r.infinite_count, r.zero_iqr, r.outlier_ratio) == (1, True, pytest.approx(0.2))
    assert profile.column_profile(df).first().null_ratio == pytest.approx(1 / 7)
    kinds = spark.createDataFrame([(1, 1, 1, 2.0, "2024-01-01", "34000")], "TransactionID long, isFraud int, card1 int, x double, day string, code string")
    assert profile.roles(kinds) == {"TransactionID": "identifier", "isFraud": "target", "card1": "categorical", "x": "numeric", "day": "datetime", "code": "categorical"}


def test_retrieval(spark):
    docs = [{"id": i, "title": i, "text": i, "source": "s", "kind": "policy"} for i in "AB"]
    index = retrieval.Index.build(spark, docs, lambda texts: [[1.0, 0.0], [0.0, 1.0]])
    assert [h["id"] for h in index.search([1.0, 1.0])] == ["A", "B"]
    assert [h["id"] for h in index.search([1.0, 0.0], floor=0.9)] == ["A"]
    with pytest.raises(ValueError):
        index.search([0.0, 0.0])
    pick = retrieval.Grounded(lambda q, hits: {"source_ids": ["A"], "abstain": False})
    assert [s["id"] for s in pick.sources("q", index.search([1.0, 1.0]))] == ["A"]
    with pytest.raises(RuntimeError):
        retrieval.Grounded(lambda q, hits: {"source_ids": ["Z"], "abstain": False}).sources("q", index.search([1.0, 1.0]))
    assert retrieval.answer([]).startswith("No")


def test_saved_and_raw_requests_agree(spark, tmp_path):
    from tests.test_history import NAMES, as_tuples, stream

    whole = [r | {"card5": 2.0, "addr1": 1.0} for r in stream(21, 46, 1)]
    data = [d for d in as_tuples(whole) if d[1] < whole[-1]["TransactionDT"]][:39] + as_tuples(whole)[-1:]
    last = data[-1][0]
    features = history.features(spark.createDataFrame(data, tables.TRANSACTION)).withColumn("split", F.lit("train")).persist()
    fitted = service.fit(features, trees=forest.ForestConfig(8, 32))
    api = service.Service(spark, fitted, RuleSet(DEFAULT), features)
    as_dict = [dict(zip(NAMES, r, strict=True)) for r in data]
    saved, raw = api.score({"transaction_id": last}), api.score({"transaction": as_dict[-1], "history": as_dict[:-1]})
    assert saved["raw_anomaly_score"] == pytest.approx(raw["raw_anomaly_score"])
    service.save(fitted, f"{tmp_path}/model")
    again = service.Service(spark, service.load(spark, f"{tmp_path}/model"), RuleSet(DEFAULT), features)
    assert again.score({"transaction_id": last}) == saved
    # A snapshot by id, and all rows at once: the same scores.
    by_id = service.Service(spark, fitted, RuleSet(DEFAULT), Snapshot.write(features, "TransactionID", f"{tmp_path}/snapshot", 6))
    assert by_id.score({"transaction_id": last}) == saved
    many = {r.TransactionID: r.raw_anomaly_score for r in service.score(features, fitted).collect()}
    assert many[last] == pytest.approx(saved["raw_anomaly_score"]) and len(many) == features.count()
    assert [t["status"] for t in api.explain({"transaction_id": last})["trace"]] == ["completed", "completed"]
    with pytest.raises(service.NotFound):
        api.score({"transaction_id": 1})
    with pytest.raises(service.BadRequest):
        api.score({"transaction_id": last, "history": as_dict[:1]})
    # Rules and policies are indexed and asked for; a reply that can't be used has a kind of its own.
    with pytest.raises(service.Unavailable):
        api.query("why?")
    policies = [{"id": "p1", "title": "Limits", "text": "Large amounts are looked at.", "source": "desk", "kind": "policy"}]
    embed = lambda texts: [[1.0 + len(t) % 7, 1.0 + len(t) % 5] for t in texts]
    assert api.indexed(policies, embed).table.count() == 11
    with pytest.raises(ValueError):
        api.indexed([policies[0], policies[0]], embed)
    api.grounded = retrieval.Grounded(lambda q, hits: {"source_ids": [hits[0]["id"]], "abstain": False})
    assert len(api.query("why?")["sources"]) == 1
    api.grounded = retrieval.Grounded(lambda q, hits: "nonsense")
    with pytest.raises(retrieval.BadReply):
        api.query("why?")
    assert service.STATUS[retrieval.BadReply] == 502


def test_spearman_of_many_columns(spark):
    """Thirty columns that are missing in ways of their own: every pair as over its complete rows, in a plan that pairs don't widen."""
    rnd = random.Random(51)
    names = [f"c{i}" for i in range(30)]
    gone = [lambda i, k=k: i % (3 + k) == 0 for k in range(3)]
    rows = [tuple(None if k % 4 and gone[k % 4 - 1](i) else [rnd.random(), float(rnd.randrange(3)), 7.0 if i else 8.0, i * (-1.0) ** k][k % 5 % 4] for k in range(30)) for i in range(140)]
    rows = [(*r[:29], r[0] if i % 30 == 0 else None) for i, r in enumerate(rows)]
    df = spark.createDataFrame(rows, ", ".join(f"{n} double" for n in names)).repartition(3)
    pairs = [(a, b) for k, a in enumerate(names) for b in names[k + 1 :]]

    def plain(a, b):
        both = [(r[names.index(a)], r[names.index(b)]) for r in rows if r[names.index(a)] is not None and r[names.index(b)] is not None]
        place = lambda v, x: sum(y < x for y in v) + (sum(y == x for y in v) + 1) / 2
        ranks = [[place([p[s] for p in both], p[s]) for p in both] for s in (0, 1)]
        mean = [sum(r) / max(len(r), 1) for r in ranks]
        xy, xx, yy = (sum((p - mean[s]) * (q - mean[t]) for p, q in zip(ranks[s], ranks[t], strict=True)) for s, t in ((0, 1), (0, 0), (1, 1)))
        return len(both), None if len(both) < 20 or not xx * yy else xy / math.sqrt(xx * yy)

    shuffles = lambda d: d._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")
    found = profile.spearman(df, pairs, 20)
    assert shuffles(found) <= 6
    got = {(r["first"], r["second"]): (r.n, r.rho) for r in found.collect()}
    assert len(got) == 435
    for pair in rnd.sample(pairs, 120) + [("c0", "c29"), ("c2", "c7")]:
        n, rho = plain(*pair)
        assert got[pair][0] == n and (got[pair][1] is None) == (rho is None) and (rho is None or math.isclose(got[pair][1], rho, abs_tol=1e-12)), pair
    assert profile.spearman(df.limit(0), pairs[:1]).collect() == [(*pairs[0], 0, None)]


def test_rank_reference(spark, tmp_path):
    """Shares equal a plain count for values between, at and beyond the reference's; a lookup reads one block a column."""
    rnd = random.Random(41)
    rows = [(i, rnd.choice([None, round(rnd.random(), 2), 0.5, rnd.gauss(0, 3)]), float(rnd.randrange(4)), None) for i in range(900)]
    df = spark.createDataFrame(rows, "TransactionID long, a double, b double, gone double")
    made = ranking.RankReference.write(df, ["a", "b", "gone"], f"{tmp_path}/ranks", 50)
    moved = made.copied(f"{tmp_path}/moved")
    assert len(made._first["a"]) > 8 and moved.totals == made.totals
    for v in (-99.0, 99.0, 0.5, 0.0, 3.0, *[r[1] for r in rows[:25] if r[1] is not None], *[rnd.gauss(0, 2) for _ in range(10)]):
        want = {"gone": None} | {c: sum(r[i] is not None and r[i] < v for r in rows) / sum(r[i] is not None for r in rows) for i, c in ((1, "a"), (2, "b"))}
        assert moved.shares({"a": v, "b": v, "gone": v}) == pytest.approx(want)
    assert made.shares({"a": None, "b": None}) == {"a": None, "b": None} and made.block("a", -99.0) is None
    assert made.block("a", 99.0).endswith(f"name=a/block={len(made._first['a']) - 1}")
    some = df.where("TransactionID % 9 = 0").withColumn("a", F.col("a") + 0.001)
    got = {r.TransactionID: (r.ra, r.rb) for r in prefix.ranks_among(made.values(), some, {"a": "ra", "b": "rb"}).collect()}
    assert all(got[r.TransactionID] == (made.shares({"a": r.a})["a"], made.shares({"b": r.b})["b"]) for r in some.limit(12).collect())


def test_snapshot_reads_one_block(spark, tmp_path):
    rows = [(i * 7 % 1000, f"v{i}", i % 3) for i in range(1000)] + [(None, "no key", 0), (14, "again", 5)]
    df = spark.createDataFrame(rows, "TransactionID long, v string, _other int")
    shot = Snapshot.write(df, "TransactionID", f"{tmp_path}/s", 10)
    assert len(shot.blocks) > 5 and shot.table().count() == 1001
    for key in (0, 14, 500, 999):
        found = shot.find(key)
        assert sorted(tuple(r) for r in found.collect()) == sorted(r for r in rows if r[0] == key)
        files = found.inputFiles()
        assert len(files) == 1 and shot.block(key).split("/rows/")[1] in files[0]
    assert shot.find(5000).count() == 0 and shot.find(-1).count() == 0 and found.schema == df.schema
    none = Snapshot.write(df.limit(0), "TransactionID", f"{tmp_path}/none")
    assert none.find(1).count() == 0 and none.table().count() == 0 and Snapshot(spark, f"{tmp_path}/s").cuts == shot.cuts


def test_prepared_tables(spark, tmp_path):
    """The checked join is written by split, and what is refused is not written."""
    from driftwell.plans import experiment

    tx = spark.createDataFrame([(i, float(i), 5.0 * (i % 4), i % 2) for i in range(40)], "TransactionID long, TransactionDT double, TransactionAmt double, isFraud int")
    idn = spark.createDataFrame([(i, "desktop") for i in range(0, 40, 5)], "TransactionID long, DeviceType string")
    path, audit = experiment.prepare(spark, tx, idn)
    assert audit["splits"] == {"train": 24, "validation": 8, "test": 8} and (audit["joined_rows"], audit["identity_rows"], audit["zero_amount_rows"]) == (40, 8, 10)
    assert "PartitionFilters: [isnotnull(split" in spark.read.parquet(path).where("split = 'test'")._jdf.queryExecution().executedPlan().toString()
    tables.write_json(tmp_path / "audit.json", audit)
    assert json.loads((tmp_path / "audit.json").read_text()) == audit
    with pytest.raises(ValueError):
        tables.write_json(tmp_path / "bad.json", {"x": float("nan")})
    for bad in (tx.withColumn("TransactionAmt", -F.col("TransactionAmt") - 1), tx.withColumn("isFraud", F.lit(3)), tx.withColumn("TransactionDT", F.expr("cast('Infinity' as double)")), tx.unionByName(tx)):
        with pytest.raises(ValueError):
            experiment.prepare(spark, bad, idn)
    scores = tx.select("TransactionID", (F.col("TransactionID") / 40).alias("score"), "isFraud")
    assert experiment.bound(tx, scores).where("score >= 0.5").count() == 20
    for odd in (scores.where("TransactionID > 3"), scores.withColumn("isFraud", F.lit(0))):
        with pytest.raises(ValueError):
            experiment.bound(tx, odd)


def test_checks_of_scores_and_policies(spark):
    from driftwell.operators import context, layers

    from tests.test_history import as_tuples, stream

    features = history.features(spark.createDataFrame(as_tuples(stream(22, 60, 2)), tables.TRANSACTION)).withColumn("split", F.lit("train")).persist()
    references = layers.fit_references(features)
    assert layers.raw_layers(features, references, check=True).count() == 60
    for c, v in (("amount", None), ("prior_mean_amount", -1.0), ("entity_hour_probability", 0.0), ("prior_std_amount", float("inf"))):
        with pytest.raises(ValueError):
            layers.raw_layers(features.withColumn(c, F.lit(v).cast("double")), references, check=True)
    with pytest.raises(ValueError):
        layers.raw_layers(features.limit(0), references, check=True)
    policy = context.ProductRisk(0.1, 5.0, prior=10, support=10)
    rows = [("P", 50, 9, policy.relative(50, 9)), ("Q", 4, 1, 0.0)]
    kinds = "ProductCD string, support long, positive long, log_relative_risk double"
    context.check_profiles(spark.createDataFrame(rows, kinds), policy)
    with pytest.raises(ValueError):
        context.check_profiles(spark.createDataFrame([("P", 50, 9, 0.01)], kinds), policy)
    assert profile.varying_columns(features.select("amount", F.lit(1.0).alias("one"), F.lit(None).cast("double").alias("gone")), ["amount", "one", "gone"]) == ["amount"]


def test_quantiles_and_strongest_pairs(spark):
    import numpy as np

    rnd = random.Random(3)
    rows = [(rnd.choice("ab"), rnd.choice([None, rnd.randrange(40) / 4]), float(i), 1.0) for i in range(400)]
    df = spark.createDataFrame(rows, "g string, x double, y double, one double").withColumn("z", -F.col("y") + F.col("x"))
    from driftwell.operators.prefix import quantiles

    for r in quantiles(df, "x", [0.0, 0.1, 0.37, 1.0], ("g",)).collect():
        own = [x for g, x, *_ in rows if g == r.g and x is not None]
        assert r.n == len(own) and list(r.q) == pytest.approx(list(np.quantile(own, [0.0, 0.1, 0.37, 1.0])))
    none = quantiles(df.where("x < 0"), "x", [0.5]).first()
    assert none.n == 0 and none.q[0] is None
    top = profile.spearman_top(df, ["x", "y", "z", "one"], most=2).collect()
    assert [(r.first, r.second) for r in top][0] == ("y", "z") and len(top) == 2 and abs(top[0].rho) >= abs(top[1].rho)


def test_csv(spark, tmp_path):
    (tmp_path / "a.csv").write_text("TransactionID,isFraud\n1,0\n2,7\n2,1\n")
    report = tables.integrity(spark, str(tmp_path / "a.csv"), "TransactionID", "isFraud")
    assert (report["rows"], report["unique_keys"], report["bad_labels"], report["wrong_width"]) == (3, False, 1, 0)
    (tmp_path / "b.csv").write_text('TransactionID,note\n1,"two\nlines, quoted ""so"""\n2,short\n3,too,many\n4\n')
    report = tables.integrity(spark, str(tmp_path / "b.csv"), "TransactionID")
    assert (report["rows"], report["unique_keys"], report["missing_keys"], report["wrong_width"], report["columns"]) == (4, True, 0, 2, 2)
    assert tables.read_csv(spark, str(tmp_path / "a.csv"), "TransactionID long, isFraud int").count() == 3
    with pytest.raises(ValueError):
        tables.read_csv(spark, str(tmp_path / "a.csv"), "TransactionID long, other int")
    with pytest.raises(ValueError):
        tables.read_json('{"a": 1, "a": 2}')


def test_capacity_and_final(spark, tmp_path):
    from driftwell.plans.experiment import final_evaluation

    a, b = scored(spark, [1, 0, 0], score=[0.1, 0.9, 0.2]), scored(spark, [1, 0, 0], score=[0.9, 0.1, 0.2])
    assert evaluate.select_by_capacity({0.0: a, 0.5: b, 1.0: b}, 1)[0] == 0.5
    labels = b.select("TransactionID", "isFraud")
    assert final_evaluation(spark, str(tmp_path), b.drop("isFraud"), labels, 0.5, {"strength": 0.5}, "score").first().tp == 1
    with pytest.raises(ValueError):
        final_evaluation(spark, str(tmp_path), b.drop("isFraud"), labels, 0.5, {"strength": 0.5}, "score")
    # A row without a label, or with one that is none, is refused and not left out.
    for n, short in enumerate((labels.where("TransactionID > 1"), labels.withColumn("isFraud", F.lit(2)))):
        with pytest.raises(ValueError):
            final_evaluation(spark, f"{tmp_path}/{n}", b.drop("isFraud"), short, 0.5, {}, "score")


UP, DOWN, WIDE = (28.0, 169.0), (-169.0, -28.0), (-10.0, 45.0)


@pytest.mark.parametrize(
    ("gap", "intervals", "halves", "expected"),
    [
        (94, [UP, UP], (55, 33), "gain"), (-94, [DOWN, DOWN], (-55, -33), "loss"), (0, [WIDE, WIDE], (0, 0), "flat"), (12, [WIDE, WIDE], (4, 19), "weak"), (-12, [WIDE, WIDE], (-4, -19), "weak"),
        (12, [DOWN, DOWN], (4, 19), "conflict"), (94, [UP, DOWN], (55, 33), "conflict"), (0, [UP, UP], (0, 0), "conflict"), (12, [UP, UP], (-4, 19), "none"), (12, [UP, UP], (0, 19), "none"),
        (94, [UP, None], (55, 33), "partial"), (94, [None, None], (55, 33), "uncomputed"), (5, [UP, WIDE], (1, 2), "weak"),
    ],
)
def test_reading(gap, intervals, halves, expected):
    assert evaluate.reading(gap, intervals, halves) == expected


def test_interval_sign():
    assert [evaluate.interval_sign(*i) for i in (UP, DOWN, WIDE, (0.0, 45.0), (-45.0, 0.0))] == [1, -1, 0, 0, 0]


def test_fits_run_side_by_side(spark):
    """the jobs of an experiment's rankers are under way at once, in folds too, and their results keep the cases' order."""
    meet = threading.Barrier(4, timeout=60)

    def fitted(case: tuple[int, str]) -> tuple:
        meet.wait()  # broken where one waits for the other to end
        fold, kind = case
        df = scored(spark, [0, 1] * 20, x=[float(i % 7 + fold) for i in range(40)])
        return fold, kind, evaluate.supervised(df, ["x"], kind=kind, rounds=1)(df, "p").where("p between 0 and 1").count()

    found = experiment.together(lambda f: experiment.together(fitted, [(f, "logistic"), (f, "boosted")]), [1, 2])
    assert found == [[(f, k, 40) for k in ("logistic", "boosted")] for f in (1, 2)]
