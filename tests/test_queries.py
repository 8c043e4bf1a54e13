"""Every registered query of the engine: against its SQL on the smallest tables, or against what it must hold."""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from driftwell.operators import context, forest, layers
from driftwell.plans import queries, registry


@pytest.fixture(scope="module")
def duck(sf):
    con = duckdb.connect()
    con.execute("set TimeZone = 'UTC'")
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"create view {p.stem} as select * from '{p}'")
    return con


@pytest.fixture(scope="module", autouse=True)
def scored_once():
    """Some forty queries begin with the same scored rows; here, and here only, they are computed once."""
    held, plain_scored = {}, queries.scored

    def scored(spark, sf_dir, wanted=queries.PLAIN):
        key = sf_dir, queries._FOREST.get(), wanted
        if key not in held:
            held[key] = plain_scored(spark, sf_dir, wanted)
        return held[key]

    queries.scored = scored
    yield
    queries.scored = plain_scored


def plain(v):
    v = v.item() if hasattr(v, "item") else v
    if isinstance(v, float):
        return None if math.isnan(v) else float(f"{v:.9g}")
    return v


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_equals_sql(spark, sf, duck, name):
    df = registry.QUERIES[name](spark, sf)
    columns = sorted(df.columns)
    got = sorted((tuple(plain(r[c]) for c in columns) for r in df.collect()), key=str)
    result = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in result.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    assert got == sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=str) and got


FULL = sorted(n for n in registry.QUERIES if n.startswith("full_") and n.removeprefix("full_") in registry.ORACLES)


@pytest.mark.parametrize("name", [n for n in FULL if n != "full_stream_history"])
def test_four_layers_beside_three(spark, sf, name):
    """The same rows and columns, and those of the fourth layer; the chain itself is held against plain Python in test_scores."""
    full, three = (registry.QUERIES[n](spark, sf) for n in (name, name.removeprefix("full_")))
    assert set(three.columns) <= set(full.columns) and full.count() >= three.count() > 0
    if "TransactionID" in full.columns:
        assert {r[0] for r in full.select("TransactionID").collect()} == {r[0] for r in three.select("TransactionID").collect()}


def test_hybrid_query(spark, sf):
    """Turns in each source by reading both rankings to the end."""
    rows = defaultdict(list)
    for r in queries.labelled(spark, sf).collect():
        rows[r.source].append(r)
    got = Counter((r.fold, r.TransactionID, r.place) for r in registry.QUERIES["hybrid_ranking"](spark, sf).collect())
    want = Counter()
    for source, own in rows.items():
        ranked = {c: sorted(own, key=lambda r, c=c: (-r[c], r.TransactionID)) for c in ("score", "other")}
        seen: list[int] = []
        while len(seen) < min(20, len(own)):
            n = len(seen)
            side = "score" if -(-(n + 1) // 2) > -(-n // 2) else "other"
            seen.append(min((r for r in own if r.TransactionID not in seen), key=lambda r: ranked[side].index(r)).TransactionID)
        want.update((source, i, place + 1) for place, i in enumerate(seen))
    assert got == want


def test_bootstrap_queries(spark, sf):
    for name in ("block_bootstrap", "full_block_bootstrap", "row_bootstrap"):
        r = registry.QUERIES[name](spark, sf).first()
        assert r.status == "ok" and r.ci_low <= r.ci_high and r.ci_low - 30 <= r.observed <= r.ci_high + 30 and r.excludes_zero == (r.ci_low > 0 or r.ci_high < 0)


def test_supervised_query(spark, sf):
    rows = registry.QUERIES["supervised_rank"](spark, sf).collect()
    assert len(rows) == queries.feature_table(spark, sf).where("split = 'validation'").count()
    assert all(0 <= r[k] <= 1 for r in rows for k in ("logistic", "boosted")) and len({round(r.boosted, 6) for r in rows}) > 5


def test_walk_forward_query(spark, sf):
    rows = registry.QUERIES["walk_forward"](spark, sf).collect()
    by = {(r.fold, r.measure, r.ranking): r.value for r in rows}
    assert len(by) == len(rows)
    names = ["raw_anomaly_score", "full_logistic", "without_time_logistic", "matched_logistic", "matched_boosted"]
    n = queries.feature_table(spark, sf).where("split = 'validation'").count()
    assert sum(by[f, "rows", None] for f in (1, 2)) == n
    for f in (1, 2):
        k = math.ceil(by[f, "rows", None] * 0.05)
        for x in names:
            assert 0 <= by[f, "roc_auc", x] <= 1 and 0 < by[f, "average_precision", x] <= 1 and 0 <= by[f, "hits", x] <= min(k, by[f, "positives", None])
        assert by[f, "overlap_reviews_each", "matched_boosted"] == k
        union = by[f, "overlap_union_tp", "matched_boosted"]
        assert by[f, "hits", "hybrid"] <= union and union <= by[f, "hits", "raw_anomaly_score"] + by[f, "hits", "matched_boosted"]
        assert all((f, f"ci_low_{h}h", x) in by for h in (6, 24) for x in names[1:])


def test_scenario_query(spark, sf):
    """48 scenarios of every validation row; the layers of some rows worked out again in plain Python."""
    got = registry.QUERIES["scenario_grid"](spark, sf).collect()
    f = queries.feature_table(spark, sf).where("split = 'validation'")
    n = f.count()
    assert len(got) == 48 and all(r.rows == n for r in got)
    cell = {(r.g_amount, r.g_pace, r.g_trust, r.g_calendar): r for r in got}
    for a in queries.AMOUNTS:
        for p in queries.PACES:
            base = cell[a, p, "none", "weekday"]
            for t in queries.TRUST:
                for c in queries.CALENDARS:
                    r = cell[a, p, t, c]
                    # Trust and calendar change no layer; evidence that isn't there changes nothing.
                    assert (r.mean_raw, r.guarded) == (base.mean_raw, base.guarded) and r.mean_adjusted <= r.mean_raw + 1e-9
                    assert (t == "before" or not r.trusted) and (c == "weekend_planned" or not r.planned)
    assert cell[1.0, 12, "none", "weekday"].guarded > cell[1.0, 0, "none", "weekday"].guarded
    references = layers.fit_references(queries.feature_table(spark, sf).where("split = 'train'"), check=False)
    each, external = queries.scenarios(f.where("prior_transaction_count >= 5").limit(5))
    assert external.count() == each.count() == 240
    before = {r.TransactionID: r for r in f.collect()}
    for r in layers.raw_layers(each, references).collect():
        old = before[r.TransactionID // 48]
        amount = old.amount * r.g_amount
        scale = max(old.prior_std_amount, old.prior_mean_amount * 0.1, 1.0)
        assert r.column_raw == pytest.approx(abs(math.log1p(amount) - references["amount"].centre) / references["amount"].scale)
        assert r.entity_amount_deviation == pytest.approx(abs(amount - old.prior_mean_amount) / scale) and r.prior_count_1h == old.prior_count_1h + r.g_pace
        assert r.temporal_velocity_1h == pytest.approx(max((math.log1p(old.prior_count_1h + r.g_pace) - references["velocity_1h"].centre) / references["velocity_1h"].scale, 0.0))


def test_forest_query(spark, sf):
    rows = registry.QUERIES["forest_scores"](spark, sf).collect()
    assert len(rows) == queries.feature_table(spark, sf).count() and all(0 < r.multivariate_raw < 1 for r in rows) and len({r.multivariate_raw for r in rows}) > len(rows) / 2


def test_every_query_is_tested():
    own = {"hybrid_ranking", "block_bootstrap", "full_block_bootstrap", "row_bootstrap", "supervised_rank", "walk_forward", "scenario_grid", "full_scenario_grid", "forest_scores", "full_stream_history"}
    assert set(registry.QUERIES) == set(registry.ORACLES) | set(FULL) | own


def test_full_scenarios(spark, sf):
    rows = registry.QUERIES["full_scenario_grid"](spark, sf).collect()
    assert len(rows) == 48 and len({r.rows for r in rows}) == 1 and all(0 <= r.mean_adjusted <= r.mean_raw <= 1 for r in rows)


def test_default_rules_on_four_layers_match(spark, sf):
    """Rules that read the multivariate layer match some rows, in the larger table at least."""
    d = registry.QUERIES["full_rule_activity"](spark, sf.replace("0.001", "0.01")).collect()
    by = {r.rule[:3]: r.matches for r in d}
    assert by["R01"] + by["R05"] + by["R08"] > 0 and all(r.wins <= r.matches and r.audit_matches <= r.matches for r in d)


@pytest.mark.parametrize("name", ["scenario_grid", "full_scenario_grid"])
def test_scenarios_are_not_written(spark, sf, monkeypatch, name):
    """F1, F3: the grid is that of all rows under all scenarios, scored one by one, and no table has as many rows."""
    features = queries.feature_table(spark, sf).cache()
    train, rows = (features.where(F.col("split") == x) for x in ("train", "validation"))
    references, isolate = layers.fit_references(train, check=False), forest.scores(forest.fit(train)) if name.startswith("full_") else None
    each, external = queries.scenarios(rows)
    whole = layers.combined(layers.normalised(layers.raw_layers(train, references, isolate), layers.raw_layers(each, references, isolate)))
    out = context.apply_context(whole, queries.small_context(), context.product_reference(train, queries.small_context(), check=False), external)
    of = lambda c: F.sum(F.col(c).cast("long"))
    expected = out.groupBy("g_amount", "g_pace", "g_trust", "g_calendar").agg(F.count("*"), F.avg("raw_anomaly_score"), F.avg("adjusted_anomaly_score"), of("context_guard_active"), of("context_match_verified_trust"), of("context_match_expected_weekend"))
    expected = {tuple(r)[:4]: tuple(r)[4:] for r in expected.collect()}
    written, write = [], queries.keep

    def counted(df, label):
        table = write(df, label)
        written.append((label, table.count()))
        return table

    monkeypatch.setattr(queries, "keep", counted)
    got = {tuple(r)[:4]: tuple(r)[4:] for r in registry.QUERIES[name](spark, sf).collect()}
    assert set(got) == set(expected) and len(got) == 48
    for scenario, values in expected.items():
        assert got[scenario] == pytest.approx(values, abs=2e-6), scenario
    assert written and all(n <= features.count() for _, n in written), written
