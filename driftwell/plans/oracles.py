"""DuckDB SQL that says what the registered queries say, written from the definitions on plain windows and quantiles.

``ORACLES`` maps a query to one statement; statements share named parts, of which each takes what it needs.
"""

from __future__ import annotations

import re

ORACLES: dict[str, str] = {}


def r(x: str, digits: int = 6) -> str:
    """A number rounded as in the queries."""
    return f"round({x} + 1e-9, {digits})"


def _txn(name: str, tick: int) -> str:
    return f"""
  SELECT event_id AS id, (sec // {tick}) * {tick} AS t, value AS amt, user_id::DOUBLE AS card1, (user_id % 7)::DOUBLE AS card2, user_id AS u,
         CASE WHEN event_id % 13 <> 0 THEN (user_id % 11)::DOUBLE END AS addr1, 'brand' || (user_id % 4) AS card4, event_type AS product,
         CASE WHEN k % 17 <> 0 THEN 'd' || (k % 10) END AS email, CASE WHEN k % 19 <> 0 THEN 'd' || (k // 10) END AS recipient,
         CASE WHEN k % 5 <> 0 THEN 'dev' || (k % 23) END AS device, (event_id % 29 = 0)::INT AS fraud, event_id % 4 = 0 AS has_identity,
         CASE WHEN event_id % 4 = 0 THEN k END AS id_score, event_id % 13 <> 0 AS known, CASE WHEN event_id % 13 = 0 THEN event_id END AS own
  FROM (SELECT *, json_extract(props, '$.k')::INT AS k, epoch_us(ts) // 1000000 - 1704067200 AS sec FROM events)"""


def _history(source: str) -> str:
    return f"""
  SELECT *, CASE WHEN known THEN n END AS prior_n,
         CASE WHEN known AND n > 0 THEN avg_amt END AS prior_mean, CASE WHEN known AND n >= 2 THEN std_amt END AS prior_std,
         CASE WHEN known AND n > 0 AND avg_amt > 0 THEN amt / avg_amt END AS relative,
         CASE WHEN known AND n >= 5 AND std_amt > 0 THEN (amt - avg_amt) / std_amt END AS z,
         CASE WHEN known AND n > 0 THEN (t - first_t) / 86400.0::DOUBLE END AS span,
         CASE WHEN known AND n > 0 THEN (t - last_t)::DOUBLE END AS since,
         CASE WHEN known AND n > 0 THEN (in_hour + 1)::DOUBLE / (n + 24) END AS hour_p,
         CASE WHEN known AND product IS NOT NULL AND d_product > 0 THEN (w_product = 0)::INT::DOUBLE END AS new_product,
         CASE WHEN known AND email IS NOT NULL AND d_email > 0 THEN (w_email = 0)::INT::DOUBLE END AS new_email,
         CASE WHEN known AND device IS NOT NULL AND d_device > 0 THEN (w_device = 0)::INT::DOUBLE END AS new_device
  FROM (
    SELECT *, count(*) OVER p AS n, avg(amt) OVER p AS avg_amt, stddev_pop(amt) OVER p AS std_amt, min(t) OVER p AS first_t, max(t) OVER p AS last_t,
           count(*) OVER (PARTITION BY u, own ORDER BY t RANGE BETWEEN 3600 PRECEDING AND 1 PRECEDING) AS c1h,
           count(*) OVER (PARTITION BY u, own ORDER BY t RANGE BETWEEN 86400 PRECEDING AND 1 PRECEDING) AS c24h,
           count(*) OVER (PARTITION BY u, own, (t // 3600) % 24 ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS in_hour,
           count(DISTINCT product) OVER p AS d_product, count(DISTINCT email) OVER p AS d_email, count(DISTINCT device) OVER p AS d_device,
           count(*) OVER (PARTITION BY u, own, product ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w_product,
           count(*) OVER (PARTITION BY u, own, email ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w_email,
           count(*) OVER (PARTITION BY u, own, device ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS w_device
    FROM {source} WINDOW p AS (PARTITION BY u, own ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))"""


_BEFORE = "ORDER BY t RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING"


def _split(source: str) -> str:
    return f"""
  SELECT *, CASE WHEN t < (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM {source}) WHERE i = floor((SELECT count(*) FROM {source}) * 0.6::DOUBLE) + 1) THEN 'train'
                 WHEN t < (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM {source}) WHERE i = floor((SELECT count(*) FROM {source}) * 0.8::DOUBLE) + 1) THEN 'validation' ELSE 'test' END AS split
  FROM {source}"""


def _robust(x: str, name: str) -> str:
    iqr, wide = f"(quantile_cont({x}, 0.75) - quantile_cont({x}, 0.25)) / 1.349", f"(quantile_cont({x}, 0.9) - quantile_cont({x}, 0.1)) / 2.563"
    return f"quantile_cont({x}, 0.5) AS {name}_centre, CASE WHEN {iqr} >= 1e-8 THEN {iqr} WHEN {wide} >= 1e-8 THEN {wide} ELSE 1.0 END AS {name}_scale"


def _rank(x: str) -> str:
    """The share of training rows below, by counts of smaller values in the union of both."""
    return f"CASE WHEN {x} IS NOT NULL THEN (SELECT count(*) FROM raw q WHERE q.split = 'train' AND q.{x} < s.{x}) / (SELECT count({x}) FROM raw WHERE split = 'train')::DOUBLE END"


_EFFECTIVE = "CASE WHEN {x}_n IS NOT NULL AND have > 0 THEN 0.25 / have ELSE 0.0 END"
_LIMITED = "(CASE WHEN total > 0 THEN least(total, least(0.05, 0.15 * score)) / total ELSE 0.0 END)"


def _discounts(name: str, strength: float, enabled: str, external: bool = False) -> str:
    """Context on ``norm``: at most one reason a layer, the first of the largest; with the evidence of context_external or none."""
    trusted, planned = ("id % 3 = 0 AND greatest(t + id % 7 - 3, 0) < t", "id % 2 = 0 AND greatest(t - 1, 0) < t") if external else ("false", "false")
    on = lambda rule, condition: f"coalesce({condition}, false)" if rule in enabled or enabled == "all" else "false"
    return f"""
  SELECT *, score - reduction AS adjusted0, greatest(0.0, least(1.0, score - reduction)) AS adjusted FROM (
    SELECT *, column_best * scale AS column_red, 0.0 * scale AS entity_red, temporal_best * scale AS temporal_red, column_best * scale + temporal_best * scale AS reduction FROM (
      SELECT *, CASE WHEN total > 0 THEN least(total, least(0.05, score * 0.15)) / total ELSE 0.0 END AS scale FROM (
        SELECT *, column_best + temporal_best AS total FROM (
          SELECT *, greatest(CASE WHEN m_typical THEN column_c * 0.10 * {strength} ELSE 0.0 END, CASE WHEN m_familiar THEN column_c * 0.15 * {strength} ELSE 0.0 END) AS column_best,
                 greatest(CASE WHEN m_frequent THEN temporal_c * 0.20 * {strength} ELSE 0.0 END, CASE WHEN m_hours OR m_weekend THEN temporal_c * 0.10 * {strength} ELSE 0.0 END) AS temporal_best
          FROM (
            SELECT *, {on("product_typical_amount", "amt >= lower AND amt <= upper AND NOT guard AND column_n >= 0.9")} AS m_typical,
                   {on("frequent_familiar_activity", "stable AND frequent = 1 AND hour_p >= 1.0::DOUBLE / 24")} AS m_frequent,
                   {on("familiar_high_amount", "stable AND frequent = 1 AND column_n >= 0.9")} AS m_familiar,
                   {on("business_hours", "stable AND business = 1")} AS m_hours,
                   {on("expected_weekend", f"stable AND weekend = 1 AND {planned}")} AS m_weekend, {on("verified_trust", f"stable AND {trusted}")} AS m_trust, {trusted} AS trusted, {planned} AS planned
            FROM (
              SELECT *, coalesce(prior_n >= 5 AND usual = 1 AND round(relative, 9) BETWEEN 0.8 AND 1.25 AND entity_raw <= 1.0 AND new_product = 0 AND NOT guard, false) AS stable
              FROM (SELECT n.*, p.lower, p.upper, coalesce(entity_raw >= 3.0, false) OR coalesce(c1h_k >= 10, false) OR coalesce(new_product = 1, false) OR coalesce(new_email = 1, false) OR coalesce(new_device = 1, false) AS guard
                    FROM norm n LEFT JOIN products p USING (product))))))))"""


_RULES = [
    ("R02_hourly_velocity", 95, "c1h_k >= 10"),
    ("R03_daily_velocity", 90, "c24h_k >= 30 AND temporal_n >= 0.95"),
    ("R04_amount_jump", 85, "prior_n >= 5 AND relative >= 3 AND entity_raw >= 3"),
    ("R06_new_product_and_email", 75, "prior_n >= 5 AND new_product = 1 AND new_email = 1"),
    ("R07_rare_product_card_amount", 70, "global_n >= 1000 AND pc_f < 0.005 AND column_n >= 0.95"),
    ("R09_high_adjusted_score", 60, "adjusted >= 0.85"),
]
_MONITOR = ("R10_familiar_activity", 10, "frequent = 1 AND usual = 1 AND adjusted < 0.6")
#: Rules on the multivariate layer, which these queries leave out.
_NEVER = ("R01_multi_entity_deviation", "R05_new_device_anomaly", "R08_rare_email_pair_anomaly")


def _decisions(source: str) -> str:
    flags = ", ".join(f"coalesce({c}, false) AS {n}" for n, _, c in [*_RULES, _MONITOR])
    ranked = [*_RULES, _MONITOR]
    first = lambda value: "CASE " + " ".join(f"WHEN {n} THEN {value(n, q)}" for n, q, _ in ranked) + " END"
    review = " OR ".join(n for n, _, _ in _RULES)
    return f"""
  SELECT *, {" + ".join(f"{n}::BIGINT" for n, _, _ in ranked)} AS matched, {first(lambda n, q: f"'{n}'")} AS winner, {first(lambda n, q: f"{q}::BIGINT")} AS priority,
         CASE WHEN {review} THEN 'review' WHEN {_MONITOR[0]} THEN 'monitor' ELSE 'no_rule_match' END AS action, ({review}) AND {_MONITOR[0]} AS conflict
  FROM (SELECT *, {flags} FROM {source})"""


_PARTS = {
    "txn": _txn("txn", 60),
    "txnh": _txn("txnh", 3600),
    "hist": _history("txn"),
    "histh": _history("txnh"),
    "ord": "SELECT o_orderkey AS id, date_diff('day', DATE '1995-01-01', o_orderdate::DATE) * 86400 AS t, o_custkey AS cust, o_totalprice AS amt FROM orders",
    "ords": _split("ord"),
    "txns": _split("txn"),
    "feat": f"""
  SELECT h.*, CASE WHEN known THEN c1h END AS c1h_k, CASE WHEN known THEN c24h END AS c24h_k, count(*) OVER ({_BEFORE}) AS global_n,
         (known AND n >= 20 AND coalesce(span, 0) >= 7)::INT::DOUBLE AS frequent, CASE WHEN known AND n >= 5 THEN (relative BETWEEN 2.0::DOUBLE / 3 AND 1.5)::INT::DOUBLE END AS usual,
         count(*) OVER (PARTITION BY product, card4 {_BEFORE}) / nullif(count(*) OVER ({_BEFORE}), 0)::DOUBLE AS pc_f,
         CASE WHEN ((t // 86400) + 0) % 7 < 5 AND (t // 3600) % 24 >= 9 AND (t // 3600) % 24 < 17 THEN 1.0 ELSE 0.0 END AS business,
         CASE WHEN (t // 86400) % 7 >= 5 THEN 1.0 ELSE 0.0 END AS weekend
  FROM hist h""",
    "feats": _split("feat"),
    "refs": f"SELECT {_robust('ln(1 + amt)', 'a')}, {_robust('CASE WHEN prior_n >= 5 THEN ln(1 + c1h_k) END', 'h')}, {_robust('CASE WHEN prior_n >= 5 THEN ln(1 + c24h_k) END', 'd')}, {_robust('CASE WHEN prior_n >= 5 THEN -ln(hour_p) END', 'p')} FROM feats WHERE split = 'train'",
    "raw": """
  SELECT *, round(column_raw0, 9) AS column_raw, round(greatest(dev, nov), 9) AS entity_raw, round(greatest(v1, v24, vh), 9) AS temporal_raw
  FROM (
    SELECT f.*, abs(ln(1 + amt) - a_centre) / a_scale AS column_raw0,
           CASE WHEN prior_n >= 5 THEN abs(amt - prior_mean) / greatest(prior_std, prior_mean * 0.1, 1.0) END AS dev,
           CASE WHEN prior_n >= 5 THEN 2.0 * greatest(new_product, new_email, new_device) END AS nov,
           CASE WHEN prior_n >= 5 THEN greatest((ln(1 + c1h_k) - h_centre) / h_scale, 0.0) END AS v1,
           CASE WHEN prior_n >= 5 THEN greatest((ln(1 + c24h_k) - d_centre) / d_scale, 0.0) END AS v24,
           CASE WHEN prior_n >= 5 THEN greatest((-ln(hour_p) - p_centre) / p_scale, 0.0) END AS vh
    FROM feats f, refs)""",
    "ranked": f"SELECT s.*, {_rank('column_raw')} AS column_n, {_rank('entity_raw')} AS entity_n, {_rank('temporal_raw')} AS temporal_n FROM raw s",
    "norm": f"""
  SELECT *, column_c + entity_c + temporal_c AS score FROM (
    SELECT *, {_EFFECTIVE.format(x="column")} * coalesce(column_n, 0) AS column_c, {_EFFECTIVE.format(x="entity")} * coalesce(entity_n, 0) AS entity_c, {_EFFECTIVE.format(x="temporal")} * coalesce(temporal_n, 0) AS temporal_c
    FROM (SELECT *, CASE WHEN column_n IS NOT NULL THEN 0.25 ELSE 0.0 END + CASE WHEN entity_n IS NOT NULL THEN 0.25 ELSE 0.0 END + CASE WHEN temporal_n IS NOT NULL THEN 0.25 ELSE 0.0 END AS have FROM ranked))""",
    "products": "SELECT product, count(*) AS support, quantile_cont(amt, 0.1) AS lower, quantile_cont(amt, 0.9) AS upper FROM feats WHERE split = 'train' GROUP BY product HAVING count(*) >= 100",
    "ctx": _discounts("ctx", 1.0, "all"),
    "ctx0": _discounts("ctx0", 0.0, "all"),
    "ctxb": _discounts("ctxb", 1.0, "business_hours"),
    "ctxe": _discounts("ctxe", 1.0, "all", True),
    "dec": _decisions("ctx"),
    "dec0": _decisions("ctx0"),
    "lab": "SELECT d.doc_id AS id, d.n_chars::DOUBLE AS score, (d.doc_id * 7919 % 1000 / 1000.0)::DOUBLE AS other, toxic::INT AS y FROM documents d JOIN labels l USING (doc_id)",
}


def _needs(sql: str) -> list[str]:
    """The parts that a statement names, in the order in which they are defined."""
    found: set[str] = set()
    todo = [sql]
    while todo:
        text = todo.pop()
        for name, part in _PARTS.items():
            if name not in found and re.search(rf"(FROM|JOIN|,)\s+{name}\b", text):
                found.add(name)
                todo.append(part)
    return [n for n in _PARTS if n in found]


def says(name: str, sql: str) -> None:
    parts = ",\n".join(f"{n} AS ({_PARTS[n]})" for n in _needs(sql))
    ORACLES[name] = f"WITH {parts}\n{sql}" if parts else sql


def _confusion(decided: str, label: str, source: str) -> str:
    n = lambda c: f"count(*) FILTER ({c})"
    d, y = f"({decided})", f"({label})"
    return f"""SELECT {n(d)} AS alerts, {n(f"{d} AND {y}")} AS tp, {n(f"{d} AND NOT {y}")} AS fp, {n(f"NOT {d} AND {y}")} AS fn, {n(f"NOT {d} AND NOT {y}")} AS tn,
  {r(f"{n(f'{d} AND {y}')} / nullif({n(d)}, 0)::DOUBLE")} AS "precision", {r(f"{n(f'{d} AND {y}')} / nullif({n(y)}, 0)::DOUBLE")} AS recall, {r(f"{n(f'{d} AND NOT {y}')} / nullif({n(f'NOT {y}')}, 0)::DOUBLE")} AS fpr FROM {source}"""


# Joins, checks and parts
says("join_presence_audit", f"SELECT count(*) AS joined_rows, sum(has_identity::INT)::BIGINT AS identity_rows, {r('avg(has_identity::INT)')} AS identity_coverage, sum(fraud)::BIGINT AS positive_rows, {r('avg(fraud)')} AS positive_rate, sum((amt = 0)::INT)::BIGINT AS zero_amount_rows FROM txn")
says("join_presence_rows", 'SELECT id AS "TransactionID", t::DOUBLE AS "TransactionDT", id_score, has_identity FROM txn')
says("orphan_anti", "SELECT doc_id, lang, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE doc_id IS NOT NULL)")
says("labelled_semi", "SELECT doc_id, lang, n_chars FROM documents WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = documents.doc_id AND toxic = 1)")
says("key_audit", "SELECT count(DISTINCT id) AS keys, 0::BIGINT AS null_keys, (count(*) - count(DISTINCT id))::BIGINT AS repeated_keys, sum((amt < 0)::INT)::BIGINT AS negative_amounts, sum((addr1 IS NULL)::INT)::BIGINT AS incomplete_entities FROM txn")
_SPLITS = "SELECT split, count(*) AS rows, min(t)::DOUBLE AS first_time, max(t)::DOUBLE AS last_time FROM {} GROUP BY split"
says("split_counts", _SPLITS.format("txns"))
says("split_ties", _SPLITS.format("ords"))
says("split_halves", "SELECT t < (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM ords WHERE split = 'validation') WHERE i = floor((SELECT count(*) FROM ords WHERE split = 'validation') * 0.5::DOUBLE) + 1) AS calibration, count(*) AS rows, max(t)::DOUBLE AS last_time FROM ords WHERE split = 'validation' GROUP BY 1")
_EDGE = "(SELECT min(t)::DOUBLE AS lo, (nextafter(max(t)::DOUBLE, 'inf'::DOUBLE) - min(t)::DOUBLE) / 3 AS w, nextafter(max(t)::DOUBLE, 'inf'::DOUBLE) AS hi FROM ords WHERE split = 'validation')"
_START, _STOP = "lo + (f.fold - 1) * w", "CASE WHEN f.fold = 3 THEN hi ELSE lo + f.fold * w END"
_FOLD = f"""(SELECT o.*, f.fold, CASE WHEN t >= {_START} AND t < {_STOP} THEN 'audit' WHEN t < {_START} - {{}} * 86400 THEN 'train' END AS part
  FROM ords o, {_EDGE} e, (SELECT unnest([1, 2, 3])::INT AS fold) f WHERE split <> 'test')"""
says("fold_windows", f"SELECT fold, part, count(*) AS rows, min(t)::DOUBLE AS first_time, max(t)::DOUBLE AS last_time FROM {_FOLD.format('7.0')} WHERE part IS NOT NULL GROUP BY fold, part")
says("fold_disjointness", f"SELECT count(a.id) AS covered, count(*) FILTER (a.n > 1) AS twice, count(*) FILTER (a.id IS NULL) AS missed FROM ords v LEFT JOIN (SELECT id, count(*) AS n FROM {_FOLD.format('0.0')} WHERE part = 'audit' GROUP BY id) a ON a.id = v.id WHERE v.split = 'validation'")
says("block_bucket_counts", "SELECT (t - (SELECT min(t) FROM txn)) // 86400 AS block, count(*) AS rows, sum(fraud)::BIGINT AS positives FROM txn GROUP BY 1")

# History
_ID = 'id AS "TransactionID"'
says("entity_prior_stats", f"SELECT {_ID}, prior_n AS prior_transaction_count, {r('prior_mean')} AS prior_mean_amount, {r('prior_std')} AS prior_std_amount, {r('relative')} AS amount_to_prior_mean, {r('z')} AS amount_zscore FROM histh")
says("velocity_windows", f"SELECT {_ID}, CASE WHEN known THEN c1h END AS prior_count_1h, CASE WHEN known THEN c24h END AS prior_count_24h FROM hist")
says("recency_span", f"SELECT {_ID}, since AS seconds_since_previous, {r('span')} AS history_span_days FROM hist")
says("distinct_history", f"SELECT {_ID}, CASE WHEN known THEN d_product END AS prior_distinct_products, CASE WHEN known THEN d_email END AS prior_distinct_email_domains, CASE WHEN known THEN d_device END AS prior_distinct_devices FROM histh")
says("novelty_flags", f"SELECT {_ID}, new_product AS entity_product_is_new, new_email AS entity_email_is_new, new_device AS entity_device_is_new FROM histh")
says("hour_probability", f"SELECT {_ID}, {r('hour_p')} AS entity_hour_probability FROM histh")
says("history_flags", f"SELECT {_ID}, (known AND n >= 5)::INT::DOUBLE AS history_sufficient, (known AND n >= 20 AND coalesce(span, 0) >= 7)::INT::DOUBLE AS frequent_entity, CASE WHEN known AND n >= 5 THEN (relative BETWEEN 2.0::DOUBLE / 3 AND 1.5)::INT::DOUBLE END AS usual_amount FROM histh")
says("calendar_features", f"""SELECT {_ID}, t // 86400 AS relative_day, (t // 3600) % 24 AS hour_phase, ((t // 3600) % 24)::DOUBLE AS hour, ((t // 86400) % 7)::DOUBLE AS day_of_week, ((t // 86400) % 7 >= 5)::INT::DOUBLE AS is_weekend,
  ((t // 86400) % 7 < 5 AND (t // 3600) % 24 BETWEEN 9 AND 16)::INT::DOUBLE AS is_business_hours, (email = recipient)::INT::DOUBLE AS email_domains_match, known::INT::DOUBLE AS entity_known,
  {r("sin(2 * pi() * (t % 86400) / 86400)")} AS hour_sin, {r("cos(2 * pi() * (t % 86400) / 86400)")} AS hour_cos, {r("ln(1 + amt)")} AS log_amount FROM txn""")
says("global_prefix_count", f"SELECT {_ID}, count(*) OVER ({_BEFORE}) AS prior_global_count FROM txnh")
_FREQ = "CASE WHEN {c} IS NOT NULL THEN " + r("count(*) OVER (PARTITION BY {c} " + _BEFORE + ") / nullif(count({c}) OVER (" + _BEFORE + "), 0)::DOUBLE") + " END AS {n}_prior_frequency"
says("category_frequency", f"SELECT {_ID}, {', '.join(_FREQ.format(c=c, n=c) for c in ('product', 'email', 'device'))} FROM txnh")
says("pair_support", f"""SELECT {_ID}, count(*) OVER (PARTITION BY product, card4 {_BEFORE}) AS product_card_prior_support, CASE WHEN pair IS NOT NULL THEN count(*) OVER (PARTITION BY pair {_BEFORE}) END AS email_pair_prior_support,
  {r(f"count(*) OVER (PARTITION BY product, card4 {_BEFORE}) / nullif(count(*) OVER ({_BEFORE}), 0)::DOUBLE")} AS product_card_prior_frequency, {_FREQ.format(c="pair", n="email_pair")}
  FROM (SELECT *, email || '/' || recipient AS pair FROM txnh)""")
_GONE = {"prior_mean_amount": "prior_mean", "prior_std_amount": "prior_std", "entity_device_is_new": "new_device", "email_prior_frequency": "ef", "usual_amount": "usual"}
says("feature_null_ratios", " UNION ALL ".join(f"""SELECT split, '{n}' AS "column", {r(f"avg(({c} IS NULL)::INT)")} AS null_ratio FROM (SELECT *, CASE WHEN email IS NOT NULL AND count(email) OVER ({_BEFORE}) > 0 THEN 1 END AS ef FROM feats) GROUP BY split""" for n, c in _GONE.items()))
says("customer_day_history", f"SELECT {_ID}, count(*) OVER (PARTITION BY cust {_BEFORE}) AS prior_orders, {r(f'avg(amt) OVER (PARTITION BY cust {_BEFORE})', 4)} AS prior_mean FROM ord")

# Profiles
_COLS = {"card1": "card1", "addr1": "addr1", "card4": "card4", "ProductCD": "product", "P_emaildomain": "email", "DeviceInfo": "device", "isFraud": "fraud"}
says("column_profile", " UNION ALL ".join(f"""SELECT '{n}' AS "column", count(*) AS rows, count(*) - count({c}) AS nulls, count(DISTINCT {c}) AS distinct_values, {r(f"(count(*) - count({c})) / count(*)::DOUBLE")} AS null_ratio,
  {r(f"count(DISTINCT {c}) / nullif(count({c}), 0)::DOUBLE")} AS unique_ratio, count(DISTINCT {c}) <= 1 AS "constant", count(DISTINCT {c}) >= 100 OR (count(DISTINCT {c}) >= 20 AND count(DISTINCT {c}) / nullif(count({c}), 0)::DOUBLE >= 0.05) AS high_cardinality FROM txn""" for n, c in _COLS.items()))
_Q = lambda c, q: f"quantile_cont({c}, {q})"
says("numeric_profile", " UNION ALL ".join(f"""SELECT '{n}' AS "column", count({c}) AS finite_count, 0::BIGINT AS infinite_count, {_Q(c, 0.75)} - {_Q(c, 0.25)} = 0 AS zero_iqr, {r(f"min({c})")} AS min, {r(f"max({c})")} AS max, {r(f"avg({c})")} AS mean, {r(f"stddev_pop({c})")} AS std,
  {", ".join(f"{r(_Q(c, q))} AS {a}" for a, q in (("p01", 0.01), ("p25", 0.25), ("median", 0.5), ("p75", 0.75), ("p99", 0.99)))}, {r(f"{_Q(c, 0.75)} - {_Q(c, 0.25)}")} AS iqr,
  {r(f"(SELECT avg(({c} < lo OR {c} > hi)::INT) FROM txn, (SELECT {_Q(c, 0.25)} - 1.5 * ({_Q(c, 0.75)} - {_Q(c, 0.25)}) AS lo, {_Q(c, 0.75)} + 1.5 * ({_Q(c, 0.75)} - {_Q(c, 0.25)}) AS hi FROM txn))")} AS outlier_ratio FROM txn""" for n, c in (("TransactionAmt", "amt"), ("card2", "card2"), ("addr1", "addr1"))))
_TOP = "(SELECT device AS value, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, device) AS place FROM txn WHERE device IS NOT NULL GROUP BY device)"
says("category_topn", f"SELECT value, n, place FROM {_TOP} WHERE place <= 10 UNION ALL SELECT '(other)', coalesce(sum(n) FILTER (place > 10), 0)::BIGINT, 11 FROM {_TOP} UNION ALL SELECT '(missing)', count(*) FILTER (device IS NULL), 12 FROM txn")
_PAIRS = "(SELECT recipient, device, count(*) AS n FROM txn WHERE recipient IS NOT NULL AND device IS NOT NULL GROUP BY ALL)"
says("rare_combos", f"SELECT sum(n)::BIGINT AS rows, count(*) AS pairs, count(*) FILTER (n <= 95) AS rare_pairs, coalesce(sum(n) FILTER (n <= 95), 0)::BIGINT AS rare_rows, (SELECT count(*) FROM txn WHERE recipient IS NULL OR device IS NULL) AS excluded_rows FROM {_PAIRS}")
says("rare_combo_examples", f'SELECT recipient AS "R_emaildomain", device AS "DeviceInfo", n FROM {_PAIRS} WHERE n <= 95 ORDER BY n, recipient, device LIMIT 15')


def _rho(a: str, b: str, na: str, nb: str) -> str:
    rank = lambda c: f"(rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0::DOUBLE)"
    return f"SELECT '{na}' AS first, '{nb}' AS second, count(*) AS n, {r('corr(x, y)')} AS rho FROM (SELECT {rank(a)} AS x, {rank(b)} AS y FROM txn WHERE {a} IS NOT NULL AND {b} IS NOT NULL)"


says("spearman_pairs", " UNION ALL ".join((_rho("amt", "card1", "TransactionAmt", "card1"), _rho("card1", "addr1", "card1", "addr1"), _rho("t", "amt", "TransactionDT", "TransactionAmt"))))
_NAMED = {"TransactionAmt": "amt", "card1": "card1", "addr1": "addr1", "TransactionDT": "t"}
_COUPLES = [(a, b) for i, a in enumerate(_NAMED) for b in list(_NAMED)[i + 1 :]]
says("spearman_top", f"SELECT * FROM ({' UNION ALL '.join(_rho(_NAMED[a], _NAMED[b], a, b) for a, b in _COUPLES)}) ORDER BY abs(rho) DESC LIMIT 3")
says("entity_profile", f"SELECT card1, count(*) AS transactions, {r('avg(amt)')} AS mean_amount, {r('stddev_samp(amt)')} AS std_amount, min(t)::DOUBLE AS first_time, max(t)::DOUBLE AS last_time, count(DISTINCT product) AS products, count(DISTINCT email) AS email_domains, count(DISTINCT t // 86400) AS active_days FROM txn WHERE known GROUP BY card1")
_GAPS = "(SELECT id, (t - lag(t) OVER (PARTITION BY u ORDER BY t, id))::DOUBLE AS gap FROM {} WHERE known)"
_SIZES = "(SELECT count(*) AS n FROM txnh WHERE known GROUP BY u)"
says("gap_summary", f"""SELECT sum(n)::BIGINT AS eligible_rows, (SELECT count(*) FROM txnh WHERE NOT known) AS excluded_rows, count(*) AS entities, count(*) FILTER (n = 1) AS singletons, {r(_Q("n", 0.5))} AS size_p50, {r(_Q("n", 0.9))} AS size_p90, {r(_Q("n", 0.99))} AS size_p99,
  (SELECT {r(_Q("gap", 0.5))} FROM {_GAPS.format("txnh")}) AS median_gap, (SELECT count(*) FILTER (gap = 0) FROM {_GAPS.format("txnh")}) AS zero_gaps FROM {_SIZES}""")
says("entity_gaps", f"SELECT {_ID}, gap FROM {_GAPS.format('txn')} WHERE gap IS NOT NULL")
says("daily_volume", f"SELECT t // 86400 AS day, count(*) AS rows, {r('sum(amt)', 2)} AS amount FROM txn GROUP BY 1")
says("part_supply_profile", f"""SELECT r_name, p_brand, count(*) AS rows, sum(l_quantity) AS quantity, {r("sum(l_extendedprice)", 2)} AS price FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY r_name, p_brand""")

# Layers and scores
_REF = f"SELECT {_robust('ln(1 + amt)', 'amount')}, {_robust('addr1', 'addr')} FROM txns WHERE split = 'train'"
says("robust_reference", f"SELECT {', '.join(f'{r(c)} AS {c}' for c in ('amount_centre', 'amount_scale', 'addr_centre', 'addr_scale'))} FROM ({_REF})")
says("column_layer", f"SELECT {_ID}, {r('column_raw')} AS column_raw FROM raw")
says("entity_layer", f"SELECT {_ID}, {r('dev')} AS entity_amount_deviation, nov AS entity_relation_novelty, {r('entity_raw')} AS entity_raw FROM raw")
says("temporal_layer", f"SELECT {_ID}, {r('v1')} AS temporal_velocity_1h, {r('v24')} AS temporal_velocity_24h, {r('vh')} AS temporal_hour_rarity, {r('temporal_raw')} AS temporal_raw FROM raw")
_LESS = "(SELECT count(*) FROM txns q WHERE q.split = 'train' AND q.amt < s.amt) / (SELECT count(*) FROM txns WHERE split = 'train')::DOUBLE"
says("strict_rank_norm", f"SELECT {_ID}, split, {r(_LESS)} AS rank FROM txns s")
says("aggregate_available", f"SELECT {_ID}, {r('have')} AS available_weight, {r('column_n')} AS column_normalized, {r('entity_n')} AS entity_normalized, {r('temporal_n')} AS temporal_normalized, {r(_EFFECTIVE.format(x='column'))} AS column_effective_weight, {r('entity_c')} AS entity_contribution, {r('score')} AS raw_anomaly_score FROM norm")
says("score_quantiles", f"SELECT split, {', '.join(f'{r(_Q('score', q))} AS {a}' for a, q in (('q50', 0.5), ('q90', 0.9), ('q99', 0.99)))}, {r('avg((entity_raw IS NOT NULL)::INT)')} AS entity_coverage, {r('avg((temporal_raw IS NOT NULL)::INT)')} AS temporal_coverage, {r('0.0')} AS multivariate_coverage FROM norm GROUP BY split")
says("contribution_audit", "SELECT count(*) AS rows, sum((abs(column_c + entity_c + temporal_c - score) > 1e-9)::INT)::BIGINT AS unequal_sums, sum((NOT score BETWEEN 0 AND 1)::INT)::BIGINT AS out_of_range FROM norm")

# Context
says("product_reference", f'SELECT product AS "ProductCD", support, {r("lower")} AS lower, {r("upper")} AS upper FROM products')
says("context_guard", f"SELECT {_ID}, guard AS context_guard_active, m_typical AS context_match_product_typical_amount, m_frequent AS context_match_frequent_familiar_activity, m_familiar AS context_match_familiar_high_amount, m_hours AS context_match_business_hours, m_weekend AS context_match_expected_weekend, m_trust AS context_match_verified_trust FROM ctx")
_COLUMN_REASON = "CASE WHEN column_red > 0 THEN CASE WHEN m_typical AND column_c * 0.10 * 1.0 = column_best THEN 'product_typical_amount' ELSE 'familiar_high_amount' END ELSE 'none' END AS context_column_reason"
_TEMPORAL_REASON = "CASE WHEN temporal_red > 0 THEN CASE WHEN m_frequent AND temporal_c * 0.20 * 1.0 = temporal_best THEN 'frequent_familiar_activity' ELSE 'business_hours' END ELSE 'none' END AS context_temporal_reason"
says("context_discounts", f"SELECT {_ID}, {r('column_red')} AS context_column_reduction, {r('entity_red')} AS context_entity_reduction, {r('temporal_red')} AS context_temporal_reduction, {_COLUMN_REASON}, {_TEMPORAL_REASON} FROM ctx")
says("context_capped", f"SELECT {_ID}, {r('score')} AS raw_anomaly_score, {r('reduction')} AS context_reduction, {r('adjusted')} AS adjusted_anomaly_score FROM ctx")
_EXTERNAL_REASON = "CASE WHEN temporal_red > 0 THEN CASE WHEN m_frequent AND temporal_c * 0.20 * 1.0 = temporal_best THEN 'frequent_familiar_activity' WHEN m_hours THEN 'business_hours' ELSE 'expected_weekend' END ELSE 'none' END AS context_temporal_reason"
says("context_external", f"SELECT {_ID}, m_trust AS context_match_verified_trust, m_weekend AS context_match_expected_weekend, trusted AS context_trust_available, planned AS context_weekend_schedule_available, {_EXTERNAL_REASON}, {r('reduction')} AS context_reduction, {r('adjusted')} AS adjusted_anomaly_score FROM ctxe")
says("context_ablation", f"SELECT {_ID}, {r('reduction')} AS context_reduction, {_TEMPORAL_REASON} FROM ctxb")
_RISK = """(SELECT product, n >= 100 AS supported, CASE WHEN n >= 100 THEN greatest(-1.0, least(1.0, ln(((f + 100 * g) / (n + 100)) / g))) ELSE 0.0 END AS risk
  FROM (SELECT product, count(*) AS n, sum(fraud)::DOUBLE AS f FROM feats WHERE split = 'train' GROUP BY product), (SELECT avg(fraud) AS g FROM feats WHERE split = 'train'))"""
_PARTS["ctxn"] = _discounts("ctxn", 1.0, "frequent_familiar_activity familiar_high_amount business_hours")
says("product_risk", f"""SELECT {_ID}, available AS product_context_available, blocked AS product_context_reduction_blocked, {r("risk0")} AS product_context_log_relative_risk, {r("moved - adjusted")} AS product_context_adjustment, {r("moved")} AS adjusted_anomaly_score FROM (
  SELECT *, greatest(0.0, least(1.0, adjusted + CASE WHEN blocked THEN 0.0 ELSE 0.1 * risk0 END)) AS moved FROM (
    SELECT *, 0.1 * risk0 < 0 AND guard AS blocked FROM (
      SELECT *, CASE WHEN available THEN coalesce(risk, 0.0) ELSE 0.0 END AS risk0 FROM (
        SELECT c.*, k.risk, coalesce(k.supported AND c.t > (SELECT max(t) FROM feats WHERE split = 'train'), false) AS available FROM ctxn c LEFT JOIN {_RISK} k USING (product)))))""")

# Rules
_HITS = [*((n, n) for n, _, _ in [*_RULES, _MONITOR]), *((n, "false") for n in _NEVER)]
says("rule_matches", f"SELECT {_ID}, matched AS matched_rule_count, {', '.join(f'{c} AS rule_match_{n}' for n, c in _HITS)} FROM dec")
says("rule_decisions", f"SELECT {_ID}, split, action AS rule_action, winner AS winning_rule, priority AS winning_priority, matched AS matched_rule_count, conflict AS rule_action_conflict FROM dec")
_HALF = "(SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM {0} WHERE split = 'validation') WHERE i = floor((SELECT count(*) FROM {0} WHERE split = 'validation') * 0.5::DOUBLE) + 1)"
_AUDIT = f"split = 'validation' AND t >= {_HALF}"
says("rule_activity", " UNION ALL ".join(f"SELECT '{n}' AS rule, coalesce(sum(({c})::INT), 0)::BIGINT AS matches, count(*) FILTER (({c}) AND {_AUDIT.format('dec')}) AS audit_matches, count(*) FILTER (winner = '{n}') AS wins FROM dec" for n, c in _HITS))
says("action_transitions", "SELECT a.split, a.action AS old_action, b.action AS new_action, count(*) AS rows FROM dec0 a JOIN dec b ON a.id = b.id GROUP BY ALL")
says("decision_metrics", _confusion("action = 'review'", "fraud = 1", "dec WHERE split <> 'train'"))

# Evaluation
says("confusion_threshold", _confusion("score >= 2000", "y = 1", "lab"))
_TOPK = "(SELECT *, row_number() OVER (ORDER BY {} DESC, id) AS i, count(*) OVER () AS n FROM lab)"
says("confusion_budget", _confusion("i <= ceil(n * 0.05::DOUBLE)", "y = 1", _TOPK.format("other")))
says("budget_topk", f'SELECT {_ID}, other, y AS "isFraud" FROM {_TOPK.format("other")} WHERE i <= ceil(n * 0.1::DOUBLE)')
says("budget_sweep", " UNION ALL ".join(f"SELECT '{s}' AS ranking, {q}::DOUBLE AS rate, count(*) AS reviews, count(*) FILTER (y = 1) AS hits FROM {_TOPK.format(s)} WHERE i <= ceil(n * {q}::DOUBLE)" for s in ("score", "other") for q in (0.01, 0.05, 0.1)))
says("average_precision", f"SELECT {r('sum(p * tp / seen) / max(tp)')} AS average_precision FROM (SELECT sum(y)::DOUBLE AS p, sum(sum(y)) OVER (ORDER BY other DESC)::DOUBLE AS tp, sum(count(*)) OVER (ORDER BY other DESC)::DOUBLE AS seen FROM lab GROUP BY other)")
says("roc_auc", f"SELECT {r('(sum(k) FILTER (y = 1) - count(*) FILTER (y = 1) * (count(*) FILTER (y = 1) + 1) / 2.0::DOUBLE) / (count(*) FILTER (y = 1) * count(*) FILTER (y = 0))::DOUBLE')} AS roc_auc FROM (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS k FROM lab)")
_B, _A = "round(score, 9) >= 0.7", "round(adjusted, 9) >= 0.7"
says("paired_effect", f"SELECT count(*) FILTER ({_B} AND NOT {_A} AND fraud = 0) AS removed_false_positives, count(*) FILTER (NOT {_B} AND {_A} AND fraud = 0) AS added_false_positives, count(*) FILTER ({_B} AND NOT {_A} AND fraud = 1) AS lost_true_positives, count(*) FILTER (NOT {_B} AND {_A} AND fraud = 1) AS added_true_positives FROM ctx WHERE split = 'validation'")
_NET = "SELECT split, threshold, count(*) FILTER (raw >= threshold AND fraud = 0) - count(*) FILTER (adj >= threshold AND fraud = 0) AS fp, count(*) FILTER (raw >= threshold AND fraud = 1) - count(*) FILTER (adj >= threshold AND fraud = 1) AS tp, count(*) FILTER (raw >= threshold) - count(*) FILTER (adj >= threshold) AS reviews FROM (SELECT split, fraud, round(score, 9) AS raw, round(adjusted, 9) AS adj FROM ctx), (SELECT unnest([0.5, 0.7, 0.9])::DOUBLE AS threshold) GROUP BY split, threshold"
says("break_even_ratios", f"SELECT split, threshold, fp AS net_false_positives_removed, tp AS net_true_positives_lost, reviews AS removed_reviews, {r('a')} AS false_positive_cost_only, {r('b')} AS every_review_costs, {r('c')} AS partial_prevention FROM (SELECT *, CASE WHEN tp > 0 THEN fp / tp::DOUBLE END AS a, CASE WHEN tp > 0 THEN reviews / tp::DOUBLE END AS b, CASE WHEN tp > 0 THEN fp / tp::DOUBLE / 0.5::DOUBLE END AS c FROM ({_NET}))")
_HIGHER = "(SELECT score FROM (SELECT score, row_number() OVER (ORDER BY score) AS i, count(*) OVER () AS n FROM lab) WHERE i = ceil((n - 1) * 0.95::DOUBLE) + 1)"
says("higher_quantile_threshold", f"SELECT {_HIGHER} AS threshold, count(*) FILTER (score >= {_HIGHER}) AS alerts FROM lab")
_KTH = "(SELECT other FROM (SELECT other, row_number() OVER (ORDER BY other DESC) AS i FROM lab) WHERE i = 25)"
says("equal_volume_threshold", f"SELECT {_KTH} AS threshold, count(*) FILTER (other >= {_KTH}) AS alerts FROM lab")
_STRENGTH = """(SELECT strength, count(*) FILTER (s >= 0.7 AND fraud = 1) AS tp, count(*) FILTER (s >= 0.7 AND fraud = 0) AS fp, count(*) FILTER (fraud = 1) AS pos FROM
  (SELECT fraud, x.strength, round(score - x.strength * reduction, 9) AS s FROM ctx, (SELECT unnest([0.0, 0.25, 0.5, 1.0])::DOUBLE AS strength) x WHERE split = 'validation') GROUP BY strength)"""
says("strength_selection", f"""SELECT strength, tp, fp, {r("loss")} AS recall_drop, gain AS false_positives_removed, eligible, eligible AND row_number() OVER (ORDER BY eligible DESC, gain DESC, loss, strength) = 1 AS chosen FROM (
  SELECT *, coalesce(loss <= 0.01 + 1e-12, false) AS eligible FROM (SELECT s.*, (b.tp - s.tp) / nullif(s.pos, 0)::DOUBLE AS loss, b.fp - s.fp AS gain FROM {_STRENGTH} s, {_STRENGTH} b WHERE b.strength = 0))""")
_THERE = lambda x, w: f"CASE WHEN {x}_n IS NOT NULL THEN {w} ELSE 0.0 END"


def _weighted(weights: dict[str, str]) -> str:
    top = " + ".join(f"{_THERE(x, w)} * coalesce({x}_n, 0)" for x, w in weights.items())
    return f"round(({top}) / nullif({' + '.join(_THERE(x, w) for x, w in weights.items())}, 0)::DOUBLE, 9)"


#: The candidates' weights of the layers that SQL has.
_CANDIDATES = {
    "equal": (0.25, 0.25, 0.25), "column_emphasis": (0.55, 0.15, 0.15), "multivariate_emphasis": (0.15, 0.15, 0.15), "entity_emphasis": (0.15, 0.55, 0.15), "temporal_emphasis": (0.15, 0.15, 0.55),
    "multivariate_entity": (0.10, 0.40, 0.10), "entity_temporal": (0.10, 0.40, 0.40), "multivariate_temporal": (0.10, 0.10, 0.40), "behavior_emphasis": (0.10, 0.30, 0.30),
}
_PLANS = ", ".join(f"({i}, '{n}', {c}::DOUBLE, {e}::DOUBLE, {w}::DOUBLE)" for i, (n, (c, e, w)) in enumerate(_CANDIDATES.items()))
_PARTS["cal"] = f"SELECT * FROM norm WHERE split = 'validation' AND t < {_HALF.format('norm')}"
_PARTS["scores"] = f"""SELECT id, fraud, t < (SELECT t FROM (SELECT t, row_number() OVER (ORDER BY t) AS i FROM cal) WHERE i = floor((SELECT count(*) FROM cal) * 0.5::DOUBLE) + 1) AS early, place, candidate,
  {_weighted({"column": "c", "entity": "e", "temporal": "w"})} AS s FROM cal, (VALUES {_PLANS}) v(place, candidate, c, e, w)"""
says("weight_search", f"""SELECT candidate, minimum_gain, hits, {r("ap")} AS average_precision, row_number() OVER (ORDER BY minimum_gain DESC, hits DESC, round(ap, 9) DESC, place) = 1 AS chosen FROM (
  SELECT a.place, a.candidate, least(a.h1 - b.h1, a.h2 - b.h2) AS minimum_gain, a.h AS hits, ap FROM (
    SELECT place, candidate, count(*) FILTER (early AND i <= k AND fraud = 1) AS h1, count(*) FILTER (NOT early AND i <= k AND fraud = 1) AS h2, count(*) FILTER (j <= l AND fraud = 1) AS h FROM g GROUP BY ALL) a,
    (SELECT count(*) FILTER (early AND i <= k AND fraud = 1) AS h1, count(*) FILTER (NOT early AND i <= k AND fraud = 1) AS h2 FROM g WHERE place = 0) b,
    (SELECT place, sum(p * tp / seen) / max(tp) AS ap FROM (SELECT place, sum(fraud)::DOUBLE AS p, sum(sum(fraud)) OVER (PARTITION BY place ORDER BY s DESC)::DOUBLE AS tp, sum(count(*)) OVER (PARTITION BY place ORDER BY s DESC)::DOUBLE AS seen FROM g GROUP BY place, s) GROUP BY place) c
  WHERE c.place = a.place)""".replace("FROM g ", """FROM (
    SELECT *, row_number() OVER (PARTITION BY place, early ORDER BY s DESC, id) AS i, ceil(count(*) OVER (PARTITION BY place, early) * 0.05::DOUBLE) AS k, row_number() OVER (PARTITION BY place ORDER BY s DESC, id) AS j, ceil(count(*) OVER (PARTITION BY place) * 0.05::DOUBLE) AS l FROM scores) """))
_THREE = ("column", "entity", "temporal")
_RANKINGS = {"raw": _THREE} | {f"only_{x}": (x,) for x in _THREE} | {f"without_{x}": tuple(y for y in _THREE if y != x) for x in _THREE}
says("layer_contribution", " UNION ALL ".join(f"""SELECT '{n}' AS ranking, max(k) AS reviews, count(*) FILTER (i <= k AND fraud = 1) AS hits, count(*) FILTER (s < 0) AS unscored FROM (
  SELECT *, row_number() OVER (ORDER BY s DESC, id) AS i, ceil(count(*) OVER () * 0.05::DOUBLE)::BIGINT AS k FROM (SELECT id, fraud, coalesce({_weighted(dict.fromkeys(own, "1.0"))}, -1.0) AS s FROM norm WHERE {_AUDIT.format("norm")}))""" for n, own in _RANKINGS.items()))
_RAW, _ADJUSTED = "round(score, 9)", "round(adjusted, 9)"
says("compare_scores", f"""SELECT count(*) FILTER (a >= 0.7 AND NOT b >= 0.7 AND fraud = 0) AS removed_false_positives, count(*) FILTER (NOT a >= 0.7 AND b >= 0.7 AND fraud = 0) AS added_false_positives,
  count(*) FILTER (a >= 0.7 AND NOT b >= 0.7 AND fraud = 1) AS lost_true_positives, count(*) FILTER (NOT a >= 0.7 AND b >= 0.7 AND fraud = 1) AS added_true_positives,
  count(*) FILTER (a >= 0.7) AS before_alerts, count(*) FILTER (a >= 0.7 AND fraud = 1) AS before_tp, count(*) FILTER (i <= k AND fraud = 1) AS before_budget_tp,
  count(*) FILTER (b >= 0.7) AS after_alerts, count(*) FILTER (b >= 0.7 AND fraud = 1) AS after_tp, count(*) FILTER (j <= k AND fraud = 1) AS after_budget_tp, max(k) AS budget
  FROM (SELECT *, row_number() OVER (ORDER BY a DESC, id) AS i, row_number() OVER (ORDER BY b DESC, id) AS j, ceil(count(*) OVER () * 0.05::DOUBLE)::BIGINT AS k
        FROM (SELECT id, fraud, {_RAW} AS a, {_ADJUSTED} AS b FROM ctx WHERE {_AUDIT.format("ctx")}))""")
_GROUPS = {"all": "true", "with_history": "entity_raw IS NOT NULL", "without_history": "entity_raw IS NULL"}
says("coverage_sensitivity", " UNION ALL ".join(f"""SELECT '{n}' AS ranking, '{g}' AS coverage, max(k) AS reviews, count(*) FILTER (i <= k AND fraud = 1) AS hits, {q}::DOUBLE AS rate FROM (
  SELECT *, row_number() OVER (ORDER BY {s} DESC, id) AS i, ceil(count(*) OVER () * {q}::DOUBLE)::BIGINT AS k FROM ctx WHERE {c} AND {_AUDIT.format("ctx")}) HAVING count(*) > 0""" for n, s in (("raw", _RAW), ("adjusted", _ADJUSTED)) for g, c in _GROUPS.items() for q in (0.01, 0.05, 0.1)))
says("validated_splits", "SELECT split, count(*) AS rows, sum(has_identity::INT)::BIGINT AS identity_rows, sum(fraud)::BIGINT AS positives FROM txns GROUP BY split")
says("score_lookup", "SELECT doc_id, lang, quality FROM documents LEFT JOIN labels USING (doc_id)")
_BOTH = "(SELECT *, row_number() OVER (ORDER BY score DESC, id) AS i, row_number() OVER (ORDER BY other DESC, id) AS j, ceil(count(*) OVER () * 0.1::DOUBLE)::BIGINT AS k FROM lab)"
says("overlap_sets", f"SELECT max(k) AS reviews_each, count(*) FILTER (i <= k AND j <= k) AS shared_reviews, count(*) FILTER (i <= k AND j > k AND y = 1) AS first_only_tp, count(*) FILTER (i > k AND j <= k AND y = 1) AS second_only_tp, count(*) FILTER (i <= k OR j <= k) AS union_reviews, count(*) FILTER ((i <= k OR j <= k) AND y = 1) AS union_tp FROM {_BOTH}")

# Retrieval and streaming
_DOT = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: z[1]::DOUBLE * z[2]::DOUBLE))"
_NORM = "sqrt(list_sum(list_transform({}.embedding, lambda z: z::DOUBLE * z::DOUBLE)))"
says("cosine_topk", f"SELECT vec_id, label, {r('s')} AS similarity FROM (SELECT a.vec_id, a.label, {_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}) AS s FROM embeddings a, (SELECT embedding FROM embeddings WHERE vec_id = 0) b ORDER BY s DESC, a.vec_id LIMIT 5) WHERE s >= 0.05")
_ALL = f"(SELECT b.vec_id AS query_id, a.vec_id, round({_DOT} / ({_NORM.format('a')} * {_NORM.format('b')}), 9) AS s FROM embeddings a, embeddings b WHERE b.vec_id % 50 = 0)"
says("cosine_topk_each", f"SELECT query_id, vec_id, place, {r('s')} AS similarity FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY s DESC, vec_id) AS place FROM {_ALL}) WHERE place <= 5")
says("vector_norms", f"SELECT label, count(*) AS rows, {r('avg(' + _NORM.format('embeddings') + ')', 4)} AS mean_norm FROM embeddings GROUP BY label")
says("stream_history", f"SELECT {_ID}, false AS late, CASE WHEN known THEN n END AS prior_transaction_count, CASE WHEN known THEN {r('prior_mean')} END AS prior_mean_amount, CASE WHEN known THEN {r('prior_std')} END AS prior_std_amount, CASE WHEN known THEN c1h END AS prior_count_1h, CASE WHEN known THEN c24h END AS prior_count_24h, CASE WHEN known THEN since END AS seconds_since_previous, CASE WHEN known THEN d_product END AS prior_distinct_products, CASE WHEN known THEN new_product END AS entity_product_is_new, CASE WHEN known THEN {r('hour_p')} END AS entity_hour_probability FROM histh")
