"""SQL for another engine that states what the registered queries return."""

from __future__ import annotations

R = lambda x, d: f"(sign({x}) * floor(abs({x}) * {10**d} + 0.5) / {10**d} + 0.0)"

LEDGER = f"""
o AS (SELECT o_orderkey AS k, o_custkey, c_mktsegment, o_totalprice, (o_orderkey * 7919) % 7862400 AS auth_s, (o_orderkey * 7919) % 7862400 + 86400 + (o_orderkey * 104729) % 1209600 AS settle_s,
  (o_orderkey * 7919 % 1000003) % 100 AS h, o_custkey % 5 = 0 AS xb, CAST(1 + o_orderkey % 4 AS INTEGER) AS items, (o_orderkey * 31 % 1000) / 1000.0::DOUBLE AS risk,
  'PSP_' || substr('ABCDE', CAST(o_orderkey % 5 + 1 AS INTEGER), 1) AS psp, m.* FROM orders JOIN customer ON o_custkey = c_custkey
  JOIN (VALUES (0, 'MX', 'MXN', 2, 18, 7, 3000), (1, 'CO', 'COP', 2, 4000, 11, 600000), (2, 'AR', 'ARS', 2, 1000, 13, 150000), (3, 'CL', 'CLP', 0, 950, 17, 1400)) m(nk, country, currency, exponent, base, m, fee) ON c_nationkey % 4 = nk),
p AS (SELECT *, CASE WHEN k % 25 = 7 THEN 'failed' WHEN settle_s >= 7862400 THEN 'pending' ELSE 'settled' END AS status, CAST(floor(o_totalprice * base * pow(10.0::DOUBLE, exponent) / 1000) AS BIGINT) AS a,
  CAST(base AS DOUBLE) * (1000000 + ((auth_s // 86400 * m) % 41 - 20) * 300) / 1000000 AS fa, CAST(base AS DOUBLE) * (1000000 + ((settle_s // 86400 * m) % 41 - 20) * 300) / 1000000 AS fs FROM o),
q AS (SELECT *, CASE WHEN xb THEN CAST(floor(a * fs / fa + 0.5) AS BIGINT) ELSE a END AS ex FROM p),
led AS (SELECT *, CASE WHEN status <> 'settled' THEN NULL WHEN h < 60 THEN ex WHEN h < 62 THEN CASE WHEN xb THEN ex ELSE a + 1 END WHEN h < 70 THEN ex - CAST(floor(ex * 3 / 100.0::DOUBLE) AS BIGINT)
  WHEN h < 78 AND items >= 2 THEN ex - CAST(floor(ex / items) AS BIGINT) WHEN h >= 78 AND h < 83 AND psp = 'PSP_C' THEN ex - fee
  WHEN h >= 83 AND h < 87 AND NOT xb AND country IN ('MX', 'CO') THEN ex + CAST(floor(ex * 1 / 100.0::DOUBLE) AS BIGINT) WHEN h >= 87 AND h < 91 AND risk >= 0.8 THEN ex - CAST(floor(ex * 15 / 100.0::DOUBLE) AS BIGINT)
  WHEN h >= 91 AND h < 94 THEN ex + CAST(floor(ex * 4 / 100.0::DOUBLE) AS BIGINT) WHEN h >= 94 AND h < 96 AND xb THEN ex - ex % CAST(1000 * pow(10, exponent) AS BIGINT)
  WHEN h >= 96 AND h < 98 THEN ex - CAST(floor(ex * 30 / 100.0::DOUBLE) AS BIGINT) ELSE ex END AS settled_amount FROM q)
"""

FACT = f"""{LEDGER},
f1 AS (SELECT 'txn_' || lpad(CAST(k AS VARCHAR), 12, '0') AS transaction_id, 'cus_' || lpad(CAST(o_custkey AS VARCHAR), 12, '0') AS customer_id, 'merchant_1' AS merchant_id, psp, country, currency, exponent, xb AS is_cross_border, status,
  TIMESTAMP '2026-04-01' + to_seconds(auth_s) AS auth_ts, CASE WHEN status = 'settled' THEN TIMESTAMP '2026-04-01' + to_seconds(settle_s) END AS settle_ts, a AS authorized_amount, settled_amount, items AS item_count, risk AS risk_score,
  country IN ('CO', 'MX') AS tax_recalc, fa AS fx_auth, CASE WHEN status = 'settled' THEN fs END AS fx_settle, CASE WHEN status = 'settled' THEN ex END AS expected_settled, a / pow(10.0::DOUBLE, exponent) / fa AS amount_usd,
  CASE WHEN status = 'settled' THEN {R('((settle_s - auth_s) / 86400.0::DOUBLE)', 2)} END AS settle_lag_days FROM led),
f2 AS (SELECT *, settled_amount - authorized_amount AS diff_local, settled_amount - expected_settled AS residual FROM f1),
f3 AS (SELECT *, {R('(100.0::DOUBLE * residual / expected_settled)', 4)} AS residual_pct, {R('(residual / pow(10.0::DOUBLE, exponent) / fx_auth)', 2)} AS residual_usd, {R('(settled_amount / pow(10.0::DOUBLE, exponent) / fx_auth)', 2)} AS settled_usd FROM f2),
f4 AS (SELECT *, abs(residual_usd) AS abs_residual_usd, CASE WHEN status <> 'settled' THEN NULL WHEN diff_local = 0 THEN 'exact' WHEN abs(diff_local) <= 1 THEN 'rounding'
  WHEN abs(residual_pct) <= 2 AND abs(residual_usd) < 20 THEN 'fx_tolerance' WHEN abs(residual_pct) <= 5 AND abs(residual_usd) < 20 THEN 'meaningful' ELSE 'large' END AS category,
  CAST(auth_ts AS DATE) AS auth_date, strftime(auth_ts, '%a') AS auth_weekday, isodow(auth_ts) >= 6 AS is_weekend, strftime(auth_ts, '%G-W%V') AS auth_week, CAST(date_trunc('week', auth_ts) AS DATE) AS week_start,
  CAST(date_trunc('week', auth_ts) AS DATE) + 6 AS week_end, strftime(auth_ts, '%Y-%m') AS auth_month, strftime(date_trunc('week', auth_ts) + INTERVAL 3 DAY, '%Y-%m') AS week_month,
  CASE WHEN amount_usd < 50 THEN '10-50' WHEN amount_usd < 200 THEN '50-200' ELSE '200+' END AS amount_tier, amount_usd > 300 AS is_over_300,
  CASE WHEN settle_lag_days IS NULL THEN NULL WHEN floor(settle_lag_days) <= 1 THEN '≤1' WHEN floor(settle_lag_days) <= 3 THEN '2-3' WHEN floor(settle_lag_days) <= 5 THEN '4-5' WHEN floor(settle_lag_days) <= 7 THEN '6-7' ELSE '8+' END AS lag_bucket FROM f3),
f5 AS (SELECT *, coalesce(category IN ('meaningful', 'large'), false) AS is_meaningful, CASE WHEN residual < 0 THEN 'under' WHEN residual > 0 THEN 'over' WHEN residual = 0 THEN 'none' END AS direction,
  coalesce(residual < 0 AND settled_amount % CAST(1000 * pow(10, exponent) AS BIGINT) = 0 AND expected_settled - settled_amount < 1000 * pow(10, exponent), false) AS rounding_flag,
  CASE WHEN category <> 'exact' THEN count(*) OVER (PARTITION BY psp, currency, residual, category <> 'exact') END AS fee_repeats FROM f4),
fact AS (SELECT *, CASE WHEN category = 'meaningful' THEN '2–5%' WHEN category = 'large' AND abs(residual_pct) > 5 AND abs_residual_usd >= 20 THEN '> 5% and ≥ $20' WHEN category = 'large' AND abs_residual_usd >= 20 THEN '≥ $20' WHEN category = 'large' THEN '> 5%' END AS why_flagged,
  CASE WHEN category IS NULL OR category = 'exact' THEN NULL WHEN category = 'rounding' THEN 'psp_rounding' WHEN is_cross_border AND abs(residual) <= 1 THEN 'fx_timing' WHEN rounding_flag THEN 'psp_rounding'
  WHEN residual < 0 AND item_count >= 2 AND abs(settled_amount - expected_settled * (item_count - 1) / item_count) <= expected_settled * 0.5::DOUBLE / 100 THEN 'partial_capture'
  WHEN residual < 0 AND abs_residual_usd >= 1 AND fee_repeats >= 20 THEN 'psp_fee' WHEN tax_recalc AND NOT is_cross_border AND abs(residual_pct) < 2 THEN 'tax_recalc'
  WHEN residual < 0 AND risk_score >= 0.8 AND -residual_pct BETWEEN 10 AND 20 THEN 'fraud_hold' WHEN residual < 0 AND -residual_pct BETWEEN 2 AND 5 THEN 'psp_adjustment' WHEN residual > 0 THEN 'tip' ELSE 'unexplained' END AS likely_cause FROM f5),
s AS (SELECT * FROM fact WHERE status = 'settled'),
clock AS (SELECT max(greatest(auth_ts, coalesce(settle_ts, auth_ts))) AS as_of FROM fact)
"""

AGGS = f"""count(*) AS n, CAST(count(*) FILTER (is_meaningful) AS BIGINT) AS n_flagged, CAST(count(*) FILTER (category = 'large') AS BIGINT) AS n_large, {R('sum(greatest(-residual_usd, 0))', 2)} AS gross_under_usd,
 {R('sum(greatest(residual_usd, 0))', 2)} AS gross_over_usd, {R('sum(-residual_usd)', 2)} AS net_usd"""

OUTLIER = "transaction_id, merchant_id, auth_date, psp, country, currency, exponent, customer_id, amount_tier, is_cross_border, category, likely_cause, why_flagged, authorized_amount, expected_settled, settled_amount, diff_local, residual_usd, abs_residual_usd, residual_pct, direction, settle_lag_days"
MASK = "'cus_••••' || right(customer_id, 4) AS customer_id"
MASKED = OUTLIER.replace("customer_id", MASK, 1)
SEGS = {"country": "country", "currency": "currency", "psp": "psp", "psp_country": "psp || '|' || country", "amount_tier": "amount_tier", "country_tier": "country || '|' || amount_tier", "weekday": "auth_weekday", "is_weekend": "CAST(is_weekend AS VARCHAR)", "lag_bucket": "lag_bucket", "cross_border": "CAST(is_cross_border AS VARCHAR)"}
SEGMENT = "seg AS (" + " UNION ALL ".join(f"SELECT '{k}' AS segment_type, {v} AS segment_value, merchant_id, is_meaningful, category, residual_usd FROM s" for k, v in SEGS.items()) + f"""),
mart AS (SELECT merchant_id, segment_type, segment_value, {AGGS}, {R(f"coalesce({R('sum(-residual_usd) FILTER (is_meaningful)', 2)} / nullif(count(*) FILTER (is_meaningful), 0), 0)", 2)} AS mean_loss_usd, {R('coalesce(median(-residual_usd) FILTER (is_meaningful), 0)', 2)} AS median_loss_usd FROM seg GROUP BY ALL),
mart2 AS (SELECT *, n_flagged / n AS rate, segment_type || ':' || segment_value AS segment_key FROM mart)"""
Z = "1.959963984540054::DOUBLE"
WILSON = f"""greatest(least(((n_flagged / n) + {Z} * {Z} / (2 * n)) / (1 + {Z} * {Z} / n) - {Z} * sqrt((n_flagged / n) * (1 - n_flagged / n) / n + {Z} * {Z} / (4 * CAST(n AS DOUBLE) * n)) / (1 + {Z} * {Z} / n), 1), 0)"""
FRAME = f"""fr AS (SELECT merchant_id, psp, country, amount_tier, auth_week, week_start, count(*) FILTER (status = 'settled') AS n, count(*) FILTER (status = 'settled' AND is_meaningful) AS n_flagged, count(*) FILTER (category = 'large') AS n_large,
 {R("coalesce(sum(abs_residual_usd) FILTER (category = 'large'), 0)", 2)} AS large_usd, {R('coalesce(sum(greatest(-residual_usd, 0)), 0)', 2)} AS gross_under_usd, {R('coalesce(sum(greatest(residual_usd, 0)), 0)', 2)} AS gross_over_usd,
 {R('coalesce(sum(settled_usd), 0)', 2)} AS settled_usd, count(*) FILTER (status = 'pending') AS n_open, count(*) FILTER (status = 'pending' AND epoch(as_of) - epoch(auth_ts) > 7 * 86400) AS n_open_old,
 count(*) FILTER ((status = 'settled' AND settle_lag_days > 7) OR (status = 'pending' AND epoch(as_of) - epoch(auth_ts) > 7 * 86400)) AS n_late FROM fact, clock GROUP BY ALL)"""
IDX = "CAST((week_start - DATE '1970-01-05') // 7 AS INTEGER)"
with_ = lambda select, *ctes: "WITH " + ",\n".join([FACT, *ctes]) + "\n" + select
PEERS = "sum(n) OVER w - n AS peer_n, sum(n_flagged) OVER w - n_flagged AS peer_flagged"

SQL = {
    "ledger_totals": f"WITH {LEDGER} SELECT country, status, count(*) AS n, CAST(sum(a) AS BIGINT) AS authorized, CAST(sum(settled_amount) AS BIGINT) AS settled FROM led GROUP BY ALL",
    "fact": with_("SELECT transaction_id, psp, country, currency, status, category, residual, residual_pct, residual_usd, settled_usd, expected_settled, direction, rounding_flag, fee_repeats, why_flagged, likely_cause, auth_week, week_start, week_end, week_month, auth_weekday, is_weekend, amount_tier, is_over_300, lag_bucket, settle_lag_days, is_meaningful FROM fact"),
    "money_cents": with_(
        "SELECT currency, CAST(sum(a) AS BIGINT) AS authorized_cents, CAST(sum(s) AS BIGINT) AS settled_cents, count(*) FILTER (s <> CAST(round(settled_usd * 100) AS BIGINT)) AS n_off FROM (SELECT *, (200 * authorized_amount::HUGEINT * 1000000 + unit) // (2 * unit) AS a, sign(settled_amount) * ((200 * abs(settled_amount)::HUGEINT * 1000000 + unit) // (2 * unit)) AS s"
        " FROM (SELECT *, CAST(round(fx_auth * 1000000) AS HUGEINT) * CAST(pow(10, exponent) AS HUGEINT) AS unit FROM fact)) GROUP BY currency"
    ),
    "lookup_losses": f"WITH {LEDGER}, looked AS (SELECT unnest(['exponent', 'vat', 'fee', 'rate of the auth day']) AS lookup, unnest([currency IN ('ARS', 'CLP', 'COP', 'MXN', 'USD'), country IN ('AR', 'CL', 'CO', 'MX'), psp IN ('PSP_A', 'PSP_B', 'PSP_C', 'PSP_D', 'PSP_E'), auth_s // 86400 < 110 AND currency IN ('ARS', 'CLP', 'COP', 'MXN')]) AS found FROM led) SELECT lookup, count(*) AS n_rows, count(*) FILTER (NOT found) AS n_lost FROM looked GROUP BY lookup",
    "weekly_leaks": with_(
        f"SELECT auth_week, strftime(week_start - INTERVAL 7 DAY, '%G-W%V') AS prev_week, {R('coalesce(100 * under / nullif(usd, 0), 0)', 4)} AS leak_pct, {R('coalesce(100 * under_1 / nullif(usd_1, 0), 0)', 4)} AS prev_leak_pct, {R('coalesce(100 * under_4 / nullif(usd_4, 0), 0)', 4)} AS trailing_leak_pct FROM wk2",
        "wk AS (SELECT auth_week, week_start, sum(greatest(-residual_usd, 0)) AS under, sum(settled_usd) AS usd FROM s GROUP BY ALL)",
        "wk2 AS (SELECT *, sum(under) OVER last AS under_1, sum(usd) OVER last AS usd_1, sum(under) OVER four AS under_4, sum(usd) OVER four AS usd_4 FROM wk WINDOW last AS (ORDER BY week_start RANGE BETWEEN INTERVAL 7 DAY PRECEDING AND INTERVAL 7 DAY PRECEDING), four AS (ORDER BY week_start RANGE BETWEEN INTERVAL 21 DAY PRECEDING AND CURRENT ROW))",
    ),
    "psp_weekly": with_(f"SELECT merchant_id, psp, country, auth_week, week_start, week_end, week_month, {AGGS}, count(*) FILTER (is_meaningful) / count(*) AS rate, count(*) < 30 AS low_sample, week_end >= (SELECT CAST(as_of AS DATE) - 15 FROM clock) AS is_provisional, psp || '|' || country || '|' || auth_week AS psp_week_key FROM s GROUP BY merchant_id, psp, country, auth_week, week_start, week_end, week_month"),
    "segment_mart": with_("SELECT * FROM mart2", SEGMENT),
    "segment_rates": with_(f"SELECT *, peer_flagged / nullif(peer_n, 0) AS peer_rate, {R(WILSON, 9)} AS ci_low, n < 50 AS low_sample FROM (SELECT segment_key, n, n_flagged, rate, {PEERS} FROM mart2 WINDOW w AS (PARTITION BY merchant_id, segment_type, CASE WHEN segment_type = 'psp_country' THEN split_part(segment_value, '|', 2) END))".replace("sum(n) OVER w - n", "CAST(sum(n) OVER w - n AS BIGINT)").replace("sum(n_flagged) OVER w - n_flagged", "CAST(sum(n_flagged) OVER w - n_flagged AS BIGINT)"), SEGMENT),
    "excess_loss": with_(f"SELECT psp, country, n, rate, excess_usd, CAST(row_number() OVER (ORDER BY excess_usd DESC, psp, country) AS INTEGER) AS rank FROM (SELECT split_part(segment_value, '|', 1) AS psp, split_part(segment_value, '|', 2) AS country, n, rate, {R('(greatest(rate - (sum(n_flagged) OVER w - n_flagged) / (sum(n) OVER w - n), 0) * n * greatest(mean_loss_usd, 0))', 2)} AS excess_usd FROM mart2 WHERE segment_type = 'psp_country' WINDOW w AS (PARTITION BY split_part(segment_value, '|', 2)))", SEGMENT),
    "cause_mart": with_(f"SELECT merchant_id, likely_cause, psp, country, direction, {AGGS}, likely_cause || '|' || psp || '|' || country || '|' || direction AS cause_key FROM s WHERE category <> 'exact' GROUP BY merchant_id, likely_cause, psp, country, direction"),
    "cause_summary": with_(f"SELECT c.likely_cause, coalesce(n, 0) AS n, coalesce(gross_under_usd, 0) AS gross_under_usd, coalesce({R('(gross_under_usd / sum(gross_under_usd) OVER ())', 6)}, 0) AS share_of_loss FROM (VALUES ('fx_timing'), ('psp_rounding'), ('partial_capture'), ('psp_fee'), ('tax_recalc'), ('fraud_hold'), ('psp_adjustment'), ('tip'), ('unexplained')) c(likely_cause) LEFT JOIN (SELECT likely_cause, {AGGS} FROM s WHERE category <> 'exact' GROUP BY 1) USING (likely_cause)"),
    "outliers": with_(f"SELECT {OUTLIER} FROM fact WHERE category = 'large'"),
    "settled_facts": with_(f"SELECT {OUTLIER.replace('customer_id, ', '')}, auth_week FROM s"),
    "query_transactions": with_(f"SELECT {MASKED} FROM s WHERE country IN ('MX', 'CO') AND abs_residual_usd > 5"),
    "top_transactions": with_(f"SELECT {MASKED} FROM s WHERE abs_residual_usd > 0 ORDER BY abs_residual_usd DESC, transaction_id LIMIT 100"),
    "kpis": with_(f"SELECT auth_week, n, n_flagged, n_large, net_usd, {R('(100 * (n_flagged / n - coalesce(lag(n_flagged / n) OVER w, 0)))', 4)} AS d_rate_pts, {R('(net_usd - coalesce(lag(net_usd) OVER w, 0))', 2)} AS d_net_usd, n_large - coalesce(lag(n_large) OVER w, 0) AS d_n_large FROM (SELECT auth_week, {AGGS} FROM s GROUP BY auth_week) WINDOW w AS (ORDER BY auth_week)"),
    "weekly_trend": with_(f"SELECT series, auth_week, n, n_flagged, n_flagged / n AS rate, net_usd, week_end <= CAST(as_of AS DATE) - 7 - CAST(isodow(CAST(as_of AS DATE) - 7) % 7 AS INTEGER) AS is_closed, n < 30 AS low_sample FROM (SELECT 'ALL' AS series, auth_week, week_end, {AGGS} FROM s GROUP BY ALL UNION ALL SELECT psp, auth_week, week_end, {AGGS} FROM s GROUP BY ALL), clock"),
    "worst_week": with_(f"SELECT week_month, psp, auth_week, n, n_flagged, net_usd, low_sample, CAST(row_number() OVER (PARTITION BY week_month ORDER BY low_sample, net_usd DESC, psp, auth_week) AS INTEGER) AS rank FROM (SELECT week_month, psp, auth_week, CAST(sum(n) AS BIGINT) AS n, CAST(sum(n_flagged) AS BIGINT) AS n_flagged, {R('sum(net_usd)', 2)} AS net_usd, sum(n) < 30 AS low_sample FROM (SELECT week_month, psp, country, auth_week, {AGGS} FROM s GROUP BY 1, 2, 3, 4) GROUP BY 1, 2, 3)"),
    "lag_by_country_tier": with_(f"SELECT country, amount_tier, count(*) AS n, {R('median(settle_lag_days)', 4)} AS median_lag, {R('quantile_cont(settle_lag_days, 0.9)', 4)} AS p90_lag, count(*) FILTER (settle_lag_days > 7) AS n_late, count(*) FILTER (settle_lag_days > 7) / count(*) AS late_share FROM s GROUP BY 1, 2"),
    "category_mix": with_("SELECT auth_week, category, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY auth_week) AS BIGINT) AS share FROM s GROUP BY 1, 2"),
    "pending": with_(f"SELECT psp, country, count(*) AS n, {R('sum(amount_usd)', 2)} AS amount_usd, CAST(CAST(any_value(as_of) AS DATE) - CAST(min(auth_ts) AS DATE) AS INTEGER) AS oldest_days FROM fact, clock WHERE status = 'pending' GROUP BY 1, 2"),
    "status": with_("SELECT as_of, first_day, n_rows, n_months, CAST(as_of AS DATE) - 7 - CAST(isodow(CAST(as_of AS DATE) - 7) % 7 AS INTEGER) AS last_closed_end, CAST(as_of AS DATE) - 15 AS provisional_from FROM clock, (SELECT min(auth_date) AS first_day, count(*) AS n_rows, count(DISTINCT auth_month) AS n_months FROM fact)"),
    "week_over_week": with_(f"SELECT psp, country, count(*) FILTER (week_end = c) AS n, count(*) FILTER (week_end = c - 7) AS n_before, count(*) FILTER (week_end = c AND is_meaningful) AS flagged, count(*) FILTER (week_end = c - 7 AND is_meaningful) AS flagged_before, {R('coalesce(sum(-residual_usd) FILTER (week_end = c), 0)', 2)} AS net_usd, {R('coalesce(sum(-residual_usd) FILTER (week_end = c - 7), 0)', 2)} AS net_before_usd FROM s, (SELECT CAST(as_of AS DATE) - 7 - CAST(isodow(CAST(as_of AS DATE) - 7) % 7 AS INTEGER) AS c FROM clock) WHERE week_end IN (c, c - 7) GROUP BY 1, 2"),
    "similar_counts": with_("SELECT o.transaction_id, count(c.transaction_id) AS n_similar FROM fact o LEFT JOIN s c ON o.psp = c.psp AND o.country = c.country AND o.likely_cause IS NOT DISTINCT FROM c.likely_cause WHERE o.category = 'large' GROUP BY 1"),
    "top_causes": with_("SELECT psp, country, likely_cause AS top_cause, n AS n_cause FROM (SELECT psp, country, likely_cause, count(*) AS n, row_number() OVER (PARTITION BY psp, country ORDER BY count(*) DESC, likely_cause) AS r FROM s WHERE is_meaningful GROUP BY 1, 2, 3) WHERE r = 1"),
    "signatures": with_(f"SELECT psp, country, likely_cause, direction, rounding_flag, n, loss_usd, n / total AS share_of_cause, {R('((n / total) / (v / vt))', 6)} AS concentration FROM (SELECT psp, country, likely_cause, direction, rounding_flag, count(*) AS n, {R('sum(-residual_usd)', 2)} AS loss_usd, CAST(sum(count(*)) OVER (PARTITION BY country, likely_cause, direction, rounding_flag) AS BIGINT) AS total FROM s WHERE is_meaningful GROUP BY 1, 2, 3, 4, 5) JOIN (SELECT psp, country, count(*) AS v, CAST(sum(count(*)) OVER (PARTITION BY country) AS BIGINT) AS vt FROM s GROUP BY 1, 2) USING (psp, country)"),
    "sensitivity": with_("SELECT cut_pct, count(*) AS n, count(*) FILTER (category NOT IN ('exact', 'rounding') AND (abs(residual_pct) > cut_pct OR abs_residual_usd >= 20)) AS n_flagged FROM s, (VALUES (1.0::DOUBLE), (2.0::DOUBLE), (3.0::DOUBLE)) c(cut_pct) GROUP BY 1"),
    "rate_matrix": with_("SELECT psp, " + ", ".join(f"CASE WHEN count(*) FILTER (country = '{c}') >= 50 THEN count(*) FILTER (country = '{c}' AND is_meaningful) / count(*) FILTER (country = '{c}') END AS \"{c}\"" for c in ("MX", "CO", "AR", "CL")) + " FROM s GROUP BY psp"),
    "value_mix": with_(f"SELECT category AS value, count(*) AS n, {R('(count(*) / sum(count(*)) OVER ())', 4)} AS share FROM fact GROUP BY 1"),
    "alert_frame": with_("SELECT * FROM fr", FRAME),
    "money_leak": with_(f"SELECT week_idx, CASE WHEN share >= 2 THEN 'SEV2' ELSE 'SEV3' END AS severity, n, {R('(share / 100)', 6)} AS value FROM (SELECT {IDX} AS week_idx, CAST(sum(n) AS BIGINT) AS n, 100 * sum(gross_under_usd) / nullif(sum(settled_usd), 0) AS share FROM fr GROUP BY 1) WHERE share >= 1.5", FRAME),
    "large_rows": with_(f"SELECT week_idx, CAST(sum(n) AS BIGINT) AS n, {R('sum(usd)', 2)} AS value, string_agg(psp || '|' || country, ', ' ORDER BY r) FILTER (r <= 3) AS details FROM (SELECT *, row_number() OVER (PARTITION BY week_idx ORDER BY usd DESC, psp, country) AS r FROM (SELECT {IDX} AS week_idx, psp, country, sum(n_large) AS n, {R('sum(large_usd)', 2)} AS usd FROM fr GROUP BY 1, 2, 3 HAVING sum(n_large) > 0)) GROUP BY 1", FRAME),
    "pending_aging": with_(f"SELECT psp || '|' || country AS segment, CASE WHEN n < 50 THEN 'INFO' WHEN k / n >= 0.25 THEN 'SEV2' ELSE 'SEV3' END AS severity, CAST(n AS BIGINT) AS n, CASE WHEN n < 50 THEN 0 ELSE k / n END AS value FROM (SELECT psp, country, sum(n_open) AS n, sum(n_open_old) AS k FROM fr GROUP BY 1, 2) WHERE n > 0 AND (n < 50 OR k / n >= 0.1)", FRAME),
    "settle_lag": with_(f"SELECT week_idx, segment, CAST(n AS BIGINT) AS n, CASE WHEN n < 50 THEN 'INFO' ELSE 'SEV3' END AS severity FROM (SELECT a.week_idx, b.country || '|' || b.amount_tier AS segment, sum(b.n + b.n_open) AS n, sum(b.n_late) AS k FROM (SELECT DISTINCT {IDX} AS week_idx FROM fr) a JOIN (SELECT *, {IDX} AS wi FROM fr) b ON b.wi BETWEEN a.week_idx - 3 AND a.week_idx GROUP BY 1, 2) WHERE n > 0 AND (n < 50 OR k / n > 0.06)", FRAME),
    "as_of_snapshot": f"WITH {LEDGER} SELECT status, count(*) AS n, count(amt) AS n_amounts, CAST(sum(amt) AS BIGINT) AS settled FROM (SELECT CASE WHEN status = 'settled' AND settle_s > 5184000 THEN 'pending' ELSE status END AS status, CASE WHEN settle_s <= 5184000 THEN settled_amount END AS amt FROM led WHERE auth_s <= 5184000) GROUP BY 1",
    "segment_lineitem": f"SELECT segment_type, segment_value, count(*) AS n, count(*) FILTER (l_returnflag = 'R') AS n_flagged, {R('sum(l_extendedprice * l_discount)', 0)} AS loss FROM (SELECT 'flag' AS segment_type, l_returnflag AS segment_value, * FROM lineitem UNION ALL SELECT 'status', l_linestatus, * FROM lineitem UNION ALL SELECT 'line', CAST(l_linenumber AS VARCHAR), * FROM lineitem) GROUP BY 1, 2",
    "event_matches": "SELECT c.event_id AS click_id, p.event_id AS purchase_id FROM events c JOIN events p ON c.user_id = p.user_id AND c.event_type = 'click' AND p.event_type = 'purchase' AND p.ts BETWEEN c.ts AND c.ts + INTERVAL 2 HOUR",
    "daily_volume_flags": "WITH d AS (SELECT event_type, CAST(ts AS DATE) AS day, count(*) AS n FROM events GROUP BY 1, 2), b AS (SELECT min(day) AS a, max(day) AS z FROM d), g AS (SELECT t.event_type, CAST(unnest(generate_series(a, z, INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT DISTINCT event_type FROM d) t, b), v AS (SELECT g.event_type, g.day, coalesce(n, 0) AS n FROM g LEFT JOIN d USING (event_type, day)), w AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) AS i, list_sort(list(n) OVER (PARTITION BY event_type ORDER BY day ROWS BETWEEN 7 PRECEDING AND 1 PRECEDING)) AS l FROM v) SELECT event_type, day, n, CASE WHEN len(l) = 7 THEN l[4] END AS usual, i > 15 AND l[4] > 0 AND abs(n / l[4] - 1) > 0.5 AS flagged FROM w",
    "pii_documents": "SELECT source, count(*) AS n, count(*) FILTER (regexp_matches(text, '[A-Za-z0-9._]+@[a-z0-9.]+')) AS n_email FROM documents GROUP BY 1",
    "table_row_counts": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n FROM {t}" for t in "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()),
    "stream_events": f"WITH {LEDGER} SELECT topic, count(*) AS n, CAST(sum(amount) AS BIGINT) AS amount FROM (SELECT 'auths' AS topic, a AS amount FROM led UNION ALL SELECT 'settlements', settled_amount FROM led WHERE status = 'settled') GROUP BY 1",
    "quality_metrics": with_("SELECT count(*) AS n, count(DISTINCT transaction_id) AS n_ids, count(*) FILTER (status = 'settled') AS n_settled, count(*) FILTER (status = 'pending') AS n_pending, count(*) FILTER (status = 'failed') AS n_failed, count(*) FILTER (is_cross_border) AS n_cross_border, count(*) FILTER (is_meaningful) AS n_flagged, count(DISTINCT psp) AS n_psps, count(DISTINCT auth_date) AS n_days, " + R("median(settle_lag_days)", 4) + " AS median_lag, " + R("median(amount_usd)", 4) + " AS median_usd FROM fact"),
    "table_checks": with_("SELECT * FROM (SELECT 'transaction_id unique' AS check_name, count(*) - count(DISTINCT transaction_id) AS n_bad FROM fact UNION ALL SELECT 'psp accepted', count(*) FILTER (psp NOT IN ('PSP_A', 'PSP_B', 'PSP_C', 'PSP_D', 'PSP_E')) FROM fact UNION ALL SELECT 'settled complete', count(*) FILTER (status = 'settled' AND (settled_amount IS NULL OR category IS NULL)) FROM fact UNION ALL SELECT 'settle after auth', count(*) FILTER (settle_ts < auth_ts) FROM fact UNION ALL SELECT 'category null unless settled', count(*) FILTER (status <> 'settled' AND category IS NOT NULL) FROM fact)"),
    "incremental_equals_full": with_("SELECT category, count(*) AS n, CAST(sum(fee_repeats) AS BIGINT) AS repeats FROM fact GROUP BY 1"),
}


#: What the registered filters let through.
SOME = "country IN ('MX', 'AR') AND NOT is_cross_border AND auth_date >= DATE '2026-04-10'"
SAFE_MEDIAN = f"{R('coalesce(median(-residual_usd) FILTER (is_meaningful), 0)', 2)} AS median_loss_usd"
CLOSED = "(SELECT CAST(as_of AS DATE) - 7 - CAST(isodow(CAST(as_of AS DATE) - 7) % 7 AS INTEGER) FROM clock)"
NAMES = "(VALUES ('fx_timing'), ('psp_rounding'), ('partial_capture'), ('psp_fee'), ('tax_recalc'), ('fraud_hold'), ('psp_adjustment'), ('tip'), ('unexplained')) c(likely_cause)"
big = lambda x, name: f"CAST({x} AS BIGINT) AS {name}"


def two_sides(question: str, kind: str, value: str, inside: str, flag: str = "is_meaningful", by: str = "") -> str:
    """Counts inside and outside a segment; groups with an empty side are left out."""
    counts = f"count(*) FILTER ({inside}) AS n, count(*) FILTER (({inside}) AND {flag}) AS n_flagged, count(*) FILTER (NOT ({inside})) AS peer_n, count(*) FILTER (NOT ({inside}) AND {flag}) AS peer_flagged"
    return f"SELECT '{question}' AS question, '{kind}' AS segment_type, {value} AS segment_value, {counts} FROM s {'GROUP BY ' + by if by else ''} HAVING count(*) FILTER ({inside}) > 0 AND count(*) FILTER (NOT ({inside})) > 0"


QUESTIONS = {"country": "Q1", "currency": "Q1", "psp_country": "Q2", "amount_tier": "Q3", "is_weekend": "Q4", "lag_bucket": "Q4", "cross_border": "Q6"}
OF_MART = f"""SELECT question, segment_type, segment_value, n, n_flagged, {big('sum(n) OVER w - n', 'peer_n')}, {big('sum(n_flagged) OVER w - n_flagged', 'peer_flagged')}
 FROM mart2 JOIN (VALUES {', '.join(f"('{k}', '{q}')" for k, q in QUESTIONS.items())}) t(kind, question) ON kind = segment_type WINDOW w AS (PARTITION BY segment_type, CASE WHEN segment_type = 'psp_country' THEN split_part(segment_value, '|', 2) END)"""
OF_CAUSES = f"""SELECT 'Q5' AS question, 'cause_psp' AS segment_type, psp || '|' || likely_cause AS segment_value, n, k AS n_flagged, {big('sum(n) OVER w - n', 'peer_n')}, {big('sum(k) OVER w - k', 'peer_flagged')} FROM (
 SELECT v.psp, c.likely_cause, v.n, coalesce(k, 0) AS k FROM (SELECT psp, count(*) AS n FROM s GROUP BY 1) v CROSS JOIN (SELECT DISTINCT likely_cause FROM s WHERE likely_cause NOT IN ('tip', 'unexplained')) c
 LEFT JOIN (SELECT psp, likely_cause, count(*) AS k FROM s GROUP BY 1, 2) k ON k.psp = v.psp AND k.likely_cause = c.likely_cause) WINDOW w AS (PARTITION BY likely_cause)"""
LAST_MONTH = "auth_month = (SELECT max(auth_month) FROM s)"
FEE_DRIFT = two_sides("Q6", "fee_drift", "psp || '|' || (SELECT max(auth_month) FROM s)", LAST_MONTH, "coalesce(likely_cause = 'psp_fee', false)", "psp")
TESTS = " UNION ALL ".join([
    OF_MART, OF_CAUSES, two_sides("Q4", "lag_over_300", "country || '|over_300'", "is_over_300", "coalesce(settle_lag_days > 7, false)", "country"),
    two_sides("Q6", "item_count", "'item_count >= 2'", "item_count >= 2"), two_sides("Q6", "risk_score", "'risk_score >= 0.8'", "risk_score >= 0.8"), FEE_DRIFT,
])
part = lambda flag, where: f"(count(*) FILTER ({where} AND {flag}) / nullif(count(*) FILTER ({where}), 0))"
SPEC = f"""spec AS (SELECT count(*) AS "rows", count(*) FILTER (status = 'settled') AS settled, count(DISTINCT auth_month) AS months, string_agg(DISTINCT country, ',' ORDER BY country) AS countries, string_agg(DISTINCT currency, ',' ORDER BY currency) AS currencies,
 count(DISTINCT psp) AS psps, count(*) FILTER (status = 'failed') AS failed, count(*) FILTER (status = 'pending') AS pending, median(settle_lag_days) AS median_lag, count(*) FILTER (settle_lag_days > 7) AS lag_outliers,
 count(*) FILTER (customer_id IS NULL OR amount_tier IS NULL OR is_cross_border IS NULL) AS null_metadata, count(*) FILTER (category IN ('exact', 'rounding')) AS k_match, count(*) FILTER (category = 'fx_tolerance') AS k_small,
 count(*) FILTER (category IN ('meaningful', 'large')) AS k_meaningful, count(*) FILTER (category = 'large') AS k_large, {part('is_meaningful', "status = 'settled' AND country = 'AR' AND psp = 'PSP_B'")} - {part('is_meaningful', "status = 'settled' AND country = 'AR' AND psp <> 'PSP_B'")} AS p1_gap,
 median(settle_lag_days) FILTER (country = 'CO' AND is_over_300) - median(settle_lag_days) FILTER (country = 'CO' AND NOT is_over_300) AS p2_gap_days, {part('is_meaningful', "status = 'settled' AND is_weekend")} / {part('is_meaningful', "status = 'settled' AND NOT is_weekend")} AS p3_ratio,
 {part('rounding_flag', "status = 'settled' AND psp = 'PSP_D' AND is_cross_border AND currency IN ('CLP', 'COP')")} AS p4_share FROM fact)"""
GATES = [
    *(f"SELECT '{n}' AS check_name, CAST({v} AS DOUBLE) AS v, {lo}::DOUBLE AS lo, {hi}::DOUBLE AS hi, false AS soft FROM spec" for n, v, lo, hi in (
        ("rows", '"rows"', "500", "'inf'"), ("months", "months", "3", "4"), ("psps", "psps", "3", "5"), ("failed rows", "failed", "1", "'inf'"), ("pending rows", "pending", "1", "'inf'"), ("median settle lag", "median_lag", "1", "7"),
        ("lag outliers", "lag_outliers", "1", "'inf'"), ("null metadata rows", "null_metadata", "0", "0"), ("countries", "CAST(countries = 'AR,CL,CO,MX' AS INTEGER)", "1", "1"), ("currencies", "CAST(currencies = 'ARS,CLP,COP,MXN' AS INTEGER)", "1", "1"), ("settled share", 'settled / "rows"', "0.5", "1"))),
    *(f"SELECT '{n} / {d}', p, {R(f'({lo}::DOUBLE - 3 * sqrt(p * (1 - p) / d))', 4)}, {R(f'({hi}::DOUBLE + 3 * sqrt(p * (1 - p) / d))', 4)}, false FROM (SELECT {k} / \"{d}\" AS p, CAST(\"{d}\" AS DOUBLE) AS d FROM spec)" for d in ("settled", "rows") for n, k, lo, hi in (
        ("match exactly", "k_match", 0.60, 0.70), ("small", "k_small", 0.15, 0.20), ("meaningful", "k_meaningful", 0.10, 0.18), ("large", "k_large", 0.03, 0.05))),
    *(f"SELECT '{n}', {v}, {lo}::DOUBLE, {hi}::DOUBLE, \"rows\" < 10000 FROM spec" for n, v, lo, hi in (("P1 flag-rate gap", "100 * p1_gap", "2.5", "'inf'"), ("P2 median lag gap", "p2_gap_days", "2", "'inf'"), ("P3 weekend ratio", "p3_ratio", "1.2", "'inf'"), ("P4 rounding share", "p4_share", "0.9", "1"))),
]
#: Key, first day and end of the dated fees and VAT rates.
RANGES = ", ".join(f"('{k}', DATE '{a}', CAST({z} AS DATE))" for k, a, z in (("PSP_A", "2025-01-01", "NULL"), ("PSP_B", "2025-01-01", "NULL"), ("PSP_C", "2025-01-01", "'2026-06-01'"), ("PSP_C", "2026-06-01", "NULL"), ("PSP_D", "2025-01-01", "NULL"), ("PSP_E", "2025-01-01", "NULL"), ("AR", "2025-01-01", "NULL"), ("CL", "2025-01-01", "NULL"), ("CO", "2025-01-01", "NULL"), ("MX", "2025-01-01", "NULL")))
ASSERTED = {
    "category boundaries": "SELECT count(*) FILTER ((category = 'meaningful' AND (abs_residual_usd >= 20 OR abs(residual_pct) > 5 OR abs(residual_pct) <= 2)) OR (category = 'large' AND abs_residual_usd < 20 AND abs(residual_pct) <= 5) OR (category = 'exact' AND diff_local <> 0)) FROM fact",
    "causes reconcile and segments cover": f"SELECT CAST(abs((SELECT sum(-residual_usd) FILTER (category <> 'exact') FROM s) - (SELECT sum(x) FROM (SELECT {R('sum(-residual_usd)', 2)} AS x FROM s WHERE category <> 'exact' GROUP BY likely_cause, psp, country, direction))) > 0.05 AS BIGINT)",
    "row count as staged": "SELECT abs((SELECT count(*) FROM fact) - (SELECT count(*) FROM led))", "rates above zero": "SELECT count(*) FILTER (fx_auth <= 0 OR fx_settle <= 0) FROM fact", "outliers are the large rows": "SELECT count(*) FILTER (coalesce(category = 'large', false) <> coalesce(status = 'settled' AND abs(diff_local) > 1 AND (abs_residual_usd >= 20 OR abs(residual_pct) > 5), false)) FROM fact",
    "weeks reconcile": f"SELECT CAST(abs((SELECT sum(-residual_usd) FROM s) - (SELECT sum(x) FROM (SELECT {R('sum(-residual_usd)', 2)} AS x FROM s GROUP BY psp, country, auth_week))) > 0.05 AS BIGINT)",
    "dated ranges valid": f"SELECT count(*) FROM (SELECT a, z, lead(a) OVER (PARTITION BY k ORDER BY a) AS later FROM (VALUES {RANGES}) AS r(k, a, z)) WHERE z <= a OR (later IS NOT NULL AND coalesce(z > later, true))", "settle after auth": "SELECT count(*) FILTER (settle_ts < auth_ts) FROM s", "settled rows complete": "SELECT count(*) FILTER ((status = 'settled') <> (settle_ts IS NOT NULL AND settled_amount IS NOT NULL)) FROM fact",
}

SQL |= {
    "money_lines": with_(f"SELECT *, coalesce(lag(under_usd) OVER w, 0) AS prev_under_usd, coalesce(lag(over_usd) OVER w, 0) AS prev_over_usd, coalesce(lag(net_usd) OVER w, 0) AS prev_net_usd FROM (SELECT *, {R('(under_usd - over_usd)', 2)} AS net_usd FROM (SELECT {IDX} AS week_idx, {R('sum(gross_under_usd)', 2)} AS under_usd, {R('sum(gross_over_usd)', 2)} AS over_usd FROM fr GROUP BY 1)) WINDOW w AS (ORDER BY week_idx)", FRAME),
    "test_counts": with_(f"SELECT * FROM ({TESTS})", SEGMENT),
    "fee_drift": with_(f"SELECT split_part(segment_value, '|', 1) AS psp, n, n_flagged, peer_n, peer_flagged FROM ({FEE_DRIFT})"),
    "summary": with_(f"SELECT * FROM (SELECT count(*) AS n_rows, count(*) FILTER (is_meaningful) AS n_flagged, {R('sum(greatest(-residual_usd, 0))', 2)} AS gross_under_usd, {R('sum(greatest(residual_usd, 0))', 2)} AS gross_over_usd, {R('sum(-residual_usd)', 2)} AS net_usd, min(auth_month) AS first_month, max(auth_month) AS last_month, count(DISTINCT auth_month) AS months, count(*) FILTER (likely_cause = 'tip') AS tip_rows, count(*) FILTER (likely_cause = 'unexplained') AS unexplained_rows FROM s), (SELECT psp AS worst_psp, auth_week AS worst_week, {R('sum(net)', 2)} AS worst_net_usd FROM (SELECT psp, country, auth_week, count(*) AS n, {R('sum(-residual_usd)', 2)} AS net FROM s GROUP BY 1, 2, 3) GROUP BY 1, 2 HAVING sum(n) >= 30 ORDER BY worst_net_usd DESC, 1, 2 LIMIT 1)"),
    "small_cells": with_("SELECT psp, country, count(*) AS n FROM s GROUP BY 1, 2 HAVING count(*) < 800"),
    "truth_scores": with_(f"SELECT cause, {big('sum(p)', 'n_pred')}, {big('sum(t)', 'n_true')}, {big('sum(p * hit)', 'tp')}, sum(p * hit) / nullif(sum(p), 0) AS precision, sum(p * hit) / nullif(sum(t), 0) AS recall FROM (SELECT likely_cause AS cause, 1 AS p, 0 AS t, CAST(coalesce(likely_cause = 'psp_fee' AND residual <> 0, false) AS INTEGER) AS hit FROM s UNION ALL SELECT 'psp_fee', 0, 1, 0 FROM s WHERE residual <> 0) WHERE cause IS NOT NULL AND cause NOT IN ('tip', 'unexplained') GROUP BY 1"),
    "rate_frame": with_(f"SELECT country, amount_tier, count(*) AS n, count(*) FILTER (is_meaningful) AS n_flagged, {SAFE_MEDIAN} FROM s GROUP BY 1, 2"),
    "filtered_kpis": with_(f"SELECT auth_week, n, n_flagged, net_usd, {R('(net_usd - coalesce(lag(net_usd) OVER (ORDER BY auth_week), 0))', 2)} AS d_net_usd FROM (SELECT auth_week, {AGGS} FROM s WHERE {SOME} GROUP BY 1)"),
    "filtered_causes": with_(f"SELECT c.likely_cause, coalesce(n, 0) AS n, coalesce({R('(gross_under_usd / sum(gross_under_usd) OVER ())', 6)}, 0) AS share_of_loss FROM {NAMES} LEFT JOIN (SELECT likely_cause, {AGGS} FROM s WHERE category <> 'exact' AND {SOME} GROUP BY 1) USING (likely_cause)"),
    "filtered_mix": with_(f"SELECT auth_week, category, count(*) AS n, count(*) / CAST(sum(count(*)) OVER (PARTITION BY auth_week) AS BIGINT) AS share FROM s WHERE {SOME} GROUP BY 1, 2"),
    "filtered_rates": with_(f"SELECT 'amount_tier:' || amount_tier AS segment_key, count(*) AS n, count(*) FILTER (is_meaningful) AS n_flagged, {big('sum(count(*)) OVER () - count(*)', 'peer_n')}, {big('sum(count(*) FILTER (is_meaningful)) OVER () - count(*) FILTER (is_meaningful)', 'peer_flagged')} FROM s WHERE {SOME} GROUP BY amount_tier"),
    "status_detail": with_(f"SELECT (SELECT string_agg(DISTINCT auth_week, ',' ORDER BY auth_week) FROM fact WHERE week_end > {CLOSED}) AS open_weeks, (SELECT string_agg(DISTINCT auth_week, ',' ORDER BY auth_week) FROM fact WHERE week_end >= (SELECT CAST(as_of AS DATE) - 15 FROM clock)) AS provisional_weeks, (SELECT string_agg(DISTINCT auth_month, ',' ORDER BY auth_month) FROM fact) AS months, (SELECT coalesce(string_agg(DISTINCT auth_month, ',' ORDER BY auth_month), '') FROM fact WHERE CAST(auth_month || '-01' AS DATE) >= (SELECT min(auth_date) FROM fact) AND last_day(CAST(auth_month || '-01' AS DATE)) <= (SELECT CAST(as_of AS DATE) FROM clock)) AS full_months"),
    "spec_metrics": with_("SELECT * FROM spec", SPEC),
    "validation_gate": with_(f"SELECT check_name, CASE WHEN coalesce(v BETWEEN lo AND hi, false) THEN 'PASS' WHEN soft THEN 'WARN' ELSE 'FAIL' END AS status, {R('v', 4)} AS realized FROM ({' UNION ALL '.join(GATES)})", SPEC),
    "assertions": with_(" UNION ALL ".join(f"SELECT '{k}' AS check_name, CAST(({v}) AS BIGINT) AS n_bad" for k, v in ASSERTED.items())),
    "pii_scan": " UNION ALL ".join(f"SELECT '{t}' AS name, '{c}' AS \"column\", count(*) FILTER (h > 0) AS n_rows, {big('sum(h)', 'n_values')} FROM (SELECT len(regexp_extract_all(coalesce({c}, ''), '[A-Za-z0-9._]+@[a-z0-9.]+')) AS h FROM {t})" for t, c in (("documents", "text"), ("documents", "source"), ("conversations", "text"), ("conversations", "role"))),
}
