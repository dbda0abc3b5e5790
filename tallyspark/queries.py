"""The registered queries: each takes (spark, sf_dir) and works on the tables there."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import columns as X
from .functions import money
from .operators import alerts, findings, incremental, marts, quality, questions, stats
from .plans import fact, publish
from .plans.fact import build_fact, projected_fact
from .plans.store import stored
from .sources import ledger
from .streaming import match

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
Query = Callable[[SparkSession, str], DataFrame]
FACT_COLUMNS = "transaction_id psp country currency status category residual residual_pct residual_usd settled_usd expected_settled direction rounding_flag fee_repeats why_flagged likely_cause auth_week week_start week_end week_month auth_weekday is_weekend amount_tier is_over_300 lag_bucket settle_lag_days is_meaningful".split()


def of_fact(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(projected_fact(spark, sf_dir))


def of_frame(f: Callable[[DataFrame], DataFrame]) -> Query:
    return lambda spark, sf_dir: f(stored(alerts.alert_frame(projected_fact(spark, sf_dir))))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ledger_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.projected_ledger(spark, sf_dir).groupBy("country", "status").agg(F.count("*").alias("n"), F.sum("authorized_amount").alias("authorized"), F.sum("settled_amount").alias("settled"))


def segment_lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_linestatus", "l_linenumber", (F.col("l_extendedprice") * F.col("l_discount")).alias("loss"))
    segments = {"flag": ("l_returnflag",), "status": ("l_linestatus",), "line": ("l_linenumber",)}
    return marts.segment_rows(rows, segments, ["l_returnflag", "loss"]).groupBy("segment_type", "segment_value").agg(F.count("*").alias("n"), F.count_if(F.col("l_returnflag") == "R").alias("n_flagged"), X.half_up(F.sum("loss"), 0).alias("loss"))


def event_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks and the purchases of the same user within two hours: an interval join. Hours are dealt to buckets, so that a busy user's rows spread out."""
    rows = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "ts", F.floor(F.unix_seconds(F.col("ts").cast("timestamp")) / 7200).alias("slot"))
    c = rows.where("event_type = 'click'").select(F.col("event_id").alias("click_id"), "user_id", F.col("ts").alias("a"), F.explode(F.array("slot", F.col("slot") + 1)).alias("slot"))
    p = rows.where("event_type = 'purchase'").select(F.col("event_id").alias("purchase_id"), "user_id", F.col("ts").alias("b"), "slot")
    return c.join(p, ["user_id", "slot"]).where("b between a and a + interval 2 hours").select("click_id", "purchase_id")


def daily_volume_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = table(spark, sf_dir, "events").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.count("*").alias("n"))
    return quality.volume_flags(daily, "event_type")


def pii_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    has = F.col("text").rlike("[A-Za-z0-9._]+@[a-z0-9.]+")
    return table(spark, sf_dir, "documents").groupBy("source").agg(F.count("*").alias("n"), F.count_if(has).alias("n_email"))


def table_row_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return publish.table_row_counts({n: table(spark, sf_dir, n) for n in TABLES})


def pii_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mail addresses in the text columns of documents and conversations."""
    scan = lambda name, columns: quality.pii_scan(table(spark, sf_dir, name), columns, "[A-Za-z0-9._]+@[a-z0-9.]+").withColumn("name", F.lit(name))
    return scan("documents", ["text", "source"]).unionByName(scan("conversations", ["text", "role"]))


def stream_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = match.to_events(ledger.projected_ledger(spark, sf_dir))
    amount = F.coalesce(F.get_json_object("value", "$.authorized_amount"), F.get_json_object("value", "$.settled_amount")).cast("bigint")
    return events.groupBy("topic").agg(F.count("*").alias("n"), F.sum(amount).alias("amount"))


def stream_parity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stream's rules on the same events, as a batch: all matches agree with the fact."""
    events = match.to_events(stored(ledger.projected_ledger(spark, sf_dir)))
    auths = match.parsed(events.where("topic = 'auths'"), match.AUTHS)
    settlements = match.parsed(events.where("topic = 'settlements'"), match.SETTLEMENTS)
    rows = match.categorised(match.match_settlements(auths, settlements), ledger.projected_fx(spark), ledger.reference_tables(spark)["exponents"])
    return match.compare_stream_batch(rows, projected_fact(spark, sf_dir))


def incremental_equals_full(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A fact of the ledger as of mid-June, brought up to date with what came later."""
    full, fx, refs = stored(ledger.stage_transactions(ledger.projected_ledger(spark, sf_dir))), ledger.projected_fx(spark), ledger.reference_tables(spark)
    build = lambda rows: build_fact(rows, fx, refs, hold=stored)
    before = stored(build(ledger.stage_transactions(marts.as_of_snapshot(full, "2026-06-10 00:00:00"))))
    return incremental.incremental_fact(full, before, build).groupBy("category").agg(F.count("*").alias("n"), F.sum("fee_repeats").alias("repeats"))


def as_of_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = marts.as_of_snapshot(ledger.projected_ledger(spark, sf_dir), "2026-05-31 00:00:00")
    return rows.groupBy("status").agg(F.count("*").alias("n"), F.count("settled_amount").alias("n_amounts"), F.sum("settled_amount").alias("settled"))


def segment_rates(f: DataFrame) -> DataFrame:
    return marts.segment_rates(marts.segment_mart(f)).select("segment_key", "n", "n_flagged", "rate", "peer_n", "peer_flagged", "peer_rate", X.half_up("ci_low", 9).alias("ci_low"), "low_sample")


#: Filters of the registered filtered reads.
SOME = marts.Filters(country=("MX", "AR"), xb="domestic", date_from="2026-04-10")


def all_alerts(f: DataFrame) -> DataFrame:
    return alerts.evaluate(alerts.alert_frame(f), alerts.last_closed(f))


def notifications(f: DataFrame) -> DataFrame:
    """What is sent when alerts that have stood for four weeks are muted for two."""
    told = all_alerts(f)
    return alerts.notification_plan(alerts.annotate(told, alerts.standing_mutes(told)))


def money_cents(f: DataFrame) -> DataFrame:
    """Exact US cents authorised and settled by currency, and on how many settled rows the fact's rounded double is another cent."""
    cents = lambda c: money.usd_cents(c, "exponent", "fx_auth")
    rows = f.select("currency", cents("authorized_amount").alias("a"), cents("settled_amount").alias("s"), X.half_up(F.col("settled_usd") * 100).cast("bigint").alias("d"))
    return rows.groupBy("currency").agg(F.sum("a").alias("authorized_cents"), F.sum("s").alias("settled_cents"), F.count_if(F.col("s") != F.col("d")).alias("n_off"))


def drop_merchant(f: Callable[[DataFrame], DataFrame]) -> Callable[[DataFrame], DataFrame]:
    return lambda fct: f(fct).drop("merchant_id")


QUERIES: dict[str, Query] = {
    "ledger_totals": ledger_totals,
    "fact": of_fact(lambda f: f.select(FACT_COLUMNS)),
    "money_cents": of_fact(money_cents),
    "lookup_losses": lambda spark, sf_dir: fact.lookup_losses(ledger.stage_transactions(ledger.projected_ledger(spark, sf_dir)), ledger.projected_fx(spark), ledger.reference_tables(spark)),
    "psp_weekly": of_fact(marts.psp_weekly),
    "segment_mart": of_fact(marts.segment_mart),
    "segment_rates": of_fact(segment_rates),
    "excess_loss": of_fact(lambda f: marts.excess_loss(marts.segment_rates(marts.segment_mart(f))).drop("merchant_id", "peer_rate")),
    "cause_mart": of_fact(marts.cause_mart),
    "cause_summary": of_fact(lambda f: marts.cause_summary(f).select("likely_cause", "n", "gross_under_usd", "share_of_loss")),
    "outliers": of_fact(marts.outliers),
    "settled_facts": of_fact(marts.settled_facts),
    "query_transactions": of_fact(lambda f: marts.query_transactions(f, marts.Filters(country=("MX", "CO")), 5, None)),
    "top_transactions": of_fact(marts.query_transactions),
    "kpis": of_fact(lambda f: marts.kpis(f).select("auth_week", "n", "n_flagged", "n_large", "net_usd", "d_rate_pts", "d_net_usd", "d_n_large")),
    "weekly_trend": of_fact(drop_merchant(marts.weekly_trend)),
    "worst_week": of_fact(lambda f: marts.worst_week(marts.psp_weekly(f)).drop("merchant_id", "rate")),
    "weekly_leaks": of_fact(drop_merchant(marts.weekly_leaks)),
    "lag_by_country_tier": of_fact(drop_merchant(marts.lag_by_country_tier)),
    "category_mix": of_fact(drop_merchant(marts.category_mix)),
    "pending": of_fact(drop_merchant(marts.pending)),
    "status": of_fact(lambda f: marts.status(f).drop("last_full_month")),
    "week_over_week": of_fact(drop_merchant(marts.week_over_week)),
    "similar_counts": of_fact(marts.similar_counts),
    "top_causes": of_fact(lambda f: marts.top_causes(f, ["psp", "country"])),
    "signatures": of_fact(lambda f: marts.signature_table(f).drop("merchant_id", "volume_share", "systematic")),
    "sensitivity": of_fact(lambda f: marts.sensitivity(f).drop("merchant_id", "rate")),
    "rate_matrix": of_fact(marts.rate_matrix),
    "value_mix": of_fact(lambda f: marts.value_mix(f, "category")),
    "quality_metrics": of_fact(quality.quality_metrics),
    "table_checks": of_fact(quality.table_checks),
    "alert_frame": of_fact(alerts.alert_frame),
    "money_leak": of_frame(lambda a: alerts.money_leak_rule(a).select("week_idx", "severity", "n", "value")),
    "large_rows": of_frame(lambda a: alerts.large_rows_rule(a).select("week_idx", "n", "value", "details")),
    "pending_aging": of_frame(lambda a: alerts.pending_aging_rule(a).select("segment", "severity", "n", "value")),
    "settle_lag": of_frame(lambda a: alerts.settle_lag_rule(a).select("week_idx", "segment", "n", "severity")),
    "alerts": of_fact(all_alerts),
    "notifications": of_fact(notifications),
    "money_lines": of_frame(lambda a: alerts.money_lines(a).drop("merchant_id")),
    "all_tests": of_fact(questions.all_tests),
    "test_counts": of_fact(lambda f: questions.all_tests(f).select("question", "segment_type", "segment_value", "n", "n_flagged", "peer_n", "peer_flagged").where("segment_value <> 'spearman'")),
    "fee_drift": of_fact(lambda f: questions.fee_drift(f).select("psp", "n", "n_flagged", "peer_n", "peer_flagged")),
    "summary": of_fact(lambda f: questions.summarize(f).drop("merchant_id", "flag_rate", "non_exact_rate")),
    "small_cells": of_fact(lambda f: questions.small_cells(f, 800).drop("merchant_id")),
    "truth_scores": of_fact(lambda f: questions.truth_scores(marts.settled(f), f.select("transaction_id", F.when(F.col("residual") != 0, "psp_fee").alias("true_cause")))),
    "rate_frame": of_fact(lambda f: questions.rate_frame(marts.settled(f), ["country", "amount_tier"]).select("country", "amount_tier", "n", "n_flagged", X.half_up("median_loss_usd", 2).alias("median_loss_usd"))),
    "filtered_kpis": of_fact(lambda f: marts.kpis(f, SOME).select("auth_week", "n", "n_flagged", "net_usd", "d_net_usd")),
    "filtered_causes": of_fact(lambda f: marts.cause_summary(f, SOME).select("likely_cause", "n", "share_of_loss")),
    "filtered_mix": of_fact(lambda f: marts.category_mix(f, SOME).drop("merchant_id")),
    "filtered_rates": of_fact(lambda f: marts.filtered_rates(f, "amount_tier", SOME).select("segment_key", "n", "n_flagged", "peer_n", "peer_flagged")),
    "status_detail": of_fact(lambda f: marts.status_detail(f).select(*(F.array_join(c, ",").alias(c) for c in ("open_weeks", "provisional_weeks", "months", "full_months")))),
    "spec_metrics": of_fact(quality.spec_metrics),
    "validation_gate": of_fact(lambda f: quality.validation_gate(quality.spec_metrics(f)).select("check_name", "status", X.half_up("realized", 4).alias("realized"))),
    "assertions": lambda spark, sf_dir: quality.assertions(projected_fact(spark, sf_dir), ledger.reference_tables(spark), ledger.projected_ledger(spark, sf_dir)),
    "cause_psp": of_fact(stats.cause_psp),
    "lag_tests": of_fact(stats.lag_tests),
    "spearman": of_fact(lambda f: stats.spearman(marts.settled(f).where("category <> 'exact'").withColumn("pct", F.abs("residual_pct")), "amount_usd", "pct", ["merchant_id"])),
    "glm": of_fact(stats.fit_glm),
    "findings": of_fact(lambda f: findings.findings(questions.all_tests(f), f)),
    "recommendations": of_fact(lambda f: findings.recommend(findings.findings(questions.all_tests(f), f))),
    "as_of_snapshot": as_of_snapshot,
    "incremental_equals_full": incremental_equals_full,
    "segment_lineitem": segment_lineitem,
    "event_matches": event_matches,
    "daily_volume_flags": daily_volume_flags,
    "pii_documents": pii_documents,
    "pii_scan": pii_scan,
    "table_row_counts": table_row_counts,
    "stream_events": stream_events,
    "stream_parity": stream_parity,
}
