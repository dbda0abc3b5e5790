"""The streaming twin of the fact's money rules: authorisations meet their settlements within a bounded time."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.fact import join_fx, with_money

AUTHS = T.StructType([T.StructField(n, t) for n, t in (
    ("transaction_id", T.StringType()), ("merchant_id", T.StringType()), ("psp", T.StringType()), ("country", T.StringType()), ("currency", T.StringType()), ("payer_currency", T.StringType()),
    ("is_cross_border", T.BooleanType()), ("authorized_amount", T.LongType()), ("auth_ts", T.TimestampType()), ("auth_status", T.StringType()),
)])
SETTLEMENTS = T.StructType([T.StructField(n, t) for n, t in (("transaction_id", T.StringType()), ("settled_amount", T.LongType()), ("settle_ts", T.TimestampType()))])


RATES = "rate_date date, currency string, local_per_usd double"


def to_events(ledger: DataFrame) -> DataFrame:
    """(topic, key, event_ts, value): an authorisation of each row and a settlement of each settled one; values are JSON."""
    failed = F.col("status") == "failed"
    auth = F.to_json(F.struct(*(F.col(c) for c in AUTHS.names[:-1]), F.when(failed, "failed").otherwise("authorized").alias("auth_status")))
    settlement = F.to_json(F.struct(*(F.col(c) for c in SETTLEMENTS.names)))
    event = lambda rows, topic, ts, value: rows.select(F.lit(topic).alias("topic"), F.col("transaction_id").alias("key"), F.col(ts).alias("event_ts"), value.alias("value"))
    # who reads one topic makes no values of the other
    return event(ledger, "auths", "auth_ts", auth).unionByName(event(ledger.where("status = 'settled'"), "settlements", "settle_ts", settlement))


def event_order() -> list[Column]:
    return [F.col("event_ts"), F.col("topic") != "auths", F.col("key")]


def parsed(raw: DataFrame, schema: T.StructType, value: str = "value") -> DataFrame:
    return raw.select(F.from_json(F.col(value).cast("string"), schema).alias("v")).select("v.*")


def kafka_source(spark: SparkSession, servers: str, topic: str) -> DataFrame:
    return spark.readStream.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).option("startingOffsets", "earliest").load()


def publish_events(events: DataFrame, servers: str) -> None:
    events.select("topic", "key", "value", F.col("event_ts").alias("timestamp")).write.format("kafka").option("kafka.bootstrap.servers", servers).save()


def tail_topic(spark: SparkSession, servers: str, topic: str, limit: int) -> DataFrame:
    return spark.read.format("kafka").option("kafka.bootstrap.servers", servers).option("subscribe", topic).load().limit(limit)


def match_settlements(auths: DataFrame, settlements: DataFrame, days: int = 15, late: str = "1 minute", how: str = "inner") -> DataFrame:
    """Pairs of the same id whose settlement comes within ``days`` of the authorisation; state is kept no longer than that.

    With how='leftOuter' authorisations that were never settled come out once the time is over.
    """
    a = auths.where("auth_status <> 'failed'").withWatermark("auth_ts", late) if auths.isStreaming else auths.where("auth_status <> 'failed'")
    s = settlements.withColumnRenamed("transaction_id", "settled_id")
    s = s.withWatermark("settle_ts", late) if settlements.isStreaming else s
    in_time = F.expr(f"transaction_id = settled_id and settle_ts >= auth_ts and settle_ts <= auth_ts + interval {days} days")
    return a.join(s, in_time, how).drop("settled_id")


def categorised(matched: DataFrame, fx: DataFrame, exponents: DataFrame) -> DataFrame:
    """Matches with rates, expected amount, residual and category, by the same columns as the batch fact; rows without a settlement (outer matches) are pending and have none of these."""
    rows = matched.withColumn("status", F.when(F.col("settle_ts").isNotNull(), "settled").otherwise("pending")).join(F.broadcast(exponents), "currency")
    out = with_money(join_fx(rows, fx))
    return out.select("transaction_id", "merchant_id", "psp", "country", "currency", "is_cross_border", "authorized_amount", "settled_amount", "auth_ts", "settle_ts", "expected_settled", "residual", "residual_pct", "residual_usd", "category")


def read_bounded_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A small reference table from CSV, read leniently: values that can't be read are null, and rows without one of their values, such as a header row, drop out."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").csv(path).dropna()


def priced_from_csv(rates_path: str, exponents_path: str) -> Callable[[DataFrame], DataFrame]:
    """``categorised`` with reference tables that are read anew at each call, so that each batch of a stream sees the tables as they are then."""

    def price(batch: DataFrame) -> DataFrame:
        spark = batch.sparkSession
        return categorised(batch, read_bounded_csv(spark, rates_path, RATES), read_bounded_csv(spark, exponents_path, "currency string, exponent int"))

    return price


def run_to_sinks(stream: DataFrame, matched_path: str, large_path: str, checkpoint: str, trigger: dict | None = None, price: Callable[[DataFrame], DataFrame] | None = None):
    """One query, two sinks: all matches as Parquet, and the large ones as keyed JSON. Each batch replaces its own folder, so that a repeat changes nothing.

    ``stream`` is priced already, or ``price`` does it batch by batch (see ``priced_from_csv``).
    """

    def write(batch: DataFrame, number: int) -> None:
        held = (batch if price is None else price(batch)).persist()
        held.write.mode("overwrite").parquet(f"{matched_path}/batch={number}")
        large = held.where("category = 'large'").select(F.col("transaction_id").alias("key"), F.to_json(F.struct("*")).alias("value"))
        large.write.mode("overwrite").json(f"{large_path}/batch={number}")
        held.unpersist()

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()


def read_matched(spark: SparkSession, path: str) -> DataFrame:
    """The last row of each id over all batches."""
    rows = spark.read.parquet(path)
    last = rows.groupBy("transaction_id").agg(F.max_by(F.struct(*(c for c in rows.columns if c != "transaction_id")), "batch").alias("r"))
    return last.select("transaction_id", "r.*").drop("batch").withColumn("category", F.trim("category"))


def compare_stream_batch(stream: DataFrame, batch: DataFrame) -> DataFrame:
    """Agreement of the stream's categories with the batch's, by category and over all ('ALL')."""
    b = batch.select("transaction_id", F.col("category").alias("batch_category"))
    rows = stream.select("transaction_id", "category").join(b, "transaction_id", "left").withColumn("batch_category", F.coalesce("batch_category", F.lit("not in batch")))
    out = rows.rollup("batch_category").agg(F.count("*").alias("n"), F.count_if(F.col("category") == F.col("batch_category")).alias("n_match"))
    return out.select(F.coalesce("batch_category", F.lit("ALL")).alias("category"), "n", "n_match", F.try_divide("n_match", "n").alias("rate"))
