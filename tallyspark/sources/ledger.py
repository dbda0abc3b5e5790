"""Ledger, rates and reference tables: schemas, readers, and the ledger that the driver's tables imply."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..config import DEFAULT_MERCHANT, EXPONENTS

LEDGER = T.StructType(
    [T.StructField(n, t) for n, t in (
        ("transaction_id", T.StringType()), ("customer_id", T.StringType()), ("product_category", T.StringType()), ("country", T.StringType()), ("currency", T.StringType()),
        ("payer_currency", T.StringType()), ("is_cross_border", T.BooleanType()), ("psp", T.StringType()), ("status", T.StringType()), ("auth_ts", T.TimestampType()),
        ("settle_ts", T.TimestampType()), ("authorized_amount", T.LongType()), ("settled_amount", T.LongType()), ("item_count", T.IntegerType()), ("risk_score", T.DoubleType()),
        ("card_bin_country", T.StringType()), ("merchant_id", T.StringType()),
    )]
)
FX = T.StructType([T.StructField("rate_date", T.DateType()), T.StructField("currency", T.StringType()), T.StructField("local_per_usd", T.DoubleType())])


def read_ledger_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LEDGER).option("header", True).csv(path)


def read_fx_csv(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FX).option("header", True).csv(path)


def read_staged(spark: SparkSession, path: str) -> DataFrame:
    """Staged months; the partition columns prune but are not part of the ledger."""
    return spark.read.parquet(path).select(LEDGER.names)


def ledger_source(spark: SparkSession, path: str, kind: str = "csv") -> DataFrame:
    readers = {"csv": read_ledger_csv, "lake": read_staged}
    return readers[kind](spark, path)


def reference_tables(spark: SparkSession) -> dict[str, DataFrame]:
    """Exponents, dated VAT and dated fees: fixed values, lists of a few rows."""
    vat = [("AR", 21.0, False), ("CL", 19.0, False), ("CO", 19.0, True), ("MX", 16.0, True)]
    fees = [(f"PSP_{p}", 0.0, "2025-01-01", "2026-06-01" if p == "C" else None) for p in "ABCDE"] + [("PSP_C", 1.5, "2026-06-01", None)]
    dated = lambda df: df.withColumns({c: F.col(c).cast("date") for c in ("valid_from", "valid_to")})
    return {
        "exponents": spark.createDataFrame(list(EXPONENTS.items()), "currency string, exponent int"),
        "vat": dated(spark.createDataFrame([(*r, "2025-01-01", None) for r in vat], "country string, vat_pct double, tax_recalc boolean, valid_from string, valid_to string")),
        "fees": dated(spark.createDataFrame(fees, "psp string, contract_fee_usd double, valid_from string, valid_to string")),
    }


def stage_transactions(raw: DataFrame) -> DataFrame:
    """Trimmed, cased and typed, all statuses; an empty merchant is the default one."""
    upper = {c: F.upper(F.trim(c)) for c in ("country", "currency", "payer_currency", "psp", "card_bin_country")}
    plain = {c: F.trim(c) for c in ("transaction_id", "customer_id", "product_category")}
    typed = {f.name: F.col(f.name).cast(f.dataType) for f in LEDGER if not isinstance(f.dataType, T.StringType)}
    merchant = F.coalesce(F.nullif(F.trim("merchant_id"), F.lit("")), F.lit(DEFAULT_MERCHANT))
    return raw.select(*({**upper, **plain, **typed, "status": F.lower(F.trim("status")), "merchant_id": merchant}[c].alias(c) for c in LEDGER.names))


def stage_fx(raw: DataFrame) -> DataFrame:
    return raw.select(F.col("rate_date").cast("date"), F.upper(F.trim("currency")).alias("currency"), F.col("local_per_usd").cast("double").alias("local_per_usd")).withColumn("fx_key", F.concat_ws("|", "currency", "rate_date"))


#: Fixed values of the ledger that the driver's tables imply: country, currency, exponent, rate, daily step of the rate, fee.
MARKETS = (("MX", "MXN", 2, 18, 7, 3000), ("CO", "COP", 2, 4000, 11, 600000), ("AR", "ARS", 2, 1000, 13, 150000), ("CL", "CLP", 0, 950, 17, 1400))
START, SPAN, FX_DAYS = "2026-04-01", 7862400, 110


def projected_fx(spark: SparkSession) -> DataFrame:
    days = spark.range(FX_DAYS).select(F.col("id").alias("d"))
    markets = spark.createDataFrame([(m[1], float(m[3]), m[4]) for m in MARKETS], "currency string, base double, m int")
    rate = F.col("base") * (1000000 + ((F.col("d") * F.col("m")) % 41 - 20) * 300) / 1000000
    # the calendar and the currencies are fixed lists
    return days.join(F.broadcast(markets), F.lit(True)).select(F.date_add(F.lit(START).cast("date"), F.col("d").cast("int")).alias("rate_date"), "currency", rate.alias("local_per_usd"))


def projected_ledger(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Payments derived from orders and customers by integer arithmetic, so that another engine can repeat them."""
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet").select("o_orderkey", "o_custkey", "o_totalprice")
    customer = spark.read.parquet(f"{sf_dir}/customer.parquet").select("c_custkey", "c_nationkey", "c_mktsegment")
    k = F.col("o_orderkey")
    pick = lambda i: F.element_at(F.array(*(F.lit(m[i]) for m in MARKETS)), (F.col("c_nationkey") % 4 + 1).cast("int"))
    auth_s, lag_s = (k * 7919) % SPAN, 86400 + (k * 104729) % 1209600
    rows = orders.join(customer, orders.o_custkey == customer.c_custkey).select(
        k.alias("k"), "o_custkey", "c_mktsegment", "o_totalprice", *(pick(i).alias(n) for i, n in enumerate(("country", "currency", "e", "base", "m", "fee"))),
        auth_s.alias("auth_s"), (auth_s + lag_s).alias("settle_s"), ((k * 7919 % 1000003) % 100).alias("h"), (F.col("o_custkey") % 5 == 0).alias("xb"),
        (1 + k % 4).cast("int").alias("items"), ((k * 31 % 1000) / 1000).alias("risk"), F.concat(F.lit("PSP_"), F.substring(F.lit("ABCDE"), (k % 5 + 1).cast("int"), F.lit(1))).alias("psp"),
    )
    rows = rows.withColumn("status", F.when(F.col("k") % 25 == 7, "failed").when(F.col("settle_s") >= SPAN, "pending").otherwise("settled"))
    unit = F.pow(F.lit(10.0), F.col("e"))
    rows = rows.withColumn("a", F.floor(F.col("o_totalprice") * F.col("base") * unit / 1000).cast("bigint"))
    rate = lambda s: F.col("base").cast("double") * (1000000 + ((F.floor(s / 86400) * F.col("m")) % 41 - 20) * 300) / 1000000
    rows = rows.withColumn("ex", F.when(F.col("xb"), F.floor(F.col("a") * rate(F.col("settle_s")) / rate(F.col("auth_s")) + 0.5).cast("bigint")).otherwise(F.col("a")))
    ex, h, share = F.col("ex"), F.col("h"), lambda p: F.floor(F.col("ex") * p / 100.0).cast("bigint")
    settled = (
        F.when(h < 60, ex).when(h < 62, F.when(F.col("xb"), ex).otherwise(F.col("a") + 1)).when(h < 70, ex - share(3))
        .when((h < 78) & (F.col("items") >= 2), ex - F.floor(ex / F.col("items")).cast("bigint")).when((h >= 78) & (h < 83) & (F.col("psp") == "PSP_C"), ex - F.col("fee"))
        .when((h >= 83) & (h < 87) & ~F.col("xb") & F.col("country").isin("MX", "CO"), ex + share(1)).when((h >= 87) & (h < 91) & (F.col("risk") >= 0.8), ex - share(15))
        .when((h >= 91) & (h < 94), ex + share(4)).when((h >= 94) & (h < 96) & F.col("xb"), ex - ex % (1000 * unit).cast("bigint")).when((h >= 96) & (h < 98), ex - share(30)).otherwise(ex)
    )
    at = lambda s: F.timestamp_seconds(F.lit(1775001600) + s)
    done = F.col("status") == "settled"
    return rows.select(
        F.concat(F.lit("txn_"), F.lpad(F.col("k").cast("string"), 12, "0")).alias("transaction_id"), F.concat(F.lit("cus_"), F.lpad(F.col("o_custkey").cast("string"), 12, "0")).alias("customer_id"),
        F.col("c_mktsegment").alias("product_category"), "country", "currency", F.when(F.col("xb"), "USD").otherwise(F.col("currency")).alias("payer_currency"), F.col("xb").alias("is_cross_border"), "psp", "status",
        at(F.col("auth_s")).alias("auth_ts"), F.when(done, at(F.col("settle_s"))).alias("settle_ts"), F.col("a").alias("authorized_amount"), F.when(done, settled).alias("settled_amount"),
        F.col("items").alias("item_count"), F.col("risk").alias("risk_score"), F.col("country").alias("card_bin_country"), F.lit(DEFAULT_MERCHANT).alias("merchant_id"),
    )
