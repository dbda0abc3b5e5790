"""From staged transactions to the fact: one enriched row for each transaction."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions import columns as X
from ..sources import ledger
from .store import is_there, stored


def join_valid_on(df: DataFrame, dim: DataFrame, key: str, day: Column) -> DataFrame:
    """Joins the row of a dated dimension that is valid on ``day``: from valid_from on, before valid_to (open if null).

    Dimensions are small lists kept by hand, so that they are sent to all executors; the range is checked after the match of the key.
    """
    d = F.broadcast(dim.withColumnRenamed(key, "_key"))
    valid = (F.col("_key") == F.col(key)) & (F.col("valid_from") <= day) & (F.col("valid_to").isNull() | (day < F.col("valid_to")))
    return df.join(d, valid).drop("_key", "valid_from", "valid_to")


def join_fx(df: DataFrame, fx: DataFrame) -> DataFrame:
    """Rates of the auth day (required) and of the settle day (null unless settled)."""
    rate = lambda name: F.broadcast(fx.select(F.col("currency").alias("_c"), F.col("rate_date").alias("_d"), F.col("local_per_usd").alias(name)))
    out = df.join(rate("fx_auth"), (F.col("currency") == F.col("_c")) & (F.col("auth_ts").cast("date") == F.col("_d"))).drop("_c", "_d")
    return out.join(rate("fx_settle"), (F.col("currency") == F.col("_c")) & (F.col("settle_ts").cast("date") == F.col("_d")), "left").drop("_c", "_d")


def with_exponent(df: DataFrame, exponents: DataFrame) -> DataFrame:
    """The exponent of each row's currency, from a short list; an unknown currency stops the build, as its amounts have no meaning."""
    unknown = F.raise_error(F.concat(F.lit("unknown currency "), F.coalesce("currency", F.lit("null")))).cast("int")
    # a filter, since a column would only be looked at on rows that later look-ups keep
    return df.join(F.broadcast(exponents), "currency", "left").where(F.coalesce("exponent", unknown) >= 0)


def lookup_losses(staged: DataFrame, fx: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """(lookup, n_rows, n_lost): staged rows for which a look-up that the fact requires has nothing, by look-up. Such rows have no place in the fact (an unknown currency is an error there)."""
    day = F.col("auth_ts").cast("date")
    ids = staged.select("transaction_id", "currency", "country", "psp", "auth_ts")
    dated = lambda dim, key: join_valid_on(ids, dim.select(key, "valid_from", "valid_to"), key, day)
    rated = ids.join(F.broadcast(fx.select(F.col("currency").alias("_c"), F.col("rate_date").alias("_d"))), (F.col("currency") == F.col("_c")) & (day == F.col("_d")))
    found = {"exponent": ids.join(F.broadcast(refs["exponents"]), "currency"), "vat": dated(refs["vat"], "country"), "fee": dated(refs["fees"], "psp"), "rate of the auth day": rated}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("lookup"), "n") for name, rows in found.items()]
    # one row with the number of all rows
    out = reduce(DataFrame.unionByName, counts).crossJoin(F.broadcast(ids.agg(F.count("*").alias("n_rows"))))
    return out.select("lookup", "n_rows", (F.col("n_rows") - F.col("n")).alias("n_lost"))


def enriched(staged: DataFrame, fx: DataFrame, refs: dict[str, DataFrame]) -> DataFrame:
    """All look-ups, the amount in USD, the move of the rate, the lag, calendar and tiers."""
    day = F.col("auth_ts").cast("date")
    out = join_valid_on(with_exponent(staged, refs["exponents"]), refs["vat"].drop("vat_pct"), "country", day)
    out = join_fx(join_valid_on(out, refs["fees"], "psp", day), fx)
    out = out.withColumns({
        "amount_usd": X.to_usd("authorized_amount", "exponent", "fx_auth"),
        "fx_move_pct": (F.col("fx_settle") / F.col("fx_auth") - 1) * 100,
        "settle_lag_days": X.half_up((F.col("settle_ts").cast("long") - F.col("auth_ts").cast("long")) / 86400.0, 2),
        **X.calendar("auth_ts"),
    })
    return out.withColumns({"amount_tier": X.amount_tier("amount_usd"), "is_over_300": F.col("amount_usd") > 300, "lag_bucket": X.lag_bucket("settle_lag_days")})


def with_money(df: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Expected amount, residual and category; used for batches and streams alike."""
    out = df.withColumn("expected_settled", F.when(F.col("status") == "settled", X.expected_settled("authorized_amount", "fx_auth", "fx_settle", "is_cross_border")))
    residual = F.col("settled_amount") - F.col("expected_settled")
    out = out.withColumns({"diff_local": F.col("settled_amount") - F.col("authorized_amount"), "residual": residual})
    out = out.withColumns({
        "residual_pct": X.half_up(F.try_divide(100.0 * F.col("residual"), F.col("expected_settled")), 4),
        "residual_usd": X.half_up(X.to_usd("residual", "exponent", "fx_auth"), 2),
        "settled_usd": X.half_up(X.to_usd("settled_amount", "exponent", "fx_auth"), 2),
    })
    return out.withColumns({"abs_residual_usd": F.abs("residual_usd"), "category": X.category("status", "diff_local", "residual_pct", "residual_usd", t)})


def with_fee_repeats(df: DataFrame) -> DataFrame:
    """How many non-exact rows share a row's psp, currency and residual; null on exact and unsettled rows.

    Counted by key and joined back, since a window would put a frequent residual into one task; keys that occur once need no row. Exact and unsettled rows, which are
    most, have no partner and take no part in the join.
    """
    key = ["psp", "currency", "residual"]
    odd = F.coalesce(F.col("category") != "exact", F.lit(False))
    often = df.where(odd).groupBy(*key).agg(F.count("*").alias("_n")).where("_n > 1")
    same = [F.col(f"r.{c}").eqNullSafe(F.col(f"o.{c}")) for c in key]
    out = df.where(odd).alias("r").join(often.alias("o"), reduce(Column.__and__, same), "left").select("r.*", F.coalesce("o._n", F.lit(1).cast("bigint")).alias("fee_repeats"))
    return out.unionByName(df.where(~odd).withColumn("fee_repeats", F.lit(None).cast("bigint")))


def build_fact(staged: DataFrame, fx: DataFrame, refs: dict[str, DataFrame], t: Thresholds = DEFAULTS, hold: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """``hold`` may write the rows with their money down: counting repeats reads them twice."""
    out = hold(with_money(enriched(staged, fx, refs), t))
    out = out.withColumns({
        "is_lag_outlier": F.col("settle_lag_days") > t.lag_outlier_days,
        "is_meaningful": F.coalesce(F.col("category").isin("meaningful", "large"), F.lit(False)),
        "direction": X.direction("residual"),
        "rounding_flag": X.on_rounding_step("settled_amount", "expected_settled", "exponent", t),
    })
    out = with_fee_repeats(out)
    return out.withColumns({"why_flagged": X.why_flagged("category", "residual_pct", "residual_usd", t), "likely_cause": X.likely_cause(t)})


_held: dict[tuple[str, str], DataFrame] = {}


def projected_fact(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fact of the driver's tables, written down once: a barrier, as later filters would else be pushed through every formula, of which each query reads only its columns."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _held or not is_there(_held[key]):
        # the staged ledger is a barrier too: its formulas would else be repeated in every layer of the fact
        staged = stored(ledger.stage_transactions(ledger.projected_ledger(spark, sf_dir)))
        _held[key] = stored(build_fact(staged, ledger.projected_fx(spark), ledger.reference_tables(spark), hold=stored))
    return _held[key]
