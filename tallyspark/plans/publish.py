"""Builds are written aside, checked, and only then become what readers see; report tables and exports."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators import marts, quality
from ..sources.ingest import exists

VERSIONS = "nth bigint, version string"
#: The columns of the stored fact, by type.
FACT_COLUMNS = {
    T.StringType(): "transaction_id merchant_id customer_id product_category country currency payer_currency psp status card_bin_country auth_weekday auth_week auth_month week_month amount_tier lag_bucket category direction why_flagged likely_cause",
    T.BooleanType(): "is_cross_border tax_recalc is_weekend is_over_300 is_lag_outlier is_meaningful rounding_flag",
    T.TimestampType(): "auth_ts settle_ts",
    T.DateType(): "auth_date week_start week_end",
    T.LongType(): "authorized_amount settled_amount expected_settled diff_local residual fee_repeats",
    T.IntegerType(): "item_count exponent",
    T.DoubleType(): "risk_score contract_fee_usd fx_auth fx_settle amount_usd fx_move_pct settle_lag_days residual_pct residual_usd settled_usd abs_residual_usd",
}
FACT_CONTRACT = T.StructType([T.StructField(c, kind) for kind, names in FACT_COLUMNS.items() for c in names.split()])


def published_version(spark: SparkSession, root: str) -> tuple[int, str | None]:
    """The number and the folder of the version that readers see; 0 and None before the first one."""
    if not exists(spark, f"{root}/current"):
        return 0, None
    last = spark.read.schema(VERSIONS).json(f"{root}/current").orderBy(F.desc("nth")).first()
    return (last.nth, last.version) if last else (0, None)


def publish_build(spark: SparkSession, tables: dict[str, DataFrame], root: str, checks: Callable[[dict[str, DataFrame]], DataFrame], contracts: dict[str, T.StructType] | None = None) -> str:
    """Writes all tables below a new version of ``root``, runs ``checks`` on what was written, and makes the version current if no check counts anything bad.

    ``contracts`` are the stored schemas that tables must have (if not given, the fact's ``FACT_CONTRACT``); a table that gains, loses or retypes a column isn't published.
    ``checks`` gives (check_name, n_bad) of the stored tables. A failed check is an error, and the last good version stays current. The pointer is one line that is
    appended, so that a reader sees the old version or the new one as a whole.
    """
    nth, _ = published_version(spark, root)
    version = f"v{nth + 1}-{uuid.uuid4().hex[:12]}"
    for name, df in tables.items():
        df.write.parquet(f"{root}/versions/{version}/{name}")
    stored = {name: spark.read.parquet(f"{root}/versions/{version}/{name}") for name in tables}
    contracts = {"fact": FACT_CONTRACT} if contracts is None else contracts
    faults = {name: quality.contract_faults(stored[name], c, ordered=False) for name, c in contracts.items() if name in stored}
    if any(faults.values()):
        raise ValueError(f"build {version} isn't published: {({k: v for k, v in faults.items() if v})}")
    bad = checks(stored).where("n_bad > 0").limit(20).collect()
    if bad:
        raise ValueError(f"build {version} isn't published: {[(r.check_name, r.n_bad) for r in bad]}")
    spark.createDataFrame([(nth + 1, version)], VERSIONS).coalesce(1).write.mode("append").json(f"{root}/current")
    return version


def read_published(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the current version."""
    _, version = published_version(spark, root)
    if version is None:
        raise FileNotFoundError(f"nothing is published below {root}")
    return spark.read.parquet(f"{root}/versions/{version}/{name}")


def built_tables(fct: DataFrame) -> dict[str, DataFrame]:
    """The fact and its marts."""
    return {"fact": fct, "psp_weekly": marts.psp_weekly(fct), "segment_rates": marts.segment_rates(marts.segment_mart(fct)), "cause_summary": marts.cause_mart(fct), "outliers": marts.outliers(fct)}


def table_row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    """(name, n) of each table."""
    return reduce(DataFrame.unionByName, (df.agg(F.lit(name).alias("name"), F.count("*").alias("n")) for name, df in tables.items()))


def rounded(df: DataFrame) -> DataFrame:
    """Floats to six places; NaN becomes null."""
    plain = lambda c: F.when(~F.isnan(c), F.round(F.col(c), 6))
    return df.select(*(plain(c).alias(c) if t in ("double", "float") else F.col(c) for c, t in df.dtypes))


def write_table(df: DataFrame, path: str, kind: str = "parquet", order: Sequence[str] = ()) -> None:
    """A report table as csv, parquet or jsonl, floats to six places, rows in a fixed order: by ``order``, else by all columns that can be sorted."""
    keys = list(order) or [c for c, t in df.dtypes if not t.startswith("map")]
    out = rounded(df).orderBy(*keys).write.mode("overwrite")
    writers = {"csv": lambda: out.option("header", True).csv(path), "parquet": lambda: out.parquet(path), "jsonl": lambda: out.option("ignoreNullFields", False).json(path)}
    if kind not in writers:
        raise ValueError(f"{kind} is none of {sorted(writers)}")
    writers[kind]()


def read_table(spark: SparkSession, path: str, kind: str = "parquet") -> DataFrame | None:
    """A report table, or None if it isn't there."""
    if not exists(spark, path):
        return None
    readers = {"csv": lambda: spark.read.option("header", True).option("inferSchema", True).csv(path), "parquet": lambda: spark.read.parquet(path), "jsonl": lambda: spark.read.json(path)}
    return readers[kind]()


def export_transactions_csv(fct: DataFrame, path: str, filters: marts.Filters = marts.EVERYTHING, min_usd: float = 0.0) -> None:
    """All matching rows with masked customers, as csv."""
    marts.query_transactions(fct, filters, min_usd, None).write.mode("overwrite").option("header", True).csv(path)
