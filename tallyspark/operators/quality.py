"""Data quality: table checks, metrics, contracts, freshness, volume, personal data."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..config import BANNED_FIELDS, DEFAULTS, PSPS, Thresholds
from ..functions import columns as X
from .quantiles import medians


def table_checks(fct: DataFrame) -> DataFrame:
    """Violations by check, in one pass."""
    settled = F.col("status") == "settled"
    checks = {
        "transaction_id unique": F.count("*") - F.countDistinct("transaction_id"),
        "psp accepted": F.count_if(~F.col("psp").isin(*PSPS)),
        "settled complete": F.count_if(settled & (F.col("settled_amount").isNull() | F.col("category").isNull())),
        "settle after auth": F.count_if(F.col("settle_ts") < F.col("auth_ts")),
        "category null unless settled": F.count_if(~settled & F.col("category").isNotNull()),
    }
    one = fct.agg(*(c.alias(f"c{i}") for i, c in enumerate(checks.values())))
    return one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(f"c{i}").alias("n_bad")) for i, k in enumerate(checks)))).alias("x")).select("x.*")


def failed(checks: DataFrame) -> bool:
    return not checks.where("n_bad > 0").isEmpty()


def quality_metrics(fct: DataFrame) -> DataFrame:
    count = lambda c, name: F.count_if(c).alias(name)
    # ids alone are counted as distinct rows: PSPs and days are few, so that their sets are small
    few = lambda c, name: F.size(F.collect_set(c)).cast("bigint").alias(name)
    one = fct.agg(
        F.count("*").alias("n"), F.countDistinct("transaction_id").alias("n_ids"), *(count(F.col("status") == s, f"n_{s}") for s in ("settled", "pending", "failed")),
        count(F.col("is_cross_border"), "n_cross_border"), count(F.col("is_meaningful"), "n_flagged"), few("psp", "n_psps"), few("auth_date", "n_days"),
    )
    middle = medians(fct, {"median_lag": F.col("settle_lag_days"), "median_usd": F.col("amount_usd")})
    # one row beside one row
    return one.crossJoin(middle.select(*(X.half_up(c, 4).alias(c) for c in middle.columns)))


#: The metric that a band is about, and its bounds as shares.
SHARE_BANDS = {"match exactly": ("k_match", 0.60, 0.70), "small": ("k_small", 0.15, 0.20), "meaningful": ("k_meaningful", 0.10, 0.18), "large": ("k_large", 0.03, 0.05)}
#: Check -> (metric, factor, least, most); None is no bound.
PLAIN_CHECKS = {
    "rows": ("rows", 1, 500, None), "months": ("months", 1, 3, 4), "psps": ("psps", 1, 3, 5), "failed rows": ("failed", 1, 1, None), "pending rows": ("pending", 1, 1, None),
    "median settle lag": ("median_lag", 1, 1, 7), "lag outliers": ("lag_outliers", 1, 1, None), "null metadata rows": ("null_metadata", 1, 0, 0),
}
PATTERN_CHECKS = {"P1 flag-rate gap": ("p1_gap", 100, 2.5, None), "P2 median lag gap": ("p2_gap_days", 1, 2, None), "P3 weekend ratio": ("p3_ratio", 1, 1.2, None), "P4 rounding share": ("p4_share", 1, 0.9, 1)}


def spec_metrics(fct: DataFrame) -> DataFrame:
    """One row of 19 metrics of the fact: one pass for counts, one for medians. Lists are joined by commas."""
    s = F.col("status") == "settled"
    count = lambda c: F.count_if(F.coalesce(c, F.lit(False)))
    share = lambda flag, where: F.try_divide(count(where & F.coalesce(F.col(flag), F.lit(False))), count(where))
    lag = lambda where: F.when(where, F.col("settle_lag_days"))
    few = lambda c, name: F.size(F.collect_set(c)).cast("bigint").alias(name)
    ar, co = s & (F.col("country") == "AR"), s & (F.col("country") == "CO")
    names = lambda c: F.array_join(F.array_sort(F.collect_set(c)), ",")
    category = F.col("category")
    one = fct.agg(
        F.count("*").alias("rows"), count(s).alias("settled"), few("auth_month", "months"), names("country").alias("countries"), names("currency").alias("currencies"), few("psp", "psps"),
        count(F.col("status") == "failed").alias("failed"), count(F.col("status") == "pending").alias("pending"), count(s & F.col("is_lag_outlier")).alias("lag_outliers"),
        count(F.col("customer_id").isNull() | F.col("product_category").isNull() | F.col("amount_tier").isNull() | F.col("is_cross_border").isNull()).alias("null_metadata"),
        count(s & category.isin("exact", "rounding")).alias("k_match"), count(s & (category == "fx_tolerance")).alias("k_small"), count(s & category.isin("meaningful", "large")).alias("k_meaningful"), count(s & (category == "large")).alias("k_large"),
        (share("is_meaningful", ar & (F.col("psp") == "PSP_B")) - share("is_meaningful", ar & (F.col("psp") != "PSP_B"))).alias("p1_gap"),
        F.try_divide(share("is_meaningful", s & F.col("is_weekend")), share("is_meaningful", s & ~F.col("is_weekend"))).alias("p3_ratio"),
        share("rounding_flag", s & (F.col("psp") == "PSP_D") & F.col("is_cross_border") & F.col("currency").isin("CLP", "COP")).alias("p4_share"),
    )
    middle = medians(fct, {"median_lag": lag(s), "_over": lag(co & F.col("is_over_300")), "_under": lag(co & ~F.col("is_over_300"))})
    # one row beside one row
    return one.crossJoin(middle.select("median_lag", (F.col("_over") - F.col("_under")).alias("p2_gap_days")))


def checked(name: str, value: Column, low: Column | float | None, high: Column | float | None, soft: bool = False) -> Column:
    """A check's row: PASS within the bounds, else WARN if it is soft and FAIL if not; a missing value is outside."""
    bound = lambda x, least: F.lit(float("-inf") if least else float("inf")) if x is None else (x if isinstance(x, Column) else F.lit(float(x)))
    value, low, high = value.cast("double"), bound(low, True), bound(high, False)
    ok = F.coalesce((value >= low) & (value <= high), F.lit(False))
    return F.struct(F.lit(name).alias("check_name"), value.alias("realized"), low.alias("low"), high.alias("high"), F.when(ok, "PASS").otherwise("WARN" if soft else "FAIL").alias("status"))


def pattern_bands() -> list[Column]:
    """Checks of shares on settled and on all rows, with bounds widened by three standard errors."""
    out = []
    for rows in ("settled", "rows"):
        for name, (metric, low, high) in SHARE_BANDS.items():
            n = F.col(rows).cast("double")
            p = F.try_divide(F.col(metric).cast("double"), n)
            se = F.coalesce(F.sqrt(p * (1 - p) / n), F.lit(0.0))
            out.append(checked(f"{name} / {rows}", p, X.half_up(low - 3 * se, 4), X.half_up(high + 3 * se, 4)))
    return out


def validation_gate(metrics: DataFrame, full_rows: int = 10_000) -> DataFrame:
    """(check_name, realized, low, high, status): 23 checks of the one row of ``spec_metrics``. Patterns only warn on tables under ``full_rows`` rows."""
    plain = lambda checks, soft: [checked(k, F.col(m) * f, low, high, soft) for k, (m, f, low, high) in checks.items()]
    lists = [checked("countries", (F.col("countries") == "AR,CL,CO,MX").cast("int"), 1, 1), checked("currencies", (F.col("currencies") == "ARS,CLP,COP,MXN").cast("int"), 1, 1)]
    hard = [*plain(PLAIN_CHECKS, False), *lists, checked("settled share", F.try_divide("settled", "rows"), 0.5, 1), *pattern_bands()]
    patterns = F.when(F.col("rows") >= full_rows, F.array(*plain(PATTERN_CHECKS, False))).otherwise(F.array(*plain(PATTERN_CHECKS, True)))
    return metrics.select(F.explode(F.concat(F.array(*hard), patterns)).alias("c")).select("c.*")


def generic_checks(df: DataFrame, unique: Sequence[Sequence[str]] = (), not_null: dict[str, Column | None] | Sequence[str] = (), accepted: dict[str, Sequence] | None = None) -> DataFrame:
    """(check_name, n_bad) of a table: keys that must be unique (rows beyond the first of each key), columns that must not be null (where a condition holds, if one is given), accepted values (null is accepted)."""
    conditions = not_null if isinstance(not_null, dict) else dict.fromkeys(not_null)
    checks = {f"not null {c}": F.count_if(F.col(c).isNull() if where is None else F.coalesce(where, F.lit(False)) & F.col(c).isNull()) for c, where in conditions.items()}
    checks |= {f"accepted {c}": F.count_if(~F.col(c).isin(*v)) for c, v in (accepted or {}).items()}
    spark, parts = df.sparkSession, []
    if checks:
        one = df.agg(*(c.alias(f"c{i}") for i, c in enumerate(checks.values())))
        parts.append(one.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), F.col(f"c{i}").alias("n_bad")) for i, k in enumerate(checks)))).alias("x")).select("x.*"))
    for key in unique:
        n = df.where(reduce(Column.__and__, (F.col(c).isNotNull() for c in key))).groupBy(*key).agg((F.count("*") - 1).alias("more"))
        parts.append(n.agg(F.lit("unique " + ", ".join(key)).alias("check_name"), F.coalesce(F.sum("more"), F.lit(0)).alias("n_bad")))
    return reduce(DataFrame.unionByName, parts, spark.createDataFrame([], "check_name string, n_bad bigint"))


def contract_faults(df: DataFrame, contract: StructType, ordered: bool = True) -> list[str]:
    """What differs from an enforced contract: names, types and, if ``ordered``, the order of columns."""
    have, want = [(f.name, f.dataType) for f in df.schema], [(f.name, f.dataType) for f in contract]
    out = [f"missing {n}" for n, _ in want if n not in df.columns] + [f"unexpected {n}" for n, _ in have if n not in contract.names]
    kinds = dict(have)
    out += [f"{n} is {kinds[n].simpleString()}, not {t.simpleString()}" for n, t in want if n in kinds and kinds[n] != t]
    return out or ([] if not ordered or [n for n, _ in have] == contract.names else ["columns are in another order"])


def enforced(df: DataFrame, contract: StructType) -> DataFrame:
    """``df`` if it keeps the contract, else an error: a schema never changes in silence."""
    if faults := contract_faults(df, contract):
        raise ValueError("; ".join(faults))
    return df


def assertions(fct: DataFrame, refs: dict[str, DataFrame], staged: DataFrame | None = None, outliers: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """(check_name, n_bad) of nine statements about a built fact and its marts; n_bad counts what contradicts them.

    ``staged`` are the rows that the fact was built of (without them its rows are only held against themselves), ``outliers`` the built table, if it is stored.
    """
    from . import marts

    pct, usd, c, s = F.abs("residual_pct"), F.col("abs_residual_usd"), F.col("category"), F.col("status") == "settled"
    bounds = ((c == "meaningful") & ((usd >= 20) | (pct > 5) | (pct <= 2))) | ((c == "large") & (usd < 20) & (pct <= 5)) | ((c == "exact") & (F.col("diff_local") != 0))
    complete = F.col("settle_ts").isNotNull() & F.col("settled_amount").isNotNull()
    count = lambda cond: F.count_if(F.coalesce(cond, F.lit(False)))
    one = fct.agg(count(bounds).alias("a0"), count(s & (F.col("settle_ts") < F.col("auth_ts"))).alias("a1"), count(s != complete).alias("a2"), count((F.col("fx_auth") <= 0) | (F.col("fx_settle") <= 0)).alias("a3"), F.count("*").alias("n_fact"), count(s).alias("n"), F.sum(F.when(s, -F.col("residual_usd"))).alias("net"), F.sum(F.when(s & (c != "exact"), -F.col("residual_usd"))).alias("odd_net"))
    weekly = marts.psp_weekly(fct).agg(F.sum("n").alias("w_n"), F.sum("net_usd").alias("w_net"), count((F.col("n_flagged") > F.col("n")) | (F.col("n_large") > F.col("n_flagged"))).alias("w_bad"))
    causes = marts.cause_mart(fct).agg(F.sum("net_usd").alias("c_net"))
    kinds = marts.segment_rows(marts.settled(fct), marts.SEGMENTS, []).groupBy("segment_type").agg(F.count("*").alias("m")).agg(F.min("m").alias("s_min"), F.max("m").alias("s_max"))
    built = (fct if staged is None else staged).agg(F.count("*").alias("n_staged"))
    # what the category rule makes large, field by field
    large = fct.where(s & (F.abs("diff_local") > t.rounding_minor_units) & ((usd >= t.large_usd) | (pct > t.large_pct))).select(marts.OUTLIER_COLUMNS)
    off = compare_rows(marts.outliers(fct) if outliers is None else outliers, large, ["merchant_id", "transaction_id"]).agg(F.count("*").alias("o_bad"))
    ranges = range_overlaps(refs["fees"], "psp").select("valid_from").unionByName(range_overlaps(refs["vat"], "country").select("valid_from")).agg(F.count("*").alias("r"))
    whole = one
    for part in (weekly, causes, kinds, off, built, ranges):
        whole = whole.crossJoin(F.broadcast(part))  # one row each
    near = lambda a, b, cents: (F.abs(F.col(a) - F.col(b)) > cents).cast("bigint")
    checks = {
        "category boundaries": F.col("a0"), "causes reconcile and segments cover": near("odd_net", "c_net", 0.05) + (F.col("s_min") != F.col("n")).cast("bigint") + (F.col("s_max") != F.col("n")).cast("bigint"), "row count as staged": F.abs(F.col("n_fact") - F.col("n_staged")), "rates above zero": F.col("a3"),
        "outliers are the large rows": F.col("o_bad"), "weeks reconcile": F.col("w_bad") + near("net", "w_net", 0.05) + (F.col("w_n") != F.col("n")).cast("bigint"), "dated ranges valid": F.col("r"), "settle after auth": F.col("a1"), "settled rows complete": F.col("a2"),
    }
    return whole.select(F.explode(F.array(*(F.struct(F.lit(k).alias("check_name"), v.cast("bigint").alias("n_bad")) for k, v in checks.items()))).alias("x")).select("x.*")


def range_overlaps(dim: DataFrame, key: str) -> DataFrame:
    """Dated rows that begin before the one before them ends, or end before they begin."""
    w = Window.partitionBy(key).orderBy("valid_from")
    rows = dim.withColumn("_next", F.lead("valid_from").over(w))
    has_next = F.col("_next").isNotNull()
    return rows.where((has_next & (F.col("valid_to").isNull() | (F.col("valid_to") > F.col("_next")))) | (F.col("valid_to") <= F.col("valid_from"))).drop("_next")


def compare_rows(a: DataFrame, b: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, side, columns): rows of two tables with the same columns that differ. side: left or right where only that table has the key, both where fields differ,
    which ``columns`` names. Nulls are equal to nulls, in keys as well; keys are unique in either table (see ``generic_checks``)."""
    if set(a.columns) != set(b.columns):
        raise ValueError(f"columns differ: {sorted(set(a.columns) ^ set(b.columns))}")
    fields = [c for c in a.columns if c not in keys]
    same = reduce(Column.__and__, (F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys))
    both = a.withColumn("_left", F.lit(True)).alias("a").join(b.withColumn("_right", F.lit(True)).alias("b"), same, "full_outer")
    here, there = F.col("_left").isNotNull(), F.col("_right").isNotNull()
    off = F.array(*(F.when(here & there & ~F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")), F.lit(c)) for c in fields)) if fields else F.array().cast("array<string>")
    side = F.when(~there, "left").when(~here, "right").otherwise("both")
    key = [F.when(here, F.col(f"a.{k}")).otherwise(F.col(f"b.{k}")).alias(k) for k in keys]
    out = both.select(*key, side.alias("side"), F.filter(off, lambda x: x.isNotNull()).alias("columns"))
    return out.where((F.col("side") != "both") | (F.size("columns") > 0))


def table_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that only one side has, counting repeats."""
    return a.exceptAll(b).withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).withColumn("side", F.lit("right")))


def parse_typed(c: str, kind: str) -> tuple[Column, Column]:
    """The typed value of a text column, and whether the text is there but can't be read."""
    text = F.nullif(F.trim(F.col(c)), F.lit(""))
    typed = {
        "int": F.when(text.rlike(r"^-?\d+$"), text.try_cast("bigint")), "float": text.try_cast("double"), "bool": F.when(F.lower(text).isin("true", "false"), F.lower(text) == "true"),
        "timestamp": text.try_cast("timestamp"), "date": text.try_cast("date"), "str": text,
    }[kind]
    return typed, text.isNotNull() & typed.isNull()


def contract_check(rows: DataFrame, contract: dict[str, dict], file: str = "file", line: str = "line") -> DataFrame:
    """(file, column, problem, n, lines): faults of text rows by file; lines are the first five. A file with any fault is bad as a whole.

    contract: column -> {type, nullable, enum, min, max, same_as}. Missing columns and banned ones (whatever their case) are reported with n null.
    """
    found = {c.lower(): c for c in rows.columns}
    faults = []
    for name, rule in contract.items():
        if name not in rows.columns:
            continue
        typed, unreadable = parse_typed(name, rule.get("type", "str"))
        tests = {"type": unreadable}
        if not rule.get("nullable", False):
            tests["null"] = F.nullif(F.trim(F.col(name)), F.lit("")).isNull()
        if "enum" in rule:
            tests["enum"] = ~typed.isin(*rule["enum"])
        if "min" in rule:
            tests["min"] = typed < rule["min"]
        if "max" in rule:
            tests["max"] = typed > rule["max"]
        if rule.get("same_as") in rows.columns:  # such as the source that a file's folder names
            tests["same_as"] = F.nullif(F.trim(F.col(name)), F.lit("")) != F.col(rule["same_as"])
        faults += [F.when(F.coalesce(t, F.lit(False)), F.struct(F.lit(name).alias("column"), F.lit(k).alias("problem"))) for k, t in tests.items()]
    each = rows.select(file, line, F.explode(F.filter(F.array(*faults), lambda x: x.isNotNull())).alias("f")).select(file, line, "f.*")
    # only the least five lines of a group are carried, however many there are
    nth = F.row_number().over(Window.partitionBy(file, "column", "problem").orderBy(line))
    first = each.withColumn("_r", nth).where("_r <= 5").groupBy(file, "column", "problem").agg(F.array_sort(F.collect_list(line)).alias("lines"))
    out = each.groupBy(file, "column", "problem").agg(F.count("*").alias("n")).join(first, [file, "column", "problem"])
    whole = [(c, "banned") for c in BANNED_FIELDS if c in found] + [(c, "missing") for c in contract if c not in rows.columns]
    if whole:
        more = rows.select(file).distinct().select(file, F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.lit(p).alias("problem")) for c, p in whole))).alias("x")).select(file, "x.*", F.lit(None).cast("bigint").alias("n"))
        out = out.unionByName(more, allowMissingColumns=True)
    return out


def redact(df: DataFrame) -> DataFrame:
    return df.drop(*(c for c in df.columns if c.lower() in BANNED_FIELDS))


def densified(daily: DataFrame, by: str, day: str = "day", n: str = "n", upto: str | None = None) -> DataFrame:
    """Every day for every key, missing days count zero: of the whole table's range, or with ``upto`` from the key's own first day up to that one."""
    if upto is None:
        ends = daily.agg(F.min(day).alias("a"), F.max(day).alias("z"))
        spine = daily.select(by).distinct().crossJoin(F.broadcast(ends)).select(by, F.explode(F.sequence("a", "z")).alias(day))
    else:
        firsts = daily.where(F.col(day) <= F.lit(upto).cast("date")).groupBy(by).agg(F.min(day).alias("a"))
        spine = firsts.select(by, F.explode(F.sequence("a", F.lit(upto).cast("date"))).alias(day))
    return spine.join(daily, [by, day], "left").na.fill(0, [n])


def volume_flags(daily: DataFrame, by: str, day: str = "day", n: str = "n", window: int = 7, warm_up: int = 15, off: float = 0.5, upto: str | None = None) -> DataFrame:
    """Days whose volume is off the median of the seven days before; the first days aren't checked. For ``upto`` see ``densified``."""
    order = Window.partitionBy(by).orderBy(day)
    held = F.array_sort(F.collect_list(n).over(order.rowsBetween(-window, -1)))
    out = densified(daily, by, day, n, upto).withColumns({"_l": held, "_i": F.row_number().over(order)})
    usual = F.when(F.size("_l") == window, F.try_element_at("_l", F.lit(window // 2 + 1)))
    out = out.withColumn("usual", usual)
    flagged = (F.col("_i") > warm_up) & (F.col("usual") > 0) & (F.abs(F.try_divide(n, "usual") - 1) > off)
    return out.select(by, day, n, "usual", flagged.alias("flagged"))


def freshness(files: DataFrame, sources: Sequence[str], as_of: str, most_days: int) -> DataFrame:
    """Latest date of each source and whether it is recent enough; a source without files fails."""
    spine = files.sparkSession.createDataFrame([(s,) for s in sources], "psp string")
    last = files.groupBy("psp").agg(F.max("date").alias("latest"))
    age = F.datediff(F.lit(as_of).cast("date"), F.col("latest"))
    return spine.join(last, "psp", "left").select("psp", "latest", F.when(age <= most_days, "PASS").otherwise("FAIL").alias("status"))


def schema_drift(headers: DataFrame, contract: Sequence[str]) -> DataFrame:
    """(psp, new, missing, n_files) from the header columns of files."""
    wanted = F.array(*map(F.lit, contract))
    rows = headers.select("psp", F.array_except("columns", wanted).alias("new"), F.array_except(wanted, "columns").alias("missing")).where((F.size("new") > 0) | (F.size("missing") > 0))
    return rows.groupBy("psp").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_set("new")))).alias("new"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("missing")))).alias("missing"), F.count("*").alias("n_files"))


def volume_check(flags: DataFrame, by: str, day: str = "day", most: int = 5) -> DataFrame:
    """(key, status, days): WARN with the first flagged days, else PASS."""
    nth = F.row_number().over(Window.partitionBy(by, "flagged").orderBy(day))
    first = F.array_sort(F.collect_list(F.when(F.col("flagged") & (F.col("_n") <= most), F.col(day))))
    out = flags.withColumn("_n", nth).groupBy(by).agg(first.alias("days"))
    return out.select(by, F.when(F.size("days") > 0, "WARN").otherwise("PASS").alias("status"), "days")


def quarantine_check(manifest: DataFrame) -> DataFrame:
    """(status, n_files): WARN if any file's latest state is quarantined."""
    n = manifest.agg(F.count_if(F.col("status") == "quarantined").alias("n_files"))
    return n.select(F.when(F.col("n_files") > 0, "WARN").otherwise("PASS").alias("status"), "n_files")


def overall(statuses: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), F.col("status"))
    return statuses.agg(F.max_by("status", rank).alias("status"))


def banned_fields(df: DataFrame) -> list[str]:
    return [c for c in df.columns if c.lower() in BANNED_FIELDS]


def pii_scan(df: DataFrame, columns: Sequence[str], pattern: str = r"\bcus_[0-9a-f]{12}\b") -> DataFrame:
    """How many rows and values of text columns hold an identifier; the values themselves are never shown."""
    hits = lambda c: F.regexp_count(F.coalesce(F.col(c), F.lit("")), F.lit(pattern))
    parts = F.array(*(F.struct(F.lit(c).alias("column"), hits(c).alias("h")) for c in columns))
    return df.select(F.explode(parts).alias("x")).groupBy("x.column").agg(F.count_if(F.col("x.h") > 0).alias("n_rows"), F.sum("x.h").alias("n_values"))
