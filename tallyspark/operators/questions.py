"""The test tables behind findings: one per question, stacked, with one adjustment over all p-values of a merchant."""

from __future__ import annotations

from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..config import DEFAULTS, Thresholds
from ..functions import columns as X
from ..plans.store import stored
from . import marts, stats
from .quantiles import with_quantiles

#: What every row of a test table has, beside merchant_id; what a test doesn't know is null.
COLUMNS = {
    "question": "string", "key": "string", "kind": "string", "segment_type": "string", "segment_value": "string", "psp": "string", "country": "string", "likely_cause": "string", "metric": "string",
    "n": "bigint", "n_flagged": "bigint", "rate": "double", "ci_low": "double", "ci_high": "double", "peer_n": "bigint", "peer_flagged": "bigint", "peer_rate": "double", "lift": "double", "p": "double",
    "excess_usd": "double", "mean_loss_usd": "double", "median_loss_usd": "double", "usd_note": "string",
}


def shaped(df: DataFrame, question: str, **known: Column | str) -> DataFrame:
    """``df`` with all columns of a test table; ``known`` gives some of them as columns or as text."""
    known = {k: F.lit(v) if isinstance(v, str) else v for k, v in known.items()} | {"question": F.lit(question)}
    value = lambda c: known[c] if c in known else F.col(c) if c in df.columns else F.lit(None)
    return df.select("merchant_id", *(value(c).cast(t).alias(c) for c, t in COLUMNS.items()))


def tested(df: DataFrame) -> DataFrame:
    """Adds rates, interval, lift, p and excess loss to rows with n, n_flagged, peer_n, peer_flagged and mean_loss_usd."""
    out = df.withColumns({"rate": F.try_divide("n_flagged", "n"), "peer_rate": F.try_divide("peer_flagged", "peer_n")})
    low, high = X.wilson("n_flagged", "n")
    return out.withColumns({"ci_low": low, "ci_high": high, "lift": X.lift("rate", "peer_rate"), "p": stats.rate_test("n_flagged", "n", "peer_flagged", "peer_n"), "excess_usd": X.half_up(X.excess_loss("rate", "peer_rate", "n", "mean_loss_usd"), 2)})


def group_counts(fct: DataFrame, inside: Column, flag: Column, by: list[str]) -> DataFrame:
    """Counts of flagged rows inside and outside a segment, and the loss of the flagged rows inside, in one aggregation."""
    flag, inside = F.coalesce(flag, F.lit(False)), F.coalesce(inside, F.lit(False))
    loss = F.when(inside & flag, -F.col("residual_usd"))
    counts = fct.groupBy(*by).agg(
        F.count_if(inside).alias("n"), F.count_if(inside & flag).alias("n_flagged"), F.count_if(~inside).alias("peer_n"), F.count_if(~inside & flag).alias("peer_flagged"), F.coalesce(F.avg(loss), F.lit(0.0)).alias("mean_loss_usd"),
    )
    return with_quantiles(counts, fct.select(*by, loss.alias("loss")), "loss", by, {"median_loss_usd": 0.5}).na.fill(0.0, ["median_loss_usd"])


def two_group(fct: DataFrame, inside: Column, flag: Column | None = None, by: list[str] | None = None) -> DataFrame:
    """A segment against all other rows of its group; groups where either side is empty give no row."""
    return tested(group_counts(fct, inside, F.col("is_meaningful") if flag is None else flag, by or ["merchant_id"]).where("n > 0 and peer_n > 0"))


def peers(mart: DataFrame, kind: str) -> DataFrame:
    """Each segment of a kind against the others: psp x country within its country."""
    rows = mart.where(F.col("segment_type") == kind)
    group = F.split_part("segment_value", F.lit("|"), F.lit(2)) if kind == "psp_country" else None
    return stats.compare_to_peers(rows, ["merchant_id", "segment_type"], group)


#: Segments of the mart that the tests compare.
TESTED = ("country", "currency", "psp_country", "amount_tier", "is_weekend", "lag_bucket", "cross_border")


def count_cube(fct: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(merchant_id, kind, a, b, cause, inside, n, n_flagged, loss, median_loss): every count behind the tests but those of the mart and the correlation, from one scan.

    Each settled row goes to one cell of each kind: two groups (inside or not) of orders by items, by risk, by lag, of flags by lag, of fees by month, the causes of
    PSPs, of flagged rows by psp and country, weekend and border, and the lags themselves by country.
    """
    hit, big = F.coalesce("is_meaningful", F.lit(False)), F.coalesce("is_over_300", F.lit(False))
    yes, no = F.lit(True), F.lit(None).cast("string")
    sure = lambda c: F.coalesce(c, F.lit(False))

    def cell(kind: str, a: Column = no, b: Column = no, cause: Column = no, inside: Column = yes, flag: Column = yes) -> Column:
        return F.struct(F.lit(kind).alias("kind"), a.cast("string").alias("a"), b.cast("string").alias("b"), cause.alias("cause"), inside.alias("inside"), flag.alias("flag"))

    cause, lag = F.col("likely_cause"), F.col("settle_lag_days")
    cells = [
        cell("partial_capture", inside=sure(F.col("item_count") >= 2), flag=hit), cell("fraud_hold", inside=sure(F.col("risk_score") >= t.high_risk_score), flag=hit),
        cell("lag_late", F.col("country"), inside=big, flag=sure(lag > t.lag_outlier_days)), cell("lag_money", F.col("country"), inside=big, flag=hit),
        cell("fee_drift", F.col("psp"), F.col("auth_month"), flag=sure(cause == "psp_fee")), cell("cause_psp", F.col("psp"), cause=cause),
        F.when(hit, cell("causes", F.col("psp"), F.col("country"), cause)), F.when(hit, cell("weekend_causes", F.col("is_weekend"), cause=cause)), F.when(hit, cell("border_causes", F.col("is_cross_border"), cause=cause)),
        F.when(lag.isNotNull(), cell("lag_value", F.col("country"), lag, inside=big)),
    ]
    rows = marts.settled(fct).select("merchant_id", F.col("residual_usd").alias("usd"), F.explode(F.filter(F.array(*cells), lambda x: x.isNotNull())).alias("c"))
    loss = F.when(F.col("c.flag") & ~F.col("c.kind").isin("causes", "weekend_causes", "border_causes", "lag_value"), -F.col("usd"))
    keys = ["merchant_id", "kind", "a", "b", "cause", "inside"]
    rows = rows.select("merchant_id", *(f"c.{k}" for k in keys[1:]), "c.flag", loss.alias("loss"))
    # distinct losses with their counts, stored: cells and medians are both taken from them, so that the fact is read once
    counted = stored(rows.groupBy(*keys, "loss").agg(F.count("*").alias("n"), F.count_if("flag").alias("n_flagged")))
    has = F.col("loss").isNotNull()
    cells = counted.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("n_flagged"), F.sum(F.col("loss") * F.col("n")).alias("loss"), F.sum(F.when(has, F.col("n")).otherwise(0)).alias("n_loss"))
    return with_quantiles(cells, counted, "loss", keys, {"median_loss": 0.5}, "n")


def two_sides(cells: DataFrame, by: list[str]) -> DataFrame:
    """Cells inside against those outside, by merchant and ``by``, tested; groups where either side is empty give no row."""
    inside = F.col("inside")
    side = lambda c, cond: F.coalesce(F.sum(F.when(cond, F.col(c))), F.lit(0))
    counts = cells.groupBy("merchant_id", *by).agg(
        side("n", inside).alias("n"), side("n_flagged", inside).alias("n_flagged"), side("n", ~inside).alias("peer_n"), side("n_flagged", ~inside).alias("peer_flagged"),
        F.coalesce(F.try_divide(F.sum(F.when(inside, F.col("loss"))), F.sum(F.when(inside, F.col("n_loss")))), F.lit(0.0)).alias("mean_loss_usd"), F.coalesce(F.max(F.when(inside, F.col("median_loss"))), F.lit(0.0)).alias("median_loss_usd"),
    )
    return tested(counts.where("n > 0 and peer_n > 0"))


def of_kind(cube: DataFrame, kind: str) -> DataFrame:
    return cube.where(F.col("kind") == kind).drop("kind")


def commonest(cells: DataFrame, by: list[str]) -> DataFrame:
    """The commonest cause by merchant and ``by``; ties go to the first name."""
    first = Window.partitionBy("merchant_id", *by).orderBy(F.desc("n"), "cause")
    return cells.withColumn("_r", F.row_number().over(first)).where("_r = 1").select("merchant_id", *by, F.col("cause").alias("top_cause"))


def segments_tested(mart: DataFrame, cube: DataFrame) -> DataFrame:
    """Q1 countries and currencies, Q2 a PSP against the others of the country, Q3 amount tiers, Q4 weekends and lag buckets, Q6 orders across a border: all segments of the mart in one plan."""
    kind = F.col("segment_type")
    group = F.when(kind == "psp_country", F.split_part("segment_value", F.lit("|"), F.lit(2)))
    rows = stats.compare_to_peers(mart.where(kind.isin(*TESTED)), ["merchant_id", "segment_type"], group)
    both, cell = kind == "psp_country", lambda i: F.when(kind == "psp_country", F.split_part("segment_value", F.lit("|"), F.lit(i)))
    rows = rows.withColumns({"psp": cell(1), "country": cell(2)})
    tops = commonest(of_kind(cube, "causes"), ["a", "b"]).select("merchant_id", F.concat_ws("|", "a", "b").alias("segment_value"), F.lit("psp_country").alias("segment_type"), "top_cause")
    for name, causes in (("is_weekend", "weekend_causes"), ("cross_border", "border_causes")):
        top = commonest(of_kind(cube, causes).where("a = 'true'"), [])
        tops = tops.unionByName(top.select("merchant_id", F.lit("true").alias("segment_value"), F.lit(name).alias("segment_type"), "top_cause"))
    rows = rows.join(tops, ["merchant_id", "segment_type", "segment_value"], "left")
    hit = F.col("segment_value") == "true"
    key = F.when(both, F.lower(F.concat_ws("_", "psp", "country", F.lit("peer")))).when(hit & (kind == "is_weekend"), "weekend").when(hit & (kind == "cross_border"), "cross_border")
    what = F.when(both, "peer").when(key.isNotNull(), key)
    number = F.when(kind.isin("country", "currency"), "Q1").when(both, "Q2").when(kind == "amount_tier", "Q3").when(kind.isin("is_weekend", "lag_bucket"), "Q4").otherwise("Q6")
    return shaped(rows, "Q", key=key, kind=what, likely_cause=F.col("top_cause"), metric="flag rate").withColumn("question", number)


def size(fct: DataFrame) -> DataFrame:
    """Q3: the rank correlation of the residual's size with the amount on rows that aren't exact. Its counted rows are stored: ranks look at them several times."""
    odd = marts.settled(fct).where("category <> 'exact'").withColumn("size", F.abs("residual_pct"))
    rho = stats.spearman(odd, "amount_usd", "size", ["merchant_id"], once=True)
    return shaped(rho, "Q3", segment_type="size_vs_magnitude", segment_value="spearman", n=F.col("n_rows"), metric="spearman rho", rate=F.col("rho"), p=correlation_p("rho", "n_rows"))


def lags(cube: DataFrame) -> DataFrame:
    """Q4, by country: are orders over 300 USD late more often? p is that of the rank test of lags, money that of the flag rate."""
    late = two_sides(of_kind(cube, "lag_late"), ["a"]).drop("p", "excess_usd", "mean_loss_usd", "median_loss_usd")
    money = two_sides(of_kind(cube, "lag_money"), ["a"]).select("merchant_id", "a", "excess_usd", "mean_loss_usd", "median_loss_usd")
    counts = of_kind(cube, "lag_value").groupBy("merchant_id", "a", F.col("b").cast("double").alias("lag")).agg(F.sum(F.when(F.col("inside"), F.col("n")).otherwise(0)).alias("k"), F.sum("n").alias("m"))
    ranks = stats.mann_whitney_counts(counts, "lag", ["merchant_id", "a"]).select("merchant_id", "a", "p")
    out = late.join(money, ["merchant_id", "a"]).join(ranks, ["merchant_id", "a"]).withColumnRenamed("a", "country")
    return shaped(out, "Q4", segment_type="lag_over_300", segment_value=F.concat("country", F.lit("|over_300")), key=F.concat(F.lower("country"), F.lit("_over_300_lag")), kind="lag", metric="late share", usd_note="delay, not loss")


def cause_psp(cube: DataFrame) -> DataFrame:
    """Q5: the share of rows with a cause, one PSP against all others; catch-all causes are left out."""
    cells = of_kind(cube, "cause_psp").select("merchant_id", F.col("a").alias("psp"), F.col("cause").alias("likely_cause"), F.col("n").alias("k"), "loss", F.col("median_loss").alias("median_loss_usd"))
    volume = cells.groupBy("merchant_id", "psp").agg(F.sum("k").alias("n"))
    causes = cells.where(F.col("likely_cause").isNotNull() & ~F.col("likely_cause").isin("tip", "unexplained")).select("merchant_id", "likely_cause").distinct()
    rows = volume.join(causes, "merchant_id").join(cells, ["merchant_id", "psp", "likely_cause"], "left").na.fill(0, ["k", "loss", "median_loss_usd"])
    w = Window.partitionBy("merchant_id", "likely_cause")
    rows = rows.select("merchant_id", "psp", "likely_cause", "n", F.col("k").alias("n_flagged"), (F.sum("n").over(w) - F.col("n")).alias("peer_n"), (F.sum("k").over(w) - F.col("k")).alias("peer_flagged"), F.coalesce(F.try_divide("loss", "k"), F.lit(0.0)).alias("mean_loss_usd"), "median_loss_usd")
    name = F.lower(F.concat("psp", F.lit("_"), F.regexp_replace("likely_cause", "^psp_", "")))
    return shaped(tested(rows), "Q5", segment_type="cause_psp", segment_value=F.concat_ws("|", "psp", "likely_cause"), key=name, kind="cause_psp", metric=F.concat("likely_cause", F.lit(" share")))


def drift_of_fees(cube: DataFrame) -> DataFrame:
    """Share of psp_fee in the merchant's last month against the months before, by PSP."""
    cells = of_kind(cube, "fee_drift").withColumn("last_month", F.max("b").over(Window.partitionBy("merchant_id")))  # a row for each psp and month
    out = two_sides(cells.withColumn("inside", F.col("b") == F.col("last_month")), ["a", "last_month"]).withColumnRenamed("a", "psp")
    return shaped(out, "Q6", segment_type="fee_drift", segment_value=F.concat_ws("|", "psp", "last_month"), key=F.concat(F.lower("psp"), F.lit("_fee_drift")), kind="fee_drift", likely_cause="psp_fee", metric="psp_fee share, last month vs earlier")


def fee_drift(fct: DataFrame) -> DataFrame:
    return drift_of_fees(count_cube(fct))


def several_items_and_risk(cube: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Q6: orders of several items, and of high risk, against the others."""
    out = two_sides(cube.where(F.col("kind").isin("partial_capture", "fraud_hold")), ["kind"])
    items = F.col("kind") == "partial_capture"
    value = F.when(items, "item_count >= 2").otherwise(f"risk_score >= {t.high_risk_score:g}")
    return shaped(out, "Q6", segment_type=F.when(items, "item_count").otherwise("risk_score"), segment_value=value, key=F.col("kind"), likely_cause=F.col("kind"), metric="flag rate")


def all_tests(fct: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """All test tables with q from one adjustment over every p-value of a merchant.

    The fact is scanned three times: for the mart, for the cube of counts, and for the counted values of the correlation, which are stored (see ``store.stored``).
    Mart and cube are some hundred rows a merchant, and some thousand lags.
    """
    mart = stored(marts.segment_mart(fct, {k: v for k, v in marts.SEGMENTS.items() if k in TESTED}))
    cube = stored(count_cube(fct, t))
    parts = [segments_tested(mart, cube), size(fct), lags(cube), cause_psp(cube), several_items_and_risk(cube, t), drift_of_fees(cube)]
    return stats.benjamini_hochberg(reduce(DataFrame.unionByName, parts), "p", ["merchant_id"], ["question", "segment_type", "segment_value"])


@F.pandas_udf(DoubleType())
def _student_p(rho: pd.Series, n: pd.Series) -> pd.Series:
    return pd.Series([student_p(r, m) for r, m in zip(rho, n, strict=True)], dtype=float)


def student_p(rho: float, n: float) -> float:
    """Two-sided p of a rank correlation by Student's t with n - 2 degrees of freedom; 1 under three rows."""
    if pd.isna(rho) or n < 3:
        return 1.0
    if abs(rho) >= 1:
        return 0.0
    return incomplete_beta((n - 2) / 2, 0.5, 1 - rho * rho)


def incomplete_beta(a: float, b: float, x: float) -> float:
    """The regularised incomplete beta function by its continued fraction (modified Lentz)."""
    from math import exp, lgamma, log

    if x <= 0 or x >= 1:
        return 0.0 if x <= 0 else 1.0
    if x > (a + 1) / (a + b + 2):
        return 1 - incomplete_beta(b, a, 1 - x)
    front = exp(lgamma(a + b) - lgamma(a) - lgamma(b) + a * log(x) + b * log(1 - x)) / a
    tiny, c = 1e-300, 1.0
    d = 1 / (1 - (a + b) * x / (a + 1) or tiny)
    value = d
    for m in range(1, 1000):
        for up in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d, c = 1 / (1 + up * d or tiny), 1 + up / c or tiny
            value *= c * d
        if abs(c * d - 1) < 1e-14:
            break
    return front * value


def correlation_p(rho: str, n: str) -> Column:
    return _student_p(F.col(rho), F.col(n).cast("double"))


def small_cells(fct: DataFrame, least: int = 200) -> DataFrame:
    """psp x country cells with too few rows for a term of their own."""
    return marts.settled(fct).groupBy("merchant_id", "psp", "country").agg(F.count("*").alias("n")).where(F.col("n") < least)


def rate_frame(df: DataFrame, by: list[str], flag: str = "is_meaningful", loss: str = "residual_usd") -> DataFrame:
    """Rows, flagged rows, and mean and median loss over the flagged ones (0 if there are none), for any keys."""
    hit = F.coalesce(F.col(flag), F.lit(False))
    lost = F.when(hit, -F.col(loss))
    counts = df.groupBy(*by).agg(F.count("*").alias("n"), F.count_if(hit).alias("n_flagged"), F.coalesce(F.avg(lost), F.lit(0.0)).alias("mean_loss_usd"))
    return with_quantiles(counts, df.select(*by, lost.alias("lost")), "lost", by, {"median_loss_usd": 0.5}).na.fill(0.0, ["median_loss_usd"])


def truth_scores(predicted: DataFrame, truth: DataFrame) -> DataFrame:
    """Precision and recall of likely_cause against true_cause by cause, joined on transaction_id; null where nothing is predicted or true. Catch-all causes aren't scored."""
    both = predicted.select("transaction_id", "likely_cause").join(truth.select("transaction_id", "true_cause"), "transaction_id", "left")
    said = F.array(F.struct(F.col("likely_cause").alias("cause"), F.lit(1).alias("p"), F.lit(0).alias("t")), F.struct(F.col("true_cause").alias("cause"), F.lit(0).alias("p"), F.lit(1).alias("t")))
    hit = F.when(F.col("likely_cause") == F.col("true_cause"), 1).otherwise(0)
    rows = both.select(F.explode(said).alias("s"), hit.alias("hit")).select("s.*", "hit").where(F.col("cause").isNotNull() & ~F.col("cause").isin("tip", "unexplained"))
    out = rows.groupBy("cause").agg(F.sum("p").alias("n_pred"), F.sum("t").alias("n_true"), F.sum(F.col("p") * F.col("hit")).alias("tp"))
    return out.withColumns({"precision": F.try_divide("tp", "n_pred"), "recall": F.try_divide("tp", "n_true")})


def truth_min(scores: DataFrame) -> DataFrame:
    """One row: the lowest precision or recall, null for an empty table."""
    return scores.agg(F.least(F.min("precision"), F.min("recall")).alias("truth_min"))


def summarize(fct: DataFrame) -> DataFrame:
    """Headline numbers of each merchant's settled rows, with its best-ranked week of enough rows."""
    rows = marts.settled(fct)
    usd, odd = F.col("residual_usd"), F.coalesce(F.col("category") != "exact", F.lit(False))
    one = rows.groupBy("merchant_id").agg(
        F.count("*").alias("n_rows"), F.count_if("is_meaningful").alias("n_flagged"), F.count_if(odd).alias("n_odd"), X.half_up(F.sum(F.greatest(-usd, F.lit(0.0))), 2).alias("gross_under_usd"), X.half_up(F.sum(F.greatest(usd, F.lit(0.0))), 2).alias("gross_over_usd"),
        X.half_up(F.sum(-usd), 2).alias("net_usd"), F.min("auth_month").alias("first_month"), F.max("auth_month").alias("last_month"), F.countDistinct("auth_month").alias("months"), F.count_if(F.col("likely_cause") == "tip").alias("tip_rows"), F.count_if(F.col("likely_cause") == "unexplained").alias("unexplained_rows"),
    )
    weeks = marts.psp_weekly(fct).groupBy("merchant_id", "psp", "auth_week").agg(F.sum("n").alias("n"), X.half_up(F.sum("net_usd"), 2).alias("net")).where(F.col("n") >= DEFAULTS.min_sample_week)
    worst = weeks.groupBy("merchant_id").agg(F.min_by(F.struct("psp", "auth_week", "net"), F.struct(-F.col("net"), "psp", "auth_week")).alias("w"))
    out = one.join(worst, "merchant_id", "left")
    share = lambda c: F.coalesce(F.try_divide(c, "n_rows"), F.lit(0.0))
    return out.select(*(c for c in one.columns if c != "n_odd"), share("n_flagged").alias("flag_rate"), share("n_odd").alias("non_exact_rate"), F.col("w.psp").alias("worst_psp"), F.col("w.auth_week").alias("worst_week"), F.col("w.net").alias("worst_net_usd"))


def headlines(fct: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """(merchant_id, headline, label, value): highest closed week, week of the largest loss, highest reliable segment and cell, cause of the largest loss."""
    weekly = marts.weekly_trend(fct, t).where("series = 'ALL'")
    rates = marts.segment_rates(marts.segment_mart(fct), t).where("not low_sample")
    causes = marts.cause_summary(fct)
    best = lambda df, name, label, value: df.groupBy("merchant_id").agg(F.max_by(F.struct(F.col(label).alias("label"), F.col(value).alias("value")), F.struct(value, label)).alias("b")).select("merchant_id", F.lit(name).alias("headline"), "b.label", F.col("b.value").cast("double").alias("value"))
    parts = [
        best(weekly.where("is_closed"), "highest week", "auth_week", "rate"), best(weekly, "largest loss", "auth_week", "net_usd"), best(rates.where("segment_type <> 'psp_country'"), "highest segment", "segment_key", "rate"),
        best(rates.where("segment_type = 'psp_country'"), "highest cell", "segment_value", "rate"), best(causes, "top cause", "likely_cause", "gross_under_usd"),
    ]
    return reduce(DataFrame.unionByName, parts)
