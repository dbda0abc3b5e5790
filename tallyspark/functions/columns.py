"""Column functions that batch and stream share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def half_up(x: C, places: int = 0) -> Column:
    """Rounds halves away from zero on doubles, without a negative zero."""
    x = col(x).cast("double")
    scale = float(10**places)
    return F.signum(x) * F.floor(F.abs(x) * scale + 0.5) / scale + 0.0


def to_major(minor: C, exponent: C) -> Column:
    return col(minor) / F.pow(F.lit(10.0), col(exponent))


def to_minor(major: C, exponent: C) -> Column:
    return half_up(col(major) * F.pow(F.lit(10.0), col(exponent))).cast("bigint")


def to_usd(minor: C, exponent: C, rate: C) -> Column:
    return to_major(minor, exponent) / col(rate)


def exponent_of(currency: C, exponents: dict[str, int]) -> Column:
    """Minor-unit exponent; an unknown currency is an error."""
    known = F.create_map(*[F.lit(x) for kv in exponents.items() for x in kv])
    found = known[col(currency)]
    return F.when(found.isNotNull(), found).otherwise(F.raise_error(F.concat(F.lit("unknown currency "), F.coalesce(col(currency), F.lit("null")))).cast("int"))


def expected_settled(authorized: C, fx_auth: C, fx_settle: C, cross_border: C) -> Column:
    """What should arrive, in minor units: the authorised amount, moved with the rate if it crossed a border."""
    moved = F.floor(col(authorized) * col(fx_settle) / col(fx_auth) + 0.5).cast("bigint")
    return F.when(col(cross_border), moved).otherwise(col(authorized))


def category(status: C, diff_local: C, residual_pct: C, residual_usd: C, t: Thresholds = DEFAULTS) -> Column:
    pct, usd = F.abs(col(residual_pct)), F.abs(col(residual_usd))
    small = usd < t.large_usd
    return (
        F.when(col(status) != "settled", F.lit(None).cast("string"))
        .when(col(diff_local) == 0, "exact")
        .when(F.abs(col(diff_local)) <= t.rounding_minor_units, "rounding")
        .when((pct <= t.fx_tolerance_pct) & small, "fx_tolerance")
        .when((pct <= t.large_pct) & small, "meaningful")
        .otherwise("large")
    )


def why_flagged(category: C, residual_pct: C, residual_usd: C, t: Thresholds = DEFAULTS) -> Column:
    """The cut-off that a flagged row passed, in words."""
    low, high, usd = f"{t.fx_tolerance_pct:g}", f"{t.large_pct:g}", f"{t.large_usd:g}"
    by_pct, by_usd = F.abs(col(residual_pct)) > t.large_pct, F.abs(col(residual_usd)) >= t.large_usd
    large = F.when(by_pct & by_usd, f"> {high}% and ≥ ${usd}").when(by_usd, f"≥ ${usd}").otherwise(f"> {high}%")
    return F.when(col(category) == "meaningful", f"{low}–{high}%").when(col(category) == "large", large)


def direction(residual: C) -> Column:
    return F.when(col(residual) < 0, "under").when(col(residual) > 0, "over").when(col(residual) == 0, "none")


def on_rounding_step(settled: C, expected: C, exponent: C, t: Thresholds = DEFAULTS) -> Column:
    """Settled too little, on a whole step, and by less than one step."""
    step = (t.rounding_step_major * F.pow(F.lit(10.0), col(exponent))).cast("bigint")
    short = col(expected) - col(settled)
    return F.coalesce((short > 0) & (col(settled) % step == 0) & (short < step), F.lit(False))


def likely_cause(t: Thresholds = DEFAULTS) -> Column:
    """The first rule that fits a row of the fact."""
    c, r, pct = t, F.col("residual"), F.col("residual_pct")
    under, short = r < 0, -pct
    one_item_less = F.col("expected_settled") * (F.col("item_count") - 1) / F.col("item_count")
    rules = [
        (F.col("category") == "rounding", "psp_rounding"),
        (F.col("is_cross_border") & (F.abs(r) <= 1), "fx_timing"),
        (F.col("rounding_flag"), "psp_rounding"),
        (under & (F.col("item_count") >= 2) & (F.abs(F.col("settled_amount") - one_item_less) <= F.col("expected_settled") * c.partial_tolerance_pct / 100), "partial_capture"),
        (under & (F.abs("residual_usd") >= c.fee_min_usd) & (F.col("fee_repeats") >= c.fee_min_repeats), "psp_fee"),
        (F.col("tax_recalc") & ~F.col("is_cross_border") & (F.abs(pct) < 2), "tax_recalc"),
        (under & (F.col("risk_score") >= c.high_risk_score) & short.between(10, 20), "fraud_hold"),
        (under & short.between(2, 5), "psp_adjustment"),
        (r > 0, "tip"),
    ]
    out = F.when(F.col("category").isNull() | (F.col("category") == "exact"), F.lit(None).cast("string"))
    for condition, name in rules:
        out = out.when(condition, name)
    return out.otherwise("unexplained")


def iso_week(ts: C) -> Column:
    """Label YYYY-Www."""
    return F.concat(F.extract(F.lit("YEAROFWEEK"), col(ts)).cast("string"), F.lit("-W"), F.lpad(F.extract(F.lit("WEEK"), col(ts)).cast("string"), 2, "0"))


def week_start(ts: C) -> Column:
    return F.date_trunc("week", col(ts)).cast("date")


def monday_of(week: C) -> Column:
    """The Monday of a label YYYY-Www: week 1 is the one with the 4th of January."""
    year, number = F.substring(col(week), 1, 4).cast("int"), F.substring(col(week), 7, 2).cast("int")
    return F.date_add(week_start(F.make_date(year, F.lit(1), F.lit(4))), (number - 1) * 7)


def prev_week(week: C) -> Column:
    """The label of the week before, also across a year's end."""
    return iso_week(F.date_sub(monday_of(week), 7))


def trailing_weeks(week: C, k: int) -> Column:
    """The labels of the ``k`` weeks that end with ``week``, the oldest first."""
    return F.array(*(iso_week(F.date_sub(monday_of(week), 7 * back)) for back in range(k - 1, -1, -1)))


def leak_share_pct(under_usd: C, settled_usd: C) -> Column:
    """What arrived too little, as a percentage of what was settled; 0 where nothing was."""
    return F.when(col(settled_usd) != 0, 100.0 * col(under_usd) / col(settled_usd)).otherwise(0.0)


def calendar(ts: str) -> dict[str, Column]:
    """Calendar columns of a timestamp; a week belongs to the month of its Thursday."""
    monday = week_start(ts)
    return {
        "auth_date": F.col(ts).cast("date"),
        "auth_weekday": F.date_format(ts, "EEE"),
        "is_weekend": F.weekday(ts) >= 5,
        "auth_week": iso_week(ts),
        "week_start": monday,
        "week_end": F.date_add(monday, 6),
        "auth_month": F.date_format(ts, "yyyy-MM"),
        "week_month": F.date_format(F.date_add(monday, 3), "yyyy-MM"),
    }


def amount_tier(usd: C) -> Column:
    return F.when(col(usd) < 50, "10-50").when(col(usd) < 200, "50-200").otherwise("200+")


def lag_bucket(days: C) -> Column:
    whole = F.floor(col(days))
    return F.when(col(days).isNull(), F.lit(None).cast("string")).when(whole <= 1, "≤1").when(whole <= 3, "2-3").when(whole <= 5, "4-5").when(whole <= 7, "6-7").otherwise("8+")


def mask_id(c: C) -> Column:
    """Keeps the prefix up to the last underscore and the last four characters."""
    c = col(c)
    token = F.substring_index(c, "_", -1)
    prefix = F.substring(c, F.lit(1), F.length(c) - F.length(token))
    return F.when(c.isNotNull(), F.concat(prefix, F.lit("••••"), F.when(F.length(token) > 4, F.right(token, F.lit(4))).otherwise(token)))


def last_closed_end(as_of: C) -> Column:
    """The latest Sunday that lies at least a week back."""
    day = F.date_sub(col(as_of).cast("date"), 7)
    return F.date_sub(day, (F.weekday(day) + 1) % 7)


def provisional_from(as_of: C, days: int) -> Column:
    return F.date_sub(col(as_of).cast("date"), days)


def last_full_month(as_of: C, first_day: C) -> Column:
    """The latest month that lies wholly between first_day and as_of, else null."""
    day = col(as_of).cast("date")
    month = F.when(day == F.last_day(day), F.trunc(day, "month")).otherwise(F.add_months(F.trunc(day, "month"), -1))
    return F.when(month >= col(first_day).cast("date"), F.date_format(month, "yyyy-MM"))


def as_of(auth: str = "auth_ts", settle: str = "settle_ts") -> Column:
    """Data time of a row: the later of its two timestamps."""
    return F.greatest(F.col(auth), F.coalesce(F.col(settle), F.col(auth)))


Z95 = 1.959963984540054


def wilson(k: C, n: C) -> tuple[Column, Column]:
    """Bounds of the 95 % interval of a share; 0 and 0 without rows."""
    n_, p = col(n).cast("double"), F.try_divide(col(k).cast("double"), col(n).cast("double"))
    z2 = Z95 * Z95
    centre = (p + z2 / (2 * n_)) / (1 + z2 / n_)
    half = Z95 * F.sqrt(p * (1 - p) / n_ + z2 / (4 * n_ * n_)) / (1 + z2 / n_)
    bound = lambda x: F.when(n_ > 0, F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return bound(centre - half), bound(centre + half)


def lift(rate: C, peer: C) -> Column:
    return F.when(col(peer) != 0, col(rate) / col(peer))


def excess_loss(rate: C, peer: C, n: C, mean: C) -> Column:
    """Loss beyond what the peers' rate would have cost; 0 where something is missing."""
    return F.coalesce(F.greatest(col(rate) - col(peer), F.lit(0.0)) * col(n) * F.greatest(col(mean), F.lit(0.0)) + 0.0 * col(peer), F.lit(0.0))


def control_limit(p_bar: C, n: C, sigma: float = 3.0) -> Column:
    return col(p_bar) + sigma * F.sqrt(F.try_divide(col(p_bar) * (1 - col(p_bar)), col(n)))
