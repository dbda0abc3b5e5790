"""Alert rules for all weeks and merchants at once, their status over time, and what to send."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import DEFAULTS, Thresholds
from ..functions import columns as X
from ..plans.store import stored
from . import marts, stats

FIELDS = ["merchant_id", "rule", "severity", "week_idx", "segment", "psp", "country", "n", "value", "threshold"]


def week_index(day: str = "week_start") -> Column:
    """Whole weeks since Monday 1970-01-05."""
    return (F.datediff(F.col(day), F.lit("1970-01-05").cast("date")) / 7).cast("int")


def alert_frame(fct: DataFrame, late_days: float = 7.0, pending_days: int = 7) -> DataFrame:
    """psp x country x tier x week: what the rules look at."""
    s, p = F.col("status") == "settled", F.col("status") == "pending"
    rows = fct.crossJoin(F.broadcast(marts.as_of_of(fct)))
    age = (F.col("as_of").cast("long") - F.col("auth_ts").cast("long")) / 86400.0
    large = F.coalesce(F.col("category") == "large", F.lit(False))
    usd = F.col("residual_usd")
    money = lambda c: X.half_up(F.coalesce(F.sum(c), F.lit(0.0)), 2)
    return rows.groupBy("merchant_id", "psp", "country", "amount_tier", "auth_week", "week_start").agg(
        F.count_if(s).alias("n"), F.count_if(s & F.col("is_meaningful")).alias("n_flagged"), F.count_if(large).alias("n_large"), money(F.when(large, F.col("abs_residual_usd"))).alias("large_usd"),
        money(F.when(s, F.greatest(-usd, F.lit(0.0)))).alias("gross_under_usd"), money(F.when(s, F.greatest(usd, F.lit(0.0)))).alias("gross_over_usd"), money(F.when(s, F.col("settled_usd"))).alias("settled_usd"),
        F.count_if(p).alias("n_open"), F.count_if(p & (age > pending_days)).alias("n_open_old"),
        F.count_if((s & F.coalesce(F.col("settle_lag_days") > late_days, F.lit(False))) | (p & (age > late_days))).alias("n_late"),
    )


def trailing(by: list[str], first: int, last: int):
    """Calendar weeks from ``first`` to ``last`` before the row's own; empty weeks count as empty."""
    return Window.partitionBy(*by).orderBy("week_idx").rangeBetween(-first, -last)


def cells_by_week(frame: DataFrame, keys: list[str]) -> DataFrame:
    """Sums by key and week, for every week of the merchant's range."""
    sums = ["n", "n_flagged", "n_large", "large_usd", "gross_under_usd", "gross_over_usd", "settled_usd", "n_open", "n_open_old", "n_late"]
    weekly = frame.withColumn("week_idx", week_index()).groupBy("merchant_id", *keys, "week_idx").agg(*(F.sum(c).alias(c) for c in sums))
    weeks = weekly.groupBy("merchant_id").agg(F.min("week_idx").alias("a"), F.max("week_idx").alias("b"))
    spine = weekly.select("merchant_id", *keys).distinct().join(weeks, "merchant_id").select("merchant_id", *keys, F.explode(F.sequence("a", "b")).alias("week_idx"))
    return spine.join(weekly, ["merchant_id", *keys, "week_idx"], "left").na.fill(0)


def shaped(df: DataFrame, rule: str, severity: Column, segment: Column, value: Column, threshold: Column, n: Column, psp: Column | None = None, country: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return df.select("merchant_id", F.lit(rule).alias("rule"), severity.alias("severity"), "week_idx", segment.alias("segment"), (none if psp is None else psp).alias("psp"), (none if country is None else country).alias("country"), n.cast("bigint").alias("n"), value.cast("double").alias("value"), threshold.cast("double").alias("threshold"))


def judged(df: DataFrame, rule: str, enough: Column, fires: Column, severity: str, segment: Column, value: Column, threshold: Column, t: Thresholds, psp: Column | None = None, country: Column | None = None) -> DataFrame:
    """Rows that fire, and INFO rows (value 0, threshold the least number of rows) where too few rows are there to tell."""
    told = df.where(~enough | F.coalesce(fires, F.lit(False)))
    return shaped(told, rule, F.when(enough, severity).otherwise("INFO"), segment, F.when(enough, value).otherwise(0.0), F.when(enough, threshold).otherwise(float(t.min_sample_alerts)), F.col("n"), psp, country)


def peer_rule(cells: DataFrame, weeks: int = 4, q_max: float = 0.05, gap_pts: float = 2.0, t: Thresholds = DEFAULTS) -> DataFrame:
    """psp x country flag rate of some weeks against the other PSPs of the country. cells: cells_by_week of psp and country."""
    w = trailing(["merchant_id", "psp", "country"], weeks - 1, 0)
    cells = cells.select("merchant_id", "psp", "country", "week_idx", F.sum("n").over(w).alias("n"), F.sum("n_flagged").over(w).alias("k")).where("n > 0")
    c = Window.partitionBy("merchant_id", "country", "week_idx")
    cells = cells.withColumns({"peer_n": F.sum("n").over(c) - F.col("n"), "peer_k": F.sum("k").over(c) - F.col("k")})
    enough = (F.col("n") >= t.min_sample_alerts) & (F.col("peer_n") >= t.min_sample_alerts)
    tested = cells.withColumn("p", F.when(enough, stats.two_prop_p("k", "n", "peer_k", "peer_n")))
    tested = stats.benjamini_hochberg(tested, "p", ["merchant_id", "week_idx"], ["psp", "country"])
    rate, peers = F.col("k") / F.col("n"), F.try_divide("peer_k", "peer_n")
    fires = (F.col("q") < q_max) & ((rate - peers) * 100 >= gap_pts)
    return judged(tested, "peer", enough, fires, "SEV2", F.concat_ws("|", "psp", "country"), rate, peers + gap_pts / 100, t, F.col("psp"), F.col("country"))


def change_rule(cells: DataFrame, weeks: int = 8, sigma: float = 3.0, t: Thresholds = DEFAULTS) -> DataFrame:
    """A week's flag rate over the control limit of the weeks before, for everything and for psp x country."""
    none = F.lit(None).cast("string")
    sides = F.array(F.struct(F.lit("ALL").alias("segment"), none.alias("p"), none.alias("c")), F.struct(F.concat_ws("|", "psp", "country").alias("segment"), F.col("psp").alias("p"), F.col("country").alias("c")))
    seg = cells.select("merchant_id", "week_idx", "n", "n_flagged", F.explode(sides).alias("s")).groupBy("merchant_id", "week_idx", "s.segment", "s.p", "s.c").agg(F.sum("n").alias("n"), F.sum("n_flagged").alias("k"))
    w = trailing(["merchant_id", "segment"], weeks, 1)
    seg = seg.withColumns({"base_n": F.sum("n").over(w), "base_k": F.sum("k").over(w), "full": F.count_if(F.col("n") > 0).over(w) >= weeks})
    enough = F.coalesce(F.col("full"), F.lit(False)) & (F.col("n") >= t.min_sample_alerts)
    limit, rate = X.control_limit(F.try_divide("base_k", "base_n"), F.col("n").cast("double"), sigma), F.try_divide("k", "n")
    return judged(seg, "change", enough, rate > limit, "SEV3", F.col("segment"), rate, limit, t, F.col("p"), F.col("c"))


def settle_lag_rule(frame: DataFrame, weeks: int = 4, max_share: float = 0.06, t: Thresholds = DEFAULTS) -> DataFrame:
    """Late rows among settled and pending ones, by country and tier."""
    cells = cells_by_week(frame, ["country", "amount_tier"])
    w = trailing(["merchant_id", "country", "amount_tier"], weeks - 1, 0)
    cells = cells.select("merchant_id", "country", "amount_tier", "week_idx", F.sum(F.col("n") + F.col("n_open")).over(w).alias("n"), F.sum("n_late").over(w).alias("k")).where("n > 0")
    enough, share = F.col("n") >= t.min_sample_alerts, F.col("k") / F.col("n")
    return judged(cells, "settle_lag", enough, share > max_share, "SEV3", F.concat_ws("|", "country", "amount_tier"), share, F.lit(max_share), t, country=F.col("country"))


def money_leak_rule(frame: DataFrame, t: Thresholds = DEFAULTS) -> DataFrame:
    """Gross loss as a share of settled money, by week."""
    weekly = frame.withColumn("week_idx", week_index()).groupBy("merchant_id", "week_idx").agg(F.sum("gross_under_usd").alias("u"), F.sum("settled_usd").alias("s"), F.sum("n").alias("n"))
    share = F.try_divide(100 * F.col("u"), F.col("s"))
    crit = share >= t.leak_crit_pct
    fired = weekly.where(share >= t.leak_warn_pct)
    return shaped(fired, "money_leak", F.when(crit, "SEV2").otherwise("SEV3"), F.lit("ALL"), X.half_up(share / 100, 6), F.when(crit, t.leak_crit_pct / 100).otherwise(t.leak_warn_pct / 100), F.col("n"))


def large_rows_rule(frame: DataFrame, top: int = 3) -> DataFrame:
    """Weeks with large rows: their number, their money, and the cells with the most of it."""
    cells = frame.withColumn("week_idx", week_index()).groupBy("merchant_id", "week_idx", "psp", "country").agg(F.sum("n_large").alias("n"), F.sum("large_usd").alias("usd")).where("n > 0")
    rank = F.row_number().over(Window.partitionBy("merchant_id", "week_idx").orderBy(F.desc("usd"), "psp", "country"))
    named = cells.withColumn("r", rank).groupBy("merchant_id", "week_idx").agg(F.sum("n").alias("n"), F.sum("usd").alias("usd"), F.sort_array(F.collect_list(F.when(F.col("r") <= top, F.struct("r", "psp", "country")))).alias("most"))
    out = shaped(named, "large_rows", F.lit("SEV3"), F.lit("ALL"), X.half_up("usd", 2), F.lit(0.0), F.col("n"))
    details = named.select("merchant_id", "week_idx", F.array_join(F.transform("most", lambda x: F.concat_ws("|", x["psp"], x["country"])), ", ").alias("details"))
    return out.join(details, ["merchant_id", "week_idx"]).select(*FIELDS, "details")


def pending_aging_rule(frame: DataFrame, warn: float = 0.10, crit: float = 0.25, t: Thresholds = DEFAULTS) -> DataFrame:
    """Share of old rows among a psp's and country's pending ones, at the ledger's own time."""
    cells = frame.withColumn("week_idx", week_index()).groupBy("merchant_id", "psp", "country").agg(F.sum("n_open").alias("n"), F.sum("n_open_old").alias("k"), F.max("week_idx").alias("week_idx")).where("n > 0")
    enough, share = F.col("n") >= t.min_sample_alerts, F.col("k") / F.col("n")
    out = judged(cells, "pending_aging", enough, share >= warn, "SEV3", F.concat_ws("|", "psp", "country"), share, F.when(share >= crit, crit).otherwise(warn), t, F.col("psp"), F.col("country"))
    return out.withColumn("severity", F.when((F.col("severity") == "SEV3") & (F.col("value") >= crit), "SEV2").otherwise(F.col("severity")))


def group_peers(alerts: DataFrame, least: int = 3) -> DataFrame:
    """A PSP that fires in several countries becomes one row for the PSP."""
    fires = (F.col("rule") == "peer") & (F.col("severity") != "INFO")
    wide = F.count_if(fires).over(Window.partitionBy("merchant_id", "week_idx", "psp")) >= least
    marked = alerts.withColumn("_wide", fires & wide & F.col("psp").isNotNull())
    grouped = marked.where("_wide").groupBy("merchant_id", "rule", "severity", "week_idx", "psp").agg(F.sum("n").alias("m"), (F.sum(F.col("n") * F.col("value")) / F.sum("n")).alias("value"), F.min("threshold").alias("threshold"))
    one = grouped.select("merchant_id", "rule", "severity", "week_idx", F.concat("psp", F.lit("|ALL")).alias("segment"), "psp", F.lit(None).cast("string").alias("country"), F.col("m").alias("n"), "value", "threshold")
    return marked.where("not _wide").select(FIELDS).unionByName(one)


def last_closed(fct: DataFrame) -> DataFrame:
    """One row: the index of the last week that is closed at the ledger's own time."""
    end = F.date_sub(X.last_closed_end("as_of"), 6)
    return marts.as_of_of(fct).select((F.datediff(end, F.lit("1970-01-05").cast("date")) / 7).cast("int").alias("closed"))


def evaluate(frame: DataFrame, closed: DataFrame | None = None, t: Thresholds = DEFAULTS) -> DataFrame:
    """All rules of all closed weeks: status, the week since which they are open, key, period, owner, message, in order of severity, rule and segment.

    ``closed`` is one row with the last closed week; without it the frame's last week is. Weeks after it aren't judged, but what is pending is.
    """
    frame = stored(frame)  # a few hundred rows a week that every rule reads
    closed = frame.select(F.max(week_index()).alias("closed")) if closed is None else closed
    past = frame.crossJoin(F.broadcast(closed)).where(week_index() <= F.col("closed")).drop("closed")
    cells = stored(cells_by_week(past, ["psp", "country"]))
    large = large_rows_rule(past)
    open_now = pending_aging_rule(frame, t=t).drop("week_idx").crossJoin(F.broadcast(closed.select(F.col("closed").alias("week_idx")))).select(FIELDS)
    rules = [peer_rule(cells, t=t), change_rule(cells, t=t), settle_lag_rule(past, t=t), money_leak_rule(past, t), large.select(FIELDS), open_now]
    told = with_status(group_peers(reduce(DataFrame.unionByName, rules)), closed)
    details = large.select("merchant_id", "rule", "week_idx", "details")
    return in_order(described(told.join(details, ["merchant_id", "rule", "week_idx"], "left")))


#: Fixed values.
OWNERS = {"peer": "PSP ops", "change": "PSP ops", "money_leak": "Finance", "large_rows": "PSP ops", "pending_aging": "PSP ops + Finance", "settle_lag": "PSP ops"}
SEVERITIES = ("SEV2", "SEV3", "INFO")
CHANNELS = {"SEV2": ("outbox", "slack"), "SEV3": ("outbox", "slack")}


def period(week: str = "week_idx") -> Column:
    """The label YYYY-Www of a week index."""
    return X.iso_week(F.date_add(F.lit("1970-01-05").cast("date"), F.col(week) * 7))


def described(alerts: DataFrame) -> DataFrame:
    """Adds key, period, owner and message."""
    owner = F.create_map(*(F.lit(x) for kv in OWNERS.items() for x in kv))
    share = lambda c: F.format_string("%.1f%%", F.col(c) * 100)
    money = F.format_string("%.2f USD in %d large rows: %s", "value", "n", F.coalesce("details", F.lit("-")))
    text = F.when(F.col("severity") == "INFO", F.format_string("Only %d rows (< %.0f); not evaluated.", "n", "threshold")).when(F.col("rule") == "large_rows", money).otherwise(F.format_string("%s over %d rows, limit %s", share("value"), F.col("n"), share("threshold")))
    message = F.concat(F.when(F.col("status") == "RESOLVED", "Resolved: ").otherwise(""), F.col("segment"), F.lit(" "), text)
    return alerts.withColumns({"key": F.concat_ws("|", "rule", "segment"), "period": period(), "owner": owner[F.col("rule")], "message": message})


def in_order(alerts: DataFrame) -> DataFrame:
    rank = F.array_position(F.array(*map(F.lit, SEVERITIES)), F.col("severity"))
    return alerts.orderBy("merchant_id", "week_idx", rank, "rule", "segment")


def with_status(alerts: DataFrame, closed: DataFrame | None = None) -> DataFrame:
    """NEW or ONGOING for alerts that fire, INSUFFICIENT for those that can't tell, RESOLVED for keys that fired the week before and are gone.

    A key that is there with too few rows counts as present. A PSP-wide alert continues that PSP's earlier ones, which it doesn't resolve. Alerts of the
    last judged week (``closed``, one row; if not given, the last week with an alert) can't be resolved yet. open_since is the first week of the key's run of
    weeks that ends with this alert, or the week before for a PSP-wide one that continues narrower ones; for RESOLVED that of the run that ended.
    pending_aging has no history.
    """
    key = ["merchant_id", "rule", "segment"]
    fires, wide = F.col("severity") != "INFO", F.col("segment").endswith("|ALL")
    own = Window.partitionBy(*key).orderBy("week_idx")
    of_psp = Window.partitionBy("merchant_id", "rule", "psp").orderBy("week_idx")
    rows = alerts.withColumns({
        "_fired": F.coalesce(F.max(fires).over(own.rangeBetween(-1, -1)), F.lit(False)), "_psp_fired": F.coalesce(F.max(fires & F.col("psp").isNotNull()).over(of_psp.rangeBetween(-1, -1)), F.lit(False)),
        "_next": F.count("*").over(own.rangeBetween(1, 1)) > 0, "_wide_next": F.coalesce(F.max(fires & wide & F.col("psp").isNotNull()).over(of_psp.rangeBetween(1, 1)), F.lit(False)),
    })
    last = alerts.select(F.max("week_idx").alias("_last")) if closed is None else closed.select(F.col("closed").alias("_last"))
    rows = rows.crossJoin(F.broadcast(last))  # one row
    memory = F.col("rule") != "pending_aging"
    run = F.when(fires, F.struct(fires.alias("fires"), (F.col("week_idx") - F.row_number().over(Window.partitionBy(*key, fires).orderBy("week_idx"))).alias("island")))
    rows = rows.withColumn("_run", run)
    rows = rows.withColumn("_start", F.when(fires, F.min("week_idx").over(Window.partitionBy(*key, "_run"))))
    ongoing = memory & (F.col("_fired") | (wide & F.col("_psp_fired")))
    status = F.when(~fires, "INSUFFICIENT").when(ongoing, "ONGOING").otherwise("NEW")
    since = F.when(fires & ~memory, F.col("week_idx")).when(fires & ongoing & ~F.col("_fired"), F.col("week_idx") - 1).when(fires, F.col("_start"))
    ends = fires & memory & ~F.col("_next") & ~F.col("_wide_next") & (F.col("week_idx") < F.col("_last"))
    state = lambda s, week, start: F.struct(s.alias("status"), week.cast("int").alias("week_idx"), start.cast("int").alias("open_since"))
    both = F.array(state(status, F.col("week_idx"), since), F.when(ends, state(F.lit("RESOLVED"), F.col("week_idx") + 1, F.col("_start"))))
    return rows.withColumn("_s", F.explode(F.filter(both, lambda x: x.isNotNull()))).select(*(c for c in FIELDS if c != "week_idx"), "_s.week_idx", "_s.status", "_s.open_since")


def annotate(alerts: DataFrame, state: DataFrame) -> DataFrame:
    """Adds muted and acked from a state table (merchant_id, rule, segment, mute_until, acked_week, as week indexes); of several rows of a key the latest weeks hold.

    A mute holds up to its week and for alerts that could be told only; an acknowledgement for the streak in which it was given, or an earlier one that it outlasts.
    """
    key = ["merchant_id", "rule", "segment"]
    one = state.groupBy(*key).agg(F.max("mute_until").alias("_mute"), F.max("acked_week").alias("_ack"))
    same = reduce(Column.__and__, (F.col(f"a.{c}").eqNullSafe(F.col(f"s.{c}")) for c in key))
    out = alerts.drop("muted", "acked").alias("a").join(one.alias("s"), same, "left").select("a.*", "_mute", "_ack")
    muted = (F.col("status") != "INSUFFICIENT") & (F.col("week_idx") <= F.col("_mute"))
    return out.withColumns({"muted": F.coalesce(muted, F.lit(False)), "acked": F.coalesce(F.col("_ack") >= F.col("open_since"), F.lit(False))}).drop("_mute", "_ack")


def standing_mutes(alerts: DataFrame, after: int = 4, weeks: int = 2) -> DataFrame:
    """The state that follows from a rule of operation: what has been open for ``after`` weeks is acknowledged then and muted for ``weeks`` weeks."""
    old = alerts.where(F.col("status").isin("NEW", "ONGOING") & (F.col("week_idx") - F.col("open_since") >= after))
    first = F.min("week_idx")
    return old.groupBy("merchant_id", "rule", "segment").agg((first + weeks - 1).alias("mute_until"), first.alias("acked_week"))


def notification_plan(alerts: DataFrame) -> DataFrame:
    """What to send and where: a trigger once in each streak as soon as it isn't muted, and a resolve when it ends (unless muted).

    ``alerts`` come from ``evaluate`` and ``annotate``; without a column muted none is. A streak is a run of weeks in which a key is open, however open_since moves when a PSP-wide alert
    continues narrower ones; a NEW alert is always sent. Severities without a channel aren't sent.
    """
    key = ["merchant_id", "rule", "segment"]
    muted = F.coalesce(F.col("muted"), F.lit(False)) if "muted" in alerts.columns else F.lit(False)
    channels = F.create_map(*(x for k, v in CHANNELS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))))[F.col("severity")]
    is_open = F.col("status").isin("NEW", "ONGOING")
    nth = F.row_number().over(Window.partitionBy(*key, is_open).orderBy("week_idx"))
    rows = alerts.withColumns({"channels": channels, "_island": F.when(is_open, F.col("week_idx") - nth)})
    rows = rows.where(F.col("channels").isNotNull() & (F.col("status") != "INSUFFICIENT") & ~muted)
    rows = rows.withColumn("_nth", F.row_number().over(Window.partitionBy(*key, "_island", F.col("status") == "RESOLVED").orderBy("week_idx")))
    rows = rows.where((F.col("status").isin("RESOLVED", "NEW")) | (F.col("_nth") == 1))
    action = F.when(F.col("status") == "RESOLVED", "resolve").otherwise("trigger")
    more = [c for c in ("owner", "message") if c in rows.columns]
    dedupe = F.concat_ws("|", *key, period())
    return rows.select(*key, "severity", "week_idx", period().alias("period"), "status", "open_since", action.alias("action"), "channels", dedupe.alias("dedupe_key"), *more)


def slack_text(plan: DataFrame) -> DataFrame:
    """One row for each merchant and week: the text of what goes to slack."""
    line = F.format_string("[%s] %s %s|%s (open since week %s): %s", F.upper("action"), F.col("severity"), F.col("rule"), F.col("segment"), F.col("open_since").cast("string"), F.col("message"))
    rows = plan.where(F.array_contains("channels", "slack"))
    return rows.groupBy("merchant_id", "week_idx").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("severity", "rule", "segment", line.alias("line")))), lambda x: x["line"]), "\n").alias("text"))


def history_upsert(alerts: DataFrame, plan: DataFrame, path: str, weeks: list[int] | None = None) -> None:
    """Writes one line for each alert of the given weeks (of all merchants) below ``path``; lines that these weeks had before are replaced, other weeks stay.

    ``weeks`` are those that were evaluated (if not given, those that ``alerts`` has): a week without any alert loses its old lines as well, and alerts of other weeks aren't written.
    All weeks change together when the write is done; one that breaks off changes nothing.
    """
    key = ["merchant_id", "rule", "segment", "week_idx", "status"]
    lines = alerts if weeks is None else alerts.where(F.col("week_idx").isin(weeks))
    sent = plan.select(*key, F.col("action").alias("sent"))
    muted = F.coalesce(F.col("muted"), F.lit(False)) if "muted" in alerts.columns else F.lit(False)
    out = lines.join(sent, key, "left").select("merchant_id", "rule", "segment", "severity", "status", "open_since", muted.alias("muted"), "sent", F.col("week_idx").alias("week"))
    if weeks:
        # an empty line stands for a week without alerts, so that its part is replaced like the others
        spine = alerts.sparkSession.createDataFrame([(w,) for w in sorted(set(weeks))], "week int")
        out = spine.join(out, "week", "left").select(out.columns)
    out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("week").parquet(path)


def history(spark, path: str) -> DataFrame:
    """All lines of the history."""
    return spark.read.parquet(path).where(F.col("rule").isNotNull())


def history_before(spark, path: str, week: int) -> DataFrame:
    """Lines of earlier weeks only, in order."""
    return history(spark, path).where(F.col("week") < week).orderBy("week", "rule", "segment")


def open_alerts(alerts: DataFrame) -> DataFrame:
    return alerts.where(F.col("status").isin("NEW", "ONGOING"))


def insufficient(alerts: DataFrame) -> DataFrame:
    return alerts.where("status = 'INSUFFICIENT'")


def money_lines(frame: DataFrame) -> DataFrame:
    """Under, over and net money of each week, with that of the calendar week before beside it (0 if it is absent)."""
    weekly = frame.withColumn("week_idx", week_index()).groupBy("merchant_id", "week_idx").agg(*(X.half_up(F.sum(f"gross_{c}_usd"), 2).alias(f"{c}_usd") for c in ("under", "over")))
    weekly = weekly.withColumn("net_usd", X.half_up(F.col("under_usd") - F.col("over_usd"), 2))
    w = Window.partitionBy("merchant_id").orderBy("week_idx").rangeBetween(-1, -1)
    return weekly.withColumns({f"prev_{c}": F.coalesce(F.sum(c).over(w), F.lit(0.0)) for c in ("under_usd", "over_usd", "net_usd")})


def alert_counts(alerts: DataFrame) -> DataFrame:
    return alerts.groupBy("merchant_id", "severity", "status").agg(F.count("*").alias("n"))
