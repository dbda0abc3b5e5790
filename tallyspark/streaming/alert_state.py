"""Alert status as keyed state of a stream: the streaming twin of ``alerts.with_status``.

Rows are what the rules give for each week (before any status). A week is judged when the watermark has passed its end, by a timer; what arrives
before that is held in state, in any order, and what arrives later is dropped. The alerts of one PSP under one rule share a key, since a
PSP-wide alert continues the PSP's narrower ones. State is the rows of weeks that aren't judged yet and one entry for each alert that is open.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..operators.alerts import FIELDS

WEEK_MS = 7 * 86_400_000
#: Monday 1970-01-05, with which week 0 begins.
EPOCH_MS = 4 * 86_400_000
STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
FACTS = "severity string, psp string, country string, n bigint, value double, threshold double"
OUTPUT = "merchant_id string, rule string, severity string, segment string, psp string, country string, n bigint, value double, threshold double, week_idx int, status string, open_since int"
#: Rules whose alerts are told anew each week.
WITHOUT_MEMORY = ("pending_aging",)


def week_end_ms(week: int) -> int:
    return EPOCH_MS + (week + 1) * WEEK_MS


class AlertStates(StatefulProcessor):
    """State of one (merchant, rule, PSP; or the segment where there is no PSP)."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "week_idx int, segment string", FACTS)
        self.open = handle.getMapState("open", "segment string", f"last int, start int, {FACTS}")
        self.judged = handle.getValueState("judged", "week_idx int")

    def last_judged(self) -> int:
        return self.judged.get()[0] if self.judged.exists() else -(1 << 30)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        done = self.last_judged()
        for r in rows:
            if r.week_idx > done:
                self.waiting.updateValue((r.week_idx, r.segment), (r.severity, r.psp, r.country, r.n, r.value, r.threshold))
                self.handle.registerTimer(week_end_ms(r.week_idx))
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        due = (timerValues.getCurrentWatermarkInMs() - EPOCH_MS) // WEEK_MS - 1
        # all weeks that have ended by the watermark, whichever timer of this key comes first
        weeks: dict[int, dict[str, tuple]] = {}
        for (week, segment), facts in list(self.waiting.iterator()):
            if week <= due:
                weeks.setdefault(week, {})[segment] = tuple(facts)
        held = {segment: tuple(x) for (segment,), x in list(self.open.iterator())}
        out: list[Row] = []
        # weeks in order, and the week after the last one of an open alert, in which it may be over
        while todo := [*weeks, *({x[0] + 1 for x in held.values()} if held else ())]:
            week = min(todo)
            if week > due:
                break
            now = weeks.pop(week, {})
            rows, held = judge(key, week, now, held)
            out += rows
            for segment in now:
                self.waiting.removeKey((week, segment))
            self.judged.update((week,))
        for (segment,), _ in list(self.open.iterator()):
            if segment not in held:
                self.open.removeKey((segment,))
        for segment, x in held.items():
            self.open.updateValue((segment,), x)
            self.handle.registerTimer(week_end_ms(x[0] + 1))
        return iter(out)

    def close(self) -> None:
        pass


def judge(key: tuple, week: int, now: dict[str, tuple], held: dict[str, tuple]) -> tuple[list[Row], dict[str, tuple]]:
    """The statuses of one week, and the alerts that are open after it. ``held``: segment -> (last week, start, facts) of those that fired the week before."""
    merchant, rule = key[0], key[1]
    memory = rule not in WITHOUT_MEMORY
    wide = lambda segment: segment.endswith("|ALL")
    fired = {s: f for s, f in now.items() if f[0] != "INFO"}
    of_psp = any(x[3] is not None for x in held.values())
    covered = any(wide(s) and f[1] is not None for s, f in fired.items())
    row = lambda segment, facts, status, since: Row(merchant_id=merchant, rule=rule, severity=facts[0], segment=segment, psp=facts[1], country=facts[2], n=facts[3], value=facts[4], threshold=facts[5], week_idx=week, status=status, open_since=since)
    out, after = [], {}
    for segment, facts in now.items():
        if segment not in fired:
            out.append(row(segment, facts, "INSUFFICIENT", None))
        elif memory and segment in held:
            start = held[segment][1]
            out.append(row(segment, facts, "ONGOING", start))
            after[segment] = (week, start, *facts)
        elif memory and wide(segment) and of_psp:
            out.append(row(segment, facts, "ONGOING", week - 1))
            after[segment] = (week, week, *facts)
        else:
            out.append(row(segment, facts, "NEW", week))
            if memory:
                after[segment] = (week, week, *facts)
    for segment, (_, start, *facts) in held.items():
        if segment not in now and not covered:
            out.append(row(segment, tuple(facts), "RESOLVED", start))
    return out, after


def use_rocksdb(spark: SparkSession) -> None:
    """Keyed state with timers needs this state store; to be set before the query starts."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)


def alert_states(alerts: DataFrame, late: str = "7 days") -> DataFrame:
    """``alerts`` (a stream of FIELDS) with status and open_since, a week at a time once the watermark has passed its end.

    ``late`` is how far behind the newest week's end a week's rows may come; the newest weeks within it wait. A row that comes twice counts once.
    """
    week_end = F.timestamp_millis(F.lit(EPOCH_MS) + (F.col("week_idx").cast("bigint") + 1) * WEEK_MS)
    rows = alerts.select(*FIELDS).withColumn("week_end", week_end).withWatermark("week_end", late)
    by = rows.withColumn("of", F.coalesce("psp", "segment")).groupBy("merchant_id", "rule", "of")
    return by.transformWithState(AlertStates(), OUTPUT, "append", "EventTime")


def run_states(alerts: DataFrame, path: str, checkpoint: str, late: str = "7 days", trigger: dict | None = None):
    """Writes the states as Parquet below ``path``; started again with the same checkpoint it goes on where it ended."""
    use_rocksdb(alerts.sparkSession)
    return alert_states(alerts, late).writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
