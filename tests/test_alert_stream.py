"""Alert states of a stream of weekly files against the batch."""

import json
from pathlib import Path

from pyspark.sql import functions as F

from tallyspark.operators import alerts
from tallyspark.streaming import alert_state

KIND = "merchant_id string, rule string, severity string, week_idx int, segment string, psp string, country string, n bigint, value double, threshold double"
OUT = ["merchant_id", "rule", "segment", "severity", "psp", "country", "n", "value", "threshold", "week_idx", "status", "open_since"]


def alert(week, segment, severity="SEV2", rule="peer", psp=None, merchant="m"):
    return (merchant, rule, severity, week, segment, psp, None, 100 + week, 0.2, 0.1)


BASE = 2900  # weeks since 1970
ROWS = [(*r[:3], BASE + r[3], *r[4:]) for r in (
    [alert(w, "A|MX", psp="A") for w in (1, 2, 3, 6, 7)] + [alert(2, "B|CO", psp="B"), alert(2, "B|MX", psp="B"), alert(3, "B|ALL", psp="B"), alert(4, "B|ALL", psp="B"), alert(6, "B|CO", psp="B")]
    + [alert(w, "ALL", "SEV3", "change") for w in (2, 3, 5)] + [alert(4, "ALL", "INFO", "change")] + [alert(w, "C|AR", "SEV3", "pending_aging", "C") for w in (1, 2, 5, 9)]
    + [alert(w, "A|MX", psp="A", merchant="other") for w in (3, 4)] + [alert(w, "ALL", "SEV2", "money_leak") for w in range(1, 11)]
)]


def put(folder: Path, name: str, rows) -> None:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text("".join(json.dumps(dict(zip(alerts.FIELDS, (r[0], r[1], r[2], r[3], r[4], r[5], r[6], r[7], r[8], r[9]), strict=True))) + "\n" for r in rows))


def states(spark, rows, closed):
    told = alerts.with_status(spark.createDataFrame(rows, KIND), spark.createDataFrame([(closed,)], "closed int"))
    return sorted((tuple(r) for r in told.select(OUT).collect()), key=repr)


def run(spark, tmp_path):
    stream = spark.readStream.schema(KIND).json(str(tmp_path / "in"))
    alert_state.run_states(stream, str(tmp_path / "out"), str(tmp_path / "checkpoint")).awaitTermination(300)
    return sorted((tuple(r) for r in spark.read.schema(alert_state.OUTPUT).parquet(str(tmp_path / "out")).select(OUT).collect()), key=repr)


def upto(rows, week):
    return [r for r in rows if r[3] <= week]


def test_states_of_a_stream_are_those_of_the_batch(spark, tmp_path):
    """Three starts from one checkpoint; rows of week 4 come after those of week 5, a row of week 3 comes when weeks up to 7 have been."""
    held_back = [r for r in ROWS if r[3] == BASE + 4]
    put(tmp_path / "in", "a.json", [r for r in ROWS if r[3] <= BASE + 5 and r not in held_back])
    # the watermark stands at the end of week 4 - its rows in time are those of week 5 on
    first = run(spark, tmp_path)
    assert {r[9] for r in first} <= set(range(BASE + 1, BASE + 5))
    put(tmp_path / "in", "b.json", [r for r in ROWS if BASE + 6 <= r[3] <= BASE + 7] + [alert(BASE + 2, "late", psp="L")])
    second = run(spark, tmp_path)
    assert [r for r in second if r in first] == first and not [r for r in second if r[2] == "late"]
    put(tmp_path / "in", "c.json", [r for r in ROWS if r[3] > BASE + 7])
    rows = [r for r in ROWS if r not in held_back]
    assert run(spark, tmp_path) == states(spark, upto(rows, BASE + 9), BASE + 9)


def test_rows_in_time_count_in_any_order(spark, tmp_path):
    """Rows of older weeks that come within the allowed lateness are judged in their week; repeats count once."""
    put(tmp_path / "in", "a.json", [r for r in ROWS if r[3] in (BASE + 1, BASE + 3)])
    stream = lambda: spark.readStream.schema(KIND).json(str(tmp_path / "in"))
    go = lambda: alert_state.run_states(stream(), str(tmp_path / "out"), str(tmp_path / "checkpoint"), late="28 days").awaitTermination(300)
    go()
    put(tmp_path / "in", "b.json", [r for r in ROWS if r[3] in (BASE + 2, BASE + 4)] + [r for r in ROWS if r[3] == BASE + 3])
    go()
    put(tmp_path / "in", "c.json", [r for r in ROWS if r[3] > BASE + 4] + [alert(BASE + 20, "ALL", "SEV2", "money_leak")])
    go()
    got = sorted((tuple(r) for r in spark.read.schema(alert_state.OUTPUT).parquet(str(tmp_path / "out")).select(OUT).collect()), key=repr)
    assert got == states(spark, ROWS, BASE + 16)


def test_judging_a_week():
    facts = ("SEV2", "B", None, 5, 0.2, 0.1)
    rows, held = alert_state.judge(("m", "peer", "B"), 8, {"B|ALL": facts}, {"B|CO": (7, 5, *facts)})
    assert [(r.segment, r.status, r.open_since) for r in rows] == [("B|ALL", "ONGOING", 7)] and held == {"B|ALL": (8, 8, *facts)}
    rows, held = alert_state.judge(("m", "peer", "B"), 9, {}, held)
    assert [(r.segment, r.status, r.open_since, r.week_idx) for r in rows] == [("B|ALL", "RESOLVED", 8, 9)] and held == {}
    assert F.lit(alert_state.week_end_ms(0)) is not None and alert_state.week_end_ms(0) == 11 * 86_400_000
