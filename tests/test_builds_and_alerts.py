"""Publishing, ingest from landing to staged rows, alert states over weeks, contracts, tests of questions."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyspark.functions import columns as X
from tallyspark.operators import alerts, findings, marts, quality, questions, stats
from tallyspark.plans import publish
from tallyspark.plans.fact import build_fact, projected_fact
from tallyspark.sources import ingest, ledger

SF = "/root/testdata/sf0.001"


def test_failed_checks_keep_the_last_good_build(spark, tmp_path):
    root, tables = str(tmp_path), publish.built_tables(projected_fact(spark, SF))
    checks = lambda stored: quality.assertions(stored["fact"], ledger.reference_tables(spark))
    with pytest.raises(FileNotFoundError):
        publish.read_published(spark, root, "fact")
    first = publish.publish_build(spark, tables, root, checks)
    broken = tables | {"fact": tables["fact"].withColumn("diff_local", F.lit(1).cast("bigint"))}
    with pytest.raises(ValueError, match="category boundaries"):
        publish.publish_build(spark, broken, root, checks)
    for wrong, what in ((lambda f: f.withColumn("note", F.lit(1)), "unexpected note"), (lambda f: f.drop("direction"), "missing direction"), (lambda f: f.withColumn("item_count", F.col("item_count").cast("bigint")), "item_count is bigint, not int")):
        with pytest.raises(ValueError, match=what):
            publish.publish_build(spark, tables | {"fact": wrong(tables["fact"])}, root, checks)
    assert publish.published_version(spark, root) == (1, first)
    assert publish.read_published(spark, root, "fact").count() == tables["fact"].count()
    assert {r.name: r.n for r in publish.table_row_counts(tables).collect()}["fact"] == tables["fact"].count()
    assert publish.publish_build(spark, tables, root, checks) != first and publish.published_version(spark, root)[0] == 2


def test_tables_compared_row_by_row(spark):
    kind = "k int, l string, x double, y string"
    a = spark.createDataFrame([(1, "a", 1.0, None), (2, None, 2.0, "b"), (3, "c", None, "c"), (4, "d", 4.0, "d")], kind)
    b = spark.createDataFrame([(1, "a", 1.0, None), (2, None, 2.5, None), (3, "c", 3.0, "c"), (5, "e", 5.0, "e")], kind).select("y", "x", "l", "k")
    got = {(r.k, r.l): (r.side, r.columns) for r in quality.compare_rows(a, b, ["k", "l"]).collect()}
    assert got == {(2, None): ("both", ["x", "y"]), (3, "c"): ("both", ["x"]), (4, "d"): ("left", []), (5, "e"): ("right", [])}
    assert quality.compare_rows(a, a, ["k", "l"]).isEmpty() and quality.compare_rows(a.where("false"), a, ["k"]).count() == 4
    with pytest.raises(ValueError, match="columns differ"):
        quality.compare_rows(a, b.drop("y"), ["k"])


def test_assertions_count_what_contradicts_them(spark):
    f, refs, staged = projected_fact(spark, SF), ledger.reference_tables(spark), ledger.projected_ledger(spark, SF)
    bad = lambda *x, **y: {r.check_name: r.n_bad for r in quality.assertions(*x, **y).collect() if r.n_bad}
    assert bad(f, refs, staged) == {}
    out = marts.outliers(f)
    n = out.count()
    changed = out.withColumn("likely_cause", F.when(F.col("psp") == "PSP_A", "other").otherwise(F.col("likely_cause")))
    assert bad(f, refs, staged.limit(10), changed) == {"row count as staged": f.count() - 10, "outliers are the large rows": out.where("psp = 'PSP_A'").count()} and bad(f, refs, staged, out.limit(0)) == {"outliers are the large rows": n}


def test_report_tables(spark, tmp_path):
    df = spark.createDataFrame([("b", 0.12345678, None), ("a", float("nan"), 1)], "k string, x double, n int")
    for kind in ("csv", "parquet", "jsonl"):
        path = str(tmp_path / kind)
        assert publish.read_table(spark, path, kind) is None
        publish.write_table(df, path, kind)
        assert [(r.k, r.x, r.n) for r in publish.read_table(spark, path, kind).orderBy("k").collect()] == [("a", None, 1), ("b", 0.123457, None)]
    fct = projected_fact(spark, SF)
    publish.export_transactions_csv(fct, str(tmp_path / "out"), marts.Filters(country=("MX",)), 5)
    got = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert got.count() == fct.where("status = 'settled' and country = 'MX' and abs_residual_usd > 5").count() and got.where("customer_id not like 'cus_••••%'").isEmpty()


def test_landing_to_staged_and_back(spark, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "lake")
    rows = ledger.projected_ledger(spark, SF).limit(120).persist()
    bad = F.when(F.col("psp") == "PSP_A", "XX").otherwise(F.col("country"))
    ingest.land(rows.withColumn("country", bad), landing)
    done = ingest.load_landing(spark, landing, root)
    assert {r.status for r in done.collect()} == {"staged", "quarantined"}
    staged = lambda: ledger.read_staged(spark, f"{root}/staged")
    assert staged().where("psp = 'PSP_A'").isEmpty() and staged().count() == rows.where("psp <> 'PSP_A'").count()
    assert spark.read.parquet(f"{root}/quarantine/rows").count() == rows.where("psp = 'PSP_A'").count()
    assert ingest.load_landing(spark, landing, root).isEmpty()
    again = ingest.load_landing(spark, landing, root, force=("2026-05-01", None))
    dates = ingest.dated(ingest.file_hashes(spark, landing)).where("date >= '2026-05-01'").count()
    assert again.count() == dates and staged().count() == rows.where("psp <> 'PSP_A'").count()
    fs = spark._jvm.org.apache.hadoop.fs.Path(landing).getFileSystem(spark._jsc.hadoopConfiguration())
    fs.delete(spark._jvm.org.apache.hadoop.fs.Path(landing), True)
    ingest.land(rows, landing)  # the fixed delivery
    assert {r.status for r in ingest.load_landing(spark, landing, root).collect()} == {"staged"}
    assert staged().exceptAll(rows).isEmpty() and rows.exceptAll(staged()).isEmpty()
    assert not list((tmp_path / "lake" / "quarantine").rglob("*.parquet"))
    state = ingest.latest(ingest.read_manifest(spark, root))
    report = ingest.ingest_report(state, [f"PSP_{x}" for x in "ABCDE"], most_days=400)
    assert [r.check_name for r in report.orderBy("nth").select("nth", "check_name").distinct().orderBy("nth").collect()] == ["freshness", "volume", "columns", "quarantine", "overall"]
    assert {r.source for r in report.where("check_name = 'freshness'").collect()} == {f"PSP_{x}" for x in "ABCDE"}
    with pytest.raises(ValueError, match="freshness PSP_X"):
        ingest.ingest_report(state, ["PSP_X"])
    staged_fact = build_fact(ledger.stage_transactions(rows), ledger.projected_fx(spark), ledger.reference_tables(spark)).persist()
    build = lambda r: build_fact(r, ledger.projected_fx(spark), ledger.reference_tables(spark))
    with pytest.raises(ValueError, match="freshness"):  # nothing has come for days: no rebuild
        ingest.replay_range(spark, landing, root, "2026-04-01", "2027-07-31", "2026-07-31", build, staged_fact.limit(60))
    replayed = ingest.replay_range(spark, landing, root, "2026-04-01", "2026-07-31", "2026-07-31", build, staged_fact.limit(60), most_days=400)
    assert replayed.select("transaction_id", "category").exceptAll(staged_fact.select("transaction_id", "category")).isEmpty() and replayed.count() == staged_fact.count()


def test_lines_of_files_in_pieces(spark, tmp_path):
    (tmp_path / "source=A" / "date=2026-04-01").mkdir(parents=True)
    text = "transaction_id,status\n" + "".join(f"t{i},settled\n" for i in range(5000))
    (tmp_path / "source=A" / "date=2026-04-01" / "f.csv").write_text(text)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8192")
    try:
        got = {r.transaction_id: r.line for r in ingest.read_files(spark, str(tmp_path)).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == {f"t{i}": i + 2 for i in range(5000)}


def alert(week, segment, severity="SEV2", rule="peer", psp=None):
    return ("m", rule, severity, week, segment, psp, None, 100, 0.2, 0.1)


def test_states_of_alerts(spark, tmp_path):
    rows = [
        alert(1, "A|MX", psp="A"), alert(2, "A|MX", psp="A"), alert(3, "A|MX", psp="A"), alert(6, "A|MX", psp="A"), alert(2, "B|CO", psp="B"), alert(3, "B|ALL", psp="B"), alert(4, "B|ALL", psp="B"),
        alert(5, "ALL", "INFO", "change"), alert(7, "C|AR", "SEV3", "pending_aging", "C"),
    ]
    df = spark.createDataFrame(rows, "merchant_id string, rule string, severity string, week_idx int, segment string, psp string, country string, n bigint, value double, threshold double")
    closed = spark.createDataFrame([(7,)], "closed int")
    got = {(r.segment, r.week_idx): (r.status, r.open_since) for r in alerts.with_status(df, closed).collect()}
    assert got == {
        ("A|MX", 1): ("NEW", 1), ("A|MX", 2): ("ONGOING", 1), ("A|MX", 3): ("ONGOING", 1), ("A|MX", 4): ("RESOLVED", 1), ("A|MX", 6): ("NEW", 6), ("A|MX", 7): ("RESOLVED", 6),
        ("B|CO", 2): ("NEW", 2), ("B|ALL", 3): ("ONGOING", 2), ("B|ALL", 4): ("ONGOING", 3), ("B|ALL", 5): ("RESOLVED", 3), ("ALL", 5): ("INSUFFICIENT", None), ("C|AR", 7): ("NEW", 7),
    }
    told = alerts.described(alerts.with_status(df, closed).withColumn("details", F.lit(None).cast("string")))
    state = spark.createDataFrame([("m", "peer", "A|MX", 1, None), ("m", "peer", "A|MX", 2, None), ("other", "peer", "A|MX", 9, None)], "merchant_id string, rule string, segment string, mute_until int, acked_week int")
    plan = alerts.notification_plan(alerts.annotate(told, state))
    sent = {(r.segment, r.week_idx): (r.action, r.channels, r.owner) for r in plan.collect()}
    assert sent[("A|MX", 3)] == ("trigger", ["outbox", "slack"], "PSP ops") and ("A|MX", 1) not in sent and sent[("A|MX", 4)][0] == "resolve" and ("ALL", 5) not in sent
    assert [r.text for r in alerts.slack_text(plan).where("week_idx = 4").collect()][0].startswith("[RESOLVE] SEV2 peer|A|MX")
    path = str(tmp_path / "history")
    for _ in range(2):
        alerts.history_upsert(told.where("week_idx <= 4"), plan, path)
    alerts.history_upsert(told.where("week_idx = 4").limit(1), plan, path)
    assert alerts.history_before(spark, path, 4).count() == told.where("week_idx < 4").count() and spark.read.parquet(path).where("week = 4").count() == 1
    assert alerts.open_alerts(told).count() == 8 and alerts.insufficient(told).count() == 1


def test_one_trigger_a_streak_though_open_since_moves(spark):
    rows = [alert(2, "B|CO", psp="B"), *(alert(w, "B|ALL", psp="B") for w in (3, 4, 5, 7)), *(("other", *alert(w, "B|ALL", psp="B")[1:]) for w in (4, 5))]
    df = spark.createDataFrame(rows, "merchant_id string, rule string, severity string, week_idx int, segment string, psp string, country string, n bigint, value double, threshold double")
    told = alerts.with_status(df, spark.createDataFrame([(8,)], "closed int"))
    sent = sorted((r.merchant_id, r.segment, r.week_idx, r.action) for r in alerts.notification_plan(told).collect())
    assert sent == [("m", "B|ALL", 3, "trigger"), ("m", "B|ALL", 6, "resolve"), ("m", "B|ALL", 7, "trigger"), ("m", "B|ALL", 8, "resolve"), ("m", "B|CO", 2, "trigger"), ("other", "B|ALL", 4, "trigger"), ("other", "B|ALL", 6, "resolve")]
    assert {r.dedupe_key for r in alerts.notification_plan(told).where("week_idx = 4").collect()} == {"other|peer|B|ALL|1970-W06"}
    state = spark.createDataFrame([("m", "peer", "B|ALL", 4, 3), ("m", "peer", "B|CO", None, 1)], "merchant_id string, rule string, segment string, mute_until int, acked_week int")
    marked = alerts.annotate(told, state)
    assert marked.count() == told.count()
    sent = sorted((r.merchant_id, r.week_idx, r.action) for r in alerts.notification_plan(marked).where("segment = 'B|ALL'").collect())
    assert sent == [("m", 5, "trigger"), ("m", 6, "resolve"), ("m", 7, "trigger"), ("m", 8, "resolve"), ("other", 4, "trigger"), ("other", 6, "resolve")]
    assert {(r.segment, r.week_idx) for r in marked.where("acked").collect()} == {("B|ALL", w) for w in (3, 4, 5, 6)}


def test_history_of_empty_weeks_and_broken_writes(spark, tmp_path):
    rows = [alert(w, "A|MX", psp="A") for w in (1, 2, 3)]
    df = spark.createDataFrame(rows, "merchant_id string, rule string, severity string, week_idx int, segment string, psp string, country string, n bigint, value double, threshold double")
    told = alerts.with_status(df, spark.createDataFrame([(3,)], "closed int"))
    plan, path = alerts.notification_plan(told), str(tmp_path / "history")
    weeks = lambda: [r.week for r in alerts.history(spark, path).orderBy("week").collect()]
    alerts.history_upsert(told, plan, path, [1, 2, 3, 4])
    assert weeks() == [1, 2, 3] and [r.week for r in alerts.history_before(spark, path, 3).collect()] == [1, 2]
    alerts.history_upsert(told.where("false"), plan, path, [2])
    assert weeks() == [1, 3]
    broken = told.withColumn("severity", F.when(F.col("week_idx") == 3, F.raise_error(F.lit("lost"))).otherwise(F.col("severity")))
    with pytest.raises(Exception, match="lost"):
        alerts.history_upsert(broken, plan, path, [1, 2, 3])
    assert weeks() == [1, 3]
    alerts.history_upsert(told, plan, path, [2])
    assert weeks() == [1, 2, 3] and {r.week: r.sent for r in alerts.history(spark, path).collect()} == {1: "trigger", 2: None, 3: None}


def newton(rows: list[dict], names: list[str]) -> np.ndarray:
    """Plain logistic regression of single rows, by the terms' names."""

    def value(row: dict, term: str) -> float:
        out = 1.0
        for part in term.split(":"):
            if part == "Intercept":
                continue
            if part.startswith("C("):
                factor, level = part[2:].split(")[T.")
                out *= row[factor] == level[:-1]
            else:
                out *= row[part]
        return float(out)

    x = np.array([[value(r, t) for t in names] for r in rows])
    y = np.array([float(r["is_meaningful"]) for r in rows])
    beta = np.zeros(x.shape[1])
    for _ in range(60):
        mu = 1 / (1 + np.exp(-x @ beta))
        beta = beta + np.linalg.lstsq(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu), rcond=None)[0]
    mu = 1 / (1 + np.exp(-x @ beta))
    return beta, np.sqrt(np.diag(np.linalg.inv(x.T @ (x * (mu * (1 - mu))[:, None]))))


def glm_rows(merchant: str, n: int, seed: int) -> list[dict]:
    rng = np.random.default_rng(seed)
    pick = lambda values: str(values[int(rng.integers(len(values)))])
    rows = [{"merchant_id": merchant, "status": "settled", "psp": pick(["A", "B", "C"]), "country": pick(["MX", "CO"]), "amount_tier": pick(["0-50", "200+"]), "lag_bucket": pick(["0-1", "2-3", "8+"]), "is_cross_border": bool(rng.integers(2)), "is_weekend": bool(rng.integers(2))} for _ in range(n)]
    for r in rows:
        odds = -1 + (r["psp"] == "B") - 0.7 * (r["country"] == "MX") * (r["psp"] == "C") + 0.5 * r["is_weekend"] + 0.8 * (r["lag_bucket"] == "8+")
        r["is_meaningful"] = bool(rng.random() < 1 / (1 + math.exp(-odds)))
    return rows


def test_regressions_of_all_merchants_equal_a_plain_fit(spark):
    rows = {m: glm_rows(m, 1200, i) for i, m in enumerate(("one", "two"))}
    small = [{**r, "merchant_id": "flat", "is_meaningful": False} for r in rows["one"][:50]]
    kind = "merchant_id string, status string, psp string, country string, amount_tier string, lag_bucket string, is_cross_border boolean, is_weekend boolean, is_meaningful boolean"
    df = spark.createDataFrame([tuple(r[c.split()[0]] for c in kind.split(", ")) for r in [*rows["one"], *rows["two"], *small]], kind)
    got = stats.fit_glm(df).collect()
    assert {r.merchant_id for r in got} == {"one", "two"}  # where nothing is flagged there is nothing to fit
    for m in rows:
        own = {r.term: r for r in got if r.merchant_id == m}
        assert len(own) == 11 and "C(psp)[T.C]:C(country)[T.MX]" in own and all(r.dropped == [] for r in own.values())
        beta, error = newton(rows[m], list(own))
        for r, b, e in zip(own.values(), beta, error, strict=True):
            assert math.isclose(math.log(r.odds_ratio), b, abs_tol=1e-6) and math.isclose(math.log(r.ci_high), b + X.Z95 * e, abs_tol=1e-5)
            assert math.isclose(r.p, math.erfc(abs(b / e) / math.sqrt(2)), rel_tol=1e-4, abs_tol=1e-12)


def test_a_failed_regression_drops_small_cells_once(monkeypatch):
    cells = pd.DataFrame(glm_rows("one", 2000, 5))
    cells.loc[cells.index[:1500], "psp"] = "A"
    keys = ["merchant_id", *stats.CROSSED, *stats.FACTORS, *stats.FLAGS]
    counted = cells.groupby(keys, as_index=False).agg(n=("is_meaningful", "size"), k=("is_meaningful", "sum"))
    plain, calls = stats.logistic, []
    monkeypatch.setattr(stats, "logistic", lambda *a: calls.append(a) or (None if len(calls) == 1 else plain(*a)))
    again = stats.fit_cells(counted, 200)
    sizes = counted.groupby(["psp", "country"])["n"].sum()
    assert sorted(again["dropped"].iloc[0]) == sorted(f"{p}|{c}" for (p, c), n in sizes.items() if n < 200) != []
    kept = cells[[sizes[(p, c)] >= 200 for p, c in zip(cells["psp"], cells["country"], strict=True)]]
    x = {t: o for t, o in zip(again["term"], again["odds_ratio"], strict=True)}
    names = [t for t in x if not t.startswith("C(psp)")]
    assert np.allclose([math.log(x[t]) for t in names], newton(kept.to_dict("records"), names)[0], atol=1e-6)
    monkeypatch.setattr(stats, "logistic", lambda *a: None)
    assert stats.fit_cells(counted, 200).empty


def test_alerts_stop_at_the_last_closed_week(spark):
    f = projected_fact(spark, SF)
    closed = alerts.last_closed(f).first().closed
    told = alerts.evaluate(alerts.alert_frame(f), alerts.last_closed(f))
    assert told.agg(F.max("week_idx")).first()[0] <= closed and told.where("rule = 'large_rows' and status <> 'RESOLVED' and details is null").isEmpty()
    assert [c for c in ("key", "period", "owner", "message", "open_since") if c not in told.columns] == []


def test_contracts_and_generic_checks(spark):
    df = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    got = {r.check_name: r.n_bad for r in quality.generic_checks(df, unique=[["k"], ["k", "v"]], not_null={"k": None, "v": F.col("k") == 1}, accepted={"v": ["a", "b"]}).collect()}
    assert got == {"not null k": 1, "not null v": 0, "accepted v": 1, "unique k": 1, "unique k, v": 0}
    contract = T.StructType([T.StructField("k", T.IntegerType()), T.StructField("v", T.StringType())])
    assert quality.enforced(df, contract) is df
    for wrong in (df.select("v", "k"), df.withColumn("k", F.col("k").cast("bigint")), df.drop("v"), df.withColumn("w", F.lit(1))):
        with pytest.raises(ValueError):
            quality.enforced(wrong, contract)


def test_ranks_and_correlation(spark):
    """Ranks by ranges of values equal plain mean ranks; p of a correlation equals known values."""
    values = [(i * 37) % 101 for i in range(500)] + [5] * 100
    df = spark.createDataFrame([(1, float(v)) for v in values], "f int, v double")
    got = {r.v: (r.ties, r["rank"]) for r in stats.tie_ranks(df, "v", ["f"]).collect()}
    for v in set(values):
        below, ties = sum(x < v for x in values), values.count(v)
        assert got[v] == (ties, below + (ties + 1) / 2)
    assert math.isclose(questions.student_p(0.5, 20), 0.024771, abs_tol=1e-5) and math.isclose(questions.student_p(-0.2, 102), 0.043869, abs_tol=1e-5)
    assert questions.student_p(1.0, 10) == 0.0 and questions.student_p(0.3, 2) == 1.0


def test_stacked_tests_and_actions(spark):
    f = projected_fact(spark, "/root/testdata/sf0.01")
    tests = questions.all_tests(f).persist()
    rows = tests.collect()
    assert {r.question for r in rows} == {"Q1", "Q2", "Q3", "Q4", "Q5", "Q6"} and {"fee_drift", "lag_over_300", "item_count", "risk_score", "size_vs_magnitude", "cause_psp"} <= {r.segment_type for r in rows}
    ps = sorted(r.p for r in rows if r.p is not None)
    for r in rows:
        if r.p is not None:
            assert math.isclose(r.q, min(1.0, min(p * len(ps) / (i + 1) for i, p in enumerate(ps) if p >= r.p)), rel_tol=1e-9)
        if r.segment_type not in ("lag_over_300", "size_vs_magnitude"):
            assert math.isclose(r.p, stats.rate_test_p(r.n_flagged, r.n, r.peer_flagged, r.peer_n), rel_tol=1e-9)
    found = findings.findings(tests, f)
    kinds = {r.kind for r in found.collect()}
    assert "partial_capture" in kinds
    recommended = findings.recommend(found)
    assert {r.finding for r in findings.action_of_finding(recommended).collect()} <= {r.finding for r in found.collect()}
    own = spark.createDataFrame([("reconcile", "Look into {psp}", "us", 1.0)], findings.CATALOGUE)
    assert {(r.action, r.owner) for r in findings.recommend(found, catalogue=own).collect()} == {("Look into the PSP", "us")}
    named = spark.createDataFrame([("peer", "psp_fee"), ("peer", "tip"), ("cause_psp", "tip"), ("lag", None)], "kind string, cause string").select(findings.action_of(F.col("kind"), F.col("cause")).alias("a"))
    assert [r.a for r in named.collect()] == ["fee", "peer", None, "lag"]
    assert questions.headlines(f).count() == 5
