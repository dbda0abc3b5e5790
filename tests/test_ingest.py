"""Landings whose files differ: headers of their own, state folded from the manifest, loads that break off."""

import shutil
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.operators import quality
from tallyspark.sources import ingest, ledger

SF = "/root/testdata/sf0.001"
NAMES = list(ingest.CONTRACT)
VALUES = dict(zip(NAMES, "t1,c1,books,MX,MXN,MXN,false,PSP_A,settled,2026-04-01T10:00:00,2026-04-02T10:00:00,1000,990,1,0.5,MX,m".split(","), strict=True))


def line(names, **other):
    return ",".join(str(({**VALUES, **other}).get(n, "x")) for n in names)


def put(landing: Path, source: str, date: str, names, rows, name="f.csv"):
    folder = landing / f"source={source}" / f"date={date}"
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text("\n".join([",".join(names), *(line(names, psp=source, **r) for r in rows)]) + "\n")


def staged(spark, root):
    return sorted(r.transaction_id for r in ledger.read_staged(spark, f"{root}/staged").collect())


def problems(spark, root):
    return {(r.source, r["column"], r.problem) for r in spark.read.parquet(f"{root}/quarantine/reasons").collect()}


def ids(*names):
    return [{"transaction_id": n} for n in names]


def test_each_file_is_read_by_its_own_header(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "lake")
    put(landing, "PSP_A", "2026-04-01", NAMES, ids("a1", "a2"))
    put(landing, "PSP_B", "2026-04-01", NAMES[::-1], ids("b1"))  # another order
    put(landing, "PSP_C", "2026-04-01", [*NAMES, "card_number", "note"], [{"transaction_id": "c1", "card_number": "4111", "note": '"one, two"'}])
    put(landing, "PSP_D", "2026-04-01", [n for n in NAMES if n != "risk_score"], ids("d1"))
    put(landing, "PSP_E", "2026-04-01", [f" {n} " for n in NAMES], [])
    (landing / "source=PSP_E" / "date=2026-04-02").mkdir(parents=True)
    (landing / "source=PSP_E" / "date=2026-04-02" / "none.csv").write_text("\n")
    banned = sorted(quality.BANNED_FIELDS)[0]
    put(landing, "PSP_B", "2026-04-02", [*NAMES, banned.upper()], ids("b2"))
    put(landing, "PSP_A", "2026-04-03", NAMES, [{"transaction_id": "a3"}])
    (landing / "source=PSP_A" / "date=2026-04-03" / "f.csv").write_text(",".join(NAMES) + "\n" + line(NAMES, psp="PSP_B") + "\n\n")  # rows of another source
    done = {(r.source, str(r.date)): (r.status, r.rows, r.columns) for r in ingest.load_landing(spark, str(landing), root).collect()}
    assert {k: v[0] for k, v in done.items()} == {
        ("PSP_A", "2026-04-01"): "staged", ("PSP_B", "2026-04-01"): "staged", ("PSP_C", "2026-04-01"): "quarantined", ("PSP_D", "2026-04-01"): "quarantined", ("PSP_E", "2026-04-01"): "staged",
        ("PSP_E", "2026-04-02"): "quarantined", ("PSP_B", "2026-04-02"): "quarantined", ("PSP_A", "2026-04-03"): "quarantined",
    }
    assert done[("PSP_C", "2026-04-01")][2] == [*NAMES, "card_number", "note"] and done[("PSP_E", "2026-04-01")][1:] == (0, NAMES) and done[("PSP_E", "2026-04-02")][2] == [""]
    assert staged(spark, root) == ["a1", "a2", "b1"]
    assert ledger.read_staged(spark, f"{root}/staged").where("transaction_id = 'b1'").first().settled_amount == 990
    told = problems(spark, root)
    assert {("PSP_C", "note", "unexpected"), ("PSP_D", "risk_score", "missing"), ("PSP_E", "", "unexpected"), ("PSP_B", banned.upper(), "banned"), ("PSP_A", "psp", "same_as")} <= told
    assert ("PSP_D", "risk_score", "null") not in told and not [x for x in told if x[0] == "PSP_B" and x[2] == "unexpected"]
    kept = spark.read.parquet(f"{root}/quarantine/rows")
    extra = {r.source: {x.name: x.value for x in r.extra} for r in kept.where("source = 'PSP_C'").collect()}
    assert extra["PSP_C"]["note"] == "one, two" and kept.where(F.exists("extra", lambda x: F.lower(x["name"]) == banned)).isEmpty()
    report = {(r.check_name, r.source): (r.status, r.detail) for r in ingest.ingest_report(ingest.latest(ingest.read_manifest(spark, root)), [], fail=False).collect()}
    assert report[("columns", "PSP_C")] == ("WARN", "new: card_number, note") and report[("columns", "PSP_D")] == ("WARN", "missing: risk_score") and report[("columns", "PSP_A")][0] == "PASS"
    assert report[("quarantine", "*")] == ("WARN", "5") and report[("overall", "*")][0] == "WARN"


def test_unexpected_columns_can_be_left_out(spark, tmp_path):
    landing, root = tmp_path / "landing", str(tmp_path / "lake")
    put(landing, "PSP_C", "2026-04-01", [*NAMES, "note"], ids("c1"))
    assert {r.status for r in ingest.load_landing(spark, str(landing), root, strict=False).collect()} == {"staged"} and staged(spark, root) == ["c1"]


def test_good_bad_good_and_lost_parts(spark, tmp_path):
    """What a file's last line says is held against what is stored."""
    landing, root = tmp_path / "landing", str(tmp_path / "lake")
    load = lambda: {(r.source, r.status) for r in ingest.load_landing(spark, str(landing), root).collect()}
    good = lambda: put(landing, "PSP_A", "2026-04-01", NAMES, ids("a1"))
    good()
    put(landing, "PSP_B", "2026-04-01", NAMES, ids("b1"))
    assert load() == {("PSP_A", "staged"), ("PSP_B", "staged")} and load() == set()
    put(landing, "PSP_A", "2026-04-01", NAMES, [{"transaction_id": "a1", "country": "ZZ"}])
    assert load() == {("PSP_A", "quarantined")} and staged(spark, root) == ["b1"] and load() == set()
    good()
    assert load() == {("PSP_A", "staged")} and staged(spark, root) == ["a1", "b1"]
    assert not list(Path(root, "quarantine").rglob("*.parquet")) and load() == set()
    shutil.rmtree(next(Path(root, "staged").glob("settle_month=*/file_psp=PSP_B")))
    assert load() == {("PSP_B", "staged")} and staged(spark, root) == ["a1", "b1"]
    # a second file of the same day shares the stored part; both are there afterwards, and only one line a file and load
    put(landing, "PSP_B", "2026-04-01", NAMES, ids("b2"), name="g.csv")
    assert load() == {("PSP_B", "staged")} and staged(spark, root) == ["a1", "b1", "b2"]
    put(landing, "PSP_B", "2026-04-01", NAMES, [{"transaction_id": "b2", "country": "ZZ"}], name="g.csv")
    assert load() == {("PSP_B", "staged"), ("PSP_B", "quarantined")} and staged(spark, root) == ["a1", "b1"] and ingest.load_landing(spark, str(landing), root).isEmpty()


def test_a_load_that_breaks_off_is_made_again(spark, tmp_path, monkeypatch):
    landing, root = tmp_path / "landing", str(tmp_path / "lake")
    put(landing, "PSP_A", "2026-04-01", NAMES, ids("a1"))
    put(landing, "PSP_B", "2026-04-01", NAMES, ids("b1"))
    ingest.load_landing(spark, str(landing), root)
    put(landing, "PSP_A", "2026-04-01", NAMES, [{"transaction_id": "a1", "country": "ZZ"}])
    put(landing, "PSP_B", "2026-04-01", NAMES, ids("b1", "b2"))

    def broken(*_):
        raise OSError("lost")

    for step in ("write_staged", "write_quarantine", "cleared"):
        with monkeypatch.context() as m, pytest.raises(OSError, match="lost"):
            m.setattr(ingest, step, broken)
            ingest.load_landing(spark, str(landing), root)
        assert "b1" in staged(spark, root)
        there = set(staged(spark, root)) | ({r.transaction_id for r in spark.read.parquet(f"{root}/quarantine/rows").collect()} if Path(root, "quarantine").exists() else set())
        assert {"a1", "b1"} <= there
    assert ingest.load_landing(spark, str(landing), root).count() == 2
    assert staged(spark, root) == ["b1", "b2"] and ingest.load_landing(spark, str(landing), root).isEmpty()


def test_only_touched_files_are_read(spark, tmp_path, monkeypatch):
    landing, root, seen = tmp_path / "landing", str(tmp_path / "lake"), []
    for day in range(1, 6):
        put(landing, "PSP_A", f"2026-04-0{day}", NAMES, ids(f"a{day}"))
    ingest.load_landing(spark, str(landing), root)
    put(landing, "PSP_A", "2026-04-06", NAMES, ids("a6"))
    plain = ingest.text_lines
    monkeypatch.setattr(ingest, "text_lines", lambda s, paths: seen.append(paths) or plain(s, paths))
    ingest.load_landing(spark, str(landing), root)
    assert seen and all(len(p) == 1 and "2026-04-06" in p[0] for p in seen) and len(staged(spark, root)) == 6


def test_volume_counts_settled_rows_up_to_the_report_s_date(spark):
    days = [(s, f"2026-04-{d:02d}", 50, ["x"], "staged") for s, n in (("A", 26), ("B", 24)) for d in range(1, n + 1)]
    files = spark.createDataFrame(days, "source string, date string, settled bigint, columns array<string>, status string").withColumn("date", F.col("date").cast("date"))
    report = {(r.check_name, r.source): (r.status, r.detail) for r in ingest.ingest_report(files, ["A", "B"], "2026-04-26", contract={"x": {}}).collect()}
    assert report[("volume", "A")][0] == "PASS" and report[("volume", "B")] == ("WARN", "2026-04-25, 2026-04-26") and report[("columns", "B")] == ("PASS", "")
    files = files.withColumn("settled", F.when((F.col("source") == "A") & (F.col("date") == F.lit("2026-04-20").cast("date")), 5).otherwise(F.col("settled")))
    assert {(r.source, r.detail) for r in ingest.ingest_report(files, [], "2026-04-24").where("check_name = 'volume' and status = 'WARN'").collect()} == {("A", "2026-04-20")}
