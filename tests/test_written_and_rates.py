"""Identifiers in written files, and a stream whose reference tables are CSV files."""

import json
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from tallyspark.sources import ledger, written
from tallyspark.streaming import match

SF = "/root/testdata/sf0.001"
ID = "cus_0123456789ab"


def test_planted_identifiers_are_found_in_outputs_only(spark, tmp_path):
    for zone in ("raw", "out"):
        root = tmp_path / zone
        (root / "deep" / "source=A").mkdir(parents=True)
        (root / "deep" / "source=A" / "a.csv").write_text(f'id,x\n1,"{ID} and {ID}"\n2,cus_••••89ab\n')
        (root / "rows.jsonl").write_text(json.dumps({"k": 1, "who": {"id": ID}}) + "\n" + json.dumps({"note": 'the "pan": of a text'}) + "\n")
        spark.createDataFrame([(1, (ID,), "A"), (2, ("x",), "B")], "k int, who struct<id:string>, source string").write.partitionBy("source").parquet(str(root / "table"))
    (tmp_path / "raw" / "bad.csv").write_text('\ufeffid, "PAN"\n1,2\n')
    (tmp_path / "out" / "bad.jsonl").write_text(json.dumps({"k": {"deep": [{"Email": "hidden@value"}]}}) + "\n")
    spark.createDataFrame([(1, [(2,)])], "k int, cards array<struct<cvv:int>>").write.parquet(str(tmp_path / "raw" / "cards"))
    zones = {"raw": (str(tmp_path / "raw"), False), "reports": (str(tmp_path / "out"), True), "alerts": (str(tmp_path / "nothing"), True)}
    rows = written.scan_written(spark, zones).collect()
    got = {(r.zone, Path(r.file).name if r.field or "table" not in r.file else "table", r.problem, r.field): r.n for r in rows}
    assert got == {
        ("reports", "a.csv", "identifier", None): 2, ("reports", "rows.jsonl", "identifier", None): 1, ("reports", "table", "identifier", None): 1,
        ("raw", "bad.csv", "banned field", "PAN"): 1, ("reports", "bad.jsonl", "banned field", "Email"): 1, ("raw", "cards", "banned field", "cards.cvv"): 1,
    }
    assert not [r for r in rows if ID in str(r) or "hidden" in str(r)]
    with pytest.raises(ValueError, match="banned field") as told:
        written.scan_written(spark, zones, fail=True)
    assert ID not in str(told.value)
    assert written.scan_written(spark, {"alerts": zones["alerts"]}, fail=True).isEmpty()


def test_each_batch_sees_the_rates_of_its_time(spark, tmp_path):
    events = match.to_events(ledger.projected_ledger(spark, SF)).persist()
    rates, exponents = ledger.projected_fx(spark), ledger.reference_tables(spark)["exponents"]
    first = F.crc32("key") % 2 == 0

    def arrive(part, name: str) -> None:
        for topic in ("auths", "settlements"):
            rows = events.where(part & (F.col("topic") == topic)).select("value").collect()
            (tmp_path / topic).mkdir(exist_ok=True)
            (tmp_path / topic / name).write_text("".join(r.value + "\n" for r in rows))

    def publish(factor: float):
        rows = rates.select(match.RATES.split()[0], "currency", (F.col("local_per_usd") * factor).alias("local_per_usd")).collect()
        (tmp_path / "rates.csv").write_text("rate_date,currency,local_per_usd\n" + "".join(f"{r.rate_date},{r.currency},{r.local_per_usd!r}\n" for r in rows) + "broken,line\n")
        return spark.createDataFrame(rows, match.RATES)

    (tmp_path / "exponents.csv").write_text("currency,exponent\n" + "".join(f"{r.currency},{r.exponent}\n" for r in exponents.collect()))
    assert match.read_bounded_csv(spark, str(tmp_path / "exponents.csv"), "currency string, exponent int").exceptAll(exponents).isEmpty()
    price = match.priced_from_csv(str(tmp_path / "rates.csv"), str(tmp_path / "exponents.csv"))

    def go() -> None:
        read = lambda topic, schema: match.parsed(spark.readStream.text(str(tmp_path / topic)), schema)
        # no row is late here, since both halves span the same days
        matched = match.match_settlements(read("auths", match.AUTHS), read("settlements", match.SETTLEMENTS), late="400 days")
        match.run_to_sinks(matched, str(tmp_path / "matched"), str(tmp_path / "large"), str(tmp_path / "checkpoint"), price=price).awaitTermination(300)

    want = []
    for part, name, factor in ((first, "a.json", 1.0), (~first, "b.json", 2.0)):
        arrive(part, name)
        fx = publish(factor)
        go()
        auths, settlements = (match.parsed(events.where(part & (F.col("topic") == t)), k) for t, k in (("auths", match.AUTHS), ("settlements", match.SETTLEMENTS)))
        want.append(match.categorised(match.match_settlements(auths, settlements), fx, exponents))
    columns = ["transaction_id", "expected_settled", "residual", "residual_usd", "category"]
    got, both = match.read_matched(spark, str(tmp_path / "matched")).select(columns), want[0].unionByName(want[1]).select(columns)
    assert got.count() == both.count() > 100 and got.exceptAll(both).isEmpty()
    assert both.where("residual_usd <> 0").select("transaction_id").join(want[1].select("transaction_id"), "transaction_id").count() > 5
