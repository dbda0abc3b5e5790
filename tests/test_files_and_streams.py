"""Partner files there and back, and the streaming match on files."""

from pyspark.sql import functions as F

from tallyspark.plans.fact import projected_fact
from tallyspark.sources import ingest, ledger
from tallyspark.streaming import match

SF = "/root/testdata/sf0.001"


def test_files_round_trip(spark, tmp_path):
    rows = ledger.projected_ledger(spark, SF).limit(200).persist()
    fmt = ingest.Format(sep=";", timestamps="dd/MM/yyyy HH:mm:ss", names={"transaction_id": "id", "auth_ts": "authorised"})
    ingest.land(rows, str(tmp_path / "landing"), fmt)
    read = ingest.read_files(spark, str(tmp_path / "landing"), fmt)
    good, bad, reasons = ingest.split_good(read)
    assert reasons.isEmpty() and bad.isEmpty() and read.agg(F.min("line")).first()[0] == 2
    ingest.write_staged(good, str(tmp_path / "staged"))
    ingest.write_staged(good, str(tmp_path / "staged"))
    back = ledger.read_staged(spark, str(tmp_path / "staged"))
    assert back.exceptAll(rows).isEmpty() and rows.exceptAll(back).isEmpty()
    found = ingest.file_hashes(spark, str(tmp_path / "landing"))
    ingest.append_manifest(found, read, reasons, str(tmp_path / "manifest"))
    assert ingest.new_files(found, spark.read.json(str(tmp_path / "manifest"))).isEmpty()


def test_bad_file_goes_as_a_whole(spark, tmp_path):
    rows = ledger.projected_ledger(spark, SF).limit(50).withColumn("country", F.when(F.col("psp") == "PSP_A", "XX").otherwise(F.col("country")))
    ingest.land(rows, str(tmp_path))
    good, bad, reasons = ingest.split_good(ingest.read_files(spark, str(tmp_path)))
    assert {r.psp for r in bad.select("psp").distinct().collect()} == {"PSP_A"} and good.where("psp = 'PSP_A'").isEmpty()
    assert {r.problem for r in reasons.collect()} == {"enum"}


def test_stream_matches_like_the_batch(spark, tmp_path):
    events = match.to_events(ledger.projected_ledger(spark, SF))
    for topic in ("auths", "settlements"):
        events.where(F.col("topic") == topic).select("value").coalesce(1).write.text(str(tmp_path / topic))
    read = lambda topic, schema: match.parsed(spark.readStream.text(str(tmp_path / topic)), schema)
    matched = match.match_settlements(read("auths", match.AUTHS), read("settlements", match.SETTLEMENTS))
    out = match.categorised(matched, ledger.projected_fx(spark), ledger.reference_tables(spark)["exponents"])
    match.run_to_sinks(out, str(tmp_path / "matched"), str(tmp_path / "large"), str(tmp_path / "checkpoint")).awaitTermination(120)
    got = match.read_matched(spark, str(tmp_path / "matched"))
    batch = projected_fact(spark, SF).where("status = 'settled'")
    assert got.count() == batch.count()
    assert {r.category: r.rate for r in match.compare_stream_batch(got, batch).collect()}["ALL"] == 1.0
    assert spark.read.json(str(tmp_path / "large")).select("key").distinct().count() == batch.where("category = 'large'").count()


def test_outer_matches_without_settlement_are_pending(spark):
    rows = ledger.projected_ledger(spark, SF)
    events = match.to_events(rows)
    auths, settlements = (match.parsed(events.where(F.col("topic") == t), k) for t, k in (("auths", match.AUTHS), ("settlements", match.SETTLEMENTS)))
    out = match.categorised(match.match_settlements(auths, settlements, how="leftOuter"), ledger.projected_fx(spark), ledger.reference_tables(spark)["exponents"])
    open_ = out.where("settle_ts is null")
    assert open_.count() == rows.where("status = 'pending'").count() and open_.where("category is not null").isEmpty() and out.where("category is null and settle_ts is not null").isEmpty()
