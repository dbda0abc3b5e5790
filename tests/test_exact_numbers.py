"""Exact quantiles against plain ones, money to the cent, and look-ups that find nothing."""

import random
import statistics
from collections import defaultdict
from decimal import ROUND_HALF_UP, Decimal

import pytest
from pyspark.sql import functions as F

from tallyspark.functions import money
from tallyspark.operators import marts, quality, questions
from tallyspark.operators.quantiles import exact_quantiles, medians, with_quantiles
from tallyspark.plans import fact
from tallyspark.sources import ledger

SF = "/root/testdata/sf0.001"


def plain(values, share):
    """Interpolated between the two nearest places."""
    values = sorted(values)
    place = (len(values) - 1) * share
    low = int(place)
    high = min(low + 1, len(values) - 1)
    return values[low] if place == low else values[low] + (values[high] - values[low]) * (place - low)


def test_quantiles_equal_plain_ones(spark):
    rnd = random.Random(5)
    rows = [("wide", "a", rnd.gauss(0, 1000)) for _ in range(20_001)] + [("hot", None, 0.0)] * 30_000 + [("hot", None, float(rnd.randint(-3, 3))) for _ in range(999)]
    rows += [("one", "b", 7.5), ("two", "b", 1.0), ("two", "b", 2.0), ("none", "b", None), ("odd", "b", float("-inf")), ("odd", "b", 5.0), ("odd", "b", 6.0), ("odd", "b", float("inf")), ("odd", "b", float("inf")), (None, None, 4.0), (None, None, None), ("skewed", "c", -1e300), *[("skewed", "c", 2.0**i) for i in range(500)]]
    df = spark.createDataFrame(rows, "k string, j string, x double").repartition(7)
    groups = defaultdict(list)
    for k, j, x in rows:
        if x is not None:
            groups[k, j].append(x)
    wanted = {"least": 0.0, "tenth": 0.1, "middle": 0.5, "high": 0.9, "most": 1.0}
    got = {(r.k, r.j): r for r in exact_quantiles(df, "x", ["k", "j"], wanted).collect()}
    assert got.keys() == groups.keys()
    for key, values in groups.items():
        for name, share in wanted.items():
            if key[0] == "odd" and name in ("tenth", "high"):
                continue  # between a number and infinity
            assert got[key][name] == pytest.approx(plain(values, share), rel=1e-12, abs=1e-9), (key, name)
    built_in = {(r.k, r.j): r.m for r in df.groupBy("k", "j").agg(F.median("x").alias("m")).collect()}
    grouped = df.groupBy("k", "j").agg(F.count("*").alias("n"))
    assert {(r.k, r.j): r.middle for r in with_quantiles(grouped, df, "x", ["k", "j"], {"middle": 0.5}).collect()} == built_in
    counted = df.groupBy("k", "j", "x").agg(F.count("*").alias("often"))
    assert {(r.k, r.j): r.middle for r in exact_quantiles(counted, "x", ["k", "j"], {"middle": 0.5}, "often").collect()} == {k: v for k, v in built_in.items() if v is not None}


def test_medians_of_several_columns(spark):
    df = spark.createDataFrame([(1, 2.0), (3, None), (10, 4.0), (None, None)], "a int, b double")
    assert tuple(medians(df, {"a": F.col("a"), "b": F.col("b"), "few": F.when(F.col("a") > 1, F.col("b")), "no": F.when(F.col("a") > 99, F.col("b"))}).first()) == (3.0, 3.0, 4.0, None)
    assert tuple(medians(df.where("false"), {"a": F.col("a")}).first()) == (None,)


def test_no_exact_median_buffer_is_left(spark):
    f = fact.projected_fact(spark, SF)
    plans = [marts.segment_mart(f), marts.lag_by_country_tier(f), quality.quality_metrics(f), quality.spec_metrics(f), questions.two_group(f, F.col("is_weekend")), questions.rate_frame(f, ["psp"])]
    for df in plans:
        text = df._jdf.queryExecution().optimizedPlan().toString()
        assert "median(" not in text and "percentile(" not in text and "percentile_cont(" not in text


def test_two_groups_of_an_empty_fact(spark):
    f = fact.projected_fact(spark, SF)
    assert questions.two_group(f.where("false"), F.col("is_weekend")).isEmpty()
    row = quality.quality_metrics(f.where("false")).first()
    assert row.n == 0 and row.n_psps == 0 and row.median_usd is None
    r = questions.two_group(f.where("status = 'settled'"), F.col("is_weekend")).first()
    losses = [-x.residual_usd for x in f.where("status = 'settled' and is_weekend and is_meaningful").select("residual_usd").collect()]
    assert r.median_loss_usd == pytest.approx(statistics.median(losses))


def test_cents_agree_with_decimals(spark):
    """10,000 amounts, whole ties and amounts beyond what doubles hold among them."""
    rnd = random.Random(11)
    rows = [(i, rnd.choice([1, -1]) * rnd.randrange(10 ** rnd.randint(1, 18)), rnd.choice([0, 2, 3]), Decimal(rnd.randrange(1, 10 ** rnd.randint(3, 11))) / 10**6) for i in range(9_000)]
    # halves: an odd number of half cents at a rate of 2, 4 or 8 units
    rows += [(9_000 + i, rnd.choice([1, -1]) * (2 * rnd.randrange(10**9) + 1), 2, Decimal(2)) for i in range(1_000)]
    rows += [(10_000, None, 2, Decimal(1)), (10_001, 5, 2, None), (10_002, 5, 2, Decimal(0)), (10_003, 0, 0, Decimal(950)), (10_004, 5, None, Decimal(1))]
    df = spark.createDataFrame(rows, "id int, minor bigint, e int, rate decimal(18,6)")
    got = df.select("id", money.usd_cents("minor", "e", "rate").alias("cents"), money.major_of("minor", "e").alias("major"), money.minor_of(money.major_of("minor", "e"), "e").alias("back")).collect()
    by_id = {r.id: r for r in got}
    for i, minor, e, rate in rows:
        r = by_id[i]
        if minor is None or e is None or not rate:
            assert r.cents is None
            continue
        scaled = int(rate * 10**6) * 10**e
        whole = (200 * abs(minor) * 10**6 + scaled) // (2 * scaled)
        if whole < 2**63:
            assert r.cents == (whole if minor >= 0 else -whole), (i, minor, e, rate)
        assert r.major == Decimal(minor).scaleb(-e) and r.back == minor
    tie = next(r for r in rows[9_000:10_000])
    assert by_id[9_000].cents == int((Decimal(tie[1]) / 2).quantize(Decimal(1), ROUND_HALF_UP))
    halves = spark.sql("select cast('0.005' as decimal(26,8)) a, cast('-0.005' as decimal(26,8)) b").select(money.minor_of("a", F.lit(2)), money.minor_of("b", F.lit(2))).first()
    assert tuple(halves) == (1, -1)


def test_an_unknown_currency_stops_the_build_and_other_losses_are_counted(spark):
    staged, fx, refs = ledger.stage_transactions(ledger.projected_ledger(spark, SF)), ledger.projected_fx(spark), ledger.reference_tables(spark)
    ids = [r[0] for r in staged.where("currency = 'MXN'").orderBy("transaction_id").limit(3).select("transaction_id").collect()]
    n = staged.count()
    assert {r.lookup: (r.n_rows, r.n_lost) for r in fact.lookup_losses(staged, fx, refs).collect()} == dict.fromkeys(("exponent", "vat", "fee", "rate of the auth day"), (n, 0))
    is_ = lambda i: F.col("transaction_id") == ids[i]
    odd = staged.withColumns({"currency": F.when(is_(0), "XXX").otherwise(F.col("currency")), "country": F.when(is_(1), "ZZ").otherwise(F.col("country")), "psp": F.when(is_(1) | is_(2), "PSP_Z").otherwise(F.col("psp"))})
    assert {r.lookup: r.n_lost for r in fact.lookup_losses(odd, fx, refs).collect()} == {"exponent": 1, "vat": 1, "fee": 2, "rate of the auth day": 1}
    with pytest.raises(Exception, match="unknown currency XXX"):
        fact.build_fact(odd, fx, refs).collect()
    assert fact.build_fact(odd.where(~is_(0)), fx, refs).count() == n - 3


def test_repeated_residuals_are_counted_as_by_a_window(spark):
    rows = [(str(i), "PSP_A" if i % 2 else None, "MXN", 0 if i < 500 else None if i < 800 else i % 7, "exact" if i < 500 else None if i < 800 else "large") for i in range(1000)]
    df = spark.createDataFrame(rows, "transaction_id string, psp string, currency string, residual bigint, category string")
    want = defaultdict(int)
    for _, psp, c, r, cat in rows:
        if cat == "large":
            want[psp, c, r] += 1
    got = fact.with_fee_repeats(df)
    assert got.columns == [*df.columns, "fee_repeats"] and got.count() == 1000
    assert all(r.fee_repeats == (want[r.psp, r.currency, r.residual] if r.category == "large" else None) for r in got.collect())
