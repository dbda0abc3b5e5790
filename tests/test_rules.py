"""Rules on hand-made rows."""

import math

import pytest
from pyspark.sql import functions as F

from tallyspark.config import Thresholds
from tallyspark.functions import columns as X
from tallyspark.operators import incremental, marts, quality, stats
from tallyspark.plans import fact

COLUMNS = "id string, status string, currency string, exponent int, is_cross_border boolean, tax_recalc boolean, item_count int, risk_score double, authorized_amount bigint, settled_amount bigint, fx_auth double, fx_settle double"
ROWS = [
    (("rate moved", "settled", "MXN", 2, True, True, 1, 0.1, 100000, 101000, 18.0, 18.18), (0.0, "fx_tolerance", "fx_timing", None)),
    (("five percent", "settled", "CLP", 0, False, False, 1, 0.1, 95000, 90250, 950.0, 950.0), (-5.0, "meaningful", "psp_adjustment", "2–5%")),
    (("two cents", "settled", "MXN", 2, False, True, 1, 0.1, 900000, 899964, 18.0, 18.0), (-0.02, "fx_tolerance", "tax_recalc", None)),
    (("twenty dollars", "settled", "MXN", 2, False, True, 1, 0.1, 1000000, 960000, 20.0, 20.0), (-20.0, "large", "psp_adjustment", "≥ $20")),
    (("under twenty", "settled", "MXN", 2, False, True, 1, 0.1, 1000000, 960020, 20.0, 20.0), (-19.99, "meaningful", "psp_adjustment", "2–5%")),
    (("one unit", "settled", "CLP", 0, False, False, 1, 0.1, 95000, 94999, 950.0, 950.0), (0.0, "rounding", "psp_rounding", None)),
    (("open", "pending", "CLP", 0, False, False, 1, 0.1, 95000, None, 950.0, None), (None, None, None, None)),
    (("half captured", "settled", "MXN", 2, False, True, 2, 0.1, 100000, 50000, 18.0, 18.0), (-27.78, "large", "partial_capture", "> 5% and ≥ $20")),
    (("withheld", "settled", "ARS", 2, False, False, 1, 0.9, 10000000, 8500000, 1000.0, 1000.0), (-15.0, "large", "fraud_hold", "> 5%")),
    (("tax", "settled", "MXN", 2, False, True, 1, 0.1, 100000, 101000, 18.0, 18.0), (0.56, "fx_tolerance", "tax_recalc", None)),
    (("step", "settled", "COP", 2, True, True, 1, 0.1, 40012345, 40000000, 4000.0, 4000.0), (-0.03, "fx_tolerance", "psp_rounding", None)),
]


def test_categories_and_causes(spark):
    rows = spark.createDataFrame([r for r, _ in ROWS], COLUMNS)
    out = fact.with_money(rows).withColumns({"rounding_flag": X.on_rounding_step("settled_amount", "expected_settled", "exponent"), "fee_repeats": F.lit(1)})
    out = out.select("id", "residual_usd", "category", X.likely_cause().alias("cause"), X.why_flagged("category", "residual_pct", "residual_usd").alias("why"))
    assert {r.id: tuple(r)[1:] for r in out.collect()} == {r[0]: want for r, want in ROWS}


def test_masks_and_weeks(spark):
    row = spark.sql("select 'cus_8f2a91c07f3a' a, 'abc' b, cast(null as string) c, timestamp '2027-01-01 10:00:00' t").select(X.mask_id("a"), X.mask_id("b"), X.mask_id("c"), X.iso_week("t"), X.last_closed_end("t"), X.last_full_month("t", F.lit("2026-11-15"))).first()
    assert tuple(row)[:4] == ("cus_••••7f3a", "••••abc", None, "2026-W53")
    assert str(row[4]) == "2026-12-20" and row[5] == "2026-12"


def test_weeks_before_and_leaked_shares(spark):
    row = spark.sql("select '2026-W01' a, '2027-W01' b, '2026-W25' c, cast(null as string) d").select(X.monday_of("a"), X.prev_week("a"), X.prev_week("b"), X.trailing_weeks("c", 3), X.trailing_weeks("b", 2), X.prev_week("d")).first()
    assert str(row[0]) == "2025-12-29" and tuple(row)[1:] == ("2025-W52", "2026-W53", ["2026-W23", "2026-W24", "2026-W25"], ["2026-W53", "2027-W01"], None)
    assert tuple(spark.range(1).select(X.leak_share_pct(F.lit(3.0), F.lit(150.0)), X.leak_share_pct(F.lit(3.0), F.lit(0.0)), X.leak_share_pct(F.lit(3.0), F.lit(None).cast("double"))).first()) == (2.0, 0.0, 0.0)


def test_unknown_currency_is_an_error(spark):
    with pytest.raises(Exception, match="unknown currency"):
        spark.sql("select 'XXX' c").select(X.exponent_of("c", {"MXN": 2})).collect()


def test_thresholds_and_filters_are_checked():
    with pytest.raises(ValueError):
        Thresholds(fx_tolerance_pct=6)
    for wrong in ({"country": ("XX",)}, {"week": "2026-5"}, {"date_from": "2026-02-01", "date_to": "2026-01-01"}, {"xb": "maybe"}):
        with pytest.raises(ValueError):
            marts.Filters(**wrong)


def test_interval_of_a_share(spark):
    low, high = spark.range(1).select(*X.wilson(F.lit(10), F.lit(100))).first()
    assert (round(low, 3), round(high, 3)) == (0.055, 0.174)


def test_adjusted_p_values(spark):
    rows = spark.createDataFrame([(i, p) for i, p in enumerate([0.01, 0.04, 0.03, 0.5, None])], "i int, p double").withColumn("f", F.lit(1))
    got = [r.q for r in stats.benjamini_hochberg(rows, "p", ["f"], ["i"]).orderBy("i").collect()]
    assert [x and round(x, 4) for x in got] == [0.04, 0.0533, 0.0533, 0.5, None]


def test_tests_of_rates():
    assert math.isclose(stats.fisher(1, 9, 11, 3), 0.002759456, rel_tol=1e-6)
    assert math.isclose(stats.rate_test_p(30, 100, 15, 100), 0.0177, abs_tol=5e-4)
    assert stats.rate_test_p(0, 10, 0, 10) == 1.0


def test_rank_tests(spark):
    rows = spark.createDataFrame([(1, float(v), g) for v, g in ((5, True), (6, True), (7, True), (1, False), (2, False), (3, False))], "f int, v double, g boolean")
    r = stats.mann_whitney(rows, "v", F.col("g"), ["f"]).first()
    assert r.u == 9 and 0.02 < r.p < 0.05
    assert stats.spearman(rows.withColumn("w", F.col("v") * 2), "v", "w", ["f"]).first().rho == pytest.approx(1.0)


def test_late_rows_and_upsert(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "transaction_id string, v int")
    b = spark.createDataFrame([("y", 3), ("z", 4)], "transaction_id string, v int")
    assert sorted(map(tuple, incremental.delete_insert(a, b).collect())) == [("x", 1), ("y", 3), ("z", 4)]
    assert incremental.replay_lookback("2026-06-01", "2026-06-10 12:00:00") == 10


def test_contract_reports_by_file(spark):
    rows = spark.createDataFrame([("f1", 2, "1", "MX"), ("f1", 3, "x", "ZZ"), ("f2", 2, "3", "MX")], "file string, line int, item_count string, country string")
    got = {(r.file, r["column"], r.problem): (r.n, r.lines) for r in quality.contract_check(rows, {"item_count": {"type": "int", "min": 1}, "country": {"enum": ("MX",)}, "gone": {}}).collect()}
    assert got[("f1", "item_count", "type")] == (1, [3]) and got[("f1", "country", "enum")] == (1, [3])
    assert ("f2", "gone", "missing") in got and ("f2", "country", "enum") not in got


def test_dated_ranges(spark):
    dim = spark.createDataFrame([("a", "2026-01-01", "2026-03-01"), ("a", "2026-02-01", None), ("b", "2026-01-01", None)], "k string, valid_from string, valid_to string")
    assert [r.k for r in quality.range_overlaps(dim, "k").collect()] == ["a"]
