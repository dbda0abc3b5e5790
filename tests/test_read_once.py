"""What the queries read of the fact and of the ledger's events: only what they ask for, once."""

from tallyspark.operators import marts, stats
from tallyspark.plans.fact import projected_fact
from tallyspark.sources import ledger
from tallyspark.streaming import match

SF = "/root/testdata/sf0.001"


def plan(df, part="optimizedPlan"):
    return getattr(df._jdf.queryExecution(), part)().toString()


def test_fact_is_read_by_column(spark):
    """F3 to F11: the held fact was decoded whole, from memory or disk, by each scan."""
    read = plan(projected_fact(spark, SF).select("psp"), "executedPlan")
    assert "InMemoryTableScan" not in read and "ReadSchema: struct<psp:string>" in read


def test_rank_correlation_reads_its_rows_once(spark):
    """both ranks looked at the rows again."""
    rows = spark.range(400).selectExpr("id % 3 g", "id * 7 % 50 a", "id * id % 41 b")
    out = stats.spearman(rows, "a", "b", ["g"])
    assert "Range (" not in plan(out)
    local = rows.toPandas()
    want = {g: part["a"].rank().corr(part["b"].rank()) for g, part in local.groupby("g")}
    assert all(abs(r.rho - want[r.g]) < 1e-9 for r in out.collect())


def test_ranges_by_halving_keep_ranks(spark):
    values = [(0, float(v)) for v in [*range(700), *range(0, 700, 3), -5, 1e9]]
    df = spark.createDataFrame(values, "g int, v double")
    want = df.toPandas()["v"].rank()
    got = {r.v: r["rank"] for r in stats.tie_ranks(df, "v", ["g"]).collect()}
    assert all(got[v] == w for (_, v), w in zip(values, want, strict=True))


def test_segments_are_told_of_sums(spark):
    """every row was repeated for each kind of segment."""
    text = plan(marts.segment_mart(projected_fact(spark, SF)))
    at = text.index("Generate explode")
    assert "Aggregate" in text[at:]


def test_one_topic_makes_no_values_of_the_other(spark):
    """an authorisation's scan wrote the settlements' JSON too."""
    text = plan(match.to_events(ledger.projected_ledger(spark, SF)).where("topic = 'auths'"))
    assert text.count("StructsToJson") == 1 and "Union" not in text
