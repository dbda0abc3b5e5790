import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="session")
def odd_docs(spark):
    """Nulls, empty and very long texts, repeated rows, and further columns whose names the operators use themselves."""
    text = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau"
    rows = [(1, text), (2, None), (3, ""), (4, "  \n "), (None, text), (5, text + " upsilon"), (6, "word " * 40000), (7, "é漢字 <|endoftext|> \U0001f600 naïve"), (8, "x" * 30000), (1, text)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    return df.withColumns({c: F.lit(1) for c in ("score", "node", "key", "ids", "license", "n_tokens", "secrets", "row", "shard", "rank")})


@pytest.fixture(scope="session")
def no_docs(odd_docs):
    return odd_docs.where("false")
