"""The text queries that SQL can state, and the pipeline stage by stage against plain versions."""

import re

import corpus_pipeline
import numpy as np
import pytest
from compare import compare
from test_texts import components, low, plain_spans, shingles
from tokenizers import Tokenizer

from tallyspark.llm import bpe_vocab, queries
from tallyspark.llm.common import keep

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_rows_as_sql(spark, name):
    assert compare(spark, SF, queries.QUERIES[name], queries.ORACLE_SQL[name]) == ""


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    stages = dict(corpus_pipeline.STAGES)
    step = lambda name, d: keep(stages[name](spark, d, SF))
    texts = lambda d: {r.doc_id: r.text for r in d.collect()}

    good = step("quality", docs)
    assert good.columns == docs.columns
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = set(texts(good))
    assert np.mean([(i in kept) == (q == 1) for i, q in labels.items()]) >= 0.95

    single = step("near_duplicates", good)
    groups = components({i: shingles(t) for i, t in texts(good).items()}, percent=80)
    assert set(texts(single)) == set(groups.values()) and single.columns == docs.columns

    clean = step("decontamination", single)
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    runs = lambda t, n: {tuple(w[i : i + n]) for w in [word.findall(low(t))] for i in range(len(w) - n + 1)}
    bench = set().union(*(runs(r.text, min(10, len(word.findall(low(r.text)))) or 1) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()))
    lengths = {len(x) for x in bench}
    assert set(texts(clean)) == {i for i, t in texts(single).items() if not any(runs(t, n) & bench for n in lengths)}

    masked = step("secrets", clean)
    assert set(texts(masked)) == set(texts(clean)) and not any(plain_spans(t) for t in texts(masked).values())

    t = Tokenizer.from_file(bpe_vocab.default_path())
    final = corpus_pipeline.run(spark, SF).collect()
    want = texts(masked)
    assert {r.doc_id for r in final} == set(want) and all(r.lossless for r in final)
    assert all(np.frombuffer(r.ids, "<u4").tolist() == t.encode(want[r.doc_id], add_special_tokens=False).ids for r in final)


def test_stages_on_odd_tables(spark, odd_docs, no_docs):
    """Nulls, empty and long texts, repeated rows, clashing names: each stage keeps clean rows, their columns, and what its docstring says."""
    from collections import Counter

    from pyspark.sql import functions as F

    stages = dict(corpus_pipeline.STAGES)
    docs = odd_docs.withColumns({"lang": F.lit("en"), "source": F.lit("s"), "n_chars": F.length("text"), "_nth": F.lit(1), "hash": F.lit(2), "whole": F.lit(3), "_measures": F.lit(4), "id": F.lit(5)})
    ids = lambda d: Counter(r.doc_id for r in d.collect())
    for name, stage in stages.items():
        out = stage(spark, docs, SF)
        assert name == "tokens" or out.columns == docs.columns
        assert stage(spark, docs.where("false"), SF).isEmpty()
        if name in ("secrets", "tokens", "decontamination"):
            assert ids(out) == ids(docs)
    assert ids(stages["near_duplicates"](spark, docs, SF)) == {1: 1, 2: 1, 3: 1, 4: 1, None: 1, 6: 1, 7: 1, 8: 1}
    item = next(r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").orderBy("item_id").collect() if r.text and len(r.text.split()) >= 10)
    more = spark.createDataFrame([(None, item), (1, item), (9, "x y " + item), (None, None)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").unionByName(more)
    assert ids(stages["decontamination"](spark, both, SF)) == ids(docs) + Counter({None: 1})
