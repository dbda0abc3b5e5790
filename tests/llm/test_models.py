"""Classifiers, the language model and nearest neighbours: held-out results, plain versions, odd tables."""

import math
import re
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from tallyspark.llm import ann, lm_score, mixing_model, quality, queries, toxicity

SF = "/root/testdata/sf0.01"


def test_toxicity_on_held_out_rows(spark):
    rows = queries.QUERIES["op5_toxicity"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.toxic for r in rows]) >= 0.9


def test_toxic_documents_are_told_apart(spark):
    """Held-out recall and precision, which an answer of all zeros would fail; the same when an id repeats."""
    sf = "/root/testdata/sf0.1"
    rows = queries.QUERIES["op5_toxicity"](spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("held_out").collect()
    toxic, called = {r.doc_id for r in rows if r.toxic == 1}, {r.doc_id for r in rows if r.predicted == 1 and r.toxic is not None}
    assert len(toxic & called) >= 0.75 * len(toxic) > 50 and len(toxic & called) >= 0.95 * len(called)


def test_samples_are_bounded(spark):
    """An id that repeats counts once."""
    docs = spark.createDataFrame([(1, "bad words")] * 50 + [(i, "good words") for i in range(2, 30)], "doc_id bigint, text string")
    positive, unlabelled = toxicity.sampled(docs, docs.where("doc_id = 1"), "text", 5, 10)
    assert len(positive) == 1 and len(unlabelled) == 10


def test_cut_is_the_best_level():
    draw = np.random.default_rng(3)
    for _ in range(20):
        good, bad = draw.normal(1, 1, 30), draw.normal(-1, 1, 40)
        levels = np.sort(draw.normal(0, 1.5, 50))
        cut = quality.best_cut(levels, good, bad)
        wrong = lambda c: int((good < c).sum() + (bad >= c).sum())
        assert min(wrong(x) for x in levels) == min(wrong(x) for x in levels[np.argsort(abs(levels - cut))[:2]])


def test_pairs_reach_the_least_loss():
    """No step in any direction betters the mean logistic loss over the pairs by much."""
    draw = np.random.default_rng(4)
    good, bad = draw.normal(0.3, 1, (60, quality.MEASURES)), draw.normal(0, 1, (60, quality.MEASURES))
    w = quality.fit_pairs(good, bad)
    loss = lambda w: np.logaddexp(0, -(good @ w)[:, None] + (bad @ w)[None, :]).mean()
    assert loss(w) < loss(np.zeros_like(w)) and all(loss(w + s * e) > loss(w) - 2e-3 for e in np.eye(len(w)) for s in (0.05, -0.05))


def test_quality_on_held_out_rows(spark):
    rows = queries.QUERIES["op7_quality_rank"](spark, SF).join(spark.read.parquet(f"{SF}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r.predicted == r.quality for r in rows]) >= 0.95


def test_odd_rows_are_scored(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1, 1), (6, 0, 0), (None, 1, 1), (5, None, None), (1, 1, 1), (99, 0, 0)], "doc_id bigint, quality int, toxic int")
    for score in (toxicity.score_toxicity, quality.rank_quality):
        got = score(odd_docs, labels).collect()
        assert len(got) == odd_docs.count() and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.5) for r in got)
        assert score(no_docs, labels).isEmpty() and score(odd_docs, labels.where("false")).count() == odd_docs.count()


def test_ranking_prefers_the_winners():
    draw = np.random.default_rng(0)
    good, bad = draw.normal(1, 1, (200, quality.MEASURES)), draw.normal(0, 1, (200, quality.MEASURES))
    w = quality.fit_pairs(good, bad)
    assert ((good @ w)[:, None] > (bad @ w)[None, :]).mean() > 0.95


def test_base_scores_and_totals(spark):
    sf = "/root/testdata/sf0.001"
    low = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    tokens = {r.doc_id: re.findall(r"[^\x20\x09-\x0D]+", low(r.text or "")) + ["\n"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    c = Counter(w for i, ws in tokens.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in ws)
    n, v = sum(c.values()), len(c)
    for r in queries.QUERIES["op10_lm_score"](spark, sf).collect():
        ws = tokens[r.doc_id]
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(ws), sum(w in c for w in ws), n)
        assert math.isclose(r.base_score, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), rel_tol=1e-9) and r.score < 0


def test_decisions_spell_words():
    """The probabilities of all one-byte continuations sum to one, since decisions are a binary code."""
    singles, after_th = np.zeros((256, 256)), np.zeros(256)
    singles[32, 97:123] = np.arange(1, 27)
    after_th[[97, 101, 105]] = 5, 20, 3
    code = mixing_model.Code(singles, {ord("t") * 256 + ord("h"): after_th})
    for tree in (32, 256):
        assert math.isclose(sum(2.0 ** -int(code.size[tree * 256 + b]) for b in range(256)), 1.0)
    assert code.tree[ord("t") * 256 + ord("h")] == 256 and code.tree[ord("s") * 256 + ord("h")] == ord("h")


def test_shares_of_own_words():
    """Equal to counting from the document's beginning."""
    docs = [[1, 2, 1, 2, 3, 1, 2], [2], [1, 1, 1, 2, 1, 1]]
    _, shares = mixing_model.OwnWords().shares(np.array(sum(docs, [])), np.array([len(d) for d in docs]))
    expected = []
    for d in docs:
        for i, w in enumerate(d):
            followed = [d[j] for j in range(1, i) if d[j - 1] == d[i - 1]] if i else []
            expected.append((d[:i].count(w) / max(i, 1), followed.count(w) / max(len(followed), 1)))
    assert np.allclose(shares, expected)


def test_odd_texts_are_scored(odd_docs, no_docs):
    got = lm_score.score(odd_docs, F.lit(True)).collect()
    assert len(got) == odd_docs.count() and all(r.score <= 0 and r.n_tokens >= 1 for r in got)
    assert lm_score.score(no_docs, F.lit(True)).isEmpty()
    assert lm_score.score(odd_docs, F.lit(False)).agg(F.max("n_known")).first()[0] == 0


def test_neighbours_found(spark):
    rows = spark.read.parquet(f"{SF}/embeddings.parquet").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    got = {}
    for r in queries.QUERIES["op4_nearest"](spark, SF).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    hits = 0
    for q, v in zip(ids, x, strict=True):
        if q % 20 == 0:
            others, s = ids[ids != q], (x @ v)[ids != q]
            hits += len({n for n, _ in got[q].values()} & set(others[np.lexsort((others, -s))[:20]]))
            assert all(math.isclose(s[others == n][0], y, rel_tol=1e-12) for n, y in got[q].values()) and sorted(got[q]) == list(range(1, 21))
    assert hits >= 0.9 * 20 * len(got)


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0, 0.0]), (20, [0.0, 0.0, 0.0]), (40, None), (1, [1.0, None, 0.0]), (2, [float("nan"), 1.0, 0.0]), (3, [2.0, 0.0, 0.0]), (4, [2.0, 0.0, 0.0]), (5, [1.0]), (None, [9.0, 0.0, 0.0])]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>").withColumn("score", F.lit(1))
    got = [tuple(r) for r in ann.nearest(df, df.where("vec_id % 20 = 0")).orderBy("rank").collect()]
    assert got == [(0, 1, 3, 2.0), (0, 2, 4, 2.0)]
    assert ann.nearest(df.where("false"), df).isEmpty()
