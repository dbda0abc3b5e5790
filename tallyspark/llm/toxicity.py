"""Toxicity: non-negative positive-unlabelled learning.

Confirmed toxic documents are the positives; a sample of all documents, whatever they are, is unlabelled. A linear classifier over the
presence of hashed words is trained in numpy on the class-prior-corrected risk

    prior * E_p[loss(+)] + max(0, E_u[loss(-)] - prior * E_p[loss(-)])

whose second part estimates the risk on the negatives, which nobody has labelled; where a step makes it negative, the step is taken
backwards, which keeps the classifier from fitting the unlabelled sample by heart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import batches, bucket, table, texts_of
from .words import alnum_words

#: Defaults: documents of the lowest hash of their id that the fit takes at most, confirmed ones and unlabelled ones.
POSITIVES, UNLABELLED = 4_000, 8_000
#: Words are hashed to so many places. A place gets a weight if so many documents of the sample have it and the shares of positive and of
#: unlabelled documents that have it differ by so many standard errors: chance passes fewer than one place in ten thousand.
PLACES, LEAST_DOCS, LEAST_ERRORS = 1 << 18, 4, 4.0
REMEMBERED = 1 << 18


def place(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) & (PLACES - 1)


class Places(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= REMEMBERED:
            self.clear()
        p = self[word] = place(word)
        return p


def sampled(docs: DataFrame, positive_ids: DataFrame, text: str, positives: int, unlabelled: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The word places of the positives and of the unlabelled sample; of an id with several texts the least one counts."""
    batches(docs.sparkSession)
    lowest = lambda ids, most: ids.select("doc_id").where("doc_id is not null").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    chosen = lowest(positive_ids, positives).withColumn("positive", F.lit(True)).union(lowest(docs, unlabelled).withColumn("positive", F.lit(False)))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Places()
        for batch in rows:
            sets = [np.fromiter({known[w] for w in alnum_words(t)}, "<i4").tobytes() for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([batch.column(batch.schema.get_field_index("positive")), pa.array(sets, pa.binary())], names=["positive", "places"])

    # the two limits bound what is broadcast and, as ids come once, what is collected
    once = docs.select("doc_id", text).join(F.broadcast(chosen), "doc_id").groupBy("doc_id", "positive").agg(F.min(text).alias(text))
    found = once.orderBy("doc_id").mapInArrow(run, "positive boolean, places binary").collect()
    return tuple([np.frombuffer(r.places, "<i4") for r in found if r.positive is kind] for kind in (True, False))


class Rows:
    """Documents as lists of word places, for products with weights."""

    def __init__(self, docs: list[np.ndarray], usable: np.ndarray) -> None:
        docs = [d[usable[d]] for d in docs]
        self.n = len(docs)
        self.places = np.concatenate(docs) if docs else np.zeros(0, np.int32)
        self.doc = np.repeat(np.arange(self.n), [len(d) for d in docs])

    def margins(self, w: np.ndarray, bias: float) -> np.ndarray:
        return bias + np.bincount(self.doc, weights=w[self.places], minlength=self.n)

    def gradient(self, slope: np.ndarray) -> tuple[np.ndarray, float]:
        return np.bincount(self.places, weights=slope[self.doc], minlength=PLACES), float(slope.sum())


def telling(positive: list[np.ndarray], unlabelled: list[np.ndarray]) -> np.ndarray:
    """Which places get a weight."""
    n, m = len(positive), len(unlabelled)
    a = np.bincount(np.concatenate(positive), minlength=PLACES)
    b = np.bincount(np.concatenate(unlabelled), minlength=PLACES)
    share = (a + b) / (n + m)
    error = np.sqrt(np.maximum(share * (1 - share), 1e-12) * (1 / n + 1 / m))
    return (a + b >= LEAST_DOCS) & (np.abs(a / n - b / m) >= LEAST_ERRORS * error)


def fit_nnpu(positive: list[np.ndarray], unlabelled: list[np.ndarray], prior: float, epochs: int = 150, rate: float = 0.05, ridge: float = 2e-4) -> tuple[np.ndarray, float]:
    """Weights and bias by the non-negative risk with the logistic loss; all zero weights and the prior's log-odds without positives."""
    prior = min(max(prior, 1e-3), 0.999)
    start = float(np.log(prior / (1 - prior)))
    if not positive or not unlabelled:
        return np.zeros(PLACES), start
    usable = telling(positive, unlabelled)
    p, u = Rows(positive, usable), Rows(unlabelled, usable)
    w, bias = np.zeros(PLACES), start
    m, v = np.zeros(PLACES + 1), np.zeros(PLACES + 1)
    sigmoid = lambda x: 1 / (1 + np.exp(-np.clip(x, -30, 30)))
    for epoch in range(1, epochs + 1):
        fp, fu = p.margins(w, bias), u.margins(w, bias)
        negative_risk = np.logaddexp(0, fu).mean() - prior * np.logaddexp(0, fp).mean()
        up, bu = u.gradient(sigmoid(fu) / u.n)
        pn, bn = p.gradient(prior * sigmoid(fp) / p.n)
        if negative_risk >= 0:
            pp, bp = p.gradient(-prior * sigmoid(-fp) / p.n)
            slope = np.append(up - pn + pp, bu - bn + bp)
        else:
            slope = np.append(pn - up, bn - bu)
        slope[:-1] += ridge * w * usable
        m, v = 0.9 * m + 0.1 * slope, 0.999 * v + 0.001 * slope**2
        step = rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.999**epoch)) + 1e-7)
        w, bias = w - step[:-1], bias - step[-1]
    return w, float(bias)


def score_toxicity(docs: DataFrame, labels: DataFrame, train: Column | None = None, text: str = "text", positives: int = POSITIVES, unlabelled: int = UNLABELLED) -> DataFrame:
    """``docs`` less ``text``, with score (0 to 1) and predicted (1 from 0.5 on), replacing columns of these names.

    ``labels`` has doc_id and toxic; of its rows where ``train`` holds, those with toxic 1 are the positives and the share of 1 among 0
    and 1 is the class prior (all of them are counted). At most ``positives`` of them and ``unlabelled`` documents, labelled or not, are fitted: those of the lowest
    hash of the id. A null text is scored as empty, by the bias alone. Rows with null ids are scored but not
    learnt from. Empty tables give an empty result; without positives every score is the prior (0.001 without labels).
    """
    batches(docs.sparkSession)
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1))
    rows = rows if train is None else rows.where(train)
    prior = rows.agg(F.avg(F.col("toxic").cast("double"))).first()[0] or 0.0
    w, bias = fit_nnpu(*sampled(docs, rows.where("toxic = 1"), text, positives, unlabelled), prior)
    held = docs.sparkSession.sparkContext.broadcast(w.astype(np.float32))
    base = docs.drop("score", "predicted")
    schema = T.StructType([*(T.StructField(f.name, f.dataType) for f in base.schema if f.name != text), T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, known = held.value, Places()
        for batch in batches_:
            at = batch.schema.get_field_index(text)
            margin = np.array([bias + float(weights[np.fromiter({known[x] for x in alnum_words(t)}, np.int64)].sum()) for t in texts_of(batch, text)])
            score = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
            rest = [i for i in range(batch.num_columns) if i != at]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in rest), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=[*(batch.schema.names[i] for i in rest), "score", "predicted"])

    return base.mapInArrow(run, schema)


def op5_toxicity(spark, sf_dir):
    """Scores of every text; null and empty texts are scored by the bias, rows with null or repeated ids row by row."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    scored = score_toxicity(docs.select("doc_id", "text"), labels, bucket("doc_id", 5) != 0)
    return scored.select("doc_id", (bucket("doc_id", 5) == 0).alias("held_out"), "score", "predicted")
