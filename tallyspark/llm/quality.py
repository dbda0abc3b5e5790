"""Quality classifier: Bradley-Terry ranking of documents from preference pairs.

Each text gives a short vector of measures (shares of letters, symbols, repeated lines, known function words and the like). A pair is a
good and a bad labelled document; the model says that the good one wins with probability sigmoid(w . (good - bad)), and w is fitted by
logistic loss on these differences. A document's strength is w . measures. Documents are then accepted from a quantile of the strengths of
all documents on: of ``LEVELS`` quantiles the one that the training labels bear out best.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bpe_codec import with_columns
from .common import batches, bucket, give_back, keep, table, texts_of
from .words import DIGITS, LOWER, UPPER, alnum_words

#: Default of the labelled rows of each class that the fit takes at most (those of the lowest hash of their id), and opponents of each row.
LABELLED, OPPONENTS = 10_000, 8
LEVELS = 512
#: Frequent function words of the four languages.
COMMON = frozenset("the of and to in is it that was for on with as at this de la le les et des en un une que qui pour dans du el los las y por con para der die und das den von mit ist zu ein".encode().split())
SPACE, STOPS = b" \t\n\r\x0b\x0c", b".,;:?!"
MEASURES = 16


def measures(text: str) -> list[float]:
    """What the ranking looks at; all zero but the last for a text without words."""
    raw = text.encode("utf-8", "surrogatepass")
    words = alnum_words(text)
    n, w = max(len(raw), 1), max(len(words), 1)
    without = lambda drop: (len(raw) - len(raw.translate(None, drop))) / n
    upper, lower, digits, space, stops = map(without, (UPPER, LOWER, DIGITS, SPACE, STOPS))
    high = sum(b >= 0x80 for b in raw) / n if not raw.isascii() else 0.0
    lines = [x for x in raw.split(b"\n") if x]
    tokens = raw.split()
    shouted = raw.count(b"!") / w
    return [
        upper, lower, digits, space, stops, high, max(0.0, 1 - upper - lower - digits - space - stops - high), min(shouted, 2.0),
        len(set(words)) / w, 1 - len(set(lines)) / max(len(lines), 1), sum(x in COMMON for x in words) / w, min(sum(map(len, words)) / w, 30) / 30,
        sum(not t[-1:].isalnum() for t in tokens) / max(len(tokens), 1), min(np.log1p(len(words)), 12) / 12, min(len(tokens) / max(len(lines), 1), 200) / 200, 1.0,
    ]


@F.arrow_udf(T.ArrayType(T.DoubleType()))
def measured(texts: pa.Array) -> pa.Array:
    """The measures of each text; null counts as empty."""
    give_back()
    return lists([measures(t or "") for t in texts.to_pylist()])


def lists(rows: list[list[float]]) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(range(0, MEASURES * len(rows) + 1, MEASURES), pa.int32()), pa.array([x for r in rows for x in r], pa.float64()))


def with_measures(docs: DataFrame, text: str = "text", name: str = "measures") -> DataFrame:
    """``docs`` with the measures of each text; null counts as empty."""
    batches(docs.sparkSession)
    base, schema = with_columns(docs, {name: "array<double>"})

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = lists([measures(t) for t in texts_of(batch, text)])
            yield pa.RecordBatch.from_arrays([*batch.columns, out], names=[*batch.schema.names, name])

    return base.mapInArrow(run, schema)


def fit_pairs(good: np.ndarray, bad: np.ndarray, steps: int = 400, ridge: float = 1e-4) -> np.ndarray:
    """Weights of the Bradley-Terry model; zeros if a class has no rows."""
    if not len(good) or not len(bad):
        return np.zeros(MEASURES)
    draw = np.random.default_rng(7)
    spread = np.maximum(np.vstack([good, bad]).std(axis=0), 1e-6)
    m = max(len(good), len(bad))
    pairs = np.vstack([good[np.resize(draw.permutation(len(good)), m)] - bad[np.resize(draw.permutation(len(bad)), m)] for _ in range(OPPONENTS)]) / spread
    w, push, size = np.zeros(MEASURES), np.zeros(MEASURES), np.zeros(MEASURES)
    for step in range(1, steps + 1):
        lose = 1 / (1 + np.exp(np.clip(pairs @ w, -30, 30)))
        slope = ridge * w - pairs.T @ lose / len(pairs)
        push, size = 0.9 * push + 0.1 * slope, 0.99 * size + 0.01 * slope**2
        w = w - 0.1 * (push / (1 - 0.9**step)) / (np.sqrt(size / (1 - 0.99**step)) + 1e-8)
    return w / spread


def best_cut(levels: np.ndarray, good: np.ndarray, bad: np.ndarray) -> float:
    """Of the quantiles of all strengths, the cut with the fewest wrong training labels; the middle one of the longest run of equals."""
    if not len(levels):
        return 0.0
    wrong = np.searchsorted(np.sort(good), levels, "left") + len(bad) - np.searchsorted(np.sort(bad), levels, "left")
    best = np.flatnonzero(wrong == wrong.min())
    runs = np.split(best, np.flatnonzero(np.diff(best) > 1) + 1)
    run = max(runs, key=len)
    return float((levels[run[0]] + levels[run[-1]]) / 2)


class Ranking(NamedTuple):
    """A fitted ranking: weights of the measures, the strength from which documents are accepted, and the unit of strength."""

    weights: list[float]
    cut: float
    unit: float

    def score(self, measures: str | Column = "_measures") -> Column:
        """0 to 1, from 0.5 on for accepted documents."""
        strength = _strength(self.weights, measures)
        return 1 / (1 + F.exp(F.least(F.greatest((self.cut - strength) / self.unit, F.lit(-700.0)), F.lit(700.0))))


def _strength(weights: list[float], measures: str | Column) -> Column:
    return F.aggregate(F.zip_with(measures, F.array(*map(F.lit, weights)), lambda x, y: x * y), F.lit(0.0), lambda a, x: a + x)


def fit_ranking(measured: DataFrame, labels: DataFrame, train: Column | None = None, labelled: int = LABELLED) -> Ranking:
    """Fits the ranking to labelled rows of ``measured`` (doc_id, _measures), its cut to all rows.

    ``labels`` has doc_id and quality (0 or 1; other values and null ids are left out); only its rows where ``train`` holds are used, each
    class up to ``labelled`` ids of the lowest hash; of an id with several texts the least measures count. Without labels of either class everything is accepted with 0.5.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1))
    rows = (rows if train is None else rows.where(train)).select("doc_id", "quality").dropDuplicates()
    fitted = {}
    for q in (1, 0):  # at most ``labelled`` ids, so that they can be sent to all executors, and as many rows come back
        ids = rows.where(F.col("quality") == q).orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).select("doc_id")
        fitted[q] = np.array([r.m for r in measured.join(F.broadcast(ids), "doc_id", "left_semi").groupBy("doc_id").agg(F.min("_measures").alias("m")).orderBy("doc_id").collect()]).reshape(-1, MEASURES)
    weights = list(map(float, fit_pairs(fitted[1], fitted[0])))
    levels = measured.agg(F.percentile_approx(_strength(weights, "_measures"), [i / LEVELS for i in range(LEVELS + 1)], 10_000)).first()[0]
    good, bad = fitted[1] @ weights, fitted[0] @ weights
    both = np.concatenate([good, bad])
    return Ranking(weights, best_cut(np.array(levels or []), good, bad), max(float(both.std()), 1e-9) / 4 if len(both) else 1.0)


def rank_quality(docs: DataFrame, labels: DataFrame, train: Column | None = None, text: str = "text", labelled: int = LABELLED) -> DataFrame:
    """``docs`` less ``text``, with score (0 to 1; from 0.5 on the document is accepted) and predicted, replacing columns of these names.

    See ``fit_ranking`` for the labels. A null text is scored as empty. Rows with null ids are scored; repeated rows count as often as they
    occur. Without documents the result is empty.
    """
    held = keep(with_measures(docs.drop("score", "predicted"), text, "_measures").drop(text))
    return held.withColumn("score", fit_ranking(held, labels, train, labelled).score()).withColumn("predicted", (F.col("score") >= 0.5).cast("int")).drop("_measures")


def accepted(docs: DataFrame, labels: DataFrame, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that the ranking accepts, with their own columns.

    Null and empty texts are ranked by the measures of the empty text; rows with null or repeated ids are ranked row by row; without labels of either
    class all rows stay. Texts are measured twice, which spares a shuffle of them, and nothing but texts and measures passes through Python.
    """
    ranking = fit_ranking(keep(with_measures(docs.select("doc_id", text), text, "_measures").drop(text)), labels)
    return docs.where(ranking.score(measured(F.col(text))) >= 0.5)


def op7_quality_rank(spark, sf_dir):
    """Scores of every text; null and empty texts are scored by the measures of the empty text, rows with null or repeated ids row by row."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    ranked = rank_quality(docs.select("doc_id", "text"), labels, bucket("doc_id", 3) != 1)
    return ranked.select("doc_id", (bucket("doc_id", 3) == 1).alias("held_out"), "score", "predicted")
