"""Ranked lexical search by the Best Position Algorithm over impact lists.

``build_index`` deals documents to shards and stores, for each shard and word, the list of the shard's documents by descending impact. A search
reads the lists of a query's words side by side. Each document that is met for the first time is looked up in all the other lists (direct
access), which marks its position there as seen as well. A list's best position is the last one up to which every position has been seen; the
sum of the weighted impacts there bounds whatever hasn't been met. Best positions run ahead of what has been read, so the bound is tighter than
the one at the last positions read. A search stops as soon as the bound is strictly below the k-th score: equal scores may still be won by a smaller id.

At scale: shards are bounded by tokens, and a task takes its shards one after the other with the k best of each query so far, so that later
shards stop early. What a task returns is k rows for each query. Queries go out in blocks of bounded size.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce
from math import floor, log

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import batches, keep, table, texts_of
from .words import alnum_words

#: Tokens in a shard (a longer document is a shard of its own), characters of queries in a block, entries that the first step reads of each list.
SHARD_TOKENS, BLOCK_CHARS, FIRST_READ = 1 << 20, 1 << 22, 32
#: Fixed values of the score: scale of impacts, factors of the occurrences and of the length, weight of the length in percent.
SCALE, PER_TERM, PER_LENGTH, PERCENT = 10**9, 1000, 12, 25
#: Groups in which the best rows of the tasks are ranked before they meet.
GROUPS = 64
INDEX_SCHEMA = "n_docs bigint, n_tokens bigint, doc_id binary, no_id binary, words binary, starts binary, docs binary, impacts binary"


def totals(docs: DataFrame, text: str = "text") -> tuple[int, int]:
    """(documents with at least one word, words of all documents with repeats)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = words = 0
        for batch in rows:
            for t in texts_of(batch, text):
                size = len(alnum_words(t))
                n, words = n + (size > 0), words + size
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([words], pa.int64())], names=["n", "words"])

    found = docs.select(text).mapInArrow(run, "n bigint, words bigint").agg(F.sum("n"), F.sum("words")).first()
    return found[0] or 0, found[1] or 0


class Numbers(dict):
    """Word -> its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored impact lists of ``docs`` (doc_id and the text are read), as rows of ``INDEX_SCHEMA``.

    A shard's documents ascend by id, those without one last; starts[w] to starts[w + 1] delimit the list of word w, which has documents (their numbers in the shard) by
    descending impact and then number. Null and empty texts have no words and aren't indexed; repeated rows and ids are indexed row by row.
    """
    batches(docs.sparkSession)
    n_docs, n_tokens = totals(docs, text)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        codes: list[np.ndarray] = []
        number, held = Numbers(), 0
        for batch in rows:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch, "text"), strict=True):
                w = alnum_words(t)
                if not w:
                    continue
                if ids and held + len(w) > SHARD_TOKENS:
                    yield shard(ids, codes, number, n_docs, n_tokens)
                    ids, codes, number, held = [], [], Numbers(), 0
                ids.append(i)
                codes.append(np.fromiter(map(number.__getitem__, w), np.int32, len(w)))
                held += len(w)
        if ids:
            yield shard(ids, codes, number, n_docs, n_tokens)

    return keep(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, INDEX_SCHEMA))


def shard(ids: list, codes: list[np.ndarray], number: Numbers, n_docs: int, n_tokens: int) -> pa.RecordBatch:
    order = sorted(range(len(ids)), key=lambda i: (ids[i] is None, ids[i] or 0))
    codes = [codes[i] for i in order]
    size = np.fromiter(map(len, codes), np.int64, len(codes))
    m = 100 - PERCENT + PERCENT * size * n_docs // n_tokens
    key = np.concatenate(codes).astype(np.int64) * len(codes) + np.repeat(np.arange(len(codes)), size)
    key, tf = np.unique(key, return_counts=True)
    word, doc = key // len(codes), key % len(codes)
    impact = SCALE * tf // (PER_TERM * tf + PER_LENGTH * m[doc])
    by_impact = np.lexsort((doc, -impact, word))
    starts = np.append(0, np.cumsum(np.bincount(word, minlength=len(number))))
    doc_id = np.array([ids[i] or 0 for i in order], "<i8")
    none = np.array([ids[i] is None for i in order], np.uint8)
    values = [x.tobytes() for x in (doc_id, none)] + [b" ".join(number)] + [x.tobytes() for x in (starts.astype("<i8"), doc[by_impact].astype("<i4"), impact[by_impact].astype("<i4"))]
    return pa.RecordBatch.from_arrays([pa.array([n_docs], pa.int64()), pa.array([n_tokens], pa.int64()), *(pa.array([v], pa.binary()) for v in values)], names=[c.split()[0] for c in INDEX_SCHEMA.split(", ")])


def document_counts(index: DataFrame, words: list[bytes]) -> dict[bytes, int]:
    """In how many documents each of these words occurs; one row for each word comes back."""
    number = index.sparkSession.sparkContext.broadcast({w: i for i, w in enumerate(words)})  # of one block of queries

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = np.zeros(len(number.value), np.int64)
        for batch in rows:
            for there, starts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                n = np.diff(np.frombuffer(starts, "<i8"))
                at = [(number.value[w], i) for i, w in enumerate(there.split(b" ")) if w in number.value]
                if at:
                    to, of = np.array(at).T
                    found[to] += n[of]
        hit = np.flatnonzero(found)
        yield pa.RecordBatch.from_arrays([pa.array(hit, pa.int64()), pa.array(found[hit], pa.int64())], names=["word", "n"])

    rows = index.select("words", "starts").mapInArrow(run, "word bigint, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r.word]: r.n for r in rows}


def term_weight(n_docs: int, df: int) -> int:
    return floor(1000 * log((2 * n_docs + 2) / (2 * df + 1)))


class Lists:
    """A shard's impact lists of the words that are asked for, with direct access by document."""

    def __init__(self, row: dict, asked: set[bytes]) -> None:
        self.doc_id, self.no_id = np.frombuffer(row["doc_id"], "<i8"), np.frombuffer(row["no_id"], np.uint8)
        self.starts, self.docs, self.impacts = np.frombuffer(row["starts"], "<i8"), np.frombuffer(row["docs"], "<i4"), np.frombuffer(row["impacts"], "<i4")
        self.number = {w: i for i, w in enumerate(row["words"].split(b" ")) if w in asked}
        self.held: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def of(self, word: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """(documents, impacts, position of each document of the shard or -1)."""
        i = self.number.get(word)
        if i is None:
            return None
        if i not in self.held:
            docs, impacts = self.docs[self.starts[i] : self.starts[i + 1]], self.impacts[self.starts[i] : self.starts[i + 1]].astype(np.int64)
            at = np.full(len(self.doc_id), -1, np.int32)
            at[docs] = np.arange(len(docs))
            self.held[i] = docs, impacts, at
        return self.held[i]


class Best:
    """The k best rows of a query so far: scores descending, then ids ascending, those without an id last."""

    def __init__(self, k: int) -> None:
        self.k, self.rows = k, (np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(0, np.int64))

    def add(self, score: np.ndarray, none: np.ndarray, doc_id: np.ndarray) -> None:
        score, none, doc_id = (np.concatenate(x) for x in zip(self.rows, (score, none, doc_id), strict=True))
        order = np.lexsort((doc_id, none, -score))[: self.k]
        self.rows = score[order], none[order], doc_id[order]

    def kth(self) -> int:
        """The score to be reached; 0 while there are fewer than k rows."""
        return int(self.rows[0][-1]) if len(self.rows[0]) == self.k else 0


def best_positions(lists: Lists, weights: list[tuple[bytes, int]], best: Best) -> int:
    """Adds the shard's best rows to ``best``; how many documents were looked up. Lists are read in steps that double, all to the same depth."""
    parts = [(w, part) for word, w in weights if (part := lists.of(word)) is not None]
    if not parts:
        return 0
    size = [len(p[0]) for _, p in parts]
    seen = [np.zeros(n, bool) for n in size]
    upto = [0] * len(parts)  # positions before it have all been seen
    met = np.zeros(len(lists.doc_id), bool)
    read, looked = 0, 0
    while True:
        step = FIRST_READ if not read else read
        new = np.unique(np.concatenate([p[0][read : read + step] for _, p in parts]))
        new = new[~met[new]]
        read += step
        if len(new):
            met[new] = True
            looked += len(new)
            score = np.zeros(len(new), np.int64)
            for (w, (_, impacts, at)), marks in zip(parts, seen, strict=True):
                where = at[new]
                there = where >= 0
                score[there] += w * impacts[where[there]]
                marks[where[there]] = True
            hit = np.flatnonzero((score > 0) & (score >= best.kth()))
            if len(hit):
                best.add(score[hit], lists.no_id[new[hit]], lists.doc_id[new[hit]])
        bound = 0
        for i, (w, (_, impacts, _)) in enumerate(parts):
            rest = seen[i][upto[i] :]
            upto[i] += int(rest.argmin()) if len(rest) and not rest.all() else len(rest)
            # what hasn't been met is behind the best position; the impact there bounds it
            if upto[i] < size[i]:
                bound += w * int(impacts[max(upto[i] - 1, 0)])
        if bound < max(best.kth(), 1) or read >= max(size):
            return looked


def search(index: DataFrame, queries: DataFrame, k: int = 20, text: str = "text") -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` documents with the highest scores above 0 for each row of ``queries`` (item_id and the text), the highest first.

    Equal scores go by ascending doc_id, rows without an id last. Queries without words, or whose words are nowhere, give no rows; null texts have no words;
    rows with a null or repeated item_id are queries of their own. An empty index gives no rows.
    """
    spark, schema = index.sparkSession, "query bigint, score bigint, no_id int, doc_id bigint, part int"
    numbered = keep(queries.select(F.col("item_id"), F.coalesce(F.col(text), F.lit("")).alias("text")).withColumn("query", F.monotonically_increasing_id()))
    # a block's queries come to the driver, which counts their words; a block has about BLOCK_CHARS characters
    chars = numbered.agg(F.sum(F.length("text"))).first()[0] or 0
    n_blocks = -(-chars // BLOCK_CHARS)
    first = index.select("n_docs").first()
    found = []
    for block in range(n_blocks if first else 0):
        rows = numbered.where(F.pmod(F.xxhash64("query"), F.lit(n_blocks)) == block).select("query", "text").collect()
        asked = [(r.query, Counter(alnum_words(r.text))) for r in rows]
        words = sorted(set().union(*(c for _, c in asked)))
        df = document_counts(index, words)
        weigh = lambda c: [(t, w) for t, n in sorted(c.items()) if t in df and (w := n * term_weight(first.n_docs, df[t])) > 0]  # noqa: B023, E731
        held = spark.sparkContext.broadcast([(q, weights) for q, c in asked if (weights := weigh(c))])
        found.append(index.mapInArrow(_scan(held, k), schema))
    if not found:
        return numbered.limit(0).select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("bigint").alias("doc_id"), F.lit(0).cast("bigint").alias("score"))
    rows = reduce(DataFrame.unionByName, found)
    order = [F.desc("score"), "no_id", "doc_id"]
    # the tasks' rows meet in groups first
    some = rows.withColumn("_nth", F.row_number().over(Window.partitionBy("query", F.col("part") % GROUPS).orderBy(*order))).where(F.col("_nth") <= k)
    best = some.withColumn("rank", F.row_number().over(Window.partitionBy("query").orderBy(*order))).where(F.col("rank") <= k)
    return best.join(numbered.select("query", "item_id"), "query").select("item_id", "rank", F.when(F.col("no_id") == 0, F.col("doc_id")).alias("doc_id"), "score")


def _scan(held, k: int):
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, part = held.value, TaskContext.get().partitionId()
        best = {q: Best(k) for q, _ in queries}
        asked = {t for _, weights in queries for t, _ in weights}
        for batch in rows:
            for i in range(batch.num_rows):
                lists = Lists({c: batch.column(batch.schema.get_field_index(c))[i].as_py() for c in ("doc_id", "no_id", "words", "starts", "docs", "impacts")}, asked)
                for q, weights in queries:
                    best_positions(lists, weights, best[q])
        for q, b in best.items():
            score, none, doc_id = b.rows
            if len(score):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(score), q), pa.int64()), pa.array(score), pa.array(none.astype(np.int32)), pa.array(doc_id), pa.array(np.full(len(score), part), pa.int32())], names=["query", "score", "no_id", "doc_id", "part"])

    return run


def op13_ranked_search(spark, sf_dir):
    """The 20 best documents of each benchmark item; see ``search`` for nulls, ties and repeated rows."""
    return search(build_index(table(spark, sf_dir, "documents").select("doc_id", "text")), table(spark, sf_dir, "benchmark"))
