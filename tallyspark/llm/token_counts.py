"""Token counts: how many tokens a byte-pair vocabulary makes of each text, without making the tokens.

Each word is a doubly linked list of its bytes. A heap holds the adjacent pairs that the vocabulary merges; the pair of the
lowest rank is popped and merged until none is left. The count is the number of initial symbols less the number of merges;
no token ids are emitted. Words recur, so each worker remembers the counts of a bounded number of them.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import bpe_vocab as B
from .common import batches, texts_of


class Counts(dict):
    """Word -> its number of tokens, filled on demand."""

    def __init__(self, v: B.Vocab) -> None:
        self.first = v.first
        self.rank = {(a, b): (i, ab) for i, (a, b, ab) in enumerate(v.merges)}

    def __missing__(self, word: str) -> int:
        if len(self) >= B.REMEMBERED:
            self.clear()
        data = word.encode("utf-8", "surrogatepass")
        n = self[word] = len(data) - self.merges(data)
        return n

    def merges(self, data: bytes) -> int:
        """Merges that ``data`` undergoes. A heap entry is void once either symbol has changed."""
        rank, n, done = self.rank, len(data), 0
        symbol = [self.first[b] for b in data]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(*rank[p], i, *p) for i, p in enumerate(zip(symbol, symbol[1:], strict=False)) if p in rank]
        heapify(heap)
        while heap:
            _, made, i, left, right = heappop(heap)
            j = after[i]
            if symbol[i] != left or j >= n or symbol[j] != right:
                continue
            symbol[i], symbol[j], k = made, -1, after[j]
            after[i] = k
            done += 1
            if k < n:
                before[k] = i
                if (p := (made, symbol[k])) in rank:
                    heappush(heap, (*rank[p], i, *p))
            if (h := before[i]) >= 0 and (p := (symbol[h], made)) in rank:
                heappush(heap, (*rank[p], h, *p))
        return done


class ChunkCounts(dict):
    """Chunk that follows a space -> tokens of the space and the chunk."""

    def __init__(self, counts: Counts) -> None:
        self.counts = counts

    def __missing__(self, chunk: str) -> int:
        if len(self) >= B.REMEMBERED:
            self.clear()
        words = B.WORDS.findall(" " + chunk)
        # a chunk that is one word is remembered here only
        n = self[chunk] = len(d := words[0].encode()) - self.counts.merges(d) if len(words) == 1 else sum(map(self.counts.__getitem__, words))
        return n


@lru_cache(maxsize=2)
def counters(text: str) -> tuple[B.Vocab, Counts, ChunkCounts]:
    v = B.vocab(text)
    return v, (c := Counts(v)), ChunkCounts(c)


def token_counts(docs: DataFrame, vocab_path: str | None = None, limit: int = 1024, text: str = "text") -> DataFrame:
    """``docs`` with n_bytes, n_tokens and over_limit (n_tokens > limit) added; existing columns of these names are replaced.

    A null text counts as empty: 0 bytes, 0 tokens. Repeated rows, null ids and further columns pass through; an empty table gives an
    empty result. Special strings inside a text count as one token each. Very long texts cost n log n.
    """
    spark = docs.sparkSession
    batches(spark)
    held = spark.sparkContext.broadcast(B.read_vocab(vocab_path or B.default_path()))
    added = {"n_bytes": "bigint", "n_tokens": "bigint"}
    base = docs.drop(*added, "over_limit")
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in base.schema), *(f"{k} {t}" for k, t in added.items())])

    def count(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v, words, led = counters(held.value)
        for batch in rows:
            texts = texts_of(batch, text)
            n = [sum(B.by_chunk(t, v, words.__getitem__, led.__getitem__, lambda _: 1)) for t in texts]
            size = [len(t.encode("utf-8", "surrogatepass")) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(size, pa.int64()), pa.array(n, pa.int64())], names=[*batch.schema.names, *added])

    return base.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)


def op6_token_counts(spark, sf_dir):
    """Token counts of every text; null and empty texts count 0, rows with null or repeated ids are counted row by row."""
    from .common import table

    return token_counts(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
