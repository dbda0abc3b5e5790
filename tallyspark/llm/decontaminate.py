"""Benchmark decontamination with a distributed positional inverted index.

``build_index`` stores the postings of all training tokens, partitioned by document: each row of the index holds the documents of a
shard, their distinct words and, per word, the ascending positions where it occurs. ``search`` looks for phrases in every shard:
from the words of a phrase it takes the rarest one of the shard, shifts its postings by the word's offset in the phrase, and intersects
with the shifted postings of the next rarest words until all have agreed or nothing is left. ``search_near`` finds shards' places where
all words of a phrase lie within a span. Phrases are sent to the shards in blocks of bounded size, however many there are.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, keep, slices, table, texts_of
from .words import alnum_words

#: Tokens in a shard (a longer document is a shard of its own), phrases in a block, postings looked at together.
SHARD_TOKENS, BLOCK_PHRASES, STEP = 1 << 16, 1 << 16, 1 << 19
#: Words in a window of a benchmark item.
WINDOW = 10
INDEX_SCHEMA = "shard string, doc_id array<bigint>, n_words array<int>, words binary, starts binary, positions binary"


class Numbers(dict):
    """Word -> its number, in order of first sight."""

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        return n


def build_index(docs: DataFrame, text: str = "text") -> DataFrame:
    """The stored index of ``docs`` (doc_id and the text column are read; a null text has no words).

    Null ids and repeated rows are indexed row by row; no documents give an empty index. Rows of ``INDEX_SCHEMA``: starts[w] to
    starts[w + 1] delimit the positions of word w, which count the shard's tokens over all its documents; integers are little-endian.
    """
    batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        words: list[list[bytes]] = []
        held = 0
        for batch in rows:
            for i, t in zip(batch.column(0).to_pylist(), texts_of(batch, text), strict=True):
                w = alnum_words(t)
                if ids and held + len(w) > SHARD_TOKENS:
                    yield shard(ids, words)
                    ids, words, held = [], [], 0
                ids.append(i)
                words.append(w)
                held += len(w)
        if ids:
            yield shard(ids, words)

    return keep(docs.select(F.col("doc_id").cast("bigint"), text).mapInArrow(run, INDEX_SCHEMA))


def shard(ids: list, words: list[list[bytes]]) -> pa.RecordBatch:
    number, sizes = Numbers(), [len(w) for w in words]
    codes = np.fromiter((number[x] for w in words for x in w), np.int32, sum(sizes))
    starts = np.zeros(len(number) + 1, "<i4")
    np.cumsum(np.bincount(codes, minlength=len(number)), out=starts[1:])
    positions = np.argsort(codes, kind="stable").astype("<i4")
    values = [[uuid.uuid4().hex], [ids], [sizes], [b" ".join(number)], [starts.tobytes()], [positions.tobytes()]]
    kinds = [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(v, k) for v, k in zip(values, kinds, strict=True)], names=["shard", "doc_id", "n_words", "words", "starts", "positions"])


class Shard:
    """A shard's postings, ready for searches."""

    def __init__(self, n_words: list[int], words: bytes, starts: bytes, positions: bytes) -> None:
        self.number = {w: i for i, w in enumerate(words.split(b" "))} if words else {}
        self.starts, self.positions = np.frombuffer(starts, "<i4"), np.frombuffer(positions, "<i4")
        self.n = len(self.positions)
        self.doc_ends = np.cumsum(np.array(n_words, np.int64))
        self.often = np.diff(self.starts)
        #: (word, position) of all postings as one ascending number
        self.keys = np.repeat(np.arange(len(self.often), dtype=np.int64), self.often) * (self.n + 1) + self.positions

    def has(self, word: np.ndarray, position: np.ndarray) -> np.ndarray:
        """Whether each position is in the postings of its word."""
        wanted = word.astype(np.int64) * (self.n + 1) + position
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        return (self.keys[at] == wanted) & (position >= 0) & (position < self.n)

    def document(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.doc_ends, position, side="right")

    def numbers(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Phrases all of whose words the shard has: which ones, and their words by number (-1 behind their end)."""
        own = np.fromiter((self.number.get(w, -2) for w in block.words), np.int64, len(block.words))
        words = np.where(block.phrases >= 0, own[block.phrases], -1) if len(own) else block.phrases
        which = np.flatnonzero((words != -2).all(axis=1))
        return which, words[which]

    def exact(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """Phrases that occur and where each occurrence starts."""
        which, words = self.numbers(block)
        if not len(which):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        often = np.where(words >= 0, self.often[words], np.iinfo(np.int32).max)
        rarest_first = np.argsort(often, axis=1, kind="stable")
        length = (words >= 0).sum(axis=1)
        found = []
        lists = np.take_along_axis(often, rarest_first[:, :1], 1)[:, 0]
        for a, b in slices(which, lists.tolist(), STEP):
            rows = np.arange(a, b)
            n = lists[a:b]
            offset = rarest_first[a:b, 0]
            first = self.starts[words[rows, offset]]
            row = np.repeat(rows, n)
            place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)
            start = self.positions[place].astype(np.int64) - np.repeat(offset, n)
            for k in range(1, words.shape[1]):
                at = rarest_first[row, k]
                word = words[row, at]
                ok = (word < 0) | self.has(np.maximum(word, 0), start + at)
                row, start = row[ok], start[ok]
            inside = (start >= 0) & (start + length[row] <= self.n)
            row, start = row[inside], start[inside]
            inside = self.document(start) == self.document(start + length[row] - 1)
            found.append((which[row[inside]], start[inside]))
        return np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])

    def near(self, block: Block, span: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Phrases all of whose words lie within ``span`` tokens of one document in any order: (phrase, first position, end)."""
        which, words = self.numbers(block)
        out: list[tuple[int, int, int]] = []
        for p, row in zip(which.tolist(), words.tolist(), strict=True):
            row = sorted({w for w in row if w >= 0}, key=lambda w: self.often[w])
            rare = self.positions[self.starts[row[0]] : self.starts[row[0] + 1]].astype(np.int64)
            # the span starts at one of the words: at the rarest one or up to span - 1 before it
            for begin in np.unique((rare[:, None] - np.arange(span)[None, :]).ravel()):
                if begin < 0:
                    continue
                last, starts_here = begin, False
                doc_end = self.doc_ends[self.document(np.array([begin]))[0]]
                for w in row:
                    at = np.searchsorted(self.keys, w * (self.n + 1) + begin)
                    position = self.keys[at] - w * (self.n + 1) if at < len(self.keys) else self.n + 1
                    if position >= min(begin + span, doc_end):
                        break
                    last, starts_here = max(last, position), starts_here or position == begin
                else:
                    if starts_here:
                        out.append((p, int(begin), int(last) + 1))
        a = np.array(out, np.int64).reshape(-1, 3)
        return a[:, 0], a[:, 1], a[:, 2]


class Block:
    """Phrases as rows of word numbers, padded with -1, and the item of each."""

    def __init__(self, rows: list[tuple[bytes, str | None]]) -> None:
        number = Numbers()
        coded = [[number[w] for w in phrase.split(b" ")] for phrase, _ in rows]
        self.words = list(number)
        self.items = [item for _, item in rows]
        self.phrases = np.full((len(rows), max(map(len, coded), default=1)), -1, np.int64)
        for i, c in enumerate(coded):
            self.phrases[i, : len(c)] = c


def windows(benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """(phrase, item_id as text) of all runs of ``size`` words; an item of fewer words, but not none, is one phrase."""
    batches(benchmark.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for item, text in zip(batch.column(0).to_pylist(), texts_of(batch), strict=True):
                w = alnum_words(text)
                phrases = list({b" ".join(w[i : i + size]) for i in range(max(1, len(w) - size + 1))}) if w else []
                yield pa.RecordBatch.from_arrays([pa.array(phrases, pa.binary()), pa.array([item] * len(phrases), pa.string())], names=["phrase", "item_id"])

    return benchmark.select(F.col("item_id").cast("string"), "text").mapInArrow(run, "phrase binary, item_id string").distinct()


def blocks(phrases: DataFrame) -> Iterator[Block]:
    """One block at a time reaches the driver."""
    rows = ((bytes(r.phrase), r.item_id) for r in keep(phrases).toLocalIterator())
    while part := list(islice(rows, BLOCK_PHRASES)):
        yield Block(part)


HITS = "array<struct<start:int,end:int>>"
PASSAGES = "array<struct<item_id:string,start:int,end:int>>"


def search(index: DataFrame, phrases: DataFrame, span: int | None = None) -> DataFrame:
    """One row per indexed document: doc_id, n_words, hits (merged ranges of words inside any occurrence) and passages (ranges per item).

    ``phrases`` has phrase (binary, words joined by single spaces) and item_id (string; a null one marks words but names no item).
    Matches are exact phrases, or with ``span`` the places where all words of the phrase lie within so many tokens. Positions count
    the document's words from 0, ends are exclusive. No phrases: no hits.
    """
    spark = index.sparkSession
    batches(spark)
    schema = f"shard string, row int, doc_id bigint, n_words int, hits {HITS}, passages {PASSAGES}"
    parts = []
    for i, block in enumerate(blocks(phrases)):
        held = spark.sparkContext.broadcast(block)
        parts.append(index.mapInArrow(lambda rows, held=held, every=not i: (found for batch in rows for found in search_shards(batch, held.value, span, every)), schema))
    if not parts:
        empty = Block([])
        parts.append(index.mapInArrow(lambda rows: (found for batch in rows for found in search_shards(batch, empty, span, True)), schema))
    if len(parts) == 1:
        return parts[0].drop("shard", "row")
    every = reduce(DataFrame.unionByName, parts)
    merged = every.groupBy("shard", "row").agg(F.max("doc_id").alias("doc_id"), F.max("n_words").alias("n_words"), F.flatten(F.collect_list("hits")).alias("hits"), F.flatten(F.collect_list("passages")).alias("passages"))
    return merged.withColumn("hits", merged_ranges("hits")).withColumn("passages", F.array_sort(F.array_distinct("passages"))).drop("shard", "row")


def merged_ranges(ranges: str):
    """An array of ranges with those that touch or overlap joined."""
    last = lambda a: F.element_at(a, -1)
    joined = lambda a, x: F.concat(F.slice(a, F.lit(1), F.size(a) - 1), F.array(F.struct(last(a)["start"].alias("start"), F.greatest(last(a)["end"], x["end"]).alias("end"))))
    return F.aggregate(F.array_sort(ranges), F.array().cast(HITS), lambda a, x: F.when((F.size(a) > 0) & (last(a)["end"] >= x["start"]), joined(a, x)).otherwise(F.concat(a, F.array(x))))


def ranges(marked: np.ndarray) -> list[tuple[int, int]]:
    """Runs of true values."""
    edge = np.flatnonzero(np.diff(np.concatenate([[False], marked, [False]]).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True))


def search_shards(batch: pa.RecordBatch, block: Block, span: int | None, every: bool) -> Iterator[pa.RecordBatch]:
    for r in batch.to_pylist():
        s = Shard(r["n_words"], r["words"], r["starts"], r["positions"])
        if span is None:
            phrase, start = s.exact(block)
            end = start + (block.phrases[phrase] >= 0).sum(axis=1) if len(phrase) else start
        else:
            phrase, start, end = s.near(block, span)
        doc, begin = s.document(start), np.concatenate([[0], s.doc_ends])
        rows: dict[int, dict[str | None, list[tuple[int, int]]]] = {}
        for d, p, a, b in zip(doc.tolist(), phrase.tolist(), start.tolist(), end.tolist(), strict=True):
            rows.setdefault(d, {}).setdefault(block.items[p], []).append((a - int(begin[d]), b - int(begin[d])))
        out = []
        for d in range(len(r["doc_id"])) if every else sorted(rows):
            found = {i: joined(x) for i, x in rows.get(d, {}).items()}
            hits = joined([x for xs in found.values() for x in xs])
            passages = [{"item_id": i, "start": a, "end": b} for i, xs in sorted(found.items(), key=lambda x: x[0] or "") if i is not None for a, b in xs]
            out.append((r["shard"], d, r["doc_id"][d], r["n_words"][d], [{"start": a, "end": b} for a, b in hits], passages))
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])), pa.list_(pa.struct([("item_id", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names=["shard", "row", "doc_id", "n_words", "hits", "passages"])


def joined(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def contamination(docs: DataFrame, benchmark: DataFrame, size: int = WINDOW) -> DataFrame:
    """Per document: doc_id, n_words, hits and passages of the benchmark (see ``search``). Further columns of either table are not read.

    Null texts have no words. A repeated document or item counts row by row; a null item_id marks words but names no item.
    """
    return search(build_index(docs), windows(benchmark, size))


def op2_decontamination(spark, sf_dir):
    """Benchmark passages in every text; null and empty texts have no words, rows with null or repeated ids are searched row by row."""
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    items = F.array_sort(F.array_distinct(F.transform("passages", lambda p: p["item_id"])))
    n_hit = F.aggregate("hits", F.lit(0).cast("bigint"), lambda n, h: n + h["end"] - h["start"])
    return found.select("doc_id", F.col("n_words").cast("bigint").alias("n_words"), n_hit.alias("n_hit"), F.size(items).cast("bigint").alias("n_items"), F.sha2(F.array_join(items, ","), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))
