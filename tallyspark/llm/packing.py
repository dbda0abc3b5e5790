"""Best-fit packing of documents into sequences by patterns that non-negative least squares fits to the histogram of lengths.

Documents turn into pieces of at most LIMIT tokens: only longer documents are cut, and of those only the first piece may be shorter. What is
packed is the histogram of lengths, which has LIMIT entries whatever the corpus. Patterns are lengths of two or three pieces that fill a
sequence; non-negative least squares finds how often each is repeated so that together they use up the histogram. Repeats are rounded (never
beyond what is there), the fit is made again for what is left while that helps, and the rest is packed best fit first, the longest pieces first.

The plan says, for each length, which sequences its first, second, ... pieces go to. Pieces are numbered within their length in parallel:
each task numbers its own, and the tasks' counts are summed up. So no task or driver ever sees more than its own pieces and the plan.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import bpe_vocab as B
from .bpe_rounds import codec
from .common import batches, keep, slices, table, texts_of

#: Tokens in a sequence, the id that ends a document, bytes of texts that are coded together.
LIMIT, END_ID, AT_ONCE = 1024, 2, 1 << 20
#: Second lengths that go with a length, steps of a fit, least number of sequences that a further fit must settle, fits at most.
SECONDS, STEPS, WORTH, PASSES = 24, 600, 8, 6
#: A pattern leaves at most this part of a sequence empty.
SLACK = 256
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, part int, nth bigint"


def patterns(left: np.ndarray, limit: int) -> np.ndarray:
    """Patterns of two and three lengths, descending, that fill ``limit``; 0 stands for no third one. ``left`` counts pieces by length.

    With each length goes its complement and go ``SECONDS`` others, spread as the pieces are; the third one is the longest that fits. Patterns that leave
    more than a small part of the sequence empty are left out: pieces too short for patterns of three go to the best fit.
    """
    lengths = np.flatnonzero(left)
    fits = np.zeros(limit + 1, np.int64)
    fits[lengths] = lengths
    fits = np.maximum.accumulate(fits)  # the longest present length up to this one
    total = np.cumsum(left[lengths])
    found = []
    for a in lengths:
        end = np.searchsorted(lengths, min(a, limit - a), "right")
        if end:
            spread = np.searchsorted(total[:end], total[end - 1] * (np.arange(SECONDS) + 0.5) / SECONDS)
            b = lengths[np.unique(np.append(np.minimum(spread, end - 1), end - 1))]
            triples = np.stack([np.full(len(b), a), b, fits[limit - a - b]], axis=1)
            found.append(triples[triples.sum(axis=1) >= limit - limit // SLACK])
    return np.unique(np.sort(np.concatenate(found), axis=1)[:, ::-1], axis=0) if found else np.zeros((0, 3), np.int64)


def fit(found: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Repeats x >= 0 of the patterns that minimise the weighted squared difference of what they use from ``counts`` (by length; the longer the heavier).

    Accelerated projected gradients, started anew whenever the last step went against the gradient.
    """
    limit = len(counts) - 1
    weight = np.where(np.arange(limit + 1) > 0, np.arange(limit + 1) / limit, 0.0)

    def used(x: np.ndarray) -> np.ndarray:
        return sum(np.bincount(found[:, i], weights=x, minlength=limit + 1) for i in range(3))

    up = lambda r: (weight * r)[found].sum(axis=1)
    probe = np.ones(len(found))
    for _ in range(20):  # the largest eigenvalue, which bounds the step
        probe = up(used(probe))
        size = np.linalg.norm(probe)
        probe /= size
    x = ahead = np.zeros(len(found))
    pace = 1.0
    for _ in range(STEPS):
        slope = up(used(ahead) - counts)
        new = np.maximum(ahead - slope / (1.05 * size), 0.0)
        if (slope * (new - x)).sum() > 0:
            pace = 1.0
        faster = (1 + (1 + 4 * pace * pace) ** 0.5) / 2
        ahead = new + (pace - 1) / faster * (new - x)
        x, pace = new, faster
    return x


@dataclass
class Plan:
    """For each length, where its pieces go: the first ``counts[0]`` of them to sequences ``firsts[0]``, ``firsts[0]`` + 1, ... at ``offsets[0]``, and so on."""

    limit: int
    sequences: int = 0
    counts: dict[int, list[int]] = field(default_factory=dict)
    firsts: dict[int, list[int]] = field(default_factory=dict)
    offsets: dict[int, list[int]] = field(default_factory=dict)

    def add(self, lengths: list[int], repeats: int) -> None:
        """``repeats`` sequences that hold pieces of these lengths, one after the other."""
        at = 0
        for n in lengths:
            for held, value in ((self.counts, repeats), (self.firsts, self.sequences), (self.offsets, at)):
                held.setdefault(n, []).append(value)
            at += n
        self.sequences += repeats

    def arrays(self) -> dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """By length: the number of the piece from which on each entry holds, its first sequence, its offset."""
        begins = lambda c: np.cumsum([0, *c[:-1]])
        return {n: (begins(c), np.array(self.firsts[n]), np.array(self.offsets[n])) for n, c in self.counts.items()}


def best_fit(left: np.ndarray, plan: Plan) -> None:
    """Packs counts of lengths, the longest first, each piece where the least room stays; alike sequences are filled together."""
    limit = plan.limit
    rooms: list[int] = []  # ascending
    held: dict[int, list[tuple[list[int], int]]] = {}

    def put(lengths: list[int], repeats: int) -> None:
        room = limit - sum(lengths)
        if room not in held:
            held[room] = []
            rooms.insert(bisect_left(rooms, room), room)
        held[room].append((lengths, repeats))

    for n in range(limit, 0, -1):
        todo = int(left[n])
        while todo:
            at = bisect_left(rooms, n)
            if at == len(rooms):
                each = limit // n
                if todo // each:
                    put([n] * each, todo // each)
                if todo % each:
                    put([n] * (todo % each), 1)
                break
            room = rooms[at]
            lengths, repeats = held[room].pop()
            if not held[room]:
                del held[room]
                rooms.pop(at)
            each = min(room // n, todo)
            some = min(repeats, todo // each)
            put(lengths + [n] * each, some)
            if repeats > some:
                put(lengths, repeats - some)
            todo -= some * each
    for room in rooms:
        for lengths, repeats in held[room]:
            plan.add(lengths, repeats)


def plan_of(histogram: dict[int, int], limit: int = LIMIT) -> Plan:
    """The plan for so many pieces of each length."""
    left = np.zeros(limit + 1, np.int64)
    for n, count in histogram.items():
        left[n] = count
    plan = Plan(limit)
    if left[limit]:
        plan.add([limit], int(left[limit]))
        left[limit] = 0
    for _ in range(PASSES):
        found = patterns(left, limit)
        if not len(found):
            break
        x = fit(found, left.astype(float))
        before = plan.sequences
        for j in np.argsort(-x, kind="stable"):
            if x[j] < 0.5:
                break
            used, times = np.unique(found[j][found[j] > 0], return_counts=True)
            repeats = int(min(round(x[j]), (left[used] // times).min()))
            if repeats:
                plan.add([int(n) for n in found[j] if n], repeats)
                left[used] -= times * repeats
        if plan.sequences - before < WORTH:
            break
    best_fit(left, plan)
    return plan


def pieces(docs: DataFrame, vocab_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, text: str = "text", with_ids: bool = False) -> DataFrame:
    """The stored pieces of all documents: ``PIECES`` (and ``ids``, binary, with ``with_ids``); nth numbers the pieces of a length within their task (part)."""
    batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(B.read_vocab(vocab_path or B.default_path()))
    end, names = end_id.to_bytes(4, "little"), [c.split()[0] for c in PIECES.split(", ")] + ["ids"] * with_ids
    kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.binary()][: len(names)]

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, part, seen = codec(held.value), TaskContext.get().partitionId(), [0] * (limit + 1)
        for batch in rows:
            texts, doc_ids = texts_of(batch, "text"), batch.column(0).to_pylist()
            made: dict[str, list] = {c: [] for c in names}
            coded = (x for a, b in slices(texts, list(map(len, texts)), AT_ONCE) for x in c.encode(texts[a:b]))
            for doc_id, ids in zip(doc_ids, coded, strict=True):
                ids += end
                total = len(ids) // 4
                first = total if total <= limit else total % limit or limit
                for nth, start in enumerate([0, *range(first, total, limit)]):
                    n = limit if nth else first
                    cut = ids[4 * start : 4 * (start + n)]
                    row = (doc_id, nth, start, n, zlib.crc32(cut), part, seen[n], cut)
                    seen[n] += 1
                    for column, value in zip(made.values(), row, strict=False):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(made.values(), kinds, strict=True)], names=names)
        c.forget()

    return keep(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, PIECES + ", ids binary" * with_ids))


def numbered(made: DataFrame) -> DataFrame:
    """Pieces numbered within their length over all tasks: each task's numbers are moved by what the tasks before it have."""
    counts = made.groupBy("length", "part").agg(F.count("*").alias("_n"))  # at most one row for each length and task
    before = F.sum("_n").over(Window.partitionBy("length").orderBy("part")) - F.col("_n")
    moved = made.join(counts.select("length", "part", before.alias("_before")), ["length", "part"])
    return moved.withColumn("nth", F.col("nth") + F.col("_before")).drop("part", "_before")


def pack(docs: DataFrame, vocab_path: str | None = None, limit: int = LIMIT, end_id: int = END_ID, text: str = "text", with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset): where each piece of each document lies; with ``with_ids`` its token ids as well.

    A null text is an empty one, whose only token is the end. Rows with null or repeated ids are packed row by row; further columns aren't read; an empty
    table gives no rows. Sequences are numbered from 0 and have no gaps inside.
    """
    made = pieces(docs, vocab_path, limit, end_id, text, with_ids)
    histogram = {r[0]: r[1] for r in made.groupBy("length").count().collect()}  # at most ``limit`` rows
    plan = docs.sparkSession.sparkContext.broadcast(plan_of(histogram, limit).arrays())  # grows with the patterns, not with the corpus

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            length, nth = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("length", "nth"))
            sequence, offset = np.zeros(len(nth), np.int64), np.zeros(len(nth), np.int64)
            for n in np.unique(length):
                at = np.flatnonzero(length == n)
                begins, firsts, offsets = plan.value[n]
                entry = np.searchsorted(begins, nth[at], "right") - 1
                sequence[at], offset[at] = firsts[entry] + nth[at] - begins[entry], offsets[entry]
            kept = [c for c in batch.schema.names if c != "nth"]
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in kept), pa.array(sequence), pa.array(offset)], names=[*kept, "sequence_id", "offset"])

    columns = ["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids, "nth"]
    schema = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, " + "ids binary, " * with_ids + "sequence_id bigint, offset bigint"
    return numbered(made).select(*columns).mapInArrow(run, schema)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, n_tokens, doc_ids, ids): the packed sequences themselves, from the pieces with their ids; at most ``limit`` tokens each."""
    parts = F.sort_array(F.collect_list(F.struct("offset", "doc_id", F.hex("ids").alias("hex"))))
    ids = F.unhex(F.array_join(F.transform("parts", lambda p: p["hex"]), ""))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("parts")).select("sequence_id", "n_tokens", F.transform("parts", lambda p: p["doc_id"]).alias("doc_ids"), ids.alias("ids"))


def op12_pack(spark, sf_dir):
    """Where each piece of every document lies in sequences of at most 1024 tokens; null and empty texts are their end alone, rows with null or repeated ids are packed row by row."""
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
