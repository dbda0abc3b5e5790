"""Secret scans: base patterns, and formats inferred from what they find.

The base patterns label credentials of three kinds. From a bounded sample of each kind (at most ``LABELLED`` whole values of the lowest hash) a
probabilistic automaton is inferred, with the distribution of lengths; others are inferred from as many ordinary runs of the same characters of each
make-up (letters, digits, both, with signs). Every run of ``SHORTEST`` or more such characters in every text is then a candidate, credentials that the
base patterns found included: its margin is the log-likelihood of the best kind less that of the best ordinary automaton. A run outside base spans is a
secret if its margin reaches a cut that hardly any ordinary run kept back from learning reaches, and ``MARGIN`` nats at least. Base spans always stay; a
run that overlaps one adds nothing.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from heapq import nsmallest
from math import log

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .automata import Format
from .bpe_codec import with_columns
from .common import batches, give_back, keep, table, texts_of

#: The base patterns and their order.
KINDS = ("assign", "access", "hex", "format")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ASSIGN_HINTS = ("passw", "secret", "token", "api")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
#: Examples of each kind and make-up at most, least length of a run, least margin in nats, share of the ordinary runs kept back that the cut leaves out, margins that a worker remembers.
LABELLED, SHORTEST, MARGIN, LEFT_OUT, REMEMBERED = 400, 6, 15.0, 0.995, 1 << 16
EVEN = -log(67)  # of each character of a run
RUN = re.compile(rf"[A-Za-z0-9+/_.=-]{{{SHORTEST},}}")

Span = tuple[int, int, int]  # start, number of the kind, end


def base_spans(text: str) -> Iterator[tuple[Span, str]]:
    """Spans of the base patterns with the credential inside each."""
    low = text.lower()
    if any(h in low for h in ASSIGN_HINTS):
        for m in ASSIGN.finditer(text):
            if len(m[2]) >= 6:
                yield (m.start(), 0, m.end()), m[2]
    if "AKIA" in text:
        for m in ACCESS.finditer(text):
            if m.end() - m.start() >= 20:
                yield (m.start(), 1, m.end()), m[0]
    for m in HEX.finditer(text):  # runs of the class; those under 24 fail
        yield (m.start(), 2, m.end()), m[0]


def candidates(text: str, base: list[Span]) -> Iterator[tuple[int, int, str]]:
    """Runs, less full stops at their end, that overlap none of the base spans (in order of their starts)."""
    i = reached = 0
    for m in RUN.finditer(text):
        start, value = m.start(), m[0].rstrip(".")
        end = start + len(value)
        while i < len(base) and base[i][0] < end:
            reached = max(reached, base[i][2])
            i += 1
        if reached <= start and len(value) >= SHORTEST:
            yield start, end, value


def make_up(value: str) -> int:
    """Letters only, digits only, letters and digits, or with other signs."""
    return 0 if value.isalpha() else 1 if value.isdigit() else 2 if value.isalnum() else 3


def labelled(docs: DataFrame, text: str = "text", most: int = LABELLED) -> dict[int, list[str]]:
    """Credentials of each kind, at most ``most``, and under 3 ordinary runs, at most 2 * ``most`` of each make-up: those of the lowest hash in the whole table."""
    bound = {k: most if k < 3 else 2 * most for k in range(7)}

    def sample(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least: dict[int, dict[str, int]] = {k: {} for k in bound}
        highest = dict.fromkeys(bound, 1 << 63)
        for batch in rows:
            new: dict[int, set[str]] = {k: set() for k in bound}
            for t in texts_of(batch, text):
                found = sorted(base_spans(t))
                for (_, kind, _), value in found:
                    new[kind].add(value.rstrip("."))
                for _, _, value in candidates(t, [s for s, _ in found]):
                    new[3 + make_up(value)].add(value)
            for kind, values in new.items():
                least[kind] |= {v: r for v in values if (r := rank(v)) < highest[kind]}
                if len(least[kind]) > bound[kind]:
                    least[kind] = dict(nsmallest(bound[kind], least[kind].items(), key=lambda x: (x[1], x[0])))
                    highest[kind] = max(least[kind].values())
        data = [(k, v, r) for k, values in least.items() for v, r in values.items()]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in data], pa.int32()), pa.array([x[1] for x in data], pa.string()), pa.array([x[2] for x in data], pa.int64())], names=["kind", "value", "rank"])

    drawn = keep(docs.select(text).mapInArrow(sample, "kind int, value string, rank bigint").distinct())
    taken = {k: [r.value for r in drawn.where(F.col("kind") == k).orderBy("rank", "value").limit(n).collect()] for k, n in bound.items()}
    return {k: taken[k] for k in range(3)} | {3: [v for k in range(3, 7) for v in taken[k]]}


def rank(value: str) -> int:
    return xxhash.xxh3_64_intdigest(value) >> 1


class Formats:
    """What is inferred from examples: the formats of the kinds (0 to 2), of ordinary runs of each make-up (those under 3), and the cut.

    Runs without context may hold unlabelled credentials: those that have a length of some kind and that it explains better by ``margin`` nats than characters
    drawn evenly don't count as ordinary. Every second ordinary run is kept back from learning, to set the cut. A kind without examples has no format;
    without any kind nothing is inferred.
    """

    def __init__(self, examples: dict[int, list[str]], margin: float = MARGIN) -> None:
        self.kinds = [Format(v) for k, v in sorted(examples.items()) if k < 3 and v]
        ordinary: dict[int, list[str]] = {}
        suspect = lambda v: any(len(v) in f.lengths and f.log_likelihood(v) - len(v) * EVEN >= margin for f in self.kinds)
        for v in [v for v in examples.get(3, ()) if not suspect(v)] or [""]:
            ordinary.setdefault(make_up(v), []).append(v)
        self.ordinary = [Format(v[::2]) for _, v in sorted(ordinary.items())]
        self.known: dict[str, float] = {}
        kept_back = sorted(self.margin(x) for v in ordinary.values() for x in v[1::2])
        self.cut = max([margin, *kept_back[int(len(kept_back) * LEFT_OUT) :][:1]])

    def margin(self, value: str) -> float:
        """Nats by which the best kind explains the run better than the best ordinary format, and than characters drawn evenly."""
        if (known := self.known.get(value)) is not None:
            return known
        if not self.kinds:
            return float("-inf")
        found = max(f.log_likelihood(value) for f in self.kinds) - max(len(value) * EVEN, *(f.log_likelihood(value) for f in self.ordinary))
        if len(value) <= 32:
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[value] = found
        return found

    def spans(self, text: str) -> tuple[list[Span], list[Span]]:
        """Base spans, and all spans, in order of start and kind."""
        found = self.scored(text)
        return [s for s, _ in found if s[1] < 3], [s for s, _ in found]

    def scored(self, text: str) -> list[tuple[Span, float]]:
        """All spans in order of start and kind, with the margin of the credential in each."""
        base = sorted(base_spans(text))
        runs = ((s, e, self.margin(v)) for s, e, v in candidates(text, [s for s, _ in base]))
        return sorted([*((s, self.margin(v.rstrip("."))) for s, v in base), *(((s, 3, e), m) for s, e, m in runs if m >= self.cut)])


def learn_formats(docs: DataFrame, text: str = "text") -> Formats:
    batches(docs.sparkSession)
    return Formats(labelled(docs, text))


def scan(docs: DataFrame, formats: Formats | None = None, text: str = "text") -> DataFrame:
    """``docs`` with ``secrets``, an array of (kind, start, end, base, margin), replacing a column of that name.

    Offsets are code points, the end exclusive; spans of the kind ``format`` are the inferred ones (base false); margin is how much likelier the
    credential is as one of a learnt format than as an ordinary run, in nats. A null or empty text has no secrets. Null ids, repeated rows and further columns
    pass through; an empty table gives an empty result. Where the base patterns find no credentials, no format is inferred and all margins are minus infinity.
    """
    batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(formats or learn_formats(docs, text))
    base, schema = with_columns(docs, {"secrets": "array<struct<kind:string,start:int,end:int,base:boolean,margin:double>>"})
    kind_type = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_()), ("margin", pa.float64())]))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = [[{"kind": KINDS[k], "start": s, "end": e, "base": k < 3, "margin": m} for (s, k, e), m in held.value.scored(t)] for t in texts_of(batch, text)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(out, kind_type)], names=[*batch.schema.names, "secrets"])

    return base.mapInArrow(run, schema)


def redact(docs: DataFrame, mark: str = "[SECRET]", text: str = "text") -> DataFrame:
    """``docs`` whose texts have ``mark`` in place of each secret (overlapping spans as one); null stays null and empty stays empty.

    All rows and columns stay, whatever their ids; only texts pass through Python. An empty table gives an empty result.
    """
    batches(docs.sparkSession)
    held = docs.sparkSession.sparkContext.broadcast(learn_formats(docs, text))

    @F.arrow_udf(T.StringType())
    def masked(texts: pa.Array) -> pa.Array:
        give_back()
        return pa.array([None if t is None else without(t, held.value.spans(t)[1], mark) for t in texts.to_pylist()], pa.string())

    return docs.withColumn(text, masked(text))


def without(text: str, spans: list[Span], mark: str) -> str:
    out, done = [], 0
    for start, _, end in spans:
        if start >= done:
            out += [text[done:start], mark]
        done = max(done, end)
    return "".join([*out, text[done:]])


def op3_secret_scan(spark, sf_dir):
    """Secrets of every text; null and empty texts have none, rows with null or repeated ids are scanned row by row. Beyond the contract: n_format, and n_likely, the spans whose margin is positive."""
    found = scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("secrets", lambda s: s["base"])
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("bigint").alias(f"n_{kind}")
    likely = F.size(F.filter("secrets", lambda s: s["margin"] > 0)).cast("bigint").alias("n_likely")
    return found.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("secrets")).alias("spans"), count("format"), likely)
