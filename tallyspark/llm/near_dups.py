"""MinHash near-dedup with fast similarity sketches, banding, and exact verification of every link.

Sketch. In round i each shingle of a set is hashed into one of ``COORDINATES`` bins with the value i plus a fraction; a bin keeps its
least value. Rounds go on until all bins are filled, so that a large set needs about one pass. After as many rounds as there are bins
round COORDINATES + j puts every shingle into bin j, so that no bin stays empty. Two sets agree in each coordinate with a probability
equal to their Jaccard similarity, and the number of agreements is concentrated as for independent draws.

Banding. ``BANDS`` bands of ``ROWS`` coordinates: a pair of similarity s misses all with probability (1 - s^5)^25, under 5e-7 at 0.85
and under 5e-5 at 0.80.

Verification without emitting all pairs. Equal sets are one node. Every bucket has a leader, its least node; each other member is compared
with it on full sets, which settles most groups. Buckets that then still hold several components are compared within: their members are
dealt to blocks of bounded bytes and sets, a task counts the common shingles of two blocks by matrix products and returns only as many links as
connect what it found linked; members of a bucket's most frequent component meet only the rest. No bucket is capped, and no link that would join
two components is lost.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BinaryType

from .common import batches, give_back, keep, slices, table, texts_of
from .components import components
from .words import spaced_words

SHINGLE, COORDINATES, BANDS, ROWS, PERCENT = 5, 125, 25, 5, 85
#: Shingles that are sketched together, bytes and sets of a block of a bucket, shingles that are columns of a matrix at a time, members that a leader meets at a time.
STEP, BLOCK_BYTES, BLOCK_SETS, COLUMNS, PORTION = 1 << 18, 4 << 20, 1024, 4096, 256
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser with good avalanche."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


def shingle_set(text: str, size: int = SHINGLE) -> np.ndarray:
    """The distinct hashes, ascending, of all runs of ``size`` words; of the whole if it has fewer words; none without words."""
    words = spaced_words(text)
    n = len(words)
    if not n:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    if n < size:
        return mix(np.array([xxhash.xxh3_64_intdigest(b" ".join(words), seed=n)], np.uint64))
    run = h[: n - size + 1].copy()
    for i in range(1, size):
        run = run * _A + h[i : n - size + 1 + i]
    return np.unique(mix(run))


def sketches(sets: list[np.ndarray], t: int = COORDINATES) -> np.ndarray:
    """One row of ``t`` coordinates for each set, none of which is empty."""
    empty = np.uint64(0xFFFFFFFFFFFFFFFF)
    sizes = [len(s) for s in sets]
    values = np.concatenate(sets)
    owner = np.repeat(np.arange(len(sets)), sizes)
    bins = np.full(len(sets) * t, empty)
    seeds = np.arange(1, 2 * t + 1, dtype=np.uint64) * _A
    for i in range(t):
        g = mix(values + seeds[i])
        at = owner * t + ((g >> np.uint64(32)) * np.uint64(t) >> np.uint64(32)).astype(np.int64)
        np.minimum.at(bins, at, (np.uint64(i) << np.uint64(48)) | (mix(g) >> np.uint64(16)))
        open_ = (bins.reshape(-1, t) == empty).any(axis=1)
        if not open_.any():
            break
        left = open_[owner]
        values, owner = values[left], owner[left]
    else:
        for j in range(t):
            g = mix(values + seeds[t + j])
            np.minimum.at(bins, owner * t + j, (np.uint64(t + j) << np.uint64(48)) | (mix(g) >> np.uint64(16)))
    return bins.reshape(-1, t)


def band_keys(sketch: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    out = np.tile(mix(np.arange(1, bands + 1, dtype=np.uint64) * _C), (len(sketch), 1))
    parts = sketch.reshape(len(sketch), bands, rows)
    for r in range(rows):
        out = mix(out * _A + parts[:, :, r])
    return out.view(np.int64)


def digest(shingles: np.ndarray) -> bytes:
    return md5(shingles.tobytes(), usedforsecurity=False).digest()


@F.arrow_udf(BinaryType())
def node_of(texts: pa.Array) -> pa.Array:
    """The digest of a text's shingle set, empty without words."""
    give_back()
    sets = (shingle_set(t or "") for t in texts.to_pylist())
    return pa.array([digest(s) if len(s) else b"" for s in sets], pa.binary())


#: Spark writes a deterministic function once more into the null check that a join on its result adds, so that each task would hold two workers and hash each text twice.
node_of = node_of.asNondeterministic()


def signatures(docs: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, n_shingles, node, bands): node is a digest of the shingle set, null without words."""
    batches(docs.sparkSession)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            sets = [shingle_set(t) for t in texts_of(batch, text)]
            ids, sizes = batch.column(0), [len(s) for s in sets]
            for a, b in slices(sets, sizes, STEP):
                full = [s for s in sets[a:b] if len(s)]
                keys = iter(band_keys(sketches(full)) if full else ())
                bands = [next(keys).tolist() if n else None for n in sizes[a:b]]
                nodes = [digest(s) if len(s) else None for s in sets[a:b]]
                yield pa.RecordBatch.from_arrays([ids.slice(a, b - a), pa.array(sizes[a:b], pa.int64()), pa.array(nodes, pa.binary()), pa.array(bands, pa.list_(pa.int64()))], names=["doc_id", "n_shingles", "node", "bands"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).mapInArrow(run, "doc_id bigint, n_shingles bigint, node binary, bands array<bigint>")


def full_sets(docs: DataFrame, wanted: DataFrame, text: str = "text") -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id); shingles are ascending little-endian unsigned 64-bit integers."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            nodes = batch.column(batch.schema.get_field_index("node")).to_pylist()
            for node, t in zip(nodes, texts_of(batch, text), strict=True):
                s = shingle_set(t)
                if digest(s) == node:  # an id may occur with several texts
                    yield pa.RecordBatch.from_arrays([pa.array([node], pa.binary()), pa.array([s.tobytes()], pa.binary())], names=["node", "shingles"])

    found = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text).join(wanted, "doc_id").select("node", text).mapInArrow(run, "node binary, shingles binary")
    return keep(found.groupBy("node").agg(F.first("shingles").alias("shingles")))


def verified(pairs: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """The pairs (a, b) of (lead, node) that are linked.

    Members of a leader are dealt to portions of about ``PORTION``; the leader's set goes once to each portion, ahead of its members.
    """

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lead, lead_set = None, np.zeros(0, np.uint64)
        for batch in rows:
            give_back()
            a, b = [], []
            leads, nodes, shingles = (batch.column(batch.schema.get_field_index(c)) for c in ("lead", "node", "shingles"))
            for i in range(batch.num_rows):
                own = np.frombuffer(shingles[i].as_py(), "<u8")
                if not nodes[i].is_valid:
                    lead, lead_set = leads[i].as_py(), own
                    continue
                at = np.minimum(np.searchsorted(lead_set, own), len(lead_set) - 1)
                both = int((lead_set[at] == own).sum())
                if 100 * both >= percent * (len(own) + len(lead_set) - both):
                    a.append(lead)
                    b.append(nodes[i].as_py())
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.binary()), pa.array(b, pa.binary())], names=["a", "b"])

    portions = keep(pairs.groupBy("lead").agg(F.ceil(F.count("*") / PORTION).cast("int").alias("portions")))
    heads = portions.join(sets.withColumnRenamed("node", "lead"), "lead").select("lead", F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"), F.lit(None).cast("binary").alias("node"), "shingles")
    tails = pairs.join(portions, "lead").select("lead", F.pmod(F.xxhash64("node"), F.col("portions")).cast("int").alias("portion"), "node").join(sets, "node")
    dealt = heads.unionByName(tails.select(*heads.columns)).repartition("lead", "portion").sortWithinPartitions("lead", "portion", F.col("node").isNotNull())
    return keep(dealt.mapInArrow(run, "a binary, b binary"))


def linked_between(left: list[np.ndarray], right: list[np.ndarray] | None, percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) that connect all sets linked across ``left`` and ``right`` (within ``left`` if ``right`` is None), by counts of common members over all such pairs.

    A right set has the number len(left) + its place. Memory is one count for each pair and strips of ``COLUMNS`` members.
    """
    sets = left if right is None else left + right
    n = len(left)
    sizes = np.array([len(s) for s in sets])
    values, codes = np.unique(np.concatenate(sets), return_inverse=True)
    owner = np.repeat(np.arange(len(sets)), sizes)
    shared = np.bincount(codes) > 1
    column = np.cumsum(shared) - 1
    use = shared[codes]
    owner, codes = owner[use], column[codes[use]]
    order = np.argsort(codes, kind="stable")
    owner, codes = owner[order], codes[order]
    first = 0 if right is None else n
    both = np.zeros((n, len(sets) - first), np.int32)
    for low in range(0, int(shared.sum()), COLUMNS):
        a, b = np.searchsorted(codes, [low, low + COLUMNS])
        x = np.zeros((len(sets), COLUMNS), np.float32)
        x[owner[a:b], codes[a:b] - low] = 1
        both += (x[:n] @ x[first:].T).astype(np.int32)  # a strip's counts are at most COLUMNS, so exact
    least = (sizes[:n, None] + sizes[None, first:]) * percent / (100 + percent)
    near = both >= least - 0.5  # the exact test follows, on few
    i, j = np.nonzero(np.triu(near, 1) if right is None else near)
    exact = (100 + percent) * both[i, j].astype(np.int64) >= percent * (sizes[i] + sizes[first + j])
    parent = list(range(len(sets)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    out = []
    for i, j in zip(i[exact].tolist(), (first + j[exact]).tolist(), strict=True):
        if (x := root(i)) != (y := root(j)):
            parent[max(x, y)] = min(x, y)
            out.append((i, j))
    return out


def links_within(members: DataFrame, sets: DataFrame, percent: int = PERCENT) -> DataFrame:
    """Links (a, b) that connect the components of the given buckets (key, node, root).

    Members of a bucket's most frequent component needn't be compared with each other, only with the rest; so blocks of the rest meet all blocks,
    and blocks of that component meet the blocks of the rest. Each such pair of blocks is one task's work.
    """
    sized = keep(members.join(sets.select("node", F.length("shingles").alias("bytes")), "node"))
    main = sized.groupBy("key", "root").agg(F.count("*").alias("n")).groupBy("key").agg(F.max_by("root", F.struct("n", "root")).alias("main"))
    sided = sized.join(main, "key").select("key", "node", "bytes", (F.col("root") != F.col("main")).alias("rest"))
    n_blocks = lambda rest: F.ceil(F.greatest(F.sum(F.when(rest, F.col("bytes"))) / BLOCK_BYTES, F.sum(F.when(rest, 1)) / BLOCK_SETS, F.lit(1))).cast("int")
    blocks = keep(sided.groupBy("key").agg(n_blocks(F.col("rest")).alias("rests"), n_blocks(~F.col("rest")).alias("mains")))
    own = F.pmod(F.xxhash64("node", F.lit(3)), F.when(F.col("rest"), F.col("rests")).otherwise(F.col("mains"))).cast("int")
    pair = lambda low, high, left: F.struct(low.alias("low"), high.alias("high"), F.lit(left).alias("is_left"))
    upto = lambda n: F.sequence(F.lit(0), n - 1)
    # blocks of the rest are numbered from 0, those of the main component from -1 downwards
    of_rest = F.concat(
        F.transform(upto(F.col("rests")), lambda o: F.when(o >= F.col("own"), pair(F.col("own"), o, True)).otherwise(pair(o, F.col("own"), False))),
        F.transform(upto(F.col("mains")), lambda o: pair(F.col("own"), -1 - o, True)),
    )
    of_main = F.transform(upto(F.col("rests")), lambda o: pair(o, -1 - F.col("own"), False))
    placed = sided.join(blocks, "key").withColumn("own", own).select("key", "node", F.explode(F.when(F.col("rest"), of_rest).otherwise(of_main)).alias("p")).select("key", "node", "p.*")
    dealt = placed.join(sets, "node")

    def run(group: pa.Table) -> pa.Table:
        if group.nbytes > BLOCK_BYTES // 4:  # small groups leave little
            give_back()
        group = group.sort_by("node")
        one_block = group.column("low")[0] == group.column("high")[0]
        left = group.column("is_left").to_pylist()
        nodes, shingles = group.column("node").to_pylist(), [np.frombuffer(x, "<u8") for x in group.column("shingles").to_pylist()]
        a = [i for i, x in enumerate(left) if x]
        b = [i for i, x in enumerate(left) if not x]
        if not a or (not b and not one_block):
            found, names = [], []
        else:
            found = linked_between([shingles[i] for i in a], None if one_block else [shingles[i] for i in b], percent)
            names = [nodes[i] for i in a + b]
        return pa.table({"a": pa.array([names[i] for i, _ in found], pa.binary()), "b": pa.array([names[j] for _, j in found], pa.binary())})

    return keep(dealt.groupBy("key", "low", "high").applyInArrow(run, "a binary, b binary"))


def near_duplicates(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept), one row for each row of ``docs``.

    Documents with 100 * intersection >= percent * union of their sets of distinct five-word shingles are linked; component_id is the smallest
    doc_id reachable and kept says whether it is the document's own. Null and empty texts and texts without words are linked with
    nothing. A row with a null id is linked with nothing either: its component_id is null and it is kept. Rows that repeat an id belong to one
    component only if their texts are alike; all of them are kept or none. An empty table gives an empty result.
    """
    signed, placed = grouped(docs, text, percent)
    least = placed.groupBy("root").agg(F.min("doc_id").alias("component_id"))
    of_node = keep(placed.join(least, "root").select("node", "component_id"))
    result = signed.drop("bands").join(of_node, "node", "left")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return result.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def grouped(docs: DataFrame, text: str, percent: int) -> tuple[DataFrame, DataFrame]:
    """The signatures, and (node, doc_id, root) of all nodes; doc_id is the least that has the node."""
    batches(docs.sparkSession)
    signed = keep(signatures(docs, text))
    nodes = keep(signed.where("node is not null and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("bands").alias("bands")))
    roots = link(docs, nodes, text, percent)
    return signed, nodes.select("node", "doc_id").join(roots, "node", "left").select("node", "doc_id", F.coalesce("root", "node").alias("root"))


def link(docs: DataFrame, nodes: DataFrame, text: str, percent: int = PERCENT) -> DataFrame:
    """(node, root) of linked nodes."""
    buckets = nodes.select("node", F.explode("bands").alias("key"))
    lead = keep(buckets.groupBy("key").agg(F.min("node").alias("lead"), F.count("*").alias("n")).where("n > 1"))
    members = keep(buckets.join(lead, "key"))
    pairs = keep(members.where("node <> lead").select("lead", "node").distinct())
    wanted = pairs.select(F.explode(F.array("lead", "node")).alias("node")).distinct()
    sets = full_sets(docs, nodes.select("node", "doc_id").join(wanted, "node"), text)
    links = verified(pairs, sets, percent)
    roots = components(links)
    placed = members.where("n > 2").join(roots, "node", "left").select("key", "node", F.coalesce("root", "node").alias("root"))
    # buckets with the same members are compared once
    mixed = placed.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("n"), F.sum(F.xxhash64("node").cast("decimal(20,0)")).alias("sum"), F.bit_xor(F.xxhash64("node", F.lit(1))).alias("xor")).where("low < high")
    once = keep(mixed.groupBy("n", "sum", "xor").agg(F.min("key").alias("key")).select("key"))
    if once.isEmpty():
        return roots
    return components(links.union(links_within(keep(placed.join(once, "key", "left_semi")), sets, percent)))


def deduplicated(docs: DataFrame, text: str = "text", percent: int = PERCENT) -> DataFrame:
    """One row of ``docs``, with all its columns, for each component; rows without an id stay.

    It has the component's smallest id, and among the texts that the component has under this id the least shingle set; of rows with both alike the
    longest text, then the largest hash of the text and of the row's other columns. An id stays with several rows if its texts belong to several
    components. Rows without words (null and empty texts among them) are linked with nothing; one stays for each id. An empty table gives an empty result.
    """
    signed, placed = grouped(docs, text, percent)
    chosen = placed.groupBy("root").agg(F.min(F.struct("doc_id", "node")).alias("c")).select(F.col("c.doc_id").alias("id"), F.col("c.node").alias("node"))
    wordless = signed.where("node is null and doc_id is not null").select(F.col("doc_id").alias("id"), F.lit(b"").alias("node")).distinct()
    whole = F.struct(*docs.columns)
    others = F.to_json(F.struct(*(c for c in docs.columns if c != text)))
    order = F.struct(F.coalesce(F.length(text), F.lit(-1)), F.xxhash64(text), F.xxhash64(others))
    rows = docs.where("doc_id is not null").select(F.col("doc_id").cast("bigint").alias("id"), node_of(text).alias("node"), whole.alias("whole"), order.alias("order"))
    # repeated rows meet before the shuffle already
    once = rows.groupBy("id", "node").agg(F.max_by("whole", "order").alias("whole")).join(chosen.unionByName(wordless), ["id", "node"], "left_semi")
    return once.select("whole.*").unionByName(docs.where("doc_id is null"))


def op8_near_duplicates(spark, sf_dir):
    """Components of documents at 85 percent; nulls, ties, repeated rows and empty tables as in ``near_duplicates``."""
    return near_duplicates(table(spark, sf_dir, "documents"))
