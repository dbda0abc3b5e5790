"""Approximate nearest neighbours by inner product, with score-aware anisotropic quantisation.

What is coded is what a vector lies beside the nearest of up to 256 places, turned by a fixed rotation and divided by its own length: so neither tight
clusters, nor long vectors, nor a few large components take all the fineness of the codes. Every component is coded by one of 16 centres of its own, four bits;
two codes make a byte. Codes and centres are fitted to the loss  ``PARALLEL`` * |residual along the vector|^2 + |residual across it|^2,  since it is the
part along the vector that distorts large inner products. A query turns into tables of its products with all pairs of centres, in 16 bits; a scan adds, for
each row, the table entries that its bytes name, its place's own product, and what the codes lack in the place's direction, which is held as a number:
among the members of a tight cluster of vectors of one length it outweighs all else. The best ``RERANKED`` rows are then ranked by exact products of the original vectors.

At scale: codes are an eighth of single-precision vectors, and it is only they that travel to the queries. Queries are dealt to chunks, and a task takes a
chunk past all blocks of codes (past some of them while there are fewer chunks than cores), with a running list of the best rows of each query. So
a task's memory is bounded, and what it returns grows with the queries, not with the blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, keep, table

#: Rows of the lowest hash on which centres are fitted (fewer of long vectors, so that they hold SAMPLE * 64 components at most), weight of the parallel residual, centres of a code.
SAMPLE, PARALLEL, CENTRES = 8192, 4.0, 16
#: Places that vectors are coded beside, at most, rows of the sample for each of them, and bytes of a coded row that hold its place, its length and what its codes lack along its place.
PLACES, ROWS_A_PLACE, HEAD = 256, 16, 9
#: Rows in a block, queries in a chunk on average, rows that a task gives back for each query to be ranked exactly.
BLOCK_ROWS, CHUNK_QUERIES, RERANKED = 8192, 192, 100
#: Partitions of a scan, at most.
MOST_PARTS = 20_000


def usable(df: DataFrame, vector: str = "embedding") -> DataFrame:
    """(vec_id, vector as doubles) without vectors that are null, empty, zero, hold null or non-finite components, or are not of the commonest length."""
    v = F.col(vector)
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = df.where(F.col("vec_id").isNotNull() & F.coalesce(fine, F.lit(False)))
    common = rows.groupBy(F.size(v).alias("n")).count().orderBy(F.desc("count"), "n").first()
    return rows.where(F.size(v) == (common.n if common else 0)).select(F.col("vec_id").cast("bigint").alias("vec_id"), v.cast("array<double>").alias("vector"))


def places_among(x: np.ndarray, rounds: int = 8) -> np.ndarray:
    """Means of the rows nearest to each other (Lloyd's rounds); the first ones are drawn far apart."""
    draw = np.random.default_rng(4)
    found, gap = [x.mean(axis=0)], ((x - x.mean(axis=0)) ** 2).sum(axis=1)
    while len(found) < min(PLACES, max(1, len(x) // ROWS_A_PLACE)) and gap.any():
        found.append(x[draw.choice(len(x), p=gap / gap.sum())])
        gap = np.minimum(gap, ((x - found[-1]) ** 2).sum(axis=1))
    found = np.array(found)
    for _ in range(rounds):
        nearest = ((found**2).sum(axis=1) - 2 * x @ found.T).argmin(axis=1)
        n = np.bincount(nearest, minlength=len(found))
        sums = np.zeros_like(found)
        np.add.at(sums, nearest, x)
        found[n > 0] = sums[n > 0] / n[n > 0, None]
    return found


class Quantiser:
    """Places, and centres of each component of what lies beside them, fitted to a sample."""

    def __init__(self, sample: np.ndarray, rounds: int = 6) -> None:
        self.dim = 1 << max(0, sample.shape[1] - 1).bit_length()
        self.signs = np.random.default_rng(3).choice([-1.0, 1.0], sample.shape[1])
        self.places = places_among(sample)
        turned = self.turned(self.places)
        self.directions = turned / np.maximum(np.linalg.norm(turned, axis=1, keepdims=True), 1e-300)
        x, unit = self.beside(sample)[2:]
        shares = (np.arange(CENTRES) + 0.5) / CENTRES
        self.centres = np.quantile(x, shares, axis=0).T.copy()
        code = self.encode(x, unit, sweeps=0)
        for _ in range(rounds):
            self.refit(x, unit, code)
            code = self.encode(x, unit)

    def turned(self, x: np.ndarray) -> np.ndarray:
        """Rows turned by fixed signs and a Hadamard transform, padded to a power of two; products of rows stay. Equal rows stay equal, as no sum depends on other rows."""
        out = np.zeros((len(x), self.dim))
        out[:, : x.shape[1]] = x * self.signs
        step = 1
        while step < self.dim:
            pairs = out.reshape(len(x), -1, 2, step)
            out = np.stack([pairs[:, :, 0] + pairs[:, :, 1], pairs[:, :, 0] - pairs[:, :, 1]], axis=2).reshape(len(x), -1)
            step *= 2
        return out / np.sqrt(self.dim)

    def beside(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """The nearest place of each row, the length of the rest, the rest turned and of length 1, and the row's own direction, turned."""
        nearest = ((self.places**2).sum(axis=1) - 2 * np.einsum("nd,pd->np", x, self.places)).argmin(axis=1)
        rest = self.turned(x - self.places[nearest])
        length = np.sqrt((rest**2).sum(axis=1)).astype("<f4").astype(np.float64)
        own = self.turned(x)
        return nearest, length, rest / np.maximum(length, 1e-300)[:, None], own / np.maximum(np.sqrt((own**2).sum(axis=1)), 1e-300)[:, None]

    def coded(self, x: np.ndarray) -> np.ndarray:
        """One row of bytes for each vector: place, length, what the codes lack along the place, codes."""
        nearest, length, rest, unit = self.beside(x)
        code = self.encode(rest, unit)
        lacks = ((rest - self.decoded(code)) * self.directions[nearest]).sum(axis=1) * length
        numbers = np.stack([length, lacks], axis=1).astype("<f4").view(np.uint8).reshape(-1, HEAD - 1)
        return np.concatenate([nearest[:, None].astype(np.uint8), numbers, self.packed(code)], axis=1)

    def encode(self, x: np.ndarray, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes that minimise the anisotropic loss, one after the other with the rest held."""
        code = np.abs(x[:, :, None] - self.centres[None]).argmin(axis=2)
        along = ((x - self.decoded(code)) * unit).sum(axis=1)
        for _ in range(sweeps):
            for m in range(self.dim):
                residual = x[:, m, None] - self.centres[m]
                part = residual * unit[:, m, None]
                rest = along - np.take_along_axis(part, code[:, m, None], 1)[:, 0]
                best = (residual**2 + (PARALLEL - 1) * (rest[:, None] + part) ** 2).argmin(axis=1)
                code[:, m], along = best, rest + np.take_along_axis(part, best[:, None], 1)[:, 0]
        return code

    def decoded(self, code: np.ndarray) -> np.ndarray:
        return self.centres[np.arange(self.dim), code]

    def refit(self, x: np.ndarray, unit: np.ndarray, code: np.ndarray) -> None:
        """Centres that minimise the loss for given codes, one component after the other; a centre without rows stays."""
        along = ((x - self.decoded(code)) * unit).sum(axis=1)
        for m in range(self.dim):
            u, c = unit[:, m], code[:, m]
            rest = along - (x[:, m] - self.centres[m, c]) * u
            up = np.bincount(c, weights=x[:, m] + (PARALLEL - 1) * u * (rest + x[:, m] * u), minlength=CENTRES)
            down = np.bincount(c, weights=1 + (PARALLEL - 1) * u**2, minlength=CENTRES)
            self.centres[m] = np.where(down > 0, up / np.maximum(down, 1e-300), self.centres[m])
            along = rest + (x[:, m] - self.centres[m, c]) * u

    @staticmethod
    def packed(code: np.ndarray) -> np.ndarray:
        """Two codes a byte; a last code without a partner has the partner 0."""
        code = np.pad(code, ((0, 0), (0, code.shape[1] % 2))).astype(np.uint8)
        return code[:, ::2] << 4 | code[:, 1::2]

    def tables(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each byte and each of its values what it adds for every query: bytes x 256 x queries, as whole steps of the query's own scale; what the sum starts from, and the step."""
        q = self.turned(q)
        parts = np.einsum("qm,mk->mkq", q, self.centres)
        parts = np.concatenate([parts, np.zeros((self.dim % 2, CENTRES, len(q)))])
        pairs = (parts[::2, :, None] + parts[1::2, None]).reshape(-1, CENTRES * CENTRES, len(q))
        low = pairs.min(axis=1, keepdims=True)
        pairs -= low
        most = min(65_535, (1 << 32) // len(pairs) - 1)  # sums fit 32 bits
        step = np.maximum(pairs.max(axis=(0, 1)), 1e-300) / most
        return np.rint(pairs / step).astype(np.uint16), low.sum(axis=(0, 1)).astype(np.float32), step.astype(np.float32)

    def products(self, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Products of all places with the queries, less the greatest one of each query (those that matter are near 0, where single precision is fine), and of the places' directions."""
        p = self.places @ q.T
        return (p - p.max(axis=0)).astype(np.float32), (self.directions @ self.turned(q).T).astype(np.float32)


class Scan:
    """The running best rows of each query of a chunk."""

    def __init__(self, quantiser: Quantiser, ids: np.ndarray, vectors: np.ndarray, most: int) -> None:
        self.ids, self.most, (self.tables, self.low, self.step), (self.products, self.along) = ids, most, quantiser.tables(vectors), quantiser.products(vectors)
        self.query, self.score, self.found = np.zeros(0, np.int64), np.zeros(0, np.float32), np.zeros(0, np.int64)
        self.least = np.full(len(ids), -np.inf, np.float32)  # the score of the last of ``most`` rows

    def look(self, ids: np.ndarray, codes: np.ndarray) -> None:
        steps = np.zeros((len(ids), len(self.ids)), np.uint32)
        for m, byte_table in enumerate(self.tables):
            steps += byte_table.take(codes[:, HEAD + m], axis=0)
        numbers = np.ascontiguousarray(codes[:, 1:HEAD]).view("<f4")
        total = steps.astype(np.float32)
        total *= self.step
        total += self.low
        total *= numbers[:, :1]
        total += self.along.take(codes[:, 0], axis=0) * numbers[:, 1:]
        total += self.products.take(codes[:, 0], axis=0)
        at = np.minimum(np.searchsorted(self.ids, ids), len(self.ids) - 1)
        own = np.flatnonzero(self.ids[at] == ids)
        total[own, at[own]] = -np.inf
        if len(ids) > self.most and np.isneginf(self.least).any():  # no row below the block's own best can be among the best
            self.least = np.maximum(self.least, np.partition(total, len(ids) - self.most, axis=0)[len(ids) - self.most])
        row, query = np.nonzero((total >= self.least) & (total > -np.inf))
        query, score, found = np.concatenate([self.query, query]), np.concatenate([self.score, total[row, query]]), np.concatenate([self.found, ids[row]])
        order = np.lexsort((found, -score, query))
        query, score, found = query[order], score[order], found[order]
        n = np.bincount(query, minlength=len(self.ids))
        ends = np.cumsum(n)
        nth = np.arange(len(query)) - np.repeat(ends - n, n)
        full = n >= self.most
        self.least[full] = score[(ends - n)[full] + self.most - 1]
        best = nth < self.most
        self.query, self.score, self.found = query[best], score[best], found[best]

    def rows(self, chunk: int) -> pa.RecordBatch:
        """(chunk, vec_id, places of the queries that want it)."""
        order = np.lexsort((self.query, self.found))
        found, starts = np.unique(self.found[order], return_index=True)
        wanted = pa.ListArray.from_arrays(pa.array(np.append(starts, len(order)), pa.int32()), pa.array(self.query[order], pa.int32()))
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(found), chunk), pa.int64()), pa.array(found, pa.int64()), wanted], names=["chunk", "vec_id", "wanted"])


class Ranks:
    """The running k best exact products of each query of a chunk."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int) -> None:
        self.ids, self.vectors, self.k = ids, vectors, k
        self.best = (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, np.int64))
        self.nth = np.zeros(0, np.int64)

    def add(self, ids: np.ndarray, vectors: np.ndarray, row: np.ndarray, query: np.ndarray) -> None:
        exact = np.einsum("nd,nd->n", vectors[row], self.vectors[query])
        query, score, found = (np.concatenate(x) for x in zip(self.best, (query, exact, ids[row]), strict=True))
        order = np.lexsort((found, -score, query))
        n = np.bincount(query, minlength=len(self.ids))
        nth = np.arange(len(order)) - np.repeat(np.cumsum(n) - n, n)
        order, self.nth = order[nth < self.k], nth[nth < self.k]
        self.best = query[order], score[order], found[order]

    def rows(self) -> pa.RecordBatch:
        query, score, found = self.best
        return pa.RecordBatch.from_arrays([pa.array(self.ids[query], pa.int64()), pa.array(self.nth + 1, pa.int32()), pa.array(found, pa.int64()), pa.array(score)], names=["query_id", "rank", "vec_id", "score"])


def rows_of(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    ids = batch.column(0).to_numpy()
    return ids, batch.column(1).flatten().to_numpy().reshape(len(ids), -1)


def queries_of(batch: pa.RecordBatch, i: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, ascending, and vectors of the chunk of queries in row i."""
    rows = batch.column(batch.schema.get_field_index("queries"))[i].values
    ids = rows.field(0).to_numpy()
    return ids, rows.field(1).flatten().to_numpy().reshape(len(ids), -1)


def build_index(vectors: DataFrame, quantiser) -> DataFrame:
    """Blocks (ids, codes) of all usable vectors; rows of a block ascend by id."""

    def block(ids: np.ndarray, codes: np.ndarray) -> pa.RecordBatch:
        order = np.argsort(ids, kind="stable")
        return pa.RecordBatch.from_arrays([pa.array([ids[order].astype("<i8").tobytes()], pa.binary()), pa.array([codes[order].tobytes()], pa.binary())], names=["ids", "codes"])

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, ids, codes, held = quantiser.value, [], [], 0
        for batch in batches_:
            if batch.num_rows:
                i, x = rows_of(batch)
                ids.append(i)
                codes.append(q.coded(x))
                held += len(i)
                if held >= BLOCK_ROWS:
                    yield block(np.concatenate(ids), np.concatenate(codes))
                    ids, codes, held = [], [], 0
        if held:
            yield block(np.concatenate(ids), np.concatenate(codes))

    return keep(vectors.mapInArrow(run, "ids binary, codes binary"))


def candidates(blocks: DataFrame, asked: DataFrame, quantiser, n_chunks: int, most: int) -> DataFrame:
    """(chunk, vec_id, wanted): for each query the best rows by the scan of the codes, ``most`` for each task that saw some of the blocks."""
    groups = max(1, -(-2 * blocks.sparkSession.sparkContext.defaultParallelism // n_chunks))
    parts = min(n_chunks * groups, MOST_PARTS)
    cell = lambda group: (F.col("chunk") * groups + group).alias("cell")
    heads = asked.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).select(cell(F.col("group")), "chunk", "queries", F.lit(None).cast("binary").alias("ids"), F.lit(None).cast("binary").alias("codes"))
    copies = blocks.withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit(n_chunks - 1))))
    tails = copies.select(cell(F.pmod(F.xxhash64("ids"), F.lit(groups))), F.col("chunk").cast("bigint").alias("chunk"), F.lit(None).cast(asked.schema["queries"].dataType).alias("queries"), "ids", "codes")
    # a cell's queries come first, then its blocks
    dealt = heads.unionByName(tails).repartitionById(parts, (F.col("cell") % parts).cast("int")).sortWithinPartitions("cell", F.col("queries").isNull())

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, scan, chunk = quantiser.value, None, 0
        for batch in batches_:
            chunks, ids, codes = (batch.column(batch.schema.get_field_index(c)) for c in ("chunk", "ids", "codes"))
            for i in range(batch.num_rows):
                if not ids[i].is_valid:
                    if scan is not None:
                        yield scan.rows(chunk)
                    scan, chunk = Scan(q, *queries_of(batch, i), most), chunks[i].as_py()
                else:
                    of = np.frombuffer(ids[i].as_py(), "<i8")
                    scan.look(of, np.frombuffer(codes[i].as_py(), np.uint8).reshape(len(of), -1))
        if scan is not None:
            yield scan.rows(chunk)

    return dealt.mapInArrow(run, "chunk bigint, vec_id bigint, wanted array<int>")


def ranked(found: DataFrame, vectors: DataFrame, asked: DataFrame, n_chunks: int, k: int) -> DataFrame:
    """(query_id, rank, vec_id, score) by exact products of the candidates' vectors."""
    parts = min(n_chunks, MOST_PARTS)
    once = found.groupBy("vec_id", "chunk").agg(F.array_distinct(F.flatten(F.collect_list("wanted"))).alias("wanted"))
    tails = once.join(vectors, "vec_id").select("chunk", "vec_id", "vector", "wanted", F.lit(None).cast(asked.schema["queries"].dataType).alias("queries"))
    heads = asked.select("chunk", F.lit(None).cast("bigint").alias("vec_id"), F.lit(None).cast("array<double>").alias("vector"), F.lit(None).cast("array<int>").alias("wanted"), "queries")
    dealt = heads.unionByName(tails).repartitionById(parts, (F.col("chunk") % parts).cast("int")).sortWithinPartitions("chunk", F.col("queries").isNull())

    def run(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = None
        for batch in batches_:
            heads = [i for i, x in enumerate(batch.column(1).is_null().to_pylist()) if x]
            for a, b in zip([-1, *heads], [*heads, batch.num_rows], strict=True):
                if a >= 0:
                    if ranks is not None:
                        yield ranks.rows()
                    ranks = Ranks(*queries_of(batch, a), k)
                if b > a + 1:
                    part = batch.slice(a + 1, b - a - 1)
                    vectors_, wanted = part.column(2), part.column(3)
                    x = vectors_.flatten().to_numpy().reshape(len(part), -1)
                    row = np.repeat(np.arange(len(part)), wanted.value_lengths().to_numpy())
                    ranks.add(part.column(1).to_numpy(), x, row, wanted.flatten().to_numpy())
        if ranks is not None:
            yield ranks.rows()

    return dealt.mapInArrow(run, "query_id bigint, rank int, vec_id bigint, score double")


def nearest(df: DataFrame, queries: DataFrame, k: int = 20, vector: str = "embedding", reranked: int = RERANKED) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best rows of ``df`` found for each row of ``queries`` but its own, by inner product.

    Both tables have vec_id and the vector. Rows whose vector is null, empty, zero, holds null or non-finite components or has not the commonest
    length of ``df`` take no part, nor do null ids; further columns aren't read. Scores are in double precision; ties go to the smaller vec_id. A
    repeated query id is one query (with the least of its vectors); a repeated row of ``df`` is found as often. With fewer candidates than k all are
    returned; an empty table gives none. ``reranked`` rows (2 k at least) are ranked exactly for each query and scanning task: with as many as
    ``df`` has rows the search is exact.
    """
    spark = df.sparkSession
    batches(spark)
    vectors = usable(df, vector)
    first = vectors.select(F.size("vector")).first()
    if not first:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    dim = first[0]
    sample = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(max(1024, min(SAMPLE, SAMPLE * 64 // dim))).collect()  # bounded by SAMPLE
    quantiser = spark.sparkContext.broadcast(Quantiser(np.array([r.vector for r in sample])))
    blocks = build_index(vectors, quantiser)
    single = keep(usable(queries, vector).where(F.size("vector") == dim).groupBy("vec_id").agg(F.min("vector").alias("vector")))
    n_queries = single.count()
    if not n_queries:
        return spark.createDataFrame([], "query_id bigint, rank int, vec_id bigint, score double")
    n_chunks = -(-n_queries // CHUNK_QUERIES)
    chunk = F.pmod(F.xxhash64("vec_id"), F.lit(n_chunks)).cast("bigint")
    asked = keep(single.groupBy(chunk.alias("chunk")).agg(F.sort_array(F.collect_list(F.struct("vec_id", "vector"))).alias("queries")))
    return ranked(candidates(blocks, asked, quantiser, n_chunks, max(reranked, 2 * k)), vectors, asked, n_chunks, k)


def op4_nearest(spark, sf_dir):
    """The 20 nearest of each embedding whose vec_id is divisible by 20; unusable vectors and null ids take no part, ties go to the smaller vec_id, an empty table gives no rows."""
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest(vectors, vectors.where("vec_id % 20 = 0"))
