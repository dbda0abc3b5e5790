"""Centroid clustering over a VA-file: vectors compressed to cells of a few bits a dimension, full vectors fetched only where cells can't decide.

Vectors become integers, so that sums, means and distances are exact. The index holds, for each vector, the cell of each of its components (six
bits), its squared length, and the vector itself, which is another column. For each centroid, dimension and cell a table has the least and the
greatest that a component in that cell adds to  |c|^2 - 2 x.c;  summed up over the dimensions and with |x|^2 they are an interval that holds the
distance. Where the interval of one centroid lies below all others that centroid is the nearest; otherwise the full vector is fetched and its
distances to the centroids that are left are computed exactly.

At scale: the first and the last assignment need every vector (for the sums, for the distances) and read the index once each, without a shuffle.
The rounds between read cells and lengths only. They fetch the vectors that are undecided or have moved, by a join on their key, and move them
from the sum of their old centroid to that of the new one. Centroids and sums are k x dimensions numbers; nothing else comes to the driver.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import batches, keep, table

#: Cells of a dimension (six bits), vectors of the lowest hash whose quantiles make half of the cuts, greatest component (so that distances fit 64 bits), vectors looked at together.
CELLS, SAMPLE, GREATEST, STEP = 64, 4096, 1 << 26, 4096
RESULT = "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, inertia bigint, centroid_sha256 string"


def usable(df: DataFrame, dim: int, vector: str) -> DataFrame:
    """(vec_id, vector as integers floor(64 x)) of vectors with ``dim`` components, none of them null or non-finite."""
    v = F.col(vector)
    fine = (F.size(v) == dim) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(64 * x.cast("double")))
    low = F.forall(v, lambda x: F.abs(64 * x.cast("double")) < GREATEST)
    told = F.when(low, whole).otherwise(F.raise_error(F.lit(f"a component is beyond {GREATEST} / 64, so that distances don't fit 64 bits")).cast("array<bigint>"))
    return df.where(F.coalesce(fine, F.lit(False))).select(F.col("vec_id").cast("bigint").alias("vec_id"), told.cast("array<int>").alias("vector"))


def rows_of(batch: pa.RecordBatch, dim: int, column: str = "vector") -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).flatten().to_numpy().reshape(-1, dim).astype(np.int64)


def column_of(batch: pa.RecordBatch, column: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(column)).to_numpy()


def extent(vectors: DataFrame, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """The least and the greatest of each component over all vectors."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        low, high = np.full(dim, GREATEST), np.full(dim, -GREATEST)
        for batch in rows:
            if batch.num_rows:
                x = rows_of(batch, dim)
                low, high = np.minimum(low, x.min(axis=0)), np.maximum(high, x.max(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim), pa.int32()), pa.array(low, pa.int64()), pa.array(high, pa.int64())], names=["i", "low", "high"])

    rows = vectors.select("vector").mapInArrow(run, "i int, low bigint, high bigint").groupBy("i").agg(F.min("low").alias("low"), F.max("high").alias("high")).orderBy("i").collect()
    return np.array([r.low for r in rows]), np.array([r.high for r in rows])


def cuts_of(cuts: set[int], low: int, high: int) -> list[int]:
    """CELLS - 1 cuts of the integers from ``low`` to ``high``: the given ones, and halves of the widest cells as long as cells hold more than one integer."""
    edges = sorted({low, high + 1, *(c for c in cuts if low < c <= high)})
    while len(edges) <= CELLS:
        wide, at = max((b - a, a) for a, b in zip(edges, edges[1:], strict=False))
        if wide < 2:
            break
        edges = sorted([*edges, at + wide // 2])
    return edges[1:-1] + [high + 1] * (CELLS + 1 - len(edges))


class Cells:
    """For each dimension the integers at which cells begin, and the least and greatest integer of each cell."""

    def __init__(self, sample: np.ndarray, low: np.ndarray, high: np.ndarray) -> None:
        quantiles = np.quantile(sample, np.arange(1, CELLS // 2) / (CELLS // 2), axis=0, method="nearest").astype(np.int64)
        self.cuts = np.array([cuts_of(set(q.tolist()), int(a), int(b)) for q, a, b in zip(quantiles.T, low, high, strict=True)])
        self.low = np.concatenate([low[:, None], np.maximum(self.cuts, low[:, None])], axis=1)
        self.high = np.concatenate([np.minimum(self.cuts - 1, high[:, None]), high[:, None]], axis=1)

    def encode(self, x: np.ndarray) -> np.ndarray:
        """The cells of each vector, a byte each."""
        return np.stack([np.searchsorted(c, x[:, i], "right") for i, c in enumerate(self.cuts)], axis=1).astype(np.uint8)


class Tables:
    """What each cell of each dimension adds, at least and at most, to the distance from each centroid."""

    def __init__(self, cells: Cells, centroids: np.ndarray) -> None:
        self.centroids = centroids
        ends = np.stack([-2 * cells.low[:, :, None] * centroids.T[:, None], -2 * cells.high[:, :, None] * centroids.T[:, None]])
        self.least, self.most = ends.min(axis=0), ends.max(axis=0)
        self.own = (centroids**2).sum(axis=1)

    def intervals(self, codes: np.ndarray, norm: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds of the squared distances: vectors x centroids."""
        least = self.own + norm[:, None]
        most = least.copy()
        for i in range(codes.shape[1]):
            least += self.least[i].take(codes[:, i], axis=0)
            most += self.most[i].take(codes[:, i], axis=0)
        return least, most

    def possible(self, codes: np.ndarray, norm: np.ndarray) -> np.ndarray:
        """Which centroids can be the nearest: those whose interval doesn't lie above another one."""
        least, most = self.intervals(codes, norm)
        return least <= most.min(axis=1)[:, None]

    def nearest(self, x: np.ndarray, possible: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(centroid, squared distance) by exact distances to the possible centroids only; the smaller number of equally near ones."""
        row, c = np.nonzero(possible)
        d = ((x[row] - self.centroids[c]) ** 2).sum(axis=1)
        order = np.lexsort((c, d, row))
        first = order[np.append(True, row[order][1:] != row[order][:-1])]
        return c[first], d[first]


def build_index(vectors: DataFrame, cells, dim: int) -> DataFrame:
    """The stored VA-file: key (unique), vec_id, cells, norm, and the vector in a column of its own."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            x = rows_of(batch, dim)
            codes = cells.value.encode(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([c.tobytes() for c in codes], pa.binary()), pa.array((x**2).sum(axis=1))], names=[*batch.schema.names, "cells", "norm"])

    return keep(vectors.mapInArrow(run, "vec_id bigint, vector array<int>, cells binary, norm bigint").withColumn("key", F.monotonically_increasing_id()))


def codes_of(batch: pa.RecordBatch) -> np.ndarray:
    return np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("cells")).to_pylist()), np.uint8).reshape(batch.num_rows, -1)


def steps(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in rows:
        yield from (batch.slice(i, STEP) for i in range(0, batch.num_rows, STEP))


def assigned(index: DataFrame, tables, dim: int, kept: dict[str, str]) -> DataFrame:
    """The columns ``kept`` (names and types) of every vector, its cluster and distance, from one reading of the whole index."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tables.value
        for batch in steps(rows):
            cluster, distance = t.nearest(rows_of(batch, dim), t.possible(codes_of(batch), column_of(batch, "norm")))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in kept]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(cluster, pa.int32()), pa.array(distance, pa.int64())], names=[*kept, "cluster", "distance"])

    schema = ", ".join(f"{c} {t}" for c, t in (kept | {"cluster": "int", "distance": "bigint"}).items())
    return index.select(*dict.fromkeys(["cells", "norm", "vector", *kept])).mapInArrow(run, schema)


def bounded(cells: DataFrame, tables, dim: int) -> DataFrame:
    """(key, cells, norm, cluster, now, possible): ``now`` is the nearest centroid where intervals decide, else null; reads no vector. ``cluster`` is that of the round before."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(rows):
            possible = tables.value.possible(codes_of(batch), column_of(batch, "norm"))
            now = pa.array(possible.argmax(axis=1), pa.int32(), mask=possible.sum(axis=1) > 1)
            yield pa.RecordBatch.from_arrays([*batch.columns, now, pa.array([p.tobytes() for p in np.packbits(possible, axis=1)], pa.binary())], names=[*batch.schema.names, "now", "possible"])

    return keep(cells.select("key", "cells", "norm", "cluster").mapInArrow(run, "key bigint, cells binary, norm bigint, cluster int, now int, possible binary"))


def fetched(told: DataFrame, index: DataFrame, tables, dim: int) -> DataFrame:
    """(key, cells, norm, cluster, now, vector) of the vectors that are undecided or have moved; all are decided then."""
    todo = told.where(F.col("now").isNull() | (F.col("now") != F.col("cluster")))

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        k = len(tables.value.centroids)
        for batch in steps(rows):
            masks = np.frombuffer(b"".join(batch.column(batch.schema.get_field_index("possible")).to_pylist()), np.uint8).reshape(batch.num_rows, -1)
            now, _ = tables.value.nearest(rows_of(batch, dim), np.unpackbits(masks, axis=1, count=k).astype(bool))
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("key", "cells", "norm", "cluster")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(now, pa.int32()), batch.column(batch.schema.get_field_index("vector"))], names=["key", "cells", "norm", "cluster", "now", "vector"])

    return keep(todo.join(index.select("key", "vector"), "key").mapInArrow(run, "key bigint, cells binary, norm bigint, cluster int, now int, vector array<int>"))


def sums(moves: DataFrame, k: int, dim: int) -> tuple[list[int], list[list[int]]]:
    """(counts, sums of vectors) by centroid of what (cluster, now, vector) moves: out of ``cluster``, where it isn't null, and into ``now``. Exact; k x dimensions numbers come back."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total = np.zeros(k, np.int64), np.zeros((k, dim), np.int64)
        for batch in rows:
            x, into = rows_of(batch, dim), column_of(batch, "now").astype(np.int64)
            out = batch.column(batch.schema.get_field_index("cluster")).fill_null(-1).to_numpy()
            for at, sign in ((into, 1), (out, -1)):
                for c in np.unique(at[at >= 0]):
                    of = at == c
                    n[c] += sign * int(of.sum())
                    total[c] += sign * x[of].sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(k), pa.int32()), pa.array(n), pa.array(total.tolist(), pa.list_(pa.int64()))], names=["cluster", "n", "total"])

    made = moves.select("cluster", "now", "vector").mapInArrow(run, "cluster int, n bigint, total array<bigint>")
    each = made.select("cluster", "n", F.posexplode("total").alias("i", "x")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum(F.col("x").cast("decimal(38,0)")).alias("x"))
    counts, totals = [0] * k, [[0] * dim for _ in range(k)]
    for r in each.collect():
        counts[r.cluster], totals[r.cluster][r.i] = r.n, int(r.x)
    return counts, totals


def starts(vectors: DataFrame, k: int) -> list[list[int]]:
    """The vectors of the ``k`` smallest SHA-256 of "1:<vec_id>", of equal ones the smaller vector; vectors without an id can't be a start."""
    hashed = vectors.where(F.col("vec_id").isNotNull()).withColumn("h", F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256))
    return [r.vector for r in hashed.orderBy("h", "vector").limit(k).collect()]


def cluster(df: DataFrame, k: int = 16, rounds: int = 3, dim: int = 64, vector: str = "embedding") -> DataFrame:
    """``RESULT``: each vector's centroid after ``rounds`` rounds and one more assignment, its squared distance, their sums, and a digest of its centroid.

    Components are floor(64 x). Vectors that are null, of another length, or with null or non-finite components have no row; a component of 2^20 or more is an error, since
    distances must fit 64 bits. Repeated rows and null ids are clustered row by row (null ids don't start a centroid). With fewer vectors than k each one starts a
    centroid; of equally near centroids the smaller number is taken, and one without vectors stays where it is. An empty table gives no rows; further columns aren't read.
    """
    spark: SparkSession = df.sparkSession
    batches(spark)
    vectors = usable(df, dim, vector)
    first = starts(vectors, k)
    if not first:
        return spark.createDataFrame([], RESULT)
    k, centroids = len(first), np.array(first, np.int64)
    sample = np.array([r.vector for r in vectors.orderBy(F.xxhash64("vector")).limit(SAMPLE).collect()], np.int64)  # bounded by SAMPLE
    cells = Cells(sample, *extent(vectors, dim))
    send = spark.sparkContext.broadcast
    index = build_index(vectors, send(cells), dim)
    counts, totals, told = [0] * k, [[0] * dim for _ in range(k)], None
    for _ in range(rounds):
        tables = send(Tables(cells, centroids))
        if told is None:
            told = keep(assigned(index, tables, dim, {"key": "bigint", "cells": "binary", "norm": "bigint"}).drop("distance"))
            moves = assigned(index, tables, dim, {"vector": "array<int>"}).select(F.lit(None).cast("int").alias("cluster"), F.col("cluster").alias("now"), "vector")
        else:
            seen = bounded(told, tables, dim)
            moves = fetched(seen, index, tables, dim)
            still = seen.where(F.col("now") == F.col("cluster")).select("key", "cells", "norm", "cluster")
            told = still.unionByName(moves.select("key", "cells", "norm", F.col("now").alias("cluster")))
        n, total = sums(moves, k, dim)
        counts = [a + b for a, b in zip(counts, n, strict=True)]
        totals = [[a + b for a, b in zip(x, y, strict=True)] for x, y in zip(totals, total, strict=True)]
        centroids = np.array([[x // counts[c] for x in totals[c]] if counts[c] else centroids[c].tolist() for c in range(k)], np.int64)
    last = keep(assigned(index, send(Tables(cells, centroids)), dim, {"vec_id": "bigint"}))
    each = last.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    digests = spark.createDataFrame([(c, ",".join(map(str, x))) for c, x in enumerate(centroids.tolist())], "cluster int, c string").select("cluster", F.sha2("c", 256).alias("centroid_sha256"))
    small = each.crossJoin(each.agg(F.sum("cluster_inertia").alias("inertia"))).join(digests, "cluster")
    return last.join(F.broadcast(small), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")  # k rows


def op11_clusters(spark, sf_dir):
    """The 16 clusters of the embeddings with 64 components; see ``cluster`` for nulls, ties, repeated rows and empty tables."""
    return cluster(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"))
