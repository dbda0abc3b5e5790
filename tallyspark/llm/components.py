"""Connected components of a graph of links, by alternating star contractions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep


def components(links: DataFrame) -> DataFrame:
    """(node, root) of every linked node but the roots themselves; root is the smallest node reachable.

    ``links`` has a and b of one orderable type. In turn, each node passes its larger neighbours on to its smallest neighbour, and then its
    smaller ones; when nothing changes, every edge leads to a root. Each turn is written out, which cuts the lineage.
    """
    pair = lambda a, b: F.struct(F.col(a).alias("a"), F.col(b).alias("b"))
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = None
    while True:
        both = edges.select(F.explode(F.array(pair("a", "b"), pair("b", "a"))).alias("e")).select("e.*")
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.explode(F.array(F.struct(F.col("b").alias("a"), F.col("m").alias("b")), F.struct("a", F.col("m").alias("b")))).alias("e")).select("e.*")
        edges = keep(small.where("a <> b").distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == state:
            return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
        state = now
