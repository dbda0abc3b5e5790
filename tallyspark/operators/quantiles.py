"""Exact quantiles by group, without a buffer that holds a group's values."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Ranges of values for each unit of the logarithm: one range spans 1.6 percent of a value (of one more than it, for small ones).
STEPS = 64


def same(left: str, right: str, keys: Sequence[str]) -> Column:
    """Equal keys of two aliased tables; nulls are equal to each other."""
    return reduce(Column.__and__, (F.col(f"{left}.{c}").eqNullSafe(F.col(f"{right}.{c}")) for c in keys), F.lit(True))


def exact_quantiles(rows: DataFrame, value: str, by: Sequence[str], wanted: dict[str, float], ties: str | None = None) -> DataFrame:
    """``by`` and one column for each name in ``wanted``: the quantile at that share, interpolated as ``percentile`` does. Nulls don't count; groups without values give no row.
    ``ties`` names a column that says how often a row counts (once, if not given).

    Distinct values are counted first and dealt to ranges by their logarithm, which keeps their order; only those ranges that hold a wanted place are put in order, found
    by running totals of the ranges' sizes. A task thus sorts the distinct values of one range, however many rows repeat them, and may spill; where all values of a
    group lie within 1.6 percent of each other, that is all of its distinct values. NaN is greater than all numbers.
    """
    by = list(by)
    x = F.col("_v").cast("double")
    of = F.when(F.isnan(x), F.lit(2**63 - 1)).otherwise(F.floor(F.signum(x) * F.log1p(F.abs(x)) * STEPS))
    n = rows.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_v")).agg((F.sum(ties) if ties else F.count("*")).alias("_n"))
    dealt = n.withColumn("_r", of)
    # at most some 90,000 rows a group, as doubles have no more ranges
    group, ahead = Window.partitionBy(*by), Window.partitionBy(*by).orderBy("_r")
    sizes = dealt.groupBy(*by, "_r").agg(F.sum("_n").alias("_size"))
    sizes = sizes.select(*by, "_r", "_size", (F.sum("_size").over(ahead) - F.col("_size")).alias("_below"), (F.sum("_size").over(group) - 1).alias("_last"))
    at = {name: F.col("_last") * F.lit(float(share)) for name, share in wanted.items()}
    ends = [end(place) for place in at.values() for end in (F.floor, F.ceil)]
    holds = reduce(Column.__or__, ((x >= F.col("_below")) & (x < F.col("_below") + F.col("_size")) for x in ends))
    picked = sizes.where(holds)
    up_to = Window.partitionBy(*by, "_r").orderBy("_v").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = dealt.alias("d").join(picked.alias("s"), same("d", "s", [*by, "_r"])).select("d.*", "_below", "_last")
    placed = placed.withColumn("_to", F.col("_below") + F.sum("_n").over(up_to)).withColumn("_from", F.col("_to") - F.col("_n"))
    held = lambda x: F.max(F.when((x >= F.col("_from")) & (x < F.col("_to")), F.col("_v")))
    found = placed.groupBy(*by).agg(F.max("_last").alias("_last"), *(held(end(place)).alias(f"_{side}_{name}") for name, place in at.items() for side, end in (("low", F.floor), ("high", F.ceil))))

    def between(name: str, place: Column) -> Column:
        low, high = F.col(f"_low_{name}"), F.col(f"_high_{name}")
        return F.when(low == high, low.cast("double")).otherwise((F.ceil(place) - place) * low + (place - F.floor(place)) * high)

    return found.select(*by, *(between(name, place).alias(name) for name, place in at.items()))


def with_quantiles(grouped: DataFrame, rows: DataFrame, value: str, by: Sequence[str], wanted: dict[str, float], ties: str | None = None) -> DataFrame:
    """``grouped`` (one row for each ``by``) with the quantiles of ``rows`` beside it; null where a group has no value."""
    found = exact_quantiles(rows, value, by, wanted, ties)
    return grouped.alias("g").join(found.alias("f"), same("g", "f", by), "left").select("g.*", *(f"f.{name}" for name in wanted))


def medians(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """One row with the median of each of ``values``, read in one pass; null where there are none."""
    pairs = F.array(*(F.struct(F.lit(name).alias("name"), c.cast("double").alias("value")) for name, c in values.items()))
    long = rows.select(F.explode(F.filter(pairs, lambda x: x["value"].isNotNull())).alias("m")).select("m.*")
    found = exact_quantiles(long, "value", ["name"], {"median": 0.5})
    return found.agg(*(F.max(F.when(F.col("name") == name, F.col("median"))).alias(name) for name in values))
