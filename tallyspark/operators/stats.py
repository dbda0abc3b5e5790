"""Statistics over counts. Rows are counted by Spark; tests run on the counted rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from math import erfc, exp, isfinite, lgamma, sqrt

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from ..functions import columns as X
from ..plans.store import stored
from . import marts


@F.pandas_udf(DoubleType())
def two_prop_p(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
    """One-sided p of the first share being higher, pooled z; 1 where undefined."""

    def p(a: float, n: float, b: float, m: float) -> float:
        if not n or not m or pd.isna(n + m):
            return 1.0
        pooled = (a + b) / (n + m)
        spread = pooled * (1 - pooled) * (1 / n + 1 / m)
        return 0.5 * erfc((a / n - b / m) / sqrt(spread) / sqrt(2)) if spread > 0 else 1.0

    return pd.Series([p(*x) for x in zip(k1, n1, k2, n2, strict=True)], dtype=float)


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p of a 2 x 2 table: tables no likelier than the one at hand."""
    row, column, n = a + b, a + c, a + b + c + d
    choose = lambda x, y: lgamma(x + 1) - lgamma(y + 1) - lgamma(x - y + 1)
    whole = choose(n, column)
    odds = [exp(choose(row, i) + choose(n - row, column - i) - whole) for i in range(max(0, column - (n - row)), min(row, column) + 1)]
    here = odds[a - max(0, column - (n - row))]
    return min(1.0, sum(x for x in odds if x <= here * (1 + 1e-7)))


def rate_test_p(k1: float, n1: float, k2: float, n2: float) -> float:
    """Yates-corrected chi-square, or Fisher's test where an expected count is under 5; 1 for degenerate tables."""
    if pd.isna(k1 + n1 + k2 + n2) or n1 <= 0 or n2 <= 0:
        return 1.0
    a, b, c, d = k1, n1 - k1, k2, n2 - k2
    n = a + b + c + d
    if a + c == 0 or b + d == 0:
        return 1.0
    expected = [(x * y) / n for x in (a + b, c + d) for y in (a + c, b + d)]
    if min(expected) < 5:
        return fisher(int(a), int(b), int(c), int(d))
    off = abs(a - expected[0])
    off -= min(0.5, off)
    return erfc(sqrt(sum(off * off / e for e in expected) / 2))


@F.pandas_udf(DoubleType())
def rate_test(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
    return pd.Series([rate_test_p(*x) for x in zip(k1, n1, k2, n2, strict=True)], dtype=float)


def benjamini_hochberg(df: DataFrame, p: str, family: Sequence[str], tie: Sequence[str], out: str = "q") -> DataFrame:
    """Adjusted p-values within each family; null p-values stay null and don't count."""
    ranked = Window.partitionBy(*family).orderBy(F.asc_nulls_last(p), *tie)
    ahead = ranked.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    scaled = F.when(F.col(p).isNotNull(), F.col(p) * F.count(p).over(Window.partitionBy(*family)) / F.row_number().over(ranked))
    return df.withColumn("_s", scaled).withColumn(out, F.when(F.col(p).isNotNull(), F.least(F.min("_s").over(ahead), F.lit(1.0)))).drop("_s")


#: Value ranges that are ranked side by side.
RANGES = 256


def tie_ranks(values: DataFrame, value: str, by: Sequence[str], ties: Column | None = None, rank: str = "rank") -> DataFrame:
    """Distinct values with how often they occur (the sum of ``ties``; one a row if not given) and their mean rank.

    Values are dealt to ranges by approximate quantiles; ranks are counted within a range and moved by what lies below it, so that no task sorts a whole group.
    """
    n = stored(values.where(F.col(value).isNotNull()).groupBy(*by, value).agg((F.count("*") if ties is None else F.sum(ties)).alias("ties")))
    cuts = n.groupBy(*by).agg(F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000).alias("_cuts"))
    same = reduce(Column.__and__, (F.col(f"n.{c}").eqNullSafe(F.col(f"c.{c}")) for c in by), F.lit(True))
    # how many cuts lie below, by halving: they ascend
    halves = F.array(*(F.lit(RANGES >> i) for i in range(1, RANGES.bit_length())))
    place = F.aggregate(halves, F.lit(0), lambda at, step: at + F.when(F.get("_cuts", at + step - 1) < F.col(f"n.{value}"), step).otherwise(0))
    dealt = n.alias("n").join(F.broadcast(cuts.alias("c")), same).select("n.*", place.alias("_range"))
    sizes = dealt.groupBy(*by, "_range").agg(F.sum("ties").alias("_size"))
    below = sizes.select(*by, "_range", (F.sum("_size").over(Window.partitionBy(*by).orderBy("_range")) - F.col("_size")).alias("_below"))  # at most RANGES rows a group
    up_to = Window.partitionBy(*by, "_range").orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = reduce(Column.__and__, (F.col(f"d.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*by, "_range")))
    inside = dealt.withColumn("_rank", F.sum("ties").over(up_to) - (F.col("ties") - 1) / 2.0)
    return inside.alias("d").join(F.broadcast(below.alias("b")), at).select(*(f"d.{c}" for c in (*by, value, "ties")), (F.col("_below") + F.col("_rank")).alias(rank))


def spearman(df: DataFrame, x: str, y: str, by: Sequence[str], once: bool = True) -> DataFrame:
    """Rank correlation by group; null under 3 rows. With ``once`` the counted rows are stored, so that ``df`` is read once."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(*by, x, y).agg(F.count("*").alias("n"))
    rows = stored(rows) if once else rows
    for c, r in ((x, "rx"), (y, "ry")):
        rows = rows.join(tie_ranks(rows, c, by, F.col("n"), r).drop("ties"), [*by, c])
    s = lambda e: F.sum(F.col("n") * e)
    out = rows.groupBy(*by).agg(F.sum("n").alias("n_rows"), s(F.col("rx")).alias("a"), s(F.col("ry")).alias("b"), s(F.col("rx") * F.col("ry")).alias("ab"), s(F.col("rx") ** 2).alias("aa"), s(F.col("ry") ** 2).alias("bb"))
    m = F.col("n_rows")
    rho = F.try_divide(m * F.col("ab") - F.col("a") * F.col("b"), F.sqrt((m * F.col("aa") - F.col("a") ** 2) * (m * F.col("bb") - F.col("b") ** 2)))
    return out.select(*by, "n_rows", F.when(m >= 3, rho).alias("rho"))


@F.pandas_udf(DoubleType())
def upper_tail(z: pd.Series) -> pd.Series:
    return pd.Series([1.0 if pd.isna(x) else 0.5 * erfc(x / sqrt(2)) for x in z], dtype=float)


def mann_whitney(df: DataFrame, value: str, first: Column, by: Sequence[str]) -> DataFrame:
    """One-sided p that values of ``first`` rows are greater than of the others: normal approximation with ties and continuity; 1 if a side is empty."""
    return mann_whitney_counts(df.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count_if(first).alias("k"), F.count("*").alias("m")), value, by)


def mann_whitney_counts(counts: DataFrame, value: str, by: Sequence[str]) -> DataFrame:
    """The same of counted values: k of the m rows with a value are first ones."""
    ranks = counts.join(tie_ranks(counts, value, by, F.col("m")), [*by, value])
    t = F.col("ties").cast("double")
    s = ranks.groupBy(*by).agg(F.sum("k").alias("n1"), F.sum(F.col("ties") - F.col("k")).alias("n2"), F.sum(F.col("k") * F.col("rank")).alias("r1"), F.sum(t * t * t - t).alias("tied"))
    n1, n2 = F.col("n1").cast("double"), F.col("n2").cast("double")
    n = n1 + n2
    u = F.col("r1") - n1 * (n1 + 1) / 2
    spread = F.sqrt(n1 * n2 / 12 * (n + 1 - F.try_divide(F.col("tied"), n * (n - 1))))
    z = F.try_divide(u - n1 * n2 / 2 - 0.5, spread)
    return s.withColumn("u", u).withColumn("p", upper_tail(z)).select(*by, "n1", "n2", "u", "p")


def compare_to_peers(seg: DataFrame, family: Sequence[str], group: Column | None = None) -> DataFrame:
    """Interval, peers, test, lift and excess loss of each segment."""
    out = marts.with_peers(seg, family, group)
    return out.withColumns({"p": rate_test("n_flagged", "n", "peer_flagged", "peer_n"), "excess_usd": X.half_up(X.excess_loss("rate", "peer_rate", "n", "mean_loss_usd"), 2)})


def cause_psp(fct: DataFrame) -> DataFrame:
    """Share of each cause in a PSP's settled rows against all other PSPs; catch-all causes are left out."""
    rows = marts.settled(fct)
    n = rows.groupBy("merchant_id", "psp").agg(F.count("*").alias("n"))
    k = rows.where(~F.col("likely_cause").isin("tip", "unexplained")).groupBy("merchant_id", "psp", "likely_cause").agg(F.count("*").alias("n_flagged"))
    causes = k.select("merchant_id", "likely_cause").distinct()
    out = n.join(causes, "merchant_id").join(k, ["merchant_id", "psp", "likely_cause"], "left").na.fill(0, ["n_flagged"])
    out = out.withColumn("rate", F.col("n_flagged") / F.col("n"))
    return marts.with_peers(out, ["merchant_id", "likely_cause"]).withColumn("p", rate_test("n_flagged", "n", "peer_flagged", "peer_n"))


def lag_tests(fct: DataFrame, late_days: float = 7.0) -> DataFrame:
    """By country: are lags of payments over 300 USD longer than of the others?"""
    rows = marts.settled(fct)
    late = F.col("settle_lag_days") > late_days
    shares = rows.groupBy("merchant_id", "country").agg(F.count_if("is_over_300").alias("n"), F.count_if(F.col("is_over_300") & late).alias("n_late"), F.count_if(~F.col("is_over_300")).alias("peer_n"), F.count_if(~F.col("is_over_300") & late).alias("peer_late"))
    tests = mann_whitney(rows, "settle_lag_days", F.col("is_over_300"), ["merchant_id", "country"])
    return shares.where("n > 0 and peer_n > 0").join(tests.select("merchant_id", "country", "u", "p"), ["merchant_id", "country"])


#: The model: two factors with their interaction, two factors, two flags.
CROSSED, FACTORS, FLAGS = ("psp", "country"), ("amount_tier", "lag_bucket"), ("is_cross_border", "is_weekend")
GLM = "merchant_id string, term string, odds_ratio double, ci_low double, ci_high double, p double, dropped array<string>"


def glm_design(cells: pd.DataFrame) -> tuple[list[str], np.ndarray]:
    """Names of the terms and their columns: an intercept, each factor's levels but the first, their products for the crossed ones, the flags."""
    coded: dict[str, dict[str, np.ndarray]] = {}
    for f in (*CROSSED, *FACTORS):
        levels = sorted(set(cells[f]))
        coded[f] = {f"C({f})[T.{x}]": (cells[f] == x).to_numpy(float) for x in levels[1:]}
    a, b = (coded[f] for f in CROSSED)
    columns = {"Intercept": np.ones(len(cells))} | a | b | coded[FACTORS[0]] | coded[FACTORS[1]] | {f"{x}:{y}": u * v for x, u in a.items() for y, v in b.items()} | {f: cells[f].to_numpy(float) for f in FLAGS}
    return list(columns), np.column_stack(list(columns.values()))


def logistic(x: np.ndarray, k: np.ndarray, n: np.ndarray, most: int = 100, close: float = 1e-8) -> tuple[np.ndarray, np.ndarray] | None:
    """Coefficients and standard errors of k of n by iteratively reweighted least squares; None if it doesn't settle or every row is predicted perfectly.

    Columns that hang together share the effect (the solution of least norm); the errors are those of the generalised inverse.
    """
    y = k / n
    mu, before = (y * n + 0.5) / (n + 1), np.inf
    for _ in range(most):
        weight = np.maximum(n * mu * (1 - mu), 1e-300)
        linear = np.log(mu / (1 - mu)) + n * (y - mu) / weight
        inverse = np.linalg.pinv(x.T @ (x * weight[:, None]), hermitian=True)
        beta = inverse @ (x.T @ (weight * linear))
        mu = np.clip(1 / (1 + np.exp(-np.clip(x @ beta, -700, 700))), 1e-12, 1 - 1e-12)
        deviance = -2 * float((k * np.log(mu) + (n - k) * np.log(1 - mu)).sum())
        if abs(y - mu).max() < 1e-10:
            return None
        if abs(deviance - before) < close:
            weight = n * mu * (1 - mu)
            return beta, np.sqrt(np.maximum(np.diag(np.linalg.pinv(x.T @ (x * weight[:, None]), hermitian=True)), 0.0))
        before = deviance
    return None


def fit_cells(cells: pd.DataFrame, min_cell: int) -> pd.DataFrame:
    """Odds ratios of one merchant's counted cells. If the fit fails, the rows of psp x country cells with under ``min_cell`` rows are dropped and it is made once more; no rows if that fails as well."""
    cells = cells.dropna(subset=[*CROSSED, *FACTORS, *FLAGS])
    sizes = cells.groupby([*CROSSED])["n"].transform("sum")
    small = cells[sizes < min_cell]
    dropped = sorted({f"{p}|{c}" for p, c in zip(small["psp"], small["country"], strict=True)})
    for rows, gone in ((cells, []), (cells[sizes >= min_cell], dropped)):
        if len(rows):
            names, x = glm_design(rows)
            found = logistic(x, rows["k"].to_numpy(float), rows["n"].to_numpy(float))
            if found is not None:
                beta, error = found
                with np.errstate(over="ignore", divide="ignore", invalid="ignore"):
                    z = np.abs(beta) / error
                    odds, low, high = np.exp(beta), np.exp(beta - X.Z95 * error), np.exp(beta + X.Z95 * error)
                p = [erfc(v / sqrt(2)) if isfinite(v) else float("nan") if np.isnan(v) else 0.0 for v in z]
                return pd.DataFrame({"merchant_id": cells["merchant_id"].iloc[0], "term": names, "odds_ratio": odds, "ci_low": low, "ci_high": high, "p": p, "dropped": [gone] * len(names)})
    return pd.DataFrame(columns=[c.split()[0] for c in GLM.split(", ")])


def fit_glm(fct: DataFrame, min_cell: int = 200) -> DataFrame:
    """``GLM``: odds ratios of being flagged, of all merchants at once: psp, country, both together, tier, lag bucket, border, weekend.

    Rows are counted by the values of the terms; a merchant's cells (a few thousand at most, whatever its rows) meet in one task, which fits them (see ``fit_cells``).
    """
    flag = lambda c: F.coalesce(F.col(c), F.lit(False)).cast("int").alias(c)
    rows = marts.settled(fct).select("merchant_id", *CROSSED, *FACTORS, *map(flag, FLAGS), F.coalesce("is_meaningful", F.lit(False)).alias("hit"))
    cells = rows.groupBy("merchant_id", *CROSSED, *FACTORS, *FLAGS).agg(F.count("*").alias("n"), F.count_if("hit").alias("k"))
    return cells.groupBy("merchant_id").applyInPandas(lambda group: fit_cells(group, min_cell), GLM)
