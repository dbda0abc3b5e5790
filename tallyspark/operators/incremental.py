"""Late settlements: which rows to build again, and how to put them in place."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import columns as X
from ..plans.store import stored


def restated_rows(new: DataFrame, prev: DataFrame, days: int = 15) -> DataFrame:
    """Rows of the window before the last data time, rows that were pending, and rows not seen before."""
    since = prev.agg((F.max(X.as_of()) - F.make_dt_interval(F.lit(days))).alias("_since"))
    seen = prev.select("transaction_id", (F.col("status") == "pending").alias("_was_open"))
    rows = new.crossJoin(F.broadcast(since)).join(seen, "transaction_id", "left")
    return rows.where((X.as_of() >= F.col("_since")) | F.coalesce("_was_open", F.lit(True)) | F.col("_since").isNull()).drop("_since", "_was_open")


def scope_closure(changed: DataFrame, prev_fact: DataFrame) -> DataFrame:
    """Ids to build again so that counts over (psp, currency, residual) equal those of a full build: all rows that share an old or new key."""
    key = ["psp", "currency", "residual"]
    old = prev_fact.join(changed.select("transaction_id"), "transaction_id", "left_semi").select(key)
    keys = changed.select(key).union(old).where("residual is not null").distinct()
    return changed.select("transaction_id").union(prev_fact.join(keys, key, "left_semi").select("transaction_id")).distinct()


def delete_insert(prev: DataFrame, delta: DataFrame, key: str = "transaction_id") -> DataFrame:
    return prev.join(delta.select(key), key, "left_anti").unionByName(delta)


def replay_lookback(date_from: str, as_of: str) -> int:
    """Days to look back so that a replay from ``date_from`` covers its range."""
    from datetime import date

    return max((date.fromisoformat(as_of[:10]) - date.fromisoformat(date_from)).days + 1, 1)


def incremental_fact(new_staged: DataFrame, prev_fact: DataFrame, build, days: int = 15) -> DataFrame:
    """``build`` (staged rows -> fact rows) applied to what changed and what shares its keys, in place of the old rows.

    Both builds are written down before they are filtered: filters on formulas of formulas would be expanded without end.
    """
    touched = stored(build(restated_rows(new_staged, prev_fact, days)).select("transaction_id", "psp", "currency", "residual"))
    scope = stored(scope_closure(touched, prev_fact))
    return delete_insert(prev_fact, stored(build(new_staged.join(scope, "transaction_id", "left_semi"))))
