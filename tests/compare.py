"""Runs registered queries and their SQL side by side and compares the rows."""

from __future__ import annotations

import math
import sys
import time
import traceback

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(x):
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 9) + 0.0
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, sf_dir: str, query, sql: str) -> str:
    """What differs, or an empty text."""
    got = query(spark, sf_dir)
    a = rows_of(got.columns, [tuple(r) for r in got.collect()])
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    out = con.execute(sql)
    b = rows_of([c[0] for c in out.description], out.fetchall())
    if a[0] != b[0]:
        return f"columns {set(a[0]) ^ set(b[0])}"
    if a[1] != b[1]:
        only = [x for x in a[1] if x not in set(b[1])][:2], [x for x in b[1] if x not in set(a[1])][:2]
        return f"{len(a[1])} and {len(b[1])} rows; only here {only[0]}; only there {only[1]}"
    return "" if a[1] else "no rows"


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from conftest import session

    import __spark_entry__ as entry

    spark, sql = session(), entry.oracle_sql()
    for name, query in entry.queries().items():
        if (sys.argv[2:] and name not in sys.argv[2:]) or (not sys.argv[2:] and name[:2] == "op" or name == "pipeline"):
            continue
        began = time.time()
        try:
            said = compare(spark, sys.argv[1], query, sql[name]) if name in sql else f"rows: {len(query(spark, sys.argv[1]).collect())}"
        except Exception:
            said = traceback.format_exc(limit=-2)[-700:]
        print(f"{name}: {said or 'same'} ({time.time() - began:.1f} s)", flush=True)
