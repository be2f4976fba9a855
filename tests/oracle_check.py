"""Run registered queries beside their SQL twins: python tests/oracle_check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time
from decimal import Decimal
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def plain(v):
    if isinstance(v, Decimal):
        v = float(v)
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if isinstance(v, dt.datetime):
        return v.isoformat()
    if isinstance(v, dt.date):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [[plain(r[i]) for i in order] for r in rows]
    return sorted(out, key=lambda r: [(x is None, str(type(x)), str(x)) for x in r])


def same(a, b):
    if isinstance(a, list) and isinstance(b, list):
        return len(a) == len(b) and all(same(x, y) for x, y in zip(a, b))
    if isinstance(a, (int, float)) and isinstance(b, (int, float)) and not isinstance(a, bool):
        return a == b
    return a == b and isinstance(a, type(b))


def duck(folder):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    return con


def compare(spark, con, name, folder, queries, oracles):
    begun = time.time()
    df = queries[name](spark, folder)
    table = df.toArrow()
    rows = list(zip(*[table.column(c).to_pylist() for c in df.columns])) if table.num_rows else []
    spent = time.time() - begun
    if name not in oracles:
        return f"rows={len(rows)} (no sql) spark={spent:.1f}s", True
    cur = con.execute(oracles[name])
    names = [d[0] for d in cur.description]
    expected = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns differ: {sorted(df.columns)} / {sorted(names)}", False
    a, b = rows_of(df.columns, rows), rows_of(names, expected)
    if len(a) != len(b):
        return f"rows {len(a)} / {len(b)}", False
    bad = [(x, y) for x, y in zip(a, b) if not all(same(p, q) for p, q in zip(x, y))]
    if bad:
        shown = "\n".join(f"    spark {x}\n    sql   {y}" for x, y in bad[:3])
        return f"{len(bad)} of {len(a)} rows differ {sorted(names)}\n{shown}", False
    nonnull = len([1 for r in a if any(v is not None and v != 0 for v in r)])
    return f"rows={len(a)} nonempty={nonnull} spark={spent:.1f}s", True


def main(argv):
    from __spark_entry__ import oracle_sql, queries

    from marketframe.session import local_session

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    spark = local_session(cores=int(os.environ.get("CHECK_CORES", "8")))
    folder = f"/root/testdata/sf{sf}"
    con = duck(folder)
    q, o = queries(), oracle_sql()
    failed = []
    for name in q:
        if wanted and not any(name.startswith(w) for w in wanted):
            continue
        start = time.time()
        try:
            text, ok = compare(spark, con, name, folder, q, o)
        except Exception as exc:  # report and go on with the next query
            text, ok = f"{type(exc).__name__}: {str(exc)[:600]}", False
        if not ok:
            failed.append(name)
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {text}", flush=True)
    print(f"failed: {failed}")
    spark.stop()
    return 1 if failed else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
