"""Compare registered queries with their SQL oracles in DuckDB.

Usage: python -m tests.oracle_check [sf] [name-prefix ...]
"""

from __future__ import annotations

import collections
import datetime
import math
import sys
import time

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def canon(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, (list, tuple)):
        return tuple(canon(x) for x in v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return repr(v)


DUCK_TO_SPARK = {
    "BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "BOOLEAN": "boolean",
    "DATE": "date", "TIMESTAMP": "timestamp_ntz", "FLOAT": "float", "INTEGER[]": "array<int>",
    "DOUBLE[]": "array<double>", "BIGINT[]": "array<bigint>", "VARCHAR[]": "array<string>",
}


def compare(query, spark, con, sf_dir):
    """List of problems (empty when equal), number of rows."""
    df = query(spark, sf_dir)
    names = sorted(df.columns)
    got = collections.Counter(tuple(canon(r[c]) for c in names) for r in df.collect())
    if query.sql is None:
        return [], sum(got.values())
    res = con.execute(query.sql)
    cols = [(d[0], str(d[1])) for d in res.description]
    problems = []
    if sorted(c for c, _ in cols) != names:
        return [f"columns {names} != {sorted(c for c, _ in cols)}"], sum(got.values())
    types = dict(df.dtypes)
    for c, t in cols:
        if DUCK_TO_SPARK.get(t, t) != types[c]:
            problems.append(f"type of {c}: spark {types[c]}, sql {t}")
    order = [[c for c, _ in cols].index(n) for n in names]
    want = collections.Counter(tuple(canon(r[i]) for i in order) for r in res.fetchall())
    if got != want:
        extra, missing = got - want, want - got
        problems.append(
            f"rows {sum(got.values())} vs {sum(want.values())}; only spark {sum(extra.values())}: "
            f"{list(extra)[:2]}; only sql {sum(missing.values())}: {list(missing)[:2]}"
        )
    return problems, sum(got.values())


def main(argv):
    from tests.conftest import make_session
    from tallyloom.plans import REGISTRY

    sf = argv[1] if len(argv) > 1 else "0.01"
    prefixes = argv[2:] or [""]
    sf_dir = f"/root/testdata/sf{sf}"
    spark, con = make_session(), connect(sf_dir)
    bad = 0
    for name, q in REGISTRY.items():
        if not any(name.startswith(p) for p in prefixes):
            continue
        t0 = time.time()
        try:
            problems, n = compare(q, spark, con, sf_dir)
        except Exception as e:  # report and go on with the next query
            problems, n = [f"{type(e).__name__}: {str(e)[:1200]}"], -1
        kind = "sql " if q.sql else "rows"
        print(f"{'OK  ' if not problems and n else 'BAD '} {kind} {name} rows={n} {time.time() - t0:.2f}s", flush=True)
        for p in problems:
            print("      ", p[:1500], flush=True)
        bad += bool(problems) or n == 0
    print("bad:", bad)


if __name__ == "__main__":
    main(sys.argv)
