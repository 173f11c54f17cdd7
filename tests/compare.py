"""Run registered queries against their checking SQL on the stored tables."""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def database(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None:
        return None
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v
    if isinstance(v, bool):
        return v
    if isinstance(v, int):
        return v
    return str(v)


def key(row):
    return tuple((x is None, type(x).__name__, str(x)) for x in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(plain(r[n]) for n in names) for r in df.collect()), key=key)


def rows_of_sql(con, sql):
    result = con.execute(sql)
    cols = [d[0] for d in result.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    rows = sorted((tuple(plain(r[i]) for i in order) for r in result.fetchall()), key=key)
    return [cols[i] for i in order], rows


def check(spark, con, sf_dir, name, run, sql):
    names, got = rows_of_spark(run(spark, sf_dir))
    if sql is None:
        return f"rows only ({len(got)})"
    wanted_names, wanted = rows_of_sql(con, sql)
    if names != wanted_names:
        return f"FAIL columns {names} != {wanted_names}"
    if len(got) != len(wanted):
        return f"FAIL rows {len(got)} != {len(wanted)}; only spark {[r for r in got if r not in wanted][:2]}; only sql {[r for r in wanted if r not in got][:2]}"
    bad = [(a, b) for a, b in zip(got, wanted) if a != b]
    if bad:
        diff = [(n, x, y) for a, b in bad[:3] for n, x, y in zip(names, a, b) if x != y]
        return f"FAIL {len(bad)} of {len(got)} rows differ, first {str(diff)[:900]}"
    return f"ok ({len(got)})"


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    from pageforge.session import local_session
    import __spark_entry__ as entry

    sf_dir = os.environ.get("SF_DIR", "/root/testdata/sf0.01")
    wanted = sys.argv[1:]
    spark, con = local_session(), database(sf_dir)
    oracles, failed = entry.oracle_sql(), 0
    for name, run in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        t = time.time()
        try:
            verdict = check(spark, con, sf_dir, name, run, oracles.get(name))
        except Exception as problem:  # noqa: BLE001
            verdict = f"FAIL {type(problem).__name__} {str(problem)[:1500]}"
        failed += verdict.startswith("FAIL")
        print(f"{name:32s} {time.time() - t:6.2f}s  {verdict}", flush=True)
    print("failed:", failed)
