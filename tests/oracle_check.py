"""Run registered queries next to their DuckDB text and compare: python tests/oracle_check.py [sf] [names…]."""

from __future__ import annotations

import datetime
import math
import sys
import time
from collections import Counter
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb  # noqa: E402

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{sf_dir}/{name}.parquet')")
    return con


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    if isinstance(value, int):
        return repr(float(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    return str(value)


def bag(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(_plain(r[i]) for i in order) for r in rows)


def compare(df, con, sql) -> tuple[bool, str]:
    result = con.execute(sql)
    columns = [d[0] for d in result.description]
    expected = bag(result.fetchall(), columns)
    got = bag([tuple(r) for r in df.collect()], df.columns)
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got == expected:
        return True, f"{sum(got.values())} rows"
    missing, extra = expected - got, got - expected
    return False, (
        f"{sum(got.values())} rows, oracle {sum(expected.values())}; {sorted(columns)}\n"
        f"   oracle only ({sum(missing.values())}): {list(missing)[:3]}\n"
        f"   spark only ({sum(extra.values())}): {list(extra)[:3]}"
    )


def main(argv: list[str]) -> int:
    import __spark_entry__ as entry
    from labelspark.session import local_session

    scale = argv[0] if argv else "0.01"
    sf_dir = f"/root/testdata/sf{scale}"
    spark = local_session()
    con = connect(sf_dir)
    queries, oracles = entry.queries(), entry.oracle_sql()
    names = argv[1:] or list(queries)
    bad = 0
    for name in names:
        started = time.time()
        try:
            df = queries[name](spark, sf_dir)
            if name in oracles:
                ok, note = compare(df, con, oracles[name])
            else:
                ok, note = True, f"rows only: {len(df.collect())}"
        except Exception as problem:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(problem).__name__}: {str(problem)[:700]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name:<28} {time.time() - started:6.2f}s  {note}", flush=True)
    print(f"{len(names) - bad}/{len(names)} good")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
