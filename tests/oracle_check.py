"""Run registered queries next to their SQL twins and compare values.

``python tests/oracle_check.py [sf_dir] [name …]`` prints one line per query;
`compare` is what the test suite uses.
"""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))


def connect(sf_dir: str):
    con = duckdb.connect()
    for file in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM read_parquet('{file}')")
    return con


def _plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(_plain(v) for v in value)
    if isinstance(value, dict):
        return tuple(sorted((str(k), _plain(v)) for k, v in value.items()))
    return value


def _sorted_rows(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(_plain(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def compare(df, sql, con) -> str:
    """Empty when both sides agree, else what differs."""
    result = con.execute(sql)
    want_columns, want = _sorted_rows([d[0] for d in result.description], result.fetchall())
    got_columns, got = _sorted_rows(df.columns, [tuple(r) for r in df.collect()])
    if got_columns != want_columns:
        return f"columns {got_columns} != {want_columns}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    for a, b in zip(got, want):
        if a != b:
            return f"{sum(x != y for x, y in zip(got, want))} rows differ: {a!r} != {b!r}"[:600]
    return ""


if __name__ == "__main__":
    from maskframe.catalog import ORACLE_SQL, QUERIES
    from maskframe.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(QUERIES)
    session, con = local_session(), connect(sf)
    failed = 0
    for name in names:
        start = time.time()
        try:
            df = QUERIES[name](session, sf)
            problem = compare(df, ORACLE_SQL[name], con) if name in ORACLE_SQL else ""
            rows = "" if name in ORACLE_SQL else f" rows={df.count()} (no twin)"
        except Exception as error:  # noqa: BLE001
            problem, rows = f"{type(error).__name__}: {str(error)[:700]}", ""
        failed += bool(problem)
        print(f"{'FAIL' if problem else 'ok  '} {name} {time.time() - start:.1f}s{rows} {problem}", flush=True)
    print(f"{len(names) - failed}/{len(names)} ok")
