"""Runs registered queries and their checking SQL side by side.

``python -m tests.oracle <sf> [name ...]`` prints one line per query.
"""

from __future__ import annotations

import math
import sys
import time
from decimal import Decimal
from pathlib import Path

import __spark_entry__ as entry

ROOT = "/root/testdata"


def connect(sf_dir: str):
    import duckdb

    con = duckdb.connect()
    for path in sorted(Path(sf_dir).glob("*.parquet")):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}'")
    return con


def _cell(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return 0.0 if v == 0 else v
    if isinstance(v, Decimal):
        return float(v)
    if isinstance(v, (list, tuple)):
        return tuple(_cell(x) for x in v)
    return v


def _rows(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    out = [tuple(_cell(r[i]) for i in order) for r in rows]
    return sorted(out, key=repr)


def kinds_of_spark(df):
    return {
        n: {"int": "INTEGER", "bigint": "BIGINT", "double": "DOUBLE", "string": "VARCHAR",
            "boolean": "BOOLEAN", "float": "FLOAT"}.get(t, t)
        for n, t in df.dtypes
    }


def compare(spark, con, name: str, sf_dir: str) -> tuple[bool, str]:
    """(agrees, remark) for one query."""
    df = entry.queries()[name](spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    sql = entry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows, no SQL"
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    types = {d[0]: str(d[1]) for d in cur.description}
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} against {sorted(names)}"
    spark_types = kinds_of_spark(df)
    off = {n: (spark_types[n], types[n]) for n in names if spark_types[n] != types[n]}
    a, b = _rows(df.columns, got), _rows(names, want)
    if len(a) != len(b):
        return False, f"{len(a)} rows against {len(b)}"
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    if bad:
        return False, f"{len(bad)} of {len(a)} rows differ, first {str(bad[0])[:600]}"
    return not off, f"{len(a)} rows" + (f", types {off}" if off else "")


def main(argv):
    from titleq.session import build_session

    sf_dir = f"{ROOT}/sf{argv[0]}"
    spark = build_session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    names = argv[1:] or list(entry.queries())
    names = [n for n in entry.queries() if any(n == a or (a.endswith("*") and n.startswith(a[:-1])) for a in names)]
    wrong = 0
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, name, sf_dir)
        except Exception as e:  # noqa: BLE001
            ok, note = False, f"{type(e).__name__}: {str(e)[:700]}"
        wrong += not ok
        print(f"{'ok ' if ok else 'BAD'} {name} {time.time() - start:.1f}s {note}", flush=True)
    print(f"{len(names)} queries, {wrong} wrong")


if __name__ == "__main__":
    main(sys.argv[1:])
