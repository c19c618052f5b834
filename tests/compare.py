"""Run bound queries and their SQL side by side.

    python tests/compare.py SF_DIR [name-substring ...]
"""

from __future__ import annotations

import glob
import hashlib
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def plain(value):
    if value is None:
        return None
    if isinstance(value, float):
        return None if math.isnan(value) else round(value, 6)
    if isinstance(value, (list, tuple)):
        return tuple(plain(v) for v in value)
    return value


def digest(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    lines = sorted(repr(tuple(plain(row[i]) for i in order)) for row in rows)
    return [columns[i] for i in order], lines, hashlib.md5("\n".join(lines).encode()).hexdigest()


def connect(sf_dir):
    con = duckdb.connect()
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        name = os.path.basename(path)[: -len(".parquet")]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def main(sf_dir, wanted):
    import __spark_entry__ as entry
    from fitweave.session import local_session

    spark = local_session(int(os.environ.get("COMPARE_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    oracle = entry.oracle_sql()
    bad = []
    for name, build in entry.queries().items():
        if wanted and not any(w in name for w in wanted):
            continue
        try:
            start = time.time()
            df = build(spark, sf_dir)
            rows = [tuple(r) for r in df.collect()]
            spent = time.time() - start
            columns, lines, mark = digest(df.columns, rows)
            if name not in oracle:
                print(f"ROWS {name} rows={len(rows)} {spent:.1f}s", flush=True)
                continue
            start = time.time()
            cursor = con.execute(oracle[name])
            other = cursor.fetchall()
            sql_spent = time.time() - start
            other_columns, other_lines, other_mark = digest([d[0] for d in cursor.description], other)
            if columns == other_columns and mark == other_mark:
                print(f"OK   {name} rows={len(rows)} {spent:.1f}s sql={sql_spent:.1f}s", flush=True)
                if not rows:
                    print("     (no rows!)")
                continue
            bad.append(name)
            print(f"BAD  {name} rows={len(rows)}/{len(other)} cols={columns} / {other_columns}")
            a, b = set(lines), set(other_lines)
            for line in sorted(a - b)[:3]:
                print("   spark:", line[:600])
            for line in sorted(b - a)[:3]:
                print("   sql:  ", line[:600])
        except Exception as error:  # noqa: BLE001 - report and go on
            bad.append(name)
            print(f"FAIL {name}: {str(error)[:900]}", flush=True)
    print("bad:", bad)
    return bad


if __name__ == "__main__":
    sys.exit(bool(main(sys.argv[1], sys.argv[2:])))
