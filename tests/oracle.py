"""Run registered queries beside their SQL in DuckDB: python tests/oracle.py [sf_dir] [name ...]"""

import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows_of_duckdb(sf_dir, sql):
    import duckdb

    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    cur = con.execute(sql)
    return [d[0] for d in cur.description], cur.fetchall()


def canonical(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def value(v):
        if isinstance(v, float):
            return f"{v:.6g}"
        if hasattr(v, "isoformat"):
            return v.isoformat()
        return str(v)

    return sorted(columns), sorted(tuple(value(r[i]) for i in order) for r in rows)


def compare(spark, name, fn, sql, sf_dir):
    """None if equal, else what differs."""
    df = fn(spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    if sql is None:
        return None if rows else "no rows"
    a, b = canonical(df.columns, rows), canonical(*rows_of_duckdb(sf_dir, sql))
    if a[0] != b[0]:
        return f"columns {a[0]} and {b[0]}"
    if len(a[1]) != len(b[1]):
        return f"{len(a[1])} and {len(b[1])} rows"
    bad = [(x, y) for x, y in zip(a[1], b[1], strict=True) if x != y]
    return f"{len(bad)} rows differ, first {bad[0]}" if bad else None


if __name__ == "__main__":
    import __spark_entry__ as e

    from tidemark.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    os.environ["PYTHONPATH"] = str(Path(__file__).resolve().parent.parent)
    spark = build_session("oracle", f"local[{os.environ.get('ORACLE_CPUS', '8')}]", 8, **{"spark.ui.enabled": "false", "spark.driver.memory": "8g"})
    spark.sparkContext.setLogLevel("ERROR")
    sqls = e.oracle_sql()
    for name, fn in e.queries().items():
        if sys.argv[2:] and name not in sys.argv[2:]:
            continue
        began = time.time()
        try:
            said = compare(spark, name, fn, sqls.get(name), sf)
        except Exception as x:
            said = f"{type(x).__name__}: {str(x)[:600]}"
        print(f"{name:34s} {'ok' if said is None else 'BAD ' + said} {'' if name in sqls else '(rows only) '}{time.time() - began:.1f}s", flush=True)
