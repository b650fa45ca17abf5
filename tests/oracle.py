"""Compare a query with its SQL in DuckDB, regardless of row order."""

import datetime
import decimal
import glob
import os

import duckdb


def duck(sf_dir):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for path in glob.glob(f"{sf_dir}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM read_parquet('{path}{'/*.parquet' if os.path.isdir(path) else ''}')")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9) + 0.0
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, list | tuple):
        return tuple(map(plain, v))
    return v


def difference(spark_df, con, sql):
    """None if equal, else a short account."""
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = [dict(zip(names, r, strict=True)) for r in cur.fetchall()]
    got = [r.asDict() for r in spark_df.collect()]
    if sorted(names) != sorted(spark_df.columns):
        return f"columns {sorted(spark_df.columns)} and {sorted(names)}"
    cols = sorted(names)
    key = lambda r: tuple((r[c] is None, str(type(plain(r[c])).__name__), plain(r[c]) if r[c] is not None else 0) for c in cols)
    a, b = sorted(map(key, got)), sorted(map(key, want))
    if a == b:
        return None if a else "both are empty"
    odd = [(x, y) for x, y in zip(a, b, strict=False) if x != y][:2]
    return f"{len(a)} and {len(b)} rows; {odd}"
