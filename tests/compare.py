"""Compare a registered query with its SQL on the same Parquet tables."""

from __future__ import annotations

import math
import os

import duckdb

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        path = os.path.join(sf_dir, f"{t}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{path}'")
    return con


def norm(v):
    if v is None:
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return f"{v:.6g}" if abs(v) < 1e12 else f"{v:.10g}"
    if isinstance(v, int):
        return f"{float(v):.6g}" if abs(v) < 10**6 else str(v)
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, sorted((tuple(norm(r[c]) for c in cols) for r in df.collect()), key=repr)


def rows_of_sql(con, sql):
    cur = con.execute(sql)
    names = [c[0] for c in cur.description]
    order = sorted(range(len(names)), key=lambda i: names[i])
    rows = sorted((tuple(norm(r[i]) for i in order) for r in cur.fetchall()), key=repr)
    return [names[i] for i in order], rows


def difference(df, con, sql) -> str | None:
    """None when equal, else a short report."""
    sc, sr = rows_of_spark(df)
    oc, orows = rows_of_sql(con, sql)
    if sc != oc:
        return f"columns differ: {sc} / {oc}"
    if sr == orows:
        return None
    a, b = set(sr), set(orows)
    only_s = [r for r in sr if r not in b][:3]
    only_o = [r for r in orows if r not in a][:3]
    return f"rows {len(sr)} / {len(orows)}; only spark {only_s}; only sql {only_o}"
