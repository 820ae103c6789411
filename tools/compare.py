"""Rows of Spark and of DuckDB in one form, so that they can be compared value by value."""
import datetime
import decimal
import math
import os


def norm(v):
    if isinstance(v, decimal.Decimal):
        return f"DEC {v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else (0.0 if v == 0 else v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(norm(x) for x in v)
    return v


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(([norm(r[i]) for i in order] for r in rows), key=repr)


def views(con, folder):
    """A view per table of the folder."""
    for f in os.listdir(folder):
        path = f"{folder}/{f}"
        con.execute(f"create view {f[:-8]} as select * from '{path}{'/*.parquet' if os.path.isdir(path) else ''}'")
    return con
