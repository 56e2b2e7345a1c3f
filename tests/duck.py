"""The given tables in DuckDB, and rows in a form that two engines can be compared by."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connected(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def normal(v):
    if isinstance(v, float):
        return "NaN" if v != v else repr(round(v, 9) + 0.0)
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(normal, v)) + "]"
    return "NULL" if v is None else str(v)


def rows(table):
    names = sorted(table.column_names)
    return sorted("|".join(normal(r[c]) for c in names) for r in table.to_pylist())
