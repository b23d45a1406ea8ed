import duckdb

TABLES = ("documents", "labels", "benchmark")


def duck(sf_dir=None, **frames):
    """DuckDB with the tables of a folder, or with given pandas frames."""
    con = duckdb.connect()
    for t in TABLES if sf_dir else ():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    for t, pdf in frames.items():
        con.register(t, pdf)
    return con


def multiset(rows, digits=6):
    def norm(v):
        if isinstance(v, float):
            return round(v, digits)
        return tuple(v) if isinstance(v, list) else v
    return sorted((tuple(norm(v) for v in r) for r in rows), key=repr)


def same_rows(df, con, sql):
    """Compare a DataFrame with a DuckDB query as multisets of rows."""
    cols = sorted(df.columns)
    got = multiset([tuple(r[c] for c in cols) for r in df.collect()])
    res = con.sql(sql)
    assert sorted(res.columns) == cols
    want = multiset(res.select(*[duckdb.ColumnExpression(c) for c in cols]).fetchall())
    assert got == want
    return len(got)
