"""Side-by-side run of a query in Spark and its SQL in DuckDB."""

import duckdb
import pandas as pd

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(df: pd.DataFrame) -> list[tuple]:
    def one(v):
        if v is None or v is pd.NaT or v is pd.NA or (isinstance(v, float) and v != v):
            return "NULL"
        if isinstance(v, float) and v != int(v):
            return repr(round(v, 9))
        # Pandas holds integers among nulls as floats.
        return str(int(v)) if isinstance(v, float) else str(v)

    return sorted(tuple(one(v) for v in row) for row in df[sorted(df.columns)].itertuples(index=False))


def check(spark, name, query, sql, sf_dir):
    got, want = query(spark, sf_dir).toPandas(), connect(sf_dir).execute(sql).fetchdf()
    assert sorted(got.columns) == sorted(want.columns), name
    assert plain(got) == plain(want), name
