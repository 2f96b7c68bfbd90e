"""Compare a query with its DuckDB form."""

from pathlib import Path

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return con


def rows_of(table):
    names = sorted(table.column_names)
    columns = [table.column(n).to_pylist() for n in names]
    return names, sorted(map(repr, zip(*columns)))


def same(df, con, sql: str) -> None:
    got, want = rows_of(df.toArrow()), rows_of(con.execute(sql).to_arrow_table())
    assert got[0] == want[0]
    assert got[1] == want[1]
