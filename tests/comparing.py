"""Rows of a Spark query against rows of its SQL, whatever their order."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def database(folder):
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{folder}/{t}.parquet')")
    return con


def _plain(value):
    if value is None or value != value:
        return "null"
    if isinstance(value, bool) or type(value).__name__ == "bool_":
        return str(bool(value))
    if isinstance(value, (int, float)) or "int" in type(value).__name__ or "float" in type(value).__name__:
        return f"{float(value) + 0.0:.5f}"
    return str(value)


def rows_of(pdf):
    columns = sorted(pdf.columns)
    return columns, sorted(tuple("null" if type(v).__name__ in ("NAType", "NaTType") else _plain(v) for v in r) for r in pdf[columns].itertuples(index=False))


def assert_same(df, sql, folder):
    got, want = rows_of(df.toPandas()), rows_of(database(folder).execute(sql).df())
    assert got[0] == want[0]
    assert len(got[1]) == len(want[1])
    wrong = [(a, b) for a, b in zip(got[1], want[1], strict=True) if a != b]
    assert not wrong, wrong[:3]
