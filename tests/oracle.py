"""Compare a query with its SQL in DuckDB on the same files."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(sf_dir: str):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


def _rows(pdf):
    pdf = pdf[sorted(pdf.columns)].astype(object)
    text = lambda v: "NULL" if v is None or v != v else f"{v:.6g}" if isinstance(v, float) else str(v)
    return list(pdf.columns), sorted(tuple(text(v) for v in r) for r in pdf.itertuples(index=False))


def check(spark, query, sql: str, sf_dir: str) -> None:
    got, want = _rows(query(spark, sf_dir).toPandas()), _rows(connect(sf_dir).execute(sql).df())
    assert got == want
