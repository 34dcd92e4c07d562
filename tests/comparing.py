"""Run a query and its oracle SQL over the same tables and compare the rows."""

import duckdb

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def oracle_rows(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    cursor = con.execute(sql)
    names = [c[0] for c in cursor.description]
    return names, cursor.fetchall()


def assert_matches(df, sql, sf_dir):
    names, want = oracle_rows(sql, sf_dir)
    assert sorted(df.columns) == sorted(names)
    order = sorted(names)
    got = sorted((repr(tuple(r[n] for n in order)) for r in df.collect()))
    assert got == sorted(repr(tuple(w[names.index(n)] for n in order)) for w in want)
