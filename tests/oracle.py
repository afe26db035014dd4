"""Runs a query and its SQL side by side."""

import duckdb
import numpy as np

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def expected(sql, sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con.sql(sql).df()


def same(found, wanted):
    assert sorted(found.columns) == sorted(wanted.columns)
    assert len(found) == len(wanted)
    names = sorted(found.columns)
    a, b = (x[names].sort_values(names).reset_index(drop=True) for x in (found, wanted))
    for c in names:
        missing = a[c].isna() & b[c].isna()
        if a[c].dtype.kind == "f" or b[c].dtype.kind == "f":
            equal = np.isclose(a[c].astype(float), b[c].astype(float), rtol=1e-9, atol=1e-6)
        else:
            equal = a[c] == b[c]
        assert (missing | equal).all(), c
