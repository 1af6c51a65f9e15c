"""Every query with an SQL twin against DuckDB on the smallest tables; the others run and give rows."""

import duckdb
import pytest

from helixframe import registry

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
SQL, QUERIES = registry.oracle_sql(), registry.queries()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    mine = QUERIES[name](spark, SF).toPandas()
    if name not in SQL:
        assert len(mine) > 0
        return
    theirs = duck.execute(SQL[name]).df()
    columns = sorted(mine.columns)
    assert columns == sorted(theirs.columns)
    a, b = (x[columns].sort_values(columns, key=lambda s: s.astype(str)).reset_index(drop=True) for x in (mine, theirs))
    assert len(a) == len(b)
    for c in columns:
        same = (a[c].astype(str) == b[c].astype(str)) | (a[c].isna() & b[c].isna())
        assert same.all(), (c, a[c][~same].head(3).tolist(), b[c][~same].head(3).tolist())


@pytest.mark.parametrize("rows", [18, 19])
def test_compact_pairs_of_a_last_cell_that_is_not_full(spark, duck, tmp_path, rows):
    some = duck.cursor()
    some.execute(f"COPY (SELECT * FROM '{SF}/embeddings.parquet' WHERE vec_id < {rows}) TO '{tmp_path}/embeddings.parquet' (FORMAT parquet)")
    some.execute(f"CREATE OR REPLACE TEMP VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet'")
    theirs = sorted(map(str, some.execute(SQL["compact_pairs"]).df().astype(str).values.tolist()))
    mine = sorted(map(str, QUERIES["compact_pairs"](spark, str(tmp_path)).toPandas().astype(str).values.tolist()))
    assert len(mine) == 5
    assert mine == theirs
