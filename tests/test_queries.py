"""Every registered query against its SQL in DuckDB, on the smallest tables."""

import duckdb
import pandas as pd
import pytest

from segspark.catalog import FLAGSHIP, ORACLE_SQL, QUERIES

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(frame: pd.DataFrame) -> list[tuple]:
    def value(x):
        if isinstance(x, (int, float)) and not isinstance(x, bool):
            return "~" if x != x else float(x)
        return "~" if x is None or pd.isna(x) else str(x)

    columns = sorted(frame.columns)
    return sorted((tuple(value(x) for x in row) for row in frame[columns].astype(object).itertuples(index=False)), key=str)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query_equals_its_sql(spark, duck, name):
    got, want = QUERIES[name](spark, SF).toPandas(), duck.execute(ORACLE_SQL[name]).fetchdf()
    assert sorted(got.columns) == sorted(want.columns)
    assert plain(got) == plain(want)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE_SQL)))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF).count() > 0


def test_flagship_is_registered():
    assert FLAGSHIP in QUERIES


def test_rows_that_are_not_built_are_not_claimed():
    from segspark.catalog import COVERS

    claimed = {row for rows in COVERS.values() for row in rows}
    assert not claimed & {"SEQ-05", "SEQ-06", "JFA-11", "DIA-05", "GMM-04", "GMM-08", "ONL-02"}
