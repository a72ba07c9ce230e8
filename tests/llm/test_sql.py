"""Each query of the text operators that SQL can express, against that SQL, on the smallest tables."""

import duckdb
import pytest

from sectorframe.llm.queries import ORACLE_SQL, QUERIES


@pytest.fixture(scope="module")
def duck(sf_dir):
    connection = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        connection.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return connection


def _canonical(df, columns):
    return sorted((tuple(r) for r in df[columns].astype(object).where(df[columns].notna(), None).values.tolist()), key=repr)


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_same_rows_as_sql(spark, duck, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toPandas()
    expected = duck.sql(ORACLE_SQL[name]).df()
    columns = sorted(expected.columns)
    assert columns == sorted(got.columns)
    assert _canonical(got, columns) == _canonical(expected, columns)
