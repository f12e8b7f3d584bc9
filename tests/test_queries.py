"""Every registered query of the array operators against the same question in DuckDB."""

from concurrent.futures import ThreadPoolExecutor

import duckdb
import pytest

from terrace import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for name in "nation customer supplier part orders lineitem events embeddings".split():
        con.execute(f"create view {name} as select * from '{SF}/{name}.parquet'")
    return con


def rows(frame):
    frame = frame[sorted(frame.columns)]
    values = frame.astype(object).where(frame.notna(), None).values.tolist()
    return list(frame.columns), sorted(map(tuple, values), key=lambda r: tuple(map(str, r)))


@pytest.fixture(scope="module")
def results(spark):
    """All queries, eight at a time: alone each would leave most cores idle."""
    pool = ThreadPoolExecutor(8)
    yield {name: pool.submit(lambda name=name: queries.QUERIES[name](spark, SF).toPandas()) for name in queries.QUERIES}
    pool.shutdown(cancel_futures=True)


@pytest.mark.parametrize("name", list(queries.QUERIES))
def test_same_as_sql(results, duck, name):
    got = rows(results[name].result())
    if name in queries.ORACLE_SQL:
        assert got == rows(duck.execute(queries.ORACLE_SQL[name]).df())
