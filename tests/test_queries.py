"""Each spatial query against its SQL in DuckDB."""

import duckdb
import pytest

from zonalis.plans import model_queries, report_queries, validation_queries  # noqa: F401  register their queries
from zonalis.plans import queries as spatial

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings labels".split()


def plain(row):
    return tuple(round(float(x), 5) if isinstance(x, float) or type(x).__name__ == "Decimal" else x for x in row)


@pytest.mark.parametrize("name", sorted(spatial.oracle_sql()))
def test_same_rows(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    found = spatial.queries()[name](spark, DATA)
    result = con.execute(spatial.oracle_sql()[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(found.columns)
    key = lambda r: tuple((x is None, str(x)) for x in r)
    assert sorted((plain(r[c] for c in columns) for r in found.collect()), key=key) == sorted((plain(r) for r in result.fetchall()), key=key)
