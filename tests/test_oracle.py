"""Every core query against its oracle SQL on the smallest tables."""

import math

import duckdb
import pytest

from pixelmill.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
TYPES = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
ROWS_ONLY = ("fit_", "permutation", "region_kernels", "group_split", "row_alignment")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES.split():
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6) + 0.0)
    return str(v)


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_oracle(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    rel = duck.sql(catalog.oracle_sql()[name])
    cols = sorted(rel.columns)
    assert sorted(df.columns) == cols
    kinds = dict(df.dtypes)
    assert {c: TYPES.get(kinds[c], kinds[c]) for c in cols} == dict(zip(rel.columns, map(str, rel.types), strict=True))
    at = [rel.columns.index(c) for c in cols]
    assert sorted(tuple(norm(r[c]) for c in cols) for r in df.collect()) == sorted(tuple(norm(r[i]) for i in at) for r in rel.fetchall())


def test_names():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert all(n.startswith(ROWS_ONLY) for n in set(catalog.queries()) - set(catalog.oracle_sql()))


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
