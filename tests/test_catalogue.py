"""Every query against its SQL on the smallest tables."""

import duckdb
import pytest

from lodestone import catalogue_records
from lodestone.catalogue import ORACLE, QUERIES

assert catalogue_records.query  # its queries are among the others
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
TYPES = {"bigint": "int64", "int": "int32", "string": "string", "double": "double", "boolean": "bool"}


def plain(v):
    if isinstance(v, float):
        return round(v, 9)
    return tuple(plain(x) for x in v) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    rows = df.collect()
    assert len(set(df.columns)) == len(df.columns)
    if name in ORACLE:
        want = duck.sql(ORACLE[name]).arrow()
        want = want.read_all() if hasattr(want, "read_all") else want
        cols = sorted(df.columns)
        assert cols == sorted(want.column_names)
        assert all(TYPES.get(t, str(want.schema.field(c).type)) == str(want.schema.field(c).type) for c, t in df.dtypes)
        assert sorted((tuple(plain(r[c]) for c in cols) for r in rows), key=repr) == sorted((tuple(plain(r[c]) for c in cols) for r in want.to_pylist()), key=repr)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
