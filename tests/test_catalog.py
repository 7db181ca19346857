"""Every query of the catalog against its SQL twin, as multisets of rows."""

import math
import os
from collections import Counter
from decimal import Decimal
from pathlib import Path

import duckdb
import pytest

from fieldloom.plans import catalog

SF = os.environ.get("FIELDLOOM_TEST_SF", "/root/testdata/sf0.01")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for path in Path(SF).glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM read_parquet('{path}')")
    return con


def plain(value):
    if isinstance(value, float):
        return "nan" if math.isnan(value) else round(value, 6) + 0.0
    if isinstance(value, Decimal):
        return round(float(value), 6) + 0.0
    if isinstance(value, list | tuple):
        return tuple(plain(v) for v in value)
    if isinstance(value, dict):
        return tuple((k, plain(v)) for k, v in value.items())
    if hasattr(value, "asDict"):
        return plain(value.asDict())
    return value


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query_equals_sql(spark, duck, name):
    out = catalog.queries()[name](spark, SF)
    columns = sorted(out.columns)
    got = Counter(tuple(plain(v) for v in row) for row in out.select(*columns).collect())
    told = duck.execute(catalog.oracle_sql()[name])
    names = [d[0] for d in told.description]
    assert sorted(names) == columns
    order = [names.index(c) for c in columns]
    want = Counter(tuple(plain(row[i]) for i in order) for row in told.fetchall())
    assert sum(got.values()) == sum(want.values())
    assert not (got - want), (list((got - want))[:3], list((want - got))[:3])
    assert want, "a query without rows says nothing"


def test_queries_without_sql_are_known():
    assert set(catalog.oracle_sql()) <= set(catalog.queries())


def test_entry_has_rows(spark):
    import __spark_entry__

    out = __spark_entry__.entry(spark)
    assert out.columns and out.count() > 0


def test_order_by_title_has_all_rows_in_order(spark):
    rows = [tuple(r) for r in catalog.queries()["o01_order_by_title"](spark, SF).collect()]
    assert len(rows) == spark.read.parquet(f"{SF}/part.parquet").count() > 100
    assert rows == sorted(rows, key=lambda r: (r[0].encode(), r[1]))
