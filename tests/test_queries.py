"""Every query of the library's own operators against its SQL on the smallest tables."""

import datetime
import decimal
import math

import duckdb
import pytest

from chronoweave.registry import ORACLE_SQL, QUERIES
from chronoweave.sources.graph_tables import BASE

DATA = "/root/testdata/sf0.001"


def plain(v):
    if v is None:
        return "null"
    if isinstance(v, bool):
        return str(int(v))
    if isinstance(v, (float, decimal.Decimal)):
        return "nan" if math.isnan(v) else f"{float(v):.6g}" if v else "0"
    if isinstance(v, (datetime.datetime, datetime.date)):
        return str(v).replace("+00:00", "")
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(map(plain, v)) + "]"
    return str(v)


def rows_of(names, rows):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in rows)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in BASE:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, DATA)
    rows = df.collect()
    if name not in ORACLE_SQL:
        assert len(df.columns) == len(set(df.columns))
        return
    found = duck.execute(ORACLE_SQL[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == sorted(df.columns)
    assert rows_of(df.columns, rows) == rows_of(names, found.fetchall())


def test_a_drift_stream_equals_its_batch(spark):
    batch = QUERIES["dr2_drift_changes"](spark, DATA).collect()
    stream = [r for r in QUERIES["st4_drift_stream"](spark, DATA).collect() if r.kind == "change"]
    assert batch and sorted((r.entity, r["at"]) for r in stream) == sorted((r.entity, r["at"]) for r in batch)
