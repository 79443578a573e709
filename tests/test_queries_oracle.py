"""Registered queries against their DuckDB SQL at sf0.001 (the driver checks sf0.01)."""

import math
import re

import duckdb
import pytest

import __spark_entry__ as E
from lendscope.sources.tables import TABLES

from .conftest import SF_SMALL

SQL = E.oracle_sql()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return c


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 9))
    return repr(v)


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_matches_sql(spark, con, name):
    sdf = E.queries()[name](spark, SF_SMALL)
    cols = sorted(sdf.columns)
    srows = sorted(tuple(_norm(r[c]) for c in cols) for r in sdf.collect())
    rel = con.sql(SQL[name])
    assert sorted(rel.columns) == cols
    mapping = {"bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN"}
    stypes = {f.name: mapping.get(f.dataType.simpleString()) for f in sdf.schema.fields}
    assert stypes == dict(zip(rel.columns, [str(t) for t in rel.types]))
    idx = [rel.columns.index(c) for c in cols]
    drows = sorted(tuple(_norm(r[i]) for i in idx) for r in rel.fetchall())
    assert srows == drows


def test_every_query_has_sql_or_is_model_backed():
    missing = {q for q in E.queries() if not re.match(r"op[0-9]+_|pipeline$", q)} - set(SQL)
    assert missing == {"rf_importance", "rf_report", "rf_confusion", "rf_score", "rf_top_features", "rf_stream_score"}


def test_entry_smoke(spark):
    df = E.entry(spark)
    assert df.count() > 0 and df.columns == ["section", "key", "value"]
