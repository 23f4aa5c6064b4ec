"""Every registered query with an oracle equals its DuckDB statement
(sf0.001; the driver repeats this at sf0.01)."""

import math

import pytest

import __spark_entry__ as E
from conftest import SF_SMALL
from weblytics.plans import oracle

ORACLES = oracle.oracle_sql()
DUCK_TO_SPARK = {"VARCHAR": "string", "BIGINT": "bigint", "DOUBLE": "double",
                 "BOOLEAN": "boolean", "DATE": "date"}
SKIP_SLOW = {n for n in ORACLES if n.startswith("ml_train_")}


def _norm(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(round(v, 6))
    return repr(v)


def _rows(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows)


def test_every_query_has_a_callable():
    qs = E.queries()
    assert set(ORACLES) <= set(qs)


@pytest.mark.parametrize("name", sorted(n for n in ORACLES if n not in SKIP_SLOW))
def test_matches_oracle(spark, duck, name):
    df = E.queries()[name](spark, SF_SMALL)
    rows = df.collect()
    res = duck.execute(ORACLES[name])
    ocols = [d[0] for d in res.description]
    orows = res.fetchall()
    assert sorted(df.columns) == sorted(ocols)
    assert _rows(df.columns, rows) == _rows(ocols, orows)
    # same column types on both sides
    otypes = {d[0]: DUCK_TO_SPARK.get(str(d[1]), str(d[1])) for d in res.description}
    assert dict(df.dtypes) == otypes


def test_entry_runs(spark):
    df = E.entry(spark)
    assert df.columns == ["operating_system", "device_category", "browser", "total_sessions",
                          "total_transactions", "conversion_rate_percentage"]
    assert df.count() >= 0
