import os
import sys

import pytest

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

SF_SMALL = "/root/testdata/sf0.001"
SF_MID = "/root/testdata/sf0.01"


@pytest.fixture(scope="session")
def spark():
    from pyspark.sql import SparkSession

    from weblytics.session import configure

    builder = (SparkSession.builder.master("local[4]")
               .appName("weblytics-tests")
               .config("spark.sql.shuffle.partitions", "8")
               .config("spark.ui.enabled", "false"))
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    yield spark


@pytest.fixture(scope="session")
def store(spark):
    from weblytics.sources.fixture import session_store
    return session_store(spark, SF_SMALL)


@pytest.fixture(scope="session")
def duck():
    import duckdb
    con = duckdb.connect()
    for t in ("region nation customer supplier part orders lineitem events documents "
              "embeddings pages benchmark labels conversations").split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    return con


def session_rows(spark, rows):
    """Small hand-made session DataFrame in the session schema.  ``rows`` are
    dicts with flat keys such as 'fullVisitorId', 'date', 'totals.bounces'."""
    from weblytics import schema as S

    def build(struct_type, values, prefix=""):
        out = []
        for f in struct_type.fields:
            key = prefix + f.name
            if hasattr(f.dataType, "fields"):
                sub = {k: v for k, v in values.items() if k.startswith(key + ".")}
                out.append(build(f.dataType, values, key + ".") if sub else None)
            else:
                out.append(values.get(key))
        return tuple(out)

    data = []
    for r in rows:
        r = dict(r)
        r.setdefault("_table_suffix", r.get("date"))
        data.append(build(S.SESSION_WITH_SUFFIX, r))
    return spark.createDataFrame(data, S.SESSION_WITH_SUFFIX)
