"""The published daily-predictions table: Parquet partitioned by
``predictionDate``, written with the explicit 25-column schema.

A run replaces only the partitions of the dates it writes (dynamic partition
overwrite), so re-running a day is idempotent and other days stay as they
are.  Each task writes its own files; the job commit publishes them at once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schema as S
from . import versions


def conform(df: DataFrame) -> DataFrame:
    """Columns of the published schema, in order, cast to their types."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in S.PUBLISHED.fields])


def write(df: DataFrame, path: str, mode: str = "replace_dates") -> None:
    """``mode="replace_dates"`` (default): the dates present in ``df`` are
    replaced, all other dates kept (re-runnable).  ``mode="append"``: rows are
    added, like an ``INSERT INTO``; running twice duplicates them."""
    # rebalance: adaptive execution sizes the written files toward its
    # advisory partition size instead of one small file per scoring task
    writer = conform(df).hint("rebalance").write.partitionBy("predictionDate")
    if mode == "replace_dates":
        writer = writer.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    elif mode == "append":
        writer = writer.mode("append")
    else:
        raise ValueError("mode must be 'replace_dates' or 'append'")
    writer.parquet(path)


def read(spark: SparkSession, path: str, date: str | None = None) -> DataFrame:
    df = spark.read.schema(S.PUBLISHED).parquet(path)
    if date is not None:
        df = df.where(F.col("predictionDate") == F.to_date(F.lit(date)))
    return df


# --- versioned table: create or replace, repeatable appends ---------------------------
def create_or_replace(df: DataFrame, root: str, replace: bool = True) -> None:
    """``CREATE [OR REPLACE] TABLE ... PARTITION BY predictionDate AS``: the rows are
    written to a version folder, then put in force.  A reader that has opened the
    table keeps the files it opened; ``replace=False`` fails if there is a table."""
    spark = df.sparkSession
    if not replace and versions.current(spark, root) is not None:
        raise versions.AlreadyPresent(root)
    folder = versions.new_folder(root)
    conform(df).hint("rebalance").write.partitionBy("predictionDate").parquet(folder)
    versions.commit(spark, root, folder, replace)


def open_table(spark: SparkSession, root: str) -> DataFrame:
    """The version in force now, whatever replaces it later."""
    folder = versions.current(spark, root)
    if folder is None:
        raise FileNotFoundError(f"no table at {root}")
    return spark.read.schema(S.PUBLISHED).parquet(folder)


def append_run(df: DataFrame, root: str, run_id: str) -> bool:
    """Add the rows of a run.  A run that is entered already adds nothing (False), so
    a repeated run leaves its rows once; another run with the same rows stays too."""
    folder = f"{root}/runs/run={uuid.uuid4().hex}"
    conform(df).hint("rebalance").write.partitionBy("predictionDate").parquet(folder)
    return versions.add_once(df.sparkSession, root, run_id, folder)


def read_runs(spark: SparkSession, root: str) -> DataFrame:
    """The rows of all runs of the ledger; files of runs that never got there are
    pruned by their folder."""
    names = [n.removeprefix("run=") for n in versions.entered(spark, root)]
    if not names:
        return spark.createDataFrame([], S.PUBLISHED)
    table = spark.read.schema(T.StructType([*S.PUBLISHED.fields, T.StructField("run", T.StringType())])).parquet(f"{root}/runs")
    return table.where(F.col("run").isin(names)).drop("run")
