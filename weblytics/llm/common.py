"""Small helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from weblytics.session import work_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str, partition_by: Iterable[str] = ()) -> DataFrame:
    """Write a table to the shared work folder and read it back: lineage ends
    there, and later plans know its real size."""
    path = f"{work_dir(df.sparkSession)}/llm/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def drop_names(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """Without the columns that an operator is about to add: an input column
    of the same name (in any case) is replaced."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def extended(df: DataFrame, more: str) -> T.StructType:
    """Schema of ``df`` plus the columns of a DDL string."""
    return T.StructType([*df.schema.fields, *T.StructType.fromDDL(more).fields])


def add_columns(table_: pa.Table, columns: dict[str, pa.Array]) -> pa.Table:
    for name, values in columns.items():
        table_ = table_.append_column(name, values)
    return table_


def crc32_of_id(column: str = "doc_id"):
    """Unsigned crc32 of a key's text (NULL key: of the empty text)."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_key_order(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(doc_id, text) over range partitions in key order; rows with one key (or none)
    stand in the order of their texts' first 64 characters, then of a hash.  The
    ranges split such rows by those, and rows with equal texts by a draw (they are
    interchangeable)."""
    order = ["doc_id", "__start", "__h"]
    return (docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
            .withColumns({"__start": F.substring("text", 1, 64), "__h": F.xxhash64("text"), "__salt": F.rand(17)})
            .repartitionByRange(*order, "__salt").sortWithinPartitions(*order).select("doc_id", "text"))


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Make this package importable in the executors' Python (as ``--py-files``
    would), once per application.  Nothing to do where PYTHONPATH has it."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    there = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    app = spark.sparkContext.applicationId
    if root in there or app in _SHIPPED:
        return
    archive = os.path.join(tempfile.mkdtemp(prefix="weblytics-"), "weblytics.zip")
    with zipfile.ZipFile(archive, "w") as out:
        for folder, _, names in os.walk(os.path.join(root, "weblytics")):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    out.write(path, os.path.relpath(path, root))
    spark.sparkContext.addPyFile(archive)
    _SHIPPED.add(app)


def map_arrow(df: DataFrame, function, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.mapInArrow(function, schema)


def group_arrow(df: DataFrame, key: str, function, schema) -> DataFrame:
    ship(df.sparkSession)
    return df.groupBy(key).applyInArrow(function, schema)
