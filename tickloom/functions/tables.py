"""Tables written between the steps of a job."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession, what: str) -> str:
    """A new folder below ``spark.checkpoint.dir``; where that is unset and Spark runs on one machine, below a temporary one that is
    made and set. On a cluster an unset folder is an error, for executors wouldn't see each other's files."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tickloom/{what}-{uuid.uuid4().hex}"


#: The JVM never compiles methods above this many bytes of bytecode; what Spark generates for wide rows is often larger.
_COMPILED = ("spark.sql.codegen.hugeMethodLimit", "8000")


@contextmanager
def compiled(spark: SparkSession) -> Iterator[None]:
    """Jobs run inside have no generated method that the JVM would only interpret: Spark cuts such into small ones. The session's
    own limit is set again afterwards."""
    name, limit = _COMPILED
    own = spark.conf.get(name, None)
    spark.conf.set(name, limit)
    try:
        yield
    finally:
        spark.conf.unset(name) if own is None else spark.conf.set(name, own)


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` written once as Parquet in the shared folder and read again: its lineage ends there."""
    path = shared_folder(df.sparkSession, what)
    with compiled(df.sparkSession):
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
