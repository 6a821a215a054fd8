"""Working tables in the folder that driver and executors share."""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

#: Tables that the innermost working_tables() block of this process has to delete.
_open: list[list[str]] = []


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it names none, a local session gets a private
    folder, and a cluster an error: executors would write to disks of their own and tables would come back incomplete."""
    where = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        where = spark.sparkContext.getCheckpointDir()
    return re.sub(r"^file:/(?!/)", "file:///", where.rstrip("/"))


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path of its own in the shared folder; deleted with the block of working_tables() that is open."""
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    if _open:
        _open[-1].append(path)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes a table and reads it back: computed once, lineage cut, safe from lost executors."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def delete(spark: SparkSession, *paths: str) -> None:
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


@contextmanager
def working_tables(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what was materialised in it. Results are lazy: write them inside the block."""
    _open.append([])
    try:
        yield
    finally:
        delete(spark, *_open.pop())
