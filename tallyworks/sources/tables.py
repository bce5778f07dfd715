"""Reading inputs, writing results, and cutting lineage through a written table."""

from __future__ import annotations

import tempfile
import uuid
from functools import cache

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def load(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """Read a Parquet data set under a declared schema (never inferred)."""
    return spark.read.schema(schema).parquet(path)


def save(df: DataFrame, path: str, partition_by: list[str] | None = None) -> None:
    """Write a result table; an existing target is an error, not overwritten."""
    writer = df.write.mode("errorifexists")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)


def shared_folder(spark: SparkSession) -> str:
    """The folder every executor can reach, as named by ``spark.checkpoint.dir``.

    A local session (one machine, as in tests) may leave it unset and gets a new
    temporary folder. On a cluster an unset value is an error, because a folder of one
    machine would be lost with it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder shared by the cluster")
    return _local_folder(spark.conf.get("spark.app.id"))


@cache
def _local_folder(application: str) -> str:
    return tempfile.mkdtemp(prefix="tallyworks-")


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    Used where a result feeds several branches, or where its true size decides how it
    is joined. The written table survives the loss of executors and gives the optimiser
    real file sizes. This is an action: it runs when it is called.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{uuid.uuid4().hex}"
    save(df, path)
    written = load(spark, path, df.schema)
    written.written_at = path
    return written


def discard(*tables: DataFrame) -> None:
    """Delete tables that ``materialise`` wrote, once nothing that is still to run reads them."""
    for df in tables:
        folder = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df.written_at)
        files = folder.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf())
        files.delete(folder, True)
