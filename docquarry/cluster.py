"""Where jobs keep intermediate tables, and how they cut lineage."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's spark.checkpoint.dir.

    Only where that is unset and the master is local (tests in one JVM) a temporary folder
    is made and set; on a cluster, whose executors have disks of their own, that is an error.
    """
    sc = spark.sparkContext
    path = sc.getConf().get("spark.checkpoint.dir") or (sc.getCheckpointDir() if sc._jsc.sc().getCheckpointDir().isDefined() else None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="docquarry-")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(path)
    return path


def stored(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` as a Parquet table in the shared folder and read it back.

    Cuts lineage in a way that survives the loss of executors.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    writer = df.write
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def discard(spark: SparkSession, name: str) -> int:
    """Deletes the tables that :func:`stored` wrote under ``name`` (when the results made of them are written); returns how many."""
    folder = spark._jvm.org.apache.hadoop.fs.Path
    base = folder(shared_dir(spark))
    fs = base.getFileSystem(spark._jsc.hadoopConfiguration())
    mine = [s.getPath() for s in fs.listStatus(base) if re.fullmatch(re.escape(name) + "-[0-9a-f]{32}", s.getPath().getName())]
    return sum(fs.delete(path, True) for path in mine)


def checkpointed(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint into the shared folder."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager)
