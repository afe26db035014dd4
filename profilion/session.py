"""What the session offers: the folder that all executors share, and frames that are written there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where none is set, one is made for a session on one machine, as in tests, and
    on a cluster that is an error, as its executors share no local folder."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="profilion-"))
    return sc.getCheckpointDir()


def settle(df: DataFrame) -> DataFrame:
    """Writes a frame to the cluster's shared folder as a checkpoint, which cuts its lineage."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def written(df: DataFrame) -> DataFrame:
    """Writes a frame to the cluster's shared folder as a Parquet table, and reads it."""
    folder = f"{shared_folder(df.sparkSession)}/{uuid.uuid4()}"
    df.write.parquet(folder)
    return df.sparkSession.read.parquet(folder)


def removed(spark: SparkSession, folder: str) -> None:
    """Deletes a folder of the shared file system that nothing reads any more."""
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
