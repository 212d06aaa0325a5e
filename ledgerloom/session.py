"""Sessions and the folder that driver and executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def prepare(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where they do not already."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])
    return spark


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, memory: str = "4g") -> SparkSession:
    """A session on this machine, as tests and the bench use it."""
    builder = SparkSession.builder.master(f"local[{cpus}]").appName("ledgerloom")
    for key, value in {
        "spark.sql.shuffle.partitions": shuffle_partitions, "spark.sql.session.timeZone": "UTC", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": memory, "spark.sql.adaptive.enabled": "true",
    }.items():
        builder = builder.config(key, str(value))
    return prepare(builder.getOrCreate())


def shared_dir(spark: SparkSession) -> str:
    """The cluster's spark.checkpoint.dir; a temporary folder on a local master where none is named."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not named:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir names no folder that the executors share")
        spark.sparkContext.setCheckpointDir(named := tempfile.mkdtemp(prefix="ledgerloom-"))
    return named.rstrip("/")


def cut(df: DataFrame) -> DataFrame:
    """df, written to the shared folder and read again: iterations stay short and survive lost executors."""
    path = f"{shared_dir(df.sparkSession)}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store Spark reads."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at)
