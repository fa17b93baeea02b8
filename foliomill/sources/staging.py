"""Intermediate tables on storage that all executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it. Where none is named, a session on one machine
    (tests) gets one of its own; on a cluster that is an error, since executors would each write to their own disk."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("name a folder that all executors share in spark.checkpoint.dir")
    return f"file:///tmp/foliomill-checkpoint-{os.getuid()}"


def stored(df: DataFrame, by: str | None = None) -> DataFrame:
    """The rows written to the shared folder and read from there: later steps neither compute them
    again nor depend on the executors that made them. The application's folder is removed when it ends. Rows are kept
    apart ``by`` the few values of a column, if one is named, so that a filter on it reads just its own."""
    spark = df.sparkSession
    own = f"{shared_dir(spark)}/foliomill-{spark.sparkContext.applicationId}"
    path = f"{own}/{uuid.uuid4().hex}"
    (df.write.partitionBy(by) if by else df.write).parquet(path)
    folder = spark._jvm.org.apache.hadoop.fs.Path(own)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return spark.read.schema(df.schema).parquet(path)
