"""Session settings shared by tests and the bench; a cluster brings its own."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import SparkSession


def local_session(cores: str = "8", memory: str = "12g") -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("codeloom")
        .config("spark.driver.memory", memory)
        .config("spark.sql.shuffle.partitions", cores if cores.isdigit() else "8")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession) -> str:
    """Folder for tables that cut lineage: the cluster's checkpoint folder.

    Only where no such folder is configured (tests, a laptop) is one made.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a shared folder")
    made = os.environ.get("CODELOOM_TMP") or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    os.environ["CODELOOM_TMP"] = made
    return made


def _staged_path(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/staged/{spark.sparkContext.applicationId}"


def cut_lineage(df):
    """Writes a table to the shared folder and reads it back.

    Columnar, so that later reads take the columns they need, and whole when
    an executor is lost.
    """
    path = f"{_staged_path(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(df, partition_by: str):
    """Like ``cut_lineage``, partitioned by one column.

    For inputs that several consumers filter by it: each of them then reads
    its own partition only, and the input itself is read once.
    """
    path = f"{_staged_path(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.partitionBy(partition_by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_staged(spark: SparkSession) -> None:
    """Deletes what this application has staged; its results must be written
    by then."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_staged_path(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
