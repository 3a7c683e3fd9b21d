"""Job, repository, template, log and report tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom import schemas
from codeloom.operators.resolve import absent


def read_table(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).parquet(path)


def read_json_logs(spark: SparkSession, path: str, schema: str = schemas.LOGS) -> DataFrame:
    """Structured log, one JSON object per line, with a declared schema."""
    return spark.read.schema(schema).json(path)


def parse_json_logs(lines: DataFrame, column: str = "line", schema: str = schemas.LOGS) -> DataFrame:
    return lines.select(F.from_json(F.col(column), schema).alias("l")).select("l.*")


REPORT_BUCKETS = 64


def write_reports(reports: DataFrame, root: str) -> None:
    """``reports``: job_id, filename, content. Jobs share folders by a hash of
    their id, so the number of files does not grow with the number of jobs."""
    bucket = F.pmod(F.xxhash64("job_id"), F.lit(REPORT_BUCKETS)).cast("int")
    reports.withColumn("bucket", bucket).repartition("bucket", F.pmod(F.xxhash64("filename"), F.lit(16))).write.mode(
        "append"
    ).partitionBy("bucket").parquet(root)


def read_reports(spark: SparkSession, root: str, job_id: str | None = None) -> DataFrame:
    """All reports, or those of one job, for which one folder is read."""
    found = spark.read.schema("job_id string, filename string, content string, bucket int").parquet(root)
    if job_id is not None:
        own = F.pmod(F.xxhash64(F.lit(job_id)), F.lit(REPORT_BUCKETS)).cast("int")
        found = found.filter((F.col("bucket") == own) & (F.col("job_id") == job_id))
    return found.drop("bucket")


def read_diagram_files(spark: SparkSession, root: str) -> DataFrame:
    """Plain ``*.mmd`` files below ``root`` as (path, content)."""
    return (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.mmd")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    )


# ---- keyed changes on append-only tables ------------------------------------


def current_state(events: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Newest event per key; an aggregate, so a busy key combines map-side."""
    last = events.groupBy(key).agg(F.max_by(F.struct(*events.columns), F.struct(*order)).alias("r"))
    return last.select("r.*")


def insert_if_absent(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    return absent(incoming, existing, key)


def merged_templates(existing: DataFrame, incoming: DataFrame) -> DataFrame:
    """All templates after inserting new names; the newest default wins.

    ``created_at`` orders the defaults, ``name`` breaks ties.
    """
    every = existing.unionByName(insert_if_absent(incoming, existing, "name"))
    newest = (
        every.filter("is_default")
        .agg(F.max(F.struct("created_at", "name")).alias("d"))
        .select(F.col("d.name").alias("name"), F.lit(True).alias("keeps"))
        .filter(F.col("name").isNotNull())
    )
    return (
        every.join(F.broadcast(newest), "name", "left")  # one row at most
        .withColumn("is_default", F.coalesce("keeps", F.lit(False)))
        .drop("keeps")
    )


def split_by_status(jobs: DataFrame, status: str) -> tuple[DataFrame, DataFrame]:
    """(kept, removed) jobs of a cleanup by status."""
    gone = F.coalesce(F.col("status") == status, F.lit(False))
    return jobs.filter(~gone), jobs.filter(gone)


def column_default(field: T.StructField) -> Column:
    """0 for integers, 0.0 for fractions, null for all else."""
    if isinstance(field.dataType, T.IntegralType):
        return F.lit(0).cast(field.dataType)
    if isinstance(field.dataType, T.FractionalType):
        return F.lit(0.0).cast(field.dataType)
    return F.lit(None).cast(field.dataType)


def align(df: DataFrame, target: T.StructType) -> DataFrame:
    """Adds the target's missing columns with their defaults, in its order."""
    have = set(df.columns)
    cols = [F.col(f.name) if f.name in have else column_default(f).alias(f.name) for f in target.fields]
    return df.select(*cols, *[F.col(c) for c in df.columns if c not in set(target.fieldNames())])


def columns_of(spark: SparkSession, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, column_name) of given tables, from their schemas."""
    rows = [(t, c) for t, df in tables.items() for c in df.columns]
    return spark.createDataFrame(rows, "table_name string, column_name string")


def newest_first(df: DataFrame, key: str, order: list[Column]) -> DataFrame:
    w = Window.partitionBy(key).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w))
