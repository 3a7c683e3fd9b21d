"""Incremental ingest, latest progress and windowed error rates."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from codeloom.operators.metrics import _bands


def ingest_new(
    spark: SparkSession,
    source: str,
    schema: str,
    extract: Callable[[DataFrame], DataFrame],
    sink: str,
    checkpoint: str,
    file_format: str = "parquet",
) -> StreamingQuery:
    """Process only files that arrived since the last run, then stop.

    The checkpoint remembers the files seen. Each micro-batch writes to a
    folder named after its batch id in overwrite mode, so a retried batch
    replaces its own output and nothing is doubled.
    """
    stream = spark.readStream.schema(schema).format(file_format).load(source)

    def land(batch: DataFrame, batch_id: int) -> None:
        extract(batch).write.mode("overwrite").parquet(f"{sink}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(land)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def latest_progress(events: DataFrame) -> DataFrame:
    """Newest progress per job; works on a stream in update mode as well.

    ``events``: job_id, ts, event_id, step, progress.
    """
    return (
        events.groupBy("job_id")
        .agg(F.max_by(F.struct("step", "progress", "ts"), F.struct("ts", "event_id")).alias("p"))
        .select("job_id", "p.step", "p.progress", "p.ts")
    )


def error_rates(logs: DataFrame, width: str = "1 hour", late: str = "10 minutes", slide: str | None = None) -> DataFrame:
    """Errors and warnings per event-time window, with the health bands.

    On a stream, rows later than ``late`` are dropped and windows are final
    once the watermark passes them; on a batch the watermark has no effect.
    """
    level = F.col("level")
    span = F.window("ts", width, slide) if slide else F.window("ts", width)
    return (
        logs.withWatermark("ts", late)
        .groupBy(span.alias("w"))
        .agg(
            F.count("*").alias("n_lines"),
            F.count_if(level == "ERROR").alias("n_errors"),
            F.count_if(level == "WARNING").alias("n_warnings"),
        )
        .withColumns(_bands(F.col("n_errors"), F.col("n_warnings")))
        .select(F.col("w.start").alias("window_start"), "n_lines", "n_errors", "n_warnings", "error_band", "warning_band")
    )
