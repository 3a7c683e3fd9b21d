"""Nearest preceding and following lookups along an ordered position."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _sliced(probes: DataFrame, marks: DataFrame, key: str, pos: str, value: str, bucket: Column):
    both = probes.withColumns({"_mark": F.lit(None).cast(marks.schema[value].dataType), "_is": F.lit(1)})
    tagged = marks.select(key, pos, F.col(value).alias("_mark")).withColumn("_is", F.lit(0))
    return both.unionByName(tagged, allowMissingColumns=True).withColumn("_b", bucket)


def asof_backward(
    probes: DataFrame, marks: DataFrame, key: str, pos: str, value: str, bucket: Column, out: str = "nearest"
) -> DataFrame:
    """Each probe with the last mark at or before it.

    A key's rows are cut into position buckets. Inside a bucket a window finds
    the mark; across buckets only the last mark of each bucket is carried, so
    a key that holds a third of the data is spread over its buckets.
    """
    rows = _sliced(probes, marks, key, pos, value, bucket)
    here = Window.partitionBy(key, "_b").orderBy(pos, "_is").rowsBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    carried = (
        rows.groupBy(key, "_b")
        .agg(F.max_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(pos))).alias("_last"))
        .withColumn("_carry", F.last("_last", ignorenulls=True).over(earlier))
        .drop("_last")
    )
    return (
        rows.withColumn("_near", F.last("_mark", ignorenulls=True).over(here))
        .filter(F.col("_is") == 1)
        .join(carried, [key, "_b"], "left")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .select(*probes.columns, out)
    )


def asof_forward(
    probes: DataFrame, marks: DataFrame, key: str, pos: str, value: str, bucket: Column, out: str = "nearest"
) -> DataFrame:
    """Each probe with the first mark strictly after it; bucketed alike."""
    rows = _sliced(probes, marks, key, pos, value, bucket)
    here = Window.partitionBy(key, "_b").orderBy(pos, "_is").rowsBetween(1, Window.unboundedFollowing)
    later = Window.partitionBy(key).orderBy("_b").rowsBetween(1, Window.unboundedFollowing)
    carried = (
        rows.groupBy(key, "_b")
        .agg(F.min_by("_mark", F.when(F.col("_mark").isNotNull(), F.col(pos))).alias("_first"))
        .withColumn("_carry", F.first("_first", ignorenulls=True).over(later))
        .drop("_first")
    )
    return (
        rows.withColumn("_near", F.first("_mark", ignorenulls=True).over(here))
        .filter(F.col("_is") == 1)
        .join(carried, [key, "_b"], "left")
        .withColumn(out, F.coalesce("_near", "_carry"))
        .select(*probes.columns, out)
    )
