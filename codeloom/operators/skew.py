"""Joins and totals that stay balanced when one key owns much of the data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SALTS = 32


def by_merge(df: DataFrame) -> DataFrame:
    """``df`` as a side of a sort-merge join, for tables that grow with the input.

    Catalyst takes the size of a table from its files. Paths, names and texts
    are packed into a fiftieth there, so tables of many times the broadcast
    limit would be gathered in the driver.
    """
    return df.hint("merge")


def salted(df: DataFrame, spread_by: list[str], salts: int = SALTS) -> DataFrame:
    """Adds ``_salt``, a stable hash of other columns (never random)."""
    return df.withColumn("_salt", F.pmod(F.xxhash64(*spread_by), F.lit(salts)).cast("int"))


def skew_lookup(
    facts: DataFrame,
    dim: DataFrame,
    keys: list[str],
    spread_by: list[str],
    how: str = "left",
    salts: int = SALTS,
) -> DataFrame:
    """Join facts to a dimension, usually with one row per key.

    A hot key is cut into ``salts`` pieces: the distinct (key, salt) pairs of
    the facts meet the dimension first, then the facts join on both columns,
    so no task receives a whole hot key and the dimension is not multiplied
    for keys that do not need it. The dimension never goes through the driver.
    """
    pieces = salted(facts, spread_by, salts)
    routed = pieces.select(*keys, "_salt").distinct().join(by_merge(dim), keys, "inner")
    return pieces.join(by_merge(routed), [*keys, "_salt"], how).drop("_salt")


def with_totals(
    df: DataFrame, keys: list[str], spread_by: list[str], name: str = "total", salts: int = SALTS
) -> DataFrame:
    """Every row with the row count of its key, without a per-key window."""
    pieces = salted(df, spread_by, salts)
    partial = pieces.groupBy(*keys, "_salt").agg(F.count("*").alias("_n"))
    totals = partial.groupBy(*keys).agg(F.sum("_n").alias(name))
    routed = partial.select(*keys, "_salt").join(by_merge(totals), keys)
    return pieces.join(by_merge(routed), [*keys, "_salt"]).drop("_salt")


def global_position(
    df: DataFrame, groups: list[Column], bucket: Column, order: list[Column], name: str = "position"
) -> DataFrame:
    """1-based position in the order (groups, bucket, order) over all rows.

    ``groups`` is a short list of columns with few distinct values and
    ``bucket`` a coarse, order-preserving slice of what follows. Only counts
    per (groups, bucket) meet in one place; rows are numbered inside their
    bucket, so no task sees the whole table.
    """
    g = [f"_g{i}" for i in range(len(groups))]
    keyed = df.withColumns({**dict(zip(g, groups)), "_b": bucket})
    counts = keyed.groupBy(*g, "_b").agg(F.count("*").alias("_n"))
    by_group = counts.groupBy(*g).agg(F.sum("_n").alias("_gn"))
    group_start = by_group.withColumn(
        "_gs",
        F.coalesce(F.sum("_gn").over(Window.orderBy(*g).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)),
    ).drop("_gn")
    start = counts.withColumn(
        "_bs",
        F.coalesce(
            F.sum("_n").over(Window.partitionBy(*g).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)),
            F.lit(0),
        ),
    ).drop("_n")
    inside = F.row_number().over(Window.partitionBy(*g, "_b").orderBy(*order))
    return (
        keyed.withColumn("_rn", inside)
        .join(start, [*g, "_b"])
        .join(F.broadcast(group_start), g)  # one row per group value, a handful
        .withColumn(name, (F.col("_gs") + F.col("_bs") + F.col("_rn")).cast("long"))
        .drop(*g, "_b", "_rn", "_bs", "_gs")
    )
