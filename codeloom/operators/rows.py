"""The common row every extractor emits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

NO_ITEMS = "array<string>"


def entity(kind, name: Column, line: Column, items: Column | None = None, **attrs) -> Column:
    """struct(type, name, line_number, items, attrs) for one extracted entity."""
    pairs = [x for k, v in attrs.items() for x in (F.lit(k), v if isinstance(v, Column) else F.lit(v))]
    extra = F.create_map(*pairs) if pairs else F.create_map()
    return F.struct(
        F.lit(kind).alias("type"),
        name.alias("name"),
        line.cast("int").alias("line_number"),
        (items if items is not None else F.array()).cast(NO_ITEMS).alias("items"),
        extra.cast("map<string,string>").alias("attrs"),
    )


def explode_entities(files: DataFrame, *arrays: Column) -> DataFrame:
    """One pass over ``files``: all arrays of entities become rows."""
    return (
        files.select("file_path", F.explode(F.concat(*arrays)).alias("e"))
        .select("file_path", "e.type", "e.name", "e.line_number", "e.items", "e.attrs")
    )


def first(hits: Column) -> Column:
    """First hit of an array, null when there is none."""
    return F.get(hits, F.lit(0))


def if_any(value: Column, one) -> Column:
    """``[one(value)]`` when value is not null, else an empty array."""
    return F.transform(F.array_compact(F.array(value)), one)


def once(df: DataFrame, name: str, value: Column) -> DataFrame:
    """Adds a costly column that is evaluated exactly once per row.

    A filter on a plain column is moved below its projection and evaluates the
    expression again there; a one-element explode keeps it in place.
    """
    return df.select("*", F.explode(F.array(value)).alias(name))
