"""Sets of numbers as containers: sorted out by density, united exactly.

A set is cut into ranges of 32,768 numbers. A range with few members is a list,
one with many a bitmap of 4 KB, so that a set passed along an edge costs a row
for each of its ranges and never one for each of its members.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import skew_lookup
from codeloom.session import cut_lineage

#: Members of a range up to which a list takes less room than a bitmap.
LISTED = 1024


def numbered(ids: DataFrame) -> DataFrame:
    """(id, number): distinct ids of any type with numbers from 0, without
    gaps. Each range of ids numbers its own rows; only counts are summed."""
    laid = ids.select("id").distinct().repartitionByRange("id").sortWithinPartitions("id")
    laid = cut_lineage(laid.withColumn("_at", F.monotonically_increasing_id()))
    part = F.shiftright("_at", 33)
    counts = laid.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = counts.select("_part", (F.coalesce(before, F.lit(0)) - F.col("_first")).alias("_shift"))
    # one row for each partition
    found = laid.withColumn("_part", part).join(F.broadcast(starts), "_part")
    return found.select("id", (F.col("_at") + F.col("_shift")).alias("number"))


def containers(sets: DataFrame, listed: int = LISTED) -> DataFrame:
    """(id, kind, b, n, places, bits): the ranges of each set.

    ``sets``: id, kind, member; a node has a set of each kind, members are
    numbers, no row is repeated. A range of up to ``listed`` members has
    ``places``, any other has ``bits``; no list exceeds the 32,768 numbers of
    its range.
    """
    placed = sets.select("id", "kind", F.bitmap_bucket_number("member").alias("b"), F.bitmap_bit_position("member").cast("int").alias("at"))
    ranges = placed.groupBy("id", "kind", "b").agg(F.count("*").alias("n"), F.collect_list("at").alias("places"))
    few = ranges.filter(F.col("n") <= listed).withColumn("bits", F.lit(None).cast("binary"))
    members = ranges.filter(F.col("n") > listed).select("id", "kind", "b", F.explode("places").alias("at"))
    many = members.groupBy("id", "kind", "b").agg(
        F.count("*").alias("n"), F.lit(None).cast("array<int>").alias("places"), F.bitmap_construct_agg("at").alias("bits")
    )
    return cut_lineage(few.unionByName(many))


def union_counts(links: DataFrame, sets: DataFrame, listed: int = LISTED) -> DataFrame:
    """(id, kind, n): members of the union of a node's own set and the sets of
    all that link to it, for each kind.

    ``links``: source, target, distinct. ``sets`` as in ``containers``. Sizes
    travel first: a range that only one set brings needs no comparison and its
    members stay where they are. Other ranges are united as lists while all
    lists together are short, and as bitmaps beyond.
    """
    own = containers(sets, listed)
    via = links.select(F.col("source").alias("mid"), F.col("target").alias("id"))
    brought = own.withColumnRenamed("id", "mid")
    mine = own.withColumn("mid", F.col("id"))
    sizes = skew_lookup(via, brought.select("mid", "kind", "b", "n"), ["mid"], ["id"], "inner").select("id", "kind", "b", "n")
    ranges = cut_lineage(
        sizes.unionByName(own.select("id", "kind", "b", "n")).groupBy("id", "kind", "b").agg(F.sum("n").alias("most"), F.count("*").alias("parts"))
    )
    alone = ranges.filter("parts = 1").select("id", "kind", F.col("most").alias("n"))
    shared = ranges.filter("parts > 1").select("id", "kind", "b", "most")
    carried = skew_lookup(via, brought.drop("n"), ["mid"], ["id"], "inner").unionByName(mine.drop("n"))
    met = cut_lineage(skew_lookup(carried, shared, ["id", "kind", "b"], ["mid"], "inner"))
    few = (
        met.filter(F.col("most") <= listed)
        .groupBy("id", "kind", "b")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).cast("long").alias("n"))
    )
    dense = met.filter(F.col("most") > listed)
    lists = dense.select("id", "kind", "b", F.explode("places").alias("at")).groupBy("id", "kind", "b").agg(F.bitmap_construct_agg("at").alias("bits"))
    maps = dense.filter(F.col("bits").isNotNull()).select("id", "kind", "b", "bits")
    many = maps.unionByName(lists).groupBy("id", "kind", "b").agg(F.bitmap_count(F.bitmap_or_agg("bits")).alias("n"))
    sized = alone.unionByName(few.drop("b")).unionByName(many.drop("b"))
    return sized.groupBy("id", "kind").agg(F.sum("n").alias("n"))


def words(ids: DataFrame) -> DataFrame:
    """(id, word, bits): each numbered id as the set that holds it alone, 64
    numbers a word. ``ids``: id, number."""
    return ids.select("id", F.shiftright("number", 6).alias("word"), F.expr("shiftleft(1L, cast(number & 63 AS int))").alias("bits"))


def members(sets: DataFrame) -> DataFrame:
    """Rows of word sets as one row a ``number``."""
    at = F.explode(F.filter(F.sequence(F.lit(0), F.lit(63)), lambda i: F.getbit("bits", i) == 1))
    kept = [c for c in sets.columns if c not in ("word", "bits")]
    return sets.select(*kept, "word", at.alias("_at")).select(*kept, (F.col("word") * 64 + F.col("_at")).alias("number"))
