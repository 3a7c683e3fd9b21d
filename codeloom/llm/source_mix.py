"""Mixing sources to target weights by systematic sampling.

Each document of a source expects target / source size copies. Documents are
laid out by size within their source, the expected copies are summed up along
that line, one random offset is added, and a copy is emitted for each integer
passed. Laying them out by size spreads the copies evenly over long and short
documents, so the words taken come near the target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.llm.common import Sealed, staged

WEIGHTS = (3, 1, 2)
#: Sources up to which the per-source rows are broadcast; beyond, Spark joins.
SMALL = 100_000


def words(text: str) -> Column:
    """Number of runs of characters other than blanks; null counts as 0."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def _draw(seed: int, what: Column) -> Column:
    return F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(what.cast("string"), F.lit(""))).cast("binary"))


def targets(sizes: DataFrame, source: str, share: float, cap: float, weights: tuple[int, ...]) -> DataFrame:
    """Target of each source from its ``source_size``: one row per source.

    Weights repeat along the sources by code point, null last. With sources
    sorted by the ratio at which they reach their limit, those at the limit
    are a prefix, and the rest shares what is left by weight.
    """
    order = Window.orderBy(F.col(source).asc_nulls_last())
    weight = F.array(*[F.lit(float(w)) for w in weights])
    ranked = sizes.withColumn("__w", F.get(weight, (F.row_number().over(order) - 1) % len(weights)))
    limit = F.lit(cap) * F.col("source_size")
    by_ratio = Window.orderBy(limit / F.col("__w"), F.col(source).asc_nulls_last())
    every = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    before = by_ratio.rowsBetween(Window.unboundedPreceding, -1)
    after = by_ratio.rowsBetween(0, Window.unboundedFollowing)
    level = ranked.withColumns(
        {
            "__full": limit,
            "__level": (
                F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(limit).over(before), F.lit(0.0))
            )
            / F.sum("__w").over(after),
        }
    ).withColumn("__open", F.col("__full") > F.col("__w") * F.col("__level"))
    # the first source that stays below its limit sets the level of the rest
    ratio = F.col("__full") / F.col("__w")
    first = F.min(F.when(F.col("__open"), F.struct(ratio.alias("r"), F.col("__level").alias("l")))).over(every)
    return level.withColumn(
        "target", F.when(F.col("__open"), F.col("__w") * first["l"]).otherwise(F.col("__full"))
    ).select(source, "source_size", "target")


def mix_sources(
    df: DataFrame,
    *,
    text: str = "text",
    source: str = "source",
    key: str = "doc_id",
    share: float = 1.5,
    cap: float = 2.0,
    weights: tuple[int, ...] = WEIGHTS,
    seed: int = 17,
    keep_text: bool = True,
) -> DataFrame:
    """Adds ``size``, ``source_size``, ``target``, ``copies`` and ``taken``.

    ``copies`` is how often the mix holds the row, 0 for rows left out, at most
    ``cap`` rounded up; ``taken`` is copies times size. A null text has size 0,
    a null source is a source of its own. Rows equal in source, size and key
    may swap copies among themselves; otherwise reruns agree. An empty table
    gives none; without ``keep_text`` the texts are measured but not carried; columns of the five names are replaced, others kept.

    The line of documents is a range partitioning: each partition numbers its
    own rows, only the counts per partition and source are summed across.
    """
    made = ["size", "source_size", "target", "copies", "taken"]
    own = Sealed(df, made, drop=() if keep_text else (text,))
    text, source, key = own.name(text), own.name(source), own.name(key)
    line = [F.col(source).asc_nulls_last(), "size", "__draw", F.col(key)]
    base = own.table.withColumns({"size": words(text), "__draw": _draw(seed, F.col(key))})
    needed = dict.fromkeys([*own.columns, source, key])
    laid = staged(
        base.select(*needed, "size", "__draw")
        .repartitionByRange(*line)
        .sortWithinPartitions(*line)
        .withColumn("__at", F.monotonically_increasing_id()),
        "mix",
    )
    part = F.shiftright("__at", 33).alias("__part")
    runs = laid.groupBy(source, part).agg(
        F.count(F.lit(1)).alias("__n"), F.sum("size").alias("__size"), F.min("__at").alias("__first")
    )
    runs = staged(runs, "mix-runs")  # a row for each source in each partition
    along = Window.partitionBy(source).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = runs.withColumn("__offset", F.coalesce(F.sum("__n").over(along), F.lit(0)) - F.col("__first"))
    goals = targets(runs.groupBy(source).agg(F.sum("__size").alias("source_size")), source, share, cap, weights)
    goals = goals.withColumn("__offer", F.conv(F.substring(_draw(seed + 1, F.col(source)), 1, 5), 16, 10).cast("double") / (1 << 20))
    goals = goals.select(F.col(source).alias("__s"), "source_size", "target", "__offer")
    offsets = offsets.select(F.col(source).alias("__r"), "__part", "__offset")
    facts = offsets.join(goals, F.col("__r").eqNullSafe(F.col("__s"))).drop("__s")
    if runs.count() <= SMALL:  # else the join shuffles by source and partition
        facts = F.broadcast(facts)
    found = laid.join(
        facts, F.col(source).eqNullSafe(F.col("__r")) & (F.shiftright("__at", 33) == F.col("__part"))
    )
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    rank = F.col("__at") + F.col("__offset")  # 0 for the first of its source
    passed = F.floor((rank + 1) * rate + F.col("__offer")) - F.floor(rank * rate + F.col("__offer"))
    return own.restored(
        found.withColumn("copies", passed.cast("long")).withColumn("taken", F.col("copies") * F.col("size"))
    )


def emitted(mixed: DataFrame) -> DataFrame:
    """One row for each copy, numbered from 1 in ``copy``."""
    return mixed.where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))


SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('17:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS draw FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, [3.0::DOUBLE, 1.0::DOUBLE, 2.0::DOUBLE][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w FROM s),
l AS (SELECT *, 2.0::DOUBLE * source_size AS full_size,
         (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
         / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source ASC NULLS LAST)),
g AS (SELECT source, source_size, CASE WHEN full_size > w * level
         THEN w * (SELECT arg_min(level, full_size / w) FROM l WHERE full_size > w * level) ELSE full_size END AS target,
         CAST('0x' || substr(md5('18:' || coalesce(source, '')), 1, 5) AS BIGINT) / 1048576.0::DOUBLE AS offer FROM l),
r AS (SELECT d.doc_id, d.size, g.source_size, g.target, g.offer,
         CASE WHEN g.source_size > 0 THEN g.target / g.source_size ELSE 0 END AS rate,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, d.draw, d.doc_id) AS k
      FROM d JOIN g ON d.source IS NOT DISTINCT FROM g.source)
SELECT doc_id, size, source_size, target,
       CAST(floor(k * rate + offer) - floor((k - 1) * rate + offer) AS BIGINT) * size AS taken FROM r
"""
