"""Pages, top lists, quotas and phases."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.text import contains_any
from codeloom.operators.skew import global_position, skew_lookup


def page(df: DataFrame, order: list[Column], offset: int, limit: int) -> DataFrame:
    return df.orderBy(*order).offset(offset).limit(limit)


def latest_per(jobs: DataFrame, key: str, ts: str, tie: str) -> DataFrame:
    """Newest row per key as an aggregate, so hot keys combine map-side."""
    newest = jobs.groupBy(key).agg(F.max_by(F.struct(*jobs.columns), F.struct(ts, tie)).alias("r"))
    return newest.select("r.*")


def sync_decisions(jobs: DataFrame) -> DataFrame:
    """Incremental when the last job of a repository completed, else full."""
    return latest_per(jobs, "repository_path", "created_at", "job_id").select(
        "repository_path",
        F.col("job_id").alias("last_job"),
        F.when(F.col("status") == "completed", "incremental").otherwise("full").alias("mode"),
    )


def search_entities(entities: DataFrame, query: str, types: list[str] | None = None) -> DataFrame:
    """Name, docstring or metadata contains the query; best name match first."""
    q = query.lower()
    name = F.lower("name")
    where = name.contains(q) | F.coalesce(F.lower("docstring").contains(q), F.lit(False))
    if "metadata" in entities.columns:
        where = where | F.coalesce(F.lower("metadata").contains(q), F.lit(False))
    rank = F.when(name == q, 0).when(name.startswith(q), 1).when(name.contains(q), 2).otherwise(3)
    hits = entities.filter(where)
    if types:
        hits = hits.filter(F.col("type").isin(*types))
    return hits.withColumn("relevance", rank).orderBy("relevance", "seq")


def roadmap(components: DataFrame, bucket: Column, order: list[Column]) -> DataFrame:
    """Three phases cut at a third and two thirds of the priority order."""
    ranked = global_position(
        components,
        [F.col("priority"), (F.col("risk_level") != "Critical")],
        bucket,
        order,
    )
    n = components.agg(F.count("*")).scalar()
    one = F.greatest(F.lit(1), F.floor(n / 3))
    two = F.greatest(one + 1, F.floor(2 * n / 3))
    pos = F.col("position")
    return ranked.withColumn("phase", F.when(pos <= one, 1).when(pos <= two, 2).otherwise(3))


def phase_quotas(scored: DataFrame, order: list[Column]) -> DataFrame:
    """Components per phase; quotas of the first two phases are the plan's own.

    A component may fall in no phase. Phase four has fixed hours only.
    """
    c, x = F.col("criticality"), F.col("complexity_score")
    one = scored.filter(c.isin("low", "medium") & (x <= 5.0)).orderBy(*order).limit(10)
    two = scored.filter((c == "high") & (x <= 7.0)).orderBy(*order).limit(15)
    three = scored.filter((c == "critical") | (x > 7.0))
    tag = lambda df, p: df.withColumn("phase", F.lit(p))
    return tag(one, 1).unionByName(tag(two, 2)).unionByName(tag(three, 3))


# Name, weeks and fixed hours of the four phases.
PHASES = (
    (1, "Foundation & Quick Wins", 8, 0),
    (2, "Core Business Logic Migration", 12, 0),
    (3, "Complex Systems & Integrations", 16, 0),
    (4, "Optimization & Enhancement", 6, 480),
)


def phase_totals(placed: DataFrame) -> DataFrame:
    phases = placed.sparkSession.createDataFrame(PHASES, "phase int, name string, weeks int, fixed_hours int")
    sums = placed.groupBy("phase").agg(F.count("*").alias("n"), F.sum("effort_hours").alias("hours"))
    return phases.join(sums, "phase", "left").select(
        "phase",
        "name",
        "weeks",
        F.coalesce("n", F.lit(0)).alias("n_components"),
        (F.coalesce("hours", F.lit(0)) + F.col("fixed_hours")).cast("long").alias("effort_hours"),
    )


def critical_flows(chains: DataFrame, k: int = 10) -> DataFrame:
    n = F.size("chain")
    return (
        chains.filter(n >= 3)
        .select(
            "start",
            "chain",
            n.alias("complexity"),
            F.when(n > 5, "high").otherwise("medium").alias("significance"),
        )
        .orderBy(F.desc("complexity"), "start", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">"))
        .limit(k)
    )


def ranks_by_value(df: DataFrame, group: str, value: str, spread_by: str, buckets: int = 1000) -> DataFrame:
    """rank() descending, within a group and overall, of a value in [0, 1].

    Equal values share a rank, so ranks are worked out on counts per distinct
    value and looked up. Two levels of counts keep every window small.
    """
    per = df.groupBy(group, value).agg(F.count("*").alias("n")).withColumn("b", F.floor(F.col(value) * buckets))
    before = lambda part, order: F.coalesce(
        F.sum("n").over(Window.partitionBy(*part).orderBy(F.desc(order)).rowsBetween(Window.unboundedPreceding, -1)),
        F.lit(0),
    )

    def ranked(counts: DataFrame, keys: list[str], out: str) -> DataFrame:
        slices = counts.groupBy(*keys, "b").agg(F.sum("n").alias("n"))
        above = slices.withColumn("above", before(keys, "b")).drop("n")
        inside = counts.withColumn("inside", before([*keys, "b"], value))
        return inside.join(above, [*keys, "b"]).select(
            *keys, value, (F.col("above") + F.col("inside") + 1).alias(out)
        )

    overall = per.groupBy(value, "b").agg(F.sum("n").alias("n"))
    in_group = ranked(per, [group], "category_rank")
    everywhere = ranked(overall, [], "overall_rank")
    return skew_lookup(df, in_group.join(everywhere, value), [group, value], [spread_by], "inner")


def first_k(df: DataFrame, group: Column | str, order: list[Column], k: int) -> DataFrame:
    """First k rows per group; Spark cuts each map task to k before shuffling."""
    w = Window.partitionBy(group).orderBy(*order)
    return df.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def last_days(trend: DataFrame, k: int = 7) -> DataFrame:
    """Newest k days of a trend with a month-day label, oldest first."""
    return (
        trend.orderBy(F.desc("date"))
        .limit(k)
        .select("date", F.substring("date", 6, 5).alias("label"), "successful", "rules")
        .orderBy("date")
    )


def flow_steps(functions: DataFrame, order: list[Column], k: int = 20) -> DataFrame:
    """First k functions and the edges chaining them in order."""
    top = functions.orderBy(*order).limit(k)
    # at most k rows are left, one task numbers them
    w = Window.orderBy(*order)
    return top.withColumns({"step": F.row_number().over(w) - 1, "previous": F.lag("name").over(w)})


def critical_risks(scored: DataFrame, general: tuple[str, ...], k: int = 10) -> DataFrame:
    """Distinct risks of critical components and the general ones, by name."""
    found = scored.filter(F.col("criticality") == "critical").select(F.explode("risks").alias("risk"))
    fixed = scored.sparkSession.createDataFrame([(r,) for r in general], "risk string")
    return found.distinct().unionByName(fixed).distinct().orderBy("risk").limit(k)


def mentions(df: DataFrame, column: str, needles: tuple[str, ...]) -> DataFrame:
    return df.filter(contains_any(F.lower(column), needles))
