"""Domain tables derived from the given tables, in Spark and in SQL.

Everything is a projection, join or aggregate of whole given tables, so work
grows with them. Source texts for the extractors are written from part rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog.registry import binding
from codeloom.functions.classify import STEP_WEIGHTS


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """A table of short rows over all cores, for what is derived from it: some
    MB of a file, one task's share, hold millions of keys."""
    conf = df.sparkSession.conf
    tasks = max(df.sparkSession.sparkContext.defaultParallelism, int(conf.get("spark.sql.shuffle.partitions")))
    return df.repartition(tasks, key)


def pick(values, index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), index.cast("int") + 1)


def sql_pick(values, index: str) -> str:
    return "[" + ",".join(f"'{v}'" for v in values) + f"][({index})::INT + 1]"


def fill(template: str, **values: Column) -> Column:
    """Text template with ``<<name>>`` slots as a concat of columns."""
    parts, rest = [], template
    while "<<" in rest:
        head, _, tail = rest.partition("<<")
        name, _, rest = tail.partition(">>")
        parts += [F.lit(head), values[name].cast("string")]
    return F.concat(*parts, F.lit(rest))


# ---- jobs, repositories ------------------------------------------------------


def jobs(spark: SparkSession, d: str, counts: bool = True, since: Column | None = None) -> DataFrame:
    """``since`` keeps newer orders only, and their lines before they are
    counted, so a short look back does not aggregate the whole line table."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem")
    if since is not None:
        o = o.filter(F.col("o_orderdate") >= since)
        lines = lines.join(o.select(F.col("o_orderkey").alias("l_orderkey")), "l_orderkey", "left_semi")
    done = F.col("o_orderstatus") == "F"
    base = o.select(
        F.col("o_orderkey").alias("k"),
        F.col("o_orderkey").cast("string").alias("job_id"),
        F.concat(F.lit("/repos/r"), (F.col("o_custkey") % 50).cast("string")).alias("repository_path"),
        F.when(done, "completed").when(F.col("o_orderstatus") == "P", "processing").otherwise("failed").alias("status"),
        F.col("o_orderdate").alias("created_at"),
        F.when(done, F.col("o_totalprice") / 1000).alias("processing_time"),
        F.when(
            done,
            F.col("o_orderdate") + F.make_dt_interval(secs=F.floor(F.col("o_totalprice") / 1000)),
        ).alias("completed_at"),
    )
    if not counts:
        return base
    per = (
        lines.groupBy(F.col("l_orderkey").alias("k"))
        .agg(
            F.count("*").alias("entities_count"),
            F.sum("l_quantity").cast("int").alias("files_processed"),
            F.count_if(F.col("l_returnflag") == "R").alias("rules_count"),
        )
    )
    return base.join(per, "k", "left")


binding(
    "job_lines",
    "SELECT l_orderkey, count(*) AS n, CAST(sum(l_quantity) AS INTEGER) AS q, "
    "count(*) FILTER (WHERE l_returnflag = 'R') AS r FROM lineitem GROUP BY 1",
)
binding(
    "jobs",
    "SELECT o_orderkey AS k, CAST(o_orderkey AS VARCHAR) AS job_id, '/repos/r' || (o_custkey % 50) AS repository_path, "
    "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'P' THEN 'processing' ELSE 'failed' END AS status, "
    "o_orderdate AS created_at, CASE WHEN o_orderstatus = 'F' THEN o_totalprice / 1000 END AS processing_time, "
    "CASE WHEN o_orderstatus = 'F' THEN o_orderdate + to_seconds(CAST(floor(o_totalprice / 1000) AS BIGINT)) END AS completed_at, "
    "n AS entities_count, q AS files_processed, r AS rules_count "
    "FROM orders LEFT JOIN job_lines ON l_orderkey = o_orderkey",
)


def repositories(spark: SparkSession, d: str) -> DataFrame:
    """path and languages (part type to line count) per supplier; the map has
    at most one entry per part type."""
    li = table(spark, d, "lineitem").select("l_suppkey", "l_partkey")
    p = table(spark, d, "part").select(F.col("p_partkey").alias("l_partkey"), "p_type")
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_name")
    per = (
        li.groupBy("l_suppkey", "l_partkey")
        .agg(F.count("*").alias("n"))
        .join(p, "l_partkey")
        .groupBy("l_suppkey", "p_type")
        .agg(F.sum("n").alias("n"))
        .groupBy("l_suppkey")
        .agg(F.map_from_entries(F.collect_list(F.struct("p_type", "n"))).alias("languages"))
    )
    return s.join(per, "l_suppkey", "left").select(
        F.concat(F.lit("/repos/"), "s_name").alias("path"), F.col("s_name").alias("name"), "languages"
    )


# ---- files, entities, rules ---------------------------------------------------

EXTS = (".py", ".java", ".ts", ".jsp", ".xml", ".sql", ".js", ".html", ".idl", ".css", ".TS", ".scss", ".txt")
DIRS = ("angular", "controller", "action", "web", "api", "core", "rest", "ui", "endpoint", "dao", "service")


def files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("doc_id")
    name = (
        F.when(k % 17 == 0, F.concat(F.lit("m"), k.cast("string"), F.lit("/struts.xml")))
        .when(k % 17 == 1, F.concat(F.lit("c"), k.cast("string"), F.lit(".component.ts")))
        .when(k % 17 == 2, F.concat(F.lit("m"), k.cast("string"), F.lit("/struts-config.xml")))
        .otherwise(F.concat(F.lit("f"), k.cast("string"), pick(EXTS, k % 13)))
    )
    return table(spark, d, "documents").select(
        k,
        F.col("source").alias("repo"),
        F.concat_ws("/", F.lit("src"), "source", pick(DIRS, k % 11), "lang", name).alias("file_path"),
        "text",
        "lang",
    )


binding(
    "files",
    "SELECT doc_id, source AS repo, 'src/' || source || '/' || "
    + sql_pick(DIRS, "doc_id % 11")
    + " || '/' || lang || '/' || CASE WHEN doc_id % 17 = 0 THEN 'm' || doc_id || '/struts.xml' "
    "WHEN doc_id % 17 = 1 THEN 'c' || doc_id || '.component.ts' WHEN doc_id % 17 = 2 THEN 'm' || doc_id || '/struts-config.xml' "
    "ELSE 'f' || doc_id || " + sql_pick(EXTS, "doc_id % 13") + " END AS file_path, text, lang FROM documents",
)

KINDS = ("class", "function", "interface", "corba_interface", "corba_struct")
WORDS = ("api", "service", "legacy", "payment", "controller", "web", "repository", "core")
CODE_EXTS = (".py", ".java", ".ts", ".jsp", ".xml", ".sql", ".js")
PATTERNS = ("Singleton", "Factory", "Builder")


def entities(spark: SparkSession, d: str) -> DataFrame:
    return entities_of(table(spark, d, "part"))


def entities_of(part: DataFrame) -> DataFrame:
    k = F.col("p_partkey")
    f = F.floor(k / 10)
    many = lambda prefix, n: F.transform(
        F.array_repeat(F.lit(prefix), n.cast("int")), lambda x, i: F.concat(x, i.cast("string"))
    )
    kind = pick(KINDS, k % 5)
    inherits = F.when((kind == "corba_interface") & (k % 2 == 1), 1).otherwise(0)
    return part.select(
        k.alias("k"),
        k.alias("seq"),
        F.concat(F.lit("e"), k.cast("string")).alias("entity_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.floor(k / 4).cast("string")).alias("name"),
        kind.alias("type"),
        F.concat(
            F.lit("src/"), pick(WORDS, f % 8), F.lit("/m"), (f % 50).cast("string"), F.lit("/f"), f.cast("string"),
            pick(CODE_EXTS, f % 7),
        ).alias("file_path"),
        ((k % 10) * 20 + 1).cast("int").alias("line_number"),
        F.col("p_size").alias("complexity"),
        many("m", k % 7).alias("methods"),
        many("a", k % 4).alias("properties"),
        many("dep", k % 12).alias("dependencies"),
        many("Base", k % 3).alias("base_classes"),
        F.when(k % 6 < 3, F.array(pick(PATTERNS, F.least(k % 6, F.lit(2))))).otherwise(F.array().cast("array<string>")).alias("design_patterns"),
        many("l", F.when(k % 4 == 0, 2).otherwise(0)).alias("business_logic_patterns"),
        many("c", k % 9).alias("function_calls"),
        many("I", inherits).alias("inheritance"),
        (k % 8).cast("int").alias("n_rules"),
        F.concat_ws(" ", "p_name", F.lower("p_type"), F.lower("p_brand")).alias("docstring"),
        F.col("p_type").alias("category"),
    )


binding(
    "ent",
    "SELECT p_partkey AS k, 'e' || p_partkey AS entity_id, replace(p_name, ' ', '_') || '_' || (p_partkey // 4) AS name, "
    + sql_pick(KINDS, "p_partkey % 5")
    + " AS type, 'src/' || "
    + sql_pick(WORDS, "(p_partkey // 10) % 8")
    + " || '/m' || ((p_partkey // 10) % 50) || '/f' || (p_partkey // 10) || "
    + sql_pick(CODE_EXTS, "(p_partkey // 10) % 7")
    + " AS file_path, CAST((p_partkey % 10) * 20 + 1 AS INTEGER) AS line_number, p_size AS complexity, "
    "p_partkey % 7 AS n_methods, p_partkey % 4 AS n_props, p_partkey % 12 AS n_deps_list, p_partkey % 3 AS n_bases, "
    "CASE WHEN p_partkey % 6 < 3 THEN 1 ELSE 0 END AS n_patterns, p_partkey % 6 AS pat, "
    "CASE WHEN p_partkey % 4 = 0 THEN 2 ELSE 0 END AS n_logic, p_partkey % 9 AS n_calls, "
    "CASE WHEN p_partkey % 5 = 3 AND p_partkey % 2 = 1 THEN 1 ELSE 0 END AS n_inherit, "
    "CAST(p_partkey % 8 AS INTEGER) AS n_rules, p_name || ' ' || lower(p_type) || ' ' || lower(p_brand) AS docstring, "
    "p_type AS category FROM part",
)
# Module path of an entity: folders that never count are the leading "src".
binding(
    "entm",
    "SELECT *, replace(regexp_replace(regexp_replace(file_path, '^src/', ''), '\\.[^.]+$', ''), '/', '.') AS module_path FROM ent",
)


def entities_in_modules(spark: SparkSession, d: str) -> DataFrame:
    from codeloom.functions.paths import module_path

    parts = spread(table(spark, d, "part"), "p_partkey")
    return entities_of(parts).withColumn("module_path", module_path(F.col("file_path")))


def rules(spark: SparkSession, d: str) -> DataFrame:
    """One rule per part: whole short descriptions, hot categories."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("k"),
        F.concat(F.lit("BR-"), k.cast("string")).alias("rule_id"),
        F.concat_ws(" ", "p_name", F.lit("of the"), F.lower("p_brand")).alias("description"),
        ((k % 100) / 100).alias("confidence_score"),
        F.col("p_type").alias("category"),
        F.concat(F.lit("e"), (k - k % 3).cast("string")).alias("entity_id"),
        F.concat(F.lit("e"), (k - k % 3).cast("string")).alias("code_entity_id"),
        F.when(k % 4 != 0, F.concat(F.lit("C"), (k % 500).cast("string"))).alias("class_context"),
        F.when(k % 5 == 0, "external").alias("integration_points"),
        F.when(k % 3 == 0, F.concat(F.lit("process "), (k % 11).cast("string"))).alias("business_process"),
    )


binding(
    "rules",
    "SELECT p_partkey AS k, 'BR-' || p_partkey AS rule_id, p_name || ' of the ' || lower(p_brand) AS description, "
    "(p_partkey % 100) / 100 AS confidence_score, p_type AS category, 'e' || (p_partkey - p_partkey % 3) AS entity_id, "
    "CASE WHEN p_partkey % 4 <> 0 THEN 'C' || (p_partkey % 500) END AS class_context, "
    "CASE WHEN p_partkey % 5 = 0 THEN 'external' END AS integration_points, "
    "CASE WHEN p_partkey % 3 = 0 THEN 'process ' || (p_partkey % 11) END AS business_process FROM part",
)


def document_rules(spark: SparkSession, d: str) -> DataFrame:
    """Rules from whole documents with their labels."""
    k = F.col("doc_id")
    return (
        table(spark, d, "documents")
        .join(table(spark, d, "labels"), "doc_id", "left")
        .select(
            F.concat(F.lit("BR-"), k.cast("string")).alias("rule_id"),
            F.col("lang").alias("category"),
            ((k % 100) / 100).alias("confidence_score"),
            (k % 200).alias("entity"),
            F.coalesce("quality", F.lit(-1)).alias("quality"),
            F.when(k % 5 == 0, "external").alias("integration_points"),
        )
    )


binding(
    "doc_rules",
    "SELECT 'BR-' || doc_id AS rule_id, lang AS category, (doc_id % 100) / 100 AS confidence_score, doc_id % 200 AS entity, "
    "coalesce(quality, -1) AS quality, CASE WHEN doc_id % 5 = 0 THEN 'external' END AS integration_points "
    "FROM documents LEFT JOIN labels USING (doc_id)",
)

# ---- graphs ----------------------------------------------------------------------


def supply_calls(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("caller"), F.col("l_partkey").alias("callee"), F.col("l_linenumber").alias("line")
    )


def part_edges(spark: SparkSession, d: str) -> DataFrame:
    """Two calls per part: to its half and to its twin; has cycles."""
    k = F.col("p_partkey")
    return table(spark, d, "part").select(
        k.alias("source"), F.explode(F.array(F.floor(k / 2), k.bitwiseXOR(F.lit(1).cast("long")))).alias("target")
    )


binding(
    "edges",
    "SELECT DISTINCT source, target FROM (SELECT p_partkey AS source, p_partkey // 2 AS target FROM part "
    "UNION ALL SELECT p_partkey, xor(p_partkey, 1) FROM part)",
)


def geography(spark: SparkSession, d: str) -> DataFrame:
    """Region > nation > customer > order as one parent table."""
    tag = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    none = F.lit(None).cast("string")
    r = table(spark, d, "region").select(tag("r", "r_regionkey").alias("id"), none.alias("parent_id"))
    n = table(spark, d, "nation").select(tag("n", "n_nationkey").alias("id"), tag("r", "n_regionkey").alias("parent_id"))
    c = table(spark, d, "customer").select(tag("c", "c_custkey").alias("id"), tag("n", "c_nationkey").alias("parent_id"))
    o = table(spark, d, "orders").select(tag("o", "o_orderkey").alias("id"), tag("c", "o_custkey").alias("parent_id"))
    return r.unionByName(n).unionByName(c).unionByName(o).withColumn("label", F.col("id"))


binding(
    "geo",
    "SELECT 'r' || r_regionkey AS id, CAST(NULL AS VARCHAR) AS parent_id FROM region "
    "UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey FROM nation "
    "UNION ALL SELECT 'c' || c_custkey, 'n' || c_nationkey FROM customer "
    "UNION ALL SELECT 'o' || o_orderkey, 'c' || o_custkey FROM orders",
)

# ---- logs and progress -----------------------------------------------------------


def logs(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, d, "events").select(
        F.col("event_id").alias("log_id"),
        "ts",
        F.when(t == "error", "ERROR").when(t == "signup", "WARNING").otherwise("INFO").alias("level"),
        t.alias("logger"),
        F.col("props").alias("message"),
        "user_id",
    )


binding(
    "logs",
    "SELECT event_id AS log_id, ts, CASE event_type WHEN 'error' THEN 'ERROR' WHEN 'signup' THEN 'WARNING' ELSE 'INFO' END AS level, "
    "event_type AS logger, props AS message, user_id FROM events",
)


def progress(spark: SparkSession, d: str) -> DataFrame:
    return progress_of(table(spark, d, "events"))


def progress_of(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("user_id").cast("string").alias("job_id"),
        "ts",
        "event_id",
        pick(STEP_WEIGHTS, F.col("event_id") % len(STEP_WEIGHTS)).alias("step"),
        F.least(F.lit(100), F.floor("value")).cast("int").alias("progress"),
    )


binding(
    "progress",
    "SELECT CAST(user_id AS VARCHAR) AS job_id, ts, event_id, "
    + sql_pick(STEP_WEIGHTS, f"event_id % {len(STEP_WEIGHTS)}")
    + " AS step, CAST(least(100, floor(value)) AS INTEGER) AS progress FROM events",
)
