"""Aggregations: platform metrics, profiles, statistics and summaries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions import scoring as S
from codeloom.functions.classify import confidence_band3, ladder
from codeloom.functions.paths import suffix
from codeloom.functions.text import contains_any, present


def _whole(df: DataFrame) -> Column:
    """Window over a table that was already aggregated to a few rows."""
    return Window.partitionBy()


# ---- jobs ------------------------------------------------------------------

def platform_metrics(jobs: DataFrame, repositories: DataFrame) -> DataFrame:
    done = F.col("status") == "completed"
    totals = jobs.agg(
        F.count("*").alias("total_jobs"),
        F.count_if(done).alias("successful_jobs"),
        F.count_if(F.col("status") == "failed").alias("failed_jobs"),
        F.coalesce(F.avg(F.when(done, F.col("processing_time"))), F.lit(0.0)).alias("average_processing_time"),
        F.coalesce(F.sum("entities_count"), F.lit(0)).alias("total_entities"),
        F.coalesce(F.sum("rules_count"), F.lit(0)).alias("total_business_rules"),
    )
    return totals.withColumn(
        "repositories_analyzed", repositories.agg(F.count("*")).scalar()
    )


def daily_trend(jobs: DataFrame, days: int = 30, as_of: Column | None = None) -> DataFrame:
    """Per day of the last ``days`` days before ``as_of`` (the newest job)."""
    newest = jobs.agg(F.max("created_at")).scalar() if as_of is None else as_of
    done = F.col("status") == "completed"
    return (
        jobs.filter(F.col("created_at") >= newest - F.expr(f"interval {int(days)} days"))
        .groupBy(F.date_format("created_at", "yyyy-MM-dd").alias("date"))
        .agg(
            F.count("*").alias("total"),
            F.count_if(done).alias("successful"),
            F.count_if(F.col("status") == "failed").alias("failed"),
            F.sum(F.when(done, F.coalesce("entities_count", F.lit(0))).otherwise(0)).alias("entities"),
            F.sum(F.when(done, F.coalesce("rules_count", F.lit(0))).otherwise(0)).alias("rules"),
        )
    )


def language_distribution(repositories: DataFrame) -> DataFrame:
    """Share per language over all repositories' language maps."""
    per = (
        repositories.select(F.explode("languages").alias("language", "n"))
        .groupBy("language")
        .agg(F.sum("n").alias("n"))
    )
    return per.select(
        "language", F.round(F.col("n") / F.sum("n").over(_whole(per)) * 100, 2).alias("pct")
    )


def performance_by_size(jobs: DataFrame) -> DataFrame:
    files = F.coalesce("files_processed", F.lit(0))
    size = ladder([(files < 100, "small"), (files < 500, "medium")], "large")
    stats = (
        jobs.filter(F.col("status") == "completed")
        .groupBy(size.alias("size"))
        .agg(F.count("*").alias("count"), F.avg(F.coalesce("processing_time", F.lit(0.0))).alias("t"))
    )
    sizes = jobs.sparkSession.createDataFrame([("small",), ("medium",), ("large",)], "size string")
    return sizes.join(stats, "size", "left").select(
        "size",
        F.coalesce("count", F.lit(0)).alias("count"),
        F.round(F.coalesce("t", F.lit(0.0)), 2).alias("avg_time"),
    )


# Extensions whose lines are counted in the short profile.
LINE_EXTS = (".py", ".java", ".js", ".ts", ".pl", ".txt", ".md")


def repository_profile(files: DataFrame, all_lines: bool = False) -> DataFrame:
    """Files, lines and size per repository. ``files``: repo, path, size_bytes, n_lines."""
    counted = F.col("n_lines") if all_lines else F.when(suffix(F.col("path")).isin(*LINE_EXTS), F.col("n_lines"))
    return files.groupBy("repo").agg(
        F.count("*").alias("total_files"),
        F.coalesce(F.sum(counted), F.lit(0)).alias("total_lines"),
        F.round(F.sum("size_bytes") / (1024 * 1024), 2).alias("size_mb"),
    )


def extension_counts(files: DataFrame) -> DataFrame:
    return (
        files.withColumn("ext", suffix(F.col("path")))
        .filter(F.col("ext") != "")
        .groupBy("repo", "ext")
        .agg(F.count("*").alias("n"))
    )


# ---- graph and entities -------------------------------------------------------


def graph_statistics(entities: DataFrame, edges: DataFrame, rules: DataFrame) -> DataFrame:
    """Long form: (metric, key, value)."""

    def metric(df: DataFrame, name: str, value: Column, key: str | None = None) -> DataFrame:
        grouped = df.groupBy(F.col(key).alias("key")) if key else df.groupBy(F.lit("").alias("key"))
        return grouped.agg(value.cast("double").alias("value")).select(F.lit(name).alias("metric"), "key", "value")

    n = F.count("*")
    complexity = F.round(F.coalesce(F.avg(F.nullif("complexity", F.lit(0))), F.lit(0.0)), 6)
    out = metric(entities, "total_entities", n)
    for part in (
        metric(edges, "total_relationships", n),
        metric(rules, "total_business_rules", n),
        metric(entities, "modules_count", F.countDistinct("module_path")),
        metric(entities, "avg_complexity", complexity),
        metric(entities, "entities_by_type", n, "type"),
        metric(edges, "relationships_by_type", n, "relationship_type"),
    ):
        out = out.unionByName(part)
    return out


def module_structure(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Entities by module and type, with the module's entity and rule totals.

    Rules are counted per entity first, then both sides reduce to one row per
    (module, type) before they meet.
    """
    per_entity = rules.groupBy("entity_id").agg(F.count("*").alias("n_found"))
    by_type = (
        entities.select("entity_id", "module_path", "type")
        .join(per_entity, "entity_id", "left")
        .groupBy("module_path", "type")
        .agg(F.count("*").alias("n_entities"), F.sum(F.coalesce("n_found", F.lit(0))).alias("n_rules"))
    )
    totals = by_type.groupBy("module_path").agg(
        F.sum("n_entities").alias("module_entities"), F.sum("n_rules").alias("module_rules")
    )
    return by_type.join(totals, "module_path").select(
        "module_path", "type", "n_entities", "module_entities", "module_rules"
    )


# Entity kinds counted one by one.
COUNTED_KINDS = ("class", "function", "method", "interface", "enum", "variable")


def kind_counts(entities: DataFrame) -> DataFrame:
    plural = lambda k: k + ("es" if k == "class" else "s")
    return entities.agg(*[F.count_if(F.lower("type") == k).alias(plural(k)) for k in COUNTED_KINDS])


def type_distribution(entities: DataFrame) -> DataFrame:
    per = entities.groupBy("type").agg(F.count("*").alias("n"))
    total = F.sum("n").over(_whole(per))
    of = lambda k: F.sum(F.when(F.col("type") == k, F.col("n")).otherwise(0)).over(_whole(per))
    flags = present(
        F.when(of("class") > of("function"), "Object-oriented design emphasis"),
        F.when(of("function") > of("class") * 2, "Functional programming patterns"),
        F.when(of("interface") > 0, "Interface-driven architecture"),
        F.when(of("enum") > 0, "Type-safe enumeration usage"),
    )
    return per.select(
        "type",
        "n",
        F.round(F.col("n") / total * 100, 1).alias("pct"),
        F.when(F.size(flags) > 0, F.array_join(flags, "; ")).otherwise("Mixed programming paradigms").alias("patterns"),
    )


def top_directories(entities: DataFrame, k: int = 5) -> DataFrame:
    """Busiest first and first-two path segments."""
    parts = F.split(F.replace(F.col("file_path"), F.lit("\\"), F.lit("/")), "/")
    keys = F.array_compact(
        F.array(
            F.when(F.size(parts) > 1, parts[0]),
            F.when(F.size(parts) > 2, F.concat_ws("/", parts[0], F.get(parts, F.lit(1)))),
        )
    )
    return (
        entities.select(F.explode(keys).alias("directory"))
        .groupBy("directory")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "directory")
        .limit(k)
    )


# Name parts that point at a known layering.
NAMING_PATTERNS = (
    (("Service",), "Service layer pattern detected"),
    (("Controller",), "Controller pattern (MVC/Web API)"),
    (("Repository", "Dao"), "Repository/DAO pattern"),
    (("Factory",), "Factory pattern usage"),
    (("Manager",), "Manager/Coordinator pattern"),
    (("Handler",), "Handler/Command pattern"),
)


def naming_patterns(entities: DataFrame) -> DataFrame:
    """(pattern, n_names) with at least one name showing it, in one pass."""
    labels = present(*[F.when(contains_any(F.col("name"), parts), label) for parts, label in NAMING_PATTERNS])
    return entities.select(F.explode(labels).alias("pattern")).groupBy("pattern").agg(F.count("*").alias("n_names"))


def system_label(entities: DataFrame) -> DataFrame:
    from codeloom.functions.classify import system_size

    return entities.agg(F.count("*").alias("n_entities")).withColumn(
        "system_size", system_size(F.col("n_entities"))
    )


# ---- embedded SQL ---------------------------------------------------------------


def statement_statistics(statements: DataFrame) -> DataFrame:
    """Long form: totals, by type and by table (metric, key, n)."""
    q = F.col("query_text")
    totals = statements.agg(
        F.count("*").alias("total"),
        F.count_if("is_prepared").alias("prepared"),
        F.count_if(F.size("parameters") > 0).alias("parameterized"),
        F.count_if((F.length(q) > 200) | F.upper(q).contains("JOIN")).alias("complex"),
    )
    names = ("total", "prepared", "parameterized", "complex")
    flat = totals.select(
        F.explode(F.create_map(*[x for n in names for x in (F.lit(n), F.col(n))])).alias("metric", "n")
    ).select("metric", F.lit("").alias("key"), "n")
    by_type = statements.groupBy(F.col("query_type").alias("key")).agg(F.count("*").alias("n"))
    by_table = statements.select(F.explode("tables").alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    return flat.unionByName(by_type.withColumn("metric", F.lit("by_type"))).unionByName(
        by_table.withColumn("metric", F.lit("by_table"))
    )


def top_tables(statements: DataFrame, k: int = 10) -> DataFrame:
    return (
        statements.select(F.explode("tables").alias("table_name"))
        .groupBy("table_name")
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "table_name")
        .limit(k)
    )


def file_statement_counts(statements: DataFrame) -> DataFrame:
    n_tables = statements.select("file_path", F.explode("tables").alias("t")).groupBy("file_path").agg(
        F.countDistinct("t").alias("n_tables")
    )
    return (
        statements.groupBy("file_path")
        .agg(F.count("*").alias("n_queries"))
        .join(n_tables, "file_path", "left")
        .select("file_path", "n_queries", F.coalesce("n_tables", F.lit(0)).alias("n_tables"))
    )


def inferred_schema(statements: DataFrame) -> DataFrame:
    """Distinct (table, column) pairs; a few column names per statement."""
    from codeloom.operators.extract_sql import projected_columns

    return (
        statements.select(F.explode("tables").alias("table_name"), projected_columns(F.col("query_text")).alias("c"))
        .select("table_name", F.explode("c").alias("column_name"))
        .distinct()
    )


# ---- rules ----------------------------------------------------------------------


def rule_categories(rules: DataFrame) -> DataFrame:
    c = F.col("confidence_score")
    return (
        rules.groupBy("category")
        .agg(
            F.count("*").alias("n_rules"),
            F.round(F.avg(c), 6).alias("avg_confidence"),
            F.count_if(c >= 0.8).alias("high_confidence"),
        )
        .orderBy(F.desc("n_rules"), "category")
    )


def rules_by_hierarchy(rules: DataFrame) -> DataFrame:
    """Level and key per rule, as rows.

    ``rules`` carries the entity's type and name, module_path, class_context
    and band (``related_bands``, null when unrelated). A rule on another kind of entity counts as cross-cutting
    when it relates to more than two others.
    """
    t = F.col("entity_type")
    level = ladder(
        [
            (t == "module", "module"),
            (t.isin("class", "interface"), "class"),
            (t.isin("method", "function"), "method"),
            (F.col("band").isin("3-4", "5+"), "cross_cutting"),
        ],
        F.lit(None).cast("string"),
    )
    dotted = F.concat_ws(".", "module_path", F.coalesce("class_context", F.lit("")), "entity_name")
    key = (
        F.when(level == "module", F.col("module_path"))
        .when(level == "class", F.concat_ws(".", "module_path", "entity_name"))
        .when(level == "method", F.regexp_replace(dotted, r"^\.+|\.+$", ""))
        .otherwise("")
    )
    return (
        rules.withColumns({"level": level, "hierarchy_key": key})
        .filter(F.col("level").isNotNull())
        .select("rule_id", "level", "hierarchy_key")
    )


def hierarchy_counts(placed: DataFrame) -> DataFrame:
    return placed.groupBy("level", "hierarchy_key").agg(F.count("*").alias("n_rules"))


def confidence_distribution(rules: DataFrame) -> DataFrame:
    band = confidence_band3(F.col("confidence_score"))
    per = rules.groupBy(band.alias("band")).agg(
        F.count("*").alias("n_rules"), F.count_if(F.coalesce("integration_points", F.lit("")) != "").alias("n_integration")
    )
    return per.withColumn("pct", F.round(F.col("n_rules") / F.sum("n_rules").over(_whole(per)) * 100, 1))


def impact_bands(counts: DataFrame) -> DataFrame:
    related = F.col("band")
    band = ladder([(related == "5+", "high"), (related.isin("2", "3-4"), "medium")], "low")
    return counts.groupBy(band.alias("band")).agg(F.count("*").alias("n_rules"))


def class_capabilities(rules: DataFrame, k: int = 5) -> DataFrame:
    """First ``k`` distinct business processes per class, by name."""
    distinct = rules.filter(
        F.col("class_context").isNotNull() & F.col("business_process").isNotNull()
    ).select("class_context", "business_process").distinct()
    w = Window.partitionBy("class_context").orderBy("business_process")
    return distinct.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k)


def business_processes(rules: DataFrame, k: int = 10) -> DataFrame:
    return (
        rules.filter(F.coalesce("business_process", F.lit("")) != "")
        .select("rule_id", F.col("business_process").alias("name"), "category")
        .orderBy("rule_id")
        .limit(k)
    )


# ---- components -------------------------------------------------------------------


def component_counts(components: DataFrame) -> DataFrame:
    risk, level = F.col("risk_level"), F.col("level")
    return components.agg(
        F.count("*").alias("total_components"),
        F.count_if(risk == "Critical").alias("critical_components"),
        F.count_if(risk.isin("High", "Critical")).alias("high_risk_components"),
        F.count_if(level.isin("Low", "Medium")).alias("modernization_opportunities"),
        F.count_if(level == "Low").alias("n_low"),
        F.count_if(level == "Medium").alias("n_medium"),
        F.count_if(level.isin("High", "Very High")).alias("n_high"),
        F.coalesce(F.sum("billed_hours"), F.lit(0)).alias("hours"),
    )


def migration_summary(
    components: DataFrame, database_mode: str = "static", integration_complexity: str = "Medium"
) -> DataFrame:
    """The one-row summary: counts, readiness, effort, approach, timeline."""
    c = component_counts(components)
    total = F.col("total_components")
    ratio = (F.col("n_low") + F.col("n_medium") * 0.7 + F.col("n_high") * 0.3) / total
    bonus = (10 if database_mode == "enhanced" else 0) + {"Low": 15, "High": -15}.get(integration_complexity, 0)
    score = (
        F.lit(50 + bonus)
        + F.when(total > 0, F.floor(ratio * 30 + 1e-9)).otherwise(0)
        - F.least(F.lit(30), F.col("critical_components") * 5)
    )
    days = F.floor(F.floor(F.col("hours") * 1.2 + 1e-9) / 8)
    return (
        c.withColumn("readiness", F.greatest(F.lit(0), F.least(F.lit(100), score)).cast("int"))
        .withColumn("effort_days", days.cast("long"))
        .withColumn("recommended_approach", S.overall_approach(F.col("readiness")))
        .withColumn("timeline", S.timeline(F.col("effort_days"), F.col("high_risk_components")))
        .withColumn("investment", S.investment(F.col("effort_days")))
        .withColumn("business_impact", S.disruption(F.col("readiness")))
        .drop("n_low", "n_medium", "n_high", "hours")
    )


def risk_matrix(components: DataFrame) -> DataFrame:
    """Components keyed by risk, as rows; a level's list has no bound."""
    return components.select(
        F.lower("risk_level").alias("risk"),
        "name",
        F.col("component_type").alias("type"),
        F.col("level").alias("complexity"),
        F.col("effort_text").alias("effort"),
        F.col("n_deps").alias("dependencies"),
        "approach",
    )


def effort_breakdown(components: DataFrame) -> DataFrame:
    level = F.col("level")
    return (
        components.groupBy("component_type")
        .agg(
            F.count("*").alias("components"),
            F.sum("billed_hours").alias("total_effort"),
            *[
                F.count_if(level == name).alias(f"n_{name.lower().replace(' ', '_')}")
                for name in ("Low", "Medium", "High", "Very High")
            ],
        )
        .withColumn("avg_effort", F.floor(F.col("total_effort") / F.col("components")).cast("long"))
    )


def technology_breakdown(components: DataFrame) -> DataFrame:
    per = components.groupBy("component_type").agg(F.count("*").alias("n"))
    return per.withColumn("pct", F.round(F.col("n") / F.sum("n").over(_whole(per)) * 100, 1))


# Texts of the summary's insights.
READY = "System shows good readiness for modernization"
UNREADY = "System requires significant preparation before migration"
CRITICAL_LEFT = " critical components require immediate attention"


def key_insights(summary: DataFrame) -> DataFrame:
    n = F.col("critical_components")
    return summary.select(
        F.explode(
            present(
                F.when(F.col("readiness") >= 70, READY),
                F.when(F.col("readiness") < 40, UNREADY),
                F.when(n > 0, F.concat(n.cast("string"), F.lit(CRITICAL_LEFT))),
            )
        ).alias("insight")
    )


def database_component(statements: DataFrame) -> DataFrame:
    """The database layer as one component row, from two aggregates."""
    tables = statements.select(F.explode("tables").alias("t")).agg(F.countDistinct("t")).scalar()
    n, t = F.col("n_queries"), F.col("n_tables")
    return (
        statements.agg(F.count("*").alias("n_queries"))
        .withColumn("n_tables", tables)
        .filter(n > 0)
        .select(
            F.concat(
                F.lit("Database Layer ("), t.cast("string"), F.lit(" tables, "), n.cast("string"), F.lit(" queries)")
            ).alias("name"),
            F.lit("Database").alias("component_type"),
            ladder([(n > 100, "Very High"), (n > 50, "High")], "Medium").alias("level"),
            t.alias("n_deps"),
            F.when(t > 20, "High").otherwise("Medium").alias("risk_level"),
            F.greatest(F.lit(5), F.floor(n / 10) + F.floor(t / 5)).alias("effort_days"),
            F.lit("API-first data access with ORM/repository pattern").alias("approach"),
            F.lit(2).alias("priority"),
        )
    )


def integration_component(n_flows: DataFrame) -> DataFrame:
    """``n_flows``: one row with the number of flows."""
    n = F.col("n_flows")
    return n_flows.filter(n > 0).select(
        F.concat(F.lit("Integration Layer ("), n.cast("string"), F.lit(" integration flows)")).alias("name"),
        F.lit("Integration").alias("component_type"),
        ladder([(n > 50, "Very High"), (n > 20, "High")], "Medium").alias("level"),
        n.alias("n_deps"),
        F.lit("High").alias("risk_level"),
        F.greatest(F.lit(10), F.floor(n / 2)).alias("effort_days"),
        F.lit("API gateway with microservices architecture").alias("approach"),
        F.lit(1).alias("priority"),
    )


def strategy_totals(scored: DataFrame) -> DataFrame:
    effort = F.col("total_effort")
    months = F.greatest(F.lit(6), F.floor(effort / 160))
    return (
        scored.agg(F.coalesce(F.sum("effort_hours"), F.lit(0)).cast("long").alias("total_effort"))
        .withColumn("months", months)
        .withColumn(
            "team_size",
            F.greatest(F.lit(2), F.least(F.lit(8), F.floor(effort / (F.col("months") * 160)))),
        )
    )


def component_statistics(scored: DataFrame) -> DataFrame:
    c = F.col("criticality")
    return scored.agg(
        F.count("*").alias("n_components"),
        F.round(F.coalesce(F.avg("complexity_score"), F.lit(0.0)), 4).alias("avg_complexity"),
        F.coalesce(F.sum("effort_hours"), F.lit(0)).cast("long").alias("total_effort"),
        *[F.count_if(c == x).alias(f"n_{x}") for x in ("critical", "high", "medium", "low")],
    )


# ---- flows --------------------------------------------------------------------------


def flow_statistics(call_flows: DataFrame, page_flows: DataFrame) -> DataFrame:
    """Totals over matched calls and page targets, weighted by ``n_flows``."""
    calls = call_flows.select(
        F.lit("Angular→REST").alias("pair"),
        (F.col("n_calls") * F.col("n_exact")).alias("sure"),
        (F.col("n_calls") * F.col("n_similar")).alias("likely"),
        F.lit(0).cast("long").alias("loose"),
    )
    f = F.col("n_flows")
    c = F.col("confidence")
    pages = page_flows.select(
        F.lit("JSP→Struts").alias("pair"),
        F.when(c == 1.0, f).otherwise(0).alias("sure"),
        F.lit(0).cast("long").alias("likely"),
        F.when(c < 1.0, f).otherwise(0).alias("loose"),
    )
    per = (
        calls.unionByName(pages)
        .groupBy("pair")
        .agg(
            F.sum(F.col("sure") + F.col("likely") + F.col("loose")).alias("total_flows"),
            F.sum(F.col("sure") + F.col("likely")).alias("high_confidence_flows"),
        )
    )
    old = F.sum(F.when(F.col("pair") == "JSP→Struts", F.col("total_flows")).otherwise(0)).over(_whole(per))
    new = F.sum(F.when(F.col("pair") == "Angular→REST", F.col("total_flows")).otherwise(0)).over(_whole(per))
    return per.withColumn(
        "migration_complexity", ladder([(old > new * 2, "High"), (new > old, "Low")], "Medium")
    )


def chain_statistics(counts: DataFrame) -> DataFrame:
    """``counts``: start, n_chains, total_length, from ``graph.chain_counts``.
    Roots, length per root, chains over five; chains of three calls have four
    nodes at most, so there are none of those."""
    found = counts.filter(F.col("n_chains") > 0)
    return found.agg(
        F.count("*").alias("n_roots"),
        F.round(F.sum("total_length") / F.greatest(F.count("*"), F.lit(1)), 4).alias("avg_length"),
        F.lit(0).cast("long").alias("deep_chains"),
    )


def call_graph(calls: DataFrame) -> DataFrame:
    """(caller, callee, call_count, first_line, last_line, is_recursive).

    ``calls``: caller, callee, line. Which lines, in full, is ``call_lines``.
    """
    return (
        calls.groupBy("caller", "callee")
        .agg(
            F.count("*").alias("call_count"),
            F.min("line").alias("first_line"),
            F.max("line").alias("last_line"),
        )
        .withColumn("is_recursive", F.col("caller") == F.col("callee"))
    )


def call_lines(calls: DataFrame) -> DataFrame:
    return calls.groupBy("caller", "callee", "line").agg(F.count("*").alias("n"))


def search_index(entities: DataFrame, rules: DataFrame) -> DataFrame:
    e = entities.select(
        F.concat(F.lit("e:"), F.col("entity_id")).alias("doc_key"),
        F.col("name").alias("title"),
        F.concat_ws(" ", "type", "name", "file_path").alias("content"),
        F.lit("entity").alias("category"),
        "module_path",
        F.size(F.split("module_path", r"\.")).alias("hierarchy_depth"),
    )
    r = rules.select(
        F.concat(F.lit("r:"), F.col("rule_id")).alias("doc_key"),
        F.col("rule_id").alias("title"),
        F.col("description").alias("content"),
        F.lit("business_rule").alias("category"),
        "module_path",
        F.size(F.split("module_path", r"\.")).alias("hierarchy_depth"),
    )
    return e.unionByName(r)


def api_index(entities: DataFrame) -> DataFrame:
    """Functions, classes, methods and interfaces by file, then type and name.

    Sorted rows; position inside the file comes from the sort, so no file's
    list is ever gathered.
    """
    return (
        entities.filter(F.col("type").isin("function", "class", "method", "interface"))
        .select("file_path", "type", "name", "line_number", "complexity")
        .orderBy("file_path", "type", "name", "line_number")
    )


# ---- logs and health --------------------------------------------------------------------


def _bands(errors: Column, warnings: Column) -> dict:
    return {
        "error_band": ladder([(errors > 10, "high"), (errors > 0, "some")], "none"),
        "warning_band": F.when(warnings > 20, "high").otherwise("normal"),
    }


def log_health(logs: DataFrame, last: int = 100) -> DataFrame:
    """Error and warning counts among the newest ``last`` lines."""
    level = F.col("level")
    return (
        logs.orderBy(F.desc("ts"), F.desc("log_id"))
        .limit(last)
        .agg(F.count_if(level == "ERROR").alias("n_errors"), F.count_if(level == "WARNING").alias("n_warnings"))
        .withColumns(_bands(F.col("n_errors"), F.col("n_warnings")))
    )


def health_rollup(checks: DataFrame, by: str) -> DataFrame:
    """Worst status per group: unhealthy over degraded over healthy."""
    s = F.col("status")
    rank = F.when(s.contains("unhealthy"), 2).when(s.contains("degraded"), 1).otherwise(0)
    worst = F.max(rank)
    return checks.groupBy(by).agg(
        F.when(worst == 2, "unhealthy").when(worst == 1, "degraded").otherwise("healthy").alias("overall")
    )


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        one = df.agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("table_name"), "n_rows")
        out = one if out is None else out.unionByName(one)
    return out


def insight_totals(entities: DataFrame, placed_rules: DataFrame) -> DataFrame:
    text = F.lower(F.to_json(F.struct(*entities.columns)))
    return entities.agg(
        F.count("*").alias("total_components"),
        F.count_if(text.contains("critical")).alias("critical_components"),
    ).withColumn("total_business_rules", placed_rules.agg(F.count("*")).scalar())


# Technologies counted as legacy.
LEGACY_TECH = ("jsp", "struts", "legacy", "deprecated")


def impact_totals(impacts: DataFrame, technologies: DataFrame) -> DataFrame:
    legacy = technologies.filter(F.lower("technology").isin(*LEGACY_TECH)).agg(F.count("*")).scalar()
    return impacts.agg(
        F.count_if(F.col("risk_level").isin("High", "Critical")).alias("high_impact_components")
    ).withColumn("legacy_technologies", legacy)
