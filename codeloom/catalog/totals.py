"""Statistics queries over entities, statements and rules (E6-E14, E23, E26,
E28, E35, F8, I1)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog.extraction import statements
from codeloom.catalog.registry import query
from codeloom.catalog.scores import components
from codeloom.operators import metrics as M
from codeloom.operators.extract_sql import describe_statements

c = F.col


def _typed_edges(spark, d):
    e = B.part_edges(spark, d).distinct()
    return e.withColumn("relationship_type", F.when(c("source") % 3 == 0, "inherits").otherwise("calls"))


@query("E6", "SELECT 'total_entities' AS metric, '' AS key, count(*)::DOUBLE AS value FROM ent UNION ALL SELECT 'total_relationships', '', count(*)::DOUBLE FROM edges UNION ALL SELECT 'total_business_rules', '', count(*)::DOUBLE FROM rules "
             "UNION ALL SELECT 'modules_count', '', count(DISTINCT module_path)::DOUBLE FROM entm UNION ALL SELECT 'avg_complexity', '', round(avg(nullif(complexity, 0)), 6) FROM ent "
             "UNION ALL SELECT 'entities_by_type', type, count(*)::DOUBLE FROM ent GROUP BY type UNION ALL SELECT 'relationships_by_type', CASE WHEN source % 3 = 0 THEN 'inherits' ELSE 'calls' END, count(*)::DOUBLE FROM edges GROUP BY 2")
def graph_statistics(spark, d):
    return M.graph_statistics(B.entities_in_modules(spark, d), _typed_edges(spark, d), B.rules(spark, d))


@query("E7", "WITH r AS (SELECT entity_id, count(*) AS n FROM rules GROUP BY 1), t AS (SELECT module_path, type, count(*) AS n_entities, sum(coalesce(n, 0)) AS n_rules FROM entm LEFT JOIN r USING (entity_id) GROUP BY 1, 2) "
             "SELECT module_path, type, n_entities, CAST(sum(n_entities) OVER (PARTITION BY module_path) AS BIGINT) AS module_entities, CAST(sum(n_rules) OVER (PARTITION BY module_path) AS BIGINT) AS module_rules FROM t")
def module_structure(spark, d):
    return M.module_structure(B.entities_in_modules(spark, d), B.rules(spark, d))


@query("E8", "SELECT 'total' AS metric, '' AS key, count(*) AS n FROM stmts UNION ALL SELECT 'prepared', '', count(*) FROM stmts WHERE is_prepared UNION ALL SELECT 'parameterized', '', count(*) FROM stmts WHERE n_parameters > 0 "
             "UNION ALL SELECT 'complex', '', count(*) FROM stmts WHERE length(query_text) > 200 OR contains(upper(query_text), 'JOIN') UNION ALL SELECT 'by_type', query_type, count(*) FROM stmts GROUP BY query_type "
             "UNION ALL SELECT 'by_table', t, count(*) FROM (SELECT unnest(tables) AS t FROM stmts) GROUP BY t")
def statement_statistics(spark, d):
    return M.statement_statistics(statements(spark, d))


@query("E8_top", "SELECT t AS table_name, count(*) AS n FROM (SELECT unnest(tables) AS t FROM stmts) GROUP BY 1 ORDER BY n DESC, table_name LIMIT 10")
def top_tables(spark, d):
    return M.top_tables(statements(spark, d))


@query("E9", "SELECT file_path, count(*) AS n_queries, (SELECT count(DISTINCT t) FROM (SELECT unnest(tables) AS t, file_path AS f FROM stmts) WHERE f = s.file_path) AS n_tables FROM stmts s GROUP BY 1")
def file_statements(spark, d):
    return M.file_statement_counts(statements(spark, d))


@query("E10", "SELECT DISTINCT 't' || (p_partkey % 7) AS table_name, unnest([lower(replace(p_brand, '#', '')), 'size']) AS column_name FROM part")
def inferred(spark, d):
    """Over the extracted statements, whose names carry underscores and so are
    no plain columns, and over one more statement per part."""
    text = F.concat(
        F.lit("SELECT t."), F.replace("p_brand", F.lit("#"), F.lit("")), F.lit(", size AS s FROM t"),
        (c("p_partkey") % 7).cast("string"),
    )
    more = describe_statements(B.table(spark, d, "part").select(text.alias("query_text")))
    cols = ["query_text", "tables"]
    return M.inferred_schema(statements(spark, d).select(*cols).unionByName(more.select(*cols)))


@query("E11", "SELECT count(*) FILTER (WHERE type = 'class') AS classes, count(*) FILTER (WHERE type = 'function') AS functions, 0::BIGINT AS methods, count(*) FILTER (WHERE type = 'interface') AS interfaces, 0::BIGINT AS enums, 0::BIGINT AS variables FROM ent")
def kind_counts(spark, d):
    return M.kind_counts(B.entities(spark, d))


@query("E12", "SELECT category, count(*) AS n_rules, round(avg(confidence_score), 6) AS avg_confidence, count(*) FILTER (WHERE confidence_score >= 0.8) AS high_confidence FROM doc_rules GROUP BY 1")
def rule_categories(spark, d):
    return M.rule_categories(B.document_rules(spark, d))


@query("E13", "SELECT event_type AS type, count(*) AS n, round(count(*) / (SELECT count(*) FROM events) * 100, 1) AS pct, 'Mixed programming paradigms' AS patterns FROM events GROUP BY 1")
def event_types(spark, d):
    return M.type_distribution(B.table(spark, d, "events").select(c("event_type").alias("type")))


@query("E13_entities", "SELECT type, count(*) AS n, round(count(*) / (SELECT count(*) FROM ent) * 100, 1) AS pct, 'Interface-driven architecture' AS patterns FROM ent GROUP BY 1")
def entity_types(spark, d):
    return M.type_distribution(B.entities(spark, d))


@query("E14", "SELECT directory, count(*) AS n FROM (SELECT split_part(u, '/', 1) AS directory FROM (SELECT regexp_replace(url, '^https?://', '') AS u FROM pages) WHERE contains(u, '/') "
              "UNION ALL SELECT split_part(u, '/', 1) || '/' || split_part(u, '/', 2) FROM (SELECT regexp_replace(url, '^https?://', '') AS u FROM pages) WHERE len(string_split(u, '/')) > 2) GROUP BY 1 ORDER BY n DESC, directory LIMIT 5")
def directories(spark, d):
    return M.top_directories(B.table(spark, d, "pages").select(F.regexp_replace("url", "^https?://", "").alias("file_path")))


@query("E14_names", "SELECT pattern, count(*) AS n_names FROM (SELECT unnest([CASE WHEN contains(n, 'Service') THEN 'Service layer pattern detected' END, CASE WHEN contains(n, 'Dao') THEN 'Repository/DAO pattern' END, "
                    "CASE WHEN contains(n, 'Factory') THEN 'Factory pattern usage' END]) AS pattern FROM (SELECT replace(replace(replace(name, 'red', 'Service'), 'bolt', 'Dao'), 'gear', 'Factory') AS n FROM ent)) WHERE pattern IS NOT NULL GROUP BY 1")
def naming(spark, d):
    name = c("name")
    for a, b in (("red", "Service"), ("bolt", "Dao"), ("gear", "Factory")):
        name = F.replace(name, F.lit(a), F.lit(b))
    return M.naming_patterns(B.entities(spark, d).select(name.alias("name")))


@query("E23", "SELECT band, count(*) AS n_rules, count(*) FILTER (WHERE integration_points IS NOT NULL) AS n_integration, round(count(*) / (SELECT count(*) FROM doc_rules) * 100, 1) AS pct FROM "
              "(SELECT *, CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.6 THEN 'medium' ELSE 'low' END AS band FROM doc_rules) GROUP BY 1")
def confidence(spark, d):
    return M.confidence_distribution(B.document_rules(spark, d))


@query("E23_capabilities", "SELECT class_context, business_process, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY class_context ORDER BY business_process) AS rank FROM "
                           "(SELECT DISTINCT 'C' || (k % 37) AS class_context, business_process FROM rules WHERE business_process IS NOT NULL)) WHERE rank <= 5")
def capabilities(spark, d):
    r = B.rules(spark, d).withColumn("class_context", F.concat(F.lit("C"), (c("k") % 37).cast("string")))
    return M.class_capabilities(r)


@query("E26", "SELECT 'e:' || entity_id AS doc_key, name AS title, type || ' ' || name || ' ' || file_path AS content, 'entity' AS category, module_path, CAST(3 AS INTEGER) AS hierarchy_depth FROM entm "
              "UNION ALL SELECT 'r:' || rule_id, rule_id, description, 'business_rule', 'rules.' || category, 2 FROM rules")
def search_index(spark, d):
    r = B.rules(spark, d).withColumn("module_path", F.concat(F.lit("rules."), c("category")))
    return M.search_index(B.entities_in_modules(spark, d), r)


@query("E28", "SELECT file_path, type, name, line_number, complexity FROM ent WHERE type IN ('function', 'class', 'method', 'interface')")
def api_index(spark, d):
    return M.api_index(B.entities(spark, d))


@query("E35", "SELECT rule_id, business_process AS name, category FROM rules WHERE business_process IS NOT NULL ORDER BY rule_id LIMIT 10")
def processes(spark, d):
    return M.business_processes(B.rules(spark, d))


DB_SQL = ("SELECT 'Database Layer (' || t || ' tables, ' || n || ' queries)' AS name, 'Database' AS component_type, CASE WHEN n > 100 THEN 'Very High' WHEN n > 50 THEN 'High' ELSE 'Medium' END AS level, t AS n_deps, "
          "CASE WHEN t > 20 THEN 'High' ELSE 'Medium' END AS risk_level, greatest(5, n // 10 + t // 5) AS effort_days, 'API-first data access with ORM/repository pattern' AS approach, CAST(2 AS INTEGER) AS priority "
          "FROM (SELECT count(*) AS n, (SELECT count(DISTINCT t) FROM (SELECT unnest(tables) AS t FROM stmts)) AS t FROM stmts) WHERE n > 0")


@query("F8", DB_SQL)
def database_layer(spark, d):
    return M.database_component(statements(spark, d))


@query("I1", f"SELECT name, component_type, level, risk_level, priority FROM comp UNION ALL SELECT name, component_type, level, risk_level, priority FROM ({DB_SQL}) "
             "UNION ALL SELECT 'Integration Layer (' || n || ' integration flows)', 'Integration', CASE WHEN n > 50 THEN 'Very High' WHEN n > 20 THEN 'High' ELSE 'Medium' END, 'High', 1 FROM (SELECT count(*) AS n FROM edges)")
def all_components(spark, d):
    cols = ["name", "component_type", "level", "risk_level", "priority"]
    flows = B.part_edges(spark, d).distinct().agg(F.count("*").alias("n_flows"))
    return (
        components(spark, d).select(*cols)
        .unionByName(M.database_component(statements(spark, d)).select(*cols))
        .unionByName(M.integration_component(flows).select(*cols))
    )
