"""Pages, top lists, phases, report rows and set queries (H, I)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog import extraction
from codeloom.catalog import texts as T
from codeloom.catalog.jobs import TREND_SQL, _trend
from codeloom.catalog.registry import query
from codeloom.catalog.scores import components, scored
from codeloom.functions import text as X
from codeloom.functions.scoring import GENERAL_RISKS
from codeloom.operators import ranking as K
from codeloom.operators import extract_web as W
from codeloom.operators import reports as R

c = F.col


@query("H1", "SELECT job_id, status, strftime(created_at, '%Y-%m-%d') AS created FROM jobs ORDER BY created_at DESC, k DESC LIMIT 25 OFFSET 50")
def newest_jobs(spark, d):
    j = B.jobs(spark, d, counts=False)
    top = K.page(j, [F.desc("created_at"), F.desc("k")], 50, 25)
    return top.select("job_id", "status", F.date_format("created_at", "yyyy-MM-dd").alias("created"))


@query("H2", "SELECT c_custkey, c_name FROM customer ORDER BY c_name, c_custkey LIMIT 20 OFFSET 40")
def repository_page(spark, d):
    return K.page(B.table(spark, d, "customer").select("c_custkey", "c_name"), [c("c_name"), c("c_custkey")], 40, 20)


@query("H3", "SELECT repository_path, job_id AS last_job, CASE WHEN status = 'completed' THEN 'incremental' ELSE 'full' END AS mode FROM "
             "(SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY repository_path ORDER BY created_at DESC, job_id DESC) = 1)")
def sync_modes(spark, d):
    return K.sync_decisions(B.jobs(spark, d, counts=False))


@query("H4", "SELECT module_path, count(*) AS n FROM (SELECT regexp_extract(module_path, '^[^.]+\\.[^.]+') AS module_path FROM entm) GROUP BY 1 ORDER BY n DESC, module_path LIMIT 10")
def top_modules(spark, d):
    e = B.entities_in_modules(spark, d)
    return (
        e.groupBy(F.regexp_extract("module_path", r"^[^.]+\.[^.]+", 0).alias("module_path"))
        .agg(F.count("*").alias("n"))
        .orderBy(F.desc("n"), "module_path")
        .limit(10)
    )


@query("H5", "SELECT k, name, CASE WHEN lower(name) = 'red_b' THEN 0 WHEN starts_with(lower(name), 'red_b') THEN 1 WHEN contains(lower(name), 'red_b') THEN 2 ELSE 3 END AS relevance "
             "FROM ent WHERE contains(lower(name), 'red_b') OR contains(lower(docstring), 'red_b')")
def search(spark, d):
    return K.search_entities(B.entities(spark, d), "Red_B").select("k", "name", "relevance")


@query("H5_docs", "SELECT k, relevance FROM (SELECT *, CASE WHEN starts_with(name, 'small') THEN 1 WHEN contains(name, 'small') THEN 2 ELSE 3 END AS relevance FROM ent "
                  "WHERE (contains(name, 'small') OR contains(docstring, 'small')) AND type IN ('class', 'function'))")
def search_docs(spark, d):
    return K.search_entities(B.entities(spark, d), "small", ["class", "function"]).select("k", "relevance")


@query("H6", "SELECT k, p AS position, CASE WHEN p <= one THEN 1 WHEN p <= greatest(one + 1, 2 * n // 3) THEN 2 ELSE 3 END AS phase FROM "
             "(SELECT k, row_number() OVER (ORDER BY priority, (risk_level <> 'Critical'), k) AS p, (SELECT count(*) FROM comp) AS n, greatest(1, (SELECT count(*) FROM comp) // 3) AS one FROM comp)")
def roadmap(spark, d):
    bucket = F.floor(c("k") / 65536)
    return K.roadmap(components(spark, d), bucket, [c("k")]).select("k", "position", "phase")


PLACED_SQL = ("(SELECT * FROM (SELECT k, effort_hours, 1 AS phase FROM ecomp WHERE criticality IN ('low', 'medium') AND complexity_score <= 5.0 ORDER BY criticality_rank DESC, complexity_score DESC, k LIMIT 10) "
              "UNION ALL SELECT * FROM (SELECT k, effort_hours, 2 AS phase FROM ecomp WHERE criticality = 'high' AND complexity_score <= 7.0 ORDER BY criticality_rank DESC, complexity_score DESC, k LIMIT 15) "
              "UNION ALL SELECT k, effort_hours, 3 AS phase FROM ecomp WHERE criticality = 'critical' OR complexity_score > 7.0)")


def _order():
    return [F.desc("criticality_rank"), F.desc("complexity_score"), c("k")]


@query("H7", f"SELECT phase, k FROM {PLACED_SQL}")
def phase_members(spark, d):
    return K.phase_quotas(scored(spark, d), _order()).select("phase", "k")


@query("H7_totals", f"SELECT v.phase, v.name, v.weeks, count(p.k) AS n_components, CAST(coalesce(sum(p.effort_hours), 0) + max(fixed) AS BIGINT) AS effort_hours FROM "
                    f"(VALUES (1, 'Foundation & Quick Wins', 8, 0), (2, 'Core Business Logic Migration', 12, 0), (3, 'Complex Systems & Integrations', 16, 0), (4, 'Optimization & Enhancement', 6, 480)) "
                    f"v(phase, name, weeks, fixed) LEFT JOIN {PLACED_SQL} p ON p.phase = v.phase GROUP BY 1, 2, 3")
def phase_totals(spark, d):
    return K.phase_totals(K.phase_quotas(scored(spark, d), _order()))


@query("H8", "SELECT k, criticality, complexity_score FROM ecomp ORDER BY criticality_rank DESC, complexity_score DESC, k")
def by_criticality(spark, d):
    return scored(spark, d).orderBy(*_order()).select("k", "criticality", "complexity_score")


@query("H10", "SELECT rule_id, category, rank() OVER (PARTITION BY category ORDER BY confidence_score DESC) AS category_rank, rank() OVER (ORDER BY confidence_score DESC) AS overall_rank FROM doc_rules")
def rule_ranks(spark, d):
    r = B.document_rules(spark, d)
    return K.ranks_by_value(r, "category", "confidence_score", "rule_id").select("rule_id", "category", "category_rank", "overall_rank")


LAYER_SQL = "CASE WHEN regexp_matches(file_path, '\\.js|\\.ts|\\.html|\\.jsp') THEN 'frontend' WHEN regexp_matches(file_path, '\\.java|\\.py') THEN 'backend' END"


@query("H11", f"SELECT layer, rank, k FROM (SELECT k, layer, CAST(row_number() OVER (PARTITION BY layer ORDER BY k) AS INTEGER) AS rank FROM (SELECT k, {LAYER_SQL} AS layer FROM comp) WHERE layer IS NOT NULL) WHERE rank <= 15")
def layer_caps(spark, d):
    return R.layer_components(components(spark, d), [c("k")]).select("layer", "rank", "k")


@query("H11_risk", "SELECT risk_level, rank, substr(risk_level, 1, 1) || 'R' || (rank - 1) || '[\"' || name || '\\n(' || level || ' complexity)\"]:::' || lower(risk_level) AS line FROM "
                   "(SELECT *, CAST(row_number() OVER (PARTITION BY risk_level ORDER BY k) AS INTEGER) AS rank FROM comp) WHERE rank <= 8")
def risk_caps(spark, d):
    return R.risk_nodes(components(spark, d), [c("k")]).select("risk_level", "rank", "line")


@query("H11_classes", "SELECT name, CAST(pos AS INTEGER) AS pos, CASE WHEN pos < n_methods THEN '+m' || pos || '()' ELSE '-a' || (pos - n_methods) END AS line FROM "
                      "(SELECT name, n_methods, unnest(range(n_methods + n_props)) AS pos FROM (SELECT * FROM ent WHERE type = 'class' ORDER BY k LIMIT 30))")
def class_box(spark, d):
    classes = B.entities(spark, d).filter(c("type") == "class")
    return R.class_members(classes, [c("k")]).select("name", "pos", "line")


@query("H11_flow", "SELECT step, name, lag(name) OVER (ORDER BY step) AS previous FROM (SELECT name, CAST(row_number() OVER (ORDER BY k) - 1 AS INTEGER) AS step FROM ent WHERE type = 'function' ORDER BY k LIMIT 20)")
def flow_chain(spark, d):
    functions = B.entities(spark, d).filter(c("type") == "function")
    return K.flow_steps(functions, [c("k")]).select("step", "name", "previous")


@query("H12", f"SELECT layer, string_agg(substr(regexp_replace(name, '[^\\w]', '_', 'g'), 1, 20) || '[\"' || CASE level WHEN 'Very High' THEN '🔥' WHEN 'High' THEN '⚠️' WHEN 'Medium' THEN '⚡' ELSE '✅' END || ' ' || name || '\\n(' || type || ')\"]:::' || layer, chr(10) ORDER BY k) AS content "
              f"FROM (SELECT *, row_number() OVER (PARTITION BY layer ORDER BY k) AS rank FROM (SELECT *, {LAYER_SQL} AS layer FROM comp) WHERE layer IS NOT NULL) WHERE rank <= 15 GROUP BY 1")
def layer_text(spark, d):
    return R.layer_diagram(components(spark, d), [c("k")])


@query("H12_technologies", "SELECT technology, layer, n, technology || '[' || n || ' ' || what || ']:::' || layer AS line FROM ("
                           "SELECT 'rest_endpoints' AS technology, 'api' AS layer, 'endpoints' AS what, 2 * count(*) AS n FROM restp UNION ALL "
                           "SELECT 'struts_actions', 'backend', 'actions', (SELECT count(*) FROM actp) + 2 * count(*) FROM confp UNION ALL "
                           "SELECT 'jsp_components', 'frontend', 'components', 4 * count(*) FROM jspp)")
def technology_nodes(spark, d):
    """Counts of what the extractors found, by technology."""
    kinds = {
        "rest_endpoints": (W.rest_endpoints(T.rest_files(spark, d)),),
        "struts_actions": (extraction.annotated_actions(spark, d), extraction.xml_actions(spark, d)),
        "jsp_components": (W.page_components(T.page_files(spark, d)),),
    }
    rows = [t.select(F.lit(kind).alias("technology")) for kind, tables in kinds.items() for t in tables]
    return R.technology_map(reduce(DataFrame.unionByName, rows))


@query("H12_edges", "SELECT source || CASE WHEN conf > 0.7 THEN ' ==> ' WHEN conf > 0.4 THEN ' --> ' ELSE ' -.-> ' END || target AS line FROM "
                    "(SELECT 'p' || source AS source, 'p' || target AS target, (source % 10) / 10 AS conf FROM edges)")
def edge_lines(spark, d):
    e = B.part_edges(spark, d).distinct()
    node = lambda x: F.concat(F.lit("p"), c(x).cast("string"))
    return e.select(R.edge_line(node("source"), node("target"), (c("source") % 10) / 10).alias("line"))


@query("H13", f"SELECT date, substr(date, 6, 5) AS label, successful, rules FROM ({TREND_SQL}) ORDER BY date DESC LIMIT 7")
def last_week(spark, d):
    return K.last_days(_trend(spark, d))


@query("H14", "SELECT dependency FROM (SELECT DISTINCT 'dep' || unnest(range(n_deps_list)) AS dependency FROM ent) ORDER BY dependency LIMIT 20")
def first_dependencies(spark, d):
    e = B.entities(spark, d)
    return e.select(F.explode("dependencies").alias("dependency")).distinct().orderBy("dependency").limit(20)


@query("H14_classes", "SELECT name, file_path FROM ent WHERE type = 'class' ORDER BY k LIMIT 20")
def first_classes(spark, d):
    return B.entities(spark, d).filter(c("type") == "class").orderBy("k").limit(20).select("name", "file_path")


@query("H15", "SELECT criticality, CAST(rank AS INTEGER) AS rank, '| `' || name || '` | ' || type || ' | ' || printf('%.1f', complexity_score) || '/10 | ' || effort_hours || ' | ' || approach || ' |' AS row FROM "
              "(SELECT *, row_number() OVER (PARTITION BY criticality ORDER BY complexity_score DESC, k) AS rank FROM ecomp WHERE criticality IN ('critical', 'high')) WHERE rank <= 10")
def report_rows(spark, d):
    return R.component_rows(scored(spark, d), [F.desc("complexity_score"), c("k")])


@query("H16", "SELECT k AS seq, '- ' || type || ': ' || name || ' in ' || file_path AS line FROM ent ORDER BY k LIMIT 25")
def one_liners(spark, d):
    return R.entity_lines(B.entities(spark, d), [c("k")])


# ---- sets ---------------------------------------------------------------------------


@query("I2", "SELECT DISTINCT 'dep' || unnest(range(n_deps_list)) AS dependency FROM ent")
def dependency_set(spark, d):
    return B.entities(spark, d).select(F.explode("dependencies").alias("dependency")).distinct()


@query("I3", "SELECT risk FROM (SELECT DISTINCT unnest(risks) AS risk FROM ecomp WHERE criticality = 'critical' UNION SELECT unnest(["
             + ", ".join(f"'{r}'" for r in GENERAL_RISKS) + "])) ORDER BY risk LIMIT 10")
def critical_risks(spark, d):
    return K.critical_risks(scored(spark, d), GENERAL_RISKS)


STOP_SQL = "[" + ", ".join(f"'{w}'" for w in X.STOP_WORDS) + "]"


@query("I5", "SELECT doc_id, array_to_string(list_sort(list_filter(list_distinct(list_intersect(string_split_regex(trim(lower(text), ' \\t\\n\\r'), '\\s+'), "
             "string_split('the old small of a part and red or service', ' '))), lambda w: w <> '' AND NOT list_contains(" + STOP_SQL + ", w))), ',') AS shared FROM documents")
def shared_words(spark, d):
    probe = F.lit("The old small of a part AND red or service")
    return B.table(spark, d, "documents").select(
        "doc_id", F.array_join(F.array_sort(X.shared_words(c("text"), probe)), ",").alias("shared")
    )


@query("I6", "SELECT doc_id FROM documents EXCEPT ALL SELECT doc_id FROM labels")
def unlabelled(spark, d):
    docs = B.table(spark, d, "documents").select("doc_id")
    return docs.exceptAll(B.table(spark, d, "labels").select("doc_id"))
