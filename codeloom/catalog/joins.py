"""Resolution and matching queries (D, E15, E22, E23, F9, F16, F17)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog import texts as T
from codeloom.catalog.registry import binding, query
from codeloom.functions.text import STOP_WORDS
from codeloom.operators import extract_web, graph
from codeloom.operators import metrics as M
from codeloom.operators import resolve as R
from codeloom.operators.skew import skew_lookup

W = extract_web
c = F.col


@query("D1", "SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'module:' || c_nationkey WHEN c_custkey % 3 = 1 THEN 'N' || c_nationkey END AS parent_id FROM customer")
def parents(spark, d):
    """Customers as methods of their nation's class, plain functions of its
    module, or methods of a class that does not exist."""
    n = B.table(spark, d, "nation").select(
        F.concat(F.lit("N"), c("n_nationkey").cast("string")).alias("entity_id"),
        c("n_nationkey").cast("string").alias("file_path"),
        F.lit("class").alias("type"),
        F.concat(F.lit("cls"), c("n_nationkey").cast("string")).alias("name"),
        F.lit(None).cast("string").alias("class_name"),
        c("n_nationkey").cast("long").alias("seq"),
        F.concat(F.lit("module:"), c("n_nationkey").cast("string")).alias("module_id"),
    )
    k = c("c_custkey")
    cls = F.when(k % 3 == 1, F.concat(F.lit("cls"), c("c_nationkey").cast("string"))).when(k % 3 == 2, "nowhere")
    m = B.table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("entity_id"),
        c("c_nationkey").cast("string").alias("file_path"),
        F.lit("method").alias("type"),
        c("c_name").alias("name"),
        cls.alias("class_name"),
        k.alias("seq"),
        F.concat(F.lit("module:"), c("c_nationkey").cast("string")).alias("module_id"),
    )
    return R.parent_ids(n.unionByName(m)).filter(c("type") == "method").select(
        F.substring("entity_id", 2, 20).cast("long").alias("c_custkey"), "parent_id"
    )


def _targets(spark, d):
    return B.entities(spark, d).select("entity_id", "type", "name", "seq")


def _refs(spark, d):
    """Every part refers to the name of the part five before it (loosely)."""
    return B.table(spark, d, "part").select(
        F.concat(F.lit("e"), c("p_partkey").cast("string")).alias("source_id"),
        F.concat(F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_"), F.floor(c("p_partkey") / 8).cast("string")).alias("ref"),
    )


binding("refs", "SELECT 'e' || p_partkey AS source_id, replace(p_name, ' ', '_') || '_' || (p_partkey // 8) AS ref FROM part")


def _first_match_sql(kinds):
    return (f"SELECT source_id, ref, arg_min(entity_id, k) AS target_id FROM refs JOIN ent ON name = ref AND type IN ({kinds}) GROUP BY 1, 2")


@query("D2", _first_match_sql("'class', 'interface'"))
def base_classes(spark, d):
    return R.base_class_edges(_refs(spark, d), _targets(spark, d))


@query("D3", _first_match_sql("'method', 'function'"))
def call_targets(spark, d):
    called = _refs(spark, d).withColumn("ref", F.concat("ref", F.lit("(a, b)")))
    return R.call_edges(called, _targets(spark, d))


@query("D4", "SELECT source_id, ref, arg_min(entity_id, k) AS target_id FROM (SELECT 's' || s_suppkey AS source_id, CASE s_suppkey % 3 WHEN 0 THEN 'bolt_' || s_suppkey WHEN 1 THEN 'red' ELSE 'lib/small_ring_' || (s_suppkey % 9) || '/x' END AS ref FROM supplier) "
              "JOIN ent ON contains(ref, name) OR contains(name, ref) GROUP BY 1, 2")
def loose_dependencies(spark, d):
    k = c("s_suppkey")
    s = k.cast("string")
    ref = (
        F.when(k % 3 == 0, F.concat(F.lit("bolt_"), s)).when(k % 3 == 1, "red")
        .otherwise(F.concat(F.lit("lib/small_ring_"), (k % 9).cast("string"), F.lit("/x")))
    )
    deps = B.table(spark, d, "supplier").select(F.concat(F.lit("s"), s).alias("source_id"), ref.alias("ref"))
    return R.dependency_edges(deps, _targets(spark, d))


# ---- flows --------------------------------------------------------------------

binding(
    "calls",
    "SELECT p_partkey AS k, 'GET' AS method, '/api/p' || (p_partkey % 20) || '/:id' AS url FROM part "
    "UNION ALL SELECT p_partkey, 'POST', '/legacy/p' || (p_partkey % 20) FROM part",
)
binding(
    "ends",
    "SELECT p_partkey AS k, 'GET' AS method, '/api/p' || (p_partkey % 20) || '/{id}' AS path, 'find' || p_partkey AS handler FROM part "
    "UNION ALL SELECT p_partkey, 'POST', '/legacy/p' || (p_partkey % 20), 'save' || p_partkey FROM part",
)
NORM = "regexp_replace(trim({x}, '/'), '\\{{[^}}]+\\}}|:\\w+', '*', 'g')"


def _calls(spark, d):
    return W.http_calls(T.typescript_files(spark, d)).select("method", "url")


def _endpoints(spark, d):
    return W.rest_endpoints(T.rest_files(spark, d)).select("method", "path", "handler_function")


MATCHED = (
    "SELECT c.method, c.url, c.norm_url, n_calls, coalesce(e.n, 0)::BIGINT AS n_exact, (s.n - coalesce(e.n, 0))::BIGINT AS n_similar, (n_calls * s.n)::BIGINT AS n_flows, "
    "CASE WHEN e.n > 0 THEN 1.0 ELSE 0.8 END::DOUBLE AS confidence, coalesce(e.h, s.h) AS handler FROM "
    f"(SELECT method, url, {NORM.format(x='url')} AS norm_url, count(*) AS n_calls FROM calls GROUP BY 1, 2, 3) c "
    f"JOIN (SELECT method, {NORM.format(x='path')} AS norm_url, count(*) AS n, min(handler) AS h FROM ends GROUP BY 1, 2) s ON s.method = c.method AND s.norm_url = c.norm_url "
    "LEFT JOIN (SELECT method, path, count(*) AS n, min(handler) AS h FROM ends GROUP BY 1, 2) e ON e.method = c.method AND e.path = c.url"
)


@query("D5", MATCHED)
def call_matches(spark, d):
    return R.call_matches(_calls(spark, d), _endpoints(spark, d))


@query("D5_pages", "WITH t AS (SELECT regexp_replace(url, '^https?://[^/]+', '') AS url FROM pages), e AS (SELECT regexp_replace(url, '[0-9]+', '{id}', 'g') AS path FROM t), "
                   f"n AS (SELECT {NORM.format(x='path')} AS norm_url, count(*) AS n FROM e GROUP BY 1), x AS (SELECT path, count(*) AS n FROM e GROUP BY 1), "
                   f"q AS (SELECT url, {NORM.format(x='url')} AS norm_url, count(*) AS n_calls FROM (SELECT url FROM t UNION ALL SELECT regexp_replace(url, '[0-9]+', ':k', 'g') FROM t) GROUP BY 1, 2) "
                   "SELECT q.url, n_calls, coalesce(x.n, 0)::BIGINT AS n_exact, (n_calls * n.n)::BIGINT AS n_flows FROM q JOIN n ON n.norm_url = q.norm_url LEFT JOIN x ON x.path = q.url")
def page_url_matches(spark, d):
    t = B.table(spark, d, "pages").select(F.regexp_replace("url", "^https?://[^/]+", "").alias("url"))
    get = F.lit("GET").alias("method")
    calls = t.unionByName(t.select(F.regexp_replace("url", "[0-9]+", ":k").alias("url"))).select(get, "url")
    ends = t.select(get, F.regexp_replace("url", "[0-9]+", "{id}").alias("path"), F.lit("page").alias("handler_function"))
    return R.call_matches(calls, ends).select("url", "n_calls", "n_exact", "n_flows")


binding(
    "targets",
    "SELECT target, count(*) AS n_components FROM (SELECT 'save' || (p_partkey % 25) AS target FROM part UNION ALL SELECT 'save' || (p_partkey % 25) FROM part "
    "UNION ALL SELECT 'item/' || p_partkey FROM part UNION ALL SELECT 'go' || (p_partkey % 9) FROM part) GROUP BY 1",
)
binding("acts", "SELECT 'save' || (p_partkey % 25) AS name, '/save' || (p_partkey % 25) AS path, count(*) AS n_actions FROM part GROUP BY 1, 2")
PAGE_FLOWS = (
    "SELECT target, name, path, CASE WHEN target = name THEN 1.0 WHEN contains(name, target) OR contains(target, name) THEN 0.7 ELSE 0.4 END::DOUBLE AS confidence, "
    "n_components, n_actions, n_components * n_actions AS n_flows FROM targets JOIN acts ON target = name OR contains(path, target)"
)


def _page_flows(spark, d):
    pages = W.page_components(T.page_files(spark, d)).select("target_action")
    actions = W.annotated_actions(T.action_files(spark, d)).select("name", "path")
    return R.action_matches(pages, actions)


@query("D6", PAGE_FLOWS)
def action_matches(spark, d):
    return _page_flows(spark, d)


@query("F17", "SELECT page_id, CASE WHEN a = b THEN 1.0 WHEN na = nb THEN 0.8 WHEN contains(a, b) OR contains(b, a) THEN 0.6 ELSE 0.3 END::DOUBLE AS url_score, "
              "CASE WHEN t = '' THEN 0.3 WHEN t = n THEN 1.0 WHEN contains(t, n) OR contains(n, t) THEN 0.7 ELSE 0.4 END::DOUBLE AS action_score FROM "
              f"(SELECT *, {NORM.format(x='a')} AS na, {NORM.format(x='b')} AS nb FROM (SELECT page_id, '/p/' || page_id || '/:x' AS a, "
              "CASE page_id % 4 WHEN 0 THEN '/p/' || page_id || '/:x' WHEN 1 THEN '/p/' || page_id || '/{y}' WHEN 2 THEN '/p/' ELSE '/q' END AS b, "
              "CASE page_id % 4 WHEN 0 THEN '' WHEN 1 THEN 'save' WHEN 2 THEN 'saveAll' ELSE 'drop' END AS t, 'save' AS n FROM pages))")
def match_scores(spark, d):
    k = c("page_id")
    s = k.cast("string")
    a = F.concat(F.lit("/p/"), s, F.lit("/:x"))
    b = F.when(k % 4 == 0, a).when(k % 4 == 1, F.concat(F.lit("/p/"), s, F.lit("/{y}"))).when(k % 4 == 2, "/p/").otherwise("/q")
    t = F.when(k % 4 == 0, "").when(k % 4 == 1, "save").when(k % 4 == 2, "saveAll").otherwise("drop")
    return B.table(spark, d, "pages").select(
        "page_id", R.url_confidence(a, b).alias("url_score"), R.action_confidence(t, F.lit("save")).alias("action_score")
    )


FLOW_STATS = (
    f"WITH f AS (SELECT 'Angular→REST' AS pair, sum(n_flows) AS t, sum(n_flows) AS h FROM ({MATCHED}) UNION ALL "
    f"SELECT 'JSP→Struts', sum(n_flows), sum(CASE WHEN confidence = 1.0 THEN n_flows ELSE 0 END) FROM ({PAGE_FLOWS})) "
)


@query("E15", FLOW_STATS + "SELECT pair, t::BIGINT AS total_flows, h::BIGINT AS high_confidence_flows, CASE WHEN (SELECT t FROM f WHERE pair = 'JSP→Struts') > 2 * (SELECT t FROM f WHERE pair = 'Angular→REST') THEN 'High' "
              "WHEN (SELECT t FROM f WHERE pair = 'Angular→REST') > (SELECT t FROM f WHERE pair = 'JSP→Struts') THEN 'Low' ELSE 'Medium' END AS migration_complexity FROM f")
def flow_statistics(spark, d):
    return M.flow_statistics(R.call_matches(_calls(spark, d), _endpoints(spark, d)), _page_flows(spark, d))


@query("E15_endpoints", f"SELECT path, sum(n * m)::BIGINT AS n_flows FROM (SELECT path, method, {NORM.format(x='path')} AS u, count(*) AS n FROM ends GROUP BY 1, 2, 3) e "
                        f"JOIN (SELECT method, {NORM.format(x='url')} AS u, count(*) AS m FROM calls GROUP BY 1, 2) q ON q.method = e.method AND q.u = e.u GROUP BY 1 ORDER BY n_flows DESC, path LIMIT 10")
def top_endpoints(spark, d):
    return R.endpoint_usage(_calls(spark, d), _endpoints(spark, d)).orderBy(F.desc("n_flows"), "path").limit(10)


@query("F9", FLOW_STATS + "SELECT 'Integration Layer (' || n || ' integration flows)' AS name, CASE WHEN n > 50 THEN 'Very High' WHEN n > 20 THEN 'High' ELSE 'Medium' END AS level, n AS n_deps, 'High' AS risk_level, "
             "greatest(10, n // 2) AS effort_days, CAST(1 AS INTEGER) AS priority FROM (SELECT sum(t)::BIGINT AS n FROM f) WHERE n > 0")
def integration_layer(spark, d):
    total = M.flow_statistics(R.call_matches(_calls(spark, d), _endpoints(spark, d)), _page_flows(spark, d)).agg(
        F.sum("total_flows").alias("n_flows")
    )
    return M.integration_component(total).select("name", "level", "n_deps", "risk_level", "effort_days", "priority")


# ---- rules ------------------------------------------------------------------------

binding(
    "code_refs",
    "SELECT 'R' || s_suppkey AS rule_id, CASE s_suppkey % 4 WHEN 0 THEN 'f' || s_suppkey || '.py:bolt' WHEN 1 THEN 'src/service/m1/f1.java:get_small_ring_4_x' "
    "WHEN 2 THEN '/m' || (s_suppkey % 50) || '/' ELSE 'nowhere:' || s_suppkey END AS ref FROM supplier",
)


@query("D7", "SELECT rule_id, coalesce(a, b) AS entity_id FROM (SELECT rule_id, (SELECT arg_min(entity_id, k) FROM ent WHERE contains(r.ref, ':') AND contains(file_path, split_part(r.ref, ':', 1)) AND "
             "(contains(name, split_part(r.ref, ':', 2)) OR contains(split_part(r.ref, ':', 2), name))) AS a, (SELECT arg_min(entity_id, k) FROM ent WHERE contains(file_path, r.ref)) AS b FROM code_refs r) WHERE coalesce(a, b) IS NOT NULL")
def rule_targets(spark, d):
    k = c("s_suppkey")
    s = k.cast("string")
    ref = (
        F.when(k % 4 == 0, F.concat(F.lit("f"), s, F.lit(".py:bolt")))
        .when(k % 4 == 1, "src/service/m1/f1.java:get_small_ring_4_x")
        .when(k % 4 == 2, F.concat(F.lit("/m"), (k % 50).cast("string"), F.lit("/")))
        .otherwise(F.concat(F.lit("nowhere:"), s))
    )
    rules = B.table(spark, d, "supplier").select(F.concat(F.lit("R"), s).alias("rule_id"), ref.alias("code_reference"))
    return R.rule_entities(rules, B.entities_in_modules(spark, d)).select("rule_id", "entity_id")


LINKS = (
    "WITH w AS (SELECT rule_id, unnest(list_distinct(list_filter(string_split(lower(description), ' '), lambda x: x NOT IN ('of', 'the')))) AS w FROM rules), "
    "g AS (SELECT rule_id, 'entity' AS link_kind, entity_id AS link_key FROM rules UNION ALL SELECT rule_id, 'class', class_context FROM rules WHERE class_context IS NOT NULL "
    "UNION ALL SELECT rule_id, 'category', category FROM rules UNION ALL SELECT a.rule_id, 'words', a.w || ' ' || b.w FROM w a JOIN w b ON a.rule_id = b.rule_id AND a.w < b.w) "
)
LINKED = LINKS + ", m AS (SELECT link_kind, link_key, count(*) AS members FROM g GROUP BY 1, 2 HAVING count(*) > 1) "


@query("D8", LINKED + "SELECT rule_id, link_kind, link_key, members FROM g JOIN m USING (link_kind, link_key)")
def rule_links(spark, d):
    return R.rule_links(B.rules(spark, d))


@query("D8_related", LINKED + "SELECT rule_id, CASE WHEN count(DISTINCT other) >= 5 THEN '5+' WHEN count(DISTINCT other) >= 3 THEN '3-4' WHEN count(DISTINCT other) = 2 THEN '2' ELSE '1' END AS band FROM (SELECT a.rule_id, b.rule_id AS other FROM g a JOIN g b USING (link_kind, link_key) WHERE a.rule_id <> b.rule_id) GROUP BY 1")
def related_rules(spark, d):
    return R.related_bands(B.rules(spark, d))


STOPS = ", ".join(f"'{w}'" for w in STOP_WORDS)


@query("D8_documents", f"WITH w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[^\\s\\x0B\\x{{85}}\\p{{Z}}]+')) AS w FROM documents), m AS (SELECT doc_id, w FROM w WHERE w NOT IN ({STOPS})), "
                       "s AS (SELECT a.doc_id AS a, b.doc_id AS b FROM m a JOIN m b USING (w) WHERE a.doc_id <> b.doc_id GROUP BY 1, 2 HAVING count(*) > 1) "
                       "SELECT a AS doc_id, CASE WHEN count(*) >= 5 THEN '5+' WHEN count(*) >= 3 THEN '3-4' WHEN count(*) = 2 THEN '2' ELSE '1' END AS band FROM s GROUP BY 1")
def related_documents(spark, d):
    """The word relation over whole texts instead of short descriptions."""
    return R.overlap_bands(B.table(spark, d, "documents").select("doc_id", "text"), "doc_id", "text")


@query("E23_impact", LINKED + ", r AS (SELECT rule_id, count(DISTINCT other) AS n FROM (SELECT a.rule_id, b.rule_id AS other FROM g a JOIN g b USING (link_kind, link_key) WHERE a.rule_id <> b.rule_id) GROUP BY 1) "
                     "SELECT CASE WHEN n >= 5 THEN 'high' WHEN n >= 2 THEN 'medium' ELSE 'low' END AS band, count(*) AS n_rules FROM r GROUP BY 1")
def impact_bands(spark, d):
    return M.impact_bands(R.related_bands(B.rules(spark, d)))


@query("D9", "SELECT s_name AS name, rule_path, n_rules FROM (SELECT replace(p_name, ' ', '.') || '.' || (p_partkey % 30) AS rule_path, count(*) AS n_rules FROM part GROUP BY 1) "
             "JOIN (SELECT DISTINCT split_part(p_name, ' ', 1 + (p_partkey % 2)::INT) AS s_name FROM part) ON contains(rule_path, s_name)")
def rules_of_entities(spark, d):
    p = B.table(spark, d, "part")
    k = c("p_partkey")
    names = p.select(F.element_at(F.split("p_name", " "), (k % 2).cast("int") + 1).alias("name"))
    rules = p.select(F.concat_ws(".", F.replace("p_name", F.lit(" "), F.lit(".")), (k % 30).cast("string")).alias("rule_path"))
    return R.rules_by_name(names, rules)


@query("D10", "SELECT DISTINCT source, target FROM (SELECT k AS source, 'small_ring_' || (k // 4) AS target FROM ent WHERE type = 'class') WHERE target IN (SELECT name FROM ent WHERE type = 'class')")
def known_dependencies(spark, d):
    cls = B.entities(spark, d).filter(c("type") == "class")
    edges = cls.select(c("k").alias("source"), F.concat(F.lit("small_ring_"), F.floor(c("k") / 4).cast("string")).alias("target"))
    return R.known_only(edges, cls.select("name"), "target").distinct().select("source", "target")


@query("D11", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def absent_customers(spark, d):
    incoming = B.table(spark, d, "customer").select("c_custkey")
    existing = B.table(spark, d, "orders").select(c("o_custkey").alias("c_custkey"))
    return R.absent(incoming, existing, "c_custkey")


@query("D12", "SELECT k, file_path || ':' || type || ':' || name AS entity_key, entity_id FROM ent")
def by_key(spark, d):
    from codeloom.functions.classify import entity_key

    e = B.entities(spark, d).withColumn("entity_key", entity_key(c("file_path"), c("type"), c("name")))
    ids = e.select("entity_key", "entity_id", "seq")
    firsts = R.first_per(ids, ["entity_key"], "seq", "entity_id", "entity_id")
    return skew_lookup(e.select("k", "entity_key"), firsts, ["entity_key"], ["k"], "inner").select("k", "entity_key", "entity_id")


@query("D14", "SELECT o_orderkey, 'r' || n_regionkey AS class_first, 'n' || n_nationkey AS class_last, 'c' || c_custkey AS method_context FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey")
def contexts(spark, d):
    """Orders as rules on customers; regions and nations count as classes,
    customers as methods."""
    geo = B.geography(spark, d)
    upper = geo.filter(~c("id").startswith("o"))
    entities = upper.select(
        c("id").alias("entity_id"), F.when(c("id").startswith("c"), "method").otherwise("class").alias("type"), c("label").alias("name")
    )
    closed = graph.closure(upper)
    rules = B.table(spark, d, "orders").select(
        c("o_orderkey").alias("rule_id"), F.concat(F.lit("c"), c("o_custkey").cast("string")).alias("entity_id")
    )
    last = R.rule_contexts(rules, closed, entities, "last").select(
        "rule_id", "entity_id", c("class_context").alias("class_last"), "method_context"
    )
    first = R.rule_contexts(last.select("rule_id", "entity_id"), closed, entities, "first").select(
        "rule_id", c("class_context").alias("class_first")
    )
    return last.join(first, "rule_id").select(c("rule_id").alias("o_orderkey"), "class_first", "class_last", "method_context")


PLACED = (
    LINKED + ", r AS (SELECT rule_id, count(DISTINCT other) AS n FROM (SELECT a.rule_id, b.rule_id AS other FROM g a JOIN g b USING (link_kind, link_key) WHERE a.rule_id <> b.rule_id) GROUP BY 1), "
    "x AS (SELECT rules.rule_id, type, name, module_path, class_context, coalesce(n, 0) AS n FROM rules JOIN entm USING (entity_id) LEFT JOIN r ON r.rule_id = rules.rule_id), "
    "placed AS (SELECT rule_id, CASE WHEN type IN ('class', 'interface') THEN 'class' WHEN type = 'function' THEN 'method' WHEN n > 2 THEN 'cross_cutting' END AS level, "
    "CASE WHEN type IN ('class', 'interface') THEN module_path || '.' || name WHEN type = 'function' THEN module_path || '.' || coalesce(class_context, '') || '.' || name ELSE '' END AS hierarchy_key FROM x) "
)


def placed_rules(spark, d):
    rules = B.rules(spark, d)
    e = B.entities_in_modules(spark, d).select(
        "entity_id", "module_path", c("type").alias("entity_type"), c("name").alias("entity_name")
    )
    counts = R.related_bands(rules)
    full = skew_lookup(rules, e, ["entity_id"], ["rule_id"], "inner").join(counts, "rule_id", "left")
    return M.rules_by_hierarchy(full)


@query("E22", PLACED + "SELECT level, hierarchy_key, count(*) AS n_rules FROM placed WHERE level IS NOT NULL GROUP BY 1, 2")
def hierarchy(spark, d):
    return M.hierarchy_counts(placed_rules(spark, d))


@query("E22_rules", PLACED + "SELECT rule_id, level, hierarchy_key FROM placed WHERE level IS NOT NULL")
def hierarchy_rules(spark, d):
    return placed_rules(spark, d)


@query("E33", PLACED + "SELECT (SELECT count(*) FROM ent) AS total_components, (SELECT count(*) FROM ent WHERE contains(docstring, 'critical') OR k % 9 = 0) AS critical_components, count(*) FROM placed WHERE level IS NOT NULL".replace("count(*) FROM placed", "count(*) AS total_business_rules FROM placed"))
def insight_totals(spark, d):
    e = B.entities(spark, d).select("k", "name", "docstring", F.when(c("k") % 9 == 0, "CRITICAL path").otherwise("plain").alias("note"))
    return M.insight_totals(e, placed_rules(spark, d))
