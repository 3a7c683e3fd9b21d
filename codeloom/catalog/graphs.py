"""Graph and hierarchy queries (G, E24-E27, E36, F16, H9, I4)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog import texts as T
from codeloom.catalog.registry import binding, query
from codeloom.functions.scoring import impact_risk
from codeloom.operators import graph
from codeloom.operators import metrics as M
from codeloom.operators import ranking as K
from codeloom.plans import intelligence
from codeloom.plans.run import whole_run

c = F.col


def _mixed_files(spark, d):
    """Python, TypeScript, IDL, Java, XML and page files of every part."""
    out = None
    for make in (T.python_files, T.typescript_files, T.idl_files, T.action_files, T.config_files, T.page_files):
        one = make(spark, d)
        out = one if out is None else out.unionByName(one)
    return out


NODES = " UNION ALL ".join((
    "SELECT 'class' AS type, count(*) AS n FROM (SELECT k FROM p WHERE k % 7 <> 0 UNION ALL SELECT k FROM p WHERE k % 7 <> 0 AND k % 3 = 0)",
    "SELECT 'function', count(*) FROM p WHERE k % 7 <> 0",
    # one for each file with entities, and the Angular modules
    "SELECT 'module', count(*) * 5 + count(*) FILTER (WHERE k % 7 <> 0) + count(*) FILTER (WHERE k % 11 > 1) FROM p",
    *[f"SELECT '{t}', count(*) FROM p" for t in ("component", "service", "interface", "corba_module", "corba_interface",
      "corba_attribute", "corba_struct", "corba_exception", "corba_enum", "corba_typedef", "struts2_action_class",
      "struts2_action_method", "struts2_validation_method", "struts2_jsp")],
    "SELECT 'corba_method', count(*) * 2 FROM p",
    *[f"SELECT '{t}', count(*) FROM confp" for t in ("struts2_package", "struts2_interceptor_ref", "struts2_global_result", "struts2_interceptor_stack")],
    "SELECT 'struts2_action', count(*) * 2 FROM confp",
))


@query("G1", f"SELECT type, n FROM ({NODES})")
def graph_nodes(spark, d):
    g = intelligence.build(_mixed_files(spark, d))
    return g.nodes.groupBy("type").agg(F.count("*").alias("n"))


HELPERS = "".join(
    [f"class Base{i}:\n    pass\n\n" for i in range(5)]
    + [f"def helper_{i}(x):\n    return x\n\n" for i in range(7)]
    + [f"def pkg{i}():\n    return helper_{i}(1)\n\n" for i in range(3)]
)


@query("G1_edges", "SELECT 'calls' AS kind, 'compute_' || k AS source, 'helper_' || (k % 7) AS target FROM p WHERE k % 7 <> 0 "
                   "UNION ALL SELECT 'calls', 'pkg' || i, 'helper_' || i FROM range(3) t(i) "
                   "UNION ALL SELECT 'inherits', 'P' || k, 'Base' || (k % 5) FROM p WHERE k % 7 <> 0 "
                   "UNION ALL SELECT 'depends_on', 'p' || k, 'pkg' || (k % 3) FROM p WHERE k % 7 <> 0")
def graph_edges(spark, d):
    """Edges of all three kinds; a function that calls nobody known has none,
    and none calls itself."""
    helpers = spark.range(1).select(F.lit("src/py/helpers.py").alias("file_path"), F.lit(HELPERS).alias("text"))
    files = T.python_files(spark, d).select("file_path", "text").unionByName(helpers)
    g = intelligence.build(files)
    source = g.names.select(c("entity_id").alias("source_id"), c("name").alias("source"))
    target = g.names.select(c("entity_id").alias("target_id"), c("name").alias("target"))
    return g.edges.join(source, "source_id").join(target, "target_id").select(
        c("relationship_type").alias("kind"), "source", "target"
    )


def _run(spark, d):
    """Python and SQL files of every part, and a rule for each computation."""
    files = T.python_files(spark, d).select("file_path", "text").unionByName(T.sql_files(spark, d).select("file_path", "text"))
    k = B.table(spark, d, "part").select(c("p_partkey").cast("string").alias("k"))
    at = F.concat(F.lit("py/p"), "k", F.lit(".py:compute_"), "k", F.lit("()"))
    return whole_run(files, k.select(F.concat(F.lit("R"), "k").alias("rule_id"), at.alias("code_reference")))


@query("W1_components", "SELECT 'P' || k AS name, 16 AS points, 'Medium' AS level, 'Medium' AS risk_level, 3 AS priority FROM p WHERE k % 7 <> 0 "
                        "UNION ALL SELECT 'D' || k, 5, 'Low', 'Low', 5 FROM p WHERE k % 7 <> 0 AND k % 3 = 0 "
                        "UNION ALL SELECT 'compute_' || k, 7, 'Low', 'Low', 5 FROM p WHERE k % 7 <> 0")
def run_components(spark, d):
    """Scores of what the extractors found."""
    return _run(spark, d).components.select("name", "points", "level", "risk_level", "priority")


@query("W1_modules", "SELECT 'py.p' || k AS module_path, 'class' AS type, CAST(1 + (k % 3 = 0)::INT AS BIGINT) AS n_entities, CAST(1 AS BIGINT) AS module_rules FROM p WHERE k % 7 <> 0 "
                     "UNION ALL SELECT 'py.p' || k, 'function', 1, 1 FROM p WHERE k % 7 <> 0")
def run_modules(spark, d):
    """Entities and placed rules by module."""
    return _run(spark, d).modules.select("module_path", "type", "n_entities", c("module_rules").cast("long").alias("module_rules"))


@query("W1_statements", "SELECT file_path, query_type FROM stmts")
def run_statements(spark, d):
    return _run(spark, d).statements.filter(c("file_path").startswith("db/")).select("file_path", "query_type")


@query("G2", "SELECT id, root, depth, path FROM (SELECT 'o' || o_orderkey AS id, 'r' || n_regionkey AS root, CAST(3 AS INTEGER) AS depth, 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey || '.o' || o_orderkey AS path "
             "FROM orders JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey UNION ALL SELECT 'c' || c_custkey, 'r' || n_regionkey, 2, 'r' || n_regionkey || '.n' || n_nationkey || '.c' || c_custkey FROM customer JOIN nation ON n_nationkey = c_nationkey "
             "UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, 1, 'r' || n_regionkey || '.n' || n_nationkey FROM nation UNION ALL SELECT 'r' || r_regionkey, 'r' || r_regionkey, 0, 'r' || r_regionkey FROM region)")
def root_paths(spark, d):
    return graph.root_paths(B.geography(spark, d))


@query("G3", "WITH u AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), s AS (SELECT p_partkey AS id FROM part WHERE p_size = (SELECT max(p_size) FROM part)), "
             "a AS (SELECT DISTINCT id AS start, target AS id FROM s JOIN u ON source = id), b AS (SELECT DISTINCT start, target AS id FROM a JOIN u ON source = a.id) "
             "SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT start, id, 1 AS depth FROM a UNION ALL SELECT start, id, 2 FROM b) WHERE start <> id GROUP BY 1, 2")
def related(spark, d):
    """Neighbours of all the largest parts."""
    p = B.table(spark, d, "part")
    starts = p.filter(c("p_size") == p.agg(F.max("p_size")).scalar()).select(c("p_partkey").alias("id"))
    return graph.related(B.part_edges(spark, d), starts)


@query("G3_all", "WITH u AS (SELECT source, target FROM edges UNION SELECT target, source FROM edges), a AS (SELECT DISTINCT p_partkey AS start, target AS id FROM part JOIN u ON source = p_partkey), "
                 "b AS (SELECT DISTINCT start, target AS id FROM a JOIN u ON source = a.id) "
                 "SELECT start, id, CAST(min(depth) AS INTEGER) AS depth FROM (SELECT start, id, 1 AS depth FROM a UNION ALL SELECT start, id, 2 FROM b) WHERE start <> id GROUP BY 1, 2")
def related_to_all(spark, d):
    """Neighbours of every part."""
    return graph.related(B.part_edges(spark, d), B.table(spark, d, "part").select(c("p_partkey").alias("id")))


CHAINS = (
    "WITH RECURSIVE w AS (SELECT p_partkey AS start, [p_partkey] AS chain, p_partkey AS last, 0 AS depth FROM part "
    "UNION ALL SELECT start, list_append(chain, target), target, depth + 1 FROM w JOIN edges ON source = last WHERE depth < 3 AND NOT list_contains(chain, target)), "
    "done AS (SELECT start, chain FROM w WHERE depth = 3 OR last NOT IN (SELECT source FROM edges)) "
)


def _with_recursive(sql):
    """The bindings go behind the RECURSIVE word."""
    from codeloom.catalog.registry import expand

    body = expand(sql.replace("WITH RECURSIVE ", "WITH ", 1))
    return body.replace("WITH ", "WITH RECURSIVE ", 1)


def _chain_query(key, sql):
    def add(fn):
        query(key)(fn)
        from codeloom.catalog.registry import ORACLES

        ORACLES[key] = _with_recursive(sql)
        return fn

    return add


def _starts(spark, d):
    return B.table(spark, d, "part").select(c("p_partkey").alias("id"))


def _chains(spark, d):
    return graph.call_chains(B.part_edges(spark, d), _starts(spark, d))


@_chain_query("G4", CHAINS + "SELECT start, array_to_string(chain, '>') AS chain FROM done")
def call_chains(spark, d):
    text = F.array_join(F.transform("chain", lambda x: x.cast("string")), ">")
    return _chains(spark, d).select("start", text.alias("chain"))


@_chain_query("E24", CHAINS + "SELECT count(DISTINCT start) AS n_roots, round(sum(len(chain)) / greatest(count(DISTINCT start), 1), 4) AS avg_length, count(*) FILTER (WHERE len(chain) > 5) AS deep_chains FROM done")
def chain_statistics(spark, d):
    return M.chain_statistics(graph.chain_counts(B.part_edges(spark, d), _starts(spark, d)))


@_chain_query("H9", CHAINS + "SELECT start, array_to_string(chain, '>') AS path, CAST(len(chain) AS INTEGER) AS complexity, CASE WHEN len(chain) > 5 THEN 'high' ELSE 'medium' END AS significance FROM done WHERE len(chain) >= 3 ORDER BY complexity DESC, start, path LIMIT 10")
def critical_flows(spark, d):
    top = K.critical_flows(_chains(spark, d))
    return top.select("start", F.array_join(F.transform("chain", lambda x: x.cast("string")), ">").alias("path"), "complexity", "significance")


binding(
    "impacts",
    "SELECT q.id, coalesce(i.n, 0) AS n_dependents, coalesce(o.n, 0) AS n_dependencies, coalesce(a.n, 0) AS n_affected, coalesce(a.m, 0) AS n_modules FROM (SELECT k AS id FROM ent) q "
    "LEFT JOIN (SELECT target AS id, count(*) AS n FROM edges GROUP BY 1) i ON i.id = q.id LEFT JOIN (SELECT source AS id, count(*) AS n FROM edges GROUP BY 1) o ON o.id = q.id "
    "LEFT JOIN (SELECT id, count(*) AS n, count(DISTINCT module_path) AS m FROM (SELECT target AS id, source AS far FROM edges UNION SELECT e.target, f.source FROM edges e JOIN edges f ON f.target = e.source) "
    "LEFT JOIN entm ON k = far GROUP BY 1) a ON a.id = q.id",
)
RISK = ("CASE WHEN n_dependents = 0 THEN 'Low' WHEN n_dependents <= 2 AND n_affected <= 5 THEN 'Low' WHEN n_dependents <= 5 AND n_affected <= 15 THEN 'Medium' "
        "WHEN n_dependents <= 10 AND n_affected <= 30 THEN 'High' ELSE 'Critical' END AS risk_level")


def _impacts(spark, d):
    modules = B.entities_in_modules(spark, d).select(c("k").alias("id"), "module_path")
    return graph.impact(B.part_edges(spark, d), modules)


@query("G5", f"SELECT *, {RISK} FROM impacts")
def impact(spark, d):
    return _impacts(spark, d)


@query("E36", f"SELECT (SELECT count(*) FROM (SELECT {RISK} FROM impacts) WHERE risk_level IN ('High', 'Critical')) AS high_impact_components, 1::BIGINT AS legacy_technologies")
def impact_totals(spark, d):
    e = B.entities_in_modules(spark, d)
    tech = e.select(F.regexp_extract("file_path", "^src/([^/]+)", 1).alias("technology")).distinct()
    return M.impact_totals(_impacts(spark, d), tech)


@query("F16", f"SELECT k AS id, {RISK} FROM (SELECT k, k % 13 AS n_dependents, k % 40 AS n_affected FROM ent)")
def impact_levels(spark, d):
    k = c("k")
    return B.entities(spark, d).select(k.alias("id"), impact_risk(k % 13, k % 40).alias("risk_level"))


@query("I4", "SELECT target AS id, source AS far FROM edges UNION SELECT e.target, f.source FROM edges e JOIN edges f ON f.target = e.source")
def two_step_callers(spark, d):
    e = B.part_edges(spark, d).distinct()
    near = e.select(c("target").alias("id"), c("source").alias("far"))
    far = near.select("id", c("far").alias("mid")).join(near.select(c("id").alias("mid"), "far"), "mid").select("id", "far")
    return near.unionByName(far).distinct()


@query("G6", "SELECT id AS ancestor, id AS descendant, CAST(0 AS INTEGER) AS depth, id AS path FROM geo UNION ALL SELECT parent_id, id, 1, parent_id || '.' || id FROM geo WHERE parent_id IS NOT NULL "
             "UNION ALL SELECT g.parent_id, a.id, 2, g.parent_id || '.' || a.parent_id || '.' || a.id FROM geo a JOIN geo g ON g.id = a.parent_id WHERE g.parent_id IS NOT NULL "
             "UNION ALL SELECT h.parent_id, a.id, 3, h.parent_id || '.' || g.parent_id || '.' || a.parent_id || '.' || a.id FROM geo a JOIN geo g ON g.id = a.parent_id JOIN geo h ON h.id = g.parent_id WHERE h.parent_id IS NOT NULL")
def closure(spark, d):
    return graph.closure(B.geography(spark, d))


binding(
    "tree",
    "SELECT k AS id, module_path, CASE WHEN k % 20 = 10 THEN k - 10 WHEN k % 10 = 0 THEN NULL WHEN k % 10 <= 4 THEN k - k % 10 ELSE k - 4 END AS parent_id FROM entm",
)


@query("G7", "WITH l AS (SELECT a.id, a.module_path, b.id AS parent_id FROM tree a LEFT JOIN tree b ON b.id = a.parent_id AND b.module_path = a.module_path) "
             "SELECT a.module_path, coalesce(d.id, cc.id, b.id, a.id) AS root, a.id, CAST((b.id IS NOT NULL)::INT + (cc.id IS NOT NULL)::INT + (d.id IS NOT NULL)::INT AS INTEGER) AS depth, "
             "concat_ws('.', d.id, cc.id, b.id, a.id) AS path FROM l a LEFT JOIN l b ON b.id = a.parent_id LEFT JOIN l cc ON cc.id = b.parent_id LEFT JOIN l d ON d.id = cc.parent_id")
def module_trees(spark, d):
    k = c("k")
    parent = F.when(k % 20 == 10, k - 10).when(k % 10 == 0, None).when(k % 10 <= 4, k - k % 10).otherwise(k - 4)
    nodes = B.entities_in_modules(spark, d).select(
        k.alias("id"), parent.alias("parent_id"), "module_path", k.cast("string").alias("label")
    )
    return graph.module_trees(nodes)


# Listing over page addresses: host folders, then language, then page.
@query("G8", "WITH x AS (SELECT DISTINCT unnest(list_transform(range(1, len(parts) + 1), lambda i: struct_pack(node := array_to_string(parts[1:i], '/'), level := i - 1, leaf := (i = len(parts))))) AS s FROM "
             "(SELECT list_filter(string_split(regexp_replace(url, '^https?://|[?#].*$', '', 'g'), '/'), lambda p: p <> '') AS parts FROM pages)), "
             "n AS (SELECT s.node AS node, s.level AS level, min(s.leaf::INT) AS is_file FROM x GROUP BY 1, 2), "
             "r AS (SELECT *, CASE WHEN level > 0 THEN regexp_replace(node, '/[^/]*$', '') ELSE '' END AS parent, regexp_extract(node, '[^/]*$') AS name FROM n), "
             "k AS (SELECT *, lpad(row_number() OVER (PARTITION BY parent ORDER BY is_file, name)::VARCHAR, 3, '0') AS rk, row_number() OVER (PARTITION BY parent ORDER BY is_file, name) AS rn FROM r), "
             "t AS (SELECT * FROM k WHERE rn <= 10), "
             "l AS (SELECT a.rk AS sort_key, a.node, a.name, a.level FROM t a WHERE level = 0 UNION ALL SELECT b.rk || '.' || a.rk, a.node, a.name, a.level FROM t a JOIN t b ON b.node = a.parent WHERE a.level = 1 "
             "UNION ALL SELECT d.rk || '.' || b.rk || '.' || a.rk, a.node, a.name, a.level FROM t a JOIN t b ON b.node = a.parent JOIN t d ON d.node = b.parent WHERE a.level = 2) "
             "SELECT sort_key, node, name, CAST(level AS INTEGER) AS level FROM l ORDER BY sort_key LIMIT 50")
def tree_listing(spark, d):
    path = F.regexp_replace("url", r"^https?://|[?#].*$", "")
    return graph.tree_listing(B.table(spark, d, "pages").select(path.alias("path")))


# ---- call tables ---------------------------------------------------------------------


@query("E25", "SELECT l_suppkey AS caller, l_partkey AS callee, count(*) AS call_count, min(l_linenumber) AS first_line, max(l_linenumber) AS last_line, l_suppkey = l_partkey AS is_recursive FROM lineitem GROUP BY 1, 2")
def call_graph(spark, d):
    return M.call_graph(B.supply_calls(spark, d))


@query("E25_lines", "SELECT l_suppkey AS caller, l_partkey AS callee, l_linenumber AS line, count(*) AS n FROM lineitem GROUP BY 1, 2, 3")
def call_lines(spark, d):
    return M.call_lines(B.supply_calls(spark, d))


@query("E27", "WITH n AS (SELECT 's' || l_suppkey AS s, 'p' || l_partkey AS t, count(*) AS n FROM lineitem GROUP BY 1, 2), b AS (SELECT s AS id, t AS neighbour, 'calls' AS relation, n FROM n UNION ALL SELECT t, s, 'called_by', n FROM n) "
              "SELECT * FROM b UNION ALL SELECT id, neighbour, 'cross_reference', CAST(sum(n) AS BIGINT) FROM b GROUP BY 1, 2")
def adjacency(spark, d):
    e = B.supply_calls(spark, d).select(
        F.concat(F.lit("s"), c("caller").cast("string")).alias("source"), F.concat(F.lit("p"), c("callee").cast("string")).alias("target")
    )
    return graph.adjacency(e)
