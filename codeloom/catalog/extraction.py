"""Extraction queries (A6, C): source texts written from part rows, pages,
documents and events; expected rows follow from the same part rows in SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog import texts as T
from codeloom.catalog.registry import binding, query
from codeloom.functions import text as X
from codeloom.operators import asof, extract_python, extract_rules, extract_source, extract_sql, extract_web
from codeloom.operators.ranking import first_k

P, S, W, Q = extract_python, extract_source, extract_web, extract_sql
c = F.col


def joined(column, sep=","):
    return F.array_join(column, sep)


# Every part has a file of each kind. Files that do not parse by design (one
# Python text in seven, two XML texts in eleven) yield no rows, hence the
# conditions below; the queries themselves read all files.
binding("p", "SELECT p_partkey AS k FROM part")
binding("pyp", "SELECT k, 'src/py/p' || k || '.py' AS file_path FROM p WHERE k % 7 <> 0")
binding("idlp", "SELECT k, 'src/idl/p' || k || '.idl' AS file_path FROM p")
binding("tsp", "SELECT k, 'src/angular/p' || k || '.ts' AS file_path FROM p")
binding("restp", "SELECT k, 'src/api/R' || k || '.java' AS file_path FROM p")
binding("actp", "SELECT k, 'src/action/A' || k || '.java' AS file_path FROM p")
binding("jspp", "SELECT k, 'web/p' || k || '.jsp' AS file_path FROM p")
binding("confp", "SELECT k, 'conf/p' || k || '/struts.xml' AS file_path FROM p WHERE k % 11 > 1")


# ---- Python -------------------------------------------------------------------


def nodes(spark, d):
    return P.node_table(T.python_files(spark, d))


@query("C1", "SELECT file_path, 'class' AS type, 'P' || k AS name, 4 AS line_number, 6 AS complexity FROM pyp "
             "UNION ALL SELECT file_path, 'function', 'compute_' || k, 18, 3 FROM pyp "
             "UNION ALL SELECT file_path, 'class', 'D' || k, 28, 0 FROM pyp WHERE k % 3 = 0")
def python_entities(spark, d):
    n = nodes(spark, d)
    cols = ["file_path", "type", "name", "line_number", "complexity"]
    return (
        P.classes(n).withColumn("type", F.lit("class")).select(*cols)
        .unionByName(P.functions(n).withColumn("type", F.lit("function")).select(*cols))
    )


@query("C1a", "SELECT file_path, '__init__' AS method, 7 AS line, true AS is_private, true AS is_magic, 3 AS n_params, 2 AS complexity FROM pyp "
              "UNION ALL SELECT file_path, 'create_item', 12, false, false, 2, 4 FROM pyp")
def python_methods(spark, d):
    return P.methods(nodes(spark, d)).select("file_path", "method", "line", "is_private", "is_magic", "n_params", "complexity")


@query("C1b", "SELECT file_path, 'P' || k AS name, 'Factory' AS patterns, 'Base' || (k % 5) AS bases FROM pyp "
              "UNION ALL SELECT file_path, 'D' || k, '', '' FROM pyp WHERE k % 3 = 0")
def python_patterns(spark, d):
    return P.classes(nodes(spark, d)).select(
        "file_path", "name", joined("design_patterns").alias("patterns"), joined("base_classes").alias("bases")
    )


@query("C1c", "SELECT file_path, 'P' || k AS name, false AS is_data_class, false AS is_abstract_class, true AS has_constructor, 2 AS ctor_params, 2 AS ctor_complexity, true AS ctor_validates, true AS ctor_defaults FROM pyp "
              "UNION ALL SELECT file_path, 'D' || k, true, false, false, 0, 0, false, false FROM pyp WHERE k % 3 = 0")
def python_class_flags(spark, d):
    return P.classes(nodes(spark, d)).select(
        "file_path", "name", "is_data_class", "is_abstract_class", "has_constructor", "ctor_params",
        "ctor_complexity", "ctor_validates", "ctor_defaults",
    )


@query("C1d", "SELECT file_path, 'P' || k AS name, 1 AS public_methods, 0 AS private_methods, 1 AS magic_methods, 0 AS property_methods, '__init__,create_item' AS methods, 'kind' AS properties FROM pyp "
              "UNION ALL SELECT file_path, 'D' || k, 0, 0, 0, 0, '', 'x,y' FROM pyp WHERE k % 3 = 0")
def python_method_distribution(spark, d):
    return P.classes(nodes(spark, d)).select(
        "file_path", "name", "public_methods", "private_methods", "magic_methods", "property_methods",
        joined("methods").alias("methods"), joined("properties").alias("properties"),
    )


@query("C1e", "SELECT file_path, 'compute_' || k AS name, 'x,y' AS parameters, 'int' AS return_type, 'x:int' AS parameter_types, 18 AS line_number, 26 AS end_line_number, 9 AS n_source_lines, false AS is_async FROM pyp")
def python_functions(spark, d):
    return P.functions(nodes(spark, d)).select(
        "file_path", "name", joined("parameters").alias("parameters"), "return_type",
        joined("parameter_types").alias("parameter_types"), "line_number", "end_line_number",
        (X.newlines(c("source_code")) + 1).alias("n_source_lines"), "is_async",
    )


@query("C1f", "SELECT file_path, CAST(9 AS BIGINT) AS complexity, CAST(3 AS BIGINT) AS n_functions FROM pyp")
def python_complexity(spark, d):
    per = P.complexities(nodes(spark, d))
    return per.groupBy("file_path").agg(F.sum("complexity").alias("complexity"), F.count("*").alias("n_functions"))


@query("C1g", "SELECT file_path, 19 AS line, 'calculation' AS pattern, 'Mathematical operation: Add' AS description FROM pyp "
              "UNION ALL SELECT file_path, 21, 'validation', 'Input validation or constraint check' FROM pyp")
def python_logic(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.logic_patterns(n), n).select("file_path", "line", "pattern", "description")


@query("C1h_calls", "SELECT file_path, 25 AS line, 'helper_' || (k % 7) AS function, 'function_call' AS call_type, 1 AS arg_count FROM pyp")
def python_calls(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.function_calls(n), n).drop("scope")


@query("C1h_returns", "SELECT file_path, 22 AS line, 'NoneType' AS return_type, 'constant: None' AS description FROM pyp "
                      "UNION ALL SELECT file_path, 26, 'variable', 'variable: total' FROM pyp")
def python_returns(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.returns(n), n).drop("scope")


@query("C1h_handlers", "SELECT file_path, 23 AS line, 'ValueError' AS exception_type, false AS handled FROM pyp")
def python_handlers(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.exception_handlers(n), n).drop("scope")


@query("C1h_assignments", "SELECT file_path, 19 AS line, 'total' AS variable, true AS is_business_relevant FROM pyp")
def python_assignments(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.assignments(n), n).drop("scope")


@query("C1h_conditionals", "SELECT file_path, 21 AS line, false AS has_else, true AS is_business_logic FROM pyp")
def python_conditionals(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.conditionals(n), n).drop("scope")


@query("C1h_loops", "SELECT file_path, line, 'for' AS loop_type, has_else FROM (SELECT file_path, 13 AS line, false AS has_else FROM pyp)")
def python_loops(spark, d):
    """Loops inside methods; the functions of these files have none."""
    n = nodes(spark, d)
    return P.loops(n).drop("scope")


@query("C1h_try", "SELECT file_path, 20 AS line, 1 AS n_handlers, false AS has_finally, false AS has_else FROM pyp")
def python_try_blocks(spark, d):
    n = nodes(spark, d)
    return P.of_functions(P.try_blocks(n), n).drop("scope")


@query("C1_unparsed", "SELECT 'src/py/p' || k || '.py' AS file_path, 'SyntaxError' AS reason FROM p WHERE k % 7 = 0")
def python_unparsed(spark, d):
    return P.unparsed(nodes(spark, d))


@query("C1h_counts", "SELECT file_path, 1 AS n_calls, 2 AS n_returns, 1 AS n_conditions, 0 AS n_loops, 1 AS n_try FROM pyp")
def python_counts(spark, d):
    return P.functions(nodes(spark, d)).select("file_path", "n_calls", "n_returns", "n_conditions", "n_loops", "n_try")


@query("C1i", "SELECT file_path, 'os' AS dependency FROM pyp UNION ALL SELECT file_path, 'pkg' || (k % 3) FROM pyp")
def python_imports(spark, d):
    return P.imports(nodes(spark, d))


# ---- TypeScript, IDL -------------------------------------------------------------


@query("C2", "SELECT file_path, 'component' AS type, 'C' || k || 'Component' AS name, 2 AS line_number FROM tsp "
             "UNION ALL SELECT file_path, 'service', 'S' || k || 'Service', 9 FROM tsp "
             "UNION ALL SELECT file_path, 'module', 'M' || k || 'Module', 11 FROM tsp "
             "UNION ALL SELECT file_path, 'interface', 'I' || k, 13 FROM tsp")
def typescript(spark, d):
    return S.angular_entities(T.typescript_files(spark, d)).select("file_path", "type", "name", "line_number")


@query("C2_imports", "SELECT file_path, 'lib' || (k % 4) AS dependency FROM tsp")
def typescript_imports(spark, d):
    return S.dependencies(T.typescript_files(spark, d), S.typescript_imports())


@query("C3a", "SELECT doc_id, md5(regexp_replace(regexp_replace('/* a' || chr(10) || 'b */x // ' || doc_id || chr(10) || text, '//[^\\n]*', '', 'g'), '(?s)/\\*.*?\\*/', '', 'g')) AS digest FROM documents")
def idl_comments(spark, d):
    k = c("doc_id").cast("string")
    text = F.concat(F.lit("/* a\nb */x // "), k, F.lit("\n"), c("text"))
    return B.table(spark, d, "documents").select("doc_id", F.md5(S.strip_idl_comments(text)).alias("digest"))


@query("C3b", "SELECT file_path, 'corba_module' AS type, 'M' || (k % 10) AS name, 3 AS line_number, '' AS items, CAST(NULL AS VARCHAR) AS oneway FROM idlp "
              "UNION ALL SELECT file_path, 'corba_interface', 'Svc' || k, 4, CASE WHEN k % 2 = 0 THEN 'Base' || (k % 3) || ',Root' ELSE '' END, NULL FROM idlp "
              "UNION ALL SELECT file_path, 'corba_method', 'Svc' || k || '::notify', 6, '', 'true' FROM idlp "
              "UNION ALL SELECT file_path, 'corba_method', 'Svc' || k || '::get', 7, '', 'false' FROM idlp "
              "UNION ALL SELECT file_path, 'corba_attribute', 'Svc' || k || '::size', 8, '', NULL FROM idlp "
              "UNION ALL SELECT file_path, 'corba_struct', 'S' || k, 9, 'string name,long qty', NULL FROM idlp "
              "UNION ALL SELECT file_path, 'corba_exception', 'E' || k, 10, 'string why', NULL FROM idlp "
              "UNION ALL SELECT file_path, 'corba_enum', 'Kind' || k, 11, 'A,B,C', NULL FROM idlp "
              "UNION ALL SELECT file_path, 'corba_typedef', 'L' || k, 12, '', NULL FROM idlp")
def idl(spark, d):
    return S.idl_entities(T.idl_files(spark, d)).select(
        "file_path", "type", "name", "line_number", joined("items").alias("items"), c("attrs")["is_oneway"].alias("oneway")
    )


@query("C3c", "SELECT file_path, 'common_' || (k % 5) || '.idl' AS dependency FROM idlp UNION ALL SELECT file_path, 'Base' || (k % 3) FROM idlp WHERE k % 2 = 0 "
              "UNION ALL SELECT file_path, 'Root' FROM idlp WHERE k % 2 = 0")
def idl_dependencies(spark, d):
    return S.dependencies(T.idl_files(spark, d), S.idl_dependency_names())


IDL_ADVICE = (S.DIRECT, S.INTERFACE_STEPS[0] % 1, *S.INTERFACE_STEPS[1:], *S.STRUCT_STEPS, *S.ALTERNATIVES)


@query("C3d_advice", "SELECT file_path, unnest([" + ", ".join(f"'{x}'" for x in IDL_ADVICE) + "]) AS recommendation FROM idlp")
def idl_recommendations(spark, d):
    rolled = S.idl_rollup(T.idl_files(spark, d))
    return rolled.select("file_path", F.explode("recommendations").alias("recommendation"))


@query("C3d_counts", "SELECT file_path, 0 AS crud_interfaces, 0 AS callback_interfaces, 0 AS registry_interfaces, 1 AS small_structs FROM idlp")
def idl_counts(spark, d):
    return S.idl_rollup(T.idl_files(spark, d)).select(
        "file_path", "crud_interfaces", "callback_interfaces", "registry_interfaces", "small_structs"
    )


@query("C3d", "SELECT file_path, CASE WHEN k % 2 = 0 THEN 19 ELSE 9 END AS points, CASE WHEN k % 2 = 0 THEN 'Medium' ELSE 'Low' END AS level, 1 AS async_calls, 0 AS sync_calls, 1 AS json_structs, "
              "'Convert 1 CORBA interfaces to REST APIs;Modernize 1 data structures to JSON/XML schemas;1 structs are suitable for JSON serialization' AS opportunities, '' AS challenges, "
              "CASE WHEN k % 2 = 0 THEN 'Low Priority - Manageable migration effort' ELSE 'Very Low Priority - Simple migration candidate' END AS migration_priority FROM idlp")
def idl_rollup(spark, d):
    return S.idl_rollup(T.idl_files(spark, d)).select(
        "file_path", "points", "level", "async_calls", "sync_calls", "json_structs",
        joined("opportunities", ";").alias("opportunities"), joined("challenges", ";").alias("challenges"), "migration_priority",
    )


# ---- web frameworks ------------------------------------------------------------------


@query("A6", "SELECT file_path, CAST(1 AS INTEGER) AS n_packages, 'pk' || (k % 10) AS first_package, '/n' || (k % 4) AS namespace FROM confp")
def xml_config(spark, d):
    return S.parse_config(T.config_files(spark, d)).select(
        "file_path",
        F.size("doc.package").alias("n_packages"),
        c("doc.package")[0]["_name"].alias("first_package"),
        c("doc.package")[0]["_namespace"].alias("namespace"),
    )


@query("C4a", "SELECT file_path, 'struts_action' AS type, 'save' || k AS name, 'com.A' || k AS target FROM confp UNION ALL SELECT file_path, 'struts_result', 'save' || k || '_input', 'dispatcher' FROM confp "
              "UNION ALL SELECT file_path, 'struts_result', 'save' || k || '_success', 'redirect' FROM confp UNION ALL SELECT file_path, 'struts_action', 'list' || k, 'com.L' || k FROM confp")
def struts_config(spark, d):
    return S.struts_xml_entities(T.config_files(spark, d)).select(
        "file_path", "type", "name", F.coalesce(c("attrs")["action_class"], c("attrs")["result_type"]).alias("target")
    )


@query("C4b", "SELECT file_path, 'struts_action_class' AS type, 'A' || k || 'Action' AS name, 3 AS line_number FROM actp UNION ALL SELECT file_path, 'struts_method', 'A' || k || 'Action.execute', 6 FROM actp")
def struts_classes(spark, d):
    return S.struts_class_entities(T.action_files(spark, d)).select("file_path", "type", "name", "line_number")


TAG = r"<(\w+)[^>]*>"


@query("C4c", f"SELECT page_id, CAST(len(t) AS INTEGER) AS tag_count, array_to_string(list_sort(list_distinct(t)), ',') AS tags FROM (SELECT page_id, regexp_extract_all(html, '{TAG}', 1) AS t FROM pages)")
def page_tags(spark, d):
    tags = S.page_tags(c("html"), TAG)
    return B.table(spark, d, "pages").select("page_id", tags.alias("t")).select(
        "page_id", F.size("t").alias("tag_count"), joined(F.array_sort(F.array_distinct("t"))).alias("tags")
    )


@query("C4d", "SELECT file_path, 'com.A' || k AS dependency FROM confp UNION ALL SELECT file_path, 'com.L' || k FROM confp UNION ALL SELECT file_path, 'com.I' || (k % 5) FROM confp "
              "UNION ALL SELECT file_path, 'org.apache.struts2.Foo' || (k % 3) FROM actp")
def struts_dependencies(spark, d):
    xml = S.dependencies(S.parse_config(T.config_files(spark, d)), S.xml_class_names())
    return xml.unionByName(S.dependencies(T.action_files(spark, d), S.java_framework_imports()))


@query("C5a", "SELECT file_path, 'struts2_package' AS type, 'pk' || (k % 10) AS name, '' AS items FROM confp UNION ALL SELECT file_path, 'struts2_action', 'pk' || (k % 10) || '.save' || k, '' FROM confp "
              "UNION ALL SELECT file_path, 'struts2_action', 'pk' || (k % 10) || '.list' || k, '' FROM confp UNION ALL SELECT file_path, 'struts2_interceptor_ref', 'save' || k || '_interceptor_st', '' FROM confp "
              "UNION ALL SELECT file_path, 'struts2_global_result', 'global_err', '' FROM confp UNION ALL SELECT file_path, 'struts2_interceptor_stack', 'st', 't' FROM confp")
def struts2_config(spark, d):
    return S.struts2_xml_entities(T.config_files(spark, d)).select("file_path", "type", "name", joined("items").alias("items"))


@query("C5b", "SELECT file_path, 'struts2_action_class' AS type, 'A' || k || 'Action' AS name, 2 AS line_number FROM actp UNION ALL SELECT file_path, 'struts2_action_method', 'A' || k || 'Action.run' || k, 4 FROM actp "
              "UNION ALL SELECT file_path, 'struts2_validation_method', 'A' || k || 'Action.validateAll', 7 FROM actp")
def struts2_classes(spark, d):
    return S.struts2_class_entities(T.action_files(spark, d)).select("file_path", "type", "name", "line_number")


@query("C5c", "SELECT file_path, 'p' || k AS name, 'form,textfield' AS tags, '2' AS tag_count, 'user.name|count' AS ognl FROM jspp")
def struts2_pages(spark, d):
    return S.struts2_page_entities(T.page_files(spark, d)).select(
        "file_path", "name", joined("items").alias("tags"), c("attrs")["tag_count"].alias("tag_count"), c("attrs")["ognl"].alias("ognl")
    )


@query("C5d", "SELECT file_path, 'org.apache.struts2.convention.annotation' AS dependency FROM actp UNION ALL SELECT file_path, 'org.apache.struts2.Foo' || (k % 3) FROM actp")
def struts2_dependencies(spark, d):
    return S.dependencies(T.action_files(spark, d), S.struts2_dependency_names())


# ---- web traffic -----------------------------------------------------------------------


@query("C6", "SELECT file_path, 5 AS line_number, 'GET' AS method, '/api/p' || (k % 20) || '/:id' AS url, 'load' || (k % 3) AS context_function, 'C' || k || 'Component' AS context_class, 'id' AS parameters, true AS is_dynamic_url FROM tsp "
             "UNION ALL SELECT file_path, 6, 'POST', '/legacy/p' || (k % 20), 'load' || (k % 3), 'C' || k || 'Component', '', false FROM tsp")
def http_calls(spark, d):
    return W.http_calls(T.typescript_files(spark, d)).withColumn("parameters", joined("parameters"))


@query("C7", "SELECT file_path, 3 AS line_number, 'GET' AS method, '/api/p' || (k % 20) || '/{id}' AS path, 'find' || k AS handler_function, 'a,id' AS parameters, 'R' || k || 'Controller' AS handler_class, 'Spring Boot' AS framework FROM restp "
             "UNION ALL SELECT file_path, 5, 'POST', '/legacy/p' || (k % 20), 'save' || k, 'a,id', 'R' || k || 'Controller', 'Spring Boot' FROM restp")
def rest_endpoints(spark, d):
    return W.rest_endpoints(T.rest_files(spark, d)).withColumn("parameters", joined("parameters"))


@query("C8", "SELECT file_path, 'save' || (k % 25) AS name, 'A' || k || 'Action' AS class_name, 'run' || k AS method, '/save' || (k % 25) AS path, '/ok' || k || '.jsp' AS success_page, 4 AS line_number FROM actp")
def annotated_actions(spark, d):
    return W.annotated_actions(T.action_files(spark, d)).withColumn("success_page", c("result_pages")["success"]).drop("result_pages")


@query("C9", "SELECT file_path, 'save' || k AS name, 'com.A' || k AS class_name, 'run' AS method, '/save' || k AS path, 'input=/in' || k || '.jsp,success=/b.jsp' AS pages FROM confp "
             "UNION ALL SELECT file_path, 'list' || k, 'com.L' || k, 'execute', '/list' || k, '' FROM confp")
def xml_actions(spark, d):
    pages = F.transform(F.array_sort(F.map_entries("result_pages")), lambda e: F.concat_ws("=", e["key"], e["value"]))
    return S.xml_web_actions(T.config_files(spark, d)).select(
        "file_path", "name", "class_name", "method", "path", joined(pages).alias("pages")
    )


LINK_SQL = "(?i)<a[^>]*href\\s*=\\s*[''\"`]([^''\"`]*)[''\"`][^>]*>"


@query("C10", f"SELECT page_id, u AS action_url, regexp_replace(regexp_replace(trim(u), '^/', ''), '\\.action$', '') AS target_action, count(*) AS n FROM "
              f"(SELECT page_id, unnest(regexp_extract_all(html, '{LINK_SQL}', 1)) AS u FROM pages) GROUP BY 1, 2, 3")
def page_links(spark, d):
    pages = B.table(spark, d, "pages").select(c("page_id").cast("string").alias("file_path"), c("html").alias("text"))
    links = W.page_components(pages).filter(c("component_type") == "link")
    return links.groupBy(c("file_path").cast("long").alias("page_id"), "action_url", "target_action").agg(F.count("*").alias("n"))


@query("C10_forms", "SELECT file_path, 'form' AS component_type, 1 AS line_number, 'save' || (k % 25) AS target_action, 'q' || (k % 3) AS parameters FROM jspp "
                    "UNION ALL SELECT file_path, 'form', 2, 'save' || (k % 25), 'q' || (k % 3) FROM jspp UNION ALL SELECT file_path, 'link', 3, 'item/' || k, 'q' || (k % 3) FROM jspp "
                    "UNION ALL SELECT file_path, 'button', 4, 'go' || (k % 9), 'q' || (k % 3) FROM jspp")
def page_forms(spark, d):
    return W.page_components(T.page_files(spark, d)).select(
        "file_path", "component_type", "line_number", "target_action", joined("parameters").alias("parameters")
    )


def _probes_and_marks(spark, d):
    e = B.table(spark, d, "events").withColumn("ts", c("ts").cast("timestamp"))
    probes = e.filter(c("event_type") == "purchase").select("event_id", "user_id", "ts")
    marks = e.filter(c("event_type") == "click").select("user_id", "ts", c("event_id").alias("click"))
    return probes, marks


ASOF = ("SELECT p.event_id, m.event_id AS nearest FROM (SELECT * FROM events WHERE event_type = 'purchase') p "
        "ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'click') m ON p.user_id = m.user_id AND p.ts {op} m.ts")


@query("C11", ASOF.format(op=">="))
def last_before(spark, d):
    probes, marks = _probes_and_marks(spark, d)
    return asof.asof_backward(probes, marks, "user_id", "ts", "click", F.to_date("ts")).select("event_id", "nearest")


@query("C12", ASOF.format(op="<"))
def first_after(spark, d):
    probes, marks = _probes_and_marks(spark, d)
    return asof.asof_forward(probes, marks, "user_id", "ts", "click", F.to_date("ts")).select("event_id", "nearest")


@query("C13", "SELECT page_id, md5(substr(html, CAST(greatest(a - 500, 0) + 1 AS BIGINT), CAST(a + 500 - greatest(a - 500, 0) AS BIGINT))) AS near500, "
              "md5(substr(html, CAST(greatest(a - 1000, 0) + 1 AS BIGINT), CAST(a + 1000 - greatest(a - 1000, 0) AS BIGINT))) AS near1000 FROM (SELECT page_id, html, instr(html, '<article') - 1 AS a FROM pages) WHERE a >= 0")
def windows(spark, d):
    at = F.locate("<article", c("html")) - 1
    return B.table(spark, d, "pages").filter(at >= 0).select(
        "page_id",
        F.md5(X.char_window(c("html"), at, 500)).alias("near500"),
        F.md5(X.char_window(c("html"), at, 1000)).alias("near1000"),
    )


# ---- SQL statements -----------------------------------------------------------------------

binding(
    "stmts",
    "SELECT k, 'db/q' || k || '.sql' AS file_path, 1 AS line_number, 'SELECT p_name, p_brand AS b, t.p_size FROM part_' || (k % 3) || ' t JOIN lineitem l WHERE x = ' || k AS query_text, "
    "'SELECT' AS query_type, ['lineitem', 'part_' || (k % 3)] AS tables, 0 AS n_parameters, false AS is_prepared, ['p_name', 'p_brand', 'p_size'] AS cols FROM p WHERE k % 4 = 0 "
    "UNION ALL SELECT k, 'db/q' || k || '.sql', 1, 'INSERT INTO log_' || (k % 5) || ' VALUES (?)\")', 'INSERT', ['log_' || (k % 5)], 1, false, [] FROM p WHERE k % 4 = 1 "
    "UNION ALL SELECT k, 'db/q' || k || '.sql', 1, 'INSERT INTO log_' || (k % 5) || ' VALUES (?)', 'INSERT', ['log_' || (k % 5)], 1, true, [] FROM p WHERE k % 4 = 1 "
    "UNION ALL SELECT k, 'db/q' || k || '.sql', 2, 'UPDATE stock_' || (k % 3) || ' SET qty = :q', 'UPDATE', ['stock_' || (k % 3)], 1, false, [] FROM p WHERE k % 4 = 2 "
    "UNION ALL SELECT k, 'db/q' || k || '.sql', 1, 'DELETE FROM cart_' || (k % 3) || ' WHERE id = $1', 'DELETE', ['cart_' || (k % 3)], 1, false, [] FROM p WHERE k % 4 = 3 "
    "UNION ALL SELECT k, 'db/q' || k || '.sql', 3, 'SELECT *' || chr(10) || 'FROM part_' || (k % 5), 'SELECT', ['part_' || (k % 5)], 0, false, [] FROM p WHERE k % 4 = 3",
)


def statements(spark, d):
    return Q.sql_statements(T.sql_files(spark, d))


@query("C14", "SELECT file_path, line_number, query_text, query_type, is_prepared, n_parameters FROM stmts")
def sql_statements(spark, d):
    return statements(spark, d).select(
        "file_path", "line_number", "query_text", "query_type", "is_prepared", F.size("parameters").alias("n_parameters")
    )


@query("C15", "SELECT file_path, line_number, is_prepared, array_to_string(tables, ',') AS tables FROM stmts")
def sql_tables(spark, d):
    return statements(spark, d).select("file_path", "line_number", "is_prepared", joined("tables").alias("tables"))


# An underscore is no letter or digit, so names with one are not kept.
@query("C16", "SELECT k, 'alpha,gamma,size' AS columns FROM p WHERE k % 3 = 0 UNION ALL SELECT k, '' FROM p WHERE k % 3 <> 0")
def sql_columns(spark, d):
    k = c("p_partkey")
    text = F.when(
        k % 3 == 0,
        F.concat(F.lit("SELECT Alpha, t.beta_x AS b, q.gamma, size as s, 1+2 FROM t"), k.cast("string")),
    ).when(k % 3 == 1, "SELECT * FROM t").otherwise("UPDATE t SET a = 1")
    return B.table(spark, d, "part").select(k.alias("k"), joined(Q.projected_columns(text)).alias("columns"))


KEYWORDS_SQL = "[" + ", ".join(f"'{w}'" for w in X.CALL_KEYWORDS) + "]"
CALLS_SQL = ("array_to_string(list_filter(regexp_extract_all({x}, '([\\p{{L}}\\p{{N}}_]+)\\s*\\(', 1), lambda n: length(n) > 1 AND NOT list_contains(" + KEYWORDS_SQL + ", n)), ',')")


@query("C17", f"SELECT 'page' AS kind, page_id AS id, {CALLS_SQL.format(x='html')} AS names FROM pages UNION ALL SELECT 'document', doc_id, {CALLS_SQL.format(x='text')} FROM documents")
def called(spark, d):
    names = lambda x: joined(X.called_names(c(x))).alias("names")
    pages = B.table(spark, d, "pages").select(F.lit("page").alias("kind"), c("page_id").alias("id"), names("html"))
    docs = B.table(spark, d, "documents").select(F.lit("document").alias("kind"), c("doc_id").alias("id"), names("text"))
    return pages.unionByName(docs)


# ---- rules in model output, context packs -----------------------------------------------------


@query("C18", "SELECT 'src/m' || k || '.py' AS file_path, 'R' || k AS rule_id, 'd' AS description, 0.9::DOUBLE AS confidence_score, 'Val' AS category, 0 AS n_related FROM p WHERE k % 4 = 0 "
              "UNION ALL SELECT 'src/m' || k || '.py', 'RULE-001', 'x ' || k, 0.7, 'General', 0 FROM p WHERE k % 4 = 1 "
              "UNION ALL SELECT 'src/m' || k || '.py', 'Z' || k, '', 0.7, 'General', 0 FROM p WHERE k % 4 = 1 "
              "UNION ALL SELECT 'src/m' || k || '.py', 'Q' || k, '', 0.7, 'General', 2 FROM p WHERE k % 4 = 3 "
              "UNION ALL SELECT 'stray/m' || k || '.py', 'T' || k, 'open', 0.7, 'General', 0 FROM p WHERE k % 5 < 2")
def model_rules(spark, d):
    stray = T.stray_outputs(spark, d)
    return extract_rules.parse_rules(T.model_outputs(spark, d).unionByName(stray)).select(
        "file_path", "rule_id", "description", "confidence_score", "category", F.size("related_entities").alias("n_related")
    )


@query("C19", "WITH e AS (SELECT file_path, i FROM (SELECT file_path, unnest(range(1, doc_id % 40 + 1)) AS i FROM files)), "
              "l AS (SELECT file_path, CAST(least(25, count(*)) AS BIGINT) AS n_listed, string_agg('- function: f' || i, chr(10) ORDER BY i) FILTER (WHERE i <= 25) AS entity_lines FROM e GROUP BY 1) "
              "SELECT f.file_path, CAST(length(text) AS INTEGER) AS n_chars, md5(substr(text, 1, 4000)) AS sample, n_listed, entity_lines FROM files f JOIN l ON l.file_path = f.file_path "
              "WHERE length(text) <= 50000")
def context_packs(spark, d):
    f = B.files(spark, d)
    entities = f.select(
        "file_path", F.explode(F.slice(F.sequence(F.lit(0), c("doc_id") % 40), F.lit(2), (c("doc_id") % 40).cast("int") + 1)).alias("i")
    ).select(
        "file_path", F.lit("function").alias("type"), F.concat(F.lit("f"), c("i").cast("string")).alias("name"),
        (c("i") * 3).alias("line_number"),
    )
    packs = extract_rules.context_packs(f, entities, ("claim", "policy"))
    return packs.select("file_path", "n_chars", F.md5("sample").alias("sample"), "n_listed", "entity_lines")


@query("C20", "SELECT doc_id, md5(CASE WHEN doc_id % 50 = 0 THEN substr(text, 1, 2000) ELSE array_to_string(list_slice(string_split(text, chr(10)), greatest(1, doc_id % 50 - 9), doc_id % 50 + 20), chr(10)) END) AS digest FROM documents")
def snippets(spark, d):
    line = (c("doc_id") % 50).cast("int")
    return B.table(spark, d, "documents").select("doc_id", F.md5(extract_rules.snippet(c("text"), line)).alias("digest"))


@query("C20_related", "SELECT source, target, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY target) AS rank FROM "
                      "(SELECT DISTINCT l_suppkey AS source, l_partkey AS target FROM lineitem)) WHERE rank <= 5")
def related_cut(spark, d):
    pairs = B.supply_calls(spark, d).select(c("caller").alias("source"), c("callee").alias("target")).distinct()
    return first_k(pairs, "source", [c("target")], 5).select("source", "target", "rank")
