"""Text reading, classification and formatting queries (A3-A5, B)."""

from __future__ import annotations

from pyspark.sql import functions as F

from codeloom.catalog import bindings as B
from codeloom.catalog.bindings import pick, sql_pick
from codeloom.catalog.registry import binding, query
from codeloom.functions import classify as C
from codeloom.functions import paths as P
from codeloom.functions import text as X
from codeloom.operators.skew import skew_lookup
from codeloom.sources.corpus import decode

c = F.col


@query("A3", "SELECT doc_id, md5(text) AS digest, CAST(length(text) AS INTEGER) AS n_chars FROM documents "
             "WHERE regexp_matches(text, '\\S')")
def lossy_read(spark, d):
    raw = B.table(spark, d, "documents").select(
        "doc_id", F.concat(F.encode("text", "UTF-8"), F.unhex(F.lit("FFFE"))).alias("content")
    )
    return decode(raw).select("doc_id", F.md5("text").alias("digest"), F.length("text").alias("n_chars"))


@query("A4", "SELECT source, count(*) AS n_files, CAST(sum(strlen(text)) AS BIGINT) AS n_bytes "
             "FROM documents WHERE strlen(text) > 0 GROUP BY 1")
def readable(spark, d):
    size = F.octet_length("text").cast("long")
    return (
        B.table(spark, d, "documents").filter(size > 0).groupBy("source")
        .agg(F.count("*").alias("n_files"), F.sum(size).alias("n_bytes"))
    )


@query("A5", "SELECT page_id, (starts_with(trim(html), '<') AND contains(html, '>') AND contains(html, '</')) AS is_xml FROM pages")
def xml_plausible(spark, d):
    return B.table(spark, d, "pages").select("page_id", X.xml_like(c("html")).alias("is_xml"))


binding(
    "filesx",
    "SELECT *, lower(regexp_extract(file_path, '\\.[^./]+$')) AS ext, regexp_extract(file_path, '[^/]+$') AS fname, "
    "lower(file_path) AS low FROM files",
)

LANG_SQL = "CASE ext " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in P.LANGUAGE_BY_EXT.items()) + " ELSE 'unknown' END"


@query("B1", f"SELECT doc_id, {LANG_SQL} AS language FROM filesx")
def languages(spark, d):
    return B.files(spark, d).select("doc_id", P.language(c("file_path")).alias("language"))


@query("B2", "SELECT doc_id, CASE WHEN ext IN ('.ts', '.js', '.html') AND contains(low, 'angular') THEN 'frontend' "
             "WHEN ext = '.java' AND regexp_matches(low, 'controller|rest|api|endpoint') THEN 'backend' "
             "WHEN ext = '.java' AND contains(low, 'action') THEN 'struts' "
             "WHEN ext IN ('.jsp', '.jsf', '.jspx') THEN 'jsp' "
             "WHEN lower(fname) IN ('struts.xml', 'struts-config.xml', 'web.xml') THEN 'config' "
             "WHEN ext IN ('.java', '.py') THEN 'backend' END AS technology FROM filesx")
def technologies(spark, d):
    return B.files(spark, d).select("doc_id", C.technology(c("file_path")).alias("technology"))


@query("B3", "SELECT doc_id, CASE WHEN fname = 'struts-config.xml' THEN 'struts' WHEN fname IN ('struts.xml', 'struts2.xml') THEN 'struts2' "
             "WHEN regexp_matches(file_path, '\\.(component|service|module)\\.ts$') THEN 'angular' "
             "WHEN ext = '.java' AND doc_id % 3 = 0 THEN 'struts' WHEN ext = '.java' THEN 'struts2' "
             "WHEN ext = '.py' THEN 'python' WHEN ext = '.ts' THEN 'angular' WHEN ext = '.idl' THEN 'corba' "
             "WHEN ext IN ('.xml', '.jsp') THEN 'struts2' END AS parser_kind FROM filesx")
def parser_kinds(spark, d):
    f = B.files(spark, d).withColumn(
        "text", F.concat(F.when(c("doc_id") % 3 == 0, "class A extends DispatchAction\n").otherwise(""), "text")
    )
    return f.select("doc_id", C.parser_kind(c("file_path"), c("text")).alias("parser_kind"))


SIGNS = (
    "class A extends DispatchAction {", "@Result x", "import javax.servlet.http.HttpServletRequest;", "plain",
    "extends ActionSupport",
)


@query("B4", "SELECT doc_id, CASE WHEN doc_id % 7 = 6 THEN 'struts2' WHEN doc_id % 5 IN (0, 2) THEN 'struts' ELSE 'struts2' END AS framework FROM documents")
def java_frameworks(spark, d):
    # every seventh text carries its sign below line one hundred
    k = c("doc_id")
    gap = F.when(k % 7 == 6, F.repeat(F.lit("\n"), F.lit(120))).otherwise("")
    text = F.concat(gap, pick(SIGNS, k % 5), F.lit("\n"), c("text"))
    return B.table(spark, d, "documents").select("doc_id", C.java_framework(text).alias("framework"))


REST_SIGNS = ("@RestController", "x @app.post('/')", "@Path @GET", "class B extends ActionX", "none")


@query("B5", "SELECT doc_id, ['Spring Boot', 'FastAPI', 'JAX-RS', 'Struts', 'Unknown'][(doc_id % 5)::INT + 1] AS framework FROM documents")
def rest_frameworks(spark, d):
    text = F.concat(c("text"), F.lit("\n"), pick(REST_SIGNS, c("doc_id") % 5))
    return B.table(spark, d, "documents").select("doc_id", C.rest_framework(text).alias("framework"))


@query("B6", "SELECT doc_id, regexp_matches(file_path, '\\.(py|java|js|ts|sql|jsp|jsf)$') AS sql_scan, "
             "regexp_matches(file_path, '\\.(ts|js|html|java|jsp|jsf|jspx|xml)$') AS flow_scan FROM files")
def scan_lists(spark, d):
    path = c("file_path")
    return B.files(spark, d).select(
        "doc_id",
        P.scan_allowed(path, P.SQL_SCAN_EXTS).alias("sql_scan"),
        P.scan_allowed(path, P.FLOW_SCAN_EXTS, P.FLOW_PRUNED_DIRS).alias("flow_scan"),
    )


BARE = "regexp_replace(regexp_replace(file_path, '^src/', ''), '\\.[^.]+$', '')"


@query("B7", f"SELECT doc_id, replace({BARE}, '/', '.') AS graph_module, replace(replace({BARE}, '/ui/', '/'), '/', '.') AS builder_module FROM files")
def module_paths(spark, d):
    path = c("file_path")
    return B.files(spark, d).select(
        "doc_id",
        P.module_path(path, P.SKIP_GRAPH).alias("graph_module"),
        P.module_path(path).alias("builder_module"),
    )


@query("B8", "SELECT k, type || ':' || substr(md5(file_path || ':' || type || ':' || name || ':' || line_number), 1, 8) AS entity_id FROM ent")
def entity_ids(spark, d):
    return B.entities(spark, d).select(
        "k", C.entity_id(c("file_path"), c("type"), c("name"), c("line_number")).alias("entity_id")
    )


@query("B9", "SELECT k, file_path || ':' || type || ':' || name AS entity_key FROM ent")
def entity_keys(spark, d):
    return B.entities(spark, d).select("k", C.entity_key(c("file_path"), c("type"), c("name")).alias("entity_key"))


@query("B10", "SELECT k, CASE WHEN regexp_matches(lower(file_path), '\\.js|\\.ts|\\.html|\\.angular|\\.jsp') THEN 'frontend' "
              "WHEN regexp_matches(lower(file_path), '\\.java|\\.py|\\.corba|\\.idl') THEN 'backend' "
              "WHEN regexp_matches(lower(kind), 'database|sql|query') THEN 'data' END AS layer "
              "FROM (SELECT *, CASE WHEN k % 3 = 0 THEN 'sql_query' ELSE type END AS kind FROM ent)")
def layers(spark, d):
    kind = F.when(c("k") % 3 == 0, "sql_query").otherwise(c("type"))
    return B.entities(spark, d).select("k", C.diagram_layer(c("file_path"), kind).alias("layer"))


@query("B11", "SELECT k, CASE WHEN regexp_matches(file_path, 'controller|web|ui|frontend') THEN 'web_applications' "
              "WHEN regexp_matches(file_path, 'service|api|rest|endpoint') THEN 'api_services' "
              "WHEN regexp_matches(file_path, 'repository|dao|database|entity') THEN 'databases' END AS container FROM ent")
def containers(spark, d):
    return B.entities(spark, d).select("k", C.container(c("file_path")).alias("container"))


binding("urls", "SELECT page_id, regexp_replace(url, '[0-9]+', '{id}', 'g') || '/:name/${tok}/' AS url FROM pages")


def _urls(spark, d):
    return B.table(spark, d, "pages").select(
        "page_id",
        F.concat(F.regexp_replace("url", "[0-9]+", "{id}"), F.lit("/:name/${tok}/")).alias("url"),
    )


@query("B12", "SELECT page_id, array_to_string(list_sort(list_distinct(list_concat(list_concat("
              "regexp_extract_all(url, '\\{(\\w+)\\}', 1), regexp_extract_all(url, ':(\\w+)', 1)), "
              "regexp_extract_all(url, '\\$\\{(\\w+)\\}', 1)))), ',') AS params FROM urls")
def url_params(spark, d):
    return _urls(spark, d).select(
        "page_id", F.array_join(F.array_sort(P.url_parameters(c("url"))), ",").alias("params")
    )


@query("B13", "SELECT page_id, (contains(path, '{') OR contains(path, ':')) AS is_dynamic FROM "
              "(SELECT page_id, CASE WHEN page_id % 2 = 0 THEN url ELSE regexp_replace(url, '^https?:', '') END AS path FROM pages)")
def dynamic_urls(spark, d):
    path = F.when(c("page_id") % 2 == 0, c("url")).otherwise(F.regexp_replace("url", "^https?:", ""))
    return B.table(spark, d, "pages").select("page_id", P.is_dynamic_url(path).alias("is_dynamic"))


@query("B14", "SELECT page_id, regexp_replace(trim(url, '/'), '\\{[^}]+\\}|:\\w+|\\$\\{[^}]+\\}', '*', 'g') AS norm_url FROM urls")
def normal_urls(spark, d):
    return _urls(spark, d).select("page_id", P.normal_url(c("url")).alias("norm_url"))


@query("B15", "SELECT page_id, CASE page_id % 3 WHEN 0 THEN 'save' || page_id WHEN 1 THEN 'list' || page_id ELSE 'x.action/' || page_id END AS action FROM pages")
def normal_actions(spark, d):
    k = c("page_id")
    s = k.cast("string")
    raw = (
        F.when(k % 3 == 0, F.concat(F.lit(" /save"), s, F.lit(".action ")))
        .when(k % 3 == 1, F.concat(F.lit("list"), s))
        .otherwise(F.concat(F.lit("/x.action/"), s))
    )
    return B.table(spark, d, "pages").select("page_id", P.normal_action(raw).alias("action"))


STATEMENT_HEADS = ("select a from b", "insert into t select 1", "Update x set y", "drop table z", "hello", "alter create")


@query("B16", "SELECT p_partkey AS k, ['SELECT', 'SELECT', 'UPDATE', 'DROP', 'UNKNOWN', 'CREATE'][(p_partkey % 6)::INT + 1] AS query_type FROM part")
def statement_types(spark, d):
    k = c("p_partkey")
    text = F.concat(pick(STATEMENT_HEADS, k % 6), F.lit(" "), c("p_brand"))
    return B.table(spark, d, "part").select(k.alias("k"), C.statement_type(text).alias("query_type"))


@query("B17", "SELECT rule_id, CASE WHEN confidence_score >= 0.9 THEN 'Very High' WHEN confidence_score >= 0.7 THEN 'High' "
              "WHEN confidence_score >= 0.5 THEN 'Medium' ELSE 'Low' END AS band4, "
              "CASE WHEN confidence_score >= 0.8 THEN 'high' WHEN confidence_score >= 0.6 THEN 'medium' ELSE 'low' END AS band3 FROM doc_rules")
def confidence_bands(spark, d):
    s = c("confidence_score")
    return B.document_rules(spark, d).select(
        "rule_id", C.confidence_band4(s).alias("band4"), C.confidence_band3(s).alias("band3")
    )


@query("B18", "SELECT category, count(*) AS n_entities, CASE WHEN count(*) < 20 THEN 'Low (Simple system)' "
              "WHEN count(*) < 100 THEN 'Medium (Moderate complexity)' WHEN count(*) < 500 THEN 'High (Complex system)' "
              "ELSE 'Very High (Enterprise-scale system)' END AS system_size FROM "
              "(SELECT category FROM ent UNION ALL SELECT CAST(k % 150 AS VARCHAR) FROM ent) GROUP BY 1")
def system_sizes(spark, d):
    e = B.entities(spark, d)
    systems = e.select("category").unionByName(e.select((c("k") % 150).cast("string").alias("category")))
    return systems.groupBy("category").agg(F.count("*").alias("n_entities")).withColumn(
        "system_size", C.system_size(c("n_entities"))
    )


binding("code_files", "SELECT file_path, CAST(sum(complexity) AS BIGINT) AS size_bytes FROM ent GROUP BY 1")


@query("B19", "SELECT k, file_path, size_bytes AS file_size, regexp_extract(file_path, '\\.[^./]+$') AS file_extension FROM ent JOIN code_files USING (file_path)")
def enriched(spark, d):
    e = B.entities(spark, d)
    sizes = e.groupBy("file_path").agg(F.sum("complexity").alias("size_bytes"))
    return skew_lookup(e.select("k", "file_path"), sizes, ["file_path"], ["k"]).select(
        "k", "file_path", c("size_bytes").alias("file_size"), P.suffix(c("file_path")).alias("file_extension")
    )


_before, _done = [], 0
for _w in C.STEP_WEIGHTS.values():
    _before.append(_done)
    _done += _w
_W = "[" + ",".join(map(str, C.STEP_WEIGHTS.values())) + "]"
_BEF = "[" + ",".join(map(str, _before)) + "]"


@query("B20", f"SELECT event_id, least(100, CAST(floor(({_BEF}[(event_id % 17)::INT + 1] + {_W}[(event_id % 17)::INT + 1] "
              f"* CAST(progress AS DOUBLE) / 100) / {_done} * 100) AS INTEGER)) AS overall FROM progress")
def weighted_progress(spark, d):
    return B.progress(spark, d).select("event_id", C.overall_progress(c("step"), c("progress")).alias("overall"))


@query("B21", "SELECT job_id, regexp_extract(repository_path, '[^/]*$') AS repository, CASE status WHEN 'completed' THEN 'success' ELSE status END AS label, "
              "CAST(coalesce(entities_count, 0) AS BIGINT) AS entities, CAST(coalesce(rules_count, 0) AS BIGINT) AS rules FROM jobs")
def job_cards(spark, d):
    return B.jobs(spark, d).select(
        "job_id",
        C.repository_name(c("repository_path")).alias("repository"),
        C.status_label(c("status")).alias("label"),
        F.coalesce("entities_count", F.lit(0)).alias("entities"),
        F.coalesce("rules_count", F.lit(0)).alias("rules"),
    )


@query("B22", "SELECT job_id, CASE WHEN completed_at IS NULL THEN 'In progress' ELSE (epoch(completed_at - created_at)::BIGINT // 60) || 'm ' || "
              "(epoch(completed_at - created_at)::BIGINT % 60) || 's' END AS duration, "
              "CASE WHEN h < 1 THEN (s // 60) || ' minutes ago' WHEN h < 24 THEN h || ' hours ago' ELSE (h // 24) || ' days ago' END AS age FROM "
              "(SELECT *, s // 3600 AS h FROM (SELECT *, epoch((SELECT max(created_at) FROM jobs) - created_at)::BIGINT AS s FROM jobs))")
def durations(spark, d):
    j = B.jobs(spark, d, counts=False)
    now = j.agg(F.max("created_at")).scalar()
    return j.select(
        "job_id",
        C.duration_text(c("created_at"), c("completed_at")).alias("duration"),
        C.relative_time(c("created_at"), now).alias("age"),
    )


_FACTOR = "[0.5, 1.0, 1.5, 2.0][(k % 4)::INT + 1]::DOUBLE"


@query("B23", f"SELECT job_id, m AS minutes, CASE WHEN m < 60 THEN m || ' minutes' ELSE CAST(ceil(m / 60) AS BIGINT) || ' hours' END AS time_text, size_mb FROM "
              f"(SELECT job_id, CAST(ceil(q * 0.1::DOUBLE * {_FACTOR}) AS BIGINT) AS m, CAST(ceil(q * 0.05::DOUBLE * {_FACTOR}) AS BIGINT) AS size_mb "
              f"FROM (SELECT *, coalesce(files_processed, 0) AS q FROM jobs))")
def estimates(spark, d):
    depth = pick(("minimal", "standard", "comprehensive", "exhaustive"), c("k") % 4)
    est = C.run_estimate(F.coalesce("files_processed", F.lit(0)), depth)
    return B.jobs(spark, d).select("job_id", est.alias("e")).select("job_id", "e.*")


@query("B24", "SELECT job_id, repository_path, status FROM jobs WHERE job_id = '7'")
def job_by_id(spark, d):
    return B.jobs(spark, d, counts=False).filter(c("job_id") == "7").select("job_id", "repository_path", "status")


@query("B25", "SELECT p_partkey AS k, substr(regexp_replace(p_name || '-' || p_brand || '.' || p_type, '[^\\w]', '_', 'g'), 1, 20) AS node_id FROM part")
def diagram_ids(spark, d):
    name = F.concat("p_name", F.lit("-"), "p_brand", F.lit("."), "p_type")
    return B.table(spark, d, "part").select(c("p_partkey").alias("k"), P.diagram_id(name).alias("node_id"))


LINT = ("type", "Name", "select", "qty", "where", "metadata", "x1")


@query("B26", "SELECT k, column_name, CASE lower(column_name) WHEN 'type' THEN 'entity_type, record_type, item_type, category' "
              "WHEN 'name' THEN 'entity_name, display_name, title, label' WHEN 'select' THEN 'selection, query_select, choose, pick' "
              "WHEN 'metadata' THEN 'entity_metadata, meta_data, properties, attributes' "
              "ELSE column_name || '_value, ' || column_name || '_data, entity_' || column_name END AS suggestions "
              "FROM (SELECT p_partkey AS k, " + sql_pick(LINT, "p_partkey % 7") + " || CASE WHEN p_partkey % 3 = 0 THEN '' ELSE '_' || p_partkey END AS column_name FROM part) "
              "WHERE lower(column_name) IN ('type', 'name', 'select', 'where', 'metadata')")
def column_lint(spark, d):
    k = c("p_partkey")
    name = F.concat(pick(LINT, k % 7), F.when(k % 3 == 0, "").otherwise(F.concat(F.lit("_"), k.cast("string"))))
    return (
        B.table(spark, d, "part")
        .select(k.alias("k"), name.alias("column_name"))
        .withColumn("suggestions", C.reserved_word_hint(c("column_name")))
        .filter(c("suggestions").isNotNull())
    )


@query("B27", "SELECT k, p[1] || '.' || p[2] AS class_module, p[3] AS class_name, p[1] || '.' || p[2] AS method_module, p[3] AS method_class, "
              "CASE WHEN k % 2 = 0 THEN 'unknown' ELSE 'unknown' END AS bare_module, name AS method_name FROM "
              "(SELECT k, name, string_split(module_path, '.') AS p FROM entm)")
def split_paths(spark, d):
    e = B.entities_in_modules(spark, d)
    cls = P.split_class_path(c("module_path"))
    method = P.split_method_path(F.concat_ws(".", "module_path", "name"))
    return e.select(
        "k", cls.alias("a"), method.alias("b"), P.split_class_path(c("name")).alias("z")
    ).select(
        "k",
        c("a.module_path").alias("class_module"),
        c("a.class_name").alias("class_name"),
        c("b.module_path").alias("method_module"),
        c("b.class_name").alias("method_class"),
        c("z.module_path").alias("bare_module"),
        c("b.method_name").alias("method_name"),
    )
