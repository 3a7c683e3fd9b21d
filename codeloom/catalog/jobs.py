"""Job, repository, template, log and streaming-twin queries (A, E1-E5, K)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.catalog import bindings as B
from codeloom.catalog.registry import binding, query
from codeloom.functions import paths as P
from codeloom.operators import metrics as M
from codeloom.operators.resolve import missing_columns
from codeloom.session import shared_dir
from codeloom.sources import corpus, tables
from codeloom.streaming import jobs as S

c = F.col


FOLDERS = ("src", ".git/hooks", "node_modules/x", "venv/lib", "_private", "__pycache__", ".hidden", ".venv", "venvs")
NAMES = ("__init__.py", "_util.py", ".x.js", "a.pyc", "b.class", "README", "c.d.ts", "empty.")


def _scanned(spark, d, full):
    """Planted folders and names before the files of the corpus."""
    k = c("doc_id")
    name = F.when(k % 3 == 0, B.pick(NAMES, k % 8)).otherwise(F.concat_ws("/", F.lit("deep"), F.element_at(F.split("file_path", "/"), -1)))
    rows = B.files(spark, d).select("doc_id", F.concat_ws("/", B.pick(FOLDERS, k % 9), name).alias("path"), F.octet_length("text").cast("long").alias("size_bytes"))
    return rows.filter(corpus.in_scope(c("path"), full)).select("doc_id", P.file_name(c("path")).alias("name"), P.suffix(c("path")).alias("ext"), "size_bytes")


binding(
    "scan",
    "SELECT doc_id, CAST(strlen(text) AS BIGINT) AS size_bytes, " + B.sql_pick(FOLDERS, "doc_id % 9") + " AS folder, CASE WHEN doc_id % 3 = 0 THEN "
    + B.sql_pick(NAMES, "doc_id % 8") + " ELSE regexp_extract(file_path, '[^/]+$') END AS name FROM files",
)
EXT_SQL = "CASE WHEN regexp_matches(name, '^.+\\.[^.]+$') THEN regexp_extract(name, '\\.[^.]+$') ELSE '' END"
SHORT_SQL = "folder NOT IN ('.git/hooks', 'node_modules/x', '__pycache__', '.venv')"


@query("A1", f"SELECT doc_id, name, {EXT_SQL} AS ext, size_bytes FROM scan WHERE {SHORT_SQL} AND folder <> 'venv/lib' AND {EXT_SQL} NOT IN ('.pyc', '.class')")
def full_scan(spark, d):
    """The rules of ``list_files`` on relative paths; names with a leading dot
    or underscore stay."""
    return _scanned(spark, d, True)


@query("A2", f"SELECT {EXT_SQL} AS ext, count(*) AS total_files, CAST(sum(size_bytes) AS BIGINT) AS total_bytes FROM scan WHERE {SHORT_SQL} GROUP BY 1")
def short_scan(spark, d):
    return _scanned(spark, d, False).groupBy("ext").agg(F.count("*").alias("total_files"), F.sum("size_bytes").alias("total_bytes"))


@query("A7", "SELECT level, logger, count(*) AS n, CAST(sum(log_id) AS BIGINT) AS ids FROM logs GROUP BY 1, 2")
def json_logs(spark, d):
    line = F.to_json(
        F.struct(c("ts").alias("timestamp"), "level", "logger", "message", c("log_id").cast("int").alias("line"))
    )
    parsed = tables.parse_json_logs(B.logs(spark, d).select(line.alias("line")))
    return parsed.groupBy("level", "logger").agg(F.count("*").alias("n"), F.sum("line").alias("ids"))


@query("A8", "SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key FROM orders GROUP BY 1")
def table_scan(spark, d):
    schema = "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp"
    t = tables.read_table(spark, f"{d}/orders.parquet", schema)
    return t.groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key"))


def _reports(spark, d):
    """One diagram text per job, named by its job's status."""
    j = B.jobs(spark, d, counts=False)
    return j.select(
        "job_id",
        F.concat(c("status"), F.lit("_flow_diagram.mmd")).alias("filename"),
        F.concat(F.lit("graph TB\n  "), "job_id", F.lit(" --> "), F.replace("repository_path", F.lit("/"), F.lit("_"))).alias("content"),
    )


REPORTS_SQL = ("SELECT job_id, status || '_flow_diagram.mmd' AS filename, 'graph TB' || chr(10) || '  ' || job_id || ' --> ' "
               "|| replace(repository_path, '/', '_') AS content FROM jobs")


@query("A9", REPORTS_SQL)
def reports(spark, d):
    """Written to the shared folder by ``write_reports`` and read back."""
    root = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    tables.write_reports(_reports(spark, d), root)
    return tables.read_reports(spark, root).select("job_id", "filename", "content")


@query("A10", f"SELECT path, replace(fn, '.mmd', '') AS id, CASE split_part(fn, '_', 1) WHEN 'completed' THEN 'Completed' WHEN 'failed' THEN 'Failed' "
              f"ELSE 'Processing' END || ' Flow Diagram' AS name, split_part(fn, '_', 1) || '_flow' AS type, "
              f"'Generated ' || split_part(fn, '_', 1) || ' flow diagram' AS description, content "
              f"FROM (SELECT job_id || '/diagrams/' || filename AS path, filename AS fn, content FROM ({REPORTS_SQL}))")
def diagrams(spark, d):
    from codeloom.operators.reports import diagram_metadata

    root = f"{shared_dir(spark)}/reports/{uuid.uuid4().hex}"
    tables.write_reports(_reports(spark, d), root)
    files = tables.read_reports(spark, root).filter(c("filename").endswith(".mmd"))
    return diagram_metadata(files.select(F.concat_ws("/", "job_id", F.lit("diagrams"), "filename").alias("path"), "content"))


binding(
    "job_events",
    "SELECT job_id, 'pending' AS status, created_at AS ts, 0 AS step FROM jobs "
    "UNION ALL SELECT job_id, 'processing', created_at + INTERVAL 5 SECOND, 1 FROM jobs "
    "UNION ALL SELECT job_id, status, created_at + INTERVAL 60 SECOND, 2 FROM jobs WHERE status <> 'processing'",
)


@query("A11", "SELECT job_id, arg_max(status, step) AS status, max(step) AS step FROM job_events GROUP BY 1")
def job_state(spark, d):
    j = B.jobs(spark, d, counts=False).select("job_id", "status", "created_at")
    at = lambda sec: c("created_at") + F.expr(f"interval {sec} seconds")
    events = (
        j.select("job_id", F.lit("pending").alias("status"), c("created_at").alias("ts"), F.lit(0).alias("step"))
        .unionByName(j.select("job_id", F.lit("processing").alias("status"), at(5).alias("ts"), F.lit(1).alias("step")))
        .unionByName(j.filter(c("status") != "processing").select("job_id", "status", at(60).alias("ts"), F.lit(2).alias("step")))
    )
    return tables.current_state(events, "job_id", ["ts", "step"]).select("job_id", "status", "step")


@query("A12", "SELECT path, min(k) AS first_key FROM (SELECT c_custkey AS k, '/repos/' || (c_custkey % 700) AS path FROM customer) "
              "WHERE path NOT IN (SELECT '/repos/' || s_suppkey FROM supplier) GROUP BY 1")
def insert_repositories(spark, d):
    incoming = B.table(spark, d, "customer").select(
        F.concat(F.lit("/repos/"), (c("c_custkey") % 700).cast("string")).alias("path"), c("c_custkey").alias("k")
    ).groupBy("path").agg(F.min("k").alias("first_key"))
    existing = B.table(spark, d, "supplier").select(F.concat(F.lit("/repos/"), c("s_suppkey").cast("string")).alias("path"))
    return tables.insert_if_absent(incoming, existing, "path")


@query("A13", "WITH old AS (SELECT s_name AS name, s_suppkey AS created, (s_suppkey % 10 = 0) AS dflt FROM supplier), "
              "inc AS (SELECT p_brand || '/' || p_type AS name, max(p_partkey) AS created, bool_or(p_partkey % 50 = 0) AS dflt FROM part GROUP BY 1), "
              "allt AS (SELECT * FROM old UNION ALL SELECT * FROM inc WHERE name NOT IN (SELECT name FROM old)) "
              "SELECT name, created, (dflt AND name = (SELECT name FROM allt WHERE dflt ORDER BY created DESC, name DESC LIMIT 1)) AS is_default FROM allt")
def insert_templates(spark, d):
    old = B.table(spark, d, "supplier").select(
        c("s_name").alias("name"), c("s_suppkey").alias("created_at"), (c("s_suppkey") % 10 == 0).alias("is_default")
    )
    new = (
        B.table(spark, d, "part")
        .groupBy(F.concat_ws("/", "p_brand", "p_type").alias("name"))
        .agg(F.max("p_partkey").alias("created_at"), F.max(c("p_partkey") % 50 == 0).alias("is_default"))
    )
    return tables.merged_templates(old, new).select("name", c("created_at").alias("created"), "is_default")


@query("A14", "SELECT job_id, status FROM jobs WHERE status = 'failed'")
def cleanup(spark, d):
    _, removed = tables.split_by_status(B.jobs(spark, d, counts=False), "failed")
    return removed.select("job_id", "status")


@query("A15", "SELECT o_orderkey, o_orderstatus, CAST(0 AS INTEGER) AS progress_percentage, CAST(0.0 AS DOUBLE) AS o_totalprice, "
              "CAST(NULL AS VARCHAR) AS current_step FROM orders")
def schema_evolution(spark, d):
    old = B.table(spark, d, "orders").select("o_orderkey", "o_orderstatus")
    target = T.StructType.fromDDL(
        "o_orderkey long, o_orderstatus string, progress_percentage int, o_totalprice double, current_step string"
    )
    return tables.align(old, target)


@query("E1", "SELECT count(*) AS total_jobs, count(*) FILTER (WHERE status = 'completed') AS successful_jobs, "
             "count(*) FILTER (WHERE status = 'failed') AS failed_jobs, "
             "round(coalesce(avg(processing_time) FILTER (WHERE status = 'completed'), 0), 4) AS average_processing_time, "
             "CAST(coalesce(sum(entities_count), 0) AS BIGINT) AS total_entities, CAST(coalesce(sum(rules_count), 0) AS BIGINT) AS total_business_rules, "
             "(SELECT count(*) FROM supplier) AS repositories_analyzed FROM jobs")
def platform(spark, d):
    m = M.platform_metrics(B.jobs(spark, d), B.table(spark, d, "supplier"))
    return m.withColumn("average_processing_time", F.round("average_processing_time", 4))


TREND_SQL = ("SELECT strftime(created_at, '%Y-%m-%d') AS date, count(*) AS total, count(*) FILTER (WHERE status = 'completed') AS successful, "
             "count(*) FILTER (WHERE status = 'failed') AS failed, "
             "CAST(sum(CASE WHEN status = 'completed' THEN coalesce(entities_count, 0) ELSE 0 END) AS BIGINT) AS entities, "
             "CAST(sum(CASE WHEN status = 'completed' THEN coalesce(rules_count, 0) ELSE 0 END) AS BIGINT) AS rules FROM jobs "
             "WHERE created_at >= (SELECT max(o_orderdate) FROM orders) - INTERVAL 30 DAY GROUP BY 1")


def _trend(spark, d, days=30):
    """The cut-off day comes from the order table alone and reaches both scans."""
    newest = B.table(spark, d, "orders").agg(F.max("o_orderdate")).scalar()
    recent = B.jobs(spark, d, since=newest - F.expr(f"interval {days} days"))
    return M.daily_trend(recent, days, newest)


@query("E2", TREND_SQL)
def trend(spark, d):
    return _trend(spark, d)


@query("E3", "WITH n AS (SELECT p_type AS language, count(*) AS n FROM lineitem JOIN part ON p_partkey = l_partkey "
             "JOIN supplier ON s_suppkey = l_suppkey GROUP BY 1) SELECT language, round(n / sum(n) OVER () * 100, 2) AS pct FROM n")
def language_share(spark, d):
    return M.language_distribution(B.repositories(spark, d))


@query("E4", "WITH s AS (SELECT CASE WHEN coalesce(files_processed, 0) < 100 THEN 'small' WHEN coalesce(files_processed, 0) < 500 THEN 'medium' ELSE 'large' END AS size, "
             "coalesce(processing_time, 0) AS t FROM jobs WHERE status = 'completed') "
             "SELECT z.size, count(s.size) AS count, round(coalesce(avg(t), 0), 2) AS avg_time FROM (VALUES ('small'), ('medium'), ('large')) z(size) LEFT JOIN s ON s.size = z.size GROUP BY 1")
def performance(spark, d):
    return M.performance_by_size(B.jobs(spark, d))


@query("E5", "SELECT repo, count(*) AS total_files, CAST(sum(CASE WHEN regexp_matches(file_path, '\\.(py|java|js|ts|pl|txt|md)$') THEN n_lines ELSE 0 END) AS BIGINT) AS total_lines, "
             "round(sum(strlen(text)) / (1024 * 1024), 2) AS size_mb, CAST(sum(n_lines) AS BIGINT) AS all_lines FROM "
             "(SELECT *, length(text) - length(replace(text, chr(10), '')) + CASE WHEN length(text) > 0 AND NOT ends_with(text, chr(10)) THEN 1 ELSE 0 END AS n_lines FROM files) GROUP BY 1")
def repo_profiles(spark, d):
    f = B.files(spark, d).select(
        "repo",
        c("file_path").alias("path"),
        F.octet_length("text").cast("long").alias("size_bytes"),
        corpus.line_count(c("text")).cast("long").alias("n_lines"),
    )
    full = M.repository_profile(f, all_lines=True).select("repo", c("total_lines").alias("all_lines"))
    return M.repository_profile(f).join(full, "repo")


@query("E5_extensions", "SELECT repo, regexp_extract(file_path, '\\.[^./]+$') AS ext, count(*) AS n FROM files GROUP BY 1, 2")
def repo_extensions(spark, d):
    return M.extension_counts(B.files(spark, d).select("repo", c("file_path").alias("path")))


@query("E31", "SELECT count(*) FILTER (WHERE level = 'ERROR') AS n_errors, count(*) FILTER (WHERE level = 'WARNING') AS n_warnings, "
              "CASE WHEN count(*) FILTER (WHERE level = 'ERROR') > 10 THEN 'high' WHEN count(*) FILTER (WHERE level = 'ERROR') > 0 THEN 'some' ELSE 'none' END AS error_band, "
              "CASE WHEN count(*) FILTER (WHERE level = 'WARNING') > 20 THEN 'high' ELSE 'normal' END AS warning_band "
              "FROM (SELECT * FROM logs ORDER BY ts DESC, log_id DESC LIMIT 100)")
def log_health(spark, d):
    return M.log_health(B.logs(spark, d))


@query("E34", "SELECT user_id, CASE max(CASE level WHEN 'ERROR' THEN 2 WHEN 'WARNING' THEN 1 ELSE 0 END) WHEN 2 THEN 'unhealthy' WHEN 1 THEN 'degraded' ELSE 'healthy' END AS overall FROM logs GROUP BY 1")
def health(spark, d):
    level = c("level")
    status = F.when(level == "ERROR", "unhealthy: error").when(level == "WARNING", "degraded: slow").otherwise("healthy")
    return M.health_rollup(B.logs(spark, d).select("user_id", status.alias("status")), "user_id")


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations")


@query("E32", " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in TABLES))
def table_rows(spark, d):
    return M.row_counts({t: B.table(spark, d, t) for t in TABLES})


@query("D13", "SELECT DISTINCT event_type AS table_name, unnest(['level', 'm']) AS column_name FROM events")
def schema_diff(spark, d):
    """Keys every event type should carry in its record, minus those found."""
    e = B.table(spark, d, "events")
    expected = e.select(c("event_type").alias("table_name")).distinct().select(
        "table_name", F.explode(F.array(F.lit("k"), F.lit("level"), F.lit("m"))).alias("column_name")
    )
    actual = e.select(
        c("event_type").alias("table_name"), F.explode(F.json_object_keys("props")).alias("column_name")
    ).distinct()
    return missing_columns(expected, actual)


@query("K2", "SELECT job_id, arg_max(step, event_id) AS step, arg_max(progress, event_id) AS progress FROM "
             "(SELECT * FROM progress QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY ts DESC, event_id DESC) = 1) GROUP BY 1")
def latest_progress(spark, d):
    return S.latest_progress(B.progress(spark, d)).select("job_id", "step", "progress")


@query("K3", "SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M') AS window_start, count(*) AS n_lines, count(*) FILTER (WHERE level = 'ERROR') AS n_errors, "
             "count(*) FILTER (WHERE level = 'WARNING') AS n_warnings, CASE WHEN count(*) FILTER (WHERE level = 'ERROR') > 10 THEN 'high' "
             "WHEN count(*) FILTER (WHERE level = 'ERROR') > 0 THEN 'some' ELSE 'none' END AS error_band, "
             "CASE WHEN count(*) FILTER (WHERE level = 'WARNING') > 20 THEN 'high' ELSE 'normal' END AS warning_band FROM logs GROUP BY 1")
def error_rates(spark, d):
    return S.error_rates(B.logs(spark, d)).withColumn("window_start", F.date_format("window_start", "yyyy-MM-dd HH:mm"))


EVENTS = "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


@query("K1", "SELECT job_id, count(*) AS n_updates, max(progress) AS best FROM progress GROUP BY 1")
def incremental(spark, d):
    """Runs the ingest stream over the events files to the end, then reads
    what it landed in the shared folder."""
    import uuid

    from codeloom.session import shared_dir

    root = f"{shared_dir(spark)}/ingest/{uuid.uuid4().hex}"
    extract = lambda batch: B.progress_of(batch)
    S.ingest_new(spark, f"{d}/events.parquet*", EVENTS, extract, f"{root}/out", f"{root}/checkpoint").awaitTermination()
    landed = spark.read.parquet(f"{root}/out")
    return landed.groupBy("job_id").agg(F.count("*").alias("n_updates"), F.max("progress").alias("best"))
