"""Labels and formats: technology, framework, layer, status, durations."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from codeloom.functions.paths import file_name, lookup, suffix
from codeloom.functions.text import contains_any

# Statement verbs in the order they are looked for.
SQL_VERBS = ("SELECT", "INSERT", "UPDATE", "DELETE", "CREATE", "DROP", "ALTER")

# Phrases that give a Java web framework away.
STRUTS2_SIGNS = (
    "extends ActionSupport",
    "import org.apache.struts2",
    "@Action",
    "@Result",
    "com.opensymphony.xwork2",
)
STRUTS1_SIGNS = (
    "extends Action",
    "import org.apache.struts.action",
    "extends DispatchAction",
    "import javax.servlet.http.HttpServletRequest",
)

# Generation steps and their weights, in run order.
STEP_WEIGHTS = {
    "initializing": 2,
    "analyzing_repository": 4,
    "parsing_files": 14,
    "analyzing_database_usage": 5,
    "analyzing_integration_flows": 6,
    "extracting_business_rules": 15,
    "generating_overview": 8,
    "generating_api_docs": 6,
    "generating_business_rules_docs": 4,
    "generating_architecture_docs": 6,
    "generating_database_docs": 3,
    "generating_integration_docs": 4,
    "generating_migration_dashboard": 3,
    "generating_enhanced_docs": 25,
    "generating_diagrams": 4,
    "saving_documentation": 3,
    "finalizing": 2,
}

# Job status to the label shown.
STATUS_LABELS = {
    "completed": "success",
    "processing": "processing",
    "failed": "failed",
    "pending": "pending",
    "success": "success",
}

# Effort multiplier by requested depth.
DEPTH_FACTORS = {"minimal": 0.5, "standard": 1.0, "comprehensive": 1.5, "exhaustive": 2.0}

# Words that make poor column names, and what to use instead.
RESERVED_WORDS = (
    "metadata", "registry", "mapper", "class_registry", "__mapper__", "__table__", "__tablename__",
    "__mapper_args__", "__table_args__", "__abstract__", "__mapper_cls__", "select", "insert", "update",
    "delete", "from", "where", "join", "inner", "outer", "left", "right", "on", "as", "table", "column",
    "index", "primary", "foreign", "key", "constraint", "unique", "not", "null", "default", "check",
    "references", "cascade", "class", "def", "if", "else", "elif", "for", "while", "try", "except",
    "finally", "with", "import", "lambda", "return", "yield", "raise", "assert", "del", "pass", "break",
    "continue", "global", "nonlocal", "and", "or", "in", "is", "type", "id", "name", "value", "data",
    "info", "config",
)
WORD_ALTERNATIVES = {
    "metadata": ("entity_metadata", "meta_data", "properties", "attributes"),
    "type": ("entity_type", "record_type", "item_type", "category"),
    "id": ("entity_id", "record_id", "identifier", "pk"),
    "data": ("entity_data", "content", "payload", "information"),
    "config": ("configuration", "settings", "options", "params"),
    "info": ("information", "details", "meta_info", "properties"),
    "name": ("entity_name", "display_name", "title", "label"),
    "value": ("entity_value", "content_value", "data_value", "amount"),
    "class": ("entity_class", "classification", "category", "group"),
    "table": ("data_table", "table_name", "table_ref", "relation"),
    "column": ("column_name", "field_name", "attribute", "property"),
    "select": ("selection", "query_select", "choose", "pick"),
    "update": ("modification", "change", "revision", "edit"),
    "delete": ("removal", "deletion", "destroy", "remove"),
    "insert": ("addition", "creation", "new_record", "add"),
}


def ladder(rules, default) -> Column:
    """First rule that holds wins: ``[(condition, label), ...]``."""
    out = None
    for cond, label in rules:
        out = F.when(cond, label) if out is None else out.when(cond, label)
    return out.otherwise(default)


def technology(path: Column) -> Column:
    low = F.lower(path)
    ext = F.lower(suffix(path))
    java = ext == ".java"
    return ladder(
        [
            (ext.isin(".ts", ".js", ".html") & low.contains("angular"), "frontend"),
            (java & contains_any(low, ("controller", "rest", "api", "endpoint")), "backend"),
            (java & low.contains("action"), "struts"),
            (ext.isin(".jsp", ".jsf", ".jspx"), "jsp"),
            (F.lower(file_name(path)).isin("struts.xml", "struts-config.xml", "web.xml"), "config"),
            (ext.isin(".java", ".py"), "backend"),
        ],
        F.lit(None).cast("string"),
    )


def java_framework(text: Column) -> Column:
    """Decided on the first hundred lines, as the feature is defined."""
    head = F.array_join(F.slice(F.split(text, "\n", 101), 1, 100), "\n")
    return ladder(
        [(contains_any(head, STRUTS2_SIGNS), "struts2"), (contains_any(head, STRUTS1_SIGNS), "struts")],
        "struts2",
    )


def parser_kind(path: Column, text: Column) -> Column:
    name = file_name(path)
    ext = F.lower(suffix(path))
    return ladder(
        [
            (name == "struts-config.xml", "struts"),
            (name.isin("struts.xml", "struts2.xml"), "struts2"),
            (
                path.endswith(".component.ts") | path.endswith(".service.ts") | path.endswith(".module.ts"),
                "angular",
            ),
            (suffix(path) == ".java", java_framework(text)),
            (ext == ".py", "python"),
            (ext == ".ts", "angular"),
            (ext == ".idl", "corba"),
            (ext.isin(".java", ".xml", ".jsp"), "struts2"),
        ],
        F.lit(None).cast("string"),
    )


def rest_framework(text: Column) -> Column:
    return ladder(
        [
            (contains_any(text, ("@RestController", "@RequestMapping")), "Spring Boot"),
            (contains_any(text, ("@app.get", "@app.post")), "FastAPI"),
            (text.contains("@Path") & text.contains("@GET"), "JAX-RS"),
            (text.contains("extends Action"), "Struts"),
        ],
        "Unknown",
    )


def diagram_layer(path: Column, kind: Column) -> Column:
    low = F.lower(path)
    return ladder(
        [
            (contains_any(low, (".js", ".ts", ".html", ".angular", ".jsp")), "frontend"),
            (contains_any(low, (".java", ".py", ".corba", ".idl")), "backend"),
            (contains_any(F.lower(kind), ("database", "sql", "query")), "data"),
        ],
        F.lit(None).cast("string"),
    )


def container(path: Column) -> Column:
    low = F.lower(path)
    return ladder(
        [
            (contains_any(low, ("controller", "web", "ui", "frontend")), "web_applications"),
            (contains_any(low, ("service", "api", "rest", "endpoint")), "api_services"),
            (contains_any(low, ("repository", "dao", "database", "entity")), "databases"),
        ],
        F.lit(None).cast("string"),
    )


def statement_type(text: Column) -> Column:
    up = F.upper(text)
    return ladder([(up.contains(v), v) for v in SQL_VERBS], "UNKNOWN")


def confidence_band4(score: Column) -> Column:
    return ladder([(score >= 0.9, "Very High"), (score >= 0.7, "High"), (score >= 0.5, "Medium")], "Low")


def confidence_band3(score: Column) -> Column:
    return ladder([(score >= 0.8, "high"), (score >= 0.6, "medium")], "low")


def system_size(n_entities: Column) -> Column:
    return ladder(
        [
            (n_entities < 20, "Low (Simple system)"),
            (n_entities < 100, "Medium (Moderate complexity)"),
            (n_entities < 500, "High (Complex system)"),
        ],
        "Very High (Enterprise-scale system)",
    )


def overall_progress(step: Column, within: Column) -> Column:
    """Weighted percent done; earlier steps count in full."""
    before, done = {}, 0
    for name, weight in STEP_WEIGHTS.items():
        before[name] = done
        done += weight
    reached = lookup(before, step, None) + lookup(STEP_WEIGHTS, step, None) * within / 100
    return F.least(F.lit(100), F.floor(reached / done * 100).cast("int"))


def status_label(status: Column) -> Column:
    return lookup(STATUS_LABELS, status, "pending")


def repository_name(path: Column) -> Column:
    last = F.element_at(F.split(path, "/"), -1)
    return F.when(last != "", last).otherwise("Unknown")


def duration_text(start: Column, end: Column) -> Column:
    sec = F.timestamp_diff("SECOND", start, end)
    text = F.concat(
        F.floor(sec / 60).cast("string"), F.lit("m "), F.pmod(sec, F.lit(60)).cast("string"), F.lit("s")
    )
    return F.when(end.isNull(), "In progress").otherwise(text)


def relative_time(ts: Column, now: Column) -> Column:
    sec = F.timestamp_diff("SECOND", ts, now)
    hours = F.floor(sec / 3600)
    return (
        F.when(hours < 1, F.concat(F.floor(sec / 60).cast("string"), F.lit(" minutes ago")))
        .when(hours < 24, F.concat(hours.cast("string"), F.lit(" hours ago")))
        .otherwise(F.concat(F.floor(hours / 24).cast("string"), F.lit(" days ago")))
    )


def processing_text(seconds: Column) -> Column:
    whole = F.floor(seconds)
    return (
        F.when(seconds < 60, F.concat(F.format_string("%.1f", seconds), F.lit("s")))
        .when(
            seconds < 3600,
            F.concat(F.floor(whole / 60).cast("string"), F.lit("m "), (whole % 60).cast("string"), F.lit("s")),
        )
        .otherwise(
            F.concat(
                F.floor(whole / 3600).cast("string"),
                F.lit("h "),
                F.floor((whole % 3600) / 60).cast("string"),
                F.lit("m"),
            )
        )
    )


def run_estimate(n_files: Column, depth: Column) -> Column:
    """struct(minutes, time_text, size_mb) for a run over ``n_files`` files."""
    factor = lookup(DEPTH_FACTORS, depth, 1.0)
    minutes = F.ceil(n_files * 0.1 * factor)
    return F.struct(
        minutes.alias("minutes"),
        F.when(minutes < 60, F.concat(minutes.cast("string"), F.lit(" minutes")))
        .otherwise(F.concat(F.ceil(minutes / 60).cast("string"), F.lit(" hours"))).alias("time_text"),
        F.ceil(n_files * 0.05 * factor).alias("size_mb"),
    )


def reserved_word_hint(name: Column) -> Column:
    """Suggested replacements for a reserved name, null when the name is fine."""
    low = F.lower(name)
    fallback = F.concat(name, F.lit("_value, "), name, F.lit("_data, entity_"), name)
    listed = {word: ", ".join(others) for word, others in WORD_ALTERNATIVES.items()}
    hint = F.coalesce(lookup(listed, low, None), fallback)
    return F.when(low.isin(*RESERVED_WORDS), hint)


def entity_id(path: Column, kind: Column, name: Column, line: Column) -> Column:
    digest = F.md5(F.concat_ws(":", path, kind, name, line.cast("string")))
    return F.concat(kind, F.lit(":"), F.substring(digest, 1, 8))


def entity_hash(path: Column, kind: Column, name: Column, line: Column) -> Column:
    """Like ``entity_id`` with the whole digest: safe as a join key."""
    return F.concat(kind, F.lit(":"), F.md5(F.concat_ws(":", path, kind, name, line.cast("string"))))


def entity_key(path: Column, kind: Column, name: Column) -> Column:
    return F.concat_ws(":", path, kind, name)
