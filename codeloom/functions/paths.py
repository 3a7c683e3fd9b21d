"""Columns over file paths, dotted code paths and URLs."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# File extension to language.
LANGUAGE_BY_EXT = {
    ".py": "python",
    ".java": "java",
    ".js": "javascript",
    ".ts": "typescript",
    ".jsx": "react",
    ".tsx": "react-typescript",
    ".jsp": "jsp",
    ".sql": "sql",
    ".xml": "xml",
    ".html": "html",
    ".css": "css",
    ".scss": "scss",
    ".less": "less",
}

# Folders that do not belong to a module path.
SKIP_GRAPH = ("src", "app", "backend", "main", "java", "python")
SKIP_BUILDER = SKIP_GRAPH + ("frontend", "ui")

# Folders never scanned, and suffixes never parsed.
PRUNED_DIRS = (".git", "__pycache__", "node_modules", ".venv", "venv")
BINARY_SUFFIXES = (".pyc", ".class", ".exe", ".dll", ".bin")

# Extensions looked at for SQL text and for integration flows.
SQL_SCAN_EXTS = (".py", ".java", ".js", ".ts", ".sql", ".jsp", ".jsf")
FLOW_SCAN_EXTS = (".ts", ".js", ".html", ".java", ".jsp", ".jsf", ".jspx", ".xml")
FLOW_PRUNED_DIRS = PRUNED_DIRS + ("target", "dist", "build")

# Fixed value: one URL parameter in any of its three spellings.
URL_PARAM = r"\{[^}]+\}|:\w+|\$\{[^}]+\}"


def lookup(mapping: dict, key: Column, default) -> Column:
    """Literal map lookup with a default."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), key), F.lit(default))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last extension with its dot; a leading dot alone is no extension."""
    return F.regexp_extract(file_name(path), r"^.+?(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def has_dir(path: Column, names) -> Column:
    """True when one of the path's folders is listed."""
    dirs = F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0)))
    return F.exists(dirs, lambda d: d.isin(list(names)))


def language(path: Column) -> Column:
    return lookup(LANGUAGE_BY_EXT, F.lower(suffix(path)), "unknown")


def module_path(path: Column, skip=SKIP_BUILDER) -> Column:
    parts = F.filter(F.split(path, "/"), lambda p: (p != "") & (p != "."))
    no_suffix = lambda p: F.regexp_replace(p, r"(?<=.)\.[^.]+$", "")
    bare = lambda ps: F.transform(ps, lambda p, i: F.when(i == F.size(ps) - 1, no_suffix(p)).otherwise(p))
    # one array around the parts, so that no part splits the path again
    kept = F.transform(F.array(parts), lambda ps: F.array_join(F.filter(bare(ps), lambda p: ~p.isin(list(skip))), "."))[0]
    return F.when(kept != "", kept).otherwise(stem(path))


def scan_allowed(path: Column, exts, pruned=PRUNED_DIRS) -> Column:
    allowed = F.lit(False)
    for e in exts:
        allowed = allowed | path.endswith(e)
    return allowed & ~has_dir(path, pruned)


def url_parameters(url: Column) -> Column:
    """Placeholders in {x}, :x, ${x} order, each once."""
    return F.array_distinct(
        F.concat(
            F.regexp_extract_all(url, F.lit(r"\{(\w+)\}"), F.lit(1)),
            F.regexp_extract_all(url, F.lit(r":(\w+)"), F.lit(1)),
            F.regexp_extract_all(url, F.lit(r"\$\{(\w+)\}"), F.lit(1)),
        )
    )


def is_dynamic_url(url: Column) -> Column:
    return url.contains("{") | url.contains(":")


def normal_url(url: Column) -> Column:
    return F.regexp_replace(F.btrim(url, F.lit("/")), URL_PARAM, "*")


def normal_action(url: Column) -> Column:
    bare = F.regexp_replace(F.trim(url), r"^/", "")
    return F.regexp_replace(bare, r"\.action$", "")


def diagram_id(name: Column) -> Column:
    return F.substring(F.regexp_replace(name, r"(?U)[^\w]", "_"), 1, 20)


def split_class_path(path: Column) -> Column:
    """struct(module_path, class_name); no dot means an unknown module."""
    parts = F.split(path, r"\.")
    dotted = path.contains(".")
    return F.struct(
        F.when(dotted, F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), "."))
        .otherwise("unknown").alias("module_path"),
        F.element_at(parts, -1).alias("class_name"),
    )


def split_method_path(path: Column) -> Column:
    parts = F.split(path, r"\.")
    n = F.size(parts)
    return F.struct(
        F.when(n > 2, F.array_join(F.slice(parts, F.lit(1), F.greatest(n - 2, F.lit(0))), "."))
        .otherwise("unknown").alias("module_path"),
        F.when(n > 1, F.try_element_at(parts, F.lit(-2))).otherwise("unknown").alias("class_name"),
        F.element_at(parts, -1).alias("method_name"),
    )
