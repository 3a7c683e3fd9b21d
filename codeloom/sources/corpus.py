"""File corpora: recursive scan, lossy text, size and name filters."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.functions.paths import BINARY_SUFFIXES, PRUNED_DIRS, file_name, has_dir, suffix
from codeloom.functions.text import lossy_utf8, newlines
from codeloom.session import cut_lineage
from codeloom.sources import folders


def in_scope(inside: Column, full: bool = True) -> Column:
    """The scan's rules on a path relative to the corpus root.

    The full profile also skips virtual environments and binary suffixes; the
    short one is what a quick repository check uses.
    """
    pruned = PRUNED_DIRS if full else PRUNED_DIRS[:-1]
    kept = ~has_dir(inside, pruned)
    return kept & ~suffix(inside).isin(*BINARY_SUFFIXES) if full else kept


def list_files(spark: SparkSession, root: str, full: bool = True, pattern: str | None = None) -> DataFrame:
    """Files under ``root`` without their content: (path, name, ext,
    size_bytes, error), hidden and empty ones included.

    Folders are listed in tasks, one level of the tree at a time, and pruned
    by their place below the root alone. ``error`` names what kept a folder or
    file from being read; such rows can be counted.
    """
    base = root.rstrip("/") or "/"
    inside = F.substr("path", F.lit(len(base) + 2))
    frontier, levels = spark.createDataFrame([(base,)], "path string"), []
    while True:
        found = frontier.mapInArrow(folders.children, "path string, is_dir boolean, size_bytes long, error string")
        levels.append(cut_lineage(found))
        frontier = levels[-1].filter(F.col("is_dir") & in_scope(F.concat(inside, F.lit("/x")), full)).select("path")
        if frontier.isEmpty():
            break
        frontier = frontier.repartition("path")
    files = reduce(DataFrame.unionByName, levels).filter(~F.col("is_dir") & in_scope(inside, full))
    if pattern:
        files = files.filter(excluded(file_name(F.col("path")), [pattern]))
    path = F.col("path")
    return files.select(path, file_name(path).alias("name"), suffix(path).alias("ext"), "size_bytes", "error")


def read_files(listed: DataFrame) -> DataFrame:
    """(path, size_bytes, error, content) of listed files."""
    spread = listed.select("path", "size_bytes", "error").repartition("path")
    return spread.mapInArrow(folders.contents, "path string, size_bytes long, error string, content binary")


def excluded(path: Column, patterns) -> Column:
    """Glob-style exclusion (``*`` and ``?``) on the whole path."""
    out = F.lit(False)
    for p in patterns:
        regex = "".join({"*": ".*", "?": "."}.get(ch, "\\" + ch if not ch.isalnum() else ch) for ch in p)
        out = out | path.rlike(f"(^|/){regex}($|/)")
    return out


def read_texts(
    spark: SparkSession,
    root: str,
    full: bool = True,
    exclude=(),
    max_bytes: int | None = None,
    pattern: str | None = None,
) -> DataFrame:
    """Non-blank source texts: (file_path, size_bytes, n_lines, text).

    Files that cannot be read are left out; ``read_files`` gives their errors.
    """
    files = list_files(spark, root, full, pattern).filter(F.col("size_bytes") > 0)
    if exclude:
        files = files.filter(~excluded(F.col("path"), exclude))
    if max_bytes:
        files = files.filter(F.col("size_bytes") <= max_bytes)
    return decode(read_files(files).filter(F.col("content").isNotNull())).select(
        F.col("path").alias("file_path"), "size_bytes", line_count(F.col("text")).alias("n_lines"), "text"
    )


def decode(files: DataFrame, content: str = "content") -> DataFrame:
    """Adds ``text``; rows that are blank after lossy decoding are dropped."""
    return files.withColumn("text", lossy_utf8(F.col(content))).filter(F.col("text").rlike(r"(?U)\S"))


def line_count(text: Column) -> Column:
    """Lines as an iterating reader counts them: a last line needs no break."""
    breaks = newlines(text)
    return breaks + F.when((F.length(text) > 0) & ~text.endswith("\n"), 1).otherwise(0)
