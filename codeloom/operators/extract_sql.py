"""SQL statements embedded in source text, their tables and columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import statement_type
from codeloom.functions.text import regex_hits
from codeloom.operators.rows import once

# Statement patterns (literal in every match, pattern,
# capturing group, prepared).
STATEMENTS = (
    ("select", r"(?Uis)\b(SELECT\s+.*?FROM\s+\w+.*?)(?:;|\n|\z)", 1, False),
    ("insert", r"(?Uis)\b(INSERT\s+INTO\s+\w+.*?)(?:;|\n|\z)", 1, False),
    ("update", r"(?Uis)\b(UPDATE\s+\w+.*?)(?:;|\n|\z)", 1, False),
    ("delete", r"(?Uis)\b(DELETE\s+FROM\s+\w+.*?)(?:;|\n|\z)", 1, False),
    ("", r"(?i)[\"']([^\"']*(?:SELECT|INSERT|UPDATE|DELETE)[^\"']*)[\"']", 1, False),
    ("prepare", r"(?i)(?:prepareStatement|prepare)\s*\(\s*[\"']([^\"']*)[\"']", 1, True),
    (
        "@namedquery",
        r"(?is)@NamedQuery\s*\(\s*name\s*=\s*[\"']([^\"']*)[\"'].*?query\s*=\s*[\"']([^\"']*)[\"']",
        2,
        False,
    ),
)
TABLE_AFTER = r"(?Ui)\b(?:FROM|INTO|UPDATE|JOIN)\s+(\w+)"
PLACEHOLDER = r"(?U)[?:]\w*|\$\d+|\{\w+\}"
MIN_LENGTH = 10


def _strip(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)^\s+|\s+$", "")


def referenced_tables(text: Column) -> Column:
    names = F.regexp_extract_all(text, F.lit(TABLE_AFTER), F.lit(1))
    kept = F.filter(names, lambda t: ~t.isin("VALUES", "SET", "WHERE"))
    return F.array_sort(F.array_distinct(F.transform(kept, lambda t: F.lower(t))))


def placeholders(text: Column) -> Column:
    return F.transform(
        F.regexp_extract_all(text, F.lit(PLACEHOLDER), F.lit(0)),
        lambda p: F.regexp_replace(p, r"^[?:{}$]+|[?:{}$]+$", ""),
    )


def projected_columns(text: Column) -> Column:
    """Plain column names between the first SELECT and the first FROM."""
    up = F.upper(text)
    lo = F.locate("SELECT", up)
    hi = F.locate("FROM", up)
    part = F.substring(text, lo + 6, F.greatest(hi - lo - 6, F.lit(0)))
    bare = F.transform(
        F.split(part, ","),
        lambda c: F.element_at(
            F.split(_strip(F.regexp_replace(_strip(c), r"(?s) (?:AS|as) .*$", "")), r"\."), -1
        ),
    )
    named = F.transform(F.filter(bare, lambda c: c.rlike(r"(?U)^[\p{L}\p{N}]+$")), lambda c: F.lower(c))
    usable = (lo > 0) & (hi > 0) & ~part.contains("*")
    return F.when(usable, named).otherwise(F.array().cast("array<string>"))


def describe_statements(statements: DataFrame) -> DataFrame:
    """Adds type, tables and parameters to (…, query_text) rows."""
    q = F.col("query_text")
    return statements.withColumns(
        {
            "query_type": statement_type(q),
            "tables": referenced_tables(q),
            "parameters": placeholders(q),
        }
    )


def sql_statements(files: DataFrame) -> DataFrame:
    """Unique statements per (file, line, text), prepared wins over plain.

    The verb, string and prepared patterns overlap; one statement found by
    several of them counts once. Uniqueness is inside a file, so it is settled
    in the row's own array without a shuffle.
    """
    text = F.col("text")

    def found_by(needs: str, pattern: str, group: int, prepared: bool) -> Column:
        return F.transform(
            regex_hits(text, pattern, group, needs),
            lambda h: F.struct(
                h["line"].alias("line_number"),
                _strip(h[f"g{group}"]).alias("query_text"),
                F.lit(prepared).alias("is_prepared"),
            ),
        )

    arrays = [found_by(*statement) for statement in STATEMENTS]
    every = F.filter(F.concat(*arrays), lambda s: F.length(s["query_text"]) >= MIN_LENGTH)
    prepared_only = F.array_distinct(F.filter(F.col("every"), lambda s: s["is_prepared"]))
    plain_only = F.array_distinct(F.filter(F.col("every"), lambda s: ~s["is_prepared"]))
    new_plain = F.filter(
        plain_only,
        lambda s: ~F.exists(
            prepared_only,
            lambda p: (p["line_number"] == s["line_number"]) & (p["query_text"] == s["query_text"]),
        ),
    )
    found = (
        once(files.select("file_path", "text"), "every", every)
        .filter(F.size("every") > 0)
        .select("file_path", F.explode(F.concat(prepared_only, new_plain)).alias("s"))
        .select("file_path", "s.*")
    )
    return describe_statements(found)
