"""Business rules in model output, and the context packs sent for mining."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.text import line_window
from codeloom.operators.rows import once

RULE_SCHEMA = (
    "array<struct<id:string,description:string,confidence_score:double,category:string,"
    "code_reference:string,validation_logic:string,related_entities:array<string>>>"
)
# Fixed value: JSON array inside a code fence.
FENCE = r"(?is)```(?:json)?\s*\n?(.*?)\n?```"


def top_level_arrays(text: Column) -> Column:
    """Every balanced ``[...]`` span of a text, outermost ones only."""
    gaps = F.split(text, r"[\[\]]", -1)
    marks = F.regexp_extract_all(text, F.lit(r"[\[\]]"), F.lit(0))
    steps = F.zip_with(
        F.transform(F.slice(gaps, F.lit(1), F.size(marks)), lambda g: F.length(g)),
        marks,
        lambda n, b: F.struct(n.alias("n"), b.alias("b")),
    )
    span = "array<struct<lo:int,hi:int>>"
    zero = F.struct(
        F.lit(0).alias("pos"), F.lit(0).alias("depth"), F.lit(0).alias("lo"), F.array().cast(span).alias("spans")
    )

    def step(acc: Column, s: Column) -> Column:
        at = acc["pos"] + s["n"]
        opens, depth = s["b"] == "[", acc["depth"]
        new_depth = F.when(opens, depth + 1).when(depth > 0, depth - 1).otherwise(0)
        lo = F.when(opens & (depth == 0), at).otherwise(acc["lo"])
        closed = ~opens & (depth == 1)
        one = F.array(F.struct(acc["lo"].alias("lo"), at.alias("hi")))
        return F.struct(
            (at + 1).alias("pos"),
            new_depth.alias("depth"),
            lo.alias("lo"),
            F.when(closed, F.concat(acc["spans"], one)).otherwise(acc["spans"]).alias("spans"),
        )

    spans = F.aggregate(steps, zero, step, lambda a: a["spans"])
    return F.transform(spans, lambda x: F.substring(text, x["lo"] + 1, x["hi"] - x["lo"] + 1))


#: From a line that begins an array to the first line that ends one, no other
#: beginning between them.
LINES = r"(?m)^[ \t]*(\[[^\n]*\n(?:(?![ \t]*\[)[^\n]*\n)*?(?![ \t]*\[)[^\n]*(?<!,)\])[ \t\r]*$"
#: Brackets nested once at most, wherever they begin.
SHALLOW = r"\[(?:[^\[\]]++|\[[^\]]*+\])*+\]"


def parse_rules(outputs: DataFrame) -> DataFrame:
    """Rules from ``outputs(file_path, response)``: the fence, the first
    balanced array that parses, an array laid out on lines of its own, or the
    first shallow one, in this order, so that a stray bracket in the prose
    does not lose the rules. Missing fields get their defaults."""
    text = F.col("response")
    fenced = F.regexp_extract(text, FENCE, 1)
    on_lines, shallow = F.regexp_extract_all(text, F.lit(LINES), F.lit(1)), F.regexp_extract_all(text, F.lit(SHALLOW), F.lit(0))
    candidates = F.concat(F.array(fenced), top_level_arrays(text), on_lines, shallow)
    good = F.filter(candidates, lambda c: F.trim(c).rlike(r"(?s)^\[\s*\{") & F.try_parse_json(c).isNotNull())
    return (
        once(outputs.select("file_path", "response"), "chosen", F.get(good, F.lit(0)))
        .filter(F.col("chosen").isNotNull())
        .select("file_path", F.posexplode(F.from_json("chosen", RULE_SCHEMA)).alias("pos", "r"))
        .select(
            "file_path",
            F.coalesce("r.id", F.concat(F.lit("RULE-"), F.lpad((F.col("pos") + 1).cast("string"), 3, "0"))).alias(
                "rule_id"
            ),
            F.coalesce("r.description", F.lit("")).alias("description"),
            F.coalesce("r.confidence_score", F.lit(0.7)).alias("confidence_score"),
            F.coalesce("r.category", F.lit("General")).alias("category"),
            F.coalesce("r.code_reference", F.lit("")).alias("code_reference"),
            F.col("r.validation_logic").alias("validation_logic"),
            F.coalesce("r.related_entities", F.array().cast("array<string>")).alias("related_entities"),
        )
    )


# Limits of a context pack; they are the feature's own bounds.
PACK_MAX_CHARS, PACK_SAMPLE_CHARS, PACK_ENTITIES = 50000, 4000, 25


def context_packs(files: DataFrame, entities: DataFrame, keywords=()) -> DataFrame:
    """Per file: a text sample, its length and the first entities by position.

    The entity list is cut by rank before it is collected, so a file with very
    many entities never becomes one large row.
    """
    from pyspark.sql import Window

    order = Window.partitionBy("file_path").orderBy("line_number", "name", "type")
    line = F.concat(F.lit("- "), F.col("type"), F.lit(": "), F.col("name"))
    listed = (
        entities.withColumn("rn", F.row_number().over(order))
        .filter(F.col("rn") <= PACK_ENTITIES)
        .groupBy("file_path")
        .agg(
            F.count("*").alias("n_listed"),
            F.array_sort(F.collect_list(F.struct("rn", line.alias("line")))).alias("lines"),
        )
        .select(
            "file_path",
            "n_listed",
            F.array_join(F.transform("lines", lambda x: x["line"]), "\n").alias("entity_lines"),
        )
    )
    return (
        files.filter(F.length("text") <= PACK_MAX_CHARS)
        .select(
            "file_path",
            F.length("text").alias("n_chars"),
            F.substring("text", 1, PACK_SAMPLE_CHARS).alias("sample"),
            F.lit(", ".join(keywords)).alias("keywords"),
        )
        .join(listed, "file_path", "inner")
    )


def snippet(text: Column, line: Column) -> Column:
    """Ten lines before to twenty after a line; the opening characters if the
    line is unknown."""
    return F.when(line.isNull() | (line == 0), F.substring(text, 1, 2000)).otherwise(
        line_window(text, line - 9, line + 20)
    )
