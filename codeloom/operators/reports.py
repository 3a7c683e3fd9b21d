"""Report text from ranked rows: diagram lines, tables and one-liners."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import diagram_layer
from codeloom.functions.paths import diagram_id, stem
from codeloom.operators.ranking import first_k

# Marks by complexity level in diagram labels.
LEVEL_MARKS = {"Very High": "🔥", "High": "⚠️", "Medium": "⚡"}


def edge_line(source: Column, target: Column, confidence: Column, strong: float = 0.7, fair: float = 0.4) -> Column:
    arrow = F.when(confidence > strong, " ==> ").when(confidence > fair, " --> ").otherwise(" -.-> ")
    return F.concat(diagram_id(source), arrow, diagram_id(target))


def component_line(name: Column, kind: Column, level: Column, layer: Column) -> Column:
    mark = F.lit("✅")
    for k, v in LEVEL_MARKS.items():
        mark = F.when(level == k, v).otherwise(mark)
    label = F.concat(F.lit('"'), mark, F.lit(" "), name, F.lit("\\n("), kind, F.lit(')"'))
    boxed = F.when(layer == "data", F.concat(F.lit("[("), label, F.lit(")]"))).otherwise(
        F.concat(F.lit("["), label, F.lit("]"))
    )
    return F.concat(diagram_id(name), boxed, F.lit(":::"), layer)


# Components drawn per layer.
LAYER_CAPS = {"frontend": 15, "backend": 15, "data": 10}


def layer_components(components: DataFrame, order: list[Column]) -> DataFrame:
    """Components drawn per layer of the architecture diagram."""
    layered = components.withColumn("layer", diagram_layer(F.col("file_path"), F.col("type"))).filter(
        F.col("layer").isNotNull()
    )
    top = first_k(layered, "layer", order, max(LAYER_CAPS.values()))
    return top.filter(F.col("rank") <= F.when(F.col("layer") == "data", LAYER_CAPS["data"]).otherwise(15))


def layer_diagram(components: DataFrame, order: list[Column]) -> DataFrame:
    """One text per layer; at most 15 lines each, so the groups are bounded."""
    line = component_line(F.col("name"), F.col("type"), F.col("level"), F.col("layer"))
    return (
        layer_components(components, order)
        .groupBy("layer")
        .agg(F.array_sort(F.collect_list(F.struct("rank", line.alias("line")))).alias("x"))
        .select("layer", F.array_join(F.transform("x", lambda r: r["line"]), "\n").alias("content"))
    )


# Breakdown keys of a run, what they count, and their map layer.
TECHNOLOGIES = (
    ("http_calls", "HTTP calls", "frontend"),
    ("jsp_components", "components", "frontend"),
    ("rest_endpoints", "endpoints", "api"),
    ("struts_actions", "actions", "backend"),
    ("integration_flows", "flows", "integration"),
)


def technology_map(found: DataFrame) -> DataFrame:
    """Map nodes (technology, layer, n, line) out of one row per thing found,
    with its ``technology``; keys without any are left out."""
    counts = found.groupBy("technology").agg(F.count("*").alias("n"))
    facts = {name: F.struct(F.lit(what).alias("what"), F.lit(layer).alias("layer")) for name, what, layer in TECHNOLOGIES}
    known = F.create_map(*[x for k, v in facts.items() for x in (F.lit(k), v)])
    fact = F.element_at(known, F.col("technology"))
    line = F.concat("technology", F.lit("["), F.col("n").cast("string"), F.lit(" "), fact["what"], F.lit("]:::"), fact["layer"])
    return counts.filter(fact.isNotNull()).select("technology", fact["layer"].alias("layer"), "n", line.alias("line"))


def risk_nodes(components: DataFrame, order: list[Column], per_level: int = 8) -> DataFrame:
    """First components per risk level for the risk diagram."""
    top = first_k(components, "risk_level", order, per_level)
    code = F.concat(F.substring("risk_level", 1, 1), F.lit("R"), (F.col("rank") - 1).cast("string"))
    label = F.concat(F.lit('["'), F.col("name"), F.lit("\\n("), F.col("level"), F.lit(' complexity)"]:::'), F.lower("risk_level"))
    return top.select("risk_level", "rank", "name", F.concat(code, label).alias("line"))


def class_members(classes: DataFrame, order: list[Column], n_classes: int = 30, n_members: int = 10) -> DataFrame:
    """First classes with their first members, as diagram lines in order."""
    top = classes.orderBy(*order).limit(n_classes)
    line = lambda mark, arr: F.transform(
        F.slice(F.col(arr), 1, n_members), lambda m: F.concat(F.lit(mark), m, F.lit("()" if mark == "+" else ""))
    )
    return top.select("name", F.posexplode(F.concat(line("+", "methods"), line("-", "properties"))).alias("pos", "line"))


def entity_line(kind: Column, name: Column, path: Column) -> Column:
    return F.concat(F.lit("- "), kind, F.lit(": "), name, F.lit(" in "), path)


def entity_lines(entities: DataFrame, order: list[Column], k: int = 25) -> DataFrame:
    line = entity_line(F.col("type"), F.col("name"), F.col("file_path"))
    return entities.orderBy(*order).limit(k).select(*[c for c in ("seq",) if c in entities.columns], line.alias("line"))


def component_rows(scored: DataFrame, order: list[Column], k: int = 10) -> DataFrame:
    """Markdown rows of the first critical and high components."""
    wanted = scored.filter(F.col("criticality").isin("critical", "high"))
    top = first_k(wanted, "criticality", order, k)
    row = F.concat(
        F.lit("| `"), F.col("name"), F.lit("` | "), F.col("type"), F.lit(" | "),
        F.format_string("%.1f", F.col("complexity_score")), F.lit("/10 | "),
        F.col("effort_hours").cast("string"), F.lit(" | "), F.col("approach"), F.lit(" |"),
    )
    return top.select("criticality", "rank", row.alias("row"))


def diagram_metadata(reports: DataFrame, path: str = "path") -> DataFrame:
    """Id, name and type of a diagram from its file name."""
    sid = stem(F.col(path))
    kind = F.replace(sid, F.lit("_diagram"), F.lit(""))
    return reports.filter(F.col(path).endswith(".mmd")).select(
        path,
        sid.alias("id"),
        F.initcap(F.replace(sid, F.lit("_"), F.lit(" "))).alias("name"),
        kind.alias("type"),
        "content",
        F.concat(F.lit("Generated "), F.replace(kind, F.lit("_"), F.lit(" ")), F.lit(" diagram")).alias("description"),
    )
