"""A whole run over a corpus: graph, scores, totals and statements together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import SQL_SCAN_EXTS, scan_allowed
from codeloom.functions.scoring import score_components
from codeloom.operators import metrics as M
from codeloom.operators.extract_sql import sql_statements
from codeloom.operators.resolve import rule_entities
from codeloom.plans.intelligence import Graph, build
from codeloom.session import cut_lineage

RULES = "rule_id string, code_reference string"


@dataclass
class Run:
    """``components``: scored classes, functions, interfaces and structs.
    ``statistics``: totals of the graph. ``modules``: entities and rules by
    module and type. ``statements``: SQL found in the texts. ``placed``: rules
    with the entity that they point at."""

    graph: Graph
    components: DataFrame
    statistics: DataFrame
    modules: DataFrame
    statements: DataFrame
    placed: DataFrame


def _listed(name: str) -> Column:
    parts = F.split(F.coalesce(F.col("attrs")[name], F.lit("")), ",")
    return F.filter(parts, lambda x: x != "").alias(name)


def component_rows(nodes: DataFrame) -> DataFrame:
    """Entities as the scores read them, out of what the extractors found."""
    return nodes.filter(F.col("type") != "module").select(
        "entity_id",
        "type",
        "name",
        "file_path",
        "module_path",
        F.col("attrs")["complexity"].cast("int").alias("complexity"),
        _listed("methods"),
        _listed("base_classes"),
        _listed("inheritance"),
        _listed("patterns").alias("design_patterns"),
        _listed("logic").alias("business_logic_patterns"),
        _listed("calls").alias("function_calls"),
    )


def whole_run(files: DataFrame, rules: DataFrame | None = None) -> Run:
    """``files``: file_path, text. ``rules``: rule_id, code_reference; none
    when left out. Entities are extracted and written once."""
    spark = files.sparkSession
    graph = build(files)
    nodes = cut_lineage(graph.nodes)
    graph = Graph(nodes, cut_lineage(graph.edges), nodes.select("entity_id", "name"))
    entities = component_rows(graph.nodes)
    given = spark.createDataFrame([], RULES) if rules is None else rules
    ordered = graph.nodes.filter(F.col("type") != "module").select(
        "entity_id",
        "file_path",
        "name",
        F.struct(F.col("file_path").alias("p"), F.col("line_number").alias("l"), F.col("name").alias("n")).alias("seq"),
    )
    placed = rule_entities(given, ordered).select("rule_id", "entity_id")
    return Run(
        graph,
        score_components(entities),
        M.graph_statistics(entities, graph.edges, placed),
        M.module_structure(entities, placed),
        sql_statements(files.filter(scan_allowed(F.col("file_path"), SQL_SCAN_EXTS))),
        placed,
    )
