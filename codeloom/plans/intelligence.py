"""The intelligence graph of a corpus: nodes, edges, and what follows."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import entity_hash, entity_id, entity_key
from codeloom.functions.paths import SKIP_BUILDER, language, module_path, stem
from codeloom.operators import resolve as R
from codeloom.operators.skew import by_merge
from codeloom.plans.registry import DEPENDENCY, EXTRACTORS, extract_all
from codeloom.session import cut_lineage


@dataclass
class Graph:
    """``names``: entity_id and name of all nodes, for looking up the ends of
    edges without the parents of ``nodes``."""

    nodes: DataFrame
    edges: DataFrame
    names: DataFrame | None = None


def code_nodes(entities: DataFrame, skip=SKIP_BUILDER) -> DataFrame:
    """Entity rows with ids, keys, module and order.

    ``seq`` is a sortable (path, line, name) key, not a row number: numbering
    all rows would need them in one place.
    """
    path = F.col("file_path")
    made = {
        "entity_id": entity_hash(path, F.col("type"), F.col("name"), F.col("line_number")),
        "label": entity_id(path, F.col("type"), F.col("name"), F.col("line_number")),
        "entity_key": entity_key(path, F.col("type"), F.col("name")),
        "module_path": module_path(path, skip),
        "language": language(path),
        "seq": F.struct(path.alias("p"), F.col("line_number").alias("l"), F.col("name").alias("n")),
        "class_name": F.coalesce(
            F.col("attrs")["parent_class"],
            F.when(F.col("type").isin("method", "function"), F.col("attrs")["class_name"]),
        ),
    }
    # what a file depends on is no entity and needs none of them
    of_entities = {name: F.when(F.col("type") != DEPENDENCY, value) for name, value in made.items()}
    return entities.withColumns(of_entities).withColumn("module_id", F.concat(F.lit("module:"), F.col("module_path")))


def module_nodes(entities: DataFrame) -> DataFrame:
    """One node per module path that holds an entity; of several files of one
    path the first gives the name."""
    return entities.groupBy(F.col("module_id").alias("entity_id"), "module_path").agg(
        F.min("file_path").alias("file_path")
    ).withColumns({"name": stem(F.col("file_path")), "type": F.lit("module")})


NODE_COLUMNS = ["entity_id", "label", "name", "type", "file_path", "module_path", "language", "line_number", "parent_id", "attrs"]


def build(files: DataFrame, dependencies: DataFrame | None = None, extractors=EXTRACTORS, staged: bool = True) -> Graph:
    """``files``: file_path, text. ``dependencies``: further (file_path,
    dependency) rows beside those that the extractors find.

    Entities are written once to the shared folder: every edge kind reads them
    on both sides, and parsing the corpus again each time is the one thing a
    large run cannot afford.
    """
    rows = cut_lineage(code_nodes(extract_all(files, extractors, staged)))
    entities = rows.filter(F.col("type") != DEPENDENCY)
    named = rows.filter(F.col("type") == DEPENDENCY).select("file_path", F.col("name").alias("dependency"))
    if dependencies is not None:
        named = named.unionByName(dependencies)
    edges = inherits(entities).unionByName(calls(entities)).unionByName(depends(entities, named.distinct()))
    nodes, modules = R.parent_ids(entities).select(*NODE_COLUMNS), module_nodes(entities)
    names = entities.select("entity_id", "name").unionByName(modules.select("entity_id", "name"))
    return Graph(nodes.unionByName(modules, allowMissingColumns=True), edges, names)


def inherits(nodes: DataFrame) -> DataFrame:
    refs = nodes.filter(F.col("type") == "class").select(
        F.col("entity_id").alias("source_id"), F.explode("items").alias("ref")
    )
    return _edges(R.base_class_edges(refs, nodes), "inherits")


def calls(nodes: DataFrame) -> DataFrame:
    """From the call nodes of a function's body, so that its own definition
    line is no call."""
    refs = nodes.filter(F.col("type").isin("method", "function") & (F.col("attrs")["calls"] != "")).select(
        F.col("entity_id").alias("source_id"), F.explode(F.split(F.col("attrs")["calls"], ",")).alias("ref")
    )
    return _edges(R.call_edges(refs, nodes), "calls")


def depends(nodes: DataFrame, dependencies: DataFrame) -> DataFrame:
    """Every entity of a file depends on what the file imports.

    Imports are resolved once per distinct name, on the module of the file;
    repeating them per entity would multiply the rows and add nothing.
    """
    homes = nodes.select("file_path").distinct()  # modules exist for files with entities
    refs = dependencies.join(by_merge(homes), "file_path").select(
        F.concat(F.lit("module:"), module_path(F.col("file_path"))).alias("source_id"),
        F.col("dependency").alias("ref"),
    )
    return _edges(R.dependency_edges(cut_lineage(refs), nodes), "depends_on")  # read four times


def _edges(resolved: DataFrame, kind: str) -> DataFrame:
    return resolved.select(
        "source_id", "target_id", F.lit(kind).alias("relationship_type"), F.col("ref").alias("context")
    )
