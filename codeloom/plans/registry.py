"""Extractor registry: parser kind to a function of files to entity rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import parser_kind
from codeloom.operators import extract_python as P
from codeloom.operators import extract_source as X
from codeloom.operators.rows import NO_ITEMS
from codeloom.operators.skew import by_merge
from codeloom.session import stage

Extractor = Callable[[DataFrame], DataFrame]


#: Type of the rows that name what a file depends on; they are no entities.
DEPENDENCY = "dependency"


def _dependencies(found: DataFrame) -> DataFrame:
    """(file_path, dependency) as rows of the common shape."""
    return found.select(
        "file_path",
        F.lit(DEPENDENCY).alias("type"),
        F.col("dependency").alias("name"),
        F.lit(1).alias("line_number"),
        F.array().cast(NO_ITEMS).alias("items"),
        F.create_map().cast("map<string,string>").alias("attrs"),
    )


def _python(files: DataFrame) -> DataFrame:
    nodes = P.node_table(files)
    cls = P.classes(nodes).select(
        "file_path",
        F.lit("class").alias("type"),
        "name",
        "line_number",
        F.col("base_classes").cast(NO_ITEMS).alias("items"),
        F.create_map(
            F.lit("complexity"), F.col("complexity").cast("string"),
            F.lit("patterns"), F.array_join("design_patterns", ","),
            F.lit("methods"), F.array_join("methods", ","),
            F.lit("base_classes"), F.array_join("base_classes", ","),
            F.lit("docstring"), F.col("docstring"),
        ).alias("attrs"),
    )
    fun = P.functions(nodes).join(by_merge(P.calls_and_logic(nodes)), ["file_path", "scope"], "left").select(
        "file_path",
        F.lit("function").alias("type"),
        "name",
        "line_number",
        F.array().cast(NO_ITEMS).alias("items"),
        F.create_map(
            F.lit("complexity"), F.col("complexity").cast("string"), F.lit("source_code"), F.col("source_code"),
            F.lit("calls"), F.col("calls"), F.lit("docstring"), F.col("docstring"),
            F.lit("parameters"), F.array_join("parameters", ","), F.lit("logic"), F.col("logic"),
        ).alias("attrs"),
    )
    return cls.unionByName(fun).unionByName(_dependencies(P.imports(nodes)))


def _angular(files: DataFrame) -> DataFrame:
    return X.angular_entities(files).unionByName(_dependencies(X.dependencies(files, X.typescript_imports())))


def _corba(files: DataFrame) -> DataFrame:
    return X.idl_entities(files).unionByName(_dependencies(X.dependencies(files, X.idl_dependency_names())))


def _config_classes(files: DataFrame) -> DataFrame:
    configs = X.parse_config(files.filter(F.col("file_path").endswith(".xml")))
    return _dependencies(X.dependencies(configs, X.xml_class_names()))


def _struts2(files: DataFrame) -> DataFrame:
    path = F.col("file_path")
    return (
        X.struts2_xml_entities(files.filter(path.endswith(".xml")))
        .unionByName(X.struts2_class_entities(files.filter(path.endswith(".java"))))
        .unionByName(X.struts2_page_entities(files.filter(path.endswith(".jsp"))))
        .unionByName(_config_classes(files))
        .unionByName(_dependencies(X.dependencies(files.filter(path.endswith(".java")), X.struts2_dependency_names())))
    )


def _struts(files: DataFrame) -> DataFrame:
    path = F.col("file_path")
    return (
        X.struts_xml_entities(files.filter(path.endswith(".xml")))
        .unionByName(X.struts_class_entities(files.filter(path.endswith(".java"))))
        .unionByName(X.struts_page_entities(files.filter(path.endswith(".jsp"))))
        .unionByName(_config_classes(files))
    )


EXTRACTORS: dict[str, Extractor] = {
    "python": _python,
    "angular": _angular,
    "corba": _corba,
    "struts": _struts,
    "struts2": _struts2,
}


def extract_all(
    files: DataFrame, extractors: dict[str, Extractor] = EXTRACTORS, staged: bool = True
) -> DataFrame:
    """Entities of every supported file, and rows of type ``DEPENDENCY`` for
    what a file imports or names.

    Files are routed once and staged by parser kind, so an extractor reads its
    own files and the corpus is not scanned again for each of them. Texts that
    are cheaper to derive than to write need no staging.
    """
    kind = parser_kind(F.col("file_path"), F.col("text"))
    routed = files.select("file_path", "text", kind.alias("parser_kind")).filter(
        F.col("parser_kind").isin(*extractors)
    )
    source = stage(routed, "parser_kind") if staged else routed
    out = None
    for name, extract in extractors.items():
        own = source.filter(F.col("parser_kind") == name).select("file_path", "text")
        rows = extract(own).withColumn("parser_kind", F.lit(name))
        out = rows if out is None else out.unionByName(rows)
    return out
