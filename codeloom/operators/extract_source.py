"""Entities from TypeScript, IDL, web-framework XML, Java and page sources.

Every extractor maps ``files(file_path, text)`` to entity rows in one pass:
hits of all patterns are built as arrays in the row and exploded once, so no
file text is ever shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import ladder
from codeloom.functions.paths import stem
from codeloom.functions.text import bind, contains_any, present, regex_hits, xml_like
from codeloom.operators.rows import entity, explode_entities, first, if_any, once

TEXT = "text"

# ---- TypeScript ------------------------------------------------------------

# Declaration patterns of the Angular extractor.
TS_COMPONENT = r"(?Us)@Component\s*\(\s*\{[^}]*\}\s*\)\s*export\s+class\s+(\w+)"
TS_SERVICE = r"(?Us)@Injectable\s*\(\s*.*?\s*\)\s*export\s+class\s+(\w+)"
TS_MODULE = r"(?Us)@NgModule\s*\(\s*\{[^}]*\}\s*\)\s*export\s+class\s+(\w+)"
TS_INTERFACE = r"(?U)export\s+interface\s+(\w+)"
TS_IMPORT = r"(?U)import\s+.*?\s+from\s+['\"]([^'\"]+)['\"]"


def angular_entities(files: DataFrame) -> DataFrame:
    text = F.col(TEXT)

    def declared(pattern, needs, kind, **attrs):
        return F.transform(regex_hits(text, pattern, needs=needs), lambda h: entity(kind, h["g1"], h["line"], **attrs))

    return explode_entities(
        files,
        declared(TS_COMPONENT, "@component", "component", framework="Angular"),
        declared(TS_SERVICE, "@injectable", "service", framework="Angular"),
        declared(TS_MODULE, "@ngmodule", "module", framework="Angular"),
        declared(TS_INTERFACE, "interface", "interface", language="TypeScript"),
    )


def dependencies(files: DataFrame, names: Column) -> DataFrame:
    """Rows (file_path, dependency) from an array column, each once per file."""
    return files.select("file_path", F.explode(F.array_distinct(names)).alias("dependency"))


def typescript_imports() -> Column:
    return F.regexp_extract_all(F.col(TEXT), F.lit(TS_IMPORT), F.lit(1))


# ---- IDL -------------------------------------------------------------------

# Declaration patterns of the IDL extractor. The look-ahead
# captures the body up to the first closing brace without consuming it.
_BODY = r"\{(?=([^}]*)(\}?))"
IDL_MODULE = r"(?U)module\s+(\w+)\s*\{"
IDL_INTERFACE = r"(?U)interface\s+(\w+)(?:\s*:\s*([\w:,\s]+))?\s*" + _BODY
IDL_METHOD = r"(?U)(\w+(?:\s*::\s*\w+)*)\s+(\w+)\s*\(([^)]*)\)"
IDL_ATTRIBUTE = r"(?U)(?:readonly\s+)?attribute\s+(\w+(?:\s*::\s*\w+)*)\s+(\w+)"
IDL_STRUCT = r"(?U)struct\s+(\w+)\s*" + _BODY
IDL_EXCEPTION = r"(?U)exception\s+(\w+)\s*" + _BODY
IDL_MEMBER = r"(?U)(\w+(?:\s*::\s*\w+)*)\s+(\w+)\s*;"
IDL_TYPEDEF = r"(?U)typedef\s+([\w:<>\[\],\s]+)\s+(\w+)\s*;"
IDL_ENUM = r"(?U)enum\s+(\w+)\s*\{([^}]+)\}"
IDL_INCLUDE = r"#include\s+[<\"]([^>\"]+)[>\"]"
IDL_PARENTS = r"(?U)interface\s+\w+\s*:\s*([\w:,\s]+)\s*\{"


def strip_idl_comments(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(text, r"//[^\n]*", ""), r"(?s)/\*.*?\*/", "")


def _idl_members(body: Column) -> Column:
    return F.transform(regex_hits(body, IDL_MEMBER, 2), lambda m: F.concat_ws(" ", m["g1"], m["g2"]))


def _idl_record(text: Column, pattern: str, kind: str, idl_type: str) -> Column:
    closed = F.filter(regex_hits(text, pattern, 3, idl_type), lambda h: h["g3"] == "}")
    return F.transform(
        closed, lambda h: entity(kind, h["g1"], h["line"], _idl_members(h["g2"]), idl_type=idl_type)
    )


def _idl_interface(h: Column) -> Column:
    """The interface itself followed by its methods and attributes."""
    parents = F.filter(F.transform(F.split(h["g2"], ","), lambda p: F.trim(p)), lambda p: p != "")
    own = entity("corba_interface", h["g1"], h["line"], parents, idl_type="interface")

    def method(m: Column) -> Column:
        before = F.substring(h["g3"], F.greatest(m["start"] - 19, F.lit(1)), F.least(m["start"], F.lit(20)))
        return entity(
            "corba_method",
            F.concat(h["g1"], F.lit("::"), m["g2"]),
            h["line"] + m["line"],
            return_type=m["g1"],
            parameters=F.trim(m["g3"]),
            interface=h["g1"],
            is_oneway=before.contains("oneway").cast("string"),
        )

    def attribute(a: Column) -> Column:
        return entity(
            "corba_attribute",
            F.concat(h["g1"], F.lit("::"), a["g2"]),
            h["line"] + a["line"],
            attribute_type=a["g1"],
            interface=h["g1"],
            is_readonly=a["g0"].startswith("readonly").cast("string"),
        )

    inner = F.concat(
        F.transform(regex_hits(h["g3"], IDL_METHOD, 3), method),
        F.transform(regex_hits(h["g3"], IDL_ATTRIBUTE, 2, "attribute"), attribute),
    )
    nothing = F.filter(inner, lambda _: F.lit(False))
    return F.concat(F.array(own), F.when(h["g4"] == "}", inner).otherwise(nothing))


def idl_entity_array(source: Column) -> Column:
    """All IDL entities of one text as an array."""

    def build(text: Column) -> Column:
        enum_values = lambda h: F.filter(
            F.transform(F.split(h["g2"], ","), lambda v: F.regexp_replace(v, r"(?U)^\s+|\s+$", "")),
            lambda v: v != "",
        )
        return F.concat(
            F.transform(
                regex_hits(text, IDL_MODULE, needs="module"),
                lambda h: entity("corba_module", h["g1"], h["line"], idl_type="module"),
            ),
            F.flatten(F.transform(regex_hits(text, IDL_INTERFACE, 4, "interface"), _idl_interface)),
            _idl_record(text, IDL_STRUCT, "corba_struct", "struct"),
            _idl_record(text, IDL_EXCEPTION, "corba_exception", "exception"),
            F.transform(
                regex_hits(text, IDL_TYPEDEF, 2, "typedef"),
                lambda h: entity(
                    "corba_typedef", h["g2"], h["line"], base_type=F.trim(h["g1"]), idl_type="typedef"
                ),
            ),
            F.transform(
                regex_hits(text, IDL_ENUM, 2, "enum"),
                lambda h: entity("corba_enum", h["g1"], h["line"], enum_values(h), idl_type="enum"),
            ),
        )

    return bind(strip_idl_comments(source), build)


def idl_entities(files: DataFrame) -> DataFrame:
    return explode_entities(files, idl_entity_array(F.col(TEXT)))


def idl_dependency_names() -> Column:
    text = F.col(TEXT)
    parents = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(IDL_PARENTS), F.lit(1)),
            lambda g: F.transform(F.split(g, ","), lambda p: F.regexp_replace(p, r"(?U)^\s+|\s+$", "")),
        )
    )
    return F.concat(F.regexp_extract_all(text, F.lit(IDL_INCLUDE), F.lit(1)), parents)


# Name fragments counted by the IDL roll-up.
CRUD_WORDS = ("create", "read", "update", "delete", "get", "set", "list", "find")
CALLBACK_WORDS = ("callback", "notify", "event", "signal", "observer")
REGISTRY_WORDS = ("registry", "locator", "finder", "resolver", "directory")
# Points per construct, level bounds and report texts.
IDL_POINTS = {"interface": 5, "inheritance": 10, "struct": 3, "enum": 1}
IDL_LEVELS = ((15, "Low"), (40, "Medium"), (80, "High"))
SMALL_STRUCT = 10
OPPORTUNITIES = {
    "interfaces": "Convert %d CORBA interfaces to REST APIs",
    "crud": "%d interfaces are candidates for RESTful API conversion",
    "structs": "Modernize %d data structures to JSON/XML schemas",
    "small": "%d structs are suitable for JSON serialization",
}
SPLIT_UP = "Large interface count suggests microservices decomposition opportunities"
TOO_SYNCHRONOUS = "Heavy reliance on synchronous calls - consider async patterns"
USES_CALLBACKS = "Callback patterns detected - consider event-driven architecture"
COMPLEX_DATA = "Many complex data structures may require careful schema design"
NOT_JSON = "Some data structures may not directly map to JSON"
PHASED = "High complexity detected - recommend phased migration approach"
GATEWAY = "Consider creating API gateway to abstract CORBA complexity during transition"
DIRECT = "Moderate complexity - direct migration to REST APIs feasible"
INTERFACE_STEPS = (
    "Migrate %d CORBA interfaces using these strategies:",
    "  1. Create REST API endpoints for each interface method",
    "  2. Implement request/response DTOs based on existing structs",
    "  3. Add proper error handling and status codes",
)
STRUCT_STEPS = (
    "Data structure migration strategy:",
    "  1. Convert CORBA structs to JSON schemas or DTOs",
    "  2. Validate data transformation mappings",
    "  3. Consider using OpenAPI/Swagger for API documentation",
)
ALTERNATIVES = (
    "Consider modern alternatives:",
    "  - REST APIs with JSON for simple request/response patterns",
    "  - gRPC for high-performance, strongly-typed service communication",
    "  - GraphQL for flexible data querying requirements",
    "  - Message queues (Kafka/RabbitMQ) for asynchronous communication",
)
IDL_PRIORITIES = (
    ("Very High", 20, "High Priority - Complex legacy system requiring immediate attention"),
    ("High", 10, "Medium Priority - Significant modernization effort required"),
    ("Medium", 5, "Low Priority - Manageable migration effort"),
)
IDL_SIMPLE = "Very Low Priority - Simple migration candidate"
BASIC_TYPES = ("string", "long", "short", "boolean", "double", "float", "char")


def _idl_counts(parts: Column) -> Column:
    """struct of counts over one file's interfaces, structs and enums."""
    interfaces, structs, enums = parts["interfaces"], parts["structs"], parts["enums"]
    named = lambda ws: F.size(
        F.filter(interfaces, lambda x: contains_any(F.lower(x["name"]), ws))
    )
    basic = lambda m: contains_any(F.lower(m), BASIC_TYPES)
    json_ok = lambda s: (F.size(s["items"]) > 0) & F.forall(s["items"], basic)
    pts = IDL_POINTS
    inheriting = F.size(F.filter(interfaces, lambda x: F.size(x["items"]) > 0))
    points = (
        F.size(interfaces) * pts["interface"]
        + inheriting * pts["inheritance"]
        + F.size(structs) * pts["struct"]
        + F.size(enums) * pts["enum"]
    )
    return F.struct(
        points.alias("points"),
        F.size(interfaces).alias("n_interfaces"),
        F.size(structs).alias("n_structs"),
        F.size(enums).alias("n_enums"),
        named(CRUD_WORDS).alias("crud_interfaces"),
        named(CALLBACK_WORDS).alias("callback_interfaces"),
        named(REGISTRY_WORDS).alias("registry_interfaces"),
        F.size(F.filter(structs, lambda s: F.size(s["items"]) <= SMALL_STRUCT)).alias("small_structs"),
        F.size(F.filter(structs, json_ok)).alias("json_structs"),
    )


def idl_rollup(files: DataFrame) -> DataFrame:
    """Migration roll-up per IDL file, computed in the row (no shuffle)."""

    def parts(e: Column) -> Column:
        of = lambda k: F.filter(e, lambda x: x["type"] == k)
        return F.struct(
            of("corba_interface").alias("interfaces"),
            of("corba_struct").alias("structs"),
            of("corba_enum").alias("enums"),
        )

    def counted_text(kind: str, number: Column) -> Column:
        return F.when(number > 0, F.format_string(OPPORTUNITIES[kind], number))

    c = F.col
    oneway = F.regexp_count(F.lower(strip_idl_comments(c(TEXT))), F.lit("oneway"))
    entities = once(files, "e", idl_entity_array(c(TEXT))).select("file_path", "e", oneway.alias("async_calls"))
    level, n_if, n_st, small = c("level"), c("n_interfaces"), c("n_structs"), c("small_structs")
    return (
        once(entities, "m", bind(parts(c("e")), _idl_counts))
        .select("file_path", "m.*", "async_calls")
        .filter((n_if > 0) | (n_st > 0) | (c("n_enums") > 0))
        .withColumns(
            {
                "level": ladder([(c("points") < top, name) for top, name in IDL_LEVELS], "Very High"),
                "sync_calls": n_if - c("async_calls"),
                "complex_structs": n_st - small,
            }
        )
        .withColumns(
            {
                "opportunities": present(
                    counted_text("interfaces", n_if),
                    counted_text("crud", c("crud_interfaces")),
                    counted_text("structs", n_st),
                    counted_text("small", small),
                    F.when(n_if > 5, SPLIT_UP),
                ),
                "challenges": present(
                    F.when(c("sync_calls") > c("async_calls"), TOO_SYNCHRONOUS),
                    F.when(c("callback_interfaces") > 0, USES_CALLBACKS),
                    F.when(c("complex_structs") > small, COMPLEX_DATA),
                    F.when(c("json_structs") < n_st / 2, NOT_JSON),
                ),
                "recommendations": present(
                    F.when(level.isin("High", "Very High"), PHASED).otherwise(DIRECT),
                    F.when(level.isin("High", "Very High"), GATEWAY),
                    *(F.when(n_if > 0, F.format_string(step, n_if) if "%d" in step else F.lit(step)) for step in INTERFACE_STEPS),
                    *(F.when(n_st > 0, F.lit(step)) for step in STRUCT_STEPS),
                    *map(F.lit, ALTERNATIVES),
                ),
                "migration_priority": ladder(
                    [((level == name) | (n_if > many), text) for name, many, text in IDL_PRIORITIES], IDL_SIMPLE
                ),
            }
        )
    )


# ---- web framework XML -----------------------------------------------------

_RESULT = "array<struct<_name:string,_type:string,_location:string,_VALUE:string>>"
_REFS = "array<struct<_name:string>>"
_ACTIONS = (
    f"array<struct<_name:string,_class:string,_method:string,_path:string,_type:string,"
    f"result:{_RESULT},`interceptor-ref`:{_REFS}>>"
)
_PACKAGE = (
    f"array<struct<_name:string,_namespace:string,_extends:string,action:{_ACTIONS},"
    f"`global-results`:struct<result:{_RESULT}>,"
    f"interceptors:struct<interceptor:array<struct<_name:string,_class:string>>,"
    f"`interceptor-stack`:array<struct<_name:string,`interceptor-ref`:{_REFS}>>>>>"
)
CONFIG_SCHEMA = (
    f"package {_PACKAGE}, action {_ACTIONS}, "
    f"`action-mappings` struct<action:{_ACTIONS},`action-mapping`:array<struct<_path:string,_type:string>>>"
)


def parse_config(files: DataFrame) -> DataFrame:
    """``doc`` struct per well-formed web-framework XML file."""
    # A document type line adds nothing to the data and needs no fetching.
    body = F.regexp_replace(F.col(TEXT), r"(?is)<!DOCTYPE[^>\[]*(\[[^\]]*\])?[^>]*>", "")
    parsed = F.from_xml(body, CONFIG_SCHEMA, {"mode": "PERMISSIVE"})
    return (
        once(files.filter(xml_like(F.col(TEXT))), "doc", parsed)
        .select("file_path", "doc")
        .filter(F.col("doc").isNotNull())
    )


def _list(value: Column, ddl: str) -> Column:
    return F.coalesce(value, F.array().cast(ddl))


def _all_actions() -> Column:
    doc = F.col("doc")
    in_packages = F.flatten(
        F.transform(_list(doc["package"], _PACKAGE), lambda p: _list(p["action"], _ACTIONS))
    )
    return F.concat(
        in_packages, _list(doc["action"], _ACTIONS), _list(doc["action-mappings"]["action"], _ACTIONS)
    )



def struts_xml_entities(files: DataFrame) -> DataFrame:
    """Actions with their results, and old-style mappings."""

    def action(a: Column) -> Column:
        name = F.coalesce(a["_name"], F.lit("unnamed"))
        own = entity(
            "struts_action",
            name,
            F.lit(1),
            action_class=F.coalesce(a["_class"], F.lit("")),
            method=F.coalesce(a["_method"], F.lit("execute")),
            framework="Struts2",
        )
        results = F.transform(
            _list(a["result"], _RESULT),
            lambda r: entity(
                "struts_result",
                F.concat(name, F.lit("_"), F.coalesce(r["_name"], F.lit("success"))),
                F.lit(1),
                result_type=F.coalesce(r["_type"], F.lit("dispatcher")),
                parent_action=name,
            ),
        )
        return F.concat(F.array(own), results)

    mapping = F.transform(
        _list(F.col("doc")["action-mappings"]["action-mapping"], "array<struct<_path:string,_type:string>>"),
        lambda m: entity(
            "struts_mapping",
            F.coalesce(m["_path"], F.lit("")),
            F.lit(1),
            action_class=F.coalesce(m["_type"], F.lit("")),
            framework="Struts1",
        ),
    )
    return explode_entities(parse_config(files), F.flatten(F.transform(_all_actions(), action)), mapping)


def struts2_xml_entities(files: DataFrame) -> DataFrame:
    """Packages, their actions, interceptor use, global results and stacks."""
    packages = _list(F.col("doc")["package"], _PACKAGE)

    def package(p: Column) -> Column:
        pname = F.coalesce(p["_name"], F.lit("default"))
        space = F.coalesce(p["_namespace"], F.lit("/"))
        own = entity(
            "struts2_package",
            pname,
            F.lit(1),
            namespace=space,
            extends=F.coalesce(p["_extends"], F.lit("struts-default")),
        )

        def action(a: Column) -> Column:
            aname = F.coalesce(a["_name"], F.lit("unnamed"))
            refs = F.filter(
                _list(a["interceptor-ref"], _REFS), lambda r: F.coalesce(r["_name"], F.lit("")) != ""
            )
            return F.concat(
                F.array(
                    entity(
                        "struts2_action",
                        F.concat_ws(".", pname, aname),
                        F.lit(1),
                        action_class=F.coalesce(a["_class"], F.lit("")),
                        method=F.coalesce(a["_method"], F.lit("execute")),
                        package=pname,
                        namespace=space,
                    )
                ),
                F.transform(
                    refs,
                    lambda r: entity(
                        "struts2_interceptor_ref",
                        F.concat(aname, F.lit("_interceptor_"), r["_name"]),
                        F.lit(1),
                        interceptor=r["_name"],
                        action=aname,
                    ),
                ),
            )

        shared = F.transform(
            _list(p["global-results"]["result"], _RESULT),
            lambda r: entity(
                "struts2_global_result",
                F.concat(F.lit("global_"), F.coalesce(r["_name"], F.lit("success"))),
                F.lit(1),
                result_type=F.coalesce(r["_type"], F.lit("dispatcher")),
            ),
        )
        stacks = F.transform(
            _list(
                p["interceptors"]["interceptor-stack"],
                f"array<struct<_name:string,`interceptor-ref`:{_REFS}>>",
            ),
            lambda s: entity(
                "struts2_interceptor_stack",
                F.coalesce(s["_name"], F.lit("")),
                F.lit(1),
                F.transform(
                    _list(s["interceptor-ref"], _REFS), lambda r: F.coalesce(r["_name"], F.lit(""))
                ),
            ),
        )
        return F.concat(
            F.array(own),
            F.flatten(F.transform(_list(p["action"], _ACTIONS), action)),
            shared,
            stacks,
        )

    return explode_entities(parse_config(files), F.flatten(F.transform(packages, package)))


def xml_class_names() -> Column:
    """Classes named by actions and interceptors of a parsed config."""
    interceptors = F.flatten(
        F.transform(
            _list(F.col("doc")["package"], _PACKAGE),
            lambda p: _list(p["interceptors"]["interceptor"], "array<struct<_name:string,_class:string>>"),
        )
    )
    return F.filter(
        F.concat(
            F.transform(_all_actions(), lambda a: a["_class"]),
            F.transform(interceptors, lambda i: i["_class"]),
        ),
        lambda c: F.coalesce(c, F.lit("")) != "",
    )


def xml_web_actions(files: DataFrame) -> DataFrame:
    """Named XML actions with a class, and their result pages as a map."""
    usable = F.filter(
        _all_actions(),
        lambda a: (F.coalesce(a["_name"], F.lit("")) != "") & (F.coalesce(a["_class"], F.lit("")) != ""),
    )

    def pages(a: Column) -> Column:
        # The last result of a name wins, as in a dictionary.
        rs = F.transform(
            _list(a["result"], _RESULT),
            lambda r: F.struct(
                F.coalesce(r["_name"], F.lit("success")).alias("k"),
                F.coalesce(r["_VALUE"], r["_location"], F.lit("")).alias("v"),
            ),
        )
        last = F.filter(
            rs,
            lambda r, i: ~F.exists(
                F.slice(rs, i + 2, F.greatest(F.size(rs) - i - 1, F.lit(0))), lambda o: o["k"] == r["k"]
            ),
        )
        return F.map_from_entries(last)

    return (
        parse_config(files)
        .select("file_path", F.explode(usable).alias("a"))
        .select(
            "file_path",
            F.col("a._name").alias("name"),
            F.col("a._class").alias("class_name"),
            F.coalesce("a._method", F.lit("execute")).alias("method"),
            F.concat(F.lit("/"), F.col("a._name")).alias("path"),
            pages(F.col("a")).alias("result_pages"),
            F.lit(0).alias("line_number"),
        )
    )


# ---- Java and pages of the web frameworks ----------------------------------

# Patterns of the two Java web-framework extractors.
STRUTS_CLASS = r"(?U)public\s+class\s+(\w+)\s+extends\s+(Action|ActionSupport)"
STRUTS_METHOD = r"(?U)public\s+\w+\s+(\w+)\s*\([^)]*\)\s*(?:throws\s+[^{]+)?\s*\{"
STRUTS2_CLASS = r"(?U)(?:@\w+(?:\([^)]*\))?\s*)*public\s+class\s+(\w+)"
STRUTS2_ANNOTATION = r"(?U)@(\w+)(?:\(([^)]*)\))?"
STRUTS2_ACTION_METHOD = r"(?U)@Action\s*(?:\([^)]*\))?\s*public\s+\w+\s+(\w+)\s*\("
STRUTS2_VALIDATION = r"(?U)public\s+void\s+(validate\w*)\s*\("
JAVA_IMPORT = r"(?U)import\s+([\w\.]+);"
STRUTS2_IMPORT = r"(?U)import\s+(org\.apache\.struts2[.\w]+);"
STRUTS2_MARKER = r"@(Action|Result|Results|Namespace|ParentPackage)\s*\("
PAGE_TAG = r"(?U)<s:(\w+)[^>]*>"
PAGE_OGNL = r"%\{([^}]+)\}"


def struts_class_entities(files: DataFrame) -> DataFrame:
    text = F.col(TEXT)
    cls = first(regex_hits(text, STRUTS_CLASS, 2))
    own = if_any(
        cls,
        lambda c: entity(
            "struts_action_class",
            c["g1"],
            c["line"],
            base_class=c["g2"],
            framework=F.when(c["g2"] == "Action", "Struts").otherwise("Struts2"),
        ),
    )
    wanted = F.filter(
        regex_hits(text, STRUTS_METHOD),
        lambda m: F.lower(m["g1"]).contains("execute") | m["g1"].isin("input", "validate"),
    )
    methods = F.flatten(
        if_any(
            cls,
            lambda c: F.transform(
                wanted,
                lambda m: entity(
                    "struts_method", F.concat_ws(".", c["g1"], m["g1"]), m["line"], parent_class=c["g1"]
                ),
            ),
        )
    )
    return explode_entities(files.filter(text.contains("extends Action")), own, methods)


def struts2_class_entities(files: DataFrame) -> DataFrame:
    text = F.col(TEXT)
    cls = first(regex_hits(text, STRUTS2_CLASS))
    own = if_any(
        cls,
        lambda c: entity(
            "struts2_action_class",
            c["g1"],
            c["line"],
            F.regexp_extract_all(F.substring(text, F.lit(1), c["start"]), F.lit(STRUTS2_ANNOTATION), F.lit(1)),
            framework="Struts2",
        ),
    )

    def members(pattern, kind, **attrs):
        return F.flatten(
            if_any(
                cls,
                lambda c: F.transform(
                    regex_hits(text, pattern),
                    lambda m: entity(
                        kind, F.concat_ws(".", c["g1"], m["g1"]), m["line"], parent_class=c["g1"], **attrs
                    ),
                ),
            )
        )

    marked = files.filter(text.contains("extends ActionSupport") | text.contains("@Action"))
    return explode_entities(
        marked,
        own,
        members(STRUTS2_ACTION_METHOD, "struts2_action_method", annotation="@Action"),
        members(STRUTS2_VALIDATION, "struts2_validation_method"),
    )


def java_framework_imports() -> Column:
    names = F.regexp_extract_all(F.col(TEXT), F.lit(JAVA_IMPORT), F.lit(1))
    return F.filter(names, lambda n: contains_any(F.lower(n), ("struts", "apache")))


def struts2_dependency_names() -> Column:
    text = F.col(TEXT)
    marker = F.when(text.rlike(STRUTS2_MARKER), "org.apache.struts2.convention.annotation")
    return F.concat(present(marker), F.regexp_extract_all(text, F.lit(STRUTS2_IMPORT), F.lit(1)))


def page_tags(text: Column, pattern: str = PAGE_TAG) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(1))


def struts_page_entities(files: DataFrame) -> DataFrame:
    tags = page_tags(F.col(TEXT))
    found = if_any(
        F.when(F.size(tags) > 0, tags),
        lambda t: entity(
            "struts_jsp",
            stem(F.col("file_path")),
            F.lit(1),
            F.array_sort(F.array_distinct(t)),
            tag_count=F.size(t).cast("string"),
        ),
    )
    return explode_entities(files, found)


def struts2_page_entities(files: DataFrame) -> DataFrame:
    text = F.col(TEXT)
    tags = page_tags(text)
    ognl = F.regexp_extract_all(text, F.lit(PAGE_OGNL), F.lit(1))
    both = F.when((F.size(tags) > 0) | (F.size(ognl) > 0), F.struct(tags.alias("t"), ognl.alias("o")))
    found = if_any(
        both,
        lambda b: entity(
            "struts2_jsp",
            stem(F.col("file_path")),
            F.lit(1),
            F.array_sort(F.array_distinct(b["t"])),
            tag_count=F.size(b["t"]).cast("string"),
            ognl_count=F.size(b["o"]).cast("string"),
            # the first ten expressions are what the feature keeps
            ognl=F.array_join(F.slice(b["o"], 1, 10), "|"),
        ),
    )
    return explode_entities(files, found)
