"""Python entities: a thin syntax-tree scan, everything else in Spark.

The only Python row code walks a file's syntax tree and emits one flat row per
node of interest. Classes, functions, complexity, patterns, calls, imports and
all the other records are then joins and aggregations over that node table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.classify import ladder
from codeloom.operators.skew import by_merge
from codeloom.operators.syntax_scan import scan
from codeloom.session import cut_lineage

NODE_SCHEMA = (
    "file_path string, node int, parent int, class_node int, scopes array<int>, kind string, "
    "line int, end_line int, name string, detail string, names array<string>, n int, "
    "flag boolean, flag2 boolean, doc string, source string"
)

# Name fragments behind the pattern and relevance checks.
FACTORY_PARTS = ("create", "build", "make", "get_instance", "factory")
OBSERVER_NAMES = ("notify", "update", "subscribe", "unsubscribe", "add_observer", "remove_observer")
STATE_PARTS = ("status", "state", "mode", "phase")
MONEY_PARTS = ("total", "amount", "price", "cost", "fee", "rate", "discount", "tax", "balance")
ABSTRACT_BASES = ("ABC", "AbstractBase")
MATH_OPS = ("Add", "Sub", "Mult", "Div", "Mod")


def syntax_nodes(files: DataFrame) -> DataFrame:
    """Flat node table of all Python files."""
    return files.select("file_path", "text").mapInArrow(scan, NODE_SCHEMA)


def node_table(files: DataFrame) -> DataFrame:
    """The node table written once to the shared folder.

    The class, method and function records each read it; parsing every file
    again for each of them would cost far more than the write.
    """
    return cut_lineage(syntax_nodes(files))


# ---- records derived in Spark ---------------------------------------------


def _in_scope(nodes: DataFrame) -> DataFrame:
    """Nodes once per enclosing function (a nested one counts for both)."""
    return nodes.withColumn("scope", F.explode("scopes"))


def complexities(nodes: DataFrame) -> DataFrame:
    """(file_path, scope, complexity) per function."""
    step = (
        F.when(F.col("kind").isin("If", "While", "For", "ExceptHandler"), 1)
        .when(F.col("kind") == "BoolOp", F.col("n"))
        .otherwise(0)
    )
    return (
        _in_scope(nodes)
        .groupBy("file_path", "scope")
        .agg(
            (F.lit(1) + F.sum(step)).cast("int").alias("complexity"),
            F.max(F.col("kind") == "If").alias("has_if"),
            F.max((F.col("kind") == "Return") & F.col("flag")).alias("returns_value"),
            # one pass for all that is counted: what is not asked for is pruned
            F.count_if(F.col("kind") == "Call").cast("int").alias("n_calls"),
            F.count_if(F.col("kind") == "Return").cast("int").alias("n_returns"),
            F.count_if(F.col("kind") == "If").cast("int").alias("n_conditions"),
            F.count_if(F.col("kind").isin("For", "While")).cast("int").alias("n_loops"),
            F.count_if(F.col("kind") == "Try").cast("int").alias("n_try"),
        )
    )


def methods(nodes: DataFrame) -> DataFrame:
    """One row per method: owner class, shape and complexity."""
    name = F.col("name")
    magic = name.startswith("__") & name.endswith("__")
    marks = F.split(F.get(F.split("detail", r"\|"), F.lit(0)), ",")
    own = nodes.filter((F.col("kind") == "FunctionDef") & (F.col("class_node") >= 0))
    return own.select(
        "file_path",
        "class_node",
        F.col("node").alias("scope"),
        F.col("name").alias("method"),
        "line",
        name.startswith("_").alias("is_private"),
        magic.alias("is_magic"),
        F.col("flag").alias("has_decorators"),
        F.size("names").alias("n_params"),
        (F.col("n") > 0).alias("has_defaults"),
        F.col("doc").isNotNull().alias("has_doc"),
        F.array_contains(marks, "classmethod").alias("is_class_method"),
        F.array_contains(marks, "staticmethod").alias("is_static_method"),
        F.array_contains(marks, "property").alias("is_property"),
        F.exists(marks, lambda m: m.contains("abstract") & ~m.contains(".") & ~m.contains("(")).alias("is_abstract"),
    ).join(by_merge(complexities(nodes)), ["file_path", "scope"], "left")


def _any(cond):
    return F.coalesce(F.max(cond), F.lit(False))


def classes(nodes: DataFrame) -> DataFrame:
    """One row per class with its method distribution, flags and patterns."""
    low = F.lower(F.col("method"))
    made = F.lit(False)
    for part in FACTORY_PARTS:
        made = made | low.contains(part)
    init = F.col("method") == "__init__"
    count = lambda c: F.count_if(c).cast("int")
    from_methods = (
        methods(nodes)
        .groupBy("file_path", F.col("class_node").alias("node"))
        .agg(
            F.count("*").cast("int").alias("n_methods"),
            F.sum("complexity").cast("int").alias("complexity"),
            count(~F.col("is_private")).alias("public_methods"),
            count(F.col("is_private") & ~F.col("is_magic")).alias("private_methods"),
            count(F.col("is_magic")).alias("magic_methods"),
            count(F.col("is_property")).alias("property_methods"),
            count(F.col("is_class_method")).alias("class_methods"),
            count(F.col("is_static_method")).alias("static_methods"),
            _any(F.col("is_abstract")).alias("abstract_method"),
            _any(init).alias("has_constructor"),
            F.max(F.when(init, F.col("n_params") - 1)).alias("ctor_params"),
            F.max(F.when(init, F.col("complexity"))).alias("ctor_complexity"),
            _any(init & F.col("has_if")).alias("ctor_validates"),
            _any(init & F.col("has_defaults")).alias("ctor_defaults"),
            _any(F.col("method") == "__new__").alias("has_new"),
            _any(made).alias("factory"),
            _any(low.isin(*OBSERVER_NAMES)).alias("observer"),
            _any(low.isin("build", "create")).alias("build_method"),
            count(
                ~low.isin("build", "create")
                & (F.col("method").startswith("with_") | F.col("method").startswith("set_"))
            ).alias("fluent_methods"),
            # method names of one class of one source file
            F.array_sort(F.collect_list(F.struct("line", "method"))).alias("method_list"),
        )
    )
    attributes = (
        nodes.filter((F.col("kind") == "Assign") & (F.col("class_node") >= 0))
        .groupBy("file_path", F.col("class_node").alias("node"))
        .agg(
            F.count("*").cast("int").alias("n_attributes"),
            _any(F.lower("name").contains("instance")).alias("instance_attr"),
            F.array_sort(F.collect_list(F.struct("line", "name"))).alias("attribute_list"),
        )
    )
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    no = lambda c: F.coalesce(F.col(c), F.lit(False))
    n_m, n_a = F.coalesce("n_methods", F.lit(0)), F.coalesce("n_attributes", F.lit(0))
    marks = F.split("detail", ",")
    abstract_base = F.exists("names", lambda b: F.element_at(F.split(b, r"\."), -1).isin(*ABSTRACT_BASES))
    pattern = lambda cond, label: F.when(cond, label)
    return (
        nodes.filter(F.col("kind") == "ClassDef")
        .join(by_merge(from_methods), ["file_path", "node"], "left")
        .join(by_merge(attributes), ["file_path", "node"], "left")
        .select(
            "file_path",
            "node",
            "name",
            F.col("line").alias("line_number"),
            F.col("end_line").alias("end_line_number"),
            F.col("doc").alias("docstring"),
            F.col("names").alias("base_classes"),
            F.col("n").alias("inheritance_depth"),
            F.filter(marks, lambda m: m != "").alias("decorators"),
            n_m.alias("n_methods"),
            n_a.alias("n_attributes"),
            *[
                zero(c)
                for c in (
                    "complexity public_methods private_methods magic_methods property_methods "
                    "class_methods static_methods ctor_params ctor_complexity"
                ).split()
            ],
            no("has_constructor").alias("has_constructor"),
            no("ctor_validates").alias("ctor_validates"),
            no("ctor_defaults").alias("ctor_defaults"),
            (F.array_contains(marks, "dataclass") | ((n_a > n_m) & (n_m <= 3))).alias("is_data_class"),
            (abstract_base | no("abstract_method")).alias("is_abstract_class"),
            F.array_compact(
                F.array(
                    pattern(no("instance_attr") | no("has_new"), "Singleton"),
                    pattern(no("factory"), "Factory"),
                    pattern(no("observer"), "Observer"),
                    pattern(no("build_method") & (F.coalesce("fluent_methods", F.lit(0)) > 2), "Builder"),
                )
            ).alias("design_patterns"),
            F.transform(
                F.coalesce("method_list", F.array().cast("array<struct<line:int,method:string>>")),
                lambda m: m["method"],
            ).alias("methods"),
            F.filter(
                F.flatten(
                    F.transform(
                        F.coalesce("attribute_list", F.array().cast("array<struct<line:int,name:string>>")),
                        lambda a: F.split(a["name"], ","),
                    )
                ),
                lambda a: a != "",
            ).alias("properties"),
        )
    )


def functions(nodes: DataFrame, include_async: bool = False) -> DataFrame:
    """One row per function that is no method (nested ones included)."""
    kinds = ["FunctionDef"] + (["AsyncFunctionDef"] if include_async else [])
    part = lambda i: F.get(F.split("detail", r"\|"), F.lit(i))
    return (
        nodes.filter(F.col("kind").isin(*kinds) & (F.col("class_node") < 0))
        .withColumnRenamed("node", "scope")
        .join(by_merge(complexities(nodes)), ["file_path", "scope"], "left")
        .select(
            "file_path",
            "scope",
            "name",
            F.col("line").alias("line_number"),
            F.col("end_line").alias("end_line_number"),
            F.col("doc").alias("docstring"),
            F.col("names").alias("parameters"),
            F.coalesce("complexity", F.lit(1)).alias("complexity"),
            (F.col("kind") == "AsyncFunctionDef").alias("is_async"),
            F.filter(F.split(part(0), ","), lambda d: d != "").alias("decorators"),
            F.nullif(part(1), F.lit("")).alias("return_type"),
            F.filter(F.split(part(2), ","), lambda d: d != "").alias("parameter_types"),
            F.col("source").alias("source_code"),
            *[
                F.coalesce(c, F.lit(0)).alias(c)
                for c in ("n_calls", "n_returns", "n_conditions", "n_loops", "n_try")
            ],
        )
    )


def _logic_label() -> Column:
    """The kind of business logic that a node is, or null."""
    state = F.lit(False)
    for part in STATE_PARTS:
        state = state | F.lower("detail").contains(part)
    kind = F.col("kind")
    checks = (kind == "If") & (F.col("detail").isin("Compare", "Call") | F.col("flag2"))
    return ladder(
        [
            (checks, "validation"),
            ((kind == "BinOp") & F.col("name").isin(*MATH_OPS), "calculation"),
            ((kind == "Assign") & state, "state_transition"),
        ],
        F.lit(None).cast("string"),
    )


def logic_patterns(nodes: DataFrame) -> DataFrame:
    """Validation, calculation and state-change sites per function."""
    label = _logic_label()
    text = (
        F.when(label == "validation", "Input validation or constraint check")
        .when(label == "calculation", F.concat(F.lit("Mathematical operation: "), F.col("name")))
        .otherwise("State or status change")
    )
    return (
        _in_scope(nodes)
        .withColumns({"pattern": label, "description": text})
        .filter(F.col("pattern").isNotNull())
        .select("file_path", "scope", "line", "pattern", "description")
    )


def calls_and_logic(nodes: DataFrame) -> DataFrame:
    """(file_path, scope, calls, logic): what a function calls, by the last part
    of the name, and the kinds of business logic in it, one for each site; as
    many as its body has. Null where it calls nothing or has no logic."""
    called = F.col("kind") == "Call"
    names = F.collect_set(F.when(called, F.regexp_extract("name", r"[^.]+$", 0)))
    found = nodes.withColumn("pattern", _logic_label()).filter(called | F.col("pattern").isNotNull())
    return _in_scope(found).groupBy("file_path", "scope").agg(
        F.when(F.max(called), F.array_join(names, ",")).alias("calls"),
        F.when(F.count("pattern") > 0, F.array_join(F.sort_array(F.collect_list("pattern")), ",")).alias("logic"),
    )


def function_calls(nodes: DataFrame) -> DataFrame:
    return (
        _in_scope(nodes.filter(F.col("kind") == "Call"))
        .select(
            "file_path",
            "scope",
            "line",
            F.col("name").alias("function"),
            F.col("detail").alias("call_type"),
            F.col("n").alias("arg_count"),
        )
    )


def exception_handlers(nodes: DataFrame) -> DataFrame:
    return _in_scope(nodes.filter(F.col("kind") == "ExceptHandler")).select(
        "file_path", "scope", "line", F.col("name").alias("exception_type"), F.col("flag").alias("handled")
    )


def conditionals(nodes: DataFrame) -> DataFrame:
    """One row per condition; every one counts as business logic."""
    return _in_scope(nodes.filter(F.col("kind") == "If")).select(
        "file_path", "scope", "line", F.col("flag").alias("has_else"), F.lit(True).alias("is_business_logic")
    )


def loops(nodes: DataFrame) -> DataFrame:
    return _in_scope(nodes.filter(F.col("kind").isin("For", "While"))).select(
        "file_path", "scope", "line", F.lower("kind").alias("loop_type"), F.col("flag").alias("has_else")
    )


def try_blocks(nodes: DataFrame) -> DataFrame:
    return _in_scope(nodes.filter(F.col("kind") == "Try")).select(
        "file_path", "scope", "line", F.col("n").alias("n_handlers"), F.col("flag").alias("has_finally"), F.col("flag2").alias("has_else")
    )


def unparsed(nodes: DataFrame) -> DataFrame:
    """Files that could not be parsed, with the reason."""
    return nodes.filter(F.col("kind") == "Unparsed").select("file_path", F.col("name").alias("reason"))


def assignments(nodes: DataFrame) -> DataFrame:
    """One row per assigned name or attribute, with business relevance."""
    money = F.lit(False)
    for part in MONEY_PARTS:
        money = money | F.lower("name").contains(part)
    return _in_scope(nodes.filter(F.col("kind") == "Assign")).select(
        "file_path",
        "scope",
        "line",
        F.explode("names").alias("variable"),
        (F.col("flag") | money).alias("is_business_relevant"),
    )


def returns(nodes: DataFrame) -> DataFrame:
    part = lambda i: F.get(F.split("detail", r"\|", 2), F.lit(i))
    return _in_scope(nodes.filter(F.col("kind") == "Return")).select(
        "file_path", "scope", "line", part(0).alias("return_type"), part(1).alias("description")
    )


def imports(nodes: DataFrame) -> DataFrame:
    return (
        nodes.filter(F.col("kind").isin("Import", "ImportFrom"))
        .select("file_path", F.explode("names").alias("dependency"))
        .distinct()
    )


def of_functions(records: DataFrame, nodes: DataFrame) -> DataFrame:
    """Records of functions that are no methods."""
    plain = nodes.filter((F.col("kind") == "FunctionDef") & (F.col("class_node") < 0)).select(
        "file_path", F.col("node").alias("scope")
    )
    return records.join(plain, ["file_path", "scope"], "left_semi")
