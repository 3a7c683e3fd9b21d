"""HTTP calls, REST endpoints, web actions and page components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.classify import rest_framework
from codeloom.functions.paths import is_dynamic_url, normal_action, url_parameters
from codeloom.functions.text import char_window, regex_hits
from codeloom.operators.rows import first, once

TEXT = "text"

# Client call, endpoint, action and page patterns.
HTTP_CLIENT = r"(?i)(?:httpClient|http)\.(get|post|put|delete|patch)\s*\(\s*['\"`]([^'\"`]*)['\"`]"
AJAX = (
    r"(?is)\$\.(?:ajax|get|post)\s*\(\s*[{'\"`].*?url\s*:\s*['\"`]([^'\"`]*)['\"`]"
    r".*?type\s*:\s*['\"`]([^'\"`]*)['\"`]"
)
REQUEST_MAPPING = (
    r"(?Uis)@RequestMapping\s*\(\s*value\s*=\s*['\"`]([^'\"`]*)['\"`].*?method\s*=\s*RequestMethod\.(\w+)"
)
VERB_MAPPING = r"(?Uis)@%sMapping\s*\(\s*['\"`]([^'\"`]*)['\"`]\s*\).*?public.*?(\w+)\s*\("
FASTAPI = r"(?Uis)@app\.%s\s*\(\s*['\"`]([^'\"`]*)['\"`]\s*\).*?def\s+(\w+)"
ACTION_CLASS = r"(?Ui)class\s+(\w+)\s+extends\s+(?:Action|ActionSupport)"
ACTION_MARK = r"(?i)@Action\s*\(\s*value\s*=\s*['\"`]([^'\"`]*)['\"`]"
RESULT_MARK = r"(?i)@Result\s*\(\s*location\s*=\s*['\"`]([^'\"`]*)['\"`]"
PAGE_PATTERNS = (
    ("form", "<form", r"(?i)<form[^>]*action\s*=\s*['\"`]([^'\"`]*)['\"`][^>]*>"),
    ("link", "href", r"(?i)<a[^>]*href\s*=\s*['\"`]([^'\"`]*)['\"`][^>]*>"),
    ("form", "<s:form", r"(?i)<s:form[^>]*action\s*=\s*['\"`]([^'\"`]*)['\"`][^>]*>"),
    ("link", "<s:url", r"(?i)<s:url[^>]*action\s*=\s*['\"`]([^'\"`]*)['\"`][^>]*>"),
    ("button", "<h:commandbutton", r"(?i)<h:commandButton[^>]*action\s*=\s*['\"`]([^'\"`]*)['\"`][^>]*>"),
)
PAGE_INPUT = r"(?i)<input[^>]*name\s*=\s*['\"]([^'\"]*)['\"][^>]*>"

# Declarations looked for backwards (per line, in this order)
# and forwards (whole rest of the text, in this order).
FUNCTION_ABOVE = (
    r"(?U)function\s+(\w+)",
    r"(?U)(\w+)\s*\(\s*\)\s*\{",
    r"(?U)public\s+\w+\s+(\w+)\s*\(",
    r"(?U)def\s+(\w+)\s*\(",
)
CLASS_ABOVE = (r"(?U)class\s+(\w+)",)
FUNCTION_BELOW = (
    r"(?U)public\s+\w+\s+(\w+)\s*\(",
    r"(?U)def\s+(\w+)\s*\(",
    r"(?U)function\s+(\w+)",
)
ENDPOINT_PARAMS = (
    r"(?U)@RequestParam\s*\(\s*['\"](\w+)['\"]",
    r"(?U)@PathVariable\s*\(\s*['\"](\w+)['\"]",
    r"(?U)@RequestBody\s+\w+\s+(\w+)",
)


def _found(text: Column, pattern: str) -> Column:
    name = F.regexp_extract(text, pattern, 1)
    return F.when(name != "", name)


def declarations(text: Column, patterns) -> Column:
    """array<struct<line,name>> of the lines that declare something."""
    named = F.transform(
        F.split(text, "\n", -1),
        lambda s, i: F.struct(
            (i + 1).alias("line"), F.coalesce(*[_found(s, p) for p in patterns]).alias("name")
        ),
    )
    return F.filter(named, lambda d: d["name"].isNotNull())


# ---- marks: what a text holds, as rows in the order of their places ---------------------


def _mark(kind: str | Column, at: Column, until: Column, line: Column, name: Column) -> Column:
    plain = (F.lit(kind) if isinstance(kind, str) else kind, at.cast("int"), until.cast("int"), line.cast("int"), name.cast("string"))
    return F.struct(*(v.alias(n) for v, n in zip(plain, ("kind", "at", "until", "line", "name"))))


def _marks(hits: Column, kind: str | None = None) -> Column:
    """Hits as marks of ``kind``, or each of the kind that its group names."""
    return F.transform(hits, lambda h: _mark(h["g1"] if kind is None else kind, h["start"], h["end"], h["line"], h["g1"]))


def _beginnings(text: Column, pattern: str, kind: str, needs: str = "") -> Column:
    """Marks of a pattern at every place where it may begin: only its first
    word is taken, the rest is looked ahead at, so that no match hides another."""
    flags, word = pattern[: pattern.index(")") + 1], pattern[pattern.index(")") + 1 : pattern.index("\\s")]
    rest = pattern[len(flags) + len(word) :]
    return _marks(regex_hits(text, f"{flags}{word}(?={rest})", needs=needs or word), kind)


def _declared(text: Column, patterns, kind: str) -> Column:
    none = F.lit(None)
    return F.transform(declarations(text, patterns), lambda d: _mark(kind, none, none, d["line"], d["name"]))


def _last(kind: str, value: Column) -> Column:
    return F.last(F.when(F.col("kind") == kind, value), ignorenulls=True)


def _above(kind: str) -> Column:
    """Name of the last mark of a kind at or above the row's line."""
    return _last(kind, F.col("name")).over(Window.partitionBy("file_path").orderBy("line"))


def _below(kind: str, value: Column, place: Column) -> Column:
    """``value`` of the first mark of a kind at or after the row's place."""
    return _last(kind, value).over(Window.partitionBy("file_path").orderBy(place.desc()))


def _function_below(place: Column) -> Column:
    """The next function; the order of the patterns decides, not the distance."""
    return F.coalesce(*[_below(f"f{i}", F.col("name"), place) for i in range(len(FUNCTION_BELOW))])


#: Files whose marks meet in one task of the windows.
FILES = 10_000


def _by_file(rows: DataFrame, files: DataFrame) -> DataFrame:
    """``rows`` laid by file, in as many tasks as ``files`` ask for: what a task
    sorts keeps its size when the corpus grows, whatever the session's number
    of shuffle partitions."""
    tasks = max(files.sparkSession.sparkContext.defaultParallelism, -(-files.count() // FILES))
    return rows.repartition(tasks, "file_path")


def brace_ends(marks: DataFrame) -> DataFrame:
    """``marks`` (file_path, kind, at) with ``closes``: where the brace that a
    ``{`` row opens closes, null for other rows and where it never does.

    The depth is a running sum; a brace and the one that closes it are
    neighbours among the braces of equal depth.
    """
    kind = F.col("kind")
    step = F.when(kind == "{", 1).when(kind == "}", -1).otherwise(0)
    depth = F.sum(step).over(Window.partitionBy("file_path").orderBy("at", "until"))
    level = F.when(kind == "{", F.col("_depth") - 1).when(kind == "}", F.col("_depth"))
    pairs = Window.partitionBy("file_path", "_level").orderBy("at", "until")
    after = F.lead(F.when(kind == "}", F.col("at"))).over(pairs)
    return (
        marks.withColumn("_depth", depth)
        .withColumn("_level", level)
        .withColumn("closes", F.when(kind == "{", after))
        .drop("_depth", "_level")
    )


def http_calls(files: DataFrame) -> DataFrame:
    """Client calls with the function and class above them; the two client
    patterns overlap, so equal rows of a file are one.

    Calls and declarations become rows once, and a running value over them by
    line finds the last declaration, so a call costs the same however many
    declarations its file has.
    """
    text = F.col(TEXT)
    hit = lambda h, method, url: F.struct(
        h["line"].alias("line_number"), F.upper(method).alias("method"), url.alias("url")
    )
    found = F.concat(
        F.transform(regex_hits(text, HTTP_CLIENT, 2, "http"), lambda h: hit(h, h["g1"], h["g2"])),
        F.transform(regex_hits(text, AJAX, 2, "$."), lambda h: hit(h, h["g2"], h["g1"])),
    )
    call = lambda h: F.struct(F.lit("call").alias("kind"), h["line_number"].cast("int").alias("line"), F.lit(None).cast("string").alias("name"), h.alias("c"))
    empty = F.lit(None).cast("struct<line_number:int,method:string,url:string>").alias("c")

    def declared(kind: str, patterns) -> Column:
        return F.transform(
            declarations(text, patterns),
            lambda d: F.struct(F.lit(kind).alias("kind"), d["line"].cast("int").alias("line"), d["name"].alias("name"), empty),
        )

    rows = F.concat(F.transform("found", call), declared("function", FUNCTION_ABOVE), declared("class", CLASS_ABOVE))
    marks = (
        once(files.select("file_path", TEXT), "found", found)
        .filter(F.size("found") > 0)
        .select("file_path", F.explode(rows).alias("m"))
        .select("file_path", "m.*")
    )
    return (
        _by_file(marks, files)
        .withColumns({"context_function": _above("function"), "context_class": _above("class")})
        .filter(F.col("kind") == "call")
        .select("file_path", "c.*", "context_function", "context_class")
        .distinct()
        .withColumn("parameters", url_parameters(F.col("url")))
        .withColumn("is_dynamic_url", is_dynamic_url(F.col("url")))
    )


#: Characters before and after an endpoint in which its parameters are named.
REACH = 500


def _parameters_near() -> Column:
    """Names in the window of the row's place: by pattern, then by place. A
    name that the window cuts is cut, a mark that begins before it is not seen."""
    near = F.collect_list(F.when(F.col("kind").startswith("p"), F.struct("at", "until", "kind", "name")))
    return near.over(Window.partitionBy("file_path").orderBy("at").rangeBetween(-REACH, REACH - 1))


def _cut_names(near: Column, at: Column) -> Column:
    end = at + REACH
    last = f"p{len(ENDPOINT_PARAMS) - 1}"  # ends with its name, the others with a quote

    def of(kind: str) -> Column:
        whole = lambda p: (p["until"] <= end) | ((F.lit(kind) == last) & (p["until"] - F.length(p["name"]) < end))
        own = F.array_sort(F.filter(near, lambda p: (p["kind"] == kind) & whole(p)))
        return F.transform(own, lambda p: F.left(p["name"], F.length(p["name"]) - F.greatest(p["until"] - end, F.lit(0))))

    return F.concat(*[of(f"p{i}") for i in range(len(ENDPOINT_PARAMS))])


def rest_endpoints(files: DataFrame) -> DataFrame:
    """Endpoints with their handler, its class and the parameters nearby.

    Endpoints, functions, classes and parameters become rows once; handlers,
    classes and parameters are then values of windows over their places.
    """
    text = F.col(TEXT)
    kind = "array<struct<line:int,method:string,path:string,handler:string,start:int,until:int>>"

    def hit(h: Column, method: Column, handler: Column) -> Column:
        return F.struct(h["line"].alias("line"), method.alias("method"), h["g1"].alias("path"), handler.alias("handler"), h["start"].alias("start"), h["end"].alias("until"))

    none = F.lit(None).cast("string")
    arrays = [F.transform(regex_hits(text, REQUEST_MAPPING, 2, "@requestmapping"), lambda h: hit(h, F.upper(h["g2"]), none))]

    def declared(pattern: str, needs: str, verb: str) -> Column:
        hits = regex_hits(text, pattern % verb, 2, (needs % verb).lower())
        return F.transform(hits, lambda h: hit(h, F.lit(verb.upper()), h["g2"]))

    arrays += [declared(VERB_MAPPING, "@%smapping", verb) for verb in ("Get", "Post", "Put", "Delete")]
    arrays += [declared(FASTAPI, "@app.%s", verb) for verb in ("get", "post")]
    # the other patterns name their function themselves
    functions = [_beginnings(text, p, f"f{i}", "@requestmapping") for i, p in enumerate(FUNCTION_BELOW)]
    named = ("@requestparam", "@pathvariable", "@requestbody")
    parameters = [_marks(regex_hits(text, p, needs=n), f"p{i}") for i, (p, n) in enumerate(zip(ENDPOINT_PARAMS, named))]
    marks = F.concat(*functions, *parameters, _declared(text, CLASS_ABOVE, "class"))
    blank = F.lit(None).cast(kind[len("array<") : -1])
    endpoint = lambda e: F.struct(_mark("endpoint", e["start"], e["until"], e["line"], none).alias("m"), e.alias("e"))
    rows = F.concat(F.transform("found", endpoint), F.transform(marks, lambda m: F.struct(m.alias("m"), blank.alias("e"))))
    # what comes after an endpoint is looked for from its end
    place = F.when(F.col("kind") == "endpoint", F.col("until")).otherwise(F.col("at"))
    with_any = once(files.select("file_path", TEXT), "found", F.concat(*arrays).cast(kind)).filter(F.size("found") > 0)
    placed = (
        once(with_any, "framework", rest_framework(text))
        .select("file_path", "framework", F.explode(rows).alias("r"))
        .select("file_path", "framework", "r.m.*", "r.e")
    )
    return (
        _by_file(placed, files)
        .withColumn("place", place)
        .withColumns({"handler_class": _above("class"), "below": _function_below(F.col("place")), "near": _parameters_near()})
        .filter(F.col("kind") == "endpoint")
        .select(
            "file_path",
            F.col("line").alias("line_number"),
            "e.method",
            "e.path",
            F.coalesce("e.handler", "below").alias("handler_function"),
            _cut_names(F.col("near"), F.col("at")).alias("parameters"),
            "handler_class",
            "framework",
        )
    )


def annotated_actions(files: DataFrame) -> DataFrame:
    """Action methods marked in Java, with the result page of their body.

    Actions, results, functions and braces become rows once. The body runs to
    where the first brace after the action closes; its result is the last one
    that ends in it.
    """
    text = F.col(TEXT)
    cls = F.regexp_extract_all(text, F.lit(ACTION_CLASS), F.lit(1))
    braces = _marks(regex_hits(text, "([{}])"))
    functions = [_beginnings(text, p, f"f{i}") for i, p in enumerate(FUNCTION_BELOW)]
    marks = F.concat(_marks(F.col("actions"), "action"), _marks(regex_hits(text, RESULT_MARK, needs="@result"), "result"), *functions, braces)
    place = F.when(F.col("kind") == "action", F.col("until")).otherwise(F.col("at"))
    marked = once(files.select("file_path", TEXT), "actions", regex_hits(text, ACTION_MARK, needs="@action")).filter(F.size("actions") > 0)
    classes = once(marked, "class_name", first(cls)).filter(F.col("class_name").isNotNull())
    rows = (
        once(classes, "size", F.length(text))
        .select("file_path", "class_name", "size", F.explode(marks).alias("m"))
        .select("file_path", "class_name", "size", "m.*")
    )
    rows = brace_ends(_by_file(rows, files)).withColumn("place", place)
    opened = _below("{", F.struct("closes"), F.col("place"))["closes"]
    rows = rows.withColumns({"body_end": F.coalesce(opened, F.col("size")), "below": _function_below(F.col("place"))})
    # results lie where they end, actions where their body ends
    ends = F.when(F.col("kind") == "action", F.col("body_end")).when(F.col("kind") == "result", F.col("until"))
    page = _last("result", F.struct("at", "name")).over(Window.partitionBy("file_path").orderBy("ends"))
    found = rows.filter(F.col("kind").isin("action", "result")).withColumn("ends", ends).withColumn("page", page)
    inside = F.col("page.at") >= F.col("until")
    return found.filter(F.col("kind") == "action").select(
        "file_path",
        "name",
        "class_name",
        F.coalesce("below", F.lit("execute")).alias("method"),
        F.concat(F.lit("/"), F.col("name")).alias("path"),
        F.when(inside, F.create_map(F.lit("success"), F.col("page.name"))).otherwise(F.create_map().cast("map<string,string>")).alias("result_pages"),
        F.col("line").alias("line_number"),
    )


def page_components(files: DataFrame) -> DataFrame:
    text = F.col(TEXT)

    def of(kind, needs, pattern):
        return F.transform(
            regex_hits(text, pattern, needs=needs),
            lambda h: F.struct(
                F.lit(kind).alias("component_type"),
                h["line"].alias("line_number"),
                h["start"].alias("start"),
                h["g1"].alias("action_url"),
                F.regexp_extract_all(char_window(text, h["start"], 1000), F.lit(PAGE_INPUT), F.lit(1)).alias(
                    "parameters"
                ),
            ),
        )

    return (
        files.select("file_path", F.explode(F.concat(*[of(*p) for p in PAGE_PATTERNS])).alias("c"))
        .select("file_path", "c.*")
        .withColumn("target_action", normal_action(F.col("action_url")))
    )
