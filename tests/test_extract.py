"""Extractor fixtures with hand-derived rows."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.functions import text as X
from codeloom.operators import extract_python as P
from codeloom.operators import extract_rules as RU
from codeloom.operators import extract_source as S
from codeloom.operators import extract_sql as Q
from codeloom.operators import extract_web as W

CLAIMS = '''from datetime import date
from enum import Enum


class Status(Enum):
    NEW = "new"
    OPEN = "open"
    PAID = "paid"


class Validator:
    LIMIT = 10

    def __init__(self):
        self.errors = []

    def check(self, claim):
        if claim is None:
            return False
        if claim.amount > 5 and claim.open:
            return False
        for item in claim.items:
            while item.next:
                item = item.next
        return True


class Shop:
    instance = None

    def create_order(self, a):
        try:
            return a
        except KeyError:
            raise

    def with_a(self): pass
    def with_b(self): pass
    def set_c(self): pass
    def build(self): pass

    @property
    def size(self):
        return 1

    @staticmethod
    def helper(): pass

    def notify(self): pass


async def later():
    return 1


def outer(total):
    import random

    def inner():
        return random.random()

    self_like = Status
    self_like.state = total * 2
    return inner()
'''


def test_python_classes(spark, files):
    n = P.node_table(files(("a.py", CLAIMS), ("bad.py", "def (:")))
    c = {r["name"]: r for r in P.classes(n).collect()}
    assert set(c) == {"Status", "Validator", "Shop"}
    assert c["Status"]["is_data_class"] and c["Status"]["n_attributes"] == 3
    assert c["Status"]["base_classes"] == ["Enum"]
    v = c["Validator"]
    # __init__ 1; check: 1 + two ifs + one extra operand + for + while
    assert v["complexity"] == 1 + 6 and not v["is_data_class"] and v["has_constructor"]
    assert v["ctor_params"] == 0 and not v["ctor_validates"]
    s = c["Shop"]
    assert s["design_patterns"] == ["Singleton", "Factory", "Observer", "Builder"]
    assert s["static_methods"] == 1 and s["property_methods"] == 1 and s["public_methods"] == 8


def test_python_functions(spark, files):
    n = P.node_table(files(("a.py", CLAIMS)))
    f = {r["name"]: r for r in P.functions(n).collect()}
    assert set(f) == {"outer", "inner"}  # no methods, no async ones
    assert "later" in {r["name"] for r in P.functions(n, include_async=True).collect()}
    assert f["outer"]["n_calls"] == 2 and f["inner"]["n_calls"] == 1  # nested counts for both
    assert f["outer"]["source_code"].startswith("def outer(total):")
    logic = {(r["pattern"], r["line"]) for r in P.of_functions(P.logic_patterns(n), n).collect()}
    assert {p for p, _ in logic} == {"calculation", "state_transition"}
    assert {r["dependency"] for r in P.imports(n).collect()} == {"datetime", "enum", "random"}
    calls = {(r["function"], r["call_type"]) for r in P.of_functions(P.function_calls(n), n).collect()}
    assert calls == {("random.random", "method_call"), ("inner", "function_call")}


def test_regex_hits_equal_finditer(spark):
    import re

    text = "a(1)\n\nb (2) c(3)\nxx(4)\n"
    got = spark.range(1).select(X.regex_hits(F.lit(text), r"(\w+)\s*\((\d)\)", 2).alias("h")).first()["h"]
    want = [
        (m.start(), text[: m.start()].count("\n") + 1, m.end(), m.group(1), m.group(2))
        for m in re.finditer(r"(\w+)\s*\((\d)\)", text)
    ]
    assert [(h["start"], h["line"], h["end"], h["g1"], h["g2"]) for h in got] == want
    none = spark.range(1).select(X.regex_hits(F.lit("zz"), r"(\d)", 1, "digit").alias("h")).first()["h"]
    assert none == []


def test_called_names_unicode(spark):
    r = spark.range(1).select(X.called_names(F.lit("été(1) if (x) f(2) run (3)")).alias("n")).first()["n"]
    assert r == ["été", "run"]  # keywords and one-letter names are left out


def test_substrings(spark):
    r = spark.range(1).select(F.array_sort(X.substrings(F.lit("aba"))).alias("s"), X.substrings(F.lit("")).alias("e")).first()
    assert r["s"] == ["a", "ab", "aba", "b", "ba"] and r["e"] == []
    some = F.array(F.lit(2), F.lit(3), F.lit(90))
    sized = lambda n: F.size(X.substrings(F.lit("".join(chr(97 + i % 26) + str(i) for i in range(n))), some))
    a, b = spark.range(1).select(sized(40), sized(80)).first()
    assert b <= 2.6 * a  # linear in the length


SQL = '''q = "SELECT id, u.name AS n, o.total FROM users u JOIN orders o ON 1"
cur.prepare('UPDATE users SET a = ?')
"SELECT"
SELECT *
FROM t
'''


def test_sql(spark, files):
    rows = Q.sql_statements(files(("a.py", SQL))).collect()
    texts = {(r["line_number"], r["query_text"], r["is_prepared"]) for r in rows}
    assert (1, "SELECT id, u.name AS n, o.total FROM users u JOIN orders o ON 1", False) in texts
    assert (2, "UPDATE users SET a = ?", True) in texts
    assert (4, "SELECT *\nFROM t", False) in texts
    assert not any(t == "SELECT" for _, t, _ in texts)
    assert len({(r["line_number"], r["query_text"]) for r in rows}) == len(rows)
    one = next(r for r in rows if r["query_text"].startswith("SELECT id") and r["query_text"].endswith("ON 1"))
    assert one["tables"] == ["orders", "users"] and one["query_type"] == "SELECT"
    cols = spark.range(1).select(Q.projected_columns(F.lit(one["query_text"])).alias("c")).first()["c"]
    assert cols == ["id", "name", "total"]


IDL = """/* interface Hidden { */
interface Registry : Base, Other {
  readonly attribute string name;
  attribute long size;
  oneway void fire(in long x);
  Mod::Kind find(in string id);
};
struct Empty { };
"""


def test_idl(spark, files):
    rows = {r["name"]: r for r in S.idl_entities(files(("a.idl", IDL))).collect()}
    assert "Hidden" not in rows
    assert rows["Registry"]["items"] == ["Base", "Other"]
    assert rows["Registry::fire"]["attrs"]["is_oneway"] == "true"
    assert rows["Registry::find"]["attrs"]["is_oneway"] == "false"
    assert rows["Registry::find"]["attrs"]["return_type"] == "Mod::Kind"
    assert rows["Registry::name"]["attrs"]["is_readonly"] == "true"
    assert rows["Registry::size"]["attrs"]["is_readonly"] == "false"
    roll = S.idl_rollup(files(("a.idl", IDL), ("b.idl", "module M {};"))).collect()
    assert len(roll) == 1
    r = roll[0]
    assert r["points"] == 18 and r["level"] == "Medium" and r["registry_interfaces"] == 1
    assert r["json_structs"] == 0 and "Some data structures may not directly map to JSON" in r["challenges"]


XML = """<?xml version="1.0"?><!DOCTYPE struts PUBLIC "-//X//DTD" "http://x/y.dtd">
<struts><package name="p"><action name="a" class="A"><result>/x.jsp</result><result name="success" location="/y.jsp"/></action>
<action name="b"/></package></struts>"""
OLD = '<struts-config><action-mappings><action-mapping path="/o" type="T"/><action path="/q" name="f"/></action-mappings></struts-config>'


def test_xml(spark, files):
    f = files(("struts.xml", XML), ("struts-config.xml", OLD), ("empty.xml", ""), ("bad.xml", "<a><b></a>"))
    got = {(r["type"], r["name"]) for r in S.struts_xml_entities(f).collect()}
    assert {("struts_action", "a"), ("struts_result", "a_success"), ("struts_action", "b"), ("struts_mapping", "/o")} <= got
    acts = S.xml_web_actions(f).collect()
    assert [(a["name"], a["result_pages"]) for a in acts] == [("a", {"success": "/y.jsp"})]
    two = {(r["type"], r["name"]) for r in S.struts2_xml_entities(f).collect()}
    assert ("struts2_package", "p") in two and ("struts2_action", "p.a") in two


def test_web(spark, files):
    ts = "class Svc {\n  go() {\n    this.http.get(`/api/users/${id}`);\n    this.http.post('/x');\n  }\n}\n"
    calls = {(r["method"], r["url"]): r for r in W.http_calls(files(("angular/a.ts", ts))).collect()}
    c = calls[("GET", "/api/users/${id}")]
    assert len(calls) == 2 and c["line_number"] == 3 and c["context_function"] == "go" and c["context_class"] == "Svc"
    assert c["parameters"] == ["id"] and c["is_dynamic_url"]
    py = '@app.get("/a/{b}")\ndef show(b):\n    pass\n'
    e = W.rest_endpoints(files(("api/x.py", py))).collect()
    assert [(r["method"], r["path"], r["handler_function"], r["framework"]) for r in e] == [("GET", "/a/{b}", "show", "FastAPI")]


def test_brace_ends(spark):
    for text, want in (("x { a { b } c } d { e }", {2: 14, 6: 10, 18: 22}), ("} x { a", {4: None}), ("}{}}{", {1: 2, 4: None})):
        marks = [("f", b, i, i + 1) for i, b in enumerate(text) if b in "{}"]
        rows = W.brace_ends(spark.createDataFrame(marks, "file_path string, kind string, at int, until int")).collect()
        assert {r["at"]: r["closes"] for r in rows if r["kind"] == "{"} == want


WEB_WORDS = (
    "public int run(", "public  void go (", "def f(", "function g", "class K {", "class L extends Action {", "{", "}", "\n", "\n", " x ",
    "@RequestMapping(value='/a{i}', method = RequestMethod.GET)", "@PostMapping('/b')", "@app.get('/c')", "@RequestParam('q')", "@PathVariable(\"w\")",
    "@RequestBody Thing body", "@Action(value='do')", "@Result(location='/r.jsp')", "@Result(location=\"/s.jsp\")", "http.get('/u')", "function function h", "é" * 300,
)


def last_line_with(text, line, patterns):
    found = None
    for row in text.split("\n")[:line]:
        names = [m.group(1) for p in patterns if (m := re.search(p.replace("(?U)", ""), row))]
        found = names[0] if names else found
    return found


def function_after(text, end):
    return next((m.group(1) for p in W.FUNCTION_BELOW if (m := re.search(p.replace("(?U)", ""), text[end:]))), None)


def body_after(text, end):
    depth = 0
    for i, b in enumerate(text[end:]):
        if b == "}" and depth == 1:
            return text[end : end + i]
        depth += (b == "{") - (b == "}" and depth > 0)
    return text[end:]


@pytest.mark.parametrize("seed", range(3))
def test_web_marks_equal_a_scan_for_each_hit(spark, files, seed):
    r = random.Random(seed)
    texts = {f"api/T{i}.java": " ".join(r.choice(WEB_WORDS) for _ in range(r.randint(5, 60))) for i in range(40)}
    f = files(*texts.items())
    above = lambda t, line: (last_line_with(t, line, W.FUNCTION_ABOVE), last_line_with(t, line, W.CLASS_ABOVE))
    line_of = lambda t, at: t[:at].count("\n") + 1
    want = {(p, line_of(t, m.start()), "/u", *above(t, line_of(t, m.start()))) for p, t in texts.items() for m in re.finditer(r"http\.get\('/u'\)", t)}
    got = [(c["file_path"], c["line_number"], c["url"], c["context_function"], c["context_class"]) for c in W.http_calls(f).collect()]
    assert len(got) == len(want) and set(got) == want

    want = Counter()
    for p, t in texts.items():
        flags = re.I | re.S
        spans = [(m, None) for m in re.finditer(W.REQUEST_MAPPING[6:], t, flags)]
        spans += [(m, m.group(2)) for v in ("Get", "Post", "Put", "Delete") for m in re.finditer((W.VERB_MAPPING % v)[6:], t, flags)]
        spans += [(m, m.group(2)) for v in ("get", "post") for m in re.finditer((W.FASTAPI % v)[6:], t, flags)]
        for m, handler in spans:
            near = t[max(m.start() - 500, 0) : m.start() + 500]
            params = [x for q in W.ENDPOINT_PARAMS for x in re.findall(q.replace("(?U)", ""), near)]
            line = line_of(t, m.start())
            want[(p, line, m.group(1), handler or function_after(t, m.end()), tuple(params), last_line_with(t, line, W.CLASS_ABOVE))] += 1
    got = Counter((e["file_path"], e["line_number"], e["path"], e["handler_function"], tuple(e["parameters"]), e["handler_class"]) for e in W.rest_endpoints(f).collect())
    assert got == want

    want = Counter()
    for p, t in texts.items():
        named = re.search(W.ACTION_CLASS[5:], t, re.I)
        for m in re.finditer(W.ACTION_MARK[4:], t, re.I) if named else ():
            pages = re.findall(W.RESULT_MARK[4:], body_after(t, m.end()), re.I)
            want[(p, m.group(1), named.group(1), function_after(t, m.end()) or "execute", pages[-1] if pages else None, line_of(t, m.start()))] += 1
    rows = W.annotated_actions(f).collect()
    assert Counter((a["file_path"], a["name"], a["class_name"], a["method"], a["result_pages"].get("success"), a["line_number"]) for a in rows) == want


def test_web_marks_of_a_long_file(spark, files):
    """100,000 hits in one file: every hit costs the same."""
    n = 100_000
    text = "class A extends Action {\n" + "@Action(value='d') void m() { @Result(location='/r') }\nfunction f { http.get('/u') }\n" * n
    actions = W.annotated_actions(files(("a/A.java", text)))
    assert tuple(actions.agg(F.count("*"), F.min(F.col("result_pages")["success"]), F.max("method")).first()) == (n, "/r", "f")
    calls = W.http_calls(files(("angular/a.ts", text)))
    assert tuple(calls.agg(F.count("*"), F.min("context_function"), F.max("context_class")).first()) == (n, "f", "A")


def test_model_output(spark):
    out = spark.createDataFrame(
        [
            ("fence", 'x\n```json\n[{"id":"A","related_entities":["p"]}]\n```'),
            ("nested", 'see [1] then [{"id":"B","related_entities":["q","r"]},{"category":"C"}] ok'),
            ("broken", "[{'id': 1,"),
            ("none", "nothing here"),
        ],
        "file_path string, response string",
    )
    rows = {(r["file_path"], r["rule_id"]): r for r in RU.parse_rules(out).collect()}
    assert set(rows) == {("fence", "A"), ("nested", "B"), ("nested", "RULE-002")}
    r = rows[("nested", "RULE-002")]
    assert r["category"] == "C" and r["confidence_score"] == 0.7 and r["related_entities"] == []
    assert rows[("nested", "B")]["related_entities"] == ["q", "r"]


def test_windows_get_tasks_by_files(spark, files, monkeypatch):
    """What a task of the windows sorts is bounded by files, whatever the
    session's number of shuffle partitions."""
    monkeypatch.setattr(W, "FILES", 2)
    java = 'class A extends Action {\n@Action(value = "a")\npublic String run() { done(@Result(location = "/a.jsp")); }\n}'
    rest = '@RequestMapping(value = "/a", method = RequestMethod.GET)\npublic X get(@RequestParam("q") String q) { }'
    df = files(*[(f"a{i}", java) for i in range(20)])
    many = -(-20 // 2)
    assert many > spark.sparkContext.defaultParallelism
    assert W.annotated_actions(df).rdd.getNumPartitions() == many
    assert W.annotated_actions(df).count() == 20
    found = W.rest_endpoints(files(*[(f"a{i}", rest) for i in range(20)]))
    assert found.rdd.getNumPartitions() == many
    assert {r.handler_function for r in found.collect()} == {"get"}


def test_hits_around_a_block(spark):
    """Sums of blocks are left out below a block only."""
    for n in (0, 1, X.HIT_BLOCK - 1, X.HIT_BLOCK, X.HIT_BLOCK + 1):
        text = "".join(f"x\ny{i};" for i in range(n)) + "z"
        got = spark.createDataFrame([(text,)], "t string").select(X.regex_hits(F.col("t"), r"y(\d+)").alias("h")).first()["h"]
        want = [(m.start(), 1 + text.count("\n", 0, m.start()), m.end(), m.group(1)) for m in re.finditer(r"y(\d+)", text)]
        assert [(h["start"], h["line"], h["end"], h["g1"]) for h in got] == want


def test_syntax_scan_looks_at_nodes_with_facts_only(monkeypatch):
    from codeloom.operators import syntax_scan

    seen, facts = [], syntax_scan._facts
    monkeypatch.setattr(syntax_scan, "_facts", lambda node: seen.append(node) or facts(node))
    batch = syntax_scan.pa.RecordBatch.from_pydict({"file_path": ["a.py"], "text": [CLAIMS]})
    rows = sum(b.num_rows for b in syntax_scan.scan(iter([batch])))
    assert len(seen) == rows > 10


def test_syntax_scan_passes_over_matched_constants():
    """``case True`` holds a plain value where other patterns hold nodes."""
    from codeloom.operators import syntax_scan

    out = []
    syntax_scan._walk("a.py", "def f(x):\n    match x:\n        case True | None:\n            return g(x)\n", out)
    assert sorted(r[5] for r in out) == ["Call", "FunctionDef", "Return"]


def test_calls_and_logic_in_one_pass(spark, files):
    """The lists of calls and logic that an entity carries, null where there are none."""
    text = "def a(x):\n    y = x * 2\n    if x > y:\n        m.run(x)\n        go(x)\n        go(y)\n\ndef b():\n    pass\n"
    rows = {r["scope"]: r for r in P.calls_and_logic(P.node_table(files(("a.py", text)))).collect()}
    (row,) = rows.values()
    assert sorted(row["calls"].split(",")) == ["go", "run"] and row["logic"] == "calculation,validation"
