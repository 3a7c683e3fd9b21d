"""Source texts written from part rows, one file per part and language."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.catalog.bindings import fill, spread, table

PYTHON = """import os
from pkg<<k3>> import base

class P<<k>>(Base<<k5>>):
    kind = 'x'

    def __init__(self, a, b=1):
        if a is None:
            raise ValueError('a')
        self.a = a

    def create_item(self, n):
        for i in range(n):
            if i > 2 and n < 5:
                self.status = 'done'
        return compute_<<k>>(n, 1)

def compute_<<k>>(x: int, y) -> int:
    total = x + y
    try:
        if not total:
            return None
    except ValueError:
        pass
    helper_<<k7>>(total)
    return total
"""
PYTHON_DATA = """
class D<<k>>:
    x = 1
    y = 2
"""

IDL = """// service <<k>>
#include "common_<<k5>>.idl"
module M<<k10>> {
  interface Svc<<k>> <<parents>>{
    oneway void notify(in long x);
    string get(in string id);
    readonly attribute long size;
  };
  struct S<<k>> { string name; long qty; };
  exception E<<k>> { string why; };
  enum Kind<<k>> { A, B, C };
  typedef sequence<string> L<<k>>;
};
"""

TYPESCRIPT = """import {x} from 'lib<<k4>>';
@Component({ selector: 'a' })
export class C<<k>>Component {
  load<<k3>>() {
    return this.http.get('/api/p<<k20>>/:id');
    $.ajax({ url: '/legacy/p<<k20>>', type: 'post' });
  }
}
@Injectable()
export class S<<k>>Service {}
@NgModule({ declarations: [] })
export class M<<k>>Module {}
export interface I<<k>> {}
"""

REST_JAVA = """@RestController
public class R<<k>>Controller {
  @GetMapping("/api/p<<k20>>/{id}")
  public Item find<<k>>(@PathVariable("id") String id) { return null; }
  @RequestMapping(value = "/legacy/p<<k20>>", method = RequestMethod.POST)
  public Item save<<k>>(@RequestParam("a") String a) { return null; }
}
"""

ACTION_JAVA = """import org.apache.struts2.Foo<<k3>>;
@Namespace("/a")
public class A<<k>>Action extends ActionSupport {
  @Action(value = "save<<k25>>")
  public String run<<k>>() { if (x) { y(); } done(@Result(location = "/ok<<k>>.jsp")); }
  public String execute(Ctx c) { return late(@Result(location = "/no.jsp")); }
  public void validateAll() { }
}
"""

PAGE = """<html><s:form action="save<<k25>>.action"><s:textfield name="a"/></s:form>
<form action="/save<<k25>>" method="post"><input name="q<<k3>>"></form>
<a href="/item/<<k>>">x</a>
<h:commandButton action="go<<k9>>">
%{user.name} %{count}
</html>
"""

CONFIG = """<?xml version="1.0"?>
<struts>
<package name="pk<<k10>>" namespace="/n<<k4>>" extends="base">
<interceptors><interceptor name="t" class="com.I<<k5>>"/><interceptor-stack name="st"><interceptor-ref name="t"/></interceptor-stack></interceptors>
<global-results><result name="err">/e.jsp</result></global-results>
<action name="save<<k>>" class="com.A<<k>>" method="run"><interceptor-ref name="st"/><result name="input">/in<<k>>.jsp</result><result type="redirect">/b.jsp</result></action>
<action name="list<<k>>" class="com.L<<k>>"/>
</package></struts>
"""

SQL_TEXT = (
    "SELECT p_name, p_brand AS b, t.p_size FROM part_<<k3>> t JOIN lineitem l WHERE x = <<k>>\n",
    'db.prepareStatement("INSERT INTO log_<<k5>> VALUES (?)")\n',
    "x\nUPDATE stock_<<k3>> SET qty = :q;\n",
    'DELETE FROM cart_<<k3>> WHERE id = $1\n"SELECT"\nSELECT *\nFROM part_<<k5>>\nWHERE 1=1\n',
)

MODEL_OUTPUT = (
    'Here:\n```json\n[{"id":"R<<k>>","description":"d","confidence_score":0.9,"category":"Val"}]\n```\nbye',
    'text [ {"description":"x <<k>>"} , {"id":"Z<<k>>"} ] tail',
    "no array [1, broken <<k>>",
    'junk [not json] then [{"id":"Q<<k>>","related_entities":["a","b"]}] end',
)


def _slots(k: Column) -> dict[str, Column]:
    out = {"k": k}
    for m in (3, 4, 5, 7, 9, 10, 20, 25):
        out[f"k{m}"] = k % m
    return out


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, Column]:
    # A key becomes a whole source text and then many rows, so the keys are
    # spread over all cores before they grow.
    keys = table(spark, d, "part").select(F.col("p_partkey").alias("k"))
    return spread(keys, "k"), F.col("k")


def _texts(spark: SparkSession, d: str, path: str, text: Column) -> DataFrame:
    parts, k = _parts(spark, d)
    return parts.select("k", fill(path, k=k).alias("file_path"), text.alias("text"))


def python_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    body = F.concat(
        fill(PYTHON, **_slots(k)), F.when(k % 3 == 0, fill(PYTHON_DATA, **_slots(k))).otherwise("")
    )
    return _texts(spark, d, "src/py/p<<k>>.py", F.when(k % 7 == 0, F.concat(F.lit("def (:\n"), body)).otherwise(body))


def idl_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    parents = F.when(k % 2 == 0, F.concat(F.lit(": Base"), (k % 3).cast("string"), F.lit(", Root "))).otherwise("")
    return _texts(spark, d, "src/idl/p<<k>>.idl", fill(IDL, parents=parents, **_slots(k)))


def typescript_files(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "src/angular/p<<k>>.ts", fill(TYPESCRIPT, **_slots(F.col("k"))))


def rest_files(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "src/api/R<<k>>.java", fill(REST_JAVA, **_slots(F.col("k"))))


def action_files(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "src/action/A<<k>>.java", fill(ACTION_JAVA, **_slots(F.col("k"))))


def page_files(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "web/p<<k>>.jsp", fill(PAGE, **_slots(F.col("k"))))


def config_files(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k")
    good = fill(CONFIG, **_slots(k))
    return _texts(
        spark, d, "conf/p<<k>>/struts.xml", F.when(k % 11 == 0, "").when(k % 11 == 1, "no xml").otherwise(good)
    )


def _variants(templates, k: Column) -> Column:
    out = None
    for i, t in enumerate(templates):
        text = fill(t, **_slots(k))
        out = F.when(k % len(templates) == i, text) if out is None else out.when(k % len(templates) == i, text)
    return out


def sql_files(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "db/q<<k>>.sql", _variants(SQL_TEXT, F.col("k")))


def model_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "src/m<<k>>.py", _variants(MODEL_OUTPUT, F.col("k"))).withColumnRenamed("text", "response")


# An opening bracket in the prose, then an array on lines of its own or inline.
STRAY_OUTPUT = (
    'as in [1 above:\n  [\n{"id":"T<<k>>",\n"description":"open","related_entities":[]}\n]\nbye',
    'range [0, 5) holds, so [{"id":"T<<k>>","description":"open"}] it is',
    "nothing [ here <<k>>",
    "",
    'a ] b [ {"id": ] c <<k>>',
)


def stray_outputs(spark: SparkSession, d: str) -> DataFrame:
    return _texts(spark, d, "stray/m<<k>>.py", _variants(STRAY_OUTPUT, F.col("k"))).withColumnRenamed("text", "response")
