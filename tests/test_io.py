"""Corpus scan, tables, reports and streams on temporary folders."""

import datetime as dt
import json

from pyspark.sql import functions as F
from pyspark.sql import types as T

from codeloom.operators.reports import diagram_metadata
from codeloom.sources import corpus, tables
from codeloom.streaming import jobs as S


def _tree(root):
    for path, data in {
        "src/a.py": b"x = 1\ny = 2",
        "src/bad.py": b"caf\xc3\xa9 \xff\xfe ok\n",
        "src/blank.py": b"  \n \n",
        "src/empty.py": b"",
        "src/x.pyc": b"zz",
        "src/__init__.py": b"import a",
        "_internal/_util.py": b"z = 1",
        ".tools/.x.js": b"go()",
        "node_modules/m.js": b"1",
        "venv/v.py": b"1",
        "README": b"hi\n",
    }.items():
        p = root / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_bytes(data)


def test_scan_profiles(spark, tmp_path):
    tmp_path = tmp_path / "venv" / "node_modules" / "corpus"  # what lies above the root prunes nothing
    _tree(tmp_path)
    names = lambda full: {r["name"] for r in corpus.list_files(spark, str(tmp_path), full).select("name").collect()}
    every = {"a.py", "bad.py", "blank.py", "empty.py", "__init__.py", "_util.py", ".x.js", "README"}
    assert names(True) == every
    assert names(False) == every | {"x.pyc", "v.py"}
    sizes = {r["name"]: r["size_bytes"] for r in corpus.list_files(spark, f"file://{tmp_path}/", pattern="*.py").collect()}
    assert sizes == {"a.py": 11, "bad.py": 12, "blank.py": 5, "empty.py": 0, "__init__.py": 8, "_util.py": 5}
    texts = {r["file_path"].rsplit("/", 1)[1]: r for r in corpus.read_texts(spark, str(tmp_path)).collect()}
    assert set(texts) == {"a.py", "bad.py", "README", "__init__.py", "_util.py", ".x.js"}
    assert texts["bad.py"]["text"] == "café  ok\n" and texts["bad.py"]["n_lines"] == 1
    assert texts["a.py"]["n_lines"] == 2
    kept = corpus.read_texts(spark, str(tmp_path), exclude=["bad*", "READ?E", "_*", ".tools"], max_bytes=100).select("file_path").collect()
    assert [r["file_path"].rsplit("/", 1)[1] for r in kept] == ["a.py"]


def test_unreadable_files_are_counted(spark, tmp_path):
    _tree(tmp_path)
    listed = corpus.list_files(spark, str(tmp_path))
    (tmp_path / "README").unlink()
    rows = corpus.read_files(listed).collect()
    assert {r["path"].rsplit("/", 1)[1]: r["error"] for r in rows if r["content"] is None} == {"README": "FileNotFoundError"}
    missing = corpus.list_files(spark, str(tmp_path / "absent")).collect()
    assert [r["error"] for r in missing] == ["FileNotFoundError"]


def test_reports_round_trip(spark, tmp_path):
    rows = [("j1", "class_diagram.mmd", "graph"), ("j2", "README.md", "x")]
    tables.write_reports(spark.createDataFrame(rows, "job_id string, filename string, content string"), str(tmp_path / "out"))
    back = tables.read_reports(spark, str(tmp_path / "out"))
    assert sorted((r["job_id"], r["filename"], r["content"]) for r in back.collect()) == rows
    assert [r["filename"] for r in tables.read_reports(spark, str(tmp_path / "out"), "j2").collect()] == ["README.md"]
    d = tmp_path / "j1" / "diagrams"
    d.mkdir(parents=True)
    (d / "data_flow_diagram.mmd").write_text("flowchart\nA --> B")
    m = diagram_metadata(tables.read_diagram_files(spark, str(tmp_path / "j1"))).first()
    assert (m["id"], m["name"], m["type"], m["content"]) == ("data_flow_diagram", "Data Flow Diagram", "data_flow", "flowchart\nA --> B")


def test_json_logs(spark, tmp_path):
    (tmp_path / "l.json").write_text("\n".join(json.dumps({"timestamp": "2024-01-01T00:00:00", "level": x, "line": 3}) for x in ("ERROR", "INFO")))
    got = tables.read_json_logs(spark, str(tmp_path / "l.json")).select("level", "line", "request_id").collect()
    assert sorted((r["level"], r["line"], r["request_id"]) for r in got) == [("ERROR", 3, None), ("INFO", 3, None)]


def test_templates_and_alignment(spark):
    t = lambda rows: spark.createDataFrame(rows, "name string, is_default boolean, created_at int")
    out = tables.merged_templates(t([("a", True, 1), ("b", False, 2)]), t([("b", True, 9), ("c", True, 5)])).collect()
    assert {(r["name"], r["is_default"]) for r in out} == {("a", False), ("b", False), ("c", True)}
    target = T.StructType.fromDDL("k int, n int, f double, s string")
    r = tables.align(spark.createDataFrame([(1, "x")], "k int, extra string"), target).first()
    assert r.asDict() == {"k": 1, "n": 0, "f": 0.0, "s": None, "extra": "x"}


def test_ingest_processes_each_file_once(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    extract = lambda df: df.withColumn("twice", F.col("v") * 2)

    def wave(values):
        spark.createDataFrame([(v,) for v in values], "v int").write.mode("append").parquet(src)
        S.ingest_new(spark, src, "v int", extract, sink, cp).awaitTermination()
        return sorted(r["twice"] for r in spark.read.parquet(sink).collect())

    assert wave([1, 2]) == [2, 4]
    assert wave([3]) == [2, 4, 6]


def _log_rows():
    t0 = dt.datetime(2024, 1, 1, 0, 0)
    return [(t0 + dt.timedelta(minutes=7 * i), ["ERROR", "INFO", "WARNING"][i % 3], i) for i in range(60)]


def test_error_rates_stream_equals_batch(spark, tmp_path):
    src = str(tmp_path / "logs")
    df = spark.createDataFrame(_log_rows(), "ts timestamp, level string, log_id long")
    df.write.parquet(src)
    want = sorted(map(tuple, S.error_rates(df).collect()))
    q = (
        S.error_rates(spark.readStream.schema(df.schema).parquet(src))
        .writeStream.outputMode("complete").format("memory").queryName("rates").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert sorted(map(tuple, spark.table("rates").collect())) == want


def test_latest_progress_stream(spark, tmp_path):
    src = str(tmp_path / "p")
    rows = [("j1", t, i, f"s{i}", i * 10) for i, (t, _, _) in enumerate(_log_rows()[:5])] + [("j2", _log_rows()[0][0], 9, "z", 1)]
    df = spark.createDataFrame(rows, "job_id string, ts timestamp, event_id long, step string, progress int")
    df.write.parquet(src)
    q = (
        S.latest_progress(spark.readStream.schema(df.schema).parquet(src))
        .writeStream.outputMode("complete").format("memory").queryName("prog").trigger(availableNow=True).start()
    )
    q.awaitTermination()
    assert {(r["job_id"], r["step"]) for r in spark.table("prog").collect()} == {("j1", "s4"), ("j2", "z")}


def test_graph_of_a_folder(spark, tmp_path):
    from codeloom.plans.intelligence import build

    for path, text in {
        "src/base.py": "class Base:\n    pass\n\ndef base():\n    pass\n",
        "src/child.py": "import base\n\nclass Child(Base):\n    pass\n\ndef run(x):\n    return load(x)\n\ndef load(x):\n    return x\n",
        "src/a.component.ts": "@Component({})\nexport class Page {}\n",
        "conf/struts.xml": '<struts><package name="p"><action name="a" class="A"/></package></struts>',
        "notes.txt": "nothing",
    }.items():
        p = tmp_path / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(text)
    files = corpus.read_texts(spark, str(tmp_path))
    g = build(files)
    nodes = {(r["type"], r["name"]): r for r in g.nodes.collect()}
    assert {("class", "Base"), ("class", "Child"), ("function", "run"), ("component", "Page"), ("struts2_action", "p.a"), ("module", "child")} <= set(nodes)
    assert nodes[("class", "Child")]["parent_id"] == "module:" + nodes[("class", "Child")]["module_path"]
    ids = {r["entity_id"]: r["name"] for r in nodes.values()}
    got = {(ids.get(r["source_id"], r["source_id"]), r["relationship_type"], ids[r["target_id"]]) for r in g.edges.collect()}
    assert {("Child", "inherits", "Base"), ("run", "calls", "load")} <= got
    child = nodes[("module", "child")]["entity_id"]
    assert {x for x in got if x[1] == "depends_on"} == {("child", "depends_on", "base")} and child.startswith("module:")
    assert {x for x in got if x[1] == "calls"} == {("run", "calls", "load")}
    assert ("module", "notes") not in nodes and nodes[("function", "run")]["attrs"]["parameters"] == "x"


def test_dependencies_get_no_ids(spark, tmp_path):
    """What a file depends on is written with its path and name alone, and the
    names of nodes are those of the graph."""
    from codeloom.plans.intelligence import build, code_nodes
    from codeloom.plans.registry import DEPENDENCY, extract_all

    (tmp_path / "a.py").write_text("import os\n\nclass A:\n    pass\n")
    files = corpus.read_texts(spark, str(tmp_path))
    rows = {r["type"]: r for r in code_nodes(extract_all(files)).collect()}
    assert rows[DEPENDENCY]["name"] == "os" and rows[DEPENDENCY]["entity_id"] is None and rows["class"]["module_id"]
    g = build(files)
    assert {tuple(r) for r in g.names.collect()} == {(r["entity_id"], r["name"]) for r in g.nodes.collect()}
