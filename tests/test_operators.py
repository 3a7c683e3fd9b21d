"""Joins, graphs and skew helpers against brute force on small fixtures."""

import itertools
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from codeloom.catalog import bindings
from codeloom.functions.scoring import score_components
from codeloom.functions.text import STOP_WORDS, regex_hits
from codeloom.operators import asof, graph, overlap, sets
from codeloom.operators import metrics as M
from codeloom.operators import ranking as K
from codeloom.operators import resolve as R
from codeloom.operators.overlap import overlapping
from codeloom.operators.skew import global_position, skew_lookup, with_totals
from codeloom.session import cut_lineage

EDGES = [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("d", "e"), ("e", "f"), ("f", "a"), ("g", "g")]


def edges(spark, pairs, kind="string"):
    return spark.createDataFrame(pairs, f"source {kind}, target {kind}")


def test_call_chains(spark):
    e = edges(spark, EDGES + [("a", "b")])
    starts = spark.createDataFrame([("a",), ("z",), ("g",)], "id string")
    got = sorted(tuple(r["chain"]) for r in graph.call_chains(e, starts, 3).collect())
    assert got == [("a", "b", "d", "e"), ("a", "c", "d", "e"), ("z",)]  # g only calls itself


@pytest.mark.parametrize("seed", range(4))
def test_chain_counts_equal_the_listed_chains(spark, seed):
    """Dense little graphs: returns, cycles of three, loops, leaves."""
    r = random.Random(seed)
    pairs = [(r.randrange(9), r.randrange(12)) for _ in range((10, 25, 45, 70)[seed])]
    e = edges(spark, pairs, "long")
    starts = spark.createDataFrame([(i,) for i in range(14)], "id long")
    want = Counter()
    length = Counter()
    for row in graph.call_chains(e, starts, 3).collect():
        want[row["start"]] += 1
        length[row["start"]] += len(row["chain"])
    got = {row["start"]: (row["n_chains"], row["total_length"]) for row in graph.chain_counts(e, starts).collect()}
    assert got == {i: (want[i], length[i]) for i in range(14)}


def test_chain_counts_pass_a_hub(spark):
    """100,000 callers and as many callees of one node: 10^10 chains counted."""
    n = 100_000
    ids = spark.range(n)
    e = ids.select(F.col("id").alias("source"), F.lit(-1).cast("long").alias("target"))
    e = e.unionByName(ids.select(F.lit(-1).cast("long").alias("source"), (F.col("id") + n).alias("target")))
    got = graph.chain_counts(e, ids.select("id")).agg(F.sum("n_chains"), F.sum("total_length")).first()
    assert tuple(got) == (n * n, 3 * n * n)


def test_related(spark):
    starts = spark.createDataFrame([("a",)], "id string")
    got = {r["id"]: r["depth"] for r in graph.related(edges(spark, EDGES), starts, 2).collect()}
    assert got == {"b": 1, "c": 1, "f": 1, "d": 2, "e": 2}


def test_related_from_many_starts(spark):
    rnd = random.Random(11)
    pairs = [(rnd.randrange(150), rnd.randrange(150)) for _ in range(160)] + [(7, 7)]
    near = {n: {t for s, t in pairs if s == n} | {s for s, t in pairs if t == n} for p in pairs for n in p}
    chosen = [n for n in range(0, 160, 2)]  # some of them on no edge
    want = set()
    for start in chosen:
        seen, front = {start}, {start}
        for depth in (1, 2, 3):
            front = set().union(*(near.get(n, set()) for n in front)) - seen
            seen |= front
            want |= {(start, n, depth) for n in front}
    starts = spark.createDataFrame([(n,) for n in chosen + chosen[:3]], "id long")
    e = edges(spark, pairs, "long")
    assert sorted(map(tuple, graph.related(e, starts, 3).collect())) == sorted(want)
    assert graph.related(e.limit(0), starts).count() == 0 and graph.related(e, starts.limit(0)).count() == 0


def test_related_at_a_hub(spark):
    """10,000 starts around one hub: 64 of them travel in a row."""
    n = 10_000
    e = spark.range(1, n + 1).select(F.col("id").alias("source"), F.lit(0).cast("long").alias("target"))
    numbers = sets.numbered(spark.range(1, n + 1))
    got = graph.related_sets(e, numbers).groupBy("depth").agg(F.sum(F.bit_count("bits")), F.count("*")).orderBy("depth").collect()
    assert [tuple(r)[:2] for r in got] == [(1, n), (2, n * (n - 1))]
    assert got[1][2] <= n * (n // 64 + 1)


def test_closure_and_cycle(spark):
    n = spark.createDataFrame([("r", None, "R"), ("m", "r", "M"), ("x", "m", "X"), ("o", "gone", "O")], "id string, parent_id string, label string")
    rows = {(r["ancestor"], r["descendant"], r["depth"], r["path"]) for r in graph.closure(n).collect()}
    assert ("r", "x", 2, "R.M.X") in rows and ("o", "o", 0, "O") in rows and len(rows) == 7
    loop = spark.createDataFrame([("a", "b", "A"), ("b", "a", "B")], "id string, parent_id string, label string")
    try:
        graph.closure(loop)
        raise AssertionError("a cycle must not pass")
    except ValueError:
        pass


def test_root_paths(spark):
    rows = [("r", None, "R"), ("m", "r", "M"), ("x", "m", "X"), ("y", "x", "Y"), ("z", "y", "Z"), ("o", "gone", "O"), ("p", "o", "P")]
    n = spark.createDataFrame(rows, "id string, parent_id string, label string")
    got = {r["id"]: (r["root"], r["depth"], r["path"]) for r in graph.root_paths(n).collect()}
    assert got == {
        "r": ("r", 0, "R"), "m": ("r", 1, "R.M"), "x": ("r", 2, "R.M.X"), "y": ("r", 3, "R.M.X.Y"), "z": ("r", 4, "R.M.X.Y.Z"),
        "o": ("o", 0, "O"), "p": ("o", 1, "O.P"),
    }
    assert graph.root_paths(n.filter("id = 'none'")).count() == 0
    loop = spark.createDataFrame([(i, (i + 1) % 3, "x") for i in range(3)] + [(7, 0, "y")], "id int, parent_id int, label string")
    with pytest.raises(ValueError):
        graph.root_paths(loop)


def test_root_paths_double_their_steps(spark, monkeypatch):
    """A chain of 10,000 nodes: the steps double in every round."""
    written = []
    monkeypatch.setattr(graph, "cut_lineage", lambda df: written.append(1) or cut_lineage(df))
    chain = spark.range(10_000).select("id", F.when(F.col("id") > 0, F.col("id") - 1).alias("parent_id"), F.lit("n").alias("label"))
    deep = graph.root_paths(chain, paths=False).agg(F.count("*"), F.sum("depth"), F.max("root"), F.max("depth")).first()
    assert tuple(deep) == (10_000, 9999 * 10_000 // 2, 0, 9999)
    assert len(written) <= 15


def test_impact_with_hubs_is_exact(spark):
    rnd = random.Random(7)
    pairs = {(rnd.randrange(60), rnd.randrange(60)) for _ in range(200)}
    pairs |= {(i, 5) for i in range(60)} | {(5, i) for i in range(60)} | {(40000 + i, 5) for i in range(5)}
    nodes = sorted({x for p in pairs for x in p})
    modules = spark.createDataFrame([(n, f"m{n % 7}") for n in nodes], "id long, module_path string")
    e = edges(spark, sorted(pairs), "long")
    want = {}
    for n in nodes:
        near = {s for s, t in pairs if t == n}
        far = near | {s for s, t in pairs if t in near}
        if far:
            want[n] = (len(far), len({x % 7 for x in far}))
    for limit in (3, 10, 4096):  # all, some and no nodes taken as hubs
        got = {r["id"]: (r["n_affected"], r["n_modules"]) for r in graph.affected_counts(e, modules, limit).collect()}
        assert got == want, limit


    text = e.select(F.concat(F.lit("n"), "source").alias("source"), F.concat(F.lit("n"), "target").alias("target"))
    owners = modules.select(F.concat(F.lit("n"), "id").alias("id"), "module_path")
    got = {int(r["id"][1:]): (r["n_affected"], r["n_modules"]) for r in graph.affected_counts(text, owners, 3).collect()}
    assert got == want
    rules = spark.createDataFrame([(5,), (5,), (7,)], "code_entity_id long")
    counted = {r["id"]: r["n_rules"] for r in graph.impact(e, modules, rules).collect()}
    assert counted[5] == 2 and counted[7] == 1 and counted[8] == 0


def test_impact_of_few_callers_is_listed(spark, monkeypatch):
    """Nodes that few reach need no sets, and of a graph with one hub only what
    reaches the hub is numbered."""
    k = F.col("id")
    tree = spark.range(1, 500).select(k.alias("source"), F.floor(k / 2).alias("target"))
    modules = spark.range(500).select("id", F.concat(F.lit("m"), k % 3).alias("module_path"))
    seen = []
    real = graph.union_counts
    monkeypatch.setattr(graph, "union_counts", lambda links, *rest: seen.append(links.count()) or real(links, *rest))
    want = {i: len([j for j in range(1, 500) if i in (j // 2, j // 4)]) for i in range(1, 250)}
    got = {r["id"]: r["n_affected"] for r in graph.affected_counts(tree, modules).collect()}
    assert {i: n for i, n in got.items() if i} == want and not seen
    hub = tree.unionByName(spark.range(100, 140).select(k.alias("source"), F.lit(499).cast("long").alias("target")))
    got = {r["id"]: r["n_affected"] for r in graph.affected_counts(hub, modules, 20).collect()}
    far = set(range(100, 140)) | {j for j in range(1, 500) if 100 <= j // 2 < 140}
    assert got[499] == len(far) and got[300 // 2] == 2 and seen and seen[0] < 60


def test_entities_in_modules_use_all_cores(spark, tmp_path):
    """The keys of one small file are spread before paths are derived."""
    part = spark.range(64).select(
        F.col("id").alias("p_partkey"), F.lit("a b").alias("p_name"), F.lit(1).alias("p_size"), F.lit("t").alias("p_type"), F.lit("b").alias("p_brand")
    )
    part.coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    parts = bindings.entities_in_modules(spark, str(tmp_path)).select("k", F.spark_partition_id().alias("at"))
    assert parts.select("at").distinct().count() > 1


def test_impact_of_a_large_hub(spark):
    """A hub of 100,000 callers called by none, calling 300 nodes, and a second
    one that shares half of the callers and calls 200 of them."""
    n, hub, other = 100_000, 1_000_000, 1_000_001
    ids = spark.range(n)
    link = lambda df, s, t: df.select(s.cast("long").alias("source"), t.cast("long").alias("target"))
    k = F.col("id")
    e = link(ids, k, F.lit(hub)).unionByName(link(ids, k + n // 2, F.lit(other)))
    e = e.unionByName(link(spark.range(300), F.lit(hub), k + 2_000_000)).unionByName(link(spark.range(200), F.lit(other), k + 2_000_000))
    modules = ids.select("id", F.concat(F.lit("m"), k % 11).alias("module_path"))
    got = {r["id"]: (r["n_affected"], r["n_modules"]) for r in graph.affected_counts(e, modules).collect()}
    both, first = {got[2_000_000 + i] for i in range(200)}, {got[2_000_000 + i] for i in range(200, 300)}
    assert both == {(n + n // 2 + 2, 11)} and first == {(n + 1, 11)}
    assert got[hub] == (n, 11) and got[other] == (n, 11) and len(got) == 302


def test_containers_are_chosen_by_density(spark):
    few, many = spark.range(5).select((F.col("id") * 50_000 + 3).alias("member")), spark.range(40_000).select(F.col("id").alias("member"))
    own = few.select(F.lit(1).alias("id"), "member").unionByName(many.select(F.lit(2).alias("id"), "member"))
    rows = sets.containers(own.withColumn("kind", F.lit("node"))).collect()
    assert sorted((r["n"], r["places"] is None) for r in rows if r["id"] == 1) == [(1, False)] * 5
    # number 0 has a range of its own
    assert sorted((r["n"], r["bits"] is None) for r in rows if r["id"] == 2) == [(1, True), (7231, False), (32_768, False)]


def test_pattern_hits_are_linear(spark):
    text = "ab\ncd(x\n) é"
    for n in (3, 700, 20000):
        df = spark.createDataFrame([(text * n,)], "t string")
        hits = df.select(regex_hits(F.col("t"), r"c(d)\((x\n)", 2).alias("h")).first().h
        assert len(hits) == n
        for i in (0, n // 2, n - 1):
            assert tuple(hits[i]) == (3 + len(text) * i, 2 + 2 * i, 8 + len(text) * i, "cd(x\n", "d", "x\n")


def test_either_contains(spark):
    names = ["getUser", "User", "Order", "e", "saveOrderLine"]
    deps = ["lib.User.x", "Order", "zz", "et", "saveOrder", "qqe"]
    n = spark.createDataFrame([(i, x, f"id{i}") for i, x in enumerate(names)], "seq int, name string, value string")
    t = spark.createDataFrame([(x,) for x in deps], "text string")
    got = {r["text"]: r["value"] for r in R.either_contains(t, n).collect()}
    want = {}
    for d in deps:
        for i, x in enumerate(names):
            if x in d or d in x:
                want[d] = f"id{i}"
                break
    assert got == want


@pytest.mark.parametrize("seed", range(2))
def test_containing(spark, seed):
    """Few letters, so that needles of all lengths overlap; a code point beyond
    the first plane, repeats, empty and null strings."""
    r = random.Random(seed)
    word = lambda most: "".join(r.choice("abñ\U0001f600") for _ in range(r.randint(0, most)))
    texts = [word(30) for _ in range(60)] + [None, "", "abab", "abab"]
    asked = [word(6) for _ in range(80)] + [None, "", "a", "ab", "zz", "abab"]
    t = spark.createDataFrame(list(enumerate(texts)), "k int, path string")
    n = spark.createDataFrame([(x,) for x in asked], "name string")
    got = Counter((r["k"], r["path"], r["name"]) for r in R.containing(t, "path", n, "name").collect())
    want = Counter((k, x, y) for k, x in enumerate(texts) for y in {a for a in asked if a} if x and y in x)
    assert got == want
    assert R.containing(t, "path", n.filter("name = 'no such'"), "name").count() == 0


def test_containing_makes_rows_by_text_alone(spark):
    """Needles of many lengths make no more rows of a text."""
    t = spark.createDataFrame([("".join(chr(97 + i * i % 23) for i in range(4000)),)], "path string")
    for lengths in (range(3, 5), range(3, 60)):
        n = spark.createDataFrame([("x" * w,) for w in lengths], "name string")
        sizes = n.agg(F.array_sort(F.collect_set(F.least(F.length("name"), F.lit(3))))).scalar()
        assert R._grams(t, "path", "path", sizes).count() == 4000 - 2
        assert R.containing(t, "path", n, "name").count() == 0


def test_containing_compares_whole_needles_only(spark, monkeypatch):
    """Names that differ in few digits meet their own texts alone, and nothing
    that grows is planned as a broadcast."""
    k = F.col("id").cast("string")
    t = spark.range(3000).select(F.concat(F.lit("compute_"), k, F.lit("()")).alias("path"))
    n = spark.range(3000).select(F.concat(F.lit("compute_"), k).alias("name"))
    written = []
    keep = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    monkeypatch.setattr(R, "FEW_HEADS", 0)
    out = R.containing(t, "path", n, "name")
    assert out.count() == 3000 + 2990 + 2900 + 2000  # the name, and those of its first digits
    assert [(x["head"], sorted(x["sizes"])) for x in written[2].collect()] == [("compute_", [9, 10, 11, 12])]
    assert "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_containing_drops_places_early(spark):
    """Few heads: no broadcast, and places where none begins make no row, in
    short texts and in long ones."""
    t = spark.createDataFrame([("x" * 50 + "needle",), ("y" * 5000 + "needle\U0001f600",)], "path string")
    n = spark.createDataFrame([("needle",)], "name string")
    heads = spark.createDataFrame([("need",)], "head string")
    rows = R._grams(t, "path", "path", F.array(F.lit(4)), R._among(heads, 1)).collect()
    assert sorted(r["tail"] for r in rows if r["gram"] == "need") == ["needle", "needle\U0001f600"] and len(rows) < 500
    out = R.containing(t, "path", n, "name")
    assert out.count() == 2 and "Broadcast" not in out._jdf.queryExecution().executedPlan().toString()


def test_rule_entities(spark):
    ents = [("e1", "/src/a/Pay.java", "PayService", 1), ("e2", "/src/a/Pay.java", "check", 2), ("e3", "/src/b/Ship.py", "ship", 3)]
    refs = ["Pay.java:check", "Pay.java:PayService.run", "Ship.py:nothing", "/b/", "none:x", "Pay.java"]
    e = spark.createDataFrame(ents, "entity_id string, file_path string, name string, seq int")
    r = spark.createDataFrame([(f"r{i}", x) for i, x in enumerate(refs)], "rule_id string, code_reference string")
    want = {}
    for i, ref in enumerate(refs):
        found = None
        if ":" in ref:
            fp, code = ref.split(":", 1)
            found = next((x[0] for x in ents if fp in x[1] and (code in x[2] or x[2] in code)), None)
        found = found or next((x[0] for x in ents if ref in x[1]), None)
        if found:
            want[f"r{i}"] = found
    got = {x["rule_id"]: x["entity_id"] for x in R.rule_entities(r, e).collect()}
    assert got == want


def related_by_hand(a, b):
    if a[1] == b[1] or (a[2] and a[2] == b[2]) or a[3] == b[3]:
        return True
    return len((set(a[4].lower().split()) & set(b[4].lower().split())) - set(STOP_WORDS)) >= 2


def test_rule_links_hold_the_whole_relation(spark):
    rnd = random.Random(3)
    words = "claim policy limit the of rate must payer date zone".split()
    rules = [
        (f"r{i:02d}", f"e{rnd.randrange(25)}", rnd.choice([None, "C1", "C2", f"C{i}"]), f"cat{rnd.randrange(30)}",
         " ".join(rnd.choice(words) for _ in range(rnd.randrange(1, 5))))
        for i in range(40)
    ]
    df = spark.createDataFrame(rules, "rule_id string, code_entity_id string, class_context string, category string, description string")
    links = R.rule_links(df).cache()
    groups = {}
    for r in links.collect():
        groups.setdefault((r["link_kind"], r["link_key"]), set()).add(r["rule_id"])
    got = {frozenset(p) for g in groups.values() for p in itertools.combinations(sorted(g), 2)}
    want = {frozenset((a[0], b[0])) for a, b in itertools.combinations(rules, 2) if related_by_hand(a, b)}
    assert got == want
    degree = {r[0]: sum(r[0] in p for p in want) for r in rules}
    bands = {r["rule_id"]: r["band"] for r in R.related_bands(df).collect()}
    assert bands == {k: "5+" if v >= 5 else "3-4" if v >= 3 else str(v) for k, v in degree.items() if v}


@pytest.mark.parametrize("seed", range(3))
def test_overlapping_sets(spark, seed):
    """Against all pairs; frequent and rare words, long and short sets."""
    r = random.Random(seed)
    pick = lambda: f"w{min(int(r.expovariate((0.5, 0.05, 0.01)[seed])), 200)}"
    sets = {i: {pick() for _ in range(r.choice((1, 2, 3, 12)))} for i in range(70)}
    rows = spark.createDataFrame([(i, w) for i, ws in sets.items() for w in ws], "id int, word string")
    want = {i: {j for j in sets if j != i and len(sets[i] & sets[j]) > 1} for i in sets}
    many, near = overlapping(rows)
    many = {x["id"] for x in many.collect()}
    assert all(len(want[i]) >= 5 for i in many)
    got = {i: set() for i in sets if i not in many}
    for x in near.collect():
        got[x["id"]].add(x["other"])
    assert got == {i: want[i] for i in got}


def test_overlap_makes_rows_by_words(spark, monkeypatch):
    """20,000 words shared by two texts: four pairs a word, not its square."""
    sizes = []
    monkeypatch.setattr(overlap, "with_totals", lambda df, *a: sizes.append(df.count()) or with_totals(df, *a))
    rows = spark.range(20_000).select(F.explode(F.array(F.lit(1), F.lit(2))).alias("id"), F.col("id").cast("string").alias("word"))
    many, near = overlapping(rows)
    assert many.count() == 0 and sorted(tuple(x) for x in near.collect()) == [(1, 2), (2, 1)]
    assert sizes == [40_000, 2 * (4 * 20_000 - 10)]


@pytest.mark.parametrize("common, witnesses", [(256, 1024), (8, 8), (4, 2)])
def test_overlapping_sets_in_rounds(spark, monkeypatch, common, witnesses):
    """Against all pairs, whatever the shares that are asked first; no set makes
    a row for each of its words and each of its most frequent ones."""
    monkeypatch.setattr(overlap, "COMMON", common)
    monkeypatch.setattr(overlap, "WITNESSES", witnesses)
    monkeypatch.setattr(overlap, "STEP", 4)
    monkeypatch.setattr(overlap, "with_totals", None)
    r = random.Random(common)
    pick = lambda: f"w{min(int(r.expovariate(0.03)), 150)}"
    sets = {i: sorted({pick() for _ in range(r.choice((0, 1, 2, 3, 9)))}) for i in range(150)}
    want = {i: {j for j in sets if j != i and len(set(sets[i]) & set(sets[j])) > 1} for i in sets}
    many, near = overlap.overlapping_sets(spark.createDataFrame(list(sets.items()), "id int, words array<string>"))
    many = {x["id"] for x in many.collect()}
    assert all(len(want[i]) >= 5 for i in many)
    got = {i: [] for i in sets if i not in many}
    for x in near.collect():
        if x["id"] in got:
            got[x["id"]].append(x["other"])
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(want[i]) for i in got}


def test_flow_pair_scores(spark):
    calls = spark.createDataFrame([("get", "/api/users/:userId"), ("GET", "/api/test"), ("POST", "/api/test"), ("GET", "/api/a/${x}")], "method string, url string")
    ends = spark.createDataFrame([("GET", "/api/users/{id}", "u"), ("GET", "/api/test", "t"), ("GET", "/api/test/", "t2"), ("GET", "/api/a/{y}", "a")], "method string, path string, handler_function string")
    got = {r["url"]: (r["n_exact"], r["n_similar"], r["confidence"], r["handler"]) for r in R.call_matches(calls, ends).collect()}
    assert got["/api/users/:userId"] == (0, 1, 0.8, "u")
    assert got["/api/test"] == (1, 1, 1.0, "t")
    assert got["/api/a/${x}"] == (0, 1, 0.8, "a")
    assert set(got) == {"/api/users/:userId", "/api/test", "/api/a/${x}"}


def test_asof_buckets_agree_with_scan(spark):
    rnd = random.Random(1)
    marks = [("k" if rnd.random() < 0.8 else "q", rnd.randrange(300), f"m{i}") for i in range(60)]
    marks = list({(k, p): (k, p, v) for k, p, v in marks}.values())
    probes = [(i, rnd.choice("kq"), rnd.randrange(300)) for i in range(80)]
    m = spark.createDataFrame(marks, "key string, pos int, v string")
    p = spark.createDataFrame(probes, "id int, key string, pos int")
    b = F.floor(F.col("pos") / 25)
    back = {r["id"]: r["nearest"] for r in asof.asof_backward(p, m, "key", "pos", "v", b).collect()}
    ahead = {r["id"]: r["nearest"] for r in asof.asof_forward(p, m, "key", "pos", "v", b).collect()}
    for i, k, pos in probes:
        before = max(((q, v) for kk, q, v in marks if kk == k and q <= pos), default=(0, None))[1]
        after = min(((q, v) for kk, q, v in marks if kk == k and q > pos), default=(0, None))[1]
        assert back[i] == before and ahead[i] == after


def test_skew_helpers(spark):
    facts = spark.range(500).select(F.when(F.col("id") < 300, 1).otherwise(F.col("id") % 9).alias("k"), "id")
    dim = spark.createDataFrame([(i, f"v{i}") for i in range(5)], "k long, v string")
    plain = sorted(map(tuple, facts.join(dim, "k", "left").select("k", "id", "v").collect()), key=str)
    assert sorted(map(tuple, skew_lookup(facts, dim, ["k"], ["id"]).select("k", "id", "v").collect()), key=str) == plain
    totals = {r["k"]: r["total"] for r in with_totals(facts, ["k"], ["id"]).collect()}
    assert totals == {r["k"]: r["count"] for r in facts.groupBy("k").count().collect()}
    pos = global_position(facts, [F.col("k")], F.floor(F.col("id") / 50), [F.col("id")]).collect()
    want = sorted((r["k"], r["id"]) for r in pos)
    assert [(r["k"], r["id"]) for r in sorted(pos, key=lambda r: r["position"])] == want


def test_ranks_by_value(spark):
    rows = [("a", 0.5, 1), ("a", 0.5, 2), ("a", 0.9, 3), ("b", 0.501, 4), ("b", 0.1, 5)]
    df = spark.createDataFrame(rows, "g string, v double, id int")
    got = {r["id"]: (r["category_rank"], r["overall_rank"]) for r in K.ranks_by_value(df, "g", "v", "id", 10).collect()}
    assert got == {1: (2, 3), 2: (2, 3), 3: (1, 1), 4: (1, 2), 5: (2, 5)}


def test_component_scores(spark):
    schema = ("type string, name string, file_path string, complexity int, methods array<string>, base_classes array<string>, "
              "inheritance array<string>, design_patterns array<string>, business_logic_patterns array<string>, function_calls array<string>")
    e = spark.createDataFrame(
        [("class", "TestService", "/t/T.java", 5, [], [], [], [], [], []),
         ("corba_interface", "I", "/t/I.idl", 0, ["a", "b"], [], ["P"], [], [], []),
         ("method", "m", "/t/T.java", 3, [], [], [], [], [], [])], schema)
    r = {x["name"]: x for x in score_components(e).collect()}
    t = r["TestService"]
    assert (t["points"], t["level"], t["effort_hours"], t["risk_level"], t["priority"]) == (10, "Medium", 24.0, "Low", 4)
    i = r["I"]
    assert (i["points"], i["level"], i["effort_hours"], i["effort_text"], i["billed_hours"]) == (29, "High", 84.0, "10 days", 80)
    assert "m" not in r


def test_performance_buckets_always_present(spark):
    jobs = spark.createDataFrame([("completed", 99, 1.0), ("completed", 100, 2.0), ("completed", 499, 4.0), ("failed", 500, 9.0), ("completed", None, None)],
                                 "status string, files_processed int, processing_time double")
    got = {r["size"]: (r["count"], r["avg_time"]) for r in M.performance_by_size(jobs).collect()}
    assert got == {"small": (2, 0.5), "medium": (2, 3.0), "large": (0, 0.0)}


def test_flows_read_what_was_extracted_once(spark, tmp_path):
    """Both sides of the flow joins are read several times, the sources behind
    them once: the result reads written tables only."""
    spark.createDataFrame([("GET", "/a/:x", "a"), ("POST", "/b", "b")], "method string, url string, name string").write.parquet(f"{tmp_path}/t")
    t = spark.read.parquet(f"{tmp_path}/t")
    source = set(t.inputFiles())
    actions = t.select("name", F.col("url").alias("path"))
    found = R.action_matches(t.select(F.col("name").alias("target_action")), actions)
    assert not source & set(found.inputFiles())
    assert {(r["target"], r["path"], r["confidence"]) for r in found.collect()} == {("a", "/a/:x", 1.0), ("b", "/b", 1.0)}
    ends = t.select("method", F.col("url").alias("path"), F.col("name").alias("handler_function"))
    calls = spark.createDataFrame([("get", "/a/{y}"), ("post", "/b")], "method string, url string")
    met = R.call_matches(calls, ends)
    assert not source & set(met.inputFiles())
    assert {(r["url"], r["n_exact"], r["handler"]) for r in met.collect()} == {("/a/{y}", 0, "a"), ("/b", 1, "b")}


def test_containing_writes_places_once_and_few(spark, monkeypatch):
    """Needles longer than every text are left out before they are written,
    texts without a head before they are cut, and places are cut once."""
    odd = ".*(\\E[\n\U0001f600|"
    t = spark.createDataFrame([(f"compute_{i}",) for i in range(500)] + [(f"a{odd}b",)], "path string")
    n = spark.createDataFrame([("x" * w,) for w in range(20, 400)] + [(odd,), ("te_499",)], "name string")
    written = []
    keep = R.cut_lineage
    monkeypatch.setattr(R, "cut_lineage", lambda df: written.append(keep(df)) or written[-1])
    out = R.containing(t, "path", n, "name")
    assert {(r["path"], r["name"]) for r in out.collect()} == {(f"a{odd}b", odd), ("compute_499", "te_499")}
    held, asked, heads, places = written
    assert held.count() == 501 and asked.count() == heads.count() == 2
    # ``te_4`` begins in a hundred of the names and in ten more
    assert {"gram", "tail"} <= set(places.columns) and places.select("_id").distinct().count() == 112
