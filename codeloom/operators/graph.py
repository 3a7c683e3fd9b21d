"""Hierarchies and call graphs with iterative joins.

Loops advance one level per join. Between levels the frontier is written to
the shared checkpoint folder, so a lost executor costs one level at most and
plans stay short.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from codeloom.functions.scoring import impact_risk
from codeloom.operators.sets import LISTED, members, numbered, union_counts, words
from codeloom.operators.skew import by_merge, skew_lookup
from codeloom.session import cut_lineage


def closure(nodes: DataFrame) -> DataFrame:
    """All (ancestor, descendant, depth, path) rows, each node itself included.

    ``nodes``: id, parent_id, label. ``path`` runs from the ancestor down.
    Runs until no row has a further parent, however deep the hierarchy is. A
    node that meets itself again lies on a cycle, which is an error: there is
    no whole result then.
    """
    up = nodes.filter(F.col("parent_id").isNotNull()).select(
        F.col("id").alias("ancestor"), F.col("parent_id").alias("next")
    )
    labels = nodes.select(F.col("id").alias("next"), F.col("label").alias("next_label"))
    steps = cut_lineage(up.join(labels, "next"))
    frontier = cut_lineage(
        nodes.select(
            F.col("id").alias("ancestor"),
            F.col("id").alias("descendant"),
            F.lit(0).alias("depth"),
            F.col("label").alias("path"),
        )
    )
    levels = [frontier]
    while True:
        frontier = cut_lineage(
            frontier.join(steps, "ancestor").select(
                F.col("next").alias("ancestor"),
                "descendant",
                (F.col("depth") + 1).alias("depth"),
                F.concat_ws(".", "next_label", "path").alias("path"),
            )
        )
        state = frontier.agg(F.count("*").alias("n"), F.bool_or(F.col("ancestor") == F.col("descendant")).alias("loop")).first()
        if state.loop:
            raise ValueError("the parent links contain a cycle")
        if not state.n:
            return reduce(DataFrame.unionByName, levels)
        levels.append(frontier)


#: Paths longer than this are built only once no cycle is known to exist.
CHECKED_STEPS = 4096


def root_paths(nodes: DataFrame, paths: bool = True) -> DataFrame:
    """Root, depth and root-to-node path of every node, by pointer doubling.

    ``nodes``: id, parent_id, label. Each node points at an ancestor and knows
    the labels on the way; a round looks the ancestor's own pointer up and
    takes it over, so that the steps double: a hierarchy of depth d needs
    log2(d) rounds with one row a node, and no closure is made. Nodes that
    point at a root are finished and only looked up from then on. A node whose
    parent is not among ``nodes`` is a root. Without ``paths`` the path is null.
    A cycle is an error.
    """
    parents = nodes.select(F.col("id").alias("parent_id"), F.col("label").alias("prefix"), F.lit(True).alias("known"))
    linked = skew_lookup(nodes.select("id", "parent_id", "label"), parents, ["parent_id"], ["id"])
    known = F.col("known").isNotNull()
    rows = cut_lineage(
        linked.select(
            "id",
            "label",
            F.when(known, F.col("parent_id")).otherwise(F.col("id")).alias("root"),
            known.cast("int").alias("depth"),
            (F.col("prefix") if paths else F.lit(None).cast("string")).alias("prefix"),
            (~known).alias("done"),
        )
    )
    size, steps = rows.count(), 1
    finished, walking = rows.filter("done"), rows.filter("NOT done")
    while not walking.isEmpty():
        if steps > size:
            raise ValueError("the parent links contain a cycle")
        if paths and steps == CHECKED_STEPS:
            root_paths(nodes, paths=False)
        ahead = finished.unionByName(walking).select(
            F.col("id").alias("root"), F.col("root").alias("far"), F.col("depth").alias("more"), F.col("prefix").alias("above"), F.col("done").alias("end")
        )
        prefix = F.concat_ws(".", "above", "prefix") if paths else F.col("prefix")
        rows = cut_lineage(
            skew_lookup(walking.drop("done"), ahead, ["root"], ["id"], "inner").select(
                "id", "label", F.col("far").alias("root"), (F.col("depth") + F.col("more")).alias("depth"), prefix.alias("prefix"), F.col("end").alias("done")
            )
        )
        finished, walking = finished.unionByName(rows.filter("done")), rows.filter("NOT done")
        steps *= 2
    path = F.concat_ws(".", "prefix", "label") if paths else F.lit(None).cast("string")
    return finished.select("id", "root", "depth", path.alias("path"))


def module_trees(entities: DataFrame) -> DataFrame:
    """Flat trees per module: (module_path, root, id, depth, path).

    ``entities``: id, parent_id, module_path, label. A node whose parent lies
    in another module is a root of its own module.
    """
    home = entities.select(F.col("id").alias("parent_id"), F.col("module_path").alias("parent_module"))
    local = skew_lookup(entities, home, ["parent_id"], ["id"], "left").withColumn(
        "parent_id", F.when(F.col("parent_module") == F.col("module_path"), F.col("parent_id"))
    )
    paths = root_paths(local.select("id", "parent_id", "label"))
    return paths.join(entities.select("id", "module_path"), "id").select(
        "module_path", "root", "id", "depth", "path"
    )


def undirected(edges: DataFrame) -> DataFrame:
    """Distinct cross references, both ways."""
    back = edges.select(F.col("target").alias("source"), F.col("source").alias("target"))
    return edges.select("source", "target").unionByName(back).distinct()


def related_sets(edges: DataFrame, numbers: DataFrame, max_depth: int = 2) -> DataFrame:
    """(id, word, bits, depth): for every node the starts that first reach it
    after ``depth`` references, as sets of 64 numbers a word.

    ``numbers``: id and number of each start. Breadth first from all starts at
    once: the sets move along the references, meet by OR, and lose what the node
    has seen, so a hub passes on 64 starts with each row.
    """
    refs = undirected(edges).withColumnRenamed("source", "id")
    frontier = cut_lineage(words(numbers))
    levels, seen = [], frontier
    for depth in range(1, max_depth + 1):
        arrived = (
            skew_lookup(frontier, refs, ["id"], ["word"], "inner")
            .groupBy(F.col("target").alias("id"), "word")
            .agg(F.bit_or("bits").alias("bits"))
        )
        known = seen.groupBy("id", "word").agg(F.bit_or("bits").alias("known"))
        fresh = F.col("bits").bitwiseAND(F.bitwise_not(F.coalesce("known", F.lit(0).cast("long"))))
        frontier = cut_lineage(
            arrived.join(known, ["id", "word"], "left").select("id", "word", fresh.alias("bits")).filter("bits <> 0")
        )
        seen = seen.unionByName(frontier)
        levels.append(frontier.withColumn("depth", F.lit(depth)))
    return reduce(DataFrame.unionByName, levels)


def related(edges: DataFrame, starts: DataFrame, max_depth: int = 2) -> DataFrame:
    """(start, id, depth) within ``max_depth`` references of each start, with
    the least depth: the members of ``related_sets``."""
    numbers = cut_lineage(numbered(starts))
    reached = members(related_sets(edges, numbers, max_depth))
    return skew_lookup(reached, numbers.withColumnRenamed("id", "start"), ["number"], ["id"], "inner").select("start", "id", "depth")


def call_chains(edges: DataFrame, starts: DataFrame, max_depth: int = 3) -> DataFrame:
    """(start, chain) for every simple path ending at a leaf or the depth limit.

    The limit is part of the feature; paths that run into themselves vanish.
    Each level is written once, since the finished paths and the next level
    both read it; joins are left to adaptive skew splitting.
    """
    calls = edges.select(F.col("source").alias("last"), "target").distinct()
    callers = calls.select("last").distinct()
    paths = starts.select(F.col("id").alias("start"), F.array("id").alias("chain"), F.col("id").alias("last"))
    done = []
    for _ in range(max_depth):
        done.append(paths.join(callers, "last", "left_anti").select("start", "chain"))
        grown = (
            paths.join(calls, "last")
            .filter(~F.array_contains("chain", F.col("target")))
            .select("start", F.concat("chain", F.array("target")).alias("chain"), F.col("target").alias("last"))
        )
        paths = cut_lineage(grown)
    return reduce(DataFrame.unionByName, [*done, paths.select("start", "chain")])


def _cycles_of_three(calls: DataFrame) -> DataFrame:
    """(id, tri): directed cycles of three nodes through each node.

    Links lead from the end of lower degree to that of higher degree, so no
    node has more than about the root of twice their number to itself, and the
    pairs that meet at a hub are never listed. ``calls``: no loops, distinct.
    """
    ways = calls.select(F.least("source", "target").alias("a"), F.greatest("source", "target").alias("b"), (F.col("source") < F.col("target")).alias("up"))
    links = cut_lineage(ways.groupBy("a", "b").agg(F.bool_or("up").alias("ab"), F.bool_or(~F.col("up")).alias("ba")))
    ends = links.select(F.col("a").alias("id")).unionByName(links.select(F.col("b").alias("id")))
    degree = ends.groupBy("id").agg(F.count("*").alias("d"))
    rank = lambda end: degree.select(F.col("id").alias(end), F.struct("d", F.col("id").alias("i")).alias(f"r{end}"))
    ranked = skew_lookup(skew_lookup(links, rank("a"), ["a"], ["b"], "inner"), rank("b"), ["b"], ["a"], "inner")
    first = F.col("ra") < F.col("rb")
    pick = lambda yes, no, name: F.when(first, F.col(yes)).otherwise(F.col(no)).alias(name)
    # x is the end of lower rank; out: x calls y, back: y calls x
    led = cut_lineage(ranked.select(pick("a", "b", "x"), pick("b", "a", "y"), pick("rb", "ra", "ry"), pick("ab", "ba", "out"), pick("ba", "ab", "back")))
    p, q = led.alias("p"), led.alias("q")
    wedges = p.join(q, (F.col("p.x") == F.col("q.x")) & (F.col("p.ry") < F.col("q.ry"))).select(
        F.col("p.x").alias("w"), F.col("p.y").alias("x"), F.col("q.y").alias("y"), F.col("p.out").alias("wx"), F.col("p.back").alias("xw"), F.col("q.out").alias("wy"), F.col("q.back").alias("yw")
    )
    closed = wedges.join(led.select("x", "y", "out", "back"), ["x", "y"])
    one = (F.col("wx") & F.col("out") & F.col("yw")).cast("long") + (F.col("wy") & F.col("back") & F.col("xw")).cast("long")
    return (
        closed.select(one.alias("n"), F.explode(F.array("w", "x", "y")).alias("id")).filter("n > 0").groupBy("id").agg(F.sum("n").alias("tri"))
    )


def chain_counts(edges: DataFrame, starts: DataFrame) -> DataFrame:
    """(start, n_chains, total_length) of the chains that ``call_chains`` lists
    up to depth 3, without listing one.

    Walks are counted from sums of degrees along the calls; walks that return
    to a node are taken off: with r the callees that call back, those of three
    steps over the start are r times its degree, those back to the second node
    the sum of its callees' r, those that are both r, and the rest are cycles of
    three. Rows never exceed the calls and the triangles among low degrees.
    """
    every = edges.select("source", "target").distinct()
    callers = cut_lineage(every.select(F.col("source").alias("id")).distinct())
    calls = cut_lineage(every.filter(F.col("source") != F.col("target")))
    to_leaf = calls.join(callers.withColumnRenamed("id", "target"), "target", "left_anti")
    back = calls.select(F.col("target").alias("source"), F.col("source").alias("target"))
    n = F.count("*")
    leaves = to_leaf.groupBy("source").agg(n.alias("leaves"))
    mutual = calls.join(back, ["source", "target"], "left_semi").groupBy("source").agg(n.alias("mutual"))
    node = calls.groupBy("source").agg(n.alias("deg")).join(leaves, "source", "left").join(mutual, "source", "left")
    node = cut_lineage(node.fillna(0, ["leaves", "mutual"]))

    def ahead(of: DataFrame, *sums: Column) -> DataFrame:
        """Sums over the callees of each caller."""
        return skew_lookup(calls, of.withColumnRenamed("source", "target"), ["target"], ["source"], "inner").groupBy("source").agg(*sums)

    second = cut_lineage(ahead(node, F.sum("deg").alias("walks2"), F.sum("leaves").alias("c2"), F.sum("mutual").alias("returns")))
    third = ahead(second.select("source", "walks2"), F.sum("walks2").alias("walks3"))
    tri = _cycles_of_three(calls).withColumnRenamed("id", "source")
    known = node.join(second, "source", "left").join(third, "source", "left").join(tri, "source", "left")
    known = known.fillna(0, ["c2", "returns", "walks3", "tri"])
    c3 = F.col("walks3") - F.col("mutual") * F.col("deg") - F.col("returns") + F.col("mutual") - F.col("tri")
    counted = known.select(F.col("source").alias("start"), F.col("leaves").alias("c1"), "c2", c3.alias("c3"))
    alone = starts.select(F.col("id").alias("start")).join(counted, "start", "left").join(
        callers.select(F.col("id").alias("start"), F.lit(0).cast("long").alias("c0")), "start", "left"
    )
    alone = alone.fillna(1, ["c0"]).fillna(0, ["c1", "c2", "c3"])
    return alone.select(
        "start",
        F.expr("c0 + c1 + c2 + c3").alias("n_chains"),
        F.expr("c0 + 2 * c1 + 3 * c2 + 4 * c3").alias("total_length"),
    )


def impact(edges: DataFrame, modules: DataFrame, rules: DataFrame | None = None) -> DataFrame:
    """Direct and two-step impact of every node at once.

    ``edges``: source calls target. ``modules``: id, module_path.
    Affected are the callers and the callers' callers; the second step is
    carried as lists, and as bitmaps where lists grow long
    (``affected_counts``), never as one row per pair. With ``rules``
    (code_entity_id) the rules that sit on the node itself are counted as
    ``n_rules``.
    """
    # both are read several times
    calls, modules = cut_lineage(edges.select("source", "target").distinct()), cut_lineage(modules.select("id", "module_path"))
    outgoing = calls.groupBy(F.col("source").alias("id")).agg(F.count("*").alias("n_dependencies"))
    direct = calls.groupBy(F.col("target").alias("id")).agg(F.count("*").alias("n_dependents"))
    affected = affected_counts(calls, modules)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    base = (
        modules.select("id")
        .join(by_merge(direct), "id", "left")
        .join(by_merge(outgoing), "id", "left")
        .join(by_merge(affected), "id", "left")
        .select("id", zero("n_dependents"), zero("n_dependencies"), zero("n_affected"), zero("n_modules"))
    )
    if rules is not None:
        own = rules.groupBy(F.col("code_entity_id").alias("id")).agg(F.count("*").alias("n_rules"))
        base = base.join(by_merge(own), "id", "left").withColumn("n_rules", F.coalesce("n_rules", F.lit(0)).cast("long"))
    return base.withColumn("risk_level", impact_risk(F.col("n_dependents"), F.col("n_affected")))


def affected_counts(calls: DataFrame, modules: DataFrame, listed: int = LISTED) -> DataFrame:
    """(id, n_affected, n_modules) over callers and callers' callers, exact.

    ``calls``: source, target, distinct; it is read several times. Sizes are
    known first: where the callers and their callers are up to ``listed``, each
    caller passes its own callers on as one list. The other nodes, and no more
    of the graph than reaches them, go through ``_affected_by_sets``.
    """
    homes = modules.filter(F.col("module_path").isNotNull()).select(F.col("id").alias("source"), "module_path")
    callers = calls.groupBy(F.col("target").alias("source")).agg(F.count("*").alias("_n"))
    known = homes.join(by_merge(callers), "source", "full")
    routed = cut_lineage(skew_lookup(calls, known, ["source"], ["target"], "left"))
    most = F.sum(F.lit(1) + F.coalesce("_n", F.lit(0)))
    reach = cut_lineage(routed.groupBy("target").agg(F.count("*").alias("n"), most.alias("most")))
    far = reach.filter(F.col("most") > listed).select("target")
    hubs = reach.filter(F.col("n") > listed).select("target")
    some = not far.isEmpty()
    short = routed.join(by_merge(hubs), "target", "left_anti") if some else routed
    lists = cut_lineage(
        short.groupBy("target").agg(F.collect_set("source").alias("nodes"), F.collect_set("module_path").alias("homes"))
    )
    carried = skew_lookup(calls, lists.withColumnRenamed("target", "source"), ["source"], ["target"], "inner")
    met = carried.select("target", "nodes", "homes").unionByName(lists)
    if some:
        met = met.join(by_merge(far), "target", "left_anti")
    size = lambda c: F.size(F.array_distinct(F.flatten(F.collect_list(c)))).cast("long")
    few = met.groupBy(F.col("target").alias("id")).agg(size("nodes").alias("n_affected"), size("homes").alias("n_modules"))
    return few.unionByName(_affected_by_sets(calls, far.withColumnRenamed("target", "id"), modules, listed)) if some else few


def _affected_by_sets(calls: DataFrame, ids: DataFrame, modules: DataFrame, listed: int) -> DataFrame:
    """``affected_counts`` of the nodes ``ids``, out of their callers and those
    callers' callers.

    A node passes its callers on as lists and bitmaps of ranges of numbers
    (``sets.union_counts``), their modules likewise, so no edge makes a row for
    each caller. Ids of any type are numbered without gaps first, so few ranges
    hold many callers.
    """
    asked = calls.join(by_merge(ids.withColumnRenamed("id", "target")), "target", "left_semi")
    held = ids.select(F.col("id").alias("target"), F.lit(True).alias("asked"))
    held = held.unionByName(asked.select(F.col("source").alias("target"), F.lit(False).alias("asked")))
    held = held.groupBy("target").agg(F.bool_or("asked").alias("asked"))
    used = cut_lineage(skew_lookup(calls, held, ["target"], ["source"], "inner"))
    ends = used.select(F.col("source").alias("id")).unionByName(used.select(F.col("target").alias("id")))
    numbers = cut_lineage(numbered(ends))
    named = lambda end: numbers.select(F.col("id").alias(end), F.col("number").alias(f"_{end}"))
    routed = skew_lookup(used, named("source"), ["source"], ["target"], "inner")
    routed = skew_lookup(routed, named("target"), ["target"], ["source"], "inner")
    links = cut_lineage(routed.select(F.col("_source").alias("source"), F.col("_target").alias("target"), "asked"))
    placed = modules.filter(F.col("module_path").isNotNull()).join(by_merge(numbers), "id").select("module_path", "number")
    placed = cut_lineage(placed)
    modules_by_number = numbered(placed.select(F.col("module_path").alias("id"))).select(
        F.col("id").alias("module_path"), F.col("number").alias("member")
    )
    owner = skew_lookup(placed, modules_by_number, ["module_path"], ["number"], "inner")
    owner = owner.select(F.col("number").alias("source"), "member")
    callers = links.select(F.col("target").alias("id"), F.lit("node").alias("kind"), F.col("source").alias("member"))
    homes = skew_lookup(links, owner, ["source"], ["target"], "inner").select(F.col("target").alias("id"), F.lit("module").alias("kind"), "member")
    sizes = union_counts(links.filter("asked").select("source", "target"), callers.unionByName(homes.distinct()), listed)
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("kind") == kind, F.col("n"))), F.lit(0))
    counts = sizes.groupBy(F.col("id").alias("number")).agg(of("node").alias("n_affected"), of("module").alias("n_modules"))
    # callers are no answer themselves unless asked for
    wanted = numbers.join(by_merge(ids), "id", "left_semi")
    return counts.join(by_merge(wanted), "number").select("id", "n_affected", "n_modules")


def adjacency(edges: DataFrame) -> DataFrame:
    """Neighbour rows (id, neighbour, relation, n) for calls, reverse calls
    and cross references; rows instead of lists, since a hub's list has no
    bound."""
    n = edges.groupBy("source", "target").agg(F.count("*").alias("n"))
    calls = n.select(F.col("source").alias("id"), F.col("target").alias("neighbour"), F.lit("calls").alias("relation"), "n")
    back = n.select(F.col("target").alias("id"), F.col("source").alias("neighbour"), F.lit("called_by").alias("relation"), "n")
    both = calls.unionByName(back)
    refs = both.groupBy("id", "neighbour").agg(F.sum("n").alias("n")).withColumn("relation", F.lit("cross_reference"))
    return both.unionByName(refs.select("id", "neighbour", "relation", "n"))


def tree_listing(paths: DataFrame, per_dir: int = 10, max_lines: int = 50) -> DataFrame:
    """Directory tree: folders first, then by name, ``per_dir`` children each,
    ``max_lines`` lines in all (both limits are the listing's own).

    ``paths``: path. Only children that survive their folder's cut, and whose
    folders all survived, are listed; the order is that of a depth-first walk.
    """
    parts = F.filter(F.split("path", "/"), lambda p: p != "")
    prefixes = F.transform(
        F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/")
    )
    nodes = (
        paths.select(F.posexplode(prefixes).alias("level", "node"), F.size(parts).alias("n"))
        .groupBy("node", "level")
        .agg(F.min((F.col("level") + 1 == F.col("n")).cast("int")).alias("is_file"))
        .withColumn("parent", F.when(F.col("level") > 0, F.regexp_replace("node", r"/[^/]*$", "")).otherwise(""))
        .withColumn("name", F.element_at(F.split("node", "/"), -1))
    )
    ranked = nodes.withColumn(
        "rank", F.row_number().over(Window.partitionBy("parent").orderBy("is_file", "name"))
    ).filter(F.col("rank") <= per_dir)
    # a node is listed when every folder above it was; its sort key is the
    # ranks on the way down
    steps = ranked.select(
        F.col("node").alias("leaf"),
        F.col("name").alias("leaf_name"),
        F.col("level").alias("leaf_level"),
        F.explode(
            F.transform(
                F.sequence(F.lit(1), F.col("level") + 1),
                lambda i: F.array_join(F.slice(F.split("node", "/"), F.lit(1), i), "/"),
            )
        ).alias("node"),
    )
    out = (
        steps.join(ranked.select("node", "level", "rank"), "node")
        .groupBy("leaf", "leaf_name", "leaf_level")
        .agg(F.array_sort(F.collect_list(F.struct("level", "rank"))).alias("way"))
        .filter(F.size("way") == F.col("leaf_level") + 1)
        .select(
            F.array_join(F.transform("way", lambda x: F.lpad(x["rank"].cast("string"), 3, "0")), ".").alias(
                "sort_key"
            ),
            F.col("leaf").alias("node"),
            F.col("leaf_name").alias("name"),
            F.col("leaf_level").alias("level"),
        )
    )
    return out.select("sort_key", "node", "name", "level").orderBy("sort_key").limit(max_lines)
