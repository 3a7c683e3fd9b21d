"""Name resolution and matching as joins.

"First match" means the smallest ``seq``. Lookups that the plain formulation
would do by scanning everything are turned into equi-joins: a target table is
reduced to one row per name before it meets the references, and substring
conditions go through the first characters of what is asked for. No step compares all pairs, and
none keeps all pairs of a group.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.functions.paths import normal_url
from codeloom.functions.text import meaningful_words
from codeloom.operators.overlap import overlapping_sets
from codeloom.operators.skew import by_merge, skew_lookup, with_totals
from codeloom.session import cut_lineage


# Entity types that own the rows naming them in the same file.
OWNER_TYPES = ("class", "struts_action_class", "struts2_action_class")


def first_per(targets: DataFrame, keys: list[str], seq: str, value: str, out: str) -> DataFrame:
    """One row per key: the value with the smallest seq (map-side combined)."""
    return targets.groupBy(*keys).agg(F.min_by(value, seq).alias(out))


def parent_ids(entities: DataFrame) -> DataFrame:
    """Entities with ``parent_id``: the named class of the file, else its module.

    ``entities``: entity_id, file_path, type, name, class_name, seq, module_id.
    Every row that names a class is its member, methods of web actions too; a
    class is any entity that others of its file may name. A named class that
    does not exist leaves the parent empty.
    """
    owners = (
        entities.filter(F.col("type").isin(*OWNER_TYPES))
        .groupBy("file_path", F.col("name").alias("class_name"))
        .agg(F.max_by("entity_id", "seq").alias("class_id"))
    )
    member = F.col("class_name").isNotNull()
    joined = skew_lookup(entities, owners, ["file_path", "class_name"], ["entity_id"])
    return joined.withColumn(
        "parent_id", F.when(member, F.col("class_id")).otherwise(F.col("module_id"))
    ).drop("class_id")


def name_matches(refs: DataFrame, targets: DataFrame, kinds: list[str], ref: str = "ref") -> DataFrame:
    """References with the first target of that name among ``kinds``.

    ``refs``: source_id, ref. ``targets``: entity_id, type, name, seq.
    """
    dim = first_per(
        targets.filter(F.col("type").isin(*kinds)).withColumnRenamed("name", ref), [ref], "seq", "entity_id", "target_id"
    )
    return skew_lookup(refs, dim, [ref], ["source_id"], "inner")


def base_class_edges(refs: DataFrame, targets: DataFrame) -> DataFrame:
    return name_matches(refs, targets, ["class", "interface"])


def call_edges(refs: DataFrame, targets: DataFrame) -> DataFrame:
    bare = refs.withColumn("ref", F.trim(F.regexp_replace("ref", r"\(.*\)", "")))
    return name_matches(bare, targets, ["method", "function"])


#: Heads up to which the bitmap of their hashes grows with them, 16 bits a head.
FEW_HEADS = 1 << 14
#: Characters of all heads up to which texts are searched for them by a pattern.
FEW_CHARS = 256
#: Texts up to this length are cut by ``substring``, longer ones as arrays of characters.
SHORT_TEXT = 256


def _literal(text: str) -> str:
    """A pattern that matches this text alone; control characters and all others
    but letters, digits and ``_`` by their code."""
    return "".join(x if x.isascii() and (x.isalnum() or x == "_") else f"\\x{{{ord(x):x}}}" for x in text)


def _head_size(length: Column) -> Column:
    """The greatest power of two that is no greater."""
    return F.pow(F.lit(2), F.floor(F.log2(length + 0.5))).cast("int")


def _grams(df: DataFrame, keep: str, text: str, sizes: Column, wanted=None) -> DataFrame:
    """(keep, gram, tail) for every substring of the lengths ``sizes`` that is
    ``wanted``; ``tail`` is what begins there, up to one character less than
    twice the length. Others are dropped before they make a row."""
    long = F.length(text) > SHORT_TEXT
    chars = df.filter(F.col(text) != "").select(
        keep, F.col(text).alias("_t"), F.explode(F.array(F.when(long, F.split(text, "")))).alias("_chars"), sizes.alias("_sizes")
    )
    n = F.length("_t")

    def of_size(part):
        def made(w: Column) -> Column:
            starts = F.when(n >= w, F.sequence(F.lit(1), n - w + 1)).otherwise(F.array().cast("array<int>"))
            found = F.transform(starts, lambda i: F.struct(part(i, w).alias("gram"), i.alias("i")))
            if wanted is not None:
                found = F.filter(found, lambda g: wanted(g["gram"]))
            return F.transform(found, lambda g: F.struct(g["gram"].alias("gram"), part(g["i"], 2 * w - 1).alias("tail")))

        return F.flatten(F.transform("_sizes", made))

    short = of_size(lambda i, size: F.substring("_t", i, size))
    cut = of_size(lambda i, size: F.array_join(F.slice("_chars", i, size), ""))
    return chars.select(keep, F.explode(F.when(F.col("_chars").isNull(), short).otherwise(cut)).alias("_g")).select(keep, "_g.gram", "_g.tail")


def _among(heads: DataFrame, n: int):
    """A condition that holds for all ``heads`` and for few other strings: bits
    of a bitmap of their hashes, at most 64 KB, in the plan itself."""
    bits = max(64, 1 << (16 * min(n, FEW_HEADS)).bit_length())
    at = lambda x: F.xxhash64(x).bitwiseAND(F.lit(bits - 1))
    place = lambda x: at(x).bitwiseAND(F.lit(63)).cast("int")
    found = heads.groupBy(F.shiftright(at("head"), 6).cast("int").alias("w")).agg(
        F.bit_or(F.call_function("shiftleft", F.lit(1).cast("long"), place("head"))).alias("bits")
    )
    held = {r["w"]: r["bits"] for r in found.collect()}
    # one text, which is folded to an array once
    table = F.split(F.lit(",".join(str(held.get(w, 0)) for w in range(bits // 64))), ",").cast("array<bigint>")
    return lambda x: F.getbit(F.get(table, F.shiftright(at(x), 6).cast("int")), place(x)) == 1


def containing(texts: DataFrame, text: str, needles: DataFrame, needle: str) -> DataFrame:
    """Rows of ``texts`` once for each different needle that ``text`` contains,
    with the needle as a column. Empty needles and texts match nothing.

    The head of a needle is its first 1, 2, 4, 8, ... characters, more than half
    of it. A place of a text meets the heads, and where one begins, the pieces
    of the lengths that needles of this head have are looked up whole: a needle
    is compared with no text that only resembles it, and work grows with the
    places of the texts, however many needles are alike. Places meet a bitmap of
    the heads first, the heads themselves by their key; nothing is broadcast.
    """
    held = texts.select(F.col(text).alias("_text")).filter("_text <> ''").distinct()
    held = cut_lineage(held).withColumn("_id", F.monotonically_increasing_id())
    size = F.length("_needle")
    longest = held.agg(F.max(F.length("_text"))).first()[0] or 0  # no text holds a longer needle
    asked = needles.select(F.col(needle).alias("_needle")).filter((F.col("_needle") != "") & (size <= longest))
    asked = cut_lineage(asked.distinct())
    heads = asked.groupBy(F.left("_needle", _head_size(size)).alias("head")).agg(F.collect_set(size).alias("sizes"))
    heads = cut_lineage(heads)
    long = F.length("head")
    known = heads.agg(F.count("*").alias("n"), F.sum(long).alias("chars"), F.array_sort(F.collect_set(long)).alias("sizes")).first()
    if not known["n"]:
        return texts.withColumn(needle, F.lit(None).cast("string")).limit(0)
    session = held.sparkSession
    tasks = max(session.sparkContext.defaultParallelism, int(session.conf.get("spark.sql.shuffle.partitions")))
    spread = held.repartition(tasks, "_id")  # some MB of a file hold a million texts
    if known["chars"] <= FEW_CHARS:  # most texts hold none: one pass of a pattern drops them before they are cut
        spread = spread.filter(F.col("_text").rlike("|".join(sorted(_literal(r["head"]) for r in heads.select("head").collect()))))
    places = _grams(spread, "_id", "_text", F.array(*map(F.lit, known["sizes"])), _among(heads, known["n"]))
    places = cut_lineage(places)  # read twice, and cutting texts is what costs
    begun = skew_lookup(places.withColumnRenamed("gram", "head"), heads, ["head"], ["_id"], "inner")
    pieces = begun.select("_id", "tail", F.explode("sizes").alias("_size")).filter(F.length("tail") >= F.col("_size"))
    pieces = pieces.select("_id", F.left("tail", F.col("_size")).alias("_needle"))
    hits = pieces.join(by_merge(asked), "_needle").distinct().join(by_merge(held), "_id").select("_text", "_needle")
    return texts.join(by_merge(hits), texts[text] == hits["_text"]).drop("_text").withColumnRenamed("_needle", needle)


def either_contains(texts: DataFrame, names: DataFrame) -> DataFrame:
    """First name (by seq) that contains a text or is contained in it.

    ``texts``: text. ``names``: name, seq, value. Works on distinct strings,
    each side as needles of the other.
    """
    best = cut_lineage(names.groupBy("name").agg(F.min(F.struct("seq", "value")).alias("best")))  # read five times
    asked = texts.select("text").distinct()
    inner = containing(asked, "text", best, "name").join(by_merge(best), "name").select("text", "best")
    outer = containing(best, "name", asked, "text").groupBy("text").agg(F.min("best").alias("best"))
    return (
        inner.unionByName(outer)
        .groupBy("text")
        .agg(F.min("best").alias("best"))
        .select("text", "best.seq", "best.value")
    )


def dependency_edges(deps: DataFrame, targets: DataFrame) -> DataFrame:
    """``deps``: source_id, ref → the first entity whose name matches loosely."""
    found = either_contains(
        deps.select(F.col("ref").alias("text")),
        targets.select("name", "seq", F.col("entity_id").alias("value")),
    ).select(F.col("text").alias("ref"), F.col("value").alias("target_id"))
    return skew_lookup(deps, found, ["ref"], ["source_id"], "inner")


# ---- integration flows ------------------------------------------------------


def call_matches(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Distinct called URLs with the endpoints that answer them.

    ``calls``: method, url. ``endpoints``: method, path, handler_function.
    Equal URLs are a special case of equal normalised URLs, so one equi-join
    on (method, normalised URL) finds all matches. Sites are counted before
    joining: a URL called from a third of all files is one row here, and
    ``n_flows`` says how many call-endpoint pairs it stands for.
    """
    c = (
        calls.groupBy(F.upper("method").alias("method"), "url")
        .agg(F.count("*").alias("n_calls"))
        .withColumn("norm_url", normal_url(F.col("url")))
    )
    e = (
        endpoints.groupBy(F.upper("method").alias("method"), F.col("path").alias("url"))
        .agg(F.count("*").alias("n_exact"), F.min("handler_function").alias("exact_handler"))
        .withColumn("norm_url", normal_url(F.col("url")))
    )
    e = cut_lineage(e)  # read twice, and finding endpoints is what costs
    by_shape = e.groupBy("method", "norm_url").agg(
        F.sum("n_exact").alias("n_all"), F.min("exact_handler").alias("any_handler")
    )
    # One row per shape on one side; both sides are distinct URLs by now, and
    # reading them once matters more than salting what adaptive joins split.
    shaped = c.join(by_merge(by_shape), ["method", "norm_url"])
    exact = e.select("method", "url", "n_exact", "exact_handler")
    n_exact = F.coalesce("n_exact", F.lit(0))
    return shaped.join(by_merge(exact), ["method", "url"], "left").select(
        "method",
        "url",
        "norm_url",
        "n_calls",
        n_exact.cast("long").alias("n_exact"),
        (F.col("n_all") - n_exact).cast("long").alias("n_similar"),
        (F.col("n_calls") * F.col("n_all")).alias("n_flows"),
        F.when(n_exact > 0, 1.0).otherwise(0.8).alias("confidence"),
        F.coalesce("exact_handler", "any_handler").alias("handler"),
    )


def endpoint_usage(calls: DataFrame, endpoints: DataFrame) -> DataFrame:
    """Flows per endpoint path, counted from pre-aggregated sides."""
    c = calls.groupBy(F.upper("method").alias("method"), normal_url(F.col("url")).alias("norm_url")).agg(
        F.count("*").alias("n_calls")
    )
    e = endpoints.groupBy(F.upper("method").alias("method"), "path").agg(F.count("*").alias("n_endpoints"))
    e = e.withColumn("norm_url", normal_url(F.col("path")))
    return (
        e.join(by_merge(c), ["method", "norm_url"])
        .groupBy("path")
        .agg(F.sum(F.col("n_calls") * F.col("n_endpoints")).alias("n_flows"))
    )


def url_confidence(url: Column, path: Column) -> Column:
    """1.0 equal, 0.8 equal up to parameters, 0.6 contained, else 0.3."""
    return (
        F.when(url == path, 1.0)
        .when(normal_url(url) == normal_url(path), 0.8)
        .when(url.contains(path) | path.contains(url), 0.6)
        .otherwise(0.3)
    )


def action_confidence(target: Column, name: Column) -> Column:
    return (
        F.when(target.isNull() | (target == ""), 0.3)
        .when(target == name, 1.0)
        .when(target.contains(name) | name.contains(target), 0.7)
        .otherwise(0.4)
    )


def action_matches(components: DataFrame, actions: DataFrame) -> DataFrame:
    """Distinct page targets with the web actions they reach.

    ``components``: target_action. ``actions``: name, path. A target reaches
    an action that it names or whose path contains it.
    """
    t = (
        components.filter(F.coalesce("target_action", F.lit("")) != "")
        .groupBy(F.col("target_action").alias("target"))
        .agg(F.count("*").alias("n_components"))
    )
    a = actions.groupBy("name", "path").agg(F.count("*").alias("n_actions"))
    # each is read several times, and the extraction behind it is what costs
    t, a = cut_lineage(t), cut_lineage(a)
    reached = containing(a, "path", t, "target").unionByName(a.withColumn("target", F.col("name"))).distinct()
    return (
        reached.join(by_merge(t), "target")
        .select(
            "target",
            "name",
            "path",
            action_confidence(F.col("target"), F.col("name")).alias("confidence"),
            "n_components",
            "n_actions",
            (F.col("n_components") * F.col("n_actions")).alias("n_flows"),
        )
    )


# ---- rules -------------------------------------------------------------------


def rule_entities(rules: DataFrame, entities: DataFrame) -> DataFrame:
    """Rules with the first entity their code reference points at.

    ``rules``: rule_id, code_reference. ``entities``: entity_id, file_path,
    name, seq. ``file:code`` asks for a path containing the file part and a
    name containing, or contained in, the code part; failing that, a path
    containing the whole reference.
    """
    refs = rules.select("code_reference").distinct()
    parts = refs.filter(F.col("code_reference").contains(":")).select(
        "code_reference",
        F.regexp_extract("code_reference", r"(?s)^([^:]*):", 1).alias("file_part"),
        F.regexp_extract("code_reference", r"(?s)^[^:]*:(.*)$", 1).alias("code_part"),
    )
    # entities reachable through each asked file part, reduced per name
    asked_files = parts.select("file_part").distinct()
    paths = entities.select("file_path").distinct()
    hits = containing(paths, "file_path", asked_files, "file_part")
    named = entities.groupBy("file_path", "name").agg(F.min(F.struct("seq", "entity_id")).alias("best"))
    within = cut_lineage(  # read four times
        hits.join(by_merge(named), "file_path").groupBy("file_part", "name").agg(F.min("best").alias("best"))
    )
    code_has_name = (
        containing(parts, "code_part", within, "name")
        .join(by_merge(within), ["file_part", "name"])
        .select("code_reference", "best")
    )
    name_has_code = (
        containing(within, "name", parts, "code_part")
        .groupBy("file_part", "code_part")
        .agg(F.min("best").alias("best"))
        .join(by_merge(parts), ["file_part", "code_part"])
        .select("code_reference", "best")
    )
    by_code = code_has_name.unionByName(name_has_code).withColumn("step", F.lit(1))
    per_path = entities.groupBy("file_path").agg(F.min(F.struct("seq", "entity_id")).alias("best"))
    by_path = (
        containing(per_path, "file_path", refs, "code_reference")
        .groupBy("code_reference")
        .agg(F.min("best").alias("best"))
        .join(by_merge(refs), "code_reference")
        .select("code_reference", "best")
        .withColumn("step", F.lit(2))
    )
    chosen = (
        by_code.unionByName(by_path)
        .groupBy("code_reference")
        .agg(F.min(F.struct("step", "best")).alias("c"))
        .select("code_reference", F.col("c.best.entity_id").alias("entity_id"))
    )
    return skew_lookup(rules, chosen, ["code_reference"], ["rule_id"], "inner")


def _single_links(rules: DataFrame) -> DataFrame:
    link = lambda kind, key: F.struct(F.lit(kind).alias("kind"), key.alias("key"))
    single = F.array(
        link("entity", F.col("code_entity_id").cast("string")),
        link("class", F.when(F.col("class_context") != "", F.col("class_context"))),
        link("category", F.col("category")),
    )
    return (
        rules.select("rule_id", F.explode(single).alias("x"))
        .filter(F.col("x.key").isNotNull())
        .select("rule_id", F.col("x.kind").alias("link_kind"), F.col("x.key").alias("link_key"))
    )


def _shared_groups(rows: DataFrame) -> DataFrame:
    return with_totals(rows, ["link_kind", "link_key"], ["rule_id"], "members").filter(F.col("members") > 1)


def rule_links(rules: DataFrame) -> DataFrame:
    """What ties rules together, as membership of link groups.

    ``rules``: rule_id, code_entity_id, class_context, category, description.
    Two rules are related exactly when they share a group: the same entity,
    class or category, or the same pair of meaningful description words. A
    description of w shared words is in w(w-1)/2 groups, so this listing is for
    short ones; ``related_bands`` does without it. Groups of one are dropped.
    """
    # a word of one rule alone ties nothing, and most words of long texts are such
    words = rules.select("rule_id", F.explode(meaningful_words(F.col("description"))).alias("word"))
    shared = cut_lineage(with_totals(words, ["word"], ["rule_id"], "n").filter(F.col("n") > 1).select("rule_id", "word"))
    other = shared.select("rule_id", F.col("word").alias("later"))
    pairs = shared.join(other, "rule_id").filter(F.col("word") < F.col("later")).select(
        "rule_id", F.lit("words").alias("link_kind"), F.concat_ws(" ", "word", "later").alias("link_key")
    )
    return _shared_groups(_single_links(rules).unionByName(pairs))


def _bands(many: DataFrame, near: DataFrame) -> DataFrame:
    """``many``: ids with five partners at least. ``near``: (id, other)."""
    counted = near.groupBy("id").agg(F.countDistinct("other").cast("int").alias("n"))
    n = F.max("n")
    band = F.when(n >= 5, "5+").when(n >= 3, "3-4").when(n == 2, "2").otherwise("1")
    return many.select("id").distinct().withColumn("n", F.lit(5)).unionByName(counted).groupBy("id").agg(band.alias("band"))


def overlap_bands(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, band): how many other rows share two meaningful words or more."""
    sets = texts.select(F.col(key).alias("id"), meaningful_words(F.col(text)).alias("words"))
    return _bands(*overlapping_sets(sets)).withColumnRenamed("id", key)


def related_bands(rules: DataFrame) -> DataFrame:
    """How many different rules each rule is related to (see ``rule_links``), as
    the band that the impact levels and the hierarchy ask for: ``1``, ``2``,
    ``3-4`` or ``5+``; unrelated rules are left out.

    A group of more than five members decides for ``5+`` by itself. Smaller
    groups list their members, at most five each, and are counted exactly,
    together with the rules of shared words, which an overlap join finds.
    """
    links = cut_lineage(_shared_groups(_single_links(rules)))
    big = links.filter(F.col("members") > 5).select(F.col("rule_id").alias("id"))
    small = links.filter(F.col("members") <= 5)
    lists = small.groupBy("link_kind", "link_key").agg(F.collect_set("rule_id").alias("ids"))
    listed = (
        small.join(lists, ["link_kind", "link_key"])
        .select(F.col("rule_id").alias("id"), F.explode("ids").alias("other"))
        .filter(F.col("other") != F.col("id"))
    )
    many, near = overlapping_sets(rules.select(F.col("rule_id").alias("id"), meaningful_words(F.col("description")).alias("words")))
    return _bands(big.unionByName(many), listed.unionByName(near)).withColumnRenamed("id", "rule_id")


def rules_by_name(entities: DataFrame, rules: DataFrame) -> DataFrame:
    """Distinct entity names with the rule paths that contain them.

    ``entities``: name. ``rules``: rule_path. Rules are counted per path
    before matching; each distinct path yields one row per distinct name in it.
    """
    paths = rules.groupBy("rule_path").agg(F.count("*").alias("n_rules"))
    names = entities.select("name").distinct()
    return (
        containing(paths, "rule_path", names, "name").select("name", "rule_path", "n_rules")
    )


def rule_contexts(rules: DataFrame, closure: DataFrame, entities: DataFrame, keep: str = "last") -> DataFrame:
    """Rules with the class and method they sit in.

    ``closure``: ancestor, descendant, depth. Of several enclosing classes the
    outermost is the ``first`` on the way down, the innermost the ``last``.
    Contexts are worked out once per entity, then looked up by the rules.
    """
    pick = F.min_by if keep == "last" else F.max_by
    kind = F.col("type")
    is_class, is_method = kind.isin("class", "interface"), kind.isin("method", "function")
    typed = entities.select(F.col("entity_id").alias("ancestor"), "type", "name")
    contexts = (
        skew_lookup(closure, typed, ["ancestor"], ["descendant"], "inner")
        .filter(is_class | is_method)
        .groupBy(F.col("descendant").alias("entity_id"))
        .agg(
            pick("name", F.when(is_class, F.col("depth"))).alias("class_context"),
            pick("name", F.when(is_method, F.col("depth"))).alias("method_context"),
        )
    )
    return skew_lookup(rules, contexts, ["entity_id"], ["rule_id"], "left")


# ---- presence ----------------------------------------------------------------


def known_only(edges: DataFrame, known: DataFrame, target: str) -> DataFrame:
    """Edges whose target is a known class."""
    return edges.join(known.select(F.col("name").alias(target)).distinct(), target, "left_semi")


def absent(incoming: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not there yet; one row per key."""
    return incoming.dropDuplicates([key]).join(existing.select(key).distinct(), key, "left_anti")


def missing_columns(expected: DataFrame, actual: DataFrame) -> DataFrame:
    """(table_name, column_name) expected but not present."""
    return expected.join(actual, ["table_name", "column_name"], "left_anti")
