"""Overlap join: which sets share at least two elements.

Listing every pair of a set's elements grows with the square of the set.
``overlapping_sets`` settles most sets by a few pairs of frequent elements, which
only have to be counted. The others look for partners through inverted lists,
first among few sets and then among all, so that whoever has many partners is
settled by few. ``overlapping``, for rows of short sets, orders elements by
rarity; each set enumerates pairs with its few most frequent elements only, and
the remaining sets meet the others through inverted lists of all elements but
their most frequent one.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from codeloom.operators.skew import by_merge, with_totals
from codeloom.session import cut_lineage

#: Most frequent elements of all that are paired with each other (broadcast).
COMMON = 256
#: Most frequent elements of a set that are paired, with its others or each other.
TOP = 4
#: Sets among which partners are looked for first, at least.
WITNESSES = 1024
#: Times as many in each round that follows, up to all.
STEP = 8


def _settled(sets: DataFrame, counts: DataFrame, enough: int) -> DataFrame:
    """Ids of the sets with a pair of their most frequent common words that more
    than ``enough`` sets have. A set makes six rows at most."""
    order = F.array_sort(F.collect_list(F.struct((-F.col("n")).alias("n"), "word")))
    common = counts.orderBy(F.desc("n"), "word").limit(COMMON).agg(F.transform(order, lambda x: x["word"]).alias("common"))
    heads = sets.join(F.broadcast(cut_lineage(common))).select("id", F.slice(F.array_intersect("common", "words"), 1, TOP).alias("h"))
    pair = lambda i, j: F.when(F.size("h") > j, F.struct(F.get("h", F.lit(i)).alias("a"), F.get("h", F.lit(j)).alias("b")))
    pairs = heads.select("id", F.explode(F.array_compact(F.array(*[pair(i, j) for i, j in combinations(range(TOP), 2)]))).alias("p"))
    pairs = cut_lineage(pairs.select("id", "p.a", "p.b"))
    # no more than COMMON ** 2 / 2 rows
    often = pairs.groupBy("a", "b").agg(F.countDistinct("id").alias("n")).filter(F.col("n") > enough).select("a", "b")
    return cut_lineage(pairs.join(F.broadcast(often), ["a", "b"], "left_semi").select("id").distinct())


def _partners(asked: DataFrame, words: DataFrame) -> DataFrame:
    """(id, other) for the ids of ``asked`` and the sets of ``words`` that share
    two words. ``asked``: id, word, and ``first``, true for one word of an id.

    Of two shared words one is not the first: the lists of the others find every
    partner, and where one shared word was met, the first is looked up.
    """
    held = words.select(F.col("id").alias("other"), "word")
    rest = asked.filter(~F.col("first")).select("id", "word")
    met = rest.join(by_merge(held), "word").filter(F.col("id") != F.col("other"))
    met = cut_lineage(met.groupBy("id", "other").agg(F.count("*").alias("n")))
    firsts = asked.filter("first").select("id", "word")
    once = met.filter("n = 1").join(by_merge(firsts), "id").join(by_merge(held), ["other", "word"], "left_semi")
    return met.filter("n > 1").select("id", "other").unionByName(once.select("id", "other"))


def overlapping(elements: DataFrame, enough: int = 5, top: int = TOP) -> tuple[DataFrame, DataFrame]:
    """(many, near): ids of sets with at least ``enough`` partners, and (id,
    other) with all partners of every other set; sets without one are in
    neither. Some ids of ``near`` may have ``enough`` partners as well.

    ``elements``: id, word, distinct. Partners share two words or more. Rows
    grow with the number of words, save for the inverted lists: two frequent
    words meet in one list only when few sets hold both among their most
    frequent, since more would have settled those sets.
    """
    # a word of one set alone ties nothing, and most words of long texts are such
    shared = with_totals(elements.select("id", "word"), ["word"], ["id"], "n").filter(F.col("n") > 1)
    order = Window.partitionBy("id").orderBy(F.desc("n"), F.desc("word"))
    words = cut_lineage(shared.withColumn("rank", F.row_number().over(order)).select("id", "word", "rank"))

    heads = words.filter(F.col("rank") <= top).select("id", F.col("word").alias("head"), F.col("rank").alias("of"))
    pairs = words.join(heads, "id").filter(F.col("rank") > F.col("of")).select("id", "word", "head")
    many = with_totals(pairs, ["word", "head"], ["id"], "n").filter(F.col("n") > enough).select("id").distinct()
    many = cut_lineage(many)

    # the rarer of two shared words is the most frequent word of neither set
    left = words.filter(F.col("rank") > 1)
    asked = left.join(many, "id", "left_anti").select("id", "word")
    met = asked.join(left.select(F.col("id").alias("other"), "word"), "word").filter(F.col("id") != F.col("other"))
    met = cut_lineage(met.groupBy("id", "other").agg(F.count("*").alias("n")))
    twice = met.filter(F.col("n") > 1).select("id", "other")
    # one shared word besides the first ones: the second is the first word of a side
    once = met.filter(F.col("n") == 1).select("id", "other")
    first = words.filter(F.col("rank") == 1)
    own = once.join(first.select("id", "word"), "id").join(words.select(F.col("id").alias("other"), "word"), ["other", "word"], "left_semi")
    theirs = once.join(first.select(F.col("id").alias("other"), "word"), "other").join(words.select("id", "word"), ["id", "word"], "left_semi")
    near = twice.unionByName(own.select("id", "other")).unionByName(theirs.select("id", "other")).distinct()
    return many, near


def overlapping_sets(sets: DataFrame, enough: int = 5) -> tuple[DataFrame, DataFrame]:
    """As ``overlapping``, of ``sets``: id, words (an array, distinct); for long
    sets, of which no word is shuffled until few sets are left.

    Rows of the first step grow with the number of sets. What it leaves asks for
    partners among a hash share of the sets, at least ``WITNESSES``; five found
    there settle an id, and only the others ask ``STEP`` times as many sets, at
    last all. No result depends on the shares.
    """
    words = sets.select("id", F.explode("words").alias("word"))
    counts = cut_lineage(words.groupBy("word").agg(F.count("*").alias("n")).filter("n > 1"))
    settled = [_settled(sets, counts, enough)]
    others = cut_lineage(sets.select("id").join(by_merge(settled[0]), "id", "left_anti"))
    # a word of one set alone ties nothing
    asked = words.join(others, "id", "left_semi").join(by_merge(counts), "word")
    first = asked.groupBy("id").agg(F.max(F.struct("n", "word")).alias("f"))
    asked = cut_lineage(asked.join(by_merge(first), "id").select("id", "word", (F.col("word") == F.col("f.word")).alias("first")))

    share = 1
    n = sets.count()
    while n // (share * STEP) >= WITNESSES:
        share *= STEP
    while share > 1:
        some = words.filter(F.pmod(F.xxhash64("id"), F.lit(share)) == 0)
        found = _partners(asked, some).groupBy("id").agg(F.count("*").alias("n")).filter(F.col("n") >= enough)
        settled.append(cut_lineage(found.select("id")))
        asked = cut_lineage(asked.join(by_merge(settled[-1]), "id", "left_anti"))
        share //= STEP
    # of all sets only the words that are asked for are kept
    wanted = asked.select("word").distinct()
    held = words.join(by_merge(wanted), "word", "left_semi")
    many = settled[0]
    for one in settled[1:]:
        many = many.unionByName(one)
    return many, _partners(asked, cut_lineage(held))
