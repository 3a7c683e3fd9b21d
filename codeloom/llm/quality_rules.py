"""Quality rules with cross-document line frequency.

Rules within a document (length, repeated five-word windows) come first. Then
normalised lines are hashed and the documents that hold a line are counted per
host; lines held by too many are removed, and a document that loses most of
its words that way is rejected. Built-in column functions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Sealed, staged

BLANK = r"[\x20\x09-\x0D]+"
WINDOW = 5
#: A line that more documents of one host hold is removed.
MAX_DOCUMENTS = 50
#: A document is rejected when removed lines hold more than this share of its words.
MAX_DEPLETED = 0.5


def _words(text: Column) -> Column:
    return F.filter(F.split(text, BLANK), lambda w: w != "")


def _windows(words: Column) -> Column:
    """(hash, first word) of all five-word windows, sorted by hash."""
    n = F.size(words)

    def hashed(i: Column) -> Column:
        return F.struct(F.xxhash64(*[F.get(words, i + j) for j in range(WINDOW)]).alias("h"), i.alias("i"))

    starts = F.when(n >= WINDOW, F.sequence(F.lit(0), n - WINDOW)).otherwise(F.array().cast("array<int>"))
    return F.sort_array(F.transform(starts, hashed))


def _normal(lines: Column) -> Column:
    """(hash, words, position) of the normalised lines, sorted by hash."""

    def plain(x: Column) -> Column:
        joined = F.trim(F.regexp_replace(F.lower(x["x"]), BLANK, " "))
        return F.struct(F.regexp_replace(joined, r"\d", "0").alias("x"), x["i"].alias("i"))

    def hashed(x: Column) -> Column:
        n = F.size(F.split(x["x"], " ")).cast("long")
        return F.struct(F.xxhash64(x["x"]).alias("h"), n.alias("n"), x["i"].alias("i"))

    return F.sort_array(F.transform(F.transform(lines, plain), hashed))


def line_frequency_rules(
    df: DataFrame,
    *,
    text: str = "text",
    host: str = "source",
    max_documents: int = MAX_DOCUMENTS,
    max_share: float = 0.0,
    max_depleted: float = MAX_DEPLETED,
    keep_text: bool = True,
) -> DataFrame:
    """Adds ``n_words``, ``word_chars``, ``n_symbols``, ``n_dup_lines``,
    ``n_repeat_words``, ``base_failed``, ``n_frequent_words``, ``kept`` and
    ``removed_lines`` (positions from 0 of the removed lines in the text, in
    order; empty when there are none). With ``keep_text``, the text stays and
    ``depleted`` is the text without those lines (null for a null text).

    A line is removed when more than ``max_documents`` rows of its host hold
    it, and more than the share ``max_share`` of the host's rows; with 0, the
    number alone decides.

    Lines are compared after lower-casing, joining runs of blanks and writing
    digits as 0. A line counts once for each row that holds it; with a null
    host, rows form a host of their own. A null or empty text has no words and
    fails. Every row is kept, repeated ones too; columns of these names are
    replaced, others kept. An empty table gives none.

    Only line hashes and their word counts are shuffled, texts only when they
    are kept; counts
    are summed before the shuffle, so a line that a third of all documents
    holds arrives once per task.
    """
    made = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_frequent_words", "kept", "removed_lines"]
    made += ["depleted"] if keep_text else []
    own = Sealed(df, made, drop=() if keep_text else (text,))
    text, host = own.name(text), own.name(host)
    others = list(dict.fromkeys([*own.columns, host]))
    whole = own.table.select(*others, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    split = whole.withColumns(
        {
            "__words": _words(F.col("__text")),
            "__lines": F.filter(
                F.transform(F.split("__text", "\n"), lambda x, i: F.struct(x.alias("x"), i.alias("i"))),
                lambda x: x["x"].rlike(r"[^\x20\x09-\x0D]"),
            ),
        }
    ).withColumns({"__sorted": _windows(F.col("__words")), "__own": _normal(F.col("__lines"))})
    twice = F.filter(
        "__sorted",
        lambda x, i: (x["h"] == F.get("__sorted", i - 1)["h"]) | (x["h"] == F.get("__sorted", i + 1)["h"]),
    )
    at = split.withColumn("__at", F.sort_array(F.transform(twice, lambda x: x["i"])))
    gap = F.transform(
        "__at",
        lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get("__at", i + 1) - p, F.lit(WINDOW))),
    )
    n_words = F.size("__words").cast("long")
    stats = at.select(
        *others,
        F.monotonically_increasing_id().alias("__row"),
        n_words.alias("n_words"),
        F.char_length(F.array_join("__words", "")).cast("long").alias("word_chars"),
        F.regexp_count("__text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        (F.size("__lines") - F.size(F.array_distinct(F.col("__lines")["x"]))).cast("long").alias("n_dup_lines"),
        F.aggregate(gap, F.lit(0), lambda a, x: a + x).cast("long").alias("n_repeat_words"),
        # the first of equal lines stands for the document, all lose their words
        F.transform(
            "__own",
            lambda x, i: F.struct(
                x["h"].alias("h"),
                x["n"].alias("n"),
                x["i"].alias("i"),
                (~F.coalesce(x["h"] == F.get("__own", i - 1)["h"], F.lit(False))).alias("new"),
            ),
        ).alias("__own"),
    )
    held = staged(stats, "rules")
    lines = held.select("__row", F.col(host).alias("__host"), F.explode("__own").alias("l")).select(
        "__row", "__host", "l.*"
    )
    frequent = lines.groupBy("__host", "h").agg(F.count_if("new").alias("docs")).where(F.col("docs") > max_documents)
    if max_share > 0:
        hosts = held.groupBy(F.col(host).alias("__g")).agg(F.count(F.lit(1)).alias("__rows"))
        frequent = frequent.join(hosts, F.col("__host").eqNullSafe(F.col("__g"))).where(
            F.col("docs") > max_share * F.col("__rows")
        )
    frequent = frequent.select(F.col("__host").alias("__f"), F.col("h").alias("__h"))
    lost = (
        lines.join(frequent, F.col("__host").eqNullSafe(F.col("__f")) & (F.col("h") == F.col("__h")), "left_semi")
        .groupBy(F.col("__row").alias("__lost"))
        .agg(F.sum("n").alias("n_frequent_words"), F.sort_array(F.collect_list("i")).alias("removed_lines"))
    )
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    out = held.drop("__own").join(lost, F.col("__row") == F.col("__lost"), "left")
    out = out.withColumn("n_frequent_words", F.coalesce("n_frequent_words", F.lit(0)).cast("long")).withColumn(
        "base_failed", failed
    )
    kept = ~F.col("base_failed") & (F.col("n_frequent_words") <= max_depleted * F.col("n_words"))
    out = out.withColumns(
        {"kept": kept, "removed_lines": F.coalesce("removed_lines", F.array().cast("array<int>"))}
    )
    if keep_text:
        # one split for all lines of a text: the explode keeps it out of the lambda
        out = out.withColumn("__all", F.explode(F.array(F.split(F.coalesce(F.col(text), F.lit("")), "\n"))))
        stay = F.array_except(F.sequence(F.lit(0), F.size("__all") - 1), F.col("removed_lines"))
        left = F.array_join(F.transform(stay, lambda i: F.get("__all", i)), "\n")
        out = out.withColumn("depleted", F.when(F.col(text).isNotNull(), left))
    return own.restored(out)
