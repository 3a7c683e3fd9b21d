"""Regex hits with positions, line numbers and small text idioms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words ignored when two rule descriptions are compared.
STOP_WORDS = (
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would",
    "could", "should", "may", "might", "must", "can", "cannot", "this", "that", "these", "those",
)

# Names followed by "(" that are not calls.
CALL_KEYWORDS = (
    "if", "for", "while", "try", "catch", "switch", "return", "new", "delete", "typeof", "instanceof",
)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once per row and hand it to ``body``.

    Without this a column used inside a higher-order function is evaluated
    again for every array element.
    """
    return F.transform(F.array(value), body)[0]


def strings(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


def newlines(value: Column) -> Column:
    return F.length(value) - F.length(F.replace(value, F.lit("\n"), F.lit("")))


def contains_any(value: Column, needles) -> Column:
    out = F.lit(False)
    for needle in needles:
        out = out | value.contains(needle)
    return out


def present(*conditional: Column) -> Column:
    """Array of the given nullable strings without the nulls."""
    return F.array_compact(F.array(*conditional))


def quoted(value: str) -> str:
    """SQL string literal."""
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def apply_sql(value: Column, body: str) -> Column:
    """``body`` is SQL over ``t``; evaluated on ``value``, which is bound once.

    One parsed expression instead of hundreds of driver calls keeps building
    the larger extractors quick.
    """
    return F.call_function("transform", F.array(value), F.expr(f"t -> {body}"))[0]


def _bound(value: str, name: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


#: Matches of one text that are summed as a block.
HIT_BLOCK = 128


def regex_hits(text: Column, pattern: str, groups: int = 1, needs: str = "") -> Column:
    """All matches as ``array<struct<start,line,end,g0..gN>>``.

    ``needs`` is a lower-case literal every match contains; texts without it
    skip the pattern.

    ``start`` is the 0-based character offset, ``line`` is 1-based. Splitting
    on the same pattern yields the text between matches, so offsets and line
    numbers are prefix sums; nothing leaves the JVM. The sums are taken over
    blocks of ``HIT_BLOCK`` matches first, so a match adds up the rest of its
    own block only, however many matches the text has. A text without matches
    is read once, one with less than a block needs no sums of blocks.
    """
    p = quoted(pattern)
    every = range(groups + 1)
    breaks = "length({0}) - length(replace({0}, '\\n', ''))".format
    found = "named_struct('gaps', split(t, {p}, -1), 'g0', f{g})".format(
        p=p, g="".join(f", 'g{i}', regexp_extract_all(t, {p}, {i})" for i in every if i)
    )
    # from the end of the match before (or the text's start) up to this match
    before = "if(i = 0, '', get(m.g0, i - 1))"
    measured = "named_struct({g}, 'chars', {c}, 'lines', {n})".format(
        g=", ".join(f"'g{i}', m.g{i}" for i in every),
        c=f"transform(m.g0, (h, i) -> length(get(m.gaps, i)) + length({before}))",
        n=f"transform(m.g0, (h, i) -> {breaks('get(m.gaps, i)')} + {breaks(before)})",
    )
    add = "aggregate({0}, 0, (a, x) -> a + x)".format
    blocks = f"sequence(0, size(q.g0) div {HIT_BLOCK})"
    block_sum = "transform({b}, k -> {s})".format(
        b=blocks, s=add(f"slice(q.{{0}}, k * {HIT_BLOCK} + 1, {HIT_BLOCK})")
    ).format
    # what comes before each block
    before_block = lambda sums: _bound(sums, "b", f"transform(b, (x, k) -> {add('slice(b, 1, k)')})")
    prefix = lambda part: f"if(size(q.g0) < {HIT_BLOCK}, array(0), {before_block(block_sum(part))})"
    prefixed = "named_struct({g}, 'chars', q.chars, 'lines', q.lines, 'bc', {c}, 'bl', {n})".format(
        g=", ".join(f"'g{i}', q.g{i}" for i in every), c=prefix("chars"), n=prefix("lines")
    )
    total = (
        f"(get(w.{{1}}, i div {HIT_BLOCK}) + "
        + add(f"slice(w.{{0}}, i div {HIT_BLOCK} * {HIT_BLOCK} + 1, i % {HIT_BLOCK} + 1)")
        + ")"
    ).format
    one = "transform(array({s}), s -> named_struct('start', s, 'line', 1 + {n}, 'end', s + length(h), 'g0', h{g}))[0]".format(
        s=total("chars", "bc"),
        n=total("lines", "bl"),
        g="".join(f", 'g{i}', get(w.g{i}, i)" for i in every if i),
    )
    listed = f"transform(w.g0, (h, i) -> {one})"
    hits = _bound(found, "m", _bound(measured, "q", _bound(prefixed, "w", listed)))
    hits = _bound(f"regexp_extract_all(t, {p}, 0)", "f", f"if(size(f) = 0, array(), {hits})")
    if needs:
        hits = f"if(contains(lower(t), {quoted(needs)}), {hits}, array())"
    return apply_sql(text, hits)


def called_names(text: Column) -> Column:
    """Names directly followed by an opening bracket, keywords left out."""
    names = F.regexp_extract_all(text, F.lit(r"(?U)(\w+)\s*\("), F.lit(1))
    return F.filter(names, lambda n: ~n.isin(*CALL_KEYWORDS) & (F.length(n) > 1))


def words(text: Column) -> Column:
    """Distinct lower-case words between white space."""
    return F.array_distinct(
        F.filter(F.split(F.lower(text), r"(?U)\s+"), lambda w: F.length(w) > 0)
    )


def meaningful_words(text: Column) -> Column:
    return F.array_except(words(text), strings(STOP_WORDS))


def shared_words(left: Column, right: Column) -> Column:
    return F.array_except(F.array_intersect(words(left), words(right)), strings(STOP_WORDS))


def line_window(text: Column, first: Column, last: Column) -> Column:
    """Lines ``first``..``last`` (1-based, inclusive) of a text."""
    lo = F.greatest(first, F.lit(1))
    return F.array_join(
        F.slice(F.split(text, "\n", -1), lo, F.greatest(last - lo + 1, F.lit(0))), "\n"
    )


def char_window(text: Column, at: Column, reach: int) -> Column:
    """Characters from ``at - reach`` up to ``at + reach`` (0-based ``at``)."""
    lo = F.greatest(at - reach, F.lit(0))
    return F.substring(text, lo + 1, at + reach - lo)


def lossy_utf8(content: Column) -> Column:
    """Bytes to text; undecodable bytes vanish."""
    return F.replace(F.make_valid_utf8(content.cast("string")), F.lit("�"), F.lit(""))


def xml_like(text: Column) -> Column:
    body = F.trim(text)
    return body.startswith("<") & body.contains(">") & body.contains("</")


def substrings(text: Column, lengths: Column | None = None) -> Column:
    """All distinct non-empty substrings; for short names and paths only.

    Turns "a contains b" into an equi-join on the string itself. With
    ``lengths``, an array, only substrings of those lengths are made, so their
    number grows with the length of the text and not with its square.
    """
    n = F.length(text)
    every = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    asked = every if lengths is None else F.filter(lengths, lambda w: (w > 0) & (w <= n))

    def of_length(w: Column) -> Column:
        return F.transform(F.sequence(F.lit(1), n - w + 1), lambda i: F.substring(text, i, w))

    return F.array_distinct(F.flatten(F.transform(asked, of_length)))
