"""Removal of passages that repeat across documents.

Hashes only nominate: windows of words whose hash occurs in several documents
mark passages of the document that has them first. Those passages are compiled
into Aho-Corasick automata, one for each shard of documents, and the documents
stream through to find every occurrence, which is then extended and compared
word by word.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, Rolling, Words, distinct, staged, text_chunks, word_bytes

WINDOW = 50
#: Words of the gram that nominates a window: the least hash of those inside.
GRAM = 16
#: Words of the phrases in an automaton. Two lie side by side in a window, so
#: every window holds a whole one wherever it starts.
TILE = WINDOW // 2
#: Window starts that one passage covers, and bytes of documents in a shard.
PASSAGE, SHARD_BYTES = 200, 2 << 20
_OTHER = 0xA24BAED4963EE407


def nominated(words: np.ndarray, bounds: np.ndarray, tool: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, first word, least gram hash) of every window of the texts.

    The hash depends on the window's words alone, so equal windows have equal
    ones; consecutive windows mostly share theirs, so there are few of them.
    """
    _, grams = tool.windows(words, bounds, GRAM)
    inside = WINDOW - GRAM + 1
    size = np.diff(bounds)
    count = np.maximum(size - WINDOW + 1, 0)
    row = np.repeat(np.arange(len(size)), count)
    if not len(row):
        return row, row, np.zeros(0, np.uint64)
    least, span = grams, 1
    while 2 * span <= inside:
        least, span = np.minimum(least[:-span], least[span:]), 2 * span
    rest = inside - span
    least = np.minimum(least[: len(least) - rest], least[rest:])
    at = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
    first_gram = np.concatenate(([0], np.cumsum(np.maximum(size - GRAM + 1, 0))))[:-1]
    return row, bounds[row] + at, least[first_gram[row] + at]


def _words_of(data: np.ndarray, offsets: np.ndarray, tool: Words):
    start, end = tool.split(data, offsets)
    return start, end, tool.hashes(data, start, end), np.searchsorted(start, offsets)


def _surveyed(docs: DataFrame) -> DataFrame:
    """For each document a summary row (hash null) with its number of words and
    the digest of its words, and a row for each nominating hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Words(word_bytes(BLANKS))
        for batch in batches:
            for base, data, offsets in text_chunks(batch.column("text")):
                start, end, words, bounds = _words_of(data, offsets, tool)
                row, _, gram = nominated(words, bounds, tool)
                gram, row = distinct(gram, row)
                n, m = len(offsets) - 1, len(row)
                whole = data.tobytes()
                digests = [
                    hashlib.sha256(b" ".join(whole[a:b].split())).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())
                ]
                own = batch.column("key").slice(base, n)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([own, own.take(pa.array(row))]),
                        pa.concat_arrays([pa.nulls(n, pa.int64()), pa.array(gram.view(np.int64))]),
                        pa.array(np.concatenate((np.diff(bounds), np.zeros(m, np.int64)))),
                        pa.concat_arrays([pa.array(digests, pa.binary()), pa.nulls(m, pa.binary())]),
                    ],
                    names=["key", "gram", "n_words", "digest"],
                )

    return docs.mapInArrow(rows, "key long, gram long, n_words long, digest binary")


def _windows(candidates: DataFrame) -> DataFrame:
    """(h, g, key, at) of each different window of a document that a recurring
    gram nominates; h and g are 96 bits of hash."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, second = Words(word_bytes(BLANKS)), Rolling(_OTHER)
        for batch in batches:
            lists = batch.column("grams")
            for base, data, offsets in text_chunks(batch.column("text")):
                _, _, words, bounds = _words_of(data, offsets, tool)
                row, first, gram = nominated(words, bounds, tool)
                cuts = np.searchsorted(row, np.arange(len(offsets)))
                keep = np.zeros(len(row), bool)
                for r in range(len(offsets) - 1):
                    own = slice(cuts[r], cuts[r + 1])
                    keep[own] = np.isin(gram[own].view(np.int64), lists[base + r].values.to_numpy())
                row, first = row[keep], first[keep]
                h = tool.runs.slices(words, first, first + WINDOW)
                g = second.slices(words, first, first + WINDOW)
                # a window that repeats within the document counts once
                order = np.lexsort((first, h, row))
                new = np.ones(len(order), bool)
                new[1:] = (h[order][1:] != h[order][:-1]) | (row[order][1:] != row[order][:-1])
                pick = order[new]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(h[pick].view(np.int64)),
                        pa.array((g[pick] >> np.uint64(32)).astype(np.uint32).view(np.int32)),
                        batch.column("key").take(pa.array(row[pick] + base)),
                        pa.array((first - bounds[row])[pick].astype(np.int32)),
                    ],
                    names=["h", "g", "key", "at"],
                )

    return candidates.select("key", "text", "grams").mapInArrow(rows, "h long, g int, key long, at int")


def _passages(needed: DataFrame) -> DataFrame:
    """(first, piece, words) of the wanted passages; ``needed`` has the texts
    of the first documents and the numbers of their passages."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, pieces, words = [], [], []
            for key, text, wanted in zip(*(batch.column(c).to_pylist() for c in ("key", "text", "pieces"))):
                split = text.encode().split()
                for p in wanted:
                    cut = b" ".join(split[p * PASSAGE : (p + 1) * PASSAGE + WINDOW - 1])
                    keys.append(key)
                    pieces.append(p)
                    words.append(cut.decode())
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(pieces, pa.int32()), pa.array(words, pa.string())],
                names=["first", "piece", "words"],
            )

    return needed.select("key", "text", "pieces").mapInArrow(rows, "first long, piece int, words string")


def _automaton(passages: list[list[int]]):
    """Automaton of the tiles of all passages, as sequences of word numbers;
    its values list where each tile lies."""
    places: dict[tuple[int, ...], list[tuple[int, int]]] = {}
    for p, numbers in enumerate(passages):
        for at in range(0, len(numbers) - TILE + 1, TILE):
            places.setdefault(tuple(numbers[at : at + TILE]), []).append((p, at))
    automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
    for tile, where in places.items():
        automaton.add_word(tile, where)
    automaton.make_automaton()
    return automaton


def repeated_spans(
    words: list[bytes], numbers: np.ndarray, automaton, passages: list[tuple[list[bytes], np.ndarray]], needed: set[int]
) -> list[tuple[int, int]]:
    """Disjoint word spans of a document that its smaller documents hold in
    windows: each tile found is extended over its passage while words agree.

    ``needed`` are the passages that hold the document's windows first. Others
    of the shard could add nothing, and where one word repeats for long, the
    same tile lies in very many of them.
    """
    covered = np.zeros(len(words) + 1, np.int64)
    done: dict[tuple[int, int], int] = {}
    for end, places in automaton.iter(tuple(numbers.tolist())):
        start = end - TILE + 1
        for p, at in places:
            shift = start - at  # the document's word for the passage's word 0
            if p not in needed or done.get((p, shift), 0) > start:
                continue
            own, own_numbers = passages[p]
            low, high = max(0, -shift), min(len(own), len(words) - shift)
            differ = np.flatnonzero(own_numbers[low:high] != numbers[low + shift : high + shift]) + low
            i = int(np.searchsorted(differ, at))
            left = int(differ[i - 1]) + 1 if i else low
            right = int(differ[i]) if i < len(differ) else high
            done[p, shift] = right + shift
            if right - left >= WINDOW:
                # numbers are hashes of words: compare the words themselves
                if own[left:right] != words[left + shift : right + shift]:
                    left, right = _agreeing(own, words, shift, left, right, at)
                if right - left >= WINDOW:
                    covered[left + shift] += 1
                    covered[right + shift] -= 1
    inside = np.cumsum(covered) > 0
    edge = np.flatnonzero(np.diff(np.concatenate(([False], inside)).astype(np.int8)))
    return list(zip(edge[::2].tolist(), edge[1::2].tolist()))


def _agreeing(own: list[bytes], words: list[bytes], shift: int, left: int, right: int, at: int) -> tuple[int, int]:
    """The run of equal words around ``at``, in case numbers collided."""
    a = b = at
    while a > left and own[a - 1] == words[a - 1 + shift]:
        a -= 1
    while b < right and own[b] == words[b + shift]:
        b += 1
    return a, b


def _numbered(texts: list[bytes], tool: Words) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for _, data, offsets in text_chunks(pa.array(texts, pa.large_binary()).cast(pa.large_string())):
        _, _, words, bounds = _words_of(data, offsets, tool)
        short = (words & np.uint64(0xFFFFFFFF)).astype(np.int64)
        out += [short[a:b] for a, b in zip(bounds[:-1], bounds[1:])]
    return out


def _searched(shard: tuple, passages: pd.DataFrame, docs: pd.DataFrame) -> pd.DataFrame:
    tool = Words(word_bytes(BLANKS))
    texts = [t.encode() for t in passages["words"]]
    numbers = _numbered(texts, tool)
    held = [(t.split(), n) for t, n in zip(texts, numbers)]
    at: dict[tuple[int, int], set[int]] = {}
    for p, place in enumerate(zip(passages["first"].tolist(), passages["piece"].tolist())):
        at.setdefault(place, set()).add(p)
    automaton = _automaton([n.tolist() for n in numbers]) if held else None
    out = []
    if automaton is not None and len(automaton):
        bodies = [t.encode() for t in docs["text"]]
        for key, raw, own, wanted in zip(docs["key"], bodies, _numbered(bodies, tool), docs["wanted"]):
            words = raw.split()
            needed = set().union(*(at.get((w["first"], w["piece"]), ()) for w in wanted))
            spans = repeated_spans(words, own, automaton, held, needed)
            if not spans:
                continue
            keep, edge = [], 0
            for a, b in spans:
                keep += words[edge:a]
                edge = b
            keep += words[edge:]
            digest = hashlib.sha256(b" ".join(words)).digest()
            out.append((key, digest, sum(b - a for a, b in spans), b" ".join(keep).decode(), [x for s in spans for x in s]))
    return pd.DataFrame(out, columns=["key", "digest", "n_removed", "kept", "spans"])


def remove_repeats(df: DataFrame, *, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Each row of ``df`` with

    * ``n_words`` and ``n_removed``, words of the text and those covered by a
      window of ``WINDOW`` words that also starts in a row with a smaller key;
    * ``digest``, SHA-256 of the text's words joined by one space;
    * ``kept``, the words that stay, joined by one space, and ``spans``, the
      removed word spans as start, end, start, end ...; both null where
      nothing is removed and the text stands as it is.

    Keys are integers. Windows are judged on the input. Rows with equal keys
    do not remove each other's words; a row with a null key neither loses words
    nor takes them from others. A null or empty text has no words. Other
    columns are not returned; an empty table gives none.

    Grams and windows are counted with partial sums, so a passage that a third
    of all documents holds costs each task one row; it is sent once to each
    shard that needs it.
    """
    docs = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    survey = staged(_surveyed(docs), "repeat-survey")
    summary = survey.where("gram IS NULL").select("key", "n_words", "digest")
    grams = survey.where("gram IS NOT NULL AND key IS NOT NULL").select("key", "gram")
    recurring = grams.groupBy("gram").agg(F.min("key").alias("low"), F.max("key").alias("high")).where("low < high")
    # a row per document: its hashes do not outnumber its words
    lists = grams.join(recurring.select("gram"), "gram").groupBy(F.col("key").alias("k")).agg(F.collect_list("gram").alias("grams"))
    # whole copies: their windows are those of the smallest one
    long = summary.where((F.col("n_words") >= WINDOW) & F.col("key").isNotNull())
    first = long.groupBy("digest").agg(F.min("key").alias("first"), F.max("key").alias("last")).where("first < last")
    copies = (
        long.join(first.drop("last"), "digest", "left")
        .groupBy(F.col("key").alias("c"))
        .agg(F.min("first").alias("first"), F.max("n_words").alias("n_words"), F.count(F.lit(1)).alias("rows"))
        .where("rows = 1 AND first < c")
        .drop("rows")
    )
    marked = lists.join(copies, F.col("k") == F.col("c"), "left").select("k", "grams", "first", "n_words")
    candidates = staged(
        docs.join(marked, F.col("key") == F.col("k")).select("key", "text", "grams", "first", "n_words"), "repeat-candidates"
    )
    windows = _windows(candidates.where("first IS NULL"))
    owners = windows.groupBy("h", "g").agg(F.min(F.struct("key", "at")).alias("o"), F.max("key").alias("last"))
    owners = owners.where("o.key < last").select("h", "g", F.col("o.key").alias("first"), F.col("o.at").alias("start"))
    needs = windows.join(owners, ["h", "g"]).where("key > first")
    needs = needs.select("key", "first", F.floor(F.col("start") / PASSAGE).cast("int").alias("piece"))
    last_piece = F.floor((F.col("n_words") - WINDOW) / PASSAGE).cast("int")
    copied = candidates.where("first IS NOT NULL").select(
        "key", "first", F.explode(F.sequence(F.lit(0), last_piece)).alias("piece")
    )
    needs = staged(needs.unionByName(copied).distinct(), "repeat-needs")

    size = candidates.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)).alias("b")).first().b
    shards = max(1, -(-size // SHARD_BYTES))
    shard = F.pmod(F.xxhash64("key"), F.lit(shards)).alias("shard")
    wanted = needs.groupBy(F.col("first").alias("w")).agg(F.collect_set("piece").alias("pieces"))
    # a passage belongs to a key; rows with that key give theirs each
    texts = candidates.select("key", "text").join(wanted, F.col("key") == F.col("w"))
    sent = _passages(texts).join(needs.select(shard, "first", "piece").distinct(), ["first", "piece"])
    # a document needs no more passages than it has windows
    own = needs.groupBy(F.col("key").alias("n")).agg(F.collect_list(F.struct("first", "piece")).alias("wanted"))
    streamed = candidates.select("key", "text").join(own, F.col("key") == F.col("n")).select(shard, "key", "text", "wanted")
    found = (
        sent.groupBy("shard")
        .cogroup(streamed.groupBy("shard"))
        .applyInPandas(_searched, "key long, digest binary, n_removed long, kept string, spans array<int>")
    )
    # repeated rows with one key and the same words share their result
    found = found.dropDuplicates(["key", "digest"])
    return summary.join(found, ["key", "digest"], "left").select(
        F.col("key").alias(key), "n_words", F.coalesce("n_removed", F.lit(0).cast("long")).alias("n_removed"), "digest", "kept", "spans"
    )
