"""Token counts by heap-and-linked-list byte-pair merging.

No identifiers are made: the count of a piece is its number of bytes minus the
number of merges. Popping the lowest-ranked adjacent pair from a heap and
relinking its neighbours takes O(n log n) for a piece of n bytes, so one very
long word is no trouble.
"""

from __future__ import annotations

import heapq
import json
from collections.abc import Callable, Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Sealed

# Fixed values of the vocabulary's file format: its piece pattern, and the
# characters that stand for bytes (printable ones for themselves, the other
# bytes in order from 256 on).
PIECES = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
PRINTABLE = ((0x21, 0x7E), (0xA1, 0xAC), (0xAE, 0xFF))
#: Pieces whose counts a worker remembers, and the longest piece remembered.
REMEMBERED, LONGEST = 400_000, 64


def byte_of() -> dict[str, int]:
    """The byte that each character of the file stands for."""
    plain = [b for low, high in PRINTABLE for b in range(low, high + 1)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


def read_vocabulary(path: str) -> tuple[dict[tuple[bytes, bytes], int], list[str]]:
    """Ranks of the merges, and the strings that are tokens as they stand."""
    with open(path, encoding="utf-8") as f:
        held = json.load(f)
    kind = (held["model"]["type"], held["pre_tokenizer"]["type"], held["normalizer"])
    if kind != ("BPE", "ByteLevel", None) or held["pre_tokenizer"]["add_prefix_space"]:
        raise ValueError(f"not a plain byte-level vocabulary: {kind}")
    back = byte_of()
    pairs = (m if isinstance(m, list) else m.split(" ") for m in held["model"]["merges"])
    ranks = {
        (bytes(map(back.__getitem__, a)), bytes(map(back.__getitem__, b))): rank
        for rank, (a, b) in enumerate(pairs)
    }
    return ranks, [t["content"] for t in held["added_tokens"]]


def merged_count(piece: bytes, ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Initial symbols minus merges."""
    n = len(piece)
    symbol: list[bytes | None] = [piece[i : i + 1] for i in range(n)]
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(r, i) for i in range(n - 1) if (r := ranks.get((symbol[i], symbol[i + 1]))) is not None]
    heapq.heapify(heap)
    count = n
    while heap:
        rank, i = heapq.heappop(heap)
        j = after[i]
        if symbol[i] is None or j >= n or ranks.get((symbol[i], symbol[j])) != rank:
            continue  # one of the two was merged into a neighbour meanwhile
        symbol[i] += symbol[j]
        symbol[j] = None
        after[i] = k = after[j]
        count -= 1
        if k < n:
            before[k] = i
            if (r := ranks.get((symbol[i], symbol[k]))) is not None:
                heapq.heappush(heap, (r, i))
        if (h := before[i]) >= 0 and (r := ranks.get((symbol[h], symbol[i]))) is not None:
            heapq.heappush(heap, (r, h))
    return count


class Counts(dict):
    """Counts by piece, filled as pieces are met; emptied when full."""

    def __init__(self, ranks):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: str) -> int:
        n = merged_count(piece.encode(), self.ranks)
        if len(piece) <= LONGEST:
            if len(self) >= REMEMBERED:
                self.clear()
            self[piece] = n
        return n


def counter(ranks, whole: list[str]) -> Callable[[str], int]:
    """A function from text to its number of tokens."""
    pieces, known = regex.compile(PIECES), Counts(ranks)
    apart = regex.compile("|".join(map(regex.escape, sorted(whole, key=len, reverse=True)))) if whole else None

    def count(text: str) -> int:
        if apart is None or not apart.search(text):
            return sum(map(known.__getitem__, pieces.findall(text)))
        parts = apart.split(text)
        return len(parts) - 1 + sum(sum(map(known.__getitem__, pieces.findall(p))) for p in parts)

    return count


def count_tokens(df: DataFrame, vocabulary: str, text: str = "text", limit: int = 1024) -> DataFrame:
    """Adds ``n_bytes``, ``n_tokens`` and ``over_limit`` to every row.

    ``vocabulary`` is the path of a byte-level BPE file on the driver; its
    merges (a published file of fixed size) are broadcast. Whole texts are
    counted. A null or empty text has 0 bytes and 0 tokens. Rows are never
    merged or dropped; columns of those three names are replaced, others kept.
    """
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))

    @F.pandas_udf("long")
    def tokens(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = counter(*held.value)
        for texts in batches:
            yield texts.map(lambda t: count(t) if t else 0).astype("int64")

    own = Sealed(df, ["n_bytes", "n_tokens", "over_limit"])
    whole = F.coalesce(F.col(own.name(text)), F.lit(""))
    counts = {"n_bytes": F.octet_length(whole).cast("long"), "n_tokens": tokens(whole)}
    return own.restored(own.table.withColumns(counts).withColumn("over_limit", F.col("n_tokens") > limit))
