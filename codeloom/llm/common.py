"""Helpers shared by the operators: staging, word hashes over Arrow text."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.session import shared_dir

BLANKS = bytes([0x20, *range(0x09, 0x0E)])
#: Bytes of text handled at once by the numpy code; a longer text is one chunk.
CHUNK = 1 << 21
_BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64
_STEP = 0xD6E8FEB86659FD93


def staged(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and reads it back.

    Cuts lineage in a way that survives lost executors, and fixes row numbers
    and partition bounds for everything that follows.
    """
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/llm/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def crc_mod(key: str, by: int) -> Column:
    """crc32 of the key's text, modulo ``by``; a null key counts as ''."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % by


def word_bytes(separators: bytes, fold: bool = False) -> np.ndarray:
    """256 codes by byte: 0 for separators, else 1 + byte, A-Z folded on demand.

    All separators are ASCII, so bytes of longer UTF-8 sequences are safe.
    """
    codes = np.arange(1, 257, dtype=np.uint16)
    if fold:
        codes[0x41:0x5B] += 32
    codes[list(separators)] = 0
    return codes


def text_chunks(texts: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(first row, UTF-8 bytes, row offsets into them); nulls count as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = pc.fill_null(texts.cast(pa.large_string()), "")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    held = texts.buffers()[2]
    data = np.frombuffer(held, np.uint8) if held is not None and held.size else np.zeros(0, np.uint8)
    row = 0
    while row < len(texts):
        stop = int(np.searchsorted(offsets, offsets[row] + limit, "right")) - 1
        stop = min(max(stop, row + 1), len(texts))
        yield row, data[offsets[row] : offsets[stop]], offsets[row : stop + 1] - offsets[row]
        row = stop


def mixed(h: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n + 1, base, np.uint64)
    out[0] = 1
    return np.cumprod(out, dtype=np.uint64)


class Rolling:
    """Hashes of slices of a sequence from prefix sums, modulo 2**64."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def slices(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """sum(codes[i] * base**(end-1-i)) for each slice, mixed."""
        n = len(codes)
        if n >= len(self.up):
            self.up, self.down = _powers(self.base, n), _powers(self.inverse, n)
        sums = np.zeros(n + 1, np.uint64)
        np.cumsum(codes * self.down[:n], out=sums[1:], dtype=np.uint64)
        last = np.maximum(end - 1, 0)
        return mixed((sums[end] - sums[start]) * self.up[last] + (end - start).astype(np.uint64))


class Words:
    """Words of chunked texts as 64-bit hashes with row and byte positions."""

    def __init__(self, codes: np.ndarray):
        self.codes, self.bytes, self.runs = codes, Rolling(_BASE), Rolling(_STEP)

    def split(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Byte starts and ends of the words; none spans two rows."""
        inside = self.codes[data] > 0
        before = np.empty_like(inside)
        before[:1], before[1:] = False, inside[:-1]
        before[offsets[:-1][offsets[:-1] < len(data)]] = False
        after = np.empty_like(inside)
        after[-1:], after[:-1] = False, inside[1:]
        ends = offsets[1:] - 1
        after[ends[ends >= 0]] = False
        return np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1

    def hashes(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """One hash per word, from its (folded) bytes alone."""
        out = np.empty(len(start), np.uint64)
        at = 0
        while at < len(start):  # blocks of bytes bound the memory for a very long text
            low = start[at]
            stop = max(at + 1, int(np.searchsorted(end, low + CHUNK, "right")))
            codes = self.codes[data[low : end[stop - 1]]].astype(np.uint64)
            out[at:stop] = self.bytes.slices(codes, start[at:stop] - low, end[at:stop] - low)
            at = stop
        return out

    def windows(self, hashes: np.ndarray, bounds: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of all runs of ``k`` words; ``bounds`` are the
        word offsets of the rows, which no run crosses."""
        per_row = np.maximum(np.diff(bounds) - (k - 1), 0)
        first = np.repeat(bounds[:-1] - np.concatenate(([0], np.cumsum(per_row)[:-1])), per_row)
        first = first + np.arange(len(first))
        return first, self.runs.slices(hashes, first, first + k)


def distinct(h: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different hashes of each row, sorted within the row."""
    order = np.lexsort((h, row))
    h, row = h[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
    return h[new], row[new]


class Sealed:
    """A table under positional column names, so that an operator's own names
    cannot clash with those of its input.

    ``made`` are the columns that the operator adds; columns of those names (in
    any case) are left out. ``table`` is the renamed table, ``name`` gives the
    renamed form of an input column, ``restored`` undoes the renaming.
    """

    def __init__(self, df: DataFrame, made: list[str], drop: tuple[str, ...] = ()):
        taken = {m.lower() for m in made}
        self.made, self.names = made, {c: f"__x{i}" for i, c in reversed(list(enumerate(df.columns)))}
        self.table = df.toDF(*(f"__x{i}" for i in range(len(df.columns))))
        self.kept = [
            (f"__x{i}", c) for i, c in enumerate(df.columns) if c.lower() not in taken and c not in drop
        ]

    def name(self, column: str) -> str:
        return self.names[column]

    @property
    def columns(self) -> list[str]:
        return [safe for safe, _ in self.kept]

    def restored(self, df: DataFrame) -> DataFrame:
        return df.select(*(F.col(safe).alias(c) for safe, c in self.kept), *self.made)
