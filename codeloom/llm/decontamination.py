"""Benchmark decontamination as a prefix-filtered set join.

A window of benchmark words can only occur in a document that holds all of its
shingles, so it is enough to look for one: the rarest. Documents emit the
places of such prefix shingles with the words around them, a join on the
shingle brings the windows there, and the words are compared one by one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import Sealed, Words, mixed, staged, text_chunks, word_bytes

# Word characters: digits, letters, everything beyond ASCII.
SEPARATORS = bytes(b for b in range(0x80) if not (0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A))
WINDOW, SHINGLE = 10, 3
#: Bits of the filter that is sent to all tasks, whatever the benchmark's size.
FILTER_BITS = 1 << 23

_PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(FILTER_BITS - 1)
    return (h & mask).astype(np.intp), (mixed(h) & mask).astype(np.intp)


def filter_of(shingles: DataFrame) -> np.ndarray:
    """A Bloom filter of fixed size, merged from one per task."""

    def fill(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits, any_rows = np.zeros(FILTER_BITS, bool), False
        for batch in batches:
            any_rows |= len(batch) > 0
            for at in _places(batch["h"].to_numpy(np.int64).view(np.uint64)):
                bits[at] = True
        if any_rows:
            yield pd.DataFrame({"slot": [0], "bits": [np.packbits(bits).tobytes()]})

    def union(part: pd.DataFrame) -> pd.DataFrame:
        whole = np.frombuffer(part["bits"].iloc[0], np.uint8).copy()
        for other in part["bits"].iloc[1:]:
            whole |= np.frombuffer(other, np.uint8)
        return pd.DataFrame({"bits": [whole.tobytes()]})

    few = shingles.select("h").coalesce(4).mapInPandas(fill, "slot int, bits binary")
    found = few.groupBy("slot").applyInPandas(union, "bits binary").collect()
    return np.frombuffer(found[0][0], np.uint8) if found else np.zeros(FILTER_BITS // 8, np.uint8)


def _passed(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    one, two = _places(h)
    hit = np.flatnonzero(bits[one >> 3] & (128 >> (one & 7)).astype(np.uint8))
    return hit[(bits[two[hit] >> 3] & (128 >> (two[hit] & 7)).astype(np.uint8)) > 0]


def benchmark_windows(bench: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(item, words of one window): all runs of ``n`` words, or the whole item
    when it is shorter; items without words have none."""
    folded = F.translate(F.coalesce(F.col(text), F.lit("")), _UPPER, _LOWER)
    words = F.col("__words")
    size = F.size(words)
    starts = F.sequence(F.lit(0), F.greatest(size - n, F.lit(0)))
    return (
        bench.select(F.col(item).alias("item"), F.regexp_extract_all(folded, F.lit(_PATTERN), F.lit(0)).alias("__words"))
        .where(size > 0)
        .select("item", F.explode(F.transform(starts, lambda i: F.slice(words, i + 1, n))).alias("words"))
        .distinct()
    )


def _shingled(windows: DataFrame) -> DataFrame:
    """(words, offset, length, h) for every shingle of every distinct window."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("words").to_pylist()
            text = pa.array(["\n".join(w) for w in lists], pa.string())
            out = {"row": [], "offset": [], "h": []}
            tool = Words(word_bytes(SEPARATORS, fold=True))
            for base, data, offsets in text_chunks(text):
                start, end = tool.split(data, offsets)
                hashes, bounds = tool.hashes(data, start, end), np.searchsorted(start, offsets)
                sizes = np.minimum(np.diff(bounds), SHINGLE)
                for m in np.unique(sizes[sizes > 0]):
                    first, h = tool.windows(hashes, bounds, int(m))
                    row = np.searchsorted(bounds, first, "right") - 1
                    own = sizes[row] == m
                    out["row"].append(row[own] + base)
                    out["offset"].append(first[own] - bounds[row[own]])
                    out["h"].append(h[own])
            if out["row"]:
                row = np.concatenate(out["row"])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column("words").take(pa.array(row)),
                        pa.array(np.concatenate(out["offset"]), pa.int32()),
                        pa.array(np.concatenate(out["h"]).view(np.int64)),
                    ],
                    names=["words", "offset", "h"],
                )

    return windows.select("words").distinct().mapInArrow(rows, "words array<string>, offset int, h long")


def _frequencies(docs: DataFrame, text: str, bits: np.ndarray) -> DataFrame:
    """Documents by benchmark shingle, over all documents."""
    held = docs.sparkSession.sparkContext.broadcast(bits)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, seen = Words(word_bytes(SEPARATORS, fold=True)), []
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("__text")):
                start, end = tool.split(data, offsets)
                hashes, bounds = tool.hashes(data, start, end), np.searchsorted(start, offsets)
                for m in range(1, SHINGLE + 1):
                    first, h = tool.windows(hashes, bounds, m)
                    at = _passed(held.value, h)
                    pairs = np.column_stack((np.searchsorted(bounds, first[at], "right"), h[at].view(np.int64)))
                    seen.append(np.unique(pairs, axis=0)[:, 1])
            if sum(map(len, seen)) > 1_000_000:
                yield summed(seen)
                seen = []
        if seen:
            yield summed(seen)

    def summed(seen: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(seen), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h), pa.array(n)], names=["h", "n"])

    found = docs.select(F.col(text).alias("__text")).mapInArrow(rows, "h long, n long")
    return found.groupBy("h").agg(F.sum("n").alias("docs"))


def _candidates(docs: DataFrame, columns: list[str], text: str, bits: np.ndarray, n: int) -> DataFrame:
    """Each row with its number of words and its places of prefix shingles:
    (first word, shingle, words before and after)."""
    held = docs.sparkSession.sparkContext.broadcast(bits)
    wide = n - 1

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Words(word_bytes(SEPARATORS, fold=True))
        fold = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
        for batch in batches:
            counts, places = [], []
            for _, data, offsets in text_chunks(batch.column("__text")):
                start, end = tool.split(data, offsets)
                hashes, bounds = tool.hashes(data, start, end), np.searchsorted(start, offsets)
                counts.extend(np.diff(bounds).tolist())
                own: list[list] = [[] for _ in range(len(offsets) - 1)]
                for m in range(1, SHINGLE + 1):
                    first, h = tool.windows(hashes, bounds, m)
                    at = _passed(held.value, h)
                    row = np.searchsorted(bounds, first[at], "right") - 1
                    for i, r, x in zip(first[at].tolist(), row.tolist(), h[at].view(np.int64).tolist()):
                        low, high = max(bounds[r], i - wide), min(bounds[r + 1], i + n)
                        near = [
                            data[a:b].tobytes().translate(fold).decode() for a, b in zip(start[low:high], end[low:high])
                        ]
                        own[r].append({"at": i - int(bounds[r]), "h": x, "lead": i - int(low), "near": near})
                places.extend(own)
            kept = [batch.column(c) for c in columns]
            kept += [pa.array(counts, pa.int64()), pa.array(places, kind)]
            yield pa.RecordBatch.from_arrays(kept, names=[*columns, "__n", "__places"])

    kind = pa.list_(
        pa.struct([("at", pa.int32()), ("h", pa.int64()), ("lead", pa.int32()), ("near", pa.list_(pa.string()))])
    )
    types = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields)
    schema = f"{types}, __n long, __places array<struct<at:int,h:long,lead:int,near:array<string>>>"
    return docs.select(*columns, F.col(text).alias("__text")).mapInArrow(rows, schema)


def benchmark_hits(
    docs: DataFrame, bench: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW
) -> tuple[DataFrame, DataFrame]:
    """Every occurrence of a benchmark window in a document.

    Returns the rows of ``docs`` without text but with ``__row`` and ``__n``
    (words), and (``__row``, ``start``, ``length``, ``item``) of the hits.
    """
    windows = staged(benchmark_windows(bench, item, item_text, n), "bench-windows")
    shingles = staged(_shingled(windows), "bench-shingles")
    common = _frequencies(docs, text, filter_of(shingles))
    # prefix: the rarest shingle of a window, ties by hash; one is necessary and enough
    order = F.struct(F.coalesce("docs", F.lit(0)).alias("docs"), "h", "offset")
    prefix = (
        shingles.join(common, "h", "left")
        .groupBy("words")
        .agg(F.min(order).alias("p"))
        .select("words", "p.h", "p.offset")
    )
    prefix = staged(prefix, "bench-prefix")
    columns = [c for c in docs.columns if c != text]
    numbered = docs.withColumn("__row", F.monotonically_increasing_id())
    found = staged(_candidates(numbered, [*columns, "__row"], text, filter_of(prefix), n), "bench-places")
    places = found.where(F.size("__places") > 0).select("__row", "__n", F.explode("__places").alias("c"))
    start, length = F.col("c.at") - F.col("offset"), F.size("words")
    near = F.slice("c.near", F.col("c.lead") - F.col("offset") + 1, length)
    hits = (
        places.join(prefix, F.col("c.h") == F.col("h"))
        # the window must lie within the document, then its words must agree
        .where((start >= 0) & (start + length <= F.col("__n")) & (F.col("c.lead") >= F.col("offset")))
        .where(near == F.col("words"))
        .select("__row", start.alias("start"), length.alias("length"), "words")
    )
    return found.drop("__places"), hits.join(windows, "words").drop("words")


def decontaminate(
    docs: DataFrame, bench: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text", n: int = WINDOW
) -> DataFrame:
    """Each row of ``docs`` without its text, with ``n_words``, ``n_hit`` (words
    inside any occurrence of a benchmark window), ``n_items``, ``items`` (their
    ids as sorted strings) and ``contaminated`` (any hit).

    A null text has no words, a null or empty item no windows, a null item id
    counts as ''. Every row is kept, repeated ones too; an empty benchmark hits
    nothing. Columns of these names are replaced. Several windows that a third
    of all documents hold are pre-counted per task; hits are summed per row.
    """
    made = ["n_words", "n_hit", "n_items", "items", "contaminated"]
    own = Sealed(docs, made, drop=(text,))
    body = F.col(own.name(text)).alias("__body")
    rows, hits = benchmark_hits(
        own.table.select(*own.columns, body), bench, text="__body", item=item, item_text=item_text, n=n
    )
    spans = (
        hits.groupBy("__row", "start", "length")
        .agg(F.collect_set(F.coalesce(F.col("item").cast("string"), F.lit(""))).alias("items"))
        .groupBy(F.col("__row").alias("__hit"))
        .agg(
            F.sort_array(F.collect_list(F.struct("start", "length"))).alias("s"),
            F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
        )
    )
    # union of the spans: each adds what lies beyond the furthest end so far
    covered = F.aggregate(
        "s",
        F.struct(F.lit(0).alias("n"), F.lit(0).alias("edge")),
        lambda a, x: F.struct(
            (a["n"] + F.greatest(F.lit(0), x["start"] + x["length"] - F.greatest(a["edge"], x["start"]))).alias("n"),
            F.greatest(a["edge"], x["start"] + x["length"]).alias("edge"),
        ),
        lambda a: a["n"].cast("long"),
    )
    spans = spans.select("__hit", covered.alias("n_hit"), "items")
    out = rows.join(spans, F.col("__row") == F.col("__hit"), "left").withColumns(
        {
            "n_hit": F.coalesce("n_hit", F.lit(0).cast("long")),
            "items": F.coalesce("items", F.array().cast("array<string>")),
        }
    )
    return own.restored(
        out.withColumns(
            {"n_words": F.col("__n"), "n_items": F.size("items").cast("long"), "contaminated": F.col("n_hit") > 0}
        )
    )
