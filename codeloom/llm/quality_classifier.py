"""Quality classifier: histogram gradient-boosted trees over text statistics.

The trees are grown on a bounded sample of labelled rows and flattened into
arrays, one slot per node of a complete tree, so a batch of documents walks
all trees level by level in numpy.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, Sealed, Words, text_chunks, word_bytes

#: Labelled rows that training may hold on the driver, the first by hash of the key.
MAX_TRAINING_ROWS = 20_000

_GROUPS = {
    "upper": bytes(range(0x41, 0x5B)),
    "lower": bytes(range(0x61, 0x7B)),
    "digit": bytes(range(0x30, 0x3A)),
    "blank": BLANKS,
    "line": b"\n",
    "symbol": b"#*$%&<>@^~_=+\\/",
    "bar": b"|",
    "shout": b"!?",
    "stop": b".",
    "comma": b",;:",
    "quote": b"\"'()[]{}`",
    "wide": bytes(range(0xC0, 0x100)),
}


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of statistics per text, from whole texts; null counts as empty."""
    groups = np.zeros((256, len(_GROUPS)))
    for j, members in enumerate(_GROUPS.values()):
        groups[list(members), j] = 1
    words, lines = Words(word_bytes(BLANKS, fold=True)), Words(word_bytes(b"\n"))
    out = []
    for _, data, offsets in text_chunks(texts):
        rows = len(offsets) - 1
        counts = np.stack([np.bincount(data[a:b], minlength=256) for a, b in zip(offsets[:-1], offsets[1:])])
        size = counts.sum(axis=1)
        share = (counts @ groups) / np.maximum(size, 1)[:, None]
        p = counts / np.maximum(size, 1)[:, None]
        entropy = -(p * np.log2(np.maximum(p, 1e-12))).sum(axis=1)
        start, end = words.split(data, offsets)
        hashes, bounds = words.hashes(data, start, end), np.searchsorted(start, offsets)
        length = (end - start).astype(float)
        first, five = words.windows(hashes, bounds, 5)
        line_start, line_end = lines.split(data, offsets)
        line_hash, line_bounds = lines.hashes(data, line_start, line_end), np.searchsorted(line_start, offsets)
        n, n_lines = np.diff(bounds), np.diff(line_bounds)
        own = np.column_stack(
            [
                np.log1p(size),
                np.log1p(n),
                entropy,
                _mean(length, bounds),
                _mean((length == 1).astype(float), bounds),
                _mean((length > 15).astype(float), bounds),
                _distinct(hashes, bounds),
                _distinct(five, np.searchsorted(first, bounds)),
                _distinct(line_hash, line_bounds),
                n / np.maximum(n_lines, 1),
                np.log1p(n_lines),
            ]
        )
        out.append(np.hstack([share, own]).reshape(rows, -1))
    return np.vstack(out) if out else np.zeros((0, len(_GROUPS) + 11))


def _mean(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0.0], np.cumsum(values)))
    return (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(np.diff(bounds), 1)


def _distinct(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Share of different values in each slice; 1 for an empty one."""
    row = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    order = np.lexsort((values, row))
    v, r = values[order], row[order]
    new = np.ones(len(v), bool)
    new[1:] = (v[1:] != v[:-1]) | (r[1:] != r[:-1])
    found = np.bincount(r[new], minlength=len(bounds) - 1)
    size = np.diff(bounds)
    return np.where(size > 0, found / np.maximum(size, 1), 1.0)


@dataclass
class Trees:
    """Complete trees as arrays: (trees, inner nodes) and (trees, leaves)."""

    feature: np.ndarray
    threshold: np.ndarray
    leaf: np.ndarray
    base: float

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability of label 1 for each row."""
        total = np.full(len(x), self.base)
        depth = int(np.log2(self.leaf.shape[1])) if self.leaf.size else 0
        rows = np.arange(len(x))
        for feature, threshold, leaf in zip(self.feature, self.threshold, self.leaf):
            node = np.zeros(len(x), np.intp)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            total += leaf[node - (len(leaf) - 1)]
        return 1 / (1 + np.exp(-np.clip(total, -30, 30)))


def grow(
    x: np.ndarray,
    y: np.ndarray,
    *,
    rounds: int = 80,
    depth: int = 4,
    bins: int = 64,
    rate: float = 0.15,
    least: int = 10,
    ridge: float = 1.0,
) -> Trees:
    """Boosts on logistic loss; splits are searched over quantile bins.

    Without rows the score is 0.5; with one label alone it is near that label.
    """
    n, width = x.shape if len(x) else (0, 0)
    mean = (y.sum() + 0.5) / (n + 1.0)
    empty = np.zeros((0, 1))
    base = float(np.log(mean / (1 - mean)))
    if n == 0 or y.min() == y.max():
        return Trees(np.zeros((0, 1), np.intp), empty, empty, base)
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for j in range(width)]
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    flat = binned + bins * np.arange(width)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((rounds, inner), np.intp)
    threshold = np.full((rounds, inner), np.inf)
    leaf = np.zeros((rounds, leaves))
    total = np.full(n, base)
    for t in range(rounds):
        p = 1 / (1 + np.exp(-total))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.intp)
        for level in range(depth):
            first = 2**level - 1
            for here in range(first, 2 * first + 1):
                rows = np.flatnonzero(node == here)
                if len(rows) < 2 * least:
                    continue
                cells = flat[rows].ravel()
                sums = [
                    np.bincount(cells, np.repeat(v, width), width * bins).reshape(width, bins).cumsum(axis=1)
                    for v in (g[rows], h[rows], np.ones(len(rows)))
                ]
                (gl, hl, cl), (gt, ht) = sums, (g[rows].sum(), h[rows].sum())
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(cl < least) | (len(rows) - cl < least)] = 0
                j, b = np.unravel_index(int(gain.argmax()), gain.shape)
                if gain[j, b] > 1e-9 and b < len(cuts[j]):
                    feature[t, here], threshold[t, here] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[t, node]] > threshold[t, node])
        spot = node - inner
        leaf[t] = -rate * np.bincount(spot, g, leaves) / (np.bincount(spot, h, leaves) + ridge)
        total += leaf[t, spot]
    return Trees(feature, threshold, leaf, base)


def learn(
    docs: DataFrame,
    labels: DataFrame,
    *,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    rows: Column | None = None,
    most: int = MAX_TRAINING_ROWS,
) -> Trees:
    """Trees from the labelled rows that satisfy ``rows``.

    At most ``most`` rows of ``labels`` are used, by hash of the key, so the
    join broadcasts a side of that bound and the driver holds that many rows
    of statistics. Null keys and labels are passed over; of rows of ``docs``
    that share a key, the one with the least statistics counts.
    """
    given = labels.where(F.col(key).isNotNull() & F.col(label).isNotNull())
    given = given if rows is None else given.where(rows)
    given = given.select(F.col(key).alias("__key"), F.col(label).cast("double").alias("__label"))
    given = given.orderBy(F.xxhash64("__key"), "__key", "__label").limit(most)
    texts = docs.select(F.col(key).alias("__k"), F.col(text).alias("__text"))
    joined = texts.join(F.broadcast(given), F.col("__k") == F.col("__key")).select("__key", "__label", "__text")

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = pa.array(list(statistics(batch.column("__text"))), pa.list_(pa.float64()))
            yield pa.RecordBatch.from_arrays([batch.column("__key"), batch.column("__label"), x], names=["k", "y", "x"])

    kind = joined.schema["__key"].dataType.simpleString()
    measured = joined.mapInArrow(measure, f"k {kind}, y double, x array<double>")
    # one row for each labelled one, whatever repeats
    found = measured.groupBy("k", "y").agg(F.min("x").alias("x")).toPandas()
    if found.empty:
        return grow(np.zeros((0, 0)), np.zeros(0))
    found = found.iloc[np.lexsort((found["y"], found["k"].astype(str)))]
    return grow(np.vstack(found["x"].to_numpy()), (found["y"].to_numpy() > 0.5).astype(float))


def score_quality(df: DataFrame, trees: Trees, text: str = "text", cut: float = 0.5) -> DataFrame:
    """Adds ``score`` (probability of label 1) and ``predicted`` (0 or 1).

    Empty and null texts are scored like any other, from statistics of an
    empty text. Every row is kept; columns of the two names are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(trees)  # a few thousand nodes

    @F.pandas_udf("double")
    def scores(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            x = statistics(pa.array(texts, pa.large_string(), from_pandas=True))
            yield pd.Series(held.value.score(x) if len(x) else np.zeros(0))

    own = Sealed(df, ["score", "predicted"])
    scored = own.table.withColumn("score", scores(F.coalesce(F.col(own.name(text)), F.lit(""))))
    return own.restored(scored.withColumn("predicted", (F.col("score") >= cut).cast("int")))
