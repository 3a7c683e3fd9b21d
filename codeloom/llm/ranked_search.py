"""Ranked lexical search over impact vectors in buckets of falling length.

A document is a sparse vector over the terms that the items ask for: its
impacts, times the root of the term's weight. An item is the vector of the
roots of its weights, so that the product of both is the score. Each task sorts
its documents by length and walks them in buckets. By Cauchy-Schwarz a bucket
whose longest vector cannot reach an item's tenth score is skipped for that
item, and so is everything after it. Inside a bucket the item's heaviest
coordinates are summed and the rest is bounded by the lengths left over; what
survives is scored again in integers.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from codeloom.llm.common import CHUNK, staged, text_chunks

#: Documents that share one length bound.
BUCKET = 2048
#: Coordinates of an item that are summed before the rest is bounded.
FOCUS = 8
#: Bytes of item terms that are searched, and so broadcast, at a time.
BLOCK_BYTES = 16 << 20
#: Relative allowance for the rounding of the bounds, which are doubles.
SLACK = 1e-9

_KEPT = [*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]
#: A-Z lower-cased, bytes outside of terms as blanks.
_FOLD = bytes((b + 32 if 0x41 <= b < 0x5B else b) if b in set(_KEPT) else 0x20 for b in range(256))


def _pieces(text: bytes) -> Iterator[list[bytes]]:
    """Terms of a text; a very long one is cut at blanks."""
    text = text.translate(_FOLD)
    at = 0
    while len(text) - at > CHUNK:
        cut = text.find(b" ", at + CHUNK)
        cut = len(text) if cut < 0 else cut
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def _texts(column: pa.Array) -> Iterator[bytes]:
    for _, data, offsets in text_chunks(column):
        held = data.tobytes()
        for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
            yield held[a:b]


def _lists(values: np.ndarray, sizes, kind: pa.DataType) -> pa.Array:
    offsets = np.zeros(len(sizes) + 1, np.int32)
    np.cumsum(sizes, out=offsets[1:])
    return pa.ListArray.from_arrays(offsets, pa.array(values, kind))


def _flat(column: pa.ChunkedArray | pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, offsets) of a list column without nulls."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], (offsets - offsets[0]).astype(np.int64)


def _item_terms(items: DataFrame, item: str, text: str) -> DataFrame:
    """(q, item_id, terms, size): the distinct terms of each item, in order."""
    rows = items.select(F.col(item).alias("item_id"), F.col(text).cast("string").alias("text"))

    def distinct(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [sorted(set().union(*_pieces(t))) for t in _texts(batch.column("text"))]
            terms = pa.array(found, pa.list_(pa.binary()))
            size = pa.array([sum(map(len, f)) + 16 * len(f) for f in found], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), terms, size], names=["item_id", "terms", "size"])

    kind = rows.schema["item_id"].dataType.simpleString()
    found = rows.mapInArrow(distinct, f"item_id {kind}, terms array<binary>, size long")
    return staged(found.withColumn("q", F.monotonically_increasing_id()), "items")


def _vectors(docs: DataFrame, numbers) -> DataFrame:
    """(doc_id, n, terms, tfs) of every row, terms by their number."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = numbers.value
        for batch in batches:
            n, sizes, terms, tfs = [], [], [], []
            for text in _texts(batch.column("text")):
                total, found = 0, Counter()
                for words in _pieces(text):
                    total += len(words)
                    found.update(map(known.get, words))
                found.pop(None, None)
                n.append(total)
                sizes.append(len(found))
                terms.extend(found)
                tfs.extend(found.values())
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(n, pa.int64()),
                    _lists(np.array(terms, np.int32), sizes, pa.int32()),
                    _lists(np.array(tfs, np.int64), sizes, pa.int64()),
                ],
                names=["doc_id", "n", "terms", "tfs"],
            )

    return docs.mapInArrow(count, "doc_id long, n long, terms array<int>, tfs array<long>")


def _impacts(vectors: DataFrame, weights, n_docs: int, n_terms: int) -> DataFrame:
    """(doc_id, terms, impacts, norm) of the rows that hold an asked term."""

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        for batch in batches:
            tfs, at = _flat(batch.column("tfs"))
            terms, _ = _flat(batch.column("terms"))
            n = batch.column("n").to_numpy()
            m = 10 + (90 * n * n_docs) // n_terms
            imp = (1_000_000_000 * tfs) // (1000 * tfs + 8 * np.repeat(m, np.diff(at)))
            squares = np.concatenate(([0.0], np.cumsum(w[terms] * imp.astype(np.float64) ** 2)))
            norm = np.sqrt(np.maximum(squares[at[1:]] - squares[at[:-1]], 0.0))
            # differences of prefix sums are off by their rounding at most
            norm = norm + np.sqrt(squares[-1] * 1e-12)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("terms"), _lists(imp, np.diff(at), pa.int64()), pa.array(norm)],
                names=["doc_id", "terms", "impacts", "norm"],
            )

    return vectors.where("size(terms) > 0").mapInArrow(weigh, "doc_id long, terms array<int>, impacts array<long>, norm double")


class _Item:
    """One item: its terms, weights, heaviest coordinates and ``k`` best."""

    def __init__(self, q: int, terms: np.ndarray, weights: np.ndarray, least: int):
        keep = weights > 0
        self.q, self.terms, self.weights, self.least = q, terms[keep], weights[keep], least
        self.length = math.sqrt(self.weights.sum())
        order = np.argsort(-self.weights, kind="stable")[:FOCUS]
        self.focus, self.root = self.terms[order], np.sqrt(self.weights[order])
        self.rest = math.sqrt(max(float(self.weights.sum() - self.weights[order].sum()), 0.0))
        self.scores = self.ids = np.zeros(0, np.int64)
        self.nulls = np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, nulls: np.ndarray, k: int) -> None:
        keep = scores >= max(self.least, 1)
        scores, ids, nulls = (np.concatenate(x) for x in ((self.scores, scores[keep]), (self.ids, ids[keep]), (self.nulls, nulls[keep])))
        best = np.lexsort((ids, nulls, -scores))[:k]
        self.scores, self.ids, self.nulls = scores[best], ids[best], nulls[best]
        if len(best) == k:
            self.least = max(self.least, int(self.scores[-1]))


def _walk(batch: pa.RecordBatch, at: int, items: list[_Item], weights: np.ndarray, k: int) -> list[_Item]:
    """Searches one bucket; returns the items that later buckets may serve."""
    part = batch.slice(at, BUCKET)
    norm = part.column("norm").to_numpy()
    longest = norm[0] * (1 + SLACK)
    items = [i for i in items if i.length * longest >= i.least]
    if not items:
        return items
    terms, offsets = _flat(part.column("terms"))
    impacts, _ = _flat(part.column("impacts"))
    held = part.column("doc_id")
    nulls = held.is_null().to_numpy(zero_copy_only=False)
    ids = held.fill_null(0).to_numpy()
    row = np.repeat(np.arange(len(norm)), np.diff(offsets))
    order = np.argsort(terms, kind="stable")
    by_term, by_row = terms[order], row[order]
    coordinates = np.sqrt(weights[by_term]) * impacts[order]
    for item in items:
        first, last = np.searchsorted(by_term, item.focus, "left"), np.searchsorted(by_term, item.focus, "right")
        summed, used = np.zeros(len(norm)), np.zeros(len(norm))
        for a, b, root in zip(first.tolist(), last.tolist(), item.root.tolist()):
            if a < b:
                summed[by_row[a:b]] += root * coordinates[a:b]
                used[by_row[a:b]] += coordinates[a:b] ** 2
        bound = summed + item.rest * np.sqrt(np.maximum(norm * norm * (1 + SLACK) - used, 0.0))
        alive = np.flatnonzero(bound * (1 + SLACK) + 1 >= item.least)
        if not len(alive):
            continue
        size = offsets[alive + 1] - offsets[alive]
        ends = np.cumsum(size)
        entry = np.repeat(offsets[alive] - (ends - size), size) + np.arange(ends[-1])
        found = terms[entry]
        place = np.minimum(np.searchsorted(item.terms, found), len(item.terms) - 1)
        gain = np.where(item.terms[place] == found, item.weights[place] * impacts[entry], 0)
        sums = np.concatenate(([0], np.cumsum(gain)))
        item.add(sums[ends] - sums[ends - size], ids[alive], nulls[alive], k)
    return items


def _search(weighed: DataFrame, asked, least: dict[int, int], weights, k: int) -> DataFrame:
    """(q, doc_id, score): at most ``k`` rows of an item from each task, none
    below ``least``. The rows of a task lie by falling norm."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = weights.value
        every = [_Item(q, terms, w[terms], least.get(q, 0)) for q, terms in asked.value]
        every = [i for i in every if len(i.terms)]
        items = every
        for batch in batches:
            for at in range(0, batch.num_rows if items else 0, BUCKET):
                items = _walk(batch, at, items, w, k)
        for i in every:
            if len(i.scores):
                ids = pa.array(i.ids, pa.int64(), mask=i.nulls)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(i.ids), i.q), pa.int64()), ids, pa.array(i.scores)], names=["q", "doc_id", "score"])

    return weighed.mapInArrow(run, "q long, doc_id long, score long")


def _best(found: DataFrame, k: int) -> DataFrame:
    """The ``k`` best rows of each item; first among rows of some tasks each,
    so that no task meets the rows of all."""
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    spread = found.withColumn("__part", F.pmod(F.spark_partition_id(), F.lit(64)))
    some = spread.withColumn("rank", F.row_number().over(Window.partitionBy("q", "__part").orderBy(*order)))
    return (
        some.where(F.col("rank") <= k)
        .withColumn("rank", F.row_number().over(Window.partitionBy("q").orderBy(*order)))
        .where(F.col("rank") <= k)
        .select("q", "rank", "doc_id", "score")
    )


def _weight(n_docs: int, df: int) -> int:
    return math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1)))


def _block(spark: SparkSession, docs: DataFrame, block: DataFrame, k: int) -> DataFrame | None:
    """Results of one block of items, whose terms are bounded by its bytes."""
    asked = [(r.q, [bytes(t) for t in r.terms]) for r in block.select("q", "terms").toLocalIterator()]
    numbers = {t: i for i, t in enumerate(sorted({t for _, terms in asked for t in terms}))}
    if not numbers:
        return None
    context = spark.sparkContext
    vectors = staged(_vectors(docs, context.broadcast(numbers)), "vectors")
    total = vectors.agg(F.count_if(F.col("n") > 0).alias("docs"), F.coalesce(F.sum("n"), F.lit(0)).alias("terms")).first()
    if not total.docs:
        return None
    weights = np.zeros(len(numbers), np.int64)
    # one row for each asked term
    for r in vectors.select(F.explode("terms").alias("t")).groupBy("t").agg(F.count("*").alias("df")).toLocalIterator():
        weights[r.t] = _weight(total.docs, r.df)
    weights = context.broadcast(weights)
    lists = context.broadcast([(q, np.array([numbers[t] for t in terms], np.int32)) for q, terms in asked])
    weighed = _impacts(vectors, weights, total.docs, total.terms)
    # the longest vectors of all give each item a score to begin with
    first = _search(weighed.orderBy(F.col("norm").desc()).limit(BUCKET), lists, {}, weights, k)
    scores: dict[int, list[int]] = {}
    for r in first.select("q", "score").toLocalIterator():
        scores.setdefault(r.q, []).append(r.score)
    least = {q: min(s) for q, s in scores.items() if len(s) == k}
    return _best(_search(weighed.sortWithinPartitions(F.col("norm").desc()), lists, least, weights, k), k)


def rank_documents(
    docs: DataFrame,
    items: DataFrame,
    *,
    k: int = 10,
    key: str = "doc_id",
    text: str = "text",
    item: str = "item_id",
    item_text: str = "text",
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the ``k`` highest documents of each item
    with a score above 0, equal scores by ascending id.

    Terms are maximal runs of ASCII letters and digits and of characters beyond
    ASCII, A-Z lower-cased, in whole texts. Weights and lengths follow the
    counts over all documents: a term that ``df`` of ``N`` documents hold weighs
    floor(1000 ln((2N+2)/(2df+1))), its impact is
    10^9 tf div (1000 tf + 8 m) with m = 10 + 90 n N div L. All of it but the
    logarithm is in 64-bit integers.

    A null or empty text has no terms: such a document counts nowhere, such an
    item has no rows. Each item row is an item of its own, repeated ones too;
    repeated documents count and rank one by one. A null id comes after others
    of its score; ids are longs. Other columns of any name are ignored. An empty
    table on either side gives no rows.

    Items are searched in blocks of ``block_bytes`` of terms, the only thing
    sent to all tasks; one block reads the texts once. No text is shuffled: the
    vectors over the asked terms are written once and sorted within tasks.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    terms = _item_terms(items, item, item_text)
    blocks = max(1, -(-(terms.agg(F.sum("size")).first()[0] or 0) // block_bytes))
    result = None
    for b in range(blocks):
        found = _block(spark, rows, terms.where(F.pmod(F.xxhash64("q"), F.lit(blocks)) == b), k)
        if found is not None:
            result = found if result is None else result.unionByName(found)
    if result is None:
        return terms.where("false").select("item_id", F.lit(0).alias("rank"), F.lit(0).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("score"))
    return result.join(terms.select("q", "item_id"), "q").select("item_id", "rank", "doc_id", "score")


#: The same ranking in SQL.
SQL = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, row_number() OVER () AS q, regexp_extract_all(translate(coalesce(text, ''),
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM benchmark),
a AS (SELECT count(*) FILTER (WHERE len(w) > 0) AS n_docs, CAST(sum(len(w)) AS BIGINT) AS n_terms FROM d),
tf AS (SELECT r, t, count(*) AS tf FROM (SELECT r, unnest(w) AS t FROM d) GROUP BY r, t),
weight AS (SELECT t, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
           FROM (SELECT t, count(*) AS df FROM tf GROUP BY t), a),
q AS (SELECT DISTINCT q, item_id, unnest(w) AS t FROM b),
s AS (SELECT q, item_id, d.r, d.doc_id, CAST(sum(weight.w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * len(d.w) * n_docs) // n_terms)))) AS BIGINT) AS score
      FROM q JOIN weight USING (t) JOIN tf USING (t) JOIN d ON d.r = tf.r, a GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM k WHERE rank <= 10
"""
