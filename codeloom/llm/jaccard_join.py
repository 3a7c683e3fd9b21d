"""N-gram Jaccard self-join with MinHash banding.

Each text gives the set of its five-word shingles, and each of several bands a
hash of a few min-hashes of it. Texts that share a band are candidates; the
length of a band is the longest, up to the full depth, that a pair at the
threshold shares with the target recall. It follows from the parameters alone:
there are no sorted tries whose prefixes are shortened pair by pair. Candidates
that hang together are brought together once, and every pair of them is
verified exactly, pairs that share no band too.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, Sealed, Words, distinct, mixed, staged, text_chunks, word_bytes
from codeloom.llm.components import components

SHINGLE, THRESHOLD = 5, 0.8
TREES, DEPTH, RECALL = 28, 8, 0.9999
#: Texts, and bytes of them, on each side of a block that is verified at once.
BLOCK, BLOCK_BYTES = 2048, 16 << 20
#: Shingles in more texts of a block than this are counted by a dense product.
DENSE = 24
COLUMNS = 4096


def prefix_length(trees: int, depth: int, threshold: float, recall: float) -> int:
    """The longest prefix that pairs at the threshold share in at least one
    trie with the target recall; one hash when no length reaches it."""
    for k in range(depth, 1, -1):
        if 1 - (1 - threshold**k) ** trees >= recall:
            return k
    return 1


def shingles(data: np.ndarray, offsets: np.ndarray, tool: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, text of each) of all runs of ``k`` words; a text of fewer words,
    but not none, is one shingle."""
    start, end = tool.split(data, offsets)
    words, bounds = tool.hashes(data, start, end), np.searchsorted(start, offsets)
    first, h = tool.windows(words, bounds, k)
    row = np.searchsorted(bounds, first, "right") - 1
    short = np.flatnonzero((np.diff(bounds) > 0) & (np.diff(bounds) < k))
    if len(short):
        h = np.concatenate((h, tool.runs.slices(words, bounds[short], bounds[short + 1])))
        row = np.concatenate((row, short))
        order = np.argsort(row, kind="stable")
        h, row = h[order], row[order]
    return h, row


def _signed(docs: DataFrame, columns: list[str], text: str, trees: int, length: int, k: int) -> DataFrame:
    """Each row with the digest of its shingle set and its prefix in each trie
    (both null for a text without words)."""
    types = [f"{f.name} {f.dataType.simpleString()}" for f in docs.select(*columns).schema.fields]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool = Words(word_bytes(BLANKS))
        factors = mixed(np.arange(1, trees * length + 1, dtype=np.uint64)) | np.uint64(1)
        for batch in batches:
            ids, paths = [], []
            for _, data, offsets in text_chunks(batch.column("__text")):
                n = len(offsets) - 1
                h, row = distinct(*shingles(data, offsets, tool, k))
                has = np.unique(row)
                at = np.searchsorted(row, has)
                if not len(has):
                    ids += [None] * n
                    paths += [None] * n
                    continue
                digest = np.column_stack(
                    [np.add.reduceat(x, at) for x in (mixed(h), mixed(h ^ np.uint64(0x5BD1E9955BD1E995)))]
                )
                prefix = np.zeros((len(has), trees), np.uint64)
                for i, a in enumerate(factors):
                    # multiply, then fold the well mixed upper half down
                    least = np.minimum.reduceat((h * a) >> np.uint64(16), at)
                    prefix[:, i // length] = mixed(prefix[:, i // length] * np.uint64(31) + least + np.uint64(i))
                own = dict(zip(has.tolist(), range(len(has))))
                raw = digest.astype(">u8").tobytes()
                signs = prefix.view(np.int64).tolist()
                for r in range(n):
                    j = own.get(r)
                    ids.append(None if j is None else raw[16 * j : 16 * j + 16])
                    paths.append(None if j is None else signs[j])
            kept = [batch.column(c) for c in columns]
            kept += [pa.array(ids, pa.binary()), pa.array(paths, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(kept, names=[*columns, "__set", "__paths"])

    source = docs.select(*columns, F.col(text).alias("__text"))
    return source.mapInArrow(rows, ", ".join([*types, "__set binary", "__paths array<long>"]))


def _overlaps(h: np.ndarray, row: np.ndarray, n: int, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Common shingles of each text of ``left`` with each of ``right``."""
    _, column, count = np.unique(h, return_inverse=True, return_counts=True)
    side = np.full((2, n), -1)
    side[0, left], side[1, right] = np.arange(len(left)), np.arange(len(right))
    out = np.zeros((len(left), len(right)), np.float32)
    frequent = np.flatnonzero(count > DENSE)
    place = np.full(len(count), -1)
    place[frequent] = np.arange(len(frequent))
    dense = place[column] >= 0
    c, r = place[column[dense]], row[dense]
    order = np.argsort(c, kind="stable")
    c, r = c[order], r[order]
    for low in range(0, len(frequent), COLUMNS):
        cut = slice(*np.searchsorted(c, (low, low + COLUMNS)))
        x, y = (np.zeros((len(s), min(COLUMNS, len(frequent) - low)), np.float32) for s in (left, right))
        for m, s in ((x, 0), (y, 1)):
            at = side[s, r[cut]]
            m[at[at >= 0], (c[cut] - low)[at >= 0]] = 1
        out += x @ y.T
    # the rest: runs of texts that hold one shingle, paired at each distance
    c, r = column[~dense], row[~dense]
    keep = count[c] > 1
    c, r = c[keep], r[keep]
    order = np.argsort(c, kind="stable")
    c, r = c[order], r[order]
    for gap in range(1, DENSE):
        same = np.flatnonzero(c[gap:] == c[:-gap]) if len(c) > gap else np.zeros(0, np.intp)
        if not len(same):
            break
        for a, b in ((r[same], r[same + gap]), (r[same + gap], r[same])):
            i, j = side[0, a], side[1, b]
            ok = (i >= 0) & (j >= 0)
            np.add.at(out, (i[ok], j[ok]), 1)
    return out


def _roots(links: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> np.ndarray:
    """Least position among all texts that hang together by ``links``."""
    label = np.arange(n)
    pairs = np.nonzero(links)
    a, b = left[pairs[0]], right[pairs[1]]
    while True:
        before = label.copy()
        np.minimum.at(label, a, before[b])
        np.minimum.at(label, b, before[a])
        label = label[label]
        if (label == before).all():
            return label


def _verify(threshold: float, k: int):
    def check(key: tuple, part: pd.DataFrame) -> pd.DataFrame:
        part = part.drop_duplicates("set").sort_values("set", ignore_index=True)
        n, tool, hs, rows = len(part), Words(word_bytes(BLANKS)), [], []
        for base, data, offsets in text_chunks(pa.array(part["text"], pa.large_string())):
            h, row = distinct(*shingles(data, offsets, tool, k))
            hs.append(h)
            rows.append(row + base)
        h, row = np.concatenate(hs), np.concatenate(rows)
        size = np.bincount(row, minlength=n).astype(float)
        everyone = np.arange(n)
        one, two = key[2], key[3]
        left = everyone if one == two else np.flatnonzero(part["block"] == one)
        right = everyone if one == two else np.flatnonzero(part["block"] == two)
        common = _overlaps(h, row, n, left, right).astype(float)
        union = size[left][:, None] + size[right][None, :] - common
        links = common >= threshold * union - 1e-9
        if one == two:
            np.fill_diagonal(links, False)
        copies = part["copies"].to_numpy(np.int64)
        sets, docs = np.zeros(n, np.int64), np.zeros(n, np.int64)
        sets[left], docs[left] = links.sum(axis=1), links @ copies[right]
        if one != two:
            sets[right], docs[right] = links.sum(axis=0), copies[left] @ links
        root = _roots(links, left, right, n)
        has = np.flatnonzero(sets)
        return pd.DataFrame(
            {"set": part["set"].iloc[has], "root": part["set"].iloc[root[has]].to_numpy(), "sets": sets[has], "docs": docs[has]}
        )

    return check


def jaccard_classes(
    df: DataFrame,
    *,
    text: str = "text",
    key: str = "doc_id",
    k: int = SHINGLE,
    threshold: float = THRESHOLD,
    trees: int = TREES,
    depth: int = DEPTH,
    recall: float = RECALL,
) -> DataFrame:
    """Each row of ``df`` without its text, with

    * ``set_id``: the least key among rows with the same shingle set,
    * ``class_id``: the least key among rows that hang together by links,
    * ``class_set``: the digest of one shingle set of that class, which tells
      classes apart where keys repeat; null for a text without words,
    * ``n_links``: how many other rows have a similarity of ``threshold`` or
      more, rows with the same set included,
    * ``n_linked_sets``: how many other shingle sets do.

    Words are runs of characters other than blanks, as they stand. A text of
    fewer than ``k`` words is one shingle; one without words (null, empty) has
    no links and is its own class. Repeated rows are copies. A null key never
    names a set that has other keys. Other columns are kept, those of the five
    names replaced; an empty table gives none.

    Equal sets are joined once. A large group of candidates is verified in
    pairs of blocks, whose links are counted, never listed.
    """
    made = ["set_id", "class_id", "class_set", "n_links", "n_linked_sets"]
    own = Sealed(df, made, drop=(text,))
    text, key = own.name(text), own.name(key)
    columns = list(dict.fromkeys([*own.columns, key]))
    length = prefix_length(trees, depth, threshold, recall)
    docs = own.table.select(*columns, F.coalesce(F.col(text), F.lit("")).alias("__t"))
    docs = docs.withColumns({"__mark": F.xxhash64("__t"), "__bytes": F.octet_length("__t").cast("long")})
    signed = staged(_signed(docs, [*columns, "__mark", "__bytes"], "__t", trees, length, k), "forest")
    filled = signed.where(F.col("__set").isNotNull())

    paths = filled.select(F.col("__set").alias("a"), F.posexplode("__paths").alias("tree", "prefix"))
    nodes = paths.groupBy("tree", "prefix").agg(F.min("a").alias("b"), F.max("a").alias("top"))
    nodes = nodes.where(F.col("b") != F.col("top")).drop("top")
    together = components(paths.join(nodes, ["tree", "prefix"]).select("a", "b").where("a != b"))

    # one row per candidate set, and the row whose text stands for it
    stand = F.min(F.struct(F.col(key).alias("key"), F.col("__mark").alias("mark"))).alias("s")
    sets = filled.groupBy(F.col("__set").alias("set")).agg(
        F.count(F.lit(1)).alias("copies"), F.min(key).alias("least"), F.max("__bytes").alias("bytes"), stand
    )
    sets = staged(sets, "sets")
    met = staged(sets.join(together, F.col("set") == F.col("node")).drop("node"), "candidates")
    groups = met.groupBy("root").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("size"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK), F.ceil(F.col("size") / BLOCK_BYTES)).cast("int")
    groups = groups.select(F.col("root").alias("__root"), blocks.alias("blocks"))
    total = met.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("size")).first()
    packs = max(1, 2 * total.n // BLOCK, 2 * total.size // BLOCK_BYTES)
    placed = met.join(groups, F.col("root") == F.col("__root")).select(
        "set", "copies", "s", "blocks", "root", F.pmod(F.xxhash64("set"), F.col("blocks")).cast("int").alias("block")
    )
    texts = docs.select(F.col(key).alias("__k"), F.col("__mark").alias("__m"), F.col("__t").alias("text"))
    texts = placed.join(texts, F.col("s.key").eqNullSafe(F.col("__k")) & (F.col("s.mark") == F.col("__m")))
    small = F.col("blocks") == 1
    other = F.when(small, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
    spread = texts.withColumn("other", F.explode(other)).select(
        "set",
        "copies",
        "block",
        "text",
        F.when(small, F.pmod(F.xxhash64("root"), F.lit(packs))).alias("pack"),
        F.when(~small, F.col("root")).alias("group"),
        F.least("block", "other").alias("one"),
        F.greatest("block", "other").alias("two"),
    )
    found = spread.groupBy("pack", "group", "one", "two").applyInPandas(
        _verify(threshold, k), "set binary, root binary, sets long, docs long"
    )
    found = staged(found, "links")
    counts = found.groupBy(F.col("set").alias("__c")).agg(F.sum("sets").alias("sets"), F.sum("docs").alias("docs"))
    roots = components(found.select(F.col("set").alias("a"), F.col("root").alias("b")))
    facts = (
        sets.join(counts, F.col("set") == F.col("__c"), "left")
        .join(roots, F.col("set") == F.col("node"), "left")
        .withColumn("root", F.coalesce("root", "set"))
    )
    classes = facts.groupBy(F.col("root").alias("__root")).agg(F.min("least").alias("class_id"))
    facts = facts.join(classes, F.col("root") == F.col("__root")).select(
        "set",
        F.col("least").alias("set_id"),
        "class_id",
        F.col("root").alias("class_set"),
        (F.coalesce("docs", F.lit(0)) + F.col("copies") - 1).cast("long").alias("n_links"),
        F.coalesce("sets", F.lit(0)).cast("long").alias("n_linked_sets"),
    )
    alone = F.col("set").isNull()
    out = signed.join(facts, F.col("__set") == F.col("set"), "left").select(
        *columns,
        F.when(alone, F.col(key)).otherwise(F.col("set_id")).alias("set_id"),
        F.when(alone, F.col(key)).otherwise(F.col("class_id")).alias("class_id"),
        "class_set",
        F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"),
        F.coalesce("n_linked_sets", F.lit(0).cast("long")).alias("n_linked_sets"),
    )
    return own.restored(out)
