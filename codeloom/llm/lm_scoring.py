"""Language-model scores from an Elias-Fano n-gram trie.

The trie has a level of words and one for each longer n-gram up to the order,
each cut into shards by range. An entry of a level is a word after a context,
and a context is the number of an entry of the level above. Words and the
successors of a context are monotone sequences, and every n-gram of the training
texts is kept. An entry has its share of the context and a context what it
leaves to shorter ones, each as one byte of the level's codebook. Tasks map the
shard files into memory and search the successors of a context for a word, once
for each length.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from codeloom.llm.common import BLANKS, Sealed, Words, mixed, staged, text_chunks, word_bytes
from codeloom.llm.elias_fano import Monotone, bytewise, load, part, prefixed, save, taken
from codeloom.session import shared_dir

SMOOTH = 0.1  # added to every word's count
DISCOUNT = 0.75  # taken from the count of every n-gram of two or more words
MIN_PAIR = 1  # every pair is kept, those seen once too
ORDER = 2  # words of the longest n-grams, unless asked otherwise
#: Tokens of one shard file, and tokens counted in a task before it emits.
SHARD, HELD = 1_000_000, 2_000_000
#: Tokens looked at, and keys of each shard, to cut a level by range.
SAMPLED, KEYS = 1_000_000, 64
END = np.uint64(0x656E64)  # the hash that stands for the end of a text
_FLIP = np.uint64(1 << 63)  # keeps the order of signed hashes


@dataclass
class Level:
    """The n-grams of one length; lists have a row for each shard file."""

    first: list[tuple[int, int]] = field(default_factory=list)  # least (context, word)
    ids: list[int] = field(default_factory=list)  # number of entries before it
    files: list[str] = field(default_factory=list)
    # the first contexts of shards, which may go on in others, and what they leave
    edges: list[int] = field(default_factory=list)
    edge_rests: list[float] = field(default_factory=list)
    entries: int = 0
    most: int = 1  # the highest count of a context
    top: int = 1  # the highest count of an entry

    @property
    def book(self) -> np.ndarray:
        """The values of the 256 codes, evenly spaced by their logarithms from
        the least share that there can be to 1."""
        return np.geomspace((1 - DISCOUNT) / self.most, 1, 256)

    def codes(self, values: np.ndarray) -> np.ndarray:
        low = np.log((1 - DISCOUNT) / self.most)
        return np.rint((np.log(values) - low) * (255 / -low)).clip(0, 255).astype(np.uint8)


@dataclass
class Model:
    """What a task needs to open the trie: one row for each shard file."""

    folder: str
    tokens: int = 0
    words: int = 0
    texts: int = 0
    top: int = 1  # the highest count of a word
    first_word: list[int] = field(default_factory=list)  # smallest hash of each word shard
    word_ids: list[int] = field(default_factory=list)  # number of words before it
    word_files: list[str] = field(default_factory=list)
    levels: list[Level] = field(default_factory=list)  # pairs, triples and so on

    @property
    def error(self) -> float:
        """Bound of what the codebooks add to or take from the log10 of one
        token's probability: half a step of each level."""
        return sum(np.log10(level.most / (1 - DISCOUNT)) / 255 / 2 for level in self.levels)


class Trie:
    """Lookups over the shards of a model; files are opened when first asked."""

    def __init__(self, model: Model):
        self.model, self.opened = model, {}

    def _open(self, path: str) -> dict:
        if path not in self.opened:
            arrays = load(self.model.folder, path)
            self.opened[path] = {
                "arrays": arrays,
                **{k: Monotone.of(part(arrays, k)) for k in ("keys", "sums", "starts") if f"{k}.meta" in arrays},
            }
        return self.opened[path]

    def words(self, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(id or -1, training count) of each word hash."""
        ids, counts = np.full(len(hashes), -1, np.int64), np.zeros(len(hashes), np.int64)
        if not self.model.word_files:
            return ids, counts
        keys = hashes ^ _FLIP
        shard = np.searchsorted(np.array(self.model.first_word, np.uint64), keys, "right") - 1
        for s in np.unique(shard[shard >= 0]):
            own = np.flatnonzero(shard == s)
            held = self._open(self.model.word_files[s])
            at = held["keys"].find(keys[own])
            own, at = own[at >= 0], at[at >= 0]
            ids[own] = at + self.model.word_ids[s]
            ends = held["sums"].get(np.concatenate((at, at + 1)))
            counts[own] = (ends[len(at) :] - ends[: len(at)]).astype(np.int64)
        return ids, counts

    def entries(
        self, level: Level, context: np.ndarray, word: np.ndarray, scored: bool = True
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(id or -1, share of its context or 0, what the context leaves to
        shorter ones or 1) of each word after its context; only ids unless
        ``scored``. The rows are sorted by both; a word may be -1 (unknown).

        Entries sorted by (context, word) are cut into shards anywhere, so a
        context with very many successors spreads over several files.
        """
        ids, share, rest = np.full(len(context), -1, np.int64), np.zeros(len(context)), np.ones(len(context))
        at = [*_places(context, word, level.first), len(context)]
        span, book = np.uint64(self.model.words), level.book
        for s, (a, b) in enumerate(zip(at, at[1:])):
            if a == b:
                continue
            held, c = self._open(level.files[s]), context[a:b]
            new = np.concatenate(([True], c[1:] != c[:-1]))
            node = held["keys"].find(c[new].astype(np.uint64))[np.cumsum(new) - 1]
            own = np.flatnonzero(node >= 0)
            node = node[own]
            if scored:
                rest[a + own] = book[held["arrays"]["rest"][node]]
            known = word[a + own] >= 0
            own, node = a + own[known], node[known]
            # the words of the i-th context lie in [i * span, (i + 1) * span)
            found = held["starts"].find(node.astype(np.uint64) * span + word[own].astype(np.uint64))
            own, found = own[found >= 0], found[found >= 0]
            ids[own] = found + level.ids[s]
            if scored:
                share[own] = book[held["arrays"]["share"][found]]
        if scored and level.edges:
            edges = np.array(level.edges, np.int64)
            near = np.minimum(np.searchsorted(edges, context), len(edges) - 1)
            rest = np.where(edges[near] == context, np.array(level.edge_rests)[near], rest)
        return ids, share, rest

    def followed(self, contexts: list[int]) -> list[int]:
        """How often each context of the level to come is followed: the count
        of its entry in the last level, as no text goes on after its end."""
        model, out = self.model, []
        before = model.levels[-1].ids if model.levels else model.word_ids
        for c in contexts:
            s = int(np.searchsorted(before, c, "right")) - 1
            if model.levels:
                out.append(int(taken(self._open(model.levels[-1].files[s])["arrays"], "counts", np.array([c - before[s]]))[0]))
            elif c == model.words:
                out.append(model.texts)
            else:
                first, last = self._open(model.word_files[s])["sums"].get(np.array([0, 1]) + (c - before[s]))
                out.append(int(last - first))
        return out


def _places(c: np.ndarray, w: np.ndarray, keys: list[tuple[int, int]]) -> list[int]:
    """For each (context, word) of ``keys`` how many of the sorted rows are less."""
    at = []
    for x, y in keys:
        low, high = np.searchsorted(c, x, "left"), np.searchsorted(c, x, "right")
        at.append(int(low + np.searchsorted(w[low:high], y, "left")))
    return at


def _tokens(data: np.ndarray, offsets: np.ndarray, tool: Words) -> tuple[np.ndarray, np.ndarray]:
    """(hashes with an END after each text, token bounds of the texts)."""
    start, end = tool.split(data, offsets)
    hashes, bounds = tool.hashes(data, start, end), np.searchsorted(start, offsets)
    return np.insert(hashes, bounds[1:], END), bounds + np.arange(len(bounds))


def _word_counts(docs: DataFrame) -> DataFrame:
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, held, size = Words(word_bytes(BLANKS, fold=True)), [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("__text")):
                held.append(_tokens(data, offsets, tool)[0])
                size += len(held[-1])
                if size >= HELD:
                    yield counted(held)
                    held, size = [], 0
        if held:
            yield counted(held)

    def counted(held: list[np.ndarray]) -> pa.RecordBatch:
        h, n = np.unique(np.concatenate(held), return_counts=True)
        return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n)], names=["h", "n"])

    return docs.mapInArrow(rows, "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def _paired(trie: Trie, hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of the contexts, ids, counts) for each token; a text's first token
    has the start, whose id follows those of the words, as its context."""
    distinct, back = np.unique(hashes, return_inverse=True)
    ids, counts = trie.words(distinct)
    ids, counts = ids[back], counts[back]
    context = np.empty_like(ids)
    context[1:] = ids[:-1]
    context[bounds[:-1]] = trie.model.words
    return context, ids, counts


def _longer(
    trie: Trie, level: Level, context: np.ndarray, ids: np.ndarray, bounds: np.ndarray, scored: bool = True
) -> tuple[np.ndarray, ...]:
    """(contexts of the next level, shares, rests) for each token, as
    ``entries`` gives them; -1 stands for contexts that are not in the trie, or
    that would begin before the text."""
    ask = np.flatnonzero(context >= 0)
    order, new = _runs(context[ask], ids[ask], trie.model.words)
    order, run = ask[order], np.cumsum(new) - 1
    first = order[new]
    found = trie.entries(level, context[first], ids[first], scored)
    entry, share, rest = np.full(len(ids), -1, np.int64), np.zeros(len(ids)), np.ones(len(ids))
    for whole, x in zip((entry, share, rest) if scored else (entry,), found):
        whole[order] = x[run]
    after = np.empty_like(entry)
    after[1:] = entry[:-1]
    after[bounds[:-1]] = -1
    return after, share, rest


def _runs(c: np.ndarray, w: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """Order of (c, w), where w >= -1, and where its runs of equal ones begin."""
    if len(c) and (int(c.max()) + 1) * (words + 1) < 1 << 63:  # one key is sorted faster
        order = np.argsort(c * (words + 1) + w)
    else:
        order = np.lexsort((w, c))
    c, w = c[order], w[order]
    return order, np.concatenate(([True], (c[1:] != c[:-1]) | (w[1:] != w[:-1])))[: len(c)]


def _summed(c: np.ndarray, w: np.ndarray, n: np.ndarray | None, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different (c, w) in order with the sum of their counts, 1 each if None."""
    order, new = _runs(c, w, words)
    at = np.flatnonzero(new)
    total = np.diff(np.concatenate((at, [len(c)]))) if n is None else np.add.reduceat(n[order], at)
    return c[order][at], w[order][at], total


def _counted(given: DataFrame, model: Model, schema: str, emit) -> DataFrame:
    """``emit`` over the (context, word, count) of the n-grams one longer than
    the levels of ``model``, summed over HELD tokens at a time."""
    held_model = given.sparkSession.sparkContext.broadcast(model)  # a row for each shard file

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie, tool, held, size = Trie(held_model.value), Words(word_bytes(BLANKS, fold=True)), [], 0
        for batch in batches:
            for _, data, offsets in text_chunks(batch.column("__text")):
                held.append(_tokens(data, offsets, tool))
                size += len(held[-1][0])
                if size >= HELD:
                    yield emit(*counted(trie, held))
                    held, size = [], 0
        if size:
            yield emit(*counted(trie, held))

    def counted(trie: Trie, held: list[tuple]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        starts = np.cumsum([0, *(len(h) for h, _ in held)])
        hashes = np.concatenate([h for h, _ in held])
        bounds = np.concatenate([*(b[:-1] + s for (_, b), s in zip(held, starts)), starts[-1:]])
        context, ids, _ = _paired(trie, hashes, bounds)
        for level in trie.model.levels:
            context = _longer(trie, level, context, ids, bounds, scored=False)[0]
        has = context >= 0
        return _summed(context[has], ids[has], None, trie.model.words)

    return given.mapInArrow(rows, schema)


def _cuts(given: DataFrame, model: Model, count: int) -> list[tuple[int, int]]:
    """Least (context, word) of all shards but the first, from a sample."""
    if count == 1:
        return []
    share = min(1.0, max(0.02, SAMPLED / model.tokens))
    rate = np.uint64(max(1, int(share * model.tokens / (KEYS * count))))

    def some(c: np.ndarray, w: np.ndarray, _: np.ndarray) -> pa.RecordBatch:
        own = np.flatnonzero(mixed(mixed(c.view(np.uint64)) + w.view(np.uint64)) % rate == 0)
        return pa.RecordBatch.from_arrays([pa.array(c[own]), pa.array(w[own])], names=["c", "w"])

    keys = _counted(given.sample(share, seed=8), model, "c long, w long", some).toArrow()
    keys = sorted(zip(keys["c"].to_pylist(), keys["w"].to_pylist()))
    return sorted({keys[i * len(keys) // count] for i in range(1, count)}) if keys else []


def _add_level(given: DataFrame, model: Model, last: bool) -> None:
    """Counts the n-grams one longer than the trie has and writes their level;
    the ``last`` one needs no counts beside its shares.

    Tasks cut their counts at the bounds of the shards and send each piece as
    one compressed row, so that a shard is summed and written in one task.
    """
    cuts = _cuts(given, model, max(1, -(-model.tokens // SHARD)))
    words, folder, number = model.words, model.folder, len(model.levels) + 2
    level = Level(most=model.levels[-1].top if model.levels else max(model.top, model.texts))
    known, codes = given.sparkSession.sparkContext.broadcast(model), level.codes  # a row for each shard file

    def pieces(c: np.ndarray, w: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
        at = [0, *_places(c, w, cuts), len(c)]
        codec, out = pa.Codec("zstd", 1), []
        for s, (a, b) in enumerate(zip(at, at[1:])):
            if a < b:
                planes = [x.astype("<i8").view(np.uint8).reshape(-1, 8).T for x in (np.diff(c[a:b], prepend=0), w[a:b], n[a:b])]
                out.append((s, b - a, codec.compress(np.concatenate(planes).tobytes(), asbytes=True)))
        s, size, data = zip(*out) if out else ((), (), ())
        return pa.RecordBatch.from_arrays(
            [pa.array(s, pa.int32()), pa.array(size, pa.int64()), pa.array(data, pa.binary())], names=["s", "n", "data"]
        )

    def opened(size: int, data: bytes) -> list[np.ndarray]:
        planes = np.frombuffer(pa.Codec("zstd").decompress(data, 24 * size, asbytes=True), np.uint8).reshape(3, 8, size)
        c, w, n = (np.ascontiguousarray(x.T).view("<i8").ravel() for x in planes)
        return [np.cumsum(c), w, n]

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [opened(n, d) for b in batches for n, d in zip(b.column("n").to_pylist(), b.column("data").to_pylist())]
        if not held:
            return
        c, w, n = _summed(*(np.concatenate(x) for x in zip(*held)), words)
        held.clear()
        at = np.flatnonzero(np.concatenate(([True], c[1:] != c[:-1])))
        contexts, sizes, total = c[at], np.diff(np.append(at, len(c))), np.add.reduceat(n, at)
        node = np.repeat(np.arange(len(at)), sizes)
        total[[0, -1]] = Trie(known.value).followed([int(c[0]), int(c[-1])])  # they may go on in other shards
        arrays = prefixed("keys", Monotone.packed(contexts.astype(np.uint64)))
        arrays |= prefixed("starts", Monotone.packed(node.astype(np.uint64) * np.uint64(words) + w.astype(np.uint64)))
        arrays |= {"share": codes((n - DISCOUNT) / total[node]), "rest": codes(DISCOUNT * sizes / total)}
        if not last:
            arrays |= bytewise("counts", n)
        path = save(folder, f"grams{number}-{TaskContext.get().partitionId():06d}", arrays)
        facts = [c[0], w[0], len(c), sizes[0], total[0], c[-1], sizes[-1], n.max()]
        yield pa.RecordBatch.from_arrays(
            [*(pa.array([int(x)], pa.int64()) for x in facts), pa.array([path])],
            names=["c", "w", "n", "size", "total", "last", "last_size", "top", "path"],
        )

    sent = _counted(given, model, "s int, n long, data binary", pieces).repartitionById(len(cuts) + 1, F.col("s"))
    kind = "c long, w long, n long, size long, total long, last long, last_size long, top long, path string"
    files = sorted(sent.select("n", "data").mapInArrow(build, kind).collect())  # a row for each file
    sizes, totals = {r.c: 0 for r in files}, {r.c: r.total for r in files}
    for r in files:
        level.first.append((r.c, r.w))
        level.ids.append(level.entries)
        level.files.append(r.path)
        level.entries += r.n
        level.top = max(level.top, r.top)
        sizes[r.c] += r.size
        if r.last != r.c and r.last in sizes:
            sizes[r.last] += r.last_size
    level.edges = sorted(sizes)
    rests = np.array([DISCOUNT * sizes[c] / totals[c] for c in level.edges])
    level.edge_rests = level.book[level.codes(rests)].tolist()
    model.levels.append(level)


def _shards(df: DataFrame, rows: int, order: str, write) -> list:
    """Sorts ``df`` by range into shards of about SHARD rows; ``write`` turns
    the columns of one into a file. Returns (first key, rows, path) by order."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)  # about SHARD rows
        if not sum(b.num_rows for b in held):
            return
        table = pa.Table.from_batches(held)
        columns = {c: table.column(c).to_numpy() for c in table.column_names}
        path = write(f"{TaskContext.get().partitionId():06d}", columns)
        yield pa.RecordBatch.from_arrays(
            [pa.array([int(columns[order][0])], pa.int64()), pa.array([table.num_rows], pa.int64()), pa.array([path])],
            names=["a", "n", "path"],
        )

    count = max(1, -(-rows // SHARD))
    laid = df.repartitionByRange(count, order).sortWithinPartitions(order)
    found = laid.mapInArrow(build, "a long, n long, path string").collect()  # a row for each file
    return sorted((r.a, r.n, r.path) for r in found)


def train(docs: DataFrame, *, text: str = "text", rows: Column | None = None, order: int = ORDER) -> Model:
    """Counts the n-grams of up to ``order`` words (2 or more) of the texts
    that satisfy ``rows`` and writes the trie to the shared folder.

    Counts are summed in each task, then for each shard; the driver sees one
    row for each file of about a million entries, and a sample of 64 keys of
    each to cut them. A null text counts as empty, which is one end token.
    Without rows the model knows no word.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/llm/trie-{uuid.uuid4().hex}"
    given = docs if rows is None else docs.where(rows)
    given = given.select(F.col(text).alias("__text"))
    counts = staged(_word_counts(given), "lm-words")
    total = counts.agg(F.count(F.lit(1)).alias("v"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.max("n").alias("top")).first()
    model = Model(folder, tokens=total.n, words=total.v, top=total.top or 1)
    if not total.v:
        return model

    def word_level(name: str, columns: dict) -> str:
        keys = columns["h"].view(np.uint64) ^ _FLIP
        sums = np.concatenate(([0], np.cumsum(columns["n"]))).astype(np.uint64)
        arrays = prefixed("keys", Monotone.packed(keys)) | prefixed("sums", Monotone.packed(sums))
        return save(folder, f"words-{name}", arrays)

    before = 0
    for a, n, path in _shards(counts, total.v, "h", word_level):
        model.first_word.append((a + (1 << 63)) % (1 << 64))
        model.word_ids.append(before)
        model.word_files.append(path)
        before += n
    model.texts = counts.where(F.col("h") == int(END)).select("n").first().n
    for length in range(2, order + 1):
        _add_level(given, model, length == order)
    return model


def score_texts(df: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """Adds ``n_tokens``, ``n_known``, ``train_tokens``, ``base_score`` and
    ``score`` to the rows of ``df``, without the text.

    ``base_score`` sums log10((c + 0.1) / (N + 0.1 (V + 1))). ``score`` backs
    off from the longest context to shorter ones: after a context v that was
    followed n(v) times, by t(v) different words, p(w | v) = (max(n(vw) - D, 0)
    + D t(v) p(w | v without its first word)) / n(v), and a context that is not
    in the trie is shortened. Both quotients by n(v) are codes of a byte, so a
    text's score is within ``model.error`` times its tokens of that. A null text is an empty one: a single end token.
    Rows are kept as they are; columns of these names are replaced.
    """
    held = df.sparkSession.sparkContext.broadcast(model)
    made = ["n_tokens", "n_known", "train_tokens", "base_score", "score"]
    own = Sealed(df, made, drop=(text,))
    kept = own.columns
    types = [f"{f.name} {f.dataType.simpleString()}" for f in own.table.select(*kept).schema.fields]
    types += ["n_tokens long", "n_known long", "train_tokens long", "base_score double", "score double"]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = held.value
        trie, tool = Trie(known), Words(word_bytes(BLANKS, fold=True))
        mass = known.tokens + SMOOTH * (known.words + 1)
        for batch in batches:
            out = []
            for _, data, offsets in text_chunks(batch.column("__text"), 4 << 20):
                hashes, bounds = _tokens(data, offsets, tool)
                context, ids, counts = _paired(trie, hashes, bounds)
                single = (counts + SMOOTH) / mass
                p = single
                for level in known.levels:
                    context, share, rest = _longer(trie, level, context, ids, bounds)
                    p = share + rest * p
                sums = [
                    np.add.reduceat(x, bounds[:-1]) for x in ((counts > 0).astype(np.int64), np.log10(single), np.log10(p))
                ]
                out.append((np.diff(bounds), *sums))
            if not out:
                continue
            n, seen, base, score = (np.concatenate(x) for x in zip(*out))
            columns = [batch.column(c) for c in kept]
            columns += [pa.array(x, k) for x, k in ((n, pa.int64()), (seen, pa.int64()))]
            columns.append(pa.array(np.full(len(n), known.tokens), pa.int64()))
            columns += [pa.array(base), pa.array(score)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, *made])

    source = own.table.select(*kept, F.col(own.name(text)).alias("__text"))
    return own.restored(source.mapInArrow(rows, ", ".join(types)))
