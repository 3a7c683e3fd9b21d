"""Ranked search, fingerprints, whitening against brute force."""

import hashlib
import math
import random
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from codeloom.llm import ranked_search, simhash, whitening

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile("[^\x20\x09-\x0d]+")

# Ranked search


def terms(text):
    return TERM.findall((text or "").translate(LOWER))


def ranked_brute(docs, items, k=10):
    """(item, rank, score) lists and the ids at each; scores by the formula."""
    counted = [(i, Counter(terms(t))) for i, t in docs]
    n_docs = sum(1 for _, c in counted if c)
    n_terms = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = Counter()
    for item, text in items:
        found = []
        for i, c in counted:
            if not c:
                continue
            m = 10 + (90 * sum(c.values()) * n_docs) // n_terms
            score = 0
            for t in set(terms(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, i is None, i))
        found.sort(key=lambda x: (x[0], x[1], x[2] or 0))
        out.update((item, r, i, -s) for r, (s, _, i) in enumerate(found[:k], 1))
    return out


def ranked(df):
    return Counter((r.item_id, r.rank, r.doc_id, r.score) for r in df.collect())


def items_of(spark, texts):
    return spark.createDataFrame([(f"i{n}", t, 1) for n, t in enumerate(texts)], "item_id string, text string, doc_id int")


def test_ranks_odd_rows(spark, docs, plain, nothing):
    """Nulls, empty, long and repeated texts, ties between copies, a null id."""
    texts = [t for _, t in plain[:12]] + ["one two", "ONE, Two!", None, "", "never-seen", "a text without an id", plain[5][1]]
    items = items_of(spark, texts)
    want = ranked_brute(plain, [(f"i{n}", t) for n, t in enumerate(texts)])
    assert ranked(ranked_search.rank_documents(docs, items)) == want
    assert ranked(ranked_search.rank_documents(docs, items, block_bytes=2000)) == want
    assert ranked_search.rank_documents(nothing, items).count() == 0
    assert ranked_search.rank_documents(docs, items.where("false")).columns == ["item_id", "rank", "doc_id", "score"]


@pytest.mark.parametrize("seed", range(2))
def test_ranks_over_many_buckets(spark, monkeypatch, seed):
    """Small buckets and few coordinates, so that bounds decide often."""
    monkeypatch.setattr(ranked_search, "BUCKET", 16)
    monkeypatch.setattr(ranked_search, "FOCUS", 2)
    r = random.Random(seed)
    words = [f"w{i}" for i in range(60)]
    text = lambda: " ".join(words[min(int(r.expovariate(0.08)), 59)] for _ in range(r.randint(1, 60)))
    rows = [(i, text()) for i in range(600)]
    rows += [(1000 + i, rows[3][1]) for i in range(40)]  # ties of a whole page and more
    asked = [text() for _ in range(15)] + [rows[3][1]]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = ranked_brute(rows, [(f"i{n}", t) for n, t in enumerate(asked)])
    assert ranked(ranked_search.rank_documents(docs, items_of(spark, asked))) == want


# Fingerprints


def bits_of(text):
    words = WORD.findall(text)
    votes, n = [0] * 128, len(words)
    for i in range(n):
        h = hashlib.md5(" ".join(words[i : i + 2]).encode()).hexdigest()
        for p in range(4):
            value = int(h[8 * p : 8 * p + 8], 16)
            for j in range(32):
                votes[32 * p + j] += value >> j & 1
    return [int(2 * v > n) for v in votes]


def hex_of(bits):
    number = lambda p: sum(b << j for j, b in enumerate(bits[32 * p : 32 * p + 32]))
    return "".join(f"{number(p):08x}" for p in range(4))


def edits_brute(rows, pieces):
    """``pieces``: the first sorting key of a text among rows of one id."""
    ids = sorted({i for i, _ in rows}, key=lambda i: (i is None, -(i or 0)))
    after = dict(zip(ids, [*ids[1:], ids[0]]))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    least = {i: min((t for j, t in rows if j == i), key=lambda t: (pieces[t], digest(t))) for i in ids}
    prints = {hex_of(bits_of(t)): bits_of(t) for _, t in rows}
    like = lambda a, b: 1 - sum(x != y for x, y in zip(a, b)) / 128
    out = Counter()
    for i, t in rows:
        half, other = len(t) // 2, least[after[i]]
        edit = t[: len(t) - half] + other[:half]
        own = bits_of(t)
        near = any(0 < sum(x != y for x, y in zip(own, b)) <= 6 for b in prints.values())
        out[(i, len(t), digest(edit), hex_of(own), hex_of(bits_of(edit)), like(own, bits_of(edit)), like(own, bits_of(other)), near)] += 1
    return out


def pieces_of(df):
    text = F.coalesce("text", F.lit(""))
    return {r[0]: r[1] for r in df.select(text, F.pmod(F.xxhash64(text), F.lit(simhash.PIECES))).collect()}


def test_edited_fingerprints(docs, plain, nothing):
    got = simhash.edited_fingerprints(docs)
    assert Counter(map(tuple, got.collect())) == edits_brute(plain, pieces_of(docs))
    assert simhash.edited_fingerprints(nothing).count() == 0
    one = docs.where("doc_id = 4")
    assert Counter(map(tuple, simhash.edited_fingerprints(one).collect())) == edits_brute([p for p in plain if p[0] == 4], pieces_of(one))


def test_rows_that_share_an_id(spark):
    rows = [(7, "a b c d"), (7, "a b c d"), (7, "x y"), (3, "p q r s t u"), (None, "n n m"), (None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, simhash.edited_fingerprints(df).collect())) == edits_brute([(i, t or "") for i, t in rows], pieces_of(df))


def test_fingerprints_keep_rows(docs, plain):
    got = simhash.fingerprints(docs.withColumn("w0", F.lit("taken")))
    text = simhash.as_text(F.col("w0"), F.col("w1"))
    assert got.columns == [*docs.columns, "w0", "w1"]
    assert Counter(map(tuple, got.select("doc_id", text).collect())) == Counter((i, hex_of(bits_of(t))) for i, t in plain)


@pytest.mark.parametrize("rows_per_key", [2, 1024])
def test_block_tables_find_all(spark, monkeypatch, rows_per_key):
    """A group that shares its blocks, random bits, and pairs at the radius."""
    monkeypatch.setattr(simhash, "KEY_ROWS", rows_per_key)
    r = random.Random(3)
    values = {r.getrandbits(128) for _ in range(60)}
    for v in list(values)[:25]:
        for _ in range(4):
            for b in r.sample(range(128), r.randint(1, 8)):
                v ^= 1 << b
            values.add(v)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    halves = {(signed(v >> 64), signed(v & (1 << 64) - 1)): v for v in values}
    df = spark.createDataFrame([*halves, *list(halves)[:5]], "w0 long, w1 long")
    for radius in (6, 3, 0):
        want = {(a, b): (halves[a] ^ halves[b]).bit_count() for a in halves for b in halves if a < b and (halves[a] ^ halves[b]).bit_count() <= radius}
        got = simhash.near_pairs(df, radius).collect()
        assert Counter(((r.a0, r.a1), (r.b0, r.b1), r.distance) for r in got) == Counter((a, b, d) for (a, b), d in want.items())
        assert {tuple(x) for x in simhash.has_near(df, radius).collect()} == {x for pair in want for x in pair}
    with pytest.raises(ValueError):
        simhash.near_pairs(df, 7)


def test_tables_hold_permuted_fingerprints(spark):
    """Two blocks lead in each table, the others follow in their order, and the
    fingerprint comes back; the search merges the tables sorted by their lead."""
    signed = lambda x, n: x - (1 << n) if x >> (n - 1) else x
    w0, w1 = 0x8123456789ABCDEF, 0xFEDCBA9876543210
    blocks = [w >> 16 * b & 0xFFFF for w in (w0, w1) for b in range(4)]
    df = spark.createDataFrame([(signed(w0, 64), signed(w1, 64))], "w0 long, w1 long")
    rows = simhash._tables(df)
    got = {(r.i, r.j): [v >> 16 * k & 0xFFFF for v, n in ((r.lead, 2), (r.rest, 2), (r.low, 4)) for k in reversed(range(n))] for r in rows.collect()}
    assert got == {(i, j): [blocks[i], blocks[j], *(x for b, x in enumerate(blocks) if b not in (i, j))] for i in range(8) for j in range(i + 1, 8)}
    back = rows.select(*simhash._unpermuted(*(F.col(c) for c in ("i", "j", "lead", "rest", "low")))).distinct()
    assert back.collect() == df.collect()
    assert "SortMergeJoin" in simhash.has_near(df)._jdf.queryExecution().executedPlan().toString()


def test_fingerprints_tell_edits_apart(spark):
    """An edited half is nearer than another document, nearly always."""
    r = random.Random(1)
    words = ["".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6))) for _ in range(300)]
    rows = [(i, " ".join(r.choices(words, k=200))) for i in range(200)]
    got = simhash.edited_fingerprints(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sum(r.near_edited > r.near_next for r in got) > 0.97 * len(got)


# Whitening


def polynomial(roots):
    out = [1]
    for r in roots:
        out = [a - r * b for a, b in zip([0, *out], [*out, 0])]
    return out


def test_modular_polynomials():
    r = random.Random(2)
    for d in (1, 2, 3, 7):
        m = [[r.randint(-50, 50) * (r.random() < 0.6) for _ in range(d)] for _ in range(d)]
        m = [[m[i][j] + m[j][i] for j in range(d)] for i in range(d)]
        primes = whitening.primes_below(1 << 31, 3)
        # Faddeev-LeVerrier in fractions
        c, a = [Fraction(1)], np.eye(d, dtype=object)
        for k in range(1, d + 1):
            b = np.array(m, object) @ a
            c.append(-Fraction(sum(b[i, i] for i in range(d)), k))
            a = b + np.eye(d, dtype=object) * c[-1]
        want = [[int(v) % p for v in reversed(c)] for p in primes]
        assert whitening.modular_polynomials(m, primes).tolist() == want


def test_roots_are_counted_and_isolated():
    poly = polynomial([9, 9, 4, 1, 0, -3])
    assert [whitening.roots_beyond(poly, a, 0) for a in (-4, 0, 1, 3, 8, 9)] == [6, 4, 3, 3, 2, 0]
    for k, root in ((1, 9), (2, 9), (3, 4), (4, 1)):
        a, bits = whitening.isolate(poly, k)
        assert Fraction(a, 1 << bits) < root <= Fraction(a + 1, 1 << bits)
    assert whitening.isolate(poly, 5) is None
    a, bits = whitening.isolate([1, -6, 1], 2)  # 3 - sqrt(8), below 1
    assert abs(float(Fraction(a, 1 << bits)) - (3 - math.sqrt(8))) < 1e-15


def whitened_brute(rows, count=8):
    """{id: (deviation, whitened by component)} and the shares; numpy's own
    eigenvectors of the exact covariance."""
    sound = [(i, v) for i, v in rows if v is not None and len(v) and all(c is not None and math.isfinite(c) for c in v)]
    x = np.array([[math.floor(1024 * c) + 100000 for c in v] for _, v in sound], object)
    n, s = len(x), x.sum(axis=0)
    c = n * x - s
    deviation = (c * c).sum(axis=1)
    y = c.astype(float) / n
    v = y.T @ y / n
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    z = y @ u[:, :count] / np.sqrt(np.maximum(e[:count], 1e-300))
    return {i: (int(d), r) for (i, _), d, r in zip(sound, deviation, z)}, e / e.sum(), n


def odd_vectors(d=12, n=300):
    r = np.random.default_rng(4)
    base = r.normal(size=(n, d)) * np.linspace(3, 0.4, d)
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(base)]
    rows += [(500, None), (501, []), (502, [None] * d), (503, [float("nan")] * d), (504, rows[1][1][:-1] + [float("inf")]), (505, rows[7][1]), (None, rows[8][1])]
    return rows


def test_whitens_like_numpy(spark):
    rows = odd_vectors()
    df = spark.createDataFrame([(i, v, "kept", 1) for i, v in rows], "vec_id long, embedding array<float>, N string, c int").repartition(5)
    got = whitening.whiten(df).collect()
    want, shares, n = whitened_brute(rows)
    assert len(got) == 8 * len(want)
    sign = {}
    for r in got:
        deviation, z = want[r.vec_id]
        k = r.component - 1
        assert (r.n, int(r.deviation), r.c) == (n, deviation, 1)
        if abs(z[k]) > 0.1:
            assert sign.setdefault(k, math.copysign(1, r.whitened * z[k])) == math.copysign(1, r.whitened * z[k])
        assert abs(abs(r.whitened) - abs(z[k])) < 1e-9
        assert abs(r.explained / shares[k] - 1) < 1e-9 and r.identity_error < 1e-10


def test_whitens_degenerate_tables(spark):
    schema = "vec_id long, embedding array<double>"
    whiten = lambda rows: whitening.whiten(spark.createDataFrame(rows, schema)).collect()
    assert whiten([]) == whiten([(1, [1.0, 2.0])]) == whiten([(1, [1.0, 2.0]), (2, [1.0, 2.0])]) == whiten([(1, None)]) == []
    # two equal eigenvalues and a dimension without spread
    square = [(i, [x, y, 5.0]) for i, (x, y) in enumerate([(1.0, 1.0), (-1.0, 1.0), (1.0, -1.0), (-1.0, -1.0)])]
    got = whiten(square)
    assert len(got) == 8 and {r.component for r in got} == {1, 2} and got[0].identity_error < 1e-12
    assert all(abs(r.explained - 0.5) < 1e-12 for r in got)
    # other lengths go, huge and tiny entries stay exact
    wide = [(i, [float(i) * 1e300]) for i in range(4)] + [(9, [1.0, 2.0])]
    got = whiten(wide)
    assert {r.vec_id for r in got} == {0, 1, 2, 3} and got[0].identity_error < 1e-9 and got[0].deviation is None


def test_exact_sums_in_limbs():
    for v in (0, 1, -1, 5, -5, 1 << 40, -(1 << 40), (1 << 200) - 3, -(1 << 199) + 7):
        assert sum(x << (whitening.LIMB * i) for i, x in enumerate(whitening._limbs(v))) == v
