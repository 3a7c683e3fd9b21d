"""Embedding whitening by the exact characteristic polynomial.

Entries become integers, so the centred scatter matrix is known exactly. Its
characteristic polynomial is worked out modulo many primes, one Hessenberg
reduction each, and put together by the Chinese remainder theorem. All its
roots are real, so the sign changes of its coefficients after a shift count the
roots beyond a point exactly; bisection by that count isolates the largest
roots. Inverse iteration in fixed-point integers then finds their null spaces.
Sums, primes, roots and rows are all worked on by Spark tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codeloom.llm.common import Sealed, staged

#: What an entry c becomes: floor(SCALE * c) + SHIFT.
SCALE, SHIFT = 1024, 100_000
COMPONENTS = 8
#: Bits of a limb in which exact sums leave the tasks.
LIMB = 40
#: Primes that one task reduces at once.
PRIMES = 16
#: Relative width to which roots are isolated, and bits of the fixed point.
ROOT_BITS, POINT_BITS = 140, 256


# ---- rows as integer vectors ------------------------------------------------------


def _vectors(column: pa.Array) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """By length: (rows, entries floor(SCALE c)) of the usable vectors.

    Entries are int64 where they fit, else Python integers.
    """
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.list_(pa.float64()))
    offsets = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)
    sound = np.concatenate(([0], np.cumsum(~np.isfinite(flat))))  # a null is NaN here
    size = np.diff(offsets)
    usable = column.is_valid().to_numpy(zero_copy_only=False) & (sound[offsets[1:]] == sound[offsets[:-1]]) & (size > 0)
    out = {}
    for length in np.unique(size[usable]).tolist():
        rows = np.flatnonzero(usable & (size == length))
        c = flat[offsets[rows][:, None] + np.arange(length)]
        scaled = np.floor(c * float(SCALE))
        if not np.isfinite(scaled).all():  # exact even where the product leaves the doubles
            y = np.array([[int(Fraction(v) * SCALE // 1) for v in r] for r in c.tolist()], object)
        elif len(scaled) and np.abs(scaled).max() >= 2.0**62:
            y = np.array([[int(v) for v in r] for r in scaled.tolist()], object)
        else:
            y = scaled.astype(np.int64)
        out[length] = rows, y
    return out


def _exact_product(y: np.ndarray) -> np.ndarray:
    """y' y as Python integers."""
    if y.dtype != object:
        most = float(np.abs(y).max(initial=0))
        if most * most * max(len(y), 1) < 2.0**52:
            return (y.T.astype(np.float64) @ y.astype(np.float64)).astype(np.int64).astype(object)
    y = y.astype(object)
    return y.T @ y if len(y) else np.zeros((y.shape[1], y.shape[1]), object)


def _limbs(v: int) -> list[int]:
    out = []
    while v not in (0, -1):
        out.append(v & ((1 << LIMB) - 1))
        v >>= LIMB
    return [*out, v] if v or not out else out


def scatter(df: DataFrame, vector: str) -> tuple[int, list[int], list[list[int]]]:
    """(n, sums, products) over the vectors of the most frequent length (the
    longest of equally frequent ones), as exact integers of floor(SCALE c).

    Each task adds up its rows; what leaves it does not grow with them, and
    what reaches the driver grows with the square of the length only.
    """

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for length, (rows, y) in _vectors(batch.column(0)).items():
                n, s, m = held.get(length) or (0, 0, 0)
                held[length] = [n + len(rows), s + y.astype(object).sum(axis=0), m + _exact_product(y)]
        out = []
        for length, (n, s, m) in held.items():
            out.append((length, -1, -1, 0, n))
            for i in range(length):
                out += [(length, -1, i, k, v) for k, v in enumerate(_limbs(int(s[i])))]
                for j in range(i, length):
                    out += [(length, i, j, k, v) for k, v in enumerate(_limbs(int(m[i, j])))]
        columns = list(zip(*out)) or [()] * 5
        kinds = [pa.int32()] * 4 + [pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["d", "i", "j", "k", "v"])

    parts = df.select(vector).mapInArrow(add, "d int, i int, j int, k int, v long")
    sums = staged(parts.groupBy("d", "i", "j", "k").agg(F.sum("v").alias("v")), "scatter")
    top = sums.where("i = -1 AND j = -1").orderBy(F.desc("v"), F.desc("d")).first()
    if top is None:
        return 0, [], []
    d, n = top.d, top.v
    s, m = [0] * d, [[0] * d for _ in range(d)]
    for r in sums.where((F.col("d") == d) & (F.col("j") >= 0)).toLocalIterator():
        if r.i < 0:
            s[r.j] += r.v << (LIMB * r.k)
        else:
            m[r.i][r.j] += r.v << (LIMB * r.k)
            if r.i != r.j:
                m[r.j][r.i] += r.v << (LIMB * r.k)
    return n, s, m


# ---- the characteristic polynomial ---------------------------------------------------


def primes_below(top: int, count: int) -> list[int]:
    """The ``count`` largest primes below ``top`` (Miller-Rabin with bases that
    decide all numbers below 2**32)."""

    def prime(q: int) -> bool:
        if any(q % p == 0 for p in (3, 5, 7, 11, 13)):
            return q in (3, 5, 7, 11, 13)
        d, r = q - 1, 0
        while d % 2 == 0:
            d, r = d // 2, r + 1
        for a in (2, 7, 61):
            x = pow(a, d, q)
            if x in (0, 1, q - 1):
                continue
            for _ in range(r - 1):
                x = x * x % q
                if x == q - 1:
                    break
            else:
                return False
        return True

    out, q = [], top - 1 if top % 2 == 0 else top - 2
    while len(out) < count:
        if prime(q):
            out.append(q)
        q -= 2
    return out


def _power(x: np.ndarray, e: np.ndarray, p: np.ndarray) -> np.ndarray:
    out, x, e = np.ones_like(x), x % p, e.copy()
    while e.any():
        out = np.where(e & 1, out * x % p, out)
        x, e = x * x % p, e >> 1
    return out


def modular_polynomials(matrix: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients of det(xI - matrix) modulo each prime (below 2**31), lowest
    first: one row for each prime."""
    p = np.array(primes, np.int64)
    d = len(matrix)
    h = np.stack([np.array([[v % q for v in row] for row in matrix], np.int64) for q in primes])
    every = np.arange(len(p))
    p2, p3 = p[:, None], p[:, None, None]
    for k in range(d - 2):
        below = h[:, k + 1 :, k] != 0
        some = below.any(axis=1)
        pivot = np.where(some, k + 1 + below.argmax(axis=1), k + 1)
        # a similarity: swap rows, then columns
        row = h[every, pivot].copy()
        h[every, pivot] = h[:, k + 1]
        h[:, k + 1] = row
        column = h[every, :, pivot].copy()
        h[every, :, pivot] = h[:, :, k + 1]
        h[:, :, k + 1] = column
        inverse = _power(h[:, k + 1, k], p - 2, p)
        factor = h[:, k + 2 :, k] * inverse[:, None] % p2
        h[:, k + 2 :, :] = (h[:, k + 2 :, :] - factor[:, :, None] * h[:, None, k + 1, :] % p3) % p3
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2 :] * factor[:, None, :] % p3).sum(axis=2)) % p2
    polys = [np.zeros((len(p), d + 1), np.int64) for _ in range(d + 1)]
    polys[0][:, 0] = 1
    for k in range(1, d + 1):
        last = polys[k - 1]
        new = np.zeros_like(last)
        new[:, 1:] = last[:, :-1]
        new = (new - h[:, k - 1, k - 1, None] * last) % p2
        below = np.ones(len(p), np.int64)
        for i in range(k - 1, 0, -1):
            below = below * h[:, i, i - 1] % p
            new = (new - (h[:, i - 1, k - 1] * below % p)[:, None] * polys[i - 1]) % p2
        polys[k] = new
    return polys[d]


def characteristic_polynomial(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Integer coefficients of det(xI - matrix), lowest first.

    Coefficients are at most the elementary sums of the row norms, which
    bounds the number of primes. Each task reduces some primes; the driver
    gets a residue for each prime and coefficient.
    """
    d = len(matrix)
    norms = [math.isqrt(sum(v * v for v in row)) + 1 for row in matrix]
    bound = math.prod(1 + n for n in norms)
    primes, size = [], 0
    while size <= bound.bit_length() + 1:
        want = len(primes) + max(8, (bound.bit_length() + 2 - size) // 30)
        primes = primes_below(1 << 31, want)
        size = sum(math.log2(p) for p in primes)
    context = spark.sparkContext
    held, listed = context.broadcast(matrix), context.broadcast(primes)
    pieces = -(-len(primes) // PRIMES)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for piece in batch.column(0).to_pylist():
                own = listed.value[piece * PRIMES : (piece + 1) * PRIMES]
                found = modular_polynomials(held.value, own).tolist()
                yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    rows = spark.range(0, pieces, 1, pieces).mapInArrow(reduce, "p long, c array<long>").collect()
    total = math.prod(primes)
    out = [0] * (d + 1)
    for r in rows:
        rest = total // r.p
        unit = rest * pow(rest, -1, r.p)
        for i, c in enumerate(r.c):
            out[i] += c * unit
    out = [c % total for c in out]
    return [c - total if 2 * c > total else c for c in out]


# ---- its largest roots ------------------------------------------------------------------


def roots_beyond(poly: list[int], at: int, bits: int) -> int:
    """How many roots, counted with multiplicity, exceed at / 2**bits; exact for
    polynomials with real roots only (the rule of signs after a shift)."""
    d = len(poly) - 1
    c = [v << (bits * (d - i)) for i, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += at * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:]))


def isolate(poly: list[int], k: int) -> tuple[int, int] | None:
    """(a, bits): the k-th largest root lies in (a, a + 1] / 2**bits, narrower
    than 2**-ROOT_BITS of it; None when that root is not positive."""
    if roots_beyond(poly, 0, 0) < k:
        return None
    high = 0
    while roots_beyond(poly, 1 << high, 0) >= k:
        high += 1
    if high:
        low, width, bits = 1 << (high - 1), high - 1, 0
    else:  # the root is in (0, 1]: find the binary place it begins at
        low, width, bits = 1, 0, 1
        while roots_beyond(poly, 1, bits) < k:
            bits += 1
    # the root is in (low, low + 2**width] / 2**bits, and low has `width` more places
    while width:
        width -= 1
        middle = low + (1 << width)
        if roots_beyond(poly, middle, bits) >= k:
            low = middle
    while low.bit_length() < ROOT_BITS:
        low, bits = 2 * low, bits + 1
        if roots_beyond(poly, low + 1, bits) >= k:
            low += 1
    return low, bits


# ---- components ------------------------------------------------------------------------


def _solve(rows: np.ndarray, right: np.ndarray, point: int) -> np.ndarray:
    """Solves a system in fixed point; a vanishing pivot becomes the least step."""
    a = np.concatenate((rows, right), axis=1)
    d = len(rows)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
        if not a[k, k]:
            a[k, k] = 1
        if k + 1 < d:
            factor = (a[k + 1 :, k] << point) // a[k, k]
            a[k + 1 :, k:] -= (factor[:, None] * a[None, k, k:]) >> point
    x = a[:, d:]
    for k in range(d - 1, -1, -1):
        x[k] = (x[k] << point) // a[k, k]
        if k:
            x[:k] -= (a[:k, k, None] * x[None, k]) >> point
    return x


def _orthonormal(x: np.ndarray, point: int) -> np.ndarray:
    """Gram-Schmidt on columns of integers; unit is 2**point."""
    out = []
    for c in range(x.shape[1]):
        v = [int(t) for t in x[:, c]]
        for _ in range(2):
            down = max(0, max(abs(t) for t in v).bit_length() - point)
            v = [t >> down for t in v]
            for u in out:
                dot = sum(a * b for a, b in zip(u, v)) >> point
                v = [b - (dot * a >> point) for a, b in zip(u, v)]
        length = math.isqrt(sum(t * t for t in v)) or 1
        out.append([(t << point) // length for t in v])
    return np.array(out, object).T


def null_space(matrix: list[list[int]], root: tuple[int, int], many: int) -> np.ndarray:
    """``many`` orthonormal columns (doubles) for the eigenvalues next to the
    root, by inverse iteration in fixed point."""
    d, point = len(matrix), POINT_BITS
    scale = max(abs(v) for row in matrix for v in row).bit_length()
    a = np.array([[(v << point) >> scale for v in row] for row in matrix], object)
    shift = (((2 * root[0] + 1) << point) >> (root[1] + 1)) >> scale
    a[np.arange(d), np.arange(d)] -= shift
    start = [[((i * 2654435761 + c * 40503 + 12345) % 65521 - 32760) << (point - 16) for c in range(many)] for i in range(d)]
    x = _orthonormal(np.array(start, object), point)
    for _ in range(4):
        x = _orthonormal(_solve(a.copy(), x.copy(), point), point)
    out = x.astype(object)
    return np.array([[float(Fraction(int(v), 1 << point)) for v in row] for row in out])


def components(spark: SparkSession, matrix: list[list[int]], count: int) -> list[tuple[Fraction, list[float]]]:
    """(root, unit vector) of the largest positive roots, largest first.

    Roots are isolated by one task each; roots that cannot be told apart share
    one null space. The entry of the largest size of a vector is positive.
    """
    poly = characteristic_polynomial(spark, matrix)
    count = min(count, len(matrix))
    context = spark.sparkContext
    held, coefficients = context.broadcast(matrix), context.broadcast(poly)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in batch.column(0).to_pylist():
                found = isolate(coefficients.value, k)
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([k], pa.int64()), pa.array([str(found[0])]), pa.array([found[1]], pa.int64())], names=["k", "a", "bits"])

    found = spark.range(1, count + 1, 1, count).mapInArrow(find, "k long, a string, bits long").collect()
    roots = [(int(r.a), r.bits) for r in sorted(found, key=lambda r: r.k)]
    groups: list[tuple[tuple[int, int], int]] = []
    for root in roots:
        if groups and _close(groups[-1][0], root):
            groups[-1] = groups[-1][0], groups[-1][1] + 1
        else:
            groups.append((root, 1))

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for g in batch.column(0).to_pylist():
                vectors = null_space(held.value, *groups[g]).T.tolist()
                yield pa.RecordBatch.from_arrays([pa.array([g] * len(vectors), pa.int64()), pa.array(vectors, pa.list_(pa.float64()))], names=["g", "v"])

    if not groups:
        return []
    solved = spark.range(0, len(groups), 1, len(groups)).mapInArrow(solve, "g long, v array<double>").collect()
    vectors = [list(r.v) for r in sorted(solved, key=lambda r: r.g)]
    signed = [[-t for t in v] if max(v, key=abs) < 0 else v for v in vectors]
    return [(Fraction(2 * a + 1, 1 << (bits + 1)), v) for (a, bits), v in zip(roots, signed)]


def _close(one: tuple[int, int], other: tuple[int, int]) -> bool:
    """Nearer than 2**-60 of their size: one space to double precision."""
    a, b = Fraction(one[0], 1 << one[1]), Fraction(other[0], 1 << other[1])
    return abs(a - b) * (1 << 60) <= a


def _root(e: Fraction) -> float:
    """Square root; squares may lie outside the doubles."""
    return float(Fraction(math.isqrt((e.numerator << 400) // e.denominator), 1 << 200))


# ---- the operator ------------------------------------------------------------------------


def whiten(df: DataFrame, *, vector: str = "embedding", count: int = COMPONENTS) -> DataFrame:
    """One row for each usable input row and component: ``component`` (from 1, by
    falling eigenvalue), ``n``, ``deviation`` (decimal, exact; null beyond 38
    digits), ``whitened``, ``explained``, ``identity_error``; other columns stay
    (those of these names are replaced), the vector is left out.

    An entry c becomes the integer floor(1024 c) + 100000. Rows whose vector is
    null, empty or holds a null or non-finite entry are left out, and so are
    those of another length than most have. Covariances are over all other
    rows, divisor n. Only components with an eigenvalue above 0 exist: there
    are fewer than ``count`` when the vectors span fewer dimensions, and none
    (so no rows) for an empty table, a single row or equal rows. Equal
    eigenvalues share their space; any basis of it is right. Repeated rows count
    and stay.

    The table is read three times: for the exact sums, for the covariance of
    the result, and for the rows. Nothing but sums is shuffled.
    """
    spark = df.sparkSession
    made = ["component", "n", "deviation", "whitened", "explained", "identity_error"]
    own = Sealed(df, made, drop=(vector,))
    table = own.table.select(*own.columns, F.col(own.name(vector)).cast("array<double>").alias("__v"))
    n, sums, products = scatter(table, "__v")
    d = len(sums)
    # n**2 times the covariance; a shift of all entries leaves it as it is
    matrix = [[n * products[i][j] - sums[i] * sums[j] for j in range(d)] for i in range(d)]
    trace = sum(matrix[i][i] for i in range(d))
    found = components(spark, matrix, count) if trace else []
    basis = np.array([v for _, v in found]).reshape(len(found), d)
    roots = np.array([_root(e) / n for e, _ in found])
    explained = [float(e / trace) for e, _ in found]
    state = spark.sparkContext.broadcast((n, d, sums, basis, roots))

    def centred(y: np.ndarray, n: int, sums: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """(n x - S as doubles, exact sums of its squares)."""
        s = np.array(sums, object)
        most = float(max(abs(y.max(initial=0)), abs(y.min(initial=0)))) * n + float(max(map(abs, sums)))
        if most * most * len(sums) < 2.0**62:
            c = y * n - s.astype(np.int64)
            return c.astype(np.float64), (c * c).sum(axis=1)
        c = y.astype(object) * n - s
        return c.astype(np.float64), (c * c).sum(axis=1)

    def whitened(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        n, d, sums, basis, roots = state.value
        held = _vectors(column).get(d)
        if held is None:
            return None
        rows, y = held
        c, deviation = centred(y, n, sums)
        return rows, deviation, (c / n) @ basis.T / roots

    def covariances(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(found), len(found)))
        for batch in batches:
            held = whitened(batch.column(0))
            if held is not None:
                total += held[2].T @ held[2]
        i, j = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())], names=["i", "j", "v"])

    others = own.columns
    kinds = {f.name: f.dataType.simpleString() for f in table.schema}

    def rows_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        many = len(found)
        for batch in batches:
            held = whitened(batch.column(len(others)))
            if held is None:
                continue
            rows, deviation, z = held
            take = pa.array(np.repeat(rows, many))
            kept = [batch.column(i).take(take) for i in range(len(others))]
            text = pa.array([str(v) for v in deviation.tolist()]).take(pa.array(np.repeat(np.arange(len(rows)), many)))
            component = pa.array(np.tile(np.arange(1, many + 1, dtype=np.int32), len(rows)))
            yield pa.RecordBatch.from_arrays([*kept, component, text, pa.array(z.ravel())], names=[*others, "component", "deviation", "whitened"])

    if not found:
        empty = [F.lit(None).cast(t).alias(c) for c, t in zip(made, ("int", "long", "decimal(38,0)", "double", "double", "double"))]
        return own.restored(own.table.where("false").select(*others, *empty))
    identity = table.select("__v").mapInArrow(covariances, "i long, j long, v double").groupBy("i", "j").agg(F.sum("v").alias("v"))
    error = max(abs(r.v / n - (r.i == r.j)) for r in identity.collect())  # a row for each pair of components
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in others), "component int, deviation string, whitened double"])
    result = table.mapInArrow(rows_of, schema)
    shares = F.element_at(F.array(*map(F.lit, explained)), F.col("component"))
    result = result.withColumns(
        {
            "n": F.lit(n).cast("long"),
            "deviation": F.col("deviation").try_cast("decimal(38,0)"),
            "explained": shares,
            "identity_error": F.lit(float(error)),
        }
    )
    return own.restored(result)
