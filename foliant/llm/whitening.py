"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter matrix.

Entries become integers, so the scatter n * sum(x x') - S S' of the distinct vectors is exact, whatever the order of summation.
Its characteristic polynomial is computed modulo many primes (Hessenberg reduction, one row of a Spark job for each
prime) and put together by Chinese remainders. All its roots are real, so sign variations of the shifted polynomial count
the roots above a point exactly: bisection isolates the largest ones, also multiple ones, to 120 bits. Components span the null space of
scatter minus root, found by inverse iteration in fixed-point arithmetic, one row for each root.

The driver holds numbers by the dimension only (its square), never rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliant.llm.common import drop_scratch, scratch

#: Cells of one unit of an entry, and what is added to a cell's number.
CELLS, SHIFT = 64, 1_000_000
#: Cells beyond count as this far out.
FARTHEST = 1 << 60
#: Bits to which roots are known, and of fixed-point numbers in inverse iteration.
ROOT_BITS, FIXED_BITS = 120, 400
#: Numbers above 62 bits travel as four limbs.
LIMB = 40


@dataclass
class Whitening:
    """n: distinct vectors. sums: of their cells in each dimension. vectors: unit columns, first the one of the largest variance."""

    n: int
    sums: list[int]
    variances: np.ndarray
    explained: np.ndarray
    vectors: np.ndarray
    identity_error: float = 0.0


# ---------------------------------------------------------------- cells


def usable(vector: Column) -> Column:
    """Whether a vector has entries, all of them finite."""
    fine = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf"))))
    return F.coalesce(fine, F.lit(False)) & (F.size(vector) > 0)


def cells(vector: Column) -> Column:
    """Cell of each entry, without the shift, which neither scatter nor deviation depends on."""
    far = F.lit(FARTHEST)
    return F.transform(vector, lambda c: F.least(F.greatest(F.floor(c.cast("double") * CELLS).cast("long"), -far), far))


def _distinct(vectors: DataFrame, vector: str) -> DataFrame:
    """The distinct cell vectors (x) of the length that most usable vectors have (the longest of several)."""
    held = vectors.select(F.col(f"`{vector}`").alias("v")).where(usable(F.col("v")))
    most = held.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    return held.where(F.size("v") == (most.d if most else -1)).select(cells(F.col("v")).alias("x")).distinct()


# ---------------------------------------------------------------- exact scatter


def gram(x: np.ndarray) -> np.ndarray:
    """x' x of int64 rows as exact Python integers: products of 20-bit limbs, each sum below 2^53."""
    limbs, rest = [], x
    while rest.any():
        low = ((rest + (1 << 19)) & ((1 << 20) - 1)) - (1 << 19)
        limbs.append(low.astype(np.float64))
        rest = (rest - low) >> 20
    out = np.zeros((x.shape[1], x.shape[1]), object)
    for i, a in enumerate(limbs):
        for j, b in enumerate(limbs):
            for k in range(0, len(x), 8192):
                out += (a[k : k + 8192].T @ b[k : k + 8192]).astype(np.int64).astype(object) << (20 * (i + j))
    return out


def _partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Count (i = j = -1), sums (i = -1) and products (i <= j) of a task's rows, in limbs."""
    n, sums, products = 0, None, None
    for batch in rows:
        if batch.num_rows:
            x = batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1)
            s = np.array([sum(c) for c in x.T.tolist()], object)
            n, sums, products = n + len(x), s if sums is None else sums + s, gram(x) if products is None else products + gram(x)
    if not n:
        return
    at = [(-1, -1), *[(-1, j) for j in range(len(sums))], *[(i, j) for i in range(len(sums)) for j in range(i, len(sums))]]
    values = [n, *sums, *[products[i, j] for i, j in at[1 + len(sums) :]]]
    limbs = [[(abs(v) >> LIMB * k & (1 << LIMB) - 1) * (1 if v >= 0 else -1) for v in values] for k in range(4)]
    columns = [pa.array([i for i, _ in at], pa.int32()), pa.array([j for _, j in at], pa.int32()), *[pa.array(x, pa.int64()) for x in limbs]]
    yield pa.RecordBatch.from_arrays(columns, names=["i", "j", "l0", "l1", "l2", "l3"])


def scatter(distinct: DataFrame) -> tuple[int, list[int], np.ndarray]:
    """n, sums and n * sum(x x') - S S' of the distinct cell vectors; an empty table has n = 0."""
    parts = distinct.mapInArrow(_partial, "i int, j int, l0 long, l1 long, l2 long, l3 long")
    summed = parts.groupBy("i", "j").agg(*[F.sum(f"l{k}").alias(f"l{k}") for k in range(4)]).collect()
    found = {(r.i, r.j): sum(r[f"l{k}"] << LIMB * k for k in range(4)) for r in summed}
    if not found:
        return 0, [], np.zeros((0, 0), object)
    n = found[-1, -1]
    d = max(j for _, j in found) + 1
    sums = [found[-1, j] for j in range(d)]
    return n, sums, np.array([[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(d)] for i in range(d)], object)


# ---------------------------------------------------------------- characteristic polynomial


def is_prime(n: int) -> bool:
    """Strong pseudoprime test with bases that leave no composite below 3.4e14."""
    for p in (2, 3, 5, 7, 11, 13, 17):
        if n % p == 0:
            return n == p
    odd = n - 1
    twos = (odd & -odd).bit_length() - 1
    odd >>= twos
    for base in (2, 3, 5, 7, 11, 13, 17):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_for(bound: int) -> list[int]:
    """Primes below 2^31, largest first, until their product is above twice the bound."""
    found, product, n = [], 1, 2**31 - 1
    while product <= 2 * bound:
        if is_prime(n):
            found.append(n)
            product *= n
        n -= 2
    return found


def polynomial_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients of det(t - matrix) modulo p, constant first: to Hessenberg form by similarities, then by its recurrence."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(d - 2):
        below = np.flatnonzero(h[k + 1 :, k])
        if not len(below):
            continue
        pivot, row = k + 1 + int(below[0]), k + 1
        if pivot != row:
            h[[row, pivot]] = h[[pivot, row]]
            h[:, [row, pivot]] = h[:, [pivot, row]]
        u = h[k + 2 :, k] * pow(int(h[row, k]), -1, p) % p
        h[k + 2 :] = (h[k + 2 :] - u[:, None] * h[row] % p) % p
        h[:, row] = (h[:, row] + (h[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        last = polys[k - 1]
        polys[k, 1:] = last[:-1]
        weights, product = [int(h[k - 1, k - 1])], 1
        for i in range(k - 1, 0, -1):
            product = product * int(h[i, i - 1]) % p
            weights.append(int(h[i - 1, k - 1]) * product % p)
        w = np.array(weights[::-1], np.int64)
        polys[k] = (polys[k] - (w[:, None] * polys[:k] % p).sum(axis=0)) % p
    return [int(c) for c in polys[d]]


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Exact coefficients of det(t - matrix), constant first, of a positive semidefinite integer matrix."""
    d, trace = len(matrix), sum(matrix[i, i] for i in range(len(matrix)))
    # The k-th elementary symmetric function of non-negative roots is at most that of equal ones.
    bound = max(math.comb(d, k) * trace**k // d**k + 1 for k in range(d + 1))
    primes = primes_for(bound)
    sent = spark.sparkContext.broadcast(matrix)  # bounded by the dimension

    def reduced(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            own = batch.column(0).to_pylist()
            found = [polynomial_mod(sent.value, p) for p in own]
            yield pa.RecordBatch.from_arrays([pa.array(own, pa.int64()), pa.array(found, pa.list_(pa.int64()))], names=["p", "c"])

    tasks = min(len(primes), spark.sparkContext.defaultParallelism)
    rows = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks).mapInArrow(reduced, "p long, c array<long>").collect()
    modulus = math.prod(primes)
    parts = [(r.c, modulus // r.p * pow(modulus // r.p, -1, r.p)) for r in rows]
    whole = [sum(c[k] * unit for c, unit in parts) % modulus for k in range(d + 1)]
    return [c - modulus if c > modulus // 2 else c for c in whole]


# ---------------------------------------------------------------- roots


def sign_at(poly: list[int], m: int, s: int) -> int:
    """Sign of the polynomial at m / 2^s."""
    value, d = 0, len(poly) - 1
    for i in range(d, -1, -1):
        value = value * m + (poly[i] << s * (d - i))
    return (value > 0) - (value < 0)


def roots_above(poly: list[int], m: int, s: int) -> int:
    """How many roots lie above m / 2^s, if all are real: sign variations of the polynomial shifted there."""
    d = len(poly) - 1
    c = [a << s * (d - i) for i, a in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += m * c[j + 1]
    signs = [x > 0 for x in c if x]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def largest_roots(poly: list[int], wanted: int) -> list[tuple[int, int, int]]:
    """(m, s, times): the largest positive roots m / 2^s of a polynomial with real, non-negative roots, in falling order.

    Roots closer than 120 bits of their size are one root that comes several times; the last one may bring more than wanted.
    """
    zeros = next(i for i, c in enumerate(poly) if c)
    poly = poly[zeros:]
    d = len(poly) - 1
    if not d:
        return []
    top = abs(poly[d - 1]).bit_length()  # the sum of all roots
    found: list[tuple[int, int, int]] = []
    open_ = [(0, 1 << top, 0, d, 0)]  # lo, hi, s, roots above lo, roots above hi
    while open_:
        lo, hi, s, above_lo, above_hi = open_.pop()
        times = above_lo - above_hi
        if not times or above_hi >= wanted:
            continue
        while times == 1 and (not lo or (hi - lo) << ROOT_BITS > lo):
            lo, hi, s = 2 * lo, 2 * hi, s + 1
            middle = (lo + hi) // 2
            sign = sign_at(poly, middle, s)
            if not sign:
                lo = hi = middle
            elif sign == (-1) ** above_hi:
                hi = middle
            else:
                lo = middle
        if times == 1 or lo and (hi - lo) << ROOT_BITS <= lo:
            found.append((lo + hi, s + 1, times))
            continue
        lo, hi, s = 2 * lo, 2 * hi, s + 1
        middle = (lo + hi) // 2
        above = roots_above(poly, middle, s)
        open_ += [(lo, middle, s, above_lo, above), (middle, hi, s, above, above_hi)]
    return found


# ---------------------------------------------------------------- components


def null_vectors(matrix: np.ndarray, m: int, s: int, times: int) -> np.ndarray:
    """Unit vectors (rows) that span the null space of matrix - m / 2^s: inverse iteration in fixed-point numbers of 400 bits."""
    d, one = len(matrix), 1 << FIXED_BITS
    size = sum(int(matrix[i, i]) for i in range(d)).bit_length()
    lower = np.array([[(int(c) << FIXED_BITS) >> size for c in row] for row in matrix], object)
    for i in range(d):
        lower[i, i] -= (m << FIXED_BITS) >> (s + size)
    order = list(range(d))
    for k in range(d):
        pivot = max(range(k, d), key=lambda i: abs(lower[i, k]))
        if pivot != k:
            lower[[k, pivot]] = lower[[pivot, k]]
            order[k], order[pivot] = order[pivot], order[k]
        lower[k, k] = lower[k, k] or 1
        if k + 1 < d:
            factors = (lower[k + 1 :, k] << FIXED_BITS) // lower[k, k]
            lower[k + 1 :, k + 1 :] -= (factors[:, None] * lower[k, k + 1 :][None, :]) >> FIXED_BITS
            lower[k + 1 :, k] = factors

    def solved(v: np.ndarray) -> np.ndarray:
        x = v[order].copy()
        for k in range(1, d):
            x[k] -= int((lower[k, :k] * x[:k]).sum()) >> FIXED_BITS
        for k in range(d - 1, -1, -1):
            rest = x[k] - (int((lower[k, k + 1 :] * x[k + 1 :]).sum()) >> FIXED_BITS if k + 1 < d else 0)
            x[k] = (rest << FIXED_BITS) // lower[k, k]
        return x

    def unit(v: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
        for _ in range(2):
            v = (v << FIXED_BITS) // max(1, max(abs(x) for x in v))
            for o in others:
                v = v - (o * (int((v * o).sum()) >> FIXED_BITS) >> FIXED_BITS)
        return (v << FIXED_BITS) // max(1, math.isqrt(int((v * v).sum())))

    basis: list[np.ndarray] = []
    for k in range(times):
        v = np.array([((i + 1) * 40503 + (k + 1) * 30011 * (i + 7)) % 65537 - 32768 for i in range(d)], object) * (one >> 16)
        for _ in range(3):
            v = unit(solved(v), basis)
        basis.append(v)
    out = np.array([[x / one for x in v] for v in basis])
    at = np.abs(out).argmax(axis=1)
    return out * np.sign(out[np.arange(times), at])[:, None]


def components(spark: SparkSession, matrix: np.ndarray, wanted: int) -> list[tuple[int, int, np.ndarray]]:
    """(m, s, unit vector) of the largest positive eigenvalues m / 2^s, in falling order; the largest entry of a vector is positive."""
    found = largest_roots(characteristic_polynomial(spark, matrix), wanted)
    if not found:
        return []
    sent = spark.sparkContext.broadcast(matrix)  # bounded by the dimension

    def spanned(rows: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in rows:
            for r in batch.itertuples():
                vectors = null_vectors(sent.value, int(r.m), r.s, r.times)
                yield pd.DataFrame({"k": [r.k] * len(vectors), "i": range(len(vectors)), "v": list(vectors)})

    roots = spark.createDataFrame([(k, str(m), s, times) for k, (m, s, times) in enumerate(found)], "k int, m string, s int, times int")
    rows = roots.repartition(len(found), "k").mapInPandas(spanned, "k int, i int, v array<double>").collect()
    return [(found[r.k][0], found[r.k][1], np.array(r.v)) for r in sorted(rows, key=lambda r: (r.k, r.i))][:wanted]


# ---------------------------------------------------------------- fit and apply


def projector(model: Whitening):
    """Cells (int64 rows) -> exact deviations, None where one exceeds a long, and whitened values."""
    weights = model.vectors / np.sqrt(model.variances)
    sums = np.array(model.sums, object)
    farthest = max(map(abs, model.sums), default=0)

    def projected(x: np.ndarray) -> tuple[list[int | None], np.ndarray]:
        reach = model.n * int(np.abs(x).max(initial=0)) + farthest
        if reach * reach * x.shape[1] < 1 << 62:
            away = x * model.n - sums.astype(np.int64)
            deviations = (away * away).sum(axis=1).tolist()
        else:
            away = x.astype(object) * model.n - sums
            deviations = [v if v < 1 << 63 else None for v in (away * away).sum(axis=1)]
        return deviations, (away / model.n).astype(np.float64) @ weights

    return projected


def _identity_error(distinct: DataFrame, model: Whitening) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity, over the distinct vectors."""
    projected, width = projector(model), len(model.variances)

    def partial(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width + 1, width))
        for batch in rows:
            if batch.num_rows:
                w = projected(batch.column(0).flatten().to_numpy().reshape(batch.num_rows, -1))[1]
                total += np.vstack((w.sum(axis=0), w.T @ w))
        yield pa.RecordBatch.from_arrays([pa.array(range(total.size), pa.int32()), pa.array(total.ravel())], names=["k", "v"])

    summed = {r.k: r.v for r in distinct.mapInArrow(partial, "k int, v double").groupBy("k").agg(F.sum("v").alias("v")).collect()}
    found = np.array([summed[k] for k in range((width + 1) * width)]).reshape(width + 1, width) / model.n
    return float(np.abs(found[1:] - np.outer(found[0], found[0]) - np.eye(width)).max())


def fit(vectors: DataFrame, vector: str = "embedding", wanted: int = 16) -> Whitening:
    """The largest components of the distinct usable vectors, in cells of a 64th.

    Vectors that are null, empty, or hold null or non-finite entries are left out, and so are those of another length than most.
    Copies count once. Components without variance aren't whitened: fewer than wanted come back, none from an empty table or
    from equal vectors. Eigenvalues that agree to 120 bits give an orthonormal basis of their space.
    """
    spark = vectors.sparkSession
    distinct = scratch(_distinct(vectors, vector), "distinct-cells")
    n, sums, matrix = scatter(distinct)
    common = math.gcd(*matrix.ravel().tolist()) if n else 0
    if not common:
        return Whitening(n, sums, np.zeros(0), np.zeros(0), np.zeros((len(sums), 0)))
    trace = sum(matrix[i, i] for i in range(len(matrix)))
    found = components(spark, matrix // common, wanted)
    variances = np.array([m * common / ((n * n) << s) for m, s, _ in found])
    explained = np.array([m * common / (trace << s) for m, s, _ in found])
    model = Whitening(n, sums, variances, explained, np.array([v for _, _, v in found]).T)
    model.identity_error = _identity_error(distinct, model)
    drop_scratch(distinct)
    return model


def whiten(vectors: DataFrame, model: Whitening, vector: str = "embedding") -> DataFrame:
    """Adds whitening (deviation, values): exact squared distance from the mean times n^2, and the value of each component.

    Rows whose vector isn't usable, or of another length than the model's, are dropped; null ids and repeated rows stay. A deviation
    beyond a long is null. Other columns pass through; one named whitening is replaced.
    """
    projected, width = projector(model), len(model.sums)

    @F.pandas_udf("deviation long, values array<double>")
    def whitened(x: pd.Series) -> pd.DataFrame:
        if not len(x):
            return pd.DataFrame({"deviation": pd.Series([], dtype="Int64"), "values": []})
        deviations, values = projected(np.stack(x.to_numpy()).astype(np.int64))
        return pd.DataFrame({"deviation": pd.array(deviations, "Int64"), "values": list(values)})

    fitting = vectors.where(usable(F.col(f"`{vector}`")) & (F.size(F.col(f"`{vector}`")) == width))
    return fitting.withColumn("whitening", whitened(cells(F.col(f"`{vector}`"))))
