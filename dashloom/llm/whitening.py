"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter."""

from __future__ import annotations

import math
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import freeze

SCALE = 256
COMPONENTS = 4
DIGITS = 80  # bits of an eigenvalue, and of the entries of its component
_LARGEST = 1 << 30  # primes are below it, so products of residues fit in 64 bits
_LIMB = 1 << 53


# -- integer scatter ------------------------------------------------------------------------


def _product(x: np.ndarray) -> np.ndarray:
    """x.T @ x of whole numbers, exact: in doubles where every sum fits in them, else in Python's."""
    top = int(np.abs(x).max(initial=0))
    if top >= 1 << 26:
        x = x.astype(object)
        return x.T @ x
    rows = max(1, _LIMB // max(1, top * top))
    total = np.zeros((x.shape[1],) * 2, object)
    for at in range(0, len(x), rows):
        part = x[at : at + rows].astype(np.float64)
        total += (part.T @ part).astype(np.int64)
    return total


def _rows(batch: pa.RecordBatch, length: int) -> np.ndarray:
    return batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, length)


def _scatter(length: int):
    """Sums of products and of entries over a task's vectors; row -1 has the sums, column -1 the number."""

    def run(batches):
        n, sums, products = 0, np.zeros(length, object), np.zeros((length, length), object)
        for batch in batches:
            if batch.num_rows:
                x = _rows(batch, length)
                n += len(x)
                sums += x.astype(object).sum(axis=0)
                products += _product(x)
        if n:
            i, j = np.triu_indices(length)
            out_i, out_j = np.r_[i, np.full(length + 1, -1)], np.r_[j, np.arange(-1, length)]
            value = [*(str(v) for v in products[i, j]), str(n), *(str(v) for v in sums)]
            yield pa.RecordBatch.from_arrays([pa.array(out_i, pa.int32()), pa.array(out_j, pa.int32()), pa.array(value)], names=["i", "j", "v"])
    return run


def integer_scatter(fit: DataFrame, length: int) -> tuple[int, list[int], list[list[int]]]:
    """n, the sums S and n * sum(x x') - S S' (n squared times the covariance) of vectors `x`, exact."""
    parts = fit.mapInArrow(_scatter(length), "i int, j int, v string")
    total = parts.groupBy("i", "j").agg(F.sum(F.col("v").cast("decimal(38,0)")).cast("string").alias("v"))
    found = {(r["i"], r["j"]): int(r["v"]) for r in total.collect()}  # half the square of the length
    n, sums = found[-1, -1], [found[-1, j] for j in range(length)]
    return n, sums, [[n * found[min(i, j), max(i, j)] - sums[i] * sums[j] for j in range(length)] for i in range(length)]


# -- characteristic polynomial ----------------------------------------------------------------


def _is_prime(n: int) -> bool:
    d, s = n - 1, 0
    while d % 2 == 0:
        d, s = d // 2, s + 1
    for a in (2, 3, 5, 7):  # enough below 3,215,031,751
        if n % a == 0:
            return n == a
        x = pow(a, d, n)
        if x not in (1, n - 1) and not any((x := x * x % n) == n - 1 for _ in range(s - 1)):
            return False
    return True


def primes_for(bits: int) -> list[int]:
    """Primes whose product has more than `bits` bits, from the largest below the limit down."""
    found, have, p = [], 0.0, _LARGEST - 1
    while have <= bits:
        if _is_prime(p):
            found.append(p)
            have += math.log2(p)
        p -= 2
    return found


def characteristic_mod(matrix: np.ndarray, p: int) -> list[int]:
    """Coefficients modulo the prime p of det(t - matrix), from the constant one up.

    Similar row and column operations bring the matrix to Hessenberg form; the polynomials of
    its leading blocks then follow from each other.
    """
    h, d = matrix.copy(), len(matrix)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        if (pivot := k + int(below[0])) != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k]) % p
        # (column k) + sum of factors times columns: reduced product by product, as a sum could overflow
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factors % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for m in range(1, d + 1):
        new = np.zeros(d + 1, np.int64)
        new[1:] = polys[m - 1, :-1]
        new = (new - h[m - 1, m - 1] * polys[m - 1]) % p
        run = 1
        for i in range(1, m):
            run = run * int(h[m - i, m - i - 1]) % p
            if not run:
                break
            new = (new - run * int(h[m - i - 1, m - 1]) % p * polys[m - i - 1]) % p
        polys[m] = new
    return [int(c) for c in polys[d]]


def _bits(matrix: list[list[int]]) -> int:
    """Bits that hold every coefficient: those of a matrix without negative eigenvalues are
    at most the binomial number times a power of the mean eigenvalue."""
    d, trace = len(matrix), sum(matrix[i][i] for i in range(len(matrix)))
    most = max((math.log2(math.comb(d, k)) + k * (math.log2(max(trace, 1)) - math.log2(d)) for k in range(d + 1)), default=0)
    return math.ceil(most) + 8


def _residues(matrix: list[list[int]]):
    def run(batches):
        for batch in batches:
            for p in batch.column("p").to_pylist():
                reduced = np.array([[v % p for v in row] for row in matrix], np.int64).reshape(len(matrix), len(matrix))
                yield pa.RecordBatch.from_arrays([pa.array([p]), pa.array([characteristic_mod(reduced, p)], pa.list_(pa.int64()))], names=["p", "c"])
    return run


def characteristic(spark: SparkSession, matrix: list[list[int]]) -> list[int]:
    """Coefficients of det(t - matrix), whole numbers, from the constant one up.

    One task for each few primes; the remainders are put together on the driver: one number a prime
    for each coefficient.
    """
    primes = primes_for(_bits(matrix) + 1)
    tasks = min(len(primes), 4 * spark.sparkContext.defaultParallelism)
    # Dealt by place, not by a key: every task gets as many primes, whatever their hashes.
    listed = spark.createDataFrame([(p,) for p in primes], "p long").repartition(tasks)
    found = {r["p"]: r["c"] for r in listed.mapInArrow(_residues(matrix), "p long, c array<long>").collect()}
    whole = math.prod(primes)
    bases = [(p, whole // p) for p in primes]
    bases = [(p, rest * pow(rest, -1, p)) for p, rest in bases]
    out = []
    for k in range(len(matrix) + 1):
        c = sum(found[p][k] * base for p, base in bases) % whole
        out.append(c - whole if 2 * c > whole else c)
    return out


# -- roots and components ---------------------------------------------------------------------


def _above(poly: list[int], at: int) -> int:
    """How many roots are greater than `at`, counted as often as they occur.

    All roots are real, so the changes of sign among the coefficients of poly(t + at) are exact.
    """
    c = list(poly)
    for i in range(len(c) - 1):
        for k in range(len(c) - 2, i - 1, -1):
            c[k] += at * c[k + 1]
    signs = [v > 0 for v in c if v]
    return sum(a != b for a, b in zip(signs, signs[1:], strict=False))


def _value(poly: list[int], at: int) -> int:
    total = 0
    for c in reversed(poly):
        total = total * at + c
    return total


def largest_roots(poly: list[int], how_many: int) -> list[Fraction]:
    """The positive roots from the largest down, `how_many` at most, each to DIGITS bits.

    Repeated roots come as often as they occur; equal roots are exactly equal. The polynomial
    is scaled so that roots become whole numbers to be found by halving: by counting roots
    until one is alone, then by its sign.
    """
    d = len(poly) - 1
    positive = d - next(i for i, c in enumerate(poly) if c)  # trailing zeros are roots at zero
    wanted = min(how_many, positive)
    if not wanted:
        return []
    size = max(1, -poly[d - 1]).bit_length()  # no root is above the trace
    # A root may be far smaller than the trace: as many bits more as the smallest wanted may need.
    shift, found = DIGITS, []
    while True:
        scaled = [c << shift * (d - k) for k, c in enumerate(poly)]
        if size + shift > 4096 or _above(scaled, 1 << DIGITS) >= wanted:
            break
        shift *= 2
    for k in range(1, wanted + 1):
        low, high = 0, 1 << (size + shift)  # more than k - 1 roots are above low, fewer than k above high
        if found and found[-1][1] >= k:
            found.append(found[-1])
            continue
        at_low, at_high = positive, 0
        while high - low > max(1, high >> DIGITS):
            middle = (low + high) // 2
            if at_low - at_high == 1:
                # One root in (low, high]: the sign tells on which side; above all roots poly is positive.
                sign = _value(scaled, middle)
                above = at_high + (0 if sign == 0 else int((sign < 0) == (at_high % 2 == 0)))
            else:
                above = _above(scaled, middle)
            if above >= k:
                low, at_low = middle, above
            else:
                high, at_high = middle, above
        found.append((Fraction(low + high, 2 << shift), at_low))
    return [root for root, _ in found]


def components_of(matrix: list[list[int]], roots: list[Fraction]) -> list[list[Fraction]]:
    """A unit vector for each root, by inverse iteration, equal or close roots orthogonal.

    Solved in doubles with the shifted matrix; each solution is corrected by a remainder
    that is worked out in whole numbers, so that near roots do not cost digits.
    """
    if not roots:
        return []
    d, unit = len(matrix), 1 << DIGITS
    top = roots[0]
    m = np.array([[float(Fraction(v) / top) for v in row] for row in matrix]).reshape(d, d)
    exact = np.array(matrix, object).reshape(d, d)
    rng = np.random.default_rng(7)
    done: list[np.ndarray] = []
    for root in roots:
        shifted = m - np.eye(d) * float(root / top)
        u, s, vt = np.linalg.svd(shifted)
        floor = np.where(s > 1e-13, s, 1e-13)  # its null space has no inverse: a step there is large, not endless
        v = [int(x * unit) for x in rng.standard_normal(d)]
        for _ in range(12):
            # One step of inverse iteration, then Gram-Schmidt against the components before.
            start = np.array([float(Fraction(x, unit)) for x in v])
            w = vt.T @ ((u.T @ start) / floor)
            w = _orthogonal([Fraction(x) for x in w], done)
            new = _unit(w, unit)
            change = min(max(abs(a - b) for a, b in zip(new, v, strict=True)), max(abs(a + b) for a, b in zip(new, v, strict=True)))
            v = new
            if change < unit >> 48:
                break
        for _ in range(4):
            # Remainder (matrix - root) v in whole numbers, solved away outside the null space.
            x = np.array(v, object)
            remainder = exact @ x - np.array([int(root * a) for a in v], object)
            r = np.array([float(Fraction(int(a), unit) / top) for a in remainder])
            inverse = np.where(s > 1e-12, 1 / floor, 0.0)
            if (s <= 1e-12).sum() == 0:
                inverse[-1] = 0.0
            fix = vt.T @ (inverse * (u.T @ r))
            v = _unit(_orthogonal([Fraction(a, unit) - Fraction(b) for a, b in zip(v, fix, strict=True)], done), unit)
        done.append(np.array(v, object))
    out = []
    for v in done:
        first = max(range(d), key=lambda i: (abs(v[i]), -i))
        out.append([Fraction(int(x) if v[first] > 0 else -int(x), unit) for x in v])
    return out


def _orthogonal(w: list[Fraction], done: list[np.ndarray]) -> list[Fraction]:
    unit = 1 << DIGITS
    whole = np.array([int(x * unit) for x in w], object)
    for u in done:
        whole = whole - u * (int(u @ whole) >> DIGITS) // unit
    return [Fraction(int(x), unit) for x in whole]


def _unit(w: list[Fraction], unit: int) -> list[int]:
    whole = [int(x * unit) for x in w]
    most = max(abs(x) for x in whole) or 1
    whole = [x * unit // most for x in whole]
    length = math.isqrt(sum(x * x for x in whole))
    return [x * unit // length for x in whole]


# -- model ------------------------------------------------------------------------------------


@dataclass
class Whitening:
    """What `whiten` needs for vectors of one length: sums, number and scaled components."""

    n: int
    sums: list[int]
    axes: np.ndarray  # a column for each component, over the root of its eigenvalue
    explained: list[float]

    def rows(self, x: np.ndarray) -> tuple[list[int], np.ndarray]:
        """deviation and whitened values of vectors."""
        top = max(int(np.abs(x).max(initial=0)) * self.n, max(map(abs, self.sums), default=0)) * 2
        kind = np.int64 if top * top * max(1, x.shape[1]) < 1 << 62 else object
        apart = x.astype(kind) * kind(self.n) - np.array(self.sums, kind) if kind is np.int64 else x.astype(object) * self.n - np.array(self.sums, object)
        return (apart * apart).sum(axis=1).tolist(), (apart / self.n).astype(np.float64) @ self.axes


def fit(vectors: DataFrame, length: int, how_many: int = COMPONENTS) -> Whitening:
    """The whitening of distinct whole-number vectors `x` of one length."""
    n, sums, matrix = integer_scatter(vectors, length)
    poly = characteristic(vectors.sparkSession, matrix)
    roots = largest_roots(poly, how_many)  # of n squared times the covariance
    axes = components_of(matrix, roots)
    trace = sum(matrix[i][i] for i in range(length))
    scaled = [[float(a) / math.sqrt(root / (n * n)) for a in axis] for axis, root in zip(axes, roots, strict=True)]
    return Whitening(n, sums, np.array(scaled, np.float64).reshape(len(roots), length).T, [float(r / trace) for r in roots])


def _values(model, length: int):
    def run(batches):
        own: Whitening = model.value
        for batch in batches:
            if batch.num_rows:
                _, y = own.rows(_rows(batch, length))
                yield pa.RecordBatch.from_arrays([pa.array(y[:, k]) for k in range(y.shape[1])], names=[f"y{k}" for k in range(y.shape[1])])
    return run


def _identity_error(vectors: DataFrame, model, length: int) -> float:
    """Largest absolute entry of the whitened vectors' covariance minus the identity."""
    k = model.value.axes.shape[1]
    y = vectors.mapInArrow(_values(model, length), ", ".join(f"y{i} double" for i in range(k)))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    row = y.agg(*(F.covar_pop(f"y{i}", f"y{j}").alias(f"c{i}_{j}") for i, j in pairs)).first()
    return max(abs(row[f"c{i}_{j}"] - (i == j)) for i, j in pairs)


_OUT = "component int, n long, deviation long, whitened double, explained double, identity_error double"


def _whiten(model, length: int, error: float):
    def run(batches):
        own: Whitening = model.value
        k = len(own.explained)
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                deviation, y = own.rows(_rows(part, length))
                rows, each = part.num_rows, np.arange(part.num_rows).repeat(k)
                yield pa.RecordBatch.from_arrays(
                    [part.column("vec_id").take(pa.array(each)), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), rows)),
                     pa.array(np.full(rows * k, own.n)), pa.array([deviation[i] for i in each], pa.int64()), pa.array(y.ravel()),
                     pa.array(np.tile(own.explained, rows)), pa.array(np.full(rows * k, error))],
                    names=["vec_id", *(c.split()[0] for c in _OUT.split(", "))])
    return run


def whiten(vectors: DataFrame, how_many: int = COMPONENTS) -> DataFrame:
    """The first principal components of each vector, scaled to covariance one.

    `vectors` needs (vec_id, embedding); other columns are ignored. Rows whose vector is null or
    empty or holds null or non-finite entries are left out. An entry c becomes the whole number
    floor(256 * c); each distinct whole vector is fitted once. Vectors of each length have a
    fit of their own. Entries beyond 2^54 in size end the query with an overflow error.

    Returns, for each remaining row and component: vec_id, component (from 1, by falling
    eigenvalue), n (vectors fitted), deviation (sum of (n * x - S)^2, exact; a value beyond 64 bits
    ends the query), whitened, explained (share of the variance) and identity_error. Components of eigenvalue zero are left out, so a table
    of one distinct vector gives no rows, as does an empty one. Repeated rows have equal values;
    a null vec_id keeps its row. The largest entry of a component is positive.

    The scatter is summed in whole numbers by the tasks that hold the distinct vectors; its
    characteristic polynomial is worked out modulo primes, a task for a few of them. To the
    driver come half the square of a vector's length and a number for each prime and coefficient.
    """
    spark, v = vectors.sparkSession, F.col("embedding")
    sound = (F.size(v) > 0) & F.forall(v, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(math.inf)))
    whole = F.transform(v, lambda c: F.floor(c * SCALE).cast("long"))
    rows = vectors.select("vec_id", v.cast("array<double>").alias("embedding")).where(F.coalesce(sound, F.lit(False)))
    rows = rows.select("vec_id", whole.alias("x"))
    distinct = freeze(rows.select("x").distinct(), "distinct")
    lengths = sorted(r[0] for r in distinct.select(F.size("x")).distinct().collect())  # a row for each length
    kind = vectors.schema["vec_id"].dataType.simpleString()
    out = None
    for length in lengths:
        own = distinct.where(F.size("x") == length)
        model = spark.sparkContext.broadcast(fit(own, length, how_many))
        if not model.value.explained:
            continue
        error = _identity_error(own, model, length)
        found = rows.where(F.size("x") == length).mapInArrow(_whiten(model, length, error), f"vec_id {kind}, {_OUT}")
        out = found if out is None else out.union(found)
    return spark.createDataFrame([], f"vec_id {kind}, {_OUT}") if out is None else out
