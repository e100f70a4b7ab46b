"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Entries c become integers x = floor(256 c). Over the fit list (each distinct x once) tasks sum x and x x' exactly;
M = n * sum(x x') - S S' is n squared times the covariance V, without rounding.

* Characteristic polynomial: tasks reduce M modulo primes to Hessenberg form and expand the polynomial there; Chinese
  remaindering joins the residues, with primes enough for a proven bound of the coefficients.
* Roots: M is symmetric, so all roots are real and the sign changes of the shifted polynomial count the roots above a
  point exactly, multiple ones too. Bisection on dyadic numbers isolates the largest and narrows them to 2^-200 of
  their size.
* Components: inverse iteration on the null space of M - root, in decimals of 150 digits. Roots that agree to 2^-200
  count as one; their components are an orthonormal basis of its space.

What reaches the driver is bounded by the vectors' length d (d(d+1)/2 + d + 1 sums, d + 1 residues per prime), never by
rows. Defined cases: rows whose vector is null or holds null or non-finite entries, or has another length than the most
frequent one (ties: the longer), are dropped; a null vec_id stays; repeated rows stay and are one vector of the fit
list; entries beyond the range of longs become the nearest long; a component of eigenvalue 0 is left out, since nothing
can be divided by it, so one distinct vector or an empty table give no rows; columns of other names are left behind.
"""

from __future__ import annotations

from decimal import Decimal, localcontext
from fractions import Fraction
from math import gcd

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skein.llm.common import cut
from skein.llm.vectors import common_length, finite, matrix

#: Sums cross Spark as four numbers of 40 bits, so that long columns add up to 2^23 tasks without overflow.
LIMB = 40
#: Bits to which a root is narrowed, relative to its size, and digits of the inverse iteration.
ROOT_BITS, DIGITS = 200, 150
#: Primes that one task takes together.
PRIMES_PER_TASK = 16


def integers(df: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding") -> tuple[DataFrame, int]:
    """(vec_id, x) of the rows that remain, and the length of x."""
    kept = df.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).alias("v")).where(finite(F.col("v")))
    width = common_length(kept, "v")
    x = F.transform("v", lambda c: F.floor(c.cast("double") * 256))
    return kept.where(F.size("v") == width).select("vec_id", x.alias("x")), width


def _exact(x: np.ndarray) -> np.ndarray:
    """x' x as exact Python integers: floats where all sums stay under 2^53, else Python integers."""
    top = int(max(-int(x.min()), int(x.max()))) if x.size else 0
    if top * top * len(x) < 1 << 53:
        y = x.astype(np.float64)
        return (y.T @ y).astype(np.int64).astype(object)
    y = x.astype(object)
    return y.T @ y


def scatter(fit: DataFrame, width: int) -> tuple[int, list[int], list[list[int]]]:
    """(n, S, n * sum(x x') - S S') over the rows of ``fit`` (x), exact."""
    upper = np.triu_indices(width)

    def partial(batches):
        n, total, square = 0, np.zeros(width, dtype=object), np.zeros((width, width), dtype=object)
        for batch in batches:
            x = matrix(batch.column("x"), width, np.int64)
            n += len(x)
            total += x.astype(object).sum(axis=0) if len(x) else 0
            square += _exact(x)
        values = [n, *total, *square[upper]]
        limbs = [[(int(v) >> (LIMB * k)) & ((1 << LIMB) - 1) if k < 3 else int(v) >> (LIMB * 3) for v in values] for k in range(4)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(values)), pa.int64()), *[pa.array(v, pa.int64()) for v in limbs]], names=["at", "a", "b", "c", "d"])

    rows = fit.select("x").mapInArrow(partial, "at long, a long, b long, c long, d long")
    sums = rows.groupBy("at").agg(*[F.sum(k).alias(k) for k in "abcd"]).collect()
    values = [0] * (1 + width + len(upper[0]))
    for r in sums:
        values[r["at"]] = sum(r[k] << (LIMB * i) for i, k in enumerate("abcd"))
    n, total = values[0], values[1:1 + width]
    out = [[0] * width for _ in range(width)]
    for i, j, v in zip(*upper, values[1 + width:], strict=True):
        out[i][j] = out[j][i] = n * v - total[i] * total[j]
    return n, total, out


# ------------------------------------------------------------------ characteristic polynomial

def _prime(n: int) -> bool:
    """Miller-Rabin with bases that are decisive under 3,215,031,751."""
    if any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x in (1, n - 1):
            continue
        for _ in range(twos - 1):
            x = x * x % n
            if x == n - 1:
                break
        else:
            return False
    return True


def primes_over(bound: int) -> list[int]:
    """Largest primes under 2^31 whose product exceeds ``bound``."""
    out, product, p = [], 1, (1 << 31) - 1
    while product <= bound:
        if _prime(p):
            out.append(p)
            product *= p
        p -= 2
    return out


def hessenberg_polynomials(m: list[list[int]], primes: list[int]) -> np.ndarray:
    """Coefficients (constant first) of det(t - m) modulo each prime; numpy works on all primes at once."""
    d, many = len(m), len(primes)
    p = np.array(primes, dtype=np.int64)
    h = np.array([[[v % q for v in row] for row in m] for q in primes], dtype=np.int64).reshape(many, d, d)
    each, p1, p2 = np.arange(many), p[:, None], p[:, None, None]
    for k in range(d - 2):
        pivot = k + 1 + np.argmax(h[:, k + 1:, k] != 0, axis=1)
        rows = h[each, pivot].copy()
        h[each, pivot], h[:, k + 1] = h[:, k + 1].copy(), rows
        cols = h[each, :, pivot].copy()
        h[each, :, pivot], h[:, :, k + 1] = h[:, :, k + 1].copy(), cols
        inverse = np.array([pow(int(v), -1, int(q)) if v else 0 for v, q in zip(h[:, k + 1, k], p, strict=True)], dtype=np.int64)
        factor = h[:, k + 2:, k] * inverse[:, None] % p1
        h[:, k + 2:] = (h[:, k + 2:] - factor[:, :, None] * h[:, None, k + 1] % p2) % p2
        h[:, :, k + 1] = (h[:, :, k + 1] + (h[:, :, k + 2:] * factor[:, None, :] % p2).sum(axis=2)) % p1
    poly = np.zeros((many, d + 1, d + 1), dtype=np.int64)
    poly[:, 0, 0] = 1
    for k in range(1, d + 1):
        new = np.zeros((many, d + 1), dtype=np.int64)
        new[:, 1:] = poly[:, k - 1, :-1]
        new = (new - h[:, k - 1, k - 1, None] * poly[:, k - 1] % p1) % p1
        below = np.ones(many, dtype=np.int64)
        for i in range(1, k):
            below = below * h[:, k - i, k - i - 1] % p
            new = (new - (h[:, k - i - 1, k - 1] * below % p)[:, None] * poly[:, k - i - 1] % p1) % p1
        poly[:, k] = new
    return poly[:, d]


def characteristic_polynomial(spark: SparkSession, m: list[list[int]]) -> list[int]:
    """Integer coefficients (constant first) of det(t - m) for symmetric positive semidefinite integers m.

    The j-th elementary symmetric function of roots that are not negative is at most C(d, j) (trace / d)^j, so
    (1 + trace / d)^d bounds every coefficient.
    """
    d = len(m)
    trace = sum(m[i][i] for i in range(d))
    primes = primes_over(2 * (1 + -(-trace // d)) ** d)

    def residues(batches):
        for batch in batches:
            own = [int(q) for q in batch.column("prime").to_pylist()]
            for at in range(0, len(own), PRIMES_PER_TASK):
                some = own[at:at + PRIMES_PER_TASK]
                yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array(hessenberg_polynomials(m, some).tolist(), pa.list_(pa.int64()))], names=["prime", "coefficients"])

    asked = spark.createDataFrame([(q,) for q in primes], "prime long").repartition(-(-len(primes) // PRIMES_PER_TASK))
    product, out = 1, [0] * (d + 1)
    for r in asked.mapInArrow(residues, "prime long, coefficients array<long>").collect():
        q = r["prime"]
        inverse = pow(product, -1, q)
        out = [v + product * ((c - v) * inverse % q) for v, c in zip(out, r["coefficients"], strict=True)]
        product *= q
    return [v - product if 2 * v > product else v for v in out]


# ------------------------------------------------------------------ roots

def roots_above(poly: list[int], a: int, s: int) -> int:
    """Roots over a / 2^s, counted with multiplicity; exact for a polynomial whose roots are all real."""
    d = len(poly) - 1
    c = [v << (s * (d - j)) for j, v in enumerate(poly)]
    for i in range(d):
        for j in range(d - 1, i - 1, -1):
            c[j] += a * c[j + 1]
    signs = [v > 0 for v in c if v]
    return sum(x != y for x, y in zip(signs, signs[1:], strict=False))


def _sign(poly: list[int], a: int, s: int) -> int:
    """Sign of the polynomial at a / 2^s."""
    d, total = len(poly) - 1, 0
    for j in range(d, -1, -1):
        total = total * a + (poly[j] << (s * (d - j)))
    return (total > 0) - (total < 0)


def largest_roots(poly: list[int], bound: int, most: int) -> list[tuple[Fraction, int]]:
    """(root, multiplicity) of the largest positive roots, falling, until ``most`` are counted; each to 2^-200 of its size."""
    out, k = [], 1
    positive = roots_above(poly, 0, 0)
    while k <= min(most, positive):
        low, high, s = 0, bound + 1, 0
        above_low, above_high = positive, 0
        while high - low > 1 or low.bit_length() <= ROOT_BITS:
            if high - low == 1:
                low, high, s = 2 * low, 2 * high, s + 1
            mid = (low + high) // 2
            if above_low - above_high == 1:  # one root: the sign tells its side
                sign = _sign(poly, mid, s)
                above = k if sign and (sign < 0) == (k % 2 == 1) else k - 1
            else:
                above = roots_above(poly, mid, s)
            if above >= k:
                low, above_low = mid, above
            else:
                high, above_high = mid, above
        out.append((Fraction(low + high, 1 << (s + 1)), above_low - above_high))
        k = above_low + 1
    return out


# ------------------------------------------------------------------ components

def _factorised(a: np.ndarray) -> tuple[np.ndarray, list[int]]:
    """Triangular factors of a in one matrix, rows exchanged; a pivot of zero becomes the least number that matters."""
    a, order, d = a.copy(), list(range(len(a))), len(a)
    tiny = max(abs(v) for v in a.flat) * Decimal(10) ** (20 - DIGITS)
    for k in range(d):
        best = max(range(k, d), key=lambda i: abs(a[i, k]))
        if best != k:
            a[[k, best]] = a[[best, k]]
            order[k], order[best] = order[best], order[k]
        if abs(a[k, k]) < tiny:
            a[k, k] = tiny
        a[k + 1:, k] = a[k + 1:, k] / a[k, k]
        a[k + 1:, k + 1:] = a[k + 1:, k + 1:] - np.outer(a[k + 1:, k], a[k, k + 1:])
    return a, order


def _solved(factors: tuple[np.ndarray, list[int]], b: np.ndarray) -> np.ndarray:
    a, order = factors
    x = b[order].copy()
    for i in range(1, len(x)):
        x[i] = x[i] - a[i, :i].dot(x[:i])
    for i in range(len(x) - 1, -1, -1):
        x[i] = (x[i] - (a[i, i + 1:].dot(x[i + 1:]) if i + 1 < len(x) else 0)) / a[i, i]
    return x


def null_space(m: list[list[int]], root: Fraction, size: int) -> np.ndarray:
    """Orthonormal rows that span the null space of m - root, as doubles; the largest entry of each is positive."""
    with localcontext() as context:
        context.prec = DIGITS
        d = len(m)
        shifted = np.array([[Decimal(v) for v in row] for row in m], dtype=object).reshape(d, d)
        value = Decimal(root.numerator) / Decimal(root.denominator)
        for i in range(d):
            shifted[i, i] -= value
        factors = _factorised(shifted)
        base = [np.array([Decimal(1 + (i + 1) * (j + 2) * 7919 % 104729) for i in range(d)], dtype=object) for j in range(size)]
        for _ in range(8):
            old, base_new = base, []
            for b in base:
                x = _solved(factors, b)
                x = x / max(abs(v) for v in x)
                for _twice in range(2):
                    for y in base_new:
                        x = x - y * x.dot(y)
                base_new.append(x / x.dot(x).sqrt())
            base = base_new
            moved = max(min(max(abs(u - v) for u, v in zip(x, y, strict=True)), max(abs(u + v) for u, v in zip(x, y, strict=True))) for x, y in zip(old, base, strict=True))
            if moved < Decimal(10) ** -40:
                break
        rows = np.array([[float(v) for v in x] for x in base])
    return rows * np.sign(rows[np.arange(size), np.abs(rows).argmax(axis=1)])[:, None]


# ------------------------------------------------------------------ whitening

class Whitening:
    """Fitted transform: n, S, components (rows), their eigenvalues and shares of the trace."""

    def __init__(self, spark: SparkSession, fit: DataFrame, width: int, most: int):
        self.width = width
        self.n, self.total, m = scatter(fit, width)
        trace = sum(m[i][i] for i in range(width))
        self.components, self.eigenvalues, self.explained = np.zeros((0, width)), [], []
        if not trace:
            return
        common = gcd(*[v for row in m for v in row])
        small = [[v // common for v in row] for row in m]
        poly = characteristic_polynomial(spark, small)
        found = []
        for root, times in largest_roots(poly, trace // common, most):
            found.append(null_space(small, root, times))
            self.eigenvalues += [float(root * common / self.n ** 2)] * times
            self.explained += [float(root * common / trace)] * times
        self.components = np.vstack(found)[:most]
        self.eigenvalues, self.explained = self.eigenvalues[:most], self.explained[:most]

    def transform(self, rows: DataFrame) -> DataFrame:
        """vec_id, deviation decimal(38,0) (null beyond it), whitened array<double> of rows (vec_id, x)."""
        n, total, width = self.n, np.array(self.total, dtype=object), self.width
        weights = (self.components / np.sqrt(np.array(self.eigenvalues))[:, None]).T if len(self.eigenvalues) else np.zeros((width, 0))
        large = max([abs(v) for v in self.total], default=0)

        def apply(batches):
            for batch in batches:
                x = matrix(batch.column("x"), width, np.int64)
                top = n * (max(-int(x.min()), int(x.max())) if x.size else 0) + large
                if top * top * width < 1 << 63:
                    y = n * x - total.astype(np.int64)
                    deviation = pa.array((y * y).sum(axis=1)).cast(pa.decimal128(38, 0))
                else:
                    y = n * x.astype(object) - total
                    deviation = pa.array([Decimal(v) if v < 10 ** 38 else None for v in (y * y).sum(axis=1)], pa.decimal128(38, 0))
                centred = y.astype(np.float64) / n
                white = np.einsum("ij,jk->ik", centred, weights, optimize=False)
                yield pa.RecordBatch.from_arrays([batch.column("vec_id"), deviation, pa.array(white.tolist(), pa.list_(pa.float64()))], names=["vec_id", "deviation", "whitened"])

        return rows.select("vec_id", "x").mapInArrow(apply, "vec_id long, deviation decimal(38,0), whitened array<double>")

    def identity_error(self, fit: DataFrame) -> float:
        """Largest entry of |covariance of the fit list's whitened values - identity|, from the values themselves."""
        k = len(self.eigenvalues)
        white = self.transform(fit.withColumn("vec_id", F.lit(None).cast("long"))).select(*[F.col("whitened")[i].alias(f"w{i}") for i in range(k)])
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        found = white.agg(*[F.covar_pop(f"w{i}", f"w{j}") for i, j in pairs]).first()
        return max(abs(v - (i == j)) for v, (i, j) in zip(found, pairs, strict=True))


def whiten(df: DataFrame, most: int = 4, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """vec_id, component (from 1, falling eigenvalue), n, deviation decimal(38,0), whitened, explained, identity_error."""
    spark = df.sparkSession
    rows, width = integers(df, id_col, vec_col)
    schema = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"
    if not width:
        return spark.createDataFrame([], schema)
    fit = cut(rows.select("x").distinct(), "whitening-fit")
    fitted = Whitening(spark, fit, width, most)
    if not fitted.eigenvalues:
        return spark.createDataFrame([], schema)
    error = fitted.identity_error(fit)
    shares = F.array(*[F.lit(v) for v in fitted.explained])
    each = fitted.transform(rows).select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select("vec_id", (F.col("at") + 1).alias("component"), F.lit(fitted.n).cast("long").alias("n"), "deviation", "whitened",
                       F.element_at(shares, F.col("at") + 1).alias("explained"), F.lit(error).alias("identity_error"))
