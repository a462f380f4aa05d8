"""Whitening of embeddings by the exact characteristic polynomial of their scatter.

1. Entries c become whole numbers x = floor(256 c); each distinct x vector is fitted once.
2. One pass sums x and its products exactly: blocks of small limbs go through floating
   matrix products below 2**53, and totals travel as limbs of 32 bits. From them
   M = n sum(x x^T) - S S^T, which is n squared times the covariance, a whole-number matrix.
3. Its characteristic polynomial: tasks reduce M to Hessenberg form modulo one prime each;
   the residues are joined by Chinese remaindering to the whole coefficients.
4. All roots are real, so the sign changes of the polynomial moved by a are exactly the
   number of roots above a (Descartes). Halving by these counts isolates the greatest
   roots, multiplicities included; a root that is alone is then halved by signs.
5. Inverse iteration on M - root, in decimals of many digits, gives the null spaces; equal
   roots get an orthonormal basis of their common space.

The driver holds matrices of dimensions squared and numbers per prime, never rows.

Defined cases: null vectors and those with null, NaN or infinite entries have no rows, nor
have empty vectors; vectors of different lengths are different spaces, each with a fit of its
own; x beyond a long is the nearest long; only components with a positive eigenvalue are
returned, so a space whose vectors are all equal has no rows; repeated rows are fitted once
and returned each; a null id stays null; a deviation beyond 38 digits is null; an empty table
gives an empty one; other columns, whatever their names, are not read. A component's greatest
entry (the first of equals) is positive.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rawharbor.llm.common import materialize, quoted
from rawharbor.session import prepare_python

SCALE = 256.0
COMPONENTS = 4
LIMB, ROWS_AT_ONCE = 22, 512  # 512 products of two limbs of 22 bits stay below 2**53
ROWS_PER_CARRY = 1 << 18  # and 2**18 of them below 2**63
ROOT_BITS = 160  # leading bits of a root that are settled
PRIMES_PER_TASK = 16


class Component(NamedTuple):
    eigenvalue: Decimal  # of M
    explained: float
    vector: np.ndarray


class Space(NamedTuple):
    n: int
    sums: list[int]
    components: list[Component]


# --- exact sums -------------------------------------------------------------------


def whole_numbers(vector: Column) -> Column:
    """x, or null where the vector is null or holds a null or non-finite entry."""
    sound = F.forall(
        vector, lambda c: c.isNotNull() & ~F.isnan(c.cast("double")) & (F.abs(c.cast("double")) < F.lit(float("inf")))
    )
    return F.when(sound, F.transform(vector, lambda c: F.floor(c.cast("double") * F.lit(SCALE))))


def _matrix(lists: pa.Array) -> np.ndarray:
    """Vectors of one length, one per row."""
    return np.asarray(lists.flatten()).reshape(len(lists), -1)


def _limbs(x: np.ndarray) -> list[np.ndarray]:
    parts, edge = [], 1 << LIMB
    while x.size and (x.min() <= -edge or x.max() >= edge):
        parts.append((x & (edge - 1)).astype(float))
        x = x >> LIMB
    return [*parts, x.astype(float)]


def exact_products(x: np.ndarray) -> np.ndarray:
    """x^T x in whole numbers of any size."""
    d = x.shape[1]
    total = np.zeros((d, d), object)
    for first in range(0, len(x), ROWS_PER_CARRY):
        parts = _limbs(x[first : first + ROWS_PER_CARRY])
        for i, low in enumerate(parts):
            for j, high in enumerate(parts):
                sums = np.zeros((d, d), np.int64)
                for at in range(0, len(low), ROWS_AT_ONCE):
                    sums += (low[at : at + ROWS_AT_ONCE].T @ high[at : at + ROWS_AT_ONCE]).astype(np.int64)
                total += sums.astype(object) << (LIMB * (i + j))
    return total


def _scatter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of vectors (1, x): the upper half of the sums of products, as limbs of 32 bits."""
    total = 0
    for batch in batches:
        x = _matrix(batch.column(0))
        total = total + exact_products(np.concatenate([np.ones((len(x), 1), np.int64), x], axis=1))
    if isinstance(total, int):
        return
    rows = []
    for i, j in zip(*np.triu_indices(len(total))):
        value, limb = int(total[i, j]), 0
        while value not in (0, -1):
            rows.append((i, j, limb, value & 0xFFFFFFFF))
            value, limb = value >> 32, limb + 1
        if value:
            rows.append((i, j, limb, value))
    columns = list(zip(*rows)) or [()] * 4
    kinds = [pa.int32(), pa.int32(), pa.int32(), pa.int64()]
    yield pa.record_batch([pa.array(c, k) for c, k in zip(columns, kinds)], names=["i", "j", "limb", "v"])


def exact_sums(fit: DataFrame, dimensions: int) -> np.ndarray:
    """Sums of products of (1, x) over the fitted vectors of one length."""
    cells = fit.mapInArrow(_scatter, "i int, j int, limb int, v bigint").groupBy("i", "j", "limb").agg(F.sum("v").alias("v"))
    out = np.zeros((dimensions + 1, dimensions + 1), object)
    for i, j, limb, v in cells.collect():  # dimensions squared times a few limbs
        out[i, j] += v << (32 * limb)
        if i != j:
            out[j, i] = out[i, j]
    return out


# --- characteristic polynomial ----------------------------------------------------


def is_prime(n: int) -> bool:
    """For n below 3.2 * 10**9, where these bases decide."""
    if n < 2 or any(n % p == 0 for p in (2, 3, 5, 7)):
        return n in (2, 3, 5, 7)
    odd, twos = n - 1, 0
    while odd % 2 == 0:
        odd, twos = odd // 2, twos + 1
    for base in (2, 3, 5, 7):
        x = pow(base, odd, n)
        if x not in (1, n - 1) and all((x := x * x % n) != n - 1 for _ in range(twos - 1)):
            return False
    return True


def primes_beyond(bits: float) -> list[int]:
    """The greatest primes below 2**31 whose product has more bits than asked."""
    found, candidate = [], (1 << 31) - 1
    while sum(map(math.log2, found)) <= bits:
        if is_prime(candidate):
            found.append(candidate)
        candidate -= 2
    return found


def characteristic_modulo(matrix: np.ndarray, p: int) -> np.ndarray:
    """Coefficients of det(x - matrix) modulo p, lowest power first."""
    h = (matrix % p).astype(np.int64)
    d = len(h)
    for k in range(1, d - 1):
        below = np.flatnonzero(h[k:, k - 1])
        if not len(below):
            continue
        pivot = k + int(below[0])
        if pivot != k:
            h[[k, pivot]] = h[[pivot, k]]
            h[:, [k, pivot]] = h[:, [pivot, k]]
        factors = h[k + 1 :, k - 1] * pow(int(h[k, k - 1]), -1, p) % p
        h[k + 1 :] = (h[k + 1 :] - factors[:, None] * h[k]) % p
        h[:, k] = (h[:, k] + (h[:, k + 1 :] * factors % p).sum(1)) % p
    polys = np.zeros((d + 1, d + 1), np.int64)
    polys[0, 0] = 1
    for k in range(1, d + 1):
        weights, chain = np.zeros(k, np.int64), 1
        weights[k - 1] = h[k - 1, k - 1]
        for i in range(k - 2, -1, -1):
            chain = chain * int(h[i + 1, i]) % p
            if not chain:
                break
            weights[i] = int(h[i, k - 1]) * chain % p
        polys[k, 1:] = polys[k - 1, :-1]
        polys[k] = (polys[k] - (weights[:, None] * polys[:k] % p).sum(0)) % p
    return polys[d]


def coefficient_bits(matrix: np.ndarray) -> float:
    """Bits that hold any coefficient: roots are not negative and add up to the trace, so the
    k-th elementary symmetric sum is greatest if all are equal (Maclaurin)."""
    d, trace = len(matrix), int(np.trace(matrix))
    if not d or trace == 0:
        return 2.0
    mean = math.log2(trace) - math.log2(d)
    choose = [(math.lgamma(d + 1) - math.lgamma(k + 1) - math.lgamma(d - k + 1)) / math.log(2) for k in range(d + 1)]
    return max(c + k * mean for k, c in enumerate(choose)) + 8


def join_residues(residues: list[np.ndarray], primes: list[int]) -> list[int]:
    product = math.prod(primes)
    weights = [product // p * pow(product // p, -1, p) for p in primes]
    out = []
    for values in zip(*residues):
        x = sum(w * int(v) for w, v in zip(weights, values)) % product
        out.append(x - product if 2 * x > product else x)
    return out


def characteristic_polynomial(spark: SparkSession, matrix: np.ndarray) -> list[int]:
    """Whole coefficients, lowest power first; the primes are shared out over tasks."""
    primes = primes_beyond(coefficient_bits(matrix) + 1)

    def reduce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            places = batch.column(0).to_pylist()
            rows = [characteristic_modulo(matrix, primes[i]) for i in places]
            yield pa.record_batch([pa.array(places, pa.int64()), pa.array(rows, pa.list_(pa.int64()))], names=["place", "rest"])

    places = spark.range(0, len(primes), 1, -(-len(primes) // PRIMES_PER_TASK))
    found = dict(places.mapInArrow(reduce, "place bigint, rest array<bigint>").collect())  # numbers per prime
    return join_residues([np.array(found[i]) for i in range(len(primes))], primes)


# --- roots and null spaces --------------------------------------------------------


def roots_above(coefficients: list[int], a: int) -> int:
    """How many roots exceed a, if all roots are real."""
    moved = list(coefficients)
    for i in range(len(moved) - 1):
        for k in range(len(moved) - 2, i - 1, -1):
            moved[k] += a * moved[k + 1]
    signs = [c > 0 for c in moved if c]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def _sign(coefficients: list[int], a: int) -> int:
    value = 0
    for c in reversed(coefficients):
        value = value * a + c
    return (value > 0) - (value < 0)


def greatest_roots(coefficients: list[int], count: int) -> list[tuple[int, int, int]]:
    """The greatest positive roots as ``(low, high, shift)``, each with ``low < root * 2**shift
    <= high``, apart by at most one in 2**ROOT_BITS; all roots are real and none negative.
    Roots that are equal, or equal to so many bits, share one interval."""
    degree = len(coefficients) - 1
    zeros = next(i for i, c in enumerate(coefficients) if c)
    reduced = coefficients[zeros:]
    out: list[tuple[int, int, int]] = []
    shift = ROOT_BITS
    while len(out) < min(count, degree - zeros):
        power = degree - zeros
        scaled = [c << (shift * (power - i)) for i, c in enumerate(reduced)]
        wanted = len(out) + 1
        # The sum of the roots bounds each of them.
        low, high, above_low, above_high = 0, abs(scaled[-2]), power, 0
        while high - low > max(1, low >> ROOT_BITS):
            middle = (low + high) // 2
            if above_low - above_high == 1:  # alone: the leading sign holds above an even number of roots
                sign = _sign(scaled, middle)
                if sign == 0:
                    low, high = middle - 1, middle
                    break
                above = sign < 0 if above_high % 2 == 0 else sign > 0
                count_above = above_high + (1 if above else 0)
            else:
                count_above = roots_above(scaled, middle)
            if count_above >= wanted:
                low, above_low = middle, count_above
            else:
                high, above_high = middle, count_above
        if high >> ROOT_BITS == 0:  # too small for this many bits behind the point
            shift *= 2
            continue
        out += [(low, high, shift)] * min(above_low - above_high, count - len(out))
    return out


def null_space(matrix: np.ndarray, root: Decimal, size: int, found: list, digits: int) -> list[np.ndarray]:
    """``size`` orthonormal vectors with (matrix - root) v = 0, by inverse iteration."""
    d = len(matrix)
    with localcontext() as context:
        context.prec = digits
        lu = np.array([[Decimal(int(v)) for v in row] for row in matrix], object).reshape(d, d)
        lu[np.diag_indices(d)] -= root
        tiny = root.scaleb(-digits)
        order = np.arange(d)
        for k in range(d):
            pivot = k + int(np.argmax(np.abs(lu[k:, k])))
            lu[[k, pivot]], order[[k, pivot]] = lu[[pivot, k]], order[[pivot, k]]
            if abs(lu[k, k]) < tiny:
                lu[k, k] = tiny
            lu[k + 1 :, k] /= lu[k, k]
            lu[k + 1 :, k + 1 :] -= lu[k + 1 :, k, None] * lu[k, k + 1 :]

        def unit(v: np.ndarray) -> np.ndarray:
            return v / (v * v).sum().sqrt()

        basis: list[np.ndarray] = []
        for number in range(size):
            v = np.array([Decimal(1 + (i * i + 7 * i * (number + 1)) % 101) for i in range(d)], object)
            for _ in range(4):
                v = v[order]
                for k in range(1, d):
                    v[k] -= (lu[k, :k] * v[:k]).sum()
                for k in range(d - 1, -1, -1):
                    v[k] = (v[k] - (lu[k, k + 1 :] * v[k + 1 :]).sum()) / lu[k, k]
                v = unit(v)
                for other in [*found, *basis] * 2:
                    v = v - other * (v * other).sum()
                v = unit(v)
            basis.append(v)
        return basis


def principal_components(spark: SparkSession, matrix: np.ndarray, count: int) -> list[Component]:
    """The first components of a symmetric whole-number matrix without negative eigenvalues."""
    trace = int(np.trace(matrix)) if len(matrix) else 0
    if trace == 0:
        return []
    intervals = greatest_roots(characteristic_polynomial(spark, matrix), count)
    digits = 3 * ROOT_BITS * 3 // 10
    out: list[Component] = []
    vectors: list[np.ndarray] = []
    with localcontext() as context:
        context.prec = digits
        while len(out) < len(intervals):
            low, high, shift = intervals[len(out)]
            root = Decimal(high) / Decimal(1 << shift)
            alike = sum(i == (low, high, shift) for i in intervals)
            for v in null_space(matrix, root, alike, vectors, digits):
                vectors.append(v)
                plain = v.astype(float)
                if plain[np.argmax(np.abs(plain))] < 0:
                    plain = -plain
                out.append(Component(root, float(root / trace), plain))
    return out


# --- whitening --------------------------------------------------------------------


def deviations(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    """n x - S, in longs where they hold it and any size elsewhere."""
    bound = n * max(abs(int(x.min())), abs(int(x.max())), 1) + max(map(abs, sums)) if x.size else 0
    if bound < 1 << 62:
        return x * n - np.array(sums, np.int64)
    return x.astype(object) * n - np.array(sums, object)


def _project(space: Space):
    weights = np.stack([c.vector / float(c.eigenvalue.sqrt()) for c in space.components], axis=1)
    largest = Decimal(10) ** 38

    def run(lists: pa.Array) -> pa.Array:
        if not len(lists):
            return pa.array([], kind)
        y = deviations(_matrix(lists), space.n, space.sums)
        small = y.dtype != object and int(np.abs(y).max()) ** 2 * y.shape[1] < 1 << 62
        squares = (y * y).sum(1) if small else (y.astype(object) ** 2).sum(1)
        values = [Decimal(int(s)) for s in squares]
        white = y.astype(float) @ weights
        cuts = np.arange(len(y) + 1, dtype=np.int32) * white.shape[1]
        return pa.StructArray.from_arrays(
            [
                pa.array([v if v < largest else None for v in values], pa.decimal128(38, 0)),
                pa.ListArray.from_arrays(pa.array(cuts), pa.array(white.ravel())),
            ],
            names=["deviation", "white"],
        )

    kind = pa.struct([("deviation", pa.decimal128(38, 0)), ("white", pa.list_(pa.float64()))])
    return F.arrow_udf(run, "struct<deviation:decimal(38,0),white:array<double>>").asNondeterministic()


def fit_space(fit: DataFrame, dimensions: int, components: int = COMPONENTS) -> Space:
    """The fit of distinct vectors ``x`` that all have this many entries."""
    sums = exact_sums(fit.select("x"), dimensions)
    n, first, products = int(sums[0, 0]), [int(s) for s in sums[0, 1:]], sums[1:, 1:]
    matrix = n * products - np.multiply.outer(np.array(first, object), np.array(first, object))
    return Space(n, first, principal_components(fit.sparkSession, matrix, components))


def identity_error(fit: DataFrame, space: Space) -> float:
    """Greatest entry of the whitened fit list's covariance less the identity."""
    white = fit.select(_project(space)("x")["white"].alias("w"))
    pairs = [(i, j) for i in range(len(space.components)) for j in range(i + 1)]
    found = white.agg(*[F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]).first()
    return max(abs(v - (i == j)) for (i, j), v in zip(pairs, found))


def whitened(rows: DataFrame, id_column: str = "vec_id", vector: str = "embedding", components: int = COMPONENTS) -> DataFrame:
    """One row per sound vector and component: ``vec_id, component, n, deviation`` (decimal),
    ``whitened, explained, identity_error``."""
    spark = rows.sparkSession
    prepare_python(spark)
    sound = rows.select(quoted(id_column).alias("vec_id"), whole_numbers(quoted(vector)).alias("x")).filter("size(x) > 0")
    fit = materialize(sound.select("x").distinct(), "whitening-fit")
    out = spark.createDataFrame(
        [],
        f"vec_id {rows.schema[id_column].dataType.simpleString()}, component int, n bigint, deviation decimal(38,0),"
        " whitened double, explained double, identity_error double",
    )
    for length in sorted(r[0] for r in fit.select(F.size("x")).distinct().collect()):
        alike = fit.filter(F.size("x") == length)
        space = fit_space(alike, length, components)
        if not space.components:
            continue
        error = identity_error(alike, space)
        shares = F.array(*[F.lit(c.explained) for c in space.components])
        found = sound.filter(F.size("x") == length).select("vec_id", _project(space)("x").alias("p"))
        found = found.select("vec_id", "p.deviation", F.posexplode("p.white").alias("place", "whitened"))
        out = out.unionByName(
            found.select(
                "vec_id",
                (F.col("place") + 1).alias("component"),
                F.lit(space.n).cast("bigint").alias("n"),
                "deviation",
                "whitened",
                shares[F.col("place")].alias("explained"),
                F.lit(error).alias("identity_error"),
            )
        )
    return out
