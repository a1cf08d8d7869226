"""Whitening of embeddings by the exact characteristic polynomial of their integer scatter.

Vectors become whole numbers x. Their scatter n sum(x x') - S S', which is n^2 times their covariance, is summed
exactly (limbs of 32 bits, added up by Spark), so its characteristic polynomial has integer coefficients. These are
found modulo one prime after another, by Hessenberg reduction, a task for each few primes, and put together by Chinese
remainders. All roots are real and none is negative, so the sign changes of the polynomial shifted by a are exactly the
number of roots beyond a (Descartes): bisection on a dyadic grid isolates the largest roots, repeated ones too, to
PRECISION bits. Each root's null space comes from inverse iteration in PRECISION-bit decimals, a task for each root.

Driver and tasks hold d^2 numbers for vectors of d components and never a number that grows with the rows, except one
partition's sums. The models, 8 d doubles for each length of vectors, are sent with the code of the last pass, a bounded
number of them (MODEL_DOUBLES) at a time.

Defined results: vectors that are null, empty, or hold null, NaN or infinite components take no part; entries beyond
9.2e18 after scaling become it; a null or repeated vec_id is a row like any other; vectors of each length are fitted by
themselves; components of eigenvalue 0 cannot be whitened and are left out, so that a single vector, or equal ones, give
no rows; equal eigenvalues have any orthonormal basis, the same for all rows; a deviation beyond a long is null and
stands in deviation_big as text; an empty table gives an empty result; other columns do not matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from decimal import Decimal, localcontext
from fractions import Fraction

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from . import common

SCALE, SHIFT, COMPONENTS = 1024, 100_000, 8
#: Bits of a root and of the decimals, roots taken together where they differ by less than one in 2^TOGETHER.
PRECISION, TOGETHER = 128, 64
#: Primes a task; doubles of models sent at a time; limbs of 32 bits of a sum.
BUNDLE, MODEL_DOUBLES, LIMBS = 8, 1 << 22, 6
LONG = 2**63 - 1


def whole(df: DataFrame) -> DataFrame:
    """vec_id, y: floor(1024 c) of each entry c of the vectors that take part; x is y + SHIFT, which no covariance sees."""
    bad = F.exists("embedding", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    most = F.lit(9.2e18)
    y = F.transform("embedding", lambda c: F.floor(F.least(F.greatest(c.cast("double") * SCALE, -most), most)).cast("long"))
    return df.where(F.col("embedding").isNotNull() & (F.size("embedding") > 0)).where(~bad).select("vec_id", y.alias("y"))


def matrices(column: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) for each length of the vectors in an array of lists."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    ends = np.asarray(column.offsets)
    flat, sizes = np.asarray(column.values), np.diff(ends)
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield rows, flat[ends[rows][:, None] + np.arange(d)]


def products(y: np.ndarray) -> np.ndarray:
    """y'y exactly, as unbounded integers."""
    most = max(abs(int(y.min())), abs(int(y.max())), 1)
    step = (2**53 - 1) // most**2
    if not step:
        z = y.astype(object)
        return z.T @ z
    out = np.zeros((y.shape[1],) * 2, dtype=object)
    for k in range(0, len(y), step):
        z = y[k : k + step].astype(np.float64)
        out += (z.T @ z).astype(np.int64).astype(object)
    return out


SUMS = "dim int, i int, j int, " + ", ".join(f"l{k} long" for k in range(LIMBS))


def sums(vectors: DataFrame) -> DataFrame:
    """dim, i, j and the limbs of sum(y_i y_j) for i <= j, of sum(y_i) where j = -1, of the count where i = -1."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for b in batches:
            for rows, y in matrices(b.column(0)):
                d = y.shape[1]
                n, s, p = held.get(d, (0, 0, 0))
                held[d] = [n + len(rows), s + y.astype(object).sum(axis=0), p + products(y)]
        for d, (n, s, p) in held.items():
            i, j = np.triu_indices(d)
            values = [n, *s, *p[i, j]]
            index = [np.full(len(values), d), np.concatenate(([-1], np.arange(d), i)), np.concatenate((np.full(d + 1, -1), j))]
            limbs = [[v >> 32 * k & 0xFFFFFFFF if k < LIMBS - 1 else v >> 32 * k for v in values] for k in range(LIMBS)]
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in index), *(pa.array(x, pa.int64()) for x in limbs)], names=[c.split()[0] for c in SUMS.split(", ")])

    return vectors.select("y").mapInArrow(run, SUMS).groupBy("dim", "i", "j").agg(*(F.sum(f"l{k}").alias(f"l{k}") for k in range(LIMBS)))


def packed(values) -> str:
    return ",".join(format(int(v), "x") for v in values)


def unpacked(text: str) -> np.ndarray:
    return np.array([int(x, 16) for x in text.split(",")], dtype=object)


SCATTER = "dim int, n long, total string, scatter string"


def scatters(vectors: DataFrame) -> DataFrame:
    """dim, n, the sums of y and the scatter's rows, one row for each length of vectors."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        d = int(pdf["dim"].iloc[0])
        limbs = pdf[[f"l{k}" for k in range(LIMBS)]].to_numpy().astype(object)
        value = sum(limbs[:, k] * (1 << 32 * k) for k in range(LIMBS))
        i, j = pdf["i"].to_numpy(), pdf["j"].to_numpy()
        n, s, p = int(value[i < 0][0]), np.zeros(d, dtype=object), np.zeros((d, d), dtype=object)
        one = (i >= 0) & (j < 0)
        s[i[one]], two = value[one], j >= 0
        p[i[two], j[two]] = p[j[two], i[two]] = value[two]
        m = n * p - np.outer(s, s)
        return pd.DataFrame([(d, n, packed(s), packed(m.ravel()))], columns=["dim", "n", "total", "scatter"])

    return sums(vectors).groupBy("dim").applyInPandas(run, SCATTER)


def is_prime(n: int) -> bool:
    """Miller and Rabin's test, certain below 3 x 10^9 with these bases."""
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


def primes(bits: int) -> list[int]:
    """The largest primes below 2^31, so many that their product has more than `bits` bits."""
    out, n = [], 2**31 - 1
    while 30 * len(out) <= bits:
        if is_prime(n):
            out.append(n)
        n -= 2
    return out


def polynomial_mod(m: np.ndarray, p: int) -> np.ndarray:
    """The characteristic polynomial of m modulo p < 2^31, highest power first: Hessenberg form, then its recurrence."""
    a = np.array(m % p, dtype=np.int64)
    d = len(a)
    for k in range(d - 2):
        at = k + 1 + int(np.argmax(a[k + 1 :, k] != 0))
        if not a[at, k]:
            continue
        a[[k + 1, at]] = a[[at, k + 1]]
        a[:, [k + 1, at]] = a[:, [at, k + 1]]
        u = a[k + 2 :, k] * pow(int(a[k + 1, k]), -1, p) % p
        a[k + 2 :] = (a[k + 2 :] - u[:, None] * a[k + 1] % p) % p
        a[:, k + 1] = (a[:, k + 1] + (a[:, k + 2 :] * u % p).sum(axis=1)) % p
    polys = np.zeros((d + 1, d + 1), dtype=np.int64)  # polys[k]: of the leading k rows, lowest power first
    polys[0, 0] = 1
    for k in range(d):
        polys[k + 1, 1:] = polys[k, :-1]
        polys[k + 1] -= a[k, k] * polys[k] % p
        chain = 1
        for i in range(k - 1, -1, -1):
            chain = chain * int(a[i + 1, i]) % p
            if not chain:
                break
            polys[k + 1] -= int(a[i, k]) * chain % p * polys[i] % p
        polys[k + 1] %= p
    return polys[d, ::-1]


def symmetric(m: np.ndarray, p: int) -> np.ndarray:
    """The elementary symmetric functions of the eigenvalues, e_0 to e_d, modulo p."""
    out = polynomial_mod(m, p)
    out[1::2] = -out[1::2] % p
    return out


def remaindered(residues: np.ndarray, moduli: list[int]) -> list[int]:
    """The least numbers not below 0 that leave residues[k] modulo moduli[k]."""
    product = math.prod(moduli)
    parts = [product // p for p in moduli]
    parts = [q * pow(q % p, -1, p) for q, p in zip(parts, moduli, strict=True)]
    return [sum(int(r) * q for r, q in zip(column, parts, strict=True)) % product for column in residues.T]


def beyond(poly: list[int], a: int) -> int:
    """How many roots of a real-rooted polynomial (highest power first) are greater than a: sign changes of its shift."""
    c = list(poly)
    for last in range(len(c) - 1, 0, -1):
        for k in range(1, last + 1):
            c[k] += a * c[k - 1]
    signs = [x > 0 for x in c if x]
    return sum(x != y for x, y in zip(signs, signs[1:]))


def largest_roots(e: list[int], most: int) -> tuple[int, list[int]]:
    """(bits, roots): the `most` largest positive roots, times 2^bits and rounded down, repeated ones repeated."""
    rank = max(k for k, v in enumerate(e) if v)
    if not rank:
        return 0, []
    # the least root that is not 0 is at least e_r / e_(r-1); no root is beyond e_1
    bits = PRECISION + max(0, e[rank - 1].bit_length() - e[rank].bit_length() + 1)
    poly = [(-v if k % 2 else v) << bits * k for k, v in enumerate(e[: rank + 1])]

    def at(x: int) -> int:
        out = 0
        for c in poly:
            out = out * x + c
        return out

    found: list[int] = []
    stack = [(0, (e[1] << bits) + 1, rank, 0)]
    while stack:
        low, high, above_low, above_high = stack.pop()
        if above_low == above_high or above_high >= most:
            continue
        if above_low - above_high == 1:
            sign = at(high) > 0
            if not at(high):
                low = high
            while high - low > 1:
                mid = (low + high) // 2
                value = at(mid)
                if not value:
                    low = high = mid
                elif (value > 0) == sign:
                    high = mid
                else:
                    low = mid
            found.append(low)
        elif high - low == 1:
            found += [high if not at(high) else low] * (above_low - above_high)
        else:
            mid = (low + high) // 2
            n = beyond(poly, mid)
            stack += [(low, mid, above_low, n), (mid, high, n, above_high)]
    return bits, sorted(found, reverse=True)[:most]


def null_space(m: np.ndarray, root: Fraction, size: int) -> np.ndarray:
    """`size` orthonormal vectors of m - root, by inverse iteration in decimals; one column a vector."""
    d = len(m)
    with localcontext() as context:
        context.prec = digits = 100 + len(str(max(1, int(abs(m).max()))))
        number = lambda x: Decimal(x.numerator) / Decimal(x.denominator)
        a = np.array([[Decimal(int(v)) for v in row] for row in m], dtype=object)
        scale = max(Decimal(1), sum(abs(a[k, k]) for k in range(d)))
        keep = a.copy()
        a[np.diag_indices(d)] -= number(root)
        order = np.arange(d)
        for k in range(d):
            at = k + int(np.argmax(np.abs(a[k:, k])))
            a[[k, at]], order[[k, at]] = a[[at, k]], order[[at, k]]
            if not a[k, k]:
                a[k, k] = scale.scaleb(-digits)
            a[k + 1 :, k] /= a[k, k]
            a[k + 1 :, k + 1 :] -= np.outer(a[k + 1 :, k], a[k, k + 1 :])
        v = np.array([[Decimal((i * 7919 + c * 104729 + i * i * (c + 3)) % 1009 + 1) for c in range(size)] for i in range(d)], dtype=object)
        for _ in range(4):
            w = v[order]
            for k in range(d):
                w[k + 1 :] -= np.outer(a[k + 1 :, k], w[k])
            for k in range(d - 1, -1, -1):
                w[k] /= a[k, k]
                w[:k] -= np.outer(a[:k, k], w[k])
            for c in range(size):
                for _ in range(2):  # twice is enough
                    for b in range(c):
                        w[:, c] = w[:, c] - w[:, b] * (w[:, b] * w[:, c]).sum()
                    w[:, c] = w[:, c] / (w[:, c] * w[:, c]).sum().sqrt()
            v = w
        if np.abs(keep @ v - v * number(root)).max() > scale * Decimal("1e-15"):
            raise ArithmeticError("inverse iteration does not settle")
        return v.astype(np.float64)


MODEL = "dim int, component int, eigenvalue double, explained double, vector array<double>"


def models(scatter: DataFrame) -> DataFrame:
    """dim, component, eigenvalue of the covariance, its share of the trace, unit eigenvector."""
    def bundles(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, m in zip(pdf["dim"], pdf["scatter"], strict=True):
                trace = int(unpacked(m)[:: d + 1].sum())
                # the sum of all e_k is the product of 1 + root, at most (1 + trace / d)^d
                found = primes(((trace // d + 2) ** d).bit_length())
                yield pd.DataFrame({"dim": d, "bundle": range(0, len(found), BUNDLE), "primes": [found[k : k + BUNDLE] for k in range(0, len(found), BUNDLE)]})

    def residues(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, ps, m in zip(pdf["dim"], pdf["primes"], pdf["scatter"], strict=True):
                square = unpacked(m).reshape(d, d)
                yield pd.DataFrame([(d, int(p), symmetric(square, int(p))) for p in ps], columns=["dim", "prime", "e"])

    def roots(pdf: pd.DataFrame) -> pd.DataFrame:
        e = remaindered(np.stack(pdf["e"]).astype(object), [int(p) for p in pdf["prime"]])
        bits, found = largest_roots(e, COMPONENTS)
        groups: list[list[int]] = []
        for r in found:
            if groups and groups[-1][-1] - r <= groups[-1][-1] >> TOGETHER:
                groups[-1].append(r)
            else:
                groups.append([r])
        firsts = np.cumsum([1, *map(len, groups)])[:-1] if groups else []
        return pd.DataFrame([(int(pdf["dim"].iloc[0]), int(f), bits, packed(g)) for f, g in zip(firsts, groups, strict=True)], columns=["dim", "first", "bits", "roots"])

    def vectors(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for d, first, bits, found, n, m in zip(*(pdf[c] for c in ("dim", "first", "bits", "roots", "n", "scatter")), strict=True):
                square, values = unpacked(m).reshape(d, d), [Fraction(2 * int(r) + 1, 2 << int(bits)) for r in unpacked(found)]
                v, trace, n = null_space(square, values[0], len(values)), int(np.trace(square)), int(n)
                yield pd.DataFrame([(d, int(first) + k, float(r / n**2), float(r / trace), v[:, k].tolist()) for k, r in enumerate(values)], columns=[c.split()[0] for c in MODEL.split(", ")])

    parts = common.partitions(scatter.sparkSession)
    jobs = scatter.select("dim", "scatter").mapInPandas(bundles, "dim int, bundle int, primes array<long>").join(scatter.select("dim", "scatter"), "dim")
    found = jobs.repartition(parts, "dim", "bundle").mapInPandas(residues, "dim int, prime long, e array<long>")
    clusters = found.groupBy("dim").applyInPandas(roots, "dim int, first int, bits int, roots string").join(scatter.select("dim", "n", "scatter"), "dim")
    return clusters.repartition(parts, "dim", "first").mapInPandas(vectors, MODEL)


class Model:
    """Whitens the vectors of one length."""

    def __init__(self, n: int, total: np.ndarray, rows: list) -> None:
        rows = sorted(rows, key=lambda r: r["component"])
        self.n, self.total, self.k = n, total, len(rows)
        self.explained = np.array([r["explained"] for r in rows])
        self.axes = np.array([r["vector"] for r in rows]).T / np.sqrt([r["eigenvalue"] for r in rows])
        self.wide = max((abs(int(v)) for v in total), default=0)

    def deviations(self, y: np.ndarray) -> np.ndarray:
        """n y - total, exactly; as longs where they fit."""
        kind = np.int64 if self.n * max(abs(int(y.min())), abs(int(y.max()))) + self.wide < 2**63 else object
        return y.astype(kind) * self.n - self.total.astype(kind)

    def whitened(self, off: np.ndarray) -> np.ndarray:
        return off.astype(np.float64) / self.n @ self.axes

    @staticmethod
    def squares(off: np.ndarray) -> np.ndarray:
        most = max(abs(int(off.min())), abs(int(off.max())))
        return (off * off).sum(axis=1) if off.dtype != object and most**2 * off.shape[1] < 2**63 else (off.astype(object) ** 2).sum(axis=1)


def identity_errors(vectors: DataFrame, held: dict[int, Model]) -> dict[int, float]:
    """For each length the largest entry of |covariance of the whitened vectors - 1|: each partition about its own mean."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[int, tuple] = {}
        for b in batches:
            for _, y in matrices(b.column(0)):
                if (m := held.get(y.shape[1])) is None:
                    continue
                w = m.whitened(m.deviations(y))
                n, mean = len(w), w.mean(axis=0)
                square = (w - mean).T @ (w - mean)
                if y.shape[1] in kept:
                    n0, mean0, square0 = kept[y.shape[1]]
                    gap = mean - mean0
                    square, mean, n = square + square0 + np.outer(gap, gap) * n * n0 / (n + n0), mean0 + gap * n / (n + n0), n + n0
                kept[y.shape[1]] = n, mean, square
        for d, (n, mean, square) in kept.items():
            i, j = np.indices(square.shape)
            # about the mean of all, which is 0 but for rounding
            both = np.stack([d + 0 * i.ravel(), i.ravel(), j.ravel()])
            yield pa.RecordBatch.from_arrays([*(pa.array(x, pa.int32()) for x in both), pa.array((square + n * np.outer(mean, mean)).ravel()), pa.array(np.broadcast_to(n * mean[:, None], square.shape).ravel())], names=["dim", "i", "j", "square", "mean"])

    rows = vectors.where(F.size("y").isin(list(held))).select("y").mapInArrow(run, "dim int, i int, j int, square double, mean double")
    out: dict[int, tuple] = {d: (np.zeros((m.k, m.k)), np.zeros(m.k)) for d, m in held.items()}
    for r in rows.groupBy("dim", "i", "j").agg(F.sum("square").alias("square"), F.sum("mean").alias("mean")).collect():  # k^2 a length
        out[r["dim"]][0][r["i"], r["j"]], out[r["dim"]][1][r["i"]] = r["square"], r["mean"]
    return {d: float(np.abs(s / held[d].n - np.outer(mean, mean) / held[d].n ** 2 - np.eye(len(mean))).max()) for d, (s, mean) in out.items()}


WHITE = "component int, n long, deviation long, deviation_big string, whitened double, explained double, identity_error double"


def whiten(df: DataFrame) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error: a row for each vector and component."""
    spark, vectors = df.sparkSession, whole(df)
    schema = StructType([df.schema["vec_id"], *StructType.fromDDL(WHITE).fields])
    arrow = to_arrow_schema(schema)
    scatter = common.written(scatters(vectors), "scatter")
    model = common.written(models(scatter), "models")
    parts, bunch, room = [], [], 0
    for r in model.groupBy("dim").count().orderBy("dim").collect():  # one row for each length of vectors
        if bunch and room + r["dim"] * r["count"] > MODEL_DOUBLES:
            parts, bunch, room = [*parts, bunch], [], 0
        bunch.append(r["dim"])
        room += r["dim"] * r["count"]
    parts = [*parts, bunch] if bunch else parts

    def pass_over(dims: list[int]) -> DataFrame:
        totals = {r["dim"]: r for r in scatter.where(F.col("dim").isin(dims)).select("dim", "n", "total").collect()}
        rows: dict[int, list] = {d: [] for d in dims}
        for r in model.where(F.col("dim").isin(dims)).collect():
            rows[r["dim"]].append(r)
        held = {d: Model(totals[d]["n"], unpacked(totals[d]["total"]), rows[d]) for d in dims}
        errors = identity_errors(vectors, held)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for rows, y in matrices(b.column(1)):
                    m = held[y.shape[1]]
                    off = m.deviations(y)
                    each = lambda x: np.repeat(x, m.k)
                    squares = [int(v) for v in m.squares(off)]
                    fits = [v <= LONG for v in squares]
                    columns = [
                        b.column(0).take(pa.array(each(rows))), pa.array(np.tile(np.arange(1, m.k + 1, dtype=np.int32), len(rows))), pa.array(np.full(len(rows) * m.k, m.n)),
                        pa.array([v if f else None for v, f in zip(squares, fits, strict=True)], pa.int64()).take(pa.array(each(np.arange(len(rows))))),
                        pa.array([None if f else str(v) for v, f in zip(squares, fits, strict=True)], pa.string()).take(pa.array(each(np.arange(len(rows))))),
                        pa.array(m.whitened(off).ravel()), pa.array(np.tile(m.explained, len(rows))), pa.array(np.full(len(rows) * m.k, errors[y.shape[1]])),
                    ]
                    yield pa.RecordBatch.from_arrays(columns, schema=arrow)

        return vectors.where(F.size("y").isin(dims)).mapInArrow(run, schema)

    out = spark.createDataFrame([], schema)
    for dims in parts:
        out = out.unionByName(pass_over(dims))
    return out


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(common.read(spark, sf_dir, "embeddings"))


QUERIES = {"op12_whitening": op12_whitening}
ORACLES: dict[str, str] = {}
