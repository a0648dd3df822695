"""Linear algebra. Structural operators are relational; factorizations run per matrix in Arrow-batched tasks, so many small matrices are factored in parallel.

A batch of matrices is a table (m, i0, i1, v): m names the matrix. Tall matrices are reduced by aggregates (Gram matrix, TSQR) first.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.tensor import ShapeError, Tensor

OUT = "m long, part string, i0 long, i1 long, re double, im double"


def batch(t: Tensor, m: int = 0) -> DataFrame:
    """One matrix (rank 2), or a stack of them (rank 3, first index names the matrix)."""
    return t.df.select(F.lit(m).cast("long").alias("m"), "i0", "i1", "v") if t.rank == 2 else t.df.select(F.col("i0").alias("m"), F.col("i1").alias("i0"), F.col("i2").alias("i1"), "v")


def _dense(pdf: pd.DataFrame, shape=None) -> np.ndarray:
    a = np.zeros(shape or (int(pdf.i0.max()) + 1, int(pdf.i1.max()) + 1))
    a[pdf.i0.to_numpy(int), pdf.i1.to_numpy(int)] = pdf.v.to_numpy()
    return a


def _long(m: int, parts: dict[str, np.ndarray]) -> pd.DataFrame:
    out = []
    for name, a in parts.items():
        a = np.atleast_1d(a)
        a = a[:, None] if a.ndim == 1 else a
        i, j = np.indices(a.shape)
        out.append(pd.DataFrame({"m": m, "part": name, "i0": i.ravel(), "i1": j.ravel(), "re": a.real.ravel().astype(float), "im": a.imag.ravel().astype(float)}))
    return pd.concat(out)


def per_matrix(a: DataFrame, f: Callable[[np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """f of every matrix of the batch: (m, part, i0, i1, re, im)."""
    return a.groupBy("m").applyInPandas(lambda key, pdf: _long(key[0], f(_dense(pdf))), OUT)


def per_pair(a: DataFrame, b: DataFrame, f: Callable[[np.ndarray, np.ndarray], dict[str, np.ndarray]]) -> DataFrame:
    """f of every matrix of a and the one of b with its name."""
    b = b.toDF(*b.columns)  # columns of its own, as b may come from a
    return a.groupBy("m").cogroup(b.groupBy("m")).applyInPandas(lambda key, x, y: _long(key[0], f(_dense(x), _dense(y))), OUT)


def solve(a: DataFrame, b: DataFrame) -> DataFrame: return per_pair(a, b, lambda x, y: {"x": np.linalg.solve(x, y)})
def inverse(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"inverse": np.linalg.inv(x)})
def det(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"det": np.linalg.det(x)})


def slogdet(a: DataFrame) -> DataFrame:
    def f(x):
        sign, size = np.linalg.slogdet(x)
        return {"sign": sign, "logabsdet": size}

    return per_matrix(a, f)


def pinverse(a: DataFrame, rcond: float | None = None) -> DataFrame:
    return per_matrix(a, lambda x: {"pinverse": np.linalg.pinv(x, rcond=max(x.shape) * np.finfo(float).eps if rcond is None else rcond)})


def matrix_rank(a: DataFrame, tol: float | None = None) -> DataFrame: return per_matrix(a, lambda x: {"rank": np.float64(np.linalg.matrix_rank(x, tol))})
def cond(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"cond": np.linalg.cond(x)})


def matrix_norm(t: Tensor, order: str = "fro") -> DataFrame:
    """Frobenius, 1 (columns), inf (rows) by aggregates; spectral (2) and nuclear by singular values."""
    size = F.abs("v")
    if order == "fro":
        return t.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v"))).alias("v"))
    if order in ("1", "inf"):
        return t.df.groupBy("i1" if order == "1" else "i0").agg(F.sum(size).alias("s")).agg(F.max("s").alias("v"))
    return per_matrix(batch(t), lambda x: {"norm": np.linalg.norm(x, 2 if order == "2" else "nuc")}).select(F.col("re").alias("v"))


def gram(rows: DataFrame, columns: list[str]) -> DataFrame:
    """The sums of products of all column pairs in one pass: one row."""
    return rows.agg(*(F.sum(F.col(x) * F.col(y)).alias(f"{x}__{y}") for k, x in enumerate(columns) for y in columns[k:]))


def lstsq(rows: DataFrame, features: list[str], target: str) -> np.ndarray:
    """Least squares over a table of any length: R of a QR of every partition's rows, then of the stacked R's."""
    columns = [*features, target]

    def local(batches):
        r = np.zeros((0, len(columns)))
        for pdf in batches:
            r = np.linalg.qr(np.vstack([r, pdf[columns].to_numpy(float)]), mode="r")
        yield pd.DataFrame(r, columns=columns)

    schema = ", ".join(f"`{c}` double" for c in columns)
    # a few rows per partition; stacked in a tree so that no task sees many
    stacked = rows.select(*(F.col(c).cast("double") for c in columns)).mapInPandas(local, schema)
    while (n := stacked.rdd.getNumPartitions()) > 32:
        stacked = stacked.coalesce(n // 16).mapInPandas(local, schema)
    r = np.linalg.qr(stacked.toPandas().to_numpy(float), mode="r")
    k = len(features)
    return np.linalg.lstsq(r[:k, :k], r[:k, k], rcond=None)[0]


def trace(t: Tensor) -> DataFrame: return t.df.where("i0 = i1").agg(F.coalesce(F.sum("v"), F.lit(0.0)).alias("v"))
def diag(t: Tensor) -> Tensor: return Tensor(t.df.where("i0 = i1").select("i0", "v"), (min(t.shape),))


def diagflat(t: Tensor) -> Tensor:
    flat = t.flatten()
    return Tensor(flat.df.select("i0", F.col("i0").alias("i1"), "v"), (flat.shape[0],) * 2).dense(0.0)


def triu(t: Tensor, k: int = 0) -> Tensor: return Tensor(t.df.withColumn("v", F.when(F.col("i1") - F.col("i0") >= k, F.col("v")).otherwise(0.0)), t.shape)
def tril(t: Tensor, k: int = 0) -> Tensor: return Tensor(t.df.withColumn("v", F.when(F.col("i1") - F.col("i0") <= k, F.col("v")).otherwise(0.0)), t.shape)


def kron(a: Tensor, b: Tensor) -> Tensor:
    """All products; that is what the operator asks for."""
    right = b.df.select(F.col("i0").alias("p"), F.col("i1").alias("q"), F.col("v").alias("w"))
    out = a.df.crossJoin(right).select((F.col("i0") * b.shape[0] + F.col("p")).alias("i0"), (F.col("i1") * b.shape[1] + F.col("q")).alias("i1"), (F.col("v") * F.col("w")).alias("v"))
    return Tensor(out, (a.shape[0] * b.shape[0], a.shape[1] * b.shape[1]))


def khatri_rao(a: Tensor, b: Tensor) -> Tensor:
    """Column-wise products."""
    if a.shape[1] != b.shape[1]:
        raise ShapeError("column counts must be equal")
    right = b.df.select(F.col("i0").alias("p"), "i1", F.col("v").alias("w"))
    out = a.df.join(right, "i1").select((F.col("i0") * b.shape[0] + F.col("p")).alias("i0"), "i1", (F.col("v") * F.col("w")).alias("v"))
    return Tensor(out, (a.shape[0] * b.shape[0], a.shape[1]))


def solve_banded(ab: DataFrame, b: DataFrame, lower: int, upper: int) -> DataFrame:
    """Diagonal-ordered bands: row upper + i - j holds cell (i, j)."""
    def f(bands, y):
        n = bands.shape[1]
        a = np.zeros((n, n))
        for k in range(-upper, lower + 1):
            for j in range(max(0, -k), min(n, n - k)):
                a[j + k, j] = bands[upper + k, j]
        return {"x": np.linalg.solve(a, y)}

    return per_pair(ab, b, f)


# factorizations

def _lu(x: np.ndarray):
    """Row-pivoted L, U and the order of the rows."""
    n, m = x.shape
    u, order = x.astype(complex if np.iscomplexobj(x) else float).copy(), np.arange(n)
    low = np.eye(n, dtype=u.dtype)
    for k in range(min(n, m)):
        p = k + int(np.abs(u[k:, k]).argmax())
        if u[p, k] == 0:
            continue
        u[[k, p]], order[[k, p]] = u[[p, k]], order[[p, k]]
        low[[k, p], :k] = low[[p, k], :k]
        low[k + 1 :, k] = u[k + 1 :, k] / u[k, k]
        u[k + 1 :] -= np.outer(low[k + 1 :, k], u[k])
    return low[:, : min(n, m)], np.triu(u)[: min(n, m)], order


def lu_decompose(a: DataFrame) -> DataFrame:
    def f(x):
        low, up, order = _lu(x)
        return {"l": low, "u": up, "p": order.astype(float)}

    return per_matrix(a, f)


def cholesky_decompose(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"l": np.linalg.cholesky(x)})


def qr_decompose(a: DataFrame, thin: bool = False) -> DataFrame:
    return per_matrix(a, lambda x: dict(zip("qr", np.linalg.qr(x, mode="reduced" if thin else "complete"), strict=True)))


def qr_decompose_thin(a: DataFrame) -> DataFrame: return qr_decompose(a, True)


def _substitute(t: np.ndarray, y: np.ndarray, lower: bool, unit: bool) -> np.ndarray:
    x = np.array(y, float)
    for i in range(len(t)) if lower else reversed(range(len(t))):
        rest = slice(0, i) if lower else slice(i + 1, None)
        x[i] = (x[i] - t[i, rest] @ x[rest]) / (1 if unit else t[i, i])
    return x


def solve_triangular_lower(a: DataFrame, b: DataFrame, unit: bool = False) -> DataFrame: return per_pair(a, b, lambda x, y: {"x": _substitute(x, y, True, unit)})
def solve_triangular_upper(a: DataFrame, b: DataFrame) -> DataFrame: return per_pair(a, b, lambda x, y: {"x": _substitute(x, y, False, False)})


def svd_decompose(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: dict(zip(("u", "s", "vt"), np.linalg.svd(x, full_matrices=False), strict=True)))


def eig_decompose_symmetric(a: DataFrame) -> DataFrame:
    """Eigenvalues from the largest on, with their vectors."""
    def f(x):
        w, v = np.linalg.eigh(x)
        return {"values": w[::-1], "vectors": v[:, ::-1]}

    return per_matrix(a, f)


def eig_decompose(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: dict(zip(("values", "vectors"), np.linalg.eig(x), strict=True)))


def complex_schur(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Unitary z and upper triangular t with x = z t z*: an eigenvector at a time is split off."""
    n = len(x)
    z, t = np.eye(n, dtype=complex), x.astype(complex)
    for k in range(n - 1):
        rest = t[k:, k:]
        w, v = np.linalg.eig(rest)
        q, _ = np.linalg.qr(np.column_stack([v[:, int(np.abs(w).argmax())], np.eye(n - k)]))
        full = np.eye(n, dtype=complex)
        full[k:, k:] = q[:, : n - k]
        t, z = full.conj().T @ t @ full, z @ full
    return z, np.triu(t)


def real_schur(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Orthogonal z and quasi-triangular t: real invariant subspaces of dimension 1 or 2 are split off."""
    n, k = len(x), 0
    z, t = np.eye(n), x.astype(float)
    while k < n - 1:
        w, v = np.linalg.eig(t[k:, k:])
        at = int(np.abs(w).argmax())
        pair = abs(w[at].imag) > 1e-12 * max(1.0, abs(w[at]))
        basis = np.column_stack([v[:, at].real, v[:, at].imag] if pair else [v[:, at].real])
        q, _ = np.linalg.qr(basis, mode="complete")
        full = np.eye(n)
        full[k:, k:] = q
        t, z = full.T @ t @ full, z @ full
        t[k + basis.shape[1] :, k : k + basis.shape[1]] = 0
        k += basis.shape[1]
    return z, t


def schur_decompose(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: dict(zip("zt", real_schur(x), strict=True)))


def rsf2csf(a: DataFrame) -> DataFrame:
    """The complex Schur form of the matrices."""
    return per_matrix(a, lambda x: dict(zip("zt", complex_schur(x), strict=True)))


def qz(x: np.ndarray, y: np.ndarray):
    """Unitary q, z and upper triangular s, t with x = q s z*, y = q t z*; y must be regular."""
    z, _ = complex_schur(np.linalg.solve(y, x))
    q, t = np.linalg.qr(y @ z)
    return q, q.conj().T @ x @ z, t, z


def qz_decompose(a: DataFrame, b: DataFrame) -> DataFrame: return per_pair(a, b, lambda x, y: dict(zip("qstz", qz(x, y), strict=True)))


def polar_decompose(a: DataFrame) -> DataFrame:
    """Unitary u and positive p with x = u p."""
    def f(x):
        u, s, vt = np.linalg.svd(x, full_matrices=False)
        return {"u": u @ vt, "p": (vt.T * s) @ vt}

    return per_matrix(a, f)


# functions of matrices

def _expm(x: np.ndarray) -> np.ndarray:
    """Scaling, a Taylor polynomial and squaring."""
    k = max(0, int(np.ceil(np.log2(max(np.linalg.norm(x, 1), 1e-300)))) + 4)
    y, term, total = x / 2**k, np.eye(len(x)), np.eye(len(x))
    for j in range(1, 18):
        term = term @ y / j
        total = total + term
    for _ in range(k):
        total = total @ total
    return total


def _of_schur(x: np.ndarray, f) -> np.ndarray:
    """f by Parlett's recurrence on the complex Schur form; equal eigenvalues are moved apart by rounding's size."""
    z, t = complex_schur(x)
    n = len(t)
    d = np.diag(t).copy()
    for i in range(n):
        while any(abs(d[i] - d[j]) < 1e-7 * max(1.0, abs(d[i])) for j in range(i)):
            d[i] += 2e-7 * max(1.0, abs(d[i]))
    np.fill_diagonal(t, d)
    out = np.diag([f(v) for v in d]).astype(complex)
    for gap in range(1, n):
        for i in range(n - gap):
            j = i + gap
            s = t[i, j] * (out[j, j] - out[i, i]) + t[i, i + 1 : j] @ out[i + 1 : j, j] - out[i, i + 1 : j] @ t[i + 1 : j, j]
            out[i, j] = s / (d[j] - d[i])
    out = z @ out @ z.conj().T
    return out.real if np.isrealobj(x) and np.abs(out.imag).max(initial=0) < 1e-6 * max(1, np.abs(out).max(initial=0)) else out


def _sqrtm(x: np.ndarray) -> np.ndarray:
    """Bjorck and Hammarling's recurrence on the Schur form."""
    z, t = complex_schur(x)
    n, r = len(t), np.zeros_like(t)
    for j in range(n):
        r[j, j] = np.sqrt(t[j, j])
        for i in reversed(range(j)):
            down = r[i, i] + r[j, j]
            r[i, j] = (t[i, j] - r[i, i + 1 : j] @ r[i + 1 : j, j]) / down if down else 0
    out = z @ r @ z.conj().T
    return out.real if np.isrealobj(x) and np.abs(out.imag).max(initial=0) < 1e-9 * max(1, np.abs(out).max(initial=0)) else out


def _logm(x: np.ndarray) -> np.ndarray:
    """Square roots until near the identity, then Gauss and Legendre's form of the logarithm."""
    k, y = 0, x
    while np.linalg.norm(y - np.eye(len(y)), 1) > 0.25 and k < 60:
        y, k = _sqrtm(y), k + 1
    nodes, weights = np.polynomial.legendre.leggauss(16)
    e = y - np.eye(len(y))
    out = sum(w / 2 * np.linalg.solve(np.eye(len(y)) + (u + 1) / 2 * e, e) for u, w in zip(nodes, weights, strict=True)) * 2**k
    return out


def _signm(x: np.ndarray) -> np.ndarray:
    for _ in range(100):
        inverse = np.linalg.inv(x)
        after = (x + inverse) / 2
        if np.linalg.norm(after - x, 1) < 1e-14 * np.linalg.norm(after, 1):
            return after
        x = after
    return x


def expm(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"f": _expm(x)})
def logm(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"f": _logm(x)})
def sqrtm(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"f": _sqrtm(x)})
def signm(a: DataFrame) -> DataFrame: return per_matrix(a, lambda x: {"f": _signm(x)})


def fractional_matrix_power(a: DataFrame, p: float) -> DataFrame:
    return per_matrix(a, lambda x: {"f": np.linalg.matrix_power(x, int(p)) if p == int(p) else np.linalg.matrix_power(x, int(np.floor(p))) @ _expm(_logm(x) * (p - np.floor(p)))})


def funm(a: DataFrame, f: Callable[[complex], complex]) -> DataFrame:
    """A scalar function of every matrix."""
    return per_matrix(a, lambda x: {"f": _of_schur(x, f)})
