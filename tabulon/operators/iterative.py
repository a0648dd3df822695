"""Iterative solvers and eigensolvers for sparse systems. Vectors are columns of one table keyed by i, a product with the matrix is a join and an
aggregate, dot products are aggregates, and only coefficients (small by construction) come to the driver. Every step's table is written to the
shared folder, so lineage does not grow."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.operators.sparse import Sparse
from tabulon.operators.sparse_levels import colours
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import Tensor

RTOL, ATOL, STEPS = 1e-10, 1e-14, 1000


@dataclass
class Result:
    x: Tensor
    iterations: int
    residual: float
    converged: bool


class Space:
    """The state table of one solve: i and the named vectors."""

    def __init__(self, a: Sparse, b: Tensor):
        self.a, self.n, self.scratch = a, a.shape[0], Scratch(b.df.sparkSession)
        every = b.df.sparkSession.range(self.n).withColumnRenamed("id", "i")
        self.state = every.join(b.df.select(F.col("i0").alias("i"), F.col("v").alias("b")), "i", "left").fillna(0.0)
        self.old: DataFrame | None = None

    def keep(self) -> None:
        saved = self.scratch.save(self.state)
        if self.old is not None:
            self.scratch.drop(self.old)
        self.state = self.old = saved

    def put(self, **vectors: str) -> None:
        """New vectors from expressions over the old ones, all at once."""
        self.state = self.state.select("*" if not set(vectors) & set(self.state.columns) else "i", *([] if not set(vectors) & set(self.state.columns) else [c for c in self.state.columns if c != "i" and c not in vectors]), *(F.expr(e).alias(c) for c, e in vectors.items()))

    def multiply(self, transposed: bool = False, **products: str) -> None:
        """Adds A (or its transpose) times a vector, for several vectors in one join; the state is kept afterwards."""
        row, col = ("col", "row") if transposed else ("row", "col")
        side = self.state.select(F.col("i").alias(col), *(F.expr(e).alias(f"_{c}") for c, e in products.items()))
        made = self.a.df.join(side, col).groupBy(F.col(row).alias("i")).agg(*(F.sum(F.col("v") * F.col(f"_{c}")).alias(c) for c in products))
        self.state = self.state.drop(*products).join(made, "i", "left").fillna(0.0, list(products))
        self.keep()

    def sums(self, *expressions: str) -> list[float]:
        return [x or 0.0 for x in self.state.agg(*(F.sum(F.expr(e)).alias(f"s{k}") for k, e in enumerate(expressions))).first()]

    def vector(self, c: str) -> Tensor: return Tensor(self.state.select(F.col("i").alias("i0"), F.col(c).alias("v")), (self.n,))


def _start(a: Sparse, b: Tensor, x0: Tensor | None) -> tuple[Space, float]:
    s = Space(a, b)
    if x0 is None:
        s.put(x="0D", r="b")
        s.keep()
    else:
        s.state = s.state.join(x0.df.select(F.col("i0").alias("i"), F.col("v").alias("x")), "i", "left").fillna(0.0)
        s.multiply(ax="x")
        s.put(r="b - ax")
    return s, float(np.sqrt(s.sums("b * b")[0]))


def _done(s: Space, k: int, residual: float, limit: float) -> Result: return Result(s.vector("x"), k, residual, residual <= limit)


def cg(a: Sparse, b: Tensor, x0: Tensor | None = None, rtol=RTOL, atol=ATOL, max_iter=STEPS) -> Result:
    """For symmetric positive definite matrices."""
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    s.put(p="r")
    rr = s.sums("r * r")[0]
    k = 0
    while np.sqrt(rr) > limit and k < max_iter:
        s.multiply(ap="p")
        step = rr / s.sums("p * ap")[0]
        s.put(x=f"x + {step!r}D * p", r=f"r - {step!r}D * ap")
        after = s.sums("r * r")[0]
        s.put(p=f"r + {after / rr!r}D * p")
        rr, k = after, k + 1
    return _done(s, k, float(np.sqrt(rr)), limit)


def bicgstab(a, b, x0=None, rtol=RTOL, atol=ATOL, max_iter=STEPS) -> Result:
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    s.put(h="r", p="r")
    rho, rr = s.sums("h * r", "r * r")
    k = 0
    while np.sqrt(rr) > limit and k < max_iter:
        s.multiply(ap="p")
        step = rho / s.sums("h * ap")[0]
        s.put(y=f"r - {step!r}D * ap")
        s.multiply(ay="y")
        yy, ayy, ay2 = s.sums("y * y", "ay * y", "ay * ay")
        w = ayy / ay2 if ay2 else 0.0
        s.put(x=f"x + {step!r}D * p + {w!r}D * y", r=f"y - {w!r}D * ay")
        after, rr = s.sums("h * r", "r * r")
        k += 1
        if not w or not rho:
            break
        s.put(p=f"r + {after / rho * step / w!r}D * (p - {w!r}D * ap)")
        rho = after
    return _done(s, k, float(np.sqrt(rr)), limit)


def cgs(a, b, x0=None, rtol=RTOL, atol=ATOL, max_iter=STEPS) -> Result:
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    s.put(h="r", p="r", u="r")
    rho, rr = s.sums("h * r", "r * r")
    k = 0
    while np.sqrt(rr) > limit and k < max_iter:
        s.multiply(ap="p")
        step = rho / s.sums("h * ap")[0]
        s.put(q=f"u - {step!r}D * ap")
        s.multiply(aw="u + q")
        s.put(x=f"x + {step!r}D * (u + q)", r=f"r - {step!r}D * aw")
        after, rr = s.sums("h * r", "r * r")
        k += 1
        if not after:
            break
        ratio = after / rho
        s.put(u=f"r + {ratio!r}D * q")
        s.put(p=f"u + {ratio!r}D * (q + {ratio!r}D * p)")
        rho = after
    return _done(s, k, float(np.sqrt(rr)), limit)


def qmr(a, b, x0=None, rtol=RTOL, atol=ATOL, max_iter=STEPS) -> Result:
    """Two-sided Lanczos without look-ahead."""
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    s.put(v="r", w="r", p="0D", q="0D", d="0D", g="0D")
    rho = xi = float(np.sqrt(s.sums("r * r")[0]))
    gamma, eta, eps, theta, k, rr = 1.0, -1.0, 1.0, 0.0, 0, rho * rho
    while np.sqrt(rr) > limit and k < max_iter and rho and xi:
        s.put(v=f"v / {rho!r}D", w=f"w / {xi!r}D")
        delta = s.sums("v * w")[0]
        if not delta:
            break
        first = k == 0
        s.put(p="v" if first else f"v - {xi * delta / eps!r}D * p", q="w" if first else f"w - {rho * delta / eps!r}D * q")
        s.multiply(ap="p")
        s.multiply(True, aq="q")
        eps = s.sums("q * ap")[0]
        beta = eps / delta
        if not beta:
            break
        s.put(v=f"ap - {beta!r}D * v", w=f"aq - {beta!r}D * w")
        vv, ww = s.sums("v * v", "w * w")
        before, rho, xi = rho, float(np.sqrt(vv)), float(np.sqrt(ww))
        old_theta, old_gamma = theta, gamma
        theta = rho / (gamma * abs(beta))
        gamma = 1 / np.sqrt(1 + theta * theta)
        eta = float(-eta * before * gamma**2 / (beta * old_gamma**2))
        c = float((old_theta * gamma) ** 2)
        s.put(d=f"{eta!r}D * p + {c!r}D * d", g=f"{eta!r}D * ap + {c!r}D * g")
        s.put(x="x + d", r="r - g")
        rr = s.sums("r * r")[0]
        k += 1
    return _done(s, k, float(np.sqrt(rr)), limit)


def _arnoldi(s: Space, start: str, steps: int, size: float) -> np.ndarray:
    """Adds orthonormal vectors q0, q1, ... and returns the Hessenberg matrix; each step orthogonalizes twice."""
    h = np.zeros((steps + 1, steps))
    s.put(q0=f"({start}) / {size!r}D")
    for k in range(steps):
        s.multiply(w=f"q{k}")
        for _ in range(2):
            dots = s.sums(*(f"q{j} * w" for j in range(k + 1)))
            s.put(w="w" + "".join(f" - {d!r}D * q{j}" for j, d in enumerate(dots)))
            h[: k + 1, k] += dots
        h[k + 1, k] = np.sqrt(s.sums("w * w")[0])
        if h[k + 1, k] < 1e-14 * max(1.0, np.abs(h).max()):
            return h[: k + 2, : k + 1]
        s.put(**{f"q{k + 1}": f"w / {float(h[k + 1, k])!r}D"})
    return h


def gmres(a, b, x0=None, restart: int = 20, rtol=RTOL, atol=ATOL, max_iter=STEPS, augment: int = 0) -> Result:
    """Restarted; `augment` keeps that many earlier corrections as extra directions (LGMRES)."""
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    k, old = 0, []
    residual = float(np.sqrt(s.sums("r * r")[0]))
    while residual > limit and k < max_iter:
        h = _arnoldi(s, "r", min(restart, s.n), residual)
        m = h.shape[1]
        directions = [f"q{j}" for j in range(m)]
        for e in old:
            s.multiply(**{f"a{e}": e})
        if old:
            # least squares over the Krylov directions and the earlier corrections: all inner products in one aggregate
            images = ["+".join(f"({float(h[i, j])!r}D * q{i})" for i in range(m + 1) if h[i, j] and f"q{i}" in s.state.columns) for j in range(m)] + [f"a{e}" for e in old]
            pairs = [(i, j) for i in range(len(images)) for j in range(i + 1)]
            sums = s.sums(*(f"({images[i]}) * ({images[j]})" for i, j in pairs), *(f"({x}) * r" for x in images))
            g = np.zeros((len(images),) * 2)
            for (i, j), v in zip(pairs, sums, strict=False):
                g[i, j] = g[j, i] = v
            y = np.linalg.lstsq(g, np.array(sums[len(pairs) :]), rcond=None)[0]
            directions += old
        else:
            y = np.linalg.lstsq(h, np.r_[residual, np.zeros(h.shape[0] - 1)], rcond=None)[0]
        s.put(e="0D" + "".join(f" + {float(c)!r}D * {d}" for c, d in zip(y, directions, strict=True)))
        s.put(x="x + e")
        s.multiply(ax="x")
        s.put(r="b - ax")
        if augment:
            name = f"z{k}"
            s.put(**{name: "e"})
            old = [*old, name][-augment:]
        s.state = s.state.select("i", "b", "x", "r", *old)
        s.keep()
        k += m
        before, residual = residual, float(np.sqrt(s.sums("r * r")[0]))
        if residual >= before * (1 - 1e-12):
            break
    return _done(s, k, residual, limit)


def lgmres(a, b, x0=None, restart=20, augment=3, **options) -> Result: return gmres(a, b, x0, restart, augment=augment, **options)


def adaptive_gmres(a, b, x0=None, restart: int = 10, most: int = 50, **options) -> Result:
    """The restart length doubles while a cycle hardly helps."""
    x, total = x0, 0
    while True:
        out = gmres(a, b, x, restart, max_iter=restart, **options)
        total += out.iterations
        if out.converged or restart >= most or not out.iterations:
            return Result(out.x, total, out.residual, out.converged) if out.converged else gmres(a, b, out.x, restart, **options)
        x, restart = out.x, min(2 * restart, most)


def minres(a, b, x0=None, rtol=RTOL, atol=ATOL, max_iter=STEPS) -> Result:
    """For symmetric matrices: Lanczos with Givens rotations, three vectors at a time."""
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    beta = residual = float(np.sqrt(s.sums("r * r")[0]))
    if residual <= limit:
        return _done(s, 0, residual, limit)
    s.put(v0="0D", v1=f"r / {beta!r}D", d0="0D", d1="0D")
    c0 = c1 = 1.0
    s0 = s1 = 0.0
    last, k = 0.0, 0
    eta = beta
    while residual > limit and k < max_iter:
        s.multiply(w="v1")
        alpha = s.sums("v1 * w")[0]
        s.put(w=f"w - {alpha!r}D * v1 - {last!r}D * v0")
        nxt = float(np.sqrt(s.sums("w * w")[0]))
        eps, delta = s0 * last, c0 * last
        delta, bar = c1 * delta + s1 * alpha, -s1 * delta + c1 * alpha
        rho = float(np.hypot(bar, nxt)) or 1e-300
        c0, s0 = c1, s1
        c1, s1 = bar / rho, nxt / rho
        s.put(d2=f"(v1 - {delta!r}D * d1 - {eps!r}D * d0) / {rho!r}D")
        s.put(x=f"x + {c1 * eta!r}D * d2")
        eta = -s1 * eta
        s.put(d0="d1", d1="d2", v0="v1", v1=f"w / {nxt!r}D" if nxt > 1e-300 else "0D")
        last, residual, k = nxt, abs(eta), k + 1
        if nxt <= 1e-300:
            break
    return _done(s, k, residual, limit)


def jacobi(a, b, x0=None, omega: float = 1.0, rtol=RTOL, atol=ATOL, max_iter=STEPS) -> Result:
    s, size = _start(a, b, x0)
    limit = max(rtol * size, atol)
    s.state = s.state.join(a.df.where("row = col").select(F.col("row").alias("i"), F.col("v").alias("diag")), "i", "left")
    k, residual = 0, float(np.sqrt(s.sums("r * r")[0]))
    while residual > limit and k < max_iter:
        s.put(x=f"x + {omega!r}D * r / diag")
        s.multiply(ax="x")
        s.put(r="b - ax")
        residual, k = float(np.sqrt(s.sums("r * r")[0])), k + 1
    return _done(s, k, residual, limit)


def sor(a: Sparse, b: Tensor, omega: float = 1.0, rtol=RTOL, atol=ATOL, max_iter=STEPS, seed: int = 0) -> Result:
    """Successive over-relaxation by colours: rows of one colour share no cell, so they are relaxed at once, by a join and an aggregate, with the newest values
    of all others. A sweep takes the colours in turn, which is the plain method on the rows in the order of their colours."""
    s, size = _start(a, b, None)
    limit = max(rtol * size, atol)
    colour = s.scratch.save(colours(a, seed), "colours")
    n = (colour.agg(F.max("colour")).first()[0] or 0) + 1
    rows = a.df.join(colour, "row").select("row", "col", F.col("v").alias("c"), "colour")
    rows = s.scratch.save(rows, "rows")
    diag = a.df.where("row = col").select(F.col("row").alias("i"), F.col("v").alias("diag"))
    s.state = s.state.select("i", "b", "x").join(diag, "i").join(colour.withColumnRenamed("row", "i"), "i")
    s.keep()
    k, residual = 0, float(np.sqrt(s.sums("b * b")[0]))
    while residual > limit and k < max_iter:
        for at in range(n):
            own = rows.where((F.col("colour") == at) & (F.col("row") != F.col("col")))
            met = own.join(s.state.select(F.col("i").alias("col"), "x"), "col").groupBy(F.col("row").alias("i")).agg(F.sum(F.col("c") * F.col("x")).alias("rest"))
            relaxed = F.when(F.col("colour") == at, F.col("x") + omega * ((F.col("b") - F.coalesce("rest", F.lit(0.0))) / F.col("diag") - F.col("x"))).otherwise(F.col("x"))
            s.state = s.state.join(met, "i", "left").select("i", "b", relaxed.alias("x"), "diag", "colour")
            s.keep()
        out = rows.join(s.state.select(F.col("i").alias("col"), "x"), "col").groupBy(F.col("row").alias("i")).agg(F.sum(F.col("c") * F.col("x")).alias("ax"))
        residual = float(np.sqrt(s.state.join(out, "i").agg(F.sum((F.col("b") - F.col("ax")) * (F.col("b") - F.col("ax")))).first()[0] or 0.0))
        k += 1
    return _done(s, k, residual, limit)


def block_sor(a: Sparse, b: Tensor, omega: float = 1.0, rtol=RTOL, atol=ATOL, max_iter=STEPS, blocks: int = 1) -> Result:
    """The plain order of rows for small or nearly full systems: rows go to `blocks` tasks by range, relaxed in order within, old values across."""
    s, size = _start(a, b, None)
    limit = max(rtol * size, atol)
    rows = a.df.select("row", "col", F.col("v").alias("c"), F.expr(f"row * {blocks} div {a.shape[0]}").alias("part"))
    k, residual = 0, float(np.sqrt(s.sums("r * r")[0]))

    def sweep(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["row", "col"])
        x = dict(zip(pdf["col"], pdf["xc"], strict=True))
        out = {}
        for row, g in pdf.groupby("row", sort=True):
            diag = float(g.c[g.col == row].iloc[0])
            old = float(g.xr.iloc[0])
            rest = sum(c * x[j] for c, j in zip(g.c, g.col, strict=True) if j != row)
            x[row] = out[row] = old + omega * ((float(g.b.iloc[0]) - rest) / diag - old)
        return pd.DataFrame({"i": list(out), "x": list(out.values())})

    while residual > limit and k < max_iter:
        old = s.state
        met = rows.join(old.select(F.col("i").alias("col"), F.col("x").alias("xc")), "col").join(old.select(F.col("i").alias("row"), F.col("x").alias("xr"), "b"), "row")
        new = met.groupBy("part").applyInPandas(sweep, "i long, x double")
        s.state = old.select("i", "b").join(new, "i")
        s.multiply(ax="x")
        s.put(r="b - ax")
        residual, k = float(np.sqrt(s.sums("r * r")[0])), k + 1
    return _done(s, k, residual, limit)


# eigenvalues

def _written(a: Sparse) -> Sparse:
    """The matrix as a written table: every step reads it, and its source may be a join of large tables."""
    return Sparse(Scratch(a.df.sparkSession).save(a.df.select("row", "col", "v"), "matrix"), a.shape)


def _random_start(a: Sparse, spark, seed: int) -> Space:
    b = Tensor.generate(spark, (a.shape[0],), lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), i), 11) * 2.0**-53 - 0.5)
    s = Space(a, b)
    s.keep()
    return s


def _vectors(s: Space, y: np.ndarray) -> DataFrame:
    """(i, k, v) of the combinations y of q0, q1, ..."""
    columns = [F.expr(" + ".join(f"{float(y[j, k])!r}D * q{j}" for j in range(len(y)))) for k in range(y.shape[1])]
    return s.state.select("i", F.posexplode(F.array(*columns)).alias("k", "v"))


def sparse_eig_symmetric(a: Sparse, k: int, steps: int = 40, seed: int = 0) -> tuple[np.ndarray, DataFrame]:
    """The k eigenvalues of largest magnitude and their vectors (i, k, v), by Lanczos with full orthogonalization."""
    a = _written(a)
    s = _random_start(a, a.df.sparkSession, seed)
    h = _arnoldi(s, "b", min(max(steps, 2 * k + 5), s.n), float(np.sqrt(s.sums("b * b")[0])))
    m = h.shape[1]
    w, y = np.linalg.eigh((h[:m] + h[:m].T) / 2)
    order = np.argsort(-np.abs(w))[:k]
    return w[order], _vectors(s, y[:, order])


def sparse_eig(a: Sparse, k: int, steps: int = 40, seed: int = 0) -> np.ndarray:
    """The k eigenvalues of largest magnitude, by Arnoldi."""
    a = _written(a)
    s = _random_start(a, a.df.sparkSession, seed)
    h = _arnoldi(s, "b", min(max(steps, 2 * k + 5), s.n), float(np.sqrt(s.sums("b * b")[0])))
    w = np.linalg.eigvals(h[: h.shape[1]])
    return w[np.argsort(-np.abs(w))][:k]


def svds(a: Sparse, k: int, steps: int = 40, seed: int = 0) -> tuple[np.ndarray, DataFrame, DataFrame]:
    """The k largest singular values, right and left vectors (i, k, v), by Golub-Kahan-Lanczos bidiagonalization.

    Only products with A and its transpose are taken, so the condition number isn't squared; both sides are orthogonalized twice against all vectors so far.
    """
    a = _written(a)
    spark, steps = a.df.sparkSession, min(max(steps, 2 * k + 5), *a.shape)
    right, left = (Space(Sparse(a.df, (n, n)), Tensor.generate(spark, (n,), lambda i: F.shiftrightunsigned(F.xxhash64(F.lit(seed), i), 11) * 2.0**-53 - 0.5)) for n in (a.shape[1], a.shape[0]))
    left.put(b="0D")
    right.put(v0=f"b / {float(np.sqrt(right.sums('b * b')[0]))!r}D")
    right.keep()
    left.keep()
    alpha, beta = [], []

    def image(of: Space, to: Space, name: str, transposed: bool) -> None:
        """w of `to`: A (or its transpose) times a vector of `of`."""
        row, col = ("col", "row") if transposed else ("row", "col")
        made = a.df.join(of.state.select(F.col("i").alias(col), F.col(name).alias("x")), col).groupBy(F.col(row).alias("i")).agg(F.sum(F.col("v") * F.col("x")).alias("w"))
        to.state = to.state.drop("w").join(made, "i", "left").fillna(0.0, ["w"])
        to.keep()

    def settled(s: Space, names: list[str]) -> float:
        for _ in range(2 if names else 0):
            dots = s.sums(*(f"{q} * w" for q in names))
            s.put(w="w" + "".join(f" - {d!r}D * {q}" for d, q in zip(dots, names, strict=True)))
        return float(np.sqrt(s.sums("w * w")[0]))

    for j in range(steps):
        image(right, left, f"v{j}", False)
        alpha.append(settled(left, [f"u{i}" for i in range(j)]))
        small = 1e-13 * max(alpha)
        left.put(**{f"u{j}": f"w / {alpha[-1]!r}D" if alpha[-1] > small else "0D"})
        if alpha[-1] <= small:
            break
        image(left, right, f"u{j}", True)
        beta.append(settled(right, [f"v{i}" for i in range(j + 1)]))
        if beta[-1] <= small or j + 1 == steps:
            break
        right.put(**{f"v{j + 1}": f"w / {beta[-1]!r}D"})
    m = len(alpha)
    u, s, vt = np.linalg.svd(np.diag(alpha) + np.diag(beta[: m - 1], 1))
    k = min(k, m)

    def combined(space: Space, name: str, y: np.ndarray) -> DataFrame:
        columns = [F.expr(" + ".join(f"{float(y[j, c])!r}D * {name}{j}" for j in range(m))) for c in range(k)]
        return space.state.select("i", F.posexplode(F.array(*columns)).alias("k", "v"))

    return s[:k], combined(right, "v", vt.T), combined(left, "u", u)


def two_grid(a: Sparse, b: Tensor, strength: float = 0.25, sweeps: int = 2, cycles: int = 50, rtol: float = 1e-8, coarse: int = 200) -> Result:
    """Aggregation multigrid: Jacobi sweeps, residual summed per aggregate, the coarse system solved (recursively, by CG when small), correction spread back.

    A node joins the aggregate of its least strongly connected neighbour.
    """
    n = a.shape[0]
    strong = a.df.where("row <> col").join(a.df.where("row = col").select("row", F.col("v").alias("d")), "row").where(F.abs("v") >= F.abs("d") * strength)
    lead = strong.groupBy("row").agg(F.least(F.min("col"), F.col("row")).alias("lead"))
    up = lead.select(F.col("row").alias("lead"), F.col("lead").alias("top"))
    s = Scratch(a.df.sparkSession)
    every = a.df.sparkSession.range(n).select(F.col("id").alias("row"))
    groups = every.join(lead, "row", "left").select("row", F.coalesce("lead", "row").alias("lead")).join(up, "lead", "left").select("row", F.coalesce("top", "lead").alias("g"))
    groups = s.save(groups)
    names = s.save(groups.select("g").distinct().withColumn("k", F.row_number().over(W.partitionBy(F.lit(0)).orderBy("g")) - 1))
    of = s.save(groups.join(names, "g").select("row", F.col("k").cast("long").alias("k")))
    m = names.count()
    small = a.df.join(of, "row").join(of.select(F.col("row").alias("col"), F.col("k").alias("l")), "col").groupBy(F.col("k").alias("row"), F.col("l").alias("col")).agg(F.sum("v").alias("v"))
    small = Sparse(s.save(small), (m, m))
    x, size, k = None, float(np.sqrt(b.df.agg(F.sum(F.col("v") * F.col("v"))).first()[0] or 0)), 0
    residual = size
    while residual > rtol * size and k < cycles:
        smooth = jacobi(a, b, x, omega=0.67, rtol=0.0, max_iter=sweeps)
        r = b.zip(a.spmv(smooth.x), lambda p, q: p - q)
        rc = Tensor(s.save(r.df.join(of.withColumnRenamed("row", "i0"), "i0").groupBy(F.col("k").alias("i0")).agg(F.sum("v").alias("v"))), (m,))
        ec = cg(small, rc, rtol=1e-10).x if m <= coarse or m >= n else two_grid(small, rc, strength, sweeps, 2, rtol, coarse).x
        e = of.join(ec.df.select(F.col("i0").alias("k"), F.col("v").alias("e")), "k").select(F.col("row").alias("i0"), F.col("e").alias("v"))
        x = smooth.x.zip(Tensor(e, (n,)), lambda p, q: p + q)
        after = jacobi(a, b, Tensor(s.save(x.df), (n,)), omega=0.67, rtol=0.0, max_iter=sweeps)
        x, residual, k = after.x, after.residual, k + 1
    return Result(x if x is not None else Tensor.zeros(b.df.sparkSession, (n,)), k, residual, residual <= rtol * size)
