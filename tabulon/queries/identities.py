"""Special functions, factorizations, random sources and 8-bit floats against identities, recurrences and bounds that SQL can state.

The matrices of the factorizations are those of all embeddings, 8 x 8 each, so every task factors many of them.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.functions.special import special
from tabulon.operators import linalg
from tabulon.plans.tensor import Tensor
from tabulon.queries import arrays
from tabulon.queries.algorithms import N
from tabulon.queries.arrays import M, matrix, r
from tabulon.queries.elementwise import P, U, X
from tabulon.queries.register import registrar
from tabulon.sources import random as R

QUERIES, ORACLES = {}, {}
q = registrar(QUERIES, ORACLES)

# special functions over all of lineitem
_A, _B, _Z, _M = "(l_quantity / 10 + 0.5)", "(l_tax * 50 + 1)", "(l_discount * 9 + 0.05)", "(l_discount * 9 + 0.04)"


def identity(name: str, f, sql: str, digits: int = 5) -> None:
    q(f"special_{name}_identity", f"SELECT l_orderkey, l_linenumber, {r(sql, digits)} AS v FROM lineitem", lambda s, d: s.read.parquet(f"{d}/lineitem.parquet").select("l_orderkey", "l_linenumber", f().cast("double").alias("v")), digits)


def at(x: str): return F.expr(f"double({x})")


H = 1e-3
identity("erfinv", lambda: special("erf", special("erfinv", at(f"{U} * 0.99"))), f"CAST({U} * 0.99 AS DOUBLE)", 8)
identity("erfc", lambda: special("erf", at(X)) + special("erfc", at(X)), "1.0")
identity("erf", lambda: (special("erf", at(X) + H) - special("erf", at(X) - H)) / (2 * H) - 2 / F.sqrt(F.pi()) * F.exp(-at(X) * at(X)), "0.0", 4)
identity("digamma", lambda: special("digamma", at(P) + 1) - special("digamma", at(P)), f"1 / {P}")
identity("beta", lambda: special("beta", at(_A), at(_B)), f"gamma({_A}) * gamma({_B}) / gamma({_A} + {_B})")
identity("gammainc", lambda: special("gammainc", at(_A), at(_B)) - special("gammainc", at(_A) + 1, at(_B)), f"exp({_A} * ln({_B}) - {_B}) / gamma({_A} + 1)")
identity("gammaincc", lambda: special("gammainc", at(_A), at(_B)) + special("gammaincc", at(_A), at(_B)), "1.0")
identity("gammaincinv", lambda: special("gammainc", at(_A), special("gammaincinv", at(_A), at(_Z))), _Z)
identity("betainc", lambda: special("betainc", at(_A), at(_B), at(_Z)) - special("betainc", at(_A) + 1, at(_B), at(_Z)) - F.pow(at(_Z), at(_A)) * F.pow(1 - at(_Z), at(_B)) / (at(_A) * special("beta", at(_A), at(_B))), "0.0", 8)
identity("betaincinv", lambda: special("betainc", at(_A), at(_B), special("betaincinv", at(_A), at(_B), at(_Z))), _Z)
for _pair in ("bessel_j0", "bessel_j1", "bessel_y0", "bessel_y1"):
    identity(_pair, lambda: special("bessel_j1", at(P)) * special("bessel_y0", at(P)) - special("bessel_j0", at(P)) * special("bessel_y1", at(P)), f"2 / (pi() * {P})")
for _pair in ("bessel_i0", "bessel_i1", "bessel_k0", "bessel_k1"):
    identity(_pair, lambda: special("bessel_i0", at(P)) * special("bessel_k1", at(P)) + special("bessel_i1", at(P)) * special("bessel_k0", at(P)), f"1 / {P}")
for _pair in ("ellipk", "ellipe"):
    identity(_pair, lambda: (lambda k, e, kk, ee: e * kk + ee * k - k * kk)(*(special(f, x) for x in (at(_M), 1 - at(_M)) for f in ("ellipk", "ellipe"))), "pi() / 2")
identity("hyp2f1", lambda: special("hyp2f1", at("l_discount * 5"), a=1.0, b=2.0, c=3.0), "CASE WHEN l_discount = 0 THEN 1 ELSE -2 * (l_discount * 5 + ln(1 - l_discount * 5)) / pow(l_discount * 5, 2) END")
identity("hyp1f1", lambda: special("hyp1f1", at(P), a=1.0, b=2.0), f"(exp({P}) - 1) / {P}", 4)
for _name in ("airy_ai", "airy_bi"):
    identity(_name, (lambda n: lambda: (lambda low, y, high: ((high - 2 * y + low) / (H * H) - at(X) * y) / (1 + F.abs(y)))(special(n, at(X) - H), special(n, at(X)), special(n, at(X) + H)))(_name), "0.0", 3)
for _name, _f in (("fresnel_s", F.sin), ("fresnel_c", F.cos)):
    identity(_name, (lambda n, f: lambda: (special(n, at(U) + H) - special(n, at(U) - H)) / (2 * H) - f(F.pi() / 2 * at(U) * at(U)))(_name, _f), "0.0", 4)

# factorizations: E is an embedding as 8 x 8, S = E E' + I
E_ = f"{M}, e AS (SELECT i0 AS m, i1 // 8 AS i0, i1 % 8 AS i1, v FROM m), s AS (SELECT a.m, a.i0, b.i0 AS i1, sum(a.v * b.v) + CASE WHEN a.i0 = b.i0 THEN 1 ELSE 0 END AS v FROM e a JOIN e b ON a.m = b.m AND a.i1 = b.i1 GROUP BY 1, 2, 3)"
_OF_S, _OF_E = (f"WITH {E_} SELECT m, i0, i1, {r('v', 4)} AS v FROM {t}" for t in "se")
_UNIT = f"WITH {E_} SELECT m, i0, i1, CASE WHEN i0 = i1 THEN 1.0 ELSE 0.0 END AS v FROM s"


def general(s, d) -> DataFrame: return (lambda t: linalg.batch(t.reshape((t.shape[0], 8, 8))))(matrix(s, d))
def turned(x: DataFrame) -> DataFrame: return x.select("m", F.col("i1").alias("i0"), F.col("i0").alias("i1"), "v")


def product(x: DataFrame, y: DataFrame) -> DataFrame:
    """x times y of every matrix."""
    right = y.select("m", F.col("i0").alias("k"), F.col("i1").alias("j"), F.col("v").alias("w"))
    met = x.select("m", "i0", F.col("i1").alias("k"), "v").join(right, ["m", "k"])
    return met.groupBy("m", "i0", F.col("j").alias("i1")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))


def unit(x: DataFrame) -> DataFrame: return x.withColumn("v", (F.col("i0") == F.col("i1")).cast("double"))
def definite(s, d) -> DataFrame: return (lambda e: product(e, turned(e)).withColumn("v", F.col("v") + (F.col("i0") == F.col("i1")).cast("double")))(general(s, d))
def part(out: DataFrame, name: str, column: str = "re") -> DataFrame: return out.where(F.col("part") == name).select("m", "i0", "i1", F.col(column).alias("v"))
def diagonal(x: DataFrame) -> DataFrame: return x.select("m", "i0", F.col("i0").alias("i1"), "v")


def batched(name: str, sql: str, f, source=definite) -> None:
    q(f"linalg_{name}_batch", sql, lambda s, d: f(source(s, d)), 4)


def _split(out: DataFrame, *names: str) -> list[DataFrame]: return [part(out, n) for n in names]


def _of_lu(x: DataFrame) -> DataFrame:
    out = linalg.lu_decompose(x)
    low, up, order = _split(out, "l", "u", "p")
    places = order.select("m", "i0", F.col("v").cast("long").alias("to"))
    return product(low, up).join(places, ["m", "i0"]).select("m", F.col("to").alias("i0"), "i1", "v")


def _of_eig(out: DataFrame) -> DataFrame: return (lambda w, v: product(product(v, diagonal(w)), turned(v)))(*_split(out, "values", "vectors"))


def _of_complex_schur(x: DataFrame) -> DataFrame:
    """The real part of z t z*."""
    out = linalg.rsf2csf(x)
    (zr, zi), (tr, ti) = (tuple(part(out, n, c) for c in ("re", "im")) for n in "zt")
    less = lambda a, b: a.unionByName(b.withColumn("v", -F.col("v"))).groupBy("m", "i0", "i1").agg(F.sum("v").alias("v"))
    plus = lambda a, b: a.unionByName(b).groupBy("m", "i0", "i1").agg(F.sum("v").alias("v"))
    re, im = less(product(zr, tr), product(zi, ti)), plus(product(zr, ti), product(zi, tr))
    return plus(product(re, turned(zr)), product(im, turned(zi)))


def _number(out: DataFrame, name: str) -> DataFrame: return part(out, name).select("m", "v")


batched("inverse", _UNIT, lambda x: product(x, part(linalg.inverse(x), "inverse")))
batched("pinverse", _UNIT, lambda x: product(x, part(linalg.pinverse(x), "pinverse")))
batched("solve", _UNIT, lambda x: part(linalg.solve(x, x), "x"))
batched("lu_decompose", _OF_E, _of_lu, general)
batched("cholesky_decompose", _OF_S, lambda x: (lambda low: product(low, turned(low)))(part(linalg.cholesky_decompose(x), "l")))
batched("qr_decompose", _OF_E, lambda x: product(*_split(linalg.qr_decompose(x), "q", "r")), general)
batched("qr_decompose_thin", _OF_E, lambda x: product(*_split(linalg.qr_decompose_thin(x), "q", "r")), general)
batched("qr_orthogonal", _UNIT, lambda x: (lambda y: product(turned(y), y))(part(linalg.qr_decompose(x), "q")))
batched("svd_decompose", _OF_E, lambda x: (lambda u, w, vt: product(product(u, diagonal(w)), vt))(*_split(linalg.svd_decompose(x), "u", "s", "vt")), general)
batched("eig_decompose_symmetric", _OF_S, lambda x: _of_eig(linalg.eig_decompose_symmetric(x)))
batched("eig_decompose", _UNIT, lambda x: (lambda w, v: product(product(part(linalg.inverse(v), "inverse"), product(x, v)), part(linalg.inverse(diagonal(w).unionByName(unit(x).where("i0 <> i1"))), "inverse")))(*_split(linalg.eig_decompose(x), "values", "vectors")))
batched("schur_decompose", _OF_E, lambda x: (lambda z, t: product(product(z, t), turned(z)))(*_split(linalg.schur_decompose(x), "z", "t")), general)
batched("rsf2csf", _OF_E, _of_complex_schur, general)
batched("polar_decompose", _OF_E, lambda x: product(*_split(linalg.polar_decompose(x), "u", "p")), general)
batched("sqrtm", _OF_S, lambda x: (lambda y: product(y, y))(part(linalg.sqrtm(x), "f")))
batched("fractional_matrix_power", _OF_S, lambda x: (lambda y: product(y, y))(part(linalg.fractional_matrix_power(x, 0.5), "f")))
batched("logm", _OF_S, lambda x: part(linalg.expm(part(linalg.logm(x), "f")), "f"))
batched("expm", _UNIT, lambda x: product(part(linalg.expm(x), "f"), part(linalg.expm(x.withColumn("v", -F.col("v"))), "f")))
batched("signm", _UNIT, lambda x: part(linalg.signm(x), "f"))
batched("funm", _UNIT, lambda x: (lambda y: product(y, part(linalg.inverse(product(x, x)), "inverse")))(part(linalg.funm(x, lambda z: z * z), "f")))
batched("solve_triangular_lower", _UNIT, lambda x: (lambda t: product(t, part(linalg.solve_triangular_lower(t, unit(x)), "x")))(x.withColumn("v", F.when(F.col("i1") <= F.col("i0"), F.col("v")).otherwise(0.0))))
batched("solve_triangular_upper", _UNIT, lambda x: (lambda t: product(t, part(linalg.solve_triangular_upper(t, unit(x)), "x")))(x.withColumn("v", F.when(F.col("i1") >= F.col("i0"), F.col("v")).otherwise(0.0))))
batched("matrix_rank", f"WITH {E_} SELECT DISTINCT m, 8.0 AS v FROM s", lambda x: _number(linalg.matrix_rank(x), "rank"))
# the determinant of the triangle of S is the product of its diagonal; its logarithm likewise
_TRIANGLE = lambda x: x.withColumn("v", F.when(F.col("i1") <= F.col("i0"), F.col("v")).otherwise(0.0))
batched("det", f"WITH {E_} SELECT m, {r('product(v)', 4)} AS v FROM s WHERE i0 = i1 GROUP BY m", lambda x: _number(linalg.det(_TRIANGLE(x)), "det"))
batched("slogdet", f"WITH {E_} SELECT m, {r('sum(ln(v))', 4)} AS v FROM s WHERE i0 = i1 GROUP BY m", lambda x: _number(linalg.slogdet(_TRIANGLE(x)), "logabsdet"))
batched("cond", f"WITH {E_} SELECT m, {r('max(v) / min(v)', 4)} AS v FROM s WHERE i0 = i1 GROUP BY m", lambda x: _number(linalg.cond(x.withColumn("v", F.when(F.col("i0") == F.col("i1"), F.col("v")).otherwise(0.0))), "cond"))


# random sources: mean and variance of the stream within six standard errors of the distribution's
def moments(name: str, f, mean: float, variance: float, fourth: float | None = None) -> None:
    """fourth: the fourth central moment over the squared variance; None where it is too large for a bound."""
    def run(s, d):
        v = F.col("v").cast("double")
        near = F.abs(F.var_pop(v) / variance - 1) < 6 * F.sqrt((fourth - 1) / F.count("*")) if fourth else F.lit(True)
        return f(s).df.agg(F.count("*").alias("n"), (F.abs(F.avg(v) - mean) < 6 * F.sqrt(variance / F.count("*"))).alias("mean_ok"), near.alias("variance_ok"))

    q(f"random_{name}_moments", f"SELECT {N} AS n, true AS mean_ok, true AS variance_ok", run)


_SHAPE = (N,)
for _name in ("philox", "pcg64", "threefry", "xoshiro256"):
    moments(f"{_name}_uniform", (lambda n: lambda s: getattr(R, f"{n}_uniform")(s, _SHAPE, 7))(_name), 0.5, 1 / 12, 1.8)
    moments(f"{_name}_randn", (lambda n: lambda s: getattr(R, f"{n}_randn")(s, _SHAPE, 7))(_name), 0, 1, 3)
moments("rand", lambda s: R.rand(s, _SHAPE, 1), 0.5, 1 / 12, 1.8)
moments("randn", lambda s: R.randn(s, _SHAPE, 1), 0, 1, 3)
moments("randint", lambda s: R.randint(s, 0, 10, _SHAPE, 1), 4.5, 8.25, 1.8)
moments("bernoulli", lambda s: R.bernoulli(s, 0.3, _SHAPE, 1), 0.3, 0.21, 1.8)
moments("exponential", lambda s: R.exponential(s, 2, _SHAPE, 1), 0.5, 0.25, 9)
moments("laplace", lambda s: R.laplace(s, 0, 1, _SHAPE, 1), 0, 2, 6)
moments("poisson", lambda s: R.poisson(s, 3, _SHAPE, 1), 3, 3, 3.4)
moments("binomial", lambda s: R.binomial(s, 10, 0.4, _SHAPE, 1), 4, 2.4, 3)
moments("beta", lambda s: R.beta(s, 2, 3, _SHAPE, 1), 0.4, 0.04, 2.4)
moments("gamma", lambda s: R.gamma(s, 2, 1, _SHAPE, 1), 2, 2, 6)
moments("chi_squared", lambda s: R.chi_squared(s, 3, _SHAPE, 1), 3, 6, 7)
moments("student_t", lambda s: R.student_t(s, 8, _SHAPE, 1), 0, 8 / 6, 4.5)
moments("f_distribution", lambda s: R.f_distribution(s, 5, 9, _SHAPE, 1), 9 / 7, 2 * 81 * 12 / (5 * 49 * 5))
moments("multinomial", lambda s: R.multinomial(Tensor.from_slice(s, [0.2, 0.5, 0.3], (3,)), N), 1.1, 0.49, 2.1)
q("random_dirichlet_sums", "SELECT g AS i0, 1.0 AS v FROM range(500) t(g)", lambda s, d: R.dirichlet(s, [1, 2, 3], 500).df.groupBy("i0").agg(F.sum("v").alias("v")))
q("random_multinomial_samples_sums", "SELECT g AS i0, 10.0 AS v FROM range(500) t(g)", lambda s, d: R.multinomial_samples(s, [0.2, 0.8], 10, 500).df.groupBy("i0").agg(F.sum(F.col("v").cast("double")).alias("v")))
q("random_multivariate_normal_moments", "SELECT b AS i1, 500 AS n, true AS ok FROM range(2) t(b)", lambda s, d: R.multivariate_normal(s, [0, 1], [[1, 0.5], [0.5, 2]], 500).df.groupBy("i1").agg(F.count("*").alias("n"), ((F.abs(F.avg("v") - F.col("i1")) < 6 * F.sqrt((F.col("i1") + 1) / 500.0)) & (F.abs(F.var_pop("v") / (F.col("i1") + 1) - 1) < 6 * (2 / 500) ** 0.5)).alias("ok")))
q("random_wishart_symmetric", "SELECT g AS i0, 0.0 AS v FROM range(200) t(g)", lambda s, d: R.wishart(s, [[1, 0.2], [0.2, 1]], 5, 200).df.groupBy("i0").agg(F.abs(F.sum(F.when(F.col("i1") < F.col("i2"), F.col("v")).when(F.col("i1") > F.col("i2"), -F.col("v")))).alias("v")))

# 8-bit floats by their definition
_E4, _E5 = (f"CASE WHEN {{0}} // {k} = 0 THEN ({{0}} % {k}) / {k}.0 * {low} ELSE (1 + ({{0}} % {k}) / {k}.0) * pow(2.0, {{0}} // {k} - {bias}) END" for k, low, bias in ((8, "pow(2.0, -6)", 7), (4, "pow(2.0, -14)", 15)))
for _kind, _sql in (("e4m3", _E4), ("e5m2", _E5)):
    ORACLES[f"fp8_decode_{_kind}"] = f"SELECT g AS i0, {r(_sql.format('g'))} AS v FROM range(120) t(g)"
for _name, _sql in (("fp8_matmul", _E4), ("fp8_matmul_e5m2", _E5)):
    ORACLES[_name] = f"SELECT a AS i0, b AS i1, {r('sum((' + _sql.format('(a * 8 + k)') + ') * (' + _E4.format('(b * 8 + k)') + '))')} AS v FROM range(8) t(a), range(8) u(b), range(8) w(k) GROUP BY a, b"
QUERIES |= {name: arrays.QUERIES[name] for name in ("fp8_decode_e4m3", "fp8_decode_e5m2", "fp8_matmul", "fp8_matmul_e5m2")}
