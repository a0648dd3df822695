"""Reverse-mode and forward-mode operators over all embeddings, each against its derivative in closed form.

a is |v| + 0.5 and b is |v| + 1 of every component v.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import autograd as A
from tabulon.operators import contraction, linalg
from tabulon.operators.autograd import Var
from tabulon.plans.tensor import Tensor
from tabulon.queries.arrays import WIDTH, M, matrix, r
from tabulon.queries.register import registrar

QUERIES, ORACLES = {}, {}
q = registrar(QUERIES, ORACLES)

AB = f"{M}, x AS (SELECT i0, i1, v, abs(v) + 0.5 AS a, abs(v) + 1 AS b FROM m)"
ROW = "OVER (PARTITION BY i0)"


def operands(s, d) -> dict[str, Tensor]: return (lambda t: {"v": t, "a": t.map(lambda v: F.abs(v) + 0.5), "b": t.map(lambda v: F.abs(v) + 1)})(matrix(s, d))
def constant(t: Tensor) -> Var: return Var(t, [], False)
def slope(loss: Var, by: Var) -> Tensor: return A.backward(A.var_sum(loss))[by]
def squares(x: Var) -> Var: return A.var_square(x)


def reverse(name: str, by: str, f, sql: str, digits: int = 5) -> None:
    """The gradient by one operand of the sum of f, which takes the operands v, a and b."""
    def run(s, d):
        x = {k: Var(t) for k, t in operands(s, d).items()}
        return slope(f(**x), x[by])

    q(f"var_{name}", f"WITH {AB} SELECT i0, i1, {r(sql, digits)} AS v FROM x", run, digits)


_S, _SV = "(1 / (1 + exp(-a)))", "(1 / (1 + exp(-v)))"
_Y = "0.7978845608028654 * (a + 0.044715 * a * a * a)"
reverse("add", "b", lambda v, a, b: squares(A.var_add(a, b)), "2 * (a + b)")
reverse("sub", "b", lambda v, a, b: squares(A.var_sub(a, b)), "-2 * (a - b)")
reverse("mul", "a", lambda v, a, b: squares(A.var_mul(a, b)), "2 * a * b * b")
reverse("div", "b", lambda v, a, b: squares(A.var_div(a, b)), "-2 * a * a / (b * b * b)")
reverse("pow", "b", lambda v, a, b: A.var_pow(a, b), "pow(a, b) * ln(a)")
reverse("pow_base", "a", lambda v, a, b: A.var_pow(a, b), "b * pow(a, b - 1)")
reverse("add_scalar", "a", lambda v, a, b: squares(A.var_add_scalar(a, 3.0)), "2 * (a + 3)")
reverse("sub_scalar", "a", lambda v, a, b: squares(A.var_sub_scalar(a, 3.0)), "2 * (a - 3)")
reverse("mul_scalar", "a", lambda v, a, b: squares(A.var_mul_scalar(a, 3.0)), "18 * a")
reverse("div_scalar", "a", lambda v, a, b: squares(A.var_div_scalar(a, 4.0)), "a / 8")
reverse("pow_scalar", "a", lambda v, a, b: A.var_pow_scalar(a, 3.0), "3 * a * a")
reverse("cast", "a", lambda v, a, b: squares(A.var_cast(a, "f32")), "2 * CAST(CAST(a AS FLOAT) AS DOUBLE)")
reverse("clamp", "a", lambda v, a, b: squares(A.var_clamp(a, 0.55, 0.7)), "CASE WHEN a BETWEEN 0.55 AND 0.7 THEN 2 * a ELSE 0 END")
reverse("silu_mul", "a", lambda v, a, b: A.var_silu_mul(a, b), f"b * {_S} * (1 + a * (1 - {_S}))")
reverse("gelu_mul", "b", lambda v, a, b: A.var_gelu_mul(a, b), f"a * exp(2 * {_Y}) / (exp(2 * {_Y}) + 1)")
reverse("relu_mul", "v", lambda v, a, b: A.var_relu_mul(v, b), "CASE WHEN v > 0 THEN b ELSE 0 END")
reverse("sigmoid_mul", "a", lambda v, a, b: A.var_sigmoid_mul(a, b), f"b * {_S} * (1 - {_S})")
reverse("swiglu", "b", lambda v, a, b: A.var_swiglu(a, b), f"a * {_S}")
reverse("checkpoint", "v", lambda v, a, b: A.checkpoint(lambda z: A.var_mul(A.var_sin(z), z), v), "cos(v) * v + sin(v)")
reverse("sum", "v", lambda v, a, b: squares(A.var_sum(v, [1])), f"2 * sum(v) {ROW}")
reverse("mean", "v", lambda v, a, b: squares(A.var_mean(v, [1])), f"avg(v) {ROW} / 32")
reverse("reshape", "v", lambda v, a, b: squares(A.var_reshape(v, (v.shape[0], 8, 8))), "2 * v")
reverse("transpose", "v", lambda v, a, b: squares(A.var_transpose(v)), "2 * v")
reverse("std", "v", lambda v, a, b: A.var_std(v, [1]), f"(v - avg(v) {ROW}) / (63 * stddev_samp(v) {ROW})")
reverse("softmax", "v", lambda v, a, b: A.var_mul(A.var_softmax(v), constant(a.value)), f"exp(v) / sum(exp(v)) {ROW} * (a - sum(a * exp(v)) {ROW} / sum(exp(v)) {ROW})", 6)
reverse("log_softmax", "v", lambda v, a, b: A.var_mul(A.var_log_softmax(v), constant(a.value)), f"a - sum(a) {ROW} * exp(v) / sum(exp(v)) {ROW}")
for _name, _agg in (("max", "max"), ("min", "min")):
    q(f"var_{_name}", f"WITH {M}, t AS (SELECT i0, i1, CASE WHEN v = {_agg}(v) {ROW} THEN 1.0 ELSE 0.0 END AS h FROM m) SELECT i0, i1, {r(f'h / sum(h) {ROW}')} AS v FROM t", (lambda n: lambda s, d: (lambda x: slope(getattr(A, f"var_{n}")(x, [1]), x))(Var(matrix(s, d))))(_name))
q("var_cumsum", f"WITH {M}, c AS (SELECT i0, i1, sum(v) OVER (PARTITION BY i0 ORDER BY i1) AS c FROM m) SELECT i0, i1, {r('2 * sum(c) OVER (PARTITION BY i0 ORDER BY i1 DESC)')} AS v FROM c", lambda s, d: (lambda x: slope(squares(A.var_cumsum(x, 1)), x))(Var(matrix(s, d))))
q("var_cumprod", f"WITH {AB}, c AS (SELECT i0, i1, a, exp(sum(ln(a)) OVER (PARTITION BY i0 ORDER BY i1)) AS c FROM x) SELECT i0, i1, {r('sum(c) OVER (PARTITION BY i0 ORDER BY i1 DESC) / a')} AS v FROM c", lambda s, d: (lambda x: slope(A.var_cumprod(x, 1), x))(Var(operands(s, d)["a"])))
q("var_gather", f"WITH {M} SELECT i0, i1, {r('CASE WHEN i1 IN (0, 2, 4) THEN 2 * v ELSE 0 END')} AS v FROM m", lambda s, d: (lambda x: slope(squares(A.var_gather(x, 1, Tensor.generate(s, (x.shape[0], 3), lambda i: ((i % 3) * 2).cast("double")))), x))(Var(matrix(s, d))))


def _dropped(s, d):
    x = Var(operands(s, d)["a"])
    g = slope(A.var_dropout(x, 0.25, 3), x).df
    kept = F.avg((F.col("v") != 0).cast("double"))
    return g.agg(F.count("*").alias("n"), F.sum((~((F.col("v") == 0) | (F.abs(F.col("v") - 4 / 3) < 1e-9))).cast("long")).alias("others"), (F.abs(kept - 0.75) < 3 / F.sqrt(F.count("*"))).alias("near"))


q("var_dropout", f"WITH {M} SELECT count(*) AS n, 0 AS others, true AS near FROM m", _dropped)


def _hooked(s, d):
    x, seen = Var(matrix(s, d)), {}
    A.backward_with_hooks(A.var_sum(squares(x)), lambda v, g: seen.__setitem__(v, g))
    return seen[x]


q("backward_with_hooks", f"WITH {M} SELECT i0, i1, {r('2 * v')} AS v FROM m", _hooked)

# norms: upstream gradient v, weight 1
_K = f"1 / sqrt(avg(v * v) {ROW} + 1e-5)"
_RMS = f"WITH {M}, x AS (SELECT i0, i1, v, {_K} AS k FROM m) SELECT i0, i1, {r(f'k * v - v * k * k * k * avg(v * v) {ROW}')} AS v FROM x"
_LN = f"WITH {M}, x AS (SELECT i0, i1, v, (v - avg(v) {ROW}) / sqrt(var_pop(v) {ROW} + 1e-5) AS h, 1 / sqrt(var_pop(v) {ROW} + 1e-5) AS k FROM m) SELECT i0, i1, {r(f'k * (v - avg(v) {ROW} - h * avg(v * h) {ROW})')} AS v FROM x"


def _weights(s): return Var(Tensor.ones(s, (WIDTH,))), Var(Tensor.zeros(s, (WIDTH,)))
def _by_x(s, d, f): return (lambda x: slope(A.var_mul(f(x, *_weights(s)), constant(x.value)), x))(Var(matrix(s, d)))


def _by_residual(s, d, f):
    half = matrix(s, d).map(lambda v: v / 2)
    x, residual = Var(half), Var(half)
    return slope(A.var_mul(f(x, residual, *_weights(s))[0], constant(matrix(s, d))), residual)


q("var_rms_norm", _RMS, lambda s, d: _by_x(s, d, lambda x, w, b: A.var_rms_norm(x, w)))
q("var_layer_norm", _LN, lambda s, d: _by_x(s, d, A.var_layer_norm))
q("var_fused_add_rms_norm", _RMS, lambda s, d: _by_residual(s, d, lambda x, y, w, b: A.var_fused_add_rms_norm(x, y, w)))
q("var_fused_add_layer_norm", _LN, lambda s, d: _by_residual(s, d, A.var_fused_add_layer_norm))
q("var_group_norm", f"WITH {M}, x AS (SELECT i1, (v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5) AS h FROM m WINDOW w AS (PARTITION BY i0, i1 // 16)) SELECT i1 // 8 AS i0, {r('sum(h)', 4)} AS v FROM x GROUP BY 1", lambda s, d: (lambda t, w: slope(A.var_group_norm(Var(t.reshape((t.shape[0], 8, 8))), w, Var(Tensor.zeros(s, (8,))), 4), w))(matrix(s, d), Var(Tensor.ones(s, (8,)))), 4)
q("var_matmul_bias_activation", f"WITH {M} SELECT i1 AS i0, CAST(count(*) FILTER (v > 0) AS DOUBLE) AS v FROM m GROUP BY 1", lambda s, d: (lambda b: slope(A.var_matmul_bias_activation(Var(matrix(s, d)), Var(Tensor.eye(s, WIDTH)), b, "relu"), b))(Var(Tensor.zeros(s, (WIDTH,)))))
q("var_conv1d", f"WITH {M} SELECT i0, 0 AS i1, i1 AS i2, {r('CASE WHEN i1 <= 61 THEN 1 ELSE 0 END - CASE WHEN i1 BETWEEN 1 AND 62 THEN 2 ELSE 0 END + CASE WHEN i1 >= 2 THEN 0.5 ELSE 0 END')} AS v FROM m", lambda s, d: (lambda x: slope(A.var_conv1d(x, Var(Tensor.from_slice(s, [1, -2, 0.5], (1, 1, 3)))), x))(Var(matrix(s, d).unsqueeze(1))))
q("var_conv2d", f"WITH {M} SELECT 0 AS i0, 0 AS i1, a AS i2, b AS i3, {r('sum(v)', 3)} AS v FROM m, range(2) t(a), range(2) u(b) WHERE i1 // 8 BETWEEN a AND a + 6 AND i1 % 8 BETWEEN b AND b + 6 GROUP BY a, b", lambda s, d: (lambda t, w: slope(A.var_conv2d(Var(t.reshape((t.shape[0], 1, 8, 8))), w), w))(matrix(s, d), Var(Tensor.ones(s, (1, 1, 2, 2)))), 3)


# matrix functions of A = E'E / n + I, with E all embeddings
def _definite(s, d) -> Var:
    t = matrix(s, d)
    g = contraction.einsum("ij,ik->jk", t, t)
    return Var(g.map(lambda v: v / t.shape[0]).zip(Tensor.eye(s, WIDTH), lambda x, y: x + y))


_EYE = "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN {} ELSE 0.0 END AS v FROM range(64) t(a), range(64) u(b)"
mm = contraction.matmul
q("var_trace", f"WITH {M}, n AS (SELECT count(*) / 64 AS n, sum(v * v) AS s FROM m) SELECT a AS i0, b AS i1, {r('CASE WHEN a = b THEN 2 * (s / n + 64) ELSE 0 END')} AS v FROM n, range(64) t(a), range(64) u(b)", lambda s, d: (lambda x: slope(squares(A.var_trace(x)), x))(_definite(s, d)))
q("var_inverse", _EYE.format("-1.0"), lambda s, d: (lambda x: mm(mm(x.value, slope(A.var_trace(A.var_inverse(x)), x)), x.value))(_definite(s, d)))
q("var_det", _EYE.format("1.0"), lambda s, d: (lambda x: mm(x.value, slope(A.var_log(A.var_det(x)), x)))(_definite(s, d)))
q("var_solve", "SELECT g AS i0, 0 AS i1, 1.0 AS v FROM range(64) t(g)", lambda s, d: (lambda x, b: mm(x.value, slope(A.var_solve(x, b), b)))(_definite(s, d), Var(Tensor.ones(s, (WIDTH, 1)))))
q("var_cholesky", _EYE.format("1.0"), lambda s, d: (lambda x: slope(squares(A.var_cholesky(x)), x))(_definite(s, d)))


def forward(name: str, of: str, f, sql: str, at: str = "i0, i1") -> None:
    """The tangent of f at operand `of`, whose own tangent is 2, and b, whose tangent is a."""
    def run(s, d):
        x = operands(s, d)
        return A.jvp(f, [x[of], x["b"]], [x[of].map(lambda v: F.lit(2.0)), x["a"]])[1]

    q(f"dual_{name}", f"WITH {AB} SELECT {at}, {r(sql)} AS v FROM x", run)


for _name, _sql in {"neg": "-2", "sigmoid": f"2 * {_S} * (1 - {_S})", "exp": "2 * exp(a)", "log": "2 / a", "sqrt": "1 / sqrt(a)", "square": "4 * a", "cos": "-2 * sin(a)", "tan": "2 / (cos(a) * cos(a))", "tanh": "8 / pow(exp(a) + exp(-a), 2)", "recip": "-2 / (a * a)"}.items():
    forward(_name, "a", (lambda n: lambda x, y: getattr(A, f"dual_{n}")(x))(_name), _sql)
forward("relu", "v", lambda x, y: A.dual_relu(x), "CASE WHEN v > 0 THEN 2 ELSE 0 END")
forward("abs", "v", lambda x, y: A.dual_abs(x), "2 * sign(v)")
forward("add", "a", A.dual_add, "2 + a")
forward("sub", "a", A.dual_sub, "2 - a")
forward("mul", "a", A.dual_mul, "2 * b + a * a")
forward("div", "a", A.dual_div, "(2 * b - a * a) / (b * b)")
forward("add_scalar", "a", lambda x, y: A.dual_add_scalar(x, 3.0), "2")
forward("sub_scalar", "a", lambda x, y: A.dual_sub_scalar(x, 3.0), "2")
forward("mul_scalar", "a", lambda x, y: A.dual_mul_scalar(x, 3.0), "6")
forward("div_scalar", "a", lambda x, y: A.dual_div_scalar(x, 4.0), "0.5")
forward("pow_scalar", "a", lambda x, y: A.dual_pow_scalar(x, 3.0), "6 * a * a")
forward("sum", "a", lambda x, y: A.dual_sum(y, [1]), "sum(a)", "i0")
forward("mean", "a", lambda x, y: A.dual_mean(y, [1]), "avg(a)", "i0")
for _name in ("sum", "mean"):
    ORACLES[f"dual_{_name}"] += " GROUP BY i0"
forward("reshape", "a", lambda x, y: A.dual_reshape(y, (y.shape[0], 8, 8)), "a", "i0, i1 // 8 AS i1, i1 % 8 AS i2")
forward("narrow", "a", lambda x, y: A.dual_narrow(y, 1, 2, 60), "a", "i0, i1 - 2 AS i1")
ORACLES["dual_narrow"] += " WHERE i1 BETWEEN 2 AND 61"
forward("unsqueeze", "a", lambda x, y: A.dual_unsqueeze(y, 1), "a", "i0, 0 AS i1, i1 AS i2")
forward("squeeze", "a", lambda x, y: A.dual_squeeze(A.dual_unsqueeze(y, 1), 1), "a")
forward("permute", "a", lambda x, y: A.dual_permute(y, (1, 0)), "a", "i1 AS i0, i0 AS i1")
forward("transpose", "a", lambda x, y: A.dual_transpose(y), "a", "i1 AS i0, i0 AS i1")
forward("contiguous", "a", lambda x, y: A.dual_contiguous(y), "a")


def _two(s, d):
    x = operands(s, d)["a"]
    tangents = A.jvp_multi(lambda z: [A.dual_sin(z), A.dual_exp(z)], [x], [x])[1]
    return tangents[0].df.select("i0", "i1", F.lit(0).alias("k"), "v").unionByName(tangents[1].df.select("i0", "i1", F.lit(1).alias("k"), "v"))


q("jvp_multi", f"WITH {AB} SELECT i0, i1, k, {r('CASE WHEN k = 0 THEN a * cos(a) ELSE a * exp(a) END')} AS v FROM x, (SELECT CAST(g AS INTEGER) AS k FROM range(2) t(g))", _two)
