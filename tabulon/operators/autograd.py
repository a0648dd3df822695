"""Differentiation. Reverse mode keeps a graph of nodes on the driver, each with its array (a lazy DataFrame) and the rule that maps the gradient of its
output to those of its inputs; gradients stay lazy, so a whole backward pass can be one job. Forward mode carries (value, tangent) in one struct column."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass, field
from math import prod

from pyspark.sql import functions as F

from tabulon.functions import elementwise as E
from tabulon.operators import contraction, indexing, linalg, neural
from tabulon.plans.tensor import ShapeError, Tensor


@dataclass(eq=False)
class Var:
    value: Tensor
    parents: list[tuple[Var, Callable[[Var], Var]]] = field(default_factory=list)
    requires_grad: bool = True

    @property
    def shape(self): return self.value.shape

    def detach(self) -> Var: return Var(self.value, [], False)


def _order(v: Var) -> list[Var]:
    seen, out, stack = set(), [], [(v, False)]
    while stack:
        node, done = stack.pop()
        if done:
            out.append(node)
        elif id(node) not in seen:
            seen.add(id(node))
            stack.append((node, True))
            stack += [(p, False) for p, _ in node.parents]
    return out


def backward_with_graph(loss: Var) -> dict[Var, Var]:
    """Gradients as differentiable nodes. The loss must have one element."""
    if prod(loss.shape) != 1:
        raise ShapeError("the loss must be one number")
    grads = {loss: Var(loss.value.map(lambda v: F.lit(1.0)))}
    for node in reversed(_order(loss)):
        if node not in grads:
            continue
        for parent, rule in node.parents:
            if parent.requires_grad:
                g = rule(grads[node])
                grads[parent] = var_add(grads[parent], g) if parent in grads else g
    return grads


def backward_with_hooks(loss: Var, hook: Callable[[Var, Tensor], None]) -> dict[Var, Tensor]:
    """The hook sees every leaf's gradient."""
    grads = {v: g.value for v, g in backward_with_graph(loss).items()}
    for v in reversed(_order(loss)):
        if not v.parents and v in grads:
            hook(v, grads[v])
    return grads


def backward(loss: Var) -> dict[Var, Tensor]: return backward_with_hooks(loss, lambda v, g: None)


def _to(g: Var, shape: tuple[int, ...]) -> Var:
    """The gradient of a broadcast operand: summed over what was stretched."""
    while len(g.shape) > len(shape):
        g = var_sum(g, [0])
    gone = [k for k, n in enumerate(shape) if n == 1 and g.shape[k] != 1]
    return var_sum(g, gone, True) if gone else g


def _spread(g: Var, shape) -> Var: return Var(g.value.broadcast_to(shape), [(g, lambda h: _to(h, g.shape))])


def var_add(a: Var, b: Var) -> Var: return Var(a.value.binary("add", b.value), [(a, lambda g: _to(g, a.shape)), (b, lambda g: _to(g, b.shape))])
def var_sub(a: Var, b: Var) -> Var: return Var(a.value.binary("sub", b.value), [(a, lambda g: _to(g, a.shape)), (b, lambda g: _to(var_neg(g), b.shape))])
def var_mul(a: Var, b: Var) -> Var: return Var(a.value.binary("mul", b.value), [(a, lambda g: _to(var_mul(g, b), a.shape)), (b, lambda g: _to(var_mul(g, a), b.shape))])
def var_div(a: Var, b: Var) -> Var: return Var(a.value.binary("div", b.value), [(a, lambda g: _to(var_div(g, b), a.shape)), (b, lambda g: _to(var_neg(var_div(var_mul(g, a), var_square(b))), b.shape))])


def var_pow(a: Var, b: Var) -> Var:
    out = Var(a.value.binary("pow", b.value))
    out.parents = [(a, lambda g: _to(var_mul(g, var_mul(b, var_pow(a, var_sub_scalar(b, 1.0)))), a.shape)), (b, lambda g: _to(var_mul(g, var_mul(out, var_log(a))), b.shape))]
    return out


def _scaled(name: str, slope: float):
    def f(a: Var, s: float) -> Var:
        return Var(a.value.scalar(name, s), [(a, lambda g: g if slope == 1 else var_mul_scalar(g, s if name == "mul_scalar" else 1 / s))])
    return f


var_add_scalar, var_sub_scalar, var_mul_scalar, var_div_scalar = _scaled("add_scalar", 1), _scaled("sub_scalar", 1), _scaled("mul_scalar", 0), _scaled("div_scalar", 0)


def var_pow_scalar(a: Var, s: float) -> Var: return Var(a.value.scalar("pow_scalar", s), [(a, lambda g: var_mul(g, var_mul_scalar(var_pow_scalar(a, s - 1), s)))])


def _unary(f, prime: Callable[[Var, Var], Var]):
    """prime makes the derivative from the input and the output, as differentiable nodes."""
    def make(a: Var) -> Var:
        out = Var(a.value.map(f))
        out.parents = [(a, lambda g: var_mul(g, prime(a, out)))]
        return out
    return make


def _flat(f): return lambda a, y: Var(a.value.map(f), [], False)


var_neg = lambda a: Var(a.value.map(E.neg), [(a, lambda g: var_neg(g))])
var_exp = _unary(E.exp, lambda a, y: y)
var_log = _unary(E.log, lambda a, y: var_recip(a))
var_sqrt = _unary(E.sqrt, lambda a, y: var_mul_scalar(var_recip(y), 0.5))
var_sin = _unary(E.sin, lambda a, y: var_cos(a))
var_cos = _unary(E.cos, lambda a, y: var_neg(var_sin(a)))
var_tan = _unary(E.tan, lambda a, y: var_add_scalar(var_square(y), 1.0))
var_tanh = _unary(E.tanh, lambda a, y: var_add_scalar(var_neg(var_square(y)), 1.0))
var_square = _unary(E.square, lambda a, y: var_mul_scalar(a, 2.0))
var_recip = _unary(E.recip, lambda a, y: var_neg(var_square(y)))
var_abs = _unary(E.abs_, _flat(E.sign))
var_relu = _unary(E.relu, _flat(E.relu_prime))
var_sigmoid = _unary(E.sigmoid, lambda a, y: var_mul(y, var_add_scalar(var_neg(y), 1.0)))
var_silu = lambda a: var_mul(a, var_sigmoid(a))
var_softplus = _unary(E.softplus, lambda a, y: var_sigmoid(a))
_gelu = _unary(E.gelu, _flat(E.gelu_prime))


def var_cast(a: Var, dtype: str) -> Var: return Var(a.value.map(lambda v: E.cast(v, dtype).cast("double")), [(a, lambda g: g)])
def var_clamp(a: Var, low: float, high: float) -> Var: return Var(a.value.map(lambda v: E.clamp(v, low, high)), [(a, lambda g: var_mul(g, Var(a.value.map(lambda v: v.between(low, high).cast("double")), [], False)))])
def var_silu_mul(a, b): return var_mul(var_silu(a), b)
def var_gelu_mul(a, b): return var_mul(_gelu(a), b)
def var_relu_mul(a, b): return var_mul(var_relu(a), b)
def var_sigmoid_mul(a, b): return var_mul(var_sigmoid(a), b)
def var_swiglu(gate, up): return var_silu_mul(gate, up)


def var_sum(a: Var, dims: Sequence[int] = (), keepdim: bool = False) -> Var:
    gone = sorted({a.value.dim(d) for d in dims}) or list(range(a.value.rank))
    kept = tuple(1 if k in gone else n for k, n in enumerate(a.shape))
    return Var(a.value.sum(dims, keepdim), [(a, lambda g: _spread(var_reshape(g, kept), a.shape))])


def _count(a: Var, dims) -> int: return prod(a.shape[a.value.dim(d)] for d in dims) if dims else prod(a.shape)
def var_mean(a: Var, dims=(), keepdim=False) -> Var: return var_mul_scalar(var_sum(a, dims, keepdim), 1 / _count(a, dims))
def var_reshape(a: Var, shape) -> Var: return Var(a.value.reshape(shape), [(a, lambda g: var_reshape(g, a.shape))])
def var_transpose(a: Var, x: int = -2, y: int = -1) -> Var: return Var(a.value.transpose(x, y), [(a, lambda g: var_transpose(g, x, y))])


def _extreme(op: str):
    def f(a: Var, dims=(), keepdim=False) -> Var:
        """The gradient goes to all places of the extreme value, in equal shares."""
        top = getattr(a.value, op)(dims, True)
        hit = a.value.zip(top, E.eq)
        share = Var(hit.zip(hit.sum(dims, True), lambda h, n: h / n), [], False)
        return Var(getattr(a.value, op)(dims, keepdim), [(a, lambda g: var_mul(_spread(var_reshape(g, top.shape), a.shape), share))])
    return f


var_max, var_min = _extreme("max"), _extreme("min")


def var_var(a: Var, dims=(), correction: int = 1, keepdim: bool = False) -> Var:
    off = var_sub(a, var_mean(a, dims, True))
    return var_mul_scalar(var_sum(var_square(off), dims, keepdim), 1 / max(_count(a, dims) - correction, 1))


def var_std(a, dims=(), correction=1, keepdim=False) -> Var: return var_sqrt(var_var(a, dims, correction, keepdim))


def var_softmax(a: Var, d: int = -1) -> Var:
    out = Var(neural.softmax(a.value, d))
    out.parents = [(a, lambda g: var_mul(out, var_sub(g, var_sum(var_mul(g, out), [d], True))))]
    return out


def var_log_softmax(a: Var, d: int = -1) -> Var: return Var(neural.log_softmax(a.value, d), [(a, lambda g: var_sub(g, var_mul(var_softmax(a, d), var_sum(g, [d], True))))])
def var_matmul(a: Var, b: Var) -> Var: return Var(contraction.matmul(a.value, b.value), [(a, lambda g: var_matmul(g, var_transpose(b))), (b, lambda g: var_matmul(var_transpose(a), g))])
def var_matmul_bias_activation(a, b, bias, activation: str = "none") -> Var: return {"none": lambda v: v, "relu": var_relu, "gelu": _gelu, "silu": var_silu, "sigmoid": var_sigmoid, "tanh": var_tanh}[activation](var_add(var_matmul(a, b), bias))


def var_rms_norm(x: Var, weight: Var, eps: float = 1e-5) -> Var:
    return var_mul(var_mul(x, var_recip(var_sqrt(var_add_scalar(var_mean(var_square(x), [-1], True), eps)))), weight)


def var_layer_norm(x: Var, weight: Var, bias: Var, eps: float = 1e-5) -> Var:
    off = var_sub(x, var_mean(x, [-1], True))
    return var_add(var_mul(var_div(off, var_sqrt(var_add_scalar(var_mean(var_square(off), [-1], True), eps))), weight), bias)


def var_group_norm(x: Var, weight: Var, bias: Var, groups: int, eps: float = 1e-5) -> Var:
    n, c, *rest = x.shape
    y = var_reshape(x, (n, groups, c // groups * prod(rest)))
    off = var_sub(y, var_mean(y, [-1], True))
    y = var_reshape(var_div(off, var_sqrt(var_add_scalar(var_mean(var_square(off), [-1], True), eps))), x.shape)
    per = (c, *[1] * len(rest))
    return var_add(var_mul(y, var_reshape(weight, per)), var_reshape(bias, per))


def var_fused_add_rms_norm(x, residual, weight, eps=1e-5) -> tuple[Var, Var]: return (lambda s: (var_rms_norm(s, weight, eps), s))(var_add(x, residual))
def var_fused_add_layer_norm(x, residual, weight, bias, eps=1e-5) -> tuple[Var, Var]: return (lambda s: (var_layer_norm(s, weight, bias, eps), s))(var_add(x, residual))


def var_cumsum(a: Var, d: int) -> Var:
    flip = lambda v: Var(v.value.flip(d), [(v, lambda g: flip(g))])
    return Var(a.value.cumsum(d), [(a, lambda g: flip(var_cumsum(flip(g), d)))])


def var_cumprod(a: Var, d: int) -> Var:
    """For arrays without zeros."""
    out = Var(a.value.cumprod(d))
    flip = lambda v: Var(v.value.flip(d), [(v, lambda g: flip(g))])
    out.parents = [(a, lambda g: var_div(flip(var_cumsum(flip(var_mul(g, out)), d)), a))]
    return out


def var_dropout(a: Var, p: float, seed: int, training: bool = True) -> Var:
    mask = Var(neural.dropout(Tensor(a.value.df.withColumn("v", F.lit(1.0)), a.shape), p, seed, training), [], False)
    return var_mul(a, mask)


def var_gather(a: Var, d: int, index: Tensor) -> Var:
    return Var(indexing.gather(a.value, d, index), [(a, lambda g: Var(indexing.scatter_reduce(a.value.map(lambda v: F.lit(0.0)), d, index, g.value, "sum")))])


def var_embedding_lookup(table: Var, index: Tensor) -> Var:
    def back(g: Var) -> Var:
        at = index.df.select(*(F.col(c).alias(f"x{k}") for k, c in enumerate(index.index)), F.col("v").cast("long").alias("at"))
        rows = g.value.df.join(at, [F.col(f"i{k}") == F.col(f"x{k}") for k in range(index.rank)])
        summed = rows.groupBy(F.col("at").alias("i0"), F.col(f"i{index.rank}").alias("j")).agg(F.sum("v").alias("v")).select("i0", F.col("j").alias("i1"), "v")
        return Var(Tensor(summed.where(F.col("i0").between(0, table.shape[0] - 1)), table.shape).dense(0.0))

    return Var(indexing.embedding_lookup(table.value, index), [(table, back)])


def _matrix(df, part: str, shape) -> Tensor: return Tensor(df.where(F.col("part") == part).select("i0", "i1", F.col("re").alias("v")), shape)
def var_trace(a: Var) -> Var: return var_sum(var_mul(a, Var(Tensor.eye(a.value.df.sparkSession, *a.shape), [], False)))


def var_inverse(a: Var) -> Var:
    out = Var(_matrix(linalg.inverse(linalg.batch(a.value)), "inverse", a.shape))
    out.parents = [(a, lambda g: var_neg(var_matmul(var_matmul(var_transpose(out), g), var_transpose(out))))]
    return out


def var_det(a: Var) -> Var:
    out = Var(Tensor(linalg.det(linalg.batch(a.value)).select(F.col("re").alias("v")), ()))
    out.parents = [(a, lambda g: var_mul(var_mul(_spread(g, a.shape), _spread(out, a.shape)), var_transpose(var_inverse(a))))]
    return out


def var_solve(a: Var, b: Var) -> Var: return var_matmul(var_inverse(a), b)


def var_cholesky(a: Var) -> Var:
    """The gradient is that by the symmetric input."""
    low = _matrix(linalg.cholesky_decompose(linalg.batch(a.value)), "l", a.shape)
    out = Var(low)

    def back(g: Var) -> Var:
        inner = contraction.matmul(low.transpose(), g.value)
        half = Tensor(inner.df.withColumn("v", F.when(F.col("i0") > F.col("i1"), F.col("v")).when(F.col("i0") == F.col("i1"), F.col("v") / 2).otherwise(0.0)), inner.shape)
        inv = _matrix(linalg.inverse(linalg.batch(low)), "inverse", a.shape)
        s = contraction.matmul(contraction.matmul(inv.transpose(), half), inv)
        return Var(s.zip(s.transpose(), lambda x, y: (x + y) / 2))

    out.parents = [(a, back)]
    return out


def var_conv(x: Var, weight: Var, stride: int = 1, padding=None) -> Var:
    """conv1d or conv2d with one group; unfolded windows times the weight, so both gradients come from the parts."""
    n = x.value.rank - 2
    pads = padding or [(0, 0)] * n
    flat = [p for pair in reversed(pads) for p in pair]
    t = x.value.pad(flat) if any(flat) else x.value
    for k in range(n):
        t = t.unfold(2 + k, weight.shape[2 + k], stride)
    spatial, kernel = "pq"[:n], "ij"[:n]
    a, b, o = f"nc{spatial}{kernel}", f"oc{kernel}", f"no{spatial}"
    out = contraction.einsum(f"{a},{b}->{o}", t, weight.value)

    def to_x(g: Var) -> Var:
        windows = contraction.einsum(f"{o},{b}->{a}", g.value, weight.value).df
        cells = windows.select("i0", "i1", *((F.col(f"i{2 + k}") * stride + F.col(f"i{2 + n + k}") - pads[k][0]).alias(f"x{k}") for k in range(n)), "v")
        summed = cells.groupBy("i0", "i1", *(F.col(f"x{k}").alias(f"i{2 + k}") for k in range(n))).agg(F.sum("v").alias("v"))
        inside = Tensor(summed, x.shape)
        for k in range(n):
            inside = Tensor(inside.df.where(F.col(f"i{2 + k}").between(0, x.shape[2 + k] - 1)), x.shape)
        return Var(inside.dense(0.0))

    return Var(out, [(x, to_x), (weight, lambda g: Var(contraction.einsum(f"{a},{o}->{b}", t, g.value)))])


var_conv1d = var_conv2d = var_conv


def checkpoint(f: Callable[..., Var], *inputs: Var) -> Var:
    """f's result without its graph; f runs again in the backward pass. Lineage recomputes in Spark anyway."""
    out = f(*(v.detach() for v in inputs))
    node = Var(out.value)

    def back(k: int):
        def rule(g: Var) -> Var:
            fresh = [Var(v.value) for v in inputs]
            inner = var_sum(var_mul(f(*fresh), g.detach()))
            return Var(backward(inner)[fresh[k]])
        return rule

    node.parents = [(v, back(k)) for k, v in enumerate(inputs)]
    return node


# forward mode: v is a struct of p (value) and t (tangent)

def dual(primal: Tensor, tangent: Tensor | None = None) -> Tensor:
    if tangent is None:
        return primal.map(lambda v: F.struct(v.alias("p"), F.lit(0.0).alias("t")))
    return primal.zip(tangent, lambda p, t: F.struct(p.alias("p"), t.alias("t")))


def primal(d: Tensor) -> Tensor: return d.map(lambda v: v["p"])
def tangent(d: Tensor) -> Tensor: return d.map(lambda v: v["t"])
def _pt(p, t): return F.struct(p.alias("p"), t.alias("t"))
def dual_add(a, b): return a.zip(b, lambda x, y: _pt(x["p"] + y["p"], x["t"] + y["t"]))
def dual_sub(a, b): return a.zip(b, lambda x, y: _pt(x["p"] - y["p"], x["t"] - y["t"]))
def dual_mul(a, b): return a.zip(b, lambda x, y: _pt(x["p"] * y["p"], x["p"] * y["t"] + x["t"] * y["p"]))
def dual_div(a, b): return a.zip(b, lambda x, y: _pt(E.ieee_div(x["p"], y["p"]), E.ieee_div(x["t"] * y["p"] - x["p"] * y["t"], y["p"] * y["p"])))
def _dual_unary(f, prime): return lambda a: a.map(lambda v: _pt(f(v["p"]), v["t"] * prime(v["p"])))


dual_neg = _dual_unary(E.neg, lambda p: F.lit(-1.0))
dual_relu, dual_sigmoid = _dual_unary(E.relu, E.relu_prime), _dual_unary(E.sigmoid, E.sigmoid_prime)
dual_exp, dual_log, dual_sqrt = _dual_unary(E.exp, E.exp), _dual_unary(E.log, E.recip), _dual_unary(E.sqrt, lambda p: 0.5 * E.rsqrt(p))
dual_square, dual_sin, dual_cos = _dual_unary(E.square, lambda p: 2 * p), _dual_unary(E.sin, E.cos), _dual_unary(E.cos, lambda p: -F.sin(p))
dual_tan, dual_tanh = _dual_unary(E.tan, lambda p: 1 + F.tan(p) * F.tan(p)), _dual_unary(E.tanh, lambda p: 1 - F.tanh(p) * F.tanh(p))
dual_recip, dual_abs = _dual_unary(E.recip, lambda p: -E.recip(p) * E.recip(p)), _dual_unary(E.abs_, E.sign)


def dual_add_scalar(a, s): return a.map(lambda v: _pt(v["p"] + s, v["t"]))
def dual_sub_scalar(a, s): return a.map(lambda v: _pt(v["p"] - s, v["t"]))
def dual_mul_scalar(a, s): return a.map(lambda v: _pt(v["p"] * s, v["t"] * s))
def dual_div_scalar(a, s): return dual_mul_scalar(a, 1 / s)
def dual_pow_scalar(a, s): return a.map(lambda v: _pt(F.pow(v["p"], F.lit(float(s))), v["t"] * s * F.pow(v["p"], F.lit(s - 1.0))))
def dual_sum(a, dims=(), keepdim=False): return a.aggregate(_pt(F.sum("v.p"), F.sum("v.t")), dims, keepdim)
def dual_mean(a, dims=(), keepdim=False): return a.aggregate(_pt(F.avg("v.p"), F.avg("v.t")), dims, keepdim)


def dual_matmul(a: Tensor, b: Tensor) -> Tensor:
    left = a.df.select("i0", F.col("i1").alias("k"), F.col("v").alias("x"))
    met = left.join(b.df.select(F.col("i0").alias("k"), "i1", F.col("v").alias("y")), "k")
    return Tensor(met.groupBy("i0", "i1").agg(_pt(F.sum(F.col("x.p") * F.col("y.p")), F.sum(F.col("x.p") * F.col("y.t") + F.col("x.t") * F.col("y.p"))).alias("v")), (a.shape[0], b.shape[1]))


def dual_reshape(a, shape): return a.reshape(shape)
def dual_transpose(a, x=-2, y=-1): return a.transpose(x, y)
def dual_narrow(a, d, start, length): return a.narrow(d, start, length)
def dual_unsqueeze(a, d): return a.unsqueeze(d)
def dual_squeeze(a, d=None): return a.squeeze(d)
def dual_permute(a, dims): return a.permute(dims)
def dual_contiguous(a): return a


def jvp(f: Callable[..., Tensor], primals: Sequence[Tensor], tangents: Sequence[Tensor]) -> tuple[Tensor, Tensor]:
    out = f(*(dual(p, t) for p, t in zip(primals, tangents, strict=True)))
    return primal(out), tangent(out)


def jvp_multi(f, primals, tangents) -> tuple[list[Tensor], list[Tensor]]:
    outs = f(*(dual(p, t) for p, t in zip(primals, tangents, strict=True)))
    return [primal(o) for o in outs], [tangent(o) for o in outs]


def jacobian_forward(f: Callable[[Tensor], Tensor], x: Tensor) -> Tensor:
    """Output index by input index, for a short vector x: a pass per input."""
    spark, n = x.df.sparkSession, x.shape[0]
    columns = []
    for k in range(n):
        one = Tensor(spark.range(n).select(F.col("id").alias("i0"), (F.col("id") == k).cast("double").alias("v")), (n,))
        columns.append(jvp(f, [x], [one])[1])
    from tabulon.plans.tensor import stack

    return stack(columns, 1)


def hvp(grad_f: Callable[[Tensor], Tensor], x: Tensor, v: Tensor) -> Tensor:
    """Hessian by vector, from the gradient written on dual arrays."""
    return jvp(grad_f, [x], [v])[1]
