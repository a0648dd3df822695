"""Softmax, normalizations and convolutions as windows, joins and aggregates."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions import elementwise as E
from tabulon.plans.tensor import ShapeError, Tensor


def _slice(t: Tensor, d: int):
    return W.partitionBy(*[f"i{k}" for k in range(t.rank) if k != t.dim(d)] or [F.lit(0)])


def softmax(t: Tensor, d: int = -1) -> Tensor:
    w = _slice(t, d)
    rows = t.df.withColumn("v", F.exp(F.col("v") - F.max("v").over(w)))
    return Tensor(rows.withColumn("v", F.col("v") / F.sum("v").over(w)), t.shape)


def log_softmax(t: Tensor, d: int = -1) -> Tensor:
    w = _slice(t, d)
    rows = t.df.withColumn("v", F.col("v") - F.max("v").over(w))
    return Tensor(rows.withColumn("v", F.col("v") - F.ln(F.sum(F.exp("v")).over(w))), t.shape)


def softmax_bwd(grad: Tensor, output: Tensor, d: int = -1) -> Tensor:
    """y * (g - sum of g * y over the slice)."""
    pair = grad.zip(output, lambda g, y: F.struct(g.alias("g"), y.alias("y")))
    w = _slice(pair, d)
    return Tensor(pair.df.withColumn("v", F.col("v.y") * (F.col("v.g") - F.sum(F.col("v.g") * F.col("v.y")).over(w))), pair.shape)


def softmax_with_bias(t: Tensor, bias: Tensor, d: int = -1) -> Tensor: return softmax(t.zip(bias, lambda a, b: a + b), d)


def rms_norm(t: Tensor, weight: Tensor, eps: float = 1e-5) -> Tensor:
    w = _slice(t, -1)
    return Tensor(t.df.withColumn("v", F.col("v") / F.sqrt(F.avg(F.col("v") * F.col("v")).over(w) + eps)), t.shape).zip(weight, lambda a, b: a * b)


def _normal(t: Tensor, w, eps: float) -> Tensor:
    return Tensor(t.df.withColumn("v", (F.col("v") - F.avg("v").over(w)) / F.sqrt(F.var_pop("v").over(w) + eps)), t.shape)


def layer_norm(t: Tensor, weight: Tensor, bias: Tensor, eps: float = 1e-5) -> Tensor:
    return _normal(t, _slice(t, -1), eps).zip(weight, lambda a, b: a * b).zip(bias, lambda a, b: a + b)


def group_norm(t: Tensor, weight: Tensor, bias: Tensor, groups: int, eps: float = 1e-5) -> Tensor:
    """t is batch x channels x ...; each group of channels of a batch element is normalized."""
    if t.shape[1] % groups:
        raise ShapeError("channels must divide by groups")
    w = W.partitionBy("i0", F.expr(f"i1 div {t.shape[1] // groups}"))
    per_channel = lambda x: x.reshape([t.shape[1], *[1] * (t.rank - 2)])
    return _normal(t, w, eps).zip(per_channel(weight), lambda a, b: a * b).zip(per_channel(bias), lambda a, b: a + b)


def fused_add_rms_norm(x: Tensor, residual: Tensor, weight: Tensor, eps: float = 1e-5) -> tuple[Tensor, Tensor]:
    """(normalized, sum before the norm)."""
    before = x.zip(residual, lambda a, b: a + b)
    return rms_norm(before, weight, eps), before


def fused_add_layer_norm(x, residual, weight, bias, eps: float = 1e-5) -> tuple[Tensor, Tensor]:
    before = x.zip(residual, lambda a, b: a + b)
    return layer_norm(before, weight, bias, eps), before


def fused_add_rms_norm_bwd(grad: Tensor, before: Tensor, weight: Tensor, eps: float = 1e-5) -> tuple[Tensor, Tensor]:
    """Gradients by the input (and so by the residual) and by the weight."""
    pair = before.zip(weight, lambda x, w: F.struct(x.alias("x"), w.alias("w"))).zip(grad, lambda p, g: F.struct(p["x"].alias("x"), p["w"].alias("w"), g.alias("g")))
    w = _slice(pair, -1)
    r = F.pow(F.avg(F.col("v.x") * F.col("v.x")).over(w) + eps, F.lit(-0.5))
    dot = F.avg(F.col("v.g") * F.col("v.w") * F.col("v.x")).over(w)
    dx = Tensor(pair.df.withColumn("v", r * F.col("v.g") * F.col("v.w") - F.col("v.x") * r * r * r * dot), pair.shape)
    dw = Tensor(pair.df.withColumn("v", F.col("v.g") * F.col("v.x") * r), pair.shape).sum(list(range(pair.rank - 1)))
    return dx, dw


def fused_add_layer_norm_bwd(grad: Tensor, before: Tensor, weight: Tensor, bias: Tensor, eps: float = 1e-5) -> tuple[Tensor, Tensor, Tensor]:
    """Gradients by the input, the weight and the bias."""
    hat = _normal(before, _slice(before, -1), eps)
    w0 = _slice(before, -1)
    scale = Tensor(before.df.withColumn("v", F.pow(F.var_pop("v").over(w0) + eps, F.lit(-0.5))), before.shape)
    triple = hat.zip(scale, lambda h, s: F.struct(h.alias("h"), s.alias("s"))).zip(grad, lambda p, g: F.struct(p["h"].alias("h"), p["s"].alias("s"), g.alias("g"))).zip(weight, lambda p, w: F.struct(p["h"].alias("h"), p["s"].alias("s"), p["g"].alias("g"), (p["g"] * w).alias("gw")))
    w = _slice(triple, -1)
    dx = F.col("v.s") * (F.col("v.gw") - F.avg("v.gw").over(w) - F.col("v.h") * F.avg(F.col("v.gw") * F.col("v.h")).over(w))
    rest = list(range(before.rank - 1))
    return Tensor(triple.df.withColumn("v", dx), before.shape), triple.map(lambda p: p["g"] * p["h"]).sum(rest), grad.sum(rest)


def _pads(padding, kernel: tuple[int, ...], dilation: tuple[int, ...]) -> list[tuple[int, int]]:
    if padding == "valid":
        return [(0, 0)] * len(kernel)
    if padding == "same":
        total = [(k - 1) * d for k, d in zip(kernel, dilation, strict=True)]
        return [(t // 2, t - t // 2) for t in total]
    return list(padding)


def conv(x: Tensor, weight: Tensor, bias: Tensor | None = None, stride=1, padding="valid", dilation=1, groups: int = 1) -> Tensor:
    """Convolution over any number of spatial dimensions; x: batch x channels x ..., weight: out x channels / groups x ....

    Every input cell goes to the output places its taps reach: the taps are the weight's rows, joined on the channel, so no range join is needed.
    """
    n = x.rank - 2
    stride, dilation = ((s,) * n if isinstance(s, int) else tuple(s) for s in (stride, dilation))
    kernel, (out_channels, per) = weight.shape[2:], weight.shape[:2]
    if x.shape[1] != per * groups or out_channels % groups:
        raise ShapeError("channels and groups do not fit")
    pads = _pads(padding, kernel, dilation)
    size = [(x.shape[2 + k] + sum(pads[k]) - dilation[k] * (kernel[k] - 1) - 1) // stride[k] + 1 for k in range(n)]
    taps = weight.df.select(F.col("i0").alias("o"), (F.expr(f"i0 div {out_channels // groups}") * per + F.col("i1")).alias("c"), *(F.col(f"i{2 + k}").alias(f"k{k}") for k in range(n)), F.col("v").alias("w"))
    met = x.df.withColumnRenamed("i1", "c").join(taps, "c")
    for k in range(n):
        met = met.withColumn(f"p{k}", F.col(f"i{2 + k}") + pads[k][0] - F.col(f"k{k}") * dilation[k])
        met = met.where((F.col(f"p{k}") >= 0) & (F.col(f"p{k}") % stride[k] == 0) & (F.col(f"p{k}") < size[k] * stride[k])).withColumn(f"p{k}", F.expr(f"p{k} div {stride[k]}"))
    out = met.groupBy("i0", "o", *(f"p{k}" for k in range(n))).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    t = Tensor(out.select("i0", F.col("o").alias("i1"), *(F.col(f"p{k}").alias(f"i{2 + k}") for k in range(n)), "v"), (x.shape[0], out_channels, *size))
    return t.zip(bias.reshape([out_channels, *[1] * n]), lambda a, b: a + b) if bias is not None else t


conv1d = conv2d = conv


def depthwise_conv2d(x: Tensor, weight: Tensor, bias=None, stride=1, padding="valid", dilation=1) -> Tensor: return conv(x, weight, bias, stride, padding, dilation, groups=x.shape[1])


def conv_transpose1d(x: Tensor, weight: Tensor, bias=None, stride: int = 1, padding: tuple[int, int] = (0, 0), output_padding: int = 0, dilation: int = 1, groups: int = 1) -> Tensor:
    """Scatter-add of each input cell over its taps; weight: channels x out / groups x kernel."""
    per_out, kernel = weight.shape[1], weight.shape[2]
    per_in = x.shape[1] // groups
    size = (x.shape[2] - 1) * stride - sum(padding) + dilation * (kernel - 1) + output_padding + 1
    taps = weight.df.select(F.col("i0").alias("c"), (F.expr(f"i0 div {per_in}") * per_out + F.col("i1")).alias("o"), F.col("i2").alias("k"), F.col("v").alias("w"))
    met = x.df.withColumnRenamed("i1", "c").join(taps, "c").withColumn("p", F.col("i2") * stride - padding[0] + F.col("k") * dilation).where(F.col("p").between(0, size - 1))
    out = met.groupBy("i0", F.col("o").alias("i1"), F.col("p").alias("i2")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    t = Tensor(out, (x.shape[0], per_out * groups, size)).dense(0.0)
    return t.zip(bias.reshape([per_out * groups, 1]), lambda a, b: a + b) if bias is not None else t


def dropout(t: Tensor, p: float, seed: int, training: bool = True) -> Tensor:
    return Tensor(t.df.withColumn("v", E.dropout(F.col("v"), p, seed, *t.index, training=training)), t.shape)
