"""Matrix products, Einstein notation and semiring products: an equi-join on the shared index and a grouped aggregate, or packed blocks for dense matrices."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabulon.functions import elementwise as E
from tabulon.plans.tensor import ShapeError, Tensor

#: Side of a block, the products from which dense matrices go by blocks, and the blocks that one task adds up.
SIDE, DENSE, FAN = 512, 20_000_000, 32

SEMIRINGS = {
    "plus_times": (F.sum, lambda a, b: a * b),
    "min_plus": (F.min, lambda a, b: a + b),
    "max_plus": (F.max, lambda a, b: a + b),
    "max_min": (F.max, F.least),
    "min_max": (F.min, F.greatest),
    "or_and": (F.max, lambda a, b: ((a != 0) & (b != 0)).cast("double")),
    "plus_max": (F.sum, F.greatest),
}


def semiring_matmul(a: Tensor, b: Tensor, op: str = "plus_times") -> Tensor:
    """Product of matrices under a semiring; cells with no common index are missing (sparse) or, for full operands, absent by none."""
    if a.shape[1] != b.shape[0]:
        raise ShapeError(f"{a.shape} by {b.shape}")
    reduce, times = SEMIRINGS[op]
    left = a.df.select("i0", F.col("i1").alias("k"), F.col("v").alias("va"))
    right = b.df.select(F.col("i0").alias("k"), "i1", F.col("v").alias("vb"))
    out = left.join(right, "k").groupBy("i0", "i1").agg(reduce(times(F.col("va"), F.col("vb"))).alias("v"))
    return Tensor(out, (a.shape[0], b.shape[1]))


def _blocks(t: Tensor, rows: str, cols: str, side: int, width: int | None = None) -> DataFrame:
    """Dense blocks of side rows and width columns (None: side) as packed doubles, row-major, with zeros where the matrix has none; one block a batch."""
    width = width or side
    cells = t.df.groupBy(F.expr(f"i0 div {side}").alias(rows), F.expr(f"i1 div {width}").alias(cols)).agg(F.collect_list(F.struct((F.expr(f"(i0 % {side}) * {width} + i1 % {width}")).cast("int").alias("at"), "v")).alias("cells"))

    def pack(batches):
        for batch in batches:
            lists = batch.column(2)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            at, v = flat.field("at").to_numpy(), flat.field("v").to_numpy(zero_copy_only=False)
            for k, (x, y) in enumerate(zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True)):
                m = np.zeros(side * width)
                m[at[x:y]] = v[x:y]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(k, 1), batch.column(1).slice(k, 1), pa.array([m.tobytes()], pa.binary())], [rows, cols, "m"])

    return cells.mapInArrow(pack, f"{rows} long, {cols} long, m binary")


def block_matmul(a: Tensor, b: Tensor, side: int = SIDE) -> Tensor:
    """Dense product by blocks, no larger than the matrices: block rows and block columns meet in a join, products are summed per result block, FAN at a time."""
    height, inner, width = a.shape[0], a.shape[1], b.shape[1]
    high, deep, wide = (max(1, min(side, n)) for n in (height, inner, width))
    left, right = _blocks(a, "r", "k", high, deep), _blocks(b, "k", "c", deep, wide).withColumnRenamed("m", "n")
    met = left.join(right, "k").select("r", "c", "k", "m", "n")

    def multiply(batches):
        for batch in batches:
            for i in range(batch.num_rows):
                x, y = (np.frombuffer(batch.column(c)[i].as_buffer()).reshape(shape) for c, shape in ((3, (high, deep)), (4, (deep, wide))))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, 1) for c in range(3)), pa.array([(x @ y).tobytes()], pa.binary())], ["r", "c", "k", "m"])

    def total(table) -> np.ndarray:
        out = np.zeros(high * wide)
        for m in table.column("m"):
            out += np.frombuffer(m.as_buffer())
        return out

    def some(key, table):
        return pa.table({**{c: [key[i].as_py()] for i, c in enumerate("rck")}, "m": pa.array([total(table).tobytes()], pa.binary())})

    def add(key, table):
        i, j = np.indices((high, wide)).reshape(2, -1)
        i, j, v = key[0].as_py() * high + i, key[1].as_py() * wide + j, total(table)
        kept = (i < height) & (j < width)
        return pa.table({"i0": i[kept], "i1": j[kept], "v": v[kept]})

    summed, depth = met.mapInArrow(multiply, "r long, c long, k long, m binary"), -(-inner // deep)
    while depth > FAN:
        summed = summed.withColumn("k", F.expr(f"k div {FAN}")).groupBy("r", "c", "k").applyInArrow(some, "r long, c long, k long, m binary")
        depth = -(-depth // FAN)
    return Tensor(summed.groupBy("r", "c").applyInArrow(add, "i0 long, i1 long, v double"), (height, width))


def matmul(a: Tensor, b: Tensor) -> Tensor:
    """Product over the last dimension of a and the last but one of b; earlier dimensions broadcast."""
    if a.rank == 2 and b.rank == 2:
        if a.shape[1] != b.shape[0]:
            raise ShapeError(f"{a.shape} by {b.shape}")
        if a.shape[0] * a.shape[1] * b.shape[1] >= DENSE:
            return block_matmul(a, b)
        return semiring_matmul(a, b)
    n = max(a.rank, b.rank) - 2
    product = a.unsqueeze(a.rank).zip(b.unsqueeze(b.rank - 2), lambda x, y: x * y)
    return product.sum([n + 1])


tiled_matmul = block_matmul


def matmul_bias(a: Tensor, b: Tensor, bias: Tensor) -> Tensor: return matmul(a, b).zip(bias, lambda x, y: x + y)


def matmul_bias_activation(a, b, bias, activation: str = "none") -> Tensor: return matmul_bias(a, b, bias).map(E.ACTIVATIONS[activation][0])
def matmul_bias_residual(a, b, bias, residual: Tensor) -> Tensor: return matmul_bias(a, b, bias).zip(residual, lambda x, y: x + y)


def matmul_bias_activation_bwd(grad: Tensor, a: Tensor, b: Tensor, bias: Tensor, activation: str = "none") -> tuple[Tensor, Tensor, Tensor]:
    """Gradients by a, b and bias."""
    inner = grad.zip(matmul_bias(a, b, bias).map(E.ACTIVATIONS[activation][1]), lambda g, p: g * p)
    return matmul(inner, b.transpose(0, 1)), matmul(a.transpose(0, 1), inner), inner.sum([0])


# Einstein notation

def parse_einsum(notation: str, ranks: list[int]) -> tuple[list[str], str]:
    text = notation.replace(" ", "")
    inputs, arrow, out = text.partition("->")
    terms = inputs.split(",")
    if not all(re.fullmatch("[a-z]*", x) for x in (*terms, out)) or len(terms) != len(ranks):
        raise ShapeError(f"cannot read {notation!r}")
    if any(len(x) != n for x, n in zip(terms, ranks, strict=True)):
        raise ShapeError("labels do not fit the dimensions")
    if not arrow:
        out = "".join(sorted(c for c in set(inputs) - {","} if inputs.count(c) == 1))
    if len(set(out)) != len(out) or set(out) - set(inputs):
        raise ShapeError("output labels must be distinct input labels")
    return terms, out


def einsum(notation: str, *tensors: Tensor) -> Tensor:
    """Shared labels are join keys, labels not needed any more are summed at once; repeated labels of one input take its diagonal.

    Operands are joined from the smallest intermediate on.
    """
    terms, out = parse_einsum(notation, [t.rank for t in tensors])
    size: dict[str, int] = {}
    parts = []
    for labels, t in zip(terms, tensors, strict=True):
        for c, n in zip(labels, t.shape, strict=True):
            if size.setdefault(c, n) != n:
                raise ShapeError(f"label {c} has sizes {size[c]} and {n}")
        rows = t.df
        for k, c in enumerate(labels):
            if labels.index(c) != k:
                rows = rows.where(F.col(f"i{k}") == F.col(f"i{labels.index(c)}"))
        seen = sorted(set(labels))
        parts.append((seen, rows.select(*(F.col(f"i{labels.index(c)}").alias(c) for c in seen), F.col("v"))))

    def reduced(labels, rows, others):
        needed = [c for c in labels if c in out or any(c in o for o in others)]
        return (needed, rows.groupBy(*needed).agg(F.sum("v").alias("v"))) if len(needed) < len(labels) else (labels, rows)

    def cells(x, y):
        n = 1
        for c in {*x[0], *y[0]}:
            n *= size[c]
        return n

    parts = [reduced(labels, rows, [p[0] for j, p in enumerate(parts) if j != i]) for i, (labels, rows) in enumerate(parts)]
    while len(parts) > 1:
        i, j = min(((i, j) for i in range(len(parts)) for j in range(i)), key=lambda ij: (not set(parts[ij[0]][0]) & set(parts[ij[1]][0]), cells(parts[ij[0]], parts[ij[1]])))
        (x, left), (y, right) = parts[i], parts[j]
        rest = [p for k, p in enumerate(parts) if k not in (i, j)]
        shared = sorted(set(x) & set(y))
        right = right.withColumnRenamed("v", "w")
        met = left.join(right, shared) if shared else left.crossJoin(right)
        labels = sorted({*x, *y})
        rest.append(reduced(labels, met.select(*labels, (F.col("v") * F.col("w")).alias("v")), [p[0] for p in rest]))
        parts = rest
    labels, rows = parts[0]
    return Tensor(rows.select(*(F.col(c).alias(f"i{k}") for k, c in enumerate(out)), "v"), tuple(size[c] for c in out))


# 8-bit floats: codes as whole numbers, decoded by a 256-row table

def fp8_value(code: int, exponent: int, mantissa: int, bias: int, inf: bool) -> float:
    sign = -1.0 if code >> 7 else 1.0
    e, m = (code >> mantissa) & ((1 << exponent) - 1), code & ((1 << mantissa) - 1)
    top = (1 << exponent) - 1
    if e == top and inf:
        return sign * float("inf") if m == 0 else float("nan")
    if e == top and m == (1 << mantissa) - 1 and not inf:
        return float("nan")
    return sign * (2.0 ** (1 - bias) * m / 2**mantissa if e == 0 else 2.0 ** (e - bias) * (1 + m / 2**mantissa))


FORMATS = {"e4m3": (4, 3, 7, False), "e5m2": (5, 2, 15, True)}


def fp8_decode(t: Tensor, kind: str) -> Tensor:
    """Values of 8-bit codes."""
    table = F.array(*(F.lit(fp8_value(c, *FORMATS[kind])) for c in range(256)))
    return t.map(lambda v: F.element_at(table, v.cast("int") + 1))


def fp8_encode(v: Column, kind: str) -> Column:
    """The code of the nearest finite value; beyond the largest, the largest."""
    exponent, mantissa, bias, inf = FORMATS[kind]
    most = max(x for c in range(128) if (x := fp8_value(c, *FORMATS[kind])) < float("inf"))
    size = F.least(F.abs(v), F.lit(most))
    e = F.greatest(F.floor(F.log2(size)), F.lit(1 - bias))
    step = F.pow(F.lit(2.0), e - mantissa)
    near = F.rint(F.try_divide(size, step)) * step
    e = F.greatest(F.floor(F.log2(near)), F.lit(1 - bias))
    code = F.when(near < 2.0 ** (1 - bias), F.rint(near / 2.0 ** (1 - bias - mantissa))).otherwise((e + bias) * 2**mantissa + F.rint((F.try_divide(near, F.pow(F.lit(2.0), e.cast("double"))) - 1) * 2**mantissa))
    return F.when(F.isnan(v), 127).otherwise(F.when(near == 0, 0).otherwise(code).cast("int") + F.when(v < 0, 128).otherwise(0)).cast("int")


def fp8_matmul(a: Tensor, b: Tensor, scale_a: float = 1.0, scale_b: float = 1.0) -> Tensor: return matmul(fp8_decode(a, "e4m3"), fp8_decode(b, "e4m3")).map(lambda v: v * (scale_a * scale_b))
def fp8_matmul_e5m2(a: Tensor, b: Tensor, scale_a: float = 1.0, scale_b: float = 1.0) -> Tensor: return matmul(fp8_decode(a, "e5m2"), fp8_decode(b, "e4m3")).map(lambda v: v * (scale_a * scale_b))


# 2:4 sparsity

def prune_to_24(t: Tensor) -> Tensor:
    """Of every four neighbours in a row, the two of largest magnitude (the first of equals); the others are left out."""
    from pyspark.sql import Window as W

    w = W.partitionBy("i0", F.expr("i1 div 4")).orderBy(F.desc(F.abs("v")), "i1")
    return Tensor(t.df.withColumn("r", F.row_number().over(w)).where("r <= 2").drop("r"), t.shape)


def sparse_24_to_dense(t: Tensor) -> Tensor: return t.dense(0.0)


def sparse_24_matmul(x: Tensor, weight: Tensor) -> Tensor:
    """x by the transposed pruned weight (out x in)."""
    return semiring_matmul(x, weight.transpose(0, 1)).dense(0.0)
