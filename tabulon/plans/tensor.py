"""An n-dimensional array as a DataFrame of index columns i0, i1, ... (long) and a value column v. Shapes are checked before any job runs."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass
from math import ceil, prod

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions import elementwise as E

#: Cells of a run that a window holds at once; longer runs are scanned in parts.
RUN = 65_536
#: Cells up to which the smaller side of a broadcast operation is broadcast.
SMALL = 1_000_000


class ShapeError(ValueError):
    """Shapes or dimensions do not fit."""


def names(n: int) -> list[str]:
    return [f"i{k}" for k in range(n)]


@dataclass(frozen=True)
class Tensor:
    df: DataFrame
    shape: tuple[int, ...]

    # -- making

    @staticmethod
    def from_slice(spark: SparkSession, data: Sequence[float], shape: Sequence[int]) -> Tensor:
        shape = tuple(shape)
        if len(data) != prod(shape):
            raise ShapeError(f"{len(data)} values for shape {shape}")
        flat = spark.createDataFrame([(i, None if x is None else float(x)) for i, x in enumerate(data)], "i0 long, v double")
        return Tensor(flat, (len(data),)).reshape(shape)

    @staticmethod
    def generate(spark: SparkSession, shape: Sequence[int], value: Callable[[Column], Column]) -> Tensor:
        """value maps the flat index to the value."""
        n = prod(shape)
        return Tensor(spark.range(n).select(F.col("id").alias("i0"), value(F.col("id")).alias("v")), (n,)).reshape(tuple(shape))

    @staticmethod
    def fill(spark, shape, value): return Tensor.generate(spark, shape, lambda i: F.lit(float(value)))
    @staticmethod
    def zeros(spark, shape): return Tensor.fill(spark, shape, 0.0)
    @staticmethod
    def ones(spark, shape): return Tensor.fill(spark, shape, 1.0)
    full_scalar = fill

    @staticmethod
    def arange(spark, start: float, stop: float, step: float = 1.0):
        if step == 0 or (stop - start) * step < 0:
            raise ShapeError("step must lead from start to stop")
        return Tensor.generate(spark, (ceil((stop - start) / step),), lambda i: start + i.cast("double") * step)

    @staticmethod
    def linspace(spark, start: float, stop: float, steps: int):
        return Tensor.generate(spark, (steps,), lambda i: start + i.cast("double") * ((stop - start) / max(steps - 1, 1)))

    @staticmethod
    def eye(spark, n: int, m: int | None = None):
        m = n if m is None else m
        return Tensor.generate(spark, (n, m), lambda i: (F.expr(f"id div {m}") == i % m).cast("double"))

    @staticmethod
    def rows(df: DataFrame, index: str, array: str, n: int, width: int) -> Tensor:
        """A matrix from a table of row vectors."""
        return Tensor(df.select(F.col(index).cast("long").alias("i0"), F.posexplode(array).alias("i1", "v")).select("i0", F.col("i1").cast("long").alias("i1"), F.col("v").cast("double").alias("v")), (n, width))

    # -- reading

    @property
    def rank(self) -> int: return len(self.shape)

    @property
    def index(self) -> list[str]: return names(self.rank)

    def to_vec(self) -> list[float]:
        """All values in row-major order; for small arrays."""
        rows = self.df.orderBy(*self.index) if self.rank else self.df
        return [r[0] for r in rows.select("v").collect()]

    def item(self) -> float:
        if prod(self.shape) != 1:
            raise ShapeError("item() needs one element")
        return self.df.first()["v"]

    def dim(self, d: int) -> int:
        if not -self.rank <= d < self.rank:
            raise ShapeError(f"no dimension {d} in shape {self.shape}")
        return d % self.rank

    def flat(self) -> Column:
        """The row-major index."""
        out = F.lit(0).cast("long")
        for k, n in enumerate(self.shape):
            out = out * n + F.col(f"i{k}")
        return out

    # -- element-wise

    def map(self, f: Callable[[Column], Column]) -> Tensor:
        return Tensor(self.df.select(*self.index, f(F.col("v")).alias("v")), self.shape)

    def unary(self, name: str) -> Tensor: return self.map(E.UNARY[name])
    def scalar(self, name: str, s: float) -> Tensor: return self.map(lambda v: E.SCALAR[name](v, s))

    def zip(self, other: Tensor, f: Callable[[Column, Column], Column]) -> Tensor:
        """f of both with right-aligned broadcasting: a dimension of size 1 is left out of the join's key, so nothing is replicated."""
        n = max(self.rank, other.rank)
        a, b = ((1,) * (n - t.rank) + t.shape for t in (self, other))
        if any(x != y and 1 not in (x, y) for x, y in zip(a, b, strict=True)):
            raise ShapeError(f"{self.shape} and {other.shape} do not broadcast")
        place = lambda t: {n - t.rank + k: k for k in range(t.rank)}
        pa, pb = place(self), place(other)
        keys = [k for k in range(n) if k in pa and k in pb and a[k] == b[k] and (a[k] > 1 or a == b)]
        left = self.df.select(*(F.col(f"i{k}").alias(f"a{d}") for d, k in pa.items()), F.col("v").alias("va"))
        right = other.df.select(*(F.col(f"i{k}").alias(f"b{d}") for d, k in pb.items()), F.col("v").alias("vb"))
        if prod(other.shape) <= SMALL and prod(other.shape) < prod(self.shape):
            right = F.broadcast(right)
        joined = left.join(right, [F.col(f"a{k}") == F.col(f"b{k}") for k in keys]) if keys else left.crossJoin(right)
        index = [(F.col(f"a{k}") if k in pa and (a[k] > 1 or k not in pb) else F.col(f"b{k}") if k in pb else F.lit(0).cast("long")).alias(f"i{k}") for k in range(n)]
        return Tensor(joined.select(*index, f(F.col("va"), F.col("vb")).alias("v")), tuple(max(x, y) if 0 not in (x, y) else 0 for x, y in zip(a, b, strict=True)))

    def binary(self, name: str, other: Tensor) -> Tensor: return self.zip(other, {**E.BINARY, **E.COMPARE, **E.LOGICAL}[name])

    def where_cond(self, x: Tensor, y: Tensor) -> Tensor:
        """x where self is not zero, else y."""
        pair = x.zip(y, lambda a, b: F.struct(a.alias("x"), b.alias("y")))
        return self.zip(pair, lambda c, p: F.when(c != 0, p["x"]).otherwise(p["y"]))

    # -- shape

    def _renamed(self, index: list[Column], shape) -> Tensor:
        return Tensor(self.df.select(*(c.cast("long").alias(f"i{k}") for k, c in enumerate(index)), "v"), tuple(shape))

    def reshape(self, shape: Sequence[int]) -> Tensor:
        shape = tuple(shape)
        if prod(shape) != prod(self.shape):
            raise ShapeError(f"{self.shape} to {shape}")
        rows = self.df.withColumn("_f", self.flat())
        stride, index = prod(shape), []
        for n in shape:
            stride //= max(n, 1)
            index.append(F.expr(f"(_f div {max(stride, 1)}L) % {max(n, 1)}L"))
        return Tensor(rows.select(*(c.alias(f"i{k}") for k, c in enumerate(index)), "v"), shape)

    view = reshape

    def flatten(self) -> Tensor: return self.reshape((prod(self.shape),))

    def permute(self, dims: Sequence[int]) -> Tensor:
        dims = [self.dim(d) for d in dims]
        if sorted(dims) != list(range(self.rank)):
            raise ShapeError(f"{dims} is no permutation")
        return self._renamed([F.col(f"i{d}") for d in dims], [self.shape[d] for d in dims])

    def transpose(self, a: int = -2, b: int = -1) -> Tensor:
        order = list(range(self.rank))
        a, b = self.dim(a), self.dim(b)
        order[a], order[b] = order[b], order[a]
        return self.permute(order)

    def squeeze(self, d: int | None = None) -> Tensor:
        gone = [k for k, n in enumerate(self.shape) if n == 1] if d is None else [self.dim(d)] if self.shape[self.dim(d)] == 1 else []
        kept = [k for k in range(self.rank) if k not in gone]
        return self._renamed([F.col(f"i{k}") for k in kept], [self.shape[k] for k in kept])

    def unsqueeze(self, d: int) -> Tensor:
        d = d % (self.rank + 1)
        index = [F.col(c) for c in self.index]
        return self._renamed([*index[:d], F.lit(0), *index[d:]], [*self.shape[:d], 1, *self.shape[d:]])

    def narrow(self, d: int, start: int, length: int) -> Tensor:
        d = self.dim(d)
        if start < 0 or length < 0 or start + length > self.shape[d]:
            raise ShapeError("range out of bounds")
        kept = Tensor(self.df.where(F.col(f"i{d}").between(start, start + length - 1)), self.shape)
        return kept._moved(d, F.col(f"i{d}") - start, length)

    def _moved(self, d: int, place: Column, size: int) -> Tensor:
        return self._renamed([place if k == d else F.col(f"i{k}") for k in range(self.rank)], [size if k == d else n for k, n in enumerate(self.shape)])

    def flip(self, d: int) -> Tensor:
        d = self.dim(d)
        return self._moved(d, self.shape[d] - 1 - F.col(f"i{d}"), self.shape[d])

    def flip_dims(self, dims: Sequence[int]) -> Tensor:
        out = self
        for d in dims:
            out = out.flip(d)
        return out

    def roll(self, shift: int, d: int) -> Tensor:
        d = self.dim(d)
        return self._moved(d, F.pmod(F.col(f"i{d}") + shift, F.lit(self.shape[d])), self.shape[d])

    def broadcast_to(self, shape: Sequence[int]) -> Tensor:
        return Tensor.zeros(self.df.sparkSession, shape).zip(self, lambda a, b: b)

    def _copied(self, d: int, times: int, place: Callable[[Column, Column], Column]) -> Tensor:
        rows = self.df.withColumn("_k", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(times - 1).cast("long")))) if times else self.df.where("false").withColumn("_k", F.lit(0))
        return Tensor(rows, self.shape)._moved(d, place(F.col(f"i{d}"), F.col("_k")), self.shape[d] * times)

    def repeat(self, repeats: Sequence[int]) -> Tensor:
        out = self
        while out.rank < len(repeats):
            out = out.unsqueeze(0)
        for d, r in enumerate(repeats):
            n = out.shape[d]
            out = out._copied(d, r, lambda i, k, n=n: i + k * n)
        return out

    def repeat_interleave(self, times: int, d: int | None = None) -> Tensor:
        if d is None:
            return self.flatten().repeat_interleave(times, 0)
        return self._copied(self.dim(d), times, lambda i, k: i * times + k)

    def pad(self, padding: Sequence[int], value: float = 0.0) -> Tensor:
        """padding: before and after, in pairs from the last dimension on."""
        shape, out = list(self.shape), self
        for k in range(len(padding) // 2):
            d = self.rank - 1 - k
            before, after = padding[2 * k : 2 * k + 2]
            shape[d] += before + after
            out = out._moved(d, F.col(f"i{d}") + before, shape[d])
        return out.dense(value)

    def dense(self, value: float = 0.0) -> Tensor:
        """All cells of the shape; those that are missing get the value."""
        grid = Tensor.zeros(self.df.sparkSession, self.shape).df.drop("v")
        return Tensor(grid.join(self.df, self.index, "left").withColumn("v", F.coalesce("v", F.lit(float(value)))) if self.rank else self.df, self.shape)

    def unfold(self, d: int, size: int, step: int) -> Tensor:
        """Sliding windows along d; their elements become the last dimension."""
        d, n = self.dim(d), (self.shape[self.dim(d)] - size) // step + 1
        i = F.col(f"i{d}")
        first = F.greatest(F.lit(0).cast("long"), F.ceil((i - (size - 1)) / step))
        last = F.least(F.lit(n - 1).cast("long"), F.floor(i / step))
        rows = self.df.where(first <= last).withColumn("_w", F.explode(F.sequence(first, last)))
        index = [F.col("_w") if k == d else F.col(f"i{k}") for k in range(self.rank)] + [i - F.col("_w") * step]
        return Tensor(rows, self.shape)._renamed(index, [n if k == d else m for k, m in enumerate(self.shape)] + [size])

    def split(self, size: int, d: int = 0) -> list[Tensor]:
        n = self.shape[self.dim(d)]
        return [self.narrow(d, a, min(size, n - a)) for a in range(0, n, size)]

    def chunk(self, chunks: int, d: int = 0) -> list[Tensor]: return self.split(ceil(self.shape[self.dim(d)] / chunks), d)

    def contiguous(self) -> Tensor: return self
    def detach(self) -> Tensor: return self

    # -- reductions

    def _kept(self, dims: Sequence[int]) -> tuple[list[int], list[int]]:
        gone = sorted({self.dim(d) for d in dims}) or list(range(self.rank))
        return gone, [k for k in range(self.rank) if k not in gone]

    def aggregate(self, agg: Column, dims: Sequence[int] = (), keepdim: bool = False) -> Tensor:
        """agg, an aggregate of v, over dims (none: all); partial sums are made before the shuffle."""
        gone, kept = self._kept(dims)
        rows = self.df.groupBy(*(f"i{k}" for k in kept)).agg(agg.alias("v"))
        index, shape, at = [], [], iter(kept)
        if keepdim:
            index, shape = [F.lit(0) if k in gone else F.col(f"i{k}") for k in range(self.rank)], [1 if k in gone else n for k, n in enumerate(self.shape)]
        else:
            index, shape = [F.col(f"i{k}") for k in at], [self.shape[k] for k in kept]
        return Tensor(rows, ())._renamed(index, shape)

    def sum(self, dims=(), keepdim=False): return self.aggregate(F.sum("v"), dims, keepdim)
    def mean(self, dims=(), keepdim=False): return self.aggregate(F.avg("v"), dims, keepdim)
    def max(self, dims=(), keepdim=False): return self.aggregate(F.max("v"), dims, keepdim)
    def min(self, dims=(), keepdim=False): return self.aggregate(F.min("v"), dims, keepdim)
    def prod(self, dims=(), keepdim=False): return self.aggregate(F.product("v"), dims, keepdim)
    def any(self, dims=(), keepdim=False): return self.aggregate(F.max((F.col("v") != 0).cast("double")), dims, keepdim)
    def all(self, dims=(), keepdim=False): return self.aggregate(F.min((F.col("v") != 0).cast("double")), dims, keepdim)

    def with_precision(self, op: str, precision: str, dims=(), keepdim=False) -> Tensor:
        """sum, max, min or prod of values first rounded to f32 or bf16 (f64, native: as they are)."""
        t = self.map(lambda v: E.cast(v, precision).cast("double")) if precision in ("f32", "bf16", "f16") else self
        return getattr(t, op)(dims, keepdim)

    def logsumexp(self, dims=(), keepdim=False) -> Tensor:
        _, kept = self._kept(dims)
        top = self.max(dims, True)
        safe = self.zip(top, lambda v, m: F.struct(F.when(F.abs(m) == E.INF, 0.0).otherwise(F.exp(v - m)).alias("e"), m.alias("m")))
        return safe.aggregate(F.when(F.abs(F.max("v.m")) == E.INF, F.max("v.m")).otherwise(F.max("v.m") + F.ln(F.sum("v.e"))), dims, keepdim)

    def arg(self, d: int, largest: bool, keepdim: bool = False) -> Tensor:
        """Place of the first largest (or least) value along d."""
        d = self.dim(d)
        best = F.min(F.struct((-F.col("v") if largest else F.col("v")).alias("v"), F.col(f"i{d}").alias("i")))
        return self.aggregate(best["i"].cast("double"), [d], keepdim)

    def argmax(self, d, keepdim=False): return self.arg(d, True, keepdim)
    def argmin(self, d, keepdim=False): return self.arg(d, False, keepdim)

    # -- scans

    def scan(self, d: int, agg: Callable[[Column], Column], join: Callable[[Column, Column], Column]) -> Tensor:
        """Running aggregate along d. Runs longer than RUN are scanned in parts, whose totals are scanned and joined to them."""
        d = self.dim(d)
        kept = [f"i{k}" for k in range(self.rank) if k != d]
        if self.shape[d] <= RUN:
            w = W.partitionBy(*kept or [F.lit(0)]).orderBy(f"i{d}").rowsBetween(W.unboundedPreceding, 0)
            return Tensor(self.df.withColumn("v", agg(F.col("v")).over(w)), self.shape)
        rows = self.df.withColumn("_p", F.expr(f"i{d} div {RUN}"))
        within = W.partitionBy(*kept, "_p").orderBy(f"i{d}").rowsBetween(W.unboundedPreceding, 0)
        totals = rows.groupBy(*kept, "_p").agg(agg(F.col("v")).alias("_t"))
        before = W.partitionBy(*kept or [F.lit(0)]).orderBy("_p").rowsBetween(W.unboundedPreceding, -1)
        totals = totals.select(*kept, "_p", agg(F.col("_t")).over(before).alias("_t"))
        done = rows.withColumn("v", agg(F.col("v")).over(within)).join(totals, [*kept, "_p"])
        return Tensor(done.withColumn("v", F.when(F.col("_t").isNull(), F.col("v")).otherwise(join(F.col("_t"), F.col("v")))).drop("_t", "_p"), self.shape)

    def cumsum(self, d): return self.scan(d, F.sum, lambda a, b: a + b)
    def cumprod(self, d): return self.scan(d, F.product, lambda a, b: a * b)


def cat(tensors: Sequence[Tensor], d: int = 0) -> Tensor:
    """UNION ALL with the index on d moved on."""
    d, at, out = tensors[0].dim(d), 0, None
    for t in tensors:
        if any(t.shape[k] != n for k, n in enumerate(tensors[0].shape) if k != d):
            raise ShapeError("all but the joined dimension must be equal")
        part = t._moved(d, F.col(f"i{d}") + at, t.shape[d]).df
        out, at = part if out is None else out.unionByName(part), at + t.shape[d]
    return Tensor(out, tuple(at if k == d else n for k, n in enumerate(tensors[0].shape)))


def stack(tensors: Sequence[Tensor], d: int = 0) -> Tensor: return cat([t.unsqueeze(d) for t in tensors], d)


def meshgrid(axes: Sequence[Tensor], indexing: str = "ij") -> list[Tensor]:
    """Each axis over the grid of all of them."""
    shape = [t.shape[0] for t in axes]
    n = len(axes)
    grids = []
    for k, t in enumerate(axes):
        at = t.reshape([shape[k] if j == k else 1 for j in range(n)])
        grids.append(Tensor.zeros(t.df.sparkSession, shape).zip(at, lambda a, b: b))
    return [g.transpose(0, 1) for g in grids] if indexing == "xy" and n > 1 else grids


def one_hot(t: Tensor, classes: int) -> Tensor:
    rows = t.df.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(classes - 1).cast("long")))).withColumn("v", (F.col("v") == F.col("_c")).cast("double"))
    return Tensor(rows, t.shape)._renamed([*(F.col(c) for c in t.index), F.col("_c")], [*t.shape, classes])
