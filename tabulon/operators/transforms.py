"""Fourier transforms of rows by Arrow-batched NumPy, shifts and frequencies as index expressions, and polynomials."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.plans.tensor import ShapeError, Tensor

NORMS = {"none": "backward", "backward": "backward", "ortho": "ortho", "forward": "forward"}
COMPLEX = "array<struct<re:double,im:double>>"


def _power_of_two(n: int) -> None:
    if n < 1 or n & (n - 1):
        raise ShapeError("lengths must be powers of two")


def _read(column) -> list[np.ndarray]:
    """Rows of (re, im) structs or of numbers."""
    flat, bounds = column.flatten(), column.offsets.to_numpy()
    bounds = bounds - bounds[0]
    x = flat.field("re").to_numpy(zero_copy_only=False) + 1j * flat.field("im").to_numpy(zero_copy_only=False) if pa.types.is_struct(flat.type) else flat.to_numpy(zero_copy_only=False).astype(float)
    return [x[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def _write(rows: list[np.ndarray]):
    flat = np.concatenate(rows) if rows else np.empty(0)
    bounds = pa.array(np.r_[0, np.cumsum([len(r) for r in rows])].astype(np.int32))
    if np.iscomplexobj(flat):
        return pa.ListArray.from_arrays(bounds, pa.StructArray.from_arrays([pa.array(flat.real.copy()), pa.array(flat.imag.copy())], ["re", "im"]))
    return pa.ListArray.from_arrays(bounds, pa.array(flat.astype(float)))


def _by_row(rows: DataFrame, f, real: bool = False) -> DataFrame:
    """f of each row vector; rows: i and vec."""
    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), _write([f(x) for x in _read(batch.column(1))])], ["i", "vec"])

    return rows.select("i", "vec").mapInArrow(run, f"i long, vec {'array<double>' if real else COMPLEX}")


def fft(rows: DataFrame, n: int, inverse: bool = False, norm: str = "backward") -> DataFrame:
    """Transform of each row (i, vec of n numbers or complex structs); `none` scales neither way."""
    _power_of_two(n)
    if norm == "none" and inverse:
        return _by_row(rows, lambda x: np.fft.ifft(x, norm="forward"))
    return _by_row(rows, lambda x: (np.fft.ifft if inverse else np.fft.fft)(x, norm=NORMS[norm]).astype(complex))


def rfft(rows: DataFrame, n: int, norm: str = "backward") -> DataFrame:
    _power_of_two(n)
    return _by_row(rows, lambda x: np.fft.rfft(x, norm=NORMS[norm]))


def irfft(rows: DataFrame, n: int, norm: str = "backward") -> DataFrame:
    return _by_row(rows, lambda x: np.fft.irfft(x, n, norm=NORMS[norm]), real=True)


def to_rows(t: Tensor, d: int = -1) -> tuple[DataFrame, list[str]]:
    """Slices along d as row vectors i (their flat place among the others), vec."""
    d = t.dim(d)
    others = [k for k in range(t.rank) if k != d]
    place = F.lit(0).cast("long")
    for k in others:
        place = place * t.shape[k] + F.col(f"i{k}")
    rows = t.df.groupBy(place.alias("i")).agg(F.sort_array(F.collect_list(F.struct(F.col(f"i{d}").alias("j"), "v"))).alias("l"))
    return rows.select("i", F.transform("l", lambda e: e["v"]).alias("vec")), [f"i{k}" for k in others]


def from_rows(rows: DataFrame, t: Tensor, d: int, n: int) -> Tensor:
    """The other way: values v are what the row vectors hold."""
    d = t.dim(d)
    others = [k for k in range(t.rank) if k != d]
    out = rows.select("i", F.posexplode("vec").alias("j", "v"))
    stride, index = 1, {}
    for k in reversed(others):
        index[k] = F.expr(f"(i div {stride}L) % {t.shape[k]}L")
        stride *= t.shape[k]
    shape = tuple(n if k == d else m for k, m in enumerate(t.shape))
    return Tensor(out.select(*((F.col("j").cast("long") if k == d else index[k]).alias(f"i{k}") for k in range(t.rank)), "v"), shape)


def fft_dim(t: Tensor, d: int = -1, inverse: bool = False, norm: str = "backward") -> Tensor:
    n = t.shape[t.dim(d)]
    return from_rows(fft(to_rows(t, d)[0], n, inverse, norm), t, d, n)


def fft2(t: Tensor, inverse: bool = False, norm: str = "backward") -> Tensor: return fft_dim(fft_dim(t, -1, inverse, norm), -2, inverse, norm)


def rfft2(t: Tensor, norm: str = "backward") -> Tensor:
    n = t.shape[-1]
    return fft_dim(from_rows(rfft(to_rows(t, -1)[0], n, norm), t, -1, n // 2 + 1), -2, False, norm)


def irfft2(t: Tensor, n: int, norm: str = "backward") -> Tensor:
    first = fft_dim(t, -2, True, norm)
    return from_rows(irfft(to_rows(first, -1)[0], n, norm), first, -1, n)


def fftshift(t: Tensor, d: int = -1) -> Tensor: return t.roll(t.shape[t.dim(d)] // 2, d)
def ifftshift(t: Tensor, d: int = -1) -> Tensor: return t.roll(-(t.shape[t.dim(d)] // 2), d)


def fftfreq(spark: SparkSession, n: int, step: float = 1.0) -> Tensor:
    return Tensor.generate(spark, (n,), lambda i: (F.when(i < (n + 1) // 2, i).otherwise(i - n)) / (n * step))


def rfftfreq(spark: SparkSession, n: int, step: float = 1.0) -> Tensor: return Tensor.generate(spark, (n // 2 + 1,), lambda i: i / (n * step))


# polynomials: coefficients in ascending order

def polymul(a: Tensor, b: Tensor) -> Tensor:
    """Coefficients meet by the power they make."""
    right = b.df.select(F.col("i0").alias("j"), F.col("v").alias("w"))
    out = a.df.crossJoin(right).groupBy((F.col("i0") + F.col("j")).alias("i0")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return Tensor(out, (a.shape[0] + b.shape[0] - 1,))


convolve = polymul


def polyroots(rows: DataFrame) -> DataFrame:
    """Complex roots of each row of coefficients (i, vec), by companion matrices; the leading coefficient must not be zero."""
    def roots(c):
        n = len(c) - 1
        if n < 1:
            return np.empty(0, complex)
        m = np.eye(n, k=-1)
        m[:, -1] -= c[:-1] / c[-1]
        return np.linalg.eigvals(m).astype(complex)

    return _by_row(rows, roots)


def polyfromroots(rows: DataFrame) -> DataFrame:
    """Ascending real coefficients of the monic polynomials with the roots of each row (conjugate pairs)."""
    def build(r):
        c = np.ones(1, complex)
        for x in r:
            c = np.r_[0, c] - x * np.r_[c, 0]
        return c.real

    return _by_row(rows, build, real=True)
