"""Fourier transform of one long vector (i, re, im): two passes of short transforms with one shuffle between them, so no row or task holds the vector.

With n = n1 n2, i = n2 a + b and k = c + n1 d, the transform is, for every b, one of length n1 over a; a turn of each value by exp(-2 pi i b c / n); and, for
every c, one of length n2 over b. Both passes group a table by one index and transform its groups, many at a time, by radix-2 steps; a group has about the
root of n values. Vectors of more than SHORT**2 values take the second pass by the same two passes again.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import ShapeError

#: Longest transform of one group.
SHORT = 1 << 13


def short_transforms(x: np.ndarray, sign: int = -1) -> np.ndarray:
    """The transforms of the rows of x, whose length is a power of two: halves of growing length are joined in place of one another."""
    rows, n = x.shape
    y = x.astype(complex).reshape(rows, n, 1)
    while y.shape[1] > 1:
        half, done = y.shape[1] // 2, y.shape[2]
        even, odd = y[:, :half], y[:, half:]
        turned = odd * np.exp(sign * 1j * np.pi * np.arange(done) / done)
        y = np.concatenate([even + turned, even - turned], axis=2)
    return y.reshape(rows, n)


def _pass(groups: DataFrame, length: int, sign: int, name: str) -> DataFrame:
    """Transforms of groups (g, cells of at, re, im; missing places are zero): g, the place in the transform as `name`, re, im."""
    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, (1 << 18) // length)):
                piece = batch.slice(at, max(1, (1 << 18) // length))
                g, lists = piece.column(0).to_numpy(), piece.column(1)
                size = np.diff(lists.offsets.to_numpy())
                flat = lists.flatten()
                x = np.zeros((len(g), length), complex)
                x[np.repeat(np.arange(len(g)), size), flat.field("at").to_numpy()] = flat.field("re").to_numpy() + 1j * flat.field("im").to_numpy()
                y = short_transforms(x, sign)
                k = np.tile(np.arange(length), len(g))
                yield pa.RecordBatch.from_arrays([pa.array(np.repeat(g, length)), pa.array(k), pa.array(y.real.ravel()), pa.array(y.imag.ravel())], ["g", name, "re", "im"])

    return groups.mapInArrow(run, f"g long, {name} long, re double, im double")


def _grouped(df: DataFrame, g, at) -> DataFrame:
    return df.groupBy(g.cast("long").alias("g")).agg(F.collect_list(F.struct(at.cast("long").alias("at"), F.col("re").cast("double").alias("re"), F.col("im").cast("double").alias("im"))).alias("cells"))


def _transform(scratch: Scratch, df: DataFrame, n: int, sign: int) -> DataFrame:
    """df: any keys in `key`, i, re, im of vectors of n values; the same with k for i."""
    bits = n.bit_length() - 1
    n1 = min(1 << (bits // 2), SHORT)
    n2 = n // n1
    wide = n2.bit_length()
    # one group for each key and b; the key rides in the high bits
    tag = F.shiftleft(F.col("key"), wide)
    first = _pass_keyed(_grouped(df, tag.bitwiseOR(F.col("i") % n2), F.expr(f"i div {n2}")), n1, sign, n, wide)
    first = scratch.save(first.select("key", "b", "c", "re", "im"), "columns")
    if n2 <= SHORT:
        again = _grouped(first, F.shiftleft(F.col("key"), bits + 1).bitwiseOR(F.col("c")), F.col("b"))
        out = _pass(again, n2, sign, "d")
        return out.select(F.shiftright("g", bits + 1).alias("key"), (F.col("g").bitwiseAND(F.lit((1 << (bits + 1)) - 1)) + n1 * F.col("d")).alias("k"), "re", "im")
    inner = _transform(scratch, first.select((F.col("key") * n1 + F.col("c")).alias("key"), F.col("b").alias("i"), "re", "im"), n2, sign)
    return inner.select(F.expr(f"key div {n1}").alias("key"), (F.col("key") % n1 + n1 * F.col("k")).alias("k"), "re", "im")


def _pass_keyed(groups: DataFrame, length: int, sign: int, turn: int, wide: int) -> DataFrame:
    """_pass() with the turn by b, the low bits of g: key, b, c, re, im."""
    done = _pass(groups, length, sign, "c")
    mask = F.lit((1 << wide) - 1)
    b = F.col("g").bitwiseAND(mask)
    angle = (b * F.col("c")) % turn * F.lit(sign * 2 * np.pi / turn)
    re = F.col("re") * F.cos(angle) - F.col("im") * F.sin(angle)
    im = F.col("re") * F.sin(angle) + F.col("im") * F.cos(angle)
    return done.select(F.shiftright("g", wide).alias("key"), b.alias("b"), "c", re.alias("re"), im.alias("im"))


def fft(df: DataFrame, n: int, inverse: bool = False) -> DataFrame:
    """k, re, im of the transform of the vector (i, re, im) of n values, a power of two; missing indices are zero. The inverse is divided by n."""
    if n < 1 or n & (n - 1):
        raise ShapeError(f"{n} is not a power of two")
    rows = df.select(F.lit(0).cast("long").alias("key"), F.col("i").cast("long").alias("i"), "re", "im")
    out = _transform(Scratch(df.sparkSession), rows, n, 1 if inverse else -1).select("k", "re", "im")
    return out.select("k", (F.col("re") / n).alias("re"), (F.col("im") / n).alias("im")) if inverse else out


def ifft(df: DataFrame, n: int) -> DataFrame:
    """i, re, im of the vector with the transform (k, re, im)."""
    return fft(df.select(F.col("k").alias("i"), "re", "im"), n, True).withColumnRenamed("k", "i")


def rfft(df: DataFrame, n: int) -> DataFrame:
    """k from 0 to n / 2, re, im of the transform of real values (i, v)."""
    return fft(df.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")), n).where(F.col("k") <= n // 2)


def irfft(df: DataFrame, n: int) -> DataFrame:
    """i and v of the real vector with the half transform (k, re, im)."""
    mirror = df.where((F.col("k") > 0) & (F.col("k") < n - n // 2)).select((n - F.col("k")).alias("k"), "re", (-F.col("im")).alias("im"))
    return ifft(df.select("k", "re", "im").unionByName(mirror), n).select("i", F.col("re").alias("v"))
