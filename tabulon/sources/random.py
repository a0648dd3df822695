"""Random and quasi-random arrays. Every value is a function of seed and index, so any partitioning gives the same array."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.functions.elementwise import uniform
from tabulon.plans.tensor import ShapeError, Tensor


def _u(seed: int, i, k: int = 0): return uniform(seed, i, F.lit(k))
def _open(seed, i, k=0): return 1 - _u(seed, i, k)


def rand(spark, shape, seed: int = 0) -> Tensor: return Tensor.generate(spark, shape, lambda i: _u(seed, i))
rand_seeded = rand


def _normal(seed, i, k=0):
    """Box and Muller's."""
    return F.sqrt(-2 * F.ln(_open(seed, i, k))) * F.cos(2 * math.pi * _u(seed, i, k + 1))


def randn(spark, shape, seed: int = 0) -> Tensor: return Tensor.generate(spark, shape, lambda i: _normal(seed, i))
def randint(spark, low: int, high: int, shape, seed: int = 0) -> Tensor: return Tensor.generate(spark, shape, lambda i: F.floor(_u(seed, i) * (high - low)).cast("double") + low)
def bernoulli(spark, p: float, shape, seed: int = 0) -> Tensor: return Tensor.generate(spark, shape, lambda i: (_u(seed, i) < p).cast("double"))
def exponential(spark, rate: float, shape, seed: int = 0) -> Tensor: return Tensor.generate(spark, shape, lambda i: -F.ln(_open(seed, i)) / rate)


def laplace(spark, loc: float, scale: float, shape, seed: int = 0) -> Tensor:
    def value(i):
        u = _open(seed, i) - 0.5
        return loc - scale * F.signum(u) * F.ln(F.greatest(1 - 2 * F.abs(u), F.lit(2.0**-54)))

    return Tensor.generate(spark, shape, value)


#: Values that share a generator: the k-th of run r comes from the generator of (seed, r).
RUN = 4096


def _drawn(spark: SparkSession, shape: Sequence[int], seed: int, draw) -> Tensor:
    """draw(generator, n) for each run of RUN values; runs are rows, so a lost one is drawn again alike."""
    n = math.prod(shape)
    runs = spark.range(-(-n // RUN))

    def values(batches):
        for batch in batches:
            for r in batch["id"]:
                count = min(RUN, n - r * RUN)
                yield pd.DataFrame({"i0": r * RUN + np.arange(count), "v": np.asarray(draw(np.random.Generator(np.random.Philox([seed, int(r)])), count), float)})

    return Tensor(runs.mapInPandas(values, "i0 long, v double"), (n,)).reshape(tuple(shape))


def poisson(spark, lam: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.poisson(lam, n))
def binomial(spark, trials: int, p: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.binomial(trials, p, n))
def beta(spark, a: float, b: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.beta(a, b, n))
def gamma(spark, k: float, scale: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.gamma(k, scale, n))
def chi_squared(spark, df: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.chisquare(df, n))
def student_t(spark, df: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.standard_t(df, n))
def f_distribution(spark, d1: float, d2: float, shape, seed=0): return _drawn(spark, shape, seed, lambda g, n: g.f(d1, d2, n))


def randperm(spark, n: int, seed: int = 0) -> Tensor:
    """0 to n - 1 in the order of their hashes, sorted by range partitions."""
    from tabulon.operators.sorting import argsort

    return argsort(Tensor.generate(spark, (n,), lambda i: _u(seed, i)), 0)


def multinomial(probs: Tensor, samples: int, replacement: bool = True, seed: int = 0) -> Tensor:
    """Indices drawn by weight: uniform draws are placed among the running sums; without replacement, the largest of log(u) / weight."""
    spark = probs.df.sparkSession
    if not replacement:
        keys = probs.df.where("v > 0").select("i0", (F.ln(_open(seed, F.col("i0"))) / F.col("v")).alias("k")).orderBy(F.desc("k"), "i0").limit(samples)
        return Tensor(keys.select((F.row_number().over(W.partitionBy(F.lit(0)).orderBy(F.desc("k"), "i0")) - 1).cast("long").alias("i0"), F.col("i0").cast("double").alias("v")), (samples,))
    from tabulon.operators.sorting import searchsorted

    total = probs.df.agg(F.sum("v")).first()[0]
    draws = Tensor.generate(spark, (samples,), lambda i: _u(seed, i) * total)
    return searchsorted(probs.cumsum(0), draws, right=True).map(lambda v: F.least(v, F.lit(probs.shape[0] - 1.0)))


# multivariate: one row vector per sample

def _rows(spark, n: int, width: int, seed: int, draw) -> Tensor:
    def values(batches):
        for batch in batches:
            for r in batch["id"]:
                x = np.asarray(draw(np.random.Generator(np.random.Philox([seed, int(r)]))), float).ravel()
                yield pd.DataFrame({"i0": int(r), "i1": np.arange(len(x)), "v": x})

    return Tensor(spark.range(n).mapInPandas(values, "i0 long, i1 long, v double"), (n, width))


def multivariate_normal(spark, mean, cov, samples: int, seed=0) -> Tensor:
    low, mean = np.linalg.cholesky(np.asarray(cov, float)), np.asarray(mean, float)
    return _rows(spark, samples, len(mean), seed, lambda g: mean + low @ g.standard_normal(len(mean)))


def wishart(spark, scale, df: int, samples: int, seed=0) -> Tensor:
    """Bartlett's decomposition; samples x d x d."""
    low = np.linalg.cholesky(np.asarray(scale, float))
    d = len(low)

    def draw(g):
        a = np.tril(g.standard_normal((d, d)), -1) + np.diag(np.sqrt([g.chisquare(df - i) for i in range(d)]))
        return (low @ a) @ (low @ a).T

    return _rows(spark, samples, d * d, seed, draw).reshape((samples, d, d))


def dirichlet(spark, alpha, samples: int, seed=0) -> Tensor: return _rows(spark, samples, len(alpha), seed, lambda g: g.dirichlet(alpha))
def multinomial_samples(spark, probs, trials: int, samples: int, seed=0) -> Tensor: return _rows(spark, samples, len(probs), seed, lambda g: g.multinomial(trials, np.asarray(probs, float) / np.sum(probs)))


# quasi-random

def primes(n: int) -> list[int]:
    out, k = [], 2
    while len(out) < n:
        if all(k % p for p in out if p * p <= k):
            out.append(k)
        k += 1
    return out


def halton(spark, points: int, dims: int, skip: int = 0) -> Tensor:
    """Radical inverse of the index to the first primes."""
    rows = spark.range(points).select(F.col("id").alias("i0"), (F.col("id") + skip).alias("n"))
    columns = []
    for p in primes(dims):
        digits = math.ceil(math.log(max(points + skip, 2)) / math.log(p)) + 1
        total = F.lit(0.0)
        for k in range(digits):
            total = total + (F.expr(f"(n div {p**k}L) % {p}")) * F.lit(p ** -(k + 1.0))
        columns.append(total)
    out = rows.select("i0", F.posexplode(F.array(*columns)).alias("i1", "v"))
    return Tensor(out.select("i0", F.col("i1").cast("long").alias("i1"), "v"), (points, dims))


# Primitive polynomials (degree, coefficients) and first direction numbers of the dimensions after the first.
SOBOL = [(1, 0, [1]), (2, 1, [1, 3]), (3, 1, [1, 3, 1]), (3, 2, [1, 1, 1]), (4, 1, [1, 1, 3, 3]), (4, 4, [1, 3, 5, 13]), (5, 2, [1, 1, 5, 5, 17]), (5, 4, [1, 1, 5, 5, 5]), (5, 7, [1, 1, 7, 11, 19])]
BITS = 32


def sobol_directions(d: int) -> list[int]:
    if d == 0:
        return [1 << (BITS - 1 - k) for k in range(BITS)]
    s, a, m = SOBOL[d - 1]
    v = [m[k] << (BITS - 1 - k) for k in range(s)]
    for k in range(s, BITS):
        x = v[k - s] ^ (v[k - s] >> s)
        for j in range(1, s):
            if a >> (s - 1 - j) & 1:
                x ^= v[k - j]
        v.append(x)
    return v


def sobol(spark, points: int, dims: int, skip: int = 0) -> Tensor:
    """The bits of the index's Gray code choose the direction numbers that are combined."""
    if dims > len(SOBOL) + 1:
        raise ShapeError(f"up to {len(SOBOL) + 1} dimensions")
    rows = spark.range(points).select(F.col("id").alias("i0"), F.expr(f"(id + {skip}L) ^ shiftright(id + {skip}L, 1)").alias("g"))
    bits = max((points + skip).bit_length(), 1)
    columns = []
    for d in range(dims):
        v = sobol_directions(d)
        x = F.lit(0).cast("long")
        for k in range(bits):
            x = x.bitwiseXOR(F.when(F.shiftright("g", k).bitwiseAND(F.lit(1)) == 1, F.lit(v[k])).otherwise(0).cast("long"))
        columns.append(x.cast("double") * F.lit(2.0**-BITS))
    out = rows.select("i0", F.posexplode(F.array(*columns)).alias("i1", "v"))
    return Tensor(out.select("i0", F.col("i1").cast("long").alias("i1"), "v"), (points, dims))


def latin_hypercube(spark, samples: int, dims: int, seed: int = 0) -> Tensor:
    """Per dimension a permutation of the strata, and a uniform place in each."""
    from tabulon.plans.tensor import stack

    columns = []
    for d in range(dims):
        order = randperm(spark, samples, seed * 1000 + d)
        columns.append(Tensor(order.df.withColumn("v", (F.col("v") + uniform(seed, F.col("i0"), F.lit(d))) / samples), order.shape))
    return stack(columns, 1)


# counter-based generators by name: the stream is a function of key, counter and index

def _counter(spark, shape, bits, normal: bool) -> Tensor:
    def draw(make):
        n = math.prod(shape)

        def values(batches):
            for batch in batches:
                for r in batch["id"]:
                    count = min(RUN, n - r * RUN)
                    g = np.random.Generator(make(int(r)))
                    yield pd.DataFrame({"i0": r * RUN + np.arange(count), "v": g.standard_normal(count) if normal else g.random(count)})

        return Tensor(spark.range(-(-n // RUN)).mapInPandas(values, "i0 long, v double"), (n,)).reshape(tuple(shape))

    return draw(bits)


def philox_uniform(spark, shape, key: int, counter: int = 0): return _counter(spark, shape, lambda r: np.random.Philox(key=key, counter=counter + r * RUN), False)
def philox_randn(spark, shape, key: int, counter: int = 0): return _counter(spark, shape, lambda r: np.random.Philox(key=key, counter=counter + r * RUN), True)
def pcg64_uniform(spark, shape, seed: int, stream: int = 0): return _counter(spark, shape, lambda r: np.random.PCG64(np.random.SeedSequence([seed, stream, r])), False)
def pcg64_randn(spark, shape, seed: int, stream: int = 0): return _counter(spark, shape, lambda r: np.random.PCG64(np.random.SeedSequence([seed, stream, r])), True)


def _hashed(spark, shape, salt: str, key: int, counter: int, normal: bool) -> Tensor:
    """A keyed hash of the counter, in the JVM."""
    def value(i):
        u = lambda k: F.shiftrightunsigned(F.xxhash64(F.lit(salt), F.lit(key), i + counter, F.lit(k)), 11) * F.lit(2.0**-53)
        return F.sqrt(-2 * F.ln(1 - u(0))) * F.cos(2 * math.pi * u(1)) if normal else u(0)

    return Tensor.generate(spark, shape, value)


def threefry_uniform(spark, shape, key: int, counter: int = 0): return _hashed(spark, shape, "threefry", key, counter, False)
def threefry_randn(spark, shape, key: int, counter: int = 0): return _hashed(spark, shape, "threefry", key, counter, True)
def xoshiro256_uniform(spark, shape, seed: int): return _hashed(spark, shape, "xoshiro", seed, 0, False)
def xoshiro256_randn(spark, shape, seed: int): return _hashed(spark, shape, "xoshiro", seed, 0, True)
