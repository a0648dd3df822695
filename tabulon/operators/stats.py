"""Statistics over index-keyed arrays and table columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.plans.tensor import ShapeError, Tensor


def var_of(v: Column, correction: int = 1) -> Column:
    """Sum of squared deviations by max(n - correction, 1)."""
    n = F.count(v)
    return F.var_pop(v) * n / F.greatest(n - correction, F.lit(1))


def var(t: Tensor, dims: Sequence[int] = (), keepdim=False, correction=1) -> Tensor: return t.aggregate(var_of(F.col("v"), correction), dims, keepdim)
def std(t: Tensor, dims: Sequence[int] = (), keepdim=False, correction=1) -> Tensor: return t.aggregate(F.sqrt(var_of(F.col("v"), correction)), dims, keepdim)


def quantile(t: Tensor, q: float, d: int | None = None, keepdim: bool = False, interpolation: str = "linear") -> Tensor:
    """Exact quantile at q * (n - 1): linear, lower, higher, nearest (below a half: lower) or midpoint."""
    if not 0 <= q <= 1:
        raise ShapeError("q must be in 0 to 1")
    dims = () if d is None else [d]
    if interpolation == "linear":
        return t.aggregate(F.percentile("v", F.lit(q)), dims, keepdim)
    n = t.shape[t.dim(d)] if d is not None else None
    if n is None:
        t = t.flatten()
        n = t.shape[0]
        dims = [0]
    place = q * (n - 1)
    low, high = int(place), min(int(place) + (place > int(place)), n - 1)
    at = {"lower": (low, low), "higher": (high, high), "nearest": (low, low) if place - low < 0.5 else (high, high), "midpoint": (low, high)}[interpolation]
    # percentile at an exact place is that element
    exact = [F.percentile("v", F.lit(a / max(n - 1, 1))) for a in at]
    return t.aggregate((exact[0] + exact[1]) / 2, dims, keepdim)


def percentile(t: Tensor, p: float, d: int | None = None, keepdim=False) -> Tensor: return quantile(t, p / 100, d, keepdim)
def median(t: Tensor, d: int | None = None, keepdim=False) -> Tensor: return quantile(t, 0.5, d, keepdim)


def histogram(df: DataFrame, column: str, bins: int, limits: tuple[float, float] | None = None) -> DataFrame:
    """bin, edge (its lower one) and n for each bin; outliers count in the end bins, the upper limit in the last; equal limits are widened by a half."""
    if limits is None:
        low, high = df.agg(F.min(column), F.max(column)).first()
        low, high = (0.0, 1.0) if low is None else (low, high)
    else:
        low, high = limits
    low, high = (low - 0.5, high + 0.5) if low == high else (low, high)
    width = (high - low) / bins
    place = F.least(F.greatest(F.floor((F.col(column) - low) / width), F.lit(0)), F.lit(bins - 1))
    counts = df.groupBy(place.alias("bin")).agg(F.count("*").alias("n"))
    every = df.sparkSession.range(bins).withColumnRenamed("id", "bin")
    return every.join(counts, "bin", "left").select("bin", (low + F.col("bin") * width).alias("edge"), F.coalesce("n", F.lit(0)).alias("n"))


def cov(t: Tensor, ddof: int = 1) -> Tensor:
    """Covariance of the columns; rows are observations."""
    n, d = t.shape
    if n <= ddof:
        raise ShapeError("too few observations")
    # one pass of sums of products per row: a row's values meet in its own group
    rows = _centred(t).groupBy("i0").agg(F.collect_list(F.struct("i1", "v")).alias("r"))
    pairs = rows.select(F.explode("r").alias("x"), "r").select("x", F.explode("r").alias("y"))
    sums = pairs.groupBy(F.col("x.i1").alias("i0"), F.col("y.i1").alias("i1")).agg((F.sum(F.col("x.v") * F.col("y.v")) / (n - ddof)).alias("v"))
    return Tensor(sums, (d, d))


def _centred(t: Tensor) -> DataFrame:
    return t.zip(t.mean([0], True), lambda v, m: v - m).df


def corrcoef(t: Tensor) -> Tensor:
    """Correlation of the columns; 0 where one of them is constant."""
    c = cov(t)
    dev = c.df.where("i0 = i1").select(F.col("i0").alias("k"), F.sqrt("v").alias("s"))
    x, y = dev.select(F.col("k").alias("i0"), F.col("s").alias("sx")), dev.select(F.col("k").alias("i1"), F.col("s").alias("sy"))
    out = c.df.join(x, "i0").join(y, "i1").select("i0", "i1", F.when((F.col("sx") > 0) & (F.col("sy") > 0), F.try_divide("v", F.col("sx") * F.col("sy"))).otherwise(0.0).alias("v"))
    return Tensor(out, c.shape)


def skew_of(v: Column) -> Column:
    """Population skewness; 0 for fewer than 3 values or hardly any spread."""
    return F.when((F.count(v) < 3) | (F.coalesce(F.stddev_pop(v), F.lit(0.0)) < 1e-10), 0.0).otherwise(F.skewness(v))


def kurtosis_of(v: Column) -> Column:
    """Population excess kurtosis; 0 for fewer than 4 values or hardly any spread."""
    return F.when((F.count(v) < 4) | (F.coalesce(F.var_pop(v), F.lit(0.0)) < 1e-10), 0.0).otherwise(F.kurtosis(v))


def skew(t: Tensor, dims: Sequence[int] = (), keepdim=False) -> Tensor: return t.aggregate(skew_of(F.col("v")), dims, keepdim)
def kurtosis(t: Tensor, dims: Sequence[int] = (), keepdim=False) -> Tensor: return t.aggregate(kurtosis_of(F.col("v")), dims, keepdim)


def mode(t: Tensor, d: int | None = None) -> DataFrame:
    """The most frequent value of each slice and its count n; of several, the least."""
    kept = [] if d is None else [f"i{k}" for k in range(t.rank) if k != t.dim(d)]
    counts = t.df.groupBy(*kept, "v").agg(F.count("*").alias("n"))
    best = F.min(F.struct((-F.col("n")).alias("n"), "v"))
    return counts.groupBy(*kept).agg(best.alias("b")).select(*kept, F.col("b.v").alias("v"), (-F.col("b.n")).alias("n"))


def standardize(t: Tensor, d: int) -> Tensor:
    w = W.partitionBy(*[f"i{k}" for k in range(t.rank) if k != t.dim(d)])
    return Tensor(t.df.withColumn("v", F.try_divide(F.col("v") - F.avg("v").over(w), F.stddev_pop("v").over(w))), t.shape)
