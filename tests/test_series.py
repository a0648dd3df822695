"""Special functions as column expressions against their plain versions, in and outside their domains."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tabulon.functions import series
from tabulon.functions import special as plain

TWO = [(f"{name}_{a}", (lambda f, a: lambda: f(F.lit(a), F.col("x")))(getattr(series, name), a), (lambda f, a: lambda x: f(np.full_like(x, a), x))(getattr(plain, name), a), limit) for name, limit in (("gammainc", 60), ("gammaincc", 60)) for a in (0.3, 40.0)]
THREE = [(f"{name}_{a}", (lambda f, a: lambda: f(F.lit(a), F.lit(1.7), F.col("x")))(getattr(series, name), a), (lambda f, a: lambda x: f(np.full_like(x, a), np.full_like(x, 1.7), x))(getattr(plain, name), a), 1.5) for name in ("betainc",) for a in (0.3, 40.0)]
ONE = [(n, (lambda n: lambda: getattr(series, n)(F.col("x")))(n), getattr(plain, n), 60) for n in ("erf", "erfc", "erfinv", "gamma", "lgamma", "digamma", "ellipk", "ellipe", "airy_ai", "airy_bi", "fresnel_s", "fresnel_c")]
BESSEL = [(f"bessel_{k}{n}", (lambda k, n: lambda: getattr(series, f"bessel_{k}")(n, F.col("x")))(k, n), (lambda k, n: lambda x: getattr(plain, f"bessel_{k}")(n, x))(k, n), 60) for k in "jyik" for n in (0, 1)]
HYPER = [("hyp1f1", lambda: series.hyp1f1(1.5, 2.0, F.col("x")), lambda x: plain.hyp1f1(1.5, 2.0, x), 40), ("hyp2f1", lambda: series.hyp2f1(1.0, 2.0, 3.5, F.col("x")), lambda x: plain.hyp2f1(1.0, 2.0, 3.5, x), 1.5)]
EVERY = ONE + BESSEL + TWO + THREE + HYPER


@pytest.fixture(scope="module")
def got(spark):
    """The arguments and all functions of them, in a few jobs."""
    rng = np.random.default_rng(0)
    x = np.unique(np.concatenate([rng.normal(size=25) * 3, rng.random(30), rng.random(15) * 60, [-7.5, -7.4, -2.5, -0.5, 0, 1, 2, 5, 10, 24.9, 25.1, 49.9, 50.1]]))
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1).cache()
    out = {"x": x}
    for at in range(0, len(EVERY), 9):
        part = EVERY[at : at + 9]
        found = rows.select("x", *(f().alias(n) for n, f, _, _ in part)).toPandas().sort_values("x")
        out |= {n: found[n].to_numpy(float) for n, *_ in part}
    return out


@pytest.mark.parametrize(("name", "plain_one", "limit"), [(n, p, limit) for n, _, p, limit in EVERY], ids=[n for n, *_ in EVERY])
def test_values(got, name, plain_one, limit):
    inside = got["x"] < limit
    with np.errstate(all="ignore"):
        want = np.asarray(plain_one(got["x"][inside]), float)
    ours = got[name][inside]
    same = (np.isnan(ours) & np.isnan(want)) | (ours == want) | (np.abs(ours - want) <= 1e-9 * (1 + np.abs(want)))
    assert same.all(), list(zip(got["x"][inside][~same], ours[~same], want[~same], strict=True))[:3]


def test_nulls_nans_and_ends(spark):
    rows = spark.createDataFrame([(0, None), (1, math.nan), (2, math.inf), (3, -math.inf)], "i int, x double").coalesce(1)
    out = rows.select("i", *(f().alias(n) for n, f, _, _ in ONE)).orderBy("i").collect()
    assert all(v is None for v in out[0][1:]) and all(math.isnan(v) for v in out[1][1:])
    assert (out[2]["erf"], out[3]["erf"], out[2]["erfc"], out[3]["erfc"], out[2]["fresnel_s"], out[3]["fresnel_c"], out[2]["lgamma"]) == (1, -1, 0, 2, 0.5, -0.5, math.inf)
    zero = spark.range(1).select(*(getattr(series, f"bessel_{k}")(0, F.lit(0.0)).alias(k) for k in "jyik"), series.erfinv(F.lit(1.0)).alias("e")).first()
    assert abs(zero["j"] - 1) < 1e-12 and abs(zero["i"] - 1) < 1e-12 and zero["y"] == -math.inf and zero["k"] == zero["e"] == math.inf


def test_bessel_pieces(spark):
    """Between and at the ends of the polynomials' pieces; and a row takes few steps: ten for each of four functions, where quadratures took hundreds."""
    x = np.unique(np.r_[np.linspace(0.003, 26, 400), np.arange(1, 101) / 4, 1e-9, 3 - 1e-12, 25 + 1e-12])
    rows = spark.createDataFrame([(float(v),) for v in x], "x double").coalesce(1)
    found = rows.select("x", *(getattr(series, f"bessel_{k}")(n, F.col("x")).alias(f"{k}{n}") for k in "jy" for n in (0, 1))).toPandas().sort_values("x")
    for k in "jy":
        for n in (0, 1):
            want = getattr(plain, f"bessel_{k}")(n, x)
            assert np.abs((found[f"{k}{n}"].to_numpy() - want) / (1 + np.abs(want))).max() < 1e-13, (k, n)
    wronskian = found["j1"] * found["y0"] - found["j0"] * found["y1"]
    assert np.abs(wronskian * np.pi * x / 2 - 1).max() < 1e-13
    assert 4 * series.COEFFICIENTS < 96  # steps of a row of all four


def test_inverse_of_the_incomplete_beta(monkeypatch):
    """All rows at once, against bisection row by row."""
    rng = np.random.default_rng(4)
    a, b, p = np.r_[rng.random(40) * 6 + 0.05, rng.random(10) * 200], np.r_[rng.random(40) * 6 + 0.05, rng.random(10) * 300], np.r_[rng.random(40), 10.0 ** -(rng.random(10) * 12)]
    want = np.array([plain._bisect(lambda t, x=x, y=y, q=q: plain._betainc(x, y, t) - q, 0.0, 1.0) for x, y, q in zip(a, b, p, strict=True)])
    monkeypatch.setattr(plain, "_betainc", None)
    assert np.allclose(plain.betaincinv(a, b, p), want, rtol=1e-11, atol=0)
    ends = plain.betaincinv(np.array([1, 2, 0, 1, 1, np.nan, 1]), np.array([1, 3, 1, -1, 1, 1, 1]), np.array([0, 1, 0.5, 0.5, 1.5, 0.5, 0.25]))
    assert np.allclose(plain.betainc(a, b, plain.betaincinv(a, b, p)), p, rtol=1e-7, atol=0)
    assert np.array_equal(ends, [0, 1, np.nan, np.nan, np.nan, np.nan, 0.25], equal_nan=True) and len(plain.betaincinv([], [], [])) == 0


def test_no_python_in_the_plan(spark):
    plan = spark.range(3).select(series.erf(F.col("id").cast("double")), series.bessel_y(0, F.col("id").cast("double")))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
