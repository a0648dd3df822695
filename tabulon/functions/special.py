"""Special functions by name. Most are column expressions (series.py); gamma, the incomplete beta function and the two inverses run in Arrow batches, as
their steps over folds are ten times slower. The NumPy forms of all stay beside them: value by value, they are what the column forms are tested against."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tabulon.functions import series


def _gl(n: int):
    return np.polynomial.legendre.leggauss(n)


def _each(f):
    return lambda x: np.array([f(v) for v in np.ravel(x)], float).reshape(np.shape(x))


def _safe(f):
    def g(x):
        try:
            return f(x)
        except (ValueError, OverflowError):
            return math.inf if x > 0 else math.nan
    return g


erf = _each(math.erf)
erfc = _each(math.erfc)
gamma = _each(_safe(math.gamma))
lgamma = _each(_safe(math.lgamma))


def erfinv(y):
    """Newton's steps on erf from a rough start."""
    y = np.asarray(y, float)
    inside = np.clip(y, -1 + 1e-16, 1 - 1e-16)
    w = np.log1p(-inside * inside)
    a = 2 / (math.pi * 0.147) + w / 2
    x = np.sign(inside) * np.sqrt(np.maximum(np.sqrt(a * a - w / 0.147) - a, 0))
    for _ in range(4):
        x = x + _newton_erf(x, inside)
    return np.where(np.abs(y) == 1, np.sign(y) * np.inf, np.where(np.abs(y) > 1, np.nan, x))


def _newton_erf(x, y):
    """The step that brings erf(x) to y; erfc keeps the tail's digits."""
    positive = y >= 0
    miss = np.where(positive, erfc(np.abs(x)) - (1 - np.abs(y)), (1 - np.abs(y)) - erfc(np.abs(x)))
    return miss / (2 / math.sqrt(math.pi) * np.exp(-x * x))


def digamma(x):
    """Reflection, recurrence to 10 and the asymptotic series."""
    x = np.asarray(x, float)
    pole = (x <= 0) & (x == np.floor(x))
    reflected = x < 0
    with np.errstate(all="ignore"):
        z = np.where(reflected, 1 - x, np.where(pole, 1, x))
        shift = np.zeros_like(z)
        for _ in range(10):
            low = z < 10
            shift = np.where(low, shift - 1 / np.where(low, z, 1), shift)
            z = np.where(low, z + 1, z)
        r = 1 / (z * z)
        out = shift + np.log(z) - 0.5 / z - r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r * (1 / 132 - r * 691 / 32760)))))
        out = np.where(reflected, out - math.pi / np.tan(math.pi * x), out)
    return np.where(pole, np.nan, out)


def beta(a, b): return np.exp(lgamma(a) + lgamma(b) - lgamma(np.asarray(a) + np.asarray(b)))


def _gammainc_pair(a, x):
    """Lower and upper regularized incomplete gamma of scalars."""
    if math.isnan(a) or math.isnan(x) or a <= 0 or x < 0:
        return math.nan, math.nan
    if x == 0:
        return 0.0, 1.0
    if math.isinf(x):
        return 1.0, 0.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > abs(total) * 1e-17:
            k += 1
            term *= x / k
            total += term
        low = min(total * scale, 1.0)
        return low, 1 - low
    # Lentz's continued fraction
    b, c = x + 1 - a, 1e300
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        an = -i * (i - a)
        b += 2
        d = 1 / (an * d + b or 1e-300)
        c = b + an / c or 1e-300
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    up = min(h * scale, 1.0)
    return 1 - up, up


def gammainc(a, x): return np.array([_gammainc_pair(p, q)[0] for p, q in zip(np.ravel(a), np.ravel(x), strict=True)])
def gammaincc(a, x): return np.array([_gammainc_pair(p, q)[1] for p, q in zip(np.ravel(a), np.ravel(x), strict=True)])


def _betainc(a, b, x):
    if any(map(math.isnan, (a, b, x))) or a <= 0 or b <= 0 or not 0 <= x <= 1:
        return math.nan
    if x in (0, 1):
        return float(x)
    if x > (a + 1) / (a + b + 2):
        return 1 - _betainc(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or 1e-300)
    h = d
    for m in range(1, 10_000):
        for step in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + step * d or 1e-300)
            c = 1 + step / c or 1e-300
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def _bisect(f, low, high):
    for _ in range(200):
        mid = (low + high) / 2
        if mid in (low, high):
            break
        low, high = (mid, high) if f(mid) < 0 else (low, mid)
    return (low + high) / 2


def _gammaincinv(a, p):
    if math.isnan(a) or math.isnan(p) or a <= 0 or not 0 <= p <= 1:
        return math.nan
    if p in (0, 1):
        return 0.0 if p == 0 else math.inf
    high = a + 1
    while _gammainc_pair(a, high)[0] < p:
        high *= 2
    return _bisect(lambda x: _gammainc_pair(a, x)[0] - p, 0.0, high)


def gammaincinv(a, p): return np.array([_gammaincinv(*t) for t in zip(np.ravel(a), np.ravel(p), strict=True)])


def _betainc_rows(a, b, x, scale):
    """_betainc of arrays with 0 < x < 1 and a, b > 0; scale: the logarithm of the beta function. Lentz's steps go on for the rows that still move."""
    turned = x > (a + 1) / (a + b + 2)
    a, b, x = np.where(turned, b, a), np.where(turned, a, b), np.where(turned, 1 - x, x)
    front = np.exp(a * np.log(x) + b * np.log1p(-x) - scale) / a
    tiny = lambda v: np.where(v == 0, 1e-300, v)
    out, at = np.empty_like(x), np.arange(len(x))
    c, d = np.ones_like(x), 1 / tiny(1 - (a + b) * x / (a + 1))
    h, p, q, y = d.copy(), a, b, x
    for m in range(1, 10_000):
        for step in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 / tiny(1 + step * d)
            c = tiny(1 + step / c)
            h = h * (d * c)
        moving = np.abs(d * c - 1) > 2.5e-16
        if m % 4 == 0 or not moving.any():
            out[at[~moving]] = h[~moving]
            at, c, d, h, p, q, y = (v[moving] for v in (at, c, d, h, p, q, y))
            if not len(at):
                break
    out[at] = h
    return np.where(turned, 1 - front * out, front * out)


def _log_beta(a, b): return np.array([math.lgamma(x) + math.lgamma(y) - math.lgamma(x + y) for x, y in zip(a, b, strict=True)])


def betainc(a, b, x):
    """_betainc of all rows at once."""
    a, b, x = (np.ravel(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, x))
    out = np.where((a > 0) & (b > 0) & (x >= 0) & (x <= 1), x, np.nan)
    inside = (out > 0) & (out < 1)
    with np.errstate(all="ignore"):
        out[inside] = _betainc_rows(a[inside], b[inside], x[inside], _log_beta(a[inside], b[inside]))
    return out


def _betaincinv_rows(a, b, p):
    """Newton's steps within a bracket, halved where a step leaves it or gains too little; all rows at once, while they move."""
    scale = _log_beta(a, b)
    low, high, x = np.zeros_like(p), np.ones_like(p), a / (a + b)
    before, out, at = np.ones_like(p), np.empty_like(p), np.arange(len(p))
    for _ in range(200):
        with np.errstate(all="ignore"):
            miss = _betainc_rows(a, b, x, scale) - p
            low, high = np.where(miss < 0, x, low), np.where(miss < 0, high, x)
            to = x - miss / np.exp((a - 1) * np.log(x) + (b - 1) * np.log1p(-x) - scale)
        middle = (low + high) / 2
        newton = (to > low) & (to < high) & (np.abs(to - x) <= before / 2)
        to = np.where(newton, to, middle)
        step = np.abs(to - x)
        # steps square the error: after one of 1e-10 nothing is left
        moving = (np.abs(miss) > 4e-16 * p) & (step > np.where(newton, 1e-10, 1e-16) * np.minimum(x, 1 - x)) & (middle != low) & (middle != high)
        out[at[~moving]] = np.where(np.abs(miss) > 4e-16 * p, to, x)[~moving]
        at, a, b, p, scale, low, high, x, before = (v[moving] for v in (at, a, b, p, scale, low, high, to, step))
        if not len(at):
            break
    out[at] = x
    return out


def betaincinv(a, b, p):
    a, b, p = (np.ravel(np.asarray(v, float)) for v in np.broadcast_arrays(a, b, p))
    out = np.where((a > 0) & (b > 0) & (p >= 0) & (p <= 1), p, np.nan)
    inside = (out > 0) & (out < 1)
    out[inside] = _betaincinv_rows(a[inside], b[inside], p[inside])
    return out


def _turn(f, n: int, x):
    """Mean of f(angle, x) over [0, pi] by Gauss and Legendre, with nodes enough for x."""
    x = np.asarray(x, float)
    t, w = _gl(n)
    angle = (t + 1) * math.pi / 2
    return np.array([(f(angle, v) * w).sum() / 2 for v in x.ravel()]).reshape(x.shape)


def _tail(f, x, n=400):
    """Integral over [0, T(x)] of a function that falls as exp(-x sinh t) or faster."""
    t, w = _gl(n)
    out = []
    for v in np.ravel(x):
        end = math.asinh(745 / v) if v > 0 else 1.0
        s = (t + 1) * end / 2
        out.append((f(s, v) * w).sum() * end / 2)
    return np.array(out).reshape(np.shape(x))


def _nodes(x): return int(min(200 + 2 * np.nanmax(np.abs(np.where(np.isfinite(x), x, 0)), initial=0), 4000))


def bessel_j(nu: float, x):
    """For x >= 0, or any x if nu is whole."""
    x = np.asarray(x, float)
    out = _turn(lambda a, v: np.cos(nu * a - v * np.sin(a)), _nodes(x), x)
    return out if nu == int(nu) else out - math.sin(nu * math.pi) / math.pi * _tail(lambda t, v: np.exp(-v * np.sinh(t) - nu * t), x)


def bessel_y(n: int, x):
    x = np.asarray(x, float)
    positive = np.where(x > 0, x, 1.0)
    out = _turn(lambda a, v: np.sin(v * np.sin(a) - n * a), _nodes(x), positive) - _tail(lambda t, v: (np.exp(n * t) + (-1) ** n * np.exp(-n * t)) * np.exp(-v * np.sinh(t)), positive, 800) / math.pi
    return np.where(x > 0, out, np.where(x == 0, -np.inf, np.nan))


def bessel_i(nu: float, x):
    x = np.asarray(x, float)
    out = _turn(lambda a, v: np.exp(v * np.cos(a)) * np.cos(nu * a), _nodes(x), x)
    return out if nu == int(nu) else out - math.sin(nu * math.pi) / math.pi * _tail(lambda t, v: np.exp(-v * np.cosh(t) - nu * t), x)


def bessel_k(nu: float, x):
    x = np.asarray(x, float)
    positive = np.where(x > 0, x, 1.0)
    out = _tail(lambda t, v: np.exp(-v * np.cosh(t)) * np.cosh(nu * t), positive, 800)
    return np.where(x > 0, out, np.where(x == 0, np.inf, np.nan))


def airy_ai(x):
    x = np.asarray(x, float)
    size = np.where(x == 0, 1.0, np.abs(x))
    z = 2 / 3 * size**1.5
    right = np.sqrt(size / 3) / math.pi * bessel_k(1 / 3, z)
    left = np.sqrt(size) / 3 * (bessel_j(1 / 3, z) + bessel_j(-1 / 3, z))
    return np.where(x > 0, right, np.where(x < 0, left, 1 / (3 ** (2 / 3) * math.gamma(2 / 3))))


def airy_bi(x):
    x = np.asarray(x, float)
    size = np.where(x == 0, 1.0, np.abs(x))
    z = 2 / 3 * size**1.5
    right = np.sqrt(size / 3) * (bessel_i(1 / 3, z) + bessel_i(-1 / 3, z))
    left = np.sqrt(size / 3) * (bessel_j(-1 / 3, z) - bessel_j(1 / 3, z))
    return np.where(x > 0, right, np.where(x < 0, left, 1 / (3 ** (1 / 6) * math.gamma(2 / 3))))


def _means(m):
    """Arithmetic-geometric mean of 1 and sqrt(1 - m), and the sum that gives the second kind."""
    m = np.asarray(m, float)
    with np.errstate(all="ignore"):
        a, g, c = np.ones_like(m), np.sqrt(1 - m), np.sqrt(np.abs(m))
        total, weight = m / 2, 0.5
        for _ in range(40):
            a, g, c = (a + g) / 2, np.sqrt(a * g), (a - g) / 2
            weight *= 2
            total = total + weight * c * c
        return a, total


def ellipk(m):
    a, _ = _means(m)
    with np.errstate(all="ignore"):
        return np.where(np.asarray(m) < 1, math.pi / (2 * a), np.where(np.asarray(m) == 1, np.inf, np.nan))


def ellipe(m):
    a, total = _means(m)
    with np.errstate(all="ignore"):
        return np.where(np.asarray(m) < 1, math.pi / (2 * a) * (1 - total), np.where(np.asarray(m) == 1, 1.0, np.nan))


def _series(ratio, most=100_000):
    term = total = 1.0
    for k in range(most):
        term *= ratio(k)
        total += term
        if abs(term) <= abs(total) * 1e-17:
            break
    return total


def hyp2f1(a: float, b: float, c: float, z):
    """For z < 1 (beyond -0.5 by Pfaff's transformation)."""
    def one(v):
        if v >= 1 or math.isnan(v):
            return math.nan if v != 1 or c - a - b <= 0 else math.gamma(c) * math.gamma(c - a - b) / (math.gamma(c - a) * math.gamma(c - b))
        if v < -0.5:
            return (1 - v) ** -a * _series(lambda k: (a + k) * (c - b + k) / ((c + k) * (k + 1)) * (v / (v - 1)))
        return _series(lambda k: (a + k) * (b + k) / ((c + k) * (k + 1)) * v)
    return np.array([one(float(v)) for v in np.ravel(z)])


def hyp1f1(a: float, b: float, z):
    """Negative arguments by Kummer's transformation."""
    def one(v):
        return math.exp(v) * _series(lambda k: (b - a + k) / ((b + k) * (k + 1)) * -v) if v < 0 else _series(lambda k: (a + k) / ((b + k) * (k + 1)) * v)
    return np.array([one(float(v)) for v in np.ravel(z)])


def _fresnel(f):
    t, w = _gl(20)

    def g(x):
        out = []
        for v in np.ravel(np.asarray(x, float)):
            panels = int(min(4 + v * v, 20_000)) if math.isfinite(v) else 0
            if not panels:
                out.append(math.copysign(0.5, v) if not math.isnan(v) else math.nan)
                continue
            edge = np.linspace(0, v, panels + 1)
            half = (edge[1:] - edge[:-1])[:, None] / 2
            at = edge[:-1, None] + half * (t + 1)
            out.append(float((f(math.pi * at * at / 2) * w * half).sum()))
        return np.array(out)
    return g


fresnel_s, fresnel_c = _fresnel(np.sin), _fresnel(np.cos)

#: By name: functions of one column, and those of several.
ONE = {
    "erf": erf, "erfc": erfc, "erfinv": erfinv, "gamma": gamma, "lgamma": lgamma, "digamma": digamma, "ellipk": ellipk, "ellipe": ellipe,
    "bessel_j0": lambda x: bessel_j(0, x), "bessel_j1": lambda x: bessel_j(1, x), "bessel_y0": lambda x: bessel_y(0, x), "bessel_y1": lambda x: bessel_y(1, x),
    "bessel_i0": lambda x: bessel_i(0, x), "bessel_i1": lambda x: bessel_i(1, x), "bessel_k0": lambda x: bessel_k(0, x), "bessel_k1": lambda x: bessel_k(1, x),
    "airy_ai": airy_ai, "airy_bi": airy_bi, "fresnel_s": fresnel_s, "fresnel_c": fresnel_c,
}
SEVERAL = {"beta": beta, "betainc": betainc, "gammainc": gammainc, "gammaincc": gammaincc, "gammaincinv": gammaincinv, "betaincinv": betaincinv}


#: Those that are column expressions.
COLUMNS = {
    **{n: getattr(series, n) for n in ("erf", "erfc", "erfinv", "lgamma", "digamma", "ellipk", "ellipe", "airy_ai", "airy_bi", "fresnel_s", "fresnel_c", "beta", "gammainc", "gammaincc")},
    **{f"bessel_{kind}{n}": (lambda x, f=getattr(series, f"bessel_{kind}"), n=n: f(n, x)) for kind in "jyik" for n in (0, 1)},
}


def _distinct(f, columns):
    """f on the distinct argument rows of a batch."""
    table = np.column_stack([np.asarray(c, float) for c in columns])
    rows, back = np.unique(table, axis=0, return_inverse=True)
    return np.asarray(f(*rows.T), float)[np.ravel(back)]


def special(name: str, *columns: Column, **parameters: float) -> Column:
    """The named function of the columns; hyp2f1 and hyp1f1 take a, b (and c) as parameters."""
    if name == "hyp2f1":
        return series.hyp2f1(parameters["a"], parameters["b"], parameters["c"], columns[0].cast("double"))
    if name == "hyp1f1":
        return series.hyp1f1(parameters["a"], parameters["b"], columns[0].cast("double"))
    if name in COLUMNS:
        return COLUMNS[name](*(c.cast("double") for c in columns))
    f = ONE.get(name) or SEVERAL[name]

    @F.pandas_udf("double")
    def run(*series: pd.Series) -> pd.Series:
        return pd.Series(_distinct(f, series)) if len(series[0]) else pd.Series([], dtype=float)

    return run(*(c.cast("double") for c in columns))
