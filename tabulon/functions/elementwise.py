"""Element-wise functions on columns, IEEE-safe under ANSI mode. Each takes and returns Columns; all stay inside code generation."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

INF, NAN = float("inf"), float("nan")


def _d(c) -> Column:
    return c if isinstance(c, Column) else F.lit(float(c))


# division and logarithms that return infinities and NaN instead of errors and nulls

def ieee_div(a, b) -> Column:
    """a / b with x/0 = signed infinity and 0/0 = NaN."""
    a, b = _d(a), _d(b)
    sign = F.when(F.pow(b, F.lit(-1.0)) < 0, -1.0).otherwise(1.0)
    return F.when(b != 0, F.try_divide(a, b)).when(F.isnan(a) | (a == 0), NAN).otherwise(F.signum(a) * sign * INF)


def _log(f, v, zero=0.0):
    return F.when(F.isnan(v), NAN).when(v > zero, f(v)).when(v == zero, -INF).otherwise(NAN)


def neg(v): return -v
def abs_(v): return F.abs(v)
def sign(v): return F.when(F.isnan(v), 0.0).when(v > 0, 1.0).when(v < 0, -1.0).otherwise(0.0)
def sqrt(v): return F.sqrt(v)
def rsqrt(v): return F.pow(F.sqrt(v), F.lit(-1.0))
def square(v): return v * v
def cbrt(v): return F.cbrt(v)
def recip(v): return F.pow(v, F.lit(-1.0))
def exp(v): return F.exp(v)
def exp2(v): return F.pow(F.lit(2.0), v)
def expm1(v): return F.expm1(v)
def log(v): return _log(F.ln, v)
def log2(v): return _log(F.log2, v)
def log10(v): return _log(F.log10, v)
def log1p(v): return _log(F.log1p, v, -1.0)
def sin(v): return F.sin(v)
def cos(v): return F.cos(v)
def tan(v): return F.tan(v)
def asin(v): return F.asin(v)
def acos(v): return F.acos(v)
def atan(v): return F.atan(v)
def sinh(v): return F.sinh(v)
def cosh(v): return F.cosh(v)
def tanh(v): return F.tanh(v)
def asinh(v): return sign(v) * F.asinh(F.abs(v))  # the positive half is the accurate one
def acosh(v): return F.acosh(v)
def atanh(v): return F.atanh(v)


def _whole(f, v):
    """f rounds to a long; values that are whole anyway (or not finite) pass."""
    return F.when(F.isnan(v) | (F.abs(v) >= 2.0**52), v).otherwise(f(v).cast("double"))


def floor(v): return _whole(F.floor, v)
def ceil(v): return _whole(F.ceil, v)


def round_(v):
    """Half away from zero."""
    return sign(v) * floor(F.abs(v) + 0.5)


def rint(v): return F.rint(v)
def trunc(v): return F.when(v < 0, ceil(v)).otherwise(floor(v))
def isnan(v): return F.isnan(v).cast("int")
def isinf(v): return (F.abs(v) == INF).cast("int")


UNARY = {f.__name__.rstrip("_"): f for f in (neg, abs_, sign, sqrt, rsqrt, square, cbrt, recip, exp, exp2, expm1, log, log2, log10, log1p, sin, cos, tan, asin, acos, atan, sinh, cosh, tanh, asinh, acosh, atanh, floor, ceil, round_, rint, trunc, isnan, isinf)}


def add(a, b): return a + b
def sub(a, b): return a - b
def mul(a, b): return a * b
def div(a, b): return ieee_div(a, b)
def pow_(a, b): return F.pow(a, b)


def _greater(a, b): return (a > b) & ~F.isnan(a) & ~F.isnan(b)


def maximum(a, b):
    """b unless a > b, so a NaN on either side gives b."""
    return F.when(_greater(a, b), a).otherwise(b)


def minimum(a, b): return F.when(_greater(b, a), a).otherwise(b)
def atan2(y, x): return F.atan2(y, x)
def fused_mul_add(a, b, c): return a * b + c
def fused_add_mul(a, b, c): return (a + b) * c
def add_into(a, b): return a + b


BINARY = {f.__name__.rstrip("_"): f for f in (add, sub, mul, div, pow_, maximum, minimum, atan2, add_into)}


def add_scalar(v, s): return v + F.lit(float(s))
def sub_scalar(v, s): return v - F.lit(float(s))
def mul_scalar(v, s): return v * F.lit(float(s))
def div_scalar(v, s): return ieee_div(v, F.lit(float(s)))
def pow_scalar(v, s): return F.pow(v, F.lit(float(s)))
def rsub_scalar(v, s): return F.lit(float(s)) - v
def fused_mul_add_scalar(v, scale, bias): return v * F.lit(float(scale)) + F.lit(float(bias))


SCALAR = {f.__name__: f for f in (add_scalar, sub_scalar, mul_scalar, div_scalar, pow_scalar, rsub_scalar)}


# comparisons: no order and no equality with NaN; 1.0 or 0.0

def _bool(c): return F.coalesce(c, F.lit(False)).cast("double")
def _plain(a, b): return ~F.isnan(a) & ~F.isnan(b)
def eq(a, b): return _bool((a == b) & _plain(a, b))
def ne(a, b): return _bool((a != b) | ~_plain(a, b))
def lt(a, b): return _bool((a < b) & _plain(a, b))
def le(a, b): return _bool((a <= b) & _plain(a, b))
def gt(a, b): return _bool((a > b) & _plain(a, b))
def ge(a, b): return _bool((a >= b) & _plain(a, b))


COMPARE = {f.__name__: f for f in (eq, ne, lt, le, gt, ge)}


def logical_and(a, b): return ((a != 0) & (b != 0)).cast("int")
def logical_or(a, b): return ((a != 0) | (b != 0)).cast("int")
def logical_xor(a, b): return ((a != 0) != (b != 0)).cast("int")
def logical_not(a): return (a == 0).cast("int")


LOGICAL = {f.__name__: f for f in (logical_and, logical_or, logical_xor)}


def where_cond(cond, x, y): return F.when(cond != 0, x).otherwise(y)


#: Whole-number types: lowest and highest value, and the Spark type that holds them.
INTEGERS = {"i8": (-(2**7), 2**7 - 1, "tinyint"), "i16": (-(2**15), 2**15 - 1, "smallint"), "i32": (-(2**31), 2**31 - 1, "int"), "i64": (-(2**63), 2**63 - 1, "bigint"), "u8": (0, 2**8 - 1, "smallint"), "u16": (0, 2**16 - 1, "int"), "u32": (0, 2**32 - 1, "bigint")}


def cast(v, dtype: str) -> Column:
    """To f64, f32, f16, bf16, bool or a whole-number type: truncated, saturated at its limits, NaN to 0."""
    if dtype in INTEGERS:
        low, high, kind = INTEGERS[dtype]
        inner = F.when(v >= float(high), F.lit(high)).when(v <= float(low), F.lit(low)).otherwise(F.when((v < float(high)) & (v > float(low)), v).otherwise(0.0).cast("long"))
        return F.when(F.isnan(v), F.lit(0)).otherwise(inner).cast(kind)
    if dtype == "bool":
        return ((v != 0) | F.isnan(v)).cast("int")
    if dtype == "f16":
        return _short_float(v, 11, -24, 65504.0)
    if dtype == "bf16":
        return _short_float(v, 8, -133, 3.3895313892515355e38)
    return v.cast({"f64": "double", "f32": "float"}[dtype])


def _short_float(v, bits: int, least: int, most: float) -> Column:
    """The nearest value with `bits` significant bits, half to even; beyond the largest, infinity."""
    exponent = F.greatest(F.floor(F.log2(F.abs(v))) - (bits - 1), F.lit(least))
    step = F.pow(F.lit(2.0), exponent.cast("double"))
    near = F.rint(F.try_divide(v, step)) * step
    return F.when(F.isnan(v) | (v == 0) | (F.abs(v) == INF), v).when(F.abs(near) > most, F.signum(v) * INF).otherwise(near)


def clamp(v, low, high): return F.when(F.isnan(v), v).otherwise(F.least(F.greatest(v, F.lit(float(low))), F.lit(float(high))))


# activations

def relu(v): return F.when(v > 0, v).otherwise(0.0)
def sigmoid(v): return F.when(v >= 0, F.try_divide(F.lit(1.0), 1 + F.exp(-v))).otherwise(F.try_divide(F.exp(v), 1 + F.exp(v)))
def silu(v): return v * sigmoid(v)


_GELU = math.sqrt(2 / math.pi)


def gelu(v):
    """The tanh form."""
    return 0.5 * v * (1 + F.tanh(_GELU * (v + 0.044715 * v * v * v)))


def leaky_relu(v, slope=0.01): return F.when(v > 0, v).otherwise(v * slope)
def elu(v, alpha=1.0): return F.when(v > 0, v).otherwise(alpha * F.expm1(v))
def softplus(v): return F.greatest(v, F.lit(0.0)) + F.log1p(F.exp(-F.abs(v)))
def sigmoid_prime(v): return sigmoid(v) * (1 - sigmoid(v))
def silu_prime(v): return sigmoid(v) * (1 + v * (1 - sigmoid(v)))


def gelu_prime(v):
    t = F.tanh(_GELU * (v + 0.044715 * v * v * v))
    return 0.5 * (1 + t) + 0.5 * v * (1 - t * t) * _GELU * (1 + 3 * 0.044715 * v * v)


def relu_prime(v): return F.when(v > 0, 1.0).otherwise(0.0)


ACTIVATIONS = {"none": (lambda v: v, lambda v: F.lit(1.0)), "relu": (relu, relu_prime), "gelu": (gelu, gelu_prime), "silu": (silu, silu_prime), "sigmoid": (sigmoid, sigmoid_prime), "tanh": (F.tanh, lambda v: 1 - F.tanh(v) * F.tanh(v))}


def activation_mul(kind: str, a, b): return ACTIVATIONS[kind][0](a) * b
def silu_mul(a, b): return activation_mul("silu", a, b)
def gelu_mul(a, b): return activation_mul("gelu", a, b)
def relu_mul(a, b): return activation_mul("relu", a, b)
def sigmoid_mul(a, b): return activation_mul("sigmoid", a, b)


def activation_mul_bwd(kind: str, grad, a, b) -> tuple[Column, Column]:
    """Gradients of activation(a) * b by a and by b."""
    f, prime = ACTIVATIONS[kind]
    return grad * b * prime(a), grad * f(a)


def dropout(v, p: float, seed: int, *index, training: bool = True):
    """Zeroes each element with probability p, by a hash of its index, and scales the rest."""
    return F.when(uniform(seed, *index) >= p, v / (1 - p)).otherwise(0.0) if training else v


def uniform(seed: int, *index) -> Column:
    """[0, 1) from a hash of seed and index: the same for any partitioning."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *index), 11) * F.lit(2.0**-53)


# complex numbers: STRUCT<re, im>

def make_complex(re, im): return F.struct(re.cast("double").alias("re"), im.cast("double").alias("im"))
def real(z): return z["re"]
def imag(z): return z["im"]
def conj(z): return make_complex(z["re"], -z["im"])
def angle(z): return F.atan2(z["im"], z["re"])
def angle_real(v): return F.when(v < 0, F.lit(math.pi)).otherwise(0.0)
def complex_mul_real(z, r): return make_complex(z["re"] * r, z["im"] * r)
def real_mul_complex(r, z): return complex_mul_real(z, r)
def complex_div_real(z, r): return make_complex(ieee_div(z["re"], r), ieee_div(z["im"], r))
def complex_mul(x, y): return make_complex(x["re"] * y["re"] - x["im"] * y["im"], x["re"] * y["im"] + x["im"] * y["re"])


def one_hot(index, classes: int) -> Column:
    """An array of 0.0 and 1.0; all zero for a class out of range."""
    return F.transform(F.sequence(F.lit(0), F.lit(classes - 1)), lambda k: (k == index).cast("float"))


def polyval(coefficients: list[float], x) -> Column:
    """Ascending coefficients, by Horner's rule."""
    out = F.lit(0.0)
    for c in reversed(coefficients):
        out = out * x + float(c)
    return out


def legendre_p(n: int, x) -> Column:
    before, p = F.lit(1.0), x
    if n == 0:
        return before
    for k in range(1, n):
        before, p = p, ((2 * k + 1) * x * p - k * before) / (k + 1)
    return p


def legendre_p_assoc(n: int, m: int, x) -> Column:
    """With the Condon-Shortley phase."""
    p = F.lit(1.0)
    for k in range(1, m + 1):
        p = p * -(2.0 * k - 1) * F.sqrt(1 - x * x)
    if n == m:
        return p
    before, p = p, x * (2 * m + 1) * p
    for k in range(m + 2, n + 1):
        before, p = p, ((2 * k - 1) * x * p - (k + m - 1) * before) / (k - m)
    return p


def sph_harm(n: int, m: int, theta, phi) -> Column:
    """Real spherical harmonic; theta is the polar angle."""
    k = abs(m)
    norm = math.sqrt((2 * n + 1) / (4 * math.pi) * math.factorial(n - k) / math.factorial(n + k))
    p = norm * legendre_p_assoc(n, k, F.cos(theta))
    if m == 0:
        return p
    return math.sqrt(2) * (-1) ** k * p * (F.cos(k * phi) if m > 0 else F.sin(k * phi))
