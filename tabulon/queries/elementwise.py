"""Element-wise operators over all of lineitem."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions import elementwise as E

U = "((l_extendedprice - floor(l_extendedprice / 2000) * 2000) / 1000 - 1)"  # -1 to 1
P = "(l_extendedprice / 10000 + 0.1)"  # positive
X = "((l_extendedprice - floor(l_extendedprice / 2000) * 2000) / 200 - 5)"  # -5 to 5
Q = "(l_quantity - 25)"  # whole, with zeros
D = "(l_discount * 100 - 5)"

QUERIES, ORACLES = {}, {}


def _register(name: str, inputs: list[str], f, sql: str, digits: int | None = 8) -> None:
    def query(spark, sf_dir):
        rows = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
        v = f(*(F.expr(x).cast("double") for x in inputs))
        v = v.cast("double") if digits is None else F.round(v, digits) + F.lit(0.0)
        return rows.select("l_orderkey", "l_linenumber", v.alias("v"))

    QUERIES[name] = query
    for k, x in enumerate(inputs):
        sql = sql.replace(f"${k}", f"CAST({x} AS DOUBLE)")
    ORACLES[name] = f"SELECT l_orderkey, l_linenumber, {f'CAST({sql} AS DOUBLE)' if digits is None else f'round({sql}, {digits}) + 0.0'} AS v FROM lineitem"


for _name, _input, _sql in [
    ("neg", X, "-$0"), ("abs", X, "abs($0)"), ("sign", Q, "CASE WHEN $0 > 0 THEN 1 WHEN $0 < 0 THEN -1 ELSE 0 END"), ("sqrt", P, "sqrt($0)"), ("rsqrt", P, "1 / sqrt($0)"), ("square", X, "$0 * $0"),
    ("cbrt", X, "cbrt($0)"), ("recip", P, "1 / $0"), ("exp", X, "exp($0)"), ("exp2", X, "pow(2.0, $0)"), ("expm1", X, "exp($0) - 1"), ("log", P, "ln($0)"), ("log2", P, "log2($0)"), ("log10", P, "log10($0)"),
    ("log1p", P, "ln(1 + $0)"), ("sin", X, "sin($0)"), ("cos", X, "cos($0)"), ("tan", U, "tan($0)"), ("asin", U, "asin($0)"), ("acos", U, "acos($0)"), ("atan", X, "atan($0)"), ("sinh", X, "(exp($0) - exp(-$0)) / 2"),
    ("cosh", X, "(exp($0) + exp(-$0)) / 2"), ("tanh", X, "(exp(2 * $0) - 1) / (exp(2 * $0) + 1)"), ("asinh", X, "asinh($0)"), ("acosh", f"({P} + 1)", "acosh($0)"), ("atanh", f"({U} * 0.9)", "atanh($0)"),
    ("floor", X, "floor($0)"), ("ceil", X, "ceil($0)"), ("round", X, "round($0)"), ("trunc", X, "trunc($0)"), ("isnan", X, "CASE WHEN isnan($0) THEN 1 ELSE 0 END"), ("isinf", X, "CASE WHEN isinf($0) THEN 1 ELSE 0 END"),
]:
    _register(f"unary_{_name}", [_input], E.UNARY[_name], _sql)

for _name, _a, _b, _sql in [
    ("add", X, P, "$0 + $1"), ("sub", X, P, "$0 - $1"), ("mul", X, P, "$0 * $1"), ("div", X, P, "$0 / $1"), ("pow", P, U, "pow($0, $1)"), ("maximum", X, Q, "CASE WHEN $0 > $1 THEN $0 ELSE $1 END"),
    ("minimum", X, Q, "CASE WHEN $0 < $1 THEN $0 ELSE $1 END"), ("atan2", X, Q, "atan2($0, $1)"), ("add_into", X, Q, "$0 + $1"),
]:
    _register(f"binary_{_name}", [_a, _b], E.BINARY[_name], _sql, 12 if _name == "mul" else 8)
_register("binary_fused_mul_add", [X, P, Q], E.fused_mul_add, "$0 * $1 + $2", 12)
_register("binary_fused_add_mul", [X, P, Q], E.fused_add_mul, "($0 + $1) * $2")

for _name, _sql in [("add_scalar", "$0 + 2.5"), ("sub_scalar", "$0 - 2.5"), ("mul_scalar", "$0 * 2.5"), ("div_scalar", "$0 / 2.5"), ("pow_scalar", "pow($0, 2.5)"), ("rsub_scalar", "2.5 - $0")]:
    _register(f"scalar_{_name}", [P], (lambda n: lambda v: E.SCALAR[n](v, 2.5))(_name), _sql)
_register("scalar_fused_mul_add_scalar", [X], lambda v: E.fused_mul_add_scalar(v, 3, -1), "$0 * 3 - 1")

for _name, _sql in [("eq", "="), ("ne", "<>"), ("lt", "<"), ("le", "<="), ("gt", ">"), ("ge", ">=")]:
    _register(f"compare_{_name}", [Q, D], E.COMPARE[_name], f"CASE WHEN $0 {_sql} $1 THEN 1 ELSE 0 END", None)
_register("logical_and", [Q, D], E.logical_and, "CASE WHEN $0 <> 0 AND $1 <> 0 THEN 1 ELSE 0 END", None)
_register("logical_or", [Q, D], E.logical_or, "CASE WHEN $0 <> 0 OR $1 <> 0 THEN 1 ELSE 0 END", None)
_register("logical_xor", [Q, D], E.logical_xor, "CASE WHEN ($0 <> 0) <> ($1 <> 0) THEN 1 ELSE 0 END", None)
_register("logical_not", [Q], E.logical_not, "CASE WHEN $0 = 0 THEN 1 ELSE 0 END", None)
_register("where_cond", [Q, X, P], E.where_cond, "CASE WHEN $0 <> 0 THEN $1 ELSE $2 END")
_register("clamp", [X], lambda v: E.clamp(v, -2, 3), "least(greatest($0, -2.0), 3.0)")
for _kind, (_low, _high, _) in E.INTEGERS.items():
    _big = f"({X} * 1000)"
    _register(f"cast_{_kind}", [_big], (lambda k: lambda v: E.cast(v, k))(_kind), f"least(greatest(trunc($0), {_low}), {_high})", None)
_register("cast_bool", [Q], lambda v: E.cast(v, "bool"), "CASE WHEN $0 <> 0 THEN 1 ELSE 0 END", None)
_register("cast_f32", [X], lambda v: E.cast(v, "f32"), "CAST(CAST($0 AS FLOAT) AS DOUBLE)", None)
_register("cast_bf16", [P], lambda v: E.cast(v, "bf16"), "round_even($0 / pow(2.0, floor(log2($0)) - 7), 0) * pow(2.0, floor(log2($0)) - 7)")
_register("cast_f16", [P], lambda v: E.cast(v, "f16"), "round_even($0 / pow(2.0, floor(log2($0)) - 10), 0) * pow(2.0, floor(log2($0)) - 10)")

_S = "(1 / (1 + exp(-$0)))"
_T = "tanh(0.7978845608028654 * ($0 + 0.044715 * $0 * $0 * $0))"
_TD = "((exp(2 * 0.7978845608028654 * ($0 + 0.044715 * $0 * $0 * $0)) - 1) / (exp(2 * 0.7978845608028654 * ($0 + 0.044715 * $0 * $0 * $0)) + 1))"
_ACT = {"relu": "greatest($0, 0.0)", "sigmoid": _S, "silu": f"$0 * {_S}", "gelu": f"0.5 * $0 * (1 + {_TD})"}
for _name, _sql in _ACT.items():
    _register(f"activation_{_name}", [X], getattr(E, _name), _sql)
    _register(f"activation_{_name}_mul", [X, P], getattr(E, f"{_name}_mul"), f"({_sql}) * $1", 12 if _name == "relu" else 8)
_register("activation_leaky_relu", [X], lambda v: E.leaky_relu(v, 0.1), "CASE WHEN $0 > 0 THEN $0 ELSE $0 * 0.1 END")
_register("activation_elu", [X], lambda v: E.elu(v, 1.5), "CASE WHEN $0 > 0 THEN $0 ELSE 1.5 * (exp($0) - 1) END")
_register("activation_softplus", [X], E.softplus, "ln(1 + exp($0))")
_PRIME = {"relu": "CASE WHEN $1 > 0 THEN 1.0 ELSE 0.0 END", "sigmoid": f"({_S} * (1 - {_S}))".replace("$0", "$1"), "silu": f"({_S} * (1 + $0 * (1 - {_S})))".replace("$0", "$1"), "gelu": f"(0.5 * (1 + {_TD}) + 0.5 * $0 * (1 - {_TD} * {_TD}) * 0.7978845608028654 * (1 + 0.134145 * $0 * $0))".replace("$0", "$1")}
for _name in _ACT:
    _register(f"activation_{_name}_mul_bwd", [U, X, P], (lambda n: lambda g, a, b: E.activation_mul_bwd(n, g, a, b)[0] + E.activation_mul_bwd(n, g, a, b)[1])(_name), f"$0 * $2 * ({_PRIME[_name]}) + $0 * ({_ACT[_name].replace('$0', '$1')})", 7)

Z = (X, P)
for _name, _f, _sql in [
    ("real", lambda a, b: E.real(E.make_complex(a, b)), "$0"), ("imag", lambda a, b: E.imag(E.make_complex(a, b)), "$1"), ("conj", lambda a, b: E.imag(E.conj(E.make_complex(a, b))), "-$1"),
    ("angle", lambda a, b: E.angle(E.make_complex(a, b)), "atan2($1, $0)"), ("angle_real", lambda a, b: E.angle_real(a), "CASE WHEN $0 < 0 THEN 3.141592653589793 ELSE 0 END"), ("make_complex", lambda a, b: E.make_complex(a, b)["re"] + E.make_complex(a, b)["im"], "$0 + $1"),
    ("mul_real", lambda a, b: E.complex_mul_real(E.make_complex(a, b), b)["im"], "$1 * $1"), ("real_mul", lambda a, b: E.real_mul_complex(b, E.make_complex(a, b))["re"], "$0 * $1"), ("div_real", lambda a, b: E.complex_div_real(E.make_complex(a, b), b)["re"], "$0 / $1"),
]:
    _register(f"complex_{_name}", list(Z), _f, _sql, 12 if "mul" in _name else 8)

_register("polyval", [U], lambda v: E.polyval([1, -2, 0.5, 3], v), "((3 * $0 + 0.5) * $0 - 2) * $0 + 1")
_register("legendre_p", [U], lambda v: E.legendre_p(3, v), "(5 * $0 * $0 * $0 - 3 * $0) / 2")
_register("legendre_p_assoc", [U], lambda v: E.legendre_p_assoc(2, 1, v), "-3 * $0 * sqrt(1 - $0 * $0)")
_register("sph_harm", [P, X], lambda t, p: E.sph_harm(2, 0, t, p), "sqrt(5 / (4 * pi())) * (3 * cos($0) * cos($0) - 1) / 2")
