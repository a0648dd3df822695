"""Special functions, random sources, solvers, decompositions, differentiation, collectives and a streaming window."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.functions.special import ONE, special
from tabulon.operators import autograd as A
from tabulon.operators import collectives, iterative, linalg, sparse_direct, tensor_decompose, transforms
from tabulon.operators.sparse import Sparse
from tabulon.plans.tensor import Tensor
from tabulon.queries.arrays import CS, M, class_sums, flows, matrix, r, saved
from tabulon.queries.elementwise import P, U, X
from tabulon.sources import random as R
from tabulon.streaming import windows

QUERIES, ORACLES = {}, {}


def q(name, sql=None, digits=5):
    def register(f):
        def query(spark, sf_dir):
            out = f(spark, sf_dir)
            df = out.df if isinstance(out, Tensor | Sparse) else out
            return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return f
    return register


def lines(s, d): return s.read.parquet(f"{d}/lineitem.parquet")


_SQL = {"gamma": f"gamma({P})", "lgamma": f"lgamma({P})"}
for _name in ONE:
    _in = {"erfinv": U, "ellipk": f"abs({U}) * 0.9", "ellipe": f"abs({U}) * 0.9"}.get(_name, P if _name.startswith(("gamma", "lgamma", "digamma", "bessel_y", "bessel_k")) else X)
    q(f"special_{_name}", f"SELECT l_orderkey, l_linenumber, round({_SQL[_name]}, 5) + 0.0 AS v FROM lineitem" if _name in _SQL else None)((lambda n, x: lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", special(n, F.expr(x)).alias("v")))(_name, _in))
for _name, _args in {"beta": ("p", "q"), "betainc": ("p", "q", "u"), "gammainc": ("p", "q"), "gammaincc": ("p", "q"), "gammaincinv": ("p", "u"), "betaincinv": ("p", "q", "u")}.items():
    q(f"special_{_name}")((lambda n, a: lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", special(n, *(F.expr({"p": "l_quantity / 10 + 0.5", "q": "l_tax * 50 + 1", "u": "l_discount * 9 + 0.05"}[x]) for x in a)).alias("v")))(_name, _args))
q("special_hyp2f1")(lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", special("hyp2f1", F.col("l_discount") * 5, a=1.0, b=2.0, c=3.0).alias("v")))
q("special_hyp1f1")(lambda s, d: lines(s, d).select("l_orderkey", "l_linenumber", special("hyp1f1", F.expr(U), a=1.0, b=2.0).alias("v")))

N = 5000
for _name, _f in {
    "rand": lambda s: R.rand(s, (N,), 1), "randn": lambda s: R.randn(s, (N,), 1), "randint": lambda s: R.randint(s, 0, 10, (N,), 1), "bernoulli": lambda s: R.bernoulli(s, 0.3, (N,), 1), "exponential": lambda s: R.exponential(s, 2, (N,), 1),
    "laplace": lambda s: R.laplace(s, 0, 1, (N,), 1), "poisson": lambda s: R.poisson(s, 3, (N,), 1), "binomial": lambda s: R.binomial(s, 10, 0.4, (N,), 1), "beta": lambda s: R.beta(s, 2, 3, (N,), 1), "gamma": lambda s: R.gamma(s, 2, 1, (N,), 1),
    "chi_squared": lambda s: R.chi_squared(s, 3, (N,), 1), "student_t": lambda s: R.student_t(s, 8, (N,), 1), "f_distribution": lambda s: R.f_distribution(s, 5, 9, (N,), 1), "randperm": lambda s: R.randperm(s, N, 1),
    "multinomial": lambda s: R.multinomial(Tensor.from_slice(s, [0.2, 0.5, 0.3], (3,)), N), "multivariate_normal": lambda s: R.multivariate_normal(s, [0, 1], [[1, 0.5], [0.5, 2]], 500), "wishart": lambda s: R.wishart(s, [[1, 0.2], [0.2, 1]], 5, 200),
    "dirichlet": lambda s: R.dirichlet(s, [1, 2, 3], 500), "multinomial_samples": lambda s: R.multinomial_samples(s, [0.2, 0.8], 10, 500), "latin_hypercube": lambda s: R.latin_hypercube(s, 200, 3, 1),
    "philox_uniform": lambda s: R.philox_uniform(s, (N,), 7), "philox_randn": lambda s: R.philox_randn(s, (N,), 7), "pcg64_uniform": lambda s: R.pcg64_uniform(s, (N,), 7), "pcg64_randn": lambda s: R.pcg64_randn(s, (N,), 7),
    "threefry_uniform": lambda s: R.threefry_uniform(s, (N,), 7), "threefry_randn": lambda s: R.threefry_randn(s, (N,), 7), "xoshiro256_uniform": lambda s: R.xoshiro256_uniform(s, (N,), 7), "xoshiro256_randn": lambda s: R.xoshiro256_randn(s, (N,), 7),
}.items():
    q(f"random_{_name}")((lambda f: lambda s, d: f(s))(_f))
q("random_randperm_is_permutation", f"SELECT g AS v, 1 AS n FROM range({N}) t(g)")(lambda s, d: R.randperm(s, N, 1).df.groupBy(F.col("v").cast("long").alias("v")).agg(F.count("*").alias("n")))
q("random_latin_hypercube_strata", "SELECT b AS i1, g AS stratum, 1 AS n FROM range(200) t(g), range(3) u(b)")(lambda s, d: R.latin_hypercube(s, 200, 3, 1).df.groupBy("i1", F.floor(F.col("v") * 200).alias("stratum")).agg(F.count("*").alias("n")))


def system(s, d, symmetric=True) -> tuple[Sparse, Tensor]:
    """The nations' flows, made diagonally dominant; its solution is 1, 2, ..., 25."""
    f = saved(flows(s, d))
    a = f.add(f.transpose()) if symmetric else f
    a = a.add(Sparse(s.range(25).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v")), (25, 25)))
    # strongly dominant, so that a few steps do
    total = a.df.groupBy("row").agg(F.sum("v").alias("t"))
    a = a.add(Sparse(total.select("row", F.col("row").alias("col"), (F.col("t") * 5).alias("v")), (25, 25)))
    return a, a.spmv(Tensor.arange(s, 1, 26))


_ONES = "SELECT g AS i0, CAST(g + 1 AS DOUBLE) AS v FROM range(25) t(g)"
for _name, _sym in {"cg": True, "gmres": False, "bicgstab": False, "minres": True, "cgs": False, "lgmres": False, "qmr": False, "jacobi": True, "sor": True, "adaptive_gmres": False}.items():
    q(f"solve_{_name}", _ONES, 3)((lambda n, y: lambda s, d: getattr(iterative, {"sor": "block_sor"}.get(n, n))(*system(s, d, y), rtol=1e-7).x)(_name, _sym))
q("solve_multigrid", _ONES, 3)(lambda s, d: iterative.two_grid(*system(s, d)).x)
q("sparse_eig_symmetric", digits=3)(lambda s, d: (lambda w: s.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k int, v double"))(iterative.sparse_eig_symmetric(system(s, d)[0], 3)[0]))
q("sparse_eig", digits=3)(lambda s, d: (lambda w: s.createDataFrame([(k, float(x.real), float(x.imag)) for k, x in enumerate(w)], "k int, re double, im double"))(iterative.sparse_eig(system(s, d, False)[0], 3)))
q("svds", digits=3)(lambda s, d: (lambda w: s.createDataFrame([(k, float(x)) for k, x in enumerate(w)], "k int, v double"))(iterative.svds(system(s, d, False)[0], 3)[0]))


def _batch(s, d, symmetric=True): return system(s, d, symmetric)[0].df.select(F.lit(0).cast("long").alias("m"), F.col("row").alias("i0"), F.col("col").alias("i1"), "v")


for _name in ("ilu0", "ic0", "iluk", "ilu0_symbolic", "iluk_symbolic", "sparse_lu", "sparse_qr", "maximum_transversal", "structural_rank", "column_ordering"):
    q(f"direct_{_name}", digits=3)((lambda n: lambda s, d: getattr(sparse_direct, n)(_batch(s, d)))(_name))
q("direct_iluk_numeric", digits=3)(lambda s, d: sparse_direct.iluk_numeric(_batch(s, d), sparse_direct.iluk_symbolic(_batch(s, d), 1)))
_SOL = "SELECT 0 AS m, 'x' AS part, g AS i0, 0 AS i1, CAST(g + 1 AS DOUBLE) AS re, 0.0 AS im FROM range(25) t(g)"
q("direct_sparse_lu_solve", _SOL, 3)(lambda s, d: sparse_direct.sparse_lu_solve(_batch(s, d), system(s, d)[1].df.select(F.lit(0).cast("long").alias("m"), "i0", F.lit(0).cast("long").alias("i1"), "v")))
q("direct_sparse_solve_triangular", _ONES, 3)(lambda s, d: (lambda t: sparse_direct.sparse_solve_triangular(t, t.spmv(Tensor.arange(s, 1, 26))))(Sparse(system(s, d)[0].df.where("col <= row"), (25, 25))))


def _cube(s, d) -> Tensor: return (lambda t: t.reshape((t.shape[0], 8, 8)))(class_sums(s, d))


_CUBE = f"WITH {M}, {CS} SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, {r('v', 3)} AS v FROM cs"
q("hosvd_reconstruct", _CUBE, 3)(lambda s, d: (lambda t: tensor_decompose.tucker_reconstruct(tensor_decompose.hosvd(t, t.shape)))(_cube(s, d)))
q("tucker", digits=2)(lambda s, d: tensor_decompose.tucker(_cube(s, d), (4, 3, 3), 2).core.map(F.abs))
q("tensor_train_reconstruct", _CUBE, 3)(lambda s, d: tensor_decompose.tt_reconstruct(s, tensor_decompose.tensor_train(_cube(s, d), 64)))
q("cp_decompose", digits=2)(lambda s, d: tensor_decompose.cp_reconstruct(s, *tensor_decompose.cp_decompose(_cube(s, d), 2, 2)))

q("polyroots", "SELECT 0 AS i, g AS k, CAST(g + 1 AS DOUBLE) AS re, 0.0 AS im FROM range(3) t(g)", 6)(lambda s, d: transforms.polyroots(s.createDataFrame([(0, [-6.0, 11.0, -6.0, 1.0])], "i long, vec array<double>")).select("i", F.posexplode(F.sort_array("vec")).alias("k", "z")).select("i", "k", "z.re", "z.im"))
q("polyfromroots", "SELECT 0 AS i, * FROM (VALUES (0, -6.0), (1, 11.0), (2, -6.0), (3, 1.0)) t(k, v)", 6)(lambda s, d: transforms.polyfromroots(s.createDataFrame([(0, [1.0, 2.0, 3.0])], "i long, vec array<double>")).select("i", F.posexplode("vec").alias("k", "v")))

# reverse mode: gradients with a closed form in SQL
for _name, _sql in {"exp": "exp(v)", "log": "1 / v", "sqrt": "0.5 / sqrt(v)", "sin": "cos(v)", "cos": "-sin(v)", "tan": "1 + tan(v) * tan(v)", "tanh": "4 / pow(exp(v) + exp(-v), 2)", "square": "2 * v", "recip": "-1 / (v * v)", "abs": "1.0", "neg": "-1.0", "relu": "1.0", "sigmoid": "exp(-v) / pow(1 + exp(-v), 2)", "silu": "(1 + exp(-v) * (1 + v)) / pow(1 + exp(-v), 2)", "softplus": "1 / (1 + exp(-v))"}.items():
    q(f"grad_{_name}", f"WITH {M}, p AS (SELECT i0, i1, abs(v) + 0.5 AS v FROM m) SELECT i0, i1, {r(_sql)} AS v FROM p")((lambda n: lambda s, d: (lambda x: A.backward(A.var_sum(getattr(A, f"var_{n}")(x)))[x])(A.Var(matrix(s, d).map(lambda v: F.abs(v) + 0.5))))(_name))
q("grad_matmul", f"WITH {M} SELECT g AS i0, i0 AS i1, {r('sum(v)')} AS v FROM m, range(4) t(g) GROUP BY 1, 2")(lambda s, d: (lambda t: (lambda x: A.backward(A.var_sum(A.var_matmul(x, A.Var(t))))[x])(A.Var(Tensor.ones(s, (4, t.shape[0])))))(matrix(s, d)))
q("grad_softmax_cross", f"WITH {M} SELECT i0, i1, {r('exp(v) / sum(exp(v)) OVER (PARTITION BY i0) - CASE WHEN i1 = 0 THEN 1 ELSE 0 END')} AS v FROM m")(lambda s, d: (lambda x: A.backward(A.var_neg(A.var_sum(A.var_mul(A.var_log_softmax(x), A.Var(Tensor(x.value.df.withColumn("v", (F.col("i1") == 0).cast("double")), x.shape), [], False)))))[x])(A.Var(matrix(s, d))))
q("grad_mean_broadcast", f"WITH {M} SELECT i1 AS i0, {r('avg(v)')} AS v FROM m GROUP BY i1")(lambda s, d: (lambda t: (lambda b: A.backward(A.var_sum(A.var_mean(A.var_mul(A.Var(t), b), [0])))[b])(A.Var(Tensor.ones(s, (64,)))))(matrix(s, d)))
q("grad_var", f"WITH {M} SELECT i0, i1, {r('2 * (v - avg(v) OVER (PARTITION BY i0)) / 63')} AS v FROM m")(lambda s, d: (lambda x: A.backward(A.var_sum(A.var_var(x, [1])))[x])(A.Var(matrix(s, d))))
q("grad_embedding_lookup", f"WITH {M} SELECT i0, i1, CASE WHEN i0 < 2 THEN 3.0 WHEN i0 < 4 THEN 2.0 ELSE 0.0 END AS v FROM m")(lambda s, d: (lambda x: A.backward(A.var_sum(A.var_embedding_lookup(x, Tensor.generate(s, (10,), lambda i: (i % 4).cast("double")))))[x])(A.Var(matrix(s, d))))
q("grad_second_order", f"WITH {M} SELECT i0, i1, {r('6 * v')} AS v FROM m")(lambda s, d: (lambda x: A.backward(A.var_sum(A.backward_with_graph(A.var_sum(A.var_mul(x, A.var_square(x))))[x]))[x])(A.Var(matrix(s, d))))
q("jvp_sin_product", f"WITH {M} SELECT i0, i1, {r('cos(v) * v * 2 + sin(v) * 2')} AS v FROM m")(lambda s, d: (lambda t: A.jvp(lambda x: A.dual_mul(A.dual_sin(x), x), [t], [t.map(lambda v: F.lit(2.0))])[1])(matrix(s, d)))
q("dual_matmul", f"WITH {M} SELECT a.i1 AS i0, b.i1 AS i1, {r('2 * sum(a.v * b.v)')} AS v FROM m a JOIN m b USING (i0) GROUP BY 1, 2")(lambda s, d: (lambda t: A.jvp(lambda x: A.dual_matmul(A.dual_transpose(x), x), [t], [t])[1])(matrix(s, d)))
q("jacobian_forward", "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN 2.0 * a ELSE 0.0 END AS v FROM range(5) t(a), range(5) u(b)")(lambda s, d: A.jacobian_forward(A.dual_square, Tensor.arange(s, 0, 5)))
q("hvp", f"WITH {M} SELECT i0, i1, {r('6 * v * 2')} AS v FROM m")(lambda s, d: (lambda t: A.hvp(lambda x: A.dual_mul_scalar(A.dual_square(x), 3.0), t, t.map(lambda v: F.lit(2.0))))(matrix(s, d)))

_RANKS = "x AS (SELECT l_linenumber AS rank, l_suppkey % 10 AS i0, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def _parts(s, d): return lines(s, d).groupBy(F.col("l_linenumber").alias("rank"), (F.col("l_suppkey") % 10).alias("i0")).agg(F.sum("l_quantity").alias("v"))


q("all_reduce", f"WITH {_RANKS} SELECT i0, rank, sum(v) OVER (PARTITION BY i0) AS v FROM x")(lambda s, d: collectives.all_reduce(_parts(s, d)))
q("all_gather", f"WITH {_RANKS} SELECT r.rank, x.rank AS part, i0, v FROM x, (SELECT DISTINCT rank FROM x) r")(lambda s, d: collectives.all_gather(_parts(s, d)))
q("collective_broadcast", f"WITH {_RANKS} SELECT r.rank, i0, v FROM x, (SELECT DISTINCT rank FROM x) r WHERE x.rank = 2")(lambda s, d: collectives.broadcast(_parts(s, d), 2))
q("reduce_scatter", f"WITH {_RANKS} SELECT i0, sum(v) AS v, CAST(i0 * 5 // 10 AS INTEGER) AS rank FROM x GROUP BY i0")(lambda s, d: collectives.reduce_scatter(_parts(s, d), 5))
q("window_totals", "SELECT CAST(floor(epoch(ts) / 3600) AS BIGINT) AS hour, event_type, count(*) AS n, round(sum(value), 4) + 0.0 AS total FROM events GROUP BY 1, 2", 4)(lambda s, d: windows.totals(s.read.parquet(f"{d}/events.parquet")))
