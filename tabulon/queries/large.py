"""Factorizations, solves and transforms of single large matrices and vectors, each against an identity that SQL can state."""

from __future__ import annotations

import dataclasses
import math

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tabulon.operators import blocked, contraction, iterative, long_decompose, long_fft, multigrid, sparse_levels, tall
from tabulon.operators.blocked import Blocks
from tabulon.operators.sparse import Sparse
from tabulon.plans.tensor import Tensor
from tabulon.queries.arrays import M, flows, matrix, parts, r, saved
from tabulon.queries.register import registrar

QUERIES, ORACLES = {}, {}
q = registrar(QUERIES, ORACLES)

# the Gram matrix of all embeddings, 64 x 64, in blocks of 16
G = f"{M}, g AS (SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) + CASE WHEN a.i1 = b.i1 THEN 1 ELSE 0 END AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY 1, 2)"


def gram(s, d, side: int = 16) -> Blocks:
    m = matrix(s, d)
    pairs = m.df.join(m.df.select("i0", F.col("i1").alias("j"), F.col("v").alias("w")), "i0").groupBy(F.col("i1").alias("i0"), F.col("j").alias("i1")).agg(F.sum(F.col("v") * F.col("w")).alias("v"))
    return Blocks.of(Tensor(pairs.withColumn("v", F.col("v") + (F.col("i0") == F.col("i1")).cast("double")), (64, 64)), side)


# customers by customers, from orders: neighbours within three of a customer share the value of its orders by the order's number
_CELLS = """SELECT o_custkey AS i, o_custkey + 1 + o_orderkey % 3 AS j, sum(o_totalprice) / 1013 AS v FROM orders GROUP BY 1, 2"""
B = f"""o AS ({_CELLS}), top AS (SELECT max(o_custkey) AS n FROM orders), b AS (
  SELECT i0, i1, sum(v) AS v FROM (SELECT i AS i0, j AS i1, v FROM o, top WHERE j <= n UNION ALL SELECT j, i, v / 2 FROM o, top WHERE j <= n UNION ALL SELECT i, i, 2 * v FROM o UNION ALL SELECT j, j, v FROM o, top WHERE j <= n UNION ALL SELECT g, g, 1 FROM range((SELECT n + 1 FROM top)) t(g)) GROUP BY 1, 2)"""


def banded(s, d, symmetric: bool = False) -> Sparse:
    """Diagonally dominant by columns; made symmetric by halves if asked."""
    o = s.read.parquet(f"{d}/orders.parquet").groupBy(F.col("o_custkey").alias("i"), (F.col("o_custkey") + 1 + F.col("o_orderkey") % 3).alias("j")).agg((F.sum("o_totalprice") / 1013).alias("v"))
    n = s.read.parquet(f"{d}/orders.parquet").agg(F.max("o_custkey")).first()[0]
    inside = F.col("j") <= n
    unit = s.range(n + 1).select(F.col("id").alias("row"), F.col("id").alias("col"), F.lit(1.0).alias("v"))
    parts = [o.where(inside).select("i", "j", (F.col("v") / 2 if symmetric else F.col("v"))), o.where(inside).select("j", "i", F.col("v") / 2), o.select("i", "i", 2 * F.col("v")), o.where(inside).select("j", "j", "v")]
    every = unit
    for p in parts:
        every = every.unionByName(p.toDF("row", "col", "v"))
    return Sparse.summed(every, (n + 1, n + 1))


def _product(f: blocked.LU) -> Blocks: return blocked.multiply(f.low, dataclasses.replace(f.up, shape=f.low.shape))
def _stored(x: Blocks): return x.cells().where(F.abs("v") > 1e-6)


_BAND = f"WITH {B} SELECT i0, i1, {r('v', 4)} AS v FROM b"
_SYMMETRIC = f"WITH {B.replace('SELECT i AS i0, j AS i1, v FROM o', 'SELECT i AS i0, j AS i1, v / 2 AS v FROM o')} SELECT i0, i1, {r('v', 4)} AS v FROM b"
q("blocked_lu_gram", f"WITH {G} SELECT i0, i1, {r('v', 4)} AS v FROM g", lambda s, d: _product(blocked.lu(gram(s, d))).cells(), 4)
q("blocked_cholesky_gram", f"WITH {G} SELECT i0, i1, {r('v', 4)} AS v FROM g", lambda s, d: (lambda low: blocked.multiply(low, low.transpose()))(blocked.cholesky(gram(s, d))).cells(), 4)
q("blocked_inverse_gram", "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS v FROM range(64) t(a), range(64) u(b)", lambda s, d: (lambda g: blocked.multiply(g, blocked.inverse(g)))(gram(s, d)).cells(), 4)
q("blocked_slogdet_triangle", f"WITH {G} SELECT 1.0 AS sign, {r('sum(ln(v))', 4)} AS logabsdet FROM g WHERE i0 = i1", lambda s, d: s.createDataFrame([blocked.lu(Blocks.of(Tensor(gram(s, d).cells().where("i1 <= i0"), (64, 64)), 16)).slogdet()], "sign double, logabsdet double"), 4)
q("blocked_lu_banded", _BAND, lambda s, d: _stored(_product(blocked.lu(Blocks.of(banded(s, d), 512)))), 4)
q("blocked_cholesky_banded", _SYMMETRIC, lambda s, d: (lambda low: _stored(blocked.multiply(low, low.transpose())))(blocked.cholesky(Blocks.of(banded(s, d, True), 512))), 4)
q("blocked_solve_banded", "SELECT g AS i0, CAST(0 AS BIGINT) AS i1, CAST(g % 7 + 1 AS DOUBLE) AS v FROM range((SELECT max(o_custkey) + 1 FROM orders)) t(g)", lambda s, d: (lambda a: blocked.solve(Blocks.of(a, 512), Blocks.of(Tensor(a.spmv(Tensor.generate(s, (a.shape[0],), lambda i: (i % 7 + 1).cast("double"))).df.select("i0", F.lit(0).cast("long").alias("i1"), "v"), (a.shape[0], 1)), 512)).cells())(banded(s, d)), 4)

# orders by orders: an order shares cells with the next one and the third next one of its customer and status; symmetric, diagonally dominant
C = """w AS (SELECT o_orderkey AS i, lead(o_orderkey, 1) OVER c AS j1, lead(o_orderkey, 3) OVER c AS j3, o_totalprice / 1013 AS v FROM orders WINDOW c AS (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey)),
e AS (SELECT i, j1 AS j, v FROM w WHERE j1 IS NOT NULL UNION ALL SELECT i, j3, v / 3 FROM w WHERE j3 IS NOT NULL),
c AS (SELECT "row", col, sum(v) AS v FROM (SELECT i AS "row", j AS col, -v AS v FROM e UNION ALL SELECT j, i, -v FROM e UNION ALL SELECT i, i, v * 3 FROM e UNION ALL SELECT j, j, v * 3 FROM e UNION ALL SELECT i, i, 1 FROM w) GROUP BY 1, 2)"""


def chains(s, d) -> Sparse:
    o = s.read.parquet(f"{d}/orders.parquet")
    after = W.partitionBy("o_custkey", "o_orderstatus").orderBy("o_orderkey")
    w = o.select(F.col("o_orderkey").alias("i"), F.lead("o_orderkey", 1).over(after).alias("j1"), F.lead("o_orderkey", 3).over(after).alias("j3"), (F.col("o_totalprice") / 1013).alias("v"))
    e = w.select("i", F.col("j1").alias("j"), "v").unionByName(w.select("i", F.col("j3").alias("j"), (F.col("v") / 3).alias("v"))).where("j IS NOT NULL")
    more = F.col("v") * 3
    every = e.select("i", "j", -F.col("v")).toDF("row", "col", "v")
    for x in (e.select("j", "i", -F.col("v")), e.select("i", "i", more), e.select("j", "j", more), w.select("i", "i", F.lit(1.0))):
        every = every.unionByName(x.toDF("row", "col", "v"))
    n = o.agg(F.max("o_orderkey")).first()[0] + 1
    return Sparse(sparse_levels.Scratch(s).save(Sparse.summed(every, (n, n)).df, "chains"), (n, n))


def on_pattern(low: Sparse, up: Sparse, pattern) -> Sparse:
    """The product on the cells of a pattern; what isn't stored there is zero."""
    return Sparse(pattern.select("row", "col").join(low.matmul(up).df, ["row", "col"], "left").fillna(0.0, ["v"]), low.shape)




_CHAINS = f'WITH {C} SELECT "row", col, {r("v", 4)} AS v FROM c'
_FILL = f'''WITH {C}, f AS (SELECT "row", col, 0 AS fill FROM c UNION ALL SELECT a."row", b.col, 1 FROM c a JOIN c b ON a.col = b."row" WHERE a.col < a."row" AND b.col > b."row")'''
for _level in (0, 1):
    q(f"ilu{_level}_on_pattern", _CHAINS if not _level else f'{_FILL} SELECT f."row", f.col, {r("coalesce(max(c.v), 0)", 4)} AS v FROM f LEFT JOIN c ON f."row" = c."row" AND f.col = c.col GROUP BY 1, 2', (lambda k: lambda s, d: (lambda a: (lambda f: on_pattern(f.lower(), f.upper(), f.cells))(sparse_levels.ilu(a, k)))(chains(s, d)))(_level), 4)
q("ic0_on_pattern", _CHAINS, lambda s, d: (lambda a: (lambda low: on_pattern(low, low.transpose(), a.df))(sparse_levels.ic(a)))(chains(s, d)), 4)
q("fill_pattern", f'{_FILL} SELECT "row", col, CAST(min(fill) AS INTEGER) AS fill FROM f GROUP BY 1, 2', lambda s, d: sparse_levels.fill_pattern(chains(s, d), 1))
q("row_levels", "SELECT o_orderkey AS \"row\", CAST(row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderkey) - 1 AS INTEGER) AS level FROM orders", lambda s, d: sparse_levels.row_levels(chains(s, d)))
q("sor_multicolour", "SELECT o_orderkey AS i0, CAST(o_orderkey % 7 + 1 AS DOUBLE) AS v FROM orders", lambda s, d: (lambda a: iterative.sor(a, a.spmv(Tensor.generate(s, (a.shape[0],), lambda i: (i % 7 + 1).cast("double"))), rtol=1e-6).x)(chains(s, d)), 3)


def _colouring(s, d):
    a = chains(s, d)
    c = sparse_levels.colours(a)
    met = a.df.where("row <> col").join(c, "row").join(c.select(F.col("row").alias("col"), F.col("colour").alias("other")), "col")
    return c.agg(F.count("*").alias("coloured"), (F.max("colour") <= 4).alias("few")).crossJoin(met.agg(F.count(F.when(F.col("colour") == F.col("other"), 1)).alias("conflicts")))


q("sparse_colours", "SELECT count(*) AS coloured, true AS few, CAST(0 AS BIGINT) AS conflicts FROM orders", _colouring)


def _matching(s, d):
    a = parts(s, d)
    m = sparse_levels.maximum_matching(a)
    return m.join(a.df, ["row", "col"]).agg(F.count("*").alias("size"), F.countDistinct("row").alias("n_rows"), F.countDistinct("col").alias("n_cols"))


# every supplier has more parts than there are suppliers in reach, so the largest matching holds them all
q("maximum_matching", "SELECT count(DISTINCT l_suppkey) AS size, count(DISTINCT l_suppkey) AS n_rows, count(DISTINCT l_suppkey) AS n_cols FROM lineitem", _matching)


def _rcm(s, d):
    a = chains(s, d)
    order = sparse_levels.reverse_cuthill_mckee(a)
    after = sparse_levels.permuted(a, order).df.agg(F.max(F.abs(F.col("row") - F.col("col"))).alias("after"))
    return order.agg(F.count("*").alias("n"), F.countDistinct("place").alias("places"), F.max("place").alias("last")).crossJoin(after).select("n", "places", "last", (F.col("after") <= 12).alias("narrow"))


q("reverse_cuthill_mckee", "SELECT count(*) AS n, count(*) AS places, max(o_orderkey) AS \"last\", true AS narrow FROM orders", _rcm)

# all embeddings as one n x 64 matrix
_ALL = f"WITH {M} SELECT i0, i1, {r('v', 5)} AS v FROM m"
_UNIT64 = "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS v FROM range(64) t(a), range(64) u(b)"


def vectors(s, d): return s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i"), F.col("embedding").alias("vec"))


def times(rows, right) -> Tensor:
    """Rows (i, vec) times a small matrix."""
    s, n = rows.sparkSession, rows.count()
    return contraction.semiring_matmul(Tensor.rows(rows, "i", "vec", n, len(right)), Tensor.from_slice(s, right.ravel().tolist(), right.shape))


def squared(rows) -> Tensor:
    t = Tensor.rows(rows, "i", "vec", rows.count(), 64)
    return contraction.semiring_matmul(t.transpose(), t)


q("tall_qr", _ALL, lambda s, d: times(*tall.qr(vectors(s, d), 64)))
q("tall_qr_orthogonal", _UNIT64, lambda s, d: squared(tall.qr(vectors(s, d), 64)[0]))
q("tall_svd", _ALL, lambda s, d: (lambda u, w, vt: times(u, w[:, None] * vt))(*tall.svd(vectors(s, d), 64)))
q("tall_svd_orthogonal", _UNIT64, lambda s, d: squared(tall.svd(vectors(s, d), 64)[0]))
q("tall_polar", _ALL, lambda s, d: times(*tall.polar(vectors(s, d), 64)))
q("tall_pinverse", _UNIT64, lambda s, d: (lambda a, p: contraction.semiring_matmul(Tensor.rows(p, "i", "vec", a.count(), 64).transpose(), Tensor.rows(a, "i", "vec", a.count(), 64)))(vectors(s, d), tall.pinverse(vectors(s, d), 64)))

# customers on a grid of the root of their number, tied to their neighbours by account balances
K = """k AS (SELECT c_custkey AS i, 1 + abs(c_acctbal) / 10007 AS v FROM customer), top AS (SELECT max(i) AS n, CAST(ceil(sqrt(max(i) + 1)) AS BIGINT) AS w FROM k)"""


def customer_grid(s, d) -> Sparse:
    c = s.read.parquet(f"{d}/customer.parquet").select(F.col("c_custkey").alias("i"), (1 + F.abs("c_acctbal") / 10007).alias("v"))
    n = c.agg(F.max("i")).first()[0] + 1
    w = math.isqrt(n - 1) + 1
    e = c.where((F.col("i") % w < w - 1) & (F.col("i") + 1 < n)).select("i", (F.col("i") + 1).alias("j"), "v").unionByName(c.where(F.col("i") + w < n).select("i", (F.col("i") + w).alias("j"), "v"))
    every = e.select("i", "j", -F.col("v")).toDF("row", "col", "v")
    for x in (e.select("j", "i", -F.col("v")), e.select("i", "i", "v"), e.select("j", "j", "v"), c.select("i", "i", F.lit(0.1))):
        every = every.unionByName(x.toDF("row", "col", "v"))
    return Sparse(sparse_levels.Scratch(s).save(Sparse.summed(every, (n, n)).df, "grid"), (n, n))


def _seven(s, a: Sparse) -> Tensor: return a.spmv(Tensor.generate(s, (a.shape[0],), lambda i: (i % 7 + 1).cast("double")))


q("amg_preconditioned_cg", "SELECT c_custkey AS i0, CAST(c_custkey % 7 + 1 AS DOUBLE) AS v FROM customer", lambda s, d: (lambda a: multigrid.preconditioned_cg(a, _seven(s, a), rtol=1e-6).x)(customer_grid(s, d)), 2)

# singular and eigenvectors by their residuals
_F25 = "FROM range(3) t(g)"


def _residual(a: Sparse, values, right, left):
    """k, and whether A v stays within 1e-6 of value times u."""
    s = a.df.sparkSession
    w = s.createDataFrame([(k, float(x)) for k, x in enumerate(values)], "k int, w double")
    made = a.df.join(right.select(F.col("i").alias("col"), "k", F.col("v").alias("x")), "col").groupBy(F.col("row").alias("i"), "k").agg(F.sum(F.col("v") * F.col("x")).alias("av"))
    met = left.join(made, ["i", "k"], "left").join(w, "k")
    return met.groupBy("k").agg((F.sqrt(F.sum(F.pow(F.coalesce("av", F.lit(0.0)) - F.col("w") * F.col("v"), 2))) < 1e-6 * F.max(F.abs("w"))).alias("close"), (F.abs(F.sum(F.col("v") * F.col("v")) - 1) < 1e-8).alias("unit"))


q("svds_residual", f"SELECT CAST(g AS INTEGER) AS k, true AS close, true AS unit {_F25}", lambda s, d: (lambda a: _residual(a, *iterative.svds(a, 3)))(saved(flows(s, d))))
q("sparse_eig_symmetric_residual", f"SELECT CAST(g AS INTEGER) AS k, true AS close, true AS unit {_F25}", lambda s, d: (lambda a: (lambda w, v: _residual(a, w, v, v))(*iterative.sparse_eig_symmetric(a, 3)))((lambda f: f.add(f.transpose()))(saved(flows(s, d)))))


# the values of all events as one vector, padded to a power of two
def event_vector(s, d):
    e = s.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("i"), F.col("value").alias("v"))
    return e, 1 << int(e.agg(F.max("i")).first()[0]).bit_length()


_LENGTH = "n AS (SELECT CAST(pow(2, floor(log2(max(event_id))) + 1) AS BIGINT) AS n FROM events)"
q("long_fft_inverse", f"WITH {_LENGTH} SELECT g AS i, {r('coalesce(value, 0)', 5)} AS v FROM range((SELECT n FROM n)) t(g) LEFT JOIN events ON event_id = g", lambda s, d: (lambda e, n: long_fft.ifft(long_fft.fft(e.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")), n), n).select("i", F.col("re").alias("v")))(*event_vector(s, d)))
q("long_fft_frequencies", f"WITH {_LENGTH} SELECT k, {r('sum(value * cos(2 * pi() * ((event_id * k) % n) / n))', 4)} AS re, {r('-sum(value * sin(2 * pi() * ((event_id * k) % n) / n))', 4)} AS im FROM events, n, (SELECT g * 97 AS k FROM range((SELECT n // 97 + 1 FROM n)) t(g)) WHERE k < n GROUP BY k, n", lambda s, d: (lambda e, n: long_fft.fft(e.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")), n).where("k % 97 = 0"))(*event_vector(s, d)), 4)
q("long_fft_parseval", f"SELECT {r('sum(value * value)', 3)} AS v FROM events", lambda s, d: (lambda e, n: long_fft.fft(e.select("i", F.col("v").alias("re"), F.lit(0.0).alias("im")), n).agg((F.sum(F.col("re") * F.col("re") + F.col("im") * F.col("im")) / n).alias("v")))(*event_vector(s, d)), 3)
q("long_rfft_inverse", f"WITH {_LENGTH} SELECT g AS i, {r('coalesce(value, 0)', 5)} AS v FROM range((SELECT n FROM n)) t(g) LEFT JOIN events ON event_id = g", lambda s, d: (lambda e, n: long_fft.irfft(long_fft.rfft(e, n), n))(*event_vector(s, d)))


# all embeddings as one n x 8 x 8 tensor, its first mode as a table
def slices(s, d) -> long_decompose.Slices: return long_decompose.Slices.of(vectors(s, d), (8, 8))


def _crossed(rows, k: int) -> Tensor:
    t = Tensor.rows(rows, "i", "vec", rows.count(), k)
    return contraction.semiring_matmul(t.transpose(), t)


def _energy(f):
    """Squares of the reconstruction and of what it misses, which are orthogonal; and whether the stated error is that of the rows."""
    both = f.x.rows.join(f.reconstruct().select("i", F.col("vec").alias("made")), "i").select(F.explode(F.arrays_zip("vec", "made")).alias("e"))
    miss = F.col("e.vec") - F.col("e.made")
    sums = both.agg(F.sum(F.col("e.made") * F.col("e.made")).alias("made"), F.sum(miss * miss).alias("miss"), F.sum(F.col("e.vec") * F.col("e.vec")).alias("all"))
    return sums.select((F.col("made") + F.col("miss")).alias("v"), (F.abs(F.col("miss") / F.col("all") - f.error**2) < 1e-8).alias("stated"))


_ENERGY = f"WITH {M} SELECT {r('sum(v * v)', 3)} AS v, true AS stated FROM m"
q("long_tucker_full", _ALL, lambda s, d: (lambda x: Tensor.rows(long_decompose.tucker(x, (64, 8, 8), 0).reconstruct(), "i", "vec", x.rows.count(), 64))(slices(s, d)))
q("long_tucker_orthogonal", "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS v FROM range(12) t(a), range(12) u(b)", lambda s, d: _crossed(long_decompose.tucker(slices(s, d), (12, 5, 6), 2).long_factor(), 12))
q("long_tucker_energy", _ENERGY, lambda s, d: _energy(long_decompose.tucker(slices(s, d), (8, 4, 4), 2)), 3)
q("long_cp_energy", _ENERGY, lambda s, d: _energy(long_decompose.cp(slices(s, d), 4, 4)), 3)


def _planted(s, d):
    """A tensor of two terms, n x 4 x 5, out of two components of each vector; alternating least squares finds it again."""
    e = vectors(s, d)
    x, y = F.col("vec")[0].cast("double"), F.col("vec")[1].cast("double")
    rows = e.select("i", F.array(*(x * ((j + 1) * (k + 2) / 10) + y * float((j % 3 - 1) * (k % 2 + 1)) for j in range(4) for k in range(5))).alias("vec"))
    return Tensor.rows(long_decompose.cp(long_decompose.Slices.of(rows, (4, 5)), 2, 500, 1e-12).reconstruct(), "i", "vec", rows.count(), 20)


q("long_cp_planted", f"WITH {M} SELECT a.i0, CAST(j * 5 + k AS BIGINT) AS i1, {r('a.v * (j + 1) * (k + 2) / 10 + b.v * (j % 3 - 1) * (k % 2 + 1)', 3)} AS v FROM m a JOIN m b ON a.i0 = b.i0 AND a.i1 = 0 AND b.i1 = 1, range(4) t(j), range(5) u(k)", _planted, 3)
