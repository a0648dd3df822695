"""Reductions, scans, shapes, sorting, indexing, statistics, distances, products and sparse operators over the embeddings, events and order tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from tabulon.operators import contraction as C
from tabulon.operators import distance, indexing, linalg, neural, sorting, stats, tensor_decompose, transforms
from tabulon.operators import sparse as S
from tabulon.plans import tensor as T
from tabulon.plans.scratch import Scratch
from tabulon.plans.tensor import Tensor
from tabulon.sources import random as R

QUERIES, ORACLES = {}, {}
WIDTH = 64


def matrix(spark, sf_dir) -> Tensor:
    df = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return Tensor.rows(df, "vec_id", "embedding", df.count(), WIDTH)


def series(spark, sf_dir) -> Tensor:
    df = spark.read.parquet(f"{sf_dir}/events.parquet")
    return Tensor(df.select(F.col("event_id").alias("i0"), "value").withColumnRenamed("value", "v"), (df.agg(F.max("event_id")).first()[0] + 1,))


def flows(spark, sf_dir) -> S.Sparse:
    """Customer nation by supplier nation: order value."""
    t = {n: spark.read.parquet(f"{sf_dir}/{n}.parquet") for n in ("lineitem", "orders", "customer", "supplier")}
    rows = t["lineitem"].join(t["orders"], F.col("l_orderkey") == F.col("o_orderkey")).join(t["customer"], F.col("o_custkey") == F.col("c_custkey")).join(t["supplier"], F.col("l_suppkey") == F.col("s_suppkey"))
    return S.Sparse.summed(rows.select(F.col("c_nationkey").cast("long").alias("row"), F.col("s_nationkey").cast("long").alias("col"), (F.col("l_quantity") / 100).alias("v")), (25, 25))


def parts(spark, sf_dir) -> S.Sparse:
    """Supplier by part: quantity."""
    n = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    top = n.agg(F.max("l_suppkey"), F.max("l_partkey")).first()
    return S.Sparse.summed(n.select(F.col("l_suppkey").alias("row"), F.col("l_partkey").alias("col"), F.col("l_quantity").alias("v")), (top[0] + 1, top[1] + 1))


def saved(a: S.Sparse) -> S.Sparse:
    """A matrix as a written table, for operators that read it several times."""
    return S.Sparse(Scratch(a.df.sparkSession).save(a.df, "matrix"), a.shape)


def class_sums(spark, sf_dir) -> Tensor:
    """Sum of the vectors of each class, classes x 64."""
    labels = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select(F.col("vec_id").alias("i0"), F.col("label").alias("v"))
    n, top = labels.agg(F.count("*"), F.max("v")).first()
    return C.einsum("ij,ik->jk", T.one_hot(Tensor(labels, (n,)), top + 1), matrix(spark, sf_dir))


M = "m AS (SELECT vec_id AS i0, generate_subscripts(embedding, 1) - 1 AS i1, CAST(unnest(embedding) AS DOUBLE) AS v FROM embeddings)"
CS = "l AS (SELECT vec_id AS i0, label FROM embeddings), cs AS (SELECT g AS i0, j AS i1, coalesce(sum(v), 0) AS v FROM range((SELECT max(label) + 1 FROM embeddings)) t(g) CROSS JOIN range(64) u(j) LEFT JOIN (m JOIN l USING (i0)) ON label = g AND i1 = j GROUP BY 1, 2)"
EV = "e AS (SELECT event_id AS i0, value AS v FROM events)"
FL = "f AS (SELECT c_nationkey AS \"row\", s_nationkey AS col, sum(l_quantity / 100) AS v FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2)"
PA = "p AS (SELECT l_suppkey AS \"row\", l_partkey AS col, sum(l_quantity) AS v FROM lineitem GROUP BY 1, 2)"


def q(name: str, sql: str | None = None, digits: int = 5):
    """Registers a function of (spark, sf_dir) that returns a Tensor, a Sparse or a DataFrame; its double columns are rounded, as in the SQL."""
    def register(f):
        def query(spark, sf_dir):
            out = f(spark, sf_dir)
            df = out if not isinstance(out, Tensor | S.Sparse) else out.df
            return df.select(*((F.round(c, digits) + F.lit(0.0)).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes))

        QUERIES[name] = query
        if sql:
            ORACLES[name] = sql
        return f
    return register


def r(x: str, digits: int = 5) -> str: return f"round({x}, {digits}) + 0.0"


for _op, _agg in [("sum", "sum(v)"), ("mean", "avg(v)"), ("max", "max(v)"), ("min", "min(v)"), ("any", "CAST(max(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS DOUBLE)"), ("all", "CAST(min(CASE WHEN v <> 0 THEN 1 ELSE 0 END) AS DOUBLE)")]:
    q(f"reduce_{_op}_rows", f"WITH {M} SELECT i0, {r(_agg)} AS v FROM m GROUP BY i0")((lambda o: lambda s, d: getattr(matrix(s, d), o)([1]))(_op))
    q(f"reduce_{_op}_columns", f"WITH {M} SELECT i1 AS i0, {r(_agg)} AS v FROM m GROUP BY i1")((lambda o: lambda s, d: getattr(matrix(s, d), o)([0]))(_op))
    q(f"reduce_{_op}", f"WITH {M} SELECT {r(_agg, 4)} AS v FROM m", 4)((lambda o: lambda s, d: getattr(matrix(s, d), o)())(_op))
q("reduce_prod_rows", f"WITH {M} SELECT i0, {r('product(1 + v / 10)')} AS v FROM m GROUP BY i0")(lambda s, d: matrix(s, d).map(lambda v: 1 + v / 10).prod([1]))
q("reduce_keepdim", f"WITH {M} SELECT i0, 0 AS i1, {r('sum(v)')} AS v FROM m GROUP BY i0")(lambda s, d: matrix(s, d).sum([1], True))
for _op, _agg in [("sum", "sum(x)"), ("max", "max(x)"), ("min", "min(x)")]:
    q(f"reduce_{_op}_with_precision", f"WITH {M}, x AS (SELECT i0, CAST(CAST(v AS FLOAT) AS DOUBLE) AS x FROM m) SELECT i0, {r(_agg)} AS v FROM x GROUP BY i0")((lambda o: lambda s, d: matrix(s, d).with_precision(o, "f32", [1]))(_op))
q("reduce_prod_with_precision", f"WITH {M}, x AS (SELECT i0, CAST(CAST(1 + v / 10 AS FLOAT) AS DOUBLE) AS x FROM m) SELECT i0, {r('product(x)')} AS v FROM x GROUP BY i0")(lambda s, d: matrix(s, d).map(lambda v: 1 + v / 10).with_precision("prod", "f32", [1]))
q("argmax", f"WITH {M} SELECT i0, CAST(min(i1) AS DOUBLE) AS v FROM m JOIN (SELECT i0, max(v) AS b FROM m GROUP BY i0) USING (i0) WHERE v = b GROUP BY i0")(lambda s, d: matrix(s, d).argmax(1))
q("argmin", f"WITH {M} SELECT i0, CAST(min(i1) AS DOUBLE) AS v FROM m JOIN (SELECT i0, min(v) AS b FROM m GROUP BY i0) USING (i0) WHERE v = b GROUP BY i0")(lambda s, d: matrix(s, d).argmin(1))
q("cumsum_rows", f"WITH {M} SELECT i0, i1, {r('sum(v) OVER (PARTITION BY i0 ORDER BY i1)')} AS v FROM m")(lambda s, d: matrix(s, d).cumsum(1))
q("cumsum_series", f"WITH {EV} SELECT i0, {r('sum(v) OVER (ORDER BY i0)', 3)} AS v FROM e", 3)(lambda s, d: series(s, d).cumsum(0))
q("cumprod", f"WITH {M} SELECT i0, i1, {r('product(1 + v / 10) OVER (PARTITION BY i0 ORDER BY i1)')} AS v FROM m")(lambda s, d: matrix(s, d).map(lambda v: 1 + v / 10).cumprod(1))
q("logsumexp", f"WITH {M} SELECT i0, {r('ln(sum(exp(v)))')} AS v FROM m GROUP BY i0")(lambda s, d: matrix(s, d).logsumexp([1]))

q("shape_transpose", f"WITH {M} SELECT i1 AS i0, i0 AS i1, {r('v')} AS v FROM m")(lambda s, d: matrix(s, d).transpose())
q("shape_reshape", f"WITH {M} SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, {r('v')} AS v FROM m")(lambda s, d: (lambda t: t.reshape((t.shape[0], 8, 8)))(matrix(s, d)))
q("shape_view", f"WITH {M} SELECT i0 * 2 + i1 // 32 AS i0, i1 % 32 AS i1, {r('v')} AS v FROM m")(lambda s, d: (lambda t: t.view((t.shape[0] * 2, 32)))(matrix(s, d)))
q("shape_flatten", f"WITH {M} SELECT i0 * 64 + i1 AS i0, {r('v')} AS v FROM m")(lambda s, d: matrix(s, d).flatten())
q("shape_permute", f"WITH {M} SELECT i1 % 8 AS i0, i0 AS i1, i1 // 8 AS i2, {r('v')} AS v FROM m")(lambda s, d: (lambda t: t.reshape((t.shape[0], 8, 8)).permute([2, 0, 1]))(matrix(s, d)))
q("shape_squeeze", f"WITH {M} SELECT i0, {r('sum(v)')} AS v FROM m GROUP BY i0")(lambda s, d: matrix(s, d).sum([1], True).squeeze(1))
q("shape_unsqueeze", f"WITH {M} SELECT i0, 0 AS i1, i1 AS i2, {r('v')} AS v FROM m")(lambda s, d: matrix(s, d).unsqueeze(1))
q("shape_narrow", f"WITH {M} SELECT i0, i1 - 8 AS i1, {r('v')} AS v FROM m WHERE i1 BETWEEN 8 AND 23")(lambda s, d: matrix(s, d).narrow(1, 8, 16))
q("shape_broadcast_to", f"WITH {M}, c AS (SELECT i1, avg(v) AS v FROM m GROUP BY i1) SELECT g AS i0, i1, {r('v')} AS v FROM c, range(10) t(g)")(lambda s, d: matrix(s, d).mean([0]).broadcast_to((10, WIDTH)))
q("shape_flip", f"WITH {M} SELECT i0, 63 - i1 AS i1, {r('v')} AS v FROM m")(lambda s, d: matrix(s, d).flip(1))
q("shape_flip_dims", f"WITH {M} SELECT (SELECT max(i0) FROM m) - i0 AS i0, 63 - i1 AS i1, {r('v')} AS v FROM m")(lambda s, d: matrix(s, d).flip_dims([0, 1]))
q("shape_roll", f"WITH {M} SELECT i0, (i1 + 5) % 64 AS i1, {r('v')} AS v FROM m")(lambda s, d: matrix(s, d).roll(5, 1))
q("shape_pad", f"WITH {M} SELECT i0, g AS i1, {r('coalesce(v, 9)')} AS v FROM (SELECT i0, g FROM (SELECT DISTINCT i0 FROM m), range(67) t(g)) LEFT JOIN (SELECT i0, i1 + 1 AS g, v FROM m) USING (i0, g)")(lambda s, d: matrix(s, d).pad([1, 2], 9.0))
q("shape_unfold", f"WITH {M} SELECT i0, w AS i1, i1 - w * 8 AS i2, {r('v')} AS v FROM m, range(7) t(w) WHERE i1 BETWEEN w * 8 AND w * 8 + 15")(lambda s, d: matrix(s, d).unfold(1, 16, 8))
q("shape_repeat", f"WITH {M} SELECT i0, i1 + 64 * g AS i1, {r('v')} AS v FROM m, range(2) t(g)")(lambda s, d: matrix(s, d).repeat([1, 2]))
q("shape_repeat_interleave", f"WITH {M} SELECT i0, i1 * 2 + g AS i1, {r('v')} AS v FROM m, range(2) t(g)")(lambda s, d: matrix(s, d).repeat_interleave(2, 1))
q("shape_cat", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM m UNION ALL SELECT i0, i1 + 64, {r('v * 2')} FROM m")(lambda s, d: T.cat([matrix(s, d), matrix(s, d).map(lambda v: v * 2)], 1))
q("shape_stack", f"WITH {M} SELECT 0 AS i0, i0 AS i1, i1 AS i2, {r('v')} AS v FROM m UNION ALL SELECT 1, i0, i1, {r('-v')} FROM m")(lambda s, d: T.stack([matrix(s, d), matrix(s, d).map(lambda v: -v)], 0))
q("shape_split", f"WITH {M} SELECT i0, i1 - 60 AS i1, {r('v')} AS v FROM m WHERE i1 >= 60")(lambda s, d: matrix(s, d).split(20, 1)[3])
q("shape_chunk", f"WITH {M} SELECT i0, i1 - 22 AS i1, {r('v')} AS v FROM m WHERE i1 BETWEEN 22 AND 43")(lambda s, d: matrix(s, d).chunk(3, 1)[1])
q("broadcast_binary", f"WITH {M}, c AS (SELECT i1, avg(v) AS a FROM m GROUP BY i1) SELECT i0, i1, {r('v - a')} AS v FROM m JOIN c USING (i1)")(lambda s, d: (lambda t: t.binary("sub", t.mean([0])))(matrix(s, d)))
q("create_arange", "SELECT g AS i0, 1 + g * 0.5 AS v FROM range(18) t(g)")(lambda s, d: Tensor.arange(s, 1, 10, 0.5))
q("create_linspace", f"SELECT g AS i0, {r('2 + g * (7.0 / 20)')} AS v FROM range(21) t(g)")(lambda s, d: Tensor.linspace(s, 2, 9, 21))
q("create_eye", "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN 1.0 ELSE 0.0 END AS v FROM range(5) t(a), range(7) u(b)")(lambda s, d: Tensor.eye(s, 5, 7))
q("create_fill", "SELECT a AS i0, b AS i1, 2.5 AS v FROM range(3) t(a), range(4) u(b)")(lambda s, d: Tensor.fill(s, (3, 4), 2.5))
q("create_zeros_ones", "SELECT a AS i0, 1.0 AS v FROM range(6) t(a)")(lambda s, d: Tensor.zeros(s, (6,)).binary("add", Tensor.ones(s, (6,))))
q("meshgrid", "SELECT a AS i0, b AS i1, CAST(b AS DOUBLE) AS v FROM range(4) t(a), range(5) u(b)")(lambda s, d: T.meshgrid([Tensor.arange(s, 0, 4), Tensor.arange(s, 0, 5)])[1])
q("one_hot", "SELECT vec_id AS i0, g AS i1, CASE WHEN label = g THEN 1.0 ELSE 0.0 END AS v FROM embeddings, range(8) t(g)")(lambda s, d: T.one_hot(Tensor(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i0"), F.col("label").alias("v")), (1,)), 8))

q("sort", f"WITH {M} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, {r('v')} AS v FROM m")(lambda s, d: sorting.sort(matrix(s, d), 1))
q("sort_with_indices", f"WITH {M} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) - 1 AS i1, {r('v')} AS v, i1 AS source FROM m")(lambda s, d: sorting.sort_with_indices(matrix(s, d), 1, True))
q("sort_series", f"WITH {EV} SELECT row_number() OVER (ORDER BY v, i0) - 1 AS i0, {r('v')} AS v FROM e")(lambda s, d: sorting.sort(series(s, d), 0))
q("argsort", f"WITH {M} SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v, i1) - 1 AS i1, CAST(i1 AS DOUBLE) AS v FROM m")(lambda s, d: sorting.argsort(matrix(s, d), 1).map(lambda v: v.cast("double")))
q("topk", f"WITH {M} SELECT * FROM (SELECT i0, row_number() OVER (PARTITION BY i0 ORDER BY v DESC, i1) - 1 AS i1, {r('v')} AS v, i1 AS source FROM m) WHERE i1 < 5")(lambda s, d: sorting.topk(matrix(s, d), 5, 1))
q("topk_series", f"WITH {EV} SELECT row_number() OVER (ORDER BY v DESC, i0) - 1 AS i0, {r('v')} AS v, i0 AS source FROM (SELECT * FROM e ORDER BY v DESC, i0 LIMIT 20)")(lambda s, d: sorting.topk(series(s, d), 20, 0))
q("unique", "SELECT DISTINCT l_quantity AS v FROM lineitem")(lambda s, d: sorting.unique(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity"))
q("unique_with_counts", "SELECT row_number() OVER (ORDER BY v) - 1 AS place, v, n FROM (SELECT CAST(label AS DOUBLE) AS v, count(*) AS n FROM embeddings GROUP BY 1)")(lambda s, d: sorting.unique_with_counts(Tensor(s.read.parquet(f"{d}/embeddings.parquet").select(F.col("vec_id").alias("i0"), F.col("label").cast("double").alias("v")), (1,)))[0])
q("nonzero", "SELECT l_orderkey * 8 + l_linenumber AS i0 FROM lineitem WHERE l_discount <> 0")(lambda s, d: sorting.nonzero(Tensor(s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i0"), F.col("l_discount").alias("v")), (1,))))
_SS = "SELECT o_orderkey AS i0, CAST((SELECT count(*) FROM range(0, 500000, 5000) t(g) WHERE g {} o_totalprice) AS DOUBLE) AS v FROM orders"
for _right, _cmp in ((False, "<"), (True, "<=")):
    q(f"searchsorted_{'right' if _right else 'left'}", _SS.format(_cmp))((lambda right: lambda s, d: sorting.searchsorted(Tensor.arange(s, 0, 500000, 5000), Tensor(s.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("i0"), F.col("o_totalprice").alias("v")), (1,)), right))(_right))


def picks(s, n, step, limit): return Tensor.generate(s, (n,), lambda i: ((i * step) % limit).cast("double"))


q("index_select", f"WITH {M} SELECT i0, g AS i1, {r('v')} AS v FROM range(10) t(g) JOIN m ON i1 = (g * 7) % 64")(lambda s, d: indexing.index_select(matrix(s, d), 1, picks(s, 10, 7, 64)))
q("gather", f"WITH {M} SELECT a.i0, a.i1, {r('coalesce(b.v, 0)')} AS v FROM (SELECT i0, i1, CAST(i1 + i0 % 3 AS BIGINT) AS k FROM m) a LEFT JOIN m b ON a.i0 = b.i0 AND a.k = b.i1")(lambda s, d: (lambda t: indexing.gather(t, 1, Tensor(t.df.select("i0", "i1", (F.col("i1") + F.col("i0") % 3).cast("double").alias("v")), t.shape)))(matrix(s, d)))
q("scatter", f"WITH {M} SELECT i0, i1, {r('CASE WHEN i1 < 32 THEN coalesce((SELECT x.v FROM m x WHERE x.i0 = m.i0 AND x.i1 = m.i1 * 2 + 1), 0) ELSE v END')} AS v FROM m")(lambda s, d: (lambda t: indexing.scatter(t, 1, Tensor(t.df.select("i0", "i1", F.expr("double(i1 div 2)").alias("v")), t.shape), t))(matrix(s, d)))
for _op, _agg in (("sum", "sum(v)"), ("mean", "avg(v)"), ("max", "max(v)"), ("min", "min(v)")):
    q(f"scatter_reduce_{_op}", f"WITH {M}, x AS (SELECT i0, i1, v FROM m UNION ALL SELECT i0, i1 // 2, v FROM m) SELECT i0, i1, {r(_agg)} AS v FROM x GROUP BY i0, i1")((lambda o: lambda s, d: (lambda t: indexing.scatter_reduce(t, 1, Tensor(t.df.select("i0", "i1", F.expr("double(i1 div 2)").alias("v")), t.shape), t, o))(matrix(s, d)))(_op))
q("index_put", f"WITH {M} SELECT i0, i1, {r('CASE WHEN i1 % 2 = 0 AND i1 < 20 THEN -1 ELSE v END')} AS v FROM m")(lambda s, d: (lambda t: indexing.index_put(t, 1, picks(s, 10, 2, 64), t.narrow(1, 0, 10).map(lambda v: F.lit(-1.0))))(matrix(s, d)))
q("take", f"WITH {M} SELECT g AS i0, {r('v')} AS v FROM range(100) t(g) JOIN m ON i0 * 64 + i1 = (g * 37) % 3000")(lambda s, d: indexing.take(matrix(s, d), picks(s, 100, 37, 3000)))
q("put", f"WITH {M} SELECT i0, i1, {r('CASE WHEN (i0 * 64 + i1) % 5 = 0 AND i0 * 64 + i1 < 500 THEN 7 ELSE v END')} AS v FROM m")(lambda s, d: indexing.put(matrix(s, d), picks(s, 100, 5, 10**9), Tensor.fill(s, (100,), 7)))
q("masked_select", f"WITH {M} SELECT i0 * 64 + i1 AS place, {r('v')} AS v FROM m WHERE v > 0.1")(lambda s, d: (lambda t: indexing.masked_select(t, t.map(lambda v: (v > 0.1).cast("double"))))(matrix(s, d)))
q("masked_fill", f"WITH {M} SELECT i0, i1, {r('CASE WHEN v < 0 THEN 5 ELSE v END')} AS v FROM m")(lambda s, d: (lambda t: indexing.masked_fill(t, t.map(lambda v: (v < 0).cast("double")), 5.0))(matrix(s, d)))


# every line item looks up a vector; the sums by line number hold all of them
@q("embedding_lookup", f"WITH {M}, x AS (SELECT l_linenumber, l_partkey % n AS k FROM lineitem, (SELECT count(*) AS n FROM embeddings)) SELECT l_linenumber AS i0, i1, {r('sum(v)', 3)} AS v FROM x JOIN m ON i0 = k GROUP BY 1, 2", 3)
def _lookup(s, d):
    t = matrix(s, d)
    index = s.read.parquet(f"{d}/lineitem.parquet").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("i0"), (F.col("l_partkey") % t.shape[0]).cast("double").alias("v"))
    return indexing.embedding_lookup(t, Tensor(index, (1,))).df.groupBy((F.col("i0") % 8).cast("int").alias("i0"), "i1").agg(F.sum("v").alias("v"))



q("gather_nd", f"WITH {M} SELECT g AS i0, {r('coalesce(v, 0)')} AS v FROM range(70) t(g) LEFT JOIN m ON i0 = g AND i1 = g")(lambda s, d: indexing.gather_nd(matrix(s, d), Tensor.generate(s, (70, 2), lambda i: F.expr("double(id div 2)"))))
q("gather_2d", f"WITH {M} SELECT g AS i0, {r('v')} AS v FROM range(60) t(g) JOIN m ON i0 = g AND i1 = 63 - g")(lambda s, d: indexing.gather_2d(matrix(s, d), Tensor.arange(s, 0, 60), Tensor.arange(s, 63, 3, -1)))
q("bincount", "SELECT g AS i0, CAST(count(l_quantity) AS DOUBLE) AS v FROM range(60) t(g) LEFT JOIN lineitem ON l_quantity = g GROUP BY g")(lambda s, d: indexing.bincount(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", minlength=60))
q("bincount_weighted", "SELECT g AS i0, round(coalesce(sum(l_tax), 0), 5) + 0.0 AS v FROM range(60) t(g) LEFT JOIN lineitem ON l_quantity = g GROUP BY g")(lambda s, d: indexing.bincount(s.read.parquet(f"{d}/lineitem.parquet"), "l_quantity", "l_tax", 60))
q("slice_assign", f"WITH {M} SELECT i0, i1, {r('CASE WHEN i1 BETWEEN 4 AND 13 THEN (SELECT -x.v FROM m x WHERE x.i0 = m.i0 AND x.i1 = m.i1 - 4) ELSE v END')} AS v FROM m")(lambda s, d: (lambda t: indexing.slice_assign(t, t.narrow(1, 0, 10).map(lambda v: -v), 1, 4))(matrix(s, d)))

for _name, _f, _sql in [
    ("var", lambda t: stats.var(t, [0]), "var_samp(v)"), ("var_population", lambda t: stats.var(t, [0], correction=0), "var_pop(v)"), ("std", lambda t: stats.std(t, [0]), "stddev_samp(v)"),
    ("median", lambda t: stats.median(t, 0), "quantile_cont(v, 0.5)"), ("quantile", lambda t: stats.quantile(t, 0.3, 0), "quantile_cont(v, 0.3)"), ("percentile", lambda t: stats.percentile(t, 90, 0), "quantile_cont(v, 0.9)"),
    ("skew", lambda t: stats.skew(t, [0]), "(avg(v*v*v) - 3*avg(v)*avg(v*v) + 2*avg(v)*avg(v)*avg(v)) / pow(var_pop(v), 1.5)"), ("kurtosis", lambda t: stats.kurtosis(t, [0]), "kurtosis_pop(v)"),
]:
    q(f"stats_{_name}", f"WITH {M} SELECT i1 AS i0, {r(_sql)} AS v FROM m GROUP BY i1")((lambda f: lambda s, d: f(matrix(s, d)))(_f))
_N = "SELECT i1 AS i0, round({}, 5) + 0.0 AS v FROM (SELECT i1, list_sort(list(v)) AS l, CAST(floor(0.3 * (count(*) - 1)) AS BIGINT) AS a, 0.3 * (count(*) - 1) - floor(0.3 * (count(*) - 1)) AS f, CAST(ceil(0.3 * (count(*) - 1)) AS BIGINT) AS b FROM m GROUP BY i1)"
for _mode, _sql in (("lower", "l[a + 1]"), ("higher", "l[b + 1]"), ("nearest", "CASE WHEN f < 0.5 THEN l[a + 1] ELSE l[b + 1] END"), ("midpoint", "(l[a + 1] + l[b + 1]) / 2")):
    q(f"stats_quantile_{_mode}", f"WITH {M} {_N.format(_sql)}")((lambda m: lambda s, d: stats.quantile(matrix(s, d), 0.3, 0, interpolation=m))(_mode))
q("stats_histogram", "WITH b AS (SELECT min(l_extendedprice) AS lo, (max(l_extendedprice) - min(l_extendedprice)) / 20 AS w FROM lineitem), c AS (SELECT least(CAST(floor((l_extendedprice - lo) / w) AS BIGINT), 19) AS bin, count(*) AS n FROM lineitem, b GROUP BY 1) SELECT g AS bin, round(lo + g * w, 5) + 0.0 AS edge, coalesce(n, 0) AS n FROM range(20) t(g), b LEFT JOIN c ON bin = g")(lambda s, d: stats.histogram(s.read.parquet(f"{d}/lineitem.parquet"), "l_extendedprice", 20))
_COV = "SELECT a.i1 AS i0, b.i1 AS i1, covar_samp(a.v, b.v) AS c, stddev_samp(a.v) AS x, stddev_samp(b.v) AS y FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY 1, 2"
q("stats_cov", f"WITH {M} SELECT i0, i1, {r('c')} AS v FROM ({_COV})")(lambda s, d: stats.cov(matrix(s, d)))
q("stats_corrcoef", f"WITH {M} SELECT i0, i1, {r('c / (x * y)')} AS v FROM ({_COV})")(lambda s, d: stats.corrcoef(matrix(s, d)))
q("stats_mode", "SELECT l_quantity AS v, count(*) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, v LIMIT 1")(lambda s, d: stats.mode(Tensor(s.read.parquet(f"{d}/lineitem.parquet").select(F.col("l_orderkey").alias("i0"), F.col("l_quantity").alias("v")), (1,))))

_VE = "x AS (SELECT vec_id AS i, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), y AS (SELECT * FROM x WHERE i % 20 = 0)"


def _sides(s, d):
    """All vectors, and as queries those whose id is divisible by 20."""
    x = distance.vectors(s.read.parquet(f"{d}/embeddings.parquet"), "vec_id", "embedding")
    return x, x.where("i % 20 = 0")


def _square(s, d):
    x = _sides(s, d)[0]
    return distance.squareform(distance.pdist(x), x.count())


_Z = "list_sum(list_transform(range(1, 65), lambda k: {}))"
for _name, _sql in [
    ("euclidean", "list_distance(x.v, y.v)"), ("sqeuclidean", "pow(list_distance(x.v, y.v), 2)"), ("manhattan", _Z.format("abs(x.v[k] - y.v[k])")), ("chebyshev", "list_max(list_transform(range(1, 65), lambda k: abs(x.v[k] - y.v[k])))"),
    ("cosine", "1 - list_cosine_similarity(x.v, y.v)"), ("correlation", "1 - list_cosine_similarity(list_transform(x.v, lambda e: e - list_avg(x.v)), list_transform(y.v, lambda e: e - list_avg(y.v)))"),
    ("hamming", _Z.format("CASE WHEN x.v[k] <> y.v[k] THEN 1.0 ELSE 0.0 END") + " / 64"), ("jaccard", "1 - " + _Z.format("CASE WHEN x.v[k] <> 0 AND y.v[k] <> 0 THEN 1.0 ELSE 0.0 END") + " / " + _Z.format("CASE WHEN x.v[k] <> 0 OR y.v[k] <> 0 THEN 1.0 ELSE 0.0 END")),
]:
    q(f"cdist_{_name}", f"WITH {_VE} SELECT x.i AS i0, y.i AS i1, {r(_sql)} AS v FROM x, y")((lambda n: lambda s, d: distance.cdist(*_sides(s, d), n))(_name))
q("cdist_minkowski", f"WITH {_VE} SELECT x.i AS i0, y.i AS i1, {r('pow(' + _Z.format('pow(abs(x.v[k] - y.v[k]), 3)') + ', 1.0 / 3)')} AS v FROM x, y")(lambda s, d: distance.cdist(*_sides(s, d), "minkowski", 3))
q("pdist", f"WITH {_VE} SELECT x.i AS i0, y.i AS i1, {r('list_distance(x.v, y.v)')} AS v FROM x JOIN x y ON x.i < y.i")(lambda s, d: distance.pdist(_sides(s, d)[0]))
q("squareform", f"WITH {_VE} SELECT x.i AS i0, y.i AS i1, {r('list_distance(x.v, y.v)')} AS v FROM x, x y")(_square)
q("squareform_inverse", f"WITH {_VE} SELECT x.i AS i0, y.i AS i1, {r('list_distance(x.v, y.v)')} AS v FROM x JOIN x y ON x.i < y.i")(lambda s, d: distance.squareform_inverse(_square(s, d)))

_G = "SELECT a.i1 AS i0, b.i1 AS i1, sum(a.v * b.v) AS v FROM m a JOIN m b ON a.i0 = b.i0 GROUP BY 1, 2"
q("matmul", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM ({_G})")(lambda s, d: (lambda t: C.matmul(t.transpose(), t))(matrix(s, d)))
q("block_matmul", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM ({_G})")(lambda s, d: (lambda t: C.block_matmul(t.transpose(), t, 128))(matrix(s, d)))
q("einsum_matmul", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM ({_G})")(lambda s, d: (lambda t: C.einsum("ij,ik->jk", t, t))(matrix(s, d)))
q("einsum_row_sums", f"WITH {M} SELECT i0, {r('sum(v)')} AS v FROM m GROUP BY i0")(lambda s, d: C.einsum("ij->i", matrix(s, d)))
q("einsum_trace", f"WITH {M} SELECT {r('sum(v)')} AS v FROM ({_G}) WHERE i0 = i1")(lambda s, d: (lambda t: C.einsum("ii->", C.einsum("ij,ik->jk", t, t)))(matrix(s, d)))
q("einsum_three", f"WITH {M}, c AS (SELECT i1 AS k, avg(v) AS c FROM m GROUP BY i1) SELECT i0, {r('sum(v * c)')} AS v FROM m JOIN c ON k = i1 GROUP BY i0")(lambda s, d: (lambda t: C.einsum("ij,j,k->i", t, t.mean([0]), Tensor.from_slice(s, [0.25, 0.75], (2,))))(matrix(s, d)))
q("matmul_bias", f"WITH {M}, c AS (SELECT i1, avg(v) AS c FROM m GROUP BY i1) SELECT i0, g.i1, {r('v + c')} AS v FROM ({_G}) g JOIN c ON g.i1 = c.i1")(lambda s, d: (lambda t: C.matmul_bias(t.transpose(), t, t.mean([0])))(matrix(s, d)))
q("matmul_bias_activation", f"WITH {M}, c AS (SELECT i1, avg(v) AS c FROM m GROUP BY i1) SELECT i0, g.i1, {r('greatest(v + c, 0)')} AS v FROM ({_G}) g JOIN c ON g.i1 = c.i1")(lambda s, d: (lambda t: C.matmul_bias_activation(t.transpose(), t, t.mean([0]), "relu"))(matrix(s, d)))
q("matmul_bias_residual", f"WITH {M}, c AS (SELECT i1, avg(v) AS c FROM m GROUP BY i1) SELECT i0, g.i1, {r('v + c + CASE WHEN i0 = g.i1 THEN 1 ELSE 0 END')} AS v FROM ({_G}) g JOIN c ON g.i1 = c.i1")(lambda s, d: (lambda t: C.matmul_bias_residual(t.transpose(), t, t.mean([0]), Tensor.eye(s, WIDTH)))(matrix(s, d)))
q("matmul_bias_activation_bwd", f"WITH {M} SELECT i1 AS i0, {r('count(*) * 1.0')} AS v FROM m GROUP BY i1")(lambda s, d: (lambda t: C.matmul_bias_activation_bwd(Tensor.ones(s, t.shape), t, Tensor.eye(s, WIDTH), Tensor.zeros(s, (WIDTH,)), "none")[2])(matrix(s, d)))
for _op, _agg, _times in [("min_plus", "min", "a.v + b.v"), ("max_plus", "max", "a.v + b.v"), ("max_min", "max", "least(a.v, b.v)"), ("min_max", "min", "greatest(a.v, b.v)"), ("plus_max", "sum", "greatest(a.v, b.v)"), ("or_and", "max", "CASE WHEN a.v <> 0 AND b.v <> 0 THEN 1.0 ELSE 0.0 END"), ("plus_times", "sum", "a.v * b.v")]:
    q(f"semiring_{_op}", f"WITH {FL} SELECT a.\"row\" AS i0, b.col AS i1, {r(f'{_agg}({_times})', 6)} AS v FROM f a JOIN f b ON a.col = b.\"row\" GROUP BY 1, 2", 6)((lambda o: lambda s, d: (lambda t: C.semiring_matmul(t, t, o))(flows(s, d).tensor()))(_op))
q("prune_to_24", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY i0, i1 // 4 ORDER BY abs(v) DESC, i1) AS k FROM m) WHERE k <= 2")(lambda s, d: C.prune_to_24(matrix(s, d)))
q("sparse_24_to_dense", f"WITH {M} SELECT i0, i1, {r('CASE WHEN k <= 2 THEN v ELSE 0 END')} AS v FROM (SELECT *, row_number() OVER (PARTITION BY i0, i1 // 4 ORDER BY abs(v) DESC, i1) AS k FROM m)")(lambda s, d: C.sparse_24_to_dense(C.prune_to_24(matrix(s, d))))
q("sparse_24_matmul", f"WITH {M}, g AS ({_G}), w AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY i0, i1 // 4 ORDER BY abs(v) DESC, i1) AS k FROM g) WHERE k <= 2) SELECT m.i0, w.i0 AS i1, {r('sum(m.v * w.v)', 4)} AS v FROM m JOIN w USING (i1) GROUP BY 1, 2", 4)(lambda s, d: (lambda t: C.sparse_24_matmul(t, C.prune_to_24(_gram(s, d))))(matrix(s, d)))
for _k in ("e4m3", "e5m2"):
    q(f"fp8_decode_{_k}")((lambda k: lambda s, d: C.fp8_decode(Tensor.generate(s, (120,), lambda i: i.cast("double")), k))(_k))
q("fp8_matmul")(lambda s, d: (lambda t: C.fp8_matmul(t, t.transpose()))(Tensor.generate(s, (8, 8), lambda i: (i % 100).cast("double"))))
q("fp8_matmul_e5m2")(lambda s, d: (lambda t: C.fp8_matmul_e5m2(t, t.transpose()))(Tensor.generate(s, (8, 8), lambda i: (i % 100).cast("double"))))

_W = "OVER (PARTITION BY i0)"
q("softmax", f"WITH {M} SELECT i0, i1, {r(f'exp(v) / sum(exp(v)) {_W}', 7)} AS v FROM m", 7)(lambda s, d: neural.softmax(matrix(s, d), 1))
q("log_softmax", f"WITH {M} SELECT i0, i1, {r(f'v - ln(sum(exp(v)) {_W})')} AS v FROM m")(lambda s, d: neural.log_softmax(matrix(s, d), 1))
q("softmax_bwd", f"WITH {M}, y AS (SELECT i0, i1, v AS g, exp(v) / sum(exp(v)) {_W} AS y FROM m) SELECT i0, i1, {r(f'y * (g - sum(g * y) {_W})', 7)} AS v FROM y", 7)(lambda s, d: (lambda t: neural.softmax_bwd(t, neural.softmax(t, 1), 1))(matrix(s, d)))
q("softmax_with_bias", f"WITH {M}, b AS (SELECT i0, i1, v + i1 / 64.0 AS v FROM m) SELECT i0, i1, {r(f'exp(v) / sum(exp(v)) {_W}', 7)} AS v FROM b", 7)(lambda s, d: neural.softmax_with_bias(matrix(s, d), Tensor.generate(s, (WIDTH,), lambda i: i / 64.0), 1))
_ONE = lambda s, x=1.0: Tensor.fill(s, (WIDTH,), x)
q("rms_norm", f"WITH {M} SELECT i0, i1, {r(f'2 * v / sqrt(avg(v * v) {_W} + 1e-5)')} AS v FROM m")(lambda s, d: neural.rms_norm(matrix(s, d), _ONE(s, 2)))
_LN = f"(v - avg(v) {_W}) / sqrt(var_pop(v) {_W} + 1e-5)"
q("layer_norm", f"WITH {M} SELECT i0, i1, {r(f'2 * {_LN} + 0.5')} AS v FROM m")(lambda s, d: neural.layer_norm(matrix(s, d), _ONE(s, 2), _ONE(s, 0.5)))
q("group_norm", f"WITH {M} SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, {r('(v - avg(v) OVER w) / sqrt(var_pop(v) OVER w + 1e-5)')} AS v FROM m WINDOW w AS (PARTITION BY i0, i1 // 16)")(lambda s, d: (lambda t: neural.group_norm(t.reshape((t.shape[0], 8, 8)), Tensor.ones(s, (8,)), Tensor.zeros(s, (8,)), 4))(matrix(s, d)))
q("fused_add_rms_norm", f"WITH {M} SELECT i0, i1, {r(f'2 * v / sqrt(avg(4 * v * v) {_W} + 1e-5)')} AS v FROM m")(lambda s, d: (lambda t: neural.fused_add_rms_norm(t, t, _ONE(s))[0])(matrix(s, d)))
q("fused_add_layer_norm", f"WITH {M} SELECT i0, i1, {r(f'2 * (v - avg(v) {_W}) / sqrt(4 * var_pop(v) {_W} + 1e-5)')} AS v FROM m")(lambda s, d: (lambda t: neural.fused_add_layer_norm(t, t, _ONE(s), _ONE(s, 0))[0])(matrix(s, d)))
q("fused_add_rms_norm_bwd", f"WITH {M}, x AS (SELECT i0, i1, v, 1 / sqrt(avg(v * v) {_W} + 1e-5) AS k FROM m) SELECT i0, i1, {r(f'k * v - v * k * k * k * avg(v * v) {_W}')} AS v FROM x")(lambda s, d: (lambda t: neural.fused_add_rms_norm_bwd(t, t, _ONE(s))[0])(matrix(s, d)))
q("fused_add_layer_norm_bwd", f"WITH {M}, x AS (SELECT i0, i1, v, {_LN} AS h, 1 / sqrt(var_pop(v) {_W} + 1e-5) AS k FROM m) SELECT i0, i1, {r(f'k * (v - avg(v) {_W} - h * avg(v * h) {_W})')} AS v FROM x")(lambda s, d: (lambda t: neural.fused_add_layer_norm_bwd(t, t, _ONE(s), _ONE(s, 0))[0])(matrix(s, d)))
q("conv1d", f"WITH {M} SELECT m.i0, 0 AS i1, p AS i2, {r('sum(v * CASE i1 - p WHEN 0 THEN 1 WHEN 1 THEN -2 ELSE 0.5 END)')} AS v FROM m, range(62) t(p) WHERE i1 BETWEEN p AND p + 2 GROUP BY m.i0, p")(lambda s, d: (lambda t: neural.conv1d(t.unsqueeze(1), Tensor.from_slice(s, [1, -2, 0.5], (1, 1, 3))))(matrix(s, d)))
q("conv2d", f"WITH {M} SELECT m.i0, 0 AS i1, p AS i2, q AS i3, {r('sum(v)')} AS v FROM m, range(7) t(p), range(7) u(q) WHERE i1 // 8 BETWEEN p AND p + 1 AND i1 % 8 BETWEEN q AND q + 1 GROUP BY m.i0, p, q")(lambda s, d: (lambda t: neural.conv2d(t.reshape((t.shape[0], 1, 8, 8)), Tensor.ones(s, (1, 1, 2, 2))))(matrix(s, d)))
q("depthwise_conv2d", f"WITH {M} SELECT m.i0, i1 // 16 AS i1, p AS i2, q AS i3, {r('sum(v)')} AS v FROM m, range(3) t(p), range(3) u(q) WHERE i1 % 16 // 4 BETWEEN p AND p + 1 AND i1 % 4 BETWEEN q AND q + 1 GROUP BY m.i0, i1 // 16, p, q")(lambda s, d: (lambda t: neural.depthwise_conv2d(t.reshape((t.shape[0], 4, 4, 4)), Tensor.ones(s, (4, 1, 2, 2))))(matrix(s, d)))
q("conv_transpose1d", f"WITH {M} SELECT i0, 0 AS i1, i1 * 2 + g AS i2, {r('sum(v * (g + 1))')} AS v FROM m, range(2) t(g) GROUP BY i0, i1 * 2 + g")(lambda s, d: neural.conv_transpose1d(matrix(s, d).unsqueeze(1), Tensor.from_slice(s, [1, 2], (1, 1, 2)), stride=2))
q("dropout_inference", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM m")(lambda s, d: neural.dropout(matrix(s, d), 0.5, 1, training=False))

q("fft_power", f"WITH {M} SELECT m.i0, k AS i1, {r('pow(sum(v * cos(2 * pi() * k * i1 / 64)), 2) + pow(sum(v * sin(2 * pi() * k * i1 / 64)), 2)', 4)} AS v FROM m, range(64) t(k) GROUP BY m.i0, k", 4)(lambda s, d: (lambda t: transforms.fft_dim(t, 1).map(lambda z: z["re"] * z["re"] + z["im"] * z["im"]))(matrix(s, d)))
q("rfft", f"WITH {M} SELECT m.i0, k AS i1, {r('sum(v * cos(2 * pi() * k * i1 / 64))', 4)} AS v FROM m, range(33) t(k) GROUP BY m.i0, k", 4)(lambda s, d: (lambda t: transforms.from_rows(transforms.rfft(transforms.to_rows(t)[0], 64), t, 1, 33).map(lambda z: z["re"]))(matrix(s, d)))
q("irfft", f"WITH {M} SELECT i0, i1, {r('v')} AS v FROM m")(lambda s, d: (lambda t: transforms.from_rows(transforms.irfft(transforms.rfft(transforms.to_rows(t)[0], 64), 64), t, 1, 64))(matrix(s, d)))
q("fft2", f"WITH {M}, x AS (SELECT i0, i1 // 8 AS a, i1 % 8 AS b, v FROM m) SELECT x.i0, p AS i1, u AS i2, {r('sum(v * cos(2 * pi() * (p * a + u * b) / 8))', 4)} AS v FROM x, range(8) t(p), range(8) w(u) GROUP BY x.i0, p, u", 4)(lambda s, d: (lambda t: transforms.fft2(t.reshape((t.shape[0], 8, 8))).map(lambda z: z["re"]))(matrix(s, d)))
q("irfft2", f"WITH {M} SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, {r('v')} AS v FROM m")(lambda s, d: (lambda t: transforms.irfft2(transforms.rfft2(t.reshape((t.shape[0], 8, 8))), 8))(matrix(s, d)))
q("fftshift", f"WITH {M} SELECT i0, (i1 + 32) % 64 AS i1, {r('v')} AS v FROM m")(lambda s, d: transforms.fftshift(matrix(s, d)))
q("ifftshift", f"WITH {M} SELECT i0, (i1 + 32) % 64 AS i1, {r('v')} AS v FROM m")(lambda s, d: transforms.ifftshift(matrix(s, d)))
q("fftfreq", f"SELECT g AS i0, {r('CASE WHEN g < 4 THEN g ELSE g - 8 END / 4.0')} AS v FROM range(8) t(g)")(lambda s, d: transforms.fftfreq(s, 8, 0.5))
q("rfftfreq", f"SELECT g AS i0, {r('g / 4.0')} AS v FROM range(5) t(g)")(lambda s, d: transforms.rfftfreq(s, 8, 0.5))
q("polymul", "SELECT * FROM (VALUES (0, 3.0), (1, 10.0), (2, 8.0)) t(i0, v)")(lambda s, d: transforms.polymul(Tensor.from_slice(s, [1, 2], (2,)), Tensor.from_slice(s, [3, 4], (2,))))
q("halton", "WITH RECURSIVE h(id, n, f, v) AS (SELECT g, g, 1.0::DOUBLE, 0.0::DOUBLE FROM range(1, 200) t(g) UNION ALL SELECT id, n // 2, f / 2, v + f / 2 * (n % 2) FROM h WHERE n > 0) SELECT id - 1 AS i0, 0 AS i1, max(v) AS v FROM h GROUP BY id", 12)(lambda s, d: R.halton(s, 199, 1, 1))
q("sobol", "WITH RECURSIVE g AS (SELECT i AS id, xor(i, i >> 1) AS c FROM range(200) t(i)), h(id, c, f, v) AS (SELECT id, c, 1.0::DOUBLE, 0.0::DOUBLE FROM g UNION ALL SELECT id, c // 2, f / 2, v + f / 2 * (c % 2) FROM h WHERE c > 0) SELECT id AS i0, 0 AS i1, max(v) AS v FROM h GROUP BY id", 12)(lambda s, d: R.sobol(s, 200, 1))

q("kron", "SELECT a * 2 + c AS i0, b * 2 + e AS i1, CAST((a * 2 + b + 1) * (c * 2 + e + 1) AS DOUBLE) AS v FROM range(2) t(a), range(2) u(b), range(2) w(c), range(2) z(e)")(lambda s, d: (lambda t: linalg.kron(t, t))(Tensor.from_slice(s, [1, 2, 3, 4], (2, 2))))
q("khatri_rao", f"WITH {M}, {CS} SELECT a.i0 * (SELECT max(label) + 1 FROM embeddings) + b.i0 AS i0, i1, {r('a.v * b.v')} AS v FROM m a JOIN cs b USING (i1)")(lambda s, d: linalg.khatri_rao(matrix(s, d), class_sums(s, d)))
q("trace", f"WITH {M} SELECT {r('sum(v)')} AS v FROM m WHERE i0 = i1")(lambda s, d: linalg.trace(matrix(s, d)))
q("diag", f"WITH {M} SELECT i0, {r('v')} AS v FROM m WHERE i0 = i1")(lambda s, d: linalg.diag(matrix(s, d)))
q("diagflat", "SELECT a AS i0, b AS i1, CASE WHEN a = b THEN a * 1.0 ELSE 0 END AS v FROM range(6) t(a), range(6) u(b)")(lambda s, d: linalg.diagflat(Tensor.arange(s, 0, 6)))
q("triu", f"WITH {M} SELECT i0, i1, {r('CASE WHEN i1 - i0 >= 1 THEN v ELSE 0 END')} AS v FROM m")(lambda s, d: linalg.triu(matrix(s, d), 1))
q("tril", f"WITH {M} SELECT i0, i1, {r('CASE WHEN i1 - i0 <= 0 THEN v ELSE 0 END')} AS v FROM m")(lambda s, d: linalg.tril(matrix(s, d)))
q("matrix_norm_fro", f"WITH {M} SELECT {r('sqrt(sum(v * v))')} AS v FROM m")(lambda s, d: linalg.matrix_norm(matrix(s, d)))
q("matrix_norm_1", f"WITH {M} SELECT {r('max(s)')} AS v FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i1)")(lambda s, d: linalg.matrix_norm(matrix(s, d), "1"))
q("matrix_norm_inf", f"WITH {M} SELECT {r('max(s)')} AS v FROM (SELECT sum(abs(v)) AS s FROM m GROUP BY i0)")(lambda s, d: linalg.matrix_norm(matrix(s, d), "inf"))


def _gram(s, d) -> Tensor: return (lambda t: C.einsum("ij,ik->jk", t, t))(matrix(s, d))


# factorizations of the 64 x 64 Gram matrix: identities that SQL can check
for _name, _f in {"inverse": linalg.inverse, "pinverse": linalg.pinverse, "det": linalg.det, "slogdet": linalg.slogdet, "matrix_rank": linalg.matrix_rank, "cond": linalg.cond, "lu_decompose": linalg.lu_decompose, "cholesky_decompose": linalg.cholesky_decompose, "qr_decompose": linalg.qr_decompose, "qr_decompose_thin": linalg.qr_decompose_thin, "svd_decompose": linalg.svd_decompose, "eig_decompose_symmetric": linalg.eig_decompose_symmetric, "eig_decompose": linalg.eig_decompose, "schur_decompose": linalg.schur_decompose, "rsf2csf": linalg.rsf2csf, "polar_decompose": linalg.polar_decompose, "sqrtm": linalg.sqrtm, "logm": linalg.logm, "signm": linalg.signm}.items():
    q(f"linalg_{_name}", digits=3)((lambda f: lambda s, d: f(linalg.batch(_gram(s, d))))(_f))
q("linalg_expm", digits=3)(lambda s, d: linalg.expm(linalg.batch(_gram(s, d).map(lambda v: v / 100))))
q("linalg_fractional_matrix_power", digits=3)(lambda s, d: linalg.fractional_matrix_power(linalg.batch(_gram(s, d)), 0.5))
q("linalg_funm", digits=3)(lambda s, d: linalg.funm(linalg.batch(_gram(s, d)), lambda z: z * z))
q("linalg_solve", digits=3)(lambda s, d: linalg.solve(linalg.batch(_gram(s, d)), linalg.batch(Tensor.eye(s, WIDTH))))
q("linalg_qz_decompose", digits=3)(lambda s, d: linalg.qz_decompose(linalg.batch(Tensor.from_slice(s, [1, 2, 3, 4], (2, 2))), linalg.batch(Tensor.from_slice(s, [2, 0, 1, 3], (2, 2)))))
q("linalg_solve_triangular_lower", digits=3)(lambda s, d: linalg.solve_triangular_lower(linalg.batch(linalg.tril(_gram(s, d))), linalg.batch(Tensor.eye(s, WIDTH))))
q("linalg_solve_triangular_upper", digits=3)(lambda s, d: linalg.solve_triangular_upper(linalg.batch(linalg.triu(_gram(s, d))), linalg.batch(Tensor.eye(s, WIDTH))))
q("linalg_solve_banded", digits=3)(lambda s, d: linalg.solve_banded(linalg.batch(Tensor.from_slice(s, [0, -1, -1, 2, 2, 2, -1, -1, 0], (3, 3))), linalg.batch(Tensor.ones(s, (3, 1))), 1, 1))


@q("linalg_lstsq", "SELECT 'slope' AS name, round(regr_slope(l_extendedprice, l_quantity), 3) + 0.0 AS v FROM lineitem UNION ALL SELECT 'intercept', round(regr_intercept(l_extendedprice, l_quantity), 3) + 0.0 FROM lineitem", 3)
def _lstsq(s, d):
    rows = s.read.parquet(f"{d}/lineitem.parquet").select(F.lit(1.0).alias("one"), "l_quantity", "l_extendedprice")
    b = linalg.lstsq(rows, ["one", "l_quantity"], "l_extendedprice")
    return s.createDataFrame([("intercept", float(b[0])), ("slope", float(b[1]))], "name string, v double")


q("mode_unfold", f"WITH {M} SELECT i1 // 8 AS i0, i0 * 8 + i1 % 8 AS i1, {r('v')} AS v FROM m")(lambda s, d: (lambda t: tensor_decompose.unfold(t.reshape((t.shape[0], 8, 8)), 1))(matrix(s, d)))
q("mode_fold", f"WITH {M} SELECT i0, i1 // 8 AS i1, i1 % 8 AS i2, {r('v')} AS v FROM m")(lambda s, d: (lambda t: tensor_decompose.fold(tensor_decompose.unfold(t, 1), 1, t.shape))((lambda t: t.reshape((t.shape[0], 8, 8)))(matrix(s, d))))
q("mode_n_product", f"WITH {M} SELECT i0, 0 AS i1, i1 % 8 AS i2, {r('sum(v)')} AS v FROM m GROUP BY i0, i1 % 8")(lambda s, d: (lambda t: tensor_decompose.mode_n_product(t.reshape((t.shape[0], 8, 8)), Tensor.ones(s, (1, 8)), 1))(matrix(s, d)))

# sparse
q("sparse_spmv", f"WITH {PA} SELECT g AS i0, {r('coalesce(sum(v * (col % 7)), 0)', 3)} AS v FROM range((SELECT max(l_suppkey) + 1 FROM lineitem)) t(g) LEFT JOIN p ON \"row\" = g GROUP BY g", 3)(lambda s, d: (lambda a: a.spmv(Tensor.generate(s, (a.shape[1],), lambda i: (i % 7).cast("double"))))(parts(s, d)))
q("sparse_spmm", f"WITH {FL} SELECT r AS i0, c AS i1, {r('coalesce(sum(v * (col + c)), 0)', 3)} AS v FROM range(25) t(r) CROSS JOIN range(3) u(c) LEFT JOIN f ON \"row\" = r GROUP BY r, c", 3)(lambda s, d: flows(s, d).spmm(Tensor.generate(s, (25, 3), lambda i: F.expr("double(id div 3 + id % 3)"))))
q("sparse_dsmm", f"WITH {FL} SELECT r AS i0, c AS i1, {r('coalesce(sum(v * (r + 1)), 0)', 3)} AS v FROM range(2) t(r) CROSS JOIN range(25) u(c) LEFT JOIN f ON col = c GROUP BY r, c", 3)(lambda s, d: S.dsmm(Tensor.generate(s, (2, 25), lambda i: F.expr("double(id div 25 + 1)")), flows(s, d)))
_FT = "SELECT \"row\", col, round({}, 3) + 0.0 AS v FROM ({})"
q("sparse_add", f"WITH {FL} SELECT \"row\", col, {r('sum(v)', 3)} AS v FROM (SELECT * FROM f UNION ALL SELECT col, \"row\", v FROM f) GROUP BY 1, 2", 3)(lambda s, d: (lambda a: a.add(a.transpose()))(flows(s, d)))
q("sparse_sub", f"WITH {FL} SELECT \"row\", col, {r('sum(v)', 3)} AS v FROM (SELECT * FROM f UNION ALL SELECT col + 1, \"row\" + 1, -v FROM f WHERE col < 24 AND \"row\" < 24) GROUP BY 1, 2", 3)(lambda s, d: (lambda a: a.sub(S.Sparse(a.transpose().df.where("row < 24 AND col < 24").select((F.col("row") + 1).alias("row"), (F.col("col") + 1).alias("col"), "v"), a.shape)))(flows(s, d)))
q("sparse_mul", f"WITH {FL} SELECT a.\"row\", a.col, {r('a.v * b.v', 3)} AS v FROM f a JOIN f b ON a.\"row\" = b.col AND a.col = b.\"row\"", 3)(lambda s, d: (lambda a: a.mul(a.transpose()))(flows(s, d)))
q("sparse_div", f"WITH {FL} SELECT a.\"row\", a.col, {r('a.v / b.v', 3)} AS v FROM f a JOIN f b ON a.\"row\" = b.col AND a.col = b.\"row\"", 3)(lambda s, d: (lambda a: a.div(a.transpose()))(flows(s, d)))
q("sparse_matmul", f"WITH {PA} SELECT a.\"row\", b.\"row\" AS col, {r('sum(a.v * b.v)', 2)} AS v FROM p a JOIN p b ON a.col = b.col GROUP BY 1, 2", 2)(lambda s, d: (lambda a: a.matmul(a.transpose()))(saved(parts(s, d))))
q("sparse_scale", f"WITH {FL} SELECT \"row\", col, {r('v * 2.5', 3)} AS v FROM f", 3)(lambda s, d: flows(s, d).scale(2.5))
q("sparse_scalar_add", f"WITH {FL} SELECT \"row\", col, {r('v + 1', 3)} AS v FROM f", 3)(lambda s, d: flows(s, d).scalar_add(1))
q("sparse_sum", f"WITH {PA} SELECT {r('sum(v)', 2)} AS v FROM p", 2)(lambda s, d: parts(s, d).sum())
for _name, _key, _agg in [("sum_rows", '"row"', "sum(v)"), ("sum_cols", "col", "sum(v)"), ("nnz_per_row", '"row"', "count(v) * 1.0"), ("nnz_per_col", "col", "count(v) * 1.0"), ("row_norms", '"row"', "sqrt(sum(v * v))"), ("col_norms", "col", "sqrt(sum(v * v))")]:
    q(f"sparse_{_name}", f"WITH {FL} SELECT g AS i0, {r(f'coalesce({_agg}, 0)', 3)} AS v FROM range(25) t(g) LEFT JOIN f ON {_key} = g GROUP BY g", 3)((lambda n: lambda s, d: getattr(flows(s, d), n)())(_name))
q("sparse_to_dense", f"WITH {FL} SELECT a AS i0, b AS i1, {r('coalesce(v, 0)', 3)} AS v FROM range(25) t(a) CROSS JOIN range(25) u(b) LEFT JOIN f ON \"row\" = a AND col = b", 3)(lambda s, d: flows(s, d).to_dense())
q("dense_to_sparse", f"WITH {M} SELECT i0 AS \"row\", i1 AS col, {r('v')} AS v FROM m WHERE abs(v) > 0.2")(lambda s, d: S.Sparse.from_dense(matrix(s, d), 0.2))
q("sparse_transpose", f"WITH {FL} SELECT col AS \"row\", \"row\" AS col, {r('v', 3)} AS v FROM f", 3)(lambda s, d: flows(s, d).transpose())
q("sparse_extract_diagonal", f"WITH {FL} SELECT g AS i0, {r('coalesce(v, 0)', 3)} AS v FROM range(25) t(g) LEFT JOIN f ON \"row\" = g AND col = g", 3)(lambda s, d: flows(s, d).diagonal())
q("sparse_scale_rows", f"WITH {FL} SELECT \"row\", col, {r('v * (\"row\" + 1)', 3)} AS v FROM f", 3)(lambda s, d: flows(s, d).scale_rows(Tensor.arange(s, 1, 26)))
q("sparse_scale_cols", f"WITH {FL} SELECT \"row\", col, {r('v * (col + 1)', 3)} AS v FROM f", 3)(lambda s, d: flows(s, d).scale_cols(Tensor.arange(s, 1, 26)))
q("sparse_equilibrate", f"WITH {FL}, a AS (SELECT \"row\", col, v / max(v) OVER (PARTITION BY \"row\") AS v FROM f) SELECT \"row\", col, {r('v / max(v) OVER (PARTITION BY col)')} AS v FROM a")(lambda s, d: flows(s, d).equilibrate()[0])
q("coo_to_csr_to_coo", f"WITH {FL} SELECT \"row\", col, {r('v', 3)} AS v FROM f", 3)(lambda s, d: (lambda a: S.Sparse.from_csr(a.to_csr(), a.shape))(flows(s, d)))
q("csr_to_csc", f"WITH {FL} SELECT \"row\", col, {r('v', 3)} AS v FROM f", 3)(lambda s, d: (lambda a: S.Sparse.from_csc(S.csr_to_csc(a.to_csr(), a.shape), a.shape))(flows(s, d)))
q("csr_row_starts", f"WITH {FL} SELECT g AS \"row\", CAST(coalesce(sum(count(v)) OVER (ORDER BY g ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start FROM range(25) t(g) LEFT JOIN f ON \"row\" = g GROUP BY g")(lambda s, d: flows(s, d).to_csr().select("row", "start"))

_CA = f"""WITH {M}, l AS (SELECT vec_id AS i0, label FROM embeddings), c AS (SELECT label AS k, i1, avg(v) AS c FROM m JOIN l USING (i0) GROUP BY 1, 2),
s AS (SELECT i0, k, sum(v * c) / sqrt(sum(v * v) * sum(c * c)) AS s FROM m JOIN c USING (i1) GROUP BY 1, 2),
b AS (SELECT i0, k, s FROM (SELECT *, row_number() OVER (PARTITION BY i0 ORDER BY s DESC, k) AS n FROM s) WHERE n = 1)
SELECT label, count(*) AS n, sum(CASE WHEN k = label THEN 1 ELSE 0 END) AS n_right, {r('avg(s)', 4)} AS similarity FROM b JOIN l USING (i0) GROUP BY label"""


@q("centroid_accuracy", _CA, 4)
def centroid_accuracy(spark, sf_dir):
    """Vectors by their most similar class centroid: per class, how many there are, how many are right and the mean similarity."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("label", F.col("embedding").cast("array<double>").alias("x"))
    means = rows.select("label", F.posexplode("x").alias("j", "v")).groupBy("label", "j").agg(F.avg("v").alias("v"))
    classes = means.groupBy("label").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "v"))), lambda e: e["v"]).alias("c"))
    # one row with a centroid of 64 numbers a class, which every vector meets without a shuffle
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda p, q: p * q), F.lit(0.0), lambda t, e: t + e)
    table = F.broadcast(classes.agg(F.collect_list(F.struct(F.col("label").alias("k"), "c", F.sqrt(dot(F.col("c"), F.col("c"))).alias("norm"))).alias("classes")))
    score = lambda c: F.struct((dot(F.col("x"), c["c"]) / c["norm"]).alias("s"), (-c["k"]).alias("k"))
    best = rows.crossJoin(table).select("label", F.array_max(F.transform("classes", score)).alias("b"), F.sqrt(dot(F.col("x"), F.col("x"))).alias("norm"))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.sum((-F.col("b.k") == F.col("label")).cast("long")).alias("n_right"), F.avg(F.col("b.s") / F.col("norm")).alias("similarity"))
