"""Embedding near-dedup by NN-descent: a neighbour graph refined through neighbours of neighbours.

Equal vectors form one class first. The graph starts from random rotations: rows are sorted by the axes that their rotated vectors lie closest to,
and each meets the few rows beside it, so a dense spot costs no more than any other. A round joins every vector's neighbours, and whose neighbour it is,
with each other, and each keeps its best K. Lists that are full of links (saturated) are enlarged: a component of links is compared within itself,
in blocks, so its links are exact at any size and only counts leave a block. Recall is audited against brute force for bounded samples of
vectors without, with few and with many known links, each vector counting once; while it is below RECALL, the graph starts again with more
rotations and their links are added. If it stays below, all vectors are compared in blocks, however many they are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm import graph
from tabulon.llm.common import Scratch, partitions

COSINE, K = 0.95, 8
TABLES, AXES, BESIDE = 8, 3, 4
ROUNDS, SETTLED = 4, 0.01
AUDIT, RECALL, TRIES = 200, 0.99, 3
BLOCK = 512
#: Blocks of across() have so many rows, of long vectors as many as hold so many parts, and are compared STRIP rows at a time.
WIDE, WIDE_PARTS, STRIP = 4096, 1 << 19, 512
#: A caller's own bound on the vectors that are all compared when the audit fails, beyond which it is told the recall instead; none is set.
EXACT = None
SEED = 7


def unit_rows(column: pa.Array) -> np.ndarray:
    """n x d unit vectors in double precision; all rows have the same length."""
    n = len(column)
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1) if n else np.empty((0, 1))
    # by the largest part first, so that neither huge nor tiny vectors overflow
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def by_length(batch: pa.RecordBatch):
    """The batch (u, dim, vec) in parts of equal dim."""
    dims = batch.column(1).to_numpy()
    for d in np.unique(dims):
        yield batch if (dims == d).all() else batch.take(pa.array(np.flatnonzero(dims == d)))


def _record(**columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns.values()], list(columns))


def _rotations(dim: int, seed: int, n: int) -> list[np.ndarray]:
    rng = np.random.default_rng([SEED, seed, dim])
    return [np.linalg.qr(rng.standard_normal((dim, dim)))[0] for _ in range(n)]


def start(vectors: DataFrame, first_table: int, tables: int, parts: int) -> DataFrame:
    """Pairs (u, v, s) of rows that lie side by side when sorted by their nearest axes in a random rotation."""

    def keys(batches):
        for batch, x in ((part, unit_rows(part.column(2))) for whole in batches for part in by_length(whole)):
            for t in range(first_table, first_table + tables):
                key = np.zeros(len(x), np.int64)
                for r in _rotations(x.shape[1], t, AXES) if len(x) else []:
                    y = x @ r
                    axis = np.abs(y).argmax(1)
                    key = key * (2 * x.shape[1]) + 2 * axis + (y[np.arange(len(y)), axis] > 0)
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(x), t)), pa.array(key), *batch.columns], ["t", "key", "u", "dim", "vec"])

    def beside(batches):
        held = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            table = pa.concat_tables([held, table]) if held is not None else table
            held = table.slice(max(0, len(table) - BESIDE))
            t, dim, u = (table.column(c).to_numpy() for c in ("t", "dim", "u"))
            cuts = np.flatnonzero(dim[1:] != dim[:-1]) + 1
            for a, b in zip([0, *cuts], [*cuts, len(u)], strict=True):
                x = unit_rows(table.column("vec").slice(a, b - a).combine_chunks())
                for gap in range(1, min(BESIDE, b - a - 1) + 1):
                    ok = t[a : b - gap] == t[a + gap : b]
                    s = (x[:-gap] * x[gap:]).sum(1)[ok]
                    yield _record(u=u[a : b - gap][ok], v=u[a + gap : b][ok], s=s)

    vec = vectors.schema["vec"].dataType.simpleString()
    dealt = vectors.mapInArrow(keys, f"t long, key long, u long, dim int, vec {vec}")
    order = ["t", "dim", "key", F.xxhash64("u", "t")]
    return dealt.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(beside, "u long, v long, s double").where("u <> v")


def best(edges: DataFrame, k: int = K) -> DataFrame:
    """Each node's k best neighbours as rows (u, v, s): edges go both ways, repeats once."""
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"), "s"))
    top = both.distinct().groupBy("u").agg(F.expr(f"slice(sort_array(collect_list(struct(s, v)), false), 1, {k})").alias("l"))
    return top.select("u", F.explode("l").alias("n")).select("u", F.col("n.v").alias("v"), F.col("n.s").alias("s"))


def refine(vectors: DataFrame, lists: DataFrame, k: int = K) -> DataFrame:
    """Pairs (u, v, s) among the neighbours, both ways, of each node that would enter u's or v's list."""
    worst = lists.groupBy("u").agg(F.when(F.count("*") >= k, F.min("s")).otherwise(-2.0).alias("worst"))
    # whose neighbour a node is: k of them, those that it is best for; what this leaves out the blocks of enlarge() compare
    back = lists.groupBy("v").agg(F.expr(f"slice(sort_array(collect_list(struct(s, u)), false), 1, {k})").alias("l")).select(F.col("v").alias("at"), F.explode("l.u").alias("u"))
    members = lists.select(F.col("u").alias("at"), F.col("v").alias("u")).unionByName(back).distinct()
    rows = members.join(vectors.join(worst, "u"), "u").groupBy("at").agg(F.collect_list(F.struct("u", "worst", "vec")).alias("l"))

    def run(batches):
        for batch in batches:
            lists = batch.column(0)
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            u, worst = flat.field("u").to_numpy(), flat.field("worst").to_numpy()
            vec = flat.field("vec")
            sizes = np.diff(vec.offsets.to_numpy())
            us, vs, ss = [], [], []
            for a, b in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], strict=True):
                if b - a < 2 or (sizes[a:b] != sizes[a]).any():
                    continue
                x = unit_rows(vec.slice(a, b - a))
                s = x @ x.T
                i, j = np.triu_indices(b - a, 1)
                value = s[i, j]
                ok = value > np.minimum(worst[a:b][i], worst[a:b][j])
                us.append(u[a:b][i[ok]])
                vs.append(u[a:b][j[ok]])
                ss.append(value[ok])
            if us:
                yield _record(u=np.concatenate(us), v=np.concatenate(vs), s=np.concatenate(ss))

    return rows.select("l").mapInArrow(run, "u long, v long, s double").distinct()


def _cells(rows: DataFrame, block: Column, *also: str) -> DataFrame:
    """p, q and l (x, u, vec and the columns `also` of members) for every two blocks of a component; rows: component, n (its size), u, vec.

    Members are dealt into blocks of about `block` and every two blocks of a component meet once, so a component of any size is many tasks' work.
    """
    rows = rows.withColumn("blocks", F.ceil(F.col("n") / block).cast("int"))
    rows = rows.withColumn("x", F.pmod(F.xxhash64("u"), F.col("blocks")).cast("int"))
    meets = rows.select("component", "blocks", "x", "u", *also, "vec", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("y"))
    cells = meets.groupBy("component", F.least("x", "y").alias("p"), F.greatest("x", "y").alias("q")).agg(F.collect_list(F.struct("x", "u", *also, "vec")).alias("l"))
    return cells.select("p", "q", "l")


def enlarge(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """u and links (copies of other vectors that it links with) of every node of a component; labels: node, component."""
    sizes = labels.groupBy("component").agg(F.count("*").alias("n"))
    cells = _cells(vectors.join(labels.withColumnRenamed("node", "u"), "u").join(sizes, "component"), F.lit(BLOCK), "copies")

    def run(batches):
        for batch in batches:
            lists, first, last = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            x, u, copies = (flat.field(c).to_numpy() for c in ("x", "u", "copies"))
            for a, b, p, q in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], first, last, strict=True):
                rows = unit_rows(flat.field("vec").slice(a, b - a))
                left, right = (np.flatnonzero(x[a:b] == z) for z in (p, q))
                hit = (rows[left] @ rows[right].T) >= COSINE
                if p == q:
                    np.fill_diagonal(hit, False)
                yield _record(u=u[a:b][left], links=(hit @ copies[a:b][right]).astype(np.int64))
                if p != q:
                    yield _record(u=u[a:b][right], links=(hit.T @ copies[a:b][left]).astype(np.int64))

    return cells.mapInArrow(run, "u long, links long").groupBy("u").agg(F.sum("links").alias("links"))


def _unite(root: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the trees of nodes i[k] and j[k] in root, which holds each node's tree (its least node), in place."""
    while True:
        i, j = root[i], root[j]
        apart = i != j
        if not apart.any():
            return
        i, j = i[apart], j[apart]
        np.minimum.at(root, np.maximum(i, j), np.minimum(i, j))
        while (up := root[root]).tobytes() != root.tobytes():
            root[:] = up


def across(vectors: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs (a, b) of components (a vector without one is its own), enough to merge those that a link joins, all vectors of a length being compared; labels: node, component.

    A cell returns fewer pairs than it has rows, whatever it finds.
    """
    sizes = vectors.groupBy("dim").agg(F.count("*").alias("n"))
    rows = vectors.join(labels.withColumnRenamed("node", "u"), "u", "left").withColumn("label", F.coalesce("component", "u")).drop("component")
    block = F.greatest(F.lit(1), F.least(F.lit(WIDE), F.floor(F.lit(WIDE_PARTS) / F.col("component"))))
    cells = _cells(rows.join(sizes, "dim").withColumnRenamed("dim", "component"), block, "label")

    def run(batches):
        for batch in batches:
            lists, first, last = batch.column(2), batch.column(0).to_numpy(), batch.column(1).to_numpy()
            bounds, flat = lists.offsets.to_numpy(), lists.flatten()
            x, label = (flat.field(c).to_numpy() for c in ("x", "label"))
            for a, b, p, q in zip(bounds[:-1] - bounds[0], bounds[1:] - bounds[0], first, last, strict=True):
                rows = unit_rows(flat.field("vec").slice(a, b - a))
                left, right = (np.flatnonzero(x[a:b] == z) for z in (p, q))
                names, place = np.unique(label[a:b], return_inverse=True)
                root, other = np.arange(len(names)), rows[right].T
                for at in range(0, len(left), STRIP):
                    some = left[at : at + STRIP]
                    i, j = np.nonzero((rows[some] @ other) >= COSINE)
                    _unite(root, place[some[i]], place[right[j]])
                merged = np.flatnonzero(root != np.arange(len(root)))
                yield _record(a=names[root[merged]], b=names[merged])

    return cells.mapInArrow(run, "a long, b long").distinct()


def audit(vectors: DataFrame, links: DataFrame, k: int = K) -> float:
    """The estimated mean share of a linked vector's true links that `links` (u, links) has: the lesser one of vectors with at most k known links and of the others.

    At most AUDIT vectors each, hash-drawn, of those without, with up to k and with more known links are compared with all rows; a sample stands for
    its stratum's vectors.
    """
    count = F.coalesce("links", F.lit(0))
    known = vectors.join(links, "u", "left").withColumn("links", count).withColumn("stratum", F.when(count == 0, 0).when(count <= k, 1).otherwise(2))
    sizes = dict(known.groupBy("stratum").count().collect())  # three rows at most
    samples = [known.where(F.col("stratum") == t).orderBy(F.xxhash64(F.lit(SEED), "u"), "u").limit(AUDIT) for t in range(3)]
    drawn = samples[0].unionByName(samples[1]).unionByName(samples[2]).select("u", "dim", "vec", "links", "stratum").toArrow()
    if not len(drawn):
        return 1.0
    by_dim = {}
    for d in set(drawn.column("dim").to_pylist()):
        part = drawn.filter(pa.compute.equal(drawn.column("dim"), d))
        by_dim[d] = (part.column("u").to_numpy(), unit_rows(part.column("vec").combine_chunks()))
    held = vectors.sparkSession.sparkContext.broadcast(by_dim)

    def run(batches):
        for batch in batches:
            u, dims, copies = (batch.column(i).to_numpy() for i in (0, 1, 2))
            for d in np.unique(dims):
                if d in held.value:
                    who, sample = held.value[d]
                    at = np.flatnonzero(dims == d)
                    hit = (sample @ unit_rows(batch.column(3).take(pa.array(at))).T) >= COSINE
                    hit &= who[:, None] != u[at][None]
                    yield _record(u=who, links=(hit @ copies[at]).astype(np.int64))

    true = vectors.select("u", "dim", "copies", "vec").mapInArrow(run, "u long, links long").groupBy("u").agg(F.sum("links").alias("true"))
    true = dict(true.collect())  # a row per vector of the samples
    strata = drawn.column("stratum").to_numpy()
    have = np.array([true.get(u, 0) for u in drawn.column("u").to_pylist()], float)
    share = np.minimum(drawn.column("links").to_numpy() / np.maximum(have, 1), 1)
    weight = np.array([sizes[t] / (strata == t).sum() for t in strata]) * (have > 0)
    return min((float((weight * share)[part].sum() / weight[part].sum()) for part in (strata < 2, strata == 2) if weight[part].sum()), default=1.0)


def near_dedup(rows: DataFrame, k: int = K) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row of (vec_id, embedding); two rows are linked if their cosine is at least COSINE.

    Vectors that are null, empty, zero or hold null or non-finite parts link with nothing, nor do vectors of different lengths. A row's n_links counts
    other rows, copies too. component_id is the least vec_id reachable, itself included; rows without vec_id link with nothing and
    have none. Repeated rows are separate vectors. Other columns are ignored. Empty input: no rows.
    """
    spark = rows.sparkSession
    scratch = Scratch(spark)
    rows = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("vec"))
    part = rows.schema["vec"].dataType.elementType.simpleString()
    if part not in ("float", "double"):
        rows = rows.withColumn("vec", F.col("vec").cast("array<double>"))
    limit = F.lit(float("inf"))
    sound = F.coalesce(F.forall("vec", lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != limit)), F.lit(False)) & F.coalesce(F.exists("vec", lambda e: e != 0), F.lit(False)) & F.col("vec_id").isNotNull()
    classes = rows.where(sound).groupBy("vec").agg(F.min("vec_id").alias("u"), F.count("*").alias("copies"))
    vectors = scratch.save(classes.select("u", F.size("vec").alias("dim"), "copies", "vec"), "vectors")
    # a vec_id that repeats with different vectors would stand for two classes
    if vectors.groupBy("u").count().where("count > 1").isEmpty():
        numbered = vectors
        names = None
    else:
        names = scratch.save(vectors.withColumn("n", F.xxhash64("u", "vec")), "names")
        numbered = names.select(F.col("n").alias("u"), "dim", "copies", "vec")
    n = numbered.count()
    parts = partitions(spark, n * TABLES, 20_000)
    links = edges = None
    for turn in range(TRIES):
        lists = scratch.save(best(start(numbered.select("u", "dim", "vec"), turn * TABLES, TABLES * (turn + 1), parts), k), "lists")
        near = scratch.save(lists.where(F.col("s") >= COSINE).select(F.col("u").alias("a"), F.col("v").alias("b")), "near")
        for _ in range(ROUNDS):
            found = scratch.save(refine(numbered.select("u", "vec"), lists, k), "found")
            near = near.unionByName(found.where(F.col("s") >= COSINE).select(F.col("u").alias("a"), F.col("v").alias("b")))
            after = scratch.save(best(lists.unionByName(found), k), "lists")
            changed = after.join(lists, ["u", "v"], "left_anti").count()
            scratch.drop(lists)
            lists = after
            if changed <= SETTLED * k * n:
                break
        edges = near if edges is None else edges.unionByName(near)
        labels = scratch.save(graph.components(scratch, edges), "labels")
        links = scratch.save(enlarge(numbered, labels), "links")
        recall = audit(numbered, links, k)
        if recall >= RECALL:
            break
    else:
        if EXACT is not None and n > EXACT:
            raise RuntimeError(f"recall {recall:.4f} after {TRIES} starts is below {RECALL}, and {n} vectors are too many to compare all")
        # what joins components is all that enlarge() doesn't see
        edges = edges.unionByName(scratch.save(across(numbered, labels), "across"))
        labels = scratch.save(graph.components(scratch, edges), "labels")
        links = scratch.save(enlarge(numbered, labels), "links")
    if names is not None:
        short = names.select(F.col("n").alias("node"), F.col("u").alias("least"))
        lowest = labels.join(short, "node").groupBy("component").agg(F.min("least").alias("c"))
        labels = labels.join(lowest, "component").select("node", F.col("c").alias("component"))
        per = names.select("vec", "u", "copies", F.col("n").alias("node"))
    else:
        per = numbered.select("vec", "u", "copies", F.col("u").alias("node"))
    per = per.join(labels, "node", "left").join(links.withColumnRenamed("u", "node"), "node", "left").select("vec", (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), F.coalesce("component", "u").alias("component_id"))
    linked = rows.where(sound).join(per, "vec").select("vec_id", "n_links", "component_id")
    alone = rows.where(~sound).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    out = linked.unionByName(alone)
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
