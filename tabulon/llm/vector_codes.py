"""Vector codes by delta-maintained Lloyd: one codebook for each part of a vector, trained on all vectors in integers.

Components become integers, so sums are exact and do not depend on the order in which tasks end. Every round stores each vector's assignments
beside it and compares them with those of the round before: a part whose entry changed adds itself to the new entry and takes itself away from the
old one, all others add nothing. A task sums these contributions, so at most ENTRIES rows of a part leave it, and the driver holds the running sums of
PARTS x ENTRIES entries, however many vectors there are. The contributions lie in the same table as the assignments: a round reads the vectors once.
"""

from __future__ import annotations

import hashlib
import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tabulon.llm.common import Scratch, checked_broadcast, hash_bucket

SCALE, PARTS, ENTRIES, ROUNDS = 1024, 4, 256, 4
#: Up to here products in doubles are exact, for parts of up to 256 components.
EXACT = 1 << 21
#: Vectors that are compared with a codebook at once.
BATCH = 2048
#: Rows of a label that share a salt, on average, where labels are too many to broadcast.
SALTS = 64


def bound(size: int) -> int:
    """Components beyond it, as integers, count as it, so that any squared distance of two vectors of so many components fits a long (64: 1.9e8)."""
    return min(math.isqrt((1 << 61) // max(size, 1)), (1 << 31) - 1)


def to_integers(vectors: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, label, vec (binary, 32-bit integers floor(scale * x)) of all usable vectors.

    A vector that is null, empty, or holds a null or a non-finite component goes, and one whose length isn't that of the first vector by vec_id.
    """
    x = F.col("embedding").cast("array<double>")
    usable = F.coalesce(F.size(x) > 0, F.lit(False)) & ~F.coalesce(F.exists(x, lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))), F.lit(True))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").alias("label"), x.alias("vec")).where(usable)
    first = rows.agg(F.min(F.struct(F.col("vec_id").isNull(), "vec_id", F.size("vec").alias("size")))).first()[0]
    rows = rows.where(F.size("vec") == (first["size"] if first else 0))

    def run(batches):
        for batch in batches:
            lists = batch.column(2)
            x = lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)
            q = np.clip(np.floor(x * scale), -bound(x.shape[1]), bound(x.shape[1])).astype("<i4")
            width = q.shape[1] * 4
            buffers = [None, pa.py_buffer((np.arange(len(q) + 1) * width).astype(np.int32).tobytes()), pa.py_buffer(q.tobytes())]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.Array.from_buffers(pa.binary(), len(q), buffers)], ["vec_id", "label", "vec"])

    schema = "vec_id long, label {}, vec binary".format(dict(rows.dtypes)["label"])
    return rows.mapInArrow(_small_batches(run), schema)


def _small_batches(run):
    """run over batches of BATCH rows at most."""
    return lambda batches: run(part for b in batches for part in (b.slice(at, BATCH) for at in range(0, b.num_rows, BATCH)))


def cuts(size: int, parts: int = PARTS) -> list[int]:
    """Where the parts of a vector begin and end: equal ones if the size allows, else of sizes that differ by one."""
    return [k * size // parts for k in range(parts + 1)]


def nearest(x: np.ndarray, book: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each row of x the nearest row of book by squared distance, ties to the lower one, and that distance; both are of integers."""
    if max(np.abs(x).max(initial=0), np.abs(book).max(initial=0)) <= EXACT:
        a, b = x.astype(np.float64), book.astype(np.float64)
        near = (b * b).sum(1)[None] - 2 * (a @ b.T)
        at = near.argmin(1)
        return at, (near[np.arange(len(x)), at] + (a * a).sum(1)).astype(np.int64)
    best, at = np.full(len(x), np.iinfo(np.int64).max), np.zeros(len(x), np.int64)
    for k, entry in enumerate(book.astype(np.int64)):
        far = ((x.astype(np.int64) - entry) ** 2).sum(1)
        better = far < best
        best[better], at[better] = far[better], k
    return at, best


def _vectors(column: pa.Array) -> np.ndarray:
    """n x d integers of a binary column."""
    n = len(column)
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + n + 1]
    return np.frombuffer(column.buffers()[2], "<i4")[offsets[0] // 4 : offsets[-1] // 4].reshape(n, -1)


class Lloyd:
    """Codebooks and the running sums and counts of their entries: PARTS x ENTRIES x d / PARTS integers on the driver, whatever the vectors."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.sums = [np.zeros((len(b), b.shape[1]), object) for b in books]
        self.counts = [np.zeros(len(b), object) for b in books]

    def add(self, deltas: DataFrame) -> int:
        """Adds the contributions (part, entry, n, sums) and renews the entries in use; returns how many entries had any."""
        summed = deltas.select("part", "entry", "n", F.posexplode("sums").alias("pos", "s"))
        rows = summed.groupBy("part", "entry", "pos").agg(F.sum("s").alias("s"), F.sum("n").alias("n")).collect()
        for r in rows:
            self.sums[r["part"]][r["entry"], r["pos"]] += r["s"]
            if r["pos"] == 0:
                self.counts[r["part"]][r["entry"]] += r["n"]
        for book, sums, counts in zip(self.books, self.sums, self.counts, strict=True):
            used = np.flatnonzero(counts > 0)
            book[used] = (sums[used] // counts[used][:, None]).astype(np.int64)
        return sum(r["pos"] == 0 for r in rows)


def assign(rows: DataFrame, books: list[np.ndarray]) -> DataFrame:
    """rows (vec_id, label, vec, code) with new codes and error (squared distances), and a task's summed contributions (part, entry, n, sums) of changed parts.

    code holds one byte pair (16 bits) a part; it is null before the first round, when every part counts as changed.
    """
    names = ["vec_id", "label", "vec", "code", "error", "part", "entry", "n", "sums"]

    def run(batches):
        sums, counts, schema = [np.zeros(b.shape, np.int64) for b in books], [np.zeros(len(b), np.int64) for b in books], None
        touched = [np.zeros(len(b), bool) for b in books]
        for batch in batches:
            schema, n = batch.schema, batch.num_rows
            if not n:
                continue
            x, at = _vectors(batch.column(2)), cuts(sum(b.shape[1] for b in books), len(books))
            known = batch.column(3).null_count == 0
            old = np.frombuffer(b"".join(batch.column(3).to_pylist()), "<u2").reshape(n, -1) if known else None
            new, error = np.empty((n, len(books)), "<u2"), np.zeros(n, np.int64)
            for k, book in enumerate(books):
                own = x[:, at[k] : at[k + 1]]
                new[:, k], far = nearest(own, book)
                error += far
                moved = np.flatnonzero(new[:, k] != old[:, k]) if known else np.arange(n)
                for entries, sign in ((new[moved, k], 1), (old[moved, k], -1)) if known else ((new[:, k], 1),):
                    np.add.at(sums[k], entries, sign * own[moved].astype(np.int64))
                    np.add.at(counts[k], entries, sign)
                    touched[k][entries] = True
            codes = pa.array([r.tobytes() for r in new], pa.binary())
            nothing = [pa.nulls(n, t) for t in (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], codes, pa.array(error), *nothing], names)
        found = [(k, e) for k in range(len(books)) for e in np.flatnonzero(touched[k])]
        if found:
            m = len(found)
            kept = [pa.nulls(m, schema.field(i).type) for i in range(4)]
            cells = [pa.array([k for k, _ in found], pa.int32()), pa.array([int(e) for _, e in found], pa.int32()), pa.array([int(counts[k][e]) for k, e in found], pa.int64()), pa.array([sums[k][e].tolist() for k, e in found], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays([*kept, pa.nulls(m, pa.int64()), *cells], names)

    schema = "vec_id long, label {}, vec binary, code binary, error long, part int, entry int, n long, sums array<long>".format(dict(rows.dtypes)["label"])
    return rows.select("vec_id", "label", "vec", "code").mapInArrow(_small_batches(run), schema)


def fit(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, scale: int = SCALE) -> tuple[DataFrame, list[np.ndarray], Scratch]:
    """(vec_id, label, code, error of every usable vector; the codebooks, integer arrays; the scratch tables).

    vectors: vec_id, embedding (array of numbers), label. The codebooks start as the parts of the `entries` smallest vec_ids (of vectors that share an id, the
    least vector; rows without an id don't count), so there are fewer entries if there are fewer ids. Repeated rows count as often as they are there.
    """
    scratch = Scratch(vectors.sparkSession)
    rows = scratch.save(to_integers(vectors, scale), "integers")
    ids = rows.where("vec_id IS NOT NULL").select("vec_id").distinct().orderBy("vec_id").limit(entries).agg(F.max("vec_id")).first()[0]
    start = rows.where(F.col("vec_id") <= ids).groupBy("vec_id").agg(F.min("vec").alias("vec")).orderBy("vec_id").collect() if ids is not None else []
    if not start:
        return rows.limit(0).select("vec_id", "label", F.lit(None).cast("binary").alias("code"), F.lit(None).cast("long").alias("error")), [], scratch
    first = np.array([np.frombuffer(r["vec"], "<i4") for r in start], np.int64)
    at = cuts(first.shape[1], parts)
    model = Lloyd([first[:, a:b].copy() for a, b in zip(at[:-1], at[1:], strict=True)])
    held = scratch.save(assign(rows.withColumn("code", F.lit(None).cast("binary")), model.books), "assigned")
    scratch.drop(rows)
    for _ in range(rounds):
        model.add(held.where("part IS NOT NULL").select("part", "entry", "n", "sums"))
        after = scratch.save(assign(held.where("part IS NULL"), model.books), "assigned")
        scratch.drop(held)
        held = after
    return held.where("part IS NULL").select("vec_id", "label", "code", "error"), model.books, scratch


def books_hash(books: list[np.ndarray]) -> str:
    """SHA-256 (lowercase hex) of all components, in decimal, by part, entry and place, comma-joined."""
    return hashlib.sha256(",".join(str(int(v)) for b in books for v in b.ravel()).encode()).hexdigest()


def encode(vectors: DataFrame) -> DataFrame:
    """vec_id, code (two hex digits a part), error, label_error (error of all rows with the label, null as one label; null beyond a long), codebooks_sha256.

    One row per usable vector (see to_integers()); no rows if there is none with an id. Columns of other names are not read.
    """
    rows, books, scratch = fit(vectors)
    digits = F.array(*(F.substring(F.hex("code"), 4 * k + 1, 2) for k in range(PARTS)))  # entries are below 256: the low byte of each pair
    total = scratch.save(rows.groupBy("label").agg(F.try_sum("error").alias("label_error")), "labels")
    n, salt = total.count(), hash_bucket(SALTS, "vec_id", "code", "error")
    small = checked_broadcast(total, n)
    if n > 1_000_000:
        rows, small = rows.withColumn("salt", salt), total.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = F.col("r.label").eqNullSafe(F.col("t.label")) & (F.col("r.salt") == F.col("t.salt"))
    else:
        both = F.col("r.label").eqNullSafe(F.col("t.label"))
    joined = rows.alias("r").join(small.alias("t"), both)
    return joined.select("vec_id", F.lower(F.concat_ws("", digits)).alias("code"), "error", "label_error", F.lit(books_hash(books)).alias("codebooks_sha256"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def _oracle() -> str:
    """Every round as a common table expression: parts against entries, nearest entry, integer means."""
    def assigned(k: int) -> str:
        far = "list_sum(list_transform(range(1, len(p.x) + 1), lambda i: (p.x[i] - b.x[i]) * (p.x[i] - b.x[i])))"
        return f"""d{k} AS MATERIALIZED (SELECT p.vec_id, p.part, b.entry, CAST({far} AS BIGINT) AS far FROM p JOIN b{k} b ON p.part = b.part),
a{k} AS MATERIALIZED (SELECT vec_id, part, arg_min(entry, far * {ENTRIES} + entry) AS entry, min(far) AS far FROM d{k} GROUP BY vec_id, part)"""

    def renewed(k: int) -> str:
        return f"""m{k} AS (
  SELECT part, entry, list(v ORDER BY pos) AS x FROM (
    SELECT part, entry, pos, CAST(floor_div AS BIGINT) AS v FROM (
      SELECT a.part, a.entry, u.pos, (sum(u.v) - ((sum(u.v) % count(*) + count(*)) % count(*))) // count(*) AS floor_div
      FROM a{k} a JOIN u ON a.vec_id = u.vec_id AND a.part = u.part GROUP BY a.part, a.entry, u.pos)) GROUP BY part, entry),
b{k + 1} AS MATERIALIZED (SELECT b.part, b.entry, coalesce(m.x, b.x) AS x FROM b{k} b LEFT JOIN m{k} m ON b.part = m.part AND b.entry = m.entry)"""

    steps = ",\n".join(f"{assigned(k)},\n{renewed(k)}" for k in range(ROUNDS)) + ",\n" + assigned(ROUNDS)
    return f"""
WITH q AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda v: CAST(floor({SCALE} * CAST(v AS DOUBLE)) AS BIGINT)) AS x FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda v: v IS NULL OR NOT isfinite(v))) = 0),
p AS MATERIALIZED (SELECT vec_id, part, x[part * (len(x) // {PARTS}) + 1:(part + 1) * (len(x) // {PARTS})] AS x FROM q, range({PARTS}) t(part)),
u AS MATERIALIZED (SELECT vec_id, part, unnest(range(1, len(x) + 1)) AS pos, unnest(x) AS v FROM p),
b0 AS MATERIALIZED (SELECT part, entry, x FROM p JOIN (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS entry FROM q ORDER BY vec_id LIMIT {ENTRIES}) USING (vec_id)),
{steps},
s AS (SELECT string_agg(list_aggregate(list_transform(x, lambda v: CAST(v AS VARCHAR)), 'string_agg', ','), ',' ORDER BY part, entry) AS all_entries FROM b{ROUNDS}),
c AS (SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{ROUNDS} GROUP BY vec_id)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, (SELECT sha256(all_entries) FROM s) AS codebooks_sha256 FROM c JOIN q USING (vec_id)
"""


ORACLE_SQL = _oracle()
