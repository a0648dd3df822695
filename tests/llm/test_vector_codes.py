"""Delta-maintained Lloyd against a plain one that assigns and averages everything anew in each round."""

import glob
import hashlib
import math
import os

import duckdb
import numpy as np

from tabulon.llm import vector_codes

SCHEMA = "vec_id long, embedding array<{}>, label int, code string, error long, part int, n string"


def brute(rows):
    kept = [(i, [math.floor(1024 * v) for v in x], label) for i, x, label in rows if x and all(v is not None and math.isfinite(v) for v in x)]
    size = len(min((r for r in kept if r[0] is not None), key=lambda r: (r[0], len(r[1])))[1])
    kept = [r for r in kept if len(r[1]) == size]
    cuts = [k * size // 4 for k in range(5)]
    first = {}
    for i, x, _ in kept:
        if i is not None:
            first[i] = min(first.get(i, x), x, key=lambda v: np.array(v, "<i4").tobytes())
    start = [first[i] for i in sorted(first)[:256]]
    books = [[x[a:b] for x in start] for a, b in zip(cuts, cuts[1:])]

    def near(part, k):
        return min((sum((a - b) ** 2 for a, b in zip(part, entry)), e) for e, entry in enumerate(books[k]))

    def parts():
        return [[near(x[a:b], k) for k, (a, b) in enumerate(zip(cuts, cuts[1:]))] for _, x, _ in kept]

    for _ in range(4):
        at = parts()
        for k, (a, b) in enumerate(zip(cuts, cuts[1:])):
            for e in range(len(books[k])):
                own = [x[a:b] for (_, x, _), p in zip(kept, at) if p[k][1] == e]
                if own:
                    books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    out = [(i, "".join(f"{e:02x}" for _, e in p), sum(d for d, _ in p), label) for (i, _, label), p in zip(kept, parts())]
    total = {}
    for _, _, error, label in out:
        total[label] = total.get(label, 0) + error
    digest = hashlib.sha256(",".join(str(v) for book in books for entry in book for v in entry).encode()).hexdigest()
    return sorted((repr(i), code, error, total[label], digest) for i, code, error, label in out)


def coded(spark, rows, kind="double"):
    frame = spark.createDataFrame([(i, x, label, "c", 1, 2, "n") for i, x, label in rows], SCHEMA.format(kind)).repartition(3)
    out = vector_codes.encode(frame).collect()
    return sorted((repr(r["vec_id"]), r["code"], r["error"], r["label_error"], r["codebooks_sha256"]) for r in out)


def test_rounds_odd_rows_and_ties(spark):
    rng = np.random.default_rng(3)
    rows = [(int(i), np.round(rng.normal(size=8), 1).tolist(), [None, 1, 2][i % 3]) for i in rng.permutation(700)]
    rows += [(900, rows[0][1], 1)] * 40 + [(rows[0][0], rows[0][1], 2), (rows[1][0], rows[5][1], 2), (None, rows[3][1], None), (None, rows[3][1], None)]
    rows += [(901, None, 1), (902, [], 1), (903, [None] + [1.0] * 7, 1), (904, [math.nan] + [1.0] * 7, 1), (905, [math.inf] * 8, None), (906, [1.0] * 9, 1), (-1, [-0.0005] * 8, 1), (907, [-0.0] * 8, 1)]
    assert coded(spark, rows) == brute(rows)


def test_one_value_and_few_ids(spark):
    rows = [(i % 3, [1.0, 2.0, 3.0, 4.0, 5.0, 6.0], i % 2) for i in range(300)]
    assert coded(spark, rows) == brute(rows)


def test_large_components_are_exact(spark):
    rng = np.random.default_rng(4)
    rows = [(i, (rng.normal(size=4) * 9000).tolist(), 0) for i in range(300)]
    assert coded(spark, rows) == brute(rows)
    most = vector_codes.bound(4)
    assert max(abs(v) for _, x, _ in rows for v in x) * 1024 < most and vector_codes.EXACT < most
    far = [*rows, (300, [1e300, -1e300, 1.0, 1.0], 0)]
    assert coded(spark, far) == brute([*rows, (300, [most / 1024, -most / 1024, 1.0, 1.0], 0)])


def test_nothing_usable(spark):
    assert coded(spark, []) == [] and coded(spark, [(1, None, 1), (2, [], 1)]) == [] and coded(spark, [(None, [1.0] * 4, 1)]) == []


def test_only_changed_parts_contribute(spark):
    rows = spark.createDataFrame([(i, [float(i % 7)] * 8, 0) for i in range(500)], "vec_id long, embedding array<double>, label int")
    books = [np.array([[0, 0], [3000, 3000], [6000, 6000]]) for _ in range(4)]
    once = vector_codes.assign(vector_codes.to_integers(rows).withColumn("code", vector_codes.F.lit(None).cast("binary")), books).cache()
    assert once.where("part IS NOT NULL").agg({"n": "sum"}).first()[0] == 4 * 500
    again = vector_codes.assign(once.where("part IS NULL"), books)
    assert again.where("part IS NOT NULL").count() == 0
    moved = [b.copy() for b in books]
    moved[2][1] = [2900, 5000]
    deltas = vector_codes.assign(once.where("part IS NULL"), moved).where("part IS NOT NULL")
    got = deltas.groupBy("part", "entry").agg({"n": "sum"}).collect()
    assert {r["part"] for r in got} == {2} and sum(r[2] for r in got) == 0



def test_registered_query_equals_sql(spark, small):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    names = ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    want = con.execute(f"SELECT {', '.join(names)} FROM ({vector_codes.ORACLE_SQL}) ORDER BY vec_id").fetchall()
    assert sorted(tuple(r) for r in vector_codes.query(spark, small).select(*names).collect()) == want
