"""NN-descent near-dedup against all pairs."""

import numpy as np

from tabulon.llm import embedding_dedup


def brute(rows):
    keep = [(i, np.array(v, float)) for i, v in rows if i is not None and v and None not in v and np.isfinite(np.array(v, float)).all() and np.any(v)]
    links, up = {}, {i: i for i, _ in rows if i is not None}
    for a, (i, x) in enumerate(keep):
        for j, y in keep[:a]:
            if len(x) == len(y) and x @ y / np.sqrt((x @ x) * (y @ y)) >= 0.95:
                links[i] = links.get(i, 0) + 1
                links[j] = links.get(j, 0) + 1
                p, q = i, j
                while up[p] != p:
                    p = up[p]
                while up[q] != q:
                    q = up[q]
                up[max(p, q)] = min(p, q)

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    return {i: (links.get(i, 0), root(i)) for i in up}


def test_groups_of_all_sizes_and_odd_vectors(spark):
    rng = np.random.default_rng(1)
    rows, at = [], 0
    for size in (1, 2, 3, 60, 150, *[1] * 150, *[2] * 20):
        centre = rng.standard_normal(32)
        for _ in range(size):
            rows.append((at, (centre + rng.standard_normal(32) * 0.08).astype(np.float32).tolist()))
            at += 1
    rows += [(at + k, rows[5][1]) for k in range(4)]
    at += 4
    odd = [None, [], [0.0] * 32, [float("nan")] * 32, [float("inf")] + [1.0] * 31, [None] + [1.0] * 31, [1.0, 2.0], [2.0, 4.0], [1e-30, 2e-30], [3e38, 3e38]]
    rows += [(at + k, v) for k, v in enumerate(odd)] + [(None, rows[0][1])]
    frame = spark.createDataFrame([(i, v, "x") for i, v in rows], "vec_id long, embedding array<float>, component_id string").repartition(4)
    out = embedding_dedup.near_dedup(frame).collect()
    want = brute([(i, None if v is None else [None if e is None else float(np.float32(e)) for e in v]) for i, v in rows])
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in out if r["vec_id"] is not None}
    assert len(out) == len(rows) and got == want
    assert all(r["kept"] == (r["vec_id"] == r["component_id"]) for r in out if r["vec_id"] is not None)


def test_registered_table(spark, small):
    rows = [(r[0], list(r[1])) for r in spark.read.parquet(f"{small}/embeddings.parquet").select("vec_id", "embedding").collect()]
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.query(spark, small).collect()}
    assert got == brute(rows)


def test_empty_table(spark):
    assert embedding_dedup.near_dedup(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def grouped(sizes):
    rng = np.random.default_rng(2)
    rows = []
    for size in sizes:
        centre = rng.standard_normal(32)
        rows += [(len(rows) + j, (centre + rng.standard_normal(32) * 0.08).astype(np.float32).tolist()) for j in range(size)]
    return rows


def test_audit_sees_lost_small_groups(spark):
    """A large group's links must not hide that all pairs are lost."""
    rows = grouped([200, *[2] * 200])
    links = brute([(i, [float(np.float32(e)) for e in v]) for i, v in rows])
    vectors = spark.createDataFrame([(i, 32, 1, v) for i, v in rows], "u long, dim int, copies long, vec array<float>").cache()
    audit = lambda n: embedding_dedup.audit(vectors, spark.createDataFrame([(i, c) for i, (c, _) in links.items() if c > n], "u long, links long"))
    assert audit(0) == 1.0 and audit(1) < 0.5


def test_failed_audit_ends_in_exact_links_or_an_error(spark, monkeypatch):
    import pytest

    rows = grouped([1, 60, *[2] * 30, 3])
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    none = spark.createDataFrame([], "u long, v long, s double")
    monkeypatch.setattr(embedding_dedup, "start", lambda *_: none)
    got = {r["vec_id"]: (r["n_links"], r["component_id"]) for r in embedding_dedup.near_dedup(frame).collect()}
    assert got == brute([(i, [float(np.float32(e)) for e in v]) for i, v in rows])
    monkeypatch.setattr(embedding_dedup, "EXACT", 10)
    with pytest.raises(RuntimeError, match="recall"):
        embedding_dedup.near_dedup(frame)


def test_failed_audit_is_exact_at_any_size(spark, monkeypatch):
    """No number of vectors turns the exact comparison into an error."""
    import pyarrow as pa

    rng = np.random.default_rng(3)
    group = np.repeat(np.arange(25_001), [100, *[2] * 25_000])
    vectors = (rng.standard_normal((25_001, 32))[group] + rng.standard_normal((len(group), 32)) * 0.05).astype(np.float32)
    least = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    flat = pa.ListArray.from_arrays(pa.array(np.arange(0, vectors.size + 1, 32), pa.int32()), pa.array(vectors.ravel()))
    frame = spark.createDataFrame(pa.table({"vec_id": pa.array(np.arange(len(group))), "embedding": flat})).repartition(8)
    none = spark.createDataFrame([], "u long, v long, s double")
    monkeypatch.setattr(embedding_dedup, "start", lambda *_: none)
    monkeypatch.setattr(embedding_dedup, "TRIES", 1)
    out = embedding_dedup.near_dedup(frame).orderBy("vec_id").toArrow()
    assert (out["n_links"].to_numpy() == np.bincount(group)[group] - 1).all()
    assert (out["component_id"].to_numpy() == least[group]).all()


def test_exact_comparison_returns_fewer_pairs_than_rows(spark, monkeypatch):
    rows = grouped([700, 3, 1])
    vectors = spark.createDataFrame([(i, 32, 1, v) for i, v in rows], "u long, dim int, copies long, vec array<float>")
    labels = spark.createDataFrame([], "node long, component long")
    monkeypatch.setattr(embedding_dedup, "STRIP", 100, raising=False)
    pairs = embedding_dedup.across(vectors, labels).collect()
    assert len(pairs) == 701 and {r["b"] for r in pairs if r["a"] == 0} == set(range(1, 700)) and {r["b"] for r in pairs if r["a"] == 700} == {701, 702}
