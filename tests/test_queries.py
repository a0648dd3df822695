"""Registered queries of gradients and identities against their DuckDB equivalents."""

import glob
import os

import duckdb
import pytest

from tabulon.queries import arrays, gradients, identities

CASES = [
    (gradients, n) for n in ("var_pow", "var_softmax", "var_cumprod", "var_gather", "var_group_norm", "var_inverse", "var_cholesky", "dual_div", "dual_narrow", "jvp_multi")
] + [(identities, n) for n in ("special_erfinv_identity", "special_betaincinv_identity", "linalg_solve_batch", "linalg_lu_decompose_batch", "linalg_logm_batch", "random_gamma_moments", "fp8_decode_e4m3")] + [
    (arrays, n) for n in ("centroid_accuracy", "embedding_lookup", "cdist_correlation", "squareform", "khatri_rao", "sparse_24_matmul")
]


@pytest.mark.parametrize(("module", "name"), CASES, ids=[n for _, n in CASES])
def test_query_equals_sql(spark, small, module, name):
    con = duckdb.connect()
    for f in glob.glob(f"{small}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    ours, theirs = module.QUERIES[name](spark, small).toPandas(), con.execute(module.ORACLES[name]).df()
    columns = sorted(ours.columns)
    assert columns == sorted(theirs.columns) and len(ours) == len(theirs)
    keys = [c for c in columns if c != "v"]
    ours, theirs = (x[columns].sort_values(keys or columns, ignore_index=True) for x in (ours, theirs))
    for c in columns:
        assert (ours[c] == theirs[c]).all(), c
