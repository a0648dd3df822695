"""Eigen- and singular value solvers on a matrix whose table is costly."""

import numpy as np
import pytest

from tabulon.operators import iterative
from tabulon.operators.sparse import Sparse


@pytest.mark.parametrize("solver", [iterative.sparse_eig_symmetric, iterative.sparse_eig, iterative.svds])
def test_the_matrix_is_made_once(spark, solver):
    seen = spark.sparkContext.accumulator(0)
    a = np.random.default_rng(0).normal(size=(6, 6))
    a = a + a.T

    def counted(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    rows = spark.createDataFrame([(i, j, float(a[i, j])) for i in range(6) for j in range(6)], "row long, col long, v double").mapInArrow(counted, "row long, col long, v double")
    out = solver(Sparse(rows, (6, 6)), 2)
    values = np.sort(np.abs(out[0] if isinstance(out, tuple) else out))[::-1]
    assert np.allclose(values, np.sort(np.abs(np.linalg.eigvalsh(a)))[::-1][:2], atol=1e-8) and seen.value == 36
