"""Dense products by blocks: long and flat matrices, sums in a tree."""

import numpy as np
import pytest

from tabulon.operators import contraction
from tests.test_blocked import dense, table


@pytest.mark.parametrize("shape", [(3, 70, 5), (70, 5, 3), (5, 3, 70), (1, 1, 1), (17, 16, 33)])
def test_equals_numpy(spark, shape, monkeypatch):
    monkeypatch.setattr(contraction, "FAN", 3)
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=shape[:2]), rng.normal(size=shape[1:])
    assert np.allclose(dense(contraction.block_matmul(table(spark, a), table(spark, b), 8).df, (shape[0], shape[2])), a @ b)


def test_blocks_are_no_larger_than_the_matrix_and_come_one_by_one(spark):
    flat = table(spark, np.ones((4, 3000)))
    blocks = contraction._blocks(flat, "r", "k", 4, 512).selectExpr("length(m) AS n").collect()
    assert len(blocks) == 6 and {r["n"] for r in blocks} == {4 * 512 * 8}
