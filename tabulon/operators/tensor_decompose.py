"""Tensor decompositions: unfoldings, mode products and MTTKRP are joins and aggregates, only small factor matrices are solved on the driver."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from math import prod

import numpy as np
from pyspark.sql import functions as F

from tabulon.operators.contraction import einsum
from tabulon.plans.tensor import Tensor


def unfold(t: Tensor, mode: int) -> Tensor:
    """Matricization: mode by all others in their order."""
    order = [mode, *(k for k in range(t.rank) if k != mode)]
    return t.permute(order).reshape((t.shape[mode], prod(t.shape) // max(t.shape[mode], 1)))


def fold(m: Tensor, mode: int, shape: Sequence[int]) -> Tensor:
    order = [mode, *(k for k in range(len(shape)) if k != mode)]
    t = m.reshape([shape[k] for k in order])
    return t.permute([order.index(k) for k in range(len(shape))])


def mode_n_product(t: Tensor, m: Tensor, mode: int) -> Tensor:
    labels = "abcdefgh"[: t.rank]
    return einsum(f"{labels},z{labels[mode]}->{labels.replace(labels[mode], 'z')}", t, m)


def small(spark, a: np.ndarray) -> Tensor: return Tensor.from_slice(spark, a.ravel().tolist(), a.shape)


def as_array(t: Tensor) -> np.ndarray:
    """A small tensor on the driver: factors and cores, whose size is chosen by rank."""
    a = np.zeros(t.shape)
    for r in t.df.toLocalIterator():
        a[tuple(int(r[f"i{k}"]) for k in range(t.rank))] = r["v"]
    return a


def _leading(t: Tensor, mode: int, rank: int) -> np.ndarray:
    """Leading left singular vectors of an unfolding, from its Gram matrix: one join and aggregate."""
    labels = "abcdefgh"[: t.rank]
    other = labels.replace(labels[mode], "z")
    g = as_array(einsum(f"{labels},{other}->{labels[mode]}z", t, t))
    w, v = np.linalg.eigh(g)
    return v[:, ::-1][:, :rank]


@dataclass
class Tucker:
    core: Tensor
    factors: list[np.ndarray]


def hosvd(t: Tensor, ranks: Sequence[int]) -> Tucker:
    spark, factors, core = t.df.sparkSession, [_leading(t, k, r) for k, r in enumerate(ranks)], t
    for k, f in enumerate(factors):
        core = mode_n_product(core, small(spark, f.T), k)
    return Tucker(core, factors)


def tucker(t: Tensor, ranks: Sequence[int], iterations: int = 10) -> Tucker:
    """Higher-order orthogonal iteration."""
    spark, factors = t.df.sparkSession, hosvd(t, ranks).factors
    for _ in range(iterations):
        for k in range(t.rank):
            y = t
            for j in range(t.rank):
                if j != k:
                    y = mode_n_product(y, small(spark, factors[j].T), j)
            factors[k] = _leading(y, k, ranks[k])
    core = t
    for k, f in enumerate(factors):
        core = mode_n_product(core, small(spark, f.T), k)
    return Tucker(core, factors)


def tucker_reconstruct(d: Tucker) -> Tensor:
    t = d.core
    for k, f in enumerate(d.factors):
        t = mode_n_product(t, small(t.df.sparkSession, f), k)
    return t


def cp_decompose(t: Tensor, rank: int, iterations: int = 25, seed: int = 0) -> tuple[np.ndarray, list[np.ndarray]]:
    """Alternating least squares: weights and factors."""
    spark, rng = t.df.sparkSession, np.random.default_rng(seed)
    factors, labels = [rng.standard_normal((n, rank)) for n in t.shape], "abcdefgh"[: t.rank]
    weights = np.ones(rank)
    for _ in range(iterations):
        for k in range(t.rank):
            others = [j for j in range(t.rank) if j != k]
            notation = ",".join([labels, *(f"{labels[j]}z" for j in others)]) + f"->{labels[k]}z"
            m = as_array(einsum(notation, t, *(small(spark, factors[j]) for j in others)))
            g = np.ones((rank, rank))
            for j in others:
                g *= factors[j].T @ factors[j]
            f = m @ np.linalg.pinv(g)
            weights = np.linalg.norm(f, axis=0)
            factors[k] = f / np.where(weights > 0, weights, 1)
    return weights, factors


def cp_reconstruct(spark, weights: np.ndarray, factors: list[np.ndarray]) -> Tensor:
    labels = "abcdefgh"[: len(factors)]
    return einsum(",".join(["z", *(f"{c}z" for c in labels)]) + f"->{labels}", small(spark, weights), *(small(spark, f) for f in factors))


def tensor_train(t: Tensor, max_rank: int, tolerance: float = 1e-10) -> list[np.ndarray]:
    """Cores by sequential truncation; each step's singular vectors come from the Gram matrix of the rest's unfolding."""
    spark, cores, rest, rank = t.df.sparkSession, [], t, 1
    for k in range(t.rank - 1):
        m = rest.reshape((rank * t.shape[k], prod(t.shape[k + 1 :])))
        w, v = np.linalg.eigh(as_array(einsum("ab,cb->ac", m, m)))
        w, v = np.sqrt(np.maximum(w[::-1], 0)), v[:, ::-1]
        keep = max(1, min(max_rank, int((w > tolerance * max(w[0], 1e-300)).sum())))
        cores.append(v[:, :keep].reshape(rank, t.shape[k], keep))
        rest = einsum("ar,ab->rb", small(spark, v[:, :keep]), m)
        rank = keep
    cores.append(as_array(rest).reshape(rank, t.shape[-1], 1))
    return cores


def tt_reconstruct(spark, cores: list[np.ndarray]) -> Tensor:
    shape = [c.shape[1] for c in cores]
    left = small(spark, cores[0].reshape(-1, cores[0].shape[2]))
    for c in cores[1:]:
        left = einsum("ar,rb->ab", left, small(spark, c.reshape(c.shape[0], -1))).reshape((left.shape[0] * c.shape[1], c.shape[2]))
    return left.reshape(shape)


def frobenius(t: Tensor) -> float: return t.df.agg(F.sqrt(F.sum(F.col("v") * F.col("v")))).first()[0] or 0.0
