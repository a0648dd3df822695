"""The transform of long vectors against NumPy's, with groups short enough that passes nest."""

import numpy as np
import pytest

from tabulon.operators import long_fft
from tabulon.plans.tensor import ShapeError


def table(spark, x): return spark.createDataFrame([(i, float(v.real), float(v.imag)) for i, v in enumerate(x) if v], "i long, re double, im double")


def values(df, n, key="k"):
    out = np.zeros(n, complex)
    for r in df.collect():
        out[r[key]] = r["re"] + 1j * r["im"]
    return out


@pytest.mark.parametrize(("n", "short"), [(1, 8192), (2, 8192), (64, 8192), (512, 4)])
def test_forward_and_back(spark, monkeypatch, n, short):
    monkeypatch.setattr(long_fft, "SHORT", short)
    rng = np.random.default_rng(n)
    x = rng.normal(size=n) + 1j * rng.normal(size=n)
    x[n // 2 :: 7] = 0  # missing rows
    y = long_fft.fft(table(spark, x), n)
    assert np.allclose(values(y, n), np.fft.fft(x))
    assert np.allclose(values(long_fft.ifft(y, n), n, "i"), x)


def test_short_transforms_and_odd_lengths(spark):
    x = np.random.default_rng(0).normal(size=(3, 128))
    assert np.allclose(long_fft.short_transforms(x), np.fft.fft(x)) and np.allclose(long_fft.short_transforms(x, 1), np.fft.ifft(x) * 128)
    with pytest.raises(ShapeError):
        long_fft.fft(table(spark, np.ones(3)), 3)


def test_real_vectors(spark):
    x = np.random.default_rng(1).normal(size=32)
    y = long_fft.rfft(spark.createDataFrame(list(enumerate(x.tolist())), "i long, v double"), 32)
    assert np.allclose(values(y, 17), np.fft.rfft(x))
    back = {r["i"]: r["v"] for r in long_fft.irfft(y, 32).collect()}
    assert np.allclose([back[i] for i in range(32)], x)
