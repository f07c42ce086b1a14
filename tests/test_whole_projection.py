"""The global mode: clipped, made normal, whitened, guarded, over all features."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tidemark.operators import projection
from tidemark.plans import sql as S
from tidemark.plans.catalogue import QUERIES

NAMES = ["heavy", "signed", "left", "flat"]


def yeo_johnson(x, p):
    plus = np.log1p(np.maximum(x, 0)) if abs(p) < 1e-9 else ((np.maximum(x, 0) + 1) ** p - 1) / p
    q = 2 - p
    minus = -np.log1p(-np.minimum(x, 0)) if abs(q) < 1e-9 else -((1 - np.minimum(x, 0)) ** q - 1) / q
    return np.where(x >= 0, plus, minus)


def likelihood(x, p):
    return -len(x) / 2 * np.log(yeo_johnson(x, p).var()) + (p - 1) * (np.sign(x) * np.log1p(np.abs(x))).sum()


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(6)
    x = np.stack([rng.lognormal(0, 1.5, 800), rng.normal(0, 2, 800) ** 3 / 4, 10 - rng.exponential(0.4, 800), np.full(800, 2.0)], 1)
    x[0, 0] = 1e9
    return x


def test_global_mode(spark, rows):
    df = spark.createDataFrame(rows.tolist(), NAMES)
    (block,) = projection.fit_global(df, NAMES, 0.999)
    low, high = np.where(rows.min(0) >= 0, 0, rows.min(0)), np.percentile(rows, 99, axis=0)
    assert np.allclose(block.low, low) and np.allclose(block.high, high)
    x = np.clip(rows, low, high)
    for i in range(3):
        best = max(np.linspace(-6, 30, 7201), key=lambda p: likelihood(x[:, i], p))
        assert block.powers[i] == pytest.approx(best, abs=0.01)
    assert block.powers[3] == 1.0
    got = np.array([r.coords for r in projection.project(df, [block]).select("coords").collect()])
    assert np.allclose(np.cov(got.T), np.eye(got.shape[1]), atol=1e-6) and np.allclose(got.mean(0), 0, atol=1e-8)
    t = np.stack([yeo_johnson(x[:, i], p) for i, p in enumerate(block.powers)], 1)
    t = (t - t.mean(0)) / np.where(t.std(0) > 1e-12, t.std(0), 1)
    assert np.allclose(got, t @ np.array(block.loadings).T / np.array(block.deviations), atol=1e-6)


def test_new_rows_are_clipped_and_guarded(spark, rows):
    (block,) = projection.fit_global(spark.createDataFrame(rows.tolist(), NAMES), NAMES, 0.999)
    new = spark.createDataFrame([(1e300, 0.0, 9.0, 2.0), (block.high[0], 0.0, 9.0, 2.0), (float("nan"), None, 9.0, 2.0)], ", ".join(f"{n} double" for n in NAMES))
    a, b, c = (r.coords for r in projection.project(new, [block]).select("coords").collect())
    assert a == b and np.isfinite(c).all()


def test_all_features_are_projected(spark, monkeypatch):
    seen = []
    fit = projection.fit_global
    monkeypatch.setattr(projection, "fit_global", lambda df, names, share: (seen.append(names), fit(df, names, share))[1])
    assert QUERIES["m_pca_global"](spark, ORACLE).filter(F.exists("coords", F.isnan)).count() == 0
    assert seen == [S.FEATURES]


def test_powers_that_overflow_are_left_out(spark):
    x = np.r_[np.linspace(1e80, 9e80, 200), 5e80]
    (power,) = projection.yeo_johnson_powers(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"]).values()
    assert np.isfinite(yeo_johnson(x, power)).all()
