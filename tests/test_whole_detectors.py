"""Detectors fit on all rows, in the range that they are configured for."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tidemark.config import Settings
from tidemark.operators import detectors
from tidemark.plans import tables as T
from tidemark.plans import workflows
from tidemark.plans.catalogue import QUERIES


def test_neighbours_of_more_rows_than_a_sample(spark):
    x = np.sort(np.random.default_rng(1).exponential(size=100_300))
    df = spark.createDataFrame([(float(v),) for v in x], "v double").select(F.array("v").alias("coords"))
    model = detectors.fit_neighbours(df, k=1)
    gaps = np.r_[np.inf, np.diff(x), np.inf]
    nearest = np.minimum(gaps[:-1], gaps[1:])
    assert len(model.points) == len(x)
    for p, value in model.percentiles.items():
        assert value == pytest.approx(np.percentile(nearest, p), abs=1e-12)


def test_blocks_of_points_give_the_same_neighbours():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(500, 3))
    points[:40] = points[0]
    d = np.sort(np.sqrt(((points[:, None] - points[None]) ** 2).sum(-1)), axis=1)
    for width in (3, 64, 499, 1000):
        assert np.allclose(detectors.mean_distances(points, points, 5, width=width), d[:, 1:6].mean(1))
    assert not detectors.mean_distances(points[:4], points[:4], 5, width=3).any()  # fewer points than k, all equal


def test_components_are_chosen_from_the_whole_range(spark):
    rows = QUERIES["m_kselect"](spark, ORACLE).collect()
    n = QUERIES["m_gmm_em"](spark, ORACLE).count()
    assert sorted(r.k for r in rows) == list(range(2, min(25, n // 10 - 1) + 1))


def test_training_passes_its_settings(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(detectors, "choose_components", lambda df, most, **fit: (seen.append((most, fit["max_iter"])), (2, []))[1])
    packets = T.packets(spark, ORACLE)
    workflows.train(packets, Settings.of({"mixture": {"most_components": 13, "max_iter": 37}, "forest": {"trees": 5}, "training": {"least_rows": 1}}))
    assert seen == [(13, 37)]


def test_mixtures_fitted_at_once_equal_those_alone(spark):
    rng = np.random.default_rng(3)
    x = np.concatenate([rng.normal(c, 0.3, (150, 2)) for c in ((0, 0), (6, 0), (0, 6), (6, 6), (12, 0), (12, 6), (0, 12), (6, 12))])
    df = spark.createDataFrame([(r.tolist(),) for r in x], "coords array<double>")
    k, rows = detectors.choose_components(df, most=10, reg=1e-3)
    assert k == 8
    alone = detectors.maximise(df, [8], reg=1e-3)[8]
    assert detectors.information(alone, len(x))[0] == pytest.approx(next(r["bic"] for r in rows if r["k"] == 8))


@pytest.mark.parametrize("n", [2000, 9000])
def test_one_outlier_leaves_the_mixture_of_a_feature(spark, n):
    rng = np.random.default_rng(7)
    x = np.r_[rng.normal(0, 1, n), rng.normal(10, 0.5, n), 1e7]
    params = detectors.fit_univariate(spark.createDataFrame([(float(v),) for v in x], "v double"), ["v"])["v"]
    found = sorted((m, v) for m, v, w in zip(params["means"], params["variances"], params["weights"], strict=True) if w > 0.2)
    assert [m for m, _ in found] == pytest.approx([0, 10], abs=0.2) and [v for _, v in found] == pytest.approx([1, 0.25], rel=0.15)
