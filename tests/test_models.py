"""Queries without SQL against NumPy, parsing against the grammar, and what the report holds."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.conftest import ORACLE
from tidemark.dimensions import FAMILY_VARIANCE, FEATURE_FAMILIES
from tidemark.functions import culprits
from tidemark.functions.packets import entropies
from tidemark.operators import detectors, evaluation, incidents, windows
from tidemark.plans import catalogue
from tidemark.plans.catalogue import QUERIES


@pytest.fixture(scope="module")
def frame(spark):
    """The doubles that the model queries are fitted on, in order of buckets."""
    return catalogue._doubles(spark, ORACLE).toPandas().sort_values(["capture_id", "bucket"]).reset_index(drop=True)


def in_order(df, name):
    rows = df.select("capture_id", "bucket", name).toPandas().sort_values(["capture_id", "bucket"])
    return np.array(rows[name].tolist(), float)


def test_blocked_components(spark, frame):
    got = in_order(QUERIES["m_pca_blocked"](spark, ORACLE), "coords")
    at = 0
    for family, members in FEATURE_FAMILIES.items():
        own = [n for n in members if n in frame.columns]
        if not own:
            continue
        x = frame[own].to_numpy(float)
        spread = x.std(0)
        z = (x - x.mean(0)) / np.where(spread == 0, 1, spread)
        _, s, v = np.linalg.svd(z, full_matrices=False)
        share = np.cumsum(s**2) / (s**2).sum()
        k = min(len(own), int(np.searchsorted(share, FAMILY_VARIANCE.get(family, 0.99), side="right")) + 1)
        part = got[:, at : at + k]
        # The same axes but for their signs: coordinates have the singular values as lengths, and span the same space.
        assert np.allclose(np.linalg.norm(part, axis=0), s[:k], rtol=1e-6, atol=1e-6)
        assert np.allclose(part @ part.T, (z @ v[:k].T) @ (z @ v[:k].T).T, atol=1e-5 * max(1, s[0] ** 2))
        at += k
    assert at == got.shape[1]


def test_mixture_scores_are_log_densities_and_steps_raise_likelihood(spark):
    points = in_order(catalogue._points(spark, ORACLE), "coords")
    df = spark.createDataFrame([(p.tolist(),) for p in points], "coords array<double>")
    totals = [detectors.maximise(df, [3], max_iter=n, tolerance=0.0, bayesian=False, reg=1e-6)[3].likelihood for n in (1, 3, 9)]
    assert totals == sorted(totals)
    model = detectors.fit_mixture(df, 3)
    want = np.zeros(len(points))
    for w, m, c in zip(model.weights, model.means, model.covariances, strict=True):
        gap = points - m
        want += w * np.exp(-0.5 * np.einsum("ni,ij,nj->n", gap, np.linalg.inv(c), gap)) / math.sqrt(np.linalg.det(2 * math.pi * c))
    got = in_order(QUERIES["m_gmm_em"](spark, ORACLE), "ll")
    assert np.allclose(got, np.log(want), rtol=1e-4, atol=1e-4)
    assert model.ll_mean == pytest.approx(np.log(want).mean(), rel=1e-4) and model.threshold == pytest.approx(np.percentile(-np.log(want), 99.9), rel=1e-3)


def test_forest_scores_by_walking_each_tree(spark):
    points = in_order(catalogue._points(spark, ORACLE), "coords")
    df = spark.createDataFrame([(p.tolist(),) for p in points], "coords array<double>")
    model = detectors.fit_forest(df, trees=20)

    def path(n):
        return 0.0 if n < 2 else 1.0 if n == 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n

    def walk(x):
        depths = []
        for feature, cut, left, right, size in model.trees:
            at = depth = 0
            while feature[at] >= 0:
                at, depth = (left if x[feature[at]] < cut[at] else right)[at], depth + 1
            depths.append(depth + path(size[at]))
        return 2 ** (-(sum(depths) / len(depths)) / path(model.sample))

    assert np.allclose(model.score(points), [walk(x) for x in points])
    far = points.mean(0) + 50 * points.std(0)
    assert model.score(far[None])[0] > np.percentile(model.score(points), 99)
    rows = QUERIES["m_iforest"](spark, ORACLE).collect()
    assert len(rows) == len(points) and 0.01 < np.mean([r.anomaly for r in rows]) < 0.06 and all(0 < r.score < 1 for r in rows)


def test_univariate_mixtures_are_likelier_than_one_normal(spark, frame):
    rows = QUERIES["m_univariate"](spark, ORACLE).collect()
    assert {r.feature for r in rows} == {n for n in catalogue._COV if frame[n].std(ddof=0) >= 1e-6}
    for r in rows:
        x = frame[r.feature].dropna().to_numpy(float)
        w, m, v = (np.array(a) for a in (r.weights, r.means, r.variances))
        assert w.sum() == pytest.approx(1) and (v > 0).all()
        logs = np.log(w) - 0.5 * np.log(2 * np.pi * v) - (x[:, None] - m) ** 2 / (2 * v)
        ll = np.logaddexp.reduce(logs, axis=1)
        one = -0.5 * np.log(2 * np.pi * x.var()) - (x - x.mean()) ** 2 / (2 * x.var())
        free = 3 * len(w) - 1
        cost = lambda total, free: -2 * total + 0.5 * free * (math.log(len(x)) + 2)
        assert cost(ll.sum(), free) <= cost(one.sum(), 2) + 1
        df = spark.createDataFrame([(float(a),) for a in x[:50]], "x double")
        got = df.select(detectors.univariate_likelihood(F.col("x"), {"weights": w.tolist(), "means": m.tolist(), "variances": v.tolist()}).alias("l")).toPandas()["l"]
        assert np.allclose(got, ll[:50], atol=1e-8)


def test_augmented_rows_are_rows_with_noise(spark, frame):
    rows = QUERIES["u_union_augment"](spark, ORACLE).toPandas()
    names, n = catalogue._COV, len(frame)
    whole = frame.set_index(["capture_id", "bucket"])[names]
    seen = {}
    extra = []
    for r in rows.itertuples(index=False):
        key, values = (r.capture_id, r.bucket), np.array([getattr(r, c) for c in names])
        if key not in seen and np.allclose(values, whole.loc[key].to_numpy()):
            seen[key] = True
        else:
            extra.append((key, values))
    assert len(seen) == n and 0.05 * n < len(extra) < 0.15 * n
    gaps = np.array([v - whole.loc[k].to_numpy() for k, v in extra]) / whole.std().to_numpy()
    assert np.abs(gaps).max() < 0.05 * 6 and gaps.std() == pytest.approx(0.05, rel=0.25)


def test_culprits_are_read_in_any_case(spark):
    texts = ["  Flag_SYN_ratio (spike (+5%), σ=4.2) | x", "bytes (DROP (-12.5%), Σ = 3)", "pps (SPIKE (+1.2.3%), σ=1.2.3)", "\tvel_pps_z(z=+3)", "(nothing)", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    got = df.select("i", culprits.base_name(F.col("t")).alias("n"), culprits.event_type(F.col("t")).alias("e"), culprits.sigma(F.col("t")).alias("s"), culprits.percent(F.col("t")).alias("p")).orderBy("i").collect()
    assert [(r.n, r.e, r.p) for r in got] == [("flag_syn_ratio", "SPIKE", 5.0), ("bytes", "DROP", 12.5), ("pps", "SPIKE", 0.0), ("vel_pps_z", "UNKNOWN", 0.0), ("unknown", "UNKNOWN", 0.0), ("unknown", "UNKNOWN", 0.0), ("unknown", "UNKNOWN", 0.0)]
    assert [r.s for r in got][0] == 4.2 and [r.s for r in got][2:] == [0.0] * 5


def test_entropies_of_many_texts():
    rng = np.random.default_rng(1)
    data = [b"", b"aaaa", b"ab", bytes(range(256))] + [rng.bytes(int(n)) for n in rng.integers(1, 400, 30)]

    def plain(x):
        counts = np.array([x.count(b) for b in set(x)], float) / max(len(x), 1)
        return float(-(counts * np.log2(counts)).sum()) if x else 0.0

    for rows in (3, 4096):
        assert np.allclose(entropies(data, rows), [plain(x) for x in data])


def test_only_numbers_are_features(spark):
    df = spark.sql("SELECT 'a' AS capture_id, 1L AS bucket, 'x' AS remark, 1.0D AS pps_velocity, 2 AS flag_syn_ratio, true AS bytes_odd")
    assert windows.feature_names(df) == ["pps_velocity", "flag_syn_ratio"]


def _found(spark, rows):
    df = spark.createDataFrame(rows, "capture_id string, incident_id long, a long, b long")
    return df.select("capture_id", "incident_id", F.timestamp_seconds("a").alias("start_time"), F.timestamp_seconds("b").alias("end_time"))


def test_windows_of_one_label_count_apart(spark):
    truth = spark.createDataFrame([("dos", 100, 200), ("dos", 1000, 1100)], "label string, a long, b long").select("label", F.timestamp_seconds("a").alias("win_start"), F.timestamp_seconds("b").alias("win_end"))
    r = evaluation.coverage(_found(spark, [("c", 0, 150, 160), ("c", 1, 500, 510)]), truth).first()
    assert (r.recall, r["precision"]) == (0.5, 0.5)


def test_peaks_inside_and_nearest(spark):
    rows = [("c", 10, 1.0), ("c", 20, 5.0), ("c", 8000, 2.0), ("c", 8010, 3.0), ("d", 5, 9.0)]
    results = spark.createDataFrame(rows, "capture_id string, t long, y double").select("capture_id", F.timestamp_seconds("t").alias("ts"), "y")
    found = _found(spark, [("c", 0, 5, 25), ("c", 1, 100, 200), ("c", 2, 7990, 8009), ("c", 3, 8004, 8006), ("c", 4, 20, 9000), ("d", 0, 1, 2), ("e", 0, 1, 2)])
    got = {(r.capture_id, r.incident_id): r.peak for r in evaluation.peaks(found, results, "y").collect()}
    assert got == {("c", 0): 5.0, ("c", 1): 5.0, ("c", 2): 2.0, ("c", 3): 2.0, ("c", 4): 5.0, ("d", 0): 9.0, ("e", 0): None}


def test_radar_falls_back_to_counts(spark):
    rows = spark.createDataFrame([("c", 0, 1, "flag_syn_ratio (SPIKE (+5%), σ=0.0)", "flags", 0.0), ("c", 0, 2, "bytes_velocity (SPIKE (+5%), σ=0.0)", "kinematics", 0.0), ("c", 0, 3, "x (DROP (-5%), σ=0.0)", "flags", 0.0)], "capture_id string, incident_id long, bucket long, physical_culprit string, family_consensus string, culprit_deviation double")
    got = [(r.family, round(r.value, 6)) for r in incidents.family_radar(incidents.family_stress(rows), rows).orderBy("axis").collect()]
    assert [f for f, _ in got] == list(incidents.RADAR) and dict(got)["flags"] == pytest.approx(2 / 3) and dict(got)["kinematics"] == pytest.approx(1 / 3)
    empty = rows.filter("false")
    assert [r.value for r in incidents.family_radar(incidents.family_stress(empty), empty).collect()] == [0.0] * 6

