"""Published incidents, and hand-made cases."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.operators import decisions, incidents

# Mean sigma, windows, whether the velocity tier fired, printed confidence in per cent.
PUBLISHED = [
    (4.5440, 79, False, 86.6), (3.4856, 1320, True, 100.0), (7.0134, 731, True, 100.0), (19.7243, 143, False, 89.9), (212.3383, 625, True, 100.0), (2.8396, 27, False, 80.6), (44.6567, 276, True, 96.5),
    (61.9099, 164, False, 90.6), (3.3553, 2253, True, 100.0), (4.7845, 1131, False, 97.0), (9.2086, 15, True, 80.6), (16.0034, 20, True, 82.1), (14.3471, 25, True, 83.3), (14.7841, 22, True, 82.6),
]


def test_published_confidences(spark):
    df = spark.createDataFrame(PUBLISHED, "sigma double, n int, velocity boolean, printed double")
    fired = F.when(F.col("velocity"), 1.0).otherwise(0.85)
    df = df.withColumn("c", incidents.confidence(F.col("sigma"), F.col("n"), fired, F.lit(False)) * 100)
    for r in df.collect():
        assert abs(r.c - r.printed) < 0.06, r


def results(spark, rows):
    """rows of (second, is_anomaly, severity, culprit, deviation)"""
    start = dt.datetime(2024, 1, 1)
    full = [("c", i, start + dt.timedelta(seconds=s), a, float(v), c, float(d), 1.0, float(v), 0.0, 0, 0.0, 0, 0.0, False, None, False, False, -1) for i, (s, a, v, c, d) in enumerate(rows)]
    schema = (
        "capture_id string, bucket long, ts timestamp, is_anomaly int, severity double, physical_culprit string, culprit_deviation double, balltree_score double, balltree_severity double, gmm_score double, gmm_anomaly int, "
        "iforest_score double, iforest_anomaly int, vel_score double, vel_bypass boolean, family_consensus string, is_warmup boolean, soft_zone_triggered boolean, server_port int"
    )
    return spark.createDataFrame(full, schema)


def test_gap_of_exactly_the_debounce_does_not_split(spark):
    df = incidents.cluster(results(spark, [(0, 1, 1, None, 0), (30, 1, 1, None, 0), (61, 1, 1, None, 0)]), 30.0)
    assert [r.incident_id for r in df.orderBy("ts").collect()] == [0, 0, 1]


def test_features_keep_the_event_type_of_the_largest_sigma(spark):
    rows = [(0, 1, 1, "bytes (SPIKE (+10.0%), σ=2.00)", 1), (1, 1, 1, "bytes (DROP (5.0%), σ=3.00)", 1), (2, 1, 1, "bytes (SPIKE (+2.0%), σ=3.00)", 1), (3, 1, 1, "iat_mean (DROP (1.0%), σ=9.00)", 1), (4, 1, 1, None, 1)]
    got = incidents.top_features(incidents.cluster(results(spark, rows))).orderBy("rank").collect()
    assert [(r.feature, r.event_type, r.max_sigma, r.max_pct, r.family) for r in got] == [("iat_mean", "DROP", 9.0, 1.0, "connection"), ("bytes", "DROP", 3.0, 10.0, "volume")]


def test_stress_shares_sum_to_one_and_reset_nothing(spark):
    rows = [(i, 1, 1, f"{n} (SPIKE (+1.0%), σ=2.00)", d) for i, (n, d) in enumerate([("bytes", 3), ("flag_syn_ratio", -1), ("bytes", 4)])]
    got = {r.family: r.share for r in incidents.family_stress(incidents.cluster(results(spark, rows))).collect()}
    assert got == {"volume": 0.875, "flags": 0.125}


def test_quirk_burst_factor_counts_as_flags(spark):
    rows = [(0, 1, 1, "burst_factor (SPIKE (+1.0%), σ=2.00)", 1), (1, 1, 1, "igmp_ratio (SPIKE (+1.0%), σ=2.00)", 1)]
    assert {r.feature: r.family for r in incidents.parsed(results(spark, rows)).collect()} == {"burst_factor": "flags", "igmp_ratio": "unknown"}


def test_drops_and_their_reasons(spark):
    df = results(spark, [(0, 1, 3, None, 1), (100, 0, 0, None, 0), (101, 0, 0, None, 0), (300, 0, 0, None, 0), (361, 1, 2, None, 0)])
    found = incidents.incidents(incidents.cluster(df.filter("is_anomaly = 1")))
    got = [(r.gap_seconds, r.severity_before, r.reason[:12]) for r in incidents.data_drops(df, found).orderBy("end_time").collect()]
    assert got == [(100.0, 3, "Sensor Blind"), (199.0, None, "Capture Loss"), (61.0, 2, "[POSSIBLE_SE")]
    strict = [r.reason[:12] for r in incidents.data_drops(df, found, compat=False).orderBy("end_time").collect()]
    assert strict == ["[POSSIBLE_SE", "Capture Loss", "Sensor Blind"]


def test_persistence_trails(spark):
    flags = [0, 1, 1, 1, 1, 0, 0, 0, 1, 1, 0]
    df = spark.createDataFrame([("c", i, f, 1.0, i == 9) for i, f in enumerate(flags)], "capture_id string, bucket long, is_anomaly int, severity double, vel_bypass boolean")
    assert [r.is_anomaly for r in decisions.persist(df).orderBy("bucket").collect()] == [0, 0, 0, 1, 1, 1, 1, 0, 0, 1, 0]


@pytest.mark.parametrize("seed", range(3))
def test_state_machine_equals_a_walk(spark, seed):
    import random

    rng, score, rows = random.Random(seed), 1.0, []
    for i in range(400):
        score = max(0.0, score + rng.uniform(-0.3, 0.3))
        rows.append(("c", i, int(rng.random() < 0.7), score))
    df = spark.createDataFrame(rows, "capture_id string, bucket long, is_anomaly int, balltree_score double")
    state, want = (False, 0), []
    for _, _, flag, score in rows:
        value, state = decisions.hysteresis_step(state, flag, score, 1.0, 3, 1.0, 0.75)
        want.append(value)
    assert [r.stable for r in decisions.hysteresis(df, 1.0).orderBy("bucket").collect()] == want
