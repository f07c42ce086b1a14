"""Registered queries and the SQL that must give the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.dimensions import FLAG_BITS, PROTOCOLS as PROTOCOL_NAMES, TECHNIQUES
from tidemark.functions import culprits
from tidemark.functions.packets import byte_entropy, protocol_name
from tidemark.functions.statistics import NORMAL_CDF_SQL, normal_cdf
from tidemark.operators import decisions, detectors, evaluation, health, incidents, projection, scaling, windows
from tidemark.plans import sql as S
from tidemark.plans import tables as T
from tidemark.scratch import staged
from tidemark.sources.adapters import lineitems_as_packets

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}
KEYS = ("capture_id", "bucket")


def register(name: str, oracle: str | None = None):
    def add(query: Query) -> Query:
        QUERIES[name] = query
        if oracle:
            ORACLES[name] = oracle
        return query

    return add


def _r(*names: str) -> str:
    return ", ".join(f"round({n}, 6) AS {n}" for n in names)


def _columns(name: str, table, ctes: str, source: str, exact: list[str], doubles: list[str], where: str = "") -> None:
    """A query that shows columns of a table, and its SQL."""
    sql = f"WITH {ctes.strip()} SELECT {', '.join([*exact, *([_r(*doubles)] if doubles else [])])} FROM {source} {where}"
    register(name, sql)(lambda spark, sf: T.rounded(table(spark, sf), *exact, *doubles))


# ---- windows ----

_columns("w_base_agg", T.base, S.BASE, "base", [*KEYS, "pps", "bytes", "unique_dst_ports", "size_max", "total_payload", "total_req", "total_res", "server_port"], ["size_avg", "entropy_avg", "ts_min", "ts_max", "_abs_timestamp"])
_columns("w_protocol_pivot", T.base, S.BASE, "base", [*KEYS, *[f"count_{p.lower()}" for p in S.PROTOCOLS], *[f"count_flag_{f}" for f in FLAG_BITS]], [])
_columns("w_flag_ratios", T.physics, S.PHYSICS, "physics", [*KEYS], [*[f"{p.lower()}_ratio" for p in S.PROTOCOLS], *[f"flag_{f}_ratio" for f in FLAG_BITS], "port_scan_ratio"])
_columns("w_ratios_physics", T.physics, S.PHYSICS, "physics", [*KEYS], ["total_pps_log", "total_bytes_log", "burst_factor", "flow_duration", "payload_continuity", "payload_continuity_ratio", "iat_mean"])
_columns("w_velocity_accel", T.kinematics, S.KINEMATICS, "windows", [*KEYS], [f"{s}_{k}" for s in ("pps", "bytes", "entropy") for k in ("velocity", "acceleration")])
_columns("w_volatility", T.kinematics, S.KINEMATICS, "windows", [*KEYS], [f"{s}_volatility" for s in ("pps", "bytes", "entropy")])
_columns("w_momentum", T.kinematics, S.KINEMATICS, "windows", [*KEYS], ["pps_momentum"])
_columns("w_velocity_z", T.kinematics, S.KINEMATICS, "windows", [*KEYS], ["vel_pps_z", "vel_bytes_z", "vel_syn_z"])


@register(
    "w_lineitem_days",
    """WITH p AS (SELECT epoch_us(l_shipdate) // 86400000000 AS bucket, CAST(round(l_extendedprice * 100) AS BIGINT) AS size, l_returnflag AS protocol, l_suppkey, l_partkey FROM lineitem)
SELECT bucket, count(*) AS pps, sum(size)::BIGINT AS bytes, count(*) FILTER (protocol = 'A') AS count_a, count(*) FILTER (protocol = 'N') AS count_n, count(*) FILTER (protocol = 'R') AS count_r,
  count(DISTINCT l_partkey) AS unique_dst_ports, max(size) AS size_max, max(l_suppkey) AS server_port FROM p GROUP BY bucket""",
)
def w_lineitem_days(spark, sf):
    df = lineitems_as_packets(T.table(spark, sf, "lineitem"))
    return df.groupBy("bucket").agg(
        F.count("*").alias("pps"), F.sum("size").alias("bytes"), *[F.count_if(F.col("protocol") == p).alias(f"count_{p.lower()}") for p in "ANR"],
        F.count_distinct("dst_port").alias("unique_dst_ports"), F.max("size").alias("size_max"), F.max("server_port").alias("server_port"),
    )


@register("w_relative_time", "SELECT event_id, round(epoch_us(ts) / 1e6 - min(epoch_us(ts) / 1e6) OVER (), 6) AS time_rel FROM events")
def w_relative_time(spark, sf):
    df = T.table(spark, sf, "events").select("event_id", (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"))
    start = df.agg(F.min("t").alias("start"))
    return df.join(F.broadcast(start)).select("event_id", F.round(F.col("t") - F.col("start"), 6).alias("time_rel"))  # one row


@register("w_feature_matrix", f"WITH {S.KINEMATICS.strip()} SELECT capture_id, bucket, round(total_pps_log, 6) AS total_pps_log, bytes, size_max, unique_dst_ports, round(vel_syn_z, 6) AS vel_syn_z, round(click_ratio, 6) AS click_ratio, server_port FROM windows")
def w_feature_matrix(spark, sf):
    df = windows.window_features(T.packets(spark, sf), S.PROTOCOLS)
    return T.rounded(df, "capture_id", "bucket", "total_pps_log", "bytes", "size_max", "unique_dst_ports", "vel_syn_z", "click_ratio", "server_port")


# ---- scalar functions ----

_columns("s_direction", T.packets, S.PACKETS, "packets", ["event_id", "direction", "server_port", "req_payload", "res_payload"], [])
register("s_direction", f"WITH {S.PACKETS.strip()} SELECT event_id, direction, server_port, req_payload::BIGINT AS req_payload, res_payload::BIGINT AS res_payload FROM packets")(QUERIES["s_direction"])
_columns("s_flag_bits", T.packets, S.PACKETS, "packets", ["event_id", *[f"tcp_flags_{f}" for f in FLAG_BITS]], [])


@register(
    "s_entropy_documents",
    """WITH b AS (SELECT doc_id, hex(encode(text)) AS h FROM documents), x AS (SELECT doc_id, unnest([substr(h, CAST(2 * i + 1 AS INT), 2) for i in range(len(h) // 2)]) AS c, len(h) / 2 AS n FROM b),
p AS (SELECT doc_id, count(*) / max(n) AS p FROM x GROUP BY doc_id, c) SELECT doc_id, round(-sum(p * log2(p)), 6) AS entropy FROM p GROUP BY doc_id
UNION ALL SELECT doc_id, 0.0 FROM documents WHERE text IS NULL OR text = ''""",
)
def s_entropy_documents(spark, sf):
    return T.table(spark, sf, "documents").select("doc_id", F.round(byte_entropy("text"), 6).alias("entropy"))


_CASES = " ".join(f"WHEN {n} THEN '{p.upper()}'" for n, p in PROTOCOL_NAMES.items())


@register("s_protocol_lookup", f"SELECT event_id, CASE event_id % 150 {_CASES} ELSE 'PROTO_' || (event_id % 150) END AS protocol FROM events")
def s_protocol_lookup(spark, sf):
    return T.table(spark, sf, "events").select("event_id", protocol_name(F.col("event_id") % 150).alias("protocol"))


@register("s_normal_cdf", f"SELECT event_id, round({NORMAL_CDF_SQL.format(x='((value - 50) / 20)')}, 6) AS p FROM events")
def s_normal_cdf(spark, sf):
    return T.table(spark, sf, "events").select("event_id", F.round(normal_cdf((F.col("value") - 50) / 20), 6).alias("p"))


@register("s_time_shift", "SELECT event_id, epoch_us(ts + INTERVAL 3 HOUR) AS shifted FROM events")
def s_time_shift(spark, sf):
    return T.table(spark, sf, "events").select("event_id", F.unix_micros(F.col("ts").cast("timestamp") + F.expr("interval 3 hours")).alias("shifted"))


# ---- training statistics ----

_SCALED = scaling.scaled_names(S.FEATURES)


@register("t_robust_scaler_fit", f"WITH {S.KINEMATICS.strip()} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(quantile_cont({f}, 0.5), 6)::DOUBLE AS median, round(quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25), 6)::DOUBLE AS iqr FROM windows" for f in _SCALED))
def t_robust_scaler_fit(spark, sf):
    q = scaling.quantiles(T.kinematics(spark, sf), _SCALED)
    rows = [(n, round(v[1], 6), round(v[2] - v[0], 6)) for n, v in q.items()]
    return spark.createDataFrame(rows, "feature string, median double, iqr double")


_FIT = ", ".join(f"quantile_cont({f}, 0.5) AS m_{f}, CASE WHEN quantile_cont({f}, 0.75) = quantile_cont({f}, 0.25) THEN 1 ELSE quantile_cont({f}, 0.75) - quantile_cont({f}, 0.25) END AS q_{f}" for f in _SCALED)


@register("t_robust_scaled", f"WITH {S.KINEMATICS.strip()}, fit AS (SELECT {_FIT} FROM windows) SELECT capture_id, bucket, {', '.join(f'round(({f} - m_{f}) / q_{f}, 6) AS {f}' if f in _SCALED else f'round({f}, 6) AS {f}' for f in S.FEATURES)} FROM windows, fit")
def t_robust_scaled(spark, sf):
    df = T.kinematics(spark, sf).select(*KEYS, *[F.col(f).cast("double").alias(f) for f in S.FEATURES])
    return T.rounded(scaling.apply_scaler(df, scaling.fit_scaler(df, S.FEATURES)))


@register("t_standard_scaler_fit", f"WITH {S.KINEMATICS.strip()} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_pop({f}) = 0 THEN 1 ELSE stddev_pop({f}) END, 6) AS scale FROM windows" for f in _SCALED))
def t_standard_scaler_fit(spark, sf):
    fit = scaling.fit_scaler(T.kinematics(spark, sf), S.FEATURES, "standard")
    return spark.createDataFrame([(n, round(float(m), 6), round(float(s), 6)) for n, (m, s) in fit.items()], "feature string, mean double, scale double")


@register("t_baseline_stats", f"WITH {S.KINEMATICS.strip()} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(avg({f}), 6) AS mean, round(CASE WHEN stddev_samp({f}) = 0 THEN 1e-6 ELSE stddev_samp({f}) END, 6) AS std FROM windows" for f in S.FEATURES))
def t_baseline_stats(spark, sf):
    fit = scaling.baseline(T.kinematics(spark, sf), S.FEATURES)
    return spark.createDataFrame([(n, round(float(m), 6), round(float(s), 6)) for n, (m, s) in fit.items()], "feature string, mean double, std double")


@register("t_medians", f"WITH {S.KINEMATICS.strip()} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(quantile_cont({f}, 0.5), 6)::DOUBLE AS median FROM windows" for f in S.FEATURES))
def t_medians(spark, sf):
    return spark.createDataFrame([(n, round(float(m), 6)) for n, m in scaling.medians(T.kinematics(spark, sf), S.FEATURES).items()], "feature string, median double")


@register("t_clip_bounds", f"WITH {S.KINEMATICS.strip()} " + " UNION ALL ".join(f"SELECT '{f}' AS feature, round(CASE WHEN min({f}) >= 0 THEN 0 ELSE min({f}) END, 6)::DOUBLE AS low, round(quantile_cont({f}, 0.99), 6)::DOUBLE AS high FROM windows" for f in S.FEATURES))
def t_clip_bounds(spark, sf):
    return spark.createDataFrame([(n, round(float(a), 6), round(float(b), 6)) for n, (a, b) in projection.clip_bounds(T.kinematics(spark, sf), S.FEATURES).items()], "feature string, low double, high double")


_COV = ["total_pps_log", "total_bytes_log", "entropy_avg", "size_avg", "flag_syn_ratio"]


@register("t_covariance", f"WITH {S.KINEMATICS.strip()} " + " UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, round(covar_pop({a}, {b}), 6) AS cov FROM windows" for i, a in enumerate(_COV) for b in _COV[i:]))
def t_covariance(spark, sf):
    _, cov = projection.covariance(T.kinematics(spark, sf), _COV)
    rows = [(a, b, round(float(cov[i, j]), 6)) for i, a in enumerate(_COV) for j, b in enumerate(_COV) if j >= i]
    return spark.createDataFrame(rows, "a string, b string, cov double")


# ---- detectors ----

_columns("d_velocity_bypass", T.results, S.RESULTS, "results", [*KEYS, "vel_bypass", "vel_severity", "vel_culprit"], ["vel_score"])
_columns("d_zscore_family_consensus", T.results, S.RESULTS, "results", [*KEYS, "family_consensus"], ["balltree_score"])
_columns("d_severity_tiers", T.results, S.RESULTS, "results", [*KEYS, "balltree_severity", "gmm_anomaly", "iforest_anomaly", "soft_zone_triggered"], [])
_columns("d_attribution", T.results, S.RESULTS, "results", [*KEYS, "physical_culprit"], ["culprit_deviation"])

_KNN = """pairs AS (SELECT a.vec_id, b.vec_id AS other, list_distance(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS d FROM embeddings a, embeddings b),
ranked AS (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY d, other) AS rn FROM pairs), knn AS (SELECT vec_id, avg(d) AS distance FROM ranked WHERE rn BETWEEN 2 AND 6 GROUP BY vec_id)"""


def _embeddings(spark, sf):
    df = T.table(spark, sf, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("coords"))
    return df, detectors.fit_neighbours(df)


@register("d_knn_train_distances", f"WITH {_KNN} SELECT vec_id, round(distance, 6) AS distance FROM knn")
def d_knn_train_distances(spark, sf):
    df, model = _embeddings(spark, sf)
    return df.select("vec_id", F.round(detectors.neighbour_distance(model)("coords"), 6).alias("distance"))


@register(
    "d_knn_severity",
    f"""WITH {_KNN}, p AS (SELECT quantile_cont(distance, 0.90) AS a, quantile_cont(distance, 0.95) AS b, quantile_cont(distance, 0.99) AS c, quantile_cont(distance, 0.999) AS d FROM knn)
SELECT vec_id, round(distance / c, 6) AS score, (CASE WHEN distance > d * 1.02 THEN 3.0 WHEN distance > c * 1.02 THEN 2.0 WHEN distance > b * 1.02 THEN 1.0 WHEN distance > a * 1.02 THEN 0.5 ELSE 0.0 END)::DOUBLE AS severity FROM knn, p""",
)
def d_knn_severity(spark, sf):
    df, model = _embeddings(spark, sf)
    df = df.withColumn("d", detectors.neighbour_distance(model)("coords"))
    p = model.percentiles
    return df.select("vec_id", F.round(F.col("d") / model.p99, 6).alias("score"), detectors.neighbour_severity(F.col("d"), p[90.0], p[95.0], p[99.0], p[99.9], slack=1.02).alias("severity"))


_LL = "(ln(1.0) - 0.5 * ln(2 * pi() * s_{0} * s_{0}) - ({0} - a_{0}) * ({0} - a_{0}) / (2 * s_{0} * s_{0}))"
_UNI = ["total_pps_log", "total_bytes_log", "entropy_avg", "size_avg", "flag_syn_ratio"]


@register("d_gmm1d_score", f"WITH {S.STATS.strip()} SELECT capture_id, bucket, {', '.join(f'round({_LL.format(f)}, 5) AS ll_{f}' for f in _UNI)} FROM windows, stats")
def d_gmm1d_score(spark, sf):
    df = T.kinematics(spark, sf)
    base = scaling.baseline(df, _UNI)
    params = {f: {"weights": [1.0], "means": [m], "variances": [s * s]} for f, (m, s) in base.items()}
    return df.select(*KEYS, *[F.round(detectors.univariate_likelihood(F.col(f).cast("double"), p), 5).alias(f"ll_{f}") for f, p in params.items()])


@register(
    "d_sentinel",
    f"WITH {S.STATS.strip()}, ll AS (SELECT capture_id, bucket, {', '.join(f'{_LL.format(f)} AS ll_{f}' for f in _UNI)} FROM windows, stats), t AS (SELECT {', '.join(f'quantile_cont(ll_{f}, 0.01) AS t_{f}' for f in _UNI)} FROM ll), m AS (SELECT *, least({', '.join(f'll_{f}' for f in _UNI)}) AS lowest FROM ll, t), n AS (SELECT *, CASE {' '.join(f"WHEN ll_{f} = lowest THEN '{f}'" for f in _UNI)} END AS feature, CASE {' '.join(f'WHEN ll_{f} = lowest THEN t_{f}' for f in _UNI)} END AS bound FROM m) SELECT capture_id, bucket, CAST(lowest < bound AS INT) AS vote, CASE WHEN lowest < bound THEN feature END AS feature FROM n",
)
def d_sentinel(spark, sf):
    df = T.kinematics(spark, sf)
    params = {f: {"weights": [1.0], "means": [m], "variances": [s * s]} for f, (m, s) in scaling.baseline(df, _UNI).items()}
    thresholds = detectors.likelihood_thresholds(df, params, 1.0)
    vote, feature = detectors.sentinel_vote(params, thresholds, F.lit(1.0))
    return df.select(*KEYS, vote.alias("vote"), feature.alias("feature"))


_WEIGHTS = {"balltree": 0.2, "gmm": 0.25, "iforest": 0.25, "velocity": 0.3}
_BOUNDS = "bounds AS (SELECT min(balltree_score) AS b0, max(balltree_score) AS b1, min(iforest_score) AS i0, max(iforest_score) AS i1, avg(gmm_score) AS gm, stddev_pop(gmm_score) AS gs FROM results)"
_CONSENSUS = f"""{S.RESULTS.strip()}, {_BOUNDS}, agreed AS (SELECT *, 0.2 * (balltree_score - b0) / (b1 - b0) + 0.25 * least(greatest({NORMAL_CDF_SQL.format(x='((gmm_score - gm) / (gs + 1e-10))')}, 0.0), 1.0)
  + 0.25 * (iforest_score - i0) / (i1 - i0) + 0.3 * least(greatest(vel_score / 3, 0.0), 1.0) AS consensus, CAST(abs(culprit_deviation) > 4 AS INT) AS phys_vote, gmm_anomaly + iforest_anomaly AS consensus_votes FROM results, bounds)"""


def _agreed(spark, sf):
    df = T.results(spark, sf)
    mean, dev = df.agg(F.avg("gmm_score"), F.stddev_pop("gmm_score")).first()
    df = df.withColumn("consensus", decisions.weighted_consensus(_WEIGHTS, decisions.squash(F.col("gmm_score"), mean, dev)))
    return df.withColumn("phys_vote", (F.abs("culprit_deviation") > 4).cast("int")).withColumn("consensus_votes", F.col("gmm_anomaly") + F.col("iforest_anomaly"))


@register("d_weighted_consensus", f"WITH {_CONSENSUS} SELECT capture_id, bucket, round(consensus, 6) AS consensus FROM agreed")
def d_weighted_consensus(spark, sf):
    return T.rounded(_agreed(spark, sf), *KEYS, "consensus")


@register("d_consensus_stats", f"WITH {_CONSENSUS} SELECT round(avg(consensus), 6) AS mean, round(max(consensus), 6) AS max, round(min(consensus), 6) AS min, round(stddev_pop(consensus), 6) AS std FROM agreed")
def d_consensus_stats(spark, sf):
    c = "consensus"
    return _agreed(spark, sf).agg(F.round(F.avg(c), 6).alias("mean"), F.round(F.max(c), 6).alias("max"), F.round(F.min(c), 6).alias("min"), F.round(F.stddev_pop(c), 6).alias("std"))


_RULE = "vel_bypass OR balltree_severity = 3 OR (balltree_severity = 2 AND consensus >= 0.3) OR (balltree_severity = 1 AND consensus >= 0.3 AND family_consensus IS NOT NULL) OR (balltree_severity = 1 AND phys_vote = 1)"


@register("d_decision", f"WITH {_CONSENSUS} SELECT capture_id, bucket, CAST({_RULE} AS INT) AS decided, CASE WHEN vel_bypass THEN greatest(floor(balltree_severity), vel_severity) ELSE balltree_severity END::DOUBLE AS decided_severity, CASE WHEN balltree_severity = 1 AND consensus >= 0.3 THEN family_consensus END AS decided_family FROM agreed")
def d_decision(spark, sf):
    flag, severity, family = decisions.decide(0.3)
    return _agreed(spark, sf).select(*KEYS, flag.alias("decided"), severity.alias("decided_severity"), family.alias("decided_family"))


@register("d_decision_majority", f"WITH {_CONSENSUS} SELECT capture_id, bucket, CAST(vel_bypass OR balltree_severity = 3 OR (balltree_severity IN (1, 2) AND consensus_votes >= 2) OR (balltree_severity = 1 AND phys_vote = 1) AS INT) AS decided FROM agreed")
def d_decision_majority(spark, sf):
    return _agreed(spark, sf).select(*KEYS, decisions.decide(0.3, weighted=False)[0].alias("decided"))


@register("d_veto", f"WITH {_CONSENSUS} SELECT capture_id, bucket, abs(culprit_deviation) > 5 OR (balltree_severity = 3 AND consensus_votes >= 2) AS veto, balltree_severity >= 0.5 OR vel_bypass AS suspect FROM agreed")
def d_veto(spark, sf):
    df = _agreed(spark, sf)
    return df.select(*KEYS, decisions.veto(F.col("culprit_deviation"), F.col("balltree_severity"), F.col("consensus_votes"), 5.0).alias("veto"), decisions.suspect(F.col("balltree_severity"), F.col("vel_bypass")).alias("suspect"))


# ---- stabilisation ----

_FLAGS = f"{S.RESULTS.strip()}, flags AS (SELECT capture_id, bucket, balltree_score, vel_bypass, CAST(top > 0.55 AS INT) AS is_anomaly, CASE WHEN top > 0.55 THEN 1.0 ELSE 0.0 END::DOUBLE AS severity FROM (SELECT *, balltree_score AS top FROM results))"


def _flags(spark, sf):
    hot = F.col("balltree_score") > 0.55
    return T.results(spark, sf).select(*KEYS, "balltree_score", "vel_bypass", hot.cast("int").alias("is_anomaly"), F.when(hot, 1.0).otherwise(0.0).alias("severity"))


@register(
    "x_persistence_filter",
    f"""WITH {_FLAGS}, e AS (SELECT *, CASE WHEN count(*) OVER w = 3 THEN min(is_anomaly) OVER w ELSE 0 END AS eroded FROM flags WINDOW w AS (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
g AS (SELECT *, CASE WHEN vel_bypass THEN 1 ELSE max(eroded) OVER (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) END AS kept FROM e)
SELECT capture_id, bucket, kept::INT AS is_anomaly, CASE WHEN kept = 0 THEN 0.0 ELSE severity END::DOUBLE AS severity FROM g""",
)
def x_persistence_filter(spark, sf):
    return decisions.persist(_flags(spark, sf)).select(*KEYS, "is_anomaly", "severity")


_HYST = f"""WITH RECURSIVE {_FLAGS}, n AS (SELECT *, row_number() OVER (PARTITION BY capture_id ORDER BY bucket) AS i FROM flags),
m AS (SELECT capture_id, bucket, i, (is_anomaly = 1 AND balltree_score > 0.6) AS alert, 0 AS clear, CAST(is_anomaly = 1 AND balltree_score > 0.6 AS INT) AS stable FROM n WHERE i = 1
UNION ALL SELECT n.capture_id, n.bucket, n.i,
  CASE WHEN NOT m.alert THEN n.is_anomaly = 1 AND n.balltree_score > 0.6 WHEN n.balltree_score < 0.45 THEN NOT (m.clear + 1 >= greatest(1, least(3, CAST(floor(3 / (n.balltree_score / (0.6 + 1e-10) + 0.1)) AS INT)))) ELSE true END,
  CASE WHEN NOT m.alert THEN CASE WHEN n.is_anomaly = 1 AND n.balltree_score > 0.6 THEN 0 ELSE m.clear END WHEN n.balltree_score < 0.45 THEN CASE WHEN m.clear + 1 >= greatest(1, least(3, CAST(floor(3 / (n.balltree_score / (0.6 + 1e-10) + 0.1)) AS INT))) THEN 0 ELSE m.clear + 1 END ELSE 0 END,
  CASE WHEN NOT m.alert THEN CAST(n.is_anomaly = 1 AND n.balltree_score > 0.6 AS INT) WHEN n.balltree_score < 0.45 THEN CASE WHEN m.clear + 1 >= greatest(1, least(3, CAST(floor(3 / (n.balltree_score / (0.6 + 1e-10) + 0.1)) AS INT))) THEN 0 ELSE 1 END ELSE 1 END
  FROM n JOIN m ON n.capture_id = m.capture_id AND n.i = m.i + 1) SELECT capture_id, bucket, stable FROM m"""


@register("x_hysteresis", _HYST)
def x_hysteresis(spark, sf):
    return decisions.hysteresis(_flags(spark, sf), 0.6).select(*KEYS, "stable")


@register(
    "x_moving_average_label",
    f"WITH {S.RESULTS.strip()}, a AS (SELECT *, avg(balltree_score) OVER (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW) AS ma FROM results) SELECT capture_id, bucket, round(ma, 6) AS anomaly_ma_score, CASE WHEN balltree_score / (ma + 1e-10) > 1.5 THEN 'Transient Spike' ELSE 'Sustained Attack' END AS persistence FROM a WHERE is_anomaly = 1 OR balltree_severity >= 0.5",
)
def x_moving_average_label(spark, sf):
    df = T.results(spark, sf).withColumn("anomaly_ma_score", decisions.moving_average())
    df = df.withColumn("persistence", decisions.persistence_label(F.col("balltree_score"), F.col("anomaly_ma_score"), 1 / 1.5))
    return T.rounded(df.filter("is_anomaly = 1 or balltree_severity >= 0.5"), *KEYS, "anomaly_ma_score", "persistence")


@register("x_warmup", f"WITH {S.BASE.strip()} SELECT capture_id, bucket, row_number() OVER (PARTITION BY capture_id ORDER BY bucket) <= 15 AS is_warmup FROM base")
def x_warmup(spark, sf):
    return T.base(spark, sf).select(*KEYS, decisions.is_warmup().alias("is_warmup"))


# ---- incidents ----

INC = ["capture_id", "incident_id"]
_columns("f_incidents", T.found, S.FOUND, "found", [*INC, "n", "max_severity", "is_warmup"], ["mean_sigma", "max_sigma", "duration"])
_columns("f_confidence", T.found, S.FOUND, "found", [*INC], ["confidence"])
_columns("f_dynamic_severity", T.found, S.FOUND, "found", [*INC], ["severity_score"])


@register("f_tier_evidence", f"WITH {S.FOUND.strip()} " + " UNION ALL ".join(f"SELECT capture_id, incident_id, '{t}' AS tier, {t}_count > 0 AS fired, {t}_count AS fire_count, round({t}_mean, 6) AS mean_score FROM found" for t in incidents.TIERS))
def f_tier_evidence(spark, sf):
    return T.rounded(incidents.tier_evidence(T.found(spark, sf)), *INC, "tier", "fired", "fire_count", "mean_score")


_PARSED = f"""{S.INCIDENTS.strip()}, parsed0 AS (SELECT *, coalesce(nullif(lower(regexp_extract(regexp_replace(physical_culprit, '^\\s+', ''), '(?i)^([a-z_][a-z0-9_]*)', 1)), ''), 'unknown') AS feature,
  coalesce(nullif(upper(regexp_extract(physical_culprit, '(?i)\\b(SPIKE|DROP)\\b', 1)), ''), 'UNKNOWN') AS event_type, greatest(coalesce(TRY_CAST(regexp_extract(physical_culprit, '(?i)σ\\s*=\\s*([\\d.]+)', 1) AS DOUBLE), 0), abs(culprit_deviation)) AS sigma,
  coalesce(abs(TRY_CAST(regexp_extract(physical_culprit, '(?i)(?:SPIKE|DROP)\\s*\\(([+-]?[\\d.]+)%\\)', 1) AS DOUBLE)), 0) AS pct
  FROM clustered WHERE physical_culprit IS NOT NULL), parsed AS (SELECT *, {culprits.family_sql('feature', 'family_consensus')} AS family FROM parsed0)"""
_TOP = f"""{_PARSED}, feats AS (SELECT capture_id, incident_id, feature, max(sigma) AS max_sigma, max(pct) AS max_pct, arg_max(event_type, (sigma, -bucket)) AS event_type, arg_min(family, bucket) AS family, min(bucket) AS first_seen FROM parsed GROUP BY ALL),
ranked AS (SELECT *, max_sigma / max(max_sigma) OVER (PARTITION BY capture_id, incident_id) AS loading, row_number() OVER (PARTITION BY capture_id, incident_id ORDER BY max_sigma DESC, first_seen)::INT AS rank FROM feats), top AS (SELECT * FROM ranked WHERE rank <= 3)"""


@register("f_top3_features", f"WITH {_TOP} SELECT capture_id, incident_id, feature, event_type, family, rank, {_r('max_sigma', 'max_pct', 'loading')} FROM top")
def f_top3_features(spark, sf):
    return T.rounded(incidents.top_features(T.clustered(spark, sf)), *INC, "feature", "event_type", "family", "rank", "max_sigma", "max_pct", "loading")


@register("f_top3_ports", f"WITH {S.INCIDENTS.strip()}, c AS (SELECT capture_id, incident_id, server_port, count(*) AS times FROM clustered GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, incident_id ORDER BY times DESC, server_port)::INT AS rank FROM c) SELECT * FROM r WHERE rank <= 3")
def f_top3_ports(spark, sf):
    return incidents.top_ports(T.clustered(spark, sf))


@register("f_mode_culprit", f"WITH {S.INCIDENTS.strip()}, c AS (SELECT capture_id, incident_id, family_consensus, count(*) AS times FROM clustered WHERE family_consensus IS NOT NULL GROUP BY ALL), r AS (SELECT *, row_number() OVER (PARTITION BY capture_id, incident_id ORDER BY times DESC, family_consensus) AS rn FROM c) SELECT capture_id, incident_id, family_consensus, times FROM r WHERE rn = 1")
def f_mode_culprit(spark, sf):
    return incidents.most_frequent(T.clustered(spark, sf), "family_consensus")


@register("f_family_stress", f"WITH {_PARSED}, s AS (SELECT capture_id, incident_id, family, sum(abs(culprit_deviation)) AS stress FROM parsed GROUP BY ALL) SELECT capture_id, incident_id, family, round(stress, 6) AS stress, round(stress / sum(stress) OVER (PARTITION BY capture_id, incident_id), 6) AS share FROM s")
def f_family_stress(spark, sf):
    return T.rounded(incidents.family_stress(T.clustered(spark, sf)))


@register("f_family_distribution", f"WITH {_PARSED} SELECT family, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6)::DOUBLE AS share FROM parsed GROUP BY family")
def f_family_distribution(spark, sf):
    return T.rounded(incidents.family_distribution(T.clustered(spark, sf)))


@register("f_threat_distribution", f"WITH {_PARSED} SELECT feature, count(*) AS n FROM parsed GROUP BY feature")
def f_threat_distribution(spark, sf):
    return incidents.threat_distribution(T.clustered(spark, sf))


@register("f_pair_counts", f"WITH {_PARSED} SELECT feature, family, count(*) AS n FROM parsed GROUP BY feature, family ORDER BY n DESC, feature, family LIMIT 5")
def f_pair_counts(spark, sf):
    return incidents.pair_counts(T.clustered(spark, sf))


_DIM = "dim(rank, pattern, tactic, technique) AS (VALUES " + ", ".join(f"({i}, '{p}', '{t}', '{x}')" for i, (p, t, x) in enumerate(TECHNIQUES)) + ")"


@register("f_mitre", f"WITH {_PARSED}, {_DIM}, b AS (SELECT capture_id, incident_id, feature, min(bucket) AS first_seen FROM parsed GROUP BY ALL) SELECT capture_id, incident_id, technique, arg_min(tactic, (first_seen, rank)) AS tactic FROM b JOIN dim ON contains(feature, pattern) GROUP BY ALL")
def f_mitre(spark, sf):
    return incidents.techniques(T.clustered(spark, sf))


@register(
    "f_data_drops",
    f"""WITH {S.FOUND.strip()}, l AS (SELECT *, lag(ts) OVER w AS start_time, lag(is_anomaly) OVER w AS was, lag(severity) OVER w AS was_severity FROM results WINDOW w AS (PARTITION BY capture_id ORDER BY ts)),
g AS (SELECT *, epoch_us(ts) / 1e6 - epoch_us(start_time) / 1e6 AS gap_seconds, CASE WHEN was = 1 THEN was_severity::INT WHEN is_anomaly = 1 THEN severity::INT END AS severity_before, was = 1 OR is_anomaly = 1 AS ctx FROM l),
d AS (SELECT *, EXISTS (SELECT 1 FROM found f WHERE f.capture_id = g.capture_id AND f.max_severity >= 2 AND epoch_us(g.ts) / 1e6 - epoch_us(f.end_time) / 1e6 BETWEEN 0 AND {S.NEAR}) AS sat FROM g WHERE gap_seconds > {S.DROP})
SELECT capture_id, epoch_us(start_time) AS start_us, epoch_us(ts) AS end_us, round(gap_seconds, 6) AS gap_seconds, severity_before, ctx AS is_anomaly_context,
  CASE WHEN sat THEN '[POSSIBLE_SENSOR_SATURATION] Gap follows high-severity incident' WHEN ctx AND severity_before >= 2 THEN 'Sensor Blindness / Data Drop due to Saturation' ELSE 'Capture Loss / Network Silence' END AS reason FROM d""",
)
def f_data_drops(spark, sf):
    results = T.results(spark, sf)
    df = incidents.data_drops(results, T.found_of(results), S.DROP, S.NEAR)
    return df.select("capture_id", F.unix_micros("start_time").alias("start_us"), F.unix_micros("end_time").alias("end_us"), F.round("gap_seconds", 6).alias("gap_seconds"), "severity_before", "is_anomaly_context", "reason")


_REPORT = "n >= 1 AND duration >= 1 AND confidence >= 0.6 AND mean_sigma >= 2"


_AXES = "axes(axis, family) AS (VALUES " + ", ".join(f"({i}, '{f}')" for i, f in enumerate(incidents.RADAR)) + ")"


@register(
    "f_family_radar",
    f"""WITH {_PARSED}, {_AXES}, st AS (SELECT capture_id, incident_id, family, sum(abs(coalesce(culprit_deviation, 0))) AS s FROM parsed GROUP BY ALL),
sh AS (SELECT family, s / CASE WHEN sum(s) OVER w = 0 THEN 1 ELSE sum(s) OVER w END AS share FROM st WINDOW w AS (PARTITION BY capture_id, incident_id)), ag AS (SELECT family, sum(share) AS a FROM sh GROUP BY family),
ct AS (SELECT family, count(*) AS b FROM parsed GROUP BY family), t AS (SELECT (SELECT coalesce(sum(a), 0) FROM ag) AS ta, (SELECT coalesce(sum(b), 0) FROM ct) AS tb)
SELECT axis, family, round(coalesce(CASE WHEN ta > 0 THEN a / ta WHEN tb > 0 THEN b / tb END, 0), 6)::DOUBLE AS value FROM axes LEFT JOIN ag USING (family) LEFT JOIN ct USING (family), t""",
)
def f_family_radar(spark, sf):
    rows = staged(T.clustered(spark, sf), "clustered")
    return T.rounded(incidents.family_radar(incidents.family_stress(rows), rows), "axis", "family", "value")


@register("f_reportable", f"WITH {S.FOUND.strip()} SELECT capture_id, incident_id, n, round(confidence, 6) AS confidence FROM found WHERE {_REPORT}")
def f_reportable(spark, sf):
    return T.rounded(incidents.reportable(T.found(spark, sf), 0.6), *INC, "n", "confidence")


@register(
    "f_summary",
    f"""WITH {S.FOUND.strip()} SELECT (SELECT count(*) FROM results) AS windows, (SELECT count(*) FROM results WHERE is_anomaly = 1) AS anomalies, (SELECT count(*) FROM results WHERE severity >= 3) AS critical,
(SELECT count(*) FROM results WHERE soft_zone_triggered) AS soft_zone, (SELECT count(*) FROM anomalous) AS report_rows, (SELECT count(*) FROM found) AS incidents, (SELECT round(max(severity_score), 6) FROM found) AS max_severity_score,
(SELECT round(avg(confidence), 6) FROM found) AS mean_confidence, (SELECT count(*) FROM found WHERE {_REPORT}) AS reportable, (SELECT round(avg(is_anomaly), 6) FROM results) AS anomaly_rate""",
)
def f_summary(spark, sf):
    results = T.results(spark, sf)
    found = T.found_of(results)
    return T.rounded(incidents.summary(results, incidents.anomalies(results), found, incidents.reportable(found, 0.6)))


@register("f_severity_counts", f"WITH {S.RESULTS.strip()} SELECT severity, count(*) AS n, count(*) FILTER (physical_culprit LIKE '%SPIKE%') AS spikes, count(*) FILTER (physical_culprit LIKE '%DROP%') AS drops FROM results GROUP BY severity")
def f_severity_counts(spark, sf):
    text = F.upper("physical_culprit")
    return T.results(spark, sf).groupBy("severity").agg(F.count("*").alias("n"), F.count_if(text.contains("SPIKE")).alias("spikes"), F.count_if(text.contains("DROP")).alias("drops"))


@register("f_culprit_parse", f"WITH {_PARSED} SELECT capture_id, bucket, feature, event_type, round(sigma, 6) AS sigma, round(pct, 6) AS pct FROM parsed")
def f_culprit_parse(spark, sf):
    return T.rounded(incidents.parsed(T.clustered(spark, sf)), *KEYS, "feature", "event_type", "sigma", "pct")


@register("f_family_infer", f"WITH {_PARSED} SELECT capture_id, bucket, family, {culprits.family_sql('feature', 'NULL')} AS guessed FROM parsed")
def f_family_infer(spark, sf):
    return incidents.parsed(T.clustered(spark, sf)).select(*KEYS, "family", culprits.family(F.col("feature"), F.lit(None).cast("string")).alias("guessed"))


# ---- evaluation ----

_WINDOWS = [("A", "2024-01-03 00:00:00", "2024-01-05 12:00:00"), ("B", "2024-01-09 06:00:00", "2024-01-09 18:00:00"), ("C", "2024-01-15 00:00:00", "2024-01-18 00:00:00"), ("D", "2024-01-25 01:00:00", "2024-01-25 02:00:00")]
_GT = "raw_truth(label, a, b) AS (VALUES " + ", ".join(f"('{x}', TIMESTAMP '{a}', TIMESTAMP '{b}')" for x, a, b in _WINDOWS) + "), truth AS (SELECT label, a + INTERVAL 3 HOUR AS win_start, b + INTERVAL 3 HOUR AS win_end FROM raw_truth)"
_FAMS = ["connection", "flags", "payload", "protocol", "kinematics", "volume", "recon", "volume_flood"]


def _truth(spark):
    df = spark.createDataFrame(_WINDOWS, "label string, win_start string, win_end string")
    return evaluation.shifted(df.select("label", F.to_timestamp("win_start").alias("win_start"), F.to_timestamp("win_end").alias("win_end")), 3)


_HIT = f"{S.FOUND.strip()}, {_GT}, hit AS (SELECT f.capture_id, f.incident_id, label FROM found f JOIN truth t ON NOT (f.end_time < t.win_start OR f.start_time > t.win_end))"


@register("e_overlaps", f"WITH {_HIT} SELECT * FROM hit")
def e_overlaps(spark, sf):
    return evaluation.overlaps(T.found(spark, sf), _truth(spark)).select(*INC, "label")


@register("e_overlaps_tolerance", f"WITH {S.FOUND.strip()}, {_GT} SELECT f.capture_id, f.incident_id, label FROM found f JOIN truth t ON f.end_time >= t.win_start - INTERVAL 5 MINUTE AND f.start_time <= t.win_end + INTERVAL 5 MINUTE")
def e_overlaps_tolerance(spark, sf):
    return evaluation.overlaps(T.found(spark, sf), _truth(spark), 300.0).select(*INC, "label")


_FAM_VALUES = ", ".join(f"('{f}')" for f in _FAMS)
_TOP_HIT = f"{_TOP}, {S.FOUND.strip()[len(S.INCIDENTS.strip()) + 1:].strip()}, {_GT}, hit AS (SELECT f.capture_id, f.incident_id, label FROM found f JOIN truth t ON NOT (f.end_time < t.win_start OR f.start_time > t.win_end))"


@register("e_attack_overlap_atlas", f"WITH {_TOP_HIT}, fams(family) AS (VALUES {_FAM_VALUES}), cells AS (SELECT family, label, max(max_sigma) AS s FROM top JOIN hit USING (capture_id, incident_id) GROUP BY ALL) SELECT family, " + ", ".join(f"round(greatest(coalesce(max(s) FILTER (label = '{x}'), 0.1), 0.1), 6) AS {x}" for x, *_ in _WINDOWS) + " FROM fams LEFT JOIN cells USING (family) GROUP BY family")
def e_attack_overlap_atlas(spark, sf):
    rows = T.clustered(spark, sf)
    return T.rounded(evaluation.atlas(incidents.top_features(rows), incidents.incidents(rows), _truth(spark), _FAMS, [x for x, *_ in _WINDOWS]))


@register("e_recall", f"WITH {_HIT} SELECT round((SELECT count(DISTINCT label) FROM hit) / (SELECT count(*) FROM truth), 6)::DOUBLE AS recall, round((SELECT count(DISTINCT incident_id) FROM hit) / (SELECT count(*) FROM found), 6)::DOUBLE AS precision")
def e_recall(spark, sf):
    return T.rounded(evaluation.coverage(T.found(spark, sf), _truth(spark)))


@register("e_nearest_window", f"WITH {S.FOUND.strip()} SELECT f.capture_id, f.incident_id, round(max(r.balltree_score), 6) AS peak FROM found f JOIN results r ON r.capture_id = f.capture_id AND r.ts BETWEEN f.start_time AND f.end_time GROUP BY ALL")
def e_nearest_window(spark, sf):
    results = T.results(spark, sf)
    return T.rounded(evaluation.peaks(T.found_of(results), results, "balltree_score"))


# ---- health ----

_HIST = "sp AS (SELECT min(timestamp) AS low, max(timestamp) AS high FROM packets), bins AS (SELECT greatest(ceil((timestamp - low) / (high - low) * (floor((high - low) / 3600) + 1)) - 1, 0)::BIGINT AS bin, (floor((high - low) / 3600) + 1)::BIGINT AS bins, count(*) AS n FROM packets, sp GROUP BY ALL)"


@register("h_histogram", f"WITH {S.PACKETS.strip()}, {_HIST} SELECT 'events' AS capture_id, bin, bins, n FROM bins")
def h_histogram(spark, sf):
    return health.histogram(T.packets(spark, sf), 3600.0)


_GAP = "gp AS (SELECT max(g) AS g FROM (SELECT timestamp - lag(timestamp) OVER (ORDER BY timestamp) AS g FROM packets))"


@register("h_gap_max", f"WITH {S.PACKETS.strip()}, {_GAP} SELECT 'events' AS capture_id, round(g, 5) AS max_timestamp_gap_sec FROM gp")
def h_gap_max(spark, sf):
    return health.largest_gap(T.packets(spark, sf)).select("capture_id", F.round("max_timestamp_gap_sec", 5).alias("max_timestamp_gap_sec"))


@register(
    "h_capture_health",
    f"""WITH {S.PACKETS.strip()}, {_HIST}, {_GAP} SELECT 'events' AS capture_id, count(*) AS packet_count, round(max(timestamp) - min(timestamp), 5) AS time_span_sec, round(avg(entropy), 5) AS entropy_avg, round(stddev_pop(entropy), 5) AS entropy_std,
round(skewness(entropy), 5) AS entropy_skewness, round(kurtosis(entropy), 5) AS entropy_kurtosis, count(*) FILTER (entropy < 0 OR entropy > 8) AS entropy_violations, (SELECT round(avg(n), 5) FROM bins) AS pps_avg,
(SELECT round((max(bins) - count(*)) / max(bins) * 100, 5) FROM bins) AS silent_windows_pct, (SELECT round(skewness(n), 5) FROM bins) AS pps_skewness, (SELECT round(kurtosis(n), 5) FROM bins) AS pps_kurtosis, (SELECT round(g, 5) FROM gp) AS max_timestamp_gap_sec FROM packets""",
)
def h_capture_health(spark, sf):
    df = health.capture_health(T.packets(spark, sf), 3600.0)
    return df.select(*[F.round(c, 5).alias(c) if t == "double" else c for c, t in df.dtypes])


# ---- unions, alignment, models ----


@register("u_schema_align", f"WITH {S.KINEMATICS.strip()} SELECT capture_id, bucket, round(total_pps_log, 6) AS total_pps_log, 7.5::DOUBLE AS icmp_ratio, 0.0::DOUBLE AS tcp_ratio, round(vel_syn_z, 6) AS vel_syn_z FROM windows")
def u_schema_align(spark, sf):
    return T.rounded(scaling.align_schema(T.kinematics(spark, sf), ["total_pps_log", "icmp_ratio", "tcp_ratio", "vel_syn_z"], {"icmp_ratio": 7.5}, KEYS))


@register("u_union_augment")
def u_union_augment(spark, sf):
    df = T.kinematics(spark, sf).select(*KEYS, *[F.col(f).cast("double").alias(f) for f in _COV])
    return scaling.augment(df, _COV)


@register("u_forward_fill", "SELECT event_id, last_value(CASE WHEN event_id % 3 = 0 THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS filled FROM events")
def u_forward_fill(spark, sf):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, 0)
    return T.table(spark, sf, "events").select("event_id", F.last(F.when(F.col("event_id") % 3 == 0, F.col("value")), ignorenulls=True).over(w).alias("filled"))


def _doubles(spark, sf):
    df = T.kinematics(spark, sf)
    return df.select(*KEYS, *[F.col(f).cast("double").alias(f) for f in S.FEATURES])


@register("m_pca_blocked")
def m_pca_blocked(spark, sf):
    df = _doubles(spark, sf)
    return projection.project(df, projection.fit_blocks(df)).select(*KEYS, "coords")


@register("m_pca_global")
def m_pca_global(spark, sf):
    df = _doubles(spark, sf)
    return projection.project(df, projection.fit_global(df, S.FEATURES, 0.99)).select(*KEYS, "coords")


def _points(spark, sf):
    return _doubles(spark, sf).select(*KEYS, F.array(*_COV).alias("coords"))


@register("m_gmm_em")
def m_gmm_em(spark, sf):
    df = _points(spark, sf)
    model = detectors.fit_mixture(df, 3)
    return df.select(*KEYS, detectors.log_likelihood(model)("coords").alias("ll"))


@register("m_iforest")
def m_iforest(spark, sf):
    df = _points(spark, sf)
    model = detectors.fit_forest(df)
    return df.select(*KEYS, detectors.forest_score(model)("coords").alias("score")).withColumn("anomaly", F.col("score") > model.threshold)


@register("m_kselect")
def m_kselect(spark, sf):
    _, rows = detectors.choose_components(_points(spark, sf))
    return spark.createDataFrame([(r["k"], r["bic"], r["aic"], r["silhouette"], r["davies_bouldin"], r["cost"]) for r in rows], "k int, bic double, aic double, silhouette double, davies_bouldin double, cost double")


@register("m_univariate")
def m_univariate(spark, sf):
    params = detectors.fit_univariate(_doubles(spark, sf), _COV)
    return spark.createDataFrame([(n, p["weights"], p["means"], p["variances"]) for n, p in params.items()], "feature string, weights array<double>, means array<double>, variances array<double>")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events to hourly windows, kinematics, velocity bypass and alerts."""
    return QUERIES["d_velocity_bypass"](spark, sf_dir)
