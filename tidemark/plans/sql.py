"""Common table expressions for the oracle queries: the same tables as the plans build, in SQL."""

from __future__ import annotations

from tidemark.dimensions import CONSENSUS_FAMILIES, FLAG_BITS, SERVICE_PORTS, VELOCITY_FEATURES
from tidemark.functions.statistics import NORMAL_CDF_SQL

PROTOCOLS = ["CLICK", "ERROR", "PURCHASE", "SIGNUP", "VIEW"]
PORTS = ", ".join(map(str, SERVICE_PORTS))

PACKETS = f"""
raw_packets AS (SELECT 'events' AS capture_id, event_id, epoch_us(ts) / 1e6 AS timestamp, epoch_us(ts) // 3600000000 AS bucket, CAST(floor(value * 100) AS BIGINT) AS size,
  upper(event_type) AS protocol, event_id % 65536 AS src_port, user_id AS dst_port, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, length(props) AS payload_bytes, props AS payload FROM events),
routed AS (SELECT *, CASE WHEN src_port < 0 AND dst_port < 0 THEN 'unknown' WHEN src_port IN ({PORTS}) THEN 'inbound' WHEN dst_port IN ({PORTS}) THEN 'outbound'
    WHEN src_port < 1024 OR dst_port >= 1024 THEN 'outbound' ELSE 'unknown' END AS direction,
  CASE WHEN src_port < 0 AND dst_port < 0 THEN -1 WHEN src_port IN ({PORTS}) THEN src_port WHEN dst_port IN ({PORTS}) THEN dst_port
    WHEN src_port < 1024 OR dst_port >= 1024 THEN greatest(dst_port, -1) ELSE -1 END AS server_port,
  {", ".join(f"CASE WHEN (k & {bit}) <> 0 THEN 1 ELSE 0 END AS tcp_flags_{f}" for f, bit in FLAG_BITS.items())} FROM raw_packets),
letters AS (SELECT event_id, unnest(string_split(payload, '')) AS c, payload_bytes FROM routed),
shares AS (SELECT event_id, count(*) * 1.0 / max(payload_bytes) AS p FROM letters GROUP BY event_id, c),
entropies AS (SELECT event_id, -sum(p * log2(p)) AS entropy FROM shares GROUP BY event_id),
packets AS (SELECT r.*, coalesce(e.entropy, 0.0) AS entropy, CASE WHEN direction = 'outbound' THEN payload_bytes ELSE 0 END AS req_payload,
  CASE WHEN direction = 'inbound' THEN payload_bytes ELSE 0 END AS res_payload FROM routed r LEFT JOIN entropies e USING (event_id))"""

BASE = f"""{PACKETS},
base AS (SELECT capture_id, bucket, count(*) AS pps, sum(size)::BIGINT AS bytes, {", ".join(f"count(*) FILTER (protocol = '{p}') AS count_{p.lower()}" for p in PROTOCOLS)},
  {", ".join(f"sum(tcp_flags_{f})::BIGINT AS count_flag_{f}" for f in FLAG_BITS)}, count(DISTINCT coalesce(dst_port, -1)) AS unique_dst_ports, avg(size) AS size_avg, avg(entropy) AS entropy_avg,
  max(size) AS size_max, max(timestamp) AS ts_max, min(timestamp) AS ts_min, sum(payload_bytes)::BIGINT AS total_payload, sum(req_payload)::BIGINT AS total_req, sum(res_payload)::BIGINT AS total_res,
  min(timestamp) AS _abs_timestamp, max(server_port) AS server_port FROM packets GROUP BY capture_id, bucket)"""

PHYSICS = f"""{BASE},
physics AS (SELECT *, ln(1 + pps) AS total_pps_log, ln(1 + bytes) AS total_bytes_log, {", ".join(f"count_{p.lower()} / pps AS {p.lower()}_ratio" for p in PROTOCOLS)},
  {", ".join(f"count_flag_{f} / pps AS flag_{f}_ratio" for f in FLAG_BITS)}, unique_dst_ports / pps AS port_scan_ratio, size_max / size_avg AS burst_factor,
  greatest(ts_max - ts_min, 1e-6) AS flow_duration, total_payload / pps AS payload_continuity, total_res / (total_req + 1e-6) AS payload_continuity_ratio,
  greatest(ts_max - ts_min, 1e-6) / (greatest(pps, 2) - 1) AS iat_mean FROM base)"""

_Z = ", ".join(
    f"CASE WHEN count({x}) OVER w60 = 60 THEN ({x} - avg({x}) OVER w60) / (stddev_samp({x}) OVER w60 + 1e-6) ELSE 0 END AS {z}"
    for z, x in zip(VELOCITY_FEATURES, ("total_pps_log", "total_bytes_log", "flag_syn_ratio"), strict=True)
)
_SIGNALS = {"pps": "total_pps_log", "bytes": "total_bytes_log", "entropy": "entropy_avg"}
KINEMATICS = f"""{PHYSICS},
speed AS (SELECT *, {", ".join(f"coalesce({x} - lag({x}) OVER w, 0) AS {s}_velocity" for s, x in _SIGNALS.items())},
  {", ".join(f"CASE WHEN count({x}) OVER w5 = 5 THEN stddev_samp({x}) OVER w5 ELSE 0 END AS {s}_volatility" for s, x in _SIGNALS.items())},
  CASE WHEN count(total_pps_log) OVER w10 = 10 THEN CAST(total_pps_log > 1.5 * avg(total_pps_log) OVER w10 AS INT) END AS burst_flag, {_Z} FROM physics
  WINDOW w AS (PARTITION BY capture_id ORDER BY bucket), w5 AS (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW),
    w10 AS (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 9 PRECEDING AND CURRENT ROW), w60 AS (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 59 PRECEDING AND CURRENT ROW)),
windows AS (SELECT *, {", ".join(f"coalesce({s}_velocity - lag({s}_velocity) OVER w, 0) AS {s}_acceleration" for s in _SIGNALS)},
  CASE WHEN count(burst_flag) OVER w5 = 5 THEN sum(burst_flag) OVER w5 ELSE 0 END::DOUBLE AS pps_momentum FROM speed
  WINDOW w AS (PARTITION BY capture_id ORDER BY bucket), w5 AS (PARTITION BY capture_id ORDER BY bucket ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))"""

#: Features that the results of the test tables are made from.
FEATURES = [
    "total_pps_log", "total_bytes_log", "entropy_avg", "size_avg", "size_max", "burst_factor", "unique_dst_ports", "port_scan_ratio", "flag_syn_ratio", "flag_rst_ratio", "flag_fin_ratio", "flag_psh_ratio",
    "flag_urg_ratio", "flow_duration", "iat_mean", "pps_velocity", "bytes_velocity", "pps_volatility", "bytes_volatility", "vel_pps_z", "vel_bytes_z", "vel_syn_z",
]

STATS = f"""{KINEMATICS},
stats AS (SELECT {", ".join(f"avg({f}) AS a_{f}, CASE WHEN stddev_samp({f}) = 0 THEN 1e-6 ELSE stddev_samp({f}) END AS s_{f}" for f in FEATURES)} FROM windows)"""


def _first(names: list[str], value: str, best: str) -> str:
    return "CASE " + " ".join(f"WHEN {value.format(n)} = {best} THEN '{n}'" for n in names) + " END"


def _family() -> str:
    cases = []
    for family, patterns in CONSENSUS_FAMILIES.items():
        hits = []
        for p in patterns:
            own = [f for f in FEATURES if p in f]
            if own:
                hits.append(f"CAST(greatest({', '.join(f'abs(({f} - a_{f}) / s_{f})' for f in own)}, 0.0) >= 2.0 AS INT)")
        if hits:
            cases.append(f"WHEN {' + '.join(hits)} >= 2 THEN '{family}'")
    return f"CASE {' '.join(cases)} END"


#: The results: scores from z-scores of the features, severities by percentiles, as SURVEY's section on test tables has it.
RESULTS = f"""{STATS},
zs AS (SELECT w.*, {", ".join(f"a_{f}, s_{f}" for f in FEATURES)}, {", ".join(f"abs({f} - a_{f}) / (s_{f} + 1e-10) AS z_{f}" for f in FEATURES)} FROM windows w, stats),
tops AS (SELECT *, greatest({", ".join(f"z_{f}" for f in FEATURES)}) AS top_z, ({" + ".join(f"z_{f}" for f in FEATURES)}) / {len(FEATURES)} AS mean_z,
  {" + ".join(f"z_{f} * z_{f}" for f in FEATURES)} AS sum_z2, greatest(abs(vel_pps_z), abs(vel_bytes_z), abs(vel_syn_z)) AS top_vel, {_family()} AS family_consensus FROM zs),
named AS (SELECT *, {_first(FEATURES, "z_{}", "top_z")} AS culprit_feature, {_first(list(VELOCITY_FEATURES), "abs({})", "top_vel")} AS vel_name FROM tops),
valued AS (SELECT *, CASE culprit_feature {" ".join(f"WHEN '{f}' THEN {f}" for f in FEATURES)} END::DOUBLE AS culprit_value, CASE culprit_feature {" ".join(f"WHEN '{f}' THEN a_{f}" for f in FEATURES)} END::DOUBLE AS culprit_mean,
  CASE vel_name {" ".join(f"WHEN '{f}' THEN {f}" for f in VELOCITY_FEATURES)} END::DOUBLE AS vel_signed FROM named),
limits AS (SELECT quantile_cont(top_z, 0.90) AS p90, quantile_cont(top_z, 0.95) AS p95, quantile_cont(top_z, 0.99) AS p99, quantile_cont(top_z, 0.999) AS p999, quantile_cont(sum_z2, 0.95) AS g95, quantile_cont(mean_z, 0.95) AS i95 FROM valued),
results AS (SELECT capture_id, bucket, _abs_timestamp, server_port, top_z / p99 AS balltree_score, CASE WHEN top_z > p999 THEN 3.0 WHEN top_z > p99 THEN 2.0 WHEN top_z > p95 THEN 1.0 WHEN top_z > p90 THEN 0.5 ELSE 0.0 END::DOUBLE AS balltree_severity,
  sum_z2 AS gmm_score, CAST(sum_z2 > g95 AS INT) AS gmm_anomaly, mean_z AS iforest_score, CAST(mean_z > i95 AS INT) AS iforest_anomaly,
  least(greatest(top_vel / 3.0, 0.0), 3.0) AS vel_score, top_vel >= 3.0 AS vel_bypass, CASE WHEN top_vel >= 3.0 THEN printf('%s(z=%+.2f)', vel_name, vel_signed) ELSE '' END AS vel_culprit,
  CASE WHEN top_vel >= 12 THEN 3 WHEN top_vel >= 8 THEN 2 WHEN top_vel >= 3.0 THEN 1 ELSE 0 END AS vel_severity, family_consensus,
  CASE WHEN top_z > p90 OR top_vel >= 3.0 THEN CASE WHEN culprit_value > culprit_mean
     THEN printf('%s (SPIKE (+%.1f%%), σ=%.2f)', culprit_feature, abs(culprit_value - culprit_mean) / (abs(culprit_mean) + 1e-10) * 100, top_z)
     ELSE printf('%s (DROP (%.1f%%), σ=%.2f)', culprit_feature, abs(culprit_value - culprit_mean) / (abs(culprit_mean) + 1e-10) * 100, top_z) END END AS physical_culprit,
  CASE WHEN top_z > p90 OR top_vel >= 3.0 THEN CASE WHEN culprit_value > culprit_mean THEN top_z ELSE -top_z END ELSE 0.0 END AS culprit_deviation,
  row_number() OVER (PARTITION BY capture_id ORDER BY bucket) <= 15 AS is_warmup, top_z > p90 AND top_z <= p95 AS soft_zone_triggered,
  CAST(top_z > p95 OR top_vel >= 3.0 AS INT) AS is_anomaly, CASE WHEN top_z > p999 THEN 3.0 WHEN top_z > p99 THEN 2.0 WHEN top_z > p95 OR top_vel >= 3.0 THEN 1.0 ELSE 0.0 END::DOUBLE AS severity,
  make_timestamp(CAST(_abs_timestamp * 1000000 AS BIGINT)) AS ts FROM valued, limits)"""

DEBOUNCE, DROP, NEAR = 7200.0, 3600.0, 7200.0
INCIDENTS = f"""{RESULTS},
anomalous AS (SELECT * FROM results WHERE is_anomaly = 1 OR (soft_zone_triggered AND balltree_severity >= 0.5)),
gaps AS (SELECT *, coalesce(CAST(epoch_us(ts) / 1e6 - epoch_us(lag(ts) OVER (PARTITION BY capture_id ORDER BY ts)) / 1e6 > {DEBOUNCE} AS INT), 0) AS starts FROM anomalous),
clustered AS (SELECT *, sum(starts) OVER (PARTITION BY capture_id ORDER BY ts)::BIGINT AS incident_id FROM gaps)"""

_TIERS = [
    ("BallTree", "balltree_severity > 0", "balltree_score"), ("GMM", "gmm_anomaly = 1", "gmm_score"), ("IForest", "iforest_anomaly = 1", "iforest_score"),
    ("PhysicalSentinel", "physical_culprit IS NOT NULL", "abs(culprit_deviation)"), ("VelocityBypass", "vel_bypass", "vel_score"),
]
_AGGS = ", ".join(f"count(*) FILTER ({fired}) AS {t}_count, avg({score}) AS {t}_mean" for t, fired, score in _TIERS)
FOUND = f"""{INCIDENTS},
rolled AS (SELECT capture_id, incident_id, min(ts) AS start_time, max(ts) AS end_time, count(*) AS n, max(severity) AS max_severity, coalesce(avg(abs(culprit_deviation)), 0) AS mean_sigma,
  coalesce(max(abs(culprit_deviation)), 0) AS max_sigma, avg(CAST(is_warmup AS DOUBLE)) > 0.5 AS is_warmup, {_AGGS} FROM clustered GROUP BY capture_id, incident_id),
timed AS (SELECT *, epoch_us(end_time) / 1e6 - epoch_us(start_time) / 1e6 AS duration,
  CASE WHEN BallTree_count > 0 THEN 0.20 ELSE 0.0 END + CASE WHEN GMM_count > 0 THEN 0.25 ELSE 0.0 END + CASE WHEN IForest_count > 0 THEN 0.20 ELSE 0.0 END + CASE WHEN PhysicalSentinel_count > 0 THEN 0.20 ELSE 0.0 END
  + CASE WHEN VelocityBypass_count > 0 THEN 0.15 ELSE 0.0 END AS fired FROM rolled),
found AS (SELECT *, least(1.0, (0.45 * NORMAL(mean_sigma) + 0.35 * least(1.0, log2(1 + n) / log2(513.0)) + 0.20 * fired::DOUBLE) * CASE WHEN is_warmup THEN 0.5 ELSE 1.0 END) AS confidence,
  (CASE WHEN max_sigma <= 5 THEN max_sigma / 5 ELSE 1 + pow(greatest(max_sigma - 5, 0), 1.8) / 10 END) * (1 + ln(1 + n) / ln(101.0)) AS severity_score FROM timed)""".replace("NORMAL(mean_sigma)", NORMAL_CDF_SQL.format(x="mean_sigma"))
