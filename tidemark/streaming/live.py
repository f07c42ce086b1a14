"""The same operators over streams of packets.

Windows are event-time windows with a watermark; rows later than that are dropped. What needs rows in order (differences,
rolling frames, the alert state machine) runs in a stateful function for each capture, with the state of the last rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from tidemark.operators.decisions import hysteresis_step

HISTORY = 60


def stream_windows(packets: DataFrame, seconds: int, late: str = "10 minutes") -> DataFrame:
    """Counts and sums of each capture and window, once the watermark has passed it; packets need ts (a timestamp)."""
    windowed = packets.withWatermark("ts", late).groupBy("capture_id", F.window("ts", f"{seconds} seconds").alias("w"))
    df = windowed.agg(F.count("*").alias("pps"), F.sum("size").alias("bytes"), F.avg("size").alias("size_avg"), F.max("size").alias("size_max"), F.sum("tcp_flags_syn").alias("syn"))
    return df.select("capture_id", F.floor(F.unix_micros("w.start") / F.lit(seconds * 1_000_000)).cast("long").alias("bucket"), "pps", "bytes", "size_avg", "size_max", (F.col("syn") / F.col("pps")).alias("flag_syn_ratio"))


OUT = "capture_id string, bucket long, vel_pps_z double, vel_bytes_z double, vel_syn_z double, vel_bypass boolean, stable int"
STATE = "pps array<double>, bytes array<double>, syn array<double>, alert boolean, clear int"


def rolling_z(history: list[float]) -> float:
    if len(history) < HISTORY:
        return 0.0
    x = np.array(history[-HISTORY:])
    return float((x[-1] - x.mean()) / (x.std(ddof=1) + 1e-6))


def _advance(threshold: float, score_limit: float):
    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = state.get if state.exists else ([], [], [], False, 0)
        pps, size, syn, alert, clear = (list(x) if not isinstance(x, (bool, int)) else x for x in held)
        rows = []
        for r in pd.concat(list(frames)).sort_values("bucket").itertuples():
            for series, value in ((pps, np.log1p(r.pps)), (size, np.log1p(r.bytes)), (syn, r.flag_syn_ratio)):
                series.append(float(value))
                del series[:-HISTORY]
            z = [rolling_z(s) for s in (pps, size, syn)]
            score = max(map(abs, z)) / threshold
            flag, (alert, clear) = hysteresis_step((alert, clear), int(score > score_limit), score, score_limit, 3, 1.0, 0.75)
            rows.append((key[0], int(r.bucket), *z, score >= 1, flag))
        state.update((pps, size, syn, bool(alert), int(clear)))
        yield pd.DataFrame(rows, columns=["capture_id", "bucket", "vel_pps_z", "vel_bytes_z", "vel_syn_z", "vel_bypass", "stable"])

    return run


def stream_alerts(windows: DataFrame, threshold: float = 5.0, score_limit: float = 0.6) -> DataFrame:
    """Rates of change, bypass and stabilised alerts for windows in order, with state across micro-batches."""
    return windows.groupBy("capture_id").applyInPandasWithState(_advance(threshold, score_limit), OUT, STATE, "append", GroupStateTimeout.NoTimeout)


def stream_sessions(alerts: DataFrame, gap: str = "30 seconds", late: str = "10 minutes") -> DataFrame:
    """Incidents as sessions of anomalous rows; alerts need ts, is_anomaly and severity."""
    odd = alerts.filter("is_anomaly = 1").withWatermark("ts", late)
    return odd.groupBy("capture_id", F.session_window("ts", gap).alias("s")).agg(F.count("*").alias("n"), F.max("severity").alias("max_severity")).select("capture_id", F.col("s.start").alias("start_time"), F.col("s.end").alias("end_time"), "n", "max_severity")


def without_copies(packets: DataFrame, keys: list[str], late: str = "10 minutes") -> DataFrame:
    """Packets without repeats of the keys within the watermark."""
    return packets.withWatermark("ts", late).dropDuplicatesWithinWatermark(keys)
