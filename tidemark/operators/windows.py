"""Packets to one row a time bucket, and features over the run of buckets.

Frames count rows (non-empty buckets) of a capture; an incomplete frame gives 0, as does a first difference.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dimensions import FEATURE_NAMES, FEATURE_PARTS, FLAG_BITS, METADATA

KEYS = ("capture_id", "bucket")


def protocols_of(packets: DataFrame) -> list[str]:
    """The protocols that occur, in order: the list that names the count columns."""
    return sorted(r[0] for r in packets.select("protocol").distinct().collect() if r[0] is not None)


def _column(name: str) -> str:
    return name.lower().replace("-", "_")


def base_aggregates(packets: DataFrame, protocols: list[str], flags: tuple[str, ...] = tuple(FLAG_BITS)) -> DataFrame:
    """Counts, sums, extremes and means of each bucket, in one aggregation with a partial step on the map side."""
    counts = [F.count_if(F.col("protocol") == p).alias(f"count_{_column(p)}") for p in protocols]
    counts += [F.count_if(F.col(f"tcp_flags_{f}") == 1).alias(f"count_flag_{f}") for f in flags]
    return packets.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("pps"), F.sum("size").alias("bytes"), *counts, F.count_distinct(F.coalesce("dst_port", F.lit(-1))).alias("unique_dst_ports"),
        F.avg("size").alias("size_avg"), F.avg("entropy").alias("entropy_avg"), F.max("size").alias("size_max"), F.max("timestamp").alias("ts_max"), F.min("timestamp").alias("ts_min"),
        F.sum("payload_bytes").alias("total_payload"), F.sum("req_payload").alias("total_req"), F.sum("res_payload").alias("total_res"), F.min("timestamp").alias("_abs_timestamp"),
        F.max("server_port").alias("server_port"),
    )


def physics(windows: DataFrame, protocols: list[str], flags: tuple[str, ...] = tuple(FLAG_BITS)) -> DataFrame:
    """Logarithms, ratios, durations and continuities of each bucket."""
    c, n = F.col, F.col("pps")
    duration = F.greatest(c("ts_max") - c("ts_min"), F.lit(1e-6))
    return windows.select(
        "*", F.log1p("pps").alias("total_pps_log"), F.log1p("bytes").alias("total_bytes_log"),
        *[(c(f"count_{_column(p)}") / n).alias(f"{_column(p)}_ratio") for p in protocols], *[(c(f"count_flag_{f}") / n).alias(f"flag_{f}_ratio") for f in flags],
        (c("unique_dst_ports") / n).alias("port_scan_ratio"), (c("size_max") / c("size_avg")).alias("burst_factor"), duration.alias("flow_duration"),
        (c("total_payload") / n).alias("payload_continuity"), (c("total_res") / (c("total_req") + 1e-6)).alias("payload_continuity_ratio"), (duration / (F.greatest(n, F.lit(2)) - 1)).alias("iat_mean"),
    )


def ordered() -> Window:
    return Window.partitionBy("capture_id").orderBy("bucket")


def rolling(x: Column, how, n: int) -> Column:
    """The aggregate over the last n rows, missing until there are n values."""
    frame = ordered().rowsBetween(1 - n, 0)
    return F.when(F.count(x).over(frame) == n, how(x).over(frame))


def difference(x: str) -> Column:
    return F.coalesce(F.col(x) - F.lag(x).over(ordered()), F.lit(0.0))


def kinematics(windows: DataFrame) -> DataFrame:
    """First and second differences, volatilities, bursts and z-scores; all frames share one sort."""
    signals = {"pps": "total_pps_log", "bytes": "total_bytes_log", "entropy": "entropy_avg"}
    df = windows.select("*", *[difference(x).alias(f"{s}_velocity") for s, x in signals.items()])
    df = df.select("*", *[difference(f"{s}_velocity").alias(f"{s}_acceleration") for s in signals])
    df = df.select("*", *[F.coalesce(rolling(F.col(x), F.stddev_samp, 5), F.lit(0.0)).alias(f"{s}_volatility") for s, x in signals.items()])
    mean = rolling(F.col("total_pps_log"), F.avg, 10)
    df = df.withColumn("burst_flag", F.when(mean.isNotNull(), (F.col("total_pps_log") > 1.5 * mean).cast("double")))
    df = df.withColumn("pps_momentum", F.coalesce(rolling(F.col("burst_flag"), F.sum, 5), F.lit(0.0))).drop("burst_flag")
    for name, x in (("vel_pps_z", "total_pps_log"), ("vel_bytes_z", "total_bytes_log"), ("vel_syn_z", "flag_syn_ratio")):
        z = (F.col(x) - rolling(F.col(x), F.avg, 60)) / (rolling(F.col(x), F.stddev_samp, 60) + 1e-6)
        df = df.withColumn(name, F.coalesce(z, F.lit(0.0)))
    return df


def select_features(windows: DataFrame) -> DataFrame:
    """Keys, the columns whose names mark them as features, and metadata."""
    names = [c for c in windows.columns if (any(p in c for p in FEATURE_PARTS) or c in FEATURE_NAMES) and not c.startswith("count_") and c not in METADATA]
    return windows.select(*[c for c in KEYS if c in windows.columns], *names, *[c for c in METADATA if c in windows.columns]).fillna(0)


NUMBERS = ("double", "float", "tinyint", "smallint", "int", "bigint", "decimal")


def feature_names(df: DataFrame) -> list[str]:
    """The numeric columns but for keys and metadata."""
    return [c for c, kind in df.dtypes if kind.startswith(NUMBERS) and c not in KEYS and c not in METADATA and not c.startswith(("_", "meta_"))]


def window_features(packets: DataFrame, protocols: list[str] | None = None) -> DataFrame:
    """The feature matrix of the packets."""
    protocols = protocols_of(packets) if protocols is None else protocols
    return select_features(kinematics(physics(base_aggregates(packets, protocols), protocols)))
