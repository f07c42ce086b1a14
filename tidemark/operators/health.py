"""Health of a capture from its packets."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import sample_kurtosis, sample_skewness


def histogram(packets: DataFrame, width: float = 1.0) -> DataFrame:
    """Packets in equal bins over the time span, int(span / width) + 1 of them; empty bins have no row. Bins close on the right."""
    span = packets.groupBy("capture_id").agg(F.min("timestamp").alias("low"), F.max("timestamp").alias("high"))
    df = packets.join(span, "capture_id")  # a row for each capture: Spark broadcasts it by its measured size
    bins = F.floor((F.col("high") - F.col("low")) / width) + 1
    place = F.greatest(F.ceil((F.col("timestamp") - F.col("low")) / (F.col("high") - F.col("low")) * bins) - 1, F.lit(0))
    return df.groupBy("capture_id", F.coalesce(place, F.lit(0)).cast("long").alias("bin"), bins.cast("long").alias("bins")).agg(F.count("*").alias("n"))


def largest_gap(packets: DataFrame, slots: float = 3600.0) -> DataFrame:
    """The longest time between packets: within slots of time, and between the last of one slot and the first of the next."""
    slot = F.floor(F.col("timestamp") / slots)
    df = packets.select("capture_id", "timestamp", slot.alias("slot"))
    inner = df.withColumn("gap", F.col("timestamp") - F.lag("timestamp").over(Window.partitionBy("capture_id", "slot").orderBy("timestamp")))
    per = inner.groupBy("capture_id", "slot").agg(F.max("gap").alias("gap"), F.min("timestamp").alias("first"), F.max("timestamp").alias("last"))
    outer = per.withColumn("between", F.col("first") - F.lag("last").over(Window.partitionBy("capture_id").orderBy("slot")))
    return outer.groupBy("capture_id").agg(F.coalesce(F.max(F.greatest("gap", "between")), F.lit(0.0)).alias("max_timestamp_gap_sec"))


def capture_health(packets: DataFrame, width: float = 1.0) -> DataFrame:
    """Twelve measures of each capture; silent_windows_pct counts empty bins."""
    bins = histogram(packets, width).groupBy("capture_id").agg(
        F.avg("n").alias("pps_avg"), ((F.max("bins") - F.count("*")) / F.max("bins") * 100).alias("silent_windows_pct"), sample_skewness("n").alias("pps_skewness"), sample_kurtosis("n").alias("pps_kurtosis")
    )
    whole = packets.groupBy("capture_id").agg(
        F.count("*").alias("packet_count"), (F.max("timestamp") - F.min("timestamp")).alias("time_span_sec"), F.avg("entropy").alias("entropy_avg"), F.stddev_pop("entropy").alias("entropy_std"),
        sample_skewness("entropy").alias("entropy_skewness"), sample_kurtosis("entropy").alias("entropy_kurtosis"), F.count_if((F.col("entropy") < 0) | (F.col("entropy") > 8)).alias("entropy_violations"),
    )
    return whole.join(bins, "capture_id").join(largest_gap(packets), "capture_id")
