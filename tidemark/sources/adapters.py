"""Tables of other kinds as packets."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.dimensions import FLAG_BITS
from tidemark.functions import packets as P


def bucket_of(micros, seconds: float):
    return F.floor(micros / F.lit(int(seconds * 1_000_000))).cast("long")


def routed(df: DataFrame) -> DataFrame:
    """Direction, server port and payloads each way, from ports and payload_bytes."""
    src, dst = F.col("src_port"), F.col("dst_port")
    df = df.withColumn("direction", P.direction(src, dst)).withColumn("server_port", P.server_port(src, dst))
    way, payload = F.col("direction"), F.col("payload_bytes")
    return df.withColumn("req_payload", P.request_bytes(way, payload)).withColumn("res_payload", P.response_bytes(way, payload))


def events_as_packets(events: DataFrame, bucket_seconds: float = 3600.0) -> DataFrame:
    """A packet for each event: kind as protocol, value as size, user as port, the property k as flags, properties as payload."""
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    k = F.get_json_object("props", "$.k").cast("long")
    df = events.select(
        F.lit("events").alias("capture_id"), "event_id", (micros / 1e6).alias("timestamp"), bucket_of(micros, bucket_seconds).alias("bucket"),
        F.floor(F.col("value") * 100).cast("long").alias("size"), F.upper("event_type").alias("protocol"), (F.col("event_id") % 65536).alias("src_port"),
        F.col("user_id").alias("dst_port"), *[P.flag(k, f).alias(f"tcp_flags_{f}") for f in FLAG_BITS], F.length("props").cast("long").alias("payload_bytes"), F.col("props").alias("payload"),
    )
    return routed(df)


def lineitems_as_packets(lineitem: DataFrame, bucket_seconds: float = 86_400.0) -> DataFrame:
    """A packet for each line: price as size, return flag as protocol, supplier as port."""
    micros = F.unix_micros(F.col("l_shipdate").cast("timestamp"))
    return lineitem.select(
        F.lit("lineitem").alias("capture_id"), (micros / 1e6).alias("timestamp"), bucket_of(micros, bucket_seconds).alias("bucket"), F.round(F.col("l_extendedprice") * 100).cast("long").alias("size"),
        F.col("l_returnflag").alias("protocol"), F.col("l_suppkey").alias("server_port"), F.col("l_partkey").alias("dst_port"),
    )
