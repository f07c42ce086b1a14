"""Streams give what batches give."""

from pyspark.sql import functions as F

from tests.conftest import SMALL
from tidemark.operators.decisions import hysteresis_step
from tidemark.operators.windows import kinematics
from tidemark.sources.adapters import events_as_packets
from tidemark.streaming import live


def test_alerts_across_batches_equal_one_batch(spark, tmp_path):
    packets = events_as_packets(spark.read.parquet(f"{SMALL}/events.parquet"), 3600.0)
    w = packets.groupBy("capture_id", "bucket").agg(F.count("*").alias("pps"), F.sum("size").alias("bytes"), F.avg("tcp_flags_syn").alias("flag_syn_ratio"), F.avg(F.lit(0.0)).alias("entropy_avg"))
    rows = w.toPandas().sort_values("bucket").reset_index(drop=True)
    for i in range(3):
        spark.createDataFrame(rows.iloc[i * 150 : (i + 1) * 150]).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    schema = spark.read.parquet(f"{tmp_path}/in/0").schema
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in")
    query = live.stream_alerts(stream, 5.0, 0.4).writeStream.format("memory").queryName("alerts").outputMode("append").option("checkpointLocation", f"{tmp_path}/state").start()
    query.processAllAvailable()
    query.stop()
    got = {r.bucket: r for r in spark.table("alerts").collect()}
    batch = spark.createDataFrame(rows.iloc[:450]).withColumn("total_pps_log", F.log1p("pps")).withColumn("total_bytes_log", F.log1p("bytes"))
    want = kinematics(batch).orderBy("bucket").collect()
    state = (False, 0)
    assert len(got) == len(want)
    for r in want:
        assert abs(got[r.bucket].vel_pps_z - r.vel_pps_z) < 1e-6 and abs(got[r.bucket].vel_syn_z - r.vel_syn_z) < 1e-6
        score = max(abs(r.vel_pps_z), abs(r.vel_bytes_z), abs(r.vel_syn_z)) / 5.0
        flag, state = hysteresis_step(state, int(score > 0.4), score, 0.4, 3, 1.0, 0.75)
        assert got[r.bucket].stable == flag


def test_windows_of_a_stream(spark, tmp_path):
    df = events_as_packets(spark.read.parquet(f"{SMALL}/events.parquet"), 3600.0).withColumn("ts", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long"))).select("capture_id", "ts", "size", "tcp_flags_syn")
    df.coalesce(1).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(df.schema).parquet(f"{tmp_path}/in")
    query = live.stream_windows(stream, 3600).writeStream.format("memory").queryName("windows").outputMode("complete").start()
    query.processAllAvailable()
    query.stop()
    got = {(r.bucket, r.pps, r.bytes) for r in spark.table("windows").collect()}
    want = {(r.b, r.n, r.s) for r in df.groupBy(F.floor(F.unix_micros("ts") / 3_600_000_000).alias("b")).agg(F.count("*").alias("n"), F.sum("size").alias("s")).collect()}
    assert got == want
