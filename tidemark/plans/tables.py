"""The tables that the registered queries are made from, over the driver's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.packets import byte_entropy
from tidemark.functions.statistics import first_greatest
from tidemark.operators import attribution, detectors, incidents, scaling, windows
from tidemark.plans.sql import DEBOUNCE, FEATURES, PROTOCOLS
from tidemark.scratch import staged
from tidemark.sources.adapters import events_as_packets


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return events_as_packets(table(spark, sf_dir, "events")).withColumn("entropy", byte_entropy("payload"))


def base(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.base_aggregates(packets(spark, sf_dir), PROTOCOLS)


def physics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.physics(base(spark, sf_dir), PROTOCOLS)


def kinematics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return windows.kinematics(physics(spark, sf_dir))


def results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table of results whose scores come from z-scores of the windows' features. Windows and results are written once,
    as statistics and each further step read them again."""
    df = staged(kinematics(spark, sf_dir), "windows")
    base_stats = scaling.baseline(df, FEATURES)
    zs = attribution.z_scores(base_stats, FEATURES)
    df = attribution.culprit(df, base_stats, FEATURES)
    _, top = first_greatest(zs)
    mean = sum((z for _, z in zs[1:]), zs[0][1]) / len(zs)
    squares = sum((z * z for _, z in zs[1:]), zs[0][1] * zs[0][1])
    df = df.withColumn("top_z", top).withColumn("mean_z", mean).withColumn("sum_z2", squares)
    df = df.withColumn("family_consensus", detectors.family_consensus(base_stats, FEATURES))
    score, bypass, severity, vel_culprit = detectors.velocity_bypass(df.columns, 3.0)
    df = df.withColumn("vel_score", score).withColumn("vel_bypass", bypass).withColumn("vel_severity", severity).withColumn("vel_culprit", vel_culprit)
    p = df.agg(F.percentile("top_z", F.array(*[F.lit(x) for x in (0.90, 0.95, 0.99, 0.999)])), F.percentile("sum_z2", F.lit(0.95)), F.percentile("mean_z", F.lit(0.95))).first()
    p90, p95, p99, p999 = p[0]
    odd = (F.col("top_z") > p90) | F.col("vel_bypass")
    level = detectors.neighbour_severity(F.col("top_z"), p90, p95, p99, p999, slack=1.0)
    df = df.select(
        "capture_id", "bucket", "_abs_timestamp", "server_port", (F.col("top_z") / F.lit(p99)).alias("balltree_score"), level.alias("balltree_severity"), F.col("sum_z2").alias("gmm_score"),
        (F.col("sum_z2") > p[1]).cast("int").alias("gmm_anomaly"), F.col("mean_z").alias("iforest_score"), (F.col("mean_z") > p[2]).cast("int").alias("iforest_anomaly"), "vel_score", "vel_bypass", "vel_culprit",
        "vel_severity", "family_consensus", F.when(odd, F.col("physical_culprit")).alias("physical_culprit"), F.when(odd, F.col("culprit_z")).otherwise(0.0).alias("culprit_deviation"),
        (F.row_number().over(windows.ordered()) <= 15).alias("is_warmup"), ((F.col("top_z") > p90) & (F.col("top_z") <= p95)).alias("soft_zone_triggered"),
        ((F.col("top_z") > p95) | F.col("vel_bypass")).cast("int").alias("is_anomaly"), F.when(F.col("vel_bypass"), F.greatest(F.floor(level), F.lit(1)).cast("double")).when(level >= 1, level).otherwise(0.0).alias("severity"),
        F.timestamp_micros((F.col("_abs_timestamp") * 1_000_000).cast("long")).alias("ts"),
    )
    return staged(df, "results")


def clustered(spark: SparkSession, sf_dir: str) -> DataFrame:
    return incidents.cluster(incidents.anomalies(results(spark, sf_dir)), DEBOUNCE)


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found_of(results(spark, sf_dir))


def found_of(results: DataFrame) -> DataFrame:
    return incidents.incidents(incidents.cluster(incidents.anomalies(results), DEBOUNCE))


def rounded(df: DataFrame, *names: str) -> DataFrame:
    """The named columns; doubles to six places."""
    kinds = dict(df.dtypes)
    return df.select(*[F.round(n, 6).alias(n) if kinds[n] == "double" else F.col(n) for n in names or df.columns])
