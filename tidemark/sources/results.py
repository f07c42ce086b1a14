"""Results as CSV or Parquet, with a fixed schema; empty texts come back as null."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

RESULTS = (
    "capture_id string, bucket long, balltree_score double, balltree_severity double, gmm_score double, gmm_anomaly int, iforest_score double, iforest_anomaly int, consensus_votes int, is_anomaly int, "
    "severity double, persistence string, anomaly_ma_score double, physical_culprit string, culprit_component string, culprit_deviation double, forensic_evidence string, is_warmup boolean, "
    "family_consensus string, vel_score double, vel_bypass boolean, vel_culprit string, _abs_timestamp double, server_port int, soft_zone_triggered boolean"
)
COLUMNS = [c.split()[0] for c in RESULTS.split(", ")]


def read_results(spark: SparkSession, path: str) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    df = spark.read.schema(RESULTS).option("header", True).option("escape", '"').csv(path)
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if t == "string" else c for c, t in df.dtypes])


def write_results(df: DataFrame, path: str) -> None:
    out = df.select(*[c for c in COLUMNS if c in df.columns])
    if path.rstrip("/").endswith(".parquet"):
        out.write.mode("overwrite").parquet(path)
    else:
        out.write.mode("overwrite").option("header", True).option("escape", '"').csv(path)


def write_matrix(df: DataFrame, path: str) -> None:
    """The feature matrix as CSV, for audit."""
    df.write.mode("overwrite").option("header", True).csv(path)


def write_json(spark: SparkSession, path: str, value: dict) -> None:
    """A small document, through Spark so that any store will do."""
    spark.createDataFrame([(json.dumps(value, sort_keys=True),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path, wholetext=False).first()[0])
