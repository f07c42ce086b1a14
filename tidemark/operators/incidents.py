"""Rows of results to incidents, and what is told of each.

Results have capture_id, ts (a timestamp), the score columns of each tier and physical_culprit (null where there is none).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.dimensions import TECHNIQUES, TIER_WEIGHTS
from tidemark.functions import culprits as C
from tidemark.functions.statistics import normal_cdf

KEYS = ("capture_id", "incident_id")


def seconds(x: Column) -> Column:
    return F.unix_micros(x) / 1e6


def timeline(results: DataFrame) -> DataFrame:
    """Epoch seconds as ts, a missing or impossible time taken from the row before; empty texts as null."""
    valid = F.when(F.col("_abs_timestamp") > 1e9, F.col("_abs_timestamp"))
    filled = F.last(valid, ignorenulls=True).over(Window.partitionBy("capture_id").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0))
    texts = [c for c, t in results.dtypes if t == "string" and c != "capture_id"]
    df = results.withColumn("ts", F.timestamp_micros((filled * 1e6).cast("long")))
    return df.select(*[F.nullif(F.col(c), F.lit("")).alias(c) if c in texts else F.col(c) for c in df.columns])


def anomalies(results: DataFrame) -> DataFrame:
    return results.filter((F.col("is_anomaly") == 1) | (F.col("soft_zone_triggered") & (F.col("balltree_severity") >= 0.5)))


def cluster(rows: DataFrame, debounce: float = 30.0) -> DataFrame:
    """Adds incident_id: a new one after a gap of more than the debounce."""
    order = Window.partitionBy("capture_id").orderBy("ts")
    gap = seconds(F.col("ts")) - seconds(F.lag("ts").over(order))
    starts = F.coalesce((gap > debounce).cast("int"), F.lit(0))
    return rows.withColumn("__start", starts).withColumn("incident_id", F.sum("__start").over(order.rowsBetween(Window.unboundedPreceding, 0)).cast("long")).drop("__start")


TIERS = {
    "BallTree": (F.col, "balltree_score", lambda: F.col("balltree_severity") > 0),
    "GMM": (F.col, "gmm_score", lambda: F.col("gmm_anomaly") == 1),
    "IForest": (F.col, "iforest_score", lambda: F.col("iforest_anomaly") == 1),
    "PhysicalSentinel": (F.abs, "culprit_deviation", lambda: F.col("physical_culprit").isNotNull()),
    "VelocityBypass": (F.col, "vel_score", lambda: F.col("vel_bypass")),
}


def incidents(rows: DataFrame) -> DataFrame:
    """One row for each incident, by one aggregation: extent, severities and the evidence of all tiers."""
    tiers = []
    for name, (of, score, fired) in TIERS.items():
        tiers += [F.count_if(fired()).alias(f"{name}_count"), F.avg(of(score)).alias(f"{name}_mean")]
    dev = F.abs("culprit_deviation")
    df = rows.groupBy(*KEYS).agg(
        F.min("ts").alias("start_time"), F.max("ts").alias("end_time"), F.count("*").alias("n"), F.max("severity").alias("max_severity"), F.coalesce(F.avg(dev), F.lit(0.0)).alias("mean_sigma"),
        F.coalesce(F.max(dev), F.lit(0.0)).alias("max_sigma"), (F.avg(F.col("is_warmup").cast("double")) > 0.5).alias("is_warmup"), *tiers,
    )
    df = df.withColumn("duration", seconds(F.col("end_time")) - seconds(F.col("start_time")))
    return df.withColumn("confidence", confidence()).withColumn("severity_score", severity_score(F.col("max_sigma"), F.col("n")))


def tier_evidence(found: DataFrame) -> DataFrame:
    """A row for each incident and tier."""
    parts = [F.struct(F.lit(t).alias("tier"), (F.col(f"{t}_count") > 0).alias("fired"), F.col(f"{t}_count").alias("fire_count"), F.col(f"{t}_mean").alias("mean_score")) for t in TIERS]
    return found.select(*KEYS, F.explode(F.array(*parts)).alias("t")).select(*KEYS, "t.*")


def confidence(mean_sigma: Column | None = None, n: Column | None = None, fired: Column | None = None, warmup: Column | None = None) -> Column:
    """0.45 of significance, 0.35 of volume, 0.20 of the tiers' agreement; half while warming up."""
    mean_sigma = F.col("mean_sigma") if mean_sigma is None else mean_sigma
    n = F.col("n") if n is None else n
    if fired is None:
        fired = sum((F.when(F.col(f"{t}_count") > 0, w).otherwise(0.0) for t, w in TIER_WEIGHTS.items()), F.lit(0.0)) / sum(TIER_WEIGHTS.values())
    warmup = F.col("is_warmup") if warmup is None else warmup
    volume = F.least(F.lit(1.0), F.log2(n + 1) / F.log2(F.lit(513.0)))
    raw = 0.45 * normal_cdf(F.greatest(mean_sigma, F.lit(0.0))) + 0.35 * volume + 0.20 * fired
    return F.least(F.lit(1.0), F.when(warmup, raw * 0.5).otherwise(raw))


def severity_score(max_sigma: Column, n: Column) -> Column:
    power = F.when(max_sigma <= 5, max_sigma / 5).otherwise(1 + F.pow(F.greatest(max_sigma - 5, F.lit(0.0)), F.lit(1.8)) / 10)
    return power * (1 + F.log1p(n) / F.log1p(F.lit(100.0)))


def parsed(rows: DataFrame) -> DataFrame:
    """Rows with a culprit, and what its text says."""
    text = F.col("physical_culprit")
    df = rows.filter(text.isNotNull()).withColumn("feature", C.base_name(text)).withColumn("event_type", C.event_type(text))
    df = df.withColumn("sigma", F.greatest(C.sigma(text), F.abs("culprit_deviation"))).withColumn("pct", C.percent(text))
    return df.withColumn("family", C.family(F.col("feature"), F.col("family_consensus")))


def top_features(rows: DataFrame, n: int = 3) -> DataFrame:
    """The features of largest sigma of each incident; of equal ones the first in time."""
    df = parsed(rows).filter("feature <> 'unknown'").groupBy(*KEYS, "feature").agg(
        F.max("sigma").alias("max_sigma"), F.max("pct").alias("max_pct"), F.max_by("event_type", F.struct("sigma", -F.col("bucket"))).alias("event_type"),
        F.min_by("family", "bucket").alias("family"), F.min("bucket").alias("first_seen"),
    )
    top = F.max("max_sigma").over(Window.partitionBy(*KEYS))
    df = df.withColumn("loading", F.col("max_sigma") / F.when(top == 0, 1.0).otherwise(top))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("max_sigma"), "first_seen"))
    return df.withColumn("rank", rank).filter(F.col("rank") <= n).drop("first_seen")


def top_ports(rows: DataFrame, n: int = 3) -> DataFrame:
    counts = rows.groupBy(*KEYS, "server_port").agg(F.count("*").alias("times"))
    return counts.withColumn("rank", F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("times"), "server_port"))).filter(F.col("rank") <= n)


def most_frequent(rows: DataFrame, column: str) -> DataFrame:
    """The mode of a column in each incident, the least of equally frequent values."""
    counts = rows.filter(F.col(column).isNotNull()).groupBy(*KEYS, column).agg(F.count("*").alias("times"))
    rank = F.row_number().over(Window.partitionBy(*KEYS).orderBy(F.desc("times"), column))
    return counts.withColumn("rank", rank).filter("rank = 1").drop("rank")


def family_stress(rows: DataFrame) -> DataFrame:
    """Each family's share of an incident's absolute deviations."""
    sums = parsed(rows).groupBy(*KEYS, "family").agg(F.sum(F.abs(F.coalesce("culprit_deviation", F.lit(0.0)))).alias("stress"))
    total = F.sum("stress").over(Window.partitionBy(*KEYS))
    return sums.withColumn("share", F.col("stress") / F.when(total == 0, 1.0).otherwise(total))


def family_distribution(rows: DataFrame) -> DataFrame:
    counts = parsed(rows).groupBy("family").agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.join(F.broadcast(total)).select("family", "n", (F.col("n") / F.col("total")).alias("share"))  # one row of totals


#: The families of the radar, in the order of its axes.
RADAR = ("volume", "payload", "flags", "protocol", "connection", "kinematics")


def family_radar(stress: DataFrame, rows: DataFrame) -> DataFrame:
    """Each family's part of the incidents' stress shares together; where no incident has any, of the rows with a culprit."""
    shares = stress.groupBy("family").agg(F.sum("share").alias("a"))
    counts = parsed(rows).groupBy("family").agg(F.count("*").cast("double").alias("b"))
    both = shares.join(counts, "family", "full")
    total = both.agg(F.coalesce(F.sum("a"), F.lit(0.0)).alias("all_a"), F.coalesce(F.sum("b"), F.lit(0.0)).alias("all_b"))  # one row
    both = both.join(F.broadcast(total)).withColumn("value", F.when(F.col("all_a") > 0, F.col("a") / F.col("all_a")).when(F.col("all_b") > 0, F.col("b") / F.col("all_b")))
    axes = rows.sparkSession.createDataFrame(list(enumerate(RADAR)), "axis int, family string")
    return F.broadcast(axes).join(both, "family", "left").select("axis", "family", F.coalesce("value", F.lit(0.0)).alias("value"))


def threat_distribution(rows: DataFrame) -> DataFrame:
    return parsed(rows).groupBy("feature").agg(F.count("*").alias("n"))


def pair_counts(rows: DataFrame, n: int = 5) -> DataFrame:
    return parsed(rows).groupBy("feature", "family").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "feature", "family").limit(n)


def technique_table(spark) -> DataFrame:
    return spark.createDataFrame([(i, *t) for i, t in enumerate(TECHNIQUES)], "rank int, pattern string, tactic string, technique string")


def techniques(rows: DataFrame) -> DataFrame:
    """Tactics and techniques whose pattern stands in the culprit's name, each once for an incident."""
    bases = parsed(rows).groupBy(*KEYS, "feature").agg(F.min("bucket").alias("first_seen"))
    hits = bases.join(F.broadcast(technique_table(rows.sparkSession)), F.expr("instr(feature, pattern) > 0"))  # 25 fixed rows
    return hits.groupBy(*KEYS, "technique").agg(F.min_by("tactic", F.struct("first_seen", "rank")).alias("tactic"))


def data_drops(results: DataFrame, found: DataFrame, threshold: float = 60.0, near: float = 15.0, compat: bool = True) -> DataFrame:
    """Gaps between rows of results longer than the threshold, with the reason for each.

    With compat a gap follows an incident when its end does (within `near` seconds); without, when its start does.
    """
    order = Window.partitionBy("capture_id").orderBy("ts")
    df = results.select("capture_id", "ts", "is_anomaly", "severity").select(
        "capture_id", F.lag("ts").over(order).alias("start_time"), F.col("ts").alias("end_time"), F.lag("is_anomaly").over(order).alias("was"), F.lag("severity").over(order).alias("was_severity"), "is_anomaly", "severity"
    )
    df = df.withColumn("gap_seconds", seconds(F.col("end_time")) - seconds(F.col("start_time"))).filter(F.col("gap_seconds") > threshold)
    before = F.when(F.col("was") == 1, F.col("was_severity").cast("int")).when(F.col("is_anomaly") == 1, F.col("severity").cast("int"))
    df = df.withColumn("severity_before", before).withColumn("is_anomaly_context", (F.col("was") == 1) | (F.col("is_anomaly") == 1))
    severe = found.filter("max_severity >= 2").select(F.col("capture_id").alias("c"), "end_time").withColumnRenamed("end_time", "inc_end")
    # The range join is an equi join on time slots as wide as the range, so that no pair outside two slots is tried.
    point = "end_time" if compat else "start_time"
    slot = F.floor(seconds(F.col(point)) / near)
    severe = severe.withColumn("slot", F.explode(F.array(F.floor(seconds(F.col("inc_end")) / near), F.floor(seconds(F.col("inc_end")) / near) + 1)))
    lag = seconds(F.col(point)) - seconds(F.col("inc_end"))
    hit = df.withColumn("__slot", slot).join(severe, (F.col("c") == F.col("capture_id")) & (F.col("slot") == F.col("__slot")) & (lag >= 0) & (lag <= near), "left_semi")
    hit = hit.select("capture_id", "end_time", F.lit(True).alias("saturated"))
    df = df.join(hit, ["capture_id", "end_time"], "left")
    reason = (
        F.when(F.col("saturated"), "[POSSIBLE_SENSOR_SATURATION] Gap follows high-severity incident")
        .when(F.col("is_anomaly_context") & (F.col("severity_before") >= 2), "Sensor Blindness / Data Drop due to Saturation")
        .otherwise("Capture Loss / Network Silence")
    )
    return df.select("capture_id", "start_time", "end_time", "gap_seconds", "severity_before", "is_anomaly_context", reason.alias("reason"))


def reportable(found: DataFrame, confidence_least: float = 0.8, n: int = 1, duration: float = 1.0, sigma: float = 2.0) -> DataFrame:
    return found.filter((F.col("n") >= n) & (F.col("duration") >= duration) & (F.col("confidence") >= confidence_least) & (F.col("mean_sigma") >= sigma))


def summary(results: DataFrame, rows: DataFrame, found: DataFrame, shown: DataFrame) -> DataFrame:
    """One row of totals."""
    a = results.agg(F.count("*").alias("windows"), F.count_if(F.col("is_anomaly") == 1).alias("anomalies"), F.count_if(F.col("severity") >= 3).alias("critical"), F.count_if("soft_zone_triggered").alias("soft_zone"))
    b = rows.agg(F.count("*").alias("report_rows"))
    c = found.agg(F.count("*").alias("incidents"), F.coalesce(F.max("severity_score"), F.lit(0.0)).alias("max_severity_score"), F.coalesce(F.avg("confidence"), F.lit(0.0)).alias("mean_confidence"))
    d = shown.agg(F.count("*").alias("reportable"))
    df = a.join(F.broadcast(b)).join(F.broadcast(c)).join(F.broadcast(d))  # four single rows
    return df.withColumn("anomaly_rate", F.when(F.col("windows") > 0, F.col("anomalies") / F.col("windows")).otherwise(0.0))
