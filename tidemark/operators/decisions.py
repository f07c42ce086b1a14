"""Weighted consensus of the detectors, the decision rules and what stabilises them over time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.statistics import clip, normal_cdf
from tidemark.operators.windows import ordered


def min_max(x: str, low: Column | float | None = None, high: Column | float | None = None) -> Column:
    """Scaled to [0, 1] by the batch's extremes, or by given ones (a stream has no batch); 0 where these are equal."""
    whole = Window.partitionBy("capture_id")
    low = F.min(x).over(whole) if low is None else F.lit(low)
    high = F.max(x).over(whole) if high is None else F.lit(high)
    return F.when(high - low > 1e-10, (F.col(x) - low) / (high - low)).otherwise(0.0)


def squash(score: Column, mean: float, deviation: float, method: str = "cdf") -> Column:
    """A likelihood score as a number in [0, 1]."""
    z = (score - F.lit(mean)) / F.lit(deviation + 1e-10)
    return clip(normal_cdf(z), 0.0, 1.0) if method == "cdf" else (clip(z, -3.0, 3.0) + 3) / 6


def normal_weights(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values()) or 1.0
    return {k: v / total for k, v in weights.items()}


def weighted_consensus(weights: dict[str, float], gmm: Column, bounds: dict[str, tuple[float, float]] | None = None) -> Column:
    """Of balltree_score, gmm (already in [0, 1]), iforest_score and vel_score; bounds freeze what a batch would give."""
    b = bounds or {}
    total = F.lit(weights.get("balltree", 0.0)) * min_max("balltree_score", *b.get("balltree_score", (None, None)))
    total = total + F.lit(weights.get("gmm", 0.0)) * gmm + F.lit(weights.get("iforest", 0.0)) * min_max("iforest_score", *b.get("iforest_score", (None, None)))
    if weights.get("velocity", 0.0) > 0:
        total = total + F.lit(weights["velocity"]) * clip(F.col("vel_score") / 3, 0.0, 1.0)
    return total


def suspect(severity: Column, bypass: Column) -> Column:
    """Rows that the second tier looks at."""
    return (severity >= 1) | (severity == 0.5) | bypass


def decide(threshold: float, weighted: bool = True, votes_needed: int = 2) -> tuple[Column, Column, Column]:
    """(is_anomaly, severity, family) from balltree_severity, consensus, family_consensus, phys_vote, vel_bypass, vel_severity and consensus_votes."""
    sev, bypass, phys = F.col("balltree_severity"), F.col("vel_bypass"), F.col("phys_vote") == 1
    agreed = F.col("consensus") >= threshold
    family = F.when((sev == 1) & agreed, F.col("family_consensus")) if weighted else F.lit(None).cast("string")
    if weighted:
        rule = (sev == 3) | ((sev == 2) & agreed) | ((sev == 1) & agreed & F.col("family_consensus").isNotNull()) | ((sev == 1) & phys)
    else:
        rule = (sev == 3) | (sev.isin(1.0, 2.0) & (F.col("consensus_votes") >= votes_needed)) | ((sev == 1) & phys)
    severity = F.when(bypass, F.greatest(F.floor(sev), F.col("vel_severity")).cast("double")).otherwise(sev.cast("double"))
    return (bypass | rule).cast("int"), severity, family


def persist(df: DataFrame, n: int = 3) -> DataFrame:
    """Alerts that last n rows, and n - 1 rows beyond; bypass rows stay; captures of fewer than n rows are left as they are."""
    confirmed = F.when(F.count("*").over(ordered().rowsBetween(1 - n, 0)) == n, F.min("is_anomaly").over(ordered().rowsBetween(1 - n, 0))).otherwise(0)
    df = df.withColumn("__eroded", confirmed).withColumn("__grown", F.max("__eroded").over(ordered().rowsBetween(1 - n, 0)))
    long_enough = F.count("*").over(Window.partitionBy("capture_id")) >= n
    flag = F.when(long_enough, F.when(F.col("vel_bypass"), 1).otherwise(F.col("__grown"))).otherwise(F.col("is_anomaly"))
    return df.withColumn("is_anomaly", flag.cast("int")).withColumn("severity", F.when(F.col("is_anomaly") == 0, 0.0).otherwise(F.col("severity"))).drop("__eroded", "__grown")


def hysteresis(df: DataFrame, threshold: float, base: int = 3, entry: float = 1.0, exit_: float = 0.75, out: str = "stable") -> DataFrame:
    """A state machine over each capture's rows in order: alerts begin above the entry and end when the score stays below
    the exit. How many low rows end an alert falls with the score.

    Rows pass in Arrow batches; the state, two values, goes from batch to batch.
    """
    import pyarrow as pa

    def run(batches):
        state: dict = {}
        for batch in batches:
            flags = []
            for capture, flag, score in zip(*(batch.column(c).to_pylist() for c in ("capture_id", "is_anomaly", "balltree_score")), strict=True):
                if state.get("capture") != capture:
                    state = {"capture": capture, "machine": (False, 0)}
                value, state["machine"] = hysteresis_step(state["machine"], flag, score, threshold, base, entry, exit_)
                flags.append(value)
            yield pa.record_batch([batch.column("capture_id"), batch.column("bucket"), pa.array(flags, pa.int32())], names=["capture_id", "bucket", out])

    rows = df.select("capture_id", F.col("bucket").cast("long").alias("bucket"), F.col("is_anomaly").cast("int").alias("is_anomaly"), F.col("balltree_score").cast("double").alias("balltree_score"))
    return df.join(rows.repartition("capture_id").sortWithinPartitions("capture_id", "bucket").mapInArrow(run, f"capture_id string, bucket long, {out} int"), ["capture_id", "bucket"])


def hysteresis_step(machine: tuple[bool, int], flag: int, score: float, threshold: float, base: int, entry: float, exit_: float) -> tuple[int, tuple[bool, int]]:
    """One row of the state machine: (flag out, state)."""
    alert, clear = machine
    high, low = threshold * entry, threshold * exit_
    if not alert:
        return (1, (True, 0)) if flag and score > high else (0, (False, clear))
    if score < low:
        needed = max(1, min(base, int(3 / (score / (high + 1e-10) + 0.1))))
        return (0, (False, 0)) if clear + 1 >= needed else (1, (True, clear + 1))
    return 1, (True, 0)


def fix_severity(flag: Column, severity: Column) -> Column:
    """No severity without an alert, and no alert without severity."""
    return F.when(flag == 0, 0.0).when(severity == 0, 1.0).otherwise(severity)


def moving_average(n: int = 5) -> Column:
    enough = F.count("*").over(Window.partitionBy("capture_id")) >= n
    return F.when(enough, F.avg("balltree_score").over(ordered().rowsBetween(1 - n, 0)))


def persistence_label(score: Column, average: Column, transient: float = 0.4) -> Column:
    return F.when(score / (average + 1e-10) > 1 / transient, "Transient Spike").otherwise("Sustained Attack")


def is_warmup(n: int = 5, multiplier: int = 3) -> Column:
    return F.row_number().over(ordered()) <= n * multiplier


def veto(deviation: Column, severity: Column, votes: Column, limit: float = 12.0) -> Column:
    """Rows that are critical whatever the rest says."""
    return (F.abs(deviation) > limit) | ((severity == 3) & (votes >= 2))
