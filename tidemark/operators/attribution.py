"""Which feature and component make a row stand out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions.statistics import top


def z_scores(base: dict[str, tuple[float, float]], names: list[str]) -> list[tuple[str, Column]]:
    return [(n, F.abs(F.col(n) - F.lit(base[n][0])) / (F.lit(base[n][1]) + 1e-10)) for n in names]


def _pick(name: Column, options: dict[str, Column]) -> Column:
    out = F.lit(None)
    for n, v in options.items():
        out = F.when(name == n, v).otherwise(out)
    return out


def culprit(df: DataFrame, base: dict[str, tuple[float, float]], names: list[str], likelihoods: dict[str, Column] | None = None) -> DataFrame:
    """Adds culprit_feature, culprit_z (signed), culprit_pct and the text physical_culprit."""
    items = [(z, {"name": F.lit(n), "value": F.col(n).cast("double"), "mean": F.lit(float(base[n][0]))}) for n, z in z_scores(base, names)]
    df = df.withColumn("__top", top(items))
    z, value, mean = F.col("__top.k"), F.col("__top.value"), F.col("__top.mean")
    up = value > mean
    df = df.withColumn("culprit_feature", F.col("__top.name")).withColumn("culprit_pct", F.abs(value - mean) / (F.abs(mean) + 1e-10) * 100).withColumn("culprit_z", F.when(up, z).otherwise(-z))
    spike, drop = "%s (SPIKE (+%.1f%%), σ=%.2f)", "%s (DROP (%.1f%%), σ=%.2f)"
    text = F.when(up, F.format_string(spike, "culprit_feature", "culprit_pct", z)).otherwise(F.format_string(drop, "culprit_feature", "culprit_pct", z))
    if likelihoods:
        df = df.withColumn("__least", top([(-v, {"name": F.lit(n)}) for n, v in likelihoods.items()]))
        other = F.format_string(" | GMM: %s (LL=%.3f)", F.col("__least.name"), -F.col("__least.k"))
        text = F.when(F.col("__least.name") != F.col("culprit_feature"), F.concat(text, other)).otherwise(text)
    return df.withColumn("physical_culprit", text).drop("__top", "__least")


def component_culprit(parts: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(component, signed deviation) of the largest coordinate."""
    best = top([(F.abs(v), {"name": F.lit(n), "signed": v}) for n, v in parts])
    return best["name"], best["signed"]


def severity_label(severity: Column) -> Column:
    return F.when(severity == 0.5, "SOFT ZONE").when(severity >= 3, "CRITICAL").when(severity >= 2, "MEDIUM").when(severity >= 1, "BORDERLINE").otherwise("NORMAL")


def evidence(suspects: dict[str, list[str]], threshold: float) -> Column:
    """The sentence that explains a row; suspects names the features behind each component."""
    c = F.col
    told = _pick(c("culprit_component"), {n: F.lit(", ".join(f)) for n, f in suspects.items()})
    head = F.concat(F.lit("["), severity_label(c("balltree_severity")), F.when(c("is_warmup"), " [WARMUP]").otherwise(""), F.lit("] Physical: "), c("physical_culprit"), F.lit(". Multivariate: "), c("culprit_component"))
    body = F.format_string(" (%s %.2fσ). Suspect features: ", F.when(c("culprit_deviation") > 0, "elevated").otherwise("reduced"), F.abs(c("culprit_deviation")))
    tail = F.concat(F.coalesce(told, F.lit("")), F.lit(". Persistence: "), F.coalesce(c("persistence"), F.lit("")), F.format_string(". BallTree score: %.2fx P99.", c("balltree_score")))
    family = F.when(c("family_consensus").isNotNull(), F.concat(F.lit(" Family: "), c("family_consensus"), F.lit("."))).otherwise("")
    bypass = F.when(c("vel_bypass"), F.concat(F.lit(" VELOCITY BYPASS: "), c("vel_culprit"), F.lit(f" (≥{threshold:.1f}σ)."))).otherwise("")
    return F.concat(head, body, tail, family, bypass, F.when(c("balltree_severity") == 3, " ALERT: Critical — immediate investigation required.").otherwise(""))
