"""train, detect and report: the whole way from packets to a report."""

from __future__ import annotations

import importlib.util
import json
import logging
import time
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from datetime import UTC, datetime

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.config import Settings
from tidemark.dimensions import VELOCITY_FEATURES
from tidemark.errors import ArtifactError, DetectionError, InsufficientData
from tidemark.operators import attribution, decisions, detectors, incidents, projection, scaling, windows
from tidemark.scratch import staged
from tidemark.sources.results import read_json, write_json, write_matrix, write_results


@dataclass
class Bundle:
    """Everything that detection needs; all of it small."""

    features: list[str]
    protocols: list[str]
    scaler: dict
    medians: dict
    base: dict
    blocks: list
    neighbours: detectors.Neighbours
    mixture: detectors.MixtureModel
    forest: detectors.ForestModel
    univariate: dict
    thresholds: dict
    bounds: dict = field(default_factory=dict)
    metadata: dict = field(default_factory=dict)

    def document(self) -> dict:
        m, n, f = self.mixture, self.neighbours, self.forest
        return {
            "features": self.features, "protocols": self.protocols, "scaler": self.scaler, "medians": self.medians, "base": self.base, "blocks": [asdict(b) for b in self.blocks],
            "neighbours": {"k": n.k, "percentiles": {str(p): v for p, v in n.percentiles.items()}}, "points": n.points.tolist(),
            "mixture": {"weights": m.weights.tolist(), "means": m.means.tolist(), "covariances": m.covariances.tolist(), "ll_mean": m.ll_mean, "ll_std": m.ll_std, "threshold": m.threshold},
            "forest": {"sample": f.sample, "threshold": f.threshold, "trees": [[c.tolist() for c in t] for t in f.trees]}, "univariate": self.univariate, "thresholds": self.thresholds,
            "bounds": self.bounds, "metadata": self.metadata,
        }

    def save(self, spark: SparkSession, path: str) -> None:
        document = self.document()
        spark.createDataFrame([(i, p) for i, p in enumerate(document.pop("points"))], "place long, coords array<double>").write.mode("overwrite").parquet(f"{path}/points")
        write_json(spark, f"{path}/model", document)
        write_json(spark, f"{path}/sidecar", self.metadata)
        self.save_scaler(spark, f"{path}/scaler")

    def save_scaler(self, spark: SparkSession, path: str) -> None:
        """The scaler as a table of its own: feature, centre, scale."""
        rows = [(n, float(centre), float(scale)) for n, (centre, scale) in self.scaler.items()]
        spark.createDataFrame(rows, "feature string, centre double, scale double").coalesce(1).write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> Bundle:
        try:
            d = read_json(spark, f"{path}/model")
            points = [r.coords for r in spark.read.parquet(f"{path}/points").orderBy("place").collect()]
        except Exception as e:
            raise ArtifactError(f"no bundle at {path}") from e
        a = np.array
        pairs = lambda x: {k: tuple(v) for k, v in x.items()}
        m, n, f = d["mixture"], d["neighbours"], d["forest"]
        return cls(
            d["features"], d["protocols"], pairs(d["scaler"]), d["medians"], pairs(d["base"]), [projection.Block(**b) for b in d["blocks"]],
            detectors.Neighbours(a(points), n["k"], {float(p): v for p, v in n["percentiles"].items()}),
            detectors.MixtureModel(a(m["weights"]), a(m["means"]), a(m["covariances"]), m["ll_mean"], m["ll_std"], m["threshold"]),
            detectors.ForestModel([tuple(a(c) for c in t) for t in f["trees"]], f["sample"], f["threshold"]), d["univariate"], d["thresholds"], pairs(d["bounds"]), d["metadata"],
        )


def load_scaler(spark: SparkSession, path: str) -> dict[str, tuple[float, float]]:
    return {r.feature: (r.centre, r.scale) for r in spark.read.parquet(path).collect()}


def train(packets: DataFrame, settings: Settings = Settings(), source: str = "", audit: str | None = None) -> Bundle:
    """Fit all tiers on packets that are known to be normal; audit: a folder for the unscaled matrix as CSV."""
    began, t = time.time(), settings
    protocols = windows.protocols_of(packets)
    cached = matrix = windows.window_features(packets, protocols).persist()
    n = matrix.count()
    if n < t.training.least_rows:
        raise InsufficientData(f"{n} windows; training needs {t.training.least_rows}")
    if audit:
        write_matrix(matrix, audit)
    names = windows.feature_names(matrix)
    matrix = scaling.sanitise(matrix, names)
    medians, scaler = scaling.medians(matrix, names), scaling.fit_scaler(matrix, names)
    scaled = scaling.apply_scaler(matrix, scaler)
    if t.training.augmentation_enabled:
        scaled = scaling.augment(scaled, names, t.training.synthetic_fraction, t.training.noise_scale, t.training.seed)
    scaled = scaled.persist()
    base = scaling.baseline(scaled, names)
    univariate = detectors.fit_univariate(scaled, names)
    thresholds = detectors.likelihood_thresholds(scaled, univariate, t.sentinel.percentile)
    blocks = projection.fit_blocks(scaled, shares=t.projection.family_variance) if t.projection.blocked else projection.fit_global(scaled, names, t.projection.variance)
    points = projection.project(scaled, blocks).select("coords").persist()
    neighbours = detectors.fit_neighbours(points, t.neighbours.k, t.neighbours.percentiles)
    k = t.mixture.components
    if t.mixture.adaptive:
        k, _ = detectors.choose_components(points, t.mixture.most_components, reg=t.mixture.reg_covar, max_iter=t.mixture.max_iter)
    mixture = detectors.fit_mixture(points, k, t.mixture.reg_covar, t.mixture.max_iter, percentile=t.mixture.threshold_percentile)
    forest = detectors.fit_forest(points, t.forest.trees, t.forest.sample, t.forest.contamination, t.training.seed)
    scored = points.select((detectors.neighbour_distance(neighbours)("coords") / F.lit(neighbours.p99)).alias("b"), detectors.forest_score(forest)("coords").alias("i"))
    row = scored.agg(F.min("b"), F.max("b"), F.min("i"), F.max("i")).first()
    bounds = {"balltree_score": (row[0], row[1]), "iforest_score": (row[2], row[3])}
    metadata = {
        "training_date": datetime.now(UTC).isoformat(), "source": source, "aggregated_windows": n, "feature_count": len(names), "training_duration_sec": time.time() - began, "per_feature_ll_thresholds": thresholds,
        "training_stats": {"dimensions": sum(len(b.loadings) for b in blocks), "balltree_training_p99_distance": neighbours.p99, "gmm_components": k}, "config": json.loads(json.dumps(asdict(t))),
    }
    for df in (points, scaled, cached):
        df.unpersist()
    return Bundle(names, protocols, scaler, medians, base, blocks, neighbours, mixture, forest, univariate, thresholds, bounds, metadata)


def detect(packets: DataFrame, bundle: Bundle, settings: Settings = Settings(), frozen: bool = False) -> DataFrame:
    """Results for each window of the packets; nothing is fitted. frozen takes the training's extremes instead of the batch's."""
    return detect_matrix(windows.window_features(packets, bundle.protocols), bundle, settings, frozen)


def detect_matrix(matrix: DataFrame, bundle: Bundle, settings: Settings = Settings(), frozen: bool = False) -> DataFrame:
    """The same for a matrix of windows. It must have all features of the bundle but for rates of change."""
    t = settings
    if missing := sorted(set(bundle.features) - set(VELOCITY_FEATURES) - set(matrix.columns)):
        raise DetectionError(f"the windows lack features of the bundle: {', '.join(missing)}")
    keep = ("capture_id", "bucket", "_abs_timestamp", "server_port")
    df = scaling.apply_scaler(scaling.align_schema(matrix, bundle.features, bundle.medians, keep), bundle.scaler)
    df = projection.project(df, bundle.blocks)
    distance = detectors.neighbour_distance(bundle.neighbours)
    p = bundle.neighbours.percentiles
    p90, p95, p99, p999 = (p[x] for x in sorted(p))
    df = df.withColumn("__d", distance("coords")).withColumn("balltree_score", F.col("__d") / F.lit(bundle.neighbours.p99))
    df = df.withColumn("balltree_severity", detectors.neighbour_severity(F.col("__d"), p90, p95, p99, p999, t.neighbours.slack))
    score, bypass, severity, culprit = detectors.velocity_bypass(df.columns if t.velocity.enabled else [], t.velocity.bypass_threshold)
    df = df.withColumn("vel_score", score).withColumn("vel_bypass", bypass).withColumn("vel_severity", severity).withColumn("vel_culprit", culprit)
    # The second tier counts for suspects alone. It scores all windows in the one pass: there are few of these against
    # packets, and a branch for suspects would read and aggregate the packets twice.
    m = bundle.mixture
    doubtful = decisions.suspect(F.col("balltree_severity"), F.col("vel_bypass"))
    df = df.withColumn("__ll", detectors.log_likelihood(m)("coords")).withColumn("__if", detectors.forest_score(bundle.forest)("coords"))
    gmm = decisions.squash(-F.col("__ll"), m.ll_mean, m.ll_std, t.mixture.normalization if t.mixture.normalization != "minmax" else "cdf")
    low, high = bundle.bounds.get("iforest_score", (0.0, 1.0))
    forest = F.least(F.greatest((F.col("__if") - low) / F.lit(max(high - low, 1e-10)), F.lit(0.0)), F.lit(1.0))
    df = df.withColumn("gmm_score", F.when(doubtful, gmm).otherwise(0.0)).withColumn("gmm_anomaly", (doubtful & (-F.col("__ll") > F.lit(m.threshold))).cast("int"))
    df = df.withColumn("iforest_score", F.when(doubtful, forest).otherwise(0.0)).withColumn("iforest_anomaly", (doubtful & (F.col("__if") > F.lit(bundle.forest.threshold))).cast("int"))
    df = df.drop("__ll", "__if").withColumn("consensus_votes", F.col("gmm_anomaly") + F.col("iforest_anomaly"))
    weights = decisions.normal_weights({"balltree": t.tribunal.balltree, "gmm": t.tribunal.gmm, "iforest": t.tribunal.iforest})
    agreed = decisions.squash(F.col("gmm_score"), m.ll_mean, m.ll_std)
    df = df.withColumn("consensus", decisions.weighted_consensus(weights, agreed, bundle.bounds if frozen else None))
    if t.sentinel.enabled and bundle.univariate:
        vote, _ = detectors.sentinel_vote(bundle.univariate, bundle.thresholds, F.col("balltree_severity"))
    else:
        vote = F.lit(0)
    family = detectors.family_consensus(bundle.base, bundle.features, t.family_consensus.z_threshold, t.family_consensus.min_hits) if t.family_consensus.enabled else F.lit("disabled")
    df = df.withColumn("phys_vote", vote).withColumn("family_consensus", family)
    flag, severity, named = decisions.decide(t.tribunal.threshold, t.tribunal.weighted, t.tribunal.votes)
    df = df.withColumn("is_anomaly", flag).withColumn("severity", severity).withColumn("family_consensus", named)
    df = decisions.persist(df, t.persistence.filter_window)
    if t.sentinel.enabled:
        df = decisions.hysteresis(df, p95 / bundle.neighbours.p99, t.persistence.alert_minimum, t.persistence.entry_multiplier, t.persistence.exit_multiplier)
        df = df.withColumn("is_anomaly", F.when(F.col("vel_bypass"), 1).otherwise(F.col("stable"))).withColumn("severity", decisions.fix_severity(F.col("is_anomaly"), F.col("severity"))).drop("stable")
    df = df.withColumn("anomaly_ma_score", decisions.moving_average(t.persistence.ma_window)).withColumn("is_warmup", decisions.is_warmup(t.persistence.ma_window, t.persistence.warmup_multiplier))
    shown = (F.col("is_anomaly") == 1) | (F.col("balltree_severity") >= 0.5)
    df = df.withColumn("persistence", F.when(shown, decisions.persistence_label(F.col("balltree_score"), F.col("anomaly_ma_score"), t.persistence.transient_threshold)))
    likelihoods = {n: detectors.univariate_likelihood(F.col(n).cast("double"), p) for n, p in bundle.univariate.items()}
    df = attribution.culprit(df, bundle.base, bundle.features, likelihoods)
    parts = [(n, F.col("coords")[i]) for i, (n, _) in enumerate(projection.components(bundle.blocks))]
    component, deviation = attribution.component_culprit(parts)
    df = df.withColumn("culprit_component", F.when(shown, component)).withColumn("culprit_deviation", F.when(shown, deviation).otherwise(0.0)).withColumn("physical_culprit", F.when(shown, F.col("physical_culprit")))
    suspects = {n: projection.suspects(bundle.blocks, i, t.forensic.top_features) for i, (n, _) in enumerate(parts)}
    df = df.withColumn("forensic_evidence", F.when(shown, attribution.evidence(suspects, t.velocity.bypass_threshold)))
    forced = decisions.veto(F.col("culprit_deviation"), F.col("balltree_severity"), F.col("consensus_votes"), t.sentinel.veto_sigma)
    df = df.withColumn("severity", F.when(forced, 3.0).otherwise(F.col("severity"))).withColumn("is_anomaly", F.when(forced, 1).otherwise(F.col("is_anomaly")))
    df = df.withColumn("severity", F.when((F.col("is_anomaly") == 1) & (F.col("severity") == 0), 1.0).otherwise(F.col("severity")))
    df = df.withColumn("soft_zone_triggered", F.col("balltree_severity") == 0.5)
    return df.drop("coords", "__d", *bundle.features)


def detection_summary(results: DataFrame, seconds: float) -> dict:
    row = results.agg(F.count("*"), F.count_if(F.col("is_anomaly") == 1), F.count_if(F.col("severity") >= 3), F.count_if("soft_zone_triggered")).first()
    return {"windows": row[0], "anomalies": row[1], "critical": row[2], "soft_zone": row[3], "anomaly_rate": row[1] / row[0] if row[0] else 0.0, "duration_sec": seconds, "windows_per_sec": row[0] / seconds if seconds else 0.0}


def report(results: DataFrame, settings: Settings = Settings()) -> dict[str, DataFrame]:
    """The tables of a report."""
    f = settings.forensic
    df = incidents.timeline(results)
    rows = staged(incidents.cluster(incidents.anomalies(df), f.debounce_seconds), "report-rows")  # most tables read them
    found = incidents.incidents(rows)
    shown = incidents.reportable(found, f.confidence, f.min_anomalies, f.min_duration_seconds, f.sigma_min)
    return {
        "summary": incidents.summary(df, rows, found, shown), "incidents": found, "reportable": shown, "tiers": incidents.tier_evidence(found), "features": incidents.top_features(rows, f.top_features),
        "ports": incidents.top_ports(rows), "stress": incidents.family_stress(rows), "families": incidents.family_distribution(rows), "threats": incidents.threat_distribution(rows),
        "techniques": incidents.techniques(rows), "persistence": incidents.most_frequent(rows, "persistence").drop("times") if "persistence" in rows.columns else found.select("capture_id", "incident_id", F.lit(None).cast("string").alias("persistence")), "drops": incidents.data_drops(df, found, f.drop_threshold_seconds), "radar": incidents.family_radar(incidents.family_stress(rows), rows), "timeline": df.select("capture_id", "ts", "balltree_score", "severity", "is_anomaly"),
    }


SEVERITY = {1: "low", 2: "high", 3: "critical"}


def _shown(v) -> str:
    if isinstance(v, datetime):
        return v.strftime("%Y-%m-%d %H:%M:%S")
    return "-" if v is None else f"{v:.4f}" if isinstance(v, float) else str(v).replace("|", "\\|")


def _grid(names: list[str], rows) -> Iterator[str]:
    yield "| " + " | ".join(names) + " |"
    yield "|" + "---|" * len(names)
    for r in rows:
        yield "| " + " | ".join(map(_shown, r)) + " |"
    yield ""


def lines(tables: dict[str, DataFrame], settings: Settings = Settings()) -> Iterator[str]:
    """The report's lines: parameters, totals, families, each reportable incident in turn, data drops. Rows are streamed,
    all of them."""
    f = settings.forensic
    yield from ("# Telemetry anomaly report", "", f"Generated {datetime.now(UTC):%Y-%m-%d %H:%M:%S} UTC", "")
    span = tables["timeline"].agg(F.min("ts"), F.max("ts")).first()
    yield from (f"Windows from {_shown(span[0])} to {_shown(span[1])}", "", "## Parameters", "")
    parameters = [("debounce (s)", f.debounce_seconds), ("data drop from (s)", f.drop_threshold_seconds), ("least confidence", f.confidence), ("least anomalies", f.min_anomalies), ("least duration (s)", f.min_duration_seconds), ("least mean sigma", f.sigma_min)]
    yield from _grid(["parameter", "value"], parameters)
    yield from ("## Summary", "")
    totals = tables["summary"].first().asDict()
    worst = tables["incidents"].agg(F.max("max_severity"), F.avg("max_severity"), F.avg("duration")).first()
    yield from (f"- {k}: {_shown(v)}" for k, v in totals.items())
    if worst[0] is not None:
        yield from (f"- largest severity: {worst[0]:g} of 3 ({SEVERITY.get(int(worst[0]), 'none')})", f"- mean severity: {worst[1]:.2f}", f"- mean duration: {worst[2]:.1f} s")
    yield from (f"- data drops: {tables['drops'].count()}", "", "## Families", "")
    yield from _grid(["family", "anomalies", "share"], tables["families"].select("family", "n", "share").orderBy(F.desc("n"), "family").collect())
    yield from _grid(["axis", "family", "part of the stress"], tables["radar"].orderBy("axis").collect())  # six rows
    yield from ("## Incidents", "")
    none = True
    for r in _sections(tables).toLocalIterator():
        none = False
        yield from (f"### {r.capture_id}, incident {r.incident_id + 1}", "")
        facts = [("start", r.start_time), ("end", r.end_time), ("duration (s)", r.duration), ("anomalous windows", r.n), ("severity", f"{r.max_severity:g} of 3, {SEVERITY.get(int(r.max_severity), 'none')}"), ("severity score", r.severity_score), ("confidence", r.confidence), ("persistence", r.persistence), ("ports", ", ".join(map(str, r.ports or [])) or None), ("warm-up", "yes" if r.is_warmup else "no")]
        yield from _grid(["field", "value"], facts)
        yield from _grid(["tier", "fired", "times", "mean score"], [tuple(t)[1:] for t in r.tiers or []])
        if r.features:
            yield from _grid(["rank", "feature", "family", "event", "largest sigma", "largest per cent", "loading"], r.features)
        by_tactic: dict[str, list[str]] = {}
        for t in r.techniques or []:
            by_tactic.setdefault(t.tactic, []).append(t.technique)
        yield from (f"- {tactic}: {', '.join(names)}" for tactic, names in by_tactic.items())
        yield ""
    if none:
        yield from ("None.", "")
    yield from ("## Data drops", "")
    yield from _grid(["capture", "start", "end", "gap (s)", "severity before", "reason"], (tuple(r) for r in tables["drops"].orderBy("start_time", "capture_id").select("capture_id", "start_time", "end_time", "gap_seconds", "severity_before", "reason").toLocalIterator()))


def _sections(tables: dict[str, DataFrame]) -> DataFrame:
    """A row for each reportable incident with all that its section tells: a few entries of each table."""
    keys = ["capture_id", "incident_id"]

    def listed(name: str, fields: list[str], out: str) -> DataFrame:
        return tables[name].groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct(*fields))).alias(out))

    order = F.create_map(*[x for i, t in enumerate(incidents.TIERS) for x in (F.lit(t), F.lit(i))])
    tiers = tables["tiers"].withColumn("place", order[F.col("tier")]).groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("place", "tier", "fired", "fire_count", "mean_score"))).alias("tiers"))
    ports = listed("ports", ["rank", "server_port"], "p").select(*keys, F.transform("p", lambda x: x.server_port).alias("ports"))
    df = tables["reportable"].join(tables["persistence"], keys, "left").join(tiers, keys, "left").join(ports, keys, "left")
    df = df.join(listed("features", ["rank", "feature", "family", "event_type", "max_sigma", "max_pct", "loading"], "features"), keys, "left")
    return df.join(listed("techniques", ["tactic", "technique"], "techniques"), keys, "left").orderBy("start_time", *keys)


def markdown(tables: dict[str, DataFrame], settings: Settings = Settings()) -> str:
    return "\n".join(lines(tables, settings)) + "\n"


def pdf(tables: dict[str, DataFrame], path: str, settings: Settings = Settings()) -> bool:
    """The report as PDF; where the library for that is absent, a message and False."""
    if importlib.util.find_spec("reportlab") is None:
        logging.getLogger(__name__).warning("no PDF at %s: reportlab isn't installed", path)
        return False
    from reportlab.lib.styles import getSampleStyleSheet
    from reportlab.platypus import Preformatted, SimpleDocTemplate

    style = getSampleStyleSheet()["Code"]
    SimpleDocTemplate(path).build([Preformatted(line or " ", style) for line in lines(tables, settings)])
    return True


def run(spark: SparkSession, packets: DataFrame, bundle: Bundle, out: str, settings: Settings = Settings()) -> dict:
    """Detection, its results and the report, written below a folder."""
    began = time.time()
    write_results(detect(packets, bundle, settings), f"{out}/results.parquet")
    results = spark.read.parquet(f"{out}/results.parquet")
    summary = detection_summary(results, time.time() - began)
    write_json(spark, f"{out}/summary", summary)
    spark.createDataFrame([(line,) for line in lines(report(results, settings), settings)], "value string").coalesce(1).write.mode("overwrite").text(f"{out}/report")
    return summary
