"""Detectors: neighbours, mixtures, forest, single features and rates of change.

Fitted parameters are small; fitting gathers sums or bounded samples, scoring is an expression or an Arrow function.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dimensions import CONSENSUS_FAMILIES, VELOCITY_FEATURES, VELOCITY_SEVERITIES
from tidemark.functions.statistics import clip, finite, top

#: Rows of a training matrix that trees draw their samples from; more rows are thinned by hash.
MOST_TRAINING_ROWS = 100_000


def matrix(df: DataFrame, name: str = "coords", most: int = MOST_TRAINING_ROWS) -> np.ndarray:
    """The training matrix on the driver, bounded: beyond the bound the rows with the least hashes."""
    n = df.count()
    if n > most:
        df = df.orderBy(F.xxhash64(name)).limit(most)
    return np.array([r[0] for r in df.select(name).collect()], float)


def all_rows(df: DataFrame, name: str = "coords") -> np.ndarray:
    """Every row of the training matrix, on the driver: 8 bytes a value."""
    column = df.select(F.col(name).cast("array<double>").alias(name)).toArrow().column(0).combine_chunks()
    values = column.flatten().to_numpy(zero_copy_only=False)
    if column.null_count or len(values) % max(len(column), 1) or (np.diff(column.offsets.to_numpy()) * len(column) != len(values)).any():
        raise ValueError(f"rows of {name} that are null or differ in length")
    return values.reshape(len(column), -1) if len(column) else np.zeros((0, 0))


# ---- neighbours ----


@dataclass(frozen=True)
class Neighbours:
    points: np.ndarray
    k: int
    percentiles: dict[float, float]

    @property
    def p99(self) -> float:
        return self.percentiles[99.0] if self.percentiles[99.0] > 1e-10 else 1.0


def mean_distances(points: np.ndarray, queries: np.ndarray, k: int, block: int = 256, width: int = 16_384) -> np.ndarray:
    """Mean distance to the neighbours 2 to k + 1; the nearest is taken for the point itself. The k + 1 nearest of each block of points are merged."""
    out = np.zeros(len(queries))
    for lo in range(0, len(queries), block):
        q = queries[lo : lo + block]
        near = np.zeros((len(q), 0))
        for at in range(0, len(points), width):
            part = points[at : at + width]
            d = np.sqrt(np.maximum(((q[:, None, :] - part[None, :, :]) ** 2).sum(-1), 0)) if len(part) * q.size < 5e7 else _distances(q, part)
            near = np.concatenate([near, np.partition(d, min(k, d.shape[1] - 1), axis=1)[:, : k + 1]], axis=1)
        out[lo : lo + block] = np.sort(near, axis=1)[:, 1 : k + 1].mean(1)
    return out


def _distances(q: np.ndarray, points: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((q**2).sum(1)[:, None] + (points**2).sum(1)[None, :] - 2 * q @ points.T, 0))


def fit_neighbours(df: DataFrame, k: int = 5, percentiles: tuple[float, ...] = (90.0, 95.0, 99.0, 99.9), name: str = "coords") -> Neighbours:
    """All rows are points, however many; their distances are searched on the executors."""
    model = Neighbours(all_rows(df, name), k, {})
    rows = df.select(name).repartition(df.sparkSession.sparkContext.defaultParallelism)
    row = rows.select(neighbour_distance(model)(name).alias("d")).agg(F.percentile("d", F.array(*[F.lit(p / 100) for p in percentiles]))).first()
    return Neighbours(model.points, k, dict(zip(percentiles, row[0], strict=True)))


def neighbour_distance(model: Neighbours) -> object:
    points, k = model.points, model.k

    @F.pandas_udf("double")
    def distance(coords: pd.Series) -> pd.Series:
        return pd.Series(mean_distances(points, np.stack(coords.to_numpy()).astype(float), k)) if len(coords) else pd.Series([], dtype=float)

    return distance


def neighbour_severity(distance: Column, p90: float, p95: float, p99: float, p999: float, slack: float = 1.2) -> Column:
    at = [p * slack for p in (p90, p95, p99, p999)]
    return F.when(distance > at[3], 3.0).when(distance > at[2], 2.0).when(distance > at[1], 1.0).when(distance > at[0], 0.5).otherwise(0.0)


# ---- mixtures ----


@dataclass(frozen=True)
class MixtureModel:
    weights: np.ndarray
    means: np.ndarray
    covariances: np.ndarray
    ll_mean: float = 0.0
    ll_std: float = 1.0
    threshold: float = 0.0
    likelihood: float = 0.0

    def densities(self, x: np.ndarray) -> np.ndarray:
        """log(weight * density) of each row and component."""
        out = np.empty((len(x), len(self.weights)))
        for k, (w, m, c) in enumerate(zip(self.weights, self.means, self.covariances, strict=True)):
            low = np.linalg.cholesky(c)
            z = np.linalg.solve(low, (x - m).T)
            out[:, k] = math.log(max(w, 1e-300)) - 0.5 * (z**2).sum(0) - np.log(np.diag(low)).sum() - 0.5 * x.shape[1] * math.log(2 * math.pi)
        return out

    def log_likelihood(self, x: np.ndarray) -> np.ndarray:
        return np.logaddexp.reduce(self.densities(x), axis=1)


def _partials(models: dict[int, MixtureModel], name: str):
    def run(parts):
        total: dict[int, np.ndarray] = {}
        for pdf in parts:
            if not len(pdf):
                continue
            x = np.stack(pdf[name].to_numpy()).astype(float)
            for k, model in models.items():
                logs = model.densities(x)
                ll = np.logaddexp.reduce(logs, axis=1)
                r = np.exp(logs - ll[:, None])
                stats = np.concatenate([[len(x), ll.sum()], r.sum(0), (r.T @ x).ravel(), np.einsum("nk,ni,nj->kij", r, x, x, optimize=True).ravel()])
                total[k] = total[k] + stats if k in total else stats
        for k, stats in total.items():
            yield pd.DataFrame({"k": k, "at": np.arange(len(stats)), "value": stats})

    return run


def maximise(df: DataFrame, ks: list[int], reg: float = 0.1, max_iter: int = 200, tolerance: float = 1e-3, prior: float = 1e-2, bayesian: bool = True, name: str = "coords") -> dict[int, MixtureModel]:
    """A mixture for each number of components: expectation on the executors, which send sums; maximisation on the driver.

    With bayesian, weights have a sparse prior. One job takes a step of all mixtures that have not converged.
    """
    own = None if df.is_cached else df.select(name).persist()
    df = df if own is None else own
    first = df.select(name).orderBy(F.xxhash64(name)).limit(max(max(ks) * 20, 200)).collect()
    sample = np.array([r[0] for r in first], float)
    d = sample.shape[1]
    models, before = {}, dict.fromkeys(ks, -math.inf)
    for k in ks:
        seed = sample[: max(k * 20, 200)]
        centres = [seed[0]]
        for _ in range(1, k):  # farthest-first, so that starts are spread and the same at every run
            gap = np.min([((seed - c) ** 2).sum(1) for c in centres], axis=0)
            centres.append(seed[int(gap.argmax())])
        models[k] = MixtureModel(np.full(k, 1 / k), np.array(centres), np.array([np.cov(seed.T).reshape(d, d) + reg * np.eye(d)] * k))
    live = set(ks)
    for _ in range(max_iter):
        steps = _partials({k: models[k] for k in sorted(live)}, name)
        rows = df.select(name).mapInPandas(steps, "k int, at int, value double").groupBy("k", "at").agg(F.sum("value").alias("value")).toPandas()
        for k, part in rows.groupby("k"):
            s = np.zeros(len(part))
            s[part["at"].to_numpy()] = part["value"].to_numpy()
            n, ll = s[0], s[1]
            nk = s[2 : 2 + k] + 1e-12
            sums, squares = s[2 + k : 2 + k + k * d].reshape(k, d), s[2 + k + k * d :].reshape(k, d, d)
            means = sums / nk[:, None]
            cov = squares / nk[:, None, None] - np.einsum("ki,kj->kij", means, means) + reg * np.eye(d)
            weights = np.maximum(nk + (prior - 1 / k if bayesian else 0), 1e-9)
            models[k] = MixtureModel(weights / weights.sum(), means, cov, likelihood=ll)
            if abs(ll / n - before[k]) < tolerance:
                live.discard(k)
            before[k] = ll / n
        if not live:
            break
    if own is not None:
        own.unpersist()
    return models


def fit_mixture(df: DataFrame, k: int, reg: float = 0.1, max_iter: int = 200, tolerance: float = 1e-3, prior: float = 1e-2, bayesian: bool = True, percentile: float = 99.9, name: str = "coords") -> MixtureModel:
    model = maximise(df, [k], reg, max_iter, tolerance, prior, bayesian, name)[k]
    scored = df.select(log_likelihood(model)(name).alias("ll"))
    row = scored.agg(F.avg("ll"), F.stddev_pop("ll"), F.percentile(-F.col("ll"), F.lit(percentile / 100))).first()
    return MixtureModel(model.weights, model.means, model.covariances, row[0], row[1] or 1e-10, row[2], model.likelihood)


def log_likelihood(model: MixtureModel):
    @F.pandas_udf("double")
    def score(coords: pd.Series) -> pd.Series:
        return pd.Series(model.log_likelihood(np.stack(coords.to_numpy()).astype(float))) if len(coords) else pd.Series([], dtype=float)

    return score


def information(model: MixtureModel, n: int) -> tuple[float, float]:
    """(BIC, AIC)."""
    k, d = model.means.shape
    free = k - 1 + k * d + k * d * (d + 1) / 2
    return -2 * model.likelihood + free * math.log(max(n, 2)), -2 * model.likelihood + 2 * free


def _shape(points: np.ndarray, model: MixtureModel) -> tuple[float, float]:
    """(silhouette by centres, Davies-Bouldin) of the bounded sample."""
    labels = model.densities(points).argmax(1)
    used = np.unique(labels)
    if len(used) < 2:
        return -1.0, 10.0
    centres = np.array([points[labels == u].mean(0) for u in used])
    d = _distances(points, centres)
    own = d[np.arange(len(points)), np.searchsorted(used, labels)]
    d[np.arange(len(points)), np.searchsorted(used, labels)] = np.inf
    other = d.min(1)
    spread = np.array([own[labels == u].mean() for u in used])
    gaps = _distances(centres, centres) + np.eye(len(used)) * 1e300
    return float(((other - own) / np.maximum(np.maximum(own, other), 1e-12)).mean()), float(((spread[:, None] + spread[None, :]) / np.maximum(gaps, 1e-12)).max(1).mean())


def choose_components(df: DataFrame, most: int = 25, name: str = "coords", **fit) -> tuple[int, list[dict]]:
    """The number of components by 0.40 BIC + 0.10 AIC + 0.25 silhouette + 0.25 Davies-Bouldin, each scaled to [0, 1]."""
    n = df.count()
    points = matrix(df, name, 2000)
    rows = []
    for k, model in maximise(df, list(range(2, max(2, min(most, n // 10 - 1)) + 1)), name=name, **fit).items():
        bic, aic = information(model, n)
        silhouette, db = _shape(points, model)
        rows.append({"k": k, "bic": float(bic), "aic": float(aic), "silhouette": silhouette, "davies_bouldin": db})

    def scaled(values):
        v = np.array(values, float)
        return (v - v.min()) / (v.max() - v.min()) if v.max() > v.min() else np.zeros(len(v))

    cost = 0.40 * scaled([r["bic"] for r in rows]) + 0.10 * scaled([r["aic"] for r in rows]) + 0.25 * scaled([-r["silhouette"] for r in rows]) + 0.25 * scaled([r["davies_bouldin"] for r in rows])
    for r, c in zip(rows, cost, strict=True):
        r["cost"] = float(c)
    return rows[int(cost.argmin())]["k"], rows


# ---- forest ----


def _grow(x: np.ndarray, rng: np.random.Generator, depth: int, nodes: list[tuple]) -> int:
    """Append the subtree of x to nodes as (feature, cut, left, right, size) and return its index."""
    at = len(nodes)
    nodes.append(None)
    spread = np.flatnonzero(x.max(0) > x.min(0)) if len(x) > 1 and depth > 0 else []
    if not len(spread):
        nodes[at] = (-1, 0.0, -1, -1, len(x))
        return at
    f = int(rng.choice(spread))
    cut = rng.uniform(x[:, f].min(), x[:, f].max())
    left = x[:, f] < cut
    nodes[at] = (f, cut, _grow(x[left], rng, depth - 1, nodes), _grow(x[~left], rng, depth - 1, nodes), len(x))
    return at


def average_path(n) -> np.ndarray:
    n = np.asarray(n, float)
    return np.where(n > 2, 2 * (np.log(np.maximum(n - 1, 1)) + 0.5772156649015329) - 2 * (n - 1) / np.maximum(n, 1), np.where(n == 2, 1.0, 0.0))


@dataclass(frozen=True)
class ForestModel:
    trees: list
    sample: int
    threshold: float = 0.5

    def score(self, x: np.ndarray) -> np.ndarray:
        depth = np.zeros(len(x))
        for feature, cut, left, right, size in self.trees:
            at, steps = np.zeros(len(x), int), np.zeros(len(x))
            live = np.arange(len(x))
            while len(live := live[feature[at[live]] >= 0]):
                f = feature[at[live]]
                at[live] = np.where(x[live, f] < cut[at[live]], left[at[live]], right[at[live]])
                steps[live] += 1
            depth += steps + average_path(size[at])
        return 2.0 ** (-(depth / len(self.trees)) / max(float(average_path(self.sample)), 1e-12))


def fit_forest(df: DataFrame, trees: int = 100, sample: int = 256, contamination: float = 0.05, seed: int = 42, name: str = "coords") -> ForestModel:
    points = matrix(df, name)
    rng = np.random.default_rng(seed)
    psi = min(sample, len(points))
    grown = []
    for _ in range(trees):
        nodes: list[tuple] = []
        _grow(points[rng.choice(len(points), psi, replace=False)], rng, math.ceil(math.log2(max(psi, 2))), nodes)
        grown.append(tuple(np.array(c) for c in zip(*nodes, strict=True)))
    model = ForestModel(grown, psi)
    threshold = df.select(forest_score(model)(name).alias("s")).agg(F.percentile("s", F.lit(1 - contamination))).first()[0]
    return ForestModel(grown, psi, threshold)


def forest_score(model: ForestModel):
    @F.pandas_udf("double")
    def score(coords: pd.Series) -> pd.Series:
        return pd.Series(model.score(np.stack(coords.to_numpy()).astype(float))) if len(coords) else pd.Series([], dtype=float)

    return score


# ---- single features ----


#: Distinct values of a feature beyond which these are binned.
BINS = 4096


def fit_univariate(df: DataFrame, names: list[str], most: int = 5, reg: float = 1e-6, iterations: int = 60) -> dict[str, dict]:
    """For each feature a mixture of 1 to most normals, by 0.5 BIC + 0.5 AIC; features that hardly vary have none."""
    span = df.agg(*[F.stddev_pop(F.col(n).cast("double")).alias(n) for n in names]).first()
    names = [n for n in names if (span[n] or 0.0) >= 1e-6]
    if not names:
        return {}
    parts = [F.struct(F.lit(n).alias("feature"), F.col(n).cast("double").alias("value")) for n in names]
    values = df.select(F.explode(F.array(*parts)).alias("p")).select("p.feature", "p.value").filter("value is not null")
    # Equal values count once with their number. A feature with more distinct ones than BINS is binned by its quantiles, and
    # a bin keeps its squares about its mean: no group grows with the input.
    values = values.groupBy("feature", "value").agg(F.count("*").alias("n")).persist()
    many = sorted(r.feature for r in values.groupBy("feature").count().filter(F.col("count") > BINS).select("feature").collect())
    shares = F.array(*[F.lit(i / BINS) for i in range(1, BINS)])
    cuts = df.agg(*[F.percentile_approx(F.col(n).cast("double"), shares, F.lit(20 * BINS)).alias(n) for n in many]).first().asDict() if many else {}
    edges = {n: np.unique(np.array(c, float)) for n, c in cuts.items()}

    def bin_of(pdf: pd.DataFrame) -> np.ndarray:
        out = np.zeros(len(pdf), np.int64)
        for name, of in edges.items():
            own = (pdf["feature"] == name).to_numpy()
            out[own] = np.searchsorted(of, pdf["value"].to_numpy(float)[own], side="left")
        return out

    def binned(parts):
        for pdf in parts:
            at = bin_of(pdf)
            low = np.array([edges[f][min(b, len(edges[f]) - 1)] for f, b in zip(pdf["feature"], at, strict=True)], float)
            yield pd.DataFrame({"feature": pdf["feature"], "bin": at, "n": pdf["n"], "low": low, "gap": pdf["value"].to_numpy(float) - low})

    few = values.filter(~F.col("feature").isin(many)).select("feature", "value", F.col("n").cast("double").alias("n"), F.lit(0.0).alias("inner"))
    bins = few
    if many:
        rows = values.filter(F.col("feature").isin(many)).mapInPandas(binned, "feature string, bin long, n long, low double, gap double")
        sums = rows.groupBy("feature", "bin", "low").agg(F.sum("n").cast("double").alias("n"), F.sum(F.col("n") * F.col("gap")).alias("s"), F.sum(F.col("n") * F.col("gap") * F.col("gap")).alias("q"))
        mean = F.col("s") / F.col("n")
        bins = few.unionByName(sums.select("feature", (F.col("low") + mean).alias("value"), "n", F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0)).alias("inner")))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        x, w, inner = pdf["value"].to_numpy(float), pdf["n"].to_numpy(float), pdf["inner"].to_numpy(float)[:, None]
        best = None
        for k in range(1, min(most, len(x)) + 1):
            order = np.argsort(x)
            cuts = np.searchsorted(np.cumsum(w[order]), w.sum() * (np.arange(k) + 0.5) / k)
            m = x[order][np.minimum(cuts, len(x) - 1)].copy()
            part = np.minimum((np.cumsum(w[order]) - w[order] / 2) / w.sum() * k, k - 1).astype(int)  # starts are as wide as their share of the values, not as all
            near = [((x[order] - m[part]) ** 2 + inner[order, 0])[part == i] for i in range(k)]
            v = np.array([max(np.average(d, weights=w[order][part == i]) if len(d) else 0.0, reg) for i, d in enumerate(near)])
            p = np.full(k, 1 / k)
            for _ in range(iterations):
                logs = np.log(p) - 0.5 * np.log(2 * np.pi * v) - ((x[:, None] - m) ** 2 + inner) / (2 * v)
                ll = np.logaddexp.reduce(logs, axis=1)
                r = np.exp(logs - ll[:, None]) * w[:, None]
                nk = r.sum(0) + 1e-12
                m, p = (r * x[:, None]).sum(0) / nk, nk / nk.sum()
                v = (r * ((x[:, None] - m) ** 2 + inner)).sum(0) / nk + reg
            total, free = float((ll * w).sum()), 3 * k - 1
            cost = 0.5 * (-2 * total + free * math.log(w.sum())) + 0.5 * (-2 * total + 2 * free)
            if best is None or cost < best[0]:
                best = (cost, k, p.tolist(), m.tolist(), v.tolist())
        return pd.DataFrame([{"feature": pdf["feature"].iloc[0], "k": best[1], "weights": best[2], "means": best[3], "variances": best[4]}])

    schema = "feature string, k int, weights array<double>, means array<double>, variances array<double>"
    found = bins.groupBy("feature").applyInPandas(fit, schema).collect()
    values.unpersist()
    return {r.feature: {"weights": list(r.weights), "means": list(r.means), "variances": list(r.variances)} for r in found}


def univariate_likelihood(x: Column, params: dict) -> Column:
    """Log likelihood as an expression: log of a sum, shifted by the largest term."""
    terms = [F.lit(math.log(max(w, 1e-300)) - 0.5 * math.log(2 * math.pi * v)) - (x - F.lit(m)) * (x - F.lit(m)) / F.lit(2 * v) for w, m, v in zip(params["weights"], params["means"], params["variances"], strict=True)]
    if len(terms) == 1:
        return terms[0]
    top = F.greatest(*terms)
    total = F.exp(terms[0] - top)
    for t in terms[1:]:
        total = total + F.exp(t - top)
    return top + F.log(total)


def likelihood_thresholds(df: DataFrame, params: dict[str, dict], percentile: float = 99.9) -> dict[str, float]:
    if not params:
        return {}
    row = df.agg(*[F.percentile(univariate_likelihood(F.col(n).cast("double"), p), F.lit(percentile / 100)).alias(n) for n, p in params.items()]).first()
    return {n: row[n] for n in params}


def sentinel_vote(params: dict[str, dict], thresholds: dict[str, float], severity: Column) -> tuple[Column, Column]:
    """(vote, feature): whether the least likely feature is below its threshold, in rows of some severity."""
    least = top([(-univariate_likelihood(F.col(n).cast("double"), p), {"name": F.lit(n), "bound": F.lit(float(thresholds[n]))}) for n, p in params.items()])
    vote = (severity > 0) & (-least["k"] < least["bound"])
    return F.coalesce(vote, F.lit(False)).cast("int"), F.when(vote, least["name"])


# ---- rates of change ----


def velocity_bypass(columns: list[str], threshold: float) -> tuple[Column, Column, Column, Column]:
    """(score, bypass, severity, culprit) of the rates of change; zeros where a column is missing."""
    if any(f not in columns for f in VELOCITY_FEATURES):
        return F.lit(0.0), F.lit(False), F.lit(0), F.lit("")
    z = {f: finite(F.col(f).cast("double")) for f in VELOCITY_FEATURES}
    most = top([(F.abs(v), {"name": F.lit(f), "signed": v}) for f, v in z.items()])
    name, best, signed = most["name"], most["k"], most["signed"]
    bypass = best >= threshold
    level = F.lit(1)
    for least, severity in sorted(VELOCITY_SEVERITIES):
        level = F.when(best >= least, severity).otherwise(level)
    return clip(best / F.lit(threshold), 0.0, 3.0), bypass, F.when(bypass, level).otherwise(0), F.when(bypass, F.format_string("%s(z=%+.2f)", name, signed)).otherwise("")


def family_consensus(base: dict[str, tuple[float, float]], columns: list[str], z_least: float = 2.0, min_hits: int = 2, families: dict = CONSENSUS_FAMILIES) -> Column:
    """The first family with enough members beyond the limit; a member is any feature whose name holds the pattern."""
    out = F.lit(None).cast("string")
    for family, patterns in reversed(families.items()):
        hits = F.lit(0)
        for p in patterns:
            own = [c for c in columns if p in c and c in base and base[c][1] >= 1e-10]
            if own:
                beyond = F.greatest(*[F.abs((F.col(c) - F.lit(base[c][0])) / F.lit(base[c][1])) for c in own], F.lit(0.0))
                hits = hits + (beyond >= z_least).cast("int")
        out = F.when(hits >= min_hits, family).otherwise(out)
    return out
