"""Principal components by family, from one aggregation of products."""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.dimensions import FAMILY_VARIANCE, FEATURE_FAMILIES
from tidemark.functions.statistics import clip


def covariance(df: DataFrame, names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Means and population covariances; the driver receives only the sums."""
    pairs = [(i, j) for i in range(len(names)) for j in range(i, len(names))]
    row = df.agg(*[F.avg(n) for n in names], *[F.covar_pop(F.col(names[i]).cast("double"), F.col(names[j]).cast("double")) for i, j in pairs]).first()
    mean, cov = np.array([row[i] or 0.0 for i in range(len(names))], float), np.zeros((len(names), len(names)))
    for k, (i, j) in enumerate(pairs):
        cov[i, j] = cov[j, i] = row[len(names) + k] or 0.0
    return mean, cov


@dataclass(frozen=True)
class Block:
    family: str
    names: list[str]
    mean: list[float]
    scale: list[float]
    loadings: list[list[float]]
    variance: list[float]
    #: Of the global mode alone: bounds and Yeo-Johnson power of each feature, deviation of each component.
    low: list[float] = field(default_factory=list)
    high: list[float] = field(default_factory=list)
    powers: list[float] = field(default_factory=list)
    deviations: list[float] = field(default_factory=list)


def fit_block(df: DataFrame, family: str, names: list[str], share: float) -> Block:
    """Components of the standardised features that together explain more than the share of variance."""
    mean, cov = covariance(df, names)
    scale = np.sqrt(np.diag(cov))
    scale[scale == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(scale, scale))
    order = np.argsort(values)[::-1]
    values, vectors = np.maximum(values[order], 0), vectors[:, order]
    total = values.sum() or 1.0
    k = min(len(names), int(np.searchsorted(np.cumsum(values) / total, share, side="right")) + 1)
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(vectors.shape[1])])  # the largest loading is positive
    vectors = vectors * np.where(signs == 0, 1, signs)
    return Block(family, names, mean.tolist(), scale.tolist(), vectors[:, :k].T.tolist(), values[:k].tolist())


def fit_blocks(df: DataFrame, families: dict[str, list[str]] = FEATURE_FAMILIES, shares: dict[str, float] = FAMILY_VARIANCE) -> list[Block]:
    """A block for each family that has features in df."""
    own = {f: [n for n in names if n in df.columns] for f, names in families.items()}
    return [fit_block(df, f, names, shares.get(f, 0.99)) for f, names in own.items() if names]


def fit_global(df: DataFrame, names: list[str], share: float) -> list[Block]:
    """One block of all features: clipped to [0 or least, P99], made normal by Yeo-Johnson, standardised; components are whitened."""
    bounds = clip_bounds(df, names)
    clipped = df.select(*[clip(F.col(n).cast("double"), *bounds[n]).alias(n) for n in names]).persist()
    powers = yeo_johnson_powers(clipped, names)
    block = fit_block(clipped.mapInPandas(_transformed(powers), clipped.schema), "all", names, share)
    n = clipped.count()
    clipped.unpersist()
    deviations = np.sqrt(np.array(block.variance) * n / max(n - 1, 1))
    low, high = ([bounds[x][i] for x in names] for i in (0, 1))
    return [replace(block, low=low, high=high, powers=[powers[x] for x in names], deviations=np.where(deviations > 1e-12, deviations, 1.0).tolist())]


def _transformed(powers: dict[str, float]):
    def run(parts):
        for pdf in parts:
            yield pd.DataFrame({n: yeo_johnson(pdf[n].to_numpy(float), p) for n, p in powers.items()})

    return run


def clip_bounds(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    row = df.agg(*[F.min(n).alias(f"m_{n}") for n in names], *[F.percentile(F.col(n).cast("double"), F.lit(0.99)).alias(f"p_{n}") for n in names]).first()
    return {n: (0.0 if (row[f"m_{n}"] or 0.0) >= 0 else float(row[f"m_{n}"]), row[f"p_{n}"]) for n in names}


def yeo_johnson(x: np.ndarray, power: float) -> np.ndarray:
    q, plus, minus = 2 - power, np.maximum(x, 0), np.maximum(-x, 0)
    with np.errstate(over="ignore", invalid="ignore"):
        up = np.log1p(plus) if abs(power) < 1e-9 else np.expm1(power * np.log1p(plus)) / power
        down = -np.log1p(minus) if abs(q) < 1e-9 else -np.expm1(q * np.log1p(minus)) / q
    return np.where(x >= 0, up, down)


def _variances(df: DataFrame, grids: dict[str, list[float]]) -> dict[str, list[float]]:
    """The variance of each feature by each of its powers; partitions send counts, means and squares about these."""

    def run(parts):
        total: dict[tuple[str, int], tuple[float, float, float]] = {}
        for pdf in parts:
            for name, grid in grids.items():
                x = pdf[name].to_numpy(float)
                x = x[~np.isnan(x)]
                for i, p in enumerate(grid if len(x) else []):
                    y = yeo_johnson(x, p)
                    with np.errstate(over="ignore", invalid="ignore"):
                        total[name, i] = _merged(total.get((name, i), (0.0, 0.0, 0.0)), (float(len(y)), y.mean(), ((y - y.mean()) ** 2).sum()))
        yield pd.DataFrame([(n, i, *map(float, t)) for (n, i), t in total.items()], columns=["name", "i", "n", "mean", "squares"])

    sums: dict[tuple[str, int], tuple[float, float, float]] = {}
    for name, i, *t in map(tuple, df.select(*grids).mapInPandas(run, "name string, i int, n double, mean double, squares double").collect()):
        known = (math.inf if v is None else v for v in t)  # what overflows is NaN, and null in Arrow
        sums[name, i] = _merged(sums.get((name, i), (0.0, 0.0, 0.0)), tuple(known))
    return {name: [t[2] / t[0] if (t := sums.get((name, i))) else 0.0 for i in range(len(grid))] for name, grid in grids.items()}


def _merged(a: tuple, b: tuple) -> tuple:
    n, gap = a[0] + b[0], b[1] - a[1]
    return n, a[1] + gap * b[0] / n, a[2] + b[2] + gap * gap * a[0] * b[0] / n


def yeo_johnson_powers(df: DataFrame, names: list[str], rounds: int = 10, width: int = 9, farthest: float = 64.0) -> dict[str, float]:
    """The power of greatest likelihood of each feature; 1 for a constant one.

    Each round tries many for all features in one aggregation and closes in on the best, or moves on where that is at
    the edge of what has been tried.
    """
    spans = dict.fromkeys(names, (-3.0, 5.0))
    tried = dict(spans)
    closed = dict.fromkeys(names, 0)
    logs = {n: F.sum(F.signum(n) * F.log1p(F.abs(n))) for n in names}
    row = df.agg(*[F.count(n) for n in names], *logs.values(), *[F.var_pop(n) for n in names]).first()
    counts, sums, variances = (dict(zip(names, row[i * len(names) : (i + 1) * len(names)], strict=True)) for i in range(3))
    powers = {n: 1.0 for n in names if (variances[n] or 0.0) <= 1e-300}
    while left := [n for n in names if n not in powers]:
        grids = {n: np.linspace(*spans[n], width).tolist() for n in left}
        rows = _variances(df, grids)
        for n in left:
            found = rows[n]
            ok = [np.isfinite(v) and v >= np.finfo(float).tiny for v in found]
            likely = [-counts[n] / 2 * np.log(v) + (p - 1) * sums[n] if good else -np.inf for p, v, good in zip(grids[n], found, ok, strict=True)]
            best, grid = int(np.argmax(likely)), grids[n]
            size = grid[-1] - grid[0]
            if best == 0 and grid[0] <= tried[n][0] and grid[0] > -farthest:
                spans[n] = (grid[1] - size, grid[1])
            elif best == width - 1 and grid[-1] >= tried[n][1] and grid[-1] < farthest:
                spans[n] = (grid[-2], grid[-2] + size)
            else:
                spans[n] = (grid[max(0, best - 1)], grid[min(width - 1, best + 1)])
                closed[n] += 1
            tried[n] = (min(tried[n][0], spans[n][0]), max(tried[n][1], spans[n][1]))
            if closed[n] == rounds:
                powers[n] = grid[best]
    return powers


def _whole(b: Block) -> Column:
    """The components of the global mode as an array: an Arrow function, as an expression would repeat each feature many times."""
    low, high, mean, scale, deviations = (np.array(v, float) for v in (b.low, b.high, b.mean, b.scale, b.deviations))
    powers, loadings = b.powers, np.array(b.loadings, float).T

    @F.pandas_udf("array<double>")
    def run(features: pd.Series) -> pd.Series:
        if not len(features):
            return pd.Series([], dtype=object)
        x = np.clip(np.stack(features.to_numpy()).astype(float), low, high)
        z = (np.stack([yeo_johnson(x[:, i], p) for i, p in enumerate(powers)], 1) - mean) / scale
        out = np.nan_to_num(np.nan_to_num(z, nan=0.0, posinf=3.0, neginf=-3.0) @ loadings / deviations, nan=0.0, posinf=3.0, neginf=-3.0)
        return pd.Series(list(out))

    return run(F.array(*[F.coalesce(F.col(n).cast("double"), F.lit(float("nan"))) for n in b.names]))


def components(blocks: list[Block]) -> list[tuple[str, Column]]:
    """(name, expression) of each component, families in order."""
    out = []
    for b in blocks:
        whole = _whole(b) if b.powers else None
        for k, row in enumerate(b.loadings):
            if whole is not None:
                out.append((f"PC_{b.family}_{k + 1}", whole[k]))
                continue
            terms = [(F.col(n) - F.lit(m)) / F.lit(s) * F.lit(w) for n, m, s, w in zip(b.names, b.mean, b.scale, row, strict=True)]
            total = terms[0]
            for t in terms[1:]:
                total = total + t
            out.append((f"PC_{b.family}_{k + 1}", total))
    return out


def project(df: DataFrame, blocks: list[Block], name: str = "coords") -> DataFrame:
    whole = len(blocks) == 1 and blocks[0].powers
    return df.withColumn(name, _whole(blocks[0]) if whole else F.array(*[c for _, c in components(blocks)]))


def component_table(blocks: list[Block]) -> list[dict]:
    """For each component its family, place in it and loadings."""
    return [{"pc": f"PC_{b.family}_{k + 1}", "family": b.family, "local": k + 1, "loadings": dict(zip(b.names, row, strict=True))} for b in blocks for k, row in enumerate(b.loadings)]


def suspects(blocks: list[Block], index: int, n: int = 3) -> list[str]:
    """The features that load most on a component."""
    loadings = component_table(blocks)[index]["loadings"]
    return sorted(loadings, key=lambda f: -abs(loadings[f]))[:n]
