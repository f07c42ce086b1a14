"""Scaling by fitted parameters, schema alignment and baseline augmentation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.functions.statistics import finite


def scaled_names(names: list[str], compat: bool = True) -> list[str]:
    """Features that are scaled: those that aren't ratios. With compat any name holding the letters "ratio" counts as one."""
    return [n for n in names if not ("ratio" in n if compat else n.endswith("_ratio"))]


def quantiles(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float, float]]:
    """Exact quartiles of each column in one pass."""
    if not names:
        return {}
    row = df.agg(*[F.percentile(F.col(n).cast("double"), F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(n) for n in names]).first()
    return {n: tuple(row[n]) for n in names}


def fit_scaler(df: DataFrame, names: list[str], kind: str = "robust", compat: bool = True) -> dict[str, tuple[float, float]]:
    """(centre, scale) of each scaled feature; a scale of 0 becomes 1."""
    chosen = scaled_names(names, compat)
    if kind == "robust":
        return {n: (q[1], (q[2] - q[0]) or 1.0) for n, q in quantiles(df, chosen).items()}
    row = df.agg(*[F.avg(n).alias(f"a_{n}") for n in chosen], *[F.stddev_pop(n).alias(f"s_{n}") for n in chosen]).first()
    return {n: (row[f"a_{n}"], row[f"s_{n}"] or 1.0) for n in chosen}


def apply_scaler(df: DataFrame, scaler: dict[str, tuple[float, float]]) -> DataFrame:
    return df.select(*[((F.col(c) - F.lit(scaler[c][0])) / F.lit(scaler[c][1])).alias(c) if c in scaler else F.col(c) for c in df.columns])


def sanitise(df: DataFrame, names: list[str]) -> DataFrame:
    return df.select(*[finite(F.col(c).cast("double")).alias(c) if c in names else F.col(c) for c in df.columns])


def medians(df: DataFrame, names: list[str]) -> dict[str, float]:
    """Medians of the finite values."""
    ok = {n: F.when(~F.isnan(F.col(n).cast("double")) & (F.abs(F.col(n)) != float("inf")), F.col(n).cast("double")) for n in names}
    row = df.agg(*[F.percentile(v, F.lit(0.5)).alias(n) for n, v in ok.items()]).first()
    return {n: row[n] if row[n] is not None else 0.0 for n in names}


def align_schema(df: DataFrame, names: list[str], fill: dict[str, float], keep: tuple[str, ...] = ()) -> DataFrame:
    """The named features in order, missing ones as their fill (0 if it has none), and the kept columns; others go."""
    features = [F.col(n) if n in df.columns else F.lit(float(fill.get(n, 0.0))).alias(n) for n in names]
    return df.select(*[k for k in keep if k in df.columns], *features)


def baseline(df: DataFrame, names: list[str]) -> dict[str, tuple[float, float]]:
    """(mean, sample deviation) of each feature; a deviation of 0 becomes 1e-6."""
    row = df.agg(*[F.avg(n).alias(f"a_{n}") for n in names], *[F.stddev_samp(n).alias(f"s_{n}") for n in names]).first()
    return {n: (row[f"a_{n}"] or 0.0, row[f"s_{n}"] or 1e-6) for n in names}


def augment(df: DataFrame, names: list[str], fraction: float = 0.10, noise: float = 0.05, seed: int = 42) -> DataFrame:
    """df and a sample with replacement of it whose features carry normal noise in proportion to their deviation."""
    spread = baseline(df, names)
    extra = df.sample(withReplacement=True, fraction=fraction, seed=seed)
    noisy = [(F.col(c) + F.randn(seed + i) * F.lit(noise * spread[c][1])).alias(c) if c in names else F.col(c) for i, c in enumerate(df.columns)]
    return df.unionByName(extra.select(*noisy))
