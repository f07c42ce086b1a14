"""Expressions that neither engine has built in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def normal_cdf(x: Column) -> Column:
    """The normal distribution by Abramowitz and Stegun 7.1.26, within 1.5e-7."""
    z = F.abs(x) / F.sqrt(F.lit(2.0))
    t = 1 / (1 + 0.3275911 * z)
    poly = ((((1.061405429 * t - 1.453152027) * t + 1.421413741) * t - 0.284496736) * t + 0.254829592) * t
    erf = 1 - poly * F.exp(-z * z)
    return F.when(x >= 0, 0.5 * (1 + erf)).otherwise(0.5 * (1 - erf))


NORMAL_CDF_SQL = (
    "(0.5 * (1 + sign({x}) * (1 - ((((1.061405429 * (1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0))) - 1.453152027) * (1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0))) + 1.421413741)"
    " * (1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0))) - 0.284496736) * (1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0))) + 0.254829592) * (1 / (1 + 0.3275911 * abs({x}) / sqrt(2.0)))"
    " * exp(-({x}) * ({x}) / 2))))"
)


def sample_skewness(x: str) -> Column:
    """Skewness corrected for bias; Spark's own is the population's."""
    n = F.count(x)
    return F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2)


def sample_kurtosis(x: str) -> Column:
    n = F.count(x)
    return (n - 1) / ((n - 2) * (n - 3)) * ((n + 1) * F.kurtosis(x) + 6)


def clip(x: Column, low: float, high: float) -> Column:
    return F.least(F.greatest(x, F.lit(low)), F.lit(high))


def finite(x: Column) -> Column:
    """The value, 0 for one that is missing or not finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), 0.0).otherwise(F.coalesce(x, F.lit(0.0)))


def top(items: list[tuple[Column, dict[str, Column]]]) -> Column:
    """The item of the greatest key as a struct of the key k and its fields; the first of equal keys. Grows with the items alone."""
    rows = [F.struct(key.cast("double").alias("k"), F.lit(-i).alias("o"), *[c.alias(n) for n, c in fields.items()]) for i, (key, fields) in enumerate(items)]
    return F.array_max(F.array(*rows))


def first_greatest(pairs: list[tuple[str, Column]]) -> tuple[Column, Column]:
    """(name, value) of the greatest value, the first of equals."""
    best = top([(v, {"name": F.lit(n)}) for n, v in pairs])
    return best["name"], best["k"]
