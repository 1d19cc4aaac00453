"""Principal components of standardised columns, with the tests that tell whether a common score is justified."""

from __future__ import annotations

import math
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Factors(NamedTuple):
    columns: list[str]
    rows: int
    means: np.ndarray
    spreads: np.ndarray
    eigenvalues: np.ndarray  # falling
    vectors: np.ndarray  # a column each, the entry farthest from 0 positive
    kmo: float
    kmo_by_column: np.ndarray
    bartlett: float
    freedom: int
    p_value: float


def chi_square_tail(x: float, freedom: int) -> float:
    """P(X >= x) for a chi-square variable with whole degrees of freedom."""
    if x <= 0 or freedom < 1:
        return 1.0
    total = math.erfc(math.sqrt(x / 2)) if freedom % 2 else math.exp(-x / 2)
    for k in range(1 if freedom % 2 else 2, freedom, 2):
        total += math.exp(k / 2 * math.log(x / 2) - x / 2 - math.lgamma(k / 2 + 1))
    return min(1.0, total)


def fit_factors(df: DataFrame, columns: list[str]) -> Factors:
    """One aggregation of spreads and pairwise covariances over the rows without nulls; matrices as wide as the columns (PLN-2).

    A column without spread has correlation 0 with all others. The KMO measure compares correlations with partial
    ones; Bartlett's test asks whether the correlations are all 0. Linearly dependent columns make the test infinite.
    """
    k, d = len(columns), df.dropna(subset=columns)
    together = {(i, j): F.covar_pop(F.col(a).cast("double"), F.col(columns[j]).cast("double")).alias(f"c{i}_{j}") for i, a in enumerate(columns) for j in range(i)}
    row = d.agg(F.count("*").alias("n"), *[F.avg(c).cast("double").alias(f"m{i}") for i, c in enumerate(columns)], *[F.stddev_pop(c).alias(f"s{i}") for i, c in enumerate(columns)], *together.values()).first()
    r = np.eye(k)
    for i, j in together:
        spread = (row[f"s{i}"] or 0.0) * (row[f"s{j}"] or 0.0)
        r[i, j] = r[j, i] = row[f"c{i}_{j}"] / spread if spread > 0 else 0.0
    values, vectors = np.linalg.eigh(r)
    values, vectors = values[::-1], vectors[:, ::-1]
    vectors = vectors * np.sign(vectors[np.abs(np.round(vectors, 9)).argmax(0), np.arange(k)])
    inverse = np.linalg.pinv(r)
    partial = -inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(k, dtype=bool)
    r2, p2 = (r**2 * off).sum(0), (partial**2 * off).sum(0)
    sign, log_det = np.linalg.slogdet(r)
    freedom = k * (k - 1) // 2
    statistic = -(row["n"] - 1 - (2 * k + 5) / 6) * log_det if sign > 0 and values[-1] > 1e-12 else math.inf
    number = lambda c, i: np.nan if row[f"{c}{i}"] is None else row[f"{c}{i}"]
    with np.errstate(invalid="ignore", divide="ignore"):
        kmo, by_column = float(np.float64(r2.sum()) / (r2.sum() + p2.sum())), r2 / (r2 + p2)
    return Factors(columns, row["n"], np.array([number("m", i) for i in range(k)]), np.array([number("s", i) for i in range(k)]), values, vectors, kmo, by_column, statistic, freedom, chi_square_tail(statistic, freedom))


def loadings(spark, fit: Factors) -> DataFrame:
    """column, component (from 1), eigenvalue, explained (share of the variance), loading, kmo of the column."""
    k = len(fit.columns)
    rows = [(c, j + 1, float(fit.eigenvalues[j]), float(fit.eigenvalues[j] / k), float(fit.vectors[i, j] * math.sqrt(max(0.0, fit.eigenvalues[j]))), float(fit.kmo_by_column[i])) for i, c in enumerate(fit.columns) for j in range(k)]
    return spark.createDataFrame(rows, "column string, component int, eigenvalue double, explained double, loading double, kmo double")


def component_scores(df: DataFrame, fit: Factors, count: int = 1, prefix: str = "component_") -> DataFrame:
    """df with the scores of the first components; null where a column is."""
    z = [(F.col(c).cast("double") - float(m)) / float(s) if s > 0 else F.col(c).cast("double") * 0.0 for c, m, s in zip(fit.columns, fit.means, fit.spreads)]
    total = lambda j: sum((z[i] * float(fit.vectors[i, j]) for i in range(1, len(z))), z[0] * float(fit.vectors[0, j]))
    return df.withColumns({f"{prefix}{j + 1}": total(j) for j in range(count)})
