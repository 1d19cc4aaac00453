"""Conditional logit on counts within strata: how often each candidate of a stratum was chosen."""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut, join_unique


class Choice(NamedTuple):
    features: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    log_likelihood: float
    null_log_likelihood: float
    rounds: int


def _utility(features: list[str], beta) -> Column:
    return reduce(lambda a, b: a + b, [F.col(f).cast("double") * F.lit(float(b)) for f, b in zip(features, beta)])


def log_likelihood(df: DataFrame, stratum: str, count: str, features: list[str], beta: list[float]) -> DataFrame:
    """One row: strata, choices, log_likelihood at the given coefficients (PLN-2).

    The largest utility of each stratum is taken off first, so no exponential overflows.
    """
    d = df.select(stratum, F.coalesce(F.col(count).cast("double"), F.lit(0.0)).alias("_n"), _utility(features, beta).alias("_u"))
    top = d.groupBy(stratum).agg(F.max("_u").alias("_top"))
    by = join_unique(d, top, [stratum]).groupBy(stratum).agg(F.sum("_n").alias("_all"), F.sum(F.col("_n") * (F.col("_u") - F.col("_top"))).alias("_own"), F.sum(F.exp(F.col("_u") - F.col("_top"))).alias("_e"))
    return by.agg(F.count("*").alias("strata"), F.sum("_all").alias("choices"), F.sum(F.col("_own") - F.col("_all") * F.log("_e")).alias("log_likelihood"))


def shares(df: DataFrame, stratum: str, features: list[str], beta: list[float], out: str = "share") -> DataFrame:
    """df with each candidate's probability within its stratum."""
    d = df.withColumn("_u", _utility(features, beta))
    top = d.groupBy(stratum).agg(F.max("_u").alias("_top"))
    e = join_unique(d, top, [stratum]).withColumn("_e", F.exp(F.col("_u") - F.col("_top")))
    return join_unique(e, e.groupBy(stratum).agg(F.sum("_e").alias("_all")), [stratum]).withColumn(out, F.col("_e") / F.col("_all")).select(*df.columns, out)


def _step(centred: DataFrame, k: int, beta: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Log-likelihood, gradient and information at beta: sums within strata, then one row of sums over them."""
    x = [F.col(f"_x{i}") for i in range(k)]
    e = F.exp(reduce(lambda a, b: a + b, [x[i] * F.lit(float(beta[i])) for i in range(k)]))
    pairs = [(i, j) for i in range(k) for j in range(i + 1)]
    sums = [F.sum("_n").alias("n"), F.sum(e).alias("e"), *[F.sum(F.col("_n") * x[i]).alias(f"c{i}") for i in range(k)], *[F.sum(e * x[i]).alias(f"x{i}") for i in range(k)], *[F.sum(e * x[i] * x[j]).alias(f"q{i}_{j}") for i, j in pairs]]
    mean = lambda c: F.col(c) / F.col("e")
    own = reduce(lambda a, b: a + b, [F.col(f"c{i}") * F.lit(float(beta[i])) for i in range(k)])
    total = [F.sum(own - F.col("n") * F.log("e")).alias("l"), *[F.sum(F.col(f"c{i}") - F.col("n") * mean(f"x{i}")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("n") * (mean(f"q{i}_{j}") - mean(f"x{i}") * mean(f"x{j}"))).alias(f"h{i}_{j}") for i, j in pairs]]
    row = centred.groupBy("_s").agg(*sums).filter("n > 0").agg(*total).first()
    value = lambda c: np.nan if row[c] is None else row[c]
    h = np.zeros((k, k))
    for i, j in pairs:
        h[i, j] = h[j, i] = value(f"h{i}_{j}")
    return value("l"), np.array([value(f"g{i}") for i in range(k)]), h


def fit_choice(df: DataFrame, stratum: str, count: str, features: list[str], near: float = 1e-9, rounds: int = 40) -> Choice:
    """Newton's method; each step is one aggregation by stratum and K x K numbers on the driver (PLN-2).

    Rows without a stratum or a feature are left out, null counts are 0, strata without choices tell nothing. Features are
    centred within strata first, which leaves the model as it is. A step that lowers the likelihood is halved. Raises where
    it doesn't settle (one feature that separates the chosen from the rest) or a feature has no spread within strata.
    """
    k = len(features)
    d = cut(df.dropna(subset=[stratum, *features]).select(F.col(stratum).alias("_s"), F.coalesce(F.col(count).cast("double"), F.lit(0.0)).alias("_n"), *[F.col(f).cast("double").alias(f"_f{i}") for i, f in enumerate(features)]), "choices")
    means = d.groupBy("_s").agg(*[F.avg(f"_f{i}").alias(f"_m{i}") for i in range(k)])
    centred = cut(join_unique(d, means, ["_s"]).select("_s", "_n", *[(F.col(f"_f{i}") - F.col(f"_m{i}")).alias(f"_x{i}") for i in range(k)]), "choices")
    beta = np.zeros(k)
    best, gradient, information = _step(centred, k, beta)
    start = best
    for done in range(1, rounds + 1):
        move = np.linalg.solve(information, gradient)
        if not np.isfinite(move).all():
            raise ValueError("no coefficients: a feature has no spread within strata")
        value, g, h = _step(centred, k, beta + move)
        for _ in range(30):
            if np.isfinite(value) and value >= best - 1e-9 * abs(best):
                break
            move = move / 2
            value, g, h = _step(centred, k, beta + move)
        beta, best, gradient, information = beta + move, value, g, h
        if np.abs(move).max() <= near * (1 + np.abs(beta).max()):
            return Choice(features, beta, np.sqrt(np.diag(np.linalg.inv(information))), best, start, done)
    raise RuntimeError(f"coefficients did not settle in {rounds} steps")


def coefficients(spark, fit: Choice) -> DataFrame:
    """feature, coefficient, std_error, z."""
    rows = [(f, float(b), float(e), float(b / e)) for f, b, e in zip(fit.features, fit.coefficients, fit.errors)]
    return spark.createDataFrame(rows, "feature string, coefficient double, std_error double, z double")
