"""Gravity model of flows by Poisson pseudo-likelihood, with effects of origins and destinations that are never dummies.

flow = exp(origin effect + destination effect + features x coefficients). At given coefficients the effects follow from
balancing rows and columns in turn; Newton steps for the coefficients use the features less their weighted row and column
means, found by the same turns. Effects are tables joined on their keys; only K x K sums reach the driver.
"""

from __future__ import annotations

from functools import reduce
from typing import NamedTuple

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut, join_unique


class Gravity(NamedTuple):
    features: list[str]
    coefficients: np.ndarray
    errors: np.ndarray
    rounds: int
    fitted: DataFrame  # the flows with `fitted`


def _sum(parts: list[Column]) -> Column:
    return reduce(lambda a, b: a + b, parts)


class _Flows:
    """Flows on storage with a table for each side: its effects (e) and the weighted means (a0, ...) of the features there."""

    def __init__(self, flows: DataFrame, k: int, near: float, turns: int):
        self.flows, self.k, self.near, self.turns = flows, k, near, turns
        self.rows = flows.count()
        self.scale = [x or 1.0 for x in flows.agg(*[F.max(F.abs(f"_x{i}")) for i in range(k)]).first()]
        self.sides = {"_d": cut(flows.select("_d").distinct().select("_d", F.lit(0.0).alias("e_d"), *[F.lit(0.0).alias(f"a{i}_d") for i in range(k)]), "effects")}

    def beside(self, *sides: str) -> DataFrame:
        out = self.flows
        for side in sides:
            out = join_unique(out, self.sides[side], [side], rows=self.rows)
        return out

    def pull(self, beta: np.ndarray) -> Column:
        return _sum([F.col(f"_x{i}") * F.lit(float(beta[i])) for i in range(self.k)])

    def balance(self, beta: np.ndarray) -> None:
        """Effects under which fitted row and column sums equal those of the flows, and means that leave features without row and column means.

        What a side gets depends on the other side's table only: its own effect is in all of its weights alike.
        """
        for _ in range(self.turns):
            for side, other in (("_o", "_d"), ("_d", "_o")):
                last = self.sides.get(side)
                w = F.exp(F.col(f"e{other}") + self.pull(beta))
                means = [(F.sum(w * (F.col(f"_x{i}") - F.col(f"a{i}{other}"))) / F.sum(w)).alias(f"a{i}{side}") for i in range(self.k)]
                self.sides[side] = cut(self.beside(other).groupBy(side).agg(F.log(F.sum("_y") / F.sum(w)).alias(f"e{side}"), *means), "effects")
            names = ["e_d", *[f"a{i}_d" for i in range(self.k)]]
            moved = last.select("_d", *[F.col(n).alias(f"_{n}") for n in names]).join(self.sides["_d"], "_d").agg(*[F.max(F.abs(F.col(n) - F.col(f"_{n}"))) for n in names]).first()
            if moved[0] is None or all(x <= self.near * s for x, s in zip(moved, [1.0, *self.scale])):
                return
        raise RuntimeError(f"rows and columns did not balance in {self.turns} turns")

    def fitted(self, beta: np.ndarray) -> DataFrame:
        """Flows with `_m` (fitted) and the features less their row and column means (_r0, ...)."""
        d = self.beside("_o", "_d").withColumn("_m", F.exp(F.col("e_o") + F.col("e_d") + self.pull(beta)))
        return d.withColumns({f"_r{i}": F.col(f"_x{i}") - F.col(f"a{i}_o") - F.col(f"a{i}_d") for i in range(self.k)})


def fit_gravity(df: DataFrame, origin: str, destination: str, flow: str, features: list[str], near: float = 1e-9, rounds: int = 25, turns: int = 200) -> Gravity:
    """Coefficients and fitted flows (PLN-3); fitted flows sum to the flows by origin and by destination.

    Rows with a null in a key, the flow or a feature are left out. Origins and destinations without any flow have fitted
    flows of 0 and tell nothing, so their rows don't take part in the fit. A negative flow raises an error.
    """
    k = len(features)
    names = {origin: "_o", destination: "_d", flow: "_y"}
    d = df.dropna(subset=[origin, destination, flow, *features]).select(*[F.col(a).alias(b) for a, b in names.items()], *[F.col(f).cast("double").alias(f"_x{i}") for i, f in enumerate(features)])
    y = F.col("_y").cast("double")
    d = cut(d.withColumn("_y", F.when(y < 0, F.raise_error(F.lit("negative flow"))).otherwise(y)), "flows")
    for side in ("_o", "_d"):
        d = d.join(d.groupBy(side).agg(F.sum("_y").alias("_t")).filter("_t > 0").select(side), side, "left_semi")
    state = _Flows(cut(d, "flows"), k, near, turns)
    beta = np.zeros(k)
    for done in range(1, rounds + 1):
        state.balance(beta)
        held = state.fitted(beta)
        pairs = [(i, j) for i in range(k) for j in range(i + 1)]
        row = held.agg(*[F.sum((F.col("_y") - F.col("_m")) * F.col(f"_r{i}")).alias(f"g{i}") for i in range(k)], *[F.sum(F.col("_m") * F.col(f"_r{i}") * F.col(f"_r{j}")).alias(f"h{i}_{j}") for i, j in pairs]).first()
        if row["g0"] is None:
            raise ValueError("no flows")
        h = np.zeros((k, k))
        for i, j in pairs:
            h[i, j] = h[j, i] = row[f"h{i}_{j}"]
        move = np.linalg.solve(h, np.array([row[f"g{i}"] for i in range(k)]))
        if np.abs(move).max() <= near * (1 + np.abs(beta).max()):
            fitted = held.select(*[F.col(b).alias(a) for a, b in names.items()], *[F.col(f"_x{i}").alias(f) for i, f in enumerate(features)], F.col("_m").alias("fitted"))
            return Gravity(features, beta, np.sqrt(np.diag(np.linalg.inv(h))), done, fitted)
        beta = beta + move
    raise RuntimeError(f"coefficients did not settle in {rounds} steps")


def coefficients(spark, fit: Gravity) -> DataFrame:
    """feature, coefficient, std_error (of a Poisson model)."""
    rows = [(f, float(b), float(e)) for f, b, e in zip(fit.features, fit.coefficients, fit.errors)]
    return spark.createDataFrame(rows, "feature string, coefficient double, std_error double")
