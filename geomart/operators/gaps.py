"""Expected against observed values: ridge from sufficient statistics, boosted trees, hold-outs, residual classes.

Ridge needs only sums of products. They are taken once per fold in one aggregation; a fold's training sums are the
totals less its own, so all hold-out fits together need two aggregations and matrices as wide as the features.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.codes import gap_direction
from ..functions.compat import exact_quantile, null_safe_join, regression_scores, zscore0


def one_hot(df: DataFrame, name: str, most: int = 1000) -> tuple[DataFrame, list[str]]:
    """df with a 0/1 column for each of a column's values, `most` at most, else an error; unseen values later are 0 in all."""
    values = [r[0] for r in df.select(name).distinct().orderBy(name).limit(most + 1).collect()]
    if len(values) > most:
        raise ValueError(f"{name} has more than {most} values")
    names = [f"{name}_is_{v}" for v in values]
    return df.withColumns({n: (F.col(name) == v).cast("double") for n, v in zip(names, values)}), names


def _sums(features: list[str], y: str) -> list[Column]:
    cols = [*[F.col(f).cast("double") for f in features], F.col(y).cast("double")]
    products = [F.sum(cols[i] * cols[j]).alias(f"s{i}_{j}") for i in range(len(cols)) for j in range(i, len(cols))]
    return [F.count("*").cast("double").alias("n"), *[F.sum(c).alias(f"m{i}") for i, c in enumerate(cols)], *products]


def solve_ridge(n: float, means: np.ndarray, products: np.ndarray, alpha: float, scaled: list[bool]) -> tuple[np.ndarray, float]:
    """Coefficients and intercept from sums; marked features are scaled to unit spread first, the intercept carries no penalty (ML-1, ML-2)."""
    m = means / n
    c = products - n * np.outer(m, m)
    k = len(m) - 1
    spread = np.array([np.sqrt(max(c[i, i] / n, 0.0)) if s else 1.0 for i, s in enumerate(scaled)])
    spread[spread == 0] = 1.0
    gram = c[:k, :k] / np.outer(spread, spread)
    w = np.linalg.solve(gram + alpha * np.eye(k), c[:k, k] / spread) / spread
    return w, float(m[k] - w @ m[:k])


def ridge_out_of_fold(df: DataFrame, features: list[str], y: str, fold: str, alpha: float = 1.0, scaled: list[bool] | None = None, out: str = "prediction") -> DataFrame:
    """df with predictions of each fold by a ridge fit on the other folds (ML-1, ML-2, ML-4, ML-7); null where there are no others.

    Each fold's sums meet the totals, a table of one row, in a task that solves for its coefficients; these are joined to
    the fold's rows. So any number of folds is one plan of the same size, and nothing is collected.
    """
    k, marks = len(features) + 1, scaled or [True] * len(features)
    sums = df.groupBy(fold).agg(*_sums(features, y))
    names = [c for c in sums.columns if c != fold]
    total = df.agg(*_sums(features, y)).toDF(*[f"t_{c}" for c in names])
    key = df.select(fold).schema.fields[0]

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            held = pdf[[f"t_{c}" for c in names]].to_numpy(float) - pdf[names].to_numpy(float)
            rows = []
            for r in held:
                at = dict(zip(names, r))
                if at["n"] <= 0:
                    rows.append((None, None))
                    continue
                means, products = np.array([at[f"m{i}"] for i in range(k)]), np.array([[at[f"s{min(i, j)}_{max(i, j)}"] for j in range(k)] for i in range(k)])
                w, b = solve_ridge(at["n"], means, products, alpha, marks)
                rows.append((w.tolist(), b))
            yield pd.DataFrame({fold: pdf[fold], "_w": [r[0] for r in rows], "_b": [r[1] for r in rows]})

    schema = StructType([key, StructField("_w", ArrayType(DoubleType())), StructField("_b", DoubleType())])
    fits = sums.crossJoin(F.broadcast(total)).mapInPandas(solve, schema)  # total is one row
    value = reduce(lambda a, c: a + c, [F.get(F.col("_w"), F.lit(i)) * F.col(f).cast("double") for i, f in enumerate(features)], F.col("_b"))
    return null_safe_join(df, fits, [fold]).withColumn(out, value).select(*df.columns, out)


def boosted_out_of_fold(df: DataFrame, features: list[str], y: str, fold: str, out: str = "prediction", rounds: int = 60, rate: float = 0.08, depth: int = 4, least: int = 20, seed: int = 42) -> DataFrame:
    """The same with gradient-boosted trees of the built-in learner: the same kind of model, not the same numbers as other learners (ML-3)."""
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import GBTRegressor

    ready = VectorAssembler(inputCols=features, outputCol="_x").transform(df)
    parts = []
    for row in df.select(fold).distinct().orderBy(fold).collect():
        learner = GBTRegressor(featuresCol="_x", labelCol=y, predictionCol=out, maxIter=rounds, stepSize=rate, maxDepth=depth, minInstancesPerNode=least, seed=seed)
        parts.append(learner.fit(ready.filter(F.col(fold) != row[0])).transform(ready.filter(F.col(fold) == row[0])).drop("_x"))
    return reduce(lambda a, b: a.unionByName(b), parts)


def balanced_group_folds(df: DataFrame, group: str, folds: int = 5, most: int = 1_000_000) -> DataFrame:
    """group, fold: groups by falling size, each to the lightest fold so far (ML-5). Each choice depends on those before, so the groups' sizes, `most` at most, are dealt on the driver; more raise an error."""
    rows = df.groupBy(group).count().limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"{group} has more than {most} values")
    sizes = sorted(((-r["count"], r[group]) for r in rows), key=lambda x: (x[0], str(x[1])))
    folds = max(1, min(folds, len(sizes)))
    weight, rows = [0] * folds, []
    for n, g in sizes:
        at = weight.index(min(weight))
        weight[at] -= n
        rows.append((g, at + 1))
    return df.sparkSession.createDataFrame(rows, df.select(group).schema.add("fold", IntegerType()))


def forward_splits(df: DataFrame, year: str) -> DataFrame:
    """split, year, train_rows, test_rows for training on all years before each but the first (ML-5)."""
    n = df.groupBy(year).agg(F.count("*").alias("test_rows"))
    w = Window.orderBy(year).rowsBetween(Window.unboundedPreceding, -1)  # one row a year
    out = n.withColumn("train_rows", F.sum("test_rows").over(w)).filter("train_rows is not null")
    return out.select(F.format_string("train_to_%d_test_%d", (F.col(year) - 1).cast("int"), F.col(year).cast("int")).alias("split"), F.col(year), "train_rows", "test_rows")


def balanced_panel(df: DataFrame, entity: str, period: str) -> DataFrame:
    """Rows of entities that are there in every period (AGG-21)."""
    every = df.agg(F.count_distinct(period).alias("_n"))
    full = df.groupBy(entity).agg(F.count_distinct(period).alias("_k")).join(F.broadcast(every), F.col("_k") == F.col("_n")).select(entity)  # `every` is one row
    return df.join(full, entity, "left_semi")


def residual_gaps(df: DataFrame, y: str, p: str, quarter: str) -> DataFrame:
    """df with gap_log, gap_ratio of the values behind log1p, and gap_z within the quarter (ML-8, WIN-8)."""
    out = df.withColumn("gap_log", F.col(y) - F.col(p)).withColumn("gap_ratio", F.try_divide(F.expm1(y), F.nullif(F.greatest(F.expm1(p), F.lit(0.0)), F.lit(0.0))))
    return out.withColumn("gap_z", zscore0("gap_log", quarter))


def persistent_gaps(df: DataFrame, entity: list[str], z: str = "gap_z", threshold: float = 1.0, least: int = 3, labels: tuple[str, str, str] = ("목적소비형", "통과형", "일반형")) -> DataFrame:
    """Quarters above and below, mean z and class of each entity, above tested first (ML-9, ML-10, AGG-10)."""
    g = df.groupBy(*entity).agg(F.count("*").alias("quarters_observed"), F.count_if(F.col(z) >= threshold).alias("positive_gap_quarters"), F.count_if(F.col(z) <= -threshold).alias("negative_gap_quarters"), F.avg(z).alias("mean_gap_z"))
    return g.withColumn("gap_type", F.when(F.col("positive_gap_quarters") >= least, labels[0]).when(F.col("negative_gap_quarters") >= least, labels[1]).otherwise(labels[2]))


def with_direction(df: DataFrame, z: str = "gap_z") -> DataFrame:
    return df.withColumn("gap_direction", gap_direction(F.col(z)))


def sign_stability(df: DataFrame, entity: str, year: str, value: str, years: list[int]) -> DataFrame:
    """Yearly means side by side, how many carry the overall mean's sign, and whether all do; a missing year counts against (ML-12)."""
    wide = df.groupBy(entity).pivot(year, years).agg(F.avg(value)).withColumnsRenamed({str(y): f"y{y}" for y in years})
    whole = df.groupBy(entity).agg(F.avg(value).alias("_m"))
    same = reduce(lambda a, b: a + b, [F.coalesce((F.signum(F.col(f"y{y}")) == F.signum("_m")).cast("int"), F.lit(0)) for y in years])
    return wide.join(whole, entity).withColumn("same_sign_years", same.cast("long")).withColumn("stable", F.col("same_sign_years") == len(years)).drop("_m")


def residual_reduction(df: DataFrame, y: str, before: str, after: str, by: list[str]) -> DataFrame:
    """Mean absolute residuals of two predictions and the reduction in percent (ML-11, AGG-11)."""
    g = df.groupBy(*by).agg(F.avg(F.abs(F.col(y) - F.col(before))).alias("mean_abs_before"), F.avg(F.abs(F.col(y) - F.col(after))).alias("mean_abs_after"))
    return g.withColumn("reduction_percent", (1 - F.try_divide(F.col("mean_abs_after"), F.col("mean_abs_before"))) * 100)


def best_model(scores: DataFrame, metric: str = "rmse", name: str = "model") -> DataFrame:
    """The row of least metric, names breaking ties (ML-6, TOP-3)."""
    return scores.orderBy(metric, name).limit(1)


def compare_models(predictions: dict[str, DataFrame], y: str, p: str = "prediction") -> DataFrame:
    """Pooled scores of each model's predictions (ML-6, AGG-20)."""
    parts = [regression_scores(df, y, p).withColumn("model", F.lit(name)) for name, df in predictions.items()]
    return reduce(lambda a, b: a.unionByName(b), parts)


def low_support(df: DataFrame, measures: list[str], q: float = 0.05, out: str = "low_support") -> DataFrame:
    """Flag of rows strictly below the q-quantile of any measure; nulls never are (PRJ-14)."""
    flag = reduce(lambda a, b: a | b, [F.coalesce(F.col(m) < F.col(f"_q_{m}"), F.lit(False)) for m in measures])
    for m in measures:
        df = df.join(F.broadcast(exact_quantile(df, m, q, out=f"_q_{m}")), how="left")  # one row at most
    return df.withColumn(out, flag).drop(*[f"_q_{m}" for m in measures])


def score_pivot(scores: DataFrame, scheme: str, model: str, models: list[str], metrics: list[str]) -> DataFrame:
    """One row a scheme with each metric of each model side by side, as metric_model (AGG-13)."""
    return scores.groupBy(scheme).agg(*[F.max(F.when(F.col(model) == m, F.col(x))).alias(f"{x}_{m}") for x in metrics for m in models])
