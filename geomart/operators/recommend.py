"""Eligibility, fallback ranking and ranking metrics by published rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def exclusion(route_ok: Column, time_ok: Column, minutes: Column, most: float, condition_ok: Column) -> Column:
    """Why a candidate is left out, in order; null for eligible ones, and a time of exactly `most` is eligible (PRJ-36)."""
    no = lambda c: ~F.coalesce(c, F.lit(False))
    return (
        F.when(no(route_ok), "NO_ROUTE_OR_UNVERIFIED_ROUTE")
        .when(no(time_ok) | minutes.isNull(), "MISSING_OR_UNVERIFIED_JOURNEY_TIME")
        .when(minutes > most, "OVER_MAX_TRAVEL_TIME")
        .when(no(condition_ok), "UNSUPPORTED_OR_UNVERIFIED_CONDITION")
    )


def recommend(eligible: DataFrame, by: list[str], candidate: str, minutes: str, same: str, popular: str, k: int = 5) -> DataFrame:
    """The first k of each group by the first basis whose metric every eligible row has, ties by time and id (SCR-5, TOP-5)."""
    w = Window.partitionBy(*by)
    complete = lambda c: F.count(c).over(w) == F.count("*").over(w)
    basis = F.when(complete(same), "same-condition-historical-inflow").when(complete(popular), "global-popularity").otherwise("shortest-travel-time")
    d = eligible.withColumn("basis", basis)
    metric = F.when(F.col("basis") == "same-condition-historical-inflow", F.col(same).cast("double")).when(F.col("basis") == "global-popularity", F.col(popular).cast("double")).otherwise(F.lit(0.0))
    order = w.orderBy(metric.desc(), F.col(minutes), F.col(candidate))
    return d.withColumn("place", F.row_number().over(order).cast("long")).filter(F.col("place") <= k)


def ranking_metrics(df: DataFrame, by: list[str], predicted: str, relevance: str, k: int = 5) -> DataFrame:
    """Recall at k, NDCG at k and reciprocal rank of each group; predicted is a place from 1, relevance 0 or more (PLN-1)."""
    ideal = F.row_number().over(Window.partitionBy(*by).orderBy(F.desc(relevance), predicted))
    d = df.withColumn("_ideal", ideal)
    gain = lambda place: F.col(relevance) / F.log2(F.col(place) + 1)
    top, good = F.col(predicted) <= k, F.col(relevance) > 0
    g = d.groupBy(*by).agg(F.count_if(top & good).alias("_h"), F.count_if(good).alias("_n"), F.sum(F.when(top, gain(predicted)).otherwise(0.0)).alias("_d"), F.sum(F.when(F.col("_ideal") <= k, gain("_ideal")).otherwise(0.0)).alias("_i"), F.min(F.when(good, F.col(predicted))).alias("_f"))
    return g.select(*by, F.coalesce(F.try_divide(F.col("_h"), F.least(F.col("_n"), F.lit(k))), F.lit(0.0)).alias("recall_at_k"), F.coalesce(F.try_divide(F.col("_d"), F.col("_i")), F.lit(0.0)).alias("ndcg_at_k"), F.coalesce(F.try_divide(F.lit(1.0), F.col("_f")), F.lit(0.0)).alias("reciprocal_rank"))


def spearman(df: DataFrame, by: list[str], a: str, b: str) -> DataFrame:
    """Rank correlation with average ranks (PLN-2)."""
    rank = lambda c: F.rank().over(Window.partitionBy(*by).orderBy(c)) + (F.count("*").over(Window.partitionBy(*by, c)) - 1) / 2
    d = df.filter(F.col(a).isNotNull() & F.col(b).isNotNull()).withColumn("_a", rank(a)).withColumn("_b", rank(b))
    return d.groupBy(*by).agg(F.corr("_a", "_b").alias("spearman"))


def concentration(df: DataFrame, by: list[str], amount: str) -> DataFrame:
    """Herfindahl-Hirschman index of amounts (PLN-2)."""
    s = F.col(amount).cast("double")
    return df.groupBy(*by).agg(F.try_divide(F.sum(s * s), F.nullif(F.sum(s) * F.sum(s), F.lit(0.0))).alias("hhi"))


def huff_shares(df: DataFrame, origin: str, size: str, distance: str, beta: float = 2.0) -> DataFrame:
    """Shares of an origin's visits by size over distance to the power beta (PLN-3)."""
    pull = F.col(size).cast("double") / F.pow(F.greatest(F.col(distance).cast("double"), F.lit(1e-9)), F.lit(beta))
    d = df.withColumn("_p", pull)
    return d.withColumn("huff_share", F.try_divide(F.col("_p"), F.sum("_p").over(Window.partitionBy(origin)))).drop("_p")
