"""Roll-ups of reachable pairs to areas, and their stability over periods."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import access_tier, candidate_tier, stability
from ..functions.compat import null_safe_join, outer_fold


def area_by_mode(pairs: DataFrame, area: list[str], origin: str = "origin", stop: str = "stop", minutes: str = "travel_minutes", mode: str = "mode") -> DataFrame:
    """Distinct origins and stops, least and median minutes by area and mode; a null area is a group (AGG-2 to AGG-4, AGG-6).

    Origins and stops are made distinct on their own first, so no row is multiplied by the number of distinct counts.
    """
    keys = [*area, mode]
    counted = lambda c, name: pairs.select(*keys, c).distinct().groupBy(*keys).agg(F.count(c).alias(name))
    times = pairs.groupBy(*keys).agg(F.min(minutes).alias("minimum_travel_minutes"), F.median(minutes).alias("median_travel_minutes"))
    out = null_safe_join(null_safe_join(times, counted(origin, "reachable_origin_count"), keys), counted(stop, "reachable_stop_count"), keys)
    return out.select(*keys, "reachable_origin_count", "reachable_stop_count", "minimum_travel_minutes", "median_travel_minutes")


def candidate_areas(by_mode: DataFrame, area: list[str], origins: int | DataFrame) -> DataFrame:
    """Modes of an area put together: most origins, sum of stops, least minutes, median of medians; ratio and tier (AGG-5, GRF-7). origins: their number, or a table of one row that holds it."""
    c = by_mode.groupBy(*area).agg(F.max("reachable_origin_count").alias("reachable_origin_count"), F.sum("reachable_stop_count").alias("reachable_stop_count"), F.min("minimum_travel_minutes").alias("minimum_travel_minutes"), F.median("median_travel_minutes").alias("median_travel_minutes"))
    if isinstance(origins, DataFrame):
        c = c.crossJoin(F.broadcast(origins.toDF("total_origin_count")))  # one row
    else:
        c = c.withColumn("total_origin_count", F.lit(origins).cast("long"))
    c = c.withColumn("reachable_origin_ratio", F.col("reachable_origin_count") / F.col("total_origin_count"))
    return c.withColumn("candidate_tier", candidate_tier(F.col("reachable_origin_ratio")))


def combine_periods(frames: dict[int, DataFrame], keys: list[str], ratio: str = "reachable_origin_ratio", threshold: float = 0.5) -> DataFrame:
    """Ratios of several hours side by side, missing ones 0, with how many reach the threshold, least, mean and label (JOIN-4, PRJ-10, PRJ-23)."""
    names = [f"ratio_{h:02d}" for h in sorted(frames)]
    wide = outer_fold([frames[h].select(*keys, F.col(ratio).alias(n)) for h, n in zip(sorted(frames), names)], keys).fillna(0.0, names)
    cols = [F.col(n) for n in names]
    add = lambda xs: reduce(lambda a, b: a + b, xs)
    out = wide.withColumn("periods_above_threshold", add([(c >= threshold).cast("int") for c in cols])).withColumn("minimum_period_ratio", F.least(*cols) if len(cols) > 1 else cols[0]).withColumn("mean_period_ratio", add(cols) / len(cols))
    return out.withColumn("time_stability", stability(F.col("periods_above_threshold")))


def area_access(periods: DataFrame, keys: list[str]) -> DataFrame:
    """periods with the tier of the least ratio (GRF-8, PRJ-8)."""
    return periods.withColumn("access_tier", access_tier(F.col("minimum_period_ratio")))


def overlap_scores(a: DataFrame, b: DataFrame, by: list[str], item: str) -> DataFrame:
    """Counts of items in both, only b and only a, with precision and recall of b against a, and Jaccard; 0 where undefined (AGG-19)."""
    x, y = a.select(*by, item).distinct().withColumn("_a", F.lit(1)), b.select(*by, item).distinct().withColumn("_b", F.lit(1))
    n = x.join(y, [*by, item], "full").groupBy(*by).agg(F.count("_a").alias("a_items"), F.count("_b").alias("b_items"), F.count_if(F.col("_a").isNotNull() & F.col("_b").isNotNull()).alias("true_positive"))
    n = n.withColumn("false_positive", F.col("b_items") - F.col("true_positive")).withColumn("false_negative", F.col("a_items") - F.col("true_positive"))
    safe = lambda p, q: F.when(q > 0, p / q).otherwise(F.lit(0.0))
    tp, fp, fn = F.col("true_positive"), F.col("false_positive"), F.col("false_negative")
    return n.withColumn("precision", safe(tp, tp + fp)).withColumn("recall", safe(tp, tp + fn)).withColumn("jaccard", safe(tp, tp + fp + fn))
