"""Stations, stops and districts against isochrone polygons."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import station_key
from ..functions.compat import set_concat
from .polygon import coverage
from .spatial import point_in_polygon, polygon_counts


def merge_stations(found: DataFrame, place: str = "place", by: list[str] | None = None) -> DataFrame:
    """One row per physical station, of each `by`: those of the same normalized name, placed where the first of them lies, with all ids and lines (ISO-1)."""
    keys = [*(by or []), "station_key"]
    g = found.withColumn("station_key", station_key(F.col("station_name"))).groupBy(*keys)
    first = F.min_by(F.struct("station_name", "x", "y"), F.col(place))
    return g.agg(first.alias("_f"), set_concat("station_id").alias("station_ids"), set_concat("line").alias("lines"), F.count("*").alias("rows")).select(*keys, "_f.*", "station_ids", "lines", "rows")


def search_circle(edges: DataFrame, margin_m: float = 500.0) -> DataFrame:
    """Mean of the exterior vertices and the greatest distance to one plus a margin, for a polygon in degrees (SRC-13)."""
    from ..functions.geo import haversine_m

    outer = edges.filter("not hole").select("x1", "y1")
    middle = outer.agg(F.avg("x1").alias("lon"), F.avg("y1").alias("lat"))
    return outer.crossJoin(middle).groupBy("lon", "lat").agg((F.max(haversine_m(F.col("lon"), F.col("lat"), F.col("x1"), F.col("y1"))) + margin_m).alias("radius_m"))  # middle is one row


def stops_in(stops: DataFrame, edges: DataFrame, stop: str, origin: str, size: float | None = None) -> DataFrame:
    """origin and stop of the stops within an origin's isochrone (ISO-3, JOIN-10)."""
    return point_in_polygon(stops, edges, stop, [origin], size=size).select(origin, stop)


def stop_summary(pairs: DataFrame, stop: str, origin: str, origins: int) -> DataFrame:
    """Distinct origins that reach each stop, and their share (ISO-3)."""
    n = pairs.groupBy(stop).agg(F.count_distinct(origin).alias("reachable_origin_count"))
    return n.withColumn("reachable_origin_ratio", F.col("reachable_origin_count") / F.lit(origins))


def stop_reach(stops: DataFrame, edges: DataFrame, stop: str, origin: str, origins: int, size: float | None = None) -> DataFrame:
    """The same as `stop_summary` of `stops_in`, without a table of the pairs (ISO-3)."""
    n = polygon_counts(stops, edges, stop, origin, size=size).withColumnRenamed("polygons", "reachable_origin_count")
    return n.withColumn("reachable_origin_ratio", F.col("reachable_origin_count") / F.lit(origins))


def district_coverage(zones: DataFrame, shapes: DataFrame, zone: str, origin: str, origins: int, least: float = 0.1) -> DataFrame:
    """Origins whose isochrones cover at least `least` of a district, their share, greatest coverage and names, most reached first (ISO-2, JOIN-13)."""
    c = coverage(zones, shapes, zone, origin, least)
    g = c.groupBy(zone).agg(F.count_distinct(origin).alias("origin_count"), F.max("ratio").alias("maximum_coverage"), set_concat(F.col(origin).cast("string")).alias("origins"))
    return g.withColumn("origin_ratio", F.col("origin_count") / F.lit(origins)).orderBy(F.desc("origin_ratio"), F.desc("maximum_coverage"), zone)


def hourly_agreement(scores: DataFrame, hour: str = "hour") -> DataFrame:
    """Mean and median precision, recall and Jaccard by hour (AGG-19)."""
    names = ["precision", "recall", "jaccard"]
    return scores.groupBy(hour).agg(F.count("*").alias("origins"), *[F.avg(n).alias(f"mean_{n}") for n in names], *[F.median(n).alias(f"median_{n}") for n in names])


def latest_of(df: DataFrame, quarter: str) -> DataFrame:
    """Rows of the latest quarter (TOP-4)."""
    return df.join(df.agg(F.max(quarter).alias(quarter)), quarter, "left_semi")
