"""Spatial joins as equi-joins on grid cells with an exact test behind."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tables import cut, join_dealt, join_unique


def radius_join(a: DataFrame, b: DataFrame, radius_m: float, a_key: str, b_key: str, lon: str = "lon", lat: str = "lat", top_lat: float = 60.0) -> DataFrame:
    """a_key, b_key, metres of all pairs within the radius, inclusive (JOIN-14, JOIN-15).

    Cells are as high and, at `top_lat`, as wide as the radius, so a point's neighbours always lie in its own or the
    eight cells around; between -top_lat and top_lat no pair is missed. b's rows of a crowded cell are dealt to several tasks.
    """
    high = radius_m / 110_000.0
    wide = high / math.cos(math.radians(top_lat))
    left = a.select(F.col(a_key).alias("_a"), F.col(lon).alias("_x"), F.col(lat).alias("_y")).withColumn("_c", F.explode(geo.cells(F.col("_x") / wide, F.col("_y") / high, 1.0, 1)))
    right = b.select(F.col(b_key).alias("_b"), F.col(lon).alias("_u"), F.col(lat).alias("_v")).withColumn("_c", geo.cell(F.col("_u") / wide, F.col("_v") / high, 1.0))
    metres = geo.haversine_m(F.col("_x"), F.col("_y"), F.col("_u"), F.col("_v"))
    return join_dealt(right, left, ["_c"]).withColumn("metres", metres).filter(F.col("metres") <= radius_m).select(F.col("_a").alias(a_key if a_key != b_key else f"{a_key}_a"), F.col("_b").alias(b_key if a_key != b_key else f"{b_key}_b"), "metres")


def access_times(origins: DataFrame, stops: DataFrame, radius_m: float, walk_mps: float) -> DataFrame:
    """origin, stop, seconds on foot, rounded up (JOIN-14)."""
    near = radius_join(origins, stops, radius_m, "origin", "stop")
    return near.select("origin", "stop", F.ceil(F.col("metres") / walk_mps).cast("int").alias("seconds"))


def walking_edges(stops: DataFrame, radius_m: float, walk_mps: float) -> DataFrame:
    """from_stop, to_stop, seconds between different stops within the radius."""
    near = radius_join(stops, stops, radius_m, "stop", "stop").filter("stop_a <> stop_b")
    return near.select(F.col("stop_a").alias("from_stop"), F.col("stop_b").alias("to_stop"), F.ceil(F.col("metres") / walk_mps).cast("int").alias("seconds"))


def cell_size(boxes: DataFrame, x0: str, x9: str, y0: str, y9: str) -> float:
    """The mean of the longer sides of the boxes; 1 without any."""
    return boxes.agg(F.avg(F.greatest(F.col(x9) - F.col(x0), F.col(y9) - F.col(y0)))).first()[0] or 1.0


def equal_shapes(edges: DataFrame, polygon: list[str], more: list[str] | None = None) -> DataFrame:
    """polygon keys and `_like`, the first of the polygons with the same edges (and columns `more`): its key, or a struct of several keys.

    Edges are told by two sums of 64-bit hashes over a polygon's edges, so that their order is free and no polygon travels whole.
    """
    own = [c for c in [*dict.fromkeys(["part", "ring", "hole", *(more or []), "x1", "y1", "x2", "y2"])] if c in edges.columns and c not in polygon]
    halves = []
    for k in range(2):
        h = F.xxhash64(F.lit(k), *[F.coalesce(F.col(c).cast("string"), F.lit("")) if c in (more or []) else F.col(c) for c in own])
        halves += [F.sum(F.shiftrightunsigned(h, 32)).alias(f"_h{k}"), F.sum(h.bitwiseAND(F.lit(0xFFFFFFFF))).alias(f"_l{k}")]  # sums of 32 bits, so none overflows
    marks = ["_m", "_h0", "_l0", "_h1", "_l1"]
    told = cut(edges.dropna(subset=polygon).groupBy(*polygon).agg(F.count("*").alias("_m"), *halves), "shapes")
    first = told.groupBy(*marks).agg(F.min(F.col(polygon[0]) if len(polygon) == 1 else F.struct(*polygon)).alias("_like"))
    return cut(join_unique(told, first, marks).select(*polygon, "_like"), "shapes")


def _hits(points: DataFrame, edges: DataFrame, polygon: list[str], x: str, y: str, boundary: bool, reach: float, size: float | None) -> tuple[DataFrame, DataFrame]:
    """_px, _py, _like: each place of points with the shapes that hold it; and polygon keys, _like. Equal places and shapes are tested once."""
    like = equal_shapes(edges.select(*polygon, "part", "x1", "y1", "x2", "y2"), polygon)
    key = F.col(polygon[0]) if len(polygon) == 1 else F.struct(*polygon)
    firsts = like.filter(key == F.col("_like"))
    edges = cut(edges.join(firsts, polygon).select("_like", "part", "x1", "y1", "x2", "y2"), "edges")
    pts = cut(points.select(F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py")).distinct(), "places")
    box = edges.groupBy("_like", "part").agg(F.min(F.least("x1", "x2")).alias("_x0"), F.max(F.greatest("x1", "x2")).alias("_x9"), F.min(F.least("y1", "y2")).alias("_y0"), F.max(F.greatest("y1", "y2")).alias("_y9"))
    inside = (F.col("_px") >= F.col("_x0") - reach) & (F.col("_px") <= F.col("_x9") + reach) & (F.col("_py") >= F.col("_y0") - reach) & (F.col("_py") <= F.col("_y9") + reach)
    size = size or cell_size(box, "_x0", "_x9", "_y0", "_y9") + 2 * reach
    span = lambda lo, hi: F.sequence(F.floor((F.col(lo) - reach) / size), F.floor((F.col(hi) + reach) / size))
    boxed = box.withColumn("_cx", F.explode(span("_x0", "_x9"))).withColumn("_cy", F.explode(span("_y0", "_y9")))
    placed = pts.withColumn("_cx", F.floor(F.col("_px") / size)).withColumn("_cy", F.floor(F.col("_py") / size))
    near = cut(join_dealt(placed, boxed, ["_cx", "_cy"]).filter(inside).select("_px", "_py", "_like", "part"), "near")
    at = [F.col(c) for c in ("_px", "_py", "x1", "y1", "x2", "y2")]
    tested = join_dealt(near, edges, ["_like", "part"])
    sums = tested.groupBy("_px", "_py", "_like", "part").agg((F.count_if(geo.crosses(*at)) % 2).alias("odd"), F.bool_or(geo.on_edge(*at)).alias("edge"), F.min(geo.segment_distance(*at)).alias("away"))
    member = (F.col("odd") == 1) & ~F.col("edge") | F.lit(boundary) & F.col("edge")
    if reach > 0:
        member = member | (F.col("odd") == 1) | (F.col("away") <= reach)
    return cut(sums.filter(member).select("_px", "_py", "_like").distinct(), "hits"), like


def _placed(points: DataFrame, point: str, x: str, y: str) -> DataFrame:
    return points.select(F.col(point).alias("_p"), F.col(x).cast("double").alias("_px"), F.col(y).cast("double").alias("_py"))


def point_in_polygon(points: DataFrame, edges: DataFrame, point: str, polygon: list[str], x: str = "x", y: str = "y", boundary: bool = False, reach: float = 0.0, size: float | None = None) -> DataFrame:
    """point and polygon keys of the points within each polygon, or within `reach` of it (JOIN-10, JOIN-11, JOIN-16 to JOIN-18).

    edges: polygon keys, part, hole, x1, y1, x2, y2. Points on an edge belong if `boundary` is set; inside is an odd
    number of crossings over all rings of a part. Points and polygons meet by the grid cells of `size` that a polygon's
    box covers; where it isn't given, cells are as large as the boxes on average. Points of crowded cells and of crowded
    polygons are dealt to several tasks. Where only the first polygon of a point or their number is asked for,
    `first_polygon` and `polygon_counts` form no table of the pairs.
    """
    hits, like = _hits(points, edges, polygon, x, y, boundary, reach, size)
    found = cut(join_dealt(_placed(points, point, x, y), hits, ["_px", "_py"]).select("_p", "_like"), "hits")
    return join_dealt(found, like, ["_like"]).select(F.col("_p").alias(point), *polygon).distinct()


def first_polygon(points: DataFrame, edges: DataFrame, point: str, polygon: str, order: DataFrame, x: str = "x", y: str = "y", boundary: bool = False, reach: float = 0.0, size: float | None = None) -> DataFrame:
    """Each point with the first polygon that holds it; order: polygon, place (JOIN-16). Only the first polygon of each shape is looked at."""
    hits, like = _hits(points, edges, [polygon], x, y, boundary, reach, size)
    least = like.join(order.filter("place is not null"), polygon).groupBy("_like").agg(F.min(F.struct("place", polygon)).alias("_first"))
    by_place = cut(hits.join(least, "_like").groupBy("_px", "_py").agg(F.min("_first").alias("_first")), "first")
    found = join_unique(_placed(points, point, x, y), by_place, ["_px", "_py"])
    return found.groupBy(F.col("_p").alias(point)).agg(F.min("_first")[polygon].alias(polygon))


def polygon_counts(points: DataFrame, edges: DataFrame, point: str, polygon: str, x: str = "x", y: str = "y", boundary: bool = False, reach: float = 0.0, size: float | None = None) -> DataFrame:
    """point, polygons: the number of different polygons that hold each point, for points within any: sums over shapes (ISO-3)."""
    hits, like = _hits(points, edges, [polygon], x, y, boundary, reach, size)
    held = cut(hits.join(like.groupBy("_like").agg(F.count("*").alias("_held")), "_like"), "hits")
    at = held.groupBy("_px", "_py").agg(F.sum("_held").alias("_held"))
    placed = cut(_placed(points, point, x, y).distinct(), "places")
    several = cut(placed.groupBy("_p").count().filter("count > 1").select("_p"), "several")  # points with several places, whose polygons may be the same
    same = F.col("_p").eqNullSafe(F.col("_q"))
    apart = placed.join(several.withColumnRenamed("_p", "_q"), same, "left_anti")
    one = join_unique(cut(apart, "places"), at, ["_px", "_py"]).select("_p", "_held")
    more = placed.join(several.withColumnRenamed("_p", "_q"), same, "left_semi").join(held, ["_px", "_py"]).select("_p", "_like", "_held").distinct().groupBy("_p").agg(F.sum("_held").alias("_held"))
    return one.unionByName(more).select(F.col("_p").alias(point), F.col("_held").alias("polygons"))
