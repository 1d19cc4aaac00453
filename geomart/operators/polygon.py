"""Areas of polygon intersections and unions, exact up to rounding, in Arrow tasks (JOIN-12, JOIN-13).

Area is summed over horizontal slabs between all vertex and crossing heights. Within a slab edges don't cross, so the
covered width is linear and its value at the middle times the height is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut, join_dealt
from .spatial import cell_size, equal_shapes


def _heights(edges: np.ndarray) -> np.ndarray:
    """All heights at which the picture can change: ends of edges and crossings of two."""
    x1, y1, x2, y2 = edges.T
    d = (x2 - x1)[:, None] * (y2 - y1)[None, :] - (y2 - y1)[:, None] * (x2 - x1)[None, :]
    with np.errstate(divide="ignore", invalid="ignore"):
        t = ((x1[None, :] - x1[:, None]) * (y2 - y1)[None, :] - (y1[None, :] - y1[:, None]) * (x2 - x1)[None, :]) / d
        u = ((x1[None, :] - x1[:, None]) * (y2 - y1)[:, None] - (y1[None, :] - y1[:, None]) * (x2 - x1)[:, None]) / d
    hit = (d != 0) & (t >= 0) & (t <= 1) & (u >= 0) & (u <= 1)
    cross = (y1[:, None] + t * (y2 - y1)[:, None])[hit]
    return np.unique(np.concatenate([y1, y2, cross]))


def covered_area(shapes: list[np.ndarray], need: int | None = None) -> float:
    """Area where at least `need` shapes (all, if None) cover the plane; a shape is rows of edges x1, y1, x2, y2, inside by parity."""
    need = len(shapes) if need is None else need
    if len(shapes) < need or not all(len(s) for s in shapes):
        return 0.0
    levels = _heights(np.concatenate(shapes))
    area = 0.0
    for low, high in zip(levels[:-1], levels[1:]):
        y = (low + high) / 2
        marks = []
        for s in shapes:
            x1, y1, x2, y2 = s[(s[:, 1] > y) != (s[:, 3] > y)].T
            xs = np.sort(x1 + (y - y1) / (y2 - y1) * (x2 - x1))
            marks += [(x, 1 if k % 2 == 0 else -1) for k, x in enumerate(xs)]
        depth, width, last = 0, 0.0, 0.0
        for x, step in sorted(marks):
            width += (x - last) * (depth >= need)
            depth, last = depth + step, x
        area += width * (high - low)
    return area


def _shape(part: pd.DataFrame) -> np.ndarray:
    return part[["x1", "y1", "x2", "y2"]].to_numpy(float)


def areas(edges: DataFrame, key: str) -> DataFrame:
    """key, area by the shoelace sum: exteriors count plus, holes minus."""
    ring = edges.groupBy(key, "part", "ring", "hole").agg(F.abs(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("a"))
    return ring.groupBy(key).agg(F.sum(F.when(F.col("hole"), -F.col("a")).otherwise(F.col("a"))).alias("area"))


def _boxes(edges: DataFrame, key: str, tag: str) -> DataFrame:
    ends = edges.groupBy(key).agg(F.min(F.least("x1", "x2")).alias(f"x0{tag}"), F.max(F.greatest("x1", "x2")).alias(f"x9{tag}"), F.min(F.least("y1", "y2")).alias(f"y0{tag}"), F.max(F.greatest("y1", "y2")).alias(f"y9{tag}"), F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias(f"edges{tag}"))
    return ends.withColumnRenamed(key, f"{key}{tag}")


def _meeting(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float | None) -> DataFrame:
    """The two keys of boxes (x0_a to y9_a, x0_b to y9_b) that overlap, by the cells they cover; without `cell` cells are as large as the boxes on average."""
    cell = cell or max(cell_size(df, *[f"{c}{t}" for c in ("x0", "x9", "y0", "y9")]) for df, t in ((a, "_a"), (b, "_b")))
    cells = lambda c, t: F.sequence(F.floor(F.col(f"{c}0{t}") / cell), F.floor(F.col(f"{c}9{t}") / cell))
    spread = lambda df, t: df.withColumn("_cx", F.explode(cells("x", t))).withColumn("_cy", F.explode(cells("y", t)))
    once = reduce(lambda p, q: p & q, [F.col(f"_c{c}") == F.floor(F.greatest(f"{c}0_a", f"{c}0_b") / cell) for c in "xy"])  # the cell of the common box's lower left corner
    return spread(a, "_a").join(spread(b, "_b"), ["_cx", "_cy"]).filter("x0_a < x9_b and x0_b < x9_a and y0_a < y9_b and y0_b < y9_a").filter(once).select(a_key, b_key)


def _of_first(edges: DataFrame, like: DataFrame, key: str) -> DataFrame:
    """The edges of the first polygon of each shape."""
    return edges.join(like.filter(F.col(key) == F.col("_like")).select(key), key, "left_semi")


def _of_all(found: DataFrame, like_a: DataFrame, like_b: DataFrame, a_key: str, b_key: str) -> DataFrame:
    """found, about first polygons, for all polygons of their shapes."""
    rest = [c for c in found.columns if c not in (a_key, b_key)]
    members = lambda like, key: like.select(F.col("_like").alias(f"_{key}"), key)
    named = cut(found.withColumnsRenamed({a_key: f"_{a_key}", b_key: f"_{b_key}"}), "shares")
    one = cut(join_dealt(named, members(like_a, a_key), [f"_{a_key}"]), "shares")
    return join_dealt(one, members(like_b, b_key), [f"_{b_key}"]).select(a_key, b_key, *rest)


def overlay_shares(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float | None = None, digits: int | None = None) -> DataFrame:
    """a_key, b_key, overlap, area, share of a's area, for polygons that overlap (JOIN-12). Boxes meet by the cells they cover; a polygon's edges travel as one array.

    Polygons of equal shape are measured once, and overlap and share rounded to `digits` there.
    """
    like_a, like_b = equal_shapes(a, [a_key]), equal_shapes(b, [b_key])
    a, b = _of_first(a, like_a, a_key), _of_first(b, like_b, b_key)
    left, right = _boxes(a, a_key, "_a"), _boxes(b, b_key, "_b")
    meet = _meeting(left.drop("edges_a"), right.drop("edges_b"), f"{a_key}_a", f"{b_key}_b", cell)
    pairs = meet.join(left.select(f"{a_key}_a", "edges_a"), f"{a_key}_a").join(right.select(f"{b_key}_b", "edges_b"), f"{b_key}_b")

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [covered_area([np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in s], float) for s in (p, q)]) for p, q in zip(pdf["edges_a"], pdf["edges_b"])]
            yield pd.DataFrame({a_key: pdf[f"{a_key}_a"], b_key: pdf[f"{b_key}_b"], "overlap": np.array(rows, float)})

    kinds = f"{a_key} {dict(a.dtypes)[a_key]}, {b_key} {dict(b.dtypes)[b_key]}, overlap double"
    return shares_of_all(pairs.mapInPandas(measure, kinds).filter("overlap > 0"), a, like_a, like_b, a_key, b_key, digits)


def shares_of_all(found: DataFrame, a: DataFrame, like_a: DataFrame, like_b: DataFrame, a_key: str, b_key: str, digits: int | None = None) -> DataFrame:
    """a_key, b_key, overlap, area, share for all polygons of the shapes whose first ones are found: a_key, b_key, overlap."""
    found = found.join(areas(a, a_key), a_key).withColumn("share", F.col("overlap") / F.col("area"))
    if digits is not None:
        found = found.withColumns({c: F.round(c, digits) for c in ("overlap", "share")})
    return _of_all(found, like_a, like_b, a_key, b_key)


def coverage(zones: DataFrame, shapes: DataFrame, zone: str, origin: str, least: float = 0.1, cell: float | None = None) -> DataFrame:
    """zone, origin, ratio of the zone that the union of an origin's shapes covers, where at least `least` (JOIN-13). shapes: origin, shape, part, x1, y1, x2, y2. Boxes meet by the cells they cover."""
    z = zones.groupBy(zone).agg(F.collect_list(F.struct("x1", "y1", "x2", "y2")).alias("_zone"))
    s = shapes.groupBy(origin).agg(F.collect_list(F.struct(F.xxhash64("shape", "part").alias("of"), "x1", "y1", "x2", "y2")).alias("_shapes"))
    box = lambda df, k, t: df.groupBy(k).agg(F.min(F.least("x1", "x2")).alias(f"x0{t}"), F.max(F.greatest("x1", "x2")).alias(f"x9{t}"), F.min(F.least("y1", "y2")).alias(f"y0{t}"), F.max(F.greatest("y1", "y2")).alias(f"y9{t}"))
    near = _meeting(box(zones, zone, "_a"), box(shapes, origin, "_b"), zone, origin, cell)

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        as_rows = lambda es: np.array([(e["x1"], e["y1"], e["x2"], e["y2"]) for e in es], float)
        for pdf in batches:
            ratio = []
            for zz, ss in zip(pdf["_zone"], pdf["_shapes"]):
                of: dict[int, list] = {}
                for e in ss:
                    of.setdefault(e["of"], []).append(e)
                own, parts = as_rows(zz), [as_rows(p) for p in of.values()]
                # |zone and union| = |zone| + |union| - |zone or union|
                whole, union, both = covered_area([own]), covered_area(parts, 1), covered_area([own, *parts], 1)
                ratio.append((whole + union - both) / whole if whole else 0.0)
            yield pd.DataFrame({zone: pdf[zone], origin: pdf[origin], "ratio": ratio})

    kinds = f"{zone} {dict(zones.dtypes)[zone]}, {origin} {dict(shapes.dtypes)[origin]}, ratio double"
    return near.join(z, zone).join(s, origin).mapInPandas(measure, kinds).filter(F.col("ratio") >= least)
