"""Intersections of polygons of any number of vertices: edges clipped to cells that split until each holds few (JOIN-12, JOIN-13).

A cell holds the pieces of edges inside it and, for each shape, the heights at which its left side goes in or out of the
shape: the ends of what lies to the left, where each end that two edges share cancels itself. With these a cell can be
measured alone. A crowded cell becomes four; cells without pieces are inside or outside as a whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.tables import cut
from .polygon import _meeting, _of_first, shares_of_all
from .spatial import equal_shapes

CELL = ["cell", "cx0", "cy0", "cx1", "cy1"]


def _clip(pdf: pd.DataFrame) -> pd.DataFrame:
    """Rows of edges (kind 0, y1 < y2) and ends (kind 1, y1) with the cell each goes to: the pieces inside, and the ends of what lies to the left of it."""
    ends = pdf[(pdf.kind == 1) & (pdf.y1 < pdf.cy1)]
    ends = ends.assign(y1=np.maximum(ends.y1, ends.cy0))
    e = pdf[(pdf.kind == 0) & (np.maximum(pdf.y1, pdf.cy0) < np.minimum(pdf.y2, pdf.cy1))]
    x1, y1, x2, y2, left, right = (e[n].to_numpy(float) for n in ("x1", "y1", "x2", "y2", "cx0", "cx1"))
    ya, yb = np.maximum(y1, e.cy0.to_numpy(float)), np.minimum(y2, e.cy1.to_numpy(float))
    at = lambda y: np.where(y == y1, x1, np.where(y == y2, x2, x1 + (y - y1) * (x2 - x1) / (y2 - y1)))
    xa, xb = at(ya), at(yb)
    with np.errstate(divide="ignore", invalid="ignore"):
        meets = lambda x: np.clip(y1 + (x - x1) * (y2 - y1) / (x2 - x1), ya, yb)
        rising, most, least = xa <= xb, np.maximum(xa, xb), np.minimum(xa, xb)
        first, last = np.where(rising, ya, yb), np.where(rising, yb, ya)  # from left to right
        enter = np.where(most <= left, last, np.where(least >= left, first, meets(left)))
        leave = np.where(least >= right, first, np.where(most <= right, last, meets(right)))
    low, high = np.where(rising, enter, leave), np.where(rising, leave, enter)
    x_of = lambda y: np.clip(np.where(y == ya, xa, np.where(y == yb, xb, at(y))), left, right)
    pieces = e.assign(x1=x_of(low), y1=low, x2=x_of(high), y2=high)[low < high]
    begin, end = np.where(rising, ya, enter), np.where(rising, enter, yb)  # of the part to the left
    out = [e.assign(kind=1, x1=np.nan, y1=y, x2=np.nan, y2=np.nan)[(begin < end) & (y < e.cy1)] for y in (begin, end)]
    return pd.concat([pieces, ends, *out])


def _rows_in(df: DataFrame, keys: list[str]) -> DataFrame:
    """The rows of df in the cells that its rows name, with ends that stand there an even number of times left out."""

    def clip(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield _clip(pdf)

    found = df.mapInPandas(clip, df.schema)
    ends = found.filter("kind = 1").groupBy(*keys, "side", *CELL, "y1").agg(F.count("*").alias("n")).filter("n % 2 = 1")
    none = F.lit(None).cast("double")
    return found.filter("kind = 0").unionByName(ends.select(*keys, "side", *CELL, F.lit(1).alias("kind"), none.alias("x1"), "y1", none.alias("x2"), none.alias("y2")))


def cells(edges: DataFrame, keys: list[str], most: int = 256, depth: int = 20) -> DataFrame:
    """keys, cell, rows (an array) of cells with at most `most` pieces; edges: keys, side (the name of a shape), cx0, cy0, cx1, cy1 (the box of the keys), x1, y1, x2, y2.

    Only a point in which more edges than that meet leaves a fuller cell, after `depth` splits.
    """
    up = F.col("y1") < F.col("y2")
    turned = edges.filter("y1 <> y2").select(*keys, "side", F.lit(1).cast("long").alias("cell"), *CELL[1:], F.lit(0).alias("kind"), *[F.when(up, F.col(a)).otherwise(F.col(b)).cast("double").alias(n) for a, b, n in (("x1", "x2", "x1"), ("y1", "y2", "y1"), ("x2", "x1", "x2"), ("y2", "y1", "y2"))])
    state = cut(_rows_in(turned, keys), "cells")
    done = []
    for level in range(depth + 1):
        n = state.groupBy(*keys, "cell").agg(F.count_if(F.col("kind") == 0).alias("n"))
        full = cut(n.filter(F.col("n") > most).drop("n"), "full")
        if level == depth or not full.limit(1).count():
            done.append(state)
            break
        done.append(state.join(full, [*keys, "cell"], "left_anti"))
        x, y = (F.col("cx0") + F.col("cx1")) / 2, (F.col("cy0") + F.col("cy1")) / 2
        quarter = F.explode(F.array(*[F.struct((F.col("cell") * 4 + k).alias("cell"), a.alias("cx0"), b.alias("cy0"), c.alias("cx1"), d.alias("cy1")) for k, (a, b, c, d) in enumerate([(F.col("cx0"), F.col("cy0"), x, y), (x, F.col("cy0"), F.col("cx1"), y), (F.col("cx0"), y, x, F.col("cy1")), (x, y, F.col("cx1"), F.col("cy1"))])]))
        split = state.join(full, [*keys, "cell"], "left_semi").withColumn("q", quarter).drop(*CELL).select(*keys, "side", "q.*", "kind", "x1", "y1", "x2", "y2")
        state = cut(_rows_in(split, keys), "cells")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.groupBy(*keys, "cell").agg(F.first("cx0").alias("cx0"), F.first("cx1").alias("cx1"), F.first("cy0").alias("cy0"), F.first("cy1").alias("cy1"), F.collect_list(F.struct("side", "kind", "x1", "y1", "x2", "y2")).alias("rows"))


def _trapezoids(rows: list, x0: float, y0: float, x1: float, y1: float) -> list[tuple[float, ...]]:
    """(low, high, left at low, left at high, right at low, right at high) of what the shape "" and any other shape cover together in a cell."""
    from .polygon import _heights

    pieces, ends = {}, {}
    for r in rows:
        (pieces if r["kind"] == 0 else ends).setdefault(r["side"], []).append([r["x1"], r["y1"], r["x2"], r["y2"]])
    sides = sorted({*pieces, *ends})
    if "" not in sides or len(sides) < 2:
        return []
    flat = [np.array(pieces.get(s, []), float).reshape(-1, 4) for s in sides]
    turns = [np.array([e[1] for e in ends.get(s, [])], float) for s in sides]
    levels = np.unique(np.concatenate([[y0, y1], _heights(np.concatenate(flat)) if any(map(len, flat)) else [], *turns]))
    out = []
    for low, high in zip(levels[:-1], levels[1:]):
        y, marks = (low + high) / 2, []
        for s, edges, turn in zip(sides, flat, turns):
            if (turn <= y).sum() % 2:
                marks.append((x0, s, x0, x0))
            xa, ya, xb, yb = edges[(edges[:, 1] <= y) & (edges[:, 3] > y)].T
            slope = (xb - xa) / (yb - ya)
            marks += zip(xa + (y - ya) * slope, [s] * len(xa), xa + (low - ya) * slope, xa + (high - ya) * slope)
        inside, open_ = dict.fromkeys(sides, False), None
        for _, s, a, b in sorted(marks, key=lambda m: m[0]):
            inside[s] = not inside[s]
            now = inside[""] and any(v for k, v in inside.items() if k)
            if now and open_ is None:
                open_ = (a, b)
            elif not now and open_ is not None:
                out.append((low, high, *open_, a, b))
                open_ = None
        if open_ is not None:
            out.append((low, high, *open_, x1, x1))
    return [t for t in out if (t[4] - t[2]) + (t[5] - t[3]) > 0]


def clipped(edges: DataFrame, keys: list[str], most: int = 256) -> DataFrame:
    """keys, part, x1, y1, x2, y2: the edges of trapezoids that fill what the shape "" and any other shape (`side`) cover together; parts of equal keys don't overlap."""
    names = [*keys, "part", "ring", "hole", "x1", "y1", "x2", "y2"]
    kinds = ", ".join([*[f"`{k}` {dict(edges.dtypes)[k]}" for k in keys], "part string, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double"])

    def measure(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for *own, cell, held, x0, y0, x1, y1 in zip(*(pdf[c] for c in [*keys, "cell", "rows", "cx0", "cy0", "cx1", "cy1"])):
                for i, (low, high, a, b, c, d) in enumerate(_trapezoids(held, x0, y0, x1, y1)):
                    corners = [(a, low), (c, low), (d, high), (b, high)]
                    rows += [(*own, f"{cell}/{i}", 0, False, *p, *q) for p, q in zip(corners, corners[1:] + corners[:1]) if p != q]
            yield pd.DataFrame(rows, columns=names)

    return cells(edges, keys, most).mapInPandas(measure, kinds)


def _box(df: DataFrame, key: str, tag: str) -> DataFrame:
    ends = [F.min(F.least("x1", "x2")).alias(f"x0{tag}"), F.max(F.greatest("x1", "x2")).alias(f"x9{tag}"), F.min(F.least("y1", "y2")).alias(f"y0{tag}"), F.max(F.greatest("y1", "y2")).alias(f"y9{tag}")]
    return cut(df.groupBy(F.col(key).alias(f"_k{tag}")).agg(*ends), "boxes")


def overlay(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float | None = None, most: int = 256, shape: list[str] | None = None) -> DataFrame:
    """a_key, b_key and the edges of trapezoids that fill each intersection (JOIN-12), for polygons too large for one task.

    With `shape`, columns of b, each value of these is a shape of its own and the trapezoids fill what a shares with the
    union of b_key's shapes (JOIN-13); without, holes and parts of b_key count by parity.
    """
    boxes_a, boxes_b = _box(a, a_key, "_a"), _box(b, b_key, "_b")
    pairs = _meeting(boxes_a, boxes_b, "_k_a", "_k_b", cell).join(boxes_a, "_k_a").join(boxes_b, "_k_b")
    pairs = pairs.select("_k_a", "_k_b", F.greatest("x0_a", "x0_b").alias("cx0"), F.greatest("y0_a", "y0_b").alias("cy0"), F.least("x9_a", "x9_b").alias("cx1"), F.least("y9_a", "y9_b").alias("cy1"))
    named = F.concat_ws("/", F.lit("shape"), *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in shape or []])
    sides = [pairs.join(df.select(F.col(k).alias(f"_k{t}"), side.alias("side"), "x1", "y1", "x2", "y2"), f"_k{t}") for df, k, t, side in ((a, a_key, "_a", F.lit("")), (b, b_key, "_b", named))]
    return clipped(sides[0].unionByName(sides[1]), ["_k_a", "_k_b"], most).withColumnsRenamed({"_k_a": a_key, "_k_b": b_key})


def overlay_areas(a: DataFrame, b: DataFrame, a_key: str, b_key: str, cell: float | None = None, most: int = 256, shape: list[str] | None = None, digits: int | None = None) -> DataFrame:
    """a_key, b_key, overlap, area, share of a's area: the same rows as `overlay_shares`, or with `shape` the ratios of `coverage`. Polygons of equal shape are measured once."""
    like_a, like_b = equal_shapes(a, [a_key]), equal_shapes(b, [b_key], shape)
    a, b = _of_first(a, like_a, a_key), _of_first(b, like_b, b_key)
    parts = overlay(a, b, a_key, b_key, cell, most, shape)
    found = parts.groupBy(a_key, b_key).agg((F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / 2).alias("overlap")).filter("overlap > 0")
    return shares_of_all(found, a, like_a, like_b, a_key, b_key, digits)
