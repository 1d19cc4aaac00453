"""Spatial autocorrelation: nearest-neighbour weights through cells, global and local Moran's I, permutation tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import geo
from ..functions.tables import cut, running_total


def nearest_links(points: DataFrame, key: str, k: int, x: str = "x", y: str = "y", crowd: float = 2.0) -> DataFrame:
    """from_key, to_key, distance: the k nearest other points of each point in the plane, ties to the smaller key (PLN-2).

    Points meet those of the nine cells around them. A point whose k-th neighbour is no farther than a cell is wide has
    found its nearest; the others try cells twice as wide, until one cell holds all. The first cells hold `crowd` * k
    points on average. Points without coordinates have no links; of fewer than k others, all are linked.
    """
    known = points.filter(F.col(x).isNotNull() & F.col(y).isNotNull())
    pts = cut(known.select(F.col(key).alias("_k"), F.col(x).cast("double").alias("_x"), F.col(y).cast("double").alias("_y")), "points")
    n, wide, high = pts.agg(F.count("*"), F.max("_x") - F.min("_x"), F.max("_y") - F.min("_y")).first()
    side = max(wide or 0.0, high or 0.0) or 1.0
    size = side * min(1.0, (crowd * k / max(n, 1)) ** 0.5)
    open_, found = pts, []
    while True:
        left = open_.select(F.col("_k").alias("from_key"), F.col("_x").alias("_u"), F.col("_y").alias("_v"), F.explode(geo.cells(F.col("_x"), F.col("_y"), size, 1)).alias("_c"))
        pairs = left.join(pts.withColumn("_c", geo.cell(F.col("_x"), F.col("_y"), size)), "_c").filter("from_key <> _k")
        away = F.sqrt((F.col("_x") - F.col("_u")) * (F.col("_x") - F.col("_u")) + (F.col("_y") - F.col("_v")) * (F.col("_y") - F.col("_v")))
        ranked = pairs.select("from_key", F.col("_k").alias("to_key"), away.alias("distance")).withColumn("place", F.row_number().over(Window.partitionBy("from_key").orderBy("distance", "to_key"))).filter(F.col("place") <= k)
        near = cut(ranked.drop("place"), "near")
        if size >= side:  # the nine cells hold all points
            found.append(near)
            break
        done = near.groupBy("from_key").agg(F.count("*").alias("_n"), F.max("distance").alias("_far")).filter((F.col("_n") == k) & (F.col("_far") <= size)).select("from_key")
        found.append(near.join(done, "from_key", "left_semi"))
        open_ = cut(open_.join(done, F.col("_k") == F.col("from_key"), "left_anti"), "open")
        if not open_.limit(1).count():
            break
        size *= 2
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def row_weights(links: DataFrame) -> DataFrame:
    """from_key, to_key, weight: equal weights that sum to 1 for each from_key."""
    n = links.groupBy("from_key").agg(F.count("*").alias("_n"))
    return links.join(n, "from_key").select("from_key", "to_key", (1 / F.col("_n")).alias("weight"))


def _deviations(values: DataFrame, key: str, value: str) -> DataFrame:
    """_k, _z: the deviations from the mean of the values that are there."""
    d = values.filter(F.col(value).isNotNull()).select(F.col(key).alias("_k"), F.col(value).cast("double").alias("_v"))
    return d.crossJoin(F.broadcast(d.agg(F.avg("_v").alias("_m")))).select("_k", (F.col("_v") - F.col("_m")).alias("_z"))  # the mean is one row


def _lags(z: DataFrame, weights: DataFrame) -> DataFrame:
    """_k, _z, _lag, _w: the weighted sum of neighbours' deviations and the sum of weights; neighbours without a value don't count."""
    lag = weights.join(z.select(F.col("_k").alias("to_key"), F.col("_z").alias("_n")), "to_key").groupBy("from_key").agg(F.sum(F.col("weight") * F.col("_n")).alias("_lag"), F.sum("weight").alias("_w"))
    return z.join(lag, F.col("_k") == F.col("from_key"), "left").select("_k", "_z", F.coalesce("_lag", F.lit(0.0)).alias("_lag"), F.coalesce("_w", F.lit(0.0)).alias("_w"))


def morans_i(values: DataFrame, weights: DataFrame, key: str, value: str) -> DataFrame:
    """One row: n, moran_i, expected_i (without autocorrelation). Null where the values have no spread or no point has neighbours (PLN-2)."""
    s = _lags(_deviations(values, key, value), weights).agg(F.count("*").alias("n"), F.sum(F.col("_z") * F.col("_lag")).alias("_c"), F.sum("_w").alias("_s"), F.sum(F.col("_z") * F.col("_z")).alias("_q"))
    return s.select("n", F.try_divide(F.col("n") * F.col("_c"), F.nullif(F.col("_s") * F.col("_q"), F.lit(0.0))).alias("moran_i"), F.try_divide(F.lit(-1.0), F.col("n") - 1).alias("expected_i"))


def local_morans(values: DataFrame, weights: DataFrame, key: str, value: str) -> DataFrame:
    """key, local_i, quadrant of each point with a value: HH, LL, HL or LH by the signs of its own and its neighbours' deviation, a zero counting as high (PLN-2)."""
    d = _lags(_deviations(values, key, value), weights)
    m = d.agg(F.avg(F.col("_z") * F.col("_z")).alias("_m2"))
    high = lambda c: F.when(F.col(c) >= 0, "H").otherwise("L")
    return d.crossJoin(F.broadcast(m)).select(F.col("_k").alias(key), F.try_divide(F.col("_z") * F.col("_lag"), F.nullif(F.col("_m2"), F.lit(0.0))).alias("local_i"), F.concat(high("_z"), high("_lag")).alias("quadrant"))  # m is one row


def permuted(values: DataFrame, key: str, value: str, rounds: int, seed: int) -> DataFrame:
    """_k, _i, _z, round, _r, _zr: in each round every point gets the deviation of the point at place _r, a random order of all; _i is its own place.

    The order is that of a hash of seed, round and key, numbered over buckets, so that no round is sorted in one task.
    """
    base = cut(running_total(_deviations(values, key, value), [], ["_k"], F.lit(1), "_i"), "places")
    drawn = base.withColumn("round", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn("_h", F.xxhash64(F.lit(seed), "round", "_k"))
    numbered = running_total(drawn, ["round"], ["_h", "_k"], F.lit(1), "_r").drop("_h")
    return numbered.join(base.select(F.col("_i").alias("_r"), F.col("_z").alias("_zr")), "_r").select("_k", "_i", "_z", "round", "_r", "_zr")


def permutation_tests(values: DataFrame, weights: DataFrame, key: str, value: str, rounds: int = 199, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """One row (n, moran_i, expected_i, p_value), and key, local_i, quadrant, p_value of each point (PLN-2).

    A pseudo p is (1 + the rounds at or beyond the observed value, on the side with fewer) / (rounds + 1). For local
    values a point keeps its own value and its neighbours get those of others: the point whose turn it would be to get
    this point's value gets the one this point would have got.
    """
    drawn = cut(permuted(values, key, value, rounds, seed), "permuted")
    other = drawn.select(F.col("_k").alias("to_key"), "round", F.col("_r").alias("_q"), F.col("_zr").alias("_n"))
    own = drawn.select(F.col("_k").alias("from_key"), "round", "_i", "_z", F.col("_zr").alias("_own"))
    pairs = weights.join(other, "to_key").join(own, ["from_key", "round"])
    held = F.when(F.col("_q") == F.col("_i"), F.col("_own")).otherwise(F.col("_n"))
    lags = cut(pairs.groupBy("from_key", "round").agg(F.first("_z").alias("_z"), F.first("_own").alias("_own"), F.sum(F.col("weight") * held).alias("_lag"), F.sum(F.col("weight") * F.col("_n")).alias("_all")), "lags")
    seen = cut(_lags(_deviations(values, key, value), weights), "seen")
    sums = seen.agg(F.sum(F.col("_z") * F.col("_lag")).alias("_c"), F.avg(F.col("_z") * F.col("_z")).alias("_m2"))  # one row
    p = lambda beyond, n: (1 + F.least(beyond, n - beyond)) / (n + 1)
    reached = lambda now, then: now >= then - F.lit(1e-9) * F.col("_m2")  # noqa: E731  sums of the same values in another order are equal
    by_round = lags.groupBy("round").agg(F.sum(F.col("_own") * F.col("_all")).alias("_now")).crossJoin(F.broadcast(sums))
    tested = by_round.agg(F.count_if(reached(F.col("_now"), F.col("_c"))).alias("_b"))
    whole = morans_i(values, weights, key, value).crossJoin(F.broadcast(tested)).select("n", "moran_i", "expected_i", p(F.col("_b"), F.lit(rounds)).alias("p_value"))
    then = seen.select(F.col("_k").alias("from_key"), F.col("_lag").alias("_then"))
    counts = lags.join(then, "from_key").crossJoin(F.broadcast(sums)).groupBy("from_key").agg(F.count_if(reached(F.col("_z") * F.col("_lag"), F.col("_z") * F.col("_then"))).alias("_b"))
    local = local_morans(values, weights, key, value).join(counts, F.col(key) == F.col("from_key"), "left").withColumn("p_value", p(F.col("_b"), F.lit(rounds))).drop("from_key", "_b")
    return whole, local
