"""Spatial, choice, factor and gravity models against plain numpy solvers, on awkward rows too."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomart.operators import autocorrelation, choice, factors, gravity

RANDOM = np.random.default_rng(8)


def nearest_by_hand(rows, k):
    out = set()
    for key, x, y in rows:
        line = sorted((math.hypot(u - x, v - y), other) for other, u, v in rows if other != key)
        out |= {(key, other) for _, other in line[:k]}
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_links_of_crowds_and_outliers(spark, k):
    rows = [(i, float(RANDOM.integers(0, 50)), float(RANDOM.integers(0, 50))) for i in range(150)] + [(200 + i, 5000.0 + i, 7000.0) for i in range(3)] + [(300 + i, 10.0, 10.0) for i in range(9)]
    df = spark.createDataFrame([*rows, (999, None, 1.0)], "id long, x double, y double")
    found = [(r["from_key"], r["to_key"]) for r in autocorrelation.nearest_links(df, "id", k).collect()]
    assert len(found) == len(rows) * k and set(found) == nearest_by_hand(rows, k)


def test_few_points(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.0)], "id long, x double, y double")
    assert sorted((r["from_key"], r["to_key"]) for r in autocorrelation.nearest_links(df, "id", 5).collect()) == [(1, 2), (2, 1)]
    none = df.limit(0)
    assert autocorrelation.nearest_links(none, "id", 3).collect() == []
    w = autocorrelation.row_weights(autocorrelation.nearest_links(none, "id", 3))
    assert autocorrelation.morans_i(none, w, "id", "x").first().asDict() == {"n": 0, "moran_i": None, "expected_i": -1.0} or autocorrelation.morans_i(none, w, "id", "x").first()["moran_i"] is None


def test_permutation_tests(spark):
    n, rounds = 40, 39
    rows = [(i, float(i % 8), float(i // 8), float(i // 8) * 2 + float(RANDOM.random())) for i in range(n)]
    df = spark.createDataFrame([*rows, (77, 3.0, 3.0, None)], "id long, x double, y double, v double")
    w = autocorrelation.row_weights(autocorrelation.nearest_links(df.filter("v is not null"), "id", 4))
    weights = np.zeros((n, n))
    for r in w.collect():
        weights[r["from_key"], r["to_key"]] = r["weight"]
    z = np.array([r[3] for r in rows])
    z -= z.mean()
    i_all, local = n * (z @ weights @ z) / weights.sum() / (z @ z), z * (weights @ z) / (z @ z / n)
    whole, parts = autocorrelation.permutation_tests(df, w, "id", "v", rounds=rounds, seed=3)
    drawn = autocorrelation.permuted(df, "id", "v", rounds, 3).collect()
    at = {r["_k"]: r["_i"] for r in drawn}
    orders = np.zeros((rounds, n), int)  # the point whose value each point gets
    point = {i: k for k, i in at.items()}
    for r in drawn:
        orders[r["round"] - 1, r["_k"]] = point[r["_r"]]
    assert all(sorted(o) == list(range(n)) for o in orders) and len({tuple(o) for o in orders}) == rounds
    fold = lambda b: (1 + min(b, rounds - b)) / (rounds + 1)
    got = whole.first()
    assert got["moran_i"] == pytest.approx(i_all) and got["p_value"] == pytest.approx(fold(sum(z[o] @ weights @ z[o] >= z @ weights @ z - 1e-9 for o in orders)))
    assert got["moran_i"] > 0.5 and got["p_value"] == pytest.approx(1 / 40)
    for r in parts.collect():
        i, beyond = r["id"], 0
        for o in orders:
            values = z[o].copy()
            values[o == i] = z[o[i]]
            beyond += z[i] * (weights[i] @ values) >= z[i] * (weights[i] @ z) - 1e-9
        assert r["local_i"] == pytest.approx(local[i]) and r["p_value"] == pytest.approx(fold(beyond))


def choice_rows():
    rows = []
    for s in range(30):
        x = RANDOM.normal(size=(6, 2))
        p = np.exp(x @ [0.8, -0.5])
        rows += [(s, int(c), float(a), float(b)) for (a, b), c in zip(x, RANDOM.multinomial(50, p / p.sum()))]
    return rows


def newton_by_hand(rows, k):
    groups = {}
    for s, c, *x in rows:
        groups.setdefault(s, []).append((c, x))
    beta = np.zeros(k)
    for _ in range(60):
        g, h = np.zeros(k), np.zeros((k, k))
        for held in groups.values():
            c, x = np.array([a for a, _ in held], float), np.array([b for _, b in held])
            p = np.exp(x @ beta - (x @ beta).max())
            p /= p.sum()
            m = p @ x
            g += c @ x - c.sum() * m
            h += c.sum() * ((x.T * p) @ x - np.outer(m, m))
        beta = beta + np.linalg.solve(h, g)
    return beta, np.sqrt(np.diag(np.linalg.inv(h)))


def test_choice_equals_a_plain_newton_solver(spark):
    rows = choice_rows()
    beta, errors = newton_by_hand(rows, 2)
    more = [(99, 0, 1.0, 2.0), (99, None, 3.0, 1.0), (None, 5, 1.0, 1.0), (3, 7, None, 1.0)]
    df = spark.createDataFrame([(s, c, a, b + 1e4 * (s or 0) if b is not None else None) for s, c, a, b in rows + more], "s long, n int, a double, b double")
    fit = choice.fit_choice(df, "s", "n", ["a", "b"])
    assert fit.coefficients == pytest.approx(beta, abs=1e-7) and fit.errors == pytest.approx(errors, rel=1e-5)
    assert fit.log_likelihood > fit.null_log_likelihood == pytest.approx(-30 * 50 * math.log(6))
    plain = spark.createDataFrame(rows, "s long, n int, a double, b double")
    assert choice.log_likelihood(plain, "s", "n", ["a", "b"], [900.0, -800.0]).first()["log_likelihood"] < -1000
    assert choice.log_likelihood(plain, "s", "n", ["a", "b"], list(beta)).first()["log_likelihood"] == pytest.approx(fit.log_likelihood)
    assert choice.shares(plain, "s", ["a", "b"], list(beta)).groupBy("s").agg(F.sum("share").alias("t")).agg(F.max(F.abs(F.col("t") - 1))).first()[0] < 1e-12


def test_choice_without_a_solution(spark):
    with pytest.raises((RuntimeError, ValueError, np.linalg.LinAlgError)):
        choice.fit_choice(spark.createDataFrame([(1, 1, 0.0), (1, 0, 0.0)], "s long, n int, a double"), "s", "n", ["a"])


def test_factors(spark):
    a = RANDOM.normal(size=(200, 1))
    x = np.hstack([a + 0.4 * RANDOM.normal(size=(200, 1)), -2 * a + RANDOM.normal(size=(200, 1)), RANDOM.normal(size=(200, 1)), 5 + 0 * a])
    df = spark.createDataFrame([*map(tuple, x.tolist()), (None, 1.0, 2.0, 3.0)], "a double, b double, c double, d double")
    fit = factors.fit_factors(df, ["a", "b", "c"])
    r = np.corrcoef(x[:, :3].T)
    values = np.sort(np.linalg.eigvalsh(r))[::-1]
    assert fit.rows == 200 and fit.eigenvalues == pytest.approx(values) and np.abs(fit.vectors).argmax(0).tolist() == [int(np.argmax(v)) for v in fit.vectors.T]
    inverse = np.linalg.inv(r)
    partial = inverse / np.sqrt(np.outer(np.diag(inverse), np.diag(inverse)))
    off = ~np.eye(3, dtype=bool)
    assert fit.kmo == pytest.approx((r[off] ** 2).sum() / ((r[off] ** 2).sum() + (partial[off] ** 2).sum()))
    assert fit.bartlett == pytest.approx(-(199 - 11 / 6) * math.log(np.linalg.det(r))) and fit.freedom == 3 and fit.p_value < 1e-6
    scores = np.array([row["component_1"] for row in factors.component_scores(df.dropna(), fit).collect()])
    z = (x[:, :3] - x[:, :3].mean(0)) / x[:, :3].std(0)
    assert sorted(scores) == pytest.approx(sorted(z @ fit.vectors[:, 0]))
    assert np.var(scores) == pytest.approx(values[0])
    flat = factors.fit_factors(df, ["a", "d"])
    assert flat.eigenvalues == pytest.approx([1, 1]) and flat.p_value == 1.0
    assert factors.fit_factors(df.withColumn("e", F.col("a") * 2), ["a", "e"]).p_value == 0.0
    assert factors.loadings(spark, fit).count() == 9


def test_chi_square_tail():
    assert factors.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05)
    assert factors.chi_square_tail(5.991464547107979, 2) == pytest.approx(0.05)
    assert factors.chi_square_tail(18.307038053275146, 10) == pytest.approx(0.05)
    assert factors.chi_square_tail(12.591587243743977, 6) == pytest.approx(0.05)
    assert factors.chi_square_tail(14.067140449340169, 7) == pytest.approx(0.05)


def poisson_by_hand(rows, no, nd):
    """Newton's method with a dummy for every origin and every destination but one."""
    x = np.zeros((len(rows), no + nd - 1 + 1))
    y = np.array([r[2] for r in rows], float)
    for k, (o, d, _, v) in enumerate(rows):
        x[k, o] = 1
        if d:
            x[k, no + d - 1] = 1
        x[k, -1] = v
    beta = np.zeros(x.shape[1])
    beta[:no] = math.log(y.mean())
    for _ in range(60):
        m = np.exp(x @ beta)
        beta = beta + np.linalg.solve((x.T * m) @ x, x.T @ (y - m))
    return beta[-1], math.sqrt(np.linalg.inv((x.T * m) @ x)[-1, -1]), m


def test_gravity_equals_a_plain_solver(spark):
    rnd = random.Random(4)
    rows = [(o, d, float(RANDOM.poisson(math.exp(1 + o / 4 - d / 5 - 0.7 * (v := rnd.random() * 3)))), v) for o in range(6) for d in range(5) if (o, d) != (2, 3)]
    slope, error, fitted = poisson_by_hand(rows, 6, 5)
    more = [(50, d, 0.0, 1.0) for d in range(5)] + [(o, 60, 0.0, 1.0) for o in range(6)] + [(None, 1, 3.0, 1.0), (1, 1, None, 1.0)]
    fit = gravity.fit_gravity(spark.createDataFrame(rows + more, "o long, d long, y double, v double"), "o", "d", "y", ["v"])
    assert fit.coefficients[0] == pytest.approx(slope, abs=1e-7) and fit.errors[0] == pytest.approx(error, rel=1e-6)
    got = {(r["o"], r["d"]): r["fitted"] for r in fit.fitted.collect()}
    assert got == pytest.approx({(o, d): m for (o, d, _, _), m in zip(rows, fitted)}, rel=1e-6)


def tree_by_hand(x, r, leaves, least, penalty):
    """Grows a tree leaf by leaf, trying every value of every feature as a split of every leaf; leaf of each row and the leaves' values."""
    score = lambda v: v.sum() ** 2 / (len(v) + penalty)
    parts = [np.arange(len(r))]
    while len(parts) < leaves:
        best = (0.0, None)
        for k, part in enumerate(parts):
            for f in range(x.shape[1]):
                for v in np.unique(x[part, f])[:-1]:
                    side = x[part, f] <= v
                    if min(side.sum(), (~side).sum()) >= least:
                        gain = score(r[part[side]]) + score(r[part[~side]]) - score(r[part])
                        if gain > best[0] + 1e-9:
                            best = (gain, (k, f, v))
        if best[1] is None:
            break
        k, f, v = best[1]
        side = x[parts[k], f] <= v
        parts[k : k + 1] = [parts[k][side], parts[k][~side]]
    return parts, [r[p].sum() / (len(p) + penalty) for p in parts]


def test_histogram_boosting_equals_a_search_of_every_split(spark):
    from geomart.operators import boosting

    n = 240
    x = np.column_stack([RANDOM.integers(0, 30, n), RANDOM.integers(0, 12, n)]).astype(float)
    y = np.where(x[:, 0] > 11, 3.0, 0.0) + 0.2 * x[:, 1] + RANDOM.normal(size=n) * 0.3
    fold = RANDOM.integers(0, 3, n)
    rows = [(int(i), float(a), float(b), float(v), f"f{k}") for i, ((a, b), v, k) in enumerate(zip(x, y, fold))]
    df = spark.createDataFrame([*rows, (999, None, 3.0, None, "f1"), (998, None, 3.0, 1.0, None)][:-1], "i long, a double, b double, y double, fold string")
    found, forest = boosting.histogram_out_of_fold(df, ["a", "b"], "y", "fold", rounds=2, rate=0.3, leaves=5, least=10)
    got = {r["i"]: r["prediction"] for r in found.collect()}
    for k in range(3):
        train = np.flatnonzero(fold != k)
        p = np.full(n, y[train].mean())
        for _ in range(2):
            parts, values = tree_by_hand(x[train], (y - p)[train], 5, 10, 1.0)
            lows = [x[train][q].min(0) for q in parts]
            highs = [x[train][q].max(0) for q in parts]
            for i in range(n):
                inside = [j for j in range(len(parts)) if (x[i] >= lows[j]).all() and (x[i] <= highs[j]).all()]
                if i in train:
                    at = next(j for j, q in enumerate(parts) if i in train[q])
                    p[i] += 0.3 * values[at]
                elif len(inside) == 1:
                    p[i] += 0.3 * values[inside[0]]
                else:
                    p[i] = np.nan  # between the rows of two leaves
        for i in np.flatnonzero(fold == k):
            assert np.isnan(p[i]) or got[i] == pytest.approx(p[i])
        assert np.isfinite(p[fold == k]).mean() > 0.7
    assert got[999] is not None and len(forest) == 2 and all(2 <= len(t.leaves) <= 5 for trees in forest for t in trees)
    e = np.array([got[i] for i in range(n)]) - y
    assert (e**2).mean() < 0.6 * y.var()


def test_histogram_boosting_of_one_fold_and_of_no_rows(spark):
    from geomart.operators import boosting

    df = spark.createDataFrame([(1.0, 2.0, 1)], "a double, y double, fold int")
    assert [r["prediction"] for r in boosting.histogram_out_of_fold(df, ["a"], "y", "fold", rounds=2)[0].collect()] == [None]
    assert boosting.histogram_out_of_fold(df.limit(0), ["a"], "y", "fold", rounds=2)[0].collect() == []


def star(n, x, y, r, seed, wild=0.5):
    rng = np.random.default_rng(seed)
    t = np.sort(rng.random(n)) * 2 * np.pi
    d = r * (1 - wild * rng.random(n))
    return [(float(x + a * math.cos(b)), float(y + a * math.sin(b))) for a, b in zip(d, t)]


def ring_edges(spark, shapes, key):
    rows = [(k, 0, i, i > 0, *p, *q) for k, rings in shapes.items() for i, ring in enumerate(rings) for p, q in zip(ring, ring[1:] + ring[:1])]
    return spark.createDataFrame(rows, f"{key} string, part int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double")


@pytest.mark.parametrize("most", [4, 256])
def test_clipped_overlays_equal_the_sweep_over_whole_polygons(spark, most):
    from geomart.operators import clipping, polygon

    a = {"a": [star(40, 0, 0, 10, 1), star(9, 0, 0, 3, 2)], "b": [[(0.0, 0.0), (8.0, 0.0), (8.0, 8.0), (0.0, 8.0)]], "c": [star(25, 6, -3, 7, 3)], "far": [[(90.0, 90.0), (91.0, 90.0), (91.0, 91.0)]]}
    b = {"p": [star(60, 2, 1, 9, 4)], "q": [[(2.0, 2.0), (6.0, 2.0), (6.0, 6.0), (2.0, 6.0)], [(3.0, 3.0), (5.0, 3.0), (5.0, 5.0), (3.0, 5.0)]], "r": [[(8.0, 0.0), (9.0, 0.0), (9.0, 8.0), (8.0, 8.0)]], "s": [[(-50.0, -50.0), (50.0, -50.0), (50.0, 50.0), (-50.0, 50.0)]]}
    left, right = ring_edges(spark, a, "k"), ring_edges(spark, b, "z")
    want = {(r["k"], r["z"]): r["overlap"] for r in polygon.overlay_shares(left, right, "k", "z").collect()}
    got = {(r["k"], r["z"]): r["overlap"] for r in clipping.overlay_areas(left, right, "k", "z", most=most).collect()}
    assert len(want) >= 8 and got == pytest.approx(want, rel=1e-9)
    parts = clipping.overlay(left, right, "k", "z", most=most).filter("k = 'a' and z = 'p'")
    again = parts.groupBy("part").agg(F.sum(F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")).alias("twice"))
    assert again.filter("twice < -1e-9").count() == 0 and again.agg(F.sum("twice") / 2).first()[0] == pytest.approx(want["a", "p"])
    assert clipping.overlay_areas(left.limit(0), right, "k", "z", cell=1.0).collect() == []
    shapes = right.withColumn("origin", F.lit("o")).withColumn("shape", F.col("z"))
    union = {r["k"]: r["ratio"] for r in polygon.coverage(left.filter("k <> 'far'"), shapes.filter("z <> 's'"), "k", "origin", least=0.0).collect()}
    found = {r["k"]: r["share"] for r in clipping.overlay_areas(left, shapes.filter("z <> 's'"), "k", "origin", most=most, shape=["shape", "part"]).collect()}
    assert found == pytest.approx({k: v for k, v in union.items() if v > 0})


def test_large_polygons_in_cells(spark):
    """Two stars of 10,000 vertices, whose whole sweep would cross all edges with all others."""
    from geomart.operators import clipping

    one, two = star(10_000, 0, 0, 10, 5, 0.1), star(10_000, 1, 0, 10, 6, 0.1)
    a, b = ring_edges(spark, {"a": [one]}, "k"), ring_edges(spark, {"b": [two]}, "z")
    cells = clipping.cells(a.withColumn("side", F.lit("")).withColumns({"cx0": F.lit(-10.0), "cy0": F.lit(-10.0), "cx1": F.lit(10.0), "cy1": F.lit(10.0)}), ["k"])
    assert cells.agg(F.max(F.size(F.filter("rows", lambda r: r["kind"] == 0)))).first()[0] <= 256
    shoelace = lambda p: abs(sum(u[0] * v[1] - v[0] * u[1] for u, v in zip(p, p[1:] + p[:1]))) / 2
    around = ring_edges(spark, {"b": [[(-20.0, -20.0), (20.0, -20.0), (20.0, 20.0), (-20.0, 20.0)]]}, "z")
    assert clipping.overlay_areas(a, around, "k", "z").first()["overlap"] == pytest.approx(shoelace(one))
    both = clipping.overlay_areas(a, b, "k", "z").first()["overlap"]
    assert 0.8 * shoelace(one) < both < min(shoelace(one), shoelace(two))


@pytest.mark.parametrize("way", ["sweep", "cells"])
def test_equal_shapes_are_measured_once(spark, monkeypatch, way):
    """30 copies of a star, edges in any order, and one other, against 20 copies of a square with a hole: two overlaps are measured, 620 returned."""
    from geomart.operators import clipping, polygon

    hole = [[(-4.0, -4.0), (6.0, -4.0), (6.0, 6.0), (-4.0, 6.0)], [(0.0, 0.0), (1.0, 0.0), (1.0, 1.0), (0.0, 1.0)]]
    a = ring_edges(spark, {f"a{i}": [star(12, 0, 0, 10, 1)] for i in range(30)} | {"b": [star(12, 0, 0, 10, 2)]}, "k").orderBy(F.rand(3))
    b = ring_edges(spark, {f"z{i}": hole for i in range(20)}, "z")
    module, measure = (polygon, polygon.overlay_shares) if way == "sweep" else (clipping, clipping.overlay_areas)
    whole, measured = polygon.shares_of_all, []

    def counted(found, *rest):
        measured.append(found.count())
        return whole(found, *rest)

    monkeypatch.setattr(module, "shares_of_all", counted)
    got = {(r["k"], r["z"]): r["overlap"] for r in measure(a, b, "k", "z").collect()}
    area = {s: polygon.covered_area([np.array([(*p, *q) for ring in rings for p, q in zip(ring, ring[1:] + ring[:1])]) for rings in ([star(12, 0, 0, 10, s)], hole)]) for s in (1, 2)}
    assert measured == [2] and got == pytest.approx({(k, f"z{i}"): area[1 if k != "b" else 2] for k in [*(f"a{i}" for i in range(30)), "b"] for i in range(20)})


def test_places_and_shapes_are_tested_once(spark, monkeypatch):
    """40 points at two places, one of them also elsewhere, in 30 copies of a square: one hit a place is kept, and counts and firsts equal those of the pairs."""
    from geomart.operators import isochrones, odmart, spatial

    box = lambda x, y, s: [[(x, y), (x + s, y), (x + s, y + s), (x, y + s)]]
    edges = ring_edges(spark, {f"z{i:02}": box(0.0, 0.0, 4.0) for i in range(30)} | {"y": box(3.0, 3.0, 4.0), "far": box(50.0, 50.0, 1.0)}, "z")
    pts = spark.createDataFrame([(k, 1.0 if k < 35 else 3.5, 1.0 if k < 35 else 3.5) for k in range(40)] + [(7, 3.5, 3.5), (8, 1.0, 1.0), (90, 9.0, 9.0)], "k int, x double, y double")
    whole, kept = spatial._hits, []

    def counted(*given):
        hits, like = whole(*given)
        kept.append(hits.count())
        return hits, like

    monkeypatch.setattr(spatial, "_hits", counted)
    want = {k: 30 for k in range(40)} | {k: 31 for k in (7, *range(35, 40))}
    pairs = spatial.point_in_polygon(pts, edges, "k", ["z"])
    assert {r["k"]: r["n"] for r in pairs.groupBy("k").agg(F.count("*").alias("n")).collect()} == want
    assert {r["k"]: (r["reachable_origin_count"], r["reachable_origin_ratio"]) for r in isochrones.stop_reach(pts, edges, "k", "z", 32).collect()} == {k: (n, n / 32) for k, n in want.items()}
    order = edges.select("z").distinct().withColumn("place", F.when(F.col("z") == "z11", 1).when(F.col("z") == "y", 0).otherwise(2))
    found = odmart.crosswalk(pts.filter("k not in (7, 8)").withColumnRenamed("k", "cell_id"), edges, "z", order)
    assert {r["cell_id"]: r["z"] for r in found.collect()} == {k: None if k == 90 else "y" if k >= 35 else "z11" for k in (*range(7), *range(9, 40), 90)}
    assert kept == [3, 3, 3]


def test_scores_that_round_alike_tie_by_name(spark, tmp_path):
    """Prices differ by a ten-millionth between years, so both models' errors round to 0 and the name decides, as in SQL; null keys are a group."""
    import datetime

    import duckdb

    from geomart.plans import catalog, catalog_sources  # noqa: F401

    rows = [(k, 100.0 + (k % 2) * 1e-5, datetime.datetime(1996 + k % 2, 1, 1), "F", [None, "1-URGENT", "2-HIGH"][k % 3]) for k in range(12)]
    spark.createDataFrame(rows, "o_orderkey long, o_totalprice double, o_orderdate timestamp_ntz, o_orderstatus string, o_orderpriority string").write.parquet(f"{tmp_path}/orders.parquet")
    want = duckdb.connect().execute(catalog.SQL["better_model"].replace("FROM orders", f"FROM '{tmp_path}/orders.parquet/*.parquet'")).fetchall()
    assert [tuple(r) for r in catalog.QUERIES["better_model"](spark, f"file://{tmp_path}").collect()] == want == [("priority", 0.0, 0.0)]


def test_flows_are_taken_once(spark):
    """Lines are joined once and their sums kept: what follows reads no fact table."""
    from geomart.plans import catalog_models

    plan = catalog_models.choices(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "l_orderkey" not in plan and "o_orderkey" not in plan
