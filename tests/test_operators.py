"""Operators on hand-computed cases and against plain Python."""

import heapq
import io
import math
import random
import struct
import zipfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from geomart.functions import codes, compat, geo
from geomart.operators import access, features, gaps, network, odmart, polygon, recommend, routing, spatial
from geomart.sources import readers, sinks
from geomart.streaming import windows


def one(spark, expr):
    return spark.range(1).select(expr.alias("x")).first()["x"]


def rows(df, *cols):
    return sorted(tuple(r[c] for c in cols or df.columns) for r in df.collect())


def column(df, key, value):
    return {r[key]: r[value] for r in df.collect()}


def test_clock(spark):
    assert one(spark, codes.clock_seconds(F.lit("25:10:05"))) == 90605
    for bad in ("7:60:00", "-1:00:00", "x"):
        with pytest.raises(Exception, match="not a clock time"):
            one(spark, codes.clock_seconds(F.lit(bad)))


def test_codes(spark):
    for raw, admin, cut in (("1123071000", "11230710", "11230710"), ("11230710.0", "11230710", "11230710"), ("123456789", "123456789", "12345678"), ("7", "00000007", "00000007")):
        assert (one(spark, codes.admin_code(F.lit(raw))), one(spark, codes.admin_code_cut(F.lit(raw)))) == (admin, cut)
    assert one(spark, codes.area_code(F.lit("12345678.0"))) == "12345678" and one(spark, codes.plain_id(F.lit("12.0"))) == "12"
    for name, words, service in (("호프-간이주점", "여가문화", "식사"), ("반찬가게", "식사", "쇼핑"), ("의약품", "생활서비스", "쇼핑"), ("커피-음료", "카페", "카페"), ("우주선", "생활서비스", None)):
        assert (one(spark, codes.purpose_by_words(F.lit(name))), one(spark, codes.purpose_by_service(F.lit(name)))) == (words, service)
    assert one(spark, codes.station_key(F.lit("서울 역(1호선)역"))) == "서울역" and one(spark, codes.trip_purpose(F.lit("4"))) == "쇼핑" and one(spark, codes.trip_purpose(F.lit("x"))) == "미상"
    tiers = {0.25: "broad_25pct", 0.2499: "excluded_below_25pct", 0.5: "base_50pct", 0.8: "stable_80pct", 1.0: "stable_80pct", 1.2: None}
    assert all(one(spark, codes.candidate_tier(F.lit(r))) == t for r, t in tiers.items())
    df = spark.createDataFrame([("식사", 1.0, 2.0, None)], "p string, `시간대_11~14_매출_금액` double, `시간대_17~21_매출_금액` double, `극장_수` double")
    assert df.select(codes.purpose_hours(df.columns, F.col("p"))).first()[0] == 3.0 and df.select(codes.purpose_facilities(df.columns, F.col("p"))).first()[0] == 0.0


def test_ranks_and_scores(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 1.0), ("a", 2.0), ("a", 5.0), ("b", 3.0), ("b", 3.0), ("b", 3.0)], "g string, x double")
    assert rows(compat.percentile_score(df, "x", "p", "g"), "g", "p") == [("a", 37.5), ("a", 37.5), ("a", 75.0), ("a", 100.0), ("b", 50.0), ("b", 50.0), ("b", 50.0)]
    z = spark.createDataFrame([(1, 1.0), (1, 3.0), (2, 2.0), (2, 2.0)], "g int, x double").withColumn("z", compat.zscore0("x", "g"))
    assert rows(z, "g", "z") == [(1, -1.0), (1, 1.0), (2, 0.0), (2, 0.0)]
    e = compat.entropy(spark.createDataFrame([(1, 1), (1, 1), (1, 0), (2, 0), (2, 0)], "g int, n int"), ["g"], "n")
    assert column(e, "g", "entropy") == {1: pytest.approx(math.log(2)), 2: 0.0}
    w = compat.weighted_median_lower(spark.createDataFrame([(10, 1), (20, 1), (30, 2)], "v int, w int"), "v", "w")
    assert w.first()["weighted_median"] == 20
    d = spark.createDataFrame([(1.0, None, None), (None, None, None), (2.0, 2.0, 1.0)], "a double, b double, c double")
    assert [r[0] for r in d.select(compat.row_sum_or_null("a", "b")).collect()] == [1.0, None, 4.0]
    assert [r[0] for r in d.select(compat.arg_max_name(["a", "b", "c"])).collect()] == ["a", "a", "a"]
    assert [r[0] for r in d.select(compat.arg_max_from_middle(["a", "b", "c"], ["A", "B", "C"])).collect()] == ["A", "none", "A"]
    s = compat.persistence_summary(spark.createDataFrame([(1, 1.0), (1, 3.0), (1, -1.0), (2, None)], "k int, g double"), ["k"], "g")
    assert {r["k"]: (r["same_sign_quarters"], r["gap_cv"]) for r in s.collect()} == {1: (2, pytest.approx(np.std([1, 3, -1]))), 2: (0, None)}
    with pytest.raises(ValueError, match="lacks columns: z"):
        compat.require_columns(d, ["a", "z"])
    with pytest.raises(Exception, match="duplicate key"):
        compat.unique_or_raise(df, "g").count()
    assert rows(compat.null_safe_join(spark.createDataFrame([(None, 1), (2, 2)], "k int, a int"), spark.createDataFrame([(None, 5), (3, 6)], "k int, b int"), ["k"])) == [(None, 1, 5)]


def test_network(spark):
    st = spark.createDataFrame([("A", "p", 1, "08:00:00", "08:00:00"), ("A", "q", 2, "08:02:00", "08:03:00"), ("A", "r", 3, "08:05:00", "08:05:00"), ("B", "p", 1, "25:00:00", "25:00:00")], "trip_id string, stop_id string, stop_sequence int, arrival_time string, departure_time string")
    assert rows(network.connections(st), "from_stop_id", "to_stop_id", "departure", "arrival") == [("p", "q", 28800, 28920), ("q", "r", 28980, 29100)]
    cal = spark.createDataFrame([("wk", "20260101", "20261231", *"1111100"), ("we", "20260101", "20261231", *"0000011")], "service_id string, start_date string, end_date string, monday string, tuesday string, wednesday string, thursday string, friday string, saturday string, sunday string")
    exc = spark.createDataFrame([("wk", "20260505", "2"), ("hol", "20260505", "1")], "service_id string, date string, exception_type string")
    assert rows(network.active_services(cal, exc, "2026-05-05")) == [("hol",)] and rows(network.active_services(cal, exc, "2026-05-04")) == [("wk",)]
    runs = spark.createDataFrame([("a", 1.0), ("b", 4.0), ("c", 60.0), ("d", 0.0)], "r string, n double")
    assert column(network.frequency_waits(runs, "r", "n"), "r", "wait_seconds") == {"a": 900, "b": 450, "c": 60}
    dep = spark.createDataFrame([("m", "s", 0), ("m", "s", 300), ("m", "s", 700), ("m", "t", 0), ("m", "t", 5000)], "line string, stop string, sec int")
    assert network.headway_waits(dep, "line", ["stop"], "sec").first()["wait_seconds"] == 175
    stops = spark.createDataFrame([("r", "R", 1, "a"), ("r", "R", 2, "b"), ("r", "R", 3, "c")], "route_id string, route_name string, stop_sequence int, stop_id string")
    seen = spark.createDataFrame([("r", "a", "b", 60.0), ("r", "a", "b", 80.0), ("r", "b", "c", 0.0), ("x", "y", "z", 200.0)], "route_id string, from_stop_id string, to_stop_id string, s double")
    assert rows(network.bus_edges(stops, seen, "s"), "from_stop_id", "duration_seconds", "duration_source") == [("a", 70.0, "hourly_median"), ("b", 80.0, "network_median")]
    raw = spark.createDataFrame([("1", "150.0", "A", "DAY", "U", "G", "T1", None, "08:00:00"), ("1", "151", "B", "DAY", "U", "G", "T1", "08:02:00", "08:02:30"), ("1", "152", "C", "DAY", "U", "G", "T1", "08:05:00", None), ("1", "150", "A", "SAT", "U", "G", "T9", None, "09:00:00")], "l string, c string, n string, d string, w string, e string, t string, a string, p string")
    tt = network.metro_timetable(raw, dict(line="l", station_code="c", station_name="n", day="d", direction="w", express="e", train="t", arrival="a", departure="p"))
    assert rows(network.metro_edges(tt, F.concat(F.lit("m_"), "station_code")), "from_stop_id", "to_stop_id", "duration_seconds") == [("m_150", "m_151", 120.0), ("m_151", "m_152", 150.0)]


def plain_search(access_, rides, walks, waits, cutoff=1800, penalty=120):
    best, heap = {}, [(s, stop, "") for stop, s in access_.items() if s <= cutoff]
    heapq.heapify(heap)
    while heap:
        t, stop, route = heapq.heappop(heap)
        if (stop, route) in best:
            continue
        best[stop, route] = t
        for a, b, s in walks:
            if a == stop and t + s <= cutoff:
                heapq.heappush(heap, (t + s, b, ""))
        for a, b, r, s in rides:
            if a == stop:
                u = t + s + (0 if r == route else waits.get(r, 300) + (penalty if route else 0))
                if u <= cutoff:
                    heapq.heappush(heap, (u, b, r))
    out = {}
    for (stop, _), t in best.items():
        out[stop] = min(t, out.get(stop, t))
    return out


def spark_search(spark, access_, rides, walks, waits, **options):
    a = spark.createDataFrame([("o", k, v) for k, v in access_.items()], "origin string, stop string, seconds int")
    r = spark.createDataFrame([(*x[:3], "none", float(x[3])) for x in rides], "from_stop string, to_stop string, route string, mode string, seconds double")
    w = spark.createDataFrame(walks, "from_stop string, to_stop string, seconds int")
    q = spark.createDataFrame(list(waits.items()), "route string, wait int")
    return column(routing.multimodal(a, r, w, q, routing.Search(**options)), "stop", "elapsed")


def test_search_cases(spark):
    go = lambda rides, walks: spark_search(spark, {"a": 0}, rides, walks, {"X": 60, "Y": 60}, cutoff=600)
    assert go([("a", "b", "X", 100), ("b", "c", "Y", 100)], []) == {"a": 0, "b": 160, "c": 440}
    assert go([("a", "b", "X", 100), ("b", "c", "X", 100)], []) == {"a": 0, "b": 160, "c": 260}
    assert go([("a", "b", "X", 100), ("b2", "c", "Y", 100)], [("b", "b2", 30)]) == {"a": 0, "b": 160, "b2": 190, "c": 350}
    assert spark_search(spark, {"a": 0}, [("a", "b", "Z", 100)], [], {}) == {"a": 0, "b": 400}


def test_search_equals_plain(spark):
    rng = random.Random(4)
    stops = [f"s{k}" for k in range(25)]
    rides = [(rng.choice(stops), rng.choice(stops), rng.choice("XYZ"), rng.randint(30, 400)) for _ in range(60)]
    walks = [(rng.choice(stops), rng.choice(stops), rng.randint(20, 200)) for _ in range(20)]
    access_ = {"s0": 0, "s1": 100}
    small = spark_search(spark, access_, rides, walks, {"X": 90}, cutoff=1200)
    assert small == plain_search(access_, rides, walks, {"X": 90}, 1200)
    assert set(small) <= set(plain_search(access_, rides, walks, {"X": 90}, 1800))


def test_connection_scan(spark):
    hops = spark.createDataFrame([("p", "q", 100, 200), ("q", "r", 150, 300), ("q", "r", 250, 400)], "from_stop string, to_stop string, departure int, arrival int")
    acc = spark.createDataFrame([("o", "p", 60)], "origin string, stop string, seconds int")
    walks = spark.createDataFrame([("q", "w", 50)], "from_stop string, to_stop string, seconds int")
    assert column(routing.connection_scan(acc, hops, walks, 0, 300), "stop", "arrival") == {"p": 60, "q": 200, "w": 250}


def square(key, x, y, size, part=0, hole=False, ring=0):
    p = [(x, y), (x + size, y), (x + size, y + size), (x, y + size)]
    return [(key, part, ring, hole, *map(float, (*a, *b))) for a, b in zip(p, p[1:] + p[:1])]


EDGES = "z string, part int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double"


def test_points_in_polygons(spark):
    edges = spark.createDataFrame(square("a", 0, 0, 10) + square("a", 4, 4, 2, hole=True, ring=1) + square("a", 20, 0, 5, part=1) + square("b", 5, 5, 10), EDGES)
    pts = spark.createDataFrame([(1, 1.0, 1.0), (2, 5.0, 5.0), (3, 22.0, 2.0), (4, 0.0, 3.0), (5, 30.0, 30.0), (6, 8.0, 8.0), (7, 15.5, 12.0)], "k int, x double, y double")
    find = lambda **o: rows(spatial.point_in_polygon(pts, edges, "k", ["z"], **o))
    assert find() == find(size=3.0) == [(1, "a"), (3, "a"), (6, "a"), (6, "b")]
    assert (4, "a") in find(boundary=True) and (7, "b") in find(reach=0.5) and (7, "b") not in find(reach=0.4)
    order = spark.createDataFrame([("b", 0), ("a", 1)], "z string, place int")
    assert column(spatial.first_polygon(pts, edges, "k", "z", order), "k", "z")[6] == "b"


def test_areas(spark):
    a = spark.createDataFrame(square("a", 0, 0, 10) + square("a", 4, 4, 2, hole=True, ring=1), EDGES)
    b = spark.createDataFrame(square("b", 5, 5, 10) + square("c", 50, 50, 1), EDGES).withColumnRenamed("z", "w")
    assert polygon.areas(a, "z").first()["area"] == 96.0
    r = polygon.overlay_shares(a, b, "z", "w", 4.0).collect()
    assert [(x["z"], x["w"], round(x["overlap"], 9), round(x["share"], 9)) for x in r] == [("a", "b", 24.0, 0.25)]
    shapes = spark.createDataFrame([(o, k, *e[1:2], *e[4:]) for o, k, e in [*(("o", 0, e) for e in square("", 0, 0, 5)), *(("o", 1, e) for e in square("", 3, 0, 5)), *(("p", 0, e) for e in square("", 9, 9, 5))]], "o string, shape int, part int, x1 double, y1 double, x2 double, y2 double")
    zone = spark.createDataFrame(square("z", 0, 0, 10), EDGES)
    assert [(x["o"], round(x["ratio"], 9)) for x in polygon.coverage(zone, shapes, "z", "o").collect()] == [("o", 0.4)]
    tri = np.array([(0, 0, 4, 0), (4, 0, 0, 4), (0, 4, 0, 0)], float)
    assert polygon.covered_area([tri]) == pytest.approx(8) and polygon.covered_area([tri, tri + [2, 0, 2, 0]]) == pytest.approx(2)


def test_projection_and_distance(spark):
    xy = spark.range(1).select(*[c.alias(n) for n, c in zip("xyuv", (*geo.to_5181(F.lit(127.0), F.lit(38.0)), *geo.to_5179(F.lit(127.5), F.lit(38.0))))]).first()
    assert [round(v, 6) for v in xy] == [200000, 500000, 1000000, 2000000]
    a, b = (spark.range(1).select(*geo.to_5181(F.lit(127.0 + k), F.lit(37.5))).first() for k in (0.0, 0.01))
    east = math.hypot(b[0] - a[0], b[1] - a[1])
    e2, s = 0.006694380022903, math.sin(math.radians(37.5))
    assert east == pytest.approx(6378137 / math.sqrt(1 - e2 * s * s) * math.cos(math.radians(37.5)) * math.radians(0.01), rel=1e-7)
    north = spark.range(1).select(*geo.to_5181(F.lit(127.0), F.lit(38.01))).first()[1] - 500000
    assert north == pytest.approx(6378137 * (1 - e2) / (1 - e2 * math.sin(math.radians(38.005)) ** 2) ** 1.5 * math.radians(0.01), rel=1e-7)
    rng = random.Random(1)
    p = [(k, 127 + rng.random() / 50, 37.5 + rng.random() / 50) for k in range(120)]
    df = spark.createDataFrame(p, "k int, lon double, lat double")

    def metres(a, b):
        h = math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
        return 2 * 6371000 * math.asin(math.sqrt(h))

    assert [x[:2] for x in rows(spatial.radius_join(df, df, 450, "k", "k"))] == sorted((a[0], b[0]) for a in p for b in p if metres(a, b) <= 450)


def test_access(spark):
    f = lambda x: spark.createDataFrame(x, "k string, r double")
    c = access.combine_periods({8: f([("a", 0.6), ("b", 0.5)]), 14: f([("a", 0.7)]), 19: f([("a", 0.5), ("c", 0.1)])}, ["k"], "r")
    assert column(c, "k", "time_stability") == {"a": "all_three_periods", "b": "one_period", "c": "below_threshold"}
    assert column(access.area_access(c, ["k"]), "k", "access_tier")["a"] == "base_50pct_all_periods"
    o = access.overlap_scores(spark.createDataFrame([(1, x) for x in (1, 2, 3)], "g int, i int"), spark.createDataFrame([(1, x) for x in (2, 3, 4)], "g int, i int"), ["g"], "i").first()
    assert (o["true_positive"], o["false_positive"], o["false_negative"], o["jaccard"]) == (2, 1, 1, 0.5) and o["precision"] == pytest.approx(2 / 3)
    pairs = spark.createDataFrame([("d", "o1", "s1", 10.0, "bus"), ("d", "o2", "s2", 20.0, "bus"), ("d", "o2", "s3", 5.0, "metro"), (None, "o1", "s4", 1.0, "bus")], "dong string, origin string, stop string, travel_minutes double, mode string")
    r = {x["dong"]: x for x in access.candidate_areas(access.area_by_mode(pairs, ["dong"]), ["dong"], 4).collect()}
    assert (r["d"]["reachable_origin_count"], r["d"]["reachable_stop_count"], r["d"]["median_travel_minutes"], r["d"]["candidate_tier"]) == (2, 3, 10.0, "base_50pct") and None in r


def test_gaps(spark):
    z = spark.createDataFrame([("a", x) for x in (1.0, 1.2, 1.5, -2.0)] + [("b", x) for x in (-1.0, -1.1, -3.0)] + [("c", None)], "k string, gap_z double")
    assert column(gaps.persistent_gaps(z, ["k"]), "k", "gap_type") == {"a": "목적소비형", "b": "통과형", "c": "일반형"}
    rng = np.random.default_rng(0)
    x, fold = rng.normal(size=(90, 2)), np.arange(90) % 3
    y = x @ [2.0, -1.0] + 0.5 + 0.1 * rng.normal(size=90)
    df = spark.createDataFrame([(int(f), float(a), float(b), float(c)) for f, (a, b), c in zip(fold, x, y)], "f int, a double, b double, y double")
    found = {(r["a"], r["b"]): r["prediction"] for r in gaps.ridge_out_of_fold(df, ["a", "b"], "y", "f").collect()}
    for k in range(3):
        t = fold != k
        m, s = x[t].mean(0), x[t].std(0)
        q = (x[t] - m) / s
        w = np.linalg.solve(q.T @ q + np.eye(2), q.T @ (y[t] - y[t].mean()))
        for row in x[~t]:
            assert found[tuple(row)] == pytest.approx(((row - m) / s) @ w + y[t].mean(), abs=1e-9)
    scores = compat.regression_scores(gaps.ridge_out_of_fold(df, ["a", "b"], "y", "f"), "y", "prediction").first()
    assert scores["r2"] > 0.98 and scores["rows"] == 90
    boosted = gaps.boosted_out_of_fold(df, ["a", "b"], "y", "f", rounds=5, least=3)
    assert boosted.filter("prediction is null").count() == 0
    assert gaps.best_model(gaps.compare_models({"ridge": gaps.ridge_out_of_fold(df, ["a", "b"], "y", "f"), "boosted": boosted}, "y")).first()["model"] == "ridge"
    folds = column(gaps.balanced_group_folds(spark.createDataFrame([("a",)] * 5 + [("b",)] * 4 + [("c",)] * 3 + [("d",)], "g string"), "g", 2), "g", "fold")
    assert folds == {"a": 1, "b": 2, "c": 2, "d": 1}
    wide, names = gaps.one_hot(spark.createDataFrame([(1,), (2,)], "q int"), "q")
    assert rows(wide, "q", *names) == [(1, 1.0, 0.0), (2, 0.0, 1.0)]


def test_recommend(spark):
    rows_ = [("g", "b", 10, 5.0, 1.0), ("g", "a", 10, 5.0, 2.0), ("g", "c", 5, 7.0, 3.0), ("h", "x", 20, None, 1.0), ("h", "y", 10, 9.0, 4.0), ("i", "p", 9, None, None), ("i", "q", 8, 1.0, 2.0)]
    d = recommend.recommend(spark.createDataFrame(rows_, "g string, id string, m int, s double, p double"), ["g"], "id", "m", "s", "p", k=2)
    assert rows(d, "g", "place", "id", "basis") == [("g", 1, "c", "same-condition-historical-inflow"), ("g", 2, "a", "same-condition-historical-inflow"), ("h", 1, "y", "global-popularity"), ("h", 2, "x", "global-popularity"), ("i", 1, "q", "shortest-travel-time"), ("i", 2, "p", "shortest-travel-time")]
    why = lambda *a: one(spark, recommend.exclusion(F.lit(a[0]), F.lit(a[1]), F.lit(a[2]), 30, F.lit(a[3])))
    assert [why(True, True, 30, True), why(False, True, 99, False), why(True, True, 31, False), why(True, True, 3, False)] == [None, "NO_ROUTE_OR_UNVERIFIED_ROUTE", "OVER_MAX_TRAVEL_TIME", "UNSUPPORTED_OR_UNVERIFIED_CONDITION"]
    m = recommend.ranking_metrics(spark.createDataFrame([(1, 1, 0), (1, 2, 1), (1, 9, 1)], "g int, p int, r int"), ["g"], "p", "r").first()
    assert m["recall_at_k"] == 0.5 and m["reciprocal_rank"] == 0.5


def test_panel_and_flows(spark):
    f = spark.createDataFrame([(20251, "a", "x", 1), (20252, "a", "y", 3), (20251, "b", "x", 2)], "q int, e string, p string, n int")
    panel = features.purpose_panel(f, ("q", "e", "p"), {"n": F.sum("n")})
    assert panel.count() == 8 and panel.agg(F.sum("n")).first()[0] == 6
    s = features.scored_panel(panel, ("q", "e", "p"), {"n": 1.0}, {"n": 1.0})
    assert s.filter("q = 20251 and purpose_rank is not null").count() == 0 and s.filter("q = 20252 and purpose_rank is null").count() == 0
    od = spark.createDataFrame([("1", "10", "5", 1.0, None, 2.0), ("9", "x", "5", None, None, None)], "MOVE_PURPOSE string, MOVE_TIME string, MOVE_DIST string, MALE_05_CNT double, FEML_65_CNT double, MALE_70_CNT double")
    r = {x["purpose_name"]: x for x in odmart.with_derived(od).collect()}
    assert r["출근"]["movement_total"] == 3.0 and r["출근"]["남성_60대이상_이동량"] == 2.0 and r["출근"]["여성_10대_이동량"] == 0.0 and r["미상"]["movement_total"] is None and r["미상"]["move_time_min"] is None
    asof = features.asof_latest(spark.createDataFrame([(1, 5), (1, 3), (2, 1)], "k int, t int"), spark.createDataFrame([(1, 3, "a"), (1, 4, "b")], "k int, t int, v string"), ["k"], "t", "v")
    assert rows(asof.fillna("-")) == [(1, 3, "-"), (1, 5, "b"), (2, 1, "-")]


def test_readers(spark, tmp_path):
    text = "코드,이름,값\n1,가,\n2,나,3\n"
    (tmp_path / "k.csv").write_bytes(text.encode("cp949"))
    (tmp_path / "u.csv").write_bytes(text.encode("utf-8-sig"))
    with zipfile.ZipFile(tmp_path / "z.zip", "w") as z:
        z.writestr("in/a.csv", text.encode("cp949"))
        z.writestr("in/stops.txt", "stop_id,stop_name\n7,x\n")
    want = [("1", "가", None), ("2", "나", "3")]
    for path, archive in (("k.csv", None), ("u.csv", None), ("z.zip", "single"), ("z.zip", "first")):
        got = readers.csv_any(spark, f"file://{tmp_path}/{path}", ["코드", "이름", "값"], archive)
        assert [tuple(r) for r in got.orderBy("코드").collect()] == want
    assert readers.csv_utf8(spark, f"file://{tmp_path}/u.csv", "`코드` int, `이름` string, `값` int").count() == 2
    assert rows(readers.gtfs_table(spark, f"file://{tmp_path}/z.zip", "stops", ["stop_id"])) == [("7",)]
    with pytest.raises(ValueError, match="lacks trips"):
        readers.gtfs_files(spark, f"file://{tmp_path}/z.zip")
    ns = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    book = io.BytesIO()
    with zipfile.ZipFile(book, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{ns}" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{ns}"><si><t>id</t></si><si><t>name</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{ns}"><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>1</v></c></row><row><c r="A2"><v>5</v></c><c r="C2" t="inlineStr"><is><t>five</t></is></c></row></sheetData></worksheet>')
    (tmp_path / "b.xlsx").write_bytes(book.getvalue())
    assert rows(readers.excel_sheet(spark, f"file://{tmp_path}/b.xlsx", "Data", ["id", "name"])) == [("5", "five")]
    ring = [(0, 0), (0, 2), (2, 2), (2, 0), (0, 0)]
    body = struct.pack("<i4d2ii", 5, 0, 0, 2, 2, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in ring)
    shp = bytes(100) + struct.pack(">ii", 1, len(body) // 2) + body
    dbf = struct.pack("<BBBBIHH20x", 3, 0, 0, 0, 1, 65, 9) + b"CODE".ljust(11, b"\0") + b"C" + bytes(4) + bytes([8]) + bytes(15) + b"\r" + b" " + b"77".ljust(8)
    with zipfile.ZipFile(tmp_path / "s.zip", "w") as z:
        z.writestr("a.shp", shp)
        z.writestr("a.dbf", dbf)
    edges = readers.shapefile_edges(spark, f"file://{tmp_path}/s.zip", ["CODE"])
    assert polygon.areas(edges, "CODE").first()["area"] == 4.0
    (tmp_path / "f.geojson").write_text('{"features":[{"properties":{"code":"1"},"geometry":{"type":"Polygon","coordinates":[[[0,0],[2,0],[2,2],[0,2],[0,0]]]}},{"properties":{"code":"2"},"geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0],[1,1],[0,0]]],[[[5,5],[6,5],[6,6],[5,6],[5,5]]]]}}]}')
    feats = readers.geojson_features(spark, f"file://{tmp_path}/f.geojson", ["code"])
    assert column(polygon.areas(geo.polygon_edges(feats, "geometry", ["code"]), "code"), "code", "area") == {"1": 4.0, "2": 1.5}
    assert readers.feature_by_code(feats, "2").count() == 1
    with pytest.raises(Exception, match="not one feature"):
        readers.feature_by_code(feats, "9").count()
    assert '"type":"Feature"' in sinks.feature_lines(feats, "geometry", ["code"]).first()["value"]
    cache = tmp_path / "cache"
    cache.mkdir()
    (cache / "a.json").write_text('{"result":{"geojson":{"features":[{"geometry":{"type":"Polygon","coordinates":[]}}]},"station":[{"stationClass":2,"x":1.5,"y":2,"stationID":9,"stationName":"s"}]}}')
    (cache / "b.json").write_text('{"error":[{"code":"-8","message":"no"}]}')
    (cache / "c.json").write_text("{broken")
    p = readers.cached_payloads(spark, f"file://{cache}")
    assert rows(p, "name") == [("a",), ("b",)] and rows(readers.payload_errors(p)) == [("b", "-8", "no")] and rows(readers.isochrone_features(p), "name") == [("a",)] and readers.stations(p.filter("name = 'a'")).first()["station_id"] == "9"
    assert "| a |" in sinks.markdown_table(p.select("name")) and '"n":2' in sinks.run_metadata(p, n=F.count("*"), v="x").first()["value"]


def test_streams(spark, tmp_path):
    folder, schema = f"file://{tmp_path}/in", "user_id long, ts timestamp"
    spark.sql("select 1L as user_id, timestamp'2026-01-01 00:10:00' as ts union all select 1L, timestamp'2026-01-01 00:40:00' union all select 2L, timestamp'2026-01-01 01:10:00'").write.parquet(folder)
    q = windows.hourly_counts(windows.file_stream(spark, folder, schema), "ts", ["user_id"]).writeStream.outputMode("complete").format("memory").queryName("hours").start()
    g = windows.gaps(windows.file_stream(spark, folder, schema), "user_id", "ts").writeStream.outputMode("append").format("memory").queryName("gaps").start()
    for s in (q, g):
        s.processAllAvailable()
        s.stop()
    assert sorted(r["n"] for r in spark.table("hours").collect()) == [1, 2]
    assert [(r["key"], r["gap_seconds"]) for r in spark.table("gaps").collect()] == [(1, 1800.0)]


def test_isochrones_and_explanations(spark):
    from geomart.operators import explain, isochrones

    found = spark.createDataFrame([(1, "9", "중앙역", "2", 1.0, 2.0), (2, "8", "중앙(구)", "1", 5.0, 6.0), (3, "7", "남", "1", 0.0, 0.0)], "place int, station_id string, station_name string, line string, x double, y double")
    merged = {r["station_key"]: r for r in isochrones.merge_stations(found).collect()}
    assert (merged["중앙"]["x"], merged["중앙"]["station_ids"], merged["중앙"]["lines"]) == (1.0, "8|9", "1|2") and len(merged) == 2
    shapes = spark.createDataFrame([("o", 0, *e[1:2], *e[4:]) for e in square("", 0, 0, 5)], "o string, shape int, part int, x1 double, y1 double, x2 double, y2 double")
    zones = spark.createDataFrame(square("z", 0, 0, 10), EDGES)
    assert [(r["z"], r["origin_count"], r["origin_ratio"], r["origins"]) for r in isochrones.district_coverage(zones, shapes, "z", "o", 2).collect()] == [("z", 1, 0.5, "o")]
    stops = spark.createDataFrame([("s", 1.0, 1.0), ("t", 11.0, 1.0)], "s string, x double, y double")
    pairs = isochrones.stops_in(stops, zones, "s", "z", 4.0)
    assert rows(isochrones.stop_summary(pairs, "s", "z", 4)) == [("s", 1, 0.25)]
    assert rows(isochrones.latest_of(spark.createDataFrame([(1, 20251), (2, 20252)], "k int, q int"), "q"), "k") == [(2,)]
    mix = explain.purpose_mix(spark.createDataFrame([("a", "x", 1), ("a", "y", 3)], "k string, p string, n int"), ["k"], "p", "n").first()
    assert (mix["dominant_purpose"], mix["dominant_share"]) == ("y", 0.75)
    text = one(spark, explain.gap_text(F.lit(1.5), F.lit("목적소비형"), F.lit("식사"), F.lit("20대"), F.lit("17~21"), F.lit(""), F.lit(None).cast("string")))
    assert "1.50배" in text and "높은" in text and "보류" not in text
    b = explain.paired_bootstrap(spark.createDataFrame([(k, 1.0 + k % 3, 0.5) for k in range(60)], "id int, a double, b double"), "a", "b", 200).first()
    assert b["low"] < 1.5 < b["high"] and b["mean_difference"] == pytest.approx(1.5)


def test_join_unique_with_hot_and_null_keys(spark):
    from geomart.functions.tables import join_unique

    left = spark.createDataFrame([(1, i) for i in range(300)] + [(k, k) for k in range(2, 40)] + [(None, 7)], "k long, v long")
    right = spark.createDataFrame([(1, "a"), (2, "b"), (None, "n"), (99, "z")], "k long, w string")
    got = lambda how: sorted(((r[0], r[1], r[2]) for r in join_unique(left, right, ["k"], how, share=20).select("k", "v", "w").collect()), key=repr)
    want = [(1, i, "a") for i in range(300)] + [(2, 2, "b")]
    assert got("inner") == sorted(want, key=repr)
    assert got("left") == sorted([*want, *((k, k, None) for k in range(3, 40)), (None, 7, None)], key=repr)


def test_shared_folder_is_never_made_on_a_cluster():
    from geomart.functions.tables import shared_dir

    class Conf(dict):
        set = dict.__setitem__

    session = type("S", (), {})()
    session.conf = Conf({"spark.master": "spark://host:7077"})
    with pytest.raises(RuntimeError):
        shared_dir(session)
    session.conf = Conf({"spark.master": "local[2]"})
    assert shared_dir(session).startswith("file://") and session.conf["spark.checkpoint.dir"]


def test_exact_quantiles(spark):
    import random

    import numpy as np
    from pyspark.sql import functions as F

    from geomart.functions import compat

    rnd = random.Random(2)
    data = [(g, v) for g, n in (("a", 1), ("b", 2), ("c", 997), (None, 50)) for v in [float(rnd.choice([rnd.gauss(0, 1), 3, -1e9])) for _ in range(n)]] + [("a", None), ("empty", None)]
    df = spark.createDataFrame(data, "g string, v double")
    for q in (0.0, 0.05, 0.5, 0.99, 1.0):
        want = {g: np.quantile([v for h, v in data if h == g and v is not None], q) for g in ("a", "b", "c", None)}
        for accuracy in (100_000, 60):  # 60: the large group by a sketch
            found = {r["g"]: r["quantile"] for r in compat.exact_quantile(df, "v", q, ["g"], accuracy=accuracy).collect()}
            assert found == pytest.approx(want)
        assert compat.exact_quantile(df, "v", q).first()[0] == pytest.approx(np.quantile([v for _, v in data if v is not None], q))
    assert compat.exact_quantile(df.filter("v is null"), "v", 0.5).first()[0] is None
    big = spark.range(200_000).select(F.pmod(F.xxhash64("id"), F.lit(1_000_003)).cast("double").alias("v"))
    assert compat.exact_quantile(big, "v", 0.3, accuracy=2000).first()[0] == pytest.approx(np.quantile([r["v"] for r in big.collect()], 0.3))


def test_trips_of_the_day_rules(spark):
    from pyspark.errors import PySparkException

    from geomart.operators import network

    trips = spark.createDataFrame([(1, "a"), (2, "b")], "trip_id int, service_id string")
    assert network.trips_of_the_day(trips, None, None, "2026-05-04").count() == 2
    exceptions = spark.createDataFrame([("b", "20260504", "1")], "service_id string, date string, exception_type string")
    assert [r["trip_id"] for r in network.trips_of_the_day(trips, None, exceptions, "2026-05-04").collect()] == [2]
    with pytest.raises(PySparkException, match="no service runs"):
        network.trips_of_the_day(trips, None, exceptions, "2026-05-05").collect()


def test_projections_come_back(spark):
    from pyspark.sql import functions as F

    from geomart.functions import geo

    p = spark.createDataFrame([(124.0 + i * 0.8, 33.0 + j * 0.65) for i in range(11) for j in range(11)], "lon double, lat double")
    for there, back in ((geo.to_5181, geo.from_5181), (geo.to_5179, geo.from_5179)):
        d = p.select("*", *[c.alias(n) for n, c in zip("xy", there(F.col("lon"), F.col("lat")))])
        d = d.withColumn("p", back(F.col("x"), F.col("y"))).select("*", F.col("p")[0].alias("u"), F.col("p")[1].alias("v"))
        away = d.agg(F.max(geo.haversine_m(F.col("lon"), F.col("lat"), F.col("u"), F.col("v")))).first()[0]
        assert away < 0.001


def test_one_collection(spark, tmp_path):
    import json

    from pyspark.sql import functions as F

    from geomart.functions import geo
    from geomart.sources import sinks

    square = '{"type": "Polygon",\n "coordinates": [[[200000, 500000], [200010, 500000], [200010, 500010], [200000, 500000]]]}'
    multi = square.replace("Polygon", "MultiPolygon").replace("[[[", "[[[[").replace("]]]", "]]]]")
    rows = [(i, [square, multi, None, '{"type":"Point","coordinates":[200000,500000]}'][i % 4], f'a "b"\n{i}') for i in range(400)]
    df = spark.createDataFrame(rows, "id int, g string, name string").repartition(7)
    degrees = df.withColumn("g", geo.reproject(F.col("g"), geo.from_5181))
    for chunk in (1 << 20, 17):
        sinks.write_collection(degrees, f"file://{tmp_path}/out/all.geojson", "g", ["id", "name"], chunk)
        held = json.loads((tmp_path / "out/all.geojson").read_text())
        assert held["type"] == "FeatureCollection" and sorted(f["properties"]["id"] for f in held["features"]) == list(range(400))
        by = {f["properties"]["id"]: f for f in held["features"]}
        assert by[5]["properties"]["name"] == 'a "b"\n5' and by[2]["geometry"] is None
        assert by[0]["geometry"]["coordinates"][0][0] == pytest.approx([127.0, 38.0]) and by[1]["geometry"]["coordinates"][0][0][3] == pytest.approx([127.0, 38.0]) and by[3]["geometry"]["coordinates"] == pytest.approx([127.0, 38.0])
        assert [p.name for p in (tmp_path / "out").iterdir() if not p.name.endswith(".crc")] == ["all.geojson"]
    sinks.write_collection(degrees.limit(0), f"file://{tmp_path}/out/none.geojson", "g", ["id"])
    assert json.loads((tmp_path / "out/none.geojson").read_text())["features"] == []


def test_report_rows(spark):
    from pyspark.sql import functions as F

    from geomart.sources import sinks

    df = spark.range(500).select("id", F.when(F.col("id") % 3 > 0, F.col("id") * 2).alias("twice")).repartition(5)
    lines = [r["value"] for r in sinks.markdown_rows(df, ["id"]).orderBy("line").collect()]
    assert lines == ["| id | twice |", "|---|---|", *(f"| {i} | {i * 2 if i % 3 else ''} |" for i in range(500))]


def test_requests_resume_without_a_second_call(spark, tmp_path):
    from pyspark.errors import StreamingQueryException

    from geomart.streaming import requests

    calls, cache = tmp_path / "calls", f"file://{tmp_path}/answers"
    calls.mkdir()

    def call(name, request):
        (calls / f"{name.replace('/', '_')}-{len(list(calls.glob(name.replace('/', '_') + '-*')))}").write_text(request)
        if (calls.parent / "down").exists() and name.startswith("d"):
            raise OSError("service is down")
        return '{"error":"bad"}' if name.startswith("x") else f'{{"of":"{name}"}}'

    good = lambda answer: "error" not in answer
    made = lambda: sorted(p.name for p in calls.iterdir())
    rows = [("a/1", "q"), ("b", "q"), ("b", "p"), ("c", None), ("d", "q"), ("x", "q"), (None, "q")]
    spark.createDataFrame(rows, "name string, request string").repartition(3).write.parquet(f"{tmp_path}/requests")
    stream = lambda: spark.readStream.schema("name string, request string").parquet(f"{tmp_path}/requests")
    run = lambda budget: requests.fetch_stream(stream(), call, good, cache, budget, f"{tmp_path}/checkpoint").awaitTermination()
    (tmp_path / "down").touch()
    with pytest.raises(StreamingQueryException):
        run(10)
    before = set(made())
    (tmp_path / "down").unlink()
    run(10)
    assert {"a_1-0", "b-0", "c-0", "x-0"} <= set(made()) and [n for n in made() if n.endswith("-1")] == ["d-1"] and before <= set(made())
    assert (calls / "b-0").read_text() == "p"
    assert sorted(r["name"] for r in requests.answers(spark, cache).collect()) == ["a/1", "b", "c", "d"]
    assert [(r["name"], r["payload"]) for r in requests.answers(spark, cache, "quarantine").collect()] == [("x", '{"error":"bad"}')]
    n = len(made())
    spark.createDataFrame([(f"n{i}", "q") for i in range(6)] + [("x", "q"), ("b", "q")], "name string, request string").write.mode("append").parquet(f"{tmp_path}/requests")
    with pytest.raises(StreamingQueryException, match="spent"):
        run(8)  # five are spent
    assert len(made()) == n + 3
    run(11)
    assert len(made()) == n + 6 and requests.answers(spark, cache).count() == 10


def test_zipped_csv_in_blocks(spark, tmp_path):
    import csv
    import io
    import zipfile

    from geomart.sources import archives, readers

    rows = [[str(i), "가나" * (i % 5) + f'"{i}",\n다' if i % 7 == 0 else f"값{i}", "x" * (i % 40)] for i in range(3000)]
    out = io.StringIO()
    w = csv.writer(out)
    w.writerow(["번호 ", "이름", "그밖"])
    w.writerows(rows)
    for k, (encoding, kind) in enumerate([("cp949", zipfile.ZIP_DEFLATED), ("utf-8-sig", zipfile.ZIP_STORED)]):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w", kind) as z:
            z.writestr("in/table.csv", out.getvalue().encode(encoding))
            z.writestr("in/readme.txt", "no table")
    want = sorted((r[0], r[1]) for r in rows) * 2
    for block in (1 << 26, 4096, 257):
        df = readers.csv_any(spark, f"file://{tmp_path}", ["번호", "이름"], archive="single", block=block)
        assert sorted((r["번호"], r["이름"]) for r in df.collect()) == sorted(want)
    assert df.rdd.getNumPartitions() > 400 and df.columns == ["번호", "이름"]
    blocks = archives.ZippedCsv({"path": str(tmp_path), "block": "4096"})
    assert blocks.schema().names == ["번호", "이름", "그밖"] and len(blocks.reader(blocks.schema()).partitions()) > 30
    with pytest.raises(Exception, match="lacks columns"):
        readers.csv_any(spark, f"file://{tmp_path}/0.zip", ["없음"], archive="table.csv").collect()
    with pytest.raises(Exception, match="no member"):
        readers.csv_any(spark, str(tmp_path), ["번호"], archive="other.csv").collect()
    with zipfile.ZipFile(tmp_path / "empty.zip", "w") as z:
        z.writestr("e.csv", "a,b\n")
    assert readers.csv_any(spark, str(tmp_path / "empty.zip"), ["b"], archive="first").collect() == []
    with zipfile.ZipFile(tmp_path / "bare.zip", "w") as z:
        z.writestr("e.csv", "a,b\n1,2")
    assert [tuple(r) for r in readers.csv_any(spark, str(tmp_path / "bare.zip"), ["b", "a"], archive="first").collect()] == [("2", "1")]


def test_crowded_keys_are_dealt(spark):
    from pyspark.sql import functions as F

    from geomart.functions.tables import join_dealt

    key = F.when(F.col("id") % 10 > 0, F.lit(7)).otherwise(F.col("id") % 97)
    big = spark.range(20_000).select("id", key.alias("k"), F.when(F.col("id") % 500 == 0, None).otherwise(F.lit("a")).alias("j"))
    small = spark.createDataFrame([(7, "a", "x"), (7, "a", "y"), (3, "a", "z"), (500, "a", "w"), (None, "a", "v")], "k long, j string, v string")
    got = join_dealt(big, small, ["k", "j"])
    assert got.columns == ["k", "j", "id", "v"]
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, big.join(small, ["k", "j"]).collect()))


def test_crowded_cells(spark):
    """Nine tenths of the points lie in one cell: no task gets more than twice the median's rows."""
    from pyspark.sql import functions as F

    from geomart.operators import spatial

    p = spark.range(12_000).select("id", *[F.when(F.col("id") % 10 > 0, F.pmod(F.xxhash64("id", F.lit(s)), F.lit(1000)) / 1000.0).otherwise(F.pmod(F.xxhash64("id", F.lit(s)), F.lit(20_000)) / 1000.0).alias(s) for s in "xy"])
    square = lambda z, a, b: [(z, 0, 0, False, float(u[0]), float(u[1]), float(v[0]), float(v[1])) for u, v in zip([(a, a), (b, a), (b, b), (a, b)], [(b, a), (b, b), (a, b), (a, a)])]
    edges = spark.createDataFrame([r for k in range(20) for r in square(f"z{k}", k * 0.9, k * 0.9 + 1)], "z string, part int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double")
    found = spatial.point_in_polygon(p, edges, "id", ["z"])
    want = p.crossJoin(F.broadcast(spark.range(20).select((F.col("id") * 0.9).alias("a"), F.concat(F.lit("z"), "id").alias("z")))).filter("x > a and x < a + 1 and y > a and y < a + 1")
    assert sorted((r["id"], r["z"]) for r in found.collect()) == sorted((r["id"], r["z"]) for r in want.select(p["id"], "z").collect())
    from geomart.functions.tables import join_dealt

    cells = p.withColumn("c", F.floor("x") * 100 + F.floor("y"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sizes = sorted(r["n"] for r in join_dealt(cells, cells.select("c").distinct(), ["c"]).groupBy(F.spark_partition_id()).agg(F.count("*").alias("n")).collect())
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert len(sizes) == 4 and sizes[-1] < 2 * sizes[len(sizes) // 2]
