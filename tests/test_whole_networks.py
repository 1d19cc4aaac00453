"""The searches over whole tables against brute force; no order key divides by 97 or 23, and suppliers go beyond 50."""

import random

import pytest

from geomart.plans import catalog

RANDOM = random.Random(4)
LINES = [(k, n, RANDOM.randint(1, 9), RANDOM.choice([3, 8, 40, 51, 60, 77, 80, 99]), float(RANDOM.randint(1, 50))) for k in range(1, 40) if k % 23 for n in range(1, RANDOM.randint(2, 6))]
PRIORITY = {k: RANDOM.choice(["1-URGENT", "2-HIGH", "3-MEDIUM"]) for k in range(1, 40)}
STOPS = [3, 8, 40, 51, 60, 77, 80, 99, 120]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = f"file://{tmp_path_factory.mktemp('whole')}"
    spark.createDataFrame(LINES, "l_orderkey long, l_linenumber int, l_partkey long, l_suppkey long, l_quantity double").write.parquet(f"{d}/lineitem.parquet")
    spark.createDataFrame(list(PRIORITY.items()), "o_orderkey long, o_orderpriority string").write.parquet(f"{d}/orders.parquet")
    spark.createDataFrame([(k,) for k in STOPS], "s_suppkey long").write.parquet(f"{d}/supplier.parquet")
    return d


def pairs():
    return [(a, b) for a, b in zip(LINES, LINES[1:]) if a[0] == b[0]]


def settle(state, steps):
    """Least cost per key, by repeating all steps until nothing improves."""
    while True:
        better = {}
        for key, cost in state.items():
            for k, c in steps(key, cost):
                if c < min(state.get(k, c + 1), better.get(k, c + 1)):
                    better[k] = c
        if not better:
            return state
        state |= better


def test_reachability_over_all_orders(spark, folder):
    rides = {}
    for a, b in pairs():
        key = (a[3], b[3], PRIORITY[a[0]][0])
        rides[key] = max(rides.get(key, 0), 60 + 10 * int(b[4]))

    def steps(key, cost):
        for (f, t, r), seconds in rides.items():
            total = cost + (0 if r == key[2] else 300 if key[2] == "" else 420) + seconds
            if f == key[1] and total <= 1800:
                yield (key[0], t, r), total

    want = {}
    for (o, s, _), c in settle({(k, k, ""): 0 for k in STOPS}, steps).items():
        want[o, s] = min(c, want.get((o, s), c))
    assert len(want) > 2 * len(STOPS)
    assert {(r["origin"], r["stop"]): r["elapsed"] for r in catalog.reachability_30min_whole(spark, folder).collect()} == want


def test_connections_of_all_suppliers(spark, folder):
    hops = [(a[3], b[3], a[1] * 200 + a[0] % 900, b[1] * 200 + b[0] % 900 + 60) for a, b in pairs()]

    def steps(key, cost):
        for f, t, leaves, gets in hops:
            if f == key[1] and cost <= leaves <= gets <= 1500:
                yield (key[0], t), gets

    want = settle({(k, k): 300 for k in STOPS}, steps)
    assert len(want) > 2 * len(STOPS)
    assert {(r["origin"], r["stop"]): r["arrival"] for r in catalog.connection_scan_whole(spark, folder).collect()} == want
