"""Registered queries of the analyses on the driver's tables, each beside SQL that gives the same rows.

Entities are nations and suppliers, quarters come from ship dates, purposes are part types, sales are discounted prices,
trips are orders and stops are suppliers. Money is decimal until the last step, so no sum depends on its order.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, compat
from ..operators import access, features, network, routing, spatial

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

FACT = """
fact AS (
    SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS BIGINT) AS qty,
           year(l_shipdate) * 10 + quarter(l_shipdate) AS quarter, year(l_shipdate) AS yr, month(l_shipdate) AS mon,
           n_name AS nation, p_type, p_name, p_size,
           CAST(CAST(l_extendedprice AS DECIMAL(12,2)) * (1 - CAST(l_discount AS DECIMAL(4,2))) AS DECIMAL(18,4)) AS revenue
    FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN part ON l_partkey = p_partkey
)"""


def query(sql: str):
    def add(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return add


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def money(c: str) -> Column:
    return F.col(c).cast("decimal(12,2)")


def fact(spark: SparkSession, d: str) -> DataFrame:
    li, s, n, p = (table(spark, d, x) for x in ("lineitem", "supplier", "nation", "part"))
    joined = li.join(s, li.l_suppkey == s.s_suppkey).join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(p, F.col("l_partkey") == F.col("p_partkey"))
    ship = F.col("l_shipdate")
    return joined.select(
        "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("long").alias("qty"),
        (F.year(ship) * 10 + F.quarter(ship)).cast("long").alias("quarter"), F.year(ship).cast("long").alias("yr"), F.month(ship).cast("long").alias("mon"),
        F.col("n_name").alias("nation"), "p_type", "p_name", "p_size",
        (money("l_extendedprice") * (1 - F.col("l_discount").cast("decimal(4,2)"))).cast("decimal(18,4)").alias("revenue"),
    )


def r6(c: Column | str) -> Column:
    return F.round((F.col(c) if isinstance(c, str) else c).cast("double"), 6)


PANEL_SQL = f"""
WITH {FACT}, sums AS (
    SELECT quarter, nation, p_type, count(DISTINCT l_partkey) AS stores, sum(revenue) AS sales, count(*) AS lines FROM fact GROUP BY ALL
), grid AS (
    SELECT * FROM (SELECT DISTINCT quarter FROM sums) CROSS JOIN (SELECT DISTINCT nation FROM sums) CROSS JOIN (SELECT DISTINCT p_type FROM sums)
), panel AS (
    SELECT g.*, coalesce(stores, 0) AS stores, coalesce(sales, 0) AS sales, coalesce(lines, 0) AS lines FROM grid g LEFT JOIN sums USING (quarter, nation, p_type)
), long AS (
    SELECT quarter, nation, p_type, m, CAST(v AS DOUBLE) AS v FROM (SELECT quarter, nation, p_type, CAST(stores AS DOUBLE) AS stores, CAST(sales AS DOUBLE) AS sales, CAST(lines AS DOUBLE) AS lines FROM panel) UNPIVOT (v FOR m IN (stores, sales, lines))
), pct AS (
    SELECT *, CASE WHEN min(v) OVER w = max(v) OVER w THEN 50.0 ELSE (rank() OVER (PARTITION BY quarter, p_type, m ORDER BY v) + (count(*) OVER (PARTITION BY quarter, p_type, m, v) - 1) / 2.0) / count(*) OVER w * 100 END AS p
    FROM long WINDOW w AS (PARTITION BY quarter, p_type, m)
), wide AS (
    SELECT quarter, nation, p_type, max(p) FILTER (m = 'stores') AS stores_pct, max(p) FILTER (m = 'sales') AS sales_pct, max(p) FILTER (m = 'lines') AS lines_pct FROM pct GROUP BY ALL
), score AS (
    SELECT *, 0.65 * stores_pct + 0.35 * lines_pct AS supply, 0.5 * sales_pct + 0.5 * lines_pct AS signal FROM wide
), lagged AS (
    SELECT *, lag(signal) OVER (PARTITION BY nation, p_type ORDER BY quarter) AS before FROM score
), final AS (
    SELECT *, round(0.7 * supply + 0.3 * before, 9) AS path FROM lagged
)"""


def scored(spark: SparkSession, d: str) -> DataFrame:
    keys = ("quarter", "nation", "p_type")
    panel = features.purpose_panel(fact(spark, d), keys, {"stores": F.count_distinct("l_partkey"), "sales": F.sum("revenue"), "lines": F.count("*")})
    out = features.scored_panel(panel, keys, {"stores": 0.65, "lines": 0.35}, {"sales": 0.5, "lines": 0.5})
    path = F.round("path_score", 9)
    order = Window.partitionBy("quarter", "p_type").orderBy(path.desc_nulls_last())
    return out.withColumn("path_score", path).withColumn("purpose_rank", F.when(path.isNotNull(), F.rank().over(order).cast("long")))


@query(f"{PANEL_SQL} SELECT quarter, nation, p_type, round(supply, 6) AS supply, round(before, 6) AS lagged_signal, round(path, 6) AS path_score, CASE WHEN path IS NOT NULL THEN rank() OVER (PARTITION BY quarter, p_type ORDER BY path DESC NULLS LAST) END AS purpose_rank FROM final")
def purpose_panel_scores(spark: SparkSession, d: str) -> DataFrame:
    """Dense panel of nation, quarter and part type with percentiles, scores and ranks."""
    return scored(spark, d).select("quarter", "nation", "p_type", r6("purpose_supply_score").alias("supply"), r6("lagged_sales_signal").alias("lagged_signal"), r6("path_score").alias("path_score"), "purpose_rank")


@query(f"{PANEL_SQL} SELECT p_type, nation, row_number() OVER (PARTITION BY p_type ORDER BY path DESC, nation) AS place, round(path, 6) AS path_score FROM final WHERE path IS NOT NULL AND quarter = (SELECT max(quarter) FROM final) QUALIFY place <= 10")
def latest_purpose_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Top ten nations a part type in the latest quarter."""
    s = scored(spark, d)
    latest = s.join(s.agg(F.max("quarter").alias("quarter")), "quarter").filter("path_score is not null")
    return compat.top_k(latest, 10, ["p_type"], [F.desc("path_score"), F.col("nation")]).select("p_type", "nation", "place", r6("path_score").alias("path_score"))


@query(f"WITH {FACT} SELECT p_type, l_suppkey, CAST(sum(revenue) AS DOUBLE) AS revenue, row_number() OVER (PARTITION BY p_type ORDER BY sum(revenue) DESC, l_suppkey) AS place FROM fact GROUP BY p_type, l_suppkey QUALIFY place <= 15")
def top_k_per_group(spark: SparkSession, d: str) -> DataFrame:
    g = fact(spark, d).groupBy("p_type", "l_suppkey").agg(F.sum("revenue").alias("revenue"))
    return compat.top_k(g, 15, ["p_type"], [F.desc("revenue"), F.col("l_suppkey")]).withColumn("revenue", F.col("revenue").cast("double"))


@query(f"WITH {FACT}, r AS (SELECT nation, p_type, row_number() OVER (PARTITION BY nation ORDER BY sum(revenue) DESC, p_type) AS rn FROM fact GROUP BY nation, p_type) SELECT nation, string_agg(p_type, ' · ' ORDER BY rn) AS top3 FROM r WHERE rn <= 3 GROUP BY nation")
def top3_concat(spark: SparkSession, d: str) -> DataFrame:
    g = fact(spark, d).groupBy("nation", "p_type").agg(F.sum("revenue").alias("revenue"))
    return compat.top_k(g, 3, ["nation"], [F.desc("revenue"), F.col("p_type")], "rn").groupBy("nation").agg(compat.ordered_concat("p_type", "rn").alias("top3"))


TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query(f"WITH {FACT}, s AS (SELECT nation, p_type, CAST(sum(revenue) AS DOUBLE) AS a FROM fact GROUP BY ALL), t AS (SELECT nation, p_type, a / sum(a) OVER (PARTITION BY nation) AS s FROM s) SELECT nation, " + ", ".join(f"round(coalesce(max(s) FILTER (p_type = '{t}'), 0.0), 6) AS share_{t}" for t in TYPES) + " FROM t GROUP BY nation")
def share_pivot(spark: SparkSession, d: str) -> DataFrame:
    wide = features.share_pivot(fact(spark, d), ["nation"], "p_type", "revenue", TYPES)
    return wide.select("nation", *[r6(f"share_{t}").alias(f"share_{t}") for t in TYPES])


@query(f"WITH {FACT}, s AS (SELECT nation, mon, CAST(sum(revenue) AS DOUBLE) AS r, CAST(sum(qty) AS DOUBLE) AS q FROM fact GROUP BY ALL), x AS (SELECT nation, mon, r / sum(r) OVER (PARTITION BY nation) AS ss, q / sum(q) OVER (PARTITION BY nation) AS fs FROM s) SELECT nation, mon, round(ss, 6) AS sales_share, round(fs, 6) AS flow_share, round(ss / fs, 6) AS conversion_index FROM x")
def conversion_index(spark: SparkSession, d: str) -> DataFrame:
    c = features.conversion_index(fact(spark, d), ["nation"], "mon", "revenue", "qty")
    return c.select("nation", "mon", r6("sales_share").alias("sales_share"), r6("flow_share").alias("flow_share"), "conversion_index")


@query(f"WITH {FACT}, s AS (SELECT nation, mon, CAST(sum(revenue) AS DOUBLE) AS r, CAST(sum(qty) AS DOUBLE) AS q FROM fact GROUP BY ALL), x AS (SELECT nation, mon, round(r / sum(r) OVER (PARTITION BY nation) / (q / sum(q) OVER (PARTITION BY nation)), 6) AS i FROM s) SELECT nation, arg_max(mon, i * 1000 - mon / 1e6) AS peak_month FROM x GROUP BY nation")
def peak_conversion_month(spark: SparkSession, d: str) -> DataFrame:
    """Column-wise arg-max over a pivot of twelve months, the first of equals."""
    c = features.conversion_index(fact(spark, d), ["nation"], "mon", "revenue", "qty")
    wide = c.groupBy("nation").pivot("mon", list(range(1, 13))).agg(F.max("conversion_index"))
    return wide.select("nation", compat.arg_max_name([str(m) for m in range(1, 13)]).cast("long").alias("peak_month"))


@query(f"WITH {FACT}, s AS (SELECT l_suppkey, quarter, p_type, CAST(count(*) AS DOUBLE) AS n FROM fact GROUP BY ALL), p AS (SELECT l_suppkey, quarter, n / sum(n) OVER (PARTITION BY l_suppkey, quarter) AS p FROM s) SELECT l_suppkey, quarter, round(-sum(p * ln(p)), 6) + 0.0 AS entropy FROM p GROUP BY ALL")
def entropy_by_group(spark: SparkSession, d: str) -> DataFrame:
    n = fact(spark, d).groupBy("l_suppkey", "quarter", "p_type").agg(F.count("*").alias("n"))
    return compat.entropy(n, ["l_suppkey", "quarter"], "n").select("l_suppkey", "quarter", (r6("entropy") + 0.0).alias("entropy"))


@query("""
WITH o AS (SELECT year(o_orderdate) * 10 + quarter(o_orderdate) AS quarter, c_nationkey AS nation, c_mktsegment AS segment, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total, count(*) AS orders FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL)
SELECT quarter, nation, segment, coalesce(total, 0.0) AS total, coalesce(orders, 0) AS orders
FROM (SELECT DISTINCT quarter FROM o) CROSS JOIN (SELECT DISTINCT nation FROM o) CROSS JOIN (SELECT DISTINCT segment FROM o) LEFT JOIN o USING (quarter, nation, segment)""")
def dense_grid_fill(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    o = o.select((F.year("o_orderdate") * 10 + F.quarter("o_orderdate")).cast("long").alias("quarter"), F.col("c_nationkey").alias("nation"), F.col("c_mktsegment").alias("segment"), money("o_totalprice").alias("p"))
    return features.purpose_panel(o, ("quarter", "nation", "segment"), {"total": F.sum("p").cast("double"), "orders": F.count("*")})


ORDER_KEY = ["l_linenumber", "l_partkey", "l_suppkey"]
EDGES_SQL = """
hops AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER w AS b, CAST(lead(l_quantity) OVER w AS DOUBLE) AS q, l_orderkey FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey))"""


def hops(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", *ORDER_KEY, "l_quantity")
    h = network.consecutive(li, ["l_orderkey"], ORDER_KEY, {"l_suppkey": "b", "l_quantity": "q"})
    return h.select("l_orderkey", F.col("l_suppkey").alias("a"), "b", "q")


@query(f"WITH {EDGES_SQL} SELECT a, b, median(q) AS median_q, count(*) AS n FROM hops WHERE b IS NOT NULL AND q > 0 AND q < 45 GROUP BY a, b")
def consecutive_edges(spark: SparkSession, d: str) -> DataFrame:
    return hops(spark, d).filter("q > 0 and q < 45").groupBy("a", "b").agg(F.median("q").alias("median_q"), F.count("*").alias("n"))


@query(f"""WITH {EDGES_SQL}, own AS (SELECT a, b, median(nullif(q, 50)) AS m FROM hops WHERE b IS NOT NULL AND l_orderkey % 3 = 0 GROUP BY a, b), whole AS (SELECT median(nullif(q, 50)) AS m FROM hops WHERE b IS NOT NULL AND l_orderkey % 3 = 0),
e AS (SELECT DISTINCT a, b FROM hops WHERE b IS NOT NULL)
SELECT e.a, e.b, coalesce(own.m, whole.m) AS seconds, CASE WHEN own.m IS NOT NULL THEN 'hourly_median' ELSE 'network_median' END AS source FROM e LEFT JOIN own USING (a, b) CROSS JOIN whole""")
def hourly_fallback_median(spark: SparkSession, d: str) -> DataFrame:
    """Edge medians from one hour's observations, else the network's median. Here the hour is orders whose key divides by 3, and 50 counts as no observation."""
    h = hops(spark, d)
    seen = h.filter("l_orderkey % 3 = 0").withColumn("s", F.when(F.col("q") != 50, F.col("q")))
    return network.fill_by_median(h.select("a", "b").distinct(), seen, ["a", "b"], "s", "seconds", "source", ("hourly_median", "network_median"))


@query("SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS sequence FROM events")
def row_number_resequence(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("user_id", "event_id", F.row_number().over(w).cast("long").alias("sequence"))


@query("""
WITH g AS (SELECT user_id, epoch_us(ts) // 1000000 - lag(epoch_us(ts) // 1000000) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS gap FROM events),
m AS (SELECT user_id, median(gap) AS headway_seconds FROM g WHERE gap > 0 AND gap <= 86400 GROUP BY user_id)
SELECT user_id, headway_seconds, CAST(greatest(60, least(9000, round_even(headway_seconds / 2, 0))) AS INTEGER) AS wait_seconds FROM m""")
def headway_median_wait(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events").withColumn("s", F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1_000_000))
    w = network.headway_waits(e, "user_id", [], "s", longest=86_400)
    return w.select("user_id", "headway_seconds", network.clipped_wait(F.col("headway_seconds") / 2, 60, 9000).alias("wait_seconds"))


@query("""
WITH n AS (SELECT event_type, date_trunc('hour', ts) AS h, count(*) AS runs FROM events GROUP BY ALL), m AS (SELECT event_type, median(runs) AS runs_per_hour FROM n GROUP BY event_type)
SELECT event_type, runs_per_hour, CAST(greatest(60, least(900, round_even(1800.0 / runs_per_hour, 0))) AS INTEGER) AS wait_seconds FROM m""")
def half_headway_wait(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "events").groupBy("event_type", F.date_trunc("hour", "ts").alias("h")).agg(F.count("*").alias("runs"))
    return network.frequency_waits(n, "event_type", "runs")


@query("WITH v AS (SELECT l_returnflag, l_extendedprice AS x, sum(CAST(l_quantity AS BIGINT)) AS w FROM lineitem GROUP BY ALL), c AS (SELECT *, sum(w) OVER (PARTITION BY l_returnflag ORDER BY x) AS run, sum(w) OVER (PARTITION BY l_returnflag) AS total FROM v) SELECT l_returnflag, min(x) AS weighted_median FROM c WHERE 2 * run >= total GROUP BY l_returnflag")
def weighted_median_lower(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_returnflag", "l_extendedprice", F.col("l_quantity").cast("long").alias("w"))
    return compat.weighted_median_lower(li, "l_extendedprice", "w", ["l_returnflag"])


@query("""
WITH known AS (SELECT p_partkey, p_name, p_size, CAST(p_retailprice AS DECIMAL(12,2)) AS price FROM part WHERE p_partkey % 2 = 0), names AS (SELECT p_name, avg(p_size) AS x, CAST(avg(price) AS DOUBLE) AS y FROM known GROUP BY p_name HAVING max(p_size) - min(p_size) < 49 AND max(price) - min(price) < 1900)
SELECT w.p_partkey, w.p_name, round(coalesce(CAST(k.p_size AS DOUBLE), n.x), 6) AS x, round(coalesce(CAST(k.price AS DOUBLE), n.y), 4) AS y, CASE WHEN k.p_partkey IS NOT NULL THEN 'key' ELSE 'name' END AS matched_by
FROM part w LEFT JOIN known k ON w.p_partkey = k.p_partkey LEFT JOIN names n ON w.p_name = n.p_name WHERE k.p_partkey IS NOT NULL OR n.x IS NOT NULL""")
def two_stage_match(spark: SparkSession, d: str) -> DataFrame:
    """By key among even keys, else by a name that lies within bounds."""
    p = table(spark, d, "part")
    known = p.filter("p_partkey % 2 = 0").select("p_partkey", "p_name", (F.col("p_size") / 49).alias("x"), (F.col("p_retailprice") / 1900).alias("y"))
    m = network.two_stage_match(p.select("p_partkey", "p_name"), known, "p_partkey", "p_name", "x", "y", 1.0, ("key", "name"))
    return m.select("p_partkey", "p_name", r6(F.col("x") * 49).alias("x"), F.round(F.col("y") * 1900, 4).alias("y"), "matched_by")


PERIODS = """
e AS (SELECT event_type, hour(ts) AS h, user_id FROM events), total AS (SELECT count(DISTINCT user_id) AS n FROM events),
r AS (SELECT event_type, h, count(DISTINCT user_id) / CAST(n AS DOUBLE) AS ratio FROM e CROSS JOIN total WHERE h IN (8, 14, 19) GROUP BY event_type, h, n)"""


def period_ratios(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "events")
    n = e.agg(F.count_distinct("user_id").alias("n"))
    frames = {h: e.filter(F.hour("ts") == h).groupBy("event_type").agg(F.count_distinct("user_id").alias("k")).crossJoin(n).select("event_type", (F.col("k") / F.col("n")).alias("reachable_origin_ratio")) for h in (8, 14, 19)}
    return access.combine_periods(frames, ["event_type"], threshold=0.4)


@query(f"""WITH {PERIODS}, w AS (SELECT event_type, coalesce(max(ratio) FILTER (h = 8), 0) AS r8, coalesce(max(ratio) FILTER (h = 14), 0) AS r14, coalesce(max(ratio) FILTER (h = 19), 0) AS r19 FROM r GROUP BY event_type), k AS (SELECT *, (r8 >= 0.4)::INT + (r14 >= 0.4)::INT + (r19 >= 0.4)::INT AS n FROM w)
SELECT event_type, round(r8, 6) AS ratio_08, round(r14, 6) AS ratio_14, round(r19, 6) AS ratio_19, n AS periods_above_threshold, round(least(r8, r14, r19), 6) AS minimum_period_ratio, round((r8 + r14 + r19) / 3, 6) AS mean_period_ratio,
CASE n WHEN 0 THEN 'below_threshold' WHEN 1 THEN 'one_period' WHEN 2 THEN 'two_periods' WHEN 3 THEN 'all_three_periods' END AS time_stability FROM k""")
def period_merge_stability(spark: SparkSession, d: str) -> DataFrame:
    p = period_ratios(spark, d)
    return p.select("event_type", *[r6(c).alias(c) for c in ("ratio_08", "ratio_14", "ratio_19")], "periods_above_threshold", r6("minimum_period_ratio").alias("minimum_period_ratio"), r6("mean_period_ratio").alias("mean_period_ratio"), "time_stability")


TIER_SQL = "CASE WHEN {0} >= 0.8 THEN 'core_80pct_all_periods' WHEN {0} >= 0.5 THEN 'base_50pct_all_periods' WHEN {0} >= 0.25 THEN 'exploration_25pct_all_periods' ELSE 'excluded_below_25pct' END"
BIN_SQL = "CASE WHEN {0} < 0.25 THEN 'excluded_below_25pct' WHEN {0} < 0.5 THEN 'broad_25pct' WHEN {0} < 0.8 THEN 'base_50pct' WHEN {0} < 1.001 THEN 'stable_80pct' END"


@query(f"""WITH r AS (SELECT n_name AS nation, count(DISTINCT o_custkey) / CAST((SELECT count(DISTINCT o_custkey) FROM orders) AS DOUBLE) AS ratio FROM orders JOIN lineitem ON o_orderkey = l_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY n_name)
SELECT nation, round(ratio, 6) AS ratio, {TIER_SQL.format('ratio')} AS access_tier, {BIN_SQL.format('ratio')} AS candidate_tier FROM r""")
def access_ratio_tiers(spark: SparkSession, d: str) -> DataFrame:
    """Share of customers that reach a nation's suppliers."""
    o, li, s, n = (table(spark, d, x) for x in ("orders", "lineitem", "supplier", "nation"))
    j = o.join(li, F.col("o_orderkey") == F.col("l_orderkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey")).join(n, F.col("s_nationkey") == F.col("n_nationkey"))
    r = j.groupBy(F.col("n_name").alias("nation")).agg(F.count_distinct("o_custkey").alias("k")).crossJoin(o.agg(F.count_distinct("o_custkey").alias("n"))).withColumn("ratio", F.col("k") / F.col("n"))
    return r.select("nation", r6("ratio").alias("ratio"), codes.access_tier(F.col("ratio")).alias("access_tier"), codes.candidate_tier(F.col("ratio")).alias("candidate_tier"))


@query(f"""WITH {FACT}, m AS (SELECT nation, l_returnflag, count(DISTINCT l_orderkey) AS o, count(DISTINCT l_suppkey) AS s, min(qty) AS lo, median(qty) AS med FROM fact GROUP BY ALL)
SELECT nation, max(o) AS reachable_origin_count, CAST(sum(s) AS BIGINT) AS reachable_stop_count, min(lo) AS minimum_travel_minutes, median(med) AS median_travel_minutes, round(max(o) / max(n), 6) AS reachable_origin_ratio, {BIN_SQL.format('(max(o) / max(n))')} AS candidate_tier FROM m CROSS JOIN (SELECT CAST(count(DISTINCT l_orderkey) AS DOUBLE) AS n FROM lineitem) GROUP BY nation""")
def mode_reaggregation(spark: SparkSession, d: str) -> DataFrame:
    by_mode = access.area_by_mode(fact(spark, d), ["nation"], "l_orderkey", "l_suppkey", "qty", "l_returnflag")
    c = access.candidate_areas(by_mode, ["nation"], table(spark, d, "lineitem").agg(F.count_distinct("l_orderkey")))
    return c.select("nation", "reachable_origin_count", "reachable_stop_count", "minimum_travel_minutes", "median_travel_minutes", r6("reachable_origin_ratio").alias("reachable_origin_ratio"), "candidate_tier")


PLACES_SQL = "places AS (SELECT s_suppkey AS k, 126.8 + (s_suppkey * 37 % 100) / 1000.0 AS lon, 37.4 + (s_suppkey * 61 % 100) / 1000.0 AS lat FROM supplier)"
HAVERSINE = "2 * 6371000 * asin(least(1.0, sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2))))"


def places(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select(F.col("s_suppkey").alias("k"), (F.lit(126.8) + (F.col("s_suppkey") * 37 % 100) / 1000.0).alias("lon"), (F.lit(37.4) + (F.col("s_suppkey") * 61 % 100) / 1000.0).alias("lat"))


@query(f"WITH {PLACES_SQL} SELECT a.k AS k_a, b.k AS k_b, CAST(ceil({HAVERSINE} / 1.2) AS INTEGER) AS seconds FROM places a, places b WHERE {HAVERSINE} <= 1500")
def grid_radius_join(spark: SparkSession, d: str) -> DataFrame:
    """Supplier places within 1500 m through grid cells; the SQL tests every pair."""
    p = places(spark, d)
    return spatial.radius_join(p, p, 1500, "k", "k").select("k_a", "k_b", F.ceil(F.col("metres") / 1.2).cast("int").alias("seconds"))


ZONES = {"square": [[(10, 10), (60, 10), (60, 60), (10, 60)], [(30, 30), (40, 30), (40, 40), (30, 40)]], "triangle": [[(50, 50), (90, 50), (50, 90)]]}


def zone_edges(spark: SparkSession) -> DataFrame:
    rows = [(z, 0, i > 0, float(a[0]), float(a[1]), float(b[0]), float(b[1])) for z, rings in ZONES.items() for i, r in enumerate(rings) for a, b in zip(r, r[1:] + r[:1])]
    return spark.createDataFrame(rows, "zone string, part int, hole boolean, x1 double, y1 double, x2 double, y2 double")


PARTS_XY = "pts AS (SELECT p_partkey AS k, (p_partkey * 37) % 100 + 0.5 AS x, (p_partkey * 61) % 101 + 0.25 AS y FROM part)"


@query(f"""WITH {PARTS_XY} SELECT k, 'square' AS zone FROM pts WHERE x > 10 AND x < 60 AND y > 10 AND y < 60 AND NOT (x > 30 AND x < 40 AND y > 30 AND y < 40)
UNION ALL SELECT k, 'triangle' FROM pts WHERE x > 50 AND y > 50 AND x + y < 140""")
def point_in_polygon(spark: SparkSession, d: str) -> DataFrame:
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 100 + 0.5).alias("x"), (F.col("p_partkey") * 61 % 101 + 0.25).alias("y"))
    return spatial.point_in_polygon(p, zone_edges(spark), "k", ["zone"], size=20.0)


@query(f"""WITH {PARTS_XY}, q AS (SELECT *, greatest(50 - x, 0.0) AS ax, greatest(50 - y, 0.0) AS ay FROM pts),
edges AS (SELECT * FROM (VALUES (50.0, 50.0, 90.0, 50.0), (90.0, 50.0, 50.0, 90.0), (50.0, 90.0, 50.0, 50.0)) v(x1, y1, x2, y2)),
t AS (SELECT k, x, y, x1, y1, x2, y2, greatest(0.0, least(1.0, ((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / ((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)))) AS t FROM pts, edges)
SELECT k FROM t GROUP BY k, x, y HAVING (x > 50 AND y > 50 AND x + y < 140) OR min(sqrt(pow(x - x1 - t * (x2 - x1), 2) + pow(y - y1 - t * (y2 - y1), 2))) <= 7.3""")
def buffered_area_join(spark: SparkSession, d: str) -> DataFrame:
    """Points within 7.3 of the triangle or inside it."""
    p = table(spark, d, "part").select(F.col("p_partkey").alias("k"), (F.col("p_partkey") * 37 % 100 + 0.5).alias("x"), (F.col("p_partkey") * 61 % 101 + 0.25).alias("y"))
    return spatial.point_in_polygon(p, zone_edges(spark).filter("zone = 'triangle'"), "k", ["zone"], reach=7.3, size=20.0).select("k")


def _reachability(spark: SparkSession, d: str, li: DataFrame) -> DataFrame:
    o = table(spark, d, "orders")
    h = network.consecutive(li.select("l_orderkey", *ORDER_KEY, "l_quantity"), ["l_orderkey"], ORDER_KEY, {"l_suppkey": "b", "l_quantity": "q"}).join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    rides = h.groupBy(F.col("l_suppkey").alias("from_stop"), F.col("b").alias("to_stop"), F.substring("o_orderpriority", 1, 1).alias("route")).agg(F.max(60 + 10 * F.col("q").cast("long")).alias("seconds")).withColumn("mode", F.lit("bus"))
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("origin"), F.col("s_suppkey").alias("stop"), F.lit(0).alias("seconds"))
    walks = spark.createDataFrame([], "from_stop long, to_stop long, seconds int")
    waits = spark.createDataFrame([], "route string, wait int")
    return routing.with_minutes(routing.multimodal(s, rides, walks, waits))


def _connections(spark: SparkSession, li: DataFrame, origins: DataFrame) -> DataFrame:
    h = network.consecutive(li.select("l_orderkey", *ORDER_KEY).withColumn("at", F.col("l_linenumber") * 200 + F.col("l_orderkey") % 900), ["l_orderkey"], ORDER_KEY, {"l_suppkey": "to_stop", "at": "next_at"})
    h = h.select(F.col("l_suppkey").alias("from_stop"), "to_stop", F.col("at").cast("int").alias("departure"), (F.col("next_at") + 60).cast("int").alias("arrival")).filter("arrival >= departure")
    s = origins.select(F.col("s_suppkey").alias("origin"), F.col("s_suppkey").alias("stop"), F.lit(0).alias("seconds"))
    return routing.connection_scan(s, h, spark.createDataFrame([], "from_stop long, to_stop long, seconds int"), 300, 1200)


def reachability_30min_whole(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers reachable within 1800 s over the routes of all orders."""
    return _reachability(spark, d, table(spark, d, "lineitem"))


def connection_scan_whole(spark: SparkSession, d: str) -> DataFrame:
    """Earliest arrivals from all suppliers over the lines of all orders."""
    return _connections(spark, table(spark, d, "lineitem"), table(spark, d, "supplier"))


#: Over whole tables, without SQL; tests compare them with brute force.
WITHOUT_SQL: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (reachability_30min_whole, connection_scan_whole)}


@query("""
WITH x AS (SELECT DISTINCT s_nationkey AS g, l_suppkey AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 48 AND l_returnflag = 'R'), y AS (SELECT DISTINCT s_nationkey AS g, l_suppkey AS i FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_discount >= 0.1 AND l_tax >= 0.08 AND l_returnflag = 'A'),
f AS (SELECT coalesce(x.g, y.g) AS g, x.i IS NOT NULL AS a, y.i IS NOT NULL AS b FROM x FULL JOIN y ON x.g = y.g AND x.i = y.i),
n AS (SELECT g, count(*) FILTER (a AND b) AS tp, count(*) FILTER (b AND NOT a) AS fp, count(*) FILTER (a AND NOT b) AS fn FROM f GROUP BY g)
SELECT g AS s_nationkey, tp AS true_positive, fp AS false_positive, fn AS false_negative, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0.0 END, 6) AS "precision", round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0.0 END, 6) AS recall, round(CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0.0 END, 6) AS jaccard FROM n""")
def overlap_prf(spark: SparkSession, d: str) -> DataFrame:
    j = table(spark, d, "lineitem").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    o = access.overlap_scores(j.filter("l_quantity > 48 and l_returnflag = 'R'"), j.filter("l_discount >= 0.1 and l_tax >= 0.08 and l_returnflag = 'A'"), ["s_nationkey"], "l_suppkey")
    return o.select("s_nationkey", "true_positive", "false_positive", "false_negative", *[r6(c).alias(c) for c in ("precision", "recall", "jaccard")])
