"""More registered queries: gap models, panels, flows, sets, codes, rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, compat
from ..operators import features, gaps, network, odmart, recommend
from .catalog import FACT, ORDER_KEY, fact, money, query, r6, table

NQ = f"WITH {FACT}, nq AS (SELECT nation, quarter, yr, ln(1 + CAST(sum(revenue) AS DOUBLE)) AS y, ln(1 + CAST(sum(qty) AS DOUBLE)) AS x1, ln(1 + count(DISTINCT l_partkey)) AS x2 FROM fact GROUP BY ALL)"


def nation_quarters(spark: SparkSession, d: str) -> DataFrame:
    g = fact(spark, d).groupBy("nation", "quarter", "yr").agg(F.sum("revenue").cast("double").alias("r"), F.sum("qty").cast("double").alias("q"), F.count_distinct("l_partkey").alias("n"))
    return g.select("nation", "quarter", "yr", F.log1p("r").alias("y"), F.log1p("q").alias("x1"), F.log1p("n").alias("x2"))


GAPS = NQ + ", g AS (SELECT *, y - avg(y) OVER (PARTITION BY nation) AS gap FROM nq), z AS (SELECT *, CASE WHEN stddev_pop(gap) OVER (PARTITION BY quarter) > 0 THEN (gap - avg(gap) OVER (PARTITION BY quarter)) / stddev_pop(gap) OVER (PARTITION BY quarter) ELSE 0.0 END AS z FROM g)"


def nation_gaps(spark: SparkSession, d: str) -> DataFrame:
    q = nation_quarters(spark, d)
    return gaps.residual_gaps(q.withColumn("expected", F.avg("y").over(Window.partitionBy("nation"))), "y", "expected", "quarter")


@query(GAPS + " SELECT nation, count(*) AS quarters_observed, count(*) FILTER (z >= 1) AS positive_gap_quarters, count(*) FILTER (z <= -1) AS negative_gap_quarters, round(avg(z), 6) AS mean_gap_z, CASE WHEN count(*) FILTER (z >= 1) >= 6 THEN '목적소비형' WHEN count(*) FILTER (z <= -1) >= 6 THEN '통과형' ELSE '일반형' END AS gap_type FROM z GROUP BY nation")
def gap_zscore_persistence(spark: SparkSession, d: str) -> DataFrame:
    """Residual z-scores of nations and their class over quarters."""
    return gaps.persistent_gaps(nation_gaps(spark, d), ["nation"], least=6).withColumn("mean_gap_z", r6("mean_gap_z"))


@query(GAPS + " SELECT nation, quarter, round(exp(gap + 0) * 0 + (exp(y) - 1) / greatest(exp(y - gap) - 1, 0), 6) AS gap_ratio, round(z, 6) AS gap_z, CASE WHEN z >= 1 THEN 'above_expected' WHEN z <= -1 THEN 'below_expected' ELSE 'within_expected' END AS gap_direction FROM z")
def gap_directions(spark: SparkSession, d: str) -> DataFrame:
    g = gaps.with_direction(nation_gaps(spark, d))
    return g.select("nation", "quarter", r6("gap_ratio").alias("gap_ratio"), r6("gap_z").alias("gap_z"), "gap_direction")


@query(GAPS + ", m AS (SELECT nation, avg(gap + x2 / 100) AS m, stddev_pop(gap + x2 / 100) AS s FROM z GROUP BY nation) SELECT nation, count(*) FILTER ((gap + x2 / 100) * CASE WHEN m >= 0 THEN 1 ELSE -1 END > 0) AS same_sign_quarters, round(max(s) / abs(max(m)), 6) AS gap_cv FROM z JOIN m USING (nation) GROUP BY nation")
def persistence_summary(spark: SparkSession, d: str) -> DataFrame:
    g = nation_gaps(spark, d).withColumn("gap", F.col("gap_log") + F.col("x2") / 100)
    return compat.persistence_summary(g, ["nation"], "gap").withColumn("gap_cv", r6("gap_cv"))


RIDGE_SQL = NQ + """, f AS (SELECT *, yr AS fold FROM nq), t AS (SELECT a.fold, count(*) AS n, avg(b.x1) AS m1, avg(b.x2) AS m2, avg(b.y) AS my, stddev_pop(b.x1) AS s1, stddev_pop(b.x2) AS s2, covar_pop(b.x1, b.x2) AS c12, covar_pop(b.x1, b.y) AS c1, covar_pop(b.x2, b.y) AS c2 FROM (SELECT DISTINCT fold FROM f) a JOIN f b ON b.fold <> a.fold GROUP BY a.fold),
g AS (SELECT *, n + 1.0 AS a11, n * c12 / (s1 * s2) AS a12, n * c1 / s1 AS b1, n * c2 / s2 AS b2 FROM t), w AS (SELECT *, (b1 * a11 - b2 * a12) / (a11 * a11 - a12 * a12) / s1 AS w1, (b2 * a11 - b1 * a12) / (a11 * a11 - a12 * a12) / s2 AS w2 FROM g),
p AS (SELECT f.*, w1 * x1 + w2 * x2 + (my - w1 * m1 - w2 * m2) AS prediction FROM f JOIN w USING (fold))"""


def ridge(spark: SparkSession, d: str) -> DataFrame:
    return gaps.ridge_out_of_fold(nation_quarters(spark, d), ["x1", "x2"], "y", "yr")


@query(RIDGE_SQL + " SELECT nation, quarter, round(prediction, 5) AS prediction FROM p")
def ridge_oof(spark: SparkSession, d: str) -> DataFrame:
    """Leave-one-year-out ridge predictions of log sales, from sums of products."""
    return ridge(spark, d).select("nation", "quarter", F.round("prediction", 5).alias("prediction"))


@query(RIDGE_SQL + " SELECT CAST(yr AS VARCHAR) AS split, count(*) AS rows, round(sqrt(avg((y - prediction) * (y - prediction))), 5) AS rmse, round(avg(abs(y - prediction)), 5) AS mae, round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)), 5) AS r2 FROM p GROUP BY yr UNION ALL SELECT 'pooled', count(*), round(sqrt(avg((y - prediction) * (y - prediction))), 5), round(avg(abs(y - prediction)), 5), round(1 - sum((y - prediction) * (y - prediction)) / (var_pop(y) * count(*)), 5) FROM p")
def regression_metrics(spark: SparkSession, d: str) -> DataFrame:
    p = ridge(spark, d)
    parts = compat.regression_scores(p, "y", "prediction", ["yr"]).withColumn("split", F.col("yr").cast("string")).drop("yr").unionByName(compat.regression_scores(p, "y", "prediction").withColumn("split", F.lit("pooled")))
    return parts.select("split", "rows", *[F.round(c, 5).alias(c) for c in ("rmse", "mae", "r2")])


@query(RIDGE_SQL + ", b AS (SELECT *, avg(y) OVER (PARTITION BY quarter) AS base FROM p) SELECT nation, round(avg(abs(y - base)), 5) AS mean_abs_before, round(avg(abs(y - prediction)), 5) AS mean_abs_after, round((1 - avg(abs(y - prediction)) / avg(abs(y - base))) * 100, 3) AS reduction_percent FROM b GROUP BY nation")
def residual_reduction(spark: SparkSession, d: str) -> DataFrame:
    """Mean absolute residuals of a quarter's mean against ridge predictions."""
    b = ridge(spark, d).withColumn("base", F.avg("y").over(Window.partitionBy("quarter")))
    r = gaps.residual_reduction(b, "y", "base", "prediction", ["nation"])
    return r.select("nation", F.round("mean_abs_before", 5).alias("mean_abs_before"), F.round("mean_abs_after", 5).alias("mean_abs_after"), F.round("reduction_percent", 3).alias("reduction_percent"))


@query(f"WITH {FACT}, k AS (SELECT l_suppkey FROM fact GROUP BY l_suppkey HAVING count(DISTINCT quarter) = (SELECT count(DISTINCT quarter) FROM fact)) SELECT l_suppkey, quarter, count(*) AS n FROM fact WHERE l_suppkey IN (FROM k) GROUP BY ALL")
def balanced_panel(spark: SparkSession, d: str) -> DataFrame:
    n = fact(spark, d).groupBy("l_suppkey", "quarter").agg(F.count("*").alias("n"))
    return gaps.balanced_panel(n, "l_suppkey", "quarter")


@query(NQ + ", n AS (SELECT yr, count(*) AS test_rows FROM nq GROUP BY yr), w AS (SELECT *, CAST(sum(test_rows) OVER (ORDER BY yr ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT) AS train_rows FROM n) SELECT 'train_to_' || (yr - 1) || '_test_' || yr AS split, yr, train_rows, test_rows FROM w WHERE train_rows IS NOT NULL")
def forward_split_counts(spark: SparkSession, d: str) -> DataFrame:
    return gaps.forward_splits(nation_quarters(spark, d), "yr")


YEARS = [1996, 1997, 1998, 1999, 2000]


@query(GAPS + ", v AS (SELECT nation, yr, gap + x2 / 50 - 0.1 AS v FROM z WHERE yr BETWEEN 1996 AND 2000), m AS (SELECT nation, avg(v) AS m FROM v GROUP BY nation), y AS (SELECT nation, yr, avg(v) AS a FROM v GROUP BY ALL) SELECT nation, " + ", ".join(f"round(max(a) FILTER (yr = {y}), 6) AS y{y}" for y in YEARS) + ", count(*) FILTER (sign(a) = sign(m)) AS same_sign_years, count(*) FILTER (sign(a) = sign(m)) = 5 AS stable FROM y JOIN m USING (nation) GROUP BY nation")
def multi_year_sign_stability(spark: SparkSession, d: str) -> DataFrame:
    g = nation_gaps(spark, d).filter(F.col("yr").between(1996, 2000)).withColumn("v", F.col("gap_log") + F.col("x2") / 50 - 0.1)
    s = gaps.sign_stability(g, "nation", "yr", "v", YEARS)
    return s.select("nation", *[r6(f"y{y}").alias(f"y{y}") for y in YEARS], "same_sign_years", "stable")


@query("""
WITH c AS (SELECT c_nationkey AS nation, avg(CAST(c_acctbal AS DECIMAL(12,2))) AS a, count(*) AS n, count(DISTINCT c_mktsegment) AS k FROM customer GROUP BY 1),
p AS (SELECT nation, (rank() OVER (ORDER BY a) + (count(*) OVER (PARTITION BY a) - 1) / 2.0) / count(*) OVER () AS pa, (rank() OVER (ORDER BY n) + (count(*) OVER (PARTITION BY n) - 1) / 2.0) / count(*) OVER () AS pn, (rank() OVER (ORDER BY k) + (count(*) OVER (PARTITION BY k) - 1) / 2.0) / count(*) OVER () AS pk FROM c)
SELECT nation, round(pa, 6) AS balance_pct, round(pn, 6) AS customers_pct, round(pk, 6) AS segments_pct, CASE WHEN abs(pa - 0.5) >= abs(pn - 0.5) AND abs(pa - 0.5) >= abs(pk - 0.5) THEN 'balance' WHEN abs(pn - 0.5) >= abs(pk - 0.5) THEN 'customers' ELSE 'segments' END AS strongest FROM p""")
def context_percentiles(spark: SparkSession, d: str) -> DataFrame:
    """Average-rank percentiles of nations and which one lies farthest from the middle."""
    c = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("nation")).agg(F.avg(money("c_acctbal")).cast("double").alias("a"), F.count("*").alias("n"), F.count_distinct("c_mktsegment").alias("k")).withColumn("one", F.lit(1))
    names = {"balance": "a", "customers": "n", "segments": "k"}
    p = c.withColumns({f"{n}_pct": compat.average_rank_percent(v, "one", constant=None) / 100 for n, v in names.items()})
    return p.select("nation", *[r6(f"{n}_pct").alias(f"{n}_pct") for n in names], compat.arg_max_from_middle([f"{n}_pct" for n in names], list(names)).alias("strongest"))


@query("WITH s AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS DOUBLE) AS total FROM orders GROUP BY 1) SELECT o_custkey, n, total, n < (SELECT quantile_cont(n, 0.05) FROM s) OR total < (SELECT quantile_cont(total, 0.05) FROM s) AS low_support FROM s")
def quality_flag_p5(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).cast("double").alias("total"))
    return gaps.low_support(s, ["n", "total"])


@query("SELECT o_custkey, o_orderkey, o_orderstatus FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) = 1")
def latest_per_entity(spark: SparkSession, d: str) -> DataFrame:
    return compat.first_of(table(spark, d, "orders"), ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_orderstatus")


@query(f"WITH {FACT}, s AS (SELECT l_partkey, nation, CAST(sum(revenue) AS DOUBLE) AS r FROM fact GROUP BY ALL) SELECT l_partkey, nation, round(r / sum(r) OVER (PARTITION BY l_partkey), 6) AS share FROM s QUALIFY row_number() OVER (PARTITION BY l_partkey ORDER BY r DESC, nation) = 1")
def best_row_per_entity(spark: SparkSession, d: str) -> DataFrame:
    """The nation with the largest share of each part's sales."""
    s = fact(spark, d).groupBy("l_partkey", "nation").agg(F.sum("revenue").cast("double").alias("r")).withColumn("share", compat.share("r", "l_partkey"))
    return compat.first_of(s, ["l_partkey"], [F.desc("r"), F.col("nation")]).select("l_partkey", "nation", r6("share").alias("share"))


@query("""
SELECT c_nationkey AS origin, s_nationkey AS destination, nullif(o_orderpriority, '4-NOT SPECIFIED') AS purpose, CAST(sum(CAST(l_quantity AS BIGINT)) AS BIGINT) AS movement_total, count(*) AS rows,
CAST(sum(CAST(l_quantity AS BIGINT) * CAST(l_discount AS DECIMAL(4,2))) AS DOUBLE) / CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS mean_discount
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1, 2, 3""")
def od_mart_weighted_mean(spark: SparkSession, d: str) -> DataFrame:
    """Flows between customer and supplier nations with weighted means; the null purpose is a group."""
    li, o, c, s = (table(spark, d, x) for x in ("lineitem", "orders", "customer", "supplier"))
    j = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey")).join(s, F.col("l_suppkey") == F.col("s_suppkey"))
    j = j.select(F.col("c_nationkey").alias("origin"), F.col("s_nationkey").alias("destination"), F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("purpose"), F.col("l_quantity").cast("long").alias("q"), compat.zero_to_null(F.col("l_discount").cast("decimal(4,2)")).alias("x"))
    return odmart.od_mart(j, ["origin", "destination", "purpose"], "q", {"mean_discount": "x"})


@query("SELECT o_orderkey FROM ((SELECT o_orderkey FROM orders WHERE o_orderstatus = 'P' UNION SELECT l_orderkey FROM lineitem WHERE l_quantity >= 50 AND l_orderkey % 2 = 0) EXCEPT SELECT l_orderkey FROM lineitem WHERE l_discount < 0.01 AND l_returnflag = 'N')")
def calendar_resolution(spark: SparkSession, d: str) -> DataFrame:
    """Base set and added keys less removed keys."""
    o, li = table(spark, d, "orders"), table(spark, d, "lineitem")
    added, gone = li.filter("l_quantity >= 50 and l_orderkey % 2 = 0").select("l_orderkey"), li.filter("l_discount < 0.01 and l_returnflag = 'N'").select("l_orderkey")
    return o.filter("o_orderstatus = 'P'").select("o_orderkey").union(added).distinct().subtract(gone)


@query("""
WITH a AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_quantity > 49 AND l_tax < 0.01), b AS (SELECT DISTINCT l_suppkey AS k FROM lineitem WHERE l_discount > 0.095 AND l_tax > 0.07)
SELECT 'union' AS op, k FROM (FROM a UNION FROM b) UNION ALL SELECT 'intersect', k FROM (FROM a INTERSECT FROM b) UNION ALL SELECT 'except', k FROM (FROM a EXCEPT FROM b) UNION ALL SELECT 'union_all', k FROM (FROM a UNION ALL FROM b)""")
def set_ops_suite(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem")
    a, b = li.filter("l_quantity > 49 and l_tax < 0.01").select(F.col("l_suppkey").alias("k")).distinct(), li.filter("l_discount > 0.095 and l_tax > 0.07").select(F.col("l_suppkey").alias("k")).distinct()
    parts = {"union": a.union(b).distinct(), "intersect": a.intersect(b), "except": a.subtract(b), "union_all": a.union(b)}
    out = None
    for name, df in parts.items():
        one = df.select(F.lit(name).alias("op"), "k")
        out = one if out is None else out.union(one)
    return out


@query("SELECT c_custkey, 'semi' AS kind FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 450000) UNION ALL SELECT c_custkey, 'anti' FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders)")
def semi_anti_suite(spark: SparkSession, d: str) -> DataFrame:
    c, o = table(spark, d, "customer"), table(spark, d, "orders").withColumnRenamed("o_custkey", "c_custkey")
    semi, anti = c.join(o.filter("o_totalprice > 450000"), "c_custkey", "left_semi"), c.join(o, "c_custkey", "left_anti")
    return semi.select("c_custkey", F.lit("semi").alias("kind")).union(anti.select("c_custkey", F.lit("anti")))


@query("WITH a AS (SELECT nullif(p_size, 7) AS k, count(*) AS n FROM part GROUP BY 1), b AS (SELECT nullif(p_size, 7) AS k, max(p_retailprice) AS top FROM part WHERE p_type = 'PROMO' GROUP BY 1) SELECT a.k, n, top FROM a JOIN b ON a.k IS NOT DISTINCT FROM b.k")
def null_safe_keys(spark: SparkSession, d: str) -> DataFrame:
    """A merge in which null keys match."""
    p = table(spark, d, "part").withColumn("k", F.nullif("p_size", F.lit(7)))
    return compat.null_safe_join(p.groupBy("k").agg(F.count("*").alias("n")), p.filter("p_type = 'PROMO'").groupBy("k").agg(F.max("p_retailprice").alias("top")), ["k"])


@query("SELECT p_partkey, CASE WHEN p_name = 'red widget' THEN 'exact' WHEN contains(p_name, 'ring') OR contains(p_name, 'bolt') THEN 'metal' WHEN contains(p_name, 'widget') OR contains(p_name, 'small') THEN 'parts' ELSE 'other' END AS by_words, CASE WHEN p_type IN ('ECONOMY', 'SMALL') THEN 'low' WHEN p_type IN ('LARGE', 'PROMO') THEN 'high' END AS by_set FROM part")
def purpose_rule_mapping(spark: SparkSession, d: str) -> DataFrame:
    """Ordered substring rules, and exact sets with null for the rest."""
    rules = [("metal", ["ring", "bolt"]), ("parts", ["widget", "small"])]
    return table(spark, d, "part").select("p_partkey", codes.purpose_by_words(F.col("p_name"), rules, {"red widget": "exact"}, "other").alias("by_words"), codes.purpose_by_service(F.col("p_type"), {"low": ["ECONOMY", "SMALL"], "high": ["LARGE", "PROMO"]}).alias("by_set"))


DIRTY = "k AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN (p_partkey * 7919) || '.0' WHEN 1 THEN 'A-' || p_partkey WHEN 2 THEN CAST(1100000000 + p_partkey * 1000 AS VARCHAR) ELSE CAST(123456789 + p_partkey AS VARCHAR) END AS raw FROM part), g AS (SELECT *, regexp_replace(split_part(raw, '.', 1), '[^0-9]', '', 'g') AS x FROM k)"


@query(f"WITH {DIRTY} SELECT p_partkey, CASE WHEN length(x) >= 7 THEN x ELSE lpad(x, 7, '0') END AS area_code, CASE WHEN length(x) >= 10 THEN x[1:8] WHEN length(x) >= 8 THEN x ELSE lpad(x, 8, '0') END AS admin_code, lpad(x[1:8], 8, '0') AS admin_code_cut FROM g")
def code_normalise(spark: SparkSession, d: str) -> DataFrame:
    k, m = F.col("p_partkey"), F.col("p_partkey") % 4
    raw = F.when(m == 0, F.concat((k * 7919).cast("string"), F.lit(".0"))).when(m == 1, F.concat(F.lit("A-"), k.cast("string"))).when(m == 2, (F.lit(1_100_000_000) + k * 1000).cast("string")).otherwise((F.lit(123_456_789) + k).cast("string"))
    p = table(spark, d, "part").select("p_partkey", raw.alias("raw"))
    return p.select("p_partkey", codes.area_code(F.col("raw")).alias("area_code"), codes.admin_code(F.col("raw")).alias("admin_code"), codes.admin_code_cut(F.col("raw")).alias("admin_code_cut"))


@query("SELECT o_orderkey, CAST((o_orderkey % 30) * 3600 + (o_orderkey % 60) * 60 + o_custkey % 60 AS INTEGER) AS seconds FROM orders")
def gtfs_time_parse(spark: SparkSession, d: str) -> DataFrame:
    """Clock strings with hours past 23."""
    o = table(spark, d, "orders").select("o_orderkey", F.format_string("%02d:%02d:%02d", F.col("o_orderkey") % 30, F.col("o_orderkey") % 60, F.col("o_custkey") % 60).alias("clock"))
    return o.select("o_orderkey", codes.clock_seconds(F.col("clock")).alias("seconds"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS INTEGER) AS k FROM events")
def json_extract(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"))


@query("SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, '|' ORDER BY c_mktsegment) AS segments FROM customer GROUP BY 1")
def string_set_concat(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "customer").groupBy("c_nationkey").agg(compat.set_concat("c_mktsegment").alias("segments"))


CANDIDATES = "c AS (SELECT s_nationkey AS g, s_name AS id, CAST(s_suppkey * 7 % 45 AS INTEGER) AS minutes, CASE WHEN s_nationkey % 3 = 0 THEN CAST(s_acctbal AS DECIMAL(12,2)) WHEN s_nationkey % 3 = 1 AND s_suppkey % 5 > 0 THEN CAST(s_acctbal AS DECIMAL(12,2)) END AS same, CASE WHEN s_nationkey % 3 < 2 THEN s_suppkey % 4 END AS popular, s_suppkey % 9 <> 3 AS route_ok, s_suppkey % 11 <> 5 AS time_ok, s_suppkey % 13 <> 7 AS condition_ok FROM supplier)"
WHY = "CASE WHEN NOT route_ok THEN 'NO_ROUTE_OR_UNVERIFIED_ROUTE' WHEN NOT time_ok THEN 'MISSING_OR_UNVERIFIED_JOURNEY_TIME' WHEN minutes > 30 THEN 'OVER_MAX_TRAVEL_TIME' WHEN NOT condition_ok THEN 'UNSUPPORTED_OR_UNVERIFIED_CONDITION' END"


def candidates(spark: SparkSession, d: str) -> DataFrame:
    k, n = F.col("s_suppkey"), F.col("s_nationkey")
    same = F.when((n % 3 == 0) | (n % 3 == 1) & (k % 5 > 0), money("s_acctbal"))
    c = table(spark, d, "supplier").select(n.alias("g"), F.col("s_name").alias("id"), (k * 7 % 45).cast("int").alias("minutes"), same.alias("same"), F.when(n % 3 < 2, k % 4).alias("popular"), (k % 9 != 3).alias("route_ok"), (k % 11 != 5).alias("time_ok"), (k % 13 != 7).alias("condition_ok"))
    return c.withColumn("excluded", recommend.exclusion(F.col("route_ok"), F.col("time_ok"), F.col("minutes"), 30, F.col("condition_ok")))


@query(f"WITH {CANDIDATES} SELECT coalesce({WHY}, 'eligible') AS reason, count(*) AS n FROM c GROUP BY 1")
def eligibility_reasons(spark: SparkSession, d: str) -> DataFrame:
    return candidates(spark, d).groupBy(F.coalesce("excluded", F.lit("eligible")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {CANDIDATES}, e AS (SELECT * FROM c WHERE {WHY} IS NULL), b AS (SELECT *, CASE WHEN count(same) OVER (PARTITION BY g) = count(*) OVER (PARTITION BY g) THEN 1 WHEN count(popular) OVER (PARTITION BY g) = count(*) OVER (PARTITION BY g) THEN 2 ELSE 3 END AS k FROM e) SELECT g, id, CASE k WHEN 1 THEN 'same-condition-historical-inflow' WHEN 2 THEN 'global-popularity' ELSE 'shortest-travel-time' END AS basis, row_number() OVER (PARTITION BY g ORDER BY CASE k WHEN 1 THEN same WHEN 2 THEN popular ELSE 0 END DESC, minutes, id) AS place FROM b QUALIFY place <= 5")
def basis_fallback_top5(spark: SparkSession, d: str) -> DataFrame:
    e = candidates(spark, d).filter("excluded is null")
    return recommend.recommend(e, ["g"], "id", "minutes", "same", "popular").select("g", "id", "basis", "place")


@query("SELECT o.o_orderkey, o.o_custkey, (SELECT arg_max(p.o_orderstatus, (p.o_orderdate, p.o_orderkey)) FROM orders p WHERE p.o_custkey = o.o_custkey AND p.o_orderdate < o.o_orderdate) AS latest_status FROM orders o")
def asof_latest_quarter(spark: SparkSession, d: str) -> DataFrame:
    """Each order with the status of its customer's latest order on an earlier day."""
    o = table(spark, d, "orders")
    past = o.groupBy("o_custkey", "o_orderdate").agg(F.max_by("o_orderstatus", "o_orderkey").alias("status"))
    return features.asof_latest(o.select("o_orderkey", "o_custkey", "o_orderdate"), past, ["o_custkey"], "o_orderdate", "status").drop("o_orderdate")


@query("""
WITH s AS (SELECT s_nationkey AS g, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS p, s_suppkey % 4 AS rel FROM supplier), i AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY rel DESC, p) AS ip FROM s)
SELECT g, round(coalesce(count(*) FILTER (p <= 5 AND rel > 0) / nullif(least(count(*) FILTER (rel > 0), 5), 0), 0.0), 6) AS recall_at_k, round(coalesce(sum(CASE WHEN p <= 5 THEN rel / log2(p + 1) ELSE 0 END) / nullif(sum(CASE WHEN ip <= 5 THEN rel / log2(ip + 1) ELSE 0 END), 0), 0.0), 6) AS ndcg_at_k, round(coalesce(1.0 / min(CASE WHEN rel > 0 THEN p END), 0.0), 6) AS reciprocal_rank FROM i GROUP BY g""")
def ranking_metrics_at5(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("g"), F.row_number().over(Window.partitionBy("s_nationkey").orderBy(F.desc("s_acctbal"), "s_suppkey")).alias("p"), (F.col("s_suppkey") % 4).alias("rel"))
    m = recommend.ranking_metrics(s, ["g"], "p", "rel")
    return m.select("g", *[r6(c).alias(c) for c in ("recall_at_k", "ndcg_at_k", "reciprocal_rank")])


@query(NQ + ", k AS (SELECT quarter, rank() OVER (PARTITION BY quarter ORDER BY y) + (count(*) OVER (PARTITION BY quarter, y) - 1) / 2.0 AS a, rank() OVER (PARTITION BY quarter ORDER BY x2) + (count(*) OVER (PARTITION BY quarter, x2) - 1) / 2.0 AS b FROM nq) SELECT quarter, round(corr(a, b), 6) AS spearman FROM k GROUP BY quarter")
def spearman_by_quarter(spark: SparkSession, d: str) -> DataFrame:
    return recommend.spearman(nation_quarters(spark, d), ["quarter"], "y", "x2").withColumn("spearman", r6("spearman"))


@query(f"WITH {FACT}, s AS (SELECT nation, p_type, CAST(sum(revenue) AS DOUBLE) AS r FROM fact GROUP BY ALL) SELECT nation, round(sum(r * r) / (sum(r) * sum(r)), 6) AS hhi FROM s GROUP BY nation")
def concentration_hhi(spark: SparkSession, d: str) -> DataFrame:
    s = fact(spark, d).groupBy("nation", "p_type").agg(F.sum("revenue").alias("r"))
    return recommend.concentration(s, ["nation"], "r").withColumn("hhi", r6("hhi"))


@query("WITH p AS (SELECT c_nationkey AS origin, s_suppkey AS k, (1 + s_suppkey % 7) / pow(greatest(1 + abs(c_nationkey - s_nationkey), 1e-9), 2.0) AS pull FROM (SELECT DISTINCT c_nationkey FROM customer) CROSS JOIN supplier) SELECT origin, k, round(pull / sum(pull) OVER (PARTITION BY origin), 6) AS huff_share FROM p")
def huff_shares(spark: SparkSession, d: str) -> DataFrame:
    p = compat.dense_grid(table(spark, d, "customer").select("c_nationkey"), table(spark, d, "supplier").select("s_suppkey", "s_nationkey"))
    p = p.select(F.col("c_nationkey").alias("origin"), F.col("s_suppkey").alias("k"), (1 + F.col("s_suppkey") % 7).alias("size"), (1 + F.abs(F.col("c_nationkey") - F.col("s_nationkey"))).alias("far"))
    return recommend.huff_shares(p, "origin", "size", "far").select("origin", "k", r6("huff_share").alias("huff_share"))


@query("WITH h AS (SELECT l_suppkey AS a, lead(l_suppkey) OVER w AS b, l_returnflag AS f FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), e AS (SELECT * FROM h WHERE b IS NOT NULL) SELECT 'returned' AS \"table\", (SELECT count(*) FROM e WHERE f = 'R') AS rows, (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM e WHERE f = 'R' UNION SELECT b FROM e WHERE f = 'R')) AS nodes UNION ALL SELECT 'other', (SELECT count(*) FROM e WHERE f <> 'R'), (SELECT count(DISTINCT x) FROM (SELECT a AS x FROM e WHERE f <> 'R' UNION SELECT b FROM e WHERE f <> 'R'))")
def network_summary(spark: SparkSession, d: str) -> DataFrame:
    li = table(spark, d, "lineitem").select("l_orderkey", *ORDER_KEY, "l_returnflag")
    h = network.consecutive(li, ["l_orderkey"], ORDER_KEY, {"l_suppkey": "to_stop_id"}).withColumnRenamed("l_suppkey", "from_stop_id")
    return network.network_summary({"returned": h.filter("l_returnflag = 'R'"), "other": h.filter("l_returnflag <> 'R'")})


@query("SELECT count(*) AS rows, count(*) FILTER (o_custkey % 3 = 0) AS origin_matched, count(*) FILTER (o_orderkey % 4 = 0) AS destination_matched, count(*) FILTER (o_custkey % 3 = 0 AND o_orderkey % 4 = 0) AS both_matched, count(*) FILTER (o_custkey % 3 = 0 AND o_orderkey % 4 = 0) / count(*) AS both_ratio FROM orders")
def match_rates(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.when(F.col("o_custkey") % 3 == 0, F.lit("m")).alias("a"), F.when(F.col("o_orderkey") % 4 == 0, F.lit("m")).alias("b"))
    return odmart.match_rates(o, "a", "b")


@query("SELECT s_suppkey, CASE WHEN s_acctbal >= 8000 AND s_suppkey % 100 >= 80 THEN '목적 관련 상권 구성과 직전 분기 소비 신호가 모두 강함' WHEN s_acctbal >= 8000 THEN '목적 관련 점포·시설 구성이 강함' WHEN s_suppkey % 100 >= 80 THEN '직전 분기 목적 관련 소비 신호가 강함' ELSE '후보군 평균보다 높은 목적 적합도' END AS reason, CASE WHEN s_acctbal / 10000 >= 0.8 THEN '높음' WHEN s_acctbal / 10000 >= 0.5 THEN '보통' ELSE '낮음' END AS confidence FROM supplier")
def reason_and_confidence(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "supplier")
    return s.select("s_suppkey", codes.reason(F.col("s_acctbal") / 100, F.col("s_suppkey") % 100).alias("reason"), codes.confidence(F.col("s_acctbal") / 10000).alias("confidence"))
