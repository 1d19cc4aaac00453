"""Registered queries of rules, checks, reports and reprojection."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import compat, geo
from ..operators import explain, gaps, network
from ..sources import sinks
from .catalog import PLACES_SQL, WITHOUT_SQL, money, places, query, r6, table
from .catalog_more import NQ, nation_quarters


@query("""
WITH t AS (SELECT o_orderkey AS trip_id, o_custkey % 7 AS s FROM orders)
SELECT trip_id, CAST(s AS VARCHAR) AS service_id FROM t WHERE (s % 2 = 0 AND s <> 4) OR s = 3""")
def trips_of_the_day(spark: SparkSession, d: str) -> DataFrame:
    """Trips whose service runs on a Wednesday: even ones by the calendar, one added and one removed by exceptions (SET-5)."""
    trips = table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), (F.col("o_custkey") % 7).cast("string").alias("service_id"))
    services = trips.select("service_id").distinct()
    days = [F.when(F.col("service_id") % 2 == 0, "1").otherwise("0").alias(x) for x in ("monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday")]
    calendar = services.select("service_id", F.lit("19960101").alias("start_date"), F.lit("19961231").alias("end_date"), *days)
    exceptions = services.filter("service_id in ('3', '4')").select("service_id", F.lit("19960313").alias("date"), F.when(F.col("service_id") == "3", "1").otherwise("2").alias("exception_type"))
    return network.trips_of_the_day(trips, calendar, exceptions, "1996-03-13")


@query(f"WITH {PLACES_SQL} SELECT k, lon, lat FROM places")
def checked_places(spark: SparkSession, d: str) -> DataFrame:
    """Places after the checks of their bounds and of unique keys, which pass (PRJ-35, SET-7)."""
    return compat.unique_or_raise(geo.check_lon_lat(places(spark, d), "lon", "lat"), "k")


@query("SELECT '{\"orders\":' || count(*) || ',\"customers\":' || count(DISTINCT o_custkey) || ',\"first\":\"' || min(o_orderdate)::DATE || '\",\"walk_mps\":1.2}' AS value FROM orders")
def run_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Aggregates and parameters of a run as one JSON row (SNK-3, SNK-7)."""
    return sinks.run_metadata(table(spark, d, "orders"), orders=F.count("*"), customers=F.count_distinct("o_custkey"), first=F.min(F.col("o_orderdate").cast("date")), walk_mps=1.2)


@query("""
WITH r AS (SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(12,2))) AS VARCHAR) AS total FROM orders GROUP BY 1)
SELECT 1::BIGINT AS line, '| o_custkey | n | total |' AS value UNION ALL SELECT 2, '|---|---|---|' UNION ALL SELECT 2 + row_number() OVER (ORDER BY n DESC, o_custkey), '| ' || o_custkey || ' | ' || n || ' | ' || total || ' |' FROM r""")
def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """A report table of all customers, those with most orders first (SNK-4)."""
    r = table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(money("o_totalprice")).alias("total"))
    return sinks.markdown_rows(r.withColumn("_order", -F.col("n")).select("o_custkey", "n", "total"), [F.desc("n"), F.col("o_custkey")])


TEXT = "'유동인구와 점포 수로 기대한 값의 평균 ' || printf('%.2f', n / 4.0) || '배로, ' || CASE WHEN n > 5 THEN '기대보다 높은' ELSE '기대보다 낮은' END || ' 수준이다. 매출에서는 ' || c_mktsegment || '의 비중이 가장 크고, 유동에 견준 소비는 30대, 17~21시에 가장 몰린다. '"


@query(f"WITH c AS (SELECT c_custkey, any_value(c_mktsegment) AS c_mktsegment, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1) SELECT c_custkey, {TEXT} || CASE WHEN n = 2 THEN '역 앞이다. ' ELSE '' END || '자료에서 나온 가설이며 인과를 확인한 것은 아니다.' || CASE WHEN n < 3 THEN ' 표본 적음: 해석을 보류한다.' ELSE '' END AS text FROM c")
def gap_texts(spark: SparkSession, d: str) -> DataFrame:
    """A sentence on each customer's orders with a note and a warning where there is one (PRJ-29)."""
    o = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment").join(o, "c_custkey", "left").fillna(0, ["n"])
    text = explain.gap_text(F.col("n") / 4.0, F.when(F.col("n") > 5, "목적소비형").otherwise("통과형"), F.col("c_mktsegment"), F.lit("30대"), F.lit("17~21시"), F.when(F.col("n") == 2, "역 앞이다.").otherwise(""), F.when(F.col("n") < 3, "표본 적음").otherwise(""))
    return c.select("c_custkey", text.alias("text"))


def _one(x: str, fold: str) -> str:
    """Squared errors of a hold-out ridge on one feature, in closed form."""
    return f"SELECT '{fold}' AS scheme, '{x}' AS model, y, my + c / s / (n + 1.0) * n / s * (f.{x} - m) AS p FROM nq f JOIN (SELECT a.{fold} AS k, count(*) AS n, avg(b.{x}) AS m, avg(b.y) AS my, stddev_pop(b.{x}) AS s, covar_pop(b.{x}, b.y) AS c FROM (SELECT DISTINCT {fold} FROM nq) a JOIN nq b ON a.{fold} <> b.{fold} GROUP BY a.{fold}) t ON f.{fold} = t.k"


PIVOT = ", ".join(f"round(max({m}) FILTER (model = '{x}'), 5) AS {m}_{x}" for m in ("rmse", "r2") for x in ("x1", "x2"))


@query(NQ + ", p AS (" + " UNION ALL ".join(_one(x, f) for f in ("yr", "nation") for x in ("x1", "x2")) + f"), s AS (SELECT scheme, model, sqrt(avg((y - p) * (y - p))) AS rmse, 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)) AS r2 FROM p GROUP BY ALL) SELECT scheme, {PIVOT} FROM s GROUP BY scheme")
def scheme_by_model(spark: SparkSession, d: str) -> DataFrame:
    """Hold-outs by year and by nation against two ridge models, side by side (AGG-13, ML-7)."""
    q = nation_quarters(spark, d)
    scores = gaps.compare_models({f"{fold}/{x}": gaps.ridge_out_of_fold(q, [x], "y", fold) for fold in ("yr", "nation") for x in ("x1", "x2")}, "y")
    named = scores.withColumn("scheme", F.split_part("model", F.lit("/"), F.lit(1))).withColumn("kind", F.split_part("model", F.lit("/"), F.lit(2)))
    wide = gaps.score_pivot(named, "scheme", "kind", ["x1", "x2"], ["rmse", "r2"])
    return wide.select("scheme", *[F.round(c, 5).alias(c) for c in wide.columns if c != "scheme"])


@query(NQ + ", w AS (SELECT r_name AS region, y, yr AS fold FROM nq JOIN nation ON n_name = nation JOIN region ON n_regionkey = r_regionkey), t AS (SELECT a.fold, count(*) AS n, sum(y) AS s FROM (SELECT DISTINCT fold FROM w) a JOIN w b ON a.fold <> b.fold GROUP BY a.fold), g AS (SELECT a.fold, b.region, count(*) AS k, sum(y) AS s FROM (SELECT DISTINCT fold FROM w) a JOIN w b ON a.fold <> b.fold GROUP BY ALL), h AS (SELECT g.fold, sum(k / (k + 5.0) * (g.s / k)) AS a, sum(k / (k + 5.0)) AS c, sum(k * k / (k + 5.0)) AS q, any_value(t.n) AS n, any_value(t.s) AS s, sum(k * g.s / (k + 5.0)) AS z FROM g JOIN t USING (fold) GROUP BY g.fold), b AS (SELECT fold, (s - z) / (n - q) AS b FROM h) SELECT DISTINCT w.fold AS yr, w.region, round(b.b + (g.s - g.k * b.b) / (g.k + 5.0), 5) AS prediction FROM w JOIN g USING (fold, region) JOIN b USING (fold)")
def ridge_dummies(spark: SparkSession, d: str) -> DataFrame:
    """Ridge with penalty 5 on dummies of a region, in raw units, over hold-out years (ML-2): each region's mean shrunk towards the intercept."""
    n = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("nation"), F.col("r_name").alias("region"))
    coded, names = gaps.one_hot(nation_quarters(spark, d).join(n, "nation"), "region")
    out = gaps.ridge_out_of_fold(coded, names, "y", "yr", alpha=5.0, scaled=[False] * len(names))
    return out.select("yr", "region", F.round("prediction", 5).alias("prediction")).distinct()


@query("WITH o AS (SELECT o_orderkey, 195000 + o_orderkey % 9973 AS x, 540000 + o_custkey * 7 % 9973 AS y FROM orders) SELECT o_orderkey, '{\"type\":\"Point\",\"coordinates\":[' || CAST(x AS DOUBLE) || ',' || CAST(y AS DOUBLE) || ']}' AS metres FROM o")
def reprojected_points(spark: SparkSession, d: str) -> DataFrame:
    """Points taken to degrees and back to whole metres, which gives the points themselves (SNK-2)."""
    o = table(spark, d, "orders").select("o_orderkey", F.format_string('{"type":"Point","coordinates":[%d,%d]}', 195000 + F.col("o_orderkey") % 9973, 540000 + F.col("o_custkey") * 7 % 9973).alias("g"))
    degrees = o.select("o_orderkey", F.from_json(F.get_json_object(geo.reproject(F.col("g"), geo.from_5181), "$.coordinates"), "array<double>").alias("p"))
    x, y = (F.round(c, 3).cast("string") for c in geo.to_5181(F.col("p")[0], F.col("p")[1]))
    return degrees.select("o_orderkey", F.concat(F.lit('{"type":"Point","coordinates":['), x, F.lit(","), y, F.lit("]}")).alias("metres"))


@query("WITH s AS (SELECT o_custkey, o_orderpriority AS p, CAST(o_totalprice AS DOUBLE) AS v FROM orders) SELECT p, round(quantile_cont(v, 0.05), 4) AS low, round(quantile_cont(v, 0.5), 4) AS middle FROM s GROUP BY p")
def price_quantiles(spark: SparkSession, d: str) -> DataFrame:
    """Interpolated quantiles of order prices by priority, without a sort of whole groups (PRJ-14, AGG-3)."""
    o = table(spark, d, "orders").select(F.col("o_orderpriority").alias("p"), F.col("o_totalprice").cast("double").alias("v"))
    low, middle = (compat.exact_quantile(o, "v", q, ["p"], out=n) for q, n in ((0.05, "low"), (0.5, "middle")))
    return low.join(middle, "p").select("p", F.round("low", 4).alias("low"), F.round("middle", 4).alias("middle"))


def bootstrap_interval(spark: SparkSession, d: str) -> DataFrame:
    """Interval of the mean difference of two predictions' absolute errors, by 500 bootstrap rounds (PLN-1)."""
    q = nation_quarters(spark, d)
    one, two = (gaps.ridge_out_of_fold(q, x, "y", "yr").select("nation", "quarter", F.abs(F.col("y") - F.col("prediction")).alias(n)) for x, n in ((["x1"], "a"), (["x1", "x2"], "b")))
    pairs = one.join(two, ["nation", "quarter"]).withColumn("id", F.concat_ws("/", "nation", "quarter"))
    out = explain.paired_bootstrap(pairs, "a", "b", rounds=500)
    return out.select(*[r6(c).alias(c) for c in out.columns])


WITHOUT_SQL["bootstrap_interval"] = bootstrap_interval
