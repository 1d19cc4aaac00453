"""Registered queries of spatial, choice, factor and gravity models.

Suppliers stand at points of a plane, nations choose among supplier nations by line items of a year, and orders flow
from customers' to suppliers' nations.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.tables import cut
from ..operators import autocorrelation, choice, factors, gravity
from .catalog import WITHOUT_SQL, query, r6, table
from .catalog_more import NQ, nation_quarters

POINTS_SQL = "points AS (SELECT s_suppkey AS k, CAST(s_suppkey * 37 % 1009 AS DOUBLE) AS x, CAST(s_suppkey * 61 % 997 AS DOUBLE) AS y, CAST(s_acctbal AS DOUBLE) AS v FROM supplier)"
LINKS_SQL = POINTS_SQL + ", links AS (SELECT a.k AS a, b.k AS b, a.v AS va, b.v AS vb FROM points a JOIN points b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.k) <= 6), m AS (SELECT avg(v) AS m, var_pop(v) AS s FROM points)"


def points(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, d, "supplier").select(k.alias("k"), (k * 37 % 1009).cast("double").alias("x"), (k * 61 % 997).cast("double").alias("y"), F.col("s_acctbal").cast("double").alias("v"))


def weights(p: DataFrame) -> DataFrame:
    return autocorrelation.row_weights(autocorrelation.nearest_links(p, "k", 6))


@query(f"WITH {POINTS_SQL} SELECT a.k AS from_key, b.k AS to_key, round(sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), 6) AS distance FROM points a JOIN points b ON a.k <> b.k QUALIFY row_number() OVER (PARTITION BY a.k ORDER BY sqrt((b.x - a.x) * (b.x - a.x) + (b.y - a.y) * (b.y - a.y)), b.k) <= 6")
def nearest_neighbours(spark: SparkSession, d: str) -> DataFrame:
    """The six nearest suppliers of each, through cells; the SQL compares every pair."""
    return autocorrelation.nearest_links(points(spark, d), "k", 6).select("from_key", "to_key", r6("distance").alias("distance"))


@query(f"WITH {LINKS_SQL} SELECT (SELECT count(*) FROM points) AS n, round(avg((va - m) * (vb - m)) / any_value(s), 6) AS moran_i, round(-1.0 / ((SELECT count(*) FROM points) - 1), 6) AS expected_i FROM links, m")
def morans_i(spark: SparkSession, d: str) -> DataFrame:
    """Global Moran's I of suppliers' balances over six neighbours (PLN-2)."""
    p = points(spark, d)
    return autocorrelation.morans_i(p, weights(p), "k", "v").select("n", r6("moran_i").alias("moran_i"), r6("expected_i").alias("expected_i"))


@query(f"WITH {LINKS_SQL} SELECT a AS k, round((any_value(va) - any_value(m)) * avg(vb - m) / any_value(s), 6) AS local_i, (CASE WHEN any_value(va) >= any_value(m) THEN 'H' ELSE 'L' END) || (CASE WHEN avg(vb - m) >= 0 THEN 'H' ELSE 'L' END) AS quadrant FROM links, m GROUP BY a")
def local_morans(spark: SparkSession, d: str) -> DataFrame:
    """Local Moran's I and quadrant of each supplier (PLN-2)."""
    p = points(spark, d)
    return autocorrelation.local_morans(p, weights(p), "k", "v").select("k", r6("local_i").alias("local_i"), "quadrant")


def moran_significance(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo p values of local Moran's I by 99 seeded permutations (PLN-2)."""
    p = points(spark, d)
    return autocorrelation.permutation_tests(p, weights(p), "k", "v", rounds=99)[1]


WITHOUT_SQL["moran_significance"] = moran_significance

CHOICES_SQL = """
sizes AS (SELECT n_nationkey AS dest, n_regionkey AS dest_region, count(c_custkey) AS customers FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey WHERE n_nationkey IN (SELECT s_nationkey FROM supplier) GROUP BY ALL
), flows AS (
    SELECT c_nationkey AS orig, s_nationkey AS dest, year(l_shipdate) AS yr, count(*) AS n, CAST(sum(CAST(l_quantity AS BIGINT)) AS DOUBLE) AS qty FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL
), strata AS (
    SELECT f.orig, f.yr, f.orig * 10000 + f.yr AS stratum, n_regionkey AS orig_region FROM (SELECT DISTINCT orig, yr FROM flows) f JOIN nation ON n_nationkey = orig
), choices AS (
    SELECT s.stratum, s.orig, s.yr, z.dest, coalesce(f.n, 0) AS n, ln(1 + z.customers) AS size, CASE WHEN orig_region = dest_region THEN 1.0 ELSE 0.0 END AS near, abs(s.orig - z.dest) / 10.0 AS away
    FROM strata s CROSS JOIN sizes z LEFT JOIN flows f ON f.orig = s.orig AND f.yr = s.yr AND f.dest = z.dest
)"""


def nation_flows(spark: SparkSession, d: str) -> DataFrame:
    """orig, dest, yr, n, qty: line items from customers' to suppliers' nations, on storage."""
    who = table(spark, d, "orders").select("o_orderkey", "o_custkey").join(table(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("orig")), F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "orig")
    li = table(spark, d, "lineitem").select("l_orderkey", "l_suppkey", F.year("l_shipdate").cast("short").alias("yr"), F.col("l_quantity").cast("long").alias("q"))
    to = li.join(table(spark, d, "supplier").select("s_suppkey", F.col("s_nationkey").alias("dest")), F.col("l_suppkey") == F.col("s_suppkey")).select("l_orderkey", "dest", "yr", "q")
    flows = to.join(who, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("orig", "dest", "yr").agg(F.count("*").alias("n"), F.sum("q").cast("double").alias("qty"))
    return cut(flows.withColumn("yr", F.col("yr").cast("int")), "flows")  # nations and years; read more than once


def choices(spark: SparkSession, d: str) -> DataFrame:
    """Every supplier nation as a candidate of each customer nation and year: counts, log of its customers, same region, distance of keys."""
    flows = nation_flows(spark, d)
    nation = table(spark, d, "nation")
    there = nation.join(table(spark, d, "supplier"), F.col("n_nationkey") == F.col("s_nationkey"), "left_semi").join(table(spark, d, "customer"), F.col("n_nationkey") == F.col("c_nationkey"), "left")
    sizes = there.groupBy(F.col("n_nationkey").alias("dest"), F.col("n_regionkey").alias("dest_region")).agg(F.log(1 + F.count("c_custkey")).alias("size"))
    strata = flows.select("orig", "yr").distinct().join(nation.select(F.col("n_nationkey").alias("orig"), F.col("n_regionkey").alias("orig_region")), "orig")
    grid = strata.crossJoin(sizes).join(flows, ["orig", "yr", "dest"], "left")  # nations and years, never facts
    return grid.select((F.col("orig") * 10000 + F.col("yr")).cast("long").alias("stratum"), "orig", "yr", "dest", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("qty", F.lit(0.0)).alias("qty"), "size", (F.col("orig_region") == F.col("dest_region")).cast("double").alias("near"), (F.abs(F.col("orig") - F.col("dest")) / 10.0).alias("away"))


FEATURES, GIVEN = ["size", "near", "away"], [0.9, 0.25, -0.1]
UTILITY = "0.9 * size + 0.25 * near - 0.1 * away"


@query(f"WITH {CHOICES_SQL}, u AS (SELECT *, {UTILITY} AS u FROM choices), t AS (SELECT stratum, sum(n) AS n, sum(n * u) - sum(n) * ln(sum(exp(u))) AS l FROM u GROUP BY stratum) SELECT count(*) AS strata, CAST(sum(n) AS DOUBLE) AS choices, round(sum(l), 4) AS log_likelihood FROM t")
def choice_log_likelihood(spark: SparkSession, d: str) -> DataFrame:
    """Log-likelihood of a conditional logit at given coefficients (PLN-2)."""
    return choice.log_likelihood(choices(spark, d), "stratum", "n", FEATURES, GIVEN).select("strata", "choices", F.round("log_likelihood", 4).alias("log_likelihood"))


@query(f"WITH {CHOICES_SQL} SELECT stratum, dest, round(exp({UTILITY}) / sum(exp({UTILITY})) OVER (PARTITION BY stratum), 6) AS share FROM choices")
def choice_shares(spark: SparkSession, d: str) -> DataFrame:
    """Each candidate's probability at given coefficients (PLN-2)."""
    return choice.shares(choices(spark, d), "stratum", FEATURES, GIVEN).select("stratum", "dest", r6("share").alias("share"))


@query(f"WITH {CHOICES_SQL} SELECT 'size' AS feature, round(sum(n * size), 2) AS total FROM choices UNION ALL SELECT 'near', round(sum(n * near), 2) FROM choices UNION ALL SELECT 'away', round(sum(n * away), 2) FROM choices")
def choice_fit_totals(spark: SparkSession, d: str) -> DataFrame:
    """Totals of the features over fitted choices: where the likelihood is highest they equal those over the choices made, which is what the SQL sums (PLN-2)."""
    c = cut(choices(spark, d), "choices")
    fit = choice.fit_choice(c, "stratum", "n", FEATURES)
    made = choice.shares(c, "stratum", FEATURES, list(fit.coefficients)).join(c.groupBy("stratum").agg(F.sum("n").alias("all")), "stratum")
    totals = made.agg(*[F.sum(F.col("all") * F.col("share") * F.col(f)).alias(f) for f in FEATURES])
    return totals.unpivot([], FEATURES, "feature", "total").select("feature", F.round("total", 2).alias("total"))


def choice_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the conditional logit by Newton's method (PLN-2)."""
    return choice.coefficients(spark, choice.fit_choice(choices(spark, d), "stratum", "n", FEATURES))


WITHOUT_SQL["choice_coefficients"] = choice_coefficients


@query(NQ + ", r AS (SELECT corr(x1, y) AS r, count(*) AS n FROM nq) SELECT component, round(1 + s * abs(r), 6) AS eigenvalue, round((1 + s * abs(r)) / 2, 6) AS explained, 0.5 AS kmo, round(-(n - 2.5) * ln(1 - r * r), 4) AS bartlett FROM r, (VALUES (1, 1), (2, -1)) c(component, s)")
def two_component_factors(spark: SparkSession, d: str) -> DataFrame:
    """Components, KMO and Bartlett's test of two columns, whose closed form the SQL states (PLN-2)."""
    fit = factors.fit_factors(nation_quarters(spark, d), ["x1", "y"])
    one = factors.loadings(spark, fit).filter("column = 'y'")
    return one.select("component", r6("eigenvalue").alias("eigenvalue"), r6("explained").alias("explained"), F.lit(round(fit.kmo, 6)).alias("kmo"), F.lit(round(fit.bartlett, 4)).alias("bartlett"))


@query(NQ + ", s AS (SELECT avg(x1) AS mx, stddev_pop(x1) AS sx, avg(y) AS my, stddev_pop(y) AS sy FROM nq) SELECT nation, quarter, round(((x1 - mx) / sx + (y - my) / sy) / sqrt(2), 6) AS component_1 FROM nq, s")
def component_scores(spark: SparkSession, d: str) -> DataFrame:
    """Scores of the first component of two columns that rise together (PLN-2)."""
    q = nation_quarters(spark, d)
    return factors.component_scores(q, factors.fit_factors(q, ["x1", "y"])).select("nation", "quarter", r6("component_1").alias("component_1"))


def attraction_loadings(spark: SparkSession, d: str) -> DataFrame:
    """Loadings, explained variance and KMO of three columns (PLN-2)."""
    return factors.loadings(spark, factors.fit_factors(nation_quarters(spark, d), ["x1", "x2", "y"]))


WITHOUT_SQL["attraction_loadings"] = attraction_loadings


def _gravity(spark: SparkSession, d: str) -> gravity.Gravity:
    c = choices(spark, d).groupBy("orig", "dest").agg(F.sum("qty").alias("qty"), F.first("near").alias("near"), F.first("away").alias("away"))
    return gravity.fit_gravity(c, "orig", "dest", "qty", ["near", "away"])


@query(f"WITH {CHOICES_SQL} SELECT side, CAST(k AS BIGINT) AS k, round(qty, 2) AS fitted FROM (SELECT 'orig' AS side, orig AS k, sum(qty) AS qty FROM flows GROUP BY orig UNION ALL SELECT 'dest', dest, sum(qty) FROM flows GROUP BY dest UNION ALL SELECT 'away', 0, sum(qty * abs(orig - dest) / 10.0) FROM flows)")
def gravity_balance(spark: SparkSession, d: str) -> DataFrame:
    """Fitted flows by origin and destination, and their total distance: a Poisson fit with both effects has the sums of the flows themselves, which the SQL takes (PLN-3)."""
    f = _gravity(spark, d).fitted
    by = lambda side: f.groupBy(F.lit(side).alias("side"), F.col(side).cast("long").alias("k")).agg(F.sum("fitted").alias("fitted"))
    away = f.agg(F.sum(F.col("fitted") * F.col("away")).alias("fitted")).select(F.lit("away").alias("side"), F.lit(0).cast("long").alias("k"), "fitted")
    return by("orig").unionByName(by("dest")).unionByName(away).select("side", "k", F.round("fitted", 2).alias("fitted"))


def gravity_coefficients(spark: SparkSession, d: str) -> DataFrame:
    """Coefficients of the gravity model (PLN-3)."""
    return gravity.coefficients(spark, _gravity(spark, d))


WITHOUT_SQL["gravity_coefficients"] = gravity_coefficients

