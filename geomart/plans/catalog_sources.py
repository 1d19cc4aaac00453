"""Registered queries of file formats, polygons, routing with walks, and flows: the driver's tables are written in a format, read back and compared by SQL.

Suppliers, parts and nations get rectangles from their keys, so areas of overlaps are products that SQL can give too.
"""

from __future__ import annotations

import io
import struct
import zipfile
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codes, compat, geo
from ..functions.tables import cut, scratch
from ..operators import access, boosting, clipping, explain, gaps, isochrones, network, odmart, polygon, routing, spatial
from ..sources import readers, sinks
from ..streaming import windows
from .catalog import ORDER_KEY, WITHOUT_SQL, query, r6, table


def files_of(df: DataFrame, by: str, make: Callable[[pd.DataFrame], bytes], suffix: str) -> str:
    """A folder with one file for each value of `by`, made in tasks from the group's rows."""

    def one(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"name": [f"{key[0]}.{suffix}"], "content": [make(rows)]})

    folder = scratch(df.sparkSession, suffix)
    sinks.write_files(df.groupBy(by).applyInPandas(one, "name string, content binary"), folder).count()
    return folder


def zipped(members: dict[str, bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in members.items():
            z.writestr(name, data)
    return out.getvalue()


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer")
def source_utf8_csv(spark: SparkSession, d: str) -> DataFrame:
    """Customers through CSV in UTF-8 (SRC-1, SRC-8, SNK-1)."""
    path = scratch(spark, "csv")
    c = table(spark, d, "customer").select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", "c_mktsegment")
    sinks.write_csv(c, path)
    return readers.csv_utf8(spark, path, "c_custkey long, c_name string, c_mktsegment string")


@query("SELECT CAST(c_custkey AS VARCHAR) AS \"고객\", c_name AS \"이름\" FROM customer")
def source_zipped_cp949(spark: SparkSession, d: str) -> DataFrame:
    """Customers through zipped CSV in CP949, a file for each nation (SRC-2 to SRC-5)."""

    def make(rows: pd.DataFrame) -> bytes:
        return zipped({"in/table.csv": ("고객,이름\n" + "".join(f'{k},"{n}"\n' for k, n in zip(rows["c_custkey"], rows["c_name"]))).encode("cp949")})

    folder = files_of(table(spark, d, "customer").select("c_nationkey", "c_custkey", "c_name"), "c_nationkey", make, "zip")
    return readers.csv_any(spark, folder, ["고객", "이름"], archive="single")


@query("""WITH t AS (SELECT l_orderkey, l_suppkey AS a, l_linenumber AS k, min(l_linenumber * 600 + l_orderkey % 900) AS moment FROM lineitem GROUP BY ALL), u AS (SELECT l_orderkey, k, min(a) AS a, min(moment) AS moment FROM t GROUP BY ALL),
h AS (SELECT a AS f, lead(a) OVER w AS t, moment + 30 AS departure, lead(moment) OVER w AS arrival FROM u WINDOW w AS (PARTITION BY l_orderkey ORDER BY k)) SELECT CAST(f AS VARCHAR) AS from_stop_id, CAST(t AS VARCHAR) AS to_stop_id, count(*) AS hops, CAST(sum(arrival - departure) AS BIGINT) AS seconds FROM h WHERE t IS NOT NULL GROUP BY f, t""")
def source_gtfs(spark: SparkSession, d: str) -> DataFrame:
    """Orders as trips of a transit feed, written as its text file, read and turned into hops (SRC-6, PRJ-1)."""
    li = table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.min("l_suppkey").alias("stop_id"))
    at = F.col("l_linenumber") * 600 + F.col("l_orderkey") % 900
    clock = lambda s: F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), (F.floor(s / 60) % 60).cast("int"), (s % 60).cast("int"))
    feed = scratch(spark, "feed")
    sinks.write_csv(li.select(F.col("l_orderkey").alias("trip_id"), "stop_id", F.col("l_linenumber").alias("stop_sequence"), clock(at).alias("arrival_time"), clock(at + 30).alias("departure_time")), f"{feed}/stop_times.txt")
    hops = network.connections(readers.gtfs_table(spark, feed, "stop_times", ["trip_id", "stop_id", "stop_sequence", "arrival_time", "departure_time"]))
    return hops.groupBy("from_stop_id", "to_stop_id").agg(F.count("*").alias("hops"), F.sum(F.col("arrival") - F.col("departure")).cast("long").alias("seconds"))


@query("SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name FROM supplier")
def source_excel(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers through workbooks, one for each nation (SRC-7)."""

    def make(rows: pd.DataFrame) -> bytes:
        ns, rel = "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        cell = lambda at, text: f'<c r="{at}" t="inlineStr"><is><t>{text}</t></is></c>'
        lines = [("id", "name"), *zip(rows["s_suppkey"], rows["s_name"])]
        sheet = "".join(f"<row>{cell(f'A{i}', a)}{cell(f'B{i}', b)}</row>" for i, (a, b) in enumerate(lines, 1))
        return zipped({
            "xl/workbook.xml": f'<workbook xmlns="{ns}" xmlns:r="{rel}"><sheets><sheet name="Data" r:id="r1"/></sheets></workbook>'.encode(),
            "xl/_rels/workbook.xml.rels": b'<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": f'<worksheet xmlns="{ns}"><sheetData>{sheet}</sheetData></worksheet>'.encode(),
        })

    return readers.excel_sheet(spark, files_of(table(spark, d, "supplier").select("s_nationkey", "s_suppkey", "s_name"), "s_nationkey", make, "xlsx"), "Data", ["id", "name"])


BOX_SQL = """
zones AS (SELECT s_suppkey AS z, s_nationkey AS n, s_suppkey * 29 % 90 AS x0, s_suppkey * 53 % 90 AS y0, s_suppkey * 29 % 90 + 7 + s_suppkey % 5 AS x9, s_suppkey * 53 % 90 + 5 + s_suppkey % 3 AS y9 FROM supplier),
boxes AS (SELECT p_partkey AS p, p_partkey * 37 % 100 AS x0, p_partkey * 61 % 101 AS y0, p_partkey * 37 % 100 + 2 + p_partkey % 3 AS x9, p_partkey * 61 % 101 + 2 + p_partkey % 4 AS y9 FROM part),
lands AS (SELECT n_nationkey AS land, n_nationkey % 5 * 20 AS x0, n_nationkey // 5 * 20 AS y0, n_nationkey % 5 * 20 + 19 AS x9, n_nationkey // 5 * 20 + 19 AS y9 FROM nation),
pts AS (SELECT p_partkey AS k, p_partkey * 37 % 100 + 0.5 AS x, p_partkey * 61 % 101 + 0.25 AS y FROM part)"""


def boxes(df: DataFrame, key: str, name: str, x0: Column, y0: Column, wide: Column, high: Column) -> DataFrame:
    return df.select(F.col(key).cast("long").alias(name), *[c for c in df.columns if c.endswith("nationkey") and c != key], x0.cast("double").alias("x0"), y0.cast("double").alias("y0"), (x0 + wide).cast("double").alias("x9"), (y0 + high).cast("double").alias("y9"))


def zones(spark: SparkSession, d: str) -> DataFrame:
    s, k = table(spark, d, "supplier"), F.col("s_suppkey")
    return boxes(s.select("s_suppkey", "s_nationkey"), "s_suppkey", "z", k * 29 % 90, k * 53 % 90, 7 + k % 5, 5 + k % 3)


def part_boxes(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return boxes(table(spark, d, "part").select("p_partkey"), "p_partkey", "p", k * 37 % 100, k * 61 % 101, 2 + k % 3, 2 + k % 4)


def lands(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("n_nationkey")
    return boxes(table(spark, d, "nation").select("n_nationkey"), "n_nationkey", "land", k % 5 * 20, F.floor(k / 5) * 20, F.lit(19), F.lit(19))


def part_points(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "part").select(F.col("p_partkey").cast("long").alias("k"), (F.col("p_partkey") * 37 % 100 + 0.5).alias("x"), (F.col("p_partkey") * 61 % 101 + 0.25).alias("y"))


def ring(df: DataFrame, *keys: str) -> DataFrame:
    """The four edges of each box."""
    c = [F.array(F.col(x), F.col(y)) for x, y in (("x0", "y0"), ("x9", "y0"), ("x9", "y9"), ("x0", "y9"))]
    sides = F.array(*[F.struct(a[0].alias("x1"), a[1].alias("y1"), b[0].alias("x2"), b[1].alias("y2")) for a, b in zip(c, [*c[1:], c[0]])])
    return df.select(*keys, F.lit(0).alias("part"), F.lit(0).alias("ring"), F.lit(False).alias("hole"), F.explode(sides).alias("e")).select(*keys, "part", "ring", "hole", "e.*")


def geometry() -> Column:
    corner = lambda x, y: F.format_string("[%.1f,%.1f]", F.col(x), F.col(y))
    return F.concat(F.lit('{"type":"Polygon","coordinates":[['), F.concat_ws(",", *[corner(x, y) for x, y in (("x0", "y0"), ("x9", "y0"), ("x9", "y9"), ("x0", "y9"), ("x0", "y0"))]), F.lit("]]}"))


@query(f"WITH {BOX_SQL} SELECT CAST(z AS VARCHAR) AS \"CODE\", CAST((x9 - x0) * (y9 - y0) AS DOUBLE) AS area FROM zones")
def source_shapefile(spark: SparkSession, d: str) -> DataFrame:
    """Boxes of suppliers through zipped shapefiles, one for each nation, and their areas (SRC-9)."""

    def make(rows: pd.DataFrame) -> bytes:
        shp, dbf = bytes(100), struct.pack("<BBBBIHH20x", 3, 0, 0, 0, len(rows), 65, 17) + b"CODE".ljust(11, b"\0") + b"C" + bytes(4) + bytes([16]) + bytes(15) + b"\r"
        for i, r in enumerate(rows.itertuples(), 1):
            points = [(r.x0, r.y0), (r.x0, r.y9), (r.x9, r.y9), (r.x9, r.y0), (r.x0, r.y0)]
            body = struct.pack("<i4d2ii", 5, r.x0, r.y0, r.x9, r.y9, 1, 5, 0) + b"".join(struct.pack("<2d", *p) for p in points)
            shp += struct.pack(">ii", i, len(body) // 2) + body
            dbf += b" " + str(r.z).encode().ljust(16)
        return zipped({"a.shp": shp, "a.dbf": dbf})

    return polygon.areas(readers.shapefile_edges(spark, files_of(zones(spark, d), "s_nationkey", make, "shapes"), ["CODE"]), "CODE")


def collections(df: DataFrame, by: str, properties: list[str]) -> str:
    """A folder of GeoJSON collections of boxes, one for each value of `by`."""
    lines = df.withColumn("_g", geometry()).select(by, F.concat(F.lit('{"type":"Feature","properties":'), F.to_json(F.struct(*properties)), F.lit(',"geometry":'), "_g", F.lit("}")).alias("line"))
    return files_of(lines, by, lambda rows: ('{"type":"FeatureCollection","features":[' + ",".join(rows["line"]) + "]}").encode(), "geojson")


@query(f"WITH {BOX_SQL} SELECT CAST(z AS VARCHAR) AS z, CAST((x9 - x0) * (y9 - y0) AS DOUBLE) AS area FROM zones")
def source_geojson(spark: SparkSession, d: str) -> DataFrame:
    """The same through GeoJSON (SRC-10, SRC-11)."""
    features = readers.geojson_features(spark, collections(zones(spark, d), "s_nationkey", ["z"]), ["z"])
    return polygon.areas(geo.polygon_edges(features, "geometry", ["z"]), "z")


@query(f"WITH {BOX_SQL} SELECT CAST(z AS VARCHAR) AS code, CAST(n AS VARCHAR) AS nation FROM zones WHERE z = 7")
def source_feature_by_code(spark: SparkSession, d: str) -> DataFrame:
    """The one feature of a code (SRC-17)."""
    z = zones(spark, d).withColumn("code", F.col("z")).withColumn("nation", F.col("s_nationkey"))
    return readers.feature_by_code(readers.geojson_features(spark, collections(z, "s_nationkey", ["code", "nation"]), ["code", "nation"]), "7").select("code", "nation")


@query("SELECT 'nation' AS origin, count(*) AS features FROM nation UNION ALL SELECT 'supplier', count(*) FROM supplier")
def sink_merged_features(spark: SparkSession, d: str) -> DataFrame:
    """Two tables in one collection, each feature tagged with its table, written and read back (SNK-2, SNK-6)."""
    lines = sinks.merged_features({"nation": lands(spark, d).withColumn("g", geometry()), "supplier": zones(spark, d).withColumn("g", geometry())}, "g")
    path = scratch(spark, "features")
    lines.write.text(path)
    read = spark.read.text(path).select(F.get_json_object("value", "$.properties.origin").alias("origin"), F.get_json_object("value", "$.geometry.type").alias("kind"))
    return read.filter("kind = 'Polygon'").groupBy("origin").agg(F.count("*").alias("features"))


def payloads(spark: SparkSession, d: str) -> DataFrame:
    """A cached payload for each nation: boxes and stations of its suppliers, or an error where the key divides by 5."""

    def make(rows: pd.DataFrame) -> bytes:
        n = int(rows["s_nationkey"].iloc[0])
        if n % 5 == 0:
            return (f'{{"error":{{"code":"{n}","message":"none"}}}}' if n % 2 else f'{{"error":[{{"code":"{n}","msg":"none"}}]}}').encode()
        shapes = ",".join(f'{{"geometry":{g}}}' for g in rows["g"])
        found = ",".join(f'{{"stationClass":2,"x":{r.x0},"y":{r.y0},"stationID":{r.z},"stationName":"S{r.z % 4}역","laneName":"L{r.z % 3}"}}' for r in rows.sort_values("z").itertuples())
        return f'{{"result":{{"geojson":{{"features":[{shapes}]}},"station":[{found}]}}}}'.encode()

    return readers.cached_payloads(spark, files_of(zones(spark, d).withColumn("g", geometry()), "s_nationkey", make, "json"))


@query(f"WITH {BOX_SQL} SELECT CAST(n AS VARCHAR) AS name, count(*) AS shapes, CAST(sum((x9 - x0) * (y9 - y0)) AS DOUBLE) AS area FROM zones WHERE n % 5 <> 0 GROUP BY n")
def source_cached_isochrones(spark: SparkSession, d: str) -> DataFrame:
    """Isochrones of cached payloads without errors (SRC-15, SRC-16)."""
    edges = geo.polygon_edges(readers.isochrone_features(payloads(spark, d)).withColumn("id", F.concat_ws("/", "name", "place")), "geometry", ["name", "id"])
    areas = polygon.areas(edges, "id").withColumn("name", F.split_part("id", F.lit("/"), F.lit(1)))
    return areas.groupBy("name").agg(F.count("*").alias("shapes"), F.sum("area").alias("area"))


@query("SELECT CAST(s_nationkey AS VARCHAR) AS name, CAST(s_nationkey AS VARCHAR) AS code, 'none' AS message FROM supplier WHERE s_nationkey % 5 = 0 GROUP BY s_nationkey")
def source_payload_errors(spark: SparkSession, d: str) -> DataFrame:
    return readers.payload_errors(payloads(spark, d))


@query(f"WITH {BOX_SQL} SELECT CAST(n AS VARCHAR) AS name, 'S' || CAST(z % 4 AS VARCHAR) AS station_key, CAST(min_by(x0, z) AS DOUBLE) AS x, CAST(min_by(y0, z) AS DOUBLE) AS y, count(*) AS \"rows\", array_to_string(list_sort(list(DISTINCT 'L' || CAST(z % 3 AS VARCHAR))), '|') AS lines FROM zones WHERE n % 5 <> 0 GROUP BY n, z % 4")
def merged_stations(spark: SparkSession, d: str) -> DataFrame:
    """Stations of each cached search that isn't an error, one row for each name (ISO-1, SRC-13)."""
    return isochrones.merge_stations(readers.stations(payloads(spark, d)), by=["name"]).select("name", "station_key", "x", "y", "rows", "lines")


OVERLAP = "least(a.x9, b.x9) - greatest(a.x0, b.x0)", "least(a.y9, b.y9) - greatest(a.y0, b.y0)"


@query(f"WITH {BOX_SQL} SELECT a.p, b.z, CAST(({OVERLAP[0]}) * ({OVERLAP[1]}) AS DOUBLE) AS overlap, round(({OVERLAP[0]}) * ({OVERLAP[1]}) / CAST((a.x9 - a.x0) * (a.y9 - a.y0) AS DOUBLE), 6) AS share FROM boxes a JOIN zones b ON {OVERLAP[0]} > 0 AND {OVERLAP[1]} > 0")
def polygon_overlay(spark: SparkSession, d: str) -> DataFrame:
    """Shares of part boxes in supplier boxes (JOIN-12)."""
    return polygon.overlay_shares(ring(part_boxes(spark, d), "p"), ring(zones(spark, d), "z"), "p", "z", digits=6).select("p", "z", "overlap", "share")


@query(f"WITH {BOX_SQL} SELECT a.p, b.z, CAST(({OVERLAP[0]}) * ({OVERLAP[1]}) AS DOUBLE) AS overlap, round(({OVERLAP[0]}) * ({OVERLAP[1]}) / CAST((a.x9 - a.x0) * (a.y9 - a.y0) AS DOUBLE), 6) AS share FROM boxes a JOIN zones b ON {OVERLAP[0]} > 0 AND {OVERLAP[1]} > 0")
def clipped_overlay(spark: SparkSession, d: str) -> DataFrame:
    """The same shares from the trapezoids of edges clipped to cells, which take polygons of any size (JOIN-12)."""
    return clipping.overlay_areas(ring(part_boxes(spark, d), "p"), ring(zones(spark, d), "z"), "p", "z", most=4, digits=6).select("p", "z", "overlap", "share")


@query(f"""WITH {BOX_SQL}, c AS (SELECT a.land, b.z, ({OVERLAP[0]}) * ({OVERLAP[1]}) / CAST((a.x9 - a.x0) * (a.y9 - a.y0) AS DOUBLE) AS ratio FROM lands a JOIN zones b ON {OVERLAP[0]} > 0 AND {OVERLAP[1]} > 0)
SELECT land, count(DISTINCT z) AS origin_count, round(max(ratio), 6) AS maximum_coverage, round(count(DISTINCT z) / CAST((SELECT count(*) FROM supplier) AS DOUBLE), 6) AS origin_ratio FROM c WHERE ratio >= 0.1 GROUP BY land""")
def district_coverage(spark: SparkSession, d: str) -> DataFrame:
    """Nations' boxes that suppliers' boxes cover to at least a tenth (JOIN-13, ISO-2)."""
    z = zones(spark, d)
    c = isochrones.district_coverage(ring(lands(spark, d), "land"), ring(z, "z").withColumn("shape", F.lit(0)), "land", "z", z.count())
    return c.select("land", "origin_count", r6("maximum_coverage").alias("maximum_coverage"), r6("origin_ratio").alias("origin_ratio"))


@query(f"WITH {BOX_SQL} SELECT k, count(DISTINCT z) AS reachable_origin_count, round(count(DISTINCT z) / CAST((SELECT count(*) FROM supplier) AS DOUBLE), 6) AS reachable_origin_ratio FROM pts JOIN zones ON x > x0 AND x < x9 AND y > y0 AND y < y9 GROUP BY k")
def stops_in_isochrones(spark: SparkSession, d: str) -> DataFrame:
    """Places of parts within suppliers' boxes (ISO-3, JOIN-10)."""
    z = zones(spark, d)
    return isochrones.stop_reach(part_points(spark, d), ring(z, "z"), "k", "z", z.count()).withColumn("reachable_origin_ratio", r6("reachable_origin_ratio"))


@query(f"WITH {BOX_SQL} SELECT k AS cell_id, x, y, min(z) AS z, CASE WHEN min(z) IS NULL THEN 'outside' ELSE 'matched' END AS status FROM pts LEFT JOIN zones ON x > x0 AND x < x9 AND y > y0 AND y < y9 GROUP BY k, x, y")
def od_crosswalk(spark: SparkSession, d: str) -> DataFrame:
    """The first supplier box that holds each part's place, and whether one does (OD-1, JOIN-16 to JOIN-18)."""
    z = zones(spark, d)
    return odmart.crosswalk(part_points(spark, d).withColumnRenamed("k", "cell_id"), ring(z, "z"), "z", z.select("z", F.col("z").alias("place"))).select("cell_id", "x", "y", "z", "status")


@query("""SELECT o_orderkey, coalesce(CAST(round_even(o_totalprice, 0) AS BIGINT) % 10, 0) + coalesce(o_custkey % 7, 0) AS movement_total, (CASE o_custkey % 9 WHEN 1 THEN '출근' WHEN 2 THEN '등교' WHEN 3 THEN '귀가' WHEN 4 THEN '쇼핑' WHEN 5 THEN '관광' WHEN 6 THEN '병원' WHEN 7 THEN '기타' ELSE '미상' END) AS purpose_name,
CAST(round_even(o_totalprice, 0) AS BIGINT) % 10 AS "남성_60대이상_이동량", o_custkey % 7 AS "여성_20대_이동량", 0 AS "여성_0대_이동량" FROM orders""")
def od_derived(spark: SparkSession, d: str) -> DataFrame:
    """Sums by sex and age band and purposes of moves (PRJ-31, PRJ-32)."""
    o = table(spark, d, "orders").select("o_orderkey", (F.bround(F.col("o_totalprice")).cast("long") % 10).alias("MALE_75_CNT"), (F.col("o_custkey") % 7).cast("long").alias("FEML_25_CNT"), (F.col("o_custkey") % 9).alias("MOVE_PURPOSE"), F.lit("5").alias("MOVE_TIME"), F.lit("7").alias("MOVE_DIST"))
    return odmart.with_derived(o).select("o_orderkey", F.col("movement_total").cast("long").alias("movement_total"), "purpose_name", *[F.col(c).cast("long").alias(c) for c in ("남성_60대이상_이동량", "여성_20대_이동량", "여성_0대_이동량")])


@query("""
WITH cal AS (SELECT s_suppkey AS service_id, min(l_shipdate) AS a, max(l_shipdate) AS b FROM supplier JOIN lineitem ON l_suppkey = s_suppkey GROUP BY s_suppkey),
base AS (SELECT service_id FROM cal WHERE DATE '1996-03-13' BETWEEN a AND b AND service_id % 2 = 0), ex AS (SELECT DISTINCT l_suppkey AS service_id, CASE WHEN l_returnflag = 'R' THEN '2' ELSE '1' END AS kind FROM lineitem WHERE CAST(l_shipdate AS DATE) = DATE '1996-03-13')
SELECT service_id FROM (SELECT service_id FROM base UNION SELECT service_id FROM ex WHERE kind = '1') EXCEPT SELECT service_id FROM ex WHERE kind = '2'""")
def services_of_a_day(spark: SparkSession, d: str) -> DataFrame:
    """Suppliers as services of a calendar that run on Wednesdays if their key is even, with exceptions from lines shipped that day (SET-5)."""
    li = table(spark, d, "lineitem")
    ymd = lambda c: F.date_format(c, "yyyyMMdd")
    base = li.groupBy(F.col("l_suppkey").alias("service_id")).agg(ymd(F.min("l_shipdate")).alias("start_date"), ymd(F.max("l_shipdate")).alias("end_date")).join(table(spark, d, "supplier").select(F.col("s_suppkey").alias("service_id")), "service_id", "left_semi")
    days = ["monday", "tuesday", "wednesday", "thursday", "friday", "saturday", "sunday"]
    calendar = base.withColumns({x: (F.when(F.col("service_id") % 2 == 0, "1").otherwise("0") if x == "wednesday" else F.lit("0")) for x in days})
    exceptions = li.select(F.col("l_suppkey").alias("service_id"), ymd("l_shipdate").alias("date"), F.when(F.col("l_returnflag") == "R", "2").otherwise("1").alias("exception_type")).distinct()
    return network.active_services(calendar, exceptions, "1996-03-13")


NATION_HOPS = """
s AS (SELECT s_suppkey AS k, s_nationkey AS n FROM supplier), l AS (SELECT l_orderkey, l_linenumber, l_suppkey, lead(l_suppkey) OVER w AS b, lead(l_linenumber) OVER w AS next_line, CAST(lead(l_quantity) OVER w AS BIGINT) AS q FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)),
h AS (SELECT l_orderkey, l_linenumber, next_line, q, x.n AS f, y.n AS t FROM l JOIN s x ON l_suppkey = x.k JOIN s y ON b = y.k),
walks AS (SELECT a.n_nationkey AS f, b.n_nationkey AS t, 300 + 10 * abs(a.n_nationkey - b.n_nationkey) AS sec FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey <> b.n_nationkey)"""


def nation_hops(spark: SparkSession, d: str) -> DataFrame:
    """l_orderkey, l_linenumber, next_line, q, f, t: consecutive lines of all orders between the suppliers' nations."""
    li = table(spark, d, "lineitem").select("l_orderkey", *ORDER_KEY, "l_quantity")
    h = network.consecutive(li, ["l_orderkey"], ORDER_KEY, {"l_suppkey": "b", "l_linenumber": "next_line", "l_quantity": "q"})
    s = table(spark, d, "supplier")
    at = lambda k, n: s.select(F.col("s_suppkey").alias(k), F.col("s_nationkey").cast("long").alias(n))
    return h.join(at("l_suppkey", "f"), "l_suppkey").join(at("b", "t"), "b").select("l_orderkey", "l_linenumber", "next_line", F.col("q").cast("long").alias("q"), "f", "t")


def nation_walks(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("from_stop"), "n_regionkey")
    return n.join(n.withColumnRenamed("from_stop", "to_stop"), "n_regionkey").filter("from_stop <> to_stop").select("from_stop", "to_stop", (300 + 10 * F.abs(F.col("from_stop") - F.col("to_stop"))).cast("int").alias("seconds"))


def nation_origins(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "nation").select(F.col("n_nationkey").cast("long").alias("origin"), F.col("n_nationkey").cast("long").alias("stop"), F.lit(0).alias("seconds"))


BOARD = "CASE WHEN st.r = v.r THEN 0 WHEN st.r = '' THEN v.w ELSE v.w + 120 END + v.sec"


@query(f"""
WITH RECURSIVE {NATION_HOPS}, rides AS (SELECT f, t, substr(o_orderpriority, 1, 1) AS r, CAST(200 + sum(q * 7 + f) % 900 AS INTEGER) AS sec FROM h JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL),
v AS (SELECT f, t, r, sec, CASE r WHEN '1' THEN 60 WHEN '2' THEN 150 WHEN '3' THEN 420 ELSE 300 END AS w FROM rides),
st(o, s, r, e) USING KEY (o, s, r) AS (
    SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), '', 0 FROM nation
  UNION
    SELECT n.o, n.s, n.r, n.e FROM (
        SELECT o, s, r, CAST(min(e) AS INTEGER) AS e FROM (
            SELECT st.o AS o, v.t AS s, v.r AS r, st.e + {BOARD} AS e FROM st JOIN v ON st.s = v.f
            UNION ALL SELECT st.o, w.t, '', st.e + w.sec FROM st JOIN walks w ON st.s = w.f) c WHERE e <= 1800 GROUP BY o, s, r) n
    LEFT JOIN recurring.st old ON old.o = n.o AND old.s = n.s AND old.r = n.r WHERE old.e IS NULL OR n.e < old.e
)
SELECT o AS origin, s AS stop, CAST(min(e) AS INTEGER) AS elapsed, round_even(min(e) / 60.0, 2) AS travel_minutes FROM st GROUP BY o, s""")
def reachability_30min(spark: SparkSession, d: str) -> DataFrame:
    """Nations reachable within 1800 s over routes by order priority, with waits of some routes and walks within a region (GRF-3 to GRF-6); rides sum up all orders."""
    h = nation_hops(spark, d).join(table(spark, d, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority"), "l_orderkey")
    rides = h.groupBy(F.col("f").alias("from_stop"), F.col("t").alias("to_stop"), F.substring("o_orderpriority", 1, 1).alias("route")).agg((200 + F.sum(F.col("q") * 7 + F.col("f")) % 900).alias("seconds")).withColumn("mode", F.lit("bus"))
    waits = spark.createDataFrame([("1", 60), ("2", 150), ("3", 420)], "route string, wait int")
    return routing.with_minutes(routing.multimodal(nation_origins(spark, d), rides, nation_walks(spark, d), waits))


@query(f"""
WITH RECURSIVE {NATION_HOPS}, v AS (SELECT DISTINCT f, t, CAST(l_linenumber * 200 + l_orderkey % 900 AS INTEGER) AS dep, CAST(next_line * 200 + l_orderkey % 900 + 60 AS INTEGER) AS arr FROM h),
st(o, s, a) USING KEY (o, s) AS (
    SELECT CAST(n_nationkey AS BIGINT), CAST(n_nationkey AS BIGINT), 300 FROM nation
  UNION
    SELECT n.o, n.s, n.a FROM (
        SELECT o, s, CAST(min(a) AS INTEGER) AS a FROM (
            SELECT st.o AS o, v.t AS s, v.arr AS a FROM st JOIN v ON st.s = v.f AND st.a <= v.dep WHERE v.arr >= v.dep
            UNION ALL SELECT st.o, w.t, st.a + w.sec FROM st JOIN walks w ON st.s = w.f) c WHERE a <= 700 GROUP BY o, s) n
    LEFT JOIN recurring.st old ON old.o = n.o AND old.s = n.s WHERE old.a IS NULL OR n.a < old.a
)
SELECT o AS origin, s AS stop, CAST(a AS INTEGER) AS arrival FROM st""")
def connection_scan(spark: SparkSession, d: str) -> DataFrame:
    """Earliest arrivals between nations over the lines of all orders as timed hops and over walks, leaving at second 300 with 400 s to go (GRF-1, GRF-2)."""
    h = nation_hops(spark, d).select(F.col("f").alias("from_stop"), F.col("t").alias("to_stop"), (F.col("l_linenumber") * 200 + F.col("l_orderkey") % 900).cast("int").alias("departure"), (F.col("next_line") * 200 + F.col("l_orderkey") % 900 + 60).cast("int").alias("arrival"))
    return routing.connection_scan(nation_origins(spark, d), h.filter("arrival >= departure").distinct(), nation_walks(spark, d), 300, 400)


@query("SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL")
def hourly_event_counts(spark: SparkSession, d: str) -> DataFrame:
    """The streaming count by hour, here over the table at rest."""
    e = table(spark, d, "events")
    return windows.hourly_counts(e.withColumn("ts", F.col("ts").cast("timestamp")), "ts", ["event_type"]).withColumn("start", F.col("start").cast(e.schema["ts"].dataType))


@query("""
WITH s AS (SELECT s_nationkey AS n, l_suppkey AS i, l_linenumber AS hour, l_returnflag AS flag FROM lineitem JOIN supplier ON l_suppkey = s_suppkey WHERE l_quantity > 40), x AS (SELECT DISTINCT n, hour, i FROM s WHERE flag = 'R'), y AS (SELECT DISTINCT n, hour, i FROM s WHERE flag = 'A'),
f AS (SELECT coalesce(x.n, y.n) AS n, coalesce(x.hour, y.hour) AS hour, count(*) FILTER (x.i IS NOT NULL AND y.i IS NOT NULL) AS tp, count(*) FILTER (x.i IS NULL) AS fp, count(*) FILTER (y.i IS NULL) AS fn FROM x FULL JOIN y ON x.n = y.n AND x.hour = y.hour AND x.i = y.i GROUP BY ALL),
m AS (SELECT hour, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS r, CASE WHEN tp + fp + fn > 0 THEN tp / (tp + fp + fn) ELSE 0 END AS j FROM f)
SELECT hour, count(*) AS origins, round(avg(p), 6) AS mean_precision, round(avg(r), 6) AS mean_recall, round(avg(j), 6) AS mean_jaccard, round(median(p), 6) AS median_precision, round(median(r), 6) AS median_recall, round(median(j), 6) AS median_jaccard FROM m GROUP BY hour""")
def hourly_agreement(spark: SparkSession, d: str) -> DataFrame:
    """Agreement of two sets of suppliers by nation, summed up by line number as the hour (AGG-19)."""
    j = table(spark, d, "lineitem").filter("l_quantity > 40").join(table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).withColumn("hour", F.col("l_linenumber"))
    scores = access.overlap_scores(j.filter("l_returnflag = 'R'"), j.filter("l_returnflag = 'A'"), ["s_nationkey", "hour"], "l_suppkey")
    a = isochrones.hourly_agreement(scores)
    return a.select("hour", "origins", *[r6(c).alias(c) for c in a.columns if c not in ("hour", "origins")])


PREDICTIONS = "p AS (SELECT ln(1 + CAST(o_totalprice AS DOUBLE)) AS y, avg(ln(1 + CAST(o_totalprice AS DOUBLE))) OVER (PARTITION BY o_orderpriority) AS a, avg(ln(1 + CAST(o_totalprice AS DOUBLE))) OVER (PARTITION BY year(o_orderdate), o_orderstatus) AS b FROM orders)"


@query(f"WITH {PREDICTIONS}, e AS (SELECT 'priority' AS model, y, a AS p FROM p UNION ALL SELECT 'year_status', y, b FROM p) SELECT model, round(sqrt(avg((y - p) ** 2)), 6) AS rmse, round(avg(abs(y - p)), 6) AS mae FROM e GROUP BY model ORDER BY rmse, model LIMIT 1")
def better_model(spark: SparkSession, d: str) -> DataFrame:
    """The better of two group means as models of order prices (ML-6, TOP-3)."""
    y = F.log1p(F.col("o_totalprice").cast("double"))
    o = table(spark, d, "orders").select(y.alias("y"), F.col("o_orderpriority").alias("priority"), F.struct(F.year("o_orderdate").alias("yr"), "o_orderstatus").alias("year_status"))

    def by(c: str) -> DataFrame:
        means = o.groupBy(F.col(c).alias("_k")).agg(F.avg("y").alias("prediction"))
        return o.join(means, F.col(c).eqNullSafe(F.col("_k"))).select("y", "prediction")

    scores = gaps.compare_models({c: by(c) for c in ("priority", "year_status")}, "y").select("model", r6("rmse").alias("rmse"), r6("mae").alias("mae"))
    return gaps.best_model(scores)  # models whose rounded scores are equal tie, and go by name


@query("""SELECT l_orderkey, l_linenumber, (CASE l_linenumber % 3 WHEN 0 THEN '식사' WHEN 1 THEN '쇼핑' ELSE '카페' END) AS purpose, CAST(CASE l_linenumber % 3 WHEN 0 THEN l_quantity + l_suppkey WHEN 1 THEN l_suppkey ELSE l_quantity END AS BIGINT) AS sales, CAST(CASE l_linenumber % 3 WHEN 1 THEN l_partkey ELSE 0 END AS BIGINT) AS facilities FROM lineitem""")
def purpose_measures(spark: SparkSession, d: str) -> DataFrame:
    """Sales in the hours and facilities that count for a line's purpose (PRJ-24 to PRJ-26)."""
    n = F.col("l_linenumber") % 3
    li = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", F.when(n == 0, "식사").when(n == 1, "쇼핑").otherwise("카페").alias("purpose"), F.col("l_quantity").cast("double").alias("시간대_11~14_매출_금액"), F.col("l_suppkey").cast("double").alias("시간대_17~21_매출_금액"), F.col("l_partkey").cast("double").alias("백화점_수"))
    return li.select("l_orderkey", "l_linenumber", "purpose", codes.purpose_hours(li.columns, F.col("purpose")).cast("long").alias("sales"), codes.purpose_facilities(li.columns, F.col("purpose")).cast("long").alias("facilities"))


@query("SELECT n_nationkey, coalesce(a, 0.0) AS \"약국_수\", coalesce(b, 0.0) AS \"극장_수\" FROM nation LEFT JOIN (SELECT s_nationkey, CAST(sum(s_suppkey % 5) AS DOUBLE) AS a, CAST(sum(s_suppkey % 3) AS DOUBLE) AS b FROM supplier GROUP BY ALL) ON s_nationkey = n_nationkey")
def facility_totals(spark: SparkSession, d: str) -> DataFrame:
    """Sums of the facility columns that are there (AGG-26)."""
    s = table(spark, d, "supplier").select(F.col("s_nationkey").alias("n_nationkey"), (F.col("s_suppkey") % 5).cast("string").alias("약국_수"), (F.col("s_suppkey") % 3).cast("string").alias("극장_수"))
    return explain.facility_sums(table(spark, d, "nation").select("n_nationkey"), s, ["n_nationkey"], ["약국_수", "극장_수", "대학교_수"])


@query("""
WITH g AS (SELECT n_name, sum(CAST(o_totalprice AS DECIMAL(12,2))) AS v, count(*) FILTER (o_orderstatus = 'P') AS p FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY n_name)
SELECT n_name, CAST(nullif(p, 0) AS BIGINT) AS p, row_number() OVER (ORDER BY nullif(p, 0) DESC NULLS LAST, n_name) AS place FROM g""")
def mixed_ranking(spark: SparkSession, d: str) -> DataFrame:
    """Nations by open orders, most first and none last, then by name (TOP-2)."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    g = o.groupBy("n_name").agg(F.nullif(F.count_if(F.col("o_orderstatus") == "P"), F.lit(0)).alias("p"))
    w = Window.orderBy(F.desc_nulls_last("p"), "n_name")  # one row a nation
    return g.select("n_name", F.col("p").cast("long").alias("p"), F.row_number().over(w).cast("long").alias("place"))


@query("""
WITH h AS (SELECT l_suppkey AS f, lead(l_suppkey) OVER w AS t, l_returnflag AS route FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey)), k AS (SELECT s_suppkey AS s FROM supplier WHERE s_nationkey < 12)
SELECT f AS from_stop, t AS to_stop, count(*) AS n FROM h WHERE t IS NOT NULL AND route IN ('R', 'A') AND f IN (FROM k) AND t IN (FROM k) GROUP BY f, t""")
def active_network(spark: SparkSession, d: str) -> DataFrame:
    """Hops of active routes with both ends among the known stops (PRJ-33, PRJ-34)."""
    li = table(spark, d, "lineitem").select("l_orderkey", *ORDER_KEY, "l_returnflag")
    rides = network.consecutive(li, ["l_orderkey"], ORDER_KEY, {"l_suppkey": "to_stop"}).select(F.col("l_suppkey").alias("from_stop"), "to_stop", F.col("l_returnflag").alias("route"))
    stops = table(spark, d, "supplier").filter("s_nationkey < 12").select(F.col("s_suppkey").alias("stop"))
    kept = routing.within_stops(routing.active_rides(rides, spark.createDataFrame([("R",), ("A",)], "route string")), stops)
    return kept.groupBy("from_stop", "to_stop").agg(F.count("*").alias("n"))


def model_comparison(spark: SparkSession, d: str) -> DataFrame:
    """Schemes of hold-outs by models: ridge, boosted trees and boosted histograms over years and over groups of nations (ML-3, ML-5 to ML-7, AGG-13)."""
    from .catalog_more import nation_quarters

    q = cut(nation_quarters(spark, d), "quarters")
    grouped = q.join(gaps.balanced_group_folds(q, "nation"), "nation")
    frames = {}
    for scheme, df, fold in (("year", q, "yr"), ("nation_group", grouped, "fold")):
        frames[f"{scheme}/ridge"] = gaps.ridge_out_of_fold(df, ["x1", "x2"], "y", fold)
        frames[f"{scheme}/boosted"] = gaps.boosted_out_of_fold(df, ["x1", "x2"], "y", fold, rounds=5)
        frames[f"{scheme}/histogram"] = boosting.histogram_out_of_fold(df, ["x1", "x2"], "y", fold, rounds=4, rate=0.3)[0]
    return gaps.compare_models(frames, "y").select(F.split_part("model", F.lit("/"), F.lit(1)).alias("scheme"), F.split_part("model", F.lit("/"), F.lit(2)).alias("model"), "rmse", "mae", "r2")


WITHOUT_SQL["model_comparison"] = model_comparison
