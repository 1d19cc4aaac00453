"""Scans: CSV in several encodings, archives, transit feeds, spreadsheets, shapes, GeoJSON and cached JSON.

UTF-8 CSV goes through Spark's own reader with an explicit schema, CSV in archives through a data source of its own.
Other files that Spark can't open (other encodings, spreadsheets, shapes) are read whole as binary rows, one file a row,
and parsed in tasks.
"""

from __future__ import annotations

import csv
import io
import re
import struct
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator
from itertools import islice

import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..functions.compat import require_columns
from .archives import ZippedCsv, decode, member_names, pick_member

ENCODINGS = ("utf-8-sig", "cp949", "euc-kr")
GTFS_REQUIRED = ("stops", "trips", "stop_times")
GTFS_OPTIONAL = ("calendar", "calendar_dates", "transfers", "routes")


def csv_utf8(spark: SparkSession, paths: str | list[str], schema: StructType | str) -> DataFrame:
    """CSV with a header, UTF-8 with or without a byte order mark (SRC-1, SRC-8)."""
    return spark.read.schema(schema).csv(paths, header=True, enforceSchema=False)


def union_by_name(frames: list[DataFrame]) -> DataFrame:
    """All rows with the union of the columns (SRC-8, SET-1)."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out


def archive_member(data: bytes, pick: str, suffix: str = ".csv") -> bytes:
    """The content of the member that `pick_member` takes."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        return z.read(pick_member(z.namelist(), pick, suffix))


def _strings(columns: list[str]) -> StructType:
    return StructType([StructField(c, StringType()) for c in columns])


def csv_any(spark: SparkSession, paths: str | list[str], columns: list[str], archive: str | None = None, encodings: tuple[str, ...] = ENCODINGS, block: int = 64 << 20) -> DataFrame:
    """Named columns of CSV files as strings, in any of the encodings, plain or within a ZIP (SRC-2 to SRC-6). A missing column raises.

    Members of archives are read in blocks of `block` bytes; a plain file in another encoding is one row of one task.
    """
    if archive:
        spark.dataSource.register(ZippedCsv)
        reader = spark.read.format("zipped_csv").schema(_strings(columns)).option("member", archive).option("encodings", ",".join(encodings)).option("block", block)
        return union_by_name([reader.load(p) for p in ([paths] if isinstance(paths, str) else paths)])

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, data in zip(pdf["path"], pdf["content"]):
                rows = csv.reader(io.StringIO(decode(data, encodings), newline=""))
                head = [h.strip() for h in next(rows, [])]
                if missing := [c for c in columns if c not in head]:
                    raise ValueError(f"{path} lacks columns: {', '.join(missing)}")
                at = [head.index(c) for c in columns]
                while held := [[row[i] if i < len(row) and row[i] != "" else None for i in at] for row in islice(rows, 50_000)]:
                    yield pd.DataFrame(held, columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(paths).select("path", "content").mapInPandas(read, _strings(columns))


def gtfs_table(spark: SparkSession, source: str, name: str, columns: list[str]) -> DataFrame:
    """A feed's table as strings, from a folder or a ZIP (SRC-6)."""
    if source.lower().endswith(".zip"):
        return csv_any(spark, source, columns, archive=f"{name}.txt", encodings=("utf-8-sig",))
    return require_columns(spark.read.csv(f"{source.rstrip('/')}/{name}.txt", header=True, inferSchema=False), columns, name).select(*columns)


def gtfs_files(spark: SparkSession, source: str) -> dict[str, bool]:
    """Which tables a feed has; raises if one that is needed is missing (SRC-6)."""
    if source.lower().endswith(".zip"):
        names = {n.rpartition("/")[2] for n in member_names(source)}
    else:
        names = {r[0].rpartition("/")[2] for r in spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(source).select("path").collect()}
    found = {t: f"{t}.txt" in names for t in (*GTFS_REQUIRED, *GTFS_OPTIONAL)}
    if missing := [t for t in GTFS_REQUIRED if not found[t]]:
        raise ValueError(f"the feed lacks {', '.join(missing)}")
    if not (found["calendar"] or found["calendar_dates"]):
        found["every_service"] = True
    return found


def excel_rows(data: bytes, sheet: str) -> list[list[str | None]]:
    """The cells of a sheet as strings, from the workbook's XML (SRC-7)."""
    main = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        links = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
        names = {s.get("name"): s.get("{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id") for s in book.iter(f"{main}sheet")}
        if sheet not in names:
            raise ValueError(f"no sheet {sheet}")
        shared = ["".join(t.text or "" for t in si.iter(f"{main}t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml"))] if "xl/sharedStrings.xml" in z.namelist() else []
        target = links[names[sheet]].lstrip("/")
        grid = ET.fromstring(z.read(target if target.startswith("xl/") else f"xl/{target}"))
    rows = []
    for r in grid.iter(f"{main}row"):
        row: list[str | None] = []
        for c in r.iter(f"{main}c"):
            at = 0
            for letter in re.match("[A-Z]+", c.get("r"))[0]:
                at = at * 26 + ord(letter) - 64
            value = c.find(f"{main}v")
            text = "".join(t.text or "" for t in c.iter(f"{main}t")) if c.get("t") == "inlineStr" else value.text if value is not None else None
            row += [None] * (at - 1 - len(row)) + [shared[int(text)] if c.get("t") == "s" and text is not None else text]
        rows.append(row)
    return rows


def excel_sheet(spark: SparkSession, paths: str | list[str], sheet: str, columns: list[str]) -> DataFrame:
    """Named columns of a sheet as strings; the first row is the header (SRC-7)."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                head, *rows = excel_rows(data, sheet) or [[]]
                at = [head.index(c) for c in columns]
                yield pd.DataFrame([[r[i] if i < len(r) else None for i in at] for r in rows], columns=columns, dtype=object)

    return spark.read.format("binaryFile").load(paths).select("content").mapInPandas(read, _strings(columns))


def shape_polygons(data: bytes) -> list[list[list[tuple[float, float]]]]:
    """Rings of each record of a polygon .shp file."""
    out, at = [], 100
    while at < len(data):
        _, words = struct.unpack(">ii", data[at : at + 8])
        body = data[at + 8 : at + 8 + 2 * words]
        rings = []
        if struct.unpack("<i", body[:4])[0] in (5, 15, 25):
            parts, points = struct.unpack("<ii", body[36:44])
            begins = [*struct.unpack(f"<{parts}i", body[44 : 44 + 4 * parts]), points]
            xy = struct.unpack(f"<{2 * points}d", body[44 + 4 * parts : 44 + 4 * parts + 16 * points])
            rings = [[(xy[2 * i], xy[2 * i + 1]) for i in range(a, b)] for a, b in zip(begins, begins[1:])]
        out.append(rings)
        at += 8 + 2 * words
    return out


def dbf_rows(data: bytes, encodings: tuple[str, ...] = ("utf-8", "cp949", "euc-kr")) -> list[dict[str, str]]:
    """Rows of a .dbf file as strings."""
    n, head, size = struct.unpack("<IHH", data[4:12])
    fields, at = [], 32
    while data[at] != 0x0D:
        fields.append((data[at : at + 11].split(b"\0")[0].decode("ascii"), data[at + 16]))
        at += 32
    rows = []
    for i in range(n):
        record, p, row = data[head + i * size : head + (i + 1) * size], 1, {}
        for name, width in fields:
            row[name] = decode(record[p : p + width], encodings).strip()
            p += width
        rows.append(row)
    return rows


def shapefile_edges(spark: SparkSession, path: str, columns: list[str]) -> DataFrame:
    """One row per ring edge of a zipped polygon shapefile: columns, part, ring, hole, x1, y1, x2, y2; a counter-clockwise ring is a hole (SRC-9)."""
    names = [*columns, "part", "ring", "hole", "x1", "y1", "x2", "y2"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for data in pdf["content"]:
                rows = []
                for rings, row in zip(shape_polygons(archive_member(data, "single", ".shp")), dbf_rows(archive_member(data, "single", ".dbf"))):
                    for k, ring in enumerate(rings):
                        turn = sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(ring, ring[1:]))
                        rows += [(*[row.get(c) for c in columns], 0, k, turn > 0, *a, *b) for a, b in zip(ring, ring[1:]) if a != b]
                yield pd.DataFrame(rows, columns=names)

    kinds = ", ".join([*[f"`{c}` string" for c in columns], "part int, ring int, hole boolean, x1 double, y1 double, x2 double, y2 double"])
    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(read, kinds)


def geojson_features(spark: SparkSession, paths: str | list[str], properties: list[str]) -> DataFrame:
    """place, properties and geometry (a JSON string) of each feature, in file order (SRC-10, SRC-11)."""
    schema = "struct<features:array<struct<properties:map<string,string>,geometry:string>>>"
    f = spark.read.text(paths, wholetext=True).select(F.posexplode(F.from_json("value", schema)["features"]).alias("place", "f"))
    return f.select("place", *[F.col("f.properties")[p].alias(p) for p in properties], F.col("f.geometry").alias("geometry"))


def feature_by_code(features: DataFrame, code: str, names: tuple[str, ...] = ("SIG_CD", "code")) -> DataFrame:
    """The feature whose first present code property has the value; raises, when it runs, unless there is exactly one (SRC-17)."""
    have = [F.col(n) for n in names if n in features.columns]
    found = features.filter(F.coalesce(*have) == code)
    n = found.agg(F.count("*").alias("_n"))
    return n.filter(F.when(F.col("_n") == 1, True).otherwise(F.raise_error(F.lit(f"not one feature of code {code}")).cast("boolean"))).crossJoin(found).drop("_n")


def cached_payloads(spark: SparkSession, folder: str, pattern: str = "*.json") -> DataFrame:
    """name and payload of each cached JSON file; files that don't parse go, and none at all raises when it runs (SRC-12, SRC-15)."""
    try:
        raw = spark.read.option("pathGlobFilter", pattern).text(folder, wholetext=True)
    except AnalysisException as e:
        raise ValueError(f"no cache in {folder}") from e
    named = raw.select(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1).alias("name"), F.col("value").alias("payload"))
    return named.filter(F.try_parse_json("payload").isNotNull())


def isochrone_features(payloads: DataFrame) -> DataFrame:
    """name, place, geometry of valid isochrone payloads; those that carry an error, as an object or a list, go (SRC-16)."""
    good = payloads.filter(F.get_json_object("payload", "$.error").isNull())
    f = F.from_json(F.get_json_object("payload", "$.result.geojson"), "struct<features:array<struct<geometry:string>>>")["features"]
    return good.select("name", F.posexplode(f).alias("place", "f")).select("name", "place", F.col("f.geometry").alias("geometry"))


def payload_errors(payloads: DataFrame) -> DataFrame:
    """name, code, message of payloads that carry an error."""
    e = F.get_json_object("payload", "$.error")
    one = F.when(e.startswith("["), F.get_json_object(e, "$[0]")).otherwise(e)
    return payloads.filter(e.isNotNull()).select("name", F.get_json_object(one, "$.code").alias("code"), F.coalesce(F.get_json_object(one, "$.message"), F.get_json_object(one, "$.msg")).alias("message"))


def stations(payloads: DataFrame) -> DataFrame:
    """station_id, station_name, line, x, y, class of cached station searches (SRC-13)."""
    s = F.from_json(F.get_json_object("payload", "$.result.station"), "array<struct<stationClass:int,x:double,y:double,stationID:string,stationName:string,laneName:string>>")
    return payloads.select("name", F.posexplode(s).alias("place", "s")).select("name", "place", F.col("s.stationID").alias("station_id"), F.col("s.stationName").alias("station_name"), F.col("s.laneName").alias("line"), F.col("s.x").alias("x"), F.col("s.y").alias("y"), F.col("s.stationClass").alias("station_class"))
