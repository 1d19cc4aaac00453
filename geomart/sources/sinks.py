"""Sinks: CSV, GeoJSON, run metadata and reports. Parquet is the store that stages share; these are for readers outside."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.tables import cut, scratch


def write_csv(df: DataFrame, path: str) -> None:
    """CSV with a header, a folder of parts (SNK-1)."""
    df.write.mode("overwrite").csv(path, header=True)


def feature_lines(df: DataFrame, geometry: str, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row, from a geometry in JSON text (SNK-2, SNK-6)."""
    body = F.to_json(F.struct(*properties))
    return df.select(F.concat(F.lit('{"type":"Feature","properties":'), body, F.lit(',"geometry":'), F.coalesce(geometry, F.lit("null")), F.lit("}")).alias("value"))


def write_features(df: DataFrame, path: str, geometry: str, properties: list[str]) -> None:
    feature_lines(df, geometry, properties).write.mode("overwrite").text(path)


def write_collection(df: DataFrame, uri: str, geometry: str, properties: list[str], chunk: int = 1 << 20) -> None:
    """One file with one FeatureCollection (SNK-2, SNK-6). Tasks write parts to shared storage; one task then strings these together, `chunk` bytes at a time, under a name of its own that becomes `uri` at the end."""
    spark = df.sparkSession
    folder = scratch(spark, "features")
    flat = df.withColumn(geometry, F.translate(geometry, "\r\n", "  "))
    feature_lines(flat, geometry, properties).write.text(folder)

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            source, parts = fs.FileSystem.from_uri(folder)
            store, path = fs.FileSystem.from_uri(uri)
            own, owed = f"{path}.{uuid.uuid4().hex}", False
            names = sorted(f.path for f in source.get_file_info(fs.FileSelector(parts)) if f.base_name.startswith("part-"))
            store.create_dir(path.rpartition("/")[0], recursive=True)
            with store.open_output_stream(own) as out:
                out.write(b'{"type":"FeatureCollection","features":[\n')
                for name in names:
                    with source.open_input_stream(name) as f:
                        while held := f.read(chunk):
                            if owed:
                                out.write(b",\n")
                            owed = held.endswith(b"\n")
                            out.write(held[: len(held) - owed].replace(b"\n", b",\n"))
                out.write(b"\n]}\n")
            store.move(own, path)
            yield batch

    spark.range(1).mapInArrow(join, "id long").count()


def run_metadata(df: DataFrame, **values) -> DataFrame:
    """A single JSON row of aggregates and parameters (SNK-3, SNK-7)."""
    cols = [v.alias(k) if hasattr(v, "alias") else F.lit(v).alias(k) for k, v in values.items()]
    return df.agg(*cols).select(F.to_json(F.struct("*")).alias("value"))


def merged_features(parts: dict[str, DataFrame], geometry: str, tag: str = "origin") -> DataFrame:
    """Features of several tables in one collection, each with the name of its table in the property `tag` (SNK-6)."""
    tagged = [df.select(F.lit(name).alias(tag), geometry) for name, df in parts.items()]
    return feature_lines(reduce(lambda a, b: a.unionByName(b), tagged), geometry, [tag])


def markdown_rows(df: DataFrame, order: list[str]) -> DataFrame:
    """line, value: the lines of a report table, of any length (SNK-4). The head is lines 1 and 2, rows follow in order."""
    cells = F.concat(F.lit("| "), F.concat_ws(" | ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in df.columns]), F.lit(" |"))
    ranked = running_order(df, order).select((F.col("_place") + 3).alias("line"), cells.alias("value"))
    head = df.sparkSession.createDataFrame([(1, "| " + " | ".join(df.columns) + " |"), (2, "|" + "---|" * len(df.columns))], "line long, value string")
    return head.unionByName(ranked)


def running_order(df: DataFrame, order: list[str]) -> DataFrame:
    """df with `_place`, its place from 0 in the order: ranges are numbered one by one and follow each other."""
    parts = cut(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()), "ranges")
    sizes = parts.groupBy("_part").agg(F.count("*").alias("_n"))
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # one row a range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return parts.withColumn("_in", inside).join(F.broadcast(before), "_part").withColumn("_place", F.col("_before") + F.col("_in")).drop("_part", "_in", "_before")


def markdown_table(df: DataFrame, most: int = 200) -> str:
    """A report table; more than `most` rows raise an error (SNK-4)."""
    rows = df.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"a report table of more than {most} rows")
    lines = ["| " + " | ".join(df.columns) + " |", "|" + "---|" * len(df.columns)]
    return "\n".join([*lines, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)])


def write_files(df: DataFrame, folder: str) -> DataFrame:
    """Writes each row's `content` (binary) to a file `name` under the folder and returns the names; tasks write, nothing passes through the driver."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                store, path = fs.FileSystem.from_uri(f"{folder}/{name}")
                store.create_dir(path.rpartition("/")[0], recursive=True)
                with store.open_output_stream(path) as out:
                    out.write(content.as_py())
            yield batch.select(["name"])

    return cut(df.select("name", "content").mapInArrow(write, "name string"), "files")
