"""Requests to a limited service as a stream: answers are cached, so a stopped run goes on without a second call."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

ANSWERS = "name string, payload string"
FOLDERS = ("cache", "quarantine")


class BudgetSpent(RuntimeError):
    """There are more requests than calls left; those made are cached."""


def answers(spark: SparkSession, folder: str, kind: str = "cache") -> DataFrame:
    """name and payload of the files under folder/cache, or of refused answers under folder/quarantine; no rows where there are none."""
    store, path = fs.FileSystem.from_uri(f"{folder}/{kind}")
    store.create_dir(path, recursive=True)
    raw = spark.read.schema("value string").option("pathGlobFilter", "*.json").text(f"{folder}/{kind}", wholetext=True)
    file = F.url_decode(F.regexp_extract(F.col("_metadata.file_path"), r"([^/]+)\.json$", 1))  # the path is a URI
    return raw.select(F.url_decode(file).alias("name"), F.col("value").alias("payload"))


def known_names(spark: SparkSession, folder: str) -> DataFrame:
    """The names that have been asked for, answered or refused."""
    return answers(spark, folder).unionByName(answers(spark, folder, "quarantine")).select("name")


def _ask(call: Callable[[str, str], str], good: Callable[[str], bool], folder: str):
    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, file, request in zip(*(c.to_pylist() for c in batch.columns)):
                if any(store.get_file_info(f"{root}/{k}/{file}.json").type == fs.FileType.File for k in FOLDERS):
                    continue  # a task that ran before has asked
                answer = call(name, request)
                kind, own = FOLDERS[not good(answer)], f"{root}/open-{uuid.uuid4().hex}"
                with store.open_output_stream(own) as out:
                    out.write(answer.encode())
                store.move(own, f"{root}/{kind}/{file}.json")  # whole or not at all
            yield batch.select(["name"])

    return ask


def fetch(requests: DataFrame, call: Callable[[str, str], str], good: Callable[[str], bool], folder: str, budget: int) -> int:
    """Asks for the requests (name, request) that have no answer yet, at most `budget` calls over all runs; the number of requests asked for (SRC-12).

    `call` gets name and request in a task and returns the answer's text; answers that aren't `good` go to quarantine and
    are not asked for again. Names that repeat count once, the first request by text. Raises BudgetSpent after the last
    call that the budget allows if requests are left.
    """
    spark = requests.sparkSession
    known = known_names(spark, folder)
    left = max(0, budget - known.count())
    open_ = requests.filter("name is not null").groupBy("name").agg(F.coalesce(F.min("request"), F.lit("")).alias("request")).join(known, "name", "left_anti")
    waiting = open_.limit(left + 1).count()
    if waiting:
        chosen = open_.orderBy("name").limit(left).select("name", F.url_encode("name").alias("file"), "request")
        chosen.repartition("name").mapInArrow(_ask(call, good, folder), "name string").count()
    if waiting > left:
        raise BudgetSpent(f"{budget} calls are spent")
    return waiting


def fetch_stream(requests: DataFrame, call: Callable[[str, str], str], good: Callable[[str], bool], folder: str, budget: int, checkpoint: str) -> StreamingQuery:
    """The same for a stream of requests, batch by batch. A batch that fails or spends the budget isn't committed: the next run with the same checkpoint and folder takes it up and calls only for what has no answer."""
    return requests.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, _: fetch(batch, call, good, folder, budget)).start()
