"""Importance resampling of documents towards the texts of a target table.

Runs of one to three words hash into buckets; each bucket gains by how much more often the target holds it. A document's
weight is read off an array of gains, Gumbel noise by doc_id turns weights into scores, and the highest scores are drawn
without replacement. Ranks come from an exact histogram of the integer scores: sums over all higher scores are the
offsets of each score, and only documents at or above the score that is cut last are numbered, by doc_id within a score.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, text_or_empty

BUCKETS = 10_000
#: Bytes of words stand for themselves or for their lower case (A-Z), all others for a space.
WORD_BYTES = bytes(b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else b + 32 if chr(b).isupper() else 0x20 for b in range(256))
WEIGHTS = "doc_id long, n_words long, n_features long, weight long"


def feature_buckets(text: bytes, buckets: int = BUCKETS, block: int = 1 << 20) -> Iterator[tuple[int, np.ndarray]]:
    """The number of words and the buckets of all runs of one to three words, in blocks of about `block` bytes."""
    text, held, at = text.translate(WORD_BYTES), [], 0
    while at < len(text):
        end = text.find(b" ", at + block)
        end = len(text) if end < 0 else end
        words, k = held + text[at:end].split(), len(held)
        later = [b" " + w for w in words[1:]]
        one = list(map(crc32, words))
        two = list(map(crc32, later, one))  # the checksum goes on from that of the run without its last word
        three = list(map(crc32, later[1:], two))
        yield len(words) - k, np.array(one[k:] + two[max(k - 1, 0) :] + three[max(k - 2, 0) :], np.int64) % buckets
        held, at = words[-2:], end


def bucket_counts(docs: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """bucket, n: features of all texts by bucket. Each task hands on at most `buckets` rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for text in batch.column(0):
                for _, found in feature_buckets(text.as_py(), buckets):
                    np.add.at(total, found, 1)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int32()), pa.array(total[held])], names=["bucket", "n"])

    return docs.select(text_or_empty().cast("binary").alias("text")).mapInArrow(count, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def bucket_gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> np.ndarray:
    """The gain of each bucket in thousandths of a natural logarithm, with one feature more in every bucket of both tables; `buckets` rows reach the driver."""
    spark = docs.sparkSession
    both = bucket_counts(docs, buckets).withColumn("of", F.lit("s")).unionByName(bucket_counts(target, buckets).withColumn("of", F.lit("t")))
    held = {(r["of"], r["bucket"]): r["n"] for r in both.collect()}  # two rows a bucket at most
    counts = spark.createDataFrame(pa.table({"bucket": range(buckets), "s": [held.get(("s", b), 0) for b in range(buckets)], "t": [held.get(("t", b), 0) for b in range(buckets)]}))
    more = lambda c, n: F.col(c).cast("double") + n
    total = {c: sum(n for (of, _), n in held.items() if of == c) for c in "st"}
    ratio = more("t", 1) * F.lit(float(total["s"] + buckets)) / (more("s", 1) * F.lit(float(total["t"] + buckets)))
    gains = np.zeros(buckets, np.int64)
    for row in counts.select("bucket", F.floor(1000 * F.log(ratio)).alias("gain")).collect():
        gains[row["bucket"]] = row["gain"]
    return gains


def weigh(docs: DataFrame, gains: np.ndarray) -> DataFrame:
    """doc_id, n_words, n_features, weight (the sum of its features' gains) of every document."""
    shared = docs.sparkSession.sparkContext.broadcast(gains)  # eight bytes a bucket

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gain = shared.value
        for batch in batches:
            out = np.zeros((3, batch.num_rows), np.int64)
            for i, text in enumerate(batch.column(1)):
                for words, found in feature_buckets(text.as_py(), len(gain)):
                    out[:, i] += words, len(found), gain[found].sum()
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, out)], names=["doc_id", "n_words", "n_features", "weight"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().cast("binary").alias("text")).mapInArrow(score, WEIGHTS)


def gumbel(doc_id: Column, seed: int) -> Column:
    """Noise of a doc_id in thousandths: the same in every run and at every size."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h.cast("double") + 0.5) / 4294967296.0)))


def in_ranges(df: DataFrame, order: list[Column], kind: str) -> DataFrame:
    """df on storage with `part`: the number of its range in the order, ranges of about equal size."""
    return cut(df.repartitionByRange(*order).withColumn("part", F.spark_partition_id()), kind)


def with_offsets(cells: DataFrame) -> DataFrame:
    """cells: part, score, n, where parts follow each other by falling scores. Adds `above`: the sum of n over all cells before this one.

    Sums run within a part, and over the parts' totals, one row a part.
    """
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = cells.groupBy("part").agg(F.sum("n").alias("held")).select("part", F.coalesce(F.sum("held").over(before), F.lit(0)).alias("earlier"))
    inside = Window.partitionBy("part").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, -1)
    return cells.withColumn("inside", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(parts, "part").withColumn("above", F.col("earlier") + F.col("inside")).drop("earlier", "inside")


def draw(scored: DataFrame, drawn: int) -> DataFrame:
    """scored: doc_id, score, eligible and more, on storage. Adds `rank`: 1 to `drawn` for the eligible rows of the highest scores, ties to the smaller doc_id (null last), else null.

    The histogram has one row a score. A score that very many rows share is numbered range by range, each a cell of its own.
    """
    histogram = in_ranges(scored.filter("eligible").groupBy("score").agg(F.count("*").alias("n")), [F.desc("score")], "histogram")
    last = with_offsets(histogram).filter(F.col("above") < F.lit(drawn)).agg(F.min("score")).first()[0]
    unranked = scored.withColumn("rank", F.lit(None).cast("long"))
    if last is None:
        return unranked
    surviving = F.col("eligible") & (F.col("score") >= F.lit(last))
    line = [F.asc_nulls_last("doc_id"), F.asc("row")]
    named = in_ranges(scored.filter(surviving).withColumn("row", F.monotonically_increasing_id()), [F.desc("score"), *line], "surviving")
    offsets = with_offsets(named.groupBy("part", "score").agg(F.count("*").alias("n"))).drop("n")
    ranked = named.join(offsets, ["part", "score"]).withColumn("rank", F.col("above") + F.row_number().over(Window.partitionBy("part", "score").orderBy(*line)))
    ranked = ranked.withColumn("rank", F.when(F.col("rank") <= F.lit(drawn), F.col("rank")))
    return unranked.filter(~surviving).unionByName(ranked.select(unranked.columns))


def resample(docs: DataFrame, target: DataFrame, percent: int = 5, least_words: int = 20, buckets: int = BUCKETS, seed: int = 42) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every document; `percent` of those with `least_words` words or more are drawn.

    A null text has no words, so neither features nor weight. Repeated rows are drawn one by one, each with a rank of its
    own; a null doc_id has the noise of an empty one and comes last in ties. An empty table gives an empty one; an empty
    target lowers every weight alike for equal counts. Columns beside doc_id and text are not read.
    """
    found = weigh(docs, bucket_gains(docs, target, buckets))
    scored = cut(found.select("doc_id", "n_features", "weight", (F.col("weight") + gumbel(F.col("doc_id"), seed)).alias("score"), (F.col("n_words") >= least_words).alias("eligible")), "scored")
    n = scored.filter("eligible").count()
    return draw(scored, percent * n // 100).select("doc_id", "n_features", "weight", "score", "rank")
