"""Token counts as delta-maintained rollups.

A store is a folder of batches. Committing a batch compares its changes with the documents' current counts and writes
signed rows: -1 for a count that no longer holds, +1 for one that now does. Their sums by source, language and tokenizer
version are the batch's delta; totals are the sum of the deltas and never reread the corpus. A batch's files are written
first and its commit mark last, so a batch that broke off counts for nothing and can be written again, and a batch that
is committed already is left as it is.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

KEYS = ["source", "lang", "tokenizer_version"]
LEDGER = "doc_id long, source string, lang string, tokenizer_version string, n_tokens long, sign int, batch string"
DELTA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_added long, n_removed long, batch string"


class TokenRollup:
    """Totals of documents and tokens by source, lang and tokenizer_version under `folder`."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _read(self, part: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.folder}/{part}")
        except AnalysisException:  # nothing is there before the first commit
            return self.spark.createDataFrame([], schema)

    def _committed(self, part: str, schema: str) -> DataFrame:
        return self._read(part, schema).join(self._read("commits", "batch string").distinct(), "batch", "left_semi")

    def batches(self) -> set[str]:
        return {row["batch"] for row in self._read("commits", "batch string").distinct().collect()}

    def current(self, ids: DataFrame | None = None) -> DataFrame:
        """doc_id, source, lang, tokenizer_version, n_tokens that hold after the committed batches, of the documents in ids (doc_id) or of all."""
        ledger = self._committed("ledger", LEDGER)
        if ids is not None:  # only a batch's own documents are grouped
            asked = ids.select(F.col("doc_id").alias("_id")).distinct()
            ledger = ledger.join(asked, F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
        rows = ledger.groupBy("doc_id", *KEYS, "n_tokens").agg(F.sum("sign").alias("n"))
        return rows.filter("n > 0").drop("n")

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Applies changes: doc_id, op (upsert or delete), source, lang, tokenizer_version, n_tokens. False if `batch` is committed already.

        A document has one count per tokenizer version; in an upsert null is a version like others. An upsert replaces it;
        a delete takes it away, or every count of the document where tokenizer_version is null; deleting what isn't there does nothing. Where a batch has several
        upserts of a document and version, the one with the most tokens (then the smallest source and lang) holds; an
        upsert wins over a delete in the same batch. Nulls in doc_id, source and lang are values like others; a null
        n_tokens counts as 0.
        """
        if batch in self.batches():
            return False
        new = changes.filter("op = 'upsert'").withColumn("n_tokens", F.coalesce(F.col("n_tokens").cast("long"), F.lit(0).cast("long")))
        new = new.groupBy("doc_id", "tokenizer_version").agg(F.min(F.struct(-F.col("n_tokens"), "source", "lang")).alias("x")).select("doc_id", "x.source", "x.lang", "tokenizer_version", (-F.col("x.col1")).alias("n_tokens"))
        every = (F.col("op") == "delete") & F.col("tokenizer_version").isNull()
        hit = changes.select(F.col("doc_id").alias("_d"), F.col("tokenizer_version").alias("_v"), every.alias("_all")).distinct()
        now = self.current(changes.select("doc_id"))
        gone = now.join(hit, now["doc_id"].eqNullSafe(hit["_d"]) & (hit["_all"] | now["tokenizer_version"].eqNullSafe(hit["_v"])), "left_semi")
        signed = new.withColumn("sign", F.lit(1)).unionByName(gone.withColumn("sign", F.lit(-1)))
        signed.write.mode("overwrite").parquet(f"{self.folder}/ledger/batch={batch}")
        ledger = self.spark.read.schema(LEDGER.removesuffix(", batch string")).parquet(f"{self.folder}/ledger/batch={batch}")
        by_sign = lambda k: F.sum(F.when(F.col("sign") == k, F.col("n_tokens")).otherwise(0))
        delta = ledger.groupBy(*KEYS).agg(F.sum("sign").alias("n_docs"), F.sum(F.col("sign") * F.col("n_tokens")).alias("n_tokens"), by_sign(1).alias("n_added"), by_sign(-1).alias("n_removed"))
        delta.write.mode("overwrite").parquet(f"{self.folder}/delta/batch={batch}")
        self.spark.range(1).write.mode("overwrite").parquet(f"{self.folder}/commits/batch={batch}")
        return True

    def totals(self) -> DataFrame:
        """source, lang, tokenizer_version, n_docs, n_tokens, n_added, n_removed after the committed batches; a total of 0 documents stays as a row."""
        names = ["n_docs", "n_tokens", "n_added", "n_removed"]
        return self._committed("delta", DELTA).groupBy(*KEYS).agg(*[F.sum(x).alias(x) for x in names])


def bpe_counts(docs: DataFrame, ranks_path: str) -> DataFrame:
    """docs without `text`, with n_tokens: byte-level BPE ids of the whole text, by a rank file; a null or empty text has none."""
    columns = [c for c in docs.columns if c not in ("text", "n_tokens")]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from .tokens import SegmentEncoder

        encoder = SegmentEncoder(ranks_path)
        for batch in batches:
            n = [len(encoder.encode(t)) // 4 if t else 0 for t in (x.as_py() for x in batch.column(0))]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(n, pa.int64())], names=[*columns, "n_tokens"])

    held = docs.select("text", *columns)
    return held.mapInArrow(count, StructType([*held.schema.fields[1:], StructField("n_tokens", LongType())]))
