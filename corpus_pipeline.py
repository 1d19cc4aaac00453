"""A corpus through four stages: toxic documents go, one document of each near-duplicate group stays, personal data is masked, the rest is packed."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geomart.llm import minhash, packing, pii, toxicity
from geomart.llm.common import Bitmap, cut, fresh


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below 0.5 by a model of the labelled ones. Null and empty texts score as a text without words; repeated rows all stay or all go; an empty table gives an empty one."""
    return toxicity.without_toxic(docs, toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies (similarity 0.8 or more); rows that repeat both doc_id and text stay once.

    Documents without words and those with a null text stay. Texts are shuffled only of ids that go or occur several times.
    """
    found = minhash.near_duplicates(docs, percent=80).groupBy("doc_id").agg(F.count("*").alias("n"), F.bool_or("kept").alias("kept"))
    unsure = cut(found.filter("n > 1 or not kept"), "unsure")
    passing = Bitmap(unsure, ["doc_id"], unsure.count())
    own_id, key, other = fresh(docs, "_id", "_key", "_gone")
    named = docs.withColumn(own_id, F.col("doc_id").cast("long"))
    again = passing.split(named, [own_id], True).withColumn(key, F.md5(F.encode("text", "UTF-8")))
    gone = unsure.filter("not kept").select(F.col("doc_id").alias(other))
    stay = again.join(gone, F.col(own_id).eqNullSafe(F.col(other)), "left_anti").dropDuplicates([own_id, key])
    return passing.split(named, [own_id], False).select(docs.columns).unionByName(stay.select(docs.columns))


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data in the text masked at its places. Null texts stay null, and every row stays."""
    return pii.redact(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of at most 2048 ids. A null text counts as empty: one piece of length 1."""
    return packing.pack(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("minhash_near_duplicates", drop_near_copies),
    ("pii", mask_personal_data),
    ("packing", pack_sequences),
]
#: The first stage is a trained model, so no SQL gives these rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each stage's rows are written as Parquet and read again by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
