"""Tables on shared storage, running totals and joins that survive hot keys."""

from __future__ import annotations

import tempfile
import uuid
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import IntegerType


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a new folder in local mode; an error on a cluster, whose machines share no temporary folder."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        master = spark.conf.get("spark.master", "")
        if master != "local" and not master.startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="geomart-shared-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def scratch(spark: SparkSession, kind: str) -> str:
    """A new path under the shared folder."""
    return f"{shared_dir(spark)}/geomart/{kind}-{uuid.uuid4().hex}"


def cut(df: DataFrame, kind: str = "table") -> DataFrame:
    """Writes df as Parquet to shared storage and returns a reader of it: the lineage ends there and a lost executor costs nothing."""
    spark = df.sparkSession
    path = scratch(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def bucket_of(cols: list[Column], buckets: int) -> Column:
    return F.pmod(F.xxhash64(*cols), F.lit(buckets)).cast("int")


def running_total(df: DataFrame, by: list[str], order: list[str], value: Column, out: str, buckets: int = 256) -> DataFrame:
    """Adds `out`: the sum of `value` over the rows of the same `by` that come before this one.

    The order is (hash bucket of `order`, `order`). A group of any size is spread over `buckets` windows; only the
    bucket sums, at most buckets per group, meet in one task. Null keys form a group of their own.
    """
    d = df.withColumn("_b", bucket_of([F.col(c) for c in order], buckets)).withColumn("_v", value)
    keys = [*by, "_b"]
    sums = d.groupBy(*keys).agg(F.sum("_v").alias("_s"))
    before = Window.partitionBy(*by).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)], F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    d = d.withColumn("_in", F.coalesce(F.sum("_v").over(inside), F.lit(0)))
    same = reduce(lambda a, b: a & b, [d[k].eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)])
    return d.join(sums, same, "left").withColumn(out, (F.col("_before") + F.col("_in")).cast("long")).drop("_b", "_v", "_s", "_in", "_before", *[f"_k{i}" for i in range(len(keys))])


def join_unique(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner", share: int = 1000, rows: int | None = None) -> DataFrame:
    """left join right on `keys`, where each key stands in at most one row of right; how: inner or left.

    Keys with more than 1/share of left's rows are fewer than `share`, so their rows of right are broadcast and left's
    rows of them stay where they are; all other rows are shuffled. left is read several times: it should lie on storage;
    `rows` is its number of rows, where that is known. Null keys match nothing. With fewer than 5 x share rows no key is
    frequent enough to matter.
    """
    total = left.count() if rows is None else rows
    found = left.dropna(subset=keys)
    frequent = found.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > F.lit(total // share)).select(*keys).collect() if total >= 5 * share else []  # fewer than `share`
    if not frequent:
        return left.join(right, keys, how)
    held = pa.table({k: [r[k] for r in frequent] for k in keys})
    hot = F.broadcast(left.sparkSession.createDataFrame(held, left.select(*keys).schema))
    many = found.join(hot, keys, "left_semi").join(F.broadcast(right.join(hot, keys, "left_semi")), keys, how)
    out = found.join(hot, keys, "left_anti").join(right, keys, how).unionByName(many)
    if how == "left":
        more = [f for f in right.schema.fields if f.name not in keys]
        none = left.filter(reduce(lambda a, b: a | b, [F.col(k).isNull() for k in keys])).select(*left.columns, *[F.lit(None).cast(f.dataType).alias(f.name) for f in more])
        out = out.select(*none.columns).unionByName(none)
    return out


def join_dealt(big: DataFrame, small: DataFrame, keys: list[str], share: int = 1000) -> DataFrame:
    """big inner join small on `keys`, where many rows of both may have the same key.

    The rows of a key with more than 1/share of big's rows are dealt to blocks of about that many, and small's rows of the
    key repeated for each block. Such keys are fewer than `share` and have fewer than 2 x share blocks in all. big is read
    several times: it should lie on storage or be cheap. With fewer than 5 x share rows no key is frequent enough to matter.
    """
    total = big.count()
    per = -(-total // share)
    frequent = big.groupBy(*keys).agg(F.count("*").alias("_n")).filter(F.col("_n") > per).select(*keys, F.ceil(F.col("_n") / per).cast("int").alias("_blocks")).collect() if total >= 5 * share else []  # fewer than `share`
    if not frequent:
        return big.join(small, keys)
    names = [*keys, "_blocks"]
    hot = big.sparkSession.createDataFrame([tuple(r[k] for k in names) for r in frequent], big.select(*keys).schema.add("_blocks", IntegerType()))
    blocks = F.coalesce("_blocks", F.lit(1))
    dealt = big.join(F.broadcast(hot), keys, "left").withColumn("_block", F.pmod(F.xxhash64(*big.columns), blocks).cast("int")).drop("_blocks")
    repeated = small.join(F.broadcast(hot), keys, "left").withColumn("_block", F.explode(F.sequence(F.lit(0), blocks - 1))).drop("_blocks")
    return dealt.join(repeated, [*keys, "_block"]).drop("_block")
