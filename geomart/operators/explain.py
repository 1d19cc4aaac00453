"""Explanations of gaps from conversion indexes, shares and notes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.compat import arg_max_name


def purpose_mix(sales: DataFrame, by: list[str], purpose: str, amount: str) -> DataFrame:
    """Purpose of the largest share of each group and that share; ties by name."""
    s = sales.groupBy(*by, purpose).agg(F.sum(amount).cast("double").alias("_a"))
    top = F.max_by(F.col(purpose), F.struct("_a", purpose))
    return s.groupBy(*by).agg(top.alias("dominant_purpose"), F.try_divide(F.max("_a"), F.nullif(F.sum("_a"), F.lit(0.0))).alias("dominant_share"))


def peak_labels(df: DataFrame, prefix: str, labels: list[str], out: str) -> DataFrame:
    """df with the label whose conversion index `prefix_label_conversion_index` is greatest (PRJ-27)."""
    return df.withColumn(out, arg_max_name([f"{prefix}_{x}_conversion_index" for x in labels], labels))


def gap_text(ratio: Column, kind: Column, purpose: Column, age: Column, hours: Column, note: Column, warning: Column, above: str = "목적소비형") -> Column:
    """One sentence each on level, mix and concentration, a place's note and a warning where there are any (PRJ-29)."""
    level = F.format_string("유동인구와 점포 수로 기대한 값의 평균 %.2f배로, %s 수준이다.", ratio, F.when(kind == above, "기대보다 높은").otherwise("기대보다 낮은"))
    mix = F.format_string("매출에서는 %s의 비중이 가장 크고, 유동에 견준 소비는 %s, %s에 가장 몰린다.", purpose, age, hours)
    hold = F.when(F.coalesce(warning, F.lit("")) != "", F.concat(warning, F.lit(": 해석을 보류한다.")))
    return F.concat_ws(" ", level, mix, F.nullif(note, F.lit("")), F.lit("자료에서 나온 가설이며 인과를 확인한 것은 아니다."), hold)


def with_notes(df: DataFrame, notes: DataFrame, key: str, note: str = "note") -> DataFrame:
    """df with the note of its place, from a small table (PRJ-30)."""
    return df.join(notes.select(key, note), key, "left").fillna("", [note])


def facility_sums(df: DataFrame, facilities: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """df with sums of the facility columns that are there, 0 where none (AGG-26)."""
    have = [n for n in names if n in facilities.columns]
    sums = facilities.groupBy(*keys).agg(*[F.sum(F.coalesce(F.col(n).try_cast("double"), F.lit(0.0))).alias(n) for n in have]) if have else None
    return df if sums is None else df.join(sums, keys, "left").fillna(0.0, have)


def paired_bootstrap(df: DataFrame, a: str, b: str, rounds: int = 1000, level: float = 0.95, seed: int = 7) -> DataFrame:
    """low, high, mean_difference: mean difference of paired scores and its bootstrap interval, by Poisson weights (PLN-1).

    Each row gets `rounds` weights from a hash of its `id`, so the result doesn't depend on partitions. A task sums its
    rows' weights and weighted differences and hands on one row a round. Pairs with a null are left out.
    """
    cuts = np.cumsum(np.exp(-1.0) / np.cumprod([1.0, *range(1, 12)]))  # distribution function of Poisson(1)
    d = df.select(F.xxhash64("id", F.lit(seed)).alias("h"), (F.col(a) - F.col(b)).cast("double").alias("d")).filter("d is not null")

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        steps = np.arange(1, rounds + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        n, total = np.zeros(rounds), np.zeros(rounds)
        for batch in batches:
            h, values = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            for at in range(0, len(h), 1024):
                z = h[at : at + 1024, None] + steps
                z = (z ^ (z >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
                z = (z ^ (z >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
                w = np.searchsorted(cuts, ((z ^ (z >> np.uint64(31))) >> np.uint64(11)) / 2.0**53, "right").astype(float)
                n += w.sum(0)
                total += values[at : at + 1024] @ w
        yield pa.RecordBatch.from_arrays([pa.array(range(rounds), pa.int32()), pa.array(n), pa.array(total)], names=["k", "n", "t"])

    means = d.mapInArrow(sums, "k int, n double, t double").groupBy("k").agg(F.try_divide(F.sum("t"), F.nullif(F.sum("n"), F.lit(0.0))).alias("m"))
    tail = (1 - level) / 2
    return means.agg(F.percentile("m", F.lit(tail)).alias("low"), F.percentile("m", F.lit(1 - tail)).alias("high")).crossJoin(d.agg(F.avg("d").alias("mean_difference")))  # `rounds` rows
