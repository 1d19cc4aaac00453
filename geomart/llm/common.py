"""Shared pieces of the corpus operators: filters of bounded size, text helpers; tables and joins come from the core."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.tables import bucket_of, cut, join_unique, running_total, scratch, shared_dir

__all__ = ["Bitmap", "bucket_of", "cut", "fresh", "join_unique", "marked", "running_total", "scratch", "shared_dir", "text_or_empty"]

#: Bits of a Bitmap at most: 32 MiB.
MOST_BITS = 1 << 28


def text_or_empty(name: str = "text") -> Column:
    return F.coalesce(F.col(name), F.lit(""))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, each with underscores added until no column of df has it."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def _bits_for(rows: int) -> int:
    return min(MOST_BITS, 1 << max(15, (16 * rows).bit_length()))


def _slot(columns: list[str], bits: int) -> Column:
    return F.pmod(F.xxhash64(*columns), F.lit(bits)).cast("long")


def _bitmap_parts(keys: DataFrame, columns: list[str], bits: int) -> DataFrame:
    """part, held: 4 KiB of the bitmap each."""
    place = _slot(columns, bits) + 1
    return keys.select(place.alias("at")).groupBy(F.bitmap_bucket_number("at").alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("at")).alias("held"))


def marked(df: DataFrame, keys: DataFrame, columns: list[str], rows: int, out: str) -> DataFrame:
    """df and `out`, by a bitmap as Bitmap's but with built-in functions only: true in all rows whose key is in `keys`, seldom in others. The bitmap is broadcast and df not shuffled; `rows` is the number of keys."""
    bits = _bits_for(rows)
    at, part, held = fresh(df, "_at", "_part", "_held")
    parts = F.broadcast(_bitmap_parts(keys, columns, bits).select(F.col("part").alias(part), F.col("held").alias(held)))
    place = df.withColumn(at, _slot(columns, bits) + 1)
    bit = F.bitmap_bit_position(at)
    byte = F.conv(F.hex(F.substring(held, F.shiftright(bit, 3).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return place.join(parts, F.bitmap_bucket_number(at) == F.col(part), "left").withColumn(out, F.coalesce(F.getbit(byte, (bit % 8).cast("int")) == 1, F.lit(False))).select(*df.columns, out)


class Bitmap:
    """A filter of keys: rows whose key is in `keys` always pass, others seldom. It has 16 bits a key, and never more than 32 MiB.

    It only spares rows a shuffle; what passes is joined exactly afterwards.
    """

    def __init__(self, keys: DataFrame, columns: list[str], rows: int):
        self.bits = _bits_for(rows)
        table = np.zeros(self.bits // 8, np.uint8)
        for row in _bitmap_parts(keys, columns, self.bits).toLocalIterator():  # bits / 32768 rows of 4 KiB
            at = (row["part"] - 1) * 4096
            table[at : at + 4096] = np.frombuffer(row["held"], np.uint8)
        self.table = keys.sparkSession.sparkContext.broadcast(table)

    def slot(self, columns: list[str]) -> Column:
        return _slot(columns, self.bits)

    def held(self, slots: pa.Array) -> np.ndarray:
        at = slots.to_numpy(zero_copy_only=False)
        return (self.table.value[at >> 3] >> (at & 7) & 1).astype(bool)

    def split(self, df: DataFrame, columns: list[str], inside: bool) -> DataFrame:
        """The rows of df that pass, or those that don't."""

        def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.select(batch.schema.names[:-1]).filter(pa.array(self.held(batch.column(batch.num_columns - 1)) == inside))

        return df.withColumn(fresh(df, "_slot")[0], self.slot(columns)).mapInArrow(keep, df.schema)
