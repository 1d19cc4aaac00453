"""Event streams: hourly counts with late data, and gaps between events of a key."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def file_stream(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def hourly_counts(events: DataFrame, ts: str, by: list[str], late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts by window and key; rows later than the watermark allows are left out."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, width), *by).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *by, "n")


def gaps(events: DataFrame, key: str, ts: str) -> DataFrame:
    """key, at, gap_seconds to the event before, which may have come in an earlier batch; events of one batch are put in order."""

    def step(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        last = state.get[0] if state.exists else None
        times = pd.concat([p[ts] for p in parts]).sort_values()
        rows = []
        for t in times:
            now = t.timestamp()
            if last is not None and now >= last:
                rows.append((k[0], t, now - last))
            last = now if last is None else max(last, now)
        state.update((last,))
        yield pd.DataFrame(rows, columns=["key", "at", "gap_seconds"])

    return events.select(key, ts).groupBy(key).applyInPandasWithState(step, "key long, at timestamp, gap_seconds double", "last double", "append", GroupStateTimeout.NoTimeout)
