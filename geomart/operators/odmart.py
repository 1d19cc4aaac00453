"""Origin-destination flows between areas."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.codes import demographic_columns, trip_purpose
from ..functions.compat import first_of, row_sum0, row_sum_or_null
from .spatial import first_polygon


def with_derived(df: DataFrame) -> DataFrame:
    """Total movement, minutes, metres, purpose name and sums by sex and age band (PRJ-32)."""
    bands = demographic_columns(df.columns)
    names = [c for cols in bands.values() for c in cols]
    out = df.withColumn("movement_total", row_sum_or_null(*names) if names else F.lit(None).cast("double"))
    out = out.withColumn("move_time_min", F.col("MOVE_TIME").try_cast("double")).withColumn("move_distance_m", F.col("MOVE_DIST").try_cast("double")).withColumn("purpose_name", trip_purpose(F.col("MOVE_PURPOSE")))
    every = [(s, b) for s in ("남성", "여성") for b in ("0대", "10대", "20대", "30대", "40대", "50대", "60대이상")]
    return out.withColumns({f"{s}_{b}_이동량": row_sum0(*bands[s, b]) if (s, b) in bands else F.lit(0.0) for s, b in every})


def distinct_cells(df: DataFrame) -> DataFrame:
    """cell_id, x, y of both ends, one place for each cell (OD-1, SET-1, WIN-16)."""
    ends = [df.select(F.col(f"{e}_CELL_ID").alias("cell_id"), F.col(f"{e}_CELL_X").alias("x"), F.col(f"{e}_CELL_Y").alias("y"), F.lit(k).alias("_k")) for k, e in enumerate("OD")]
    return first_of(ends[0].unionByName(ends[1]), ["cell_id"], [F.col("_k"), F.col("x"), F.col("y")]).drop("_k")


def crosswalk(cells: DataFrame, edges: DataFrame, area: str, order: DataFrame, size: float | None = None) -> DataFrame:
    """cell_id, x, y, the area that holds the cell's place (the first by order: area, place), and status: matched, outside, or no_place (OD-1)."""
    hit = first_polygon(cells.filter("x is not null and y is not null"), edges, "cell_id", area, order, boundary=True, size=size)
    status = F.when(F.col("x").isNull() | F.col("y").isNull(), "no_place").when(F.col(area).isNull(), "outside").otherwise("matched")
    return cells.join(hit, "cell_id", "left").withColumn("status", status)


def od_mart(df: DataFrame, keys: list[str], total: str, measures: dict[str, str]) -> DataFrame:
    """Sum of movement and movement-weighted means by key; null keys are groups, a null measure weighs as 0 but its movement counts (OD-2, AGG-6, AGG-7)."""
    mean = lambda c: F.try_divide(F.sum(F.coalesce(F.col(c), F.lit(0)) * F.col(total)).cast("double"), F.nullif(F.sum(total), F.lit(0)).cast("double"))
    return df.groupBy(*keys).agg(F.sum(total).alias("movement_total"), F.count("*").alias("rows"), *[mean(c).alias(n) for n, c in measures.items()])


def short_trips(mart: DataFrame, minutes: str, most: float = 30.0) -> DataFrame:
    return mart.filter(F.col(minutes) <= most)


def match_rates(df: DataFrame, origin: str, destination: str) -> DataFrame:
    """Rows, and rows with either or both ends matched (AGG-18)."""
    o, d = F.col(origin).isNotNull(), F.col(destination).isNotNull()
    return df.agg(F.count("*").alias("rows"), F.count_if(o).alias("origin_matched"), F.count_if(d).alias("destination_matched"), F.count_if(o & d).alias("both_matched"), F.try_divide(F.count_if(o & d), F.count("*")).alias("both_ratio"))
