"""Purpose panels: dense grid, shares, percentiles, scores, ranks; and share profiles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.compat import dense_grid, percentile_score, ratio_or_null, share


def purpose_panel(facts: DataFrame, keys: tuple[str, str, str], measures: dict[str, Column], purposes: DataFrame | None = None) -> DataFrame:
    """Sums of measures on the dense grid of quarter, entity and purpose, 0 where nothing is (JOIN-8, AGG-24)."""
    quarter, entity, purpose = keys
    sums = facts.groupBy(*keys).agg(*[c.alias(n) for n, c in measures.items()])
    grid = dense_grid(sums.select(quarter), sums.select(entity), purposes if purposes is not None else sums.select(purpose))
    return grid.join(sums, list(keys), "left").fillna(0, list(measures))


def scored_panel(panel: DataFrame, keys: tuple[str, str, str], supply: dict[str, float], signal: dict[str, float], path: tuple[float, float] = (0.7, 0.3)) -> DataFrame:
    """Percentiles of each measure within quarter and purpose, weighted into supply and sales signals, the signal of the quarter before, score and rank (SCR-1 to SCR-3, WIN-6, WIN-9, WIN-11).

    The first quarter of a dense panel has no earlier signal, so neither score nor rank.
    """
    quarter, entity, purpose = keys
    out = panel
    for m in dict.fromkeys([*supply, *signal]):
        out = percentile_score(out, m, f"{m}_pct", quarter, purpose)
    weigh = lambda weights: reduce(lambda a, b: a + b, [w * F.col(f"{m}_pct") for m, w in weights.items()])
    out = out.withColumn("purpose_supply_score", weigh(supply)).withColumn("sales_signal", weigh(signal))
    out = out.withColumn("lagged_sales_signal", F.lag("sales_signal").over(Window.partitionBy(entity, purpose).orderBy(quarter)))
    out = out.withColumn("path_score", path[0] * F.col("purpose_supply_score") + path[1] * F.col("lagged_sales_signal"))
    order = Window.partitionBy(quarter, purpose).orderBy(F.col("path_score").desc_nulls_last())
    return out.withColumn("purpose_rank", F.when(F.col("path_score").isNotNull(), F.rank().over(order).cast("long")))


def purpose_ranking(scored: DataFrame, keys: tuple[str, str, str], tie: str) -> DataFrame:
    """Rows with a score, ranked by row number with `tie` as the last key (SCR-4, WIN-12)."""
    quarter, _, purpose = keys
    order = Window.partitionBy(quarter, purpose).orderBy(F.desc("path_score"), tie)
    return scored.filter("path_score is not null").withColumn("purpose_rank", F.row_number().over(order).cast("long"))


def conversion_index(df: DataFrame, by: list[str], label: str, sales: str, flow: str, digits: int = 6) -> DataFrame:
    """Share of sales over share of flow by label within each group; null without flow (AGG-23)."""
    s = df.groupBy(*by, label).agg(F.sum(sales).cast("double").alias("_s"), F.sum(flow).cast("double").alias("_f"))
    total = Window.partitionBy(*by)
    s = s.withColumn("sales_share", ratio_or_null(F.col("_s"), F.sum("_s").over(total))).withColumn("flow_share", ratio_or_null(F.col("_f"), F.sum("_f").over(total)))
    return s.withColumn("conversion_index", F.when(F.col("flow_share") > 0, F.round(F.col("sales_share") / F.col("flow_share"), digits))).drop("_s", "_f")


def share_pivot(df: DataFrame, by: list[str], label: str, amount: str, values: list[str], prefix: str = "share_") -> DataFrame:
    """Shares of a group's amount by label, one column a value, 0 where missing (AGG-12)."""
    sums = df.groupBy(*by, label).agg(F.sum(amount).alias("_a"))
    sums = sums.withColumn("_a", share("_a", *by))
    wide = sums.groupBy(*by).pivot(label, values).agg(F.sum("_a")).fillna(0.0, values)
    return wide.withColumnsRenamed({v: prefix + v for v in values})


def asof_latest(left: DataFrame, right: DataFrame, by: list[str], at: str, value: str, strict: bool = True) -> DataFrame:
    """left with the latest value of right at an earlier time of the same key, one sort for both (JOIN-19)."""
    both = left.select(*by, F.col(at).alias("_t"), F.struct(*[F.col(c) for c in left.columns]).alias("_row"), F.lit(None).cast(right.schema[value].dataType).alias("_v"), F.lit(1 if not strict else 0).alias("_o"))
    both = both.unionByName(right.select(*by, F.col(at).alias("_t"), F.col(value).alias("_v"), F.lit(0 if not strict else 1).alias("_o")), allowMissingColumns=True)
    w = Window.partitionBy(*by).orderBy("_t", "_o").rowsBetween(Window.unboundedPreceding, -1)
    return both.withColumn("_last", F.last("_v", ignorenulls=True).over(w)).filter("_row is not null").select("_row.*", F.col("_last").alias(f"latest_{value}"))
