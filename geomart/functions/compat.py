"""Data-frame semantics the analyses rely on, as Spark columns: null handling, ranks, scores, rounding."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def require_columns(df: DataFrame, names: list[str], what: str = "table") -> DataFrame:
    """df, if it has all names; raises from the schema alone, without a job."""
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ValueError(f"{what} lacks columns: {', '.join(missing)}")
    return df


def drop_null_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose keys are all set: a group-by that ignores null keys."""
    return df.dropna(subset=list(keys))


def null_safe_join(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join in which null keys match each other; key columns come once."""
    r = right.select(*[F.col(k).alias(f"_r_{k}") if k in keys else F.col(k) for k in right.columns])
    on = reduce(lambda a, b: a & b, [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys])
    out = left.join(r, on, how)
    if how in ("left_semi", "left_anti"):
        return out
    return out.select(*[F.coalesce(left[k], r[f"_r_{k}"]).alias(k) for k in keys], *[left[c] for c in left.columns if c not in keys], *[r[c] for c in right.columns if c not in keys])


def outer_fold(frames: list[DataFrame], keys: list[str]) -> DataFrame:
    """N-way full outer join on keys (JOIN-4)."""
    return reduce(lambda a, b: a.join(b, keys, "full"), frames)


def sum0(c: Column | str) -> Column:
    """Sum that is 0 where all values are null."""
    return F.coalesce(F.sum(c), F.lit(0))


def row_sum0(*cols: str) -> Column:
    """Sum over columns, nulls as 0 (PRJ-24)."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c), F.lit(0)) for c in cols])


def row_sum_or_null(*cols: str) -> Column:
    """Sum over columns, null where all are null (PRJ-24)."""
    return F.when(F.coalesce(*[F.col(c) for c in cols]).isNotNull(), row_sum0(*cols))


def zero_to_null(c: Column | str) -> Column:
    return F.nullif(F.col(c) if isinstance(c, str) else c, F.lit(0))


def ratio_or_null(n: Column, d: Column) -> Column:
    return F.try_divide(n, F.nullif(d, F.lit(0)))


def ratio_or_zero(n: Column, d: Column) -> Column:
    return F.when(d > 0, n / d).otherwise(F.lit(0.0))


def pad_left(c: Column, n: int) -> Column:
    """Zero-padding that never cuts (lpad does)."""
    return F.when(F.length(c) >= n, c).otherwise(F.lpad(c, n, "0"))


def half_even(c: Column, digits: int = 0) -> Column:
    return F.bround(c, digits)


def unique_or_raise(df: DataFrame, *keys: str) -> DataFrame:
    """df with a check, when it runs, that keys are unique (SET-7)."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return df.withColumn("_n", n).filter(F.when(F.col("_n") > 1, F.raise_error(F.lit(f"duplicate key: {', '.join(keys)}")).cast("boolean")).otherwise(F.lit(True))).drop("_n")


def share(c: str, *by: str) -> Column:
    """Part of the partition's sum; 0 where the sum is not positive (WIN-7, PRJ-20)."""
    total = F.sum(c).over(Window.partitionBy(*by))
    return ratio_or_zero(F.col(c).cast("double"), total.cast("double"))


def zscore0(c: str, *by: str) -> Column:
    """Population z-score within the partition; 0 where it has no spread (WIN-8)."""
    w = Window.partitionBy(*by)
    mean, spread = F.avg(c).over(w), F.stddev_pop(c).over(w)
    return F.when(spread > 0, (F.col(c) - mean) / spread).otherwise(F.lit(0.0))


def average_rank_percent(c: str, *by: str, constant: float | None = 50.0) -> Column:
    """Average-rank percentile times 100 of a non-null column; a constant partition gets `constant` if given (WIN-9, WIN-10)."""
    part = Window.partitionBy(*by)
    ties = F.count("*").over(Window.partitionBy(*by, c))
    n = F.count("*").over(part)
    value = (F.rank().over(part.orderBy(c)) + (ties - 1) / 2) / n * 100
    return value if constant is None else F.when(F.min(c).over(part) == F.max(c).over(part), F.lit(constant)).otherwise(value)


def percentile_score(df: DataFrame, c: str, out: str, *by: str) -> DataFrame:
    """df with the average-rank percentile of c, nulls counting as 0 (WIN-9)."""
    return df.withColumn("_x", F.coalesce(F.col(c).cast("double"), F.lit(0.0))).withColumn(out, average_rank_percent("_x", *by)).drop("_x")


def entropy(df: DataFrame, by: list[str], amount: str, out: str = "entropy") -> DataFrame:
    """Shannon entropy (natural logarithm) of the positive amounts of each group over the group's whole sum; 0 without any (AGG-9)."""
    total = df.groupBy(*by).agg(F.sum(amount).cast("double").alias("_t"))
    p = F.col(amount).cast("double") / F.col("_t")
    return df.join(total, by).groupBy(*by).agg(F.coalesce(-F.sum(F.when((F.col(amount) > 0) & (F.col("_t") > 0), p * F.log(p))), F.lit(0.0)).alias(out))


def weighted_median_lower(df: DataFrame, value: str, weight: str, by: list[str] | None = None, bins: int = 1024) -> DataFrame:
    """The least value whose running weight reaches half of the total (AGG-8, WIN-13).

    Equal values are summed first and put into `bins` equal ranges of the group's values. A window over the ranges, a
    bounded number for each group, tells the one in which the half is reached; only that one's values are then sorted.
    """
    by = by or []
    d = df.filter(F.col(value).isNotNull() & (F.col(weight) > 0)).groupBy(*by, value).agg(F.sum(weight).alias("_w"))
    ends = d.groupBy(*by).agg(F.min(F.col(value).cast("double")).alias("_lo"), F.max(F.col(value).cast("double")).alias("_hi"))
    d = null_safe_join(d, ends, by) if by else d.crossJoin(F.broadcast(ends))  # without keys ends is one row
    place = F.try_divide(F.col(value).cast("double") - F.col("_lo"), F.col("_hi") - F.col("_lo"))
    d = d.withColumn("_bin", F.coalesce(F.floor(place * bins), F.lit(0)))
    group = [*by] if by else [F.lit(0)]
    sums = d.groupBy(*by, "_bin").agg(F.sum("_w").alias("_sum"))
    w = Window.partitionBy(*group)
    run = F.sum("_sum").over(w.orderBy("_bin").rowsBetween(Window.unboundedPreceding, 0))
    sums = sums.withColumn("_run", run).withColumn("_total", F.sum("_sum").over(w))
    half = sums.filter((2 * F.col("_run") >= F.col("_total")) & (2 * (F.col("_run") - F.col("_sum")) < F.col("_total"))).select(*by, "_bin", (F.col("_run") - F.col("_sum")).alias("_before"), "_total")
    near = null_safe_join(d, half, [*by, "_bin"])
    inside = F.sum("_w").over(w.orderBy(value).rowsBetween(Window.unboundedPreceding, 0))
    return near.withColumn("_run", F.col("_before") + inside).filter(2 * F.col("_run") >= F.col("_total")).groupBy(*by).agg(F.min(value).alias("weighted_median"))


def exact_quantile(df: DataFrame, value: str, q: float, by: list[str] | None = None, out: str = "quantile", accuracy: int = 100_000) -> DataFrame:
    """by, `out`: the interpolated q-quantile of the values that are there, for groups of any size.

    A sketch, whose ranks are off by n / accuracy at most, bounds the two values between which the quantile lies; groups
    of up to 10 x accuracy rows, where such bounds could be less than two ranks apart, take all values. Smaller values are only counted, the ones between the bounds are sorted: a
    ten-thousandth of a large group. A group without values has none.
    """
    by = by or []
    known = df.filter(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias("_v"))
    near = lambda p: F.percentile_approx("_v", F.lit(min(1.0, max(0.0, p))), accuracy)
    few = F.count("*") <= 10 * accuracy
    ends = known.groupBy(*by).agg(F.count("*").alias("_n"), F.when(few, F.min("_v")).otherwise(near(q - 5 / accuracy)).alias("_lo"), F.when(few, F.max("_v")).otherwise(near(q + 5 / accuracy)).alias("_hi"))
    d = known.groupBy(*by, "_v").agg(F.count("*").alias("_c"))
    d = null_safe_join(d, ends, by) if by else d.crossJoin(F.broadcast(ends))  # without keys ends is one row
    below = d.groupBy(*by).agg(F.sum(F.when(F.col("_v") < F.col("_lo"), F.col("_c")).otherwise(0)).alias("_below"))
    inside = d.filter(F.col("_v").between(F.col("_lo"), F.col("_hi")))
    inside = null_safe_join(inside, below, by) if by else inside.crossJoin(F.broadcast(below))
    w = Window.partitionBy(*(by or [F.lit(0)])).orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    run = inside.withColumn("_to", F.col("_below") + F.sum("_c").over(w)).withColumn("_at", (F.col("_n") - 1) * F.lit(q))
    holds = lambda rank: (F.col("_to") > rank) & (F.col("_to") - F.col("_c") <= rank)  # noqa: E731  counting from 0
    g = run.groupBy(*by).agg(F.first("_at").alias("_at"), F.max(F.when(holds(F.floor("_at")), F.col("_v"))).alias("_a"), F.max(F.when(holds(F.ceil("_at")), F.col("_v"))).alias("_b"))
    return g.select(*by, (F.col("_a") + (F.col("_b") - F.col("_a")) * (F.col("_at") - F.floor("_at"))).alias(out))


def top_k(df: DataFrame, k: int, by: list[str], order: list[Column], rank: str = "place") -> DataFrame:
    """The first k rows of each group, numbered from 1 (TOP-1, WIN-12)."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order)).cast("long")).filter(F.col(rank) <= k)


def first_of(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """One row per key, the first in order (WIN-14, WIN-15, WIN-16)."""
    return top_k(df, 1, by, order, "_place").drop("_place")


def ordered_concat(name: str, rank: str, separator: str = " · ") -> Column:
    """Aggregate: names joined in rank order (AGG-14)."""
    return F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(rank, name))), lambda x: x[name]), separator)


def set_concat(name: str | Column, separator: str = "|") -> Column:
    """Aggregate: distinct values joined in sorted order (AGG-15)."""
    return F.array_join(F.array_sort(F.collect_set(name)), separator)


def arg_max_name(names: list[str], labels: list[str] | None = None) -> Column:
    """Label of the greatest of several columns, nulls last, the first of equals (PRJ-27)."""
    items = F.array(*[F.struct(F.coalesce(F.col(c).cast("double"), F.lit(float("-inf"))).alias("v"), F.lit(-i).alias("i"), F.lit(label).alias("label")) for i, (c, label) in enumerate(zip(names, labels or names))])
    return F.array_max(items)["label"]


def arg_max_from_middle(names: list[str], labels: list[str], middle: float = 0.5, none: str = "none") -> Column:
    """Label of the column farthest from the middle, nulls ignored; `none` where all are null (PRJ-28)."""
    far = [F.abs(F.col(c).cast("double") - middle) for c in names]
    items = F.array(*[F.when(v.isNotNull(), F.struct(v.alias("v"), F.lit(-i).alias("i"), F.lit(label).alias("label"))) for i, (v, label) in enumerate(zip(far, labels))])
    return F.coalesce(F.array_max(items)["label"], F.lit(none))


def dense_grid(*dimensions: DataFrame) -> DataFrame:
    """Every combination of the rows of small dimension tables (JOIN-8): quarters, entities and purposes, never facts."""
    return reduce(lambda a, b: a.crossJoin(b), [d.distinct() for d in dimensions])


def persistence_summary(df: DataFrame, by: list[str], gap: str) -> DataFrame:
    """Quarters that agree with the sign of the mean gap, and the gap's coefficient of variation (AGG-17)."""
    mean = df.filter(F.col(gap).isNotNull()).groupBy(*by).agg(F.avg(gap).alias("_m"), F.stddev_pop(gap).alias("_s"))
    sign = F.when(F.col("_m") >= 0, 1).otherwise(-1)
    same = df.join(mean, by).groupBy(*by).agg(F.count_if(F.col(gap) * sign > 0).alias("same_sign_quarters"), F.first(F.when(F.col("_m") != 0, F.col("_s") / F.abs("_m"))).alias("gap_cv"))
    return df.select(*by).distinct().join(same, by, "left").fillna(0, ["same_sign_quarters"])


def regression_scores(df: DataFrame, y: str, p: str, by: list[str] | None = None) -> DataFrame:
    """rows, rmse, mae and r2 of predictions, per group or pooled; r2 is null where y has no spread (AGG-20)."""
    e = F.col(y) - F.col(p)
    sst = F.var_pop(y) * F.count(y)
    return df.filter(F.col(y).isNotNull() & F.col(p).isNotNull()).groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), F.when(F.var_pop(y) > 0, 1 - F.sum(e * e) / sst).alias("r2"))
