"""Average ranks, percentile transforms fitted on training rows, and rank combinations.

Ties are combined before any ordering: sums run over distinct values with their counts, never
over repeated ones, so a value that half of all rows share costs one row. They run by ranges of
values (``ordered``), so a key that half of all rows share is spread over tasks too.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ordered import medians, null_safe, ranged, running


def value_ranks(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """One row per key and distinct non-null value: n_equal, rank (average), n."""
    return _ranked(df, keys, value).drop("distinct")


def _ranked(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("n_equal")).withColumn("distinct", F.lit(1))
    out = running(counted, keys, value, ["n_equal", "distinct"])
    rank = F.col("n_equal_before") + (F.col("n_equal") + 1) / 2
    return out.select(*keys, value, "n_equal", rank.alias("rank"), F.col("n_equal_all").alias("n"), F.col("distinct_all").alias("distinct"))


def average_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank") -> DataFrame:
    """``df`` with the average rank of value within keys; null values have none."""
    r = value_ranks(df, keys, value).select(*keys, value, F.col("rank").alias(name))
    return df.join(r, [*keys, value], "left")


def percent_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "p") -> DataFrame:
    """(average rank - 1) / (n - 1) within keys; not Spark's percent_rank, which takes the
    least rank of ties."""
    r = value_ranks(df, keys, value).select(*keys, value, F.try_divide(F.col("rank") - 1, F.col("n") - 1).alias(name))
    return df.join(r, [*keys, value], "left")


def rank_mean(df: DataFrame, a: str, b: str, keys: Sequence[str] = (), name: str = "s") -> DataFrame:
    """Equal-weight mean of the average ranks of two scores, on [0, 1]."""
    out = average_rank(average_rank(df, keys, a, "_ra"), keys, b, "_rb")
    if keys:
        out = out.withColumn("_n", F.count("*").over(Window.partitionBy(*keys)))
    else:  # one row, so no window over all
        out = out.crossJoin(F.broadcast(df.agg(F.count("*").alias("_n"))))
    out = out.withColumn(name, F.try_divide(0.5 * F.col("_ra") + 0.5 * F.col("_rb") - 1, F.col("_n") - 1))
    return out.select(*[F.col(f"`{c}`") for c in df.columns], name)


def fit_knots(train: DataFrame, keys: Sequence[str] = ("block", "key"), value: str = "value") -> tuple[DataFrame, DataFrame]:
    """(knots: keys, x, p; medians: keys, med) of the training rows alone.

    x are the distinct values, p their average-rank percentile; a key with one distinct
    value maps to 0.5.
    """
    r = _ranked(train, keys, value)
    p = F.when(F.col("distinct") > 1, (F.col("rank") - 1) / (F.col("n") - 1)).otherwise(0.5)
    return r.select(*keys, F.col(value).alias("x"), p.alias("p")), medians(train, keys, value, "med")


def apply_knots(
    df: DataFrame, knots: DataFrame, fits: DataFrame, keys: Sequence[str] = ("block", "key"), value: str = "value", name: str = "p"
) -> DataFrame:
    """``df`` with its value's percentile by the knots and medians (``fits``) of training rows: a
    missing value takes the training median, one between knots is interpolated, one outside them takes the nearest knot's.

    Distinct values and knots are merged in one ordering per key, in ranges: a value sees the
    knots before and after it in its range, and else the nearest of the ranges around it; no
    range join.
    """
    keys = list(keys)
    filled = df.join(fits, keys, "left").withColumn("_x", F.coalesce(value, "med"))
    points = filled.where("_x is not null").select(*keys, F.col("_x").alias("x"), F.lit(None).cast("double").alias("kp")).distinct()
    r, at = ranged(points.union(knots.select(*keys, "x", F.col("p").alias("kp"))), keys, "x"), [*keys, "_range"]
    knot = F.when(F.col("kp").isNotNull(), F.struct("x", "kp"))
    ends = r.groupBy(*at).agg(F.min(knot).alias("_first"), F.max(knot).alias("_last"))
    # Frames that end at the row itself: one up to the last row would be added up anew for each row.
    line, back = (Window.partitionBy(*keys).orderBy(o).rowsBetween(Window.unboundedPreceding, -1) for o in ("_range", F.desc("_range")))
    ends = ends.select(*at, F.max("_last").over(line).alias("_lo"), F.min("_first").over(back).alias("_hi"))
    # A knot at the value itself is among those before it.
    up = Window.partitionBy(*at).orderBy("x", F.col("kp").isNull())
    down = Window.partitionBy(*at).orderBy(F.desc("x"), F.col("kp").isNotNull())
    lo, hi = (F.last(knot, ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0)) for order in (up, down))
    seen = null_safe(r.withColumns({"lo": lo, "hi": hi}), ends, at).where("kp is null").withColumns({"lo": F.coalesce("lo", "_lo"), "hi": F.coalesce("hi", "_hi")})
    between = F.col("lo.kp") + (F.col("hi.kp") - F.col("lo.kp")) / (F.col("hi.x") - F.col("lo.x")) * (F.col("x") - F.col("lo.x"))
    p = (
        F.when(F.col("lo").isNull(), F.col("hi.kp"))
        .when(F.col("hi").isNull() | (F.col("lo.x") == F.col("x")), F.col("lo.kp"))
        .otherwise(between)
    )
    at = seen.select(*keys, F.col("x").alias("_x"), F.least(F.greatest(p, F.lit(0.0)), F.lit(1.0)).alias(name))
    return filled.join(at, [*keys, "_x"], "left").drop("_x", "med")


def two_group_counts(df: DataFrame, keys: Sequence[str], value: str, positive: Column, weight: Column | None = None) -> DataFrame:
    """Per key and distinct value: wp and wn, the weight of positive and other rows, and
    wn_below, that of the others below it. A key's missing values are a row that weighs nothing,
    so that a key without values stays."""
    w = F.when(F.col(value).isNotNull(), F.lit(1.0) if weight is None else weight.cast("double")).otherwise(0.0)
    sums = (
        df.where(positive.isNotNull())
        .groupBy(*keys, value)
        .agg(F.sum(F.when(positive, w).otherwise(0.0)).alias("wp"), F.sum(F.when(positive, 0.0).otherwise(w)).alias("wn"))
    )
    return running(sums, keys, value, ["wn"]).withColumn("wn_below", F.col("wn_before").cast("double")).drop("wn_before", "wn_all")


def auc(df: DataFrame, keys: Sequence[str], value: str, positive: Column, weight: Column | None = None, name: str = "auc") -> DataFrame:
    """Chance that a positive row's value is above another's, ties counting half; rows may
    bear weights. Sums over distinct values, no pairs."""
    c = two_group_counts(df, keys, value, positive, weight)
    wins = F.sum(F.col("wp") * (F.col("wn_below") + F.col("wn") / 2))
    return c.groupBy(*keys).agg(F.try_divide(wins, F.sum("wp") * F.sum("wn")).alias(name))
