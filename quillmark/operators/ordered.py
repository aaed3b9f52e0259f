"""Sums along an order and values at given ranks, where no key need fit one task.

Rows are cut into ranges of (keys, value), so a key of very many values spans many ranges.
Sums of the ranges are a small table; sums before a range within its key complete what each
range counts by itself. For a percentile only the ranges that hold the wanted ranks are
ordered at all; nothing is buffered, so memory doesn't depend on the number of rows.

The ranges are written with their numbers, as a second sampling might cut elsewhere.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quillmark.sources.staging import staged

_BEFORE = (Window.unboundedPreceding, -1)


def null_safe(a: DataFrame, b: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """``a`` joined to ``b`` on keys of which null is a value like any."""
    other = b.select(*(F.col(k).alias(f"_j{i}") for i, k in enumerate(keys)), *(c for c in b.columns if c not in keys))
    on = reduce(lambda x, y: x & y, (F.col(k).eqNullSafe(F.col(f"_j{i}")) for i, k in enumerate(keys)))
    return a.join(other, on, how).drop(*(f"_j{i}" for i in range(len(keys))))


def ranged(rows: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """``rows`` with _range, written; equal values of a key share a range, and ranges ascend."""
    return staged(rows.repartitionByRange(*keys, value).withColumn("_range", F.spark_partition_id()), "ranges")


def running(rows: DataFrame, keys: Sequence[str], value: str, sums: Sequence[str]) -> DataFrame:
    """``rows`` (one for each key and value) with, for each of ``sums``, <name>_before, what the
    key's rows of lesser values add up to, and <name>_all, what all of them do."""
    r, at = ranged(rows, keys, value), [*keys, "_range"]
    totals = r.groupBy(*at).agg(*(F.sum(s).alias(s) for s in sums))
    own = Window.partitionBy(*(keys or [F.lit(1)]))
    up = own.orderBy("_range").rowsBetween(*_BEFORE)
    offsets = totals.select(
        *at, *(F.coalesce(F.sum(s).over(up), F.lit(0)).alias(f"_{s}_off") for s in sums), *(F.sum(s).over(own).alias(f"{s}_all") for s in sums)
    )
    inside = Window.partitionBy(*at).orderBy(value).rowsBetween(*_BEFORE)
    out = null_safe(r.withColumns({f"_{s}_in": F.coalesce(F.sum(s).over(inside), F.lit(0)) for s in sums}), offsets, at)
    out = out.withColumns({f"{s}_before": F.col(f"_{s}_off") + F.col(f"_{s}_in") for s in sums})
    return out.drop("_range", *(f"_{s}_{x}" for s in sums for x in ("off", "in")))


def numbered(rows: DataFrame, column: str, name: str) -> DataFrame:
    """``rows`` with their number from 0 in the order of a column without repeats."""
    return running(rows.withColumn(name, F.lit(1)), [], column, [name]).withColumn(name, F.col(f"{name}_before").cast("long")).drop(f"{name}_before", f"{name}_all")


def least_after(rows: DataFrame, place: str, value: str) -> DataFrame:
    """``rows`` with <value>_after, the least ``value`` of the rows whose ``place``, a whole number,
    is greater; null values don't count. Sorted by ranges, each of which passes on one value."""
    r = ranged(rows, [], place)
    later = Window.orderBy(F.desc("_range")).rowsBetween(*_BEFORE)
    beyond = r.groupBy("_range").agg(F.min(value).alias("_least")).select("_range", F.min("_least").over(later).alias("_beyond"))
    inside = Window.partitionBy("_range").orderBy(F.desc(place)).rangeBetween(Window.unboundedPreceding, -1)
    out = r.withColumn("_inside", F.min(value).over(inside)).join(F.broadcast(beyond), "_range")
    return out.withColumn(f"{value}_after", F.least("_inside", "_beyond")).drop("_range", "_inside", "_beyond")


def percentiles(df: DataFrame, keys: Sequence[str], value: str, shares: dict[str, float]) -> DataFrame:
    """Per key: the exact percentiles of the values that are there, by linear interpolation, one
    column for each of ``shares``; null for a key without values."""
    keys = list(keys)
    # A row for each distinct value; that of null has none of the values.
    counted = df.groupBy(*keys, F.col(value).cast("double").alias("_v")).agg(F.count(value).alias("_n"))
    r, at = ranged(counted, keys, "_v"), [*keys, "_range"]
    own = Window.partitionBy(*(keys or [F.lit(1)]))
    spans = r.groupBy(*at).agg(F.sum("_n").alias("_in"))
    spans = spans.select(*at, "_in", F.coalesce(F.sum("_in").over(own.orderBy("_range").rowsBetween(*_BEFORE)), F.lit(0)).alias("_from"), F.sum("_in").over(own).alias("_all"))
    place = {q: F.lit(float(s)) * (F.col("_all") - 1) for q, s in shares.items()}
    ends = [F.struct(F.lit(f"{q}{side}").alias("q"), f(p).cast("long").alias("k")) for q, p in place.items() for side, f in (("<", F.floor), (">", F.ceil))]
    here = F.filter(F.array(*ends), lambda x: (x["k"] >= F.col("_from")) & (x["k"] < F.col("_from") + F.col("_in")))
    hit = spans.withColumn("_ends", here).where(F.size("_ends") > 0).select(*at, "_from", "_ends")
    inside = Window.partitionBy(*at).orderBy("_v").rowsBetween(*_BEFORE)
    found = null_safe(r, hit, at).withColumn("_k", F.col("_from") + F.coalesce(F.sum("_n").over(inside), F.lit(0)))
    found = found.select(*keys, "_v", F.explode(F.filter("_ends", lambda x: (x["k"] >= F.col("_k")) & (x["k"] < F.col("_k") + F.col("_n")))).alias("_e"))
    sides = found.groupBy(*keys).agg(*(F.max(F.when(F.col("_e.q") == f"{q}{side}", F.col("_v"))).alias(f"{q}{side}") for q in shares for side in "<>"))
    whole = spans.groupBy(*keys).agg(F.max("_all").alias("_all"))
    both = null_safe(whole, sides, keys, "left") if keys else whole.crossJoin(sides)  # one row each
    low, high = (lambda q: F.col(f"`{q}<`")), (lambda q: F.col(f"`{q}>`"))
    value_at = {q: F.when(F.floor(p) == F.ceil(p), low(q)).otherwise((F.ceil(p) - p) * low(q) + (p - F.floor(p)) * high(q)) for q, p in place.items()}
    return both.select(*keys, *(v.alias(q) for q, v in value_at.items()))


def medians(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    return percentiles(df, keys, value, {name: 0.5})
