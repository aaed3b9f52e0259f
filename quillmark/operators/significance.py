"""Two-group tests per feature: Mann-Whitney, effect size, false discovery, controls."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.numeric import erfc, ratio
from quillmark.sources.staging import staged

from .ordered import null_safe, percentiles
from .ranks import two_group_counts


def mann_whitney(df: DataFrame, keys: Sequence[str], value: str, positive: Column) -> DataFrame:
    """Per key: n1, n0, u, z, p, delta (Cliff's, positive minus other).

    U comes from counts per distinct value, so ties take no extra rows. The variance is
    corrected for ties, z for continuity; without variance z is 0 and p is 1. A side without
    values gives nulls, as do both.
    """
    c = two_group_counts(df, keys, value, positive)
    t = F.col("wp") + F.col("wn")
    sums = c.groupBy(*keys).agg(
        F.sum("wp").alias("n1"), F.sum("wn").alias("n0"),
        F.sum(F.col("wp") * (F.col("wn_below") + F.col("wn") / 2)).alias("u"), F.sum(t * t * t - t).alias("ties"),
    )
    n1, n0, u = F.col("n1"), F.col("n0"), F.col("u")
    n = n1 + n0
    tested = (n1 > 0) & (n0 > 0)
    variance = n1 * n0 / 12 * ((n + 1) - F.try_divide(F.col("ties"), n * (n - 1)))
    diff = u - n1 * n0 / 2
    z_abs = F.when(variance > 0, F.greatest(F.lit(0.0), F.abs(diff) - 0.5) / F.sqrt(variance))
    out = sums.withColumn("_z", z_abs)
    z = F.when(F.col("_z").isNull(), 0.0).otherwise(F.when(diff < 0, -F.col("_z")).otherwise(F.col("_z")))
    p = F.when(F.col("_z").isNull(), 1.0).otherwise(erfc(F.coalesce(F.col("_z"), F.lit(0.0)) / F.sqrt(F.lit(2.0))))
    return out.select(
        *keys, n1.cast("long").alias("n1"), n0.cast("long").alias("n0"),
        F.when(tested, u).alias("u"), F.when(tested, z).alias("z"), F.when(tested, p).alias("p"),
        F.when(tested, 2 * F.try_divide(u, n1 * n0) - 1).alias("delta"),
    )


def benjamini_hochberg(df: DataFrame, families: Sequence[str], p: str = "p", q: str = "q", tie: Sequence[str] = ()) -> DataFrame:
    """``df`` with q within each family; a null p counts as 1 in the family but has no q.

    q is the least of p * m / rank from the largest p downwards, and 1 at most; ``tie``
    orders equal p.
    """
    filled = F.coalesce(F.col(p), F.lit(1.0))
    own = Window.partitionBy(*families)
    order = [filled, *(F.col(t) for t in tie)]
    out = df.withColumns({"_m": F.count("*").over(own), "_rank": F.row_number().over(own.orderBy(*order))})
    down = own.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    least = F.least(F.lit(1.0), F.min(filled * F.col("_m") / F.col("_rank")).over(down))
    return out.withColumn(q, F.when(F.col(p).isNotNull(), least)).drop("_m", "_rank")


#: [Q1, median, Q3] by linear interpolation, the value itself for one row.
QUARTILES = {"q1": 0.25, "med": 0.5, "q3": 0.75}


def quartile_summary(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: q1, med, q3, iqr."""
    return percentiles(df, keys, value, QUARTILES).withColumn("iqr", F.col("q3") - F.col("q1"))


def six_numbers(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """Per key: n, least, q1, med, q3, most, mean of the values that are there."""
    sums = df.groupBy(*keys).agg(F.count(value).alias("n"), F.min(value).alias("least"), F.max(value).alias("most"), F.avg(value).alias("mean"))
    return null_safe(sums, percentiles(df, keys, value, QUARTILES), keys).select(*keys, "n", "least", "q1", "med", "q3", "most", "mean")


def compare_groups(long: DataFrame, labels: DataFrame) -> DataFrame:
    """Features of ``long`` (uid, block, key, value) between bot and human accounts of
    ``labels`` (uid, label): the test, both groups' median and IQR, missing values, q within
    each block, and whether the difference is notable.

    ``missing`` also counts accounts whose label is neither.
    """
    rows = staged(long.join(labels.select("uid", "label"), "uid"), "labelled")
    bot, human = F.col("label") == "bot", F.col("label") == "human"
    both = rows.where(bot | human)
    test = mann_whitney(both, ("block", "key"), "value", bot)
    quarters = quartile_summary(both, ["block", "key", "label"], "value")
    of = lambda who, c: F.max(F.when(who, F.col(c))).alias(f"{'bot' if who is bot else 'human'}_{c}")
    quarters = quarters.groupBy("block", "key").agg(*(of(who, c) for who in (bot, human) for c in ("med", "iqr")))
    parts = rows.groupBy("block", "key").agg(F.count("*").alias("n_all")).join(quarters, ["block", "key"], "left")
    out = parts.join(test, ["block", "key"], "left").withColumns(
        {
            "n1": F.coalesce("n1", F.lit(0)), "n0": F.coalesce("n0", F.lit(0)),
        }
    )
    out = out.withColumns({"missing": F.col("n_all") - F.col("n1") - F.col("n0"), "iqr_ratio": ratio(F.col("bot_iqr"), F.col("human_iqr"))})
    out = benjamini_hochberg(out, ["block"], tie=["key"])
    notable = F.col("p").isNotNull() & (F.col("q") <= S.NOTABLE_Q) & (F.abs("delta") >= S.NOTABLE_DELTA)
    return out.withColumn("notable", F.coalesce(notable, F.lit(False))).drop("n_all")


def effect_status(result: DataFrame, baseline: DataFrame) -> DataFrame:
    """``result`` beside the ``baseline`` of the same features: whether its effect stayed."""
    ref = baseline.select("block", "key", F.col("delta").alias("base_delta"), F.col("notable").alias("base_notable"))
    d, b = F.col("delta"), F.col("base_delta")
    status = (
        F.when(~F.col("base_notable"), F.when(F.col("notable"), S.STATUS_NEW).otherwise(S.STATUS_NEITHER))
        .when(d.isNull(), S.STATUS_UNTESTABLE)
        .when(b * d < 0, S.STATUS_REVERSED)
        .when(F.abs(d) < S.NOTABLE_DELTA, S.STATUS_BELOW)
        .otherwise(S.STATUS_KEPT)
    )
    kept = F.col("base_notable") & (b * d > 0) & (F.abs(d) >= S.NOTABLE_DELTA)
    return result.join(F.broadcast(ref), ["block", "key"]).withColumns({"delta_change": d - b, "kept": F.coalesce(kept, F.lit(False)), "status": status})


def status_tallies(rows: DataFrame) -> DataFrame:
    """Per block: features, notable ones now and at the baseline, kept ones, and each status."""
    names = (S.STATUS_NEW, S.STATUS_NEITHER, S.STATUS_UNTESTABLE, S.STATUS_REVERSED, S.STATUS_BELOW, S.STATUS_KEPT)
    return rows.groupBy("block").agg(
        F.count("*").alias("features"), F.count_if("notable").alias("notable"), F.count_if("base_notable").alias("base_notable"), F.count_if("kept").alias("kept"),
        *(F.count_if(F.col("status") == s).alias(f"status_{i}") for i, s in enumerate(names)),
    )


def punctuation_invariant(rows: DataFrame) -> DataFrame:
    """One boolean: the ratio of punctuation to other tokens and the punctuation rate order
    accounts alike, so U and delta agree."""
    a = rows.where((F.col("block") == "M품사") & (F.col("key") == "PUNCT")).select("u", "delta")
    b = rows.where((F.col("block") == "R") & (F.col("key") == S.RHYTHM_KEYS[1])).select("u", "delta")
    return a.unionAll(b).agg(((F.count("*") == 2) & (F.countDistinct("u", "delta") == 1)).alias("holds"))
