"""What-if transforms of a labelled set, its spread, and the checks of what they did."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schema as S

from .homogeneity import centres
from .neighbours import kth_distance
from .ordered import medians

_KEY = ["block", "key"]


def _centres_wide(long: DataFrame) -> DataFrame:
    c = centres(long)
    pick = lambda x: F.max(F.when(F.col("label") == x, F.col("centre")))
    return c.groupBy(*_KEY).agg(pick("bot").alias("mb"), pick("human").alias("mh"))


def remove_centre(long: DataFrame) -> DataFrame:
    """long (uid, label, block, key, value): bots move to the human centre, keeping their own
    residuals; humans stay."""
    moved = F.when(F.col("label") == "bot", F.col("mh") + (F.col("value") - F.col("mb"))).otherwise(F.col("value"))
    return long.join(F.broadcast(_centres_wide(long)), _KEY).withColumn("value", moved).drop("mb", "mh")


def transplant(long: DataFrame, donors: DataFrame, side: str) -> DataFrame:
    """The accounts of ``side`` take a donor's whole row of residuals around their own centre;
    a donor's missing cells stay missing. donors (uid, donor) names each one's."""
    c = F.broadcast(_centres_wide(long))
    own, theirs = ("mb", "mh") if side == "bot" else ("mh", "mb")
    given = long.select(F.col("uid").alias("donor"), *_KEY, F.col("value").alias("_v"))
    base = long.where(F.col("label") == side).select("uid", "label").distinct()
    new = base.join(donors, "uid").join(given, "donor").join(c, _KEY)
    moved = new.select(*[F.col(x) for x in long.columns if x != "value"], (F.col(own) + (F.col("_v") - F.col(theirs))).alias("value"))
    return long.where(F.col("label") != side).unionByName(moved)


def spread(percentiles: DataFrame, k: int = S.NEIGHBOURS, labels: Sequence[str] = ("bot", "human")) -> DataFrame:
    """percentiles (uid, label, block, key, p): label, sd (the median over features of the
    population deviation) and nn (the median distance to the k-th neighbour in the group), of
    these labels."""
    percentiles = percentiles.where(F.col("label").isin(*labels))
    sd = medians(percentiles.groupBy("label", *_KEY).agg(F.stddev_pop("p").alias("s")), ["label"], "s", "sd")
    near = None
    for label in labels:
        vec = (
            percentiles.where(F.col("label") == label)
            .groupBy("uid")
            .agg(F.transform(F.array_sort(F.collect_list(F.struct(*_KEY, "p"))), lambda x: x["p"]).alias("vec"))
        )
        one = kth_distance(vec, k).select(F.lit(label).alias("label"), "d")
        near = one if near is None else near.unionByName(one)
    assert near is not None
    return sd.join(medians(near, ["label"], "d", "nn"), "label").select("label", "sd", "nn")


def multiplied(spreads: DataFrame, label: str, factors: dict[str, float]) -> DataFrame:
    """spreads (label, sd, nn) to (world, label, sd, nn) of worlds that multiply the values of one
    label: its deviations and distances are multiplied by as much, so no neighbour is looked for."""
    rows = F.explode(F.array(*(F.struct(F.lit(w).alias("world"), F.lit(abs(float(f))).alias("f")) for w, f in factors.items())))
    each = spreads.select("label", "sd", "nn", rows.alias("w")).withColumn("f", F.when(F.col("label") == label, F.col("w.f")).otherwise(1.0))
    return each.select("w.world", "label", (F.col("sd") * F.col("f")).alias("sd"), (F.col("nn") * F.col("f")).alias("nn"))


def threshold_test(value: Column, op: str, limit: float) -> tuple[Column, Column]:
    """(passed, rounding_differs): the comparison must hold for the value and for it rounded
    to three digits."""
    compare = {"<=": lambda v: v <= limit, ">=": lambda v: v >= limit, ">": lambda v: v > limit}[op]
    raw, rounded = compare(value), compare(F.bround(value, 3))
    return raw & rounded, raw != rounded


def gates(spreads: DataFrame, l_auc: DataFrame) -> DataFrame:
    """spreads (world, label, sd, nn) and l_auc (one row: point, lo, hi of L under W1) to one
    row: m1_sd, m1_nn, m1_strict, m1_loose, m2_sd, m2_l, m2_strict, m2_loose, m3_sd, m3_nn.

    m1: under W2 both groups spread alike. m2: under W1 bots spread as before and L is weak.
    m3 (reported only): the share of the spread's gap that W3 removes. Strict tests need the
    rounded value to pass too.
    """
    pick = lambda w, g, c: F.max(F.when((F.col("world") == w) & (F.col("label") == g), F.col(c)))
    names = [(w, g, c) for w in ("W0", "W1", "W2", "W3") for g in ("bot", "human") for c in ("sd", "nn")]
    v = spreads.agg(*(pick(*x).alias("_".join(x)) for x in names)).crossJoin(F.broadcast(l_auc.select("point", "hi")))
    c = F.col
    m1_sd, m1_nn = F.abs(c("W2_bot_sd") - c("W2_human_sd")), F.abs(c("W2_bot_nn") - c("W2_human_nn"))
    m2_sd = F.abs(c("W1_bot_sd") - c("W0_bot_sd"))
    t = lambda x, limit: threshold_test(x, "<=", limit)[0]
    gap = lambda w, q: c(f"{w}_human_{q}") - c(f"{w}_bot_{q}")
    removed = lambda q: 1 - F.try_divide(gap("W3", q), gap("W0", q))
    return v.select(
        m1_sd.alias("m1_sd"), m1_nn.alias("m1_nn"), (t(m1_sd, 0.010) & t(m1_nn, 0.010)).alias("m1_strict"), ((m1_sd <= 0.010) & (m1_nn <= 0.010)).alias("m1_loose"),
        m2_sd.alias("m2_sd"), c("point").alias("m2_l"), (t(m2_sd, 0.015) & t(c("point"), 0.60) & t(c("hi"), 0.60)).alias("m2_strict"),
        ((m2_sd <= 0.015) & (c("point") <= 0.60)).alias("m2_loose"), removed("sd").alias("m3_sd"), removed("nn").alias("m3_nn"),
    )


def donor_table(spark: SparkSession, rows: Sequence[tuple[str, str]]) -> DataFrame:
    return spark.createDataFrame(list(rows), "uid string, donor string")
