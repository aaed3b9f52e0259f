"""A short report of result tables, and the comparison with expected results."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark.operators.audit import synthetic_tolerance, tree_diff


def report(auc: DataFrame, levels: DataFrame, gates: DataFrame, tallies: DataFrame) -> str:
    """Markdown from aggregates of a few rows each."""
    out = ["# Results", "", "| world | L | G | S |", "|---|---:|---:|---:|"]
    wide = auc.where("name in ('L','G','S')").groupBy("world").pivot("name", ["L", "G", "S"]).agg(F.first("point")).orderBy("world")
    out += [f"| {r.world} | {r.L:.6f} | {r.G:.6f} | {r.S:.6f} |" for r in wide.collect()]
    for r in auc.where("world = 'W0' and name = 'S−L'").collect():
        out += ["", f"S − L: {r.point:.6f}, 95 % interval [{r.lo:.6f}, {r.hi:.6f}]"]
    out += ["", "| bots | mean S | mean S − L | lower bound > 0 |", "|---|---:|---:|---:|"]
    out += [f"| {r.level} % | {r.mean_s:.6f} | {r.mean_gain:.6f} | {r.positive}/{r.draws} |" for r in levels.orderBy(F.desc("level")).collect()]
    out += ["", *(f"M1 {'met' if r.m1_loose else 'not met'}, M2 {'met' if r.m2_loose else 'not met'}" for r in gates.collect())]
    out += ["", *(f"- {r.block}: {r.kept} of {r.base_notable} effects kept" for r in tallies.orderBy("block").collect()), ""]
    return "\n".join(out)


def verification(actual: DataFrame, expected: DataFrame) -> DataFrame:
    """One row: passed, the number of leaves off, and of those off only at the strict
    tolerance."""
    off = tree_diff(actual, expected, synthetic_tolerance)
    strict = tree_diff(actual, expected)
    return off.agg(F.count("*").alias("off")).crossJoin(strict.agg(F.count("*").alias("strict"))).select((F.col("off") == 0).alias("passed"), "off", (F.col("strict") - F.col("off")).alias("loose"))
