"""Matching by rounds of proposals against one greedy pass."""

import random

import pytest
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import matching


def one_pass(rows, caliper, seed=S.MATCH_SEED):
    bots = {u: v for u, label, v in rows if label == "bot" and v is not None}
    humans = sorted((u, v) for u, label, v in rows if label == "human" and v is not None)
    order = matching.shuffled_order(sorted(bots), seed)
    return {(b, h, i) for i, (b, h, _) in enumerate(matching.greedy([(u, bots[u]) for u in order], humans, caliper))}


def plain_greedy(bots, humans, caliper):
    free, out = list(range(len(humans))), []
    for uid, v in bots:
        near = [(abs(humans[j][1] - v), j) for j in free if abs(humans[j][1] - v) <= caliper]
        if near:
            gap, j = min(near)
            free.remove(j)
            out.append((uid, humans[j][0], gap))
        else:
            out.append((uid, None, None))
    return out


def test_greedy_is_the_plain_pass():
    for seed in range(1000):
        rng = random.Random(seed)
        draw = (lambda: float(rng.randrange(12))) if seed % 2 else (lambda: rng.uniform(0, 8))  # noqa: B023
        bots, humans = ([(f"{x}{i}", draw()) for i in range(rng.randrange(25))] for x in "bh")
        assert matching.greedy(bots, humans, 1.5) == plain_greedy(bots, humans, 1.5)


@pytest.mark.parametrize("cell_rows", [40, 1000])
def test_a_thousand_tables_in_cells(spark, cell_rows):
    """Each table lies a hundred from the next, so that one run matches all of them; values are
    whole numbers, with ties on both sides, halves and real numbers in turn."""
    rng, rows = random.Random(cell_rows), []
    for t in range(1000):
        draw = [lambda: float(rng.randrange(9)), lambda: rng.randrange(40) / 8, lambda: rng.uniform(0, 9)][t % 3]
        share = rng.choice([0.2, 0.5, 0.8])
        rows += [(f"{rng.randrange(10**9):09d}-{t}-{i}", "bot" if rng.random() < share else "human", 100.0 * t + draw()) for i in range(rng.randrange(2, 40))]
    accounts = spark.createDataFrame(rows, "uid string, label string, logn double").repartition(5)
    got = {(r.bot, r.human, r.place) for r in matching.caliper_match(accounts, 1.25, cell_rows=cell_rows).collect()}
    assert got == one_pass(rows, 1.25)


def test_cells_inside_one_crowd(spark):
    """All accounts within one island and a third of them at one value, in cells of a few rows:
    refusals travel from cell to cell."""
    rng = random.Random(6)
    rows = [(f"u{i:04d}", rng.choice(["bot", "human", "human"]), 5.0 if i % 3 == 0 else rng.uniform(0, 10)) for i in range(900)]
    accounts = spark.createDataFrame(rows, "uid string, label string, logn double")
    for caliper in (0.3, 2.0):
        got = {(r.bot, r.human, r.place) for r in matching.caliper_match(accounts, caliper, cell_rows=30).collect()}
        assert got == one_pass(rows, caliper)


def test_odd_tables(spark):
    kind = "uid string, label string, logn double"
    rows = [("a", "bot", 1.0), ("b", "bot", None), ("c", None, 1.0), ("d", "other", 1.0), ("e", "human", 1.05), ("f", "human", None)]
    got = matching.caliper_match(spark.createDataFrame(rows, kind).withColumn("at", F.lit(1))).collect()
    assert [(r.bot, r.human, r.place) for r in got] == [("a", "e", 0)]
    assert matching.caliper_match(spark.createDataFrame([], kind)).count() == 0
    alone = matching.caliper_match(spark.createDataFrame([("a", "bot", 1.0)], kind)).collect()
    assert [(r.bot, r.human) for r in alone] == [("a", None)]
    assert matching.caliper_match(spark.createDataFrame([("a", "human", 1.0)], kind)).count() == 0
