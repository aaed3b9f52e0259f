"""Greedy one-to-one matching of bot to human accounts within a caliper of a log count.

Bots come in a seeded order and each takes the nearest free human. As every human prefers the
bot of the lower place, the same pairs come from deferred acceptance: bots propose, a human
keeps the bot of the lowest place that ever came, and who is refused proposes elsewhere. So
cells of the line of values are matched side by side: a cell's bots go in their order, each to
the nearest human of the cell or its surroundings that no lower place holds. Where cells meet,
a human may get several proposals; cells with a refused bot propose again until none is.
"""

from __future__ import annotations

import bisect
import math
import random
from array import array
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.sources.staging import staged

from .ordered import numbered

#: Accounts of a cell, and cells at most: cells much narrower than the caliper share most humans.
CELL_ROWS, CELLS = 100_000, 256
#: Tasks that the pairs of a bucket are dealt to.
SHARES = 32


def candidates(bots: DataFrame, humans: DataFrame, value: str = "logn", caliper: float = S.CALIPER) -> DataFrame:
    """Pairs within the caliper: bot, human, gap. A range join by buckets a little wider than
    the caliper, each bot looking into three; the gap is checked exactly. A bucket's bots are
    dealt to ``SHARES`` tasks, each of which gets its humans, as few buckets hold most accounts."""
    width = caliper * 1.1
    b = bots.select(F.col("uid").alias("bot"), F.col(value).alias("_b"), F.explode(F.array(*(F.floor(F.col(value) / width) + i for i in (-1, 0, 1)))).alias("_k"))
    b = b.withColumn("_s", F.pmod(F.xxhash64("bot"), F.lit(SHARES)))
    h = humans.select(F.col("uid").alias("human"), F.col(value).alias("_h"), F.floor(F.col(value) / width).alias("_k"), F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SHARES - 1).cast("long"))).alias("_s"))
    gap = F.abs(F.col("_h") - F.col("_b"))
    return b.join(h, ["_k", "_s"]).where(gap <= caliper).select("bot", "human", gap.alias("gap"))


def shuffled_order(bots: Sequence[str], seed: int) -> list[str]:
    order = list(bots)
    random.Random(seed).shuffle(order)
    return order


def proposals(bots: Sequence[tuple[int, float]], humans: Sequence[tuple[int, float, float]], caliper: float) -> list[tuple[int, int, float]]:
    """bots (place, value) by ascending place and humans (number, value, the place that holds
    them) to (place, number, gap): each bot's nearest human within the caliper that no lower
    place holds or took before it, of equals the lowest number; bots without one are left out.

    Humans of one value wait in a queue. Places ascend, so a human that is held goes for good
    once its holder's place is passed; a value without humans points on to the next one on either
    side that has some. A bot costs a search of the sorted values.
    """
    queues: dict[float, list[int]] = {}
    for j in sorted(range(len(humans)), key=lambda j: humans[j][0]):
        queues.setdefault(humans[j][1], []).append(j)
    values = sorted(queues)
    waiting = [queues[v][::-1] for v in values]
    left = [len(q) for q in waiting]
    at_value = {j: i for i, q in enumerate(waiting) for j in q}
    gone = [False] * len(humans)
    leaving, next_ = sorted((h[2], j) for j, h in enumerate(humans) if h[2] != math.inf), 0
    # Places are one off, so that 0 and the last mean none.
    below, above = list(range(len(values) + 2)), list(range(len(values) + 2))

    def root(to: list[int], i: int) -> int:
        while to[i] != i:
            to[i] = to[to[i]]
            i = to[i]
        return i

    def drop(j: int) -> None:
        i = at_value[j]
        gone[j], left[i] = True, left[i] - 1
        if not left[i]:
            below[i + 1], above[i + 1] = i, i + 2

    out = []
    for place, v in bots:
        while next_ < len(leaving) and leaving[next_][0] < place:
            if not gone[leaving[next_][1]]:
                drop(leaving[next_][1])
            next_ += 1
        at = bisect.bisect_left(values, v)
        best = None
        for i in (root(below, at), root(above, at + 1)):
            if 0 < i <= len(values):
                queue = waiting[i - 1]
                while gone[queue[-1]]:
                    queue.pop()
                found = (abs(values[i - 1] - v), humans[queue[-1]][0], queue[-1])
                best = found if best is None or found < best else best
        if best is not None and best[0] <= caliper:
            out.append((place, best[1], float(best[0])))
            drop(best[2])
    return out


def greedy(bots: list[tuple[str, float]], humans: list[tuple[str, float]], caliper: float) -> list[tuple[str, str | None, float | None]]:
    """Bots in the order given, each with the nearest unused human within the caliper, of
    equals the earlier in the list; None where there is none."""
    found = {p: (j, gap) for p, j, gap in proposals([(i, v) for i, (_, v) in enumerate(bots)], [(j, v, math.inf) for j, (_, v) in enumerate(humans)], caliper)}
    return [(uid, humans[found[i][0]][0], found[i][1]) if i in found else (uid, None, None) for i, (uid, _) in enumerate(bots)]


def seeded_places(spark: SparkSession, n: int, seed: int) -> DataFrame:
    """at, place: the order of a seeded shuffle of n, made by one task as its generator is
    sequential, and passed on in pieces."""

    def shuffle(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                order = array("q", range(n))
                random.Random(seed).shuffle(order)
                for first in range(0, n, 10_000):
                    own = np.frombuffer(order[first : first + 10_000], np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(np.arange(first, first + len(own)))], ["at", "place"])

    return spark.range(0, 1, 1, 1).mapInArrow(shuffle, "at long, place long")


def _cells(bots: DataFrame, humans: DataFrame, n: int, caliper: float, cell_rows: int) -> tuple[DataFrame, DataFrame]:
    """Both with cell: bots in ranges of values of about equal numbers of accounts, humans in
    every cell with a bot that they may suit. What the cells span is a row each."""
    both = bots.select("v").union(humans.select("v")).repartitionByRange(max(1, min(CELLS, -(-n // cell_rows))), "v")
    spans = [r.top for r in both.groupBy(F.spark_partition_id()).agg(F.max("v").alias("top")).orderBy("top").collect()]
    cell_of = lambda v: F.size(F.filter(F.array(*(F.lit(t) for t in spans)), lambda t: t < v))
    own = staged(bots.withColumn("cell", cell_of(F.col("v"))), "cell-bots")
    ends = own.groupBy("cell").agg(F.min("v").alias("lo"), F.max("v").alias("hi")).orderBy("cell").collect()
    near = F.filter(
        F.array(*(F.struct(F.lit(r.cell).alias("cell"), F.lit(r.lo).alias("lo"), F.lit(r.hi).alias("hi")) for r in ends)),
        lambda c: (F.col("v") >= c["lo"] - caliper * 1.01) & (F.col("v") <= c["hi"] + caliper * 1.01),
    )
    return own, staged(humans.select("at", "v", F.explode(near).alias("c")).select("at", "v", "c.cell"), "cell-humans")


_PROPOSED = "place long, at long, gap double, cell int"


def deferred_acceptance(bots: DataFrame, humans: DataFrame, n: int, caliper: float, cell_rows: int = CELL_ROWS) -> DataFrame:
    """bots (place, v), humans (at, v), n in all, to the pairs place, at, gap.

    A round is a job: cells with a refused bot propose, humans keep the lowest place. A human's
    holder only gets better, and who was refused stays refused, so rounds end; the pairs are
    those of ``greedy``.
    """

    def propose(_, b: pa.Table, h: pa.Table) -> pa.Table:
        b = b.sort_by("place")
        holds = [math.inf if x is None else x for x in h.column("hold").to_pylist()]
        rows = proposals(list(zip(b.column("place").to_pylist(), b.column("v").to_pylist())), list(zip(h.column("at").to_pylist(), h.column("v").to_pylist(), holds)), caliper)
        place, at, gap = zip(*rows) if rows else ((), (), ())
        return pa.table({"place": pa.array(place, pa.int64()), "at": pa.array(at, pa.int64()), "gap": pa.array(gap, pa.float64()), "cell": pa.array([b.column("cell")[0].as_py()] * len(rows), pa.int32())})

    if not n or not bots.head(1):
        return bots.sparkSession.createDataFrame([], "place long, at long, gap double")
    own, near = _cells(bots, humans, n, caliper, cell_rows)
    held, stands, again = None, None, None
    while True:
        b, h = own, near
        if again is not None:
            b, h = (x.join(F.broadcast(again), "cell", "left_semi") for x in (b, h))  # names of cells
        h = h.join(held, "at", "left") if held is not None else h.withColumn("hold", F.lit(None).cast("long"))
        new = b.groupBy("cell").cogroup(h.groupBy("cell")).applyInArrow(lambda k, x, y: propose(k, x, y), _PROPOSED)
        if stands is not None:
            new = new.unionByName(stands.join(F.broadcast(again), "cell", "left_anti"))
        stands = staged(new, "proposals")
        lowest = stands.select("at", F.col("place").alias("hold"))
        held = staged((lowest if held is None else lowest.union(held)).groupBy("at").agg(F.min("hold").alias("hold")), "holds")
        again = staged(stands.join(held, "at").where("place > hold").select("cell").distinct(), "refused")
        if not again.head(1):
            return stands.select("place", "at", "gap")


def caliper_match(accounts: DataFrame, caliper: float = S.CALIPER, seed: int = S.MATCH_SEED, cell_rows: int = CELL_ROWS) -> DataFrame:
    """accounts (uid, label, logn) to bot, human, gap, place: one row per bot in the seeded
    order of the sorted bots; human is null for an unmatched one.

    Accounts are numbered in the order of uid by ranges; cells hold numbers and values only.
    The order of the bots is a table that one task writes. A cell has ``cell_rows`` accounts,
    more where a value has more or there are ``CELLS`` of them, and the humans around it.
    """
    spark = accounts.sparkSession
    # What accounts come from, texts it may be, is read once, not by each side and its sampling.
    own = staged(accounts.where(F.col("logn").isNotNull() & F.col("label").isin("bot", "human")).select("uid", "label", F.col("logn").cast("double").alias("v")), "accounts")
    bots, humans = (staged(numbered(own.where(F.col("label") == x).drop("label"), "uid", "at"), x) for x in ("bot", "human"))
    n_bots, n_humans = bots.count(), humans.count()
    placed = staged(bots.join(seeded_places(spark, n_bots, seed), "at").select("uid", "place", "v"), "placed-bots")
    pairs = deferred_acceptance(placed.select("place", "v"), humans.select("at", "v"), n_bots + n_humans, caliper, cell_rows)
    named = pairs.join(humans.select("at", F.col("uid").alias("human")), "at").select("place", "human", "gap")
    return placed.join(named, "place", "left").select(F.col("uid").alias("bot"), "human", "gap", "place")


def log_count(n: float | None) -> float | None:
    return math.log(n) if n else None
