"""Bootstrap draws of accounts, and the AUC of scores under each draw.

An account bears one row of counts, one for each replicate, as packed bytes. Draws are made
where they are needed. ``drawn_weights`` splits the draws of a whole group down a binary tree
of account ranges: the draws of a range fall to its first half by a binomial, seeded by the
range's place, so each block of accounts finds its own counts by itself and all blocks add up
to the group. ``replayed_weights`` repeats numpy's sequential multinomial for results that must
agree with seeded ones; that stream can't be divided, so one task a group draws it, in pieces.

The AUC of a replicate is a sum over ordered segments of a score: what a segment wins within
itself, and its positives times the others below it. A task turns its range of values into
three segments (its least value, its greatest, and all between), each with one number per
replicate, so rows never meet replicates one by one.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.sources.staging import staged

from .ordered import running

#: Accounts of a leaf of the tree.
LEAF = 256
#: A sequential stream is replayed for so many accounts of a group at most, as a replicate's counts
#: are in one task; and so many counts are drawn at a time.
REPLAYED, _DRAWN = 20_000_000, 1 << 22
#: Rows that are multiplied by their replicates at a time, and replicates of a group of segments.
_ROWS, _CHUNK = 256, 250


def bootstrap_counts(key: Sequence[int], n: int, replicates: int = S.BOOTSTRAPS) -> np.ndarray:
    """replicates x n resampling counts of one stratum, seeded by [SEED, *key]."""
    rng = np.random.default_rng([S.SEED, *key])
    return rng.multinomial(n, np.full(n, 1.0 / n), size=replicates) if n else np.zeros((replicates, 0), int)


def _packed(counts: np.ndarray) -> list[bytes]:
    """replicates x accounts to the bytes of each account, one for a count."""
    if counts.size and counts.max() > 255:
        raise ValueError("an account is drawn over 255 times")
    return [row.tobytes() for row in np.ascontiguousarray(counts.T).astype(np.uint8)]


def _placed(accounts: DataFrame) -> DataFrame:
    """uid, is_bot, at (from 0 in the order of uid within its group), n (of the group)."""
    own = running(accounts.select("uid", "is_bot").withColumn("one", F.lit(1)), ["is_bot"], "uid", ["one"])
    return own.select("uid", "is_bot", F.col("one_before").cast("long").alias("at"), F.col("one_all").cast("long").alias("n"))


def tree_counts(key: Sequence[int], n: int, block: int, replicates: int) -> np.ndarray:
    """replicates x accounts of a leaf: how often each is drawn when n are drawn of n.

    A node is a range of leaves; a seed of its first leaf and its width makes the binomial that
    sends draws to its first half.
    """
    first, width, drawn = 0, 1 << (-(-n // LEAF) - 1).bit_length(), np.full(replicates, n)
    accounts = lambda a, w: max(0, min((a + w) * LEAF, n) - min(a * LEAF, n))
    while width > 1:
        width //= 2
        share = accounts(first, width) / accounts(first, 2 * width)
        left = np.random.default_rng([S.SEED, *key, first, width]).binomial(drawn, share)
        if block < first + width:
            drawn = left
        else:
            first, drawn = first + width, drawn - left
    size = accounts(block, 1)
    return np.random.default_rng([S.SEED, *key, block, 0]).multinomial(drawn, np.full(size, 1.0 / size))


_WEIGHTS = "uid string, w binary"


def drawn_weights(accounts: DataFrame, key: Sequence[int], replicates: int = S.BOOTSTRAPS) -> DataFrame:
    """accounts (uid, is_bot) to uid, w: each group's accounts are drawn with replacement, as many
    as it has, in every replicate. A count is a byte."""

    def draw(table: pa.Table) -> pa.Table:
        rows = table.sort_by("at")
        is_bot, n, block = (rows.column(c)[0].as_py() for c in ("is_bot", "n", "block"))
        return pa.table({"uid": rows.column("uid"), "w": pa.array(_packed(tree_counts([*key, 2 if is_bot else 1], n, block, replicates)), pa.binary())})

    placed = _placed(accounts).withColumn("block", F.floor(F.col("at") / LEAF).cast("long"))
    return placed.groupBy("is_bot", "block").applyInArrow(draw, _WEIGHTS)


def replayed_weights(accounts: DataFrame, key: Sequence[int], replicates: int = S.BOOTSTRAPS) -> DataFrame:
    """accounts (uid, is_bot) to uid, w, the counts of ``bootstrap_counts``: humans under key 1,
    bots under key 2, each in the order of uid. One task a group draws its stream, as many
    replicates at a time as ``_DRAWN`` counts hold, and passes them on by blocks of accounts,
    where an account's pieces meet. Raises for groups of over ``REPLAYED``."""
    placed = staged(_placed(accounts), "placed")

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for is_bot, n in zip(batch.column("is_bot").to_pylist(), batch.column("n").to_pylist()):
                if n > REPLAYED:
                    raise ValueError(f"{n} accounts are too many for a sequential stream; use drawn_weights")
                rng, p, some = np.random.default_rng([S.SEED, *key, 2 if is_bot else 1]), np.full(n, 1.0 / n), max(1, _DRAWN // n)
                for first in range(0, replicates, some):
                    counts = rng.multinomial(n, p, size=min(some, replicates - first))
                    if counts.max() > 255:
                        raise ValueError("an account is drawn over 255 times")
                    own = np.ascontiguousarray(counts.T.astype(np.uint8))
                    pieces = [own[at : at + LEAF].tobytes() for at in range(0, n, LEAF)]
                    for at in range(0, len(pieces), 100):
                        w = pieces[at : at + 100]
                        columns = [pa.array([is_bot] * len(w)), pa.array(range(at, at + len(w)), pa.int64()), pa.array([first] * len(w), pa.int64()), pa.array(w, pa.binary())]
                        yield pa.RecordBatch.from_arrays(columns, ["is_bot", "block", "first", "w"])

    def meet(key, own: pa.Table, pieces: pa.Table) -> pa.Table:
        own, pieces = own.sort_by("at"), pieces.sort_by("first")
        w = np.hstack([np.frombuffer(x, np.uint8).reshape(own.num_rows, -1) for x in pieces.column("w").to_pylist()])
        return pa.table({"uid": own.column("uid"), "w": pa.array([x.tobytes() for x in w], pa.binary())})

    groups = placed.groupBy("is_bot").agg(F.max("n").alias("n")).repartition("is_bot")
    pieces = groups.mapInArrow(draw, "is_bot boolean, block long, first long, w binary")
    blocks = placed.withColumn("block", F.floor(F.col("at") / LEAF).cast("long"))
    return blocks.groupBy("is_bot", "block").cogroup(pieces.groupBy("is_bot", "block")).applyInArrow(meet, _WEIGHTS)


class _Segments:
    """One score's rows of a task, in order, as three segments for all replicates."""

    def __init__(self, replicates: int):
        self.first: tuple[float, np.ndarray, np.ndarray] | None = None
        self.last: tuple[float, np.ndarray, np.ndarray] | None = None
        self.start: float | None = None
        self.p, self.n, self.u = (np.zeros(replicates) for _ in range(3))

    def add(self, values: np.ndarray, w: np.ndarray, is_bot: np.ndarray) -> None:
        cuts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
        p = np.add.reduceat(np.where(is_bot[:, None], w, 0.0), cuts, axis=0)
        n = np.add.reduceat(np.where(is_bot[:, None], 0.0, w), cuts, axis=0)
        values = values[cuts]
        if self.last is not None and self.last[0] == values[0]:
            p[0] += self.last[1]
            n[0] += self.last[2]
        elif self.last is not None:
            values, p, n = np.concatenate([[self.last[0]], values]), np.vstack([self.last[1], p]), np.vstack([self.last[2], n])
        self.last = values[-1], p[-1], n[-1]
        values, p, n = values[:-1], p[:-1], n[:-1]
        if len(values) and self.first is None:
            self.first = values[0], p[0], n[0]
            values, p, n = values[1:], p[1:], n[1:]
        if len(values):
            below = self.n + np.cumsum(n, axis=0) - n
            self.start = values[0] if self.start is None else self.start
            self.u += (p * (below + n / 2)).sum(axis=0)
            self.p += p.sum(axis=0)
            self.n += n.sum(axis=0)

    def rows(self, score: str) -> Iterator[tuple]:
        for end in (self.first, self.last):
            if end is not None:
                yield score, float(end[0]), True, end[1], end[2], np.zeros(len(self.u))
        if self.start is not None:
            yield score, float(self.start), False, self.p, self.n, self.u


_SEGMENTS = "score string, first long, v double, tied boolean, p binary, n binary, u binary"


def _merged(table: pa.Table) -> pa.Table:
    """The segments of one score, for some replicates, to their AUCs."""
    score, first = table.column("score")[0].as_py(), table.column("first")[0].as_py()
    known: dict[tuple[float, bool], list[np.ndarray]] = {}
    for row in table.to_pylist():
        own = [np.frombuffer(row[c], np.float64) for c in "pnu"]
        before = known.get((row["v"], row["tied"]))  # parts of one tied value are one segment again
        known[row["v"], row["tied"]] = own if before is None else [x + y for x, y in zip(before, own)]
    wins = below = positives = np.zeros(len(own[0]))
    for (_, tied), (p, n, u) in sorted(known.items(), key=lambda x: x[0]):
        wins = wins + (p * n / 2 if tied else u) + p * below
        below, positives = below + n, positives + p
    weight = positives * below
    auc = pa.array(np.divide(wins, weight, where=weight > 0, out=np.zeros(len(weight))), mask=weight == 0)
    return pa.table({"rep": pa.array(np.arange(first, first + len(weight))), "score": [score] * len(weight), "auc": auc})


def bootstrap_auc(scores: DataFrame, weights: DataFrame, score_names: Sequence[str], point: bool = False) -> DataFrame:
    """scores (uid, is_bot, score columns), weights (uid, w: packed bytes or an array) to rep,
    score, auc; with ``point`` also the unweighted one, as replicate -1. Missing scores are left
    out, and an AUC is null where a side bears no weight."""
    each = F.explode(F.array(*(F.struct(F.lit(s).alias("score"), F.col(s).cast("double").alias("v")) for s in score_names)))
    # Counts are far larger than a plan takes them for, and must not be broadcast.
    both = scores.where("is_bot is not null").select("uid", "is_bot", *score_names).hint("merge").join(weights.hint("merge"), "uid")
    flat = both.select("uid", "is_bot", "w", each.alias("s")).select("uid", "is_bot", "w", "s.*").where("v is not null")
    # Values with their accounts make the ranges, so equal values need not lie in one task.
    rows = flat.repartitionByRange("score", "v", "uid").sortWithinPartitions("score", "v")
    first = -1 if point else 0

    def counts(column: pa.Array) -> np.ndarray:
        if pa.types.is_binary(column.type):
            return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(len(column), -1)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: dict[str, _Segments] = {}
        for batch in batches:
            names = np.array(batch.column("score").to_pylist(), object)
            values, is_bot = batch.column("v").to_numpy(), batch.column("is_bot").to_numpy(zero_copy_only=False)
            for at in range(0, len(names), _ROWS):
                w = counts(batch.column("w").slice(at, _ROWS)).astype(np.float64)
                if point:
                    w = np.hstack([np.ones((len(w), 1)), w])
                for name in dict.fromkeys(names[at : at + _ROWS]):
                    own = names[at : at + _ROWS] == name
                    made.setdefault(name, _Segments(w.shape[1])).add(values[at : at + _ROWS][own], w[own], is_bot[at : at + _ROWS][own])
        for name, s in made.items():
            for score, v, tied, *sums in s.rows(name):
                for at in range(0, len(sums[0]), _CHUNK):
                    columns = [[score], [at + first], [v], [tied], *([x[at : at + _CHUNK].tobytes()] for x in sums)]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["score", "first", "v", "tied", "p", "n", "u"])

    found = rows.select("score", "v", "is_bot", "w").mapInArrow(segments, _SEGMENTS)
    # A group has three segments of each task at most, whatever the number of rows.
    return found.groupBy("score", "first").applyInArrow(_merged, "rep long, score string, auc double")


DIFFERENCES = {"S−L": ("S", "L"), "S_eval−L": ("S_eval", "L"), "S−S_eval": ("S", "S_eval")}


def evaluate(scores: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, point, lo, hi of every score's AUC and of the differences on the same draws."""
    return intervals(replicated(scores, weights, names), names)


def replicated(scores: DataFrame, weights: DataFrame, names: Sequence[str]) -> DataFrame:
    """rep (-1: the unweighted point) and one AUC column per score."""
    return bootstrap_auc(scores, weights, names, point=True).groupBy("rep").pivot("score", list(names)).agg(F.first("auc"))


def intervals(wide: DataFrame, names: Sequence[str]) -> DataFrame:
    """name, point, lo, hi of ``replicated`` scores and of their differences."""
    pairs = {k: v for k, v in DIFFERENCES.items() if set(v) <= set(names)}
    columns = [F.struct(F.lit(s).alias("name"), F.col(s).alias("x")) for s in names]
    columns += [F.struct(F.lit(k).alias("name"), (F.col(a) - F.col(b)).alias("x")) for k, (a, b) in pairs.items()]
    long = wide.select("rep", F.explode(F.array(*columns)).alias("c")).select("rep", "c.*")
    draw = F.when(F.col("rep") >= 0, F.col("x"))
    # A name has as many values as there are replicates, whatever the accounts.
    out = long.groupBy("name").agg(F.max(F.when(F.col("rep") < 0, F.col("x"))).alias("point"), F.percentile(draw, F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    return out.select("name", "point", F.col("q")[0].alias("lo"), F.col("q")[1].alias("hi"))
