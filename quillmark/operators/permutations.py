"""Medians of both groups under seeded swaps within pairs, where pairs never meet in one row.

Distances become ranks among their part's distinct values. Blocks of pairs, dealt out evenly,
draw their own columns of the seeded swaps, as the generator can leap, once for all parts.
Swaps move a side's median by few ranks, in the order of the square root of the pairs: a block
counts each replicate's ranks below a window around the middle of all ranks, and passes on the
swaps only of pairs with a rank inside. Where a replicate's median turns out to lie outside,
all is done again with a wider window. Within it the median is found by refinement: blocks count
the ranks in the bins of an interval, the counts of all blocks are added, and the bin that
holds the middle is the next interval. What goes to the tasks is one interval for each
replicate, whatever the number of pairs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.sources.staging import staged

from .ordered import running

#: Pairs of a block at most, replicates counted at a time, and bins of an interval.
BLOCK, CHUNK, BINS = 2_048, 250, 64
#: Pairs of a block, of few, at least.
LEAST = 256
#: Half a window at first, in square roots of the pairs; by Hoeffding's bound a median outside
#: has a chance of less than 2 exp(-REACH ** 2 / 2).
REACH = 8.0
#: Pairs of a window whose ranks are counted at once.
PIECE = 64

#: Ranks from lo on and below hi, the number of ranks below lo and below hi on both sides.
Window = tuple[int, int, int, int]


def swap_bits(seed: int, n: int, pairs: int, first: int, size: int) -> np.ndarray:
    """n x size booleans: some columns of the n x pairs swaps, each replicate a row of draws."""
    bits = np.random.PCG64(seed).advance(first)
    rng, out = np.random.Generator(bits), np.empty((n, size), bool)
    for rep in range(n):
        out[rep] = rng.random(size) < 0.5
        bits.advance(pairs - size)
    return out


def _blocks(ranked: DataFrame, size: int) -> DataFrame:
    """pairs, block, ranks: the pairs (part, at, b, h) of a block, of all parts with so many pairs,
    dealt to tasks evenly: they are few bytes and much work."""
    placed = ranked.withColumn("block", F.floor(F.col("at") / size).cast("long"))
    blocks = staged(placed.groupBy("pairs", "block").agg(F.collect_list(F.struct("part", "at", "b", "h")).alias("ranks")), "blocks")
    return blocks.repartition(max(1, min(blocks.count(), 4 * ranked.sparkSession.sparkContext.defaultParallelism)))


def _swapped(blocks: DataFrame, n: int, seed: int, size: int, windows: dict[str, Window]) -> DataFrame:
    """part, b, h, bits: the ranks of a pair of the window and its swaps; and for each task and
    part: part, first, below, the first side's ranks below the window and below its end by
    replicate, as bytes."""

    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for row in (r for batch in batches for i in range(batch.num_rows) for r in batch.slice(i, 1).to_pylist()):
            first = row["block"] * size
            swaps = swap_bits(seed, n, row["pairs"], first, min(size, row["pairs"] - first))
            parts = np.array([x["part"] for x in row["ranks"]])
            ranks = np.array([(x["at"], x["b"], x["h"]) for x in row["ranks"]], np.int64)
            for part in dict.fromkeys(parts.tolist()):
                own = ranks[parts == part]
                b, h = own[np.argsort(own[:, 0]), 1:].T
                lo, hi = windows[part][:2]
                under_b, under_h = (x[:, None] < np.array([lo, hi]) for x in (b, h))
                # A swap puts the second side's rank in place of the first's; sums this small are exact.
                step = under_b.astype(np.float32) - under_h
                count = sums.setdefault(part, np.zeros((n, 2), np.int64))
                for at in range(0, n, CHUNK):
                    count[at : at + CHUNK] += under_h.sum(axis=0) + (swaps[at : at + CHUNK].astype(np.float32) @ step).astype(np.int64)
                near = np.flatnonzero(((b >= lo) & (b < hi)) | ((h >= lo) & (h < hi)))
                for k in range(0, len(near), PIECE):
                    piece = near[k : k + PIECE]
                    yield _row(part, len(piece), b=b[piece], h=h[piece], bits=[x.tobytes() for x in np.packbits(swaps[:, piece].T, axis=1)])
        for part, count in sums.items():
            for at in range(0, n, CHUNK):
                yield _row(part, 1, first=[at], below=[count[at : at + CHUNK].tobytes()])

    return staged(blocks.mapInArrow(draw, _SWAPPED), "swaps")


_SWAPPED = "part string, b long, h long, bits binary, first int, below binary"


def _row(part: str, rows: int, **columns) -> pa.RecordBatch:
    kinds = {"b": pa.int64(), "h": pa.int64(), "bits": pa.binary(), "first": pa.int32(), "below": pa.binary()}
    return pa.RecordBatch.from_arrays([pa.array([part] * rows, pa.string()), *(pa.array(columns.get(c, [None] * rows), t) for c, t in kinds.items())], ["part", *kinds])


def _below(swaps: DataFrame, n: int) -> dict[str, np.ndarray]:
    """Per part n x 2: the first side's ranks below the window and below its end."""

    def add(table: pa.Table) -> pa.Table:
        whole = sum(np.frombuffer(x, np.int64) for x in table.column("below").to_pylist())
        return pa.table({"part": table.column("part")[:1], "first": table.column("first")[:1], "below": pa.array([whole.tobytes()], pa.binary())})

    added = swaps.where("below is not null").select("part", "first", "below").groupBy("part", "first").applyInArrow(add, "part string, first int, below binary")
    out: dict[str, np.ndarray] = {}
    for r in added.collect():
        own = np.frombuffer(r.below, np.int64).reshape(-1, 2)
        out.setdefault(r.part, np.zeros((n, 2), np.int64))[r.first : r.first + len(own)] = own
    return out


def _windows(ranks: DataFrame, sizes: dict[str, tuple[int, int]], reach: float) -> dict[str, Window]:
    """Per part the ranks around the middle of all: on average half of what is below a rank is
    of either side, and swaps move that by some square roots of the pairs at most."""
    ends = [(part, 2 * ((pairs - 1) // 2) - reach * pairs**0.5, 2 * (pairs // 2) + reach * pairs**0.5) for part, (pairs, _) in sizes.items()]
    near = ranks.join(F.broadcast(ranks.sparkSession.createDataFrame(ends, "part string, least double, most double")), "part")
    lo = F.max(F.when(F.col("below") <= F.col("least"), F.struct("rank", "below")))
    hi = F.min(F.when(F.col("below") > F.col("most"), F.struct("rank", "below")))
    out = {}
    for r in near.groupBy("part").agg(lo.alias("lo"), hi.alias("hi")).collect():
        pairs, distinct = sizes[r.part]
        (first, under), (end, upto) = r.lo or (0, 0), r.hi or (distinct, 2 * pairs)
        out[r.part] = (first, end, under, upto)
    return out


def _counted(swaps: DataFrame, n: int, intervals: dict[tuple[str, int], np.ndarray], targets: dict[str, list[tuple[int, int]]], width: int) -> DataFrame:
    """part, target, first, counts of the bins from each replicate's interval on: a row for each
    task, which adds up its own pairs."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[tuple[str, int], np.ndarray] = {}
        for batch in batches:
            for k in range(0, batch.num_rows, PIECE):
                piece = batch.slice(k, PIECE)
                parts = np.array(piece.column("part").to_pylist())
                ranks = np.stack([piece.column(c).to_numpy() for c in "bh"], axis=1)
                packed = np.frombuffer(b"".join(piece.column("bits").to_pylist()), np.uint8).reshape(len(parts), -1)
                swapped = np.unpackbits(packed, axis=1, count=n).astype(bool)
                for part in set(parts.tolist()):
                    (b, h), own_swaps = ranks[parts == part].T[:, :, None], swapped[parts == part]
                    for t, (side, _) in enumerate(targets[part]):
                        place = np.where(own_swaps == bool(side), h, b) - intervals[part, t]
                        pair, rep = np.nonzero((place >= 0) & (place < width * BINS))
                        own = sums.setdefault((part, t), np.zeros(n * BINS, np.int64))
                        own += np.bincount(rep * BINS + place[pair, rep] // width, minlength=n * BINS)
        for (part, t), own in sums.items():
            for at in range(0, n, CHUNK):
                piece = own[at * BINS : (at + CHUNK) * BINS]
                yield pa.RecordBatch.from_arrays([pa.array([part]), pa.array([t], pa.int32()), pa.array([at], pa.int32()), pa.array([piece.tobytes()], pa.binary())], ["part", "target", "first", "counts"])

    return swaps.where("bits is not null").select("part", "b", "h", "bits").mapInArrow(count, "part string, target int, first int, counts binary")


def _narrowed(counts: DataFrame, intervals: dict, remaining: dict, width: int) -> DataFrame:
    """part, target, rep, at (where the next interval begins), left (the rank within it)."""

    def narrow(table: pa.Table) -> pa.Table:
        part, t, first = (table.column(c)[0].as_py() for c in ("part", "target", "first"))
        whole = sum(np.frombuffer(x, np.int64) for x in table.column("counts").to_pylist()).reshape(-1, BINS)
        upto = np.cumsum(whole, axis=1)
        left = remaining[part, t][first : first + len(whole)]
        own = (upto <= left[:, None]).sum(axis=1)
        before = np.where(own > 0, upto[np.arange(len(whole)), own - 1], 0)
        start = intervals[part, t][first : first + len(whole)] + own * width
        rep = np.arange(first, first + len(whole))
        return pa.table({"part": [part] * len(whole), "target": pa.array([t] * len(whole), pa.int32()), "rep": pa.array(rep), "at": pa.array(start), "left": pa.array(left - before)})

    return counts.groupBy("part", "target", "first").applyInArrow(narrow, "part string, target int, rep long, at long, left long")


def permutation_ratios(paired: DataFrame, n: int = S.PERMUTATIONS, seed: int = S.SEED) -> DataFrame:
    """paired (part, pair, d_bot, d_human) to part, rep, ratio: the first side's median over the
    second's, where a replicate swaps the sides of some pairs. Pairs count in their order; a
    pair without one of its distances makes its part's ratios null, as does a median of 0."""
    rows = staged(paired.select("part", "pair", F.col("d_bot").cast("double").alias("b"), F.col("d_human").cast("double").alias("h")), "paired")
    numbered = running(rows.withColumn("one", F.lit(1)), ["part"], "pair", ["one"]).select("part", "b", "h", F.col("one_before").cast("long").alias("at"), F.col("one_all").cast("long").alias("pairs"))
    values = rows.select("part", F.explode(F.array("b", "h")).alias("v")).where("v is not null").groupBy("part", "v").agg(F.count("*").alias("n"), F.lit(1).alias("one"))
    ranks = running(values, ["part"], "v", ["one", "n"]).select("part", "v", F.col("one_before").cast("long").alias("rank"), F.col("one_all").alias("distinct"), F.col("n_before").cast("long").alias("below"))
    ranks = staged(ranks, "distances")
    whole = rows.groupBy("part").agg(F.bool_and(F.col("b").isNotNull() & F.col("h").isNotNull()).alias("whole"), F.count("*").alias("pairs"))
    sizes = {r.part: (r.pairs, r.distinct) for r in whole.where("whole").join(ranks.groupBy("part").agg(F.max("distinct").alias("distinct")), "part").collect()}
    side = lambda c: ranks.select("part", F.col("v").alias(c), F.col("rank").alias(f"r{c}"))
    ranked = numbered.join(side("b"), ["part", "b"]).join(side("h"), ["part", "h"]).where(F.col("part").isin(list(sizes)))
    most = max((pairs for pairs, _ in sizes.values()), default=0)
    size = min(BLOCK, max(LEAST, -(-most // (2 * paired.sparkSession.sparkContext.defaultParallelism))))
    blocks = _blocks(ranked.select("part", "at", "pairs", F.col("rb").alias("b"), F.col("rh").alias("h")), size)
    # Of an even number of pairs both middle ranks are sought, of either side.
    targets = {part: [(s, k) for s in (0, 1) for k in dict.fromkeys(((pairs - 1) // 2, pairs // 2))] for part, (pairs, _) in sizes.items()}
    reach = REACH
    while True:
        windows = _windows(ranks, sizes, reach)
        swaps = _swapped(blocks, n, seed, size, windows)
        below = _below(swaps, n)
        intervals, remaining, inside = {}, {}, True
        for part, own in targets.items():
            lo, _, *totals = windows[part]
            for t, (side, k) in enumerate(own):
                # Both sides together have every rank.
                before, upto = (np.array(totals) - below[part] if side else below[part]).T
                intervals[part, t], remaining[part, t] = np.full(n, lo, np.int64), k - before
                inside &= bool(((before <= k) & (upto > k)).all())
        if inside:
            break
        reach *= 2
    width = 1
    while width * BINS < max((hi - lo for lo, hi, *_ in windows.values()), default=0):
        width *= BINS
    while True:
        found = staged(_narrowed(_counted(swaps, n, intervals, targets, width), intervals, remaining, width), "intervals")
        if width == 1:
            break
        width //= BINS
        told = found.toPandas()
        for (part, t), own in told.groupby(["part", "target"]):
            own = own.sort_values("rep")
            intervals[part, int(t)], remaining[part, int(t)] = own["at"].to_numpy(), own["left"].to_numpy()
    per_side = paired.sparkSession.createDataFrame([(p, t, s) for p, own in targets.items() for t, (s, _) in enumerate(own)], "part string, target int, side int")
    middle = found.join(F.broadcast(per_side), ["part", "target"]).join(ranks.select("part", F.col("rank").alias("at"), "v"), ["part", "at"])
    of = lambda s: F.avg(F.when(F.col("side") == s, F.col("v")))
    ratios = middle.groupBy("part", "rep").agg(F.try_divide(of(0), of(1)).alias("ratio"))
    none = whole.where("not whole").select("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))).alias("rep"), F.lit(None).cast("double").alias("ratio"))
    return ratios.unionByName(none)
