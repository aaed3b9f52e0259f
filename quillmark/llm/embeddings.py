"""Near-duplicate vectors by counting collisions on one-dimensional projections.

Vectors of length one are turned by a fixed random rotation; each coordinate is a projection
onto a line. On every line the vectors of a block are sorted, and a window of half-width w
around a query's own projection holds the vectors that collide with it there. A pair that
collides on enough lines is a candidate, and its cosine is computed in double precision.

The count that a pair must reach is calibrated for full recall. All lines together keep the
distance: the squared projected differences of a pair sum to its squared distance, which is
at most 2 - 2c for a cosine of c or more. A line missed has a difference over w, so at most
(2 - 2c) / w^2 lines can be missed, whatever the data. Among windows the calibration takes
the one under which unrelated pairs pass least often.

Counting is bit-parallel. Along a sorted line the window of a query is a range, so its set of
colliding vectors is the difference of two prefix sets of bits, and one operation on a word
counts 64 pairs.

Groups of blocks meet in a grid of cells, each bounded in rows whatever the data; that work
grows with the square of the number of distinct vectors, as collision counting does. Cells
give each vector's number of links and a spanning tree of its links, never the pairs.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import looked_up, scratch, written

MIN_COSINE = 0.9
SEED = 20_260_101
#: Vectors of a block; its prefix sets take BLOCK^2 / 8 bytes a line.
BLOCK = 1024
#: Distinct vectors that a group holds at most; a cell has two groups.
GROUP_ROWS = 16_384
#: Cells are at least so many, so that all executors have work.
MIN_GROUPS = 8
#: Vectors without a vec_id get names from here on, above all that have one.
NAMELESS = 1 << 61
#: Queries counted at a time against a block.
QUERIES = 512


class Calibration(NamedTuple):
    width: float
    misses: int


@lru_cache(maxsize=32)
def calibrate(dim: int, min_cosine: float) -> Calibration:
    """The window's half-width and the lines that a pair may miss.

    Unrelated unit vectors differ by about sqrt(2 / dim) on a line; the width with the least
    chance that such a pair misses few enough lines is taken. No choice loses a linked pair.
    """
    reach = 2 - 2 * min_cosine
    sigma = math.sqrt(2 / dim)
    best: tuple[float, Calibration] | None = None
    for misses in range(0, dim):
        # Lines missed have a difference over width: (misses + 1) of them would exceed reach.
        width = math.sqrt(reach / (misses + 1)) * (1 + 1e-9) + 1e-12
        p = math.erf(width / sigma / math.sqrt(2))
        mean, sd = dim * (1 - p), math.sqrt(max(dim * p * (1 - p), 1e-12))
        chance = 0.5 * math.erfc((mean - misses - 0.5) / sd / math.sqrt(2))
        if best is None or chance < best[0]:
            best = chance, Calibration(width, misses)
    assert best
    return best[1]


@lru_cache(maxsize=4)
def rotation(dim: int) -> np.ndarray:
    q, r = np.linalg.qr(np.random.Generator(np.random.PCG64(SEED)).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


class _Lines:
    """A block's sorted projections and, for each line, the prefix sets along it."""

    def __init__(self, projected: np.ndarray):
        n, self.dim = projected.shape
        self.n, self.words = n, -(-n // 64)
        order = np.argsort(projected, axis=0, kind="stable")
        self.sorted = np.take_along_axis(projected, order, axis=0)
        self.prefix = np.zeros((self.dim, n + 1, self.words), np.uint64)
        at = np.arange(1, n + 1)
        for line in range(self.dim):
            own = self.prefix[line]
            own[at, order[:, line] // 64] = np.uint64(1) << (order[:, line] % 64).astype(np.uint64)
            np.bitwise_xor.accumulate(own, axis=0, out=own)

    def within(self, queries: np.ndarray, width: float, misses: int) -> np.ndarray:
        """Bits of the block's vectors that miss at most ``misses`` lines of each query."""
        planes = max(misses + 1, 1).bit_length()
        count = np.zeros((planes, len(queries), self.words), np.uint64)
        over = np.zeros((len(queries), self.words), np.uint64)
        carry, spare = np.empty_like(over), np.empty_like(over)
        for line in range(self.dim):
            own = self.sorted[:, line]
            lo = np.searchsorted(own, queries[:, line] - width, "left")
            hi = np.searchsorted(own, queries[:, line] + width, "right")
            prefix = self.prefix[line]
            np.bitwise_xor(prefix[hi], prefix[lo], out=carry)
            np.invert(carry, out=carry)  # the vectors that miss this line
            for plane in count:
                np.bitwise_and(plane, carry, out=spare)
                np.bitwise_xor(plane, carry, out=plane)
                carry, spare = spare, carry
            np.bitwise_or(over, carry, out=over)  # more misses than the planes can count
        # count > misses, from the highest plane down.
        above, equal = np.zeros_like(over), np.full_like(over, ~np.uint64(0))
        for p in range(planes - 1, -1, -1):
            if misses >> p & 1:
                equal &= count[p]
            else:
                above |= equal & count[p]
                equal &= ~count[p]
        return ~(above | over)


def block_candidates(a: np.ndarray, lines: _Lines, fit: Calibration) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Positions (in a, in the block) of pairs that collide on enough lines."""
    for at in range(0, len(a), QUERIES):
        near = lines.within(a[at : at + QUERIES], fit.width, fit.misses)
        q, w = np.nonzero(near)
        if not len(q):
            continue
        bits = np.unpackbits(near[q, w].astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        k, bit = np.nonzero(bits)
        j = w[k] * 64 + bit
        real = j < lines.n
        yield q[k][real] + at, j[real]


#: Products of unit vectors this near the limit are judged by the vectors as given.
_CLOSE = 1e-12


def _cosines(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """dot / (norm * norm), rounded once at each step, so that exact ties stay ties."""
    dot, aa, bb = (np.cumsum(p * q, axis=1)[:, -1] for p, q in ((a, b), (a, a), (b, b)))
    return dot / (np.sqrt(aa) * np.sqrt(bb))


def cell_links(x: np.ndarray, y: np.ndarray | None, min_cosine: float, given_x: np.ndarray | None = None, given_y: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked positions of unit vectors x and y (None: within x, i < j); ``given`` are the
    vectors before they were made units."""
    given_x, given_y = x if given_x is None else given_x, y if given_y is None else given_y
    fit = calibrate(x.shape[1], min_cosine)
    turn = rotation(x.shape[1])
    px = x @ turn
    z, pz, given_z = (x, px, given_x) if y is None else (y, y @ turn, given_y)
    for at in range(0, len(z), BLOCK):
        lines = _Lines(pz[at : at + BLOCK])
        # Within one group a block meets itself and the blocks before it.
        queries = px if y is not None else px[: at + BLOCK]
        for i, j in block_candidates(queries, lines, fit):
            j = j + at
            if y is None:
                i, j = i[i < j], j[i < j]
            for s in range(0, len(i), 1 << 16):
                a, b = i[s : s + (1 << 16)], j[s : s + (1 << 16)]
                product = np.einsum("ij,ij->i", x[a], z[b])
                near, close = product >= min_cosine, np.abs(product - min_cosine) < _CLOSE
                near[close] = _cosines(given_x[a[close]], given_z[b[close]]) >= min_cosine
                yield a[near], b[near]


def _union(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    while len(a):
        a, b = parent[a], parent[b]
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        apart = hi != lo
        hi, lo = hi[apart], lo[apart]
        np.minimum.at(parent, hi, lo)
        while (parent[parent] != parent).any():
            parent[:] = parent[parent]
        a, b = hi, lo


_CELL = "node long, links long, root long"


def _solve_cell(side: np.ndarray, node: np.ndarray, many: np.ndarray, vectors: list, min_cosine: float, diagonal: bool) -> pa.Table:
    """One cell's vectors (side 0 and, off the diagonal, 1) to links and a spanning tree. Off the
    diagonal a side may be empty; links within the other are those of its own diagonal cell."""
    dims = np.array([len(v) for v in vectors])
    links, parent = np.zeros(len(node), np.int64), np.arange(len(node))
    for dim in np.unique(dims):
        own = dims == dim
        given = np.stack([v for v, o in zip(vectors, own) if o]).astype(np.float64)
        # By powers of two, so that squares neither overflow nor vanish and no digit is lost.
        given = np.ldexp(given, -np.frexp(np.abs(given).max(axis=1, keepdims=True))[1])
        unit = given / np.linalg.norm(given, axis=1)[:, None]
        place = np.flatnonzero(own)
        left, right = place[side[place] == 0], place[side[place] == 1]
        sides = [(unit[side[place] == s], given[side[place] == s]) for s in (0, 1)]
        if not len(left) or not diagonal and not len(right):
            continue  # a group's side has no vector of this length
        z = left if diagonal else right
        (x, given_x), (y, given_y) = sides[0], (None, None) if diagonal else sides[1]
        for a, b in cell_links(x, y, min_cosine, given_x, given_y):
            a, b = left[a], z[b]
            np.add.at(links, a, many[b])
            np.add.at(links, b, many[a])
            _union(parent, a, b)
    some = links > 0
    return pa.table({"node": node[some], "links": links[some], "root": node[parent[some]]})


def near_duplicate_vectors(vectors: DataFrame, min_cosine: float = MIN_COSINE) -> DataFrame:
    """``vectors`` (vec_id, embedding array) to vec_id, n_links, component_id, kept; one row
    per input row.

    Equal vectors are one node that counts as many, named by the smallest vec_id. Vectors
    that are null, empty, zero or hold null or non-finite components link with nothing, nor
    do vectors of different lengths. A null vec_id names nothing: its row counts as a link of
    others, and its component is the smallest vec_id reachable, null if there is none. A
    vec_id is below 2^61. Repeated rows link with each other, ties at the limit link, and an
    empty table gives no rows. Only vec_id and embedding are read, so other columns can't clash.
    """
    v = F.transform("embedding", lambda x: x.cast("double"))
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0.0), F.lit(False))
    # Adding zero makes -0.0 and 0.0 equal.
    large = F.col("vec_id") >= NAMELESS
    vec_id = F.when(large, F.raise_error(F.lit("a vec_id is 2^61 or more")).cast("long")).otherwise(F.col("vec_id")).alias("vec_id")
    marked = vectors.select(vec_id, F.when(able, F.transform(v, lambda x: x + F.lit(0.0))).alias("v"))
    # 128 bits of hashes stand for a vector where rows meet its result, so no vector moves there.
    marked = marked.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    with scratch(vectors.sparkSession) as keep:
        linked = keep(written(_linked_vectors(marked, min_cosine), "linked-vectors"))
    rows = marked.select("vec_id", F.when(F.col("v").isNotNull(), F.col("h")).alias("h"), "h2")
    out = looked_up(rows, linked, ["h", "h2"], "many").select(
        "vec_id",
        F.coalesce("links", F.lit(0)).cast("long").alias("n_links"),
        F.coalesce(F.when(F.col("c") < NAMELESS, F.col("c")), F.col("vec_id")).alias("component_id"),
    )
    return out.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def _linked_vectors(marked: DataFrame, min_cosine: float) -> DataFrame:
    """h, h2, many (rows), links, c (component) of each vector with links or copies."""
    named = (
        marked.where("v is not null")
        .groupBy("v")
        .agg(F.min("vec_id").alias("node"), F.count("*").alias("many"))
        .select(F.xxhash64("v").alias("h"), F.xxhash64(F.lit("second"), F.col("v")).alias("h2"), "v", "many", F.coalesce("node", F.lit(NAMELESS) + F.xxhash64("v").bitwiseAND(F.lit(NAMELESS - 1))).alias("node"))
    )
    distinct = written(named, "distinct-vectors")
    n = distinct.count()
    groups = max(MIN_GROUPS, -(-n // GROUP_ROWS))
    # A row's group comes from its hash; it goes to the cells (g, k) for k >= g and (k, g).
    placed = distinct.withColumn("g", F.pmod("h", F.lit(groups)).cast("int"))
    cells = F.transform(
        F.sequence(F.lit(0), F.lit(groups - 1)),
        lambda k: F.struct(
            (F.least(k, F.col("g")) * groups + F.greatest(k, F.col("g"))).cast("long").alias("cell"), F.when(k < F.col("g"), 1).otherwise(0).alias("side")
        ),
    )
    spread = placed.select("node", "many", F.col("v"), F.explode(cells).alias("c")).select("c.cell", "c.side", "node", "many", "v")

    def solve(key: tuple, table: pa.Table) -> pa.Table:
        side, node, many = (table.column(c).to_numpy() for c in ("side", "node", "many"))
        column = table.column("v").combine_chunks()
        flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
        rows = [flat[a:b] for a, b in zip(cuts, cuts[1:])]
        cell = key[0].as_py()
        return _solve_cell(side, node, many, rows, min_cosine, cell // groups == cell % groups)

    solved = written(
        spread.repartition(min(groups * (groups + 1) // 2, 20_000), "cell").groupBy("cell").applyInArrow(lambda k, t: solve(k, t), _CELL), "vector-links"
    )
    components = connected_components(solved.select(F.col("node").alias("a"), F.col("root").alias("b")).where("a <> b"))
    degree = solved.groupBy("node").agg(F.sum("links").alias("links"))
    return (
        distinct.select("h", "h2", "node", "many")
        .join(degree, "node", "left")
        .join(components, "node", "left")
        .where("many > 1 or links is not null or component is not null")
        .select("h", "h2", "many", (F.coalesce("links", F.lit(0)) + F.col("many") - 1).alias("links"), F.coalesce("component", "node").alias("c"))
    )


def op1_collision_counting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"))


#: All pairs: for small tables.
OP1_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings),
able AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v
    WHERE len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_inner_product(a.e, b.e) / (a.n * b.n) >= {MIN_COSINE}),
reach(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b),
least AS (SELECT a, min(b) AS c FROM reach GROUP BY a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept
FROM embeddings JOIN least ON a = vec_id LEFT JOIN (SELECT a AS x, count(*) AS k FROM links GROUP BY a) ON x = vec_id
"""
