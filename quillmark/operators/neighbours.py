"""Distance to the k-th nearest neighbour within a set, by L1 distance over features.

Rows go to the nearest of a few centres; a centre's rows are a cell, cut into groups of bounded
size. A row's k least distances in its own group bound what it still looks for, and the
triangle inequality bounds its distance to any row of another cell from below:

- beyond the ball of the cell: d(x, c) - max d(y, c), and inside its hole: min d(y, c) - d(x, c);
- across the boundary, as y is nearer to its centre c than to the centre o of x:
  (d(x, c) - d(x, o)) / 2.

Only pairs of groups in which some row may still find something meet, and in them only rows that
may. On vectors without clusters no bound holds, and where over one in ``DENSE`` pairs of rows would
meet, larger groups of a hash meet instead, each two once, so that rows travel less. No matrix of all
distances exists anywhere.

Where groups meet, distances of components in small whole numbers bound the exact ones from below;
only pairs of rows that they don't rule out are compared in doubles.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.sources.staging import staged

from .ordered import medians

#: Rows of a group, by the expectation of a hash; two groups meet, a tile of them at a time.
GROUP_ROWS = 4096
#: Rows a centre is wanted for, and the most centres there are.
CELL_ROWS = 1024
CENTRES = 1024
#: Rows sampled for each centre.
_SAMPLE = 4
_TILE = 256
#: One in so many pairs of groups meets at most before groups are dealt anew, with more rows.
DENSE, DENSE_ROWS, _DENSE_VALUES = 8, 32_768, 1 << 21
#: Groups that meet carry rows so many times as far as groups dealt anew, at most.
_TRAVEL = 4
#: Rows that a tile meets at a time, steps of a component at least, and distances that wait.
_WIDTH, _LEAST_STEPS, _WAITING = 4096, 64, 1 << 22


def _least(d: np.ndarray, k: int) -> np.ndarray:
    return np.sort(np.partition(d, k - 1, axis=1)[:, :k], axis=1) if d.shape[1] > k else np.sort(d, axis=1)


def _l1(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out, own = np.zeros((len(a), len(b))), np.empty((len(a), len(b)))
    left, right = np.ascontiguousarray(a.T), np.ascontiguousarray(b.T)
    for j in range(a.shape[1]):
        np.subtract(left[j][:, None], right[j][None, :], out=own)
        out += np.abs(own, out=own)
    return np.divide(out, a.shape[1], out=out)


class _Rows:
    """Rows that meet in a task: exact values, and where it helps, whole numbers of steps that are
    no farther apart than the values, but for a step a component."""

    def __init__(self, x: np.ndarray):
        self.n, self.dims = x.shape
        self.exact = np.ascontiguousarray(x.T)
        self.steps = None
        most = 32_767 // max(self.dims, 1)
        if self.n and most >= _LEAST_STEPS and np.isfinite(x).all():
            # Values beyond the ends come to the ends, which only brings them nearer.
            lo, hi = np.quantile(x[:: max(1, self.n // 4096)], (0.001, 0.999), axis=0)
            self.step = float((hi - lo).max()) / most
            if self.step > 0:
                self.steps = np.ascontiguousarray(np.clip(np.rint((x - lo) / self.step), 0, most).T.astype(np.int16))

    def below(self, bound: np.ndarray) -> np.ndarray:
        """The most steps between a row and one at its bound."""
        most = np.floor(np.minimum(bound, 1e300) * (1 + 1e-9) * self.dims / self.step) + self.dims + 1
        return np.clip(most, -1, 32_767).astype(np.int16)

    def met(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Steps between rows ``a`` and ``b``."""
        out, own = np.zeros((len(a), len(b)), np.int16), np.empty((len(a), len(b)), np.int16)
        for column in self.steps:
            np.subtract(column[a][:, None], column[b][None, :], out=own)
            out += np.abs(own, out=own)
        return out

    def distances(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The distances of pairs of rows, added up as ``_l1`` does."""
        out = np.zeros(len(a))
        for column in self.exact:
            out += np.abs(column[a] - column[b])
        return out / self.dims


class _Found:
    """The k least distances of each row among those that were put here."""

    def __init__(self, k: int):
        self.k, self.rows, self.d, self.size = k, [], [], 0

    def put(self, rows: np.ndarray, d: np.ndarray) -> None:
        self.rows.append(rows)
        self.d.append(d)
        self.size += len(rows)
        if self.size > _WAITING:
            rows, d = self.least()
            self.rows, self.d, self.size = [rows], [d], 0

    def least(self) -> tuple[np.ndarray, np.ndarray]:
        rows, d = np.concatenate([np.zeros(0, np.int64), *self.rows]), np.concatenate([np.zeros(0), *self.d])
        order = np.lexsort((d, rows))
        rows, d = rows[order], d[order]
        first = np.flatnonzero(np.concatenate([[True], rows[1:] != rows[:-1]])) if len(rows) else np.zeros(0, int)
        place = np.arange(len(rows)) - np.repeat(first, np.diff(np.append(first, len(rows))))
        return rows[place < self.k], d[place < self.k]

    def table(self, ids: pa.ChunkedArray) -> pa.Table:
        rows, d = self.least()
        at, n = np.unique(rows, return_counts=True)
        ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
        return pa.table({"id": ids.take(pa.array(at, pa.int64())), "near": pa.ListArray.from_arrays(pa.array(ends), pa.array(d, pa.float64()))})


def _meet(rows: _Rows, found: _Found, bound: np.ndarray, beyond: np.ufunc, a: np.ndarray, b: np.ndarray, both: np.ndarray | None) -> None:
    """Rows ``a`` look at rows ``b``; with ``both`` those of ``b`` for which it is true look back.
    ``beyond`` compares a distance with the bound of who looks, -inf if it doesn't; a row is no
    neighbour of itself."""
    limit = rows.below(bound) if rows.steps is not None else None
    for t in range(0, len(a), _TILE):
        tile = a[t : t + _TILE]
        for u in range(0, len(b), _WIDTH):
            other = b[u : u + _WIDTH]
            back = None if both is None else both[u : u + _WIDTH]
            if limit is None:
                # No bound of whole numbers: all pairs are exact.
                i, j = (x.ravel() for x in np.broadcast_arrays(tile[:, None], other[None, :]))
                looks = [(i, j)] + ([] if back is None else [(j[back[np.arange(len(j)) % len(other)]], i[back[np.arange(len(j)) % len(other)]])])
            else:
                q = rows.met(tile, other)
                # Places in one dimension are found far sooner than in two.
                i, j = np.divmod(np.flatnonzero(q <= limit[tile][:, None]), len(other))
                looks = [(tile[i], other[j])]
                if back is not None and back.any():
                    # No step is less than none.
                    i, j = np.divmod(np.flatnonzero(q <= np.where(back, limit[other], -1)[None, :]), len(other))
                    looks.append((other[j], tile[i]))
            for x, y in looks:
                x, y = x[x != y], y[x != y]
                d = rows.distances(x, y)
                near = ~beyond(d, bound[x]) & (bound[x] > -np.inf)
                found.put(x[near], d[near])


def _matrix(column: pa.ChunkedArray | pa.Array) -> np.ndarray:
    flat = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return flat.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(flat), -1)


def _lists(rows: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, rows)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(rows) if rows else np.zeros(0), kind))


def kth_distance(vectors: DataFrame, k: int = S.NEIGHBOURS, key: str = "uid", vec: str = "vec", name: str = "d") -> DataFrame:
    """vectors (key, vec: array<double>) to key, d: the mean absolute difference to the k-th
    nearest other row; null where there are fewer others. Equal rows are neighbours like any."""
    return nearest_distances(vectors, k, key, vec).select(key, F.get("near", F.lit(k - 1)).alias(name))


def nearest_distances(vectors: DataFrame, k: int, key: str = "uid", vec: str = "vec") -> DataFrame:
    """vectors (key, vec) to key, near: the k least distances to other rows, ascending; a vector
    with a missing component has none."""
    given = vectors.select(key, F.when(F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x)), F.col(vec)).alias(vec))
    given = staged(given, "vectors")
    n, rows = given.agg(F.count(vec), F.count("*")).first()
    found = _nearest(given.where(F.col(vec).isNotNull()), n, k, key, vec)
    return found if n == rows else given.select(key).join(found, key, "left")


def _nearest(vectors: DataFrame, n: int, k: int, key: str, vec: str) -> DataFrame:
    met = meetings(vectors.select(F.col(key).alias("id"), F.col(vec).alias("v")), n, k)
    found = met.rows.select("id", "near")
    if met.pairs is not None:
        met = met._replace(pairs=staged(met.pairs, "pairs"))
        found = _across_all(met, n, k) if _dense(met, n) else found.unionAll(_across(met, k))
    merged = found.groupBy("id").agg(F.slice(F.array_sort(F.flatten(F.collect_list("near"))), 1, k).alias("near"))
    return merged.select(F.col("id").alias(key), "near")


def _dense(met: Meetings, n: int) -> bool:
    """Whether to let all groups meet: over one in ``DENSE`` pairs of groups would, and either as many
    pairs of rows, or rows would travel farther than between the larger groups."""
    pairs = met.pairs.count()
    if met.groups <= 2 or pairs * DENSE * 2 <= met.groups * (met.groups - 1):
        return False
    if pairs * 2 > _TRAVEL * met.groups * _dense_groups(met, n):
        return True
    sizes = met.rows.groupBy(F.col("cell").alias("to")).agg(F.count("*").alias("n"))
    asked = met.rows.select(F.explode("visits").alias("to")).groupBy("to").agg(F.count("*").alias("rows"))
    looks = asked.join(sizes, "to").agg(F.sum(F.col("rows") * F.col("n"))).first()[0] or 0
    return looks * DENSE > n * n


def _dense_groups(met: Meetings, n: int) -> int:
    dims = met.rows.select(F.size("v")).first()[0]
    return -(-n // max(GROUP_ROWS, min(DENSE_ROWS, _DENSE_VALUES // max(dims, 1), n // 16)))


class Meetings(NamedTuple):
    """rows (id, v, cell, g, near, bound, visits): the k least distances within the group, the
    k-th of them (infinite if there are fewer) and the cells that may hold a lesser one; pairs
    (a, b, a_cell, b_cell) of groups that meet, null if there is one group; groups in all."""

    rows: DataFrame
    pairs: DataFrame | None
    groups: int


def meetings(vectors: DataFrame, n: int, k: int) -> Meetings:
    """vectors (id, v), n of them without a null, to the rows and pairs that have to be looked at."""
    wanted = min(CENTRES, -(-n // min(CELL_ROWS, GROUP_ROWS)))
    kind = vectors.schema["id"].dataType.simpleString()
    if wanted <= 1:
        one = vectors.select("id", "v", F.lit(0).alias("cell"), F.lit(0).alias("g"))
        rows = one.groupBy("g").applyInArrow(_own(k, None), _ROWS.format(kind=kind))
        return Meetings(rows, None, min(n, 1))
    # A bounded number of rows, taken by a hash; the centres decide about work, not about results.
    sample = vectors.orderBy(F.xxhash64("id"), "id").limit(_SAMPLE * wanted).select("v").collect()
    centres = _far_apart(np.array([r.v for r in sample], float), wanted)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = _matrix(b.column("v"))
            d = np.concatenate([_l1(x[s : s + _TILE], centres) for s in range(0, len(x), _TILE)]) if len(x) else np.zeros((0, len(centres)))
            cell = d.argmin(axis=1) if len(x) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("v"), pa.array(cell, pa.int32()), pa.array(d[np.arange(len(x)), cell], pa.float64())], ["id", "v", "cell", "r"])

    placed = staged(vectors.mapInArrow(place, f"id {kind}, v array<double>, cell int, r double"), "placed")
    # One row a centre.
    sizes = placed.groupBy("cell").agg(F.count("*").alias("n"), F.min("r").alias("lo"), F.max("r").alias("hi")).orderBy("cell").collect()
    parts = [-(-s.n // GROUP_ROWS) for s in sizes]
    first = np.cumsum([0, *parts]).tolist()
    cells = placed.sparkSession.createDataFrame([(s.cell, first[i], parts[i]) for i, s in enumerate(sizes)], "cell int, first int, parts int")
    at = np.array([s.cell for s in sizes])
    shells = (centres[at], at, np.array([s.lo for s in sizes]), np.array([s.hi for s in sizes]), np.array(parts))
    own = placed.join(F.broadcast(cells), "cell").select("id", "v", "cell", (F.col("first") + F.pmod(F.xxhash64("id"), "parts")).cast("int").alias("g"))
    rows = staged(own.groupBy("g").applyInArrow(_own(k, shells), _ROWS.format(kind=kind)), "near")
    asked = rows.select("g", "cell", F.explode("visits").alias("to")).distinct()
    other = asked.join(F.broadcast(cells.withColumnRenamed("cell", "to")), "to").select(
        F.struct("g", "cell").alias("x"), F.explode(F.transform(F.sequence(F.col("first"), F.expr("first + parts - 1")), lambda h: F.struct(h.alias("g"), F.col("to").alias("cell")))).alias("y")
    )
    a, b = F.least("x", "y"), F.greatest("x", "y")
    pairs = other.where("x.g <> y.g").select(a["g"].alias("a"), b["g"].alias("b"), a["cell"].alias("a_cell"), b["cell"].alias("b_cell")).distinct()
    return Meetings(rows, pairs, first[-1])


_ROWS = "id {kind}, v array<double>, cell int, g int, near array<double>, bound double, visits array<int>"


def _far_apart(x: np.ndarray, n: int) -> np.ndarray:
    """Up to ``n`` different rows, each the farthest from those before it."""
    x = x[np.isfinite(x).all(axis=1)] if np.isfinite(x).all(axis=1).any() else x[:1]
    taken, d = [0], _l1(x, x[:1])[:, 0]
    while len(taken) < n and d.max() > 0:
        taken.append(int(d.argmax()))
        d = np.minimum(d, _l1(x, x[taken[-1:]])[:, 0])
    return x[taken]


def _own(k: int, shells: tuple[np.ndarray, ...] | None):
    """A group to the k least distances within it and the cells that each row still has to see."""

    def solve(table: pa.Table) -> pa.Table:
        x, cell = _matrix(table.column("v")), table.column("cell").to_numpy()
        near, visits = [], []
        for s in range(0, len(x), _TILE):
            tile = np.arange(s, min(s + _TILE, len(x)))
            d = _l1(x[tile], x)
            d[tile - s, tile] = np.inf
            # One entry a row is itself; it is cut before any infinite distance to others.
            least = np.sort(d, axis=1)[:, :-1] if len(x) <= k + 1 else _least(d, k)
            near.extend(least)
            if shells is not None:
                bound = least[:, k - 1] if least.shape[1] >= k else np.full(len(tile), np.inf)
                visits.extend(_to_see(x[tile], cell[tile], bound, shells))
        bounds = np.array([r[k - 1] if len(r) >= k else np.inf for r in near])
        visits = visits or [np.zeros(0, np.int32)] * len(near)
        out = {c: table.column(c) for c in ("id", "v", "cell", "g")}
        return pa.table(out | {"near": _lists(near, pa.float64()), "bound": pa.array(bounds, pa.float64()), "visits": _lists(visits, pa.int32())})

    return solve


def _to_see(x: np.ndarray, cell: np.ndarray, bound: np.ndarray, shells: tuple[np.ndarray, ...]) -> list[np.ndarray]:
    centres, at, lo, hi, parts = shells
    d = _l1(x, centres)
    home = cell[:, None] == at[None, :]
    across = (d - d[home][:, None]) / 2
    # What rounding may have added; a comparison with a number that is none keeps the cell.
    floor = np.maximum(np.maximum(d - hi, lo - d), across) - 1e-12 * (d + hi)
    see = ~(floor >= bound[:, None]) & (bound > 0)[:, None]
    see = np.where(home, (parts > 1) & (bound > 0)[:, None], see)
    return [at[row].astype(np.int32) for row in see]


def _across(met: Meetings, k: int) -> DataFrame:
    """id, near: distances below a row's bound, from each group that it looked at."""
    end = lambda side, g, to: F.struct(F.lit(side).alias("side"), F.col(g).alias("g"), F.col(to).alias("to"))
    ends = met.pairs.select("a", "b", F.inline(F.array(end(0, "a", "b_cell"), end(1, "b", "a_cell"))))
    spread = met.rows.join(ends, "g").select("a", "b", "side", "id", "v", "bound", F.array_contains("visits", F.col("to")).alias("asks"))
    kind = met.rows.schema["id"].dataType.simpleString()

    def solve(table: pa.Table) -> pa.Table:
        side, bound = table.column("side").to_numpy(), table.column("bound").to_numpy()
        asks = table.column("asks").to_numpy()
        sides = [np.flatnonzero(side == s) for s in (0, 1)]
        asking = [own[asks[own]] for own in sides]
        rows, found = _Rows(_matrix(table.column("v"))), _Found(k)
        apart = len(asking[0]) * len(sides[1]) + len(asking[1]) * len(sides[0])
        if apart < len(sides[0]) * len(sides[1]):
            for s in (0, 1):
                _meet(rows, found, bound, np.greater_equal, asking[s], sides[1 - s], None)
        else:
            # Who doesn't ask has seen all that it may find here.
            _meet(rows, found, np.where(asks, bound, -np.inf), np.greater_equal, sides[0], sides[1], asks[sides[1]])
        return found.table(table.column("id"))

    return spread.groupBy("a", "b").applyInArrow(solve, f"id {kind}, near array<double>")


def _across_all(met: Meetings, n: int, k: int) -> DataFrame:
    """id, near: distances up to a row's bound among all rows, its own group's with them. Groups of
    up to ``DENSE_ROWS`` by a hash; each first meets itself, which brings the bounds down, as what
    lies below them is compared exactly, and then each two meet once."""
    groups = _dense_groups(met, n)
    kind = met.rows.schema["id"].dataType.simpleString()
    dealt = met.rows.select("id", "v", "bound", F.pmod(F.xxhash64("id", F.lit(1)), F.lit(groups)).cast("int").alias("g"))

    def alone(table: pa.Table) -> pa.Table:
        rows, found, bound = _Rows(_matrix(table.column("v"))), _Found(k), table.column("bound").to_numpy()
        # A tile and what comes after it, so that no two rows meet twice.
        for t in range(0, rows.n, _TILE):
            tile, after = np.arange(t, min(t + _TILE, rows.n)), np.arange(min(t + _TILE, rows.n), rows.n)
            _meet(rows, found, bound, np.greater, tile, tile, None)
            _meet(rows, found, bound, np.greater, tile, after, np.ones(len(after), bool))
        at, d = found.least()
        ends = np.cumsum([0, *np.bincount(at, minlength=rows.n)])
        full = np.diff(ends) == k
        bound = bound.copy()
        bound[full] = np.minimum(bound[full], d[ends[1:][full] - 1])
        near = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(d, pa.float64()))
        return pa.table({c: table.column(c) for c in ("id", "v", "g")} | {"bound": pa.array(bound, pa.float64()), "near": near})

    own = staged(dealt.groupBy("g").applyInArrow(alone, f"id {kind}, v array<double>, g int, bound double, near array<double>"), "alone")
    others = F.filter(F.sequence(F.lit(0), F.lit(groups - 1)), lambda h: h != F.col("g"))
    ends = F.transform(others, lambda h: F.struct(F.least("g", h).alias("a"), F.greatest("g", h).alias("b")))

    def solve(table: pa.Table) -> pa.Table:
        g, bound = table.column("g").to_numpy(), table.column("bound").to_numpy()
        sides = [np.flatnonzero(g == g.min()), np.flatnonzero(g != g.min())]
        rows, found = _Rows(_matrix(table.column("v"))), _Found(k)
        if len(sides[1]):
            _meet(rows, found, bound, np.greater, sides[0], sides[1], np.ones(len(sides[1]), bool))
        return found.table(table.column("id"))

    across = own.select("id", "v", "bound", "g", F.inline(ends)).groupBy("a", "b").applyInArrow(solve, f"id {kind}, near array<double>")
    return own.select("id", "near").unionAll(across)


def train_scale_density(percentiles: DataFrame, k: int = S.NEIGHBOURS) -> DataFrame:
    """uid, g: minus the k-th neighbour's distance among rows on the training scale."""
    return kth_distance(percentiles, k).select("uid", (-F.col("d")).alias("g"))


# Why a set has no density on its own scale.
TOO_FEW, INFINITE, ALL_MISSING = "행렬 크기 또는 k 오류", "자질에 무한값 존재", "열 전체 결측"


def density_problem(long: DataFrame, ks: tuple[int, ...] = (S.NEIGHBOURS,), keys: tuple[str, ...] = ("block", "key"), value: str = "value") -> DataFrame:
    """One row: reason, why the set (uid, keys, value) has no density on its own scale, else
    null. It needs more accounts than the largest k, no infinite value and no key without any."""
    v = F.col(value)
    by_key = long.groupBy(*keys).agg(F.count(v).alias("n"), F.count_if(F.abs(v) == float("inf")).alias("infinite"))
    found = by_key.agg(F.coalesce(F.sum("infinite"), F.lit(0)).alias("infinite"), F.count_if(F.col("n") == 0).alias("empty"))
    accounts = long.agg(F.countDistinct("uid").alias("accounts"))
    reason = F.when(F.col("accounts") <= max(ks), TOO_FEW).when(F.col("infinite") > 0, INFINITE).when(F.col("empty") > 0, ALL_MISSING)
    return accounts.crossJoin(found).select(reason.alias("reason"))


def set_density(long: DataFrame, ks: tuple[int, ...] = (S.NEIGHBOURS,)) -> DataFrame:
    """long (uid, block, key, value) to uid, g_<k> for each k, reason: minus the distance to the
    k-th neighbour on the set's own scale. Where ``density_problem`` has a reason, it stands in
    every row and the densities are null."""
    reason = density_problem(long, ks).first().reason
    uids = long.select("uid").distinct()
    if reason:
        return uids.select("uid", *(F.lit(None).cast("double").alias(f"g_{k}") for k in ks), F.lit(reason).alias("reason"))
    by_uid = F.transform(F.array_sort(F.collect_list(F.struct("block", "key", "p"))), lambda x: x["p"])
    vec = self_scaled(long).groupBy("uid").agg(by_uid.alias("vec"))
    near = nearest_distances(vec, max(ks))
    return near.select("uid", *((-F.get("near", F.lit(k - 1))).alias(f"g_{k}") for k in ks), F.lit(None).cast("string").alias("reason"))


def self_scaled(long: DataFrame, keys: tuple[str, ...] = ("block", "key"), value: str = "value") -> DataFrame:
    """``long`` with p: missing values take the set's median, then average-rank percentiles
    within the set."""
    from .ranks import percent_rank

    filled = long.join(medians(long, keys, value, "_med"), list(keys)).withColumn(value, F.coalesce(value, "_med")).drop("_med")
    return percent_rank(filled, list(keys), value, "p")
