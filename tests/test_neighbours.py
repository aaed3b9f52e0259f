"""Neighbours by cells: which groups meet, and the distances beside all pairs."""

import numpy as np
import pytest

from quillmark.operators import neighbours


@pytest.fixture
def small_groups(monkeypatch):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 60)
    monkeypatch.setattr(neighbours, "CELL_ROWS", 30)


def frame(spark, x):
    return spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "uid long, vec array<double>").repartition(4)


def clusters(n, dims=6, seed=0):
    """n / 40 clusters of 40 rows, far from one another for their width."""
    rng = np.random.default_rng(seed)
    return np.repeat(rng.random((n // 40, dims)) * 100, 40, axis=0) + rng.random((n, dims))


def plain(x, k):
    d = np.abs(x[:, None] - x[None]).mean(2)
    np.fill_diagonal(d, np.inf)
    return np.sort(d, 1)[:, :k]


def tables():
    rng = np.random.default_rng(3)
    yield "clusters", clusters(400)
    yield "spread", rng.standard_normal((300, 5))
    yield "copies", np.concatenate([np.tile(rng.random(4), (130, 1)), rng.random((200, 4))])
    yield "one value", np.ones((200, 3))
    yield "line", np.arange(300)[:, None] * np.ones((1, 2))
    yield "large numbers", rng.integers(0, 4, (250, 3)) + 1e9


@pytest.mark.parametrize("name,x", list(tables()), ids=lambda v: v if isinstance(v, str) else "")
def test_the_k_least_are_those_of_all_pairs(spark, small_groups, name, x):
    got = {r.uid: r.near for r in neighbours.nearest_distances(frame(spark, x), 5).collect()}
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(plain(x, 5), rel=1e-12)


def test_more_neighbours_than_a_group_holds(spark, small_groups):
    x = clusters(200)
    got = {r.uid: r.near for r in neighbours.nearest_distances(frame(spark, x), 150).collect()}
    assert np.array([got[i] for i in range(len(x))]) == pytest.approx(plain(x, 150), rel=1e-12)


def test_infinite_components_keep_the_row_and_no_rows_give_none(spark, small_groups):
    x = clusters(200)
    x[7, 2] = np.inf
    got = {r.uid: r.near for r in neighbours.nearest_distances(frame(spark, x), 3).collect()}
    rest = np.delete(np.arange(200), 7)
    assert len(got) == 200
    assert np.array([got[i] for i in rest]) == pytest.approx(plain(x[rest], 3), rel=1e-12)
    assert neighbours.nearest_distances(frame(spark, x).limit(0), 3).count() == 0


def met(spark, n):
    found = neighbours.meetings(frame(spark, clusters(n)).selectExpr("uid id", "vec v"), n, 5)
    return found.pairs.count(), found.groups


def test_groups_of_other_clusters_are_skipped(spark, small_groups):
    """Four times the rows in four times the clusters: pairs that meet grow far less than the
    sixteen times of all pairs."""
    few, groups = met(spark, 800)
    assert few < groups * (groups - 1) / 2 / 2
    many, more = met(spark, 3200)
    assert more > 3 * groups and many < more * (more - 1) / 2 / 6
    assert many < 8 * few


def test_rows_without_clusters_meet_in_large_groups(spark, monkeypatch):
    """Where most groups meet, rows are dealt once for each large group, and the result is that of all pairs."""
    rng = np.random.default_rng(5)
    x = np.round(rng.normal(size=(900, 12)), 2)
    x[7] = x[8]
    dealt = []
    plain = neighbours._across_all
    monkeypatch.setattr(neighbours, "CELL_ROWS", 40)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 60)
    monkeypatch.setattr(neighbours, "_across_all", lambda *a: dealt.append(1) or plain(*a))
    got = {r.uid: r.near for r in neighbours.nearest_distances(frame(spark, x), 4).collect()}
    d = neighbours._l1(x, x)
    np.fill_diagonal(d, np.inf)
    assert dealt and all(got[u] == sorted(d[int(u)])[:4] for u in got) and len(got) == 900


def test_few_pairs_of_a_meeting_are_exact():
    """Whole numbers of steps rule out what lies beyond the bound, in both directions."""
    rng = np.random.default_rng(6)
    x = rng.normal(size=(600, 64))
    d = neighbours._l1(x, x)
    np.fill_diagonal(d, np.inf)
    bound = np.sort(d, axis=1)[:, 4]
    rows, found, asked = neighbours._Rows(x), neighbours._Found(5), []
    rows.distances = lambda a, b: asked.append(len(a)) or neighbours._Rows.distances(rows, a, b)
    a, b = np.arange(300), np.arange(300, 600)
    neighbours._meet(rows, found, bound, np.greater, a, b, np.ones(300, bool))
    row, near = found.least()
    want = [(i, v) for i in range(600) for v in sorted(d[i][(b if i < 300 else a)]) if v <= bound[i]]
    assert list(zip(row.tolist(), near.tolist())) == want and sum(asked) < 300 * 300 / 5
