"""Draws by a tree, and AUCs by segments, against plain sums."""

import random

import numpy as np
import pytest

from quillmark import schema as S
from quillmark.operators import bootstrap


def plain_auc(rows, w):
    """rows (uid, is_bot, v), w (uid -> counts) to one AUC a replicate."""
    bots, humans = [(v, w[u]) for u, b, v in rows if b and v is not None], [(v, w[u]) for u, b, v in rows if not b and v is not None]
    wins = sum(x * y * ((a > b) + 0.5 * (a == b)) for a, x in bots for b, y in humans)
    return wins / (sum(x for _, x in bots) * sum(y for _, y in humans))


def weights_of(df):
    return {r.uid: np.frombuffer(bytes(r.w), np.uint8).astype(float) for r in df.collect()}


@pytest.mark.parametrize("n", [1, 2, 255, 256, 257, 1000])
def test_blocks_of_the_tree_add_up(n):
    blocks = [bootstrap.tree_counts((5, 1), n, b, 40) for b in range(-(-n // bootstrap.LEAF))]
    whole = np.hstack(blocks)
    assert whole.shape == (40, n) and (whole.sum(axis=1) == n).all()
    if n == 1000:  # about Poisson: mean 1, variance 1 - 1 / n
        assert abs(whole.var() - (1 - 1 / n)) < 0.05 and abs(np.corrcoef(whole[:, 0], whole[:, -1])[0, 1]) < 0.5
        assert (np.hstack([bootstrap.tree_counts((5, 2), n, b, 40) for b in range(4)]) != whole).any()


def test_draws_do_not_depend_on_partitions(spark):
    rows = [(f"u{i:04d}", i % 3 == 0) for i in range(1500)]
    frame = spark.createDataFrame(rows, "uid string, is_bot boolean")
    a, b = (weights_of(bootstrap.drawn_weights(frame.repartition(k), (7,), 25)) for k in (1, 6))
    assert a.keys() == {u for u, _ in rows} and all((a[u] == b[u]).all() for u in a)
    for side in (True, False):
        assert (sum(a[u] for u, x in rows if x == side) == sum(x == side for _, x in rows)).all()


@pytest.mark.parametrize("levels", [1, 4, 1000])
def test_auc_by_segments(spark, levels, monkeypatch):
    """Ties within and across tasks, missing scores, and several scores at once."""
    monkeypatch.setattr(bootstrap, "_ROWS", 37)
    monkeypatch.setattr(bootstrap, "_CHUNK", 8)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(key, False)
    rng = random.Random(levels)
    rows = [(f"u{i:04d}", rng.random() < 0.4, float(rng.randrange(levels)), rng.choice([None, 1.0, rng.random()])) for i in range(400)]
    scores = spark.createDataFrame(rows, "uid string, is_bot boolean, L double, G double").repartition(5)
    w = bootstrap.drawn_weights(scores, (3,), 20)
    known = weights_of(w)
    got = {(r.score, r.rep): r.auc for r in bootstrap.bootstrap_auc(scores, w, ["L", "G"], point=True).collect()}
    spark.conf.unset(key)
    for at, name in ((2, "L"), (3, "G")):
        own = [(r[0], r[1], r[at]) for r in rows]
        assert [got[name, i] for i in range(20)] == pytest.approx(plain_auc(own, known).tolist())
        assert got[name, -1] == pytest.approx(plain_auc(own, dict.fromkeys(known, 1.0)))
    assert len(got) == 42


def test_one_side_only_has_no_auc(spark):
    scores = spark.createDataFrame([("a", True, 1.0), ("b", True, 2.0), ("c", None, 3.0)], "uid string, is_bot boolean, L double")
    got = bootstrap.evaluate(scores, bootstrap.drawn_weights(scores.where("is_bot is not null"), (1,), 5), ["L"]).collect()
    assert [tuple(r) for r in got] == [("L", None, None, None)]


def test_a_stream_is_not_replayed_for_many(spark, monkeypatch):
    monkeypatch.setattr(bootstrap, "REPLAYED", 3)
    frame = spark.createDataFrame([(f"u{i}", i % 2 == 0) for i in range(9)], "uid string, is_bot boolean")
    with pytest.raises(Exception, match="too many for a sequential stream"):
        bootstrap.replayed_weights(frame, (S.EXPERIMENT,), 5).collect()
