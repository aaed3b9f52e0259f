"""Ranks, tests and scores against plain versions and hand-made cases."""

import math
import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import bootstrap, homogeneity, matching, model, neighbours, ranks, resampling, significance, worlds
from quillmark.plans import analysis, evaluation, training

few = settings(max_examples=12, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])


def average_ranks(v):
    v = np.asarray(v, float)
    return np.array([(v < x).sum() + ((v == x).sum() + 1) / 2 for x in v])


def long_of(spark, matrix, labels=None):
    """Rows of a matrix (nan: missing) to long form under one block."""
    out = []
    for i, row in enumerate(matrix):
        for j, v in enumerate(row):
            out.append((f"u{i:03d}", None if labels is None else labels[i], "F", f"k{j:02d}", None if math.isnan(v) else float(v)))
    return spark.createDataFrame(out, "uid string, label string, block string, key string, value double")


def test_rank_mean_with_ties(spark):
    df = spark.createDataFrame([(0, 0.9, 1.5), (1, 0.2, -2.0), (2, 0.7, 3.0), (3, 0.7, 0.0), (4, 0.1, -2.0)], "i int, l double, g double")
    got = [r.s for r in ranks.rank_mean(df, "l", "g").orderBy("i").collect()]
    assert got == pytest.approx([0.875, 0.1875, 0.8125, 0.5625, 0.0625])


def test_auc_with_ties(spark):
    df = spark.createDataFrame([(1, 0.2, False), (1, 0.5, False), (1, 0.5, True), (1, 0.8, True)], "k int, v double, b boolean")
    assert ranks.auc(df, ["k"], "v", F.col("b")).first().auc == pytest.approx(3.5 / 4)


@few
@given(st.lists(st.tuples(st.integers(0, 6), st.booleans()), min_size=2, max_size=40))
def test_mann_whitney_is_the_pairwise_count(spark, rows):
    df = spark.createDataFrame([(1, float(v), b) for v, b in rows], "k int, v double, b boolean")
    got = significance.mann_whitney(df, ["k"], "v", F.col("b")).first()
    x, y = [v for v, b in rows if b], [v for v, b in rows if not b]
    if not x or not y:
        assert got.u is None and got.p is None and got.delta is None
        return
    u = sum((a > c) + (a == c) / 2 for a in x for c in y)
    n, (n1, n0) = len(rows), (len(x), len(y))
    ties = sum(t**3 - t for t in np.unique([v for v, _ in rows], return_counts=True)[1])
    var = n1 * n0 / 12 * ((n + 1) - ties / (n * (n - 1)))
    z = max(0, abs(u - n1 * n0 / 2) - 0.5) / math.sqrt(var) if var > 0 else 0.0
    assert got.u == u and got.delta == pytest.approx(2 * u / (n1 * n0) - 1)
    assert abs(got.z) == pytest.approx(z) and got.p == pytest.approx(math.erfc(z / math.sqrt(2)) if var > 0 else 1.0, rel=1e-9)


def test_false_discovery_counts_a_missing_p_as_one(spark):
    p = [0.01, 0.04, 0.03, None, 0.2, 0.04]
    df = spark.createDataFrame([("F", str(i), v) for i, v in enumerate(p)], "block string, key string, p double")
    got = {r.key: r.q for r in significance.benjamini_hochberg(df, ["block"], tie=["key"]).collect()}
    filled = [1.0 if v is None else v for v in p]
    order, q, run = sorted(range(6), key=filled.__getitem__), {}, 1.0
    for rank in range(6, 0, -1):
        i = order[rank - 1]
        run = min(run, filled[i] * 6 / rank)
        q[str(i)] = run if p[i] is not None else None
    assert {k: v and round(v, 12) for k, v in got.items()} == {k: v and round(v, 12) for k, v in q.items()}


def test_effects_beside_a_baseline(spark):
    cases = [("a", True, 0.3, True, 0.3), ("b", True, 0.3, False, -0.2), ("c", True, 0.3, False, 0.1), ("d", True, 0.3, False, None), ("e", False, 0.1, True, 0.2), ("f", False, 0.1, False, 0.0), ("g", True, 0.3, False, 0.0)]
    now = spark.createDataFrame([("F", k, d, n) for k, _, _, n, d in cases], "block string, key string, delta double, notable boolean")
    base = spark.createDataFrame([("F", k, b, n) for k, n, b, _, _ in cases], "block string, key string, delta double, notable boolean")
    got = {r.key: (r.status, r.kept) for r in significance.effect_status(now, base).collect()}
    assert got == {"a": (S.STATUS_KEPT, True), "b": (S.STATUS_REVERSED, False), "c": (S.STATUS_BELOW, False), "d": (S.STATUS_UNTESTABLE, False),
                   "e": (S.STATUS_NEW, False), "f": (S.STATUS_NEITHER, False), "g": (S.STATUS_BELOW, False)}


def test_unlabelled_accounts_count_as_missing(spark):
    long = long_of(spark, [[1.0], [2.0], [3.0], [float("nan")]], ["bot", "human", S.UNLABELLED, "human"])
    got = significance.compare_groups(long.drop("label"), long.select("uid", "label").distinct()).first()
    assert (got.n1, got.n0, got.missing, got.bot_iqr) == (1, 1, 2, 0.0)


def test_the_transform_knows_training_rows_only(spark):
    nan = float("nan")
    train = long_of(spark, [[0, 0], [1, 2], [2, nan]])
    knots, medians = ranks.fit_knots(train)
    assert sorted((r.key, r.med) for r in medians.collect()) == [("k00", 1.0), ("k01", 1.0)]
    alone = {(r.key): r.p for r in ranks.apply_knots(long_of(spark, [[100, nan]]), knots, medians).collect()}
    two = {(r.uid, r.key): r.p for r in ranks.apply_knots(long_of(spark, [[100, nan], [-100, 1000]]), knots, medians).collect()}
    assert alone == {"k00": 1.0, "k01": 0.5} and {k: two[("u000", k)] for k in alone} == alone and two[("u001", "k00")] == 0.0


@few
@given(st.lists(st.integers(-5, 5), min_size=1, max_size=20), st.lists(st.floats(-7, 7), min_size=1, max_size=20))
def test_interpolation_is_numpys(spark, train, points):
    knots, medians = ranks.fit_knots(long_of(spark, [[v] for v in train]))
    got = {r.uid: r.p for r in ranks.apply_knots(long_of(spark, [[v] for v in points]), knots, medians).collect()}
    x = np.unique(train)
    r = average_ranks(train)
    p = np.array([(r[np.array(train) == v][0] - 1) / (len(train) - 1) for v in x]) if len(x) > 1 else np.array([0.5])
    want = np.clip(np.interp(points, x, p), 0, 1)
    assert [got[f"u{i:03d}"] for i in range(len(points))] == pytest.approx(want.tolist(), abs=1e-12)


@pytest.mark.parametrize("limit", [4096, 7])
def test_kth_neighbour(spark, monkeypatch, limit):
    monkeypatch.setattr(neighbours, "GROUP_ROWS", limit)
    rng = np.random.default_rng(1)
    x = np.concatenate([np.arange(12)[:, None] / 11 * np.ones((1, 3)), rng.random((20, 3)), np.zeros((3, 3))])
    df = spark.createDataFrame([(f"u{i}", r.tolist()) for i, r in enumerate(x)], "uid string, vec array<double>")
    got = {r.uid: r.d for r in neighbours.kth_distance(df).collect()}
    d = np.abs(x[:, None] - x[None]).mean(2)
    np.fill_diagonal(d, np.inf)
    assert [got[f"u{i}"] for i in range(len(x))] == pytest.approx(np.sort(d, 1)[:, 9].tolist())
    assert neighbours.kth_distance(df.limit(5)).where("d is not null").count() == 0


def test_greedy_matching_is_the_sequential_pass(spark):
    rng = random.Random(4)
    rows = [(f"b{i:03d}", "bot", round(rng.choice([2, 5, 9]) + rng.random(), 2)) for i in range(60)]
    rows += [(f"h{i:03d}", "human", round(rng.choice([2, 5, 9]) + rng.random(), 2)) for i in range(80)]
    got = {r.bot: (r.human, r.gap) for r in matching.caliper_match(spark.createDataFrame(rows, "uid string, label string, logn double"), 0.1, 5).collect()}
    humans = sorted((u, v) for u, l, v in rows if l == "human")
    bots = sorted(u for u, l, _ in rows if l == "bot")
    value = {u: v for u, _, v in rows}
    random.Random(5).shuffle(bots)
    used, want = set(), {}
    for b in bots:
        free = [(abs(v - value[b]), i, u) for i, (u, v) in enumerate(humans) if u not in used and abs(v - value[b]) <= 0.1]
        best = min(free, default=None)
        want[b] = (best[2], best[0]) if best else (None, None)
        used.add(best[2] if best else None)
    assert got == want


def test_pair_folds_keep_pairs_together():
    units = [(2 * i, 2 * i + 1) for i in range(20)]
    fold = resampling.pair_folds(units, np.array([1, 0] * 20), 5, np.random.default_rng(1))
    assert len(fold) == 40 and all(fold[a] == fold[b] for a, b in units) and sorted(np.bincount(list(fold.values()))) == [8] * 5


def test_bootstrap_auc_is_the_weighted_comparison(spark):
    rng = np.random.default_rng(2)
    rows = [(f"u{i}", bool(i % 3 == 0), float(rng.integers(0, 6))) for i in range(40)]
    scores = spark.createDataFrame(rows, "uid string, is_bot boolean, L double")
    bots, humans = sorted(u for u, b, _ in rows if b), sorted(u for u, b, _ in rows if not b)
    w = bootstrap.replayed_weights(scores, (S.EXPERIMENT, 7), 30)
    got = {r.rep: r.auc for r in bootstrap.bootstrap_auc(scores, w, ["L"]).collect()}
    wh, wb = (bootstrap.bootstrap_counts([S.EXPERIMENT, 7, k], len(x), 30) for k, x in ((1, humans), (2, bots)))
    v = {u: s for u, _, s in rows}
    c = np.array([[(v[a] > v[b]) + 0.5 * (v[a] == v[b]) for b in humans] for a in bots])
    want = ((wb @ c) * wh).sum(1) / (wb.sum(1) * wh.sum(1))
    assert [got[i] for i in range(30)] == pytest.approx(want.tolist())
    assert wh.sum(1).tolist() == [len(humans)] * 30


def test_homogeneity_is_the_matrix_version(spark):
    rng = np.random.default_rng(3)
    n = 12
    x = rng.normal(size=(2 * n, 6))
    x[:n] *= 0.5
    x[rng.random(x.shape) < 0.05] = np.nan
    x[:, 4] = np.where(np.arange(2 * n) % n < 2, 1.0, 0.0)  # median residual 0, mean above
    x[:, 5] = 3.0  # no scale
    labels = ["bot"] * n + ["human"] * n
    pairs = spark.createDataFrame([(i, f"u{i:03d}", f"u{n + i:03d}") for i in range(n)], "pair int, bot string, human string")
    out = homogeneity.homogeneity(long_of(spark, x, labels).drop("label"), pairs, n=700)
    bot = np.arange(2 * n) < n
    c = np.where(bot[:, None], np.nanmedian(x[bot], 0), np.nanmedian(x[~bot], 0))
    a = np.abs(x - c)
    s = np.where(np.nanmedian(a, 0) > 0, np.nanmedian(a, 0), np.where(np.nanmean(a, 0) > 0, np.nanmean(a, 0), np.nan))
    d = np.nanmean(np.minimum(a / s, 5), axis=1)
    got = out["ratios"].first()
    assert got.ratio == pytest.approx(np.median(d[n:]) / np.median(d[:n]))
    swap = np.random.default_rng(S.SEED).random((700, n)) < 0.5
    b, h = np.where(swap, d[n:], d[:n]), np.where(swap, d[:n], d[n:])
    perm = np.median(h, 1) / np.median(b, 1)
    assert got.n_ge == (perm >= got.ratio * (1 - 1e-12)).sum() and got.p_one == pytest.approx((got.n_ge + 1) / 701)
    assert got.n_ge_two == (np.abs(np.log(perm)) >= abs(math.log(got.ratio)) * (1 - 1e-12)).sum()
    kinds = {r.kind: r["count"] for r in out["scale_kinds"].collect()}
    assert kinds == {S.SCALE_MEDIAN: 4, S.SCALE_MEAN: 1, S.SCALE_ZERO: 1}
    assert {r.key for r in out["sparse"].where("dropped").collect()} == {"k04"}


def test_worlds(spark):
    nan = float("nan")
    x = np.array([[1.0, 5], [3, nan], [10, 20], [12, 22], [14, nan]])
    labels = ["bot", "bot", "human", "human", "human"]
    long = long_of(spark, x, labels)
    w1 = {(r.uid, r.key): r.value for r in worlds.remove_centre(long).collect()}
    assert w1[("u000", "k00")] == 11 and w1[("u000", "k01")] == 21 and w1[("u001", "k01")] is None and w1[("u004", "k00")] == 14
    donors = worlds.donor_table(spark, [("u002", "u000"), ("u003", "u001"), ("u004", "u000")])
    w2 = {(r.uid, r.key): r.value for r in worlds.transplant(long, donors, "human").collect()}
    assert w2[("u002", "k00")] == 11 and w2[("u003", "k01")] is None and w2[("u004", "k01")] == 21 and w2[("u000", "k00")] == 1 and len(w2) == 10


def test_threshold_needs_the_rounded_value_too(spark):
    df = spark.createDataFrame([(0.0104,), (0.0100,), (0.0096,), (0.011,)], "v double")
    got = df.select("v", *(c.alias(n) for c, n in zip(worlds.threshold_test(F.col("v"), "<=", 0.010), ("ok", "differs")))).collect()
    assert [(r.ok, r.differs) for r in got] == [(False, True), (True, False), (True, False), (False, False)]


def test_logistic_is_at_the_penalised_optimum(spark):
    rng = np.random.default_rng(5)
    x = rng.random((60, 3))
    y = x[:, 0] + 0.3 * rng.normal(size=60) > 0.5
    fitted = model.fit_logistic(spark.createDataFrame([(bool(b), r.tolist()) for b, r in zip(y, x)], "is_bot boolean, vec array<double>"))
    w, b = fitted
    p = 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(x.T @ (p - y) + w).max() < 1e-9 and abs((p - y).sum()) < 1e-9


def test_splits_and_subsamples(spark):
    acc = spark.createDataFrame([(f"b{i}", "bot", None) for i in range(7)] + [(f"h{i}", "human", f"s{i % 2}") for i in range(10)], "uid string, label string, source string")
    split, counts = resampling.half_split(acc)
    rows = {r.uid: r.part for r in split.collect()}
    assert len(rows) == 17 and counts["bot"] == {"all": 7, "development": 3, "confirmation": 4}
    rng, want = np.random.default_rng(S.SPLIT_SEED), set()
    for g in (sorted(f"b{i}" for i in range(7)), sorted(f"h{i}" for i in range(0, 10, 2)), sorted(f"h{i}" for i in range(1, 10, 2))):
        want |= {g[i] for i in rng.permutation(len(g))[: len(g) // 2]}
    assert {u for u, p in rows.items() if p == "development"} == want
    assert len(resampling.subsample([f"b{i}" for i in range(600)], 10, 449, 1)) == round(449 * 10 / 90)


def test_training_and_an_evaluation_set_end_to_end(spark):
    rng = np.random.default_rng(6)
    n = 30
    x = rng.normal(size=(2 * n, 5))
    x[:n] = 0.4 * x[:n] + 0.8
    labels = ["bot"] * n + ["human"] * n
    long = long_of(spark, x, labels)
    info = spark.createDataFrame([(f"u{i:03d}", labels[i], 100 + i % n) for i in range(2 * n)], "uid string, label string, n long")
    pairs = analysis.matched_pairs(info, "n").cache()
    assert pairs.count() == n
    bundle, oof, auc = training.train(long.drop("label"), pairs)
    assert oof.count() == 2 * n and auc.first().auc > 0.6
    out = evaluation.run_set(long, evaluation.EvaluationSet((501,), 501, "all", True), bundle, info.select("uid"), 40)
    got = {(r.world, r.name): (r.lo, r.point, r.hi) for r in out["auc"].collect()}
    assert {w for w, _ in got} == {"W0", "W1", "W2", "W3"} and {"L", "G", "S", "G_eval", "S_eval", "S−L"} <= {k for _, k in got}
    assert all(-1 <= lo <= hi <= 1 for lo, _, hi in got.values()) and got[("W0", "G")][1] > 0.6
    assert out["extra"].count() == S.EXTRA_DRAWS and out["derived"].count() == 2 and out["gates"].count() == 1
    p = bundle.percentiles(long)
    rows = {}
    for r in p.collect():
        rows.setdefault(r.uid, {})[r.key] = r.p
    m = np.array([[rows[f"u{i:03d}"][f"k{j:02d}"] for j in range(5)] for i in range(2 * n)])
    d = np.abs(m[:, None] - m[None]).mean(2)
    np.fill_diagonal(d, np.inf)
    g = -np.sort(d, 1)[:, 9]
    assert got[("W0", "G")][1] == pytest.approx(np.mean([(a > b) + 0.5 * (a == b) for a in g[:n] for b in g[n:]]))
    sets = evaluation.evaluation_sets()
    assert len(sets) == 23 and sum(s.worlds for s, _ in sets) == 3


def test_all_sets_take_the_rows_of_their_rule(spark, monkeypatch):
    acc = [(f"b{i:02d}", "bot", None) for i in range(40)] + [(f"h{i:02d}", "human", f"s{i % 2}") for i in range(40)]
    info = spark.createDataFrame(acc, "uid string, label string, source string")
    long = info.select("uid", F.lit("F").alias("block"), F.lit("k").alias("key"), F.lit(1.0).alias("value"))
    split, _ = resampling.half_split(info)
    conf = {r.uid for r in split.where("part = 'confirmation'").collect()}
    gone = sorted(conf)[:3]
    seen = {}

    def recorded(rows, spec, bundle, confirmation, replicates):
        seen[spec.key] = {(r.uid, r.value) for r in rows.collect()}
        return {}

    monkeypatch.setattr(evaluation, "run_set", recorded)
    evaluation.run_all(long, long.withColumn("value", F.lit(2.0)), info, spark.createDataFrame([(u,) for u in gone], "uid string"), None)
    bots = {u for u in conf if u[0] == "b"}
    source = {u: s for u, _, s in acc}
    assert {u for u, _ in seen[(501,)]} == conf and seen[(531,)] == {(u, 2.0) for u in conf}
    assert {u for u, _ in seen[(541,)]} == conf - set(gone)
    assert {u for u, _ in seen[(511,)]} == bots | {u for u in conf if source[u] == "s0"} == {u for u, _ in seen[(522,)]}
    chosen = {u for u, _ in seen[(625, 1)]}
    assert {u for u in chosen if u[0] == "h"} == conf - bots
    assert {u for u in chosen if u[0] == "b"} == set(resampling.subsample(sorted(bots), 25, 20, 1)) and len(seen) == 1 + 12 + 4 + 2


def test_reports(spark):
    from quillmark.plans import report

    auc = spark.createDataFrame([("W0", n, p, p - 0.1, p + 0.1) for n, p in (("L", 0.9), ("G", 0.8), ("S", 0.95), ("S−L", 0.05))], "world string, name string, point double, lo double, hi double")
    sub = spark.createDataFrame([(50, s, n, p, lo, 1.0) for s, lo in ((0, 0.01), (1, -0.01)) for n, p in (("S", 0.9), ("S−L", 0.1))], "level int, seed int, name string, point double, lo double, hi double")
    levels = evaluation.subsample_report(sub)
    assert tuple(levels.first()) == (50, 0.9, 0.1, 1, 2)
    gates = spark.createDataFrame([(True, False)], "m1_loose boolean, m2_loose boolean")
    tallies = spark.createDataFrame([("F", 3, 4)], "block string, kept long, base_notable long")
    text = report.report(auc, levels, gates, tallies)
    assert "| W0 | 0.900000 | 0.800000 | 0.950000 |" in text and "M1 met, M2 not met" in text and "3 of 4" in text and "1/2" in text


def test_a_monotone_map_keeps_ranks(spark):
    rows = []
    for i, (p, n) in enumerate([(3, 10), (2, 20), (5, 9), (1, 30), (4, 11)]):
        label = "bot" if i % 2 else "human"
        rows += [(f"u{i}", label, "M품사", "PUNCT", p / n), (f"u{i}", label, "R", S.RHYTHM_KEYS[1], p / (p + n))]
    long = spark.createDataFrame(rows, "uid string, label string, block string, key string, value double")
    c = significance.compare_groups(long.drop("label"), long.select("uid", "label").distinct())
    assert significance.punctuation_invariant(c).first().holds
    assert not significance.punctuation_invariant(c.withColumn("u", F.when(F.col("block") == "R", F.col("u") + 1).otherwise(F.col("u")))).first().holds


def test_a_bundle_is_the_same_after_loading(spark, tmp_path):
    rng = np.random.default_rng(8)
    long = long_of(spark, rng.random((20, 3))).withColumn("is_bot", F.col("uid") < "u010")
    bundle = model.fit_bundle(long)
    bundle.save(str(tmp_path / "b"))
    back = model.Bundle.load(spark, str(tmp_path / "b"))
    a, b = ({r.uid: r.L for r in model.score(x.model, model.vectors(x.percentiles(long))).collect()} for x in (bundle, back))
    assert a == b and len(a) == 20
