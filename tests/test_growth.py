"""Steps whose work must not grow with the square of the input, or meet in one task or row."""

import re
import threading
import tracemalloc

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.functions.text import collapse
from quillmark.operators import bootstrap, counts, homogeneity, matching, model, neighbours, ordered, permutations, ranks, selection, worlds
from quillmark.plans import evaluation, feature_tables
from quillmark.queries import stats
from quillmark.sources import nested, readers, staging

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().toString()


def test_replayed_draws_come_in_pieces(spark, monkeypatch):
    """more accounts than were allowed; pieces of the stream are the stream."""
    assert bootstrap.REPLAYED > 3_000_000
    monkeypatch.setattr(bootstrap, "_DRAWN", 1000)
    frame = spark.createDataFrame([(f"{i:04d}", i < 300) for i in range(900)], "uid string, is_bot boolean")
    got = {r.uid: list(r.w) for r in bootstrap.replayed_weights(frame, (5,), 7).collect()}
    for first, n, side in ((0, 300, 2), (300, 600, 1)):
        want = bootstrap.bootstrap_counts([5, side], n, 7)
        assert [got[f"{first + i:04d}"] for i in range(n)] == want.T.tolist()


def test_draws_are_not_broadcast(spark):
    """a plan takes 2,000 counts for a few bytes."""
    scores = spark.createDataFrame([("a", True, 1.0), ("b", False, 2.0)], "uid string, is_bot boolean, L double")
    weights = scores.select("uid", F.unhex(F.lit("0001")).alias("w"))
    assert "BroadcastHashJoin" not in plan(bootstrap.bootstrap_auc(scores, weights, ["L"]))


def test_donors_come_without_a_nested_loop(spark):
    """the next row of another kind, by ranges."""
    assert "NestedLoop" not in plan(stats.transplanted(spark, SF)).replace("BroadcastNestedLoopJoin BuildRight, Cross", "")
    rng = np.random.default_rng(1)
    n = sorted(rng.choice(500, 200, False).tolist())
    rows = [(i, i if rng.random() < 0.1 else None) for i in n]
    got = {r.n: r.v_after for r in ordered.least_after(spark.createDataFrame(rows, "n long, v long"), "n", "v").collect()}
    assert got == {i: min((v for m, v in rows if m > i and v is not None), default=None) for i in n}


def test_candidates_of_one_bucket_are_dealt_out(spark):
    """accounts of one length fill many tasks."""
    a = spark.range(400).select(F.col("id").cast("string").alias("uid"), F.lit(5.0).alias("logn"))
    found = matching.candidates(a.where("id < 100"), a.where("id >= 100"))
    assert found.count() == 100 * 300 and "_s" in plan(found)


def test_tokens_stay_with_their_text(spark):
    """Documents of a text are passed on with it; sentences are counted in their row."""
    docs = spark.createDataFrame([("a", 1, "One two. Three!"), ("b", 2, "One two. Three!"), ("a", 3, "it's 'so' 5"), ("c", 4, "")], "uid string, seq long, text string")
    named = docs.withColumn("doc", F.col("seq"))
    want = counts.tokenize(named.where("text <> ''").select("uid", "doc", "text"))
    once = feature_tables.parse_once(docs)
    assert "SortMergeJoin" not in plan(once) and "HashJoin" not in plan(once)
    assert sorted(map(tuple, once.select(want.columns).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    rows = counts.sentence_counts(named)
    assert sorted(map(tuple, rows.collect())) == sorted(map(tuple, counts.sentence_lengths(want).collect())) and "Exchange" not in plan(rows)


def test_forms_are_tagged_once(spark):
    """A form is one row an account, with the same counts."""
    docs = spark.createDataFrame([("a", 1, "the the the dogs. walked!"), ("b", 2, "The dog's")], "uid string, doc long, text string")
    forms = counts.forms(docs)
    assert forms.where("form = 'the'").count() == 1
    want = counts.feature_counts(counts.tokenize(docs), ["the"])
    assert sorted(map(tuple, counts.feature_counts(forms, ["the"]).collect())) == sorted(map(tuple, want.collect()))


def test_multisets_are_read_once(spark):
    """F19"""
    a = spark.createDataFrame([(1, None), (1, None), (2, "x")], "n long, s string")
    assert selection.same_elements(a, a.orderBy(F.desc("n"))).first().equal
    assert not selection.same_elements(a, a.distinct().union(a.where("n = 2"))).first().equal
    assert "BroadcastNestedLoop" not in plan(selection.same_elements(a, a)) and plan(selection.same_elements(a, a)).split("== Physical")[1].count("ExistingRDD") == 2


def test_lines_are_numbered_by_splits(spark, tmp_path):
    """no window gets a file's lines."""
    (tmp_path / "a.txt").write_text("".join(f"line {i}\n" for i in range(5000)))
    (tmp_path / "b.txt").write_text("x\ny\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    try:
        rows = readers.numbered_lines(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5002 and all(r.source_line == int(r.value.split()[1]) + 1 for r in rows if r.f.endswith("a.txt"))
    assert sorted((r.source_line, r.value) for r in rows if r.f.endswith("b.txt")) == [(1, "x"), (2, "y")]


def test_blocks_of_a_nested_file_are_small(tmp_path):
    """what a range needs beside its entries."""
    path = tmp_path / "n.json"
    path.write_text("{" + ",".join(f'"{i}": {{"posts": [{{"posts": "{"a word, " * 100}"}}]}}' for i in range(8000)) + "}")
    tracemalloc.start()
    assert sum(1 for _ in nested._range_entries(str(path), 0, 1 << 62, False, 0)) == 8000
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 40e6


@pytest.mark.parametrize("text,want", [(" a  b\t\tc \n", "a b c"), (" x  y", "x y"), ("", ""), ("  ", ""), ("a b", "a b")])
def test_white_space(spark, text, want):
    """single spaces are left where they are."""
    assert spark.createDataFrame([(text,)], "t string").select(collapse(F.col("t"))).first()[0] == want


def _staged_frames(monkeypatch, *modules):
    """(label, frame given, frame read back) of what these modules stage from now on."""
    out = []

    def staged(df, label, own=staging.staged):
        out.append((label, df, own(df, label)))
        return out[-1][2]

    for module in modules:
        monkeypatch.setattr(module, "staged", staged)
    return out


@pytest.mark.parametrize("kind", ["distinct", "tied"])
def test_swaps_are_dealt_out_and_few_are_kept(spark, monkeypatch, kind):
    """draws of small shuffles are not left to one task; only pairs near the middle keep theirs."""
    rng, n, pairs = np.random.default_rng(3), 200, 3000
    b, h = rng.uniform(1, 2, (2, pairs)) if kind == "distinct" else rng.integers(1, 2000, (2, pairs)).astype(float)
    frames = _staged_frames(monkeypatch, permutations)
    rows = [(part, i, float(b[i]), float(h[i])) for part in "FR" for i in range(pairs)]
    got = {(r.part, r.rep): r.ratio for r in permutations.permutation_ratios(spark.createDataFrame(rows, "part string, pair long, d_bot double, d_human double"), n, 5).collect()}
    (swaps,) = (back for label, _, back in frames if label == "swaps")
    assert len(swaps.inputFiles()) >= 4
    assert swaps.agg(F.sum(F.length("bits"))).first()[0] < 2 * pairs * n / 8 / 2
    s = homogeneity.swaps(pairs, n, 5)
    want = np.median(np.where(s, b, h), axis=1) / np.median(np.where(s, h, b), axis=1)
    for part in "FR":
        assert [got[part, i] for i in range(n)] == pytest.approx(want.tolist(), rel=1e-12)


def test_medians_outside_the_first_window(spark, monkeypatch):
    """where a median lies outside, the window grows until none does."""
    monkeypatch.setattr(permutations, "REACH", 0.01)
    frames = _staged_frames(monkeypatch, permutations)
    b, h = np.random.default_rng(4).uniform(1, 2, (2, 301))
    rows = [("F", i, float(b[i]), float(h[i])) for i in range(301)]
    got = {r.rep: r.ratio for r in permutations.permutation_ratios(spark.createDataFrame(rows, "part string, pair long, d_bot double, d_human double"), 50, 5).collect()}
    assert sum(label == "swaps" for label, *_ in frames) > 1
    s = homogeneity.swaps(301, 50, 5)
    want = np.median(np.where(s, b, h), axis=1) / np.median(np.where(s, h, b), axis=1)
    assert [got[i] for i in range(50)] == pytest.approx(want.tolist(), rel=1e-12)


def test_accounts_are_read_once_to_be_matched(spark, monkeypatch):
    """texts that accounts come from are not read by each side and its sampling."""
    frames = _staged_frames(monkeypatch, matching, ordered)
    a = spark.range(60).select(F.col("id").cast("string").alias("uid"), F.when(F.col("id") % 3 == 0, "bot").otherwise("human").alias("label"), F.log(F.col("id") + 9.0).alias("logn"))
    assert matching.caliper_match(a).count() == 20
    assert [label for label, df, _ in frames if "Range (0, 60" in plan(df)] == ["accounts"]


def test_knots_need_no_frame_up_to_the_last_row(spark):
    """such a frame is added up anew for each row of a range."""
    rng = np.random.default_rng(8)
    train, held = ([("F", "k", float(v)) for v in rng.integers(0, 60, n)] for n in (40, 300))
    train, held = (spark.createDataFrame(rows, "block string, key string, value double") for rows in (train, held))
    knots, medians = ranks.fit_knots(train)
    found = ranks.apply_knots(held, knots, medians)
    assert not re.search(r"rowframe, (currentrow\$\(\)|\d+), unboundedfollowing", plan(found).lower())
    k = sorted((r.x, r.p) for r in knots.collect())
    got = found.collect()
    assert len(got) == 300 and [r.p for r in got] == pytest.approx(np.interp([r.value for r in got], *zip(*k)).tolist(), abs=1e-12)


def test_neighbours_of_a_set_are_found_once(spark, monkeypatch):
    """ranks of the densities read what was found."""
    rng = np.random.default_rng(9)
    rows = [(f"u{i:02d}", "bot" if i % 2 else "human", "F", f"k{j}", float(rng.normal())) for i in range(40) for j in range(3)]
    long = spark.createDataFrame(rows, "uid string, label string, block string, key string, value double")
    bundle = model.fit_bundle(long.withColumn("is_bot", F.col("label") == "bot"))
    p = evaluation.percentiles(long, bundle)
    frames = _staged_frames(monkeypatch, evaluation, ordered)
    assert evaluation.scored(long, p, bundle).where("S is not null and S_eval is not null").count() == 40
    assert [label for label, df, _ in frames if "FlatMapGroupsInArrow" in plan(df)] == ["densities"]


def test_groups_with_many_neighbours_are_not_dealt_anew_for_a_few_rows(spark, monkeypatch):
    """in a plane over one in eight pairs of groups meet, but few of their rows look."""
    monkeypatch.setattr(neighbours, "CELL_ROWS", 100)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 100)
    x = np.random.default_rng(10).uniform(size=(2000, 2))
    vec = spark.createDataFrame([(f"{i:04d}", row.tolist()) for i, row in enumerate(x)], "uid string, vec array<double>")
    met = neighbours.meetings(vec.select(F.col("uid").alias("id"), F.col("vec").alias("v")), 2000, 3)
    assert met.pairs.count() * neighbours.DENSE * 2 > met.groups * (met.groups - 1) and not neighbours._dense(met, 2000)
    monkeypatch.setattr(neighbours, "_across_all", None)
    got = {r.uid: r.d for r in neighbours.kth_distance(vec, 3).collect()}
    d = np.sort(np.abs(x[:, None] - x[None]).mean(2), axis=1)[:, 3]
    assert [got[f"{i:04d}"] for i in range(2000)] == pytest.approx(d.tolist(), rel=1e-12)


def test_worlds_go_side_by_side():
    """no world waits for another's jobs; a failure is passed on."""
    both = threading.Barrier(2, timeout=20)
    evaluation._together([both.wait, both.wait])
    with pytest.raises(ZeroDivisionError):
        evaluation._together([lambda: 1 / 0, lambda: 1])


def test_multiples_of_a_spread_look_for_no_neighbours(spark, monkeypatch):
    """each group's neighbours are found once, not for each world; the figures are those of the worlds."""
    asked = []
    monkeypatch.setattr(worlds, "kth_distance", lambda *a, own=worlds.kth_distance: asked.append(1) or own(*a))
    got = stats.gates(spark, SF).first()
    assert len(asked) == 2
    p = stats.vectors_long(spark, SF).select("uid", "label", "block", "key", F.coalesce("value", F.lit(0.0)).alias("p"))
    times = {"W0": 1.0, "W2": -1.5}
    spreads = {(r.world, r.label): (r.sd, r.nn) for r in worlds.multiplied(worlds.spread(p), "bot", times).collect()}
    for w, f in times.items():
        for r in worlds.spread(p.withColumn("p", F.when(F.col("label") == "bot", F.col("p") * f).otherwise(F.col("p")))).collect():
            assert spreads[w, r.label] == pytest.approx((r.sd, r.nn), rel=1e-12)
    assert got.m1_sd == pytest.approx(abs(1.02 * spreads["W0", "bot"][0] - spreads["W0", "human"][0]), abs=1e-6)


def test_large_groups_bring_their_own_bounds_down(spark, monkeypatch):
    """what lies below the bound of a small group was compared exactly with all rows."""
    for name, rows in (("CELL_ROWS", 40), ("GROUP_ROWS", 60), ("DENSE_ROWS", 300)):
        monkeypatch.setattr(neighbours, name, rows)
    monkeypatch.setattr(neighbours, "_dense_groups", lambda met, n: 3)
    frames = _staged_frames(monkeypatch, neighbours)
    x = np.random.default_rng(11).normal(size=(900, 12))
    vec = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(x)], "uid long, vec array<double>")
    got = {r.uid: r.near for r in neighbours.nearest_distances(vec, 4).collect()}
    d = neighbours._l1(x, x)
    np.fill_diagonal(d, np.inf)
    assert all(got[i] == sorted(d[i])[:4] for i in range(900))
    (own,) = (back for label, _, back in frames if label == "alone")
    group = {r.id: (r.g, r.bound) for r in own.select("id", "g", "bound").collect()}
    for i, (g, bound) in group.items():
        inside = np.sort(d[i][[j for j in group if group[j][0] == g]])
        assert bound <= inside[3] + 1e-12


def test_who_stays_in_a_world_is_not_looked_at_again(spark, monkeypatch):
    """of four worlds' eight groups, three move."""
    seen, spread = [], worlds.spread
    monkeypatch.setattr(worlds, "spread", lambda p, labels: seen.append(labels) or spread(p, labels=labels))
    rng = np.random.default_rng(12)
    rows = [(f"u{i:02d}", "bot" if i % 2 else "human", "F", f"k{j}", float(rng.normal())) for i in range(40) for j in range(3)]
    long = spark.createDataFrame(rows, "uid string, label string, block string, key string, value double")
    bundle = model.fit_bundle(long.withColumn("is_bot", F.col("label") == "bot"))
    out = evaluation.run_set(long, evaluation.EvaluationSet((501,), 501, "all", True), bundle, long.select("uid").distinct(), 10)["spread"]
    got = {(r.world, r.label): (r.sd, r.nn) for r in out.collect()}
    assert seen == [("bot", "human"), ("bot",), ("human",), ("bot",)] and len(got) == 8
    for r in spread(bundle.percentiles(worlds.remove_centre(long))).collect():
        assert got["W1", r.label] == pytest.approx((r.sd, r.nn), rel=1e-12)
