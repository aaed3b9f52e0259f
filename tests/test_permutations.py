"""Medians under swaps by refinement, against numpy's on whole rows."""

import random

import numpy as np
import pytest

from quillmark.operators import homogeneity, permutations


def test_columns_of_the_seeded_swaps():
    whole = homogeneity.swaps(23, 40, 9)
    for first, size in ((0, 23), (0, 7), (7, 16), (22, 1)):
        assert (permutations.swap_bits(9, 40, 23, first, size) == whole[:, first : first + size]).all()


@pytest.mark.parametrize("pairs,block,bins", [(1, 512, 64), (2, 512, 64), (37, 8, 4), (38, 5, 3), (300, 64, 64)])
def test_ratios(spark, monkeypatch, pairs, block, bins):
    monkeypatch.setattr(permutations, "BLOCK", block)
    monkeypatch.setattr(permutations, "BINS", bins)
    monkeypatch.setattr(permutations, "CHUNK", 70)
    rng, n = random.Random(pairs), 200
    draw = {"F": lambda: rng.uniform(0.5, 2), "M": lambda: float(rng.randrange(1, 4))}
    rows = [(part, i * 3, draw[part](), draw[part]()) for part in draw for i in range(pairs)]
    frame = spark.createDataFrame(rows, "part string, pair long, d_bot double, d_human double").repartition(3)
    got = {(r.part, r.rep): r.ratio for r in permutations.permutation_ratios(frame, n, 5).collect()}
    assert len(got) == 2 * n
    for part in draw:
        b, h = (np.array([r[c] for r in rows if r[0] == part]) for c in (2, 3))
        s = homogeneity.swaps(pairs, n, 5)
        want = np.median(np.where(s, b, h), axis=1) / np.median(np.where(s, h, b), axis=1)
        assert [got[part, i] for i in range(n)] == pytest.approx(want.tolist(), rel=1e-12)


def test_missing_and_zero_distances(spark):
    rows = [("F", 0, 1.0, 2.0), ("F", 1, None, 2.0), ("M", 0, 0.0, 0.0), ("R", 0, 1.0, 2.0), ("R", 5, 1.0, 2.0)]
    got = permutations.permutation_ratios(spark.createDataFrame(rows, "part string, pair long, d_bot double, d_human double"), 10, 1).collect()
    assert all(r.ratio is None for r in got if r.part in "FM") and all(r.ratio for r in got if r.part == "R") and len(got) == 30
    assert permutations.permutation_ratios(spark.createDataFrame(rows, "part string, pair long, d_bot double, d_human double").limit(0), 10, 1).count() == 0
