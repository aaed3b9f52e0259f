"""Tables of few distinct vectors, which leave groups empty."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import embeddings
from tests.llm.test_other_operators import plain_links


def test_few_linked_vectors_count_each_link_once(spark):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(64)
    made = [(i, (center + 0.05 * rng.standard_normal(64)).tolist()) for i in range(60)]
    # Vectors of the first two groups only: all groups above are empty.
    group = F.pmod(F.xxhash64("embedding"), F.lit(embeddings.MIN_GROUPS))
    low = spark.createDataFrame(made, "vec_id long, embedding array<double>").where(group < 2).limit(12)
    rows = sorted((r.vec_id, list(r.embedding)) for r in low.collect())
    assert 5 <= len(rows) <= 12
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows)


@pytest.mark.parametrize("dim", [4, 8])
def test_pairs_at_the_limit_link(spark, dim):
    """Integer vectors whose cosine is 0.9 exactly, permuted and scaled."""
    rng = random.Random(dim)
    rows = []
    for i in range(200):
        # Each pair has dimensions of its own, so no others link.
        order, scale = rng.sample(range(4), 4), [rng.choice([1, 2, 3, 5, 7, 12, 1000]) for _ in range(2)]
        a, b = [0.0] * 4, [9.0, 3.0, 3.0, 1.0]
        a[order.index(0)] = float(scale[0])
        rows.append((i, a, [b[o] * scale[1] for o in order]))
    for i, a, b in rows[:40]:
        pad = [0.0] * (dim - 4)
        got = embeddings._solve_cell(np.zeros(2, int), np.array([1, 2]), np.ones(2, int), [np.array(a + pad), np.array(b + pad)], 0.9, True)
        assert got.num_rows == 2, (a, b)
        below = [x + (0.001 if i == 0 else 0) for i, x in enumerate(sorted(b))]
        less = embeddings._solve_cell(np.zeros(2, int), np.array([1, 2]), np.ones(2, int), [np.array([0.0, 0, 0, 1.0] + pad), np.array(below + pad)], 0.9, True)
        assert less.num_rows == 0
    frame = spark.createDataFrame([(0, [1.0, 0.0, 0.0, 0.0]), (1, [9.0, 3.0, 3.0, 1.0]), (2, [9.0, -3.0, 3.0, 1.01])], "vec_id long, embedding array<double>")
    assert {r.vec_id: r.n_links for r in embeddings.near_duplicate_vectors(frame).collect()} == {0: 1, 1: 1, 2: 0}


def test_large_vec_ids_are_refused(spark):
    with pytest.raises(Exception, match="2\\^61"):
        embeddings.near_duplicate_vectors(spark.createDataFrame([(1 << 61, [1.0])], "vec_id long, embedding array<double>")).collect()
