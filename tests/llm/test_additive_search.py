"""Recall against brute force, exact scores and ties, and odd rows."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import additive_search as aq


def plain_nearest(rows, asked, k=5):
    """rows (id, vector); the k nearest other rows of each asked position."""
    x = np.array([v for _, v in rows], np.float64)
    unit = x / np.linalg.norm(x, axis=1)[:, None]
    out = {}
    for i in asked:
        score = unit @ unit[i]
        others = [(-round(float(score[j]), 12), rows[j][0]) for j in range(len(rows)) if j != i]
        out[rows[i][0]] = [(n, -s) for s, n in sorted(others)[:k]]
    return out


@pytest.mark.parametrize("sf_dir", ["/root/testdata/sf0.01", "/root/testdata/sf0.1"])
def test_recall_on_the_given_tables(spark, sf_dir):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()]
    want = plain_nearest(rows, [i for i, (n, _) in enumerate(rows) if n % 50 == 0])
    got = {}
    for r in aq.op13_additive_search(spark, sf_dir).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys() and all(len(x) == 5 for x in got.values())
    hits = sum(len({n for n, _ in got[q]} & {n for n, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)
    known = dict(rows)
    for q, near in got.items():
        assert [(-s, n) for n, s in near] == sorted((-s, n) for n, s in near)
        for n, s in near:
            a, b = np.array(known[q], np.float64), np.array(known[n], np.float64)
            assert abs(s - a @ b / (np.linalg.norm(a) * np.linalg.norm(b))) < 1e-12


def test_recall_without_clusters(spark):
    """Gaussian vectors, the hardest case: a sample of a fifth of the rows fits the books."""
    x = np.random.default_rng(1).standard_normal((4000, 32))
    x[2000:] = x[:2000] + 0.4 * np.random.default_rng(2).standard_normal((2000, 32))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    asked = range(0, 4000, 40)
    want = plain_nearest(rows, asked)
    got = aq.nearest_vectors(frame, frame.where("vec_id % 40 = 0")).groupBy("query_id").agg(F.collect_set("vec_id").alias("n")).collect()
    hits = sum(len(set(r.n) & {n for n, _ in want[r.query_id]}) for r in got)
    assert hits >= 0.9 * 5 * len(want), hits / (5 * len(want))


def test_beam_search_and_lookup_tables():
    rng = np.random.default_rng(3)
    x = rng.standard_normal((600, 16))
    x /= np.linalg.norm(x, axis=1)[:, None]
    books = aq.fit_codebooks(x, books=4, words=32)
    error = lambda codes: ((x - books.decode(codes)) ** 2).sum()
    assert error(books.encode(x, 16)) < error(books.encode(x, 1))
    codes = books.encode(x)
    approx = aq.scored(books.tables(x[:5]).astype(np.float32), codes, books.norms(codes).astype(np.float32))
    made = books.decode(codes)
    assert np.allclose(approx, x[:5] @ made.T / np.linalg.norm(made, axis=1), atol=1e-5)
    assert aq.best_of(np.array([[1.0, 3, 3, 2, 3, 0]]), 2).tolist() == [[1, 2]]


def test_copies_ties_and_repeated_ids(spark):
    """A third of all rows are copies of one vector; ties go by vec_id, a query's own row stays out."""
    rng = np.random.default_rng(4)
    rows = [(i, [3.0, 4.0, 0.0]) for i in range(0, 300)] + [(300 + i, rng.standard_normal(3).tolist()) for i in range(600)]
    rows += [(100, [3.0, 4.0, 0.0]), (700, rows[400][1])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(5)
    got = {}
    for r in aq.nearest_vectors(frame, frame.where("vec_id in (0, 3, 100, 250, 400)")).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0] == [1, 2, 3, 4, 5] and got[3] == [0, 1, 2, 4, 5] and got[250] == [0, 1, 2, 3, 4]
    assert got[100] == [0, 0, 1, 1, 2, 2, 3, 3, 4, 4]  # two rows of that id, in the order of ranks
    assert got[400][0] == 700 or 700 in got[400]


def test_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, None), (50, []), (100, [0.0, 0.0]), (150, [1.0, None]), (200, [nan, 1.0]), (250, [inf, 1.0]), (300, [1.0, 0.0]), (301, [1.0, 1.0]),
            (350, [1.0, 2.0, 3.0]), (None, [1.0, 0.1]), (302, [-0.0, 1.0]), (303, [0.0, 2.0]), (400, [1e300, 1e300, 1e-300])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("score", F.lit(1)).withColumn("node", F.lit("x"))
    got = [tuple(r) for r in aq.nearest_vectors(frame, frame.where("vec_id % 50 = 0")).orderBy("query_id", "rank").collect()]
    assert [(q, r, n) for q, r, n, _ in got] == [(300, 1, 301), (300, 2, 302), (300, 3, 303), (350, 1, 400), (400, 1, 350)]
    assert got[0][3] == pytest.approx(0.5**0.5)
    assert aq.nearest_vectors(frame.limit(0)).count() == 0
    assert aq.nearest_vectors(frame.where("vec_id = 300")).count() == 0  # no other row
