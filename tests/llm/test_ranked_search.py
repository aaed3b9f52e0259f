"""Exact top k against scores of every document, for shards of any size, and odd rows."""

import math
import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from quillmark.llm import ranked_search as rs


def plain_terms(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", low)


def plain_search(docs, items, k=10):
    counted = [(d, Counter(plain_terms(t))) for d, t in docs]
    counted = [(d, c, sum(c.values())) for d, c in counted if c]
    n_docs, total = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    asked = defaultdict(set)
    for item, text in items:
        if item is not None:
            asked[item] |= set(plain_terms(text))
    out = []
    for item, terms in asked.items():
        scored = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scored.append((-s, d is not None, d or 0, d))
        out += [(item, i + 1, d, -s) for i, (s, _, _, d) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=repr)


def found(index, items, **kw):
    return sorted((tuple(r) for r in rs.search(*index, items, **kw).collect()), key=repr)


@pytest.mark.parametrize("shard", [(1 << 20, 1 << 14), (300, 1 << 14), (1 << 20, 1), (1 << 20, 3)])
def test_random_documents(spark, monkeypatch, shard):
    monkeypatch.setattr(rs, "SHARD_POSTINGS", shard[0])
    monkeypatch.setattr(rs, "SHARD_DOCS", shard[1])
    rng = random.Random(shard[0] + shard[1])
    letters = "the of Tha é über 東京 a1 zz q w e r t".split()
    docs = [(i, " ".join(rng.choices(letters, k=rng.randrange(12)))) for i in range(90)] + [(200 + i, "same words here, same") for i in range(40)]
    items = [(i, " ".join(rng.choices(letters + ["same", "absent"], k=rng.randrange(6)))) for i in range(25)]
    index = rs.build_index(spark.createDataFrame(docs, "doc_id long, text string").repartition(3))
    given = spark.createDataFrame(items, "item_id long, text string")
    assert found(index, given) == plain_search(docs, items)
    assert found(index, given, k=3) == plain_search(docs, items, 3)


def test_items_in_blocks(spark, sf, monkeypatch):
    monkeypatch.setattr(rs, "BLOCK_TERMS", 100)
    docs, items = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "benchmark"))
    want = plain_search([tuple(r) for r in docs.select("doc_id", "text").collect()], [tuple(r) for r in items.select("item_id", "text").collect()])
    assert found(rs.build_index(docs), items) == want
    monkeypatch.undo()
    assert sorted((tuple(r) for r in rs.op12_ranked_search(spark, sf).collect()), key=repr) == want


def test_few_nodes_are_opened_for_a_clear_answer():
    rng = random.Random(3)
    build = rs.ShardBuilder(rs.Collection(4000, 400_000))
    for i in range(4000):
        build.add(i, [b"w%d" % rng.randrange(500) for _ in range(99)] + [b"rare"] * (i % 1000 == 7))
    arrays = build.arrays()
    tree, lists = rs.Tree(arrays), rs.Lists(arrays)
    at = lists.ranges({b"rare", b"w1", b"w2"})
    begin, end = (np_array([at[t][i] for t in sorted(at)]) for i in (0, 1))
    opened, ones = [], tree.ones
    tree.ones = lambda level, place: (opened.append(len(place)), ones(level, place))[1]
    top = tree.top(begin, end, np_array([9000, 1000, 1000]), 4, [])
    assert sorted(k for _, k in top) == [7, 1007, 2007, 3007]
    assert sum(opened) < 4000  # ranges of terms, two places each; all nodes would be over 20,000


def np_array(x):
    import numpy as np

    return np.array(x, np.int64)


def test_odd_rows(spark):
    docs = [(1, None), (2, ""), (None, "alpha beta"), (3, "alpha beta"), (3, "alpha beta"), (4, "ALPHA " * 30_000), (5, "\x00alpha\x7fbeta_gamma"), (6, "Ünï 東京x")]
    items = [(1, "Alpha, beta"), (1, "gamma"), (2, None), (3, "nothing there"), (None, "alpha"), (4, "東京X"), (5, "")]
    given = spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1))
    frame = spark.createDataFrame(docs, "doc_id long, text string").withColumn("score", F.lit(0)).withColumn("term", F.lit("x"))
    index = rs.build_index(frame)
    assert found(index, given) == plain_search(docs, items)
    empty = rs.build_index(frame.limit(0))
    assert found(empty, given) == [] and found(index, given.limit(0)) == []
