"""Near copies by five-word shingles, against all pairs compared in full."""

import random

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from quillmark.llm import near_copies

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def shingles(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def plain(rows, limit=0.8):
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if len(sets[i] & sets[j]) >= limit * len(sets[i] | sets[j]):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {d: least[root(i)] for i, (d, _) in enumerate(rows)}


def edited():
    rng = random.Random(9)
    rows = []
    for g in range(12):
        base = [f"w{rng.randrange(3000)}" for _ in range(rng.choice([30, 120, 400]))]
        rows.append(" ".join(base))
        for _ in range(6):
            copy = list(base)
            for _ in range(rng.randrange(1, max(3, len(base) // 20))):
                copy[rng.randrange(len(copy))] = f"x{rng.randrange(3000)}"
            rows.append(" ".join(copy))
    rows += ["a b", "a b", "a b c", "a b c d e", "a b c d f"]
    rng.shuffle(rows)
    return list(enumerate(rows))


def test_near_copies_are_those_of_all_pairs(spark):
    rows = edited()
    want = plain(rows)
    # Copies that differ, and documents that must stay apart, are both there.
    assert len(rows) // 6 < len(set(want.values())) < len(rows) - 15
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    for group in (near_copies.GROUP_SHINGLES, 300):  # the last divides large sets of candidates
        got = near_copies.near_copies(docs, group_shingles=group).collect()
        assert {r.doc_id: r.component_id for r in got} == want


def test_the_stage_removes_near_copies_and_keeps_the_rest(spark):
    rows = edited()
    docs = spark.createDataFrame([(d, t, "en", "s", 1) for d, t in rows] + [(None, rows[0][1], "en", "s", 1)], COLUMNS)
    got = [r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()]
    assert sorted(d for d in got if d is not None) == sorted(set(plain(rows).values())) and got.count(None) == 1


def test_similar_sets_follow_chains_and_the_limit_links():
    sets = [range(10), range(1, 10), range(100, 109), range(2, 10), range(3, 9), range(100, 104)]
    flat, starts = np.concatenate([np.array(s) for s in sets]), np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    # 10/9, 9/8 and 10/8 of ten link; 6 of 8 does not.
    assert near_copies.similar_sets(flat, starts).tolist() == [0, 0, 2, 0, 4, 5]


def test_fingerprints_propose_by_themselves(spark):
    """The pipeline's stage goes through the tries: without min-hashes they find texts a few words apart."""
    words = [f"w{i}" for i in range(2000)]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:-1])), (3, " ".join(words[::-1]))], "doc_id long, text string")
    named = near_copies.sketches(docs).select("same", F.col("doc_id").alias("node"), "fp")
    assert [set(r) for r in near_copies._trie_links(named).distinct().collect()] == [{1, 2}]
    assert {r.doc_id: r.component_id for r in near_copies.near_copies(docs).collect()} == {1: 1, 2: 1, 3: 3}
