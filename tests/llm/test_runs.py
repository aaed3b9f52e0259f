"""Runs against a plain search of all lags, planted repeats, and odd rows."""

import hashlib
import random
import zlib
from fractions import Fraction

import pytest
from pyspark.sql import functions as F

from quillmark.llm import runs


def plain_runs(words, min_length=6, exponent=4):
    n, found = len(words), {}
    for q in range(1, n // exponent + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            length = j - i + q
            if length >= max(min_length, exponent * q):
                found.setdefault((i, length), q)
            i = j
    return sorted(((s, length, q) for (s, length), q in found.items()), key=lambda r: (r[0], r[2]))


def plain_planted(doc_id, text):
    words = [w for w in __import__("re").findall(r"[^\x20\x09-\x0D]+", text or "")]
    h, n = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1, len(words)
    g = h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    return words


def plain_row(doc_id, text):
    words = plain_planted(doc_id, text)
    found = plain_runs(words)
    dropped = {i for s, length, q in found for i in range(s + q, s + length)}
    best = min(found, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
    told = "".join(f"{s},{length},{q}\n" for s, length, q in found)
    sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
    head = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *head, sha(told), sha(" ".join(w for i, w in enumerate(words) if i not in dropped)))


@pytest.mark.parametrize("letters", [1, 2, 3, 6])
def test_random_words_against_all_lags(letters):
    rng = random.Random(letters)
    for _ in range(400):
        words = [b"%d" % rng.randrange(letters) for _ in range(rng.randrange(60))]
        for _ in range(rng.randrange(3)):
            a, p = rng.randrange(len(words) + 1), 1 + rng.randrange(5)
            words[a:a] = (words[:p] or [b"x"]) * rng.randrange(7)
        assert [tuple(r) for r in runs.find_runs(words)] == plain_runs(words)
        assert [tuple(r) for r in runs.find_runs(words, 2, 2)] == plain_runs(words, 2, 2)


def test_nested_and_neighbouring_runs():
    for text in ("a a a a a a", "a a a a a", "a b a b a b a b", "a b a b a b a", "a a a a a a b " * 5, "x y " * 9 + "y " * 7, "a a a b " * 6 + "a a"):
        words = text.encode().split()
        assert [tuple(r) for r in runs.find_runs(words)] == plain_runs(words), text


def test_query_against_plain_rows(spark, sf):
    got = {tuple(r) for r in runs.op11_periodic_runs(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    short = [(d, t) for d, t in docs if len(t or "") < 9000]
    want = {plain_row(d, t) for d, t in short}
    assert want <= got and len(got) == len(docs) and len(short) > len(docs) / 2
    assert sum(r[1] > 0 for r in want) > 5


def test_odd_rows(spark):
    rows = [(1, None), (None, "a " * 9), (2, ""), (2, ""), (3, "  \n\t "), (4, "  " * 8), (26, "word " * 50_000), (7, "p q\x0br\n" * 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("runs", F.lit(1)).withColumn("collapsed", F.lit("x"))
    got = runs.run_digests(runs.collapse_runs(docs.withColumn("text", runs.planted(F.col("doc_id"), F.col("text")))))
    want = sorted((plain_row(d, t) for d, t in rows if t is None or len(t) < 1000), key=repr)
    assert sorted((tuple(r) for r in got.where("doc_id is null or doc_id <> 26").collect()), key=repr) == want
    assert got.where("doc_id = 26").first().n_runs == 1
    assert runs.collapse_runs(docs.limit(0)).count() == 0


def test_long_text_of_few_words_is_done_in_parts():
    rng = random.Random(5)
    words = [b"%d" % rng.randrange(40) for _ in range(20_000)]
    words[7000:7000] = [b"%d" % (i % 9) for i in range(90)]
    assert any(r.period == 9 and r.length >= 90 for r in runs.find_runs(words))
