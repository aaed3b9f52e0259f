"""The trigram model against plain sums, on held-out rows, and odd texts."""

import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillmark.operators import language


def plain_buckets(text):
    c = [ord(x) for x in text.lower()]
    return [(a * 961 + b * 31 + d) % 65536 for a, b, d in zip(c, c[1:], c[2:])]


ROWS = [("en", "the cat sat on the mat with the hat"), ("en", "this is that and those are these"), ("de", "der hund und die katze sind nicht müde"), ("de", "ich weiß das nicht 𝒳𝒴𝒵"), (None, "zzz"), ("fr", None), ("fr", "le chat est là où il était")]


def test_model_is_smoothed_counts(spark):
    model = language.fit(spark.createDataFrame(ROWS, "lang string, text string").repartition(3))
    assert model.languages == ["de", "en", "fr"]
    counts = {lang: Counter(b for name, t in ROWS if name == lang and t for b in plain_buckets(t)) for lang in model.languages}
    for text in ("the dog", "die müde Katze", "𝒳𝒴𝒵 là"):
        want = [sum(math.log((counts[x][b] + 1) / (counts[x].total() + 65536)) for b in plain_buckets(text)) for x in model.languages]
        scores, n = model.scores(text)
        assert scores.tolist() == pytest.approx(want) and n == len(text) - 2
        order = sorted(zip(want, model.languages), key=lambda x: (-x[0], x[1]))
        assert model.best(text) == (order[0][1], pytest.approx((order[0][0] - order[1][0]) / n))


def test_odd_texts(spark):
    model = language.fit(spark.createDataFrame(ROWS, "lang string, text string"))
    rows = [(1, None), (2, ""), (3, "ab"), (4, "The Cat"), (5, "der hund " * 20_000), (6, "qqq")]
    got = {r.i: (r.x.lang, r.x.margin) for r in spark.createDataFrame(rows, "i int, text string").select("i", model.identify(F.col("text")).alias("x")).collect()}
    assert got[1] == got[2] == got[3] == (None, None) and got[4][0] == "en" and got[5][0] == "de"
    assert got[6][1] >= 0
    none = language.fit(spark.createDataFrame([], "lang string, text string"))
    assert none.languages == []
    one = language.fit(spark.createDataFrame(ROWS[:2], "lang string, text string"))
    assert one.best("the") == ("en", None)


def test_held_out_accuracy(spark):
    d = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    model = language.fit(d.where("doc_id % 2 = 0"))
    got = d.where("doc_id % 2 = 1").select("lang", model.language(F.col("text")).alias("found"))
    assert got.agg(F.avg((F.col("lang") == F.col("found")).cast("int"))).first()[0] > 0.95
