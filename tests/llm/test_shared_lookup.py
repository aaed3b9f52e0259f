"""Lookups of keys that many rows share, and names of archive records."""

from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillmark.llm import embeddings, shared, warc
from quillmark.llm.shared import opened
from tests.llm.test_other_operators import plain_links


@pytest.mark.parametrize("kind", ["long", "binary"])
def test_heavy_light_null_and_missing_keys(spark, kind):
    keys = [1] * 3000 + [None] * 500 + [k for k in range(2, 400) for _ in range(2)] + list(range(1000, 1300))
    rows = [(i, k, k) for i, k in enumerate(keys)]
    table = [(k, k, n, f"v{k}") for k, n in Counter(keys).items() if k is not None and k < 1000]
    cast = lambda df: df.withColumn("k", F.col("k").cast("string").cast("binary")) if kind == "binary" else df
    left = cast(spark.createDataFrame(rows, "i long, k long, k2 long"))
    right = cast(spark.createDataFrame(table, "k long, k2 long, many long, v string"))
    got = shared.looked_up(left, right, ["k", "k2"], "many")
    assert got.columns == ["i", "k", "k2", "v"]
    assert {r.i: r.v for r in got.collect()} == {i: None if k is None or k >= 1000 else f"v{k}" for i, k, _ in rows}
    none = shared.looked_up(left, right.where("false"), ["k", "k2"], "many")
    assert none.count() == len(rows) and none.where("v is not null").count() == 0


@pytest.mark.parametrize("n", [1, 2, 3, 5, 8, 13, 20])
def test_small_tables_of_linked_vectors(spark, n):
    rng = np.random.default_rng(n)
    center = rng.standard_normal(64)
    rows = [(i, (center + 0.05 * rng.standard_normal(64)).tolist()) for i in range(n)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows)


def test_copies_of_one_vector(spark):
    rng = np.random.default_rng(2)
    hot = rng.standard_normal(16).tolist()
    rows = [(i, hot) for i in range(2, 900, 3)] + [(i, rng.standard_normal(16).tolist()) for i in range(0, 900, 9)] + [(i, None) for i in range(1, 300, 3)]
    got = embeddings.near_duplicate_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r.vec_id: (r.n_links, r.component_id) for r in got} == plain_links(rows)


def test_record_names_are_unique_and_revisits_refer_to_records(spark):
    big = bytearray(b"p" * 200)
    rows = [(1, "http://a", big), (2, "http://b", big), (3, "http://c", big), (None, "u", big), (None, "u", big), (7, "x", bytearray(b"q" * 150)), (7, "x", bytearray(b"q" * 150)), (8, "y", bytearray(b"q" * 150))]
    records = spark.createDataFrame(rows, "record_id long, uri string, payload binary").repartition(3)
    names, refers, targets = [], {}, {}
    for a in warc.write_archives(warc.resolve_revisits(records)).collect():
        fs, path = opened(a.uri)
        with fs.open_input_stream(path, compression=None) as f:
            for data in warc.members(f):
                head, _ = warc.parse_record(data)
                names.append(head["WARC-Record-ID"])
                if head["WARC-Type"] == "revisit":
                    refers[head["X-Record-Key"]] = head.get("WARC-Refers-To")
                    targets[head["X-Record-Key"]] = head["WARC-Refers-To-Target-URI"]
    assert len(names) == len(rows) == len(set(names))
    assert refers == {"2": f"<{warc.record_uri(1)}>", "3": f"<{warc.record_uri(1)}>", "8": None}  # two records have the id 7
    assert targets == {"2": "http://a", "3": "http://a", "8": "x"} and refers["2"] in names


def test_a_cluster_must_name_its_shared_folder(spark, monkeypatch):
    class Context:
        master = "spark://host:7077"

        def getCheckpointDir(self):
            return None

    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = Context()

    with pytest.raises(RuntimeError):
        shared.shared_dir(Session())


def test_tables_are_cleared(spark):
    kept = spark.range(5)
    frame = shared.written(kept, "test-table")
    place = shared._places[-1]
    assert frame.count() == 5
    shared.removed(spark, place)
    assert place not in shared._places


def test_operators_leave_only_the_tables_that_their_results_read(spark):
    docs = spark.createDataFrame([(i, f"some words of text number {i // 3} and more of them") for i in range(30)], "doc_id long, text string")
    from quillmark.llm import near_copies, simhash

    for made, left in ((lambda: simhash.near_duplicates(docs), 2), (lambda: near_copies.near_copies(docs), 2), (lambda: simhash.one_of_each(docs, near_copies.near_copies), 1)):
        before = len(shared._places)
        out = made()
        assert len(shared._places) == before + left
        assert out.count() > 0


def test_scores_follow_the_words_nearby(spark):
    from quillmark.llm import pii
    from quillmark.llm.spans import digests

    rows = [(1, "my visa card is 4111 1111 1111 1111"), (2, "order number 4111 1111 1111 1111"), (3, "mail a@b.co, or +1 555 010 9999"), (4, None)]
    got = {r.doc_id: r for r in digests(spark.createDataFrame(rows, "doc_id long, text string"), pii.find, pii.KINDS, pii.BASE, scores=True).collect()}
    assert (got[1].spans, got[1].scores) == ("card:16:35", "1.00") and (got[2].spans, got[2].scores) == ("card:13:32", "0.55")
    assert got[3].scores == "1.00,0.70" and (got[4].spans, got[4].scores) == ("", "")
