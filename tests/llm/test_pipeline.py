"""The pipeline's stages against plain versions, and what they do with odd rows."""

import public_tokenizers
from tokenizers import Tokenizer

import corpus_pipeline
from quillmark.llm import pii
from tests.llm.test_text_operators import plain_components, plain_counts, plain_fingerprint

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def documents():
    words = [f"w{i}" for i in range(400)]
    body = lambda i, n=60: " ".join(words[(i * 37 + k * (1 + i % 7)) % 400] for k in range(n))
    rows = [(i, body(i) + (f" mail me{i}@example.com" if i % 5 == 0 else ""), "en", f"s{i % 4}", 1) for i in range(60)]
    rows += [(100 + i, body(3), "en", "s1", 1) for i in range(5)]  # exact copies
    rows += [(7, body(7), "en", "s3", 1)]  # a repeated row
    rows += [(200, None, None, None, None), (201, "", "en", None, 0), (202, "too short", "en", "s0", 9), (203, "ab " * 200, "en", "s0", 600), (None, body(90), "en", "s2", 5)]
    return rows


def plain_run(rows):
    kept = []
    for r in rows:
        c = plain_counts(r[1])
        if not (c[0] < 20 or 100 * c[4] > 30 * c[0]):
            kept.append(r)
    named = [r for r in kept if r[0] is not None]
    fps = [plain_fingerprint(r[1]) for r in named]
    root = plain_components(fps)
    least = {}
    for r, c in zip(named, root):
        least[c] = min(least.get(c, r[0]), r[0])
    one = {r[0]: r for r, c in zip(named, root) if least[c] == r[0]}
    return [*one.values(), *(r for r in kept if r[0] is None)]


def test_run_is_the_plain_pipeline(spark, tmp_path):
    rows = documents()
    spark.createDataFrame(rows, COLUMNS).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = {r[0]: len(library.encode(pii.redact(r[1]), add_special_tokens=False).ids) + 1 for r in plain_run(rows)}
    assert {r.doc_id: r.doc_tokens for r in got} == want
    lengths = {}
    for r in got:
        lengths[r.doc_id] = lengths.get(r.doc_id, 0) + r.length
    assert lengths == want


def test_stages_keep_columns_and_take_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], COLUMNS + ", kept string, _row int")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, none, str(tmp_path))
        assert out.columns == none.columns and out.count() == 0, name
    assert corpus_pipeline.STAGES[-1][1](spark, none, str(tmp_path)).count() == 0


def test_clean_documents_stay(spark, tmp_path):
    rows = [r for r in documents() if r[0] is not None and r[0] < 60]
    docs = spark.createDataFrame(rows, COLUMNS)
    assert {r.doc_id for r in corpus_pipeline.quality_rules(spark, docs, "").collect()} == {r[0] for r in rows}
    clean = docs.where("not contains(text, '@')")
    assert sorted(r.text for r in corpus_pipeline.personal_data(spark, clean, "").collect()) == sorted(r.text for r in clean.collect())


def test_a_very_long_text_passes_whole(spark, tmp_path):
    long = " ".join(f"word{i % 90_001}x{i}" for i in range(200_000)) + " reach me@example.org"
    docs = spark.createDataFrame([(1, long, "en", "s", 1), (2, long + " end", "en", "s", 1)], COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert sorted(r.doc_id for r in docs.collect()) == ([1, 2] if name == "quality_rules" else [1]), name
    assert docs.first().text == long.replace("me@example.org", "[email]")
    pieces = corpus_pipeline.packed(spark, docs, "").collect()
    assert sum(r.length for r in pieces) == pieces[0].doc_tokens > 400_000
