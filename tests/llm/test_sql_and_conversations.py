"""Queries with SQL give DuckDB's rows; conversations of any length are packed whole."""

from collections import defaultdict
from pathlib import Path

import duckdb
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quillmark.llm import packing, registry
from tests.test_queries import rows


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, sf, name):
    con = duckdb.connect()
    for p in Path(sf).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p}')")
    got, want = registry.queries()[name](spark, sf), con.sql(registry.oracle_sql()[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want.columns, want.fetchall())


@pytest.mark.parametrize("most", [1 << 20, 50])
def test_tokens_of_a_conversation_are_placed_once(spark, monkeypatch, most):
    monkeypatch.setattr(packing, "EXAMPLE_TOKENS", most)  # pickled with the function, as tests run in this process's module
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    turns = [(c, t, "assistant" if t % 2 else "user", f"turn {t} says some words " * (1 + t % 5)) for c in range(4) for t in range(60)]
    turns += [(None, 1, "user", "alone"), (None, 1, "user", "alone"), (9, 0, None, None)]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").repartition(3)
    limits = packing.Limits(256, 8, 200)
    got = packing.pack_conversations(frame, path, 2, limits).collect()
    length = lambda text: len(library.encode(text or "", add_special_tokens=False).ids) + 1
    want, loss = defaultdict(int), defaultdict(int)
    for c, _, role, text in turns:
        want[c] += length(text)
        loss[c] += length(text) * (role == "assistant")
    placed, bears = defaultdict(list), defaultdict(int)
    for r in got:
        placed[r.conv_id].append((r.start, r.length))
        bears[r.conv_id] += r.n_loss
    assert {c: sum(n for _, n in p) for c, p in placed.items()} == dict(want) and {c: bears[c] for c in want} == {c: loss[c] for c in want}
    for c, pieces in placed.items():
        at = 0
        for start, n in sorted(pieces):
            assert c is None or start == at
            at += n
