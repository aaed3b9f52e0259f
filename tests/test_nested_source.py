"""One JSON object cut at every place, beside the parsed whole."""

import gzip
import json

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from quillmark.sources import nested

ODD = {
    "a\"b": {"posts": [{"posts": 'quote " and \\ and \\\\" {[,]}', "created_utc": "1", "subreddit": None}]},
    "": {"posts": [], "comment_1": None},
    "é{": {"comment_1": [{"comment_body": "\\" * 9 + '"', "created_utc": ",", "subreddit": "}"}]},
    "z": {},
    "long": {"posts": [{"posts": "w,o{r}d\\" * 60}]},
}


def write(tmp_path, text, name="o.json"):
    (tmp_path / name).write_bytes(text.encode())
    return str(tmp_path / name)


def read(path, size, text_bytes):
    """All ranges of a file as the two passes see them, without Spark."""
    inside, depth, out = False, 0, []
    import pyarrow as pa

    for s in range(0, text_bytes, size):
        batch = pa.RecordBatch.from_pylist([{"path": f"file:{path}", "start": s, "end": s + size}])
        row = next(nested._sums([batch])).to_pylist()[0]
        out += nested._range_entries(f"file:{path}", s, s + size, inside, depth)
        depth += row["inner"] if inside else row["outer"]
        inside ^= bool(row["odd"])
    assert (inside, depth) == (False, 0)
    return [json.loads(b"{" + e + b"}") for e in out]


@pytest.mark.parametrize("indent", [None, 1])
@pytest.mark.parametrize("ascii_only", [True, False])
def test_every_length_of_range_gives_every_entry_once(tmp_path, monkeypatch, indent, ascii_only):
    text = json.dumps(ODD, indent=indent, ensure_ascii=ascii_only) + "\n"
    path = write(tmp_path, text)
    want = [{k: v} for k, v in ODD.items()]
    for block in (1, 7, 4096):
        monkeypatch.setattr(nested, "BLOCK_BYTES", block)
        for size in (1, 2, 3, 5, 17, 64, 10_000):
            assert read(path, size, len(text.encode())) == want


JSON = st.recursive(st.none() | st.booleans() | st.integers() | st.text('a"\\{}[],é '), lambda x: st.lists(x, max_size=3) | st.dictionaries(st.text('b"\\{,'), x, max_size=3), max_leaves=12)


@settings(max_examples=60, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.dictionaries(st.text('k"\\}:,'), JSON, max_size=5), st.integers(1, 40))
def test_any_object(tmp_path, value, size):
    text = json.dumps(value)
    assert read(write(tmp_path, text), size, len(text.encode())) == [{k: v} for k, v in value.items()]


def test_by_spark_with_gzip_several_files_and_empty_ones(spark, tmp_path):
    write(tmp_path, json.dumps(ODD, indent=1))
    write(tmp_path, "{}", "empty.json")
    write(tmp_path, "", "nothing.json")
    (tmp_path / "p.json.gz").write_bytes(gzip.compress(json.dumps({f"g{i}": {"posts": []} for i in range(500)}).encode()))
    got = [json.loads(r.value) for r in nested.json_entries(spark, str(tmp_path), 37).collect()]
    want = [{k: v} for k, v in ODD.items()] + [{f"g{i}": {"posts": []}} for i in range(500)]
    assert sorted(map(str, got)) == sorted(map(str, want))
