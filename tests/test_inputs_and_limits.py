"""Inputs from archives, caches, trained parsers, and sets that can't be scored."""

import gzip
import io
import json
import tarfile
import zipfile

import pandas as pd
import pytest
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import audit, counts, matching, neighbours, selection
from quillmark.plans import evaluation, feature_tables
from quillmark.sources import archives, readers, sinks


def made_tar(path, files):
    with tarfile.open(path, "w:gz") as t:
        for name, data in files.items():
            info = tarfile.TarInfo(name)
            info.size = len(data)
            t.addfile(info, io.BytesIO(data))


def call(i):
    rows = [{"종류": "시작"}, {"종류": "슬롯", "슬롯id": f"s{i}", "댓글": "글"}]
    return "\n".join(json.dumps(r, ensure_ascii=False) for r in rows).encode()


def test_an_archive_becomes_inputs(tmp_path):
    files = {"x/set/Users.csv": b"a,b\n", "x/raw/t.gz": b"raw", "x/a.jsonl": b"{}\n", "x/s.json": json.dumps({"설정": {"실행": 1, "라벨": "x"}}).encode()}
    files |= {f"x/calls/log_{i}.jsonl": call(i) for i in range(5)}
    plan = archives.Conversion({"users": {"/set/Users.csv": (2026, 1, 2, 3, 4, 6)}}, {"/raw/t.gz": "t.gz"}, {"/a.jsonl": "a.jsonl.gz"}, {"/s.json": "s.json.gz"}, "/calls/log_")
    redact = lambda x: {"설정": audit.redact_settings(x["설정"])}
    made_tar(tmp_path / "a.tgz", files)
    for out in ("one", "two"):
        (tmp_path / out).mkdir()
        archives.convert_archive(tmp_path / "a.tgz", tmp_path / out, plan, redact)
    names = ["users.zip", "t.gz", "a.jsonl.gz", "s.json.gz", "calls.jsonl.gz"]
    assert all((tmp_path / "one" / n).read_bytes() == (tmp_path / "two" / n).read_bytes() for n in names)
    with zipfile.ZipFile(tmp_path / "one/users.zip") as z:
        assert z.read("users/Users.csv") == b"a,b\n" and z.infolist()[0].date_time == (2026, 1, 2, 3, 4, 6)
    assert json.loads(gzip.decompress((tmp_path / "one/s.json.gz").read_bytes())) == {"설정": {"라벨": "x"}}
    records = [json.loads(x) for x in gzip.decompress((tmp_path / "one/calls.jsonl.gz").read_bytes()).splitlines()]
    assert [(r["source_file"], r["source_line"], r["slot_id"], r["comment"], r["model"]) for r in records] == [(f"log_{i}.jsonl", 2, f"s{i}", "글", None) for i in range(5)]
    expected = {n: archives.sha256(tmp_path / "one" / n) for n in names}
    archives.check_inputs(tmp_path / "two", expected)
    (tmp_path / "two/t.gz").write_bytes(b"other")
    with pytest.raises(archives.Refused, match="another hash: t.gz"):
        archives.check_inputs(tmp_path / "two", expected | {"t.gz": expected["t.gz"]})
    with pytest.raises(archives.Refused, match="missing: gone"):
        archives.check_inputs(tmp_path / "one", {"gone": "h"})
    made_tar(tmp_path / "four.tgz", {k: v for k, v in files.items() if "log_4" not in k})
    with pytest.raises(archives.Refused, match="4 call logs"):
        archives.convert_archive(tmp_path / "four.tgz", tmp_path / "one", plan, redact)
    made_tar(tmp_path / "twice.tgz", files | {"y/raw/t.gz": b"raw"})
    with pytest.raises(archives.Refused, match="2 members"):
        archives.convert_archive(tmp_path / "twice.tgz", tmp_path / "one", plan, redact)


def test_redaction_reaches_only_what_it_names():
    settings = {
        "실행": 1, "파이프라인": {"모델경로": {"pos": "/home/x/resources/en/m.pt"}, "기타": "/home/x/resources/y"}, "정제규칙": {"출처": "file", "규칙": "r"}, "모델ID표": {"비고": 1, "표": 2},
        "입력": {"12-0_py": {"sha256": "h", "path": "/home"}, "own": {"sha256": "k"}}, "라벨": "old",
    }
    before = json.dumps(settings, ensure_ascii=False)
    once = audit.redact_settings(settings, replaced={("라벨",): "new", ("없음", "x"): "y"})
    assert once == {
        "파이프라인": {"모델경로": {"pos": "en/m.pt"}, "기타": "/home/x/resources/y"}, "정제규칙": {"규칙": "r"}, "모델ID표": {"표": 2}, "입력": {"fox8_extraction_code": "h", "own": "k"}, "라벨": "new",
    }
    assert audit.redact_settings(once, replaced={("라벨",): "new"}) == once and json.dumps(settings, ensure_ascii=False) == before
    assert audit.redact_settings({}) == {} and len(audit.INPUT_NAMES) == 14


def test_cache_upserts_merge_within_a_partition(spark, tmp_path):
    kind = "uid string, fingerprint string, v int, corpus string"
    place = str(tmp_path / "cache")
    rows = lambda: sorted((r.corpus, r.uid, r.v) for r in spark.read.schema(kind).parquet(place).collect())
    sinks.upsert_cache(spark.createDataFrame([("a", "h", 1, "c1"), ("b", "h", 2, "c1"), ("a", "h", 3, "c2")], kind), place)
    assert rows() == [("c1", "a", 1), ("c1", "b", 2), ("c2", "a", 3)]
    sinks.upsert_cache(spark.createDataFrame([("a", "h2", 9, "c1"), ("z", "h", 4, "c3")], kind), place)
    assert rows() == [("c1", "a", 9), ("c1", "b", 2), ("c2", "a", 3), ("c3", "z", 4)]


def test_a_key_without_a_sign_has_an_empty_value(spark):
    c = spark.createDataFrame([("M형태", "Foo", 1), ("M형태", "Number=Plur", 1), ("M형태", "Number=Sing", 1)], "block string, key string, n long")
    assert {r.axis: r["values"] for r in counts.axis_map(c).collect()} == {"Foo": [""], "Number": ["Plur", "Sing"]}


def test_a_trained_parser_and_language_plug_in(spark):
    docs = spark.createDataFrame([("u", i, f"one two three{i % 3}") for i in range(12)] + [("v", i, "uno dos") for i in range(12)], "uid string, seq long, text string")

    def parse(texts):
        def run(batches):
            for pdf in batches:
                rows = [(u, 0, 0, k, w, "X" if k else "PUNCT", "A=1") for u, t in zip(pdf.uid, pdf.text) for k, w in enumerate(t.split())]
                yield pd.DataFrame(rows, columns=["uid", "doc", "sent", "tok", "form", "upos", "feats"])

        return texts.mapInPandas(run, S.TOKENS.replace("doc long", "doc int"))

    @F.pandas_udf("string")
    def language(text: pd.Series) -> pd.Series:
        return text.map(lambda t: "es" if "uno" in t else "en")

    assert {r.uid for r in selection.eligible(docs, language).collect()} == {"u"}
    keys = S.key_dimension(spark, {"F": ["two"], "M형태": ["A=1"], "M품사": ["X", "PUNCT"], "R": list(S.RHYTHM_KEYS)}, {"A": ["1"]})
    totals, long = feature_tables.feature_table(docs, ["two"], keys, parse=parse)
    got = {(r.uid, r.key): r.value for r in long.collect()}
    assert {r.uid: (r.docs, r.sents, r.toks, r.words) for r in totals.collect()} == {"u": (12, 12, 36, 24), "v": (12, 12, 24, 12)}
    assert got[("u", "two")] == 0.5 and got[("u", "X")] == 1.0 and got[("v", "A=1")] == 2.0 and got[("u", S.RHYTHM_KEYS[0])] == 2.0 and got[("u", S.RHYTHM_KEYS[2])] == 0.0


def test_sets_without_a_density_of_their_own_say_why(spark):
    def long(n, value=lambda i, k: float(i * 7 % 11 + k)):
        return spark.createDataFrame([(f"u{i:02d}", "F", f"k{k}", value(i, k)) for i in range(n) for k in range(2)], S.LONG)

    d = neighbours.set_density(long(14), (3, 10)).collect()
    assert len(d) == 14 and all(r.g_3 is not None and r.g_3 >= r.g_10 and r.reason is None for r in d)
    cases = {
        neighbours.TOO_FEW: long(10),
        neighbours.INFINITE: long(14, lambda i, k: float("-inf") if i == 3 else 1.0),
        neighbours.ALL_MISSING: long(14, lambda i, k: None if k else float(i)),
    }
    for reason, rows in cases.items():
        got = neighbours.set_density(rows).collect()
        assert {(r.g_10, r.reason) for r in got} == {(None, reason)} and len({r.uid for r in got}) == len(got)


def test_vectors_with_a_missing_component_have_no_distance(spark):
    rows = [(i, [float(i), None if i % 2 else 0.0]) for i in range(8)] + [(8, [float("nan"), 0.0])]
    got = {r.uid: r.d for r in neighbours.kth_distance(spark.createDataFrame(rows, "uid long, vec array<double>"), 2).collect()}
    assert all(got[i] is None for i in (1, 3, 5, 7, 8)) and got[0] == 2.0 and got[4] == 1.0
    scores = spark.createDataFrame([(0.1, float("nan"), 0.3, None, 0.1)], "L double, G double, S double, G_eval double, S_eval double")
    assert evaluation.usable(scores) == ["L", "S", "S_eval"]


def test_nested_lists_keep_their_order_and_numbers(spark):
    post = lambda body, t: {body: f"text {t}", "created_utc": t, "subreddit": "s"}
    raw = {"u": {"posts": [post("posts", "1"), {"posts": None}], "comment_1": None, "comment_2": [post("comment_body", "2")]}, "v": {"posts": None, "comment_1": [], "comment_2": None}}
    got = readers.nested_posts(spark.createDataFrame([(json.dumps(raw),)], "value string"))
    assert got.columns == ["uid", "tag_list", "seq", "ts", "text", "tag"]
    assert sorted(tuple(r) for r in got.na.fill("-").collect()) == [("u", 0, 0, "1", "text 1", "s"), ("u", 0, 1, "", "", "-"), ("u", 2, 2 << 32, "2", "text 2", "s")]


def test_islands_are_matched_as_one_pass(spark):
    rows = [(f"b{i:02d}", "bot", (i * 37 % 50) / 10) for i in range(40)] + [(f"h{i:02d}", "human", (i * 53 % 60) / 10) for i in range(45)]
    got = matching.caliper_match(spark.createDataFrame(rows, "uid string, label string, logn double"), 0.15).collect()
    order = matching.shuffled_order(sorted(u for u, l, _ in rows if l == "bot"), S.MATCH_SEED)
    value = {u: v for u, _, v in rows}
    free, want = sorted(u for u, l, _ in rows if l == "human"), {}
    for b in order:
        near = min(free, key=lambda h: (abs(value[h] - value[b]), h), default=None)
        ok = near is not None and abs(value[near] - value[b]) <= 0.15
        want[b] = near if ok else None
        if ok:
            free.remove(near)
    assert {r.bot: r.human for r in got} == want and [r.bot for r in sorted(got, key=lambda r: r.place)] == order


@pytest.mark.parametrize("merged", ["true", "false"])
def test_ranks_without_keys_go_by_ranges(spark, merged):
    from quillmark.operators import ranks

    values = [(i * 7919 % 500) // 3 for i in range(500)] + [None] * 7
    frame = spark.createDataFrame(list(enumerate(values)), "i long, v long")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", merged)
    try:
        got = {r.i: r["rank"] for r in ranks.average_rank(frame, [], "v").collect()}
        parts = ranks.value_ranks(frame, [], "v").collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    whole = [v for v in values if v is not None]
    want = {i: None if v is None else sum(x < v for x in whole) + (sum(x == v for x in whole) + 1) / 2 for i, v in enumerate(values)}
    assert got == want and {r.n for r in parts} == {500}
    both = ranks.rank_mean(spark.createDataFrame([(1, 1.0, 5.0), (2, 2.0, 5.0), (3, 3.0, 1.0)], "i long, a double, b double"), "a", "b")
    assert {r.i: r.s for r in both.collect()} == {1: 0.375, 2: 0.625, 3: 0.5} and both.columns == ["i", "a", "b", "s"]
    assert ranks.rank_mean(frame.where("false").selectExpr("i", "v as a", "v as b"), "a", "b").count() == 0
