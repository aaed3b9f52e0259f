"""Cleaning, selection, counts, sources, sinks and audits on hand-made cases."""

import gzip
import io
import json
import tarfile

import pytest
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.numeric import even_round
from quillmark.functions.text import clean_document, reformat_tweet_time, strip_truncated_tail, year_or_unknown
from quillmark.operators import audit, counts, features, selection
from quillmark.plans import feature_tables, report
from quillmark.sources import archives, readers, sinks


def one(spark, text, expr):
    return spark.createDataFrame([(text,)], "t string").select(expr(F.col("t")).alias("c")).first().c


def test_cleaning(spark):
    got = one(spark, "This is a sufficiently long example sentence. https://example.org @example", clean_document)
    assert got.text == "This is a sufficiently long example sentence." and got.reason is None and not got.excised
    cut = one(spark, "As an AI language model I stop. This sentence is long enough to stay.\n\nI’m here", clean_document)
    assert cut.text == "This sentence is long enough to stay. I’m here" and cut.excised
    for text, reason in ((None, S.REASON_EMPTY), ("", S.REASON_EMPTY), ("I'm sorry, but I cannot go on", S.REASON_NOTHING_LEFT), ("too short", S.REASON_SHORT), ("openai policy. so short", S.EXCISED_PREFIX + S.REASON_SHORT)):
        got = one(spark, text, clean_document)
        assert (got.text, got.reason) == (None, reason)
    assert one(spark, "é" * 20, clean_document).text == "é" * 20
    assert one(spark, "é" * 19, clean_document).reason == S.REASON_SHORT


def test_truncated_tails(spark):
    for text, want, cut in (("a b cut…", "a b", True), ("…", "", True), ("a…b", "a…b", False), ("a …", "a", True), ("", "", False)):
        got = one(spark, text, strip_truncated_tail)
        assert (got.text, got.cut) == (want, cut)


def test_times(spark):
    assert one(spark, "Wed Oct 10 20:19:24 +0900 2018", reformat_tweet_time) == "2018-10-10 20:19:24"
    assert [one(spark, t, year_or_unknown) for t in ("2023-01-01", "n/a", None, "202", "20x3")] == ["2023", "?", "?", "?", "?"]


def test_rounding_is_of_the_exact_value(spark):
    df = spark.createDataFrame([(1 / 128,), (1 / 640,), (3 / 640,), (None,)], "v double")
    assert [r[0] for r in df.select(even_round(F.col("v"), 6)).collect()] == [0.007812, 0.001563, 0.004687, None]


def test_latest_documents_keep_list_order_among_equal_times(spark):
    rows = [("a", i, "2020" if i < 5 else "2021") for i in range(10)]
    df = spark.createDataFrame(rows, "uid string, seq long, ts string")
    assert sorted(r.seq for r in selection.latest_posts(df, 7).collect()) == [3, 4, 5, 6, 7, 8, 9]
    tweets = spark.createDataFrame([("a", 0, "n/a"), ("a", 1, "2023-01-01"), ("a", 2, "2022-01-01"), ("a", 3, None)], "uid string, seq long, ts string")
    assert sorted(r.seq for r in selection.latest_tweets(tweets, 2).collect()) == [0, 3]


def test_eligibility(spark):
    rows = [("en", i, "the and of to in is that it was for") for i in range(10)] + [("de", i, "der die und das ist nicht von") for i in range(12)] + [("few", i, "the and of") for i in range(9)]
    df = spark.createDataFrame(rows, "uid string, seq long, text string")
    assert {r.uid for r in selection.eligible(df).collect()} == {"en"}
    assert {r.uid for r in selection.eligible(df, None).collect()} == {"en", "de"}


def test_alignment_and_sets(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "uid string, a int")
    b = spark.createDataFrame([("x", 3), ("y", 4)], "uid string, b int")
    assert selection.align(a, b).count() == 2
    with pytest.raises(Exception, match="one table only"):
        selection.align(a, b.where("uid = 'x'")).collect()
    assert selection.same_elements(a, a).first().equal and not selection.same_elements(a, a.limit(1)).first().equal


def test_ratios_and_rhythm(spark):
    keys = S.key_dimension(spark, {"M형태": ["Tense=Past", "Tense=Pres", "Voice=Pass"], "R": list(S.RHYTHM_KEYS)}, {"Tense": ["Past", "Pres"], "Voice": ["Pass"]})
    c = spark.createDataFrame([("a", "M형태", "Tense=Past", 3), ("a", "M형태", "Tense=Pres", 7), ("a", "M형태", "Voice=Pass", 2), ("b", "M형태", "Voice=Pass", 2)], "uid string, block string, key string, n long")
    totals = spark.createDataFrame([("a", 1, 5, 30, 20), ("b", 1, 5, 30, 20), ("z", 1, 0, 0, 0)], "uid string, docs long, sents long, toks long, words long")
    toks = [("a", 0, s, t, "w" if t < 4 else ".", "NOUN" if t < 4 else "PUNCT", None) for s in range(5) for t in range(6)]
    toks += [("b", 0, s, t, "w" if t < 5 else ".", "NOUN" if t < 5 else "PUNCT", None) for s in range(4) for t in range(6)]
    tokens = spark.createDataFrame(toks, S.TOKENS)
    got = {(r.uid, r.key): r.value for r in features.assemble(totals, c, counts.rhythm(counts.sentence_lengths(tokens)), keys).collect()}
    assert [got[("a", k)] for k in ("Tense=Past", "Tense=Pres", "Voice=Pass")] == pytest.approx([0.3, 0.7, 0.1])
    assert [got[("b", k)] for k in ("Tense=Past", "Tense=Pres", "Voice=Pass")] == [None, None, 0.1]
    assert [got[("a", k)] for k in S.RHYTHM_KEYS] == pytest.approx([4, 1 / 3, 0]) and got[("b", S.RHYTHM_KEYS[2])] is None
    assert got[("z", "Voice=Pass")] is None and got[("z", S.RHYTHM_KEYS[0])] is None


def test_equal_texts_are_tokenized_once(spark):
    docs = spark.createDataFrame([("a", 0, "One two. Three!"), ("b", 1, "One two. Three!"), ("b", 2, "")], "uid string, seq long, text string")
    tokens = feature_tables.parse_once(docs)
    assert tokens.where("uid = 'b'").count() == tokens.where("uid = 'a'").count() == 5
    totals = {r.uid: (r.docs, r.sents, r.toks, r.words) for r in counts.account_totals(docs, counts.sentence_lengths(tokens)).collect()}
    assert totals == {"a": (1, 2, 5, 3), "b": (2, 2, 5, 3)}


def test_function_words_are_counted_with_folded_apostrophes(spark):
    tokens = spark.createDataFrame([("a", 0, 0, 0, "Don’t", "AUX", "A=1|B=2"), ("a", 0, 0, 1, "!", "PUNCT", None)], S.TOKENS)
    got = {(r.block, r.key): r.n for r in counts.feature_counts(tokens, ["don't", "!"]).collect()}
    assert got == {("F", "don't"): 1, ("F", "!"): 1, ("M품사", "AUX"): 1, ("M품사", "PUNCT"): 1, ("M형태", "A=1"): 1, ("M형태", "B=2"): 1}


def test_conllu_and_labels(spark, tmp_path):
    (tmp_path / "x.conllu").write_text("# c\n1\tThe\tthe\tDET\t_\n2-3\tdon't\t_\t_\n3.1\tx\tx\tX\n\n2\tshort\n4\tdog\tdog\tNOUN\n")
    assert [(r.word, r.upos) for r in readers.conllu_words(spark, str(tmp_path / "x.conllu")).collect()] == [("The", "DET"), ("dog", "NOUN")]
    (tmp_path / "u.csv").write_text('user_id,character_setting\na," "\nb,"said ""x"""\nc,\n')
    assert {r.uid: r.label for r in readers.post_labels(spark, str(tmp_path / "u.csv")).collect()} == {"a": "human", "b": "bot", "c": "human"}


def test_a_present_null_key_is_not_an_absent_one(spark):
    base = {"id": 5, "created_at": "Wed Oct 10 20:19:24 +0000 2018"}
    tweets = [dict(base, full_text="f", text="t"), dict(base, text="RT @x"), dict(base, text="t", retweeted_status=None), dict(base, id_str="9", in_reply_to_status_id=3, entities={"hashtags": [{}, {}]})]
    line = json.dumps({"user_id": "u", "label": "bot", "dataset": "d", "user_tweets": tweets})
    lines = spark.createDataFrame([(line, 0)], "value string, line long")
    got = readers.normalised_tweets(readers.tweet_accounts(lines)).orderBy("pos").collect()
    assert [(r.tweet_id, r.text, r.is_retweet, r.is_reply, r.hashtag_count) for r in got] == [("5", "f", 0, 0, 0), ("5", "RT @x", 1, 0, 0), ("5", "t", 1, 0, 0), ("9", "", 0, 1, 2)]
    assert readers.tweet_accounts(lines).first().n == 4


def test_wide_tables_round_trip(spark, tmp_path):
    long = spark.createDataFrame([("a", "F", "x|y", 0.1), ("a", "R", "k", None), ("b", "F", "x|y", 1e-7), ("b", "R", "k", 3.0)], S.LONG)
    info = spark.createDataFrame([("a", "bot", 3), ("b", "human", 4)], "uid string, label string, n long")
    sinks.write_wide(features.to_wide(long, [("F", "x|y"), ("R", "k")], info), str(tmp_path / "t"), "gzip")
    back, flat = readers.read_long(spark, str(tmp_path / "t"), [("label", "string"), ("n", "long")])
    assert sorted(tuple(r) for r in back.collect()) == [("a", "bot", 3), ("b", "human", 4)]
    assert sorted(map(repr, (tuple(r) for r in flat.collect()))) == sorted(map(repr, (tuple(r) for r in long.collect())))
    kinds = spark.createDataFrame([("1", "1.5", "x"), ("-2", "", "1")], "a string, b string, c string").agg(*(readers.infer_column(F.col(c)).alias(c) for c in "abc")).first()
    assert tuple(kinds) == ("long", "double", "string")


def test_store_and_cache(spark, tmp_path):
    users = spark.createDataFrame([("u", "bot", "d", 2)], S.USERS)
    tweet = ("1", "u", "bot", "2020-01-01 00:00:00", "t", 0, 0, 0, 0, 0, 0, 0, 0, "")
    tweets = spark.createDataFrame([tweet, ("2", *tweet[1:5], 1, *tweet[6:])], S.TWEETS)
    sinks.write_store(users, tweets, str(tmp_path / "s"))
    assert readers.stored_tweets(spark, str(tmp_path / "s")).count() == 1 and readers.stored_users(spark, str(tmp_path / "s")).count() == 1
    assert sinks.same_store(spark.read.parquet(str(tmp_path / "s/tweets")), tweets).first().equal
    cache = spark.createDataFrame([("c1", "a", "h1", 1), ("c2", "a", "h1", 2)], "corpus string, uid string, fingerprint string, v int")
    new = spark.createDataFrame([("c1", "a", "h2", 3)], cache.schema)
    assert sorted(r.v for r in sinks.merge_cache(cache, new).collect()) == [2, 3]
    sinks.put_cache(cache, str(tmp_path / "c"))
    sinks.put_cache(new, str(tmp_path / "c"))
    assert sorted(r.v for r in spark.read.parquet(str(tmp_path / "c")).collect()) == [2, 3]
    hits, misses = audit.reuse_cached(spark.createDataFrame([("c1", "a", "h1"), ("c2", "a", "zz")], "corpus string, uid string, fingerprint string"), cache)
    assert hits.count() == 1 and misses.count() == 1


def test_small_files(tmp_path):
    out = sinks.Results(tmp_path / "results")
    assert json.loads(out.json("a/x.json", {"v": float("nan"), 1: (2.0, float("inf"))}).read_text()) == {"v": None, "1": [2.0, None]}
    with pytest.raises(PermissionError):
        out.text("../x.txt", "no")


def test_tree_comparison(spark):
    expected = {"a": {"b": 1.0, "c": "x", "d": [1, 2]}, "n": None, "집합": {"501": {"W2": 1.0, "W0": 1.0}}}
    actual = {"a": {"b": 1.0 + 1e-12, "c": "y", "d": [1], "extra": 3}, "n": None, "집합": {"501": {"W2": 1.0001, "W0": 1.0001}}}
    got = {r.path: r.problem for r in audit.tree_diff(audit.leaves(spark, actual), audit.leaves(spark, expected)).collect()}
    assert got == {"/a/c": "text", "/a/d/#": "number", "/a/d/1": "missing", "/집합/501/W2": "number", "/집합/501/W0": "number"}
    full = {"evaluation": expected}
    v = report.verification(audit.leaves(spark, {"evaluation": {**expected, "집합": {"501": {"W2": 1.0001, "W0": 1.0}}}}), audit.leaves(spark, full)).first()
    assert not v.passed or v.loose == 1


def test_hashes_and_redaction(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    found = audit.file_hashes(spark, str(tmp_path / "a.bin"))
    good = archives.sha256(tmp_path / "a.bin")
    manifest = spark.createDataFrame([("a.bin", good), ("gone.bin", good)], "name string, sha256 string")
    assert [r.name for r in audit.wrong_hashes(found, manifest).collect()] == ["gone.bin"]
    settings = {"실행": 1, "모델": {"경로": "/home/x/resources/en/m.pt"}, "입력": {"Users.csv": {"sha256": "h", "path": "/home"}, "other": "k"}}
    once = audit.redact_settings(settings)
    assert once == {"모델": {"경로": "/home/x/resources/en/m.pt"}, "입력": {"botsim_users": "h", "other": "k"}} and audit.redact_settings(once) == once


def test_archives(tmp_path):
    def tar(path, owner, mtime):
        with tarfile.open(path, "w:gz") as t:
            for name in ("b.txt", "a.txt"):
                info = tarfile.TarInfo(name)
                info.size, info.mtime, info.uname, info.pax_headers = 3, mtime, owner, {"comment": owner}
                t.addfile(info, io.BytesIO(b"abc"))

    for i, owner in enumerate(("me", "you")):
        tar(tmp_path / f"{i}.tgz", owner, 100 + i)
        archives.scrub_tar(tmp_path / f"{i}.tgz", tmp_path / f"out{i}.tgz")
    assert (tmp_path / "out0.tgz").read_bytes() == (tmp_path / "out1.tgz").read_bytes()
    with tarfile.open(tmp_path / "out0.tgz") as t:
        assert [(m.name, m.mtime, m.uname, m.mode) for m in t] == [("a.txt", 0, "", 0o644), ("b.txt", 0, "", 0o644)]
    archives.stable_gzip(io.BytesIO(b"x"), tmp_path / "x.gz")
    assert gzip.decompress((tmp_path / "x.gz").read_bytes()) == b"x"
    with pytest.raises(archives.Refused):
        archives.only_member(["a/x.csv", "b/x.csv"], "/x.csv")
    with pytest.raises(archives.Refused):
        archives.missing_inputs(tmp_path, {"raw": "h"}, "http://elsewhere/")
    assert archives.missing_inputs(tmp_path, {"raw": "h", "x.gz": "h"}) == ["raw"]


def test_call_records(spark, tmp_path):
    rows = [{"종류": "시작"}, {"종류": "슬롯", "슬롯id": "s1", "요청모델": "m", "상태": "ok", "댓글": "c"}]
    (tmp_path / "r.jsonl").write_text("\n".join(json.dumps(r, ensure_ascii=False) for r in rows))
    got = readers.call_records(spark, str(tmp_path / "r.jsonl")).first()
    assert (got.source_file, got.source_line, got.slot_id, got.comment, got.post_id) == ("r.jsonl", 2, "s1", "c", None)


def test_feature_tables_from_both_corpora(spark):
    text = "The dog and the cat of that house is in the garden for it was warm."
    tweets = spark.createDataFrame([("u", i, f"2023-01-{i + 1:02d}", text + (" cut…" if i % 2 else ""), i % 2, 0) for i in range(12)] + [("u", 99, "2023-02-01", text, 0, 1), ("", 3, "2023", text, 0, 0)], "user_id string, seq long, created_at string, text string, is_reply int, is_retweet int")
    corpora = feature_tables.tweet_corpora(tweets)
    assert corpora["tweets"].count() == 12 and corpora["tweets_trunc"].where("cut").count() == 6
    info = feature_tables.tweet_info(corpora["tweets"]).first()
    assert (info.year_median, info.year_max, info.reply_share, info.docs_in_year) == (2023.0, 2023, 0.5, 12)
    keys = S.key_dimension(spark, {"F": ["the"], "M품사": ["PUNCT"], "R": list(S.RHYTHM_KEYS)}, {})
    totals, long = feature_tables.feature_table(corpora["tweets"], ["the"], keys)
    assert totals.first().docs == 12 and long.where("key = 'the'").first().value == pytest.approx(round(36 / (12 * 16 + 6), 6))
    assert feature_tables.smoke(corpora["tweets"], 1).count() == 12
    assert feature_tables.excluded_accounts(corpora["tweets"]).count() == 0
