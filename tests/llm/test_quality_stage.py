"""Junk that is spread over many hosts, so that no host's rate is high."""

import random

import corpus_pipeline
from quillmark.llm import quality

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


def test_the_stage_rejects_junk_spread_over_hosts(spark):
    good = " ".join(f"word{i}" for i in range(40))
    symbols = " ".join(f"word{i}$$$" for i in range(40))
    lines = "\n".join([f"a line {i} of its own" for i in range(6)] + ["x", "y"] * 9)
    rows = [(i, f"{good} {i}", "en", f"s{i % 20}", 1) for i in range(400)]
    rows += [(1000 + i, symbols, "en", f"s{i}", 1) for i in range(20)] + [(2000 + i, lines, "en", f"s{i}", 1) for i in range(20)]
    got = corpus_pipeline.quality_rules(spark, spark.createDataFrame(rows, COLUMNS), "").collect()
    assert sorted(r.doc_id for r in got) == list(range(400))


def test_hosts_decide_where_junk_is_spread(spark):
    """Junk in all hosts, at rates as in the sample, more of it in one: there documents go that
    only fail rules on symbols, clean ones stay; in most others all of them stay."""
    rng = random.Random(2)
    prose = lambda: " ".join(f"w{rng.randrange(500)}" for _ in range(40))
    rows = []
    for i in range(4000):
        host = f"h{i % 20}"
        junk = rng.random() < (0.12 if host == "h3" else 0.04)
        rows.append((i, " ".join(f"a{j}$#%" for j in range(30)) if junk else prose(), host))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    lost = [i for i, text, _ in rows if not got[i]]
    hosts = {rows[i][2] for i in lost}
    assert all("$" in rows[i][1] for i in lost) and "h3" in hosts and len(hosts) < 6  # and others that stand out by chance
    assert all(got[i] for i, text, host in rows if "$" not in text)


def test_op4_hosts_change_verdicts_on_the_sample(spark):
    got = quality.op4_quality_hosts(spark, "/root/testdata/sf0.1").where("not base_failed and not kept").count()
    assert got > 0
