"""Rules that fill several tries are judged as those of one."""

import random

from quillmark.llm import url_filter
from quillmark.llm.url_filter import Rule


def test_several_tries_judge_like_one(spark, monkeypatch):
    rng = random.Random(8)
    hosts = ["", "net", "a.net", "b.a.net", "com", "c.com"]
    rules = [Rule(rng.choice(["allow", "block"]), rng.choice(hosts), rng.choice(["", "/", "/x", "/x/", "/x/y", "/z"])) for _ in range(60)]
    urls = [None, "", "http://", *(f"http://{rng.choice(['b.a.net', 'a.net', 'q.net', 'c.com', 'com', 'org', ''])}{rng.choice(['', '/', '/x', '/x/y', '/x/yy', '/zz', '/q'])}" for _ in range(300))]
    frame = spark.createDataFrame([(i, u, "own") for i, u in enumerate(urls)], "page_id long, url string, rule string")
    one = {r.page_id: tuple(r) for r in url_filter.judge_urls(frame, "url", rules).collect()}
    monkeypatch.setattr(url_filter, "MAX_RULE_BYTES", 1500)
    assert len(list(url_filter._bounded(rules))) > 2
    assert {r.page_id: tuple(r) for r in url_filter.judge_urls(frame, "url", rules).collect()} == one
    assert url_filter.judge_urls(frame.where("false"), "url", rules).count() == 0


def test_many_rules_below_one_folder():
    """Rules beside one another are found by their lengths; work doesn't grow with their number."""
    import time

    rules = [url_filter.Rule("block" if i % 3 else "allow", "example.com", f"/a/{i:06d}") for i in range(60_000)] + [url_filter.Rule("block", "example.com", "/a/00")]
    trie = url_filter.Trie(rules)
    for i in (0, 1, 59_999):
        assert trie.find("www.example.com", f"/a/{i:06d}x/y") == rules[i]
    assert trie.find("example.com", "/a/00zz") == rules[-1] and trie.find("example.com", "/a/99") is None and trie.find("example.com", "/a") is None
    few = url_filter.Trie(rules[:60])

    def least(t):
        took = []
        for _ in range(3):
            start = time.process_time()
            for i in range(3000):
                t.find("example.com", f"/a/{i:06d}")
            took.append(time.process_time() - start)
        return min(took)

    assert least(trie) < 5 * least(few) + 0.05
