"""Vectors, pages and components against plain versions, and their edge cases."""

import hashlib
import math
import random

import numpy as np
import pytest

from quillmark.llm import embeddings, url_filter, warc
from quillmark.llm.components import connected_components
from quillmark.llm.shared import opened


# -- components -----------------------------------------------------------------------------------


@pytest.mark.parametrize("shape", ["chain", "star", "random", "none"])
def test_components(spark, shape):
    rng = random.Random(2)
    links = {
        "chain": [(i, i + 1) for i in range(60)] + [(7, 7), (3, None)],
        "star": [(500, i) for i in range(200)] * 2,
        "random": [(rng.randrange(300), rng.randrange(300)) for _ in range(200)],
        "none": [],
    }[shape]
    parent = {}

    def root(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        if b is not None and a != b:
            a, b = sorted((root(a), root(b)))
            parent[b] = a
    got = connected_components(spark.createDataFrame(links, "a long, b long"))
    assert {r.node: r.component for r in got.collect()} == {x: root(x) for x in list(parent)}


# -- vectors ----------------------------------------------------------------------------------------


def plain_links(rows):
    unit = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        unit.append(np.array(v, float) / np.linalg.norm(v) if good else None)
    near = [[j for j, b in enumerate(unit) if j != i and a is not None and b is not None and len(a) == len(b) and a @ b >= 0.9] for i, a in enumerate(unit)]
    comp = []
    for i in range(len(rows)):
        seen, todo = {i}, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        comp.append(min(rows[j][0] for j in seen))
    return {rows[i][0]: (len(near[i]), comp[i]) for i in range(len(rows))}


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((25, 64))
    rows = []
    for i in range(400):
        c = centers[int(rng.integers(25))]
        rows.append((i, (c + rng.standard_normal(64) * rng.choice([0.1, 0.3, 0.45, 2.0])).tolist()))
    rows += [(400 + i, rows[3][1]) for i in range(30)]
    rows += [(500, None), (501, []), (502, [0.0] * 64), (503, [float("nan")] * 64), (504, [None] + [1.0] * 63), (505, [float("inf")] + [1.0] * 63)]
    rows += [(506, [1.0, 2.0]), (507, [2.0, 4.0]), (508, [-1.0, 2.0]), (509, [3.0]), (510, [1e-200] * 64), (511, [1e200] * 64)]
    frame = spark.createDataFrame([(a, b, 1, "x") for a, b in rows], "vec_id long, embedding array<double>, n_links int, kept string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(frame).collect()}
    want = plain_links([(a, [x for x in b] if b else b) for a, b in rows if a not in (510, 511)])
    assert {k: v for k, v in got.items() if k < 510} == want
    assert got[510] == got[511] == (1, 510)
    assert embeddings.near_duplicate_vectors(frame.where("vec_id < 0")).count() == 0


def test_repeated_and_nameless_vectors(spark):
    a, b, c = [1.0, 0.0], [0.99, 0.05], [0.0, 1.0]
    frame = spark.createDataFrame([(1, a), (1, a), (None, b), (2, c), (None, [-1.0, 0.0])], "vec_id long, embedding array<float>")
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in embeddings.near_duplicate_vectors(frame).collect()), key=repr)
    assert got == sorted([(1, 2, 1), (1, 2, 1), (None, 2, 1), (2, 0, 2), (None, 0, None)], key=repr)


@pytest.mark.parametrize("dim", [1, 2, 3, 17, 64, 200])
def test_no_pair_at_the_limit_is_lost(dim):
    rng = np.random.default_rng(dim)
    x = rng.standard_normal((300, dim))
    x /= np.linalg.norm(x, axis=1)[:, None]
    # Partners at a cosine of 0.9 or a little more.
    side = rng.standard_normal((300, dim))
    side -= (side * x).sum(1)[:, None] * x
    norm = np.linalg.norm(side, axis=1)[:, None]
    side = np.divide(side, norm, out=np.zeros_like(side), where=norm > 1e-9)
    cos = np.where(np.arange(300) % 2, 0.9000001, 0.93)[:, None]
    y = cos * x + np.sqrt(1 - cos**2) * side
    y /= np.linalg.norm(y, axis=1)[:, None]
    got = {(int(i), int(j)) for a, b in embeddings.cell_links(x, y, 0.9) for i, j in zip(a, b)}
    want = {(int(i), int(j)) for i, j in zip(*np.nonzero(x @ y.T >= 0.9))}
    assert abs(len(got ^ want)) <= len([1 for i, j in got ^ want if abs(x[i] @ y[j] - 0.9) < 1e-12])


# -- urls -----------------------------------------------------------------------------------------------


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, path = rest[:cut], rest[cut:]
    for c in "?#":
        path = path.split(c)[0]
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def test_urls(spark):
    rules = [*url_filter.RULES, url_filter.Rule("block", "a.b.net", "/en"), url_filter.Rule("allow", "a.b.net", "/en/x/y"), url_filter.Rule("block", "a.b.net", "/en/x/"),
             url_filter.Rule("allow", "c.com", ""), url_filter.Rule("block", "c.com", "")]
    rng = random.Random(4)
    urls = [None, "", "x", "://", "http://", "HTTP://NET/", "http://net", "http://É.net/", "a://b://c.net/"]
    for _ in range(400):
        host = ".".join(rng.choice(["a", "b", "net", "example", "com", "org", "c", "NET"]) for _ in range(rng.randrange(4)))
        urls.append("http://" + host + rng.choice(["", "/", "?", "#"]) + "/".join(rng.choice(["en", "fr", "de", "x", "y", "", "english"]) for _ in range(rng.randrange(4))) + rng.choice(["", "?q=/", "#f"]))
    frame = spark.createDataFrame([(i, u, "v", "j") for i, u in enumerate(urls)], "page_id long, url string, verdict string, _judged string")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict, r._judged) for r in url_filter.judge_urls(frame, "url", rules).collect()}
    for i, u in enumerate(urls):
        host, path = plain_url(u)
        fits = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
        best = max(fits, key=lambda r: (r.host.count("."), len(r.path), r.action == "block"), default=None)
        assert got[i] == (host, path, best.host + best.path if best else None, best.action if best else "allow", "j"), u
    assert url_filter.judge_urls(frame.where("false"), "url", rules).count() == 0


def test_too_many_rules_are_refused(monkeypatch):
    monkeypatch.setattr(url_filter, "MAX_RULE_BYTES", 1000)
    with pytest.raises(ValueError):
        url_filter.Trie(url_filter.Rule("block", f"h{i}.net", "/") for i in range(100))


# -- archives ----------------------------------------------------------------------------------------------


def test_archives(spark):
    rng = random.Random(6)
    payloads = ["", "short", "short", "x" * 99, "x" * 99, "y" * 100, "é" * 50, None] + ["<html>" + "z" * rng.randrange(90, 110) for _ in range(60)] + ["line\r\n\r\nWARC/1.1\r\n" * 9] * 40
    rows = [(100 - i if i % 2 else 500 + i, f"http://h/{i}\r\nX: y" if i % 5 else None, None if p is None else bytearray(p.encode())) for i, p in enumerate(payloads)]
    rows += [(None, "u", bytearray(b"q" * 200)), (900, "u", bytearray(b"q" * 200)), (900, "u", bytearray(b"q" * 200)), (901, "u", bytearray(b"q" * 200))]
    records = spark.createDataFrame(rows, "record_id long, uri string, payload binary").repartition(3)
    archives = warc.write_archives(warc.resolve_revisits(records))
    got = warc.read_archives(archives, payloads=True).collect()
    first = {}
    for i, _, p in rows:
        if i is not None:
            first[bytes(p or b"")] = min(first.get(bytes(p or b""), i), i)
    want = []
    for i, _, p in rows:
        p = bytes(p or b"")
        again = len(p) >= 100 and i is not None and i > first[p]
        want.append((i, len(p), hashlib.sha256(p).hexdigest(), "revisit" if again else "response", first[p] if again else None, None if again else p))
    found = [(r.record_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload)) for r in got]
    assert sorted(found, key=repr) == sorted(want, key=repr)
    fs, path = opened(archives.first().uri)
    with fs.open_input_stream(path, compression=None) as f:
        head, _ = warc.parse_record(next(warc.members(f)))
    assert {"WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length"} <= set(head)
    assert warc.read_archives(warc.write_archives(warc.resolve_revisits(records.where("false")))).count() == 0
