"""Operators on texts against plain versions of their contracts, and their edge cases."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
import xxhash
from tokenizers import Tokenizer

from quillmark.llm import bpe, encoding, packing, pii, quality, secrets, simhash, token_files

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, kept string, component_id string, _host string"


def texts():
    rng = random.Random(7)
    alphabet = list("abcXYé漢ß 0123456789.,'-+@/\n\t\x0b\x1c\xa0") + ["the ", " and", "  ", "\n\n", "<|endoftext|>", "'ll"]
    made = ["".join(rng.choice(alphabet) for _ in range(rng.randrange(60))) for _ in range(150)]
    long = " ".join(rng.choice(["alpha", "beta", "gamma", "delta.", "é"]) for _ in range(30_000))
    return [None, "", " ", "\n", "one", "x" * 5000, "a b c d e f g h " * 9, long, *made, made[3], made[3]]


@pytest.fixture(scope="module")
def rows():
    return [(i if i != 5 else None, t, None if i % 3 else "en", None if i % 4 == 0 else f"s{i % 3}", None, "k", "c", "h") for i, t in enumerate(texts())] + [
        (20, "a repeated row", "en", "s1", 3, "k", "c", "h"),
        (20, "a repeated row", "en", "s1", 3, "k", "c", "h"),
    ]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, DOCS).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def key(rows):
    return sorted(rows, key=repr)


# -- token ids --------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_chunked_encoding_is_the_library_on_whole_texts(name):
    path = public_tokenizers.path(name)
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    own = encoding.Encoder(path, memo_chunks=200)
    given = [t or "" for t in texts()]
    for at in range(0, len(given), 20):
        part = given[at : at + 20]
        want = [library.encode(t, add_special_tokens=False).ids for t in part]
        assert [np.frombuffer(b, "<u4").tolist() for b in own.encode(part)] == want


def test_token_files_round_trip(docs, none, rows):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    library.encode_special_tokens = True
    path = public_tokenizers.path("byte_bpe_50k.json")
    shards, dictionary = token_files.write_token_files(docs, path, end_id=0)
    got = token_files.read_token_files(shards, dictionary).collect()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids + [0]
        want.append((doc_id, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
    assert key((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == key(want)
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.start for r in ordered] == np.concatenate([[0], np.cumsum([r.n_tokens for r in ordered])])[:-1].tolist()
    named = [r.doc_id for r in ordered if r.doc_id is not None]
    assert ordered[0].doc_id is None and named == sorted(named)
    assert token_files.read_token_files(*token_files.write_token_files(none, path, 0)).count() == 0


def test_a_single_document_is_read_from_its_offset(tmp_path):
    words = [np.arange(i, i * 3 + 5, dtype=np.uint32) for i in range(40)]
    dictionary = token_files.train_dictionary([w.astype("<u2").tobytes() for w in words])
    with open(tmp_path / "x.tokens", "wb") as f:
        out = token_files.ShardWriter(f, dictionary, 2)
        for i, w in enumerate(words):
            out.add(i, w)
        out.close()
    with open(tmp_path / "x.tokens", "rb") as f:
        shard = token_files.ShardReader(f, dictionary)
        assert len(shard) == 40 and shard.document(17).tolist() == words[17].tolist()
        assert [i for i, _ in shard] == list(range(40))
        with pytest.raises(ValueError):
            token_files.ShardReader(f, dictionary + b"x")


# -- packing ------------------------------------------------------------------------------


def test_pieces_hold_each_token_once(docs, none, rows):
    path = public_tokenizers.path("word_bpe_49k.json")
    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    got = packing.pack_documents(docs, path, end_id=2).collect()
    ids = Counter()
    for doc_id, text, *_ in rows:
        ids[(doc_id, tuple(library.encode(text or "", add_special_tokens=False).ids + [2]))] += 1
    lengths = Counter()
    for r in got:
        own = [k for k in ids if k[0] == r.doc_id and len(k[1]) == r.doc_tokens]
        piece = [k for k in own if zlib.crc32(np.array(k[1][r.start : r.start + r.length], "<u4").tobytes()) == r.ids_crc32]
        assert piece
        lengths[r.doc_id] += r.length
    want = Counter()
    for (doc_id, x), n in ids.items():
        want[doc_id] += n * len(x)
    assert lengths == want
    by_sequence = defaultdict(list)
    for r in got:
        by_sequence[r.sequence_id].append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, n in sorted(pieces):
            assert offset == at
            at += n
        assert at <= 4096 and at & (at - 1) == 0  # full, or a power of two
    assert packing.pack_documents(none, path, 2).count() == 0


def test_all_three_limits_hold():
    rng = random.Random(3)
    limits = packing.Limits(tokens=64, segments=4, loss=20)
    examples = []
    for k in range(300):
        bears = [rng.random() < rng.choice([0.0, 0.3, 1.0]) for _ in range(rng.randrange(1, 120))]
        examples.append(((k, bears), len(bears), np.concatenate([[0], np.cumsum(bears)])))
    seen, use = defaultdict(list), defaultdict(lambda: [0, 0, 0])
    for (k, bears), start, n, sequence, offset in packing.pack(examples, limits):
        seen[k].append((start, n))
        assert use[sequence][0] == offset
        for i, x in enumerate((n, 1, sum(bears[start : start + n]))):
            use[sequence][i] += x
    assert all(u[i] <= limits[i] for u in use.values() for i in range(3))
    for (k, bears), n, _ in examples:
        at = 0
        for start, length in sorted(seen[k]):
            assert start == at
            at += length
        assert at == n


def test_conversations_bear_loss_on_one_role(spark):
    rows = [(c, t, "assistant" if t % 2 else "user", f"words of turn {t} " * (c + 1)) for c in range(9) for t in range(4)]
    rows += [(None, 0, None, None), (None, 0, "assistant", "x")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = packing.pack_conversations(turns, public_tokenizers.path("word_bpe_49k.json"), 2, packing.Limits(64, 8, 32)).collect()
    by = defaultdict(lambda: [0, 0, 0])
    for r in got:
        for i, x in enumerate((r.length, 1, r.n_loss)):
            by[r.sequence_id][i] += x
    assert all(a <= 64 and b <= 8 and c <= 32 for a, b, c in by.values())
    assert {r.conv_id for r in got} == {*range(9), None}


# -- byte-level BPE -------------------------------------------------------------------------


def test_recursive_bpe_is_tiktoken(docs, none, rows):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(path), special_tokens={})
    sha = lambda b: hashlib.sha256(b).hexdigest()
    want = []
    for doc_id, text, *_ in rows:
        ids = library.encode_ordinary(text or "")
        want.append((doc_id, len(ids), sha(" ".join(map(str, ids)).encode()), sha((text or "").encode())))
    got = bpe.round_trip(docs, path, public_tokenizers.PATTERN)
    assert key(tuple(r) for r in got.collect()) == key(want)
    assert bpe.round_trip(none, path, public_tokenizers.PATTERN).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(docs, path, public_tokenizers.PATTERN), path, public_tokenizers.PATTERN)
    assert key((r.doc_id, bytes(r.data)) for r in back.collect()) == key((d, (t or "").encode()) for d, t, *_ in rows)


def test_the_heap_for_long_words_contracts_like_the_query():
    own = bpe.Bpe(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    rng = random.Random(1)
    words = [bytes(rng.choice(b"abceinth\xc3\xa9") for _ in range(rng.randrange(1, 90))) for _ in range(200)]
    assert [own._heap(w) for w in words] == [t.tolist() for t in own._contract(words)]


# -- personal data and secrets ----------------------------------------------------------------


PII = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
    ("card", r"[0-9]([\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"),
]
SECRET = [
    ("assign", r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]+"),
    ("hex", r"[0-9a-f]+"),
]


def plain_pii(text):
    def holds(kind, s):
        digits = re.sub("[^0-9]", "", s)
        if kind == "ip":
            return all(int(x[-4:] if x.lstrip("0") == x[-3:].lstrip("0") else 999) <= 255 for x in s.split("."))
        if kind == "card":
            doubled = [sum(divmod(2 * int(c), 10)) if i % 2 else int(c) for i, c in enumerate(digits[::-1])]
            return 12 <= len(digits) <= 19 and sum(doubled) % 10 == 0
        return kind == "email" or 9 <= len(digits) <= 15

    return sorted((k, *m.span()) for k, p in PII for m in re.finditer(p, text) if holds(k, m.group()))


def plain_secrets(text):
    least = {"assign": 8, "access": 16, "hex": 32}
    return sorted(
        (k, *m.span())
        for k, p in SECRET
        for m in re.finditer(p, text, re.I | re.A if k == "assign" else 0)
        if len(m.group(2) if k == "assign" else m.group()) >= least[k]
    )


def test_base_spans_are_the_patterns():
    rng = random.Random(11)
    bits = ["a@b.c", "x.y_z@q-r.st.uv", "@", "_", ".", "4111 1111 1111 1111", "4111-1111-1111-1112", "1.2.3.4", "1.2.3.4.5", "999.1.1.1", "007.1.1.1",
            "+1 (555) 010-9999", "+", " ", "-", "password=abcdefgh1", "Token: 'zz", "API_KEY=", "apikey:\"Zm9vYmFy+/==", "AKIA" + "Z9" * 8, "AKIA", "0af" * 12, "deadbeef", "é", "ſecret=12345678", "1" * 25]
    for _ in range(600):
        text = "".join(rng.choice(bits) for _ in range(rng.randrange(9)))
        assert sorted((s.kind, s.start, s.end) for s in pii.find(text) if s.kind in pii.BASE) == plain_pii(text)
        assert sorted((s.kind, s.start, s.end) for s in secrets.find(text) if s.kind in secrets.BASE) == plain_secrets(text)


def test_long_runs_take_linear_time():
    for text in ("1" * 200_000, "a" * 200_000 + "@", "1." * 100_000, "+1" * 50_000, "a.b" * 60_000, "f" * 31 + " " + "0" * 200_000):
        pii.find(text)
        secrets.find(text)


def test_checksums_and_context_add_spans():
    iban = "pay to GB82 WEST 1234 5698 7654 32 soon"
    assert [s.kind for s in pii.find(iban) if s.kind == "iban"] == ["iban"]
    assert not [s for s in pii.find(iban.replace("GB82", "GB83")) if s.kind == "iban"]
    assert [s.kind for s in pii.find("my ssn is 123-45-6789")] == ["ssn"]
    assert not pii.find("part 123-45-6789")
    assert [s.kind for s in pii.find("call me at (626) 555-5759")] == ["local_phone"]
    assert pii.redact("mail a@b.co or +1 (555) 010-9999!") == "mail [email] or [phone]!"


def test_structure_confirms_secrets():
    import base64
    import json

    part = lambda x: base64.urlsafe_b64encode(json.dumps(x).encode()).rstrip(b"=").decode()
    token = f"{part({'alg': 'HS256', 'typ': 'JWT'})}.{part({'sub': '1'})}.c2lnbmF0dXJl"
    assert "jwt" in {s.kind for s in secrets.find(f"x {token} y")}
    assert not [s for s in secrets.find("eyJhbGciOiJ.bm90anNvbg.x") if s.kind == "jwt"]

    def der(tag, body):
        n = len(body)
        size = bytes([n]) if n < 128 else bytes([0x80 | 2]) + n.to_bytes(2, "big") if n > 255 else bytes([0x81, n])
        return bytes([tag]) + size + body

    key = der(0x30, der(2, b"\0") + b"".join(der(2, bytes([1 + i] * 30)) for i in range(8)))
    assert secrets.is_private_key(key) and not secrets.is_private_key(key[:-1]) and not secrets.is_private_key(key + b"\0")
    assert "der" in {s.kind for s in secrets.find("k " + base64.b64encode(key).decode())}
    assert "der" in {s.kind for s in secrets.find("k " + key.hex())}
    pem = "-----BEGIN RSA PRIVATE KEY-----\n" + base64.encodebytes(key).decode() + "-----END RSA PRIVATE KEY-----"
    assert "pem" in {s.kind for s in secrets.find(pem)}


def test_span_queries(docs, none, rows):
    from quillmark.llm.spans import digests, joined

    for module, plain in ((pii, plain_pii), (secrets, plain_secrets)):
        got = digests(docs, module.find, module.KINDS, module.BASE).collect()
        assert len(got) == len(rows)
        by = {(d, t or "") for d, t, *_ in rows}
        want = Counter()
        for d, t, *_ in rows:
            spans = sorted(plain(t or ""), key=lambda s: (s[1], module.KINDS.index(s[0])))
            want[(d, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest())] += 1
        assert Counter((r.doc_id, r.base_sha256) for r in got) == want and by
        assert digests(none, module.find, module.KINDS, module.BASE).count() == 0
    assert joined([], pii.KINDS) == ""


def test_redaction_keeps_rows_and_columns(docs, none, rows):
    got = pii.redact_documents(docs)
    assert got.columns == docs.columns and got.count() == len(rows) and pii.redact_documents(none).count() == 0
    assert key((r.doc_id, r.text) for r in got.collect()) == key((d, None if t is None else pii.redact(t)) for d, t, *_ in rows)


# -- quality ----------------------------------------------------------------------------------


def plain_counts(text):
    text = text or ""
    words = WORDS.findall(text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    count, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if count[w] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORDS.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


def test_counts_and_base_rules(docs, none, rows):
    got = quality.quality_verdicts(docs)
    want = []
    for d, t, *_ in rows:
        c = plain_counts(t)
        want.append((d, *c, c[0] < 20 or 100 * c[4] > 30 * c[0]))
    assert key((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got.collect()) == key(want)
    assert quality.quality_verdicts(none).count() == 0
    stage = quality.keep_good(docs)
    assert stage.columns == docs.columns and quality.keep_good(none).count() == 0
    assert stage.count() == got.where("kept").count()


def test_a_bad_host_goes_and_a_small_one_is_not_condemned_by_one_document(spark):
    good = " ".join(f"word{i}" for i in range(40))
    rows = [(i, good, f"good{i % 9}") for i in range(900)] + [(1000 + i, "too short", "bad") for i in range(90)]
    rows += [(2000, good, "bad"), (3000, "one short text", "small"), (3001, good, "small")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r.doc_id: r.kept for r in quality.quality_verdicts(docs).collect()}
    assert not got[2000] and got[3001] and not got[3000] and all(got[i] for i in range(900))
    rates = {(r._host, r.rule): r.rate for r in quality.host_rates(quality.judge_documents(docs), "source").collect()}
    n, f = 10 * [0], 10 * [0]
    hosts = defaultdict(lambda: [0, 0])
    for _, t, h in rows:
        hosts[h][0] += 1
        hosts[h][1] += len(WORDS.findall(t)) < 20
    n, f = (np.array([v[i] for v in hosts.values()], float) for i in (0, 1))
    m = f.sum() / n.sum()
    v = ((f * f / n).sum() - f.sum() * m - (len(n) - 1) * m * (1 - m)) / (n.sum() - (n * n).sum() / n.sum())
    s = min(1e6, max(1.0, m * (1 - m) / v - 1))
    for h, (a, b) in hosts.items():
        assert rates[(h, "short")] == pytest.approx((b + m * s) / (a + s))


# -- fingerprints -------------------------------------------------------------------------------


def plain_fingerprint(text):
    words = re.findall(rb"[^\x20\x09-\x0D]+", re.sub(rb"[A-Z]", lambda m: m.group().lower(), (text or "").encode()))
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [b" ".join(words)]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def plain_components(fps):
    parent = list(range(len(fps)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= 2:
                a, b = sorted((root(i), root(j)))
                parent[b] = a
    return [root(i) for i in range(len(fps))]


def test_fingerprints(docs, none, rows):
    got = simhash.fingerprints(docs).collect()
    assert key((r.doc_id, r.fp % (1 << 64)) for r in got) == key((d, plain_fingerprint(t)) for d, t, *_ in rows)
    assert simhash.near_duplicates(none).count() == 0 and simhash.one_of_each(none).count() == 0


def test_tries_link_what_pairs_link(spark):
    rng = random.Random(5)
    fps = {0, 1, 3, (1 << 64) - 1, 1 << 63}
    for _ in range(25):
        center = rng.getrandbits(64)
        fps.add(center)
        for _ in range(rng.randrange(40)):
            f = center
            for _ in range(rng.randrange(1, 5)):
                f ^= 1 << rng.randrange(64)
            fps.add(f)
    fps = list(fps)
    want = plain_components(fps)
    distinct = spark.createDataFrame([(f - (1 << 64) if f >= 1 << 63 else f, i) for i, f in enumerate(fps)], "fp long, node long")
    for limit in (10_000, 20, 2):  # the last two divide full nodes once and twice
        from quillmark.llm.components import connected_components

        got = {r.node: r.component for r in connected_components(simhash.fingerprint_links(distinct, limit)).collect()}
        assert [got.get(i, i) for i in range(len(fps))] == want


def test_one_of_each_keeps_the_smallest(docs, rows):
    found = simhash.near_duplicates(docs).collect()
    named = [r for r in found if r.doc_id is not None]
    fps = [r.fp % (1 << 64) for r in named]
    root = plain_components(fps)
    least = {}
    for r, c in zip(named, root):
        least[c] = min(least.get(c, r.doc_id), r.doc_id)
    assert [r.component_id for r in named] == [least[c] for c in root]
    kept = simhash.one_of_each(docs)
    assert kept.columns == docs.columns
    assert key(r.doc_id for r in kept.collect()) == key([*set(least.values()), *(d for d, *_ in rows if d is None)])
