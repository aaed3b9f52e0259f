"""Byte-level BPE from a rank file, as recursive DuckDB queries inside each task.

Texts are split by the pattern. A word that is a token is that token, as in tiktoken; the
others become rows of (word, position, token), one per byte, and a recursive query joins
neighbouring tokens with the merge table and contracts each word's leftmost pair of least
rank, until no pair of any word is in the table. A word is contracted once per worker process
and kept in a bounded memo. Decoding joins ids with the vocabulary and aggregates the tokens'
bytes in the order of their positions.

A merge is any split of a token into two tokens: pairs are looked up by their joined bytes.

Two exact steps keep long words from taking a round of the query per byte. No merge crosses a
place that no token's occurrence in the word spans, so a long word is cut there and its parts
are contracted each for itself. In parts that are long still, a round contracts all pairs of
the least rank up to the first whose new token merges at a lower rank with a neighbour: one
after the other they would come next in any case. (No token merges at a lower rank than its
own, on either side, if its merge is ``calm``.)
"""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import duckdb
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .shared import dealt, small_batches, table
from .token_files import batches

#: Words kept by a worker process; beyond it the memo starts anew. About 250 MB.
MEMO_WORDS = 1_000_000
#: Words that one recursive query contracts, and text that one batch holds.
QUERY_WORDS = 40_000
BATCH_CHARS = 4 << 20
#: Longer words are cut; longer parts go to the second query, so many bytes of them at a time.
LONG_BYTES = 64
QUERY_BYTES = 1 << 19
#: Parts in which tokens overlap throughout for so many bytes are contracted by the same rule
#: with a heap, as a query must hold a word's rows in memory.
HEAP_BYTES = 1 << 18

#: A row's key k is its word times 2048 plus its position, so that one sort orders all words.
CONTRACT = """
WITH RECURSIVE s(k, t, live) AS (
    SELECT k, t, true FROM bytes_of_words
    UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT k, t, k >> 11 AS w, lead(t) OVER v AS nt, lead(k) OVER v AS nk FROM s WHERE live WINDOW v AS (ORDER BY k)),
    least_pair AS (
        SELECT w, min(m::BIGINT * 2048 + (k & 2047)) AS e, arg_min(nk, m::BIGINT * 2048 + (k & 2047)) AS nk
        FROM pairs JOIN merges ON ab = (t::BIGINT << 32) | nt WHERE (nk >> 11) = w GROUP BY w)
    SELECT k, CASE WHEN (k & 2047) = (e & 2047) THEN (e >> 11)::INT ELSE t END, e IS NOT NULL
    FROM pairs LEFT JOIN least_pair ON pairs.w = least_pair.w WHERE e IS NULL OR k <> least_pair.nk)
)
SELECT k >> 11 AS w, t FROM s WHERE NOT live ORDER BY k
"""
#: For long parts; k is the part times 2^32 plus the position. Of a part's pairs of the least
#: rank, those up to the first after which another pair would come next; where they overlap
#: in a run, every other one from the left.
CONTRACT_LONG = """
WITH RECURSIVE s(k, t, live) AS (
    SELECT k, t, true FROM bytes_of_words
    UNION ALL
    (WITH pairs AS MATERIALIZED (
        SELECT k, t, k >> 32 AS w, lead(t) OVER v AS nt, lead(k) OVER v AS nk,
            CASE WHEN lag(k) OVER v >> 32 = k >> 32 THEN lag(t) OVER v END AS before,
            CASE WHEN lead(k, 2) OVER v >> 32 = k >> 32 THEN lead(t, 2) OVER v END AS after
        FROM s WHERE live WINDOW v AS (ORDER BY k)),
    ranked AS MATERIALIZED (
        SELECT w, k, nk, m, calm, before, after FROM pairs JOIN merges ON ab = (t::BIGINT << 32) | nt WHERE (nk >> 32) = w),
    least_pair AS MATERIALIZED (SELECT w, min(m) AS least FROM ranked GROUP BY w),
    chosen AS MATERIALIZED (SELECT ranked.* FROM ranked JOIN least_pair USING (w) WHERE m = least),
    turns AS (
        SELECT w, min(k) AS last FROM chosen WHERE NOT calm AND (((before::BIGINT << 32) | m) IN (SELECT ab FROM lower_right)
            OR ((m::BIGINT << 32) | after) IN (SELECT ab FROM lower_left) OR ((m::BIGINT << 32) | m) IN (SELECT ab FROM lower_left)) GROUP BY w),
    marked AS (
        SELECT k, nk, m, CASE WHEN lag(nk) OVER (ORDER BY k) = k THEN 0 ELSE 1 END AS fresh
        FROM chosen LEFT JOIN turns USING (w) WHERE k <= coalesce(last, k)),
    runs AS (SELECT k, nk, m, sum(fresh) OVER (ORDER BY k) AS run FROM marked),
    taken AS MATERIALIZED (SELECT k, nk, m FROM (SELECT k, nk, m, row_number() OVER (PARTITION BY run ORDER BY k) AS i FROM runs) WHERE i % 2 = 1)
    SELECT pairs.k, coalesce(taken.m, t), least IS NOT NULL
    FROM pairs LEFT JOIN least_pair ON pairs.w = least_pair.w LEFT JOIN taken ON pairs.k = taken.k
    WHERE NOT EXISTS (SELECT 1 FROM taken gone WHERE gone.nk = pairs.k))
)
SELECT k >> 32 AS w, t FROM s WHERE NOT live ORDER BY k
"""
DECODE = "SELECT d, string_agg(h, '' ORDER BY i) AS h FROM ids JOIN vocabulary USING (t) GROUP BY d"


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


class Bpe:
    def __init__(self, path: str, pattern: str, memo_words: int = MEMO_WORDS):
        self.ranks = read_ranks(path)
        if any(bytes([i]) not in self.ranks for i in range(256)):
            raise ValueError("every byte must be a token")
        self._pieces = regex.compile(pattern).findall
        self._bytes = np.array([self.ranks[bytes([i])] for i in range(256)], np.int32)
        self._limit = memo_words
        get = self.ranks.get
        merges = [
            ((a << 32) | b, m)
            for token, m in self.ranks.items()
            for i in range(1, len(token))
            if (a := get(token[:i])) is not None and (b := get(token[i:])) is not None
        ]
        # No spilling: a worker's own folder is no place for it, and what a query holds is bounded.
        self._db = duckdb.connect(config={"threads": 1, "memory_limit": "500MB", "temp_directory": ""})
        ab, m = (np.array(x, np.int64) for x in zip(*merges)) if merges else (np.empty(0, np.int64),) * 2
        # The least rank of a merge that has a token on either side.
        lowest = np.full(max(self.ranks.values()) + 1, np.iinfo(np.int64).max)
        np.minimum.at(lowest, ab >> 32, m)
        np.minimum.at(lowest, ab & 0xFFFFFFFF, m)
        for name, data in (
            ("merges", pa.table({"ab": ab, "m": m.astype(np.int32), "calm": lowest[m] > m})),
            ("lower_left", pa.table({"ab": ab[m < ab >> 32]})),
            ("lower_right", pa.table({"ab": ab[m < (ab & 0xFFFFFFFF)]})),
            ("vocabulary", pa.table({"t": np.array(list(self.ranks.values()), np.int32), "h": [k.hex() for k in self.ranks]})),
        ):
            self._db.register("given", data)
            self._db.execute(f"CREATE TABLE {name} AS SELECT * FROM given")
            self._db.unregister("given")
        self._decimal = {v: str(v) for v in self.ranks.values()}
        self._tokens: ahocorasick.Automaton | None = None
        self._forget()

    def _forget(self) -> None:
        self._place: dict[str, int] = {}
        self._flat = np.empty(1 << 20, np.int32)
        self._starts = np.zeros(self._limit + 1, np.int64)

    def _heap(self, word: bytes) -> list[int]:
        """Contract a long word: pairs in the order of (rank, position), stale ones skipped."""
        tok = self._bytes[np.frombuffer(word, np.uint8)].tolist()
        part = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(tok) + 1)), list(range(-1, len(tok) - 1))
        heap: list[tuple[int, int, bytes]] = []

        def offer(i: int) -> None:
            j = after[i]
            if j < len(tok) and (m := self.ranks.get(part[i] + part[j])) is not None:
                heapq.heappush(heap, (m, i, part[i] + part[j]))

        for i in range(len(tok) - 1):
            offer(i)
        while heap:
            m, i, joined = heapq.heappop(heap)
            j = after[i] if part[i] else len(tok)
            if j >= len(tok) or part[i] + part[j] != joined:
                continue
            tok[i], part[i], part[j] = m, joined, b""
            after[i] = after[j]
            if after[j] < len(tok):
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [t for t, p in zip(tok, part) if p]

    def _contract(self, words: list[bytes], query: str = CONTRACT, bits: int = 11) -> list[np.ndarray]:
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        flat = np.frombuffer(b"".join(words), np.uint8)
        word = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
        position = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        self._db.register("bytes_of_words", pa.table({"k": (word << bits) + position, "t": self._bytes[flat]}))
        done = self._db.sql(query).to_arrow_table()
        self._db.unregister("bytes_of_words")
        w, t = done["w"].to_numpy(), done["t"].to_numpy()
        return np.split(t, np.searchsorted(w, np.arange(1, len(words))))

    def cut(self, word: bytes) -> list[bytes]:
        """The word in parts that no merge joins: between them no token occurs."""
        if self._tokens is None:
            self._tokens = ahocorasick.Automaton()
            for token in self.ranks:
                if len(token) > 1:
                    self._tokens.add_word(token.decode("latin-1"), len(token))
            self._tokens.make_automaton()
        spanned = np.zeros(len(word) + 1, np.int64)
        found = np.fromiter(chain.from_iterable(self._tokens.iter(word.decode("latin-1"))), np.int64)
        ends, sizes = found[::2] + 1, found[1::2]
        np.add.at(spanned, ends - sizes + 1, 1)
        np.add.at(spanned, ends, -1)
        edges = [0, *np.flatnonzero(np.cumsum(spanned)[1:-1] == 0) + 1, len(word)]
        return [word[a:b] for a, b in zip(edges, edges[1:])]

    def _contract_all(self, words: list[bytes]) -> list[np.ndarray]:
        """Every word by the query for its length."""
        parts = {i: self.cut(w) for i, w in enumerate(words) if len(w) > LONG_BYTES}
        distinct = dict.fromkeys(chain((w for w in words if len(w) <= LONG_BYTES), *parts.values()))
        short, long, size = [], [], 0
        done: dict[bytes, np.ndarray] = {}

        def told(some: list[bytes], *query) -> None:
            done.update(zip(some, self._contract(some, *query)) if some else ())
            some.clear()

        for w in distinct:
            if len(w) <= LONG_BYTES:
                short.append(w)
                if len(short) == QUERY_WORDS:
                    told(short)
            elif len(w) > HEAP_BYTES:
                done[w] = np.array(self._heap(w), np.int32)
            else:
                if size + len(w) > QUERY_BYTES:
                    told(long, CONTRACT_LONG, 32)
                    size = 0
                long.append(w)
                size += len(w)
        told(short)
        told(long, CONTRACT_LONG, 32)
        return [np.concatenate([done[x] for x in parts[i]]) if i in parts else done[w] for i, w in enumerate(words)]

    def _learn(self, words: list[str]) -> None:
        tokens: list = [None] * len(words)
        coded = [w.encode("utf-8", "surrogatepass") for w in words]
        wait = []
        for i, b in enumerate(coded):
            if (t := self.ranks.get(b)) is not None:
                tokens[i] = (t,)
            else:
                wait.append(i)
        for i, t in zip(wait, self._contract_all([coded[i] for i in wait])):
            tokens[i] = t
        n = len(self._place)
        sizes = np.fromiter(map(len, tokens), np.int64, len(tokens))
        ends = self._starts[n] + np.cumsum(sizes)
        while len(self._flat) < ends[-1]:
            self._flat = np.concatenate([self._flat, np.empty_like(self._flat)])
        if len(self._starts) < n + len(words) + 1:
            self._starts = np.concatenate([self._starts, np.zeros(n + len(words) + 1, np.int64)])
        self._flat[self._starts[n] : ends[-1]] = np.concatenate([np.asarray(t, np.int32) for t in tokens])
        self._starts[n + 1 : n + len(words) + 1] = ends
        self._place.update(zip(words, range(n, n + len(words))))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        if len(self._place) > self._limit:
            self._forget()
        get = self._place.get
        split = [self._pieces(t) for t in texts]
        places = [list(map(get, pieces)) for pieces in split]
        missing = [k for k, at in enumerate(places) if None in at]
        if missing:
            new = {w for k in missing for w, i in zip(split[k], places[k]) if i is None}
            self._learn(list(new))
            for k in missing:
                row, words = places[k], split[k]
                for j in [j for j, i in enumerate(row) if i is None]:
                    row[j] = self._place[words[j]]
        counts = np.fromiter(map(len, places), np.int64, len(places))
        at = np.fromiter(chain.from_iterable(places), np.int64, int(counts.sum()))
        first, sizes = self._starts[at], self._starts[at + 1] - self._starts[at]
        ends = np.cumsum(sizes)
        total = int(ends[-1]) if len(ends) else 0
        flat = self._flat[np.arange(total) + np.repeat(first - ends + sizes, sizes)]
        return np.split(flat, np.concatenate([[0], ends])[np.cumsum(counts)[:-1]]) if texts else []

    def decode(self, ids: list[np.ndarray]) -> list[bytes]:
        """The bytes of each sequence of ids."""
        sizes = [len(x) for x in ids]
        flat = np.concatenate([*ids, np.empty(0, np.int32)]).astype(np.int32)
        given = pa.table({"d": np.repeat(np.arange(len(ids), dtype=np.int32), sizes), "i": np.arange(len(flat), dtype=np.int32), "t": flat})
        self._db.register("ids", given)
        rows = self._db.sql(DECODE).fetchall()
        self._db.unregister("ids")
        out = [b""] * len(ids)
        for d, h in rows:
            out[d] = bytes.fromhex(h)
        return out

    def decimal(self, ids: np.ndarray) -> str:
        return " ".join(map(self._decimal.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def bpe(path: str, pattern: str) -> Bpe:
    """One for each worker process, which Spark uses for many tasks."""
    return Bpe(path, pattern)


def encode_documents(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, ids (array) of each row of docs (doc_id, text); a null text has no ids."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, texts in batches(rows, "text", BATCH_CHARS):
            ids = bpe(path, pattern).encode(texts)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, data (bytes) of each row of encoded (doc_id, ids); null ids have none."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                ids = [np.asarray(x or (), np.int32) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).cast(pa.int64()), pa.array(bpe(path, pattern).decode(ids), pa.binary())], ["doc_id", "data"])

    return small_batches(encoded.select("doc_id", "ids")).mapInArrow(run, "doc_id long, data binary")


def round_trip(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256: encoded, then decoded from the ids
    alone, in one pass over each batch. Null texts are empty, repeated rows stay."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = bpe(path, pattern)
        for keys, texts in batches(rows, "text", BATCH_CHARS):
            ids = own.encode(texts)
            back = own.decode(ids)
            columns = (
                pa.array(keys, pa.int64()),
                pa.array([len(x) for x in ids], pa.int64()),
                pa.array([hashlib.sha256(own.decimal(x).encode()).hexdigest() for x in ids]),
                pa.array([hashlib.sha256(x).hexdigest() for x in back]),
            )
            yield pa.RecordBatch.from_arrays(list(columns), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op5_bpe_queries(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = dealt(table(spark, sf_dir, "documents"))
    return round_trip(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
