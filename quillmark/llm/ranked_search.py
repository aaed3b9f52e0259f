"""Ranked lexical search over shards of dual-sorted postings in wavelet trees.

A shard holds the postings of some thousand documents. Its terms' lists follow one another,
each ordered by impact, the greatest first; the document numbers of that sequence are kept in
a wavelet tree, level by level from their highest bit. So one structure is sorted twice: down
the tree a term's range narrows to a range of documents, and within a range its first entry
has the greatest impact there.

A query goes best first: a node is a range of documents beside its terms' ranges, and its
bound is the weighted sum of their first impacts. No document below a node scores more, and a
leaf's bound is its document's score. Nodes of the greatest bounds are opened, some at a time;
a node whose bound is below the k-th best score, or equal to it with later documents only, is
never opened. What is left is the exact top k.

Impacts don't depend on a term's frequency in the collection, which only weighs it, so the
index is made in one pass without a shuffle once two sums of all documents are known.
"""

from __future__ import annotations

import io
import math
import re
from collections import Counter
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import committed, dealt, new_place, opened, small_batches, table, written

TOP = 10
#: A shard is closed once it has so many postings, or so many documents.
SHARD_POSTINGS = 1 << 20
SHARD_DOCS = 1 << 14
#: (item, term) rows that go to all tasks at a time; more items take more passes.
BLOCK_TERMS = 500_000
#: Nodes opened at a time.
OPENED = 128
#: Stands for a null doc_id, which sorts first.
_NULL_ID = -(1 << 63)

_TERM = re.compile(rb"[0-9a-z\x80-\xff]+")
_TERM_JVM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def terms_of(text: str | None) -> list[bytes]:
    """Runs of ASCII letters and digits and of all other characters; A-Z lower-cased."""
    return _TERM.findall((text or "").encode().lower())  # bytes lower-case A-Z alone


class Collection(NamedTuple):
    """Sums over all documents that have a term: how many, and their terms with repeats."""

    documents: int
    terms: int


def collection(docs: DataFrame) -> Collection:
    n = F.regexp_count(F.coalesce("text", F.lit("")), F.lit(_TERM_JVM))
    row = docs.select(n.alias("n")).agg(F.count_if(F.col("n") > 0).alias("d"), F.sum(F.col("n").cast("long")).alias("t")).first()
    return Collection(row.d, row.t or 0)


def impacts(tf: np.ndarray, n: np.ndarray, whole: Collection) -> np.ndarray:
    m = 100 - 90 + 90 * n * whole.documents // whole.terms
    return 1_000_000_000 * tf // (1000 * tf + 8 * m)


def weight(df: int, documents: int) -> int:
    return math.floor(1000 * math.log((2 * documents + 2) / (2 * df + 1)))


class ShardBuilder:
    """Documents to the arrays of a shard."""

    def __init__(self, whole: Collection):
        self.whole, self.known = whole, {}
        self.keys: list[int] = []
        self.lengths: list[int] = []
        self.rows: list[tuple[np.ndarray, np.ndarray]] = []
        self.postings = 0

    def add(self, key: int | None, terms: list[bytes]) -> None:
        counted = Counter(terms)
        known = self.known
        ids = np.fromiter((known.setdefault(t, len(known)) for t in counted), np.int32, len(counted))
        self.rows.append((ids, np.fromiter(counted.values(), np.int64, len(counted))))
        self.keys.append(_NULL_ID if key is None else key)
        self.lengths.append(len(terms))
        self.postings += len(counted)

    def arrays(self) -> dict[str, np.ndarray]:
        order = np.argsort(np.array(self.keys, np.int64), kind="stable")
        rows = [self.rows[i] for i in order]
        sizes = np.array([len(ids) for ids, _ in rows])
        doc = np.repeat(np.arange(len(rows), dtype=np.int32), sizes)
        term = np.concatenate([ids for ids, _ in rows])
        impact = impacts(np.concatenate([tf for _, tf in rows]), np.array(self.lengths, np.int64)[order][doc], self.whole).astype(np.int32)
        own = np.lexsort((doc, -impact, term))
        doc, impact = doc[own], impact[own]
        levels = max(1, (len(rows) - 1).bit_length())
        bits, zeros, at = [], [], doc
        for level in range(levels):
            bit = (at >> (levels - 1 - level) & 1).astype(bool)
            padded = np.zeros(-(-(len(bit) + 1) // 64) * 64, np.uint8)
            padded[: len(bit)] = bit
            bits.append(np.packbits(padded, bitorder="little").view("<u8"))
            zeros.append(len(bit) - int(bit.sum()))
            at = np.concatenate([at[~bit], at[bit]])
        return {
            "terms": np.frombuffer(b"\n".join(self.known), np.uint8),
            "starts": np.concatenate([[0], np.cumsum(np.bincount(term, minlength=len(self.known)))]).astype(np.int64),
            "impacts": impact, "keys": np.array(self.keys, np.int64)[order], "bits": np.stack(bits), "zeros": np.array(zeros, np.int64),
        }


class Lists:
    """A shard's vocabulary: where the lists of wanted terms lie."""

    def __init__(self, arrays):
        self.arrays, self.starts = arrays, arrays["starts"]
        self.vocabulary = arrays["terms"].tobytes().split(b"\n")

    def ranges(self, wanted) -> dict[bytes, tuple[int, int]]:
        starts = self.starts
        return {t: (int(starts[i]), int(starts[i + 1])) for i, t in enumerate(self.vocabulary) if t in wanted}


class Tree:
    """The wavelet tree of a shard, with the impacts in the order of each level."""

    def __init__(self, arrays):
        self.keys, self.words, self.zeros = arrays["keys"], arrays["bits"], arrays["zeros"]
        self.levels = len(self.zeros)
        ones = np.bitwise_count(self.words).astype(np.int64)
        self.before = np.cumsum(ones, axis=1) - ones
        at = arrays["impacts"]
        self.impacts = np.empty((self.levels + 1, len(at)), np.int32)
        self.impacts[0] = at
        for level in range(self.levels):
            bit = np.unpackbits(self.words[level].view(np.uint8), bitorder="little")[: len(at)].astype(bool)
            self.impacts[level + 1] = at = np.concatenate([at[~bit], at[bit]])

    def ones(self, level: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ones before each place of its level."""
        word = at >> 6
        low = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[level, word] + np.bitwise_count(self.words[level, word] & low)

    def top(self, begin: np.ndarray, end: np.ndarray, weights: np.ndarray, k: int, best: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The k best (-score, key) of ``best`` and of the documents in the terms' ranges."""
        some = weights > 0
        begin, end, weights = begin[some], end[some], weights[some]
        if not len(begin):
            return best
        # A node: level, first document, bound; its terms' ranges lie in its place of begin, end, weights.
        level, first, size = np.zeros(1, np.int64), np.zeros(1, np.int64), np.array([len(begin)])
        bound = np.array([int((weights * self.impacts[0, begin]).sum())])
        while len(level):
            if len(best) == k:
                score, key = -best[-1][0], best[-1][1]
                able = (bound > score) | (bound == score) & (self.keys[first] < key)
            else:
                able = np.ones(len(level), bool)
            pick = able
            if np.count_nonzero(able) > OPENED:
                pick = np.zeros(len(level), bool)
                pick[np.lexsort((first, -bound, ~able))[:OPENED]] = True
            own = np.repeat(pick, size)
            rest = np.repeat(able & ~pick, size)
            b, e, w, n = begin[own], end[own], weights[own], size[pick]
            lv, fi = level[pick], first[pick]
            if not len(lv):
                break
            each = np.repeat(lv, n)
            b1, e1 = self.ones(each, b), self.ones(each, e)
            zero = self.zeros[each]
            step = np.int64(1) << (self.levels - 1 - lv)
            sides = [(b - b1, e - e1, fi), (zero + b1, zero + e1, fi + step)]
            node = np.repeat(np.arange(len(lv)), n)
            grown = []
            for sb, se, sf in sides:
                there = se > sb
                terms = np.bincount(node[there], minlength=len(lv))
                value = w[there] * self.impacts[each[there] + 1, sb[there]]
                total = np.zeros(len(lv), np.int64)
                np.add.at(total, node[there], value)
                live = terms > 0
                grown.append((lv[live] + 1, sf[live], total[live], terms[live], sb[there], se[there], w[there]))
            done = (lv + 1 == self.levels)
            # Children of a last level are documents, and their bounds are scores.
            leaves = [(g[2][g[0] == self.levels], g[1][g[0] == self.levels]) for g in grown] if done.any() else []
            if leaves:
                scores, docs = np.concatenate([x for x, _ in leaves]), np.concatenate([x for _, x in leaves])
                near = np.lexsort((docs, -scores))[:k]
                best = sorted([*best, *((-int(s), int(self.keys[d])) for s, d in zip(scores[near], docs[near]) if s > 0)])[:k]
            inner = []
            for lv2, fi2, bo2, n2, sb, se, sw in grown:
                open_ = lv2 < self.levels
                kept = np.repeat(open_, n2)
                inner.append((lv2[open_], fi2[open_], bo2[open_], n2[open_], sb[kept], se[kept], sw[kept]))
            left = able & ~pick
            columns = zip((level[left], first[left], bound[left], size[left], begin[rest], end[rest], weights[rest]), *inner)
            level, first, bound, size, begin, end, weights = (np.concatenate(c) for c in columns)
        return best


_SHARDS = "uri string, n_docs long, n_postings long"


def build_index(docs: DataFrame, whole: Collection | None = None, place: str | None = None) -> tuple[DataFrame, Collection]:
    """``docs`` (doc_id, text) to the table of shards (uri, n_docs, n_postings), itself written,
    and the sums of the collection.

    Each task packs its own documents as they come, so no text is shuffled; a task holds one
    shard. Only files of tasks that Spark committed are in the table. Documents without terms
    (null and empty texts) are in no shard. A null doc_id is indexed like any, repeated rows are
    documents of their own, a text is read whole whatever its length, and an empty table gives
    no shards. Columns besides doc_id and text are not read, so their names can't clash.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text")
    whole = whole or collection(docs)
    place = place or new_place(spark, "lexical-index")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, seq = TaskContext.get(), 0
        shard = ShardBuilder(whole)

        def closed() -> pa.RecordBatch:
            uri = f"{place}/{task.partitionId():08d}-{seq:06d}-{task.taskAttemptId()}.shard"
            buffer = io.BytesIO()
            np.savez(buffer, **shard.arrays())
            with committed(uri) as out:
                out.write(buffer.getbuffer())
            return pa.RecordBatch.from_pydict({"uri": [uri], "n_docs": pa.array([len(shard.keys)], pa.int64()), "n_postings": pa.array([shard.postings], pa.int64())})

        for batch in batches:
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                terms = terms_of(text)
                if not terms:
                    continue
                shard.add(key, terms)
                if shard.postings >= SHARD_POSTINGS or len(shard.keys) >= SHARD_DOCS:
                    yield closed()
                    shard, seq = ShardBuilder(whole), seq + 1
        if shard.keys:
            yield closed()

    return written(small_batches(docs).mapInArrow(write, _SHARDS), "lexical-shards"), whole


def _spread(shards: DataFrame) -> DataFrame:
    """The shards' names over tasks of several shards each, as a task goes on with the k-th
    scores of its shards so far."""
    n = shards.count()
    return shards.select("uri").repartition(max(1, min(n, 20_000, max(2 * shards.sparkSession.sparkContext.defaultParallelism, n // 64))))


def _opened_shards(batches: Iterator[pa.RecordBatch]) -> Iterator:
    for batch in batches:
        for uri in batch.column("uri").to_pylist():
            fs, path = opened(uri)
            with fs.open_input_file(path) as f:
                yield np.load(f)


def document_frequencies(shards: DataFrame, wanted: frozenset[bytes]) -> dict[bytes, int]:
    """How many documents hold each of the wanted terms: the lengths of their lists."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: Counter = Counter()
        for arrays in _opened_shards(batches):
            sums.update({t: e - b for t, (b, e) in Lists(arrays).ranges(wanted).items()})
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.binary()), pa.array(list(sums.values()), pa.int64())], ["term", "df"])

    rows = _spread(shards).mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df")).collect()
    return {bytes(r.term): r.df for r in rows}


def search(shards: DataFrame, whole: Collection, items: DataFrame, k: int = TOP) -> DataFrame:
    """items (item_id, text) to item_id, rank, doc_id, score: each item's k best documents, equal
    scores by ascending doc_id (null first), none of score 0.

    The items' terms go to all tasks in blocks of about ``BLOCK_TERMS``, a pass over the index
    each; a block is the only thing the driver holds. Rows of one item_id are one item with all
    their terms; items without id or terms have no rows. Each task keeps k documents an item.
    """
    spark = shards.sparkSession
    kind = items.schema["item_id"].dataType
    low = F.translate(F.coalesce("text", F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    pairs = items.where("item_id is not null").select("item_id", F.explode(F.regexp_extract_all(low, F.lit(_TERM_JVM), F.lit(0))).alias("term")).distinct()
    pairs = written(pairs, "item-terms")
    blocks = max(1, -(-pairs.count() // BLOCK_TERMS))
    names = _spread(shards)

    def found(block: int) -> DataFrame:
        asked: dict[int, list[bytes]] = {}
        for item, term in pairs.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block).toLocalIterator():
            asked.setdefault(item, []).append(term.encode())
        df = document_frequencies(shards, frozenset(t for own in asked.values() for t in own))
        weights = {t: weight(d, whole.documents) for t, d in df.items()}
        queries = {item: [t for t in sorted(own) if t in weights] for item, own in asked.items()}

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            best: dict[int, list[tuple[int, int]]] = {item: [] for item in queries}
            for arrays in _opened_shards(batches):
                at = Lists(arrays).ranges(weights)
                tree = Tree(arrays)
                for item, own in queries.items():
                    there = [t for t in own if t in at]
                    if there:
                        begin, end = (np.array([at[t][i] for t in there], np.int64) for i in (0, 1))
                        best[item] = tree.top(begin, end, np.array([weights[t] for t in there], np.int64), k, best[item])
            rows = [(item, None if key == _NULL_ID else key, -s) for item, top in best.items() for s, key in top]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows)], ["item_id", "doc_id", "score"]).cast(told)

        told = pa.schema([("item_id", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])
        return names.mapInArrow(run, "item_id long, doc_id long, score long")

    rows = reduce(DataFrame.unionByName, [found(b) for b in range(blocks)])
    own = Window.partitionBy("item_id").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_first())
    top = rows.withColumn("rank", F.row_number().over(own)).where(F.col("rank") <= k)
    return top.select(F.col("item_id").cast(kind), "rank", "doc_id", "score")


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return search(*build_index(docs), table(spark, sf_dir, "benchmark").select("item_id", "text"))


OP12_SQL = f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM_JVM}')) AS term FROM documents),
q AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_TERM_JVM}')) AS term FROM benchmark),
tf AS (SELECT doc_id, term, count(*)::BIGINT AS tf FROM t GROUP BY ALL), n AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY doc_id),
c AS (SELECT count(*)::BIGINT AS docs, sum(n)::BIGINT AS l FROM n), df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
w AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * df + 1)))::BIGINT AS w FROM df, c),
s AS (SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * docs) // l))))::BIGINT AS score FROM q JOIN tf USING (term) JOIN w USING (term) JOIN n USING (doc_id), c GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank, doc_id, score FROM s WHERE score > 0 QUALIFY rank <= {TOP}
"""
