"""SimHash fingerprints and their near-duplicates by a self-join of binary tries.

Two fingerprints of 64 bits link at ``BUDGET`` differing bits or fewer. A trie is traversed
against itself from its root: pairs of nodes go down together, the bits in which they
differ add up, and a pair over the budget is pruned with all below it.

To spread this over tasks, the fingerprint is turned so that each of BUDGET + 1 segments
comes first once. A linked pair agrees on at least one whole segment, so in that turn it
lies under one node at the segment's depth, with nothing accumulated; each such node is
traversed by one task. Nodes with too many fingerprints are divided again in the same way
by the bits that are left, so that none holds more than 2^20 (and few more than
``NODE_LIMIT``), whatever share of all documents is alike.

A task passes on a spanning tree of each node's links, at most one row per fingerprint.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .components import connected_components
from .shared import dealt, looked_up, scratch, small_batches, table, written

SHINGLE = 3
BUDGET = 2
SEED = 42
#: A node with more fingerprints is divided further.
NODE_LIMIT = 20_000
#: Pairs of nodes that a traversal expands at a time.
FRONTIER = 1 << 20
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))


def lowered_words(text: str | None) -> list[bytes]:
    """Words of a text, letters A to Z lowered; a null text has none."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64 bits, unsigned; a bit is 1 if it is set in over half the shingles' hashes. A text
    of fewer words is one shingle; without words it is zero."""
    words = lowered_words(text)
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= shingle:
        return xxhash.xxh64_intdigest(joined, SEED)
    lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
    starts = np.concatenate([[0], np.cumsum(lengths)])
    n = len(words) - shingle + 1
    digest = xxhash.xxh64_intdigest
    hashes = np.fromiter(
        (digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), (starts[shingle:] - 1).tolist())), np.uint64, n
    )
    ones = np.zeros(64, np.int64)
    for at in range(0, n, 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame) -> DataFrame:
    """doc_id, fp (the fingerprint's bits as a signed long) of each row of docs (doc_id, text)."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            fps = np.array([fingerprint(t) for t in batch.column(1).to_pylist()], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, fp long")


def _roots(parent: np.ndarray, a: np.ndarray, b: np.ndarray) -> None:
    """Union by pointing larger roots at smaller ones, for whole arrays of links at a time."""
    while len(a):
        a, b = parent[a], parent[b]
        hi, lo = np.maximum(a, b), np.minimum(a, b)
        apart = hi != lo
        hi, lo = hi[apart], lo[apart]
        np.minimum.at(parent, hi, lo)
        while True:
            up = parent[parent]
            if (up == parent).all():
                break
            parent[:] = up
        a, b = hi, lo


def _bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of each unsigned number; halves are exact as doubles."""
    high, low = x >> np.uint64(32), x & np.uint64(0xFFFFFFFF)
    return np.where(high > 0, 32 + np.frexp(high.astype(float))[1], np.frexp(low.astype(float))[1])


def trie_links(node: np.ndarray, fp: np.ndarray, depth: int, budget: int = BUDGET) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Links (positions i < j) between fingerprints of one node, for all nodes at once.

    ``node`` and ``fp`` (unsigned, turned) are sorted by (node, fp), distinct; the
    fingerprints of a node agree on their first ``depth`` bits. Nodes of the trie at a depth
    are runs of rows; ``starts[d]`` has where they begin.
    """
    n = len(fp)
    change = np.concatenate([[True], node[1:] != node[:-1]])
    # Leading bits in which a row agrees with the one before; it begins a node at deeper levels.
    agree = np.concatenate([[-1], np.where(change[1:], -1, 64 - _bit_length(fp[1:] ^ fp[:-1]))])
    starts = {d: np.flatnonzero((agree < d) | change) for d in range(depth, 65)}

    def children(d: int, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First child (an index at d + 1) and number of children of nodes at d."""
        first = np.searchsorted(starts[d + 1], starts[d][of])
        end = np.concatenate([starts[d], [n]])[of + 1]
        return first, np.searchsorted(starts[d + 1], end) - first

    top = np.arange(len(starts[depth]))
    stack = [(depth, top, top, np.zeros(len(top), np.int8))]
    while stack:
        d, a, b, bits = stack.pop()
        if d == 64:
            apart = a != b
            yield a[apart], b[apart]
            continue
        if len(a) > FRONTIER:
            half = len(a) // 2
            stack += [(d, a[half:], b[half:], bits[half:]), (d, a[:half], b[:half], bits[:half])]
            continue
        (fa, na), (fb, nb) = children(d, a), children(d, b)
        shift = np.uint64(63 - d)
        out = []
        for i in (0, 1):
            for j in (0, 1):
                has = (na > i) & (nb > j) & ~((a == b) & (i > j))
                ca, cb = fa[has] + i, fb[has] + j
                differ = ((fp[starts[d + 1][ca]] ^ fp[starts[d + 1][cb]]) >> shift) & np.uint64(1)
                sums = bits[has] + differ.astype(np.int8)
                # A node without a second fingerprint has no link with itself.
                alive = sums <= budget
                out.append((ca[alive], cb[alive], sums[alive]))
        a, b, bits = (np.concatenate(x) for x in zip(*out))
        size = np.diff(np.concatenate([starts[d + 1], [n]]))
        useful = (a != b) | (size[a] > 1)
        stack.append((d + 1, a[useful], b[useful], bits[useful]))


def _segments(bits: int) -> list[int]:
    """Lengths of BUDGET + 1 segments."""
    k = BUDGET + 1
    return [bits // k + (i < bits % k) for i in range(k)]


def _turned(value, depth: int, lengths: list[int], which: int):
    """Column ``value`` (64 bits) whose bits after ``depth`` are turned so that segment
    ``which`` follows at once. Turning within the bits left keeps distances."""
    left = 64 - depth
    before = sum(lengths[:which])
    if not before:
        return value
    mask = (1 << left) - 1
    signed = lambda x: x - (1 << 64) if x >= 1 << 63 else x
    head = value.bitwiseAND(F.lit(signed(~mask & ((1 << 64) - 1))))
    tail = value.bitwiseAND(F.lit(signed(mask)))
    up = F.shiftleft(tail, before).bitwiseAND(F.lit(signed(mask)))
    down = F.shiftrightunsigned(tail, left - before)
    return head.bitwiseOR(up).bitwiseOR(down)


def _divided(rows: DataFrame, depth: int) -> tuple[DataFrame, int]:
    """Rows (key, fp, node) once per segment of the bits after ``depth``; the key grows by the
    segment's number and the new depth holds for all (segments differ by a bit at most)."""
    lengths = _segments(64 - depth)
    deeper = depth + min(lengths)
    parts = [
        rows.select(F.col("key"), F.lit(i).alias("turn"), _turned(F.col("fp"), depth, lengths, i).alias("fp"), "node")
        for i in range(len(lengths))
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    # The key of a node: all turns so far and the bits down to its depth.
    prefix = F.shiftrightunsigned("fp", 64 - deeper)
    return out.select(F.xxhash64("key", "turn", prefix).alias("key"), "fp", "node"), deeper


def fingerprint_links(distinct: DataFrame, node_limit: int = NODE_LIMIT) -> DataFrame:
    """``distinct`` (fp, node: a long that names it) to links (a, b) of names that span the
    components of the linking relation."""
    rows, depth = _divided(distinct.select(F.lit(0).cast("long").alias("key"), "fp", "node"), 0)
    parts = []
    for level in range(3):
        full = rows.groupBy("key").count().where(F.col("count") > node_limit).select("key")
        if level == 2 or full.isEmpty():
            parts.append((rows, depth))
            break
        full = written(full, "full-nodes")
        parts.append((rows.join(full, "key", "left_anti"), depth))
        rows, depth = _divided(rows.join(full, "key", "left_semi"), depth)
    out = None
    for part, d in parts:
        links = _node_links(part, d)
        out = links if out is None else out.union(links)
    return out


def _node_links(rows: DataFrame, depth: int) -> DataFrame:
    """Spanning links of every key's fingerprints; a task gathers whole keys, many at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solved(key, fp, node):
            # Keys with one row have no link.
            new = np.concatenate([[True], key[1:] != key[:-1]])
            group = np.cumsum(new) - 1
            many = np.bincount(group)[group] > 1
            key, fp, node = key[many], fp[many], node[many]
            if not len(key):
                return None
            order = np.lexsort((fp, key))
            key, fp, node = key[order], fp[order], node[order]
            # A key is a hash; should two nodes share one, their first bits tell them apart.
            prefix = fp >> np.uint64(64 - depth)
            new = np.concatenate([[True], (key[1:] != key[:-1]) | (prefix[1:] != prefix[:-1])])
            parent = np.arange(len(key))
            for i, j in trie_links(np.cumsum(new) - 1, fp, depth):
                _roots(parent, i, j)
            linked = np.flatnonzero(parent != np.arange(len(key)))
            return pa.RecordBatch.from_arrays([pa.array(node[linked]), pa.array(node[parent[linked]])], ["a", "b"])

        held: list[tuple] = []
        size = 0
        for batch in batches:
            key, fp, node = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            held.append((key, fp.view(np.uint64), node))
            size += len(key)
            if size < 1 << 17:
                continue
            key, fp, node = (np.concatenate(x) for x in zip(*held))
            cut = int(np.searchsorted(key, key[-1]))  # the last key may go on
            if cut and (out := solved(key[:cut], fp[:cut], node[:cut])):
                yield out
            held, size = [(key[cut:], fp[cut:], node[cut:])], len(key) - cut
        if size and (out := solved(*(np.concatenate(x) for x in zip(*held)))):
            yield out

    return rows.repartition("key").sortWithinPartitions("key").select("key", "fp", "node").mapInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fp, component_id for each row of docs (doc_id, text); component_id is the
    smallest doc_id reachable by links.

    Equal fingerprints are one node, named by the smallest doc_id. A null text has
    fingerprint zero, which links like any other. A null doc_id names nothing: its row gets
    the component of its fingerprint, null if no other row has one. Repeated rows stay; an
    empty table gives no rows. A text is hashed whole whatever its length. Columns besides
    doc_id and text are not read, so their names can't clash.
    """
    found = written(fingerprints(docs), "fingerprints")
    with scratch(docs.sparkSession) as keep:
        placed = keep(written(_fingerprint_components(found), "fingerprint-components"))
    out = looked_up(found, placed, ["fp"], "n")
    return out.select("doc_id", "fp", F.coalesce("c", "doc_id").alias("component_id"))


def _fingerprint_components(found: DataFrame) -> DataFrame:
    """fp, n (rows of it), c (component). Only fingerprints of several rows, or with links, say
    more of a row than its own id."""
    named = found.groupBy("fp").agg(F.min("doc_id").alias("node"), F.count("*").alias("n")).where("node is not null")
    named = written(named, "distinct-fingerprints")
    components = connected_components(fingerprint_links(named.select("fp", "node")))
    placed = named.join(components, "node", "left").where("n > 1 or component is not null")
    return placed.select("fp", "n", F.coalesce("component", "node").alias("c"))


def one_of_each(docs: DataFrame, components: Callable[[DataFrame], DataFrame] = near_duplicates) -> DataFrame:
    """``docs`` with one document of each of ``components``, that of the smallest doc_id. Of rows
    that repeat a doc_id one stays; rows with a null doc_id all stay."""
    with scratch(docs.sparkSession) as keep:
        found = components(docs).where("doc_id is not null")
        ids = found.groupBy("doc_id").agg(F.min("component_id").alias("c"), F.count("*").alias("n")).where("n > 1 or doc_id <> c")
        ids = keep(written(ids, "not-single"))
    names = [F.col(f"`{c}`") for c in docs.columns]
    # Ids written to a table have a known size: a small one is broadcast, and then no text moves.
    single = docs.join(ids.select("doc_id"), "doc_id", "left_anti").select(*names)
    repeated = docs.join(ids.where("doc_id = c").select("doc_id"), "doc_id", "left_semi").select(*names)
    return single.union(repeated.dropDuplicates(["doc_id"]))


def op9_simhash_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = dealt(table(spark, sf_dir, "documents"))
    found = near_duplicates(docs)
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
