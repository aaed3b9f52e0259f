"""Near copies: documents whose sets of word shingles have a Jaccard similarity of a limit or more.

Min-hashes in bands propose, exact similarity decides. A band is a few minima of the set under
as many hash functions; documents that agree on a band are candidates. At a similarity of 0.8
a pair agrees on none of 32 bands of 4 with a chance of (1 - 0.8^4)^32, under 1 in 20 million.

SimHash fingerprints of the same shingles propose beside them: those within two bits, found by
the self-join of binary tries (``simhash.fingerprint_links``).

Documents that candidates join, directly or by others, are compared exactly, all with all, so
no pair is given up within them. They meet in cells bounded in shingles: small sets of
candidates share one, a large set is divided into groups, and each two groups meet in a cell.
A cell finds its components through postings of shingles, and passes on a spanning tree.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .shared import looked_up, scratch, small_batches, written
from .simhash import fingerprint_links, lowered_words

SHINGLE = 5
SIMILARITY = 0.8
BANDS, BAND_ROWS = 32, 4
SEED = 20_260_102
#: Shingles of a group of candidates; a cell has two groups at most.
GROUP_SHINGLES = 1 << 20
#: Shingles whose minima are taken at a time.
_CHUNK = 1 << 17


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def shingle_hashes(words: list[bytes], shingle: int = SHINGLE) -> np.ndarray:
    """A hash of each run of ``shingle`` words; fewer words are one shingle, none are none."""
    if not words:
        return np.zeros(0, np.uint64)
    own = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n = max(len(words) - shingle + 1, 1)
    out = np.full(n, min(len(words), shingle), np.uint64)
    for k in range(min(len(words), shingle)):
        out = _mixed(out) + own[k : k + n]
    return _mixed(out)


def _bands(hashes: list[np.ndarray]) -> np.ndarray:
    """One row of BANDS keys for each set, none of them empty."""
    rng = np.random.Generator(np.random.PCG64(SEED))
    factors = rng.integers(0, 1 << 63, BANDS * BAND_ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
    flat = np.concatenate(hashes)
    starts = np.concatenate([[0], np.cumsum([len(h) for h in hashes])[:-1]])
    out = np.empty((len(hashes), BANDS), np.uint64)
    for band in range(BANDS):
        key = np.full(len(hashes), band, np.uint64)
        for a in factors[band * BAND_ROWS : (band + 1) * BAND_ROWS]:
            key = _mixed(key) + np.minimum.reduceat(flat * a, starts)
        out[:, band] = _mixed(key)
    return out


def _fingerprint(hashes: np.ndarray) -> int:
    """The bits that are set in over half the shingles' hashes, as a signed long."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), 1 << 16):
        part = hashes[at : at + (1 << 16)].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<i8")[0])


def sketches(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """doc_id, same (a digest of the words), bands, fp (the fingerprint) of each row of docs
    (doc_id, text); a text without words has neither bands nor fingerprint."""

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            same, bands, fps, held, places, size = [], [None] * batch.num_rows, [None] * batch.num_rows, [], [], 0

            def flush() -> None:
                if held:
                    for at, keys in zip(places, _bands(held).view(np.int64)):
                        bands[at] = keys
                held.clear()
                places.clear()

            for at, text in enumerate(batch.column(1).to_pylist()):
                words = lowered_words(text)
                same.append(xxhash.xxh3_128_digest(b" ".join(words)))
                if words:
                    held.append(shingle_hashes(words, shingle))
                    fps[at] = _fingerprint(held[-1])
                    places.append(at)
                    size += len(held[-1])
                if size > _CHUNK:
                    flush()
                    size = 0
            flush()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).cast(pa.int64()), pa.array(same, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(fps, pa.int64())], ["doc_id", "same", "bands", "fp"]
            )

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, "doc_id long, same binary, bands array<long>, fp long")


def _shingled(rows: DataFrame, shingle: int) -> DataFrame:
    """rows (component, node, text) to component, node, n and the sorted distinct shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [np.unique(shingle_hashes(lowered_words(t), shingle)).view(np.int64) for t in batch.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([len(s) for s in sets], pa.int64()), pa.array(sets, pa.list_(pa.int64()))], ["component", "node", "n", "shingles"]
            )

    return small_batches(rows).mapInArrow(run, "component long, node long, n long, shingles array<long>")


def similar_sets(flat: np.ndarray, starts: np.ndarray, similarity: float = SIMILARITY) -> np.ndarray:
    """For sets of distinct values, set i being flat[starts[i]:starts[i + 1]], the first set of
    the component of each under links of ``similarity`` or more.

    A search goes on from every set reached, among those not yet reached by any; so a group
    of copies is passed once, and no pair between components goes without comparison.
    """
    sizes = np.diff(starts)
    root = np.full(len(sizes), -1)
    values, flat = np.unique(flat, return_inverse=True)
    owner = np.repeat(np.arange(len(sizes)), sizes)

    def postings(of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        own = np.flatnonzero(of[owner])
        order = own[np.argsort(flat[own], kind="stable")]
        return owner[order], np.searchsorted(flat[order], np.arange(len(values) + 1))

    free = np.ones(len(sizes), bool)
    at, cuts = postings(free)
    left = indexed = len(sizes)
    for first in range(len(sizes)):
        if root[first] >= 0:
            continue
        root[first], free[first], todo = first, False, [first]
        left -= 1
        while todo and left:
            i = todo.pop()
            lo, hi = cuts[flat[starts[i] : starts[i + 1]]], cuts[flat[starts[i] : starts[i + 1]] + 1]
            lengths = hi - lo
            take = np.repeat(lo - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            met = at[take]
            j, shared = np.unique(met[free[met]], return_counts=True)
            # In whole numbers the limit itself links: shared / union >= similarity.
            near = j[shared >= similarity * (sizes[i] + sizes[j] - shared) - 1e-9]
            root[near], free[near] = first, False
            left -= len(near)
            todo += near.tolist()
            if left < indexed // 2:
                (at, cuts), indexed = postings(free), left
    return root


def _cell(table: pa.Table, similarity: float) -> pa.Table:
    node, column = table.column("node").to_numpy(), table.column("shingles").combine_chunks()
    if isinstance(column, pa.ChunkedArray):
        column = column.chunk(0)
    starts = column.offsets.to_numpy().astype(np.int64)
    flat = column.values.to_numpy(zero_copy_only=False)[starts[0] : starts[-1]]
    root = node[similar_sets(flat, starts - starts[0], similarity)]
    linked = root != node
    return pa.table({"a": node[linked], "b": root[linked]})


def near_copies(docs: DataFrame, shingle: int = SHINGLE, similarity: float = SIMILARITY, group_shingles: int = GROUP_SHINGLES) -> DataFrame:
    """doc_id, component_id for each row of docs (doc_id, text); component_id is the smallest
    doc_id reachable by links of ``similarity`` or more.

    Texts of equal words are one node, named by the smallest doc_id; texts without words are
    copies of each other. A null doc_id names nothing, as in ``simhash.near_duplicates``.
    """
    with scratch(docs.sparkSession) as keep:
        found = written(sketches(docs, shingle), "sketches")
        at = keep(written(_copy_components(docs, found, shingle, similarity, group_shingles), "copy-components"))
        same = keep(written(found.select("doc_id", "same"), "document-digests"))
    out = looked_up(same, at, ["same"], "n")
    return out.select("doc_id", F.coalesce("c", "doc_id").alias("component_id"))


def _trie_links(named: DataFrame) -> DataFrame:
    """a, b: links between the nodes of fingerprints within two bits, equal ones among them."""
    own = named.where("fp is not null").select("fp", "node")
    distinct = written(own.groupBy("fp").agg(F.min("node").alias("first"), F.count("*").alias("n")), "distinct-fingerprints")
    several = written(distinct.where("n > 1"), "shared-fingerprints")
    equal = looked_up(own, several, ["fp"], "n", grows=True).where("first < node").select(F.col("node").alias("a"), F.col("first").alias("b"))
    return equal.union(fingerprint_links(distinct.select("fp", F.col("first").alias("node"))))


def _copy_components(docs: DataFrame, found: DataFrame, shingle: int, similarity: float, group_shingles: int) -> DataFrame:
    """same, n (rows of it), c (component) of each text that has copies or near copies."""
    named = found.groupBy("same").agg(F.min("doc_id").alias("node"), F.count("*").alias("n"), F.first("bands").alias("bands"), F.first("fp").alias("fp")).where("node is not null")
    named = written(named, "distinct-texts")
    keys = named.select("node", F.explode("bands").alias("key"))
    many = keys.groupBy("key").agg(F.min("node").alias("m"), F.count("*").alias("many")).where("many > 1")
    # Bands and texts grow with the input, so they are joined by shuffles whatever its size.
    joined = looked_up(keys, written(many, "shared-bands"), ["key"], "many", grows=True)
    proposed = joined.select(F.col("node").alias("a"), F.col("m").alias("b")).where("a <> b").union(_trie_links(named))
    candidates = written(connected_components(proposed), "candidates")

    texts = docs.select(F.col("doc_id").cast("long").alias("node"), "text").join(candidates.hint("merge"), "node")
    sets = written(_shingled(texts.select("component", "node", "text"), shingle), "candidate-shingles")
    weights = written(sets.groupBy("component").agg(F.sum("n").alias("w")), "candidate-weights")
    bins = 1 + (weights.agg(F.sum("w")).first()[0] or 0) // group_shingles
    groups = F.ceil(F.col("w") / group_shingles).cast("int")
    g = F.pmod(F.xxhash64("node"), groups).cast("int")
    # Small sets of candidates share cells by a hash; of a large one each two groups meet.
    others = F.filter(F.sequence(F.lit(0), groups - 1), lambda k: k != g)
    cells = F.when(groups <= 1, F.array(F.pmod(F.xxhash64("component"), F.lit(bins)))).otherwise(
        F.transform(others, lambda k: F.xxhash64("component", F.least(k, g), F.greatest(k, g)))
    )
    placed = sets.join(weights, "component").select(F.explode(cells).alias("cell"), "node", "shingles")
    links = written(placed.groupBy("cell").applyInArrow(lambda t: _cell(t, similarity), "a long, b long"), "near-copies")
    components = connected_components(links)
    at = named.join(components, "node", "left").where("n > 1 or component is not null")
    return at.select("same", "n", F.coalesce("component", "node").alias("c"))
