"""Nearest neighbours by additive quantisation, with exact reranking.

A vector of length one is coded as a sum of codewords, one from each of several codebooks,
every codeword as long as the vector itself. Codebooks begin as k-means of what the books
before them leave over; rounds of coding and of least squares, book by book, fit them further.
Coding is a beam search: after each book the sums with the least remaining error go on.

A row keeps its codes and the norm of its sum. For a query, the products with all codewords
make a lookup table, so a row's approximate cosine is a few table entries over its norm. Per
query the best rows go to the exact cosine on the original vectors, in double precision.

Equal vectors are one row of the index that bears the smallest ids of its copies: of copies,
no others can be among the nearest k. Blocks of codes meet blocks of queries, each of bounded
size; every query meets every row, as the contract has it.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import looked_up, scratch, table, written

NEAREST = 5
SEED = 20_260_102
BOOKS = 24
WORDS = 256
BEAM = 8
#: Approximate neighbours of a query that are ranked exactly.
RERANKED = 100
#: Distinct vectors that codebooks are fitted on, at most: those of the least hashes.
SAMPLE = 8192
ROUNDS = 1
#: Passes of least squares over all books in a round.
SWEEPS = 4
#: Distinct vectors of a block of codes, and of a block of queries.
CODE_BLOCK, QUERY_BLOCK = 65_536, 2048
#: Blocks of codes are at least so many, so that all executors have work.
MIN_BLOCKS = 8
_TILE = 64


class Codebooks(NamedTuple):
    """words: books x words x dim."""

    words: np.ndarray

    def encode(self, x: np.ndarray, beam: int = BEAM) -> np.ndarray:
        """Rows of unit vectors to codes: n x books, by beam search; a code is a byte."""
        out = np.empty((len(x), len(self.words)), np.uint8)
        for at in range(0, len(x), 1024):
            out[at : at + 1024] = self._encode(x[at : at + 1024], beam)
        return out

    def _encode(self, x: np.ndarray, beam: int) -> np.ndarray:
        n, size, x = len(x), self.words.shape[1], x.astype(np.float32)
        rest, error = x[:, None, :], np.einsum("ij,ij->i", x, x)[:, None]
        codes = np.zeros((n, 1, 0), np.int64)
        for words in self.words.astype(np.float32):
            # |r - w|^2 = |r|^2 - 2 r w + |w|^2 for each sum in the beam and each word.
            found = error[:, :, None] - 2 * (rest @ words.T) + np.einsum("ij,ij->i", words, words)
            flat = found.reshape(n, -1)
            keep = min(beam, flat.shape[1])
            near = np.argpartition(flat, keep - 1, axis=1)[:, :keep] if keep < flat.shape[1] else np.tile(np.arange(keep), (n, 1))
            parent, word = near // size, near % size
            rest = np.take_along_axis(rest, parent[:, :, None], 1) - words[word]
            error = np.take_along_axis(flat, near, 1)
            codes = np.concatenate([np.take_along_axis(codes, parent[:, :, None], 1), word[:, :, None]], axis=2)
        best = error.argmin(axis=1)
        return codes[np.arange(n), best]

    def decode(self, codes: np.ndarray) -> np.ndarray:
        return sum(words[codes[:, m]] for m, words in enumerate(self.words))

    def norms(self, codes: np.ndarray) -> np.ndarray:
        return np.maximum(np.linalg.norm(self.decode(codes), axis=1), 1e-12)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Lookup tables: books x queries x words."""
        return np.einsum("qd,mwd->mqw", queries, self.words, optimize=True)


def _k_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    centres = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = np.argmin(np.einsum("ij,ij->i", centres, centres) - 2 * (x @ centres.T), axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        counts = np.bincount(own, minlength=k)
        centres = np.where(counts[:, None] > 0, sums / np.maximum(counts, 1)[:, None], x[rng.integers(0, len(x), k)])
    return centres


def fit_codebooks(x: np.ndarray, books: int = BOOKS, words: int = WORDS, rounds: int = ROUNDS, beam: int = BEAM) -> Codebooks:
    """Codebooks of a sample of unit vectors (at least one), of 256 words at most."""
    rng, k, rest, made = np.random.default_rng(SEED), min(words, len(x)), x.copy(), []
    for _ in range(books):
        made.append(_k_means(rest, k, rng))
        own = np.argmin(np.einsum("ij,ij->i", made[-1], made[-1]) - 2 * (rest @ made[-1].T), axis=1)
        rest = rest - made[-1][own]
    best = Codebooks(np.stack(made))
    for _ in range(rounds):
        codes = best.encode(x, beam).astype(np.int64)
        words_, rest = best.words.copy(), x - best.decode(codes)
        for _ in range(SWEEPS):
            for m, own in enumerate(codes.T):
                # With all other books as they are, a word is the mean of what it has to make up.
                rest += words_[m, own]
                sums = np.zeros_like(words_[m])
                np.add.at(sums, own, rest)
                counts = np.bincount(own, minlength=k)[:, None]
                words_[m] = np.where(counts > 0, sums / np.maximum(counts, 1), words_[m])
                rest -= words_[m, own]
        best = Codebooks(words_)
    return best


def _unit(vectors: list) -> np.ndarray:
    x = np.array(vectors, np.float64)
    x /= np.abs(x).max(axis=1, keepdims=True)  # so that squares neither overflow nor vanish
    return x / np.linalg.norm(x, axis=1)[:, None]


def _column(batch: pa.RecordBatch, name: str) -> list:
    column = batch.column(name)
    flat, cuts = column.values.to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    return [flat[a:b] for a, b in zip(cuts, cuts[1:])]


def usable(vectors: DataFrame) -> DataFrame:
    """vec_id, v of the rows that take part: the embedding is there, not zero, and finite, and
    the row has a vec_id. Adding zero makes -0.0 and 0.0 equal."""
    v = F.col("embedding")
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    able = F.coalesce((F.size(v) > 0) & finite & F.exists(v, lambda x: x != 0), F.lit(False))
    zero = F.lit(0).cast(vectors.schema["embedding"].dataType.elementType)
    return vectors.where(F.col("vec_id").isNotNull() & able).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform(v, lambda x: x + zero).alias("v"))


def distinct_vectors(rows: DataFrame, k: int) -> DataFrame:
    """node, h, h2, dim, v, ids of the distinct vectors of ``usable`` rows; ids are the k + 1
    smallest of their rows, which are all that the nearest k of any query can hold."""
    hashed = rows.withColumns({"h": F.xxhash64("v"), "h2": F.xxhash64(F.lit("second"), F.col("v"))})
    place = F.row_number().over(Window.partitionBy("h", "h2").orderBy("vec_id"))
    ids = hashed.select("h", "h2", "vec_id").withColumn("_place", place).where(F.col("_place") <= k + 1)
    ids = ids.groupBy("h", "h2").agg(F.sort_array(F.collect_list("vec_id")).alias("ids"))
    once = hashed.groupBy("h", "h2").agg(F.first("v").alias("v"))
    return once.join(ids, ["h", "h2"]).select(F.monotonically_increasing_id().alias("node"), "h", "h2", F.size("v").alias("dim"), "v", "ids")


def encoded(nodes: DataFrame, books: Codebooks, blocks: int) -> DataFrame:
    """Blocks of codes (block, nodes, codes, norms): all distinct vectors, packed by a hash."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = books.encode(_unit(_column(batch, "v")))
                packed = [c.tobytes() for c in codes]
                yield pa.RecordBatch.from_arrays([batch.column("node"), batch.column("block"), pa.array(packed, pa.binary()), pa.array(books.norms(codes))], ["node", "block", "code", "norm"])

    def pack(table: pa.Table) -> pa.Table:
        table = table.sort_by("node")
        return pa.table({
            "block": table.column("block")[:1], "nodes": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()),
            "codes": pa.array([b"".join(table.column("code").to_pylist())], pa.binary()), "norms": pa.array([table.column("norm").to_numpy().astype(np.float32).tobytes()], pa.binary()),
        })

    placed = nodes.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(blocks)).cast("int").alias("block"))
    coded = placed.mapInArrow(code, "node long, block int, code binary, norm double")
    return coded.groupBy("block").applyInArrow(pack, "block int, nodes binary, codes binary, norms binary")


def scored(tables: np.ndarray, codes: np.ndarray, norms: np.ndarray) -> np.ndarray:
    """queries x rows: approximate cosines, as sums of table entries over the stored norms."""
    total = np.zeros((tables.shape[1], len(codes)), np.float32)
    for m, own in enumerate(tables):
        total += np.take(own, codes[:, m], axis=1)
    return total / norms


def best_of(scores: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k greatest of each row, of equals the first; all, if fewer."""
    if scores.shape[1] <= k:
        return np.tile(np.arange(scores.shape[1]), (len(scores), 1))
    out = np.empty((len(scores), k), np.int64)
    least = np.partition(scores, -k, axis=1)[:, -k]
    for i, (row, at) in enumerate(zip(scores, least)):
        above = np.flatnonzero(row > at)
        out[i] = np.concatenate([above, np.flatnonzero(row == at)[: k - len(above)]])
    return out


def _candidates(nodes: DataFrame, asked: DataFrame, books: Codebooks, n: int, n_asked: int, keep: int) -> DataFrame:
    """q, node: for each asked node (node, v) its ``keep`` approximate neighbours among all."""
    code_blocks, query_blocks = max(MIN_BLOCKS, -(-n // CODE_BLOCK)), max(1, -(-n_asked // QUERY_BLOCK))
    codes = written(encoded(nodes, books, code_blocks), "code-blocks")

    def pack(table: pa.Table) -> pa.Table:
        unit = _unit([np.array(v) for v in table.column("v").to_pylist()]).astype(np.float32)
        return pa.table({"part": table.column("part")[:1], "asked": pa.array([table.column("node").to_numpy().tobytes()], pa.binary()), "units": pa.array([unit.tobytes()], pa.binary())})

    parted = asked.select("node", "v", F.pmod(F.xxhash64("node"), F.lit(query_blocks)).cast("int").alias("part"))
    queries = written(parted.groupBy("part").applyInArrow(pack, "part int, asked binary, units binary"), "query-blocks")
    each = lambda size: F.explode(F.sequence(F.lit(0), F.lit(size - 1)))
    meeting = codes.withColumn("part", each(query_blocks)).hint("merge").join(queries.withColumn("block", each(code_blocks)), ["block", "part"])
    dim = books.words.shape[2]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                node, q = np.frombuffer(row["nodes"], np.int64), np.frombuffer(row["asked"], np.int64)
                code = np.frombuffer(row["codes"], np.uint8).reshape(len(node), -1)
                norm, unit = np.frombuffer(row["norms"], np.float32), np.frombuffer(row["units"], np.float32).reshape(-1, dim)
                for at in range(0, len(q), _TILE):
                    approx = scored(books.tables(unit[at : at + _TILE].astype(np.float64)).astype(np.float32), code, norm)
                    near = best_of(approx, keep)
                    told = [np.repeat(q[at : at + _TILE], near.shape[1]), node[near].ravel(), np.take_along_axis(approx, near, 1).ravel()]
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in told], ["q", "node", "approx"])

    found = meeting.select("nodes", "codes", "norms", "asked", "units").repartition(min(code_blocks * query_blocks, 20_000)).mapInArrow(search, "q long, node long, approx float")
    own = Window.partitionBy("q").orderBy(F.col("approx").desc(), "node")
    return found.withColumn("_rank", F.row_number().over(own)).where(F.col("_rank") <= keep).select("q", "node")


def cosine(a: str, b: str) -> F.Column:
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, w: u.cast("double") * w.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return dot(a, b) / (F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def nearest_vectors(vectors: DataFrame, queries: DataFrame | None = None, k: int = NEAREST, keep: int = RERANKED) -> DataFrame:
    """The k nearest rows of ``vectors`` (vec_id, embedding) for each row of ``queries`` (a part of
    ``vectors``; all of it if None): query_id, rank (from 1), vec_id, score, the cosine in double.

    A query's own row is left out; other rows of its vec_id are not. Equal scores go by vec_id;
    repeated rows are candidates of their own. Embeddings that are null, empty, zero or hold
    null or non-finite components take no part, nor do rows without vec_id; vectors of different
    lengths are not compared, and each length has codebooks of its own. Fewer candidates than k
    give all. Codebooks are fitted on ``SAMPLE`` vectors at most; all others are coded. Only
    vec_id and embedding are read, so other columns can't clash. No rows give none.
    """
    spark = vectors.sparkSession
    with scratch(spark) as result:
        nodes = written(distinct_vectors(usable(vectors), k), "distinct-vectors")
        asked = usable(vectors if queries is None else queries).select("vec_id", F.xxhash64("v").alias("h"), F.xxhash64(F.lit("second"), F.col("v")).alias("h2"))
        many = written(asked.groupBy("h", "h2").agg(F.count("*").alias("many")), "asked-vectors")
        parts = []
        for dim, n in sorted((r.dim, r.n) for r in nodes.groupBy("dim").agg(F.count("*").alias("n")).collect()):
            own = nodes.where(F.col("dim") == dim)
            wanted = written(own.join(many, ["h", "h2"]).select("node", "h", "h2", "many", "v"), "asked-nodes")
            n_asked = wanted.count()
            if not n_asked:
                continue
            sample = own.orderBy(F.xxhash64(F.lit(SEED), "h"), "h", "h2").limit(SAMPLE).select("v").toArrow()
            books = fit_codebooks(_unit([np.array(v) for v in sample.column("v").to_pylist()]))
            found = _candidates(own, wanted, books, n, n_asked, keep)
            # Pairs meet their vectors by shuffles; for each query node the best k + 1 rows stay.
            pairs = found.join(own.select("node", "v", "ids"), "node").join(wanted.select(F.col("node").alias("q"), F.col("v").alias("qv")), "q")
            exact = pairs.select("q", "node", "ids", cosine("v", "qv").alias("score"))
            flat = exact.select("q", "node", "score", F.explode("ids").alias("vec_id"))
            best = Window.partitionBy("q").orderBy(F.col("score").desc(), "vec_id")
            top = flat.withColumn("_rank", F.row_number().over(best)).where(F.col("_rank") <= k + 1)
            listed = top.groupBy("q").agg(F.transform(F.sort_array(F.collect_list(F.struct("_rank", "vec_id", "score", (F.col("node") == F.col("q")).alias("same")))), lambda x: x.dropFields("_rank")).alias("near"))
            parts.append(wanted.select("h", "h2", "many", F.col("node").alias("q")).join(listed, "q").select("h", "h2", "many", "near"))
        if not parts:
            return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
        lists = result(written(reduce(DataFrame.unionByName, parts), "nearest"))
    rows = looked_up(asked, lists, ["h", "h2"], "many")
    # The query's own row is the first of its vec_id and vector; if it isn't there, the last goes.
    at = F.array_position(F.transform("near", lambda x: F.coalesce(x["same"] & (x["vec_id"] == F.col("vec_id")), F.lit(False))), True)
    others = F.slice(F.when(at > 0, F.filter("near", lambda x, i: i + 1 != at)).otherwise(F.col("near")), 1, k)
    out = rows.select(F.col("vec_id").alias("query_id"), F.posexplode(others).alias("_i", "x"))
    return out.select("query_id", (F.col("_i") + 1).cast("int").alias("rank"), F.col("x.vec_id").alias("vec_id"), F.col("x.score").alias("score"))


#: One row in so many is a query of op13.
QUERY_STEP = 50


def op13_additive_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return nearest_vectors(vectors, vectors.where(F.col("vec_id") % QUERY_STEP == 0))
