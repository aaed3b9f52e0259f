"""Token-id files: each document compressed by itself against one trained dictionary.

Layout of a shard: ``MAGIC``, dictionary hash (32 bytes), id width (1 byte: 2 or 4), then
one zstandard frame per document, then the index (frame offsets as u64, document ids as
i64, a null mark as u8, token counts as u32), then its start and the number of documents
(two u64), a crc32 of the index (u32) and ``MAGIC`` again. A reader takes the index from
the end of the file and any single document from its offsets; it needs the dictionary
file of the same hash beside the shard.

Shards hold ascending document ids, and their names sort in that order.
"""

from __future__ import annotations

import hashlib
import io
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .encoding import encoder
from .shared import committed, new_place, opened, small_batches, written

MAGIC = b"QMTOKEN1"
_TAIL = struct.Struct("<QQI8s")
#: The dictionary is trained on at most so many documents, of so many ids each.
DICTIONARY_SAMPLE_DOCS = 512
DICTIONARY_SAMPLE_IDS = 4096
#: Characters of a sample document that reach the driver.
DICTIONARY_SAMPLE_CHARS = 4 * DICTIONARY_SAMPLE_IDS
DICTIONARY_BYTES = 64 * 1024
SHARD_BYTES = 128 << 20
READ_ROWS = 8192
BATCH_CHARS = 4 << 20


def train_dictionary(samples: list[bytes], size: int = DICTIONARY_BYTES) -> bytes:
    """A zstandard dictionary; raw content where the samples are too few to train on."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except zstandard.ZstdError:
        return (b"".join(samples)[-size:] or bytes(8)).ljust(8, b"\0")


def _dictionary(data: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(data)


class ShardWriter:
    def __init__(self, out, dictionary: bytes, width: int):
        self._out, self.at, self._kind = out, 0, f"<u{width}"
        self._zstd = zstandard.ZstdCompressor(level=3, dict_data=_dictionary(dictionary))
        self.offsets, self.ids, self.nulls, self.counts = [], [], [], []
        self._put(MAGIC + hashlib.sha256(dictionary).digest() + bytes([width]))

    def _put(self, data: bytes) -> None:
        self._out.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.offsets.append(self.at)
        self.ids.append(0 if doc_id is None else doc_id)
        self.nulls.append(doc_id is None)
        self.counts.append(len(ids))
        self._put(self._zstd.compress(ids.astype(self._kind).tobytes()))

    def close(self) -> None:
        index = b"".join(
            np.array(x, dtype=t).tobytes()
            for x, t in ((self.offsets + [self.at], "<u8"), (self.ids, "<i8"), (self.nulls, "u1"), (self.counts, "<u4"))
        )
        start = self.at
        self._put(index + _TAIL.pack(start, len(self.ids), zlib.crc32(index), MAGIC))


class ShardReader:
    """Random access to the documents of a shard."""

    def __init__(self, file, dictionary: bytes):
        self._file = file
        file.seek(0)
        head = file.read(len(MAGIC) + 33)
        if head[:8] != MAGIC:
            raise ValueError("not a token shard")
        if head[8:40] != hashlib.sha256(dictionary).digest():
            raise ValueError("the shard was written with another dictionary")
        self._kind = f"<u{head[40]}"
        file.seek(-_TAIL.size, io.SEEK_END) if isinstance(file, io.IOBase) else file.seek(file.size() - _TAIL.size)
        start, n, crc, magic = _TAIL.unpack(file.read(_TAIL.size))
        file.seek(start)
        index = file.read(8 * (n + 1) + 13 * n)
        if magic != MAGIC or zlib.crc32(index) != crc:
            raise ValueError("the shard's index is damaged")
        self.offsets = np.frombuffer(index, "<u8", n + 1)
        self.doc_ids = np.frombuffer(index, "<i8", n, 8 * (n + 1))
        self.nulls = np.frombuffer(index, "u1", n, 8 * (n + 1) + 8 * n)
        self.counts = np.frombuffer(index, "<u4", n, 8 * (n + 1) + 9 * n)
        self._zstd = zstandard.ZstdDecompressor(dict_data=_dictionary(dictionary))

    def __len__(self) -> int:
        return len(self.doc_ids)

    def document(self, i: int) -> np.ndarray:
        a, b = int(self.offsets[i]), int(self.offsets[i + 1])
        self._file.seek(a)
        return self._ids(self._file.read(b - a), i)

    def _ids(self, frame: bytes, i: int) -> np.ndarray:
        size = int(self.counts[i]) * int(self._kind[2])
        ids = np.frombuffer(self._zstd.decompress(frame, max_output_size=max(size, 1)), self._kind)
        if len(ids) != self.counts[i]:
            raise ValueError("a document's length differs from the index")
        return ids

    def __iter__(self) -> Iterator[tuple[int | None, np.ndarray]]:
        """All documents, reading a few megabytes at a time."""
        i = 0
        while i < len(self):
            j = max(i + 1, int(np.searchsorted(self.offsets, self.offsets[i] + (4 << 20), "right")) - 1)
            base = int(self.offsets[i])
            self._file.seek(base)
            block = self._file.read(int(self.offsets[j]) - base)
            for k in range(i, j):
                ids = self._ids(block[int(self.offsets[k]) - base : int(self.offsets[k + 1]) - base], k)
                yield (None if self.nulls[k] else int(self.doc_ids[k])), ids
            i = j


def batches(rows: Iterator[pa.RecordBatch], text: str, size: int = BATCH_CHARS) -> Iterator[tuple[list, list[str]]]:
    """(ids, texts) of about ``size`` characters; a null text is empty."""
    keys, texts, chars = [], [], 0
    for batch in rows:
        for key, t in zip(batch.column(0).to_pylist(), batch.column(text).to_pylist()):
            keys.append(key)
            texts.append(t or "")
            chars += len(texts[-1])
            if chars >= size:
                yield keys, texts
                keys, texts, chars = [], [], 0
    if keys:
        yield keys, texts


_MANIFEST = "part long, seq long, uri string, n_docs long, n_tokens long"


def write_token_files(docs: DataFrame, tokenizer: str, end_id: int, place: str | None = None) -> tuple[DataFrame, bytes]:
    """Encode ``docs`` (doc_id, text) and write shards in ascending doc_id order.

    Returns the table of shards, itself written, and the dictionary. A range partitioning
    on doc_id and a sort inside each task give the order; a task streams its documents and
    starts a new shard at ``SHARD_BYTES``. Only files of tasks that Spark committed are in
    the table, so repeated or lost tasks leave nothing behind in it. A null doc_id sorts
    first, a null text is empty, repeated rows are documents of their own, in any order among
    themselves; an empty table has no shards. A text is encoded as one whatever its length,
    and a document has a frame of its own. Columns besides doc_id and text are not read, so
    their names can't clash. Strings of special tokens are ordinary text.
    """
    spark = docs.sparkSession
    place = place or new_place(spark, "tokens")
    sample = docs.limit(DICTIONARY_SAMPLE_DOCS).select(F.substring("text", 1, DICTIONARY_SAMPLE_CHARS))
    texts = [r[0] or "" for r in sample.collect()]
    head = encoder(tokenizer)
    width = 2 if max(head.vocabulary, end_id + 1) <= 1 << 16 else 4
    samples = [np.frombuffer(b, "<u4")[:DICTIONARY_SAMPLE_IDS].astype(f"<u{width}").tobytes() for b in head.encode(texts)]
    dictionary = train_dictionary([s for s in samples if s])
    with committed(f"{place}/{hashlib.sha256(dictionary).hexdigest()}.dictionary") as out:
        out.write(dictionary)

    def write(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        source = batches(rows, "text")
        keys, texts = next(source, ([], []))
        while keys:
            uri = f"{place}/{part:08d}-{seq:06d}-{TaskContext.get().taskAttemptId()}.tokens"
            with committed(uri) as out:
                shard = ShardWriter(out, dictionary, width)
                while keys and shard.at < SHARD_BYTES:
                    for key, ids in zip(keys, enc.encode(texts)):
                        shard.add(key, np.append(np.frombuffer(ids, "<u4"), np.uint32(end_id)))
                    keys, texts = next(source, ([], []))
                shard.close()
            yield pa.RecordBatch.from_pydict(
                {"part": [part], "seq": [seq], "uri": [uri], "n_docs": [len(shard.ids)], "n_tokens": [sum(shard.counts)]}
            )
            seq += 1

    ordered = small_batches(docs).select("doc_id", "text").repartitionByRange("doc_id").sortWithinPartitions("doc_id")
    return written(ordered.mapInArrow(write, _MANIFEST), "token-shards"), dictionary


def read_token_files(shards: DataFrame, dictionary: bytes) -> DataFrame:
    """Per document: doc_id, start (ids of all documents before it), n_tokens, ids_crc32.

    A shard's running start is the sum of the parts before its own, over one row per part,
    and of its part's shards before it. Documents are read by one task per shard, which
    passes them on ``READ_ROWS`` at a time.
    """
    parts = shards.groupBy("part").agg(F.sum("n_tokens").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    parts = parts.select("part", F.coalesce(before, F.lit(0)).alias("_parts"))
    within = F.sum("n_tokens").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1))
    placed = shards.withColumn("_within", F.coalesce(within, F.lit(0))).join(parts, "part")
    placed = placed.select("uri", (F.col("_parts") + F.col("_within")).alias("base"))

    def read(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(out: list[tuple]) -> pa.RecordBatch:
            columns = [pa.array(c, pa.int64()) for c in zip(*out)]
            return pa.RecordBatch.from_arrays(columns, ["doc_id", "start", "n_tokens", "ids_crc32"])

        for batch in rows:
            for row in batch.to_pylist():
                fs, path = opened(row["uri"])
                out, at = [], row["base"]
                with fs.open_input_file(path) as f:
                    for doc_id, ids in ShardReader(f, dictionary):
                        out.append((doc_id, at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                        at += len(ids)
                        if len(out) >= READ_ROWS:
                            yield told(out)
                            out = []
                if out:
                    yield told(out)

    n = max(1, min(shards.count(), 20_000))
    return placed.repartition(n).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op2_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return read_token_files(*write_token_files(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0))
