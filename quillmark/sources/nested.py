"""One JSON object of any size, read entry by entry from byte ranges.

Whether a byte lies in a string, and how deep, depends on all bytes before it. So each range is
first summed up for both cases of its start, inside a string and outside: whether it has an odd
number of quotes, and what it adds to the depth. Sums over the ranges before it tell a range how
it starts, and it yields the entries that start in it, reading on to the end of the last. A
file is never one row; an entry is.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bytes of a range, and of a block that is looked at at once.
RANGE_BYTES = 64 << 20
BLOCK_BYTES = 512 << 10
#: Bytes of entries in one Arrow batch, but for one larger entry.
_BATCH_BYTES = 2 << 20

_QUOTE, _BACKSLASH, _COMMA, _OPEN = (ord(c) for c in '"\\,{')
_STEP = np.zeros(256, np.int8)
_STEP[[ord(c) for c in "{["]] = 1
_STEP[[ord(c) for c in "}]"]] = -1


def json_entries(spark: SparkSession, path: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """value: ``{"key": ...}``, one row for each entry of the top-level objects in the file or
    files at ``path``. Entries of a key that comes twice are two rows; an empty object or file
    gives none. A gzip file can't be entered within, so one task streams it.

    The file is taken to be JSON in UTF-8; a value is not looked into. Ranges are opened by
    ``pyarrow.fs``, which has to know the scheme of ``path``.
    """
    files = spark.read.format("binaryFile").load(path).where("length > 0").select("path", "length")
    step = F.when(F.endswith("path", F.lit(".gz")), F.col("length") + 1).otherwise(F.lit(range_bytes))
    starts = files.select("path", F.explode(F.sequence(F.lit(0).cast("long"), F.col("length") - 1, step)).alias("start"), "length", step.alias("step"))
    ranges = starts.select("path", "start", F.when(F.col("step") > F.col("length"), F.lit(1 << 62)).otherwise(F.col("start") + F.col("step")).alias("end"))
    dealt = ranges.repartition(spark.sparkContext.defaultParallelism, "path", "start")
    sums = dealt.mapInArrow(_sums, "path string, start long, end long, odd int, outer long, inner long")
    before = Window.partitionBy("path").orderBy("start").rowsBetween(Window.unboundedPreceding, -1)
    inside = sums.withColumn("inside", F.coalesce(F.sum("odd").over(before) % 2, F.lit(0)) == 1)
    depth = F.coalesce(F.sum(F.when(F.col("inside"), F.col("inner")).otherwise(F.col("outer"))).over(before), F.lit(0))
    known = inside.select("path", "start", "end", "inside", depth.alias("depth"))
    return known.repartition(spark.sparkContext.defaultParallelism, "path", "start").mapInArrow(_entries, "value string")


def _opened(path: str) -> tuple[fs.FileSystem, str]:
    local = re.match(r"file:/*(/.*)", path, re.S)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(path)


def _blocks(path: str, start: int, end: int) -> Iterator[np.ndarray]:
    system, place = _opened(path)
    if path.endswith(".gz"):
        with system.open_input_stream(place, compression="gzip") as f:
            while len(b := f.read(BLOCK_BYTES)):
                yield np.frombuffer(b, np.uint8)
        return
    with system.open_input_file(place) as f:
        size = f.size()
        while start < min(end, size):
            b = f.read_at(min(BLOCK_BYTES, min(end, size) - start), start)
            yield np.frombuffer(b, np.uint8)
            start += len(b)


def _backslashes(path: str, start: int) -> int:
    """How many backslashes end just before ``start``."""
    if not start or path.endswith(".gz"):
        return 0
    system, place = _opened(path)
    with system.open_input_file(place) as f:
        n, size = 0, 64
        while True:
            at = max(0, start - size)
            b = f.read_at(start - at, at)
            n = len(b) - len(b.rstrip(b"\\"))
            if n < len(b) or not at:
                return n
            size *= 4


def _quotes(block: np.ndarray, run: int) -> tuple[np.ndarray, int]:
    """Positions of the quotes that no backslash escapes, and the backslashes at the end; ``run``
    of them come before the block."""
    other = np.maximum.accumulate(np.where(block == _BACKSLASH, -1, np.arange(len(block))))
    # Backslashes that end at each position.
    runs = np.arange(len(block)) - other + np.where(other < 0, run, 0)
    q = np.flatnonzero(block == _QUOTE)
    ahead = np.where(q > 0, runs[q - 1], run)
    return q[ahead % 2 == 0], int(runs[-1])


def _sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out = []
        for r in batch.to_pylist():
            odd, depth = 0, [0, 0]
            run = _backslashes(r["path"], r["start"])
            for block in _blocks(r["path"], r["start"], r["end"]) if not r["path"].endswith(".gz") else ():
                q, run = _quotes(block, run)
                at = np.flatnonzero(_STEP[block])
                within = (np.searchsorted(q, at) + odd) % 2
                step = _STEP[block[at]].astype(np.int64)
                for i in (0, 1):
                    depth[i] += int(step[within == i].sum())
                odd = (odd + len(q)) % 2
            out.append((r["path"], r["start"], r["end"], odd, *depth))
        names = ["path", "start", "end", "odd", "outer", "inner"]
        kinds = [pa.string(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in out], k) for i, k in enumerate(kinds)], names)


def _entries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, size = [], 0
    for batch in batches:
        for r in batch.to_pylist():
            for entry in _range_entries(r["path"], r["start"], r["end"], r["inside"], r["depth"]):
                held.append("{" + entry.decode("utf-8", "replace") + "}")
                size += len(entry)
                if size > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])
                    held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.string())], ["value"])


def _range_entries(path: str, start: int, end: int, inside: bool, depth: int) -> Iterator[bytes]:
    """The entries whose opening brace or comma lies in the range."""
    run, parity, base = _backslashes(path, start), int(inside), start
    pieces: list[bytes] | None = None  # of the entry that is open, if it started here
    for block in _blocks(path, start, 1 << 62):
        q, run = _quotes(block, run)
        step = _STEP[block].astype(np.int64)
        at = np.flatnonzero((step != 0) | (block == _COMMA))
        at = at[(np.searchsorted(q, at) + parity) % 2 == 0]
        deep = depth + np.cumsum(step[at])
        char = block[at]
        comma = (char == _COMMA) & (deep == 1)
        opened, closed = (char == _OPEN) & (deep == 1), (step[at] < 0) & (deep == 0)
        cut = 0
        for i in np.flatnonzero(comma | opened | closed):
            p = int(at[i])
            if pieces is not None:
                pieces.append(block[cut:p].tobytes())
                if entry := b"".join(pieces).strip():
                    yield entry
            pieces, cut = None, p + 1
            if base + p >= end:
                return
            if not closed[i]:
                pieces = []
        if pieces is not None:
            pieces.append(block[cut:].tobytes())
        base += len(block)
        if base >= end and pieces is None:
            return
        depth = int(deep[-1]) if len(deep) else depth
        parity = (parity + len(q)) % 2
