"""Periodic runs of words, found by bit-parallel lags, and texts without their repeats.

The words of a text get ids, and the bits of the ids make planes: big integers with one bit
for each word. A plane XOR itself shifted by a lag has a bit wherever the words a lag apart
differ in that bit of their ids; planes are ORed. What is long enough among the zeros is
isolated by ANDing the matches with themselves shifted by 1, 2, 4, ... up to the length
wanted. Two planes leave nothing of that length at most lags, so the others are seldom read.

A run of exponent e holds each of its words e times at least, so a word with fewer occurrences
can't lie in one: such words cut the text into parts, which are cut again by their own counts
until nothing changes. Lags are tried within the parts. For a part of m words the work is
m / 4 lags of m bits each, so it grows with the square of a part that has no rare word.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import dealt, small_batches, table

MIN_LENGTH = 6
MIN_EXPONENT = 4
_SPACE = r"[\x20\x09-\x0D]+"


class Run(NamedTuple):
    start: int
    length: int
    period: int


def word_ids(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.array([known.setdefault(w, len(known)) for w in words], np.int64)


def parts(ids: np.ndarray, least: int, length: int) -> list[tuple[int, int]]:
    """(start, end) of the stretches in which every id occurs ``least`` times or more, of
    ``length`` words or more."""
    out, open_ = [], [(0, len(ids))]
    while open_:
        start, end = open_.pop()
        if end - start < length:
            continue
        _, own, counts = np.unique(ids[start:end], return_inverse=True, return_counts=True)
        rare = np.flatnonzero(counts[own] < least)
        if not len(rare):
            out.append((start, end))
            continue
        cuts = np.concatenate([[-1], rare, [end - start]]) + start
        open_ += [(a + 1, b) for a, b in zip(cuts.tolist(), cuts[1:].tolist()) if b - a - 1 >= length]
    return out


def _planes(ids: np.ndarray) -> list[int]:
    own = np.unique(ids, return_inverse=True)[1]
    bits = max(1, int(own.max()).bit_length())
    return [int.from_bytes(np.packbits((own >> b & 1).astype(np.uint8), bitorder="little").tobytes(), "little") for b in range(bits)]


def _stretches(matches: int, need: int) -> int:
    """A bit for each place from which ``need`` matches follow one another."""
    have = 1
    while have < need and matches:
        step = min(have, need - have)
        matches &= matches >> step
        have += step
    return matches


def _set_bits(x: int) -> list[int]:
    raw = np.frombuffer(x.to_bytes((x.bit_length() + 7) // 8, "little"), np.uint8)
    return np.flatnonzero(np.unpackbits(raw, bitorder="little")).tolist()


def _runs_of_part(ids: np.ndarray, offset: int, min_length: int, exponent: int) -> Iterator[Run]:
    n, planes = len(ids), _planes(ids)
    seen: set[tuple[int, int]] = set()
    for q in range(1, n // exponent + 1):
        need = max(min_length, exponent * q) - q
        if n - q < need:
            break
        full, miss, at = (1 << (n - q)) - 1, 0, 0
        found = full
        while found and at < len(planes):  # two planes, then all others
            for plane in planes[at : 2 if at == 0 else None]:
                miss |= plane ^ (plane >> q)
            at = 2 if at == 0 else len(planes)
            found = _stretches((miss & full) ^ full, need)
        if not found:
            continue
        # Places in a row are one stretch; its first and last place have no neighbour.
        firsts, lasts = _set_bits(found & ~(found << 1)), _set_bits(found & ~(found >> 1))
        for first, last in zip(firsts, lasts):
            # A smaller period of such a stretch divides this one and has the same bounds.
            length = last - first + need + q
            if (first, length) not in seen:
                seen.add((first, length))
                yield Run(offset + first, length, q)


def find_runs(words: list[bytes], min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> list[Run]:
    """The runs of a text's words by start, then period: maximal stretches of a smallest period
    q and at least max(min_length, exponent * q) words; exponent is 2 or more."""
    if len(words) < max(min_length, exponent):
        return []
    ids = word_ids(words)
    return sorted((r for a, b in parts(ids, exponent, max(min_length, exponent)) for r in _runs_of_part(ids[a:b], a, min_length, exponent)), key=lambda r: (r.start, r.period))


def kept_words(words: list[bytes], runs: list[Run]) -> list[bytes]:
    """The words that no run holds after its first period."""
    if not runs:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    covered = np.cumsum(change)[:-1] > 0
    return [w for w, c in zip(words, covered.tolist()) if not c]


_ADDED = "n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"


def collapse_runs(docs: DataFrame, min_length: int = MIN_LENGTH, exponent: int = MIN_EXPONENT) -> DataFrame:
    """``docs`` (doc_id, text) to doc_id, n_words, runs (by start, then period) and collapsed, the
    text's kept words joined by one space.

    Words are runs of characters other than space and U+0009 to U+000D. A null or empty text
    has no words, no runs and an empty collapsed text. Nothing crosses rows: repeated rows are
    judged each for itself, a null doc_id stays, an empty table gives no rows, and no shuffle
    is needed. A text is read whole whatever its length. Stretches of equal bounds have one
    smallest period, so there are no ties. Columns besides doc_id and text are not read, so
    their names can't clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([(c, pa.int64()) for c in Run._fields]))
        for batch in batches:
            counts, found, texts = [], [], []
            for text in batch.column("text").to_pylist():
                words = (text or "").encode().split()  # bytes split at these very characters
                runs = find_runs(words, min_length, exponent)
                counts.append(len(words))
                found.append([r._asdict() for r in runs])
                texts.append(b" ".join(kept_words(words, runs)).decode())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(found, kind), pa.array(texts, pa.string())], ["doc_id", "n_words", "runs", "collapsed"]
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, f"doc_id {kind}, {_ADDED}")


def planted(doc_id: Column, text: Column) -> Column:
    """The text whose words repeat from some place on, for one document in ten; see op11."""
    words = F.array_remove(F.split(F.coalesce(text, F.lit("")), _SPACE), "")
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeating(w: Column) -> Column:
        a = F.pmod(g, F.size(w))
        p = 1 + F.floor((F.size(w) - a) / (3 + g % 8))
        at = F.struct(a.alias("a"), p.alias("p"))
        body = lambda x: F.transform(w, lambda word, i: F.when(i < x["a"], word).otherwise(F.get(w, (x["a"] + (i - x["a"]) % x["p"]).cast("int"))))
        return F.transform(F.array(at), body)[0]

    return F.when((h % 10 == 0), F.array_join(F.transform(F.array(words), lambda w: F.when(F.size(w) > 0, repeating(w)).otherwise(w))[0], " ")).otherwise(text)


def run_digests(found: DataFrame) -> DataFrame:
    """What ``collapse_runs`` found, as counts, the run of greatest exponent, and digests."""
    # The greatest exact ratio, of equals the first: lengths are compared across.
    ahead = lambda a, b: b["length"] * a["period"] > a["length"] * b["period"]
    best = F.aggregate(F.slice("runs", 2, F.greatest(F.size("runs") - 1, F.lit(0))), F.get("runs", F.lit(0)), lambda a, b: F.when(ahead(a, b), b).otherwise(a))
    told = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string"))), "\n")
    out = found.withColumn("_b", best)
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("_b.start").alias("start"), F.col("_b.length").alias("length"), F.col("_b.period").alias("period"),
        F.floor(1000 * F.col("_b.length") / F.col("_b.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.when(F.size("runs") > 0, F.concat(told, F.lit("\n"))).otherwise("").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document after repeats were planted in one of ten by its doc_id; a null
    doc_id has none planted. Otherwise as ``collapse_runs`` says."""
    docs = dealt(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return run_digests(collapse_runs(docs.select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))))
