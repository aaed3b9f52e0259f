"""Vector bin packing of examples into sequences of bounded tokens, segments and loss.

A sequence has three limits: tokens, segments (pieces of examples) and loss-bearing
tokens. Among the waiting examples that fit whole, the one whose demand vector has the
largest dot product with what is left of the limits goes in next; so an example that asks
for what the sequence still has plenty of comes first. When none fits whole, the example of
the largest product is cut to fill the sequence, which then ends full. A sequence that another
limit ends before, or a task's last one, is cut into ones of power-of-two lengths.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from .encoding import MEMO_CHUNKS, encoder
from .shared import dealt, small_batches, table
from .token_files import BATCH_CHARS, batches


class Limits(NamedTuple):
    tokens: int = 4096
    segments: int = 256
    loss: int = 4096


class Piece(NamedTuple):
    example: int
    start: int
    length: int
    sequence: int
    offset: int


#: Examples that wait at a time; a task holds no more of them in memory.
WINDOW = 1024
#: Tokens of a conversation that wait as one example, but for its last turn's.
EXAMPLE_TOKENS = 1 << 20
#: A task numbers its sequences from its partition's number times this.
SEQUENCES_PER_TASK = 1 << 40


class Packer:
    """Places a stream of examples; ``add`` and ``finish`` return the sequences that ended.

    An example is (key, tokens, losses): ``losses`` is None if every token bears loss, else
    the running count of loss-bearing tokens, from 0, one longer than the tokens.
    """

    def __init__(self, limits: Limits = Limits(), window: int = WINDOW):
        if min(limits) < 1:
            raise ValueError("limits must be positive")
        self.limits, self._window = limits, window
        self._keys: list = [None] * window
        self._losses: list = [None] * window
        self._start = np.zeros(window, np.int64)
        self._left = np.zeros(window, np.int64)  # tokens still to place; 0: a free slot
        self._loss = np.zeros(window, np.int64)
        self._free = list(range(window))
        self._weights = np.array([1 / limits.tokens**2, 1 / limits.segments**2, 1 / limits.loss**2])
        self._open()

    def _open(self) -> None:
        self._room = np.array(self.limits, np.int64)
        self._pieces: list[tuple] = []

    def add(self, key, n_tokens: int, losses: np.ndarray | None = None) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        if not n_tokens:
            return out
        while not self._free:
            out += self._place()
        slot = self._free.pop()
        self._keys[slot], self._losses[slot] = key, losses
        self._start[slot], self._left[slot] = 0, n_tokens
        self._loss[slot] = n_tokens if losses is None else int(losses[-1])
        return out

    def finish(self) -> list[list[tuple]]:
        out: list[list[tuple]] = []
        while len(self._free) < self._window:
            out += self._place()
        if self._pieces:
            out += powers_of_two(self._pieces, self.limits.tokens)
            self._open()
        return out

    def _place(self) -> list[list[tuple]]:
        """Put one piece into the open sequence."""
        tokens, segments, loss = self._room
        w = self._room * self._weights
        # A demand beyond a whole sequence counts as one sequence's worth.
        score = (
            np.minimum(self._left, self.limits.tokens) * w[0]
            + w[1]
            + np.minimum(self._loss, self.limits.loss) * w[2]
        )
        waits = self._left > 0
        whole = waits & (self._left <= tokens) & (self._loss <= loss)
        slot = int(np.argmax(np.where(whole if whole.any() else waits, score, -1.0)))
        start, left, losses = int(self._start[slot]), int(self._left[slot]), self._losses[slot]
        n = min(left, int(tokens))
        if losses is None:
            n = spent = min(n, int(loss))
        else:
            # The longest run of tokens whose loss-bearing ones still have room.
            n = min(n, int(np.searchsorted(losses, losses[start] + loss, "right")) - 1 - start)
            spent = int(losses[start + n] - losses[start])
        out: list[list[tuple]] = []
        if n:
            self._pieces.append((self._keys[slot], start, n))
            self._room -= (n, 1, spent)
            self._start[slot] += n
            self._left[slot] -= n
            self._loss[slot] -= spent
            if n == left:
                self._keys[slot] = self._losses[slot] = None
                self._free.append(slot)
        # n is 0 if the next token bears loss and no room for it is left.
        if not n or min(self._room[:2]) == 0:
            # The limit on segments or loss may end it before it is full.
            out += powers_of_two(self._pieces, self.limits.tokens)
            self._open()
        return out


def powers_of_two(pieces: list[tuple], tokens: int) -> list[list[tuple]]:
    """Cut an unfilled sequence into ones of power-of-two lengths, which take no padding."""
    total, out = sum(p[2] for p in pieces), []
    queue = list(reversed(pieces))
    if total >= tokens:
        return [pieces]
    while total:
        room = 1 << (total.bit_length() - 1)
        total -= room
        cut: list[tuple] = []
        while room:
            key, start, n = queue.pop()
            take = min(n, room)
            cut.append((key, start, take))
            if take < n:
                queue.append((key, start + take, n - take))
            room -= take
        out.append(cut)
    return out


def pack(examples: Iterable[tuple], limits: Limits = Limits(), first: int = 0) -> Iterator[tuple]:
    """(key, n_tokens, losses) to (key, start, length, sequence, offset)."""
    packer, sequence = Packer(limits), first

    def told(ended: list[list[tuple]]) -> Iterator[tuple]:
        nonlocal sequence
        for pieces in ended:
            offset = 0
            for key, start, n in pieces:
                yield key, start, n, sequence, offset
                offset += n
            sequence += 1

    for key, n_tokens, losses in examples:
        yield from told(packer.add(key, n_tokens, losses))
    yield from told(packer.finish())


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack_documents(
    docs: DataFrame, tokenizer: str, end_id: int, limits: Limits = Limits(), memo_chunks: int = MEMO_CHUNKS, batch_chars: int = BATCH_CHARS
) -> DataFrame:
    """Encode ``docs`` (doc_id, text) and pack them; one row per piece.

    Each task packs the documents of its own input split, so nothing is shuffled, and holds
    ``WINDOW`` documents at a time. A sequence that is not full, as its segments ran out or as
    it is the task's last, is cut into ones of power-of-two lengths. Every token of a document bears loss. A null text is empty (one
    token, the end id), repeated rows are packed each for itself, and a null doc_id stays
    null; an empty table gives no rows. A text of any length is encoded whole and cut into
    sequences; among examples of one product the first waiting one goes in. Only doc_id and
    text are read, so other columns can't clash. ``memo_chunks`` and ``batch_chars`` trade memory of a worker for time.
    """
    end = struct.pack("<I", end_id)

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer, memo_chunks)

        def examples() -> Iterator[tuple]:
            for keys, texts in batches(rows, "text", batch_chars):
                for key, ids in zip(keys, enc.encode(texts)):
                    ids += end
                    yield (key, ids), len(ids) // 4, None

        out: list[tuple] = []

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], NAMES)
            out.clear()
            return made

        first = TaskContext.get().partitionId() * SEQUENCES_PER_TASK
        for (key, ids), start, n, sequence, offset in pack(examples(), limits, first):
            crc = zlib.crc32(ids[4 * start : 4 * (start + n)])
            out.append((key, start, n, crc, len(ids) // 4, sequence, offset))
            if len(out) >= 8192:
                yield batch()
        if out:
            yield batch()

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, _PIECES)


NAMES = [c.split()[0] for c in _PIECES.split(", ")]


def pack_conversations(turns: DataFrame, tokenizer: str, end_id: int, limits: Limits, loss_role: str = "assistant") -> DataFrame:
    """Instruction data: turns (conv_id, turn, role, text) of a conversation are one example,
    and only tokens of ``loss_role`` bear loss. One row per piece, with its count of them.

    A task streams its conversations in order; turns go by turn number, of equal ones by role
    and text. Of a conversation beyond ``EXAMPLE_TOKENS`` so many tokens wait at a time, as
    examples that follow one another, so none is held whole. A row with a null conv_id is an
    example by itself. Null texts are empty, null roles bear no loss, an empty table gives no
    rows; other columns are not read.
    """
    from pyspark.sql import functions as F

    place = F.coalesce(F.xxhash64("conv_id") + F.when(F.col("conv_id").isNotNull(), 0), F.xxhash64("turn", "role", "text"))
    ordered = turns.select("conv_id", "turn", "role", "text", place.alias("place")).repartition("place")
    ordered = ordered.sortWithinPartitions("conv_id", "turn", "role", "text").drop("place")
    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(tokenizer)

        def parts() -> Iterator[tuple]:
            """(conv_id, tokens, whether they bear loss) of each turn."""
            for batch in rows:
                columns = [batch.column(c).to_pylist() for c in ("conv_id", "role", "text")]
                for key, role, ids in zip(columns[0], columns[1], enc.encode([t or "" for t in columns[2]])):
                    yield key, len(ids) // 4 + 1, role == loss_role

        def source() -> Iterator[tuple]:
            key, base, held, size = None, 0, [], 0

            def example() -> tuple:
                bears = np.repeat([x for _, x in held], [n for n, _ in held])
                losses = np.concatenate([[0], np.cumsum(bears)])
                return (key, base, losses), len(bears), losses

            for other, n, bears in parts():
                if held and (other is None or other != key or size >= EXAMPLE_TOKENS):
                    yield example()
                    base = base + size if other is not None and other == key else 0
                    held, size = [], 0
                key = other
                held.append((n, bears))
                size += n
            if held:
                yield example()

        first, out = TaskContext.get().partitionId() * SEQUENCES_PER_TASK, []
        names = ["conv_id", "start", "length", "n_loss", "sequence_id", "offset"]

        def batch() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], names)
            out.clear()
            return made

        for (key, base, losses), start, n, sequence, offset in pack(source(), limits, first):
            out.append((key, base + start, n, int(losses[start + n] - losses[start]), sequence, offset))
            if len(out) >= 8192:
                yield batch()
        if out:
            yield batch()

    return small_batches(ordered).mapInArrow(run, "conv_id long, start long, length long, n_loss long, sequence_id long, offset long")


def op10_vector_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = dealt(table(spark, sf_dir, "documents"))
    return pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=2)
