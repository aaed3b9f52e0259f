"""Whole texts to token ids with the tokenizers library, one library call per new chunk.

The library's time goes into merging words that it has not met. Where its splitting of a
text can never cross a space (checked from the tokenizer's own file), a text is cut at
spaces, chunks met before come from a bounded memo, and only new ones are encoded. Other
tokenizers get whole texts. Ids are those of the whole text either way (tests compare).

The memo is flat arrays, not objects, so that a worker's memory follows from its limit.
"""

from __future__ import annotations

import gc
import json
import os
import re
import sys
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core

#: Chunks that a worker process remembers, about 40 bytes each; twice that while a batch is
#: looked up. Beyond it the half that was used last stays.
MEMO_CHUNKS = 800_000
#: New chunks that go to the library in one text.
GROUP = 64
#: Longer chunks are not kept.
MEMO_CHARS = 48


#: Letters of Latin-1, which are composed and letters in every version of Unicode.
_WORD = re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,]?")


def _byte_chars() -> dict[int, int]:
    """Byte-level vocabularies write a byte as its Latin-1 character if that is printable, and
    the others, in order, as the characters from U+0100."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: 0x100 + i for i, b in enumerate(b for b in range(256) if b not in shown)}


_BYTE_CHARS = _byte_chars()


def _mode(spec: dict) -> str:
    """How texts may be cut: before a space that a graphic character follows, at spaces
    that vanish, or not at all."""
    if any(not t.get("special") for t in spec.get("added_tokens", [])):
        return "whole"  # they are found before any splitting
    pre = spec.get("pre_tokenizer") or {}
    norm = spec.get("normalizer")
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and norm is None:
        return "leading"
    parts = pre.get("pretokenizers") or []
    steps = {n.get("type") for n in (norm or {}).get("normalizers", [])}
    if (
        len(parts) == 2
        and parts[0].get("type") == "Split"
        and parts[0].get("behavior") == "Removed"
        and parts[0].get("invert")
        and r"[^\s\p{L}\p{N}]+" in parts[0]["pattern"].get("Regex", "")
        and parts[1].get("type") == "ByteLevel"
        and not parts[1].get("use_regex")
        and not parts[1].get("add_prefix_space")
        and steps <= {"NFC", "Replace", "Lowercase"}
    ):
        return "vanishing"
    return "whole"


class _Memo:
    """Chunks met before and where their ids lie in one array."""

    def __init__(self, limit: int):
        self._limit, self._now = max(limit, 2), 0
        self._chunks = pa.array([], pa.string())
        self._used = np.zeros(0, np.int32)
        self.ids, self.starts = np.zeros(0, "<u4"), np.zeros(1, np.int64)

    def places(self, chunks: pa.StringArray) -> np.ndarray:
        """The place of each chunk, -1 for new ones."""
        at = pc.fill_null(pc.index_in(chunks, value_set=self._chunks), -1).to_numpy(zero_copy_only=False)
        self._now += 1
        self._used[at[at >= 0]] = self._now
        return at

    def add(self, chunks: list[str], ids: list[bytes]) -> None:
        """New chunks in parts, so that the memo never passes its limit by more than one."""
        part = max(1, self._limit // 4)
        for a in range(0, len(chunks), part):
            some = ids[a : a + part]
            sizes = np.fromiter(map(len, some), np.int64, len(some)) // 4
            self._chunks = pa.concat_arrays([self._chunks, pa.array(chunks[a : a + part], pa.string())])
            self._used = np.concatenate([self._used, np.full(len(some), self._now, np.int32)])
            self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(sizes)])
            self.ids = np.concatenate([self.ids, np.frombuffer(b"".join(some), "<u4")])
            if len(self._chunks) > self._limit:
                self._halve()

    def _halve(self) -> None:
        last = np.sort(np.argpartition(-self._used, self._limit // 2)[: self._limit // 2])
        sizes = np.diff(self.starts)[last]
        ends = np.cumsum(sizes)
        self.ids = self.ids[np.arange(int(ends[-1])) + np.repeat(self.starts[last] - ends + sizes, sizes)]
        self.starts = np.concatenate([[0], ends])
        self._chunks, self._used = self._chunks.take(pa.array(last)), self._used[last]


class Encoder:
    """``special_text``: the strings of special tokens in a text are ordinary text, as the
    tokenizer files' own description has it; else they become the special tokens' ids."""

    def __init__(self, path: str, memo_chunks: int = MEMO_CHUNKS, special_text: bool = True):
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._library.encode_special_tokens = special_text
        self._library.no_truncation()
        self._library.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.mode = _mode(spec)
        self._lowers = any(n.get("type") == "Lowercase" for n in (spec.get("normalizer") or {}).get("normalizers", []))
        self._special = [] if special_text else [t["content"] for t in spec.get("added_tokens", [])]
        self.vocabulary = self._library.get_vocab_size()
        self._mark = {"leading": "\n", "vanishing": " | "}.get(self.mode)
        if self._mark:
            mark = self._library.encode(self._mark, add_special_tokens=False).ids
            self._mark, self._mark_id = (self._mark, mark[0]) if len(mark) == 1 else (None, None)
        self._tails = {c: self._encoded([c])[0] for c in ".,"}
        self._memo = _Memo(memo_chunks)

    def _encoded(self, texts: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(texts), 256):
            batch = self._library.encode_batch_fast(texts[at : at + 256], add_special_tokens=False)
            out += [array("I", e.ids).tobytes() for e in batch]
        return out if sys.byteorder == "little" else [np.frombuffer(b, "=u4").astype("<u4").tobytes() for b in out]

    def _words(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of chunks that are one word of Latin letters, with a full stop or comma at most.
        Their pieces are known, so they go to the library's model past its text pipeline."""
        out: dict[str, bytes] = {}
        fits, tokenize, tails = _WORD.fullmatch, self._library.model.tokenize, self._tails
        lower, before = self._lowers, "\u0120" if self.mode == "leading" else ""
        for c in chunks:
            if fits(c):
                tail = tails.get(c[-1], b"")
                word = c[:-1] if tail else c
                if lower:
                    word = word.lower()
                if not word.isascii():
                    word = word.encode().decode("latin-1").translate(_BYTE_CHARS)
                out[c] = array("I", [t.id for t in tokenize(before + word)]).tobytes() + tail
        return out

    def _learn(self, chunks: list[str]) -> dict[str, bytes]:
        """Ids of new chunks, many in a library call: a mark between them stands alone in the
        splitting, so its id, which no chunk without its character has, parts them again."""
        lead = " " if self.mode == "leading" else ""
        out = self._words(chunks) if sys.byteorder == "little" else {}
        if self._mark:
            bare, between = self._mark.strip(" "), self._mark + lead
            plain = [c for c in chunks if c not in out and bare not in c]
            groups = [plain[at : at + GROUP] for at in range(0, len(plain), GROUP)]
            for group, ids in zip(groups, self._encoded([lead + between.join(g) for g in groups])):
                cuts = np.flatnonzero(np.frombuffer(ids, "<u4") == self._mark_id)
                if len(cuts) != len(group) - 1:
                    continue  # the mark did not stand alone: one call for each of them below
                edges = [-4, *(4 * cuts).tolist(), len(ids)]
                out.update(zip(group, [ids[a + 4 : b] for a, b in zip(edges, edges[1:])]))
        rest = [c for c in chunks if c not in out] if len(out) < len(chunks) else []
        out.update(zip(rest, self._encoded([lead + c for c in rest])))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if self.mode == "whole" or not texts:
            return self._encoded(texts)
        if self._special:
            whole = [i for i, t in enumerate(texts) if any(x in t for x in self._special)]
            if whole:
                rest = sorted(set(range(len(texts))) - set(whole))
                done = dict(zip(whole, self._encoded([texts[i] for i in whole])))
                done.update(zip(rest, self._by_chunks([texts[i] for i in rest]) if rest else []))
                return [done[i] for i in range(len(texts))]
        collecting = gc.isenabled()
        gc.disable()  # lists of plain strings make no cycles, but collections walk them
        try:
            return self._by_chunks(texts)
        finally:
            if collecting:
                gc.enable()

    def _by_chunks(self, texts: list[str]) -> list[bytes]:
        """Split, number the distinct chunks of the batch, and gather their ids, all in arrays;
        Python sees distinct chunks only."""
        lead, given = self.mode == "leading", pa.array(texts, pa.string())
        split = pc.split_pattern(given, " ") if lead else pc.ascii_split_whitespace(given)
        coded = split.values.dictionary_encode()
        place = coded.indices.to_numpy(zero_copy_only=False).astype(np.int32)
        first = split.offsets.to_numpy().astype(np.int64)
        known = self._memo.places(coded.dictionary)
        new = np.flatnonzero(known < 0)
        chunks = coded.dictionary.take(pa.array(new)).to_pylist()
        odd = np.zeros(len(known), bool)
        if lead:
            # White space after a space was not split off: such texts go to the library whole.
            blank = [not c or c[0].isspace() for c in chunks]
            odd[new] = blank
            new, chunks = new[~odd[new]], [c for c, x in zip(chunks, blank) if not x]
        found = self._learn(chunks)
        learned = [found[c] for c in chunks]
        # A text's first chunk has no space before it, so it is encoded by itself.
        heads = self._encoded(pc.list_element(split, 0).to_pylist()) if lead else []
        extra = [*learned, *heads]
        flat = np.concatenate([self._memo.ids, np.frombuffer(b"".join(extra), "<u4")])
        # Positions of ids: half as wide while a batch has fewer than 2^28 characters.
        kind = np.int32 if sum(map(len, texts)) < 1 << 28 else np.int64
        lengths = np.fromiter(map(len, extra), np.int64, len(extra)) // 4
        begins = len(self._memo.ids) + np.cumsum(lengths) - lengths
        starts, sizes = np.zeros(len(known) + len(heads), kind), np.zeros(len(known) + len(heads), kind)
        met = np.flatnonzero(known >= 0)
        starts[met], sizes[met] = self._memo.starts[known[met]], np.diff(self._memo.starts)[known[met]]
        own = np.concatenate([new, len(known) + np.arange(len(heads))])
        starts[own], sizes[own] = begins, lengths
        kept = [j for j, c in enumerate(chunks) if len(c) <= MEMO_CHARS]
        self._memo.add([chunks[j] for j in kept], [learned[j] for j in kept])
        whole: list[int] = []
        if lead:
            place[first[:-1]] = len(known) + np.arange(len(texts))
            if odd.any():
                odd = np.concatenate([odd, np.zeros(len(texts), bool)])
                whole = np.flatnonzero(np.add.reduceat(odd[place], first[:-1])).tolist()
        own = sizes[place]
        ends = np.cumsum(own, dtype=kind)
        total = int(ends[-1]) if len(ends) else 0
        data = flat[np.arange(total, dtype=kind) + np.repeat(starts[place] - ends + own, own)].tobytes()
        edges = (4 * np.concatenate([[0], ends]).astype(np.int64)[first]).tolist()
        out = [data[a:b] for a, b in zip(edges, edges[1:])]
        for i, encoded in zip(whole, self._encoded([texts[i] for i in whole])):
            out[i] = encoded
        return out


@lru_cache(maxsize=4)
def encoder(path: str, memo_chunks: int = MEMO_CHUNKS, special_text: bool = True) -> Encoder:
    """One for each worker process, which Spark uses for many tasks."""
    return Encoder(path, memo_chunks, special_text)
