"""What the span finders share: kinds, the digest of a text's spans, and the query's columns."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame

from .shared import small_batches


class Span(NamedTuple):
    start: int
    end: int
    kind: str
    score: float = 1.0


def joined(spans: list[Span], kinds: tuple[str, ...]) -> str:
    """kind:start:end by start, then by the kinds' order."""
    rank = {k: i for i, k in enumerate(kinds)}
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (s.start, rank[s.kind], s.end)))


def digests(docs: DataFrame, find: Callable[[str], list[Span]], kinds: tuple[str, ...], base: tuple[str, ...], scores: bool = False) -> DataFrame:
    """doc_id, a count per base kind, base_sha256 and spans for each row of docs (doc_id, text);
    with ``scores`` those of the spans in their order, two digits each."""
    told = ["base_sha256", "spans", *(["scores"] if scores else [])]
    schema = "doc_id long, " + ", ".join([*(f"n_{k} long" for k in base), *(f"{c} string" for c in told)])
    names = ["doc_id", *(f"n_{k}" for k in base), *told]
    types = [pa.int64()] * (1 + len(base)) + [pa.string()] * len(told)
    rank = {k: i for i, k in enumerate(kinds)}

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            out = []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spans = find(text or "")
                own = [s for s in spans if s.kind in base]
                counts = [sum(s.kind == k for s in own) for k in base]
                row = (key, *counts, hashlib.sha256(joined(own, kinds).encode()).hexdigest(), joined(spans, kinds))
                if scores:
                    row += (",".join(f"{s.score:.2f}" for s in sorted(spans, key=lambda s: (s.start, rank[s.kind], s.end))),)
                out.append(row)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], names)

    return small_batches(docs.select("doc_id", "text")).mapInArrow(run, schema)
