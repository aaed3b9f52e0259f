"""A language identifier of character trigrams, trained on labelled texts.

A trigram of code points falls into one of a fixed number of buckets, so the model has the size
of buckets times languages whatever the corpus. Tasks count the buckets of their texts; a
language's logarithms are smoothed by one. A text's score for a language is the sum over all its
trigrams, and the margin is what the best is ahead of the second, for one trigram.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed by the model: buckets, and the multipliers of a trigram's first and second letter.
BUCKETS, FIRST, SECOND = 1 << 16, 961, 31
#: Languages of a model at most; its table is sent to all tasks.
MOST_LANGUAGES = 200


def buckets(text: str | None) -> np.ndarray:
    """The bucket of each trigram of a text in lower case; none below three letters."""
    c = np.frombuffer((text or "").lower().encode("utf-32-le"), "<u4").astype(np.int64)
    return (c[:-2] * FIRST + c[1:-1] * SECOND + c[2:]) % BUCKETS


class Model(NamedTuple):
    languages: list[str]
    logs: np.ndarray  # buckets x languages

    def scores(self, text: str | None) -> tuple[np.ndarray, int]:
        own = buckets(text)
        return self.logs[own].sum(axis=0), len(own)

    def best(self, text: str | None) -> tuple[str | None, float | None]:
        """The language, of equals the first by name, and the margin; nulls for a text without
        trigrams, no margin for a single language."""
        scores, n = self.scores(text)
        if not n or not self.languages:
            return None, None
        order = np.argsort(-scores, kind="stable")
        return self.languages[order[0]], float(scores[order[0]] - scores[order[1]]) / n if len(order) > 1 else None

    def identify(self, text: Column) -> Column:
        """struct(lang, margin) of a text column."""
        best = self.best

        @F.pandas_udf("lang string, margin double")
        def found(column: pd.Series) -> pd.DataFrame:
            return pd.DataFrame([best(t) for t in column], columns=["lang", "margin"])

        return found(text)

    def language(self, text: Column) -> Column:
        return self.identify(text)["lang"]


def fit(docs: DataFrame, text: str = "text", label: str = "lang") -> Model:
    """A model of the labelled rows; rows without label or trigrams say nothing. Sums of buckets
    meet by (language, bucket), and the driver gets those alone."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for name, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums[name] = sums.get(name, 0) + np.bincount(buckets(t), minlength=BUCKETS)
                if len(sums) > MOST_LANGUAGES:
                    raise ValueError(f"over {MOST_LANGUAGES} languages")
        for name, n in sums.items():
            some = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(some), pa.string()), pa.array(some, pa.int64()), pa.array(n[some], pa.int64())], ["lang", "bucket", "n"])

    rows = docs.where(F.col(label).isNotNull()).select(label, text).mapInArrow(count, "lang string, bucket long, n long")
    found = rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(found["lang"].unique())
    n = np.zeros((BUCKETS, len(languages)))
    for i, name in enumerate(languages):
        own = found[found["lang"] == name]
        n[own["bucket"], i] = own["n"]
    return Model(languages, np.log((n + 1) / (n.sum(axis=0) + BUCKETS)))
