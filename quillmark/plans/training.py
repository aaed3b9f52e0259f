"""Out-of-fold scores of matched pairs, then a fit on all of them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import model, ranks, resampling
from quillmark.operators.ordered import numbered
from quillmark.sources.staging import staged


def fold_table(pairs: DataFrame, k: int = 5, seed: int = S.SEED) -> DataFrame:
    """uid, fold: both members of a pair in one fold, dealt by the seeded generator. The order is
    made by one task, as its stream is sequential, and meets the pairs by their numbers."""
    placed = numbered(pairs.select("pair", "bot", "human"), "pair", "at")
    n = pairs.count()

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows and n:
                fold = resampling.pair_folds([[i] for i in range(n)], np.ones(n), k, np.random.default_rng(seed))
                own = np.array([fold[i] for i in range(n)], np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(own)], ["at", "fold"])

    folds = pairs.sparkSession.range(0, 1, 1, 1).mapInArrow(deal, "at long, fold int")
    return placed.join(folds, "at").select(F.explode(F.array("bot", "human")).alias("uid"), "fold")


def hashed_folds(pairs: DataFrame, k: int = 5, seed: int = 0) -> DataFrame:
    """uid, fold: as ``fold_table``, dealt by a hash of the bots' ids."""
    return resampling.hash_folds(pairs.select("bot", "human"), [], "bot", k, seed).select(F.explode(F.array("bot", "human")).alias("uid"), "fold")


def train(long: DataFrame, pairs: DataFrame, folds: DataFrame | None = None) -> tuple[model.Bundle, DataFrame, DataFrame]:
    """long (uid, block, key, value), pairs (pair, bot, human) to the bundle fitted on all
    pairs, the out-of-fold scores and their AUC; folds (uid, fold) are seeded if none are given."""
    rows = staged(long.join(_sides(pairs), "uid"), "matched")
    oof = staged(model.out_of_fold(rows, fold_table(pairs) if folds is None else folds), "out-of-fold")
    return model.fit_bundle(rows), oof, ranks.auc(oof, [], "L", F.col("is_bot"))


def _sides(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array(F.struct(F.col("bot").alias("uid"), F.lit(True).alias("is_bot")), F.struct(F.col("human").alias("uid"), F.lit(False).alias("is_bot")))).alias("s")).select("s.*")


def out_of_fold_scores(long: DataFrame, pairs: DataFrame, folds: DataFrame) -> DataFrame:
    """The out-of-fold scores alone."""
    return model.out_of_fold(staged(long.join(_sides(pairs), "uid"), "matched"), folds)
