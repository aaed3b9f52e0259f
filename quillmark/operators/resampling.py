"""Splits, folds, subsamples and donors.

Seeded draws that must agree with a reference generator come from numpy on the driver, where
they are vectors of account ids; variants ordered by a hash need no driver and scale with the
cluster.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S

from .ordered import running


def half_split(accounts: DataFrame, seed: int = S.SPLIT_SEED) -> tuple[DataFrame, dict[str, dict[str, int]]]:
    """accounts (uid, label, source) to (uid, part) and counts: bots, then human sources by
    name, each permuted by one shared generator; the first half (rounded down) develops."""
    spark = accounts.sparkSession
    rows = accounts.where(F.col("label").isin("bot", "human")).select("uid", F.when(F.col("label") == "human", F.col("source")).alias("s")).collect()
    groups: dict[str | None, list[str]] = {}
    for r in rows:
        groups.setdefault(r.s, []).append(r.uid)
    rng, out, counts = np.random.default_rng(seed), [], {}
    for g in [None, *sorted(k for k in groups if k is not None)]:
        uids = sorted(groups.get(g, []))
        order, half = rng.permutation(len(uids)), len(uids) // 2
        out += [(uids[i], "development" if at < half else "confirmation") for at, i in enumerate(order)]
        counts[g or "bot"] = {"all": len(uids), "development": half, "confirmation": len(uids) - half}
    return spark.createDataFrame(out, "uid string, part string"), counts


def _hashed(df: DataFrame, strata: Sequence[str], key: str, seed: int) -> DataFrame:
    """``df`` with _at (from 0, by a seeded hash within its stratum) and _n (of the stratum)."""
    order = F.concat(F.md5(F.concat_ws("|", F.lit(seed), F.col(key))), F.col(key).cast("string"))
    own = running(df.withColumns({"_order": order, "_one": F.lit(1)}), strata, "_order", ["_one"])
    return own.withColumns({"_at": F.col("_one_before"), "_n": F.col("_one_all")}).drop("_order", "_one", "_one_before", "_one_all")


def hash_split(df: DataFrame, strata: Sequence[str], key: str, seed: int = 0) -> DataFrame:
    """``df`` with part: within each stratum the first half in the order of a seeded hash."""
    placed = _hashed(df, strata, key, seed)
    return placed.withColumn("part", F.when(F.col("_at") < F.floor(F.col("_n") / 2), "development").otherwise("confirmation")).drop("_at", "_n")


def pair_folds(units: Sequence[Sequence[int]], y: np.ndarray, k: int, rng: np.random.Generator) -> dict[int, int]:
    """Row to fold: units of the same labels are permuted and dealt in near-equal chunks, so
    both members of a pair share a fold."""
    signature = [tuple(sorted(int(y[i]) for i in u)) for u in units]
    fold: dict[int, int] = {}
    for kind in sorted(set(signature)):
        own = np.array([i for i, s in enumerate(signature) if s == kind])
        for f, chunk in enumerate(np.array_split(own[rng.permutation(len(own))], k)):
            fold.update((int(row), f) for u in chunk for row in units[u])
    return fold


def hash_folds(units: DataFrame, strata: Sequence[str], key: str, k: int = 5, seed: int = 0) -> DataFrame:
    """``units`` with fold: near-equal chunks of the order of a seeded hash within strata, the
    larger ones first."""
    placed = _hashed(units, strata, key, seed)
    size, more = F.floor(F.col("_n") / k), F.col("_n") % k
    late = F.when(size > 0, more + F.floor((F.col("_at") - more * (size + 1)) / F.nullif(size, F.lit(0))))
    fold = F.when(F.col("_at") < more * (size + 1), F.floor(F.col("_at") / (size + 1))).otherwise(late)
    return placed.withColumn("fold", fold.cast("int")).drop("_at", "_n")


def interval(df: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """keys, lo, hi: the central 95 %."""
    out = df.groupBy(*keys).agg(F.percentile(value, F.array(F.lit(0.025), F.lit(0.975))).alias("_q"))
    return out.select(*keys, F.col("_q")[0].alias("lo"), F.col("_q")[1].alias("hi"))


def subsample(uids: Sequence[str], percent: int, others: int, seed: int) -> list[str]:
    """Bots for a set in which they are ``percent`` beside ``others`` humans."""
    n = int(round(others * percent / (100 - percent)))
    rng = np.random.default_rng([S.WORLD_SEED, S.EXPERIMENT, 2, percent, seed])
    return sorted(rng.choice(np.array(sorted(uids)), n, replace=False).tolist())


def donors(seed: Sequence[int], own: Sequence[str], other: Sequence[str]) -> list[tuple[str, str]]:
    """(uid, donor) for each of ``own``, drawn from ``other`` with replacement."""
    pick = np.random.default_rng(list(seed)).integers(0, len(other), size=len(own))
    return [(u, other[i]) for u, i in zip(own, pick)]

