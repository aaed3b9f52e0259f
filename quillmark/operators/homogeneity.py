"""How tightly two groups spread around their own centres, with a paired permutation test.

Everything is long: (uid, block, key, value) joined by label, so centres, scales and
distances are aggregations over keys and accounts.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator, Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.sources.staging import staged

from .features import block_of
from .ordered import medians, percentiles
from .permutations import permutation_ratios
from .significance import six_numbers

_KEY = ["block", "key"]


def centres(long: DataFrame) -> DataFrame:
    """block, key, label, centre: the median of the values that are there."""
    return medians(long, [*_KEY, "label"], "value", "centre")


def residuals(long: DataFrame) -> DataFrame:
    """``long`` (uid, label, block, key, value) with residual: value less its own group's centre."""
    return long.join(F.broadcast(centres(long)), [*_KEY, "label"]).withColumn("residual", F.col("value") - F.col("centre")).drop("centre")


def scales(resid: DataFrame) -> DataFrame:
    """block, key, scale, kind: the median absolute residual over both groups, its mean where
    that is 0; no scale for fewer than two values or where both are 0."""
    sizes = resid.select(*_KEY, F.abs("residual").alias("a"))
    m = sizes.groupBy(*_KEY).agg(F.count("a").alias("n"), F.avg("a").alias("mean")).join(medians(sizes, _KEY, "a", "med"), _KEY)
    kind = (
        F.when(F.col("n") < 2, S.SCALE_UNDEFINED).when(F.col("med") > 0, S.SCALE_MEDIAN).when(F.col("mean") > 0, S.SCALE_MEAN).otherwise(S.SCALE_ZERO)
    )
    scale = F.when(kind == S.SCALE_MEDIAN, F.col("med")).when(kind == S.SCALE_MEAN, F.col("mean"))
    return m.select(*_KEY, scale.alias("scale"), kind.alias("kind"))


def scaled(resid: DataFrame, scale: DataFrame) -> DataFrame:
    """``resid`` with z: absolute residual over scale, 5 at most; null without either."""
    z = F.when(F.col("residual").isNotNull() & F.col("scale").isNotNull(), F.least(F.abs("residual") / F.col("scale"), F.lit(S.RESIDUAL_CAP)))
    return resid.join(F.broadcast(scale.select(*_KEY, "scale")), _KEY, "left").withColumn("z", z)


def distances(z: DataFrame) -> DataFrame:
    """uid, label, part (F, M or R), d, used: the mean of z over its defined features."""
    return z.groupBy("uid", "label", block_of(F.col("block")).alias("part")).agg(F.avg("z").alias("d"), F.count("z").alias("used"))


def homogeneity_ratio(dist: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Per part: the human median distance over the bots'; above 1 the bots spread less."""
    by = keys or ["part"]
    human, bot = (F.max(F.when(F.col("label") == x, F.col("med"))) for x in ("human", "bot"))
    return medians(dist, [*by, "label"], "d", "med").groupBy(*by).agg(F.try_divide(human, bot).alias("ratio"))


def sparse_features(long: DataFrame, least: int) -> DataFrame:
    """block, key, zero_bot, zero_human, dropped: keys that are 0 for so many accounts of
    either group."""
    zero = F.col("value") == 0
    z = long.groupBy(*_KEY).agg(F.count_if(zero & (F.col("label") == "bot")).alias("zero_bot"), F.count_if(zero & (F.col("label") == "human")).alias("zero_human"))
    return z.withColumn("dropped", (F.col("zero_bot") >= least) | (F.col("zero_human") >= least))


def swaps(pairs: int, n: int = S.PERMUTATIONS, seed: int = S.SEED) -> np.ndarray:
    """n x pairs booleans, the same for every part and the sensitivity analysis."""
    return np.random.default_rng(seed).random((n, pairs)) < 0.5


def swap_digest(pairs: int, n: int = S.PERMUTATIONS, seed: int = S.SEED) -> str:
    return hashlib.sha256(swaps(pairs, n, seed).tobytes()).hexdigest()


def p_values(observed: DataFrame, permuted: DataFrame, by: str = "part") -> DataFrame:
    """Per part: one-sided p (ratio at least the observed) and two-sided (on the absolute
    logarithm), both with one added, and the counts behind them."""
    o = F.broadcast(observed.select(by, F.col("ratio").alias("obs")))
    j = permuted.join(o, by)
    ge = F.count_if(F.col("ratio") >= F.col("obs") * (1 - S.RELATIVE_SLACK))
    ge2 = F.count_if(F.abs(F.ln("ratio")) >= F.abs(F.ln("obs")) * (1 - S.RELATIVE_SLACK))
    n = F.count("*")
    return j.groupBy(by).agg(((ge + 1) / (n + 1)).alias("p_one"), ((ge2 + 1) / (n + 1)).alias("p_two"), ge.alias("n_ge"), ge2.alias("n_ge_two"))


class Tables(Mapping):
    """Tables by name, each planned when it is first asked for."""

    def __init__(self, makers: dict[str, Callable[[], DataFrame]]):
        self._makers, self._made = makers, {}

    def __getitem__(self, name: str) -> DataFrame:
        if name not in self._made:
            self._made[name] = self._makers[name]()
        return self._made[name]

    def __iter__(self) -> Iterator[str]:
        return iter(self._makers)

    def __len__(self) -> int:
        return len(self._makers)


def homogeneity(long: DataFrame, pairs: DataFrame, sparse_least: int | None = None, n: int = S.PERMUTATIONS, seed: int = S.SEED) -> Tables:
    """long (uid, block, key, value) and pairs (pair, bot, human): tables named distances,
    ratios, permutation, summary, scale_kinds, sparse and, without sparse features,
    sensitivity."""
    sides = pairs.select("pair", F.explode(F.array(F.struct(F.col("bot").alias("uid"), F.lit("bot").alias("label")), F.struct(F.col("human").alias("uid"), F.lit("human").alias("label")))).alias("s")).select("pair", "s.*")
    matched = staged(long.join(sides, "uid"), "matched")
    resid = residuals(matched)
    scale = scales(resid)
    z = scaled(resid, scale)
    sparse = sparse_features(matched, sparse_least or -(-pairs.count() // 2))

    def distances_of(zz: DataFrame) -> DataFrame:
        return staged(distances(zz).join(sides.select("uid", "pair"), "uid"), "distances")

    def permuted(dist: DataFrame) -> DataFrame:
        d = lambda label: F.max(F.when(F.col("label") == label, F.col("d")))
        return staged(permutation_ratios(dist.groupBy("part", "pair").agg(d("bot").alias("d_bot"), d("human").alias("d_human")), n, seed), "permuted")

    def tested(dist: DataFrame, perm: DataFrame) -> DataFrame:
        ratio = homogeneity_ratio(dist)
        return ratio.join(p_values(ratio, perm), "part")

    def without_sparse() -> DataFrame:
        dist = distances_of(z.join(F.broadcast(sparse.where("not dropped").select(*_KEY)), _KEY, "left_semi"))
        return tested(dist, permuted(dist))

    def quantiles() -> DataFrame:
        q = percentiles(tables["permuted"], ["part"], "ratio", {"q2_5": 0.025, "q50": 0.5, "q97_5": 0.975})
        return q.join(tables["permuted"].groupBy("part").agg(F.max("ratio").alias("most")), "part")

    tables = Tables({
        "distances": lambda: distances_of(z), "permuted": lambda: permuted(tables["distances"]), "ratios": lambda: tested(tables["distances"], tables["permuted"]),
        "permutation": quantiles, "summary": lambda: six_numbers(tables["distances"], ["part", "label"], "d"),
        "scale_kinds": lambda: scale.groupBy(block_of(F.col("block")).alias("part"), "kind").count(), "sparse": lambda: sparse, "sensitivity": without_sparse,
    })
    return tables
