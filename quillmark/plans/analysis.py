"""Group differences with three controls, and homogeneity of matched groups."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.operators import homogeneity, matching, significance
from quillmark.operators.ordered import numbered
from quillmark.sources.staging import staged


def matched_pairs(info: DataFrame, tokens: str = S.COUNT_COLUMNS[3], seed: int = S.MATCH_SEED, source: str | None = None) -> DataFrame:
    """info (uid, label, tokens[, source]) to pair, bot, human, gap; accounts without tokens
    take no part. ``source`` keeps the humans of one source."""
    own = info.where(F.col(tokens) > 0)
    if source is not None:
        own = own.where((F.col("label") == "bot") | (F.col("source") == source))
    found = matching.caliper_match(own.select("uid", "label", F.ln(tokens).alias("logn")), seed=seed).where("human is not null")
    return numbered(found, "place", "pair").select("pair", "bot", "human", "gap")


def pair_members(pairs: DataFrame) -> DataFrame:
    return pairs.select(F.explode(F.array("bot", "human")).alias("uid"))


def differences(base: DataFrame, labels: DataFrame, controls: dict[str, tuple[DataFrame, DataFrame]]) -> dict[str, DataFrame]:
    """The baseline comparison and, for each control (long features, labels), its effects
    beside the baseline's; tables ``baseline`` and ``control:<name>``, tallies ``tally:<name>``."""
    first = staged(significance.compare_groups(base, labels), "baseline")
    out = {"baseline": first}
    for name, (long, own) in controls.items():
        out[f"control:{name}"] = significance.effect_status(significance.compare_groups(long, own), first)
        out[f"tally:{name}"] = significance.status_tallies(out[f"control:{name}"])
    return out


def matched_homogeneity(long: DataFrame, pairs: DataFrame, n: int = S.PERMUTATIONS) -> homogeneity.Tables:
    return homogeneity.homogeneity(long, pairs, n=n)
