"""Counts to features: rates, axis ratios and the long and wide feature tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillmark import schema as S
from quillmark.functions.numeric import even_round, ratio


def assemble(totals: DataFrame, counts: DataFrame, rhythm: DataFrame, keys: DataFrame, exact_rounding: bool = False) -> DataFrame:
    """Long features (uid, block, key, value) for every account and every key of the
    dimension: a key that an account lacks is 0, a denominator that is 0 gives null.

    Function-word rates are counts over tokens without punctuation, rounded to six digits
    (``exact_rounding``: as Python rounds). A morphological key is divided by its axis's
    total where the axis has two values or more, else by tokens without punctuation, as
    parts of speech are. The key dimension is broadcast; accounts are not shuffled for it.
    """
    own = counts.where("block <> 'R'")
    axis = own.where(F.col("block") == "M형태").groupBy("uid", F.split_part("key", F.lit("="), F.lit(1)).alias("axis")).agg(F.sum("n").alias("axis_n"))
    grid = totals.select("uid", "words").crossJoin(F.broadcast(keys.where("block <> 'R'")))
    grid = grid.join(own, ["uid", "block", "key"], "left").join(axis, ["uid", "axis"], "left")
    n = F.coalesce("n", F.lit(0))
    rate = ratio(n, F.col("words"))
    rounded = even_round(rate, S.RATE_DIGITS) if exact_rounding else F.round(rate, S.RATE_DIGITS)
    value = (
        F.when(F.col("block") == "F", rounded)
        .when((F.col("block") == "M형태") & (F.col("axis_card") >= 2), ratio(n, F.coalesce("axis_n", F.lit(0))))
        .otherwise(rate)
    )
    lexical = grid.select("uid", "block", "key", value.alias("value"))
    three = F.array(*(F.struct(F.lit("R").alias("block"), F.lit(k).alias("key"), F.col(c).cast("double").alias("value")) for k, c in zip(S.RHYTHM_KEYS, ("mean_length", "punct_share", "length_cv"))))
    flat = totals.select("uid").join(rhythm, "uid", "left").select("uid", F.explode(three).alias("r")).select("uid", "r.*")
    return lexical.unionByName(flat)


def axis_ratios(counts: DataFrame, keys: Sequence[str], axis: str, n: str, multi: Column, fallback: Column) -> DataFrame:
    """Counts (keys, axis, n) with ``ratio``: over the axis's total where ``multi`` holds,
    else over ``fallback``."""
    totals = counts.groupBy(*keys, axis).agg(F.sum(n).alias("_t"))
    return counts.join(totals, [*keys, axis]).withColumn("ratio", F.when(multi, ratio(F.col(n), F.col("_t"))).otherwise(ratio(F.col(n), fallback))).drop("_t")


def to_wide(long: DataFrame, keys: Sequence[tuple[str, str]], info: DataFrame | None = None) -> DataFrame:
    """uid (and info columns), then one column ``block|key`` per key, in the order given."""
    name = F.concat_ws("|", "block", "key")
    wide = long.select("uid", name.alias("name"), "value").groupBy("uid").pivot("name", [f"{b}|{k}" for b, k in keys]).agg(F.first("value"))
    return wide if info is None else info.join(wide, "uid")


def to_long(wide: DataFrame, info: Sequence[str] = ()) -> DataFrame:
    """Columns with a bar in their name to (uid, block, key, value), split at the first bar."""
    names = [c for c in wide.columns if "|" in c]
    flat = wide.unpivot(["uid", *info], [F.col(f"`{c}`").cast("double") for c in names], "name", "value") if names else None
    assert flat is not None
    at = F.instr("name", F.lit("|"))
    return flat.select("uid", *info, F.expr("substring(name, 1, instr(name, '|') - 1)").alias("block"), F.expr("substring(name, instr(name, '|') + 1)").alias("key"), "value").where(at > 0)


def to_vectors(long: DataFrame, keys: DataFrame, value: str = "value") -> DataFrame:
    """uid, vec: values as an array in the order of the key dimension, null where missing."""
    placed = long.join(F.broadcast(keys.select("block", "key", "ord")), ["block", "key"])
    return placed.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("ord", F.col(value).alias("v")))), lambda x: x["v"]).alias("vec"))


def block_of(block: Column) -> Column:
    """F, M or R: morphology and parts of speech are one block."""
    return F.when(block.isin("M형태", "M품사"), "M").otherwise(block)
