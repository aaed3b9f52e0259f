"""Checks: file hashes, comparisons of tables and trees, invariants, metadata redaction."""

from __future__ import annotations

import copy
import functools
import math
from collections.abc import Callable, Iterator, Sequence
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def file_hashes(spark: SparkSession, paths: Sequence[str] | str) -> DataFrame:
    """path, sha256 of each file (of any size that fits a row: 2 GB)."""
    files = spark.read.format("binaryFile").load(paths if isinstance(paths, str) else list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def wrong_hashes(found: DataFrame, manifest: DataFrame) -> DataFrame:
    """Rows of the manifest (name, sha256) whose file is missing or differs; a path's end
    names it."""
    named = found.withColumn("name", F.regexp_extract("path", r"([^/]+)$", 1)).select("name", F.col("sha256").alias("found"))
    return manifest.join(named, "name", "left").where(~F.col("sha256").eqNullSafe(F.col("found")))


def fingerprint(df: DataFrame, columns: Sequence[str], name: str = "fingerprint") -> DataFrame:
    """``df`` with the hash of its columns' JSON."""
    return df.withColumn(name, F.sha2(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}), 256))


def reuse_cached(wanted: DataFrame, cache: DataFrame, keys: Sequence[str] = ("corpus", "uid"), mark: str = "fingerprint") -> tuple[DataFrame, DataFrame]:
    """(hits with the cached columns, misses): an entry counts only if its hash agrees."""
    by = [*keys, mark]
    return wanted.join(cache, by), wanted.join(cache.select(*by), by, "left_anti")


def flatten(tree: Any, path: str = "") -> Iterator[tuple[str, str, str | None, float | None]]:
    """Leaves of a JSON tree: path, kind, text, number. A list also gives its length."""
    if isinstance(tree, dict):
        for k, v in tree.items():
            yield from flatten(v, f"{path}/{k}")
    elif isinstance(tree, list):
        yield f"{path}/#", "length", None, float(len(tree))
        for i, v in enumerate(tree):
            yield from flatten(v, f"{path}/{i}")
    elif isinstance(tree, bool):
        yield path, "bool", str(tree).lower(), None
    elif isinstance(tree, int | float):
        finite = math.isfinite(tree)
        yield path, "number" if finite else "null", None, float(tree) if finite else None
    else:
        yield path, "null" if tree is None else "text", tree, None


LEAVES = "path string, kind string, text string, number double"


def leaves(spark: SparkSession, tree: Any) -> DataFrame:
    return spark.createDataFrame(list(flatten(tree)), LEAVES)


def tree_diff(actual: DataFrame, expected: DataFrame, tolerance: Callable[[Column], Column] | float = 1e-10) -> DataFrame:
    """path, problem for every expected leaf that is missing, of another kind or off by more
    than the tolerance (absolute and relative, by path); further actual leaves are fine."""
    t = tolerance(F.col("path")) if callable(tolerance) else F.lit(tolerance)
    a = actual.select("path", F.col("kind").alias("a_kind"), F.col("text").alias("a_text"), F.col("number").alias("a_number"))
    off = F.abs(F.col("a_number") - F.col("number")) > t + t * F.abs("number")
    problem = (
        F.when(F.col("a_kind").isNull(), "missing")
        .when(F.col("a_kind") != F.col("kind"), "kind")
        .when(off, "number")
        .when(~F.col("a_text").eqNullSafe(F.col("text")), "text")
    )
    return expected.join(a, "path", "left").withColumn("problem", problem).where("problem is not null").select("path", "problem")


def synthetic_tolerance(path: Column, loose: float = 1e-3, strict: float = 1e-10) -> Column:
    """Looser for the resampled worlds of an evaluation set, where equal donors tie."""
    part = F.split(path, "/")
    return F.when((F.get(part, F.lit(1)) == "집합") & F.substring(F.get(part, F.lit(3)), 1, 2).isin("W2", "W3"), loose).otherwise(strict)


def table_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], tolerance: float = 0.0) -> DataFrame:
    """keys, column of every cell that differs, missing cells included; a row of one side only
    differs in ``*``."""
    cols = [c for c in a.columns if c not in keys]
    l, r = a.select(*keys, F.struct(*cols).alias("l")), b.select(*keys, F.struct(*cols).alias("r"))
    kinds = dict(a.dtypes)

    def differs(c: str) -> Column:
        x, y = F.col(f"l.`{c}`"), F.col(f"r.`{c}`")
        if tolerance and kinds[c] in ("double", "float"):
            return ~(x.eqNullSafe(y) | F.coalesce(F.abs(x - y) <= tolerance + tolerance * F.abs(y), F.lit(False)))
        return ~x.eqNullSafe(y)

    found = F.array(*(F.when(differs(c), F.lit(c)) for c in cols))
    whole = F.col("l").isNull() | F.col("r").isNull()
    names = F.when(whole, F.array(F.lit("*"))).otherwise(F.filter(found, lambda x: x.isNotNull()))
    return l.join(r, list(keys), "full").select(*keys, F.explode(names).alias("column"))


def require(df: DataFrame, condition: Column, message: str) -> DataFrame:
    """``df``; raises when it runs and a row breaks the condition."""
    return df.where(F.when(condition, F.lit(True)).otherwise(F.raise_error(F.lit(message)).cast("boolean")))


# -- metadata ------------------------------------------------------------------------------------

# Keys of the settings that a published file leaves out, those left out of a part
# of them, the part whose paths are shortened, and the public names of the inputs.
DROPPED_SETTINGS = ("실행", "smoke", "시험입력", "관문통과", "사전선언", "구현결정", "관문", "속도", "소요")
DROPPED_WITHIN = {"정제규칙": ("출처",), "모델ID표": ("미정_표기", "결정", "비고")}
SHORTENED = ("파이프라인", "모델경로")
INPUT_NAMES = {
    "원본JSON": "botsim_documents",
    "Users.csv": "botsim_users",
    "01_py": "botsim_screening_code",
    "02_기능어": "function_word_list",
    "09-2_JSON": "comment_only_accounts",
    "분할.json": "split_configuration",
    "프롬프트대장.jsonl": "prompt_records",
    "준비_요약.json": "preparation_summary",
    "완전모방기_문서.jsonl": "example_texts",
    "12-0_py": "fox8_extraction_code",
    "12-0_JSON": "fox8_measurements",
    "fox8_sqlite": "fox8_database",
    "13-0_계정사전.json": "control_measurements",
    "모델ID표.json": "generation_models",
}


def redact_settings(
    settings: dict,
    dropped: Sequence[str] = DROPPED_SETTINGS,
    within: dict[str, Sequence[str]] = DROPPED_WITHIN,
    shortened: Sequence[str] = SHORTENED,
    renamed: dict[str, str] = INPUT_NAMES,
    inputs: str = "입력",
    shorten_at: str = "/resources/",
    replaced: dict[tuple[str, ...], Any] | None = None,
) -> dict:
    """A copy without the dropped keys, at the top and within the parts named. The paths of one
    part, and no others, are cut after ``shorten_at``; each input stands under its public name
    with nothing but its hash. ``replaced`` gives what a publication writes in place of some
    values; those whose part is not there are left out. Redacting twice changes nothing."""
    out = copy.deepcopy({k: v for k, v in settings.items() if k not in dropped})
    for part, keys in within.items():
        if isinstance(out.get(part), dict):
            out[part] = {k: v for k, v in out[part].items() if k not in keys}
    *above, last = shortened
    part = functools.reduce(lambda x, k: x.get(k, {}), above, out)
    if last in part:
        part[last] = {k: v.rpartition(shorten_at)[2] for k, v in part[last].items()}
    if inputs in out:
        out[inputs] = {renamed.get(k, k): v["sha256"] if isinstance(v, dict) else v for k, v in out[inputs].items()}
    for (*above, last), value in (replaced or {}).items():
        part = functools.reduce(lambda x, k: x.get(k) if isinstance(x, dict) else None, above, out)
        if isinstance(part, dict):
            part[last] = copy.deepcopy(value)
    return out
