"""Where results go: tables as Parquet or csv, and small files from the driver."""

from __future__ import annotations

import json
import math
import os
from pathlib import Path
from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .staging import staged


def write_wide(wide: DataFrame, path: str, compression: str = "none") -> None:
    """A feature table as csv: sorted by account, missing cells empty, doubles in full."""
    wide.orderBy("uid").write.mode("overwrite").csv(path, header=True, nullValue="", emptyValue="", compression=compression)


def write_store(users: DataFrame, tweets: DataFrame, place: str) -> None:
    """The relational store. Tweets are clustered by account within files, which is what the
    lookups by account need; there are no indexes."""
    users.write.mode("overwrite").parquet(f"{place}/users")
    tweets.repartition("user_id").sortWithinPartitions("user_id", "created_at").write.mode("overwrite").parquet(f"{place}/tweets")


def same_store(stored: DataFrame, rebuilt: DataFrame) -> DataFrame:
    """One boolean: every field equal, order columns included."""
    return stored.exceptAll(rebuilt).unionAll(rebuilt.exceptAll(stored)).agg((F.count("*") == 0).alias("equal"))


def put_cache(rows: DataFrame, place: str) -> None:
    """Replace the partitions (by corpus) that ``rows`` has; others stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("corpus").parquet(place)


def merge_cache(cache: DataFrame, new: DataFrame, keys: tuple[str, ...] = ("corpus", "uid")) -> DataFrame:
    """``cache`` in which the rows of ``new`` replace those of the same keys."""
    return cache.join(new.select(*keys), list(keys), "left_anti").unionByName(new)


def upsert_cache(new: DataFrame, place: str, keys: tuple[str, ...] = ("corpus", "uid")) -> None:
    """Rows of ``new`` in the cache in place of those of the same keys; others stay. Only the
    partitions that ``new`` has are read and written anew."""
    spark = new.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(place)
    if path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(path):
        old = spark.read.schema(new.schema).parquet(place).join(new.select("corpus").distinct(), "corpus", "left_semi")
        new = staged(merge_cache(old.select(*new.columns), new, keys), "merged-cache")
    put_cache(new, place)


class Results:
    """Small files below one folder; a path outside it is refused."""

    def __init__(self, root: str | Path):
        self.root = Path(root).resolve()

    def _inside(self, name: str) -> Path:
        path = (self.root / name).resolve()
        if self.root not in path.parents:
            raise PermissionError(f"{path} is not below {self.root}")
        path.parent.mkdir(parents=True, exist_ok=True)
        return path

    def json(self, name: str, tree: Any) -> Path:
        """Written beside its place and then moved there; numbers that JSON lacks are null."""
        path = self._inside(name)
        part = path.with_name(path.name + ".part")
        part.write_text(json.dumps(plain(tree), ensure_ascii=False, indent=1, allow_nan=False), encoding="utf-8")
        os.replace(part, path)
        return path

    def text(self, name: str, text: str) -> Path:
        path = self._inside(name)
        path.write_text(text, encoding="utf-8")
        return path


def plain(x: Any) -> Any:
    if isinstance(x, dict):
        return {str(k): plain(v) for k, v in x.items()}
    if isinstance(x, list | tuple):
        return [plain(v) for v in x]
    if hasattr(x, "tolist"):
        return plain(x.tolist())
    if isinstance(x, float) and not math.isfinite(x):
        return None
    return x
