"""Tables between the steps of a long plan, in storage that all executors share.

A step that reads a written table starts from committed files, however long the plan before
it was and whatever became of the executors that ran it.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def staging_place(spark: SparkSession, label: str) -> str:
    """A new folder under ``spark.checkpoint.dir``; under one of our own where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="quillmark-"))
        root = spark.sparkContext.getCheckpointDir()
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def widened(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if its scan has fewer splits than there are: one small file would
    keep one core busy. A large input has more splits and is left as it is."""
    n = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(n) if df.rdd.getNumPartitions() < n else df


#: Places that this driver has staged tables at and not removed.
_places: list[str] = []


def staged(df: DataFrame, label: str) -> DataFrame:
    """``df`` written and read back. It stays until ``cleared``."""
    place = staging_place(df.sparkSession, label)
    _places.append(place)
    df.write.parquet(place)
    return df.sparkSession.read.schema(df.schema).parquet(place)


def cleared(spark: SparkSession) -> None:
    """Delete every table that ``staged`` made here. Results read them, so call this when the
    results themselves were written or are not needed any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    while _places:
        path = jvm.org.apache.hadoop.fs.Path(_places.pop())
        path.getFileSystem(conf).delete(path, True)
